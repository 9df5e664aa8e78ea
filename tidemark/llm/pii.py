"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Every kind has a pattern, a validator and context words. The four basic kinds (email, ip, card, phone) are reported
whenever their pattern and validator hold; their score says how sure the match is. The further kinds (iban,
national_id, account) are weaker, so they also need a score of at least ``MIN_SCORE``.

Patterns take time in proportion to the text: a run of characters that can't match is looked at once, whatever its
length (a lookbehind stops retries inside a run, where a match from the run's start would have been found already).
"""
from __future__ import annotations

import re
from dataclasses import dataclass
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPAN, map_rows, replace_column, span_digest

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "iban", "national_id", "account")
MIN_SCORE = 0.6
CONTEXT_CHARS = 48

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, found from each @ to both sides."""
    free, last = 0, 0
    at = text.find("@")
    while at >= 0:
        # the local part can reach neither into the last match nor over another @
        low = max(free, last)
        start = low + len(text[low:at].rstrip(_LOCAL))
        host = _HOST.match(text, at + 1) if start < at else None
        if host:
            free = host.end()
            yield start, free
        last = at + 1
        at = text.find("@", last)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _digits(s: str) -> str:
    return re.sub(r"[^0-9]", "", s)


def _ip(s: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in s.split("."))


def _card(s: str) -> bool:
    d = _digits(s)
    return 12 <= len(d) <= 19 and luhn(d)


def _phone(s: str) -> bool:
    return 9 <= len(_digits(s)) <= 15


def _iban(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and mod97(s)


def _national(s: str) -> bool:
    area, group, serial = s.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


@dataclass(frozen=True)
class Kind:
    name: str
    find: Callable[[str], Iterator[tuple[int, int]]]
    valid: Callable[[str], bool]
    base: float
    context: re.Pattern
    against: re.Pattern = re.compile(r"(?!)")
    needs: str = "0123456789"


def _by(pattern: str) -> Callable[[str], Iterator[tuple[int, int]]]:
    compiled = re.compile(pattern)
    return lambda text: (m.span() for m in compiled.finditer(text))


def _words(words: str) -> re.Pattern:
    return re.compile(rf"(?ai)\b(?:{words})\b")


RULES = (
    Kind("email", emails, lambda s: True, 0.8, _words("e-?mail|mail|contact|write|reach"), _words("example|noreply|test"), "@"),
    Kind("ip", _by(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"), _ip, 0.6, _words("ip|host|server|address|login|from"), _words("version|release|v")),
    Kind("card", _by(r"[0-9](?:[ -]?[0-9])++"), _card, 0.7, _words("card|visa|credit|debit|pay|payment|cvv"), _words("order|isbn|serial|sku")),
    Kind("phone", _by(r"\+[0-9][ ().0-9-]+[0-9]"), _phone, 0.6, _words("phone|tel|telephone|mobile|call|fax|cell|whatsapp"), needs="+"),
    Kind("iban", _by(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"), _iban, 0.9,
         _words("iban|bank|account|transfer|swift|bic")),
    Kind("national_id", _by(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"), _national, 0.5, _words("ssn|social|security|taxpayer|tin"),
         _words("part|serial|sku|model")),
    Kind("account", _by(r"(?<![0-9A-Za-z.+-])[0-9]{8,17}(?![0-9A-Za-z.-])"), lambda s: len(set(s)) > 2, 0.3,
         _words("account|acct|routing|passport|licen[cs]e number|customer number")),
)


def score(kind: Kind, text: str, start: int, end: int) -> float:
    """The kind's own weight, raised by a context word on either side and lowered by a contrary one."""
    near = text[max(0, start - CONTEXT_CHARS):start] + " \n " + text[end:end + CONTEXT_CHARS]
    s = kind.base + 0.35 * bool(kind.context.search(near)) - 0.25 * bool(kind.against.search(near))
    return round(min(1.0, max(0.0, s)), 2)


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start and then by the order of kinds; offsets are code points."""
    if not text:
        return []
    found = []
    digits = re.search("[0-9]", text) is not None
    for order, kind in enumerate(RULES):
        if kind.needs == "0123456789" and not digits or kind.needs in "@+" and kind.needs not in text:
            continue
        for start, end in kind.find(text):
            if kind.valid(text[start:end]):
                s = score(kind, text, start, end)
                if kind.name in BASE_KINDS or s >= MIN_SCORE:
                    found.append((start, order, kind.name, end, s))
    found.sort()
    return [(name, start, end, s) for start, _, name, end, s in found]


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of personal data of each row.

    Null and empty texts have none; repeated rows give repeated results; an empty table gives none; other columns
    are not read.
    """
    def start():
        return lambda doc_id, text: (doc_id, [dict(zip(("kind", "start", "end", "score"), s)) for s in find_spans(text)])
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), f"doc_id long, found {SPAN}", start)


def mask(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """The rows with each span of at least ``min_score`` replaced by its kind in angle brackets."""
    def start():
        def new(text):
            out, last = [], 0
            for kind, a, b, s in find_spans(text):
                if s >= min_score and a >= last:
                    out += [text[last:a], f"<{kind}>"]
                    last = b
            return text if not out else "".join(out) + text[last:]
        return new
    return replace_column(docs, "text", start)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the basic kinds, a digest of their spans, and all spans as text."""
    return span_digest(found, BASE_KINDS)
