"""Secrets: lex assignments out of source and configuration text and score literals by the names they are given to.

Three basic patterns (a sensitive word assigned a value, access keys, long hexadecimal runs) are always reported. The
lexer adds ``literal`` spans: from every name it reads on into (name, value) pairs, in the forms ``name = "value"``,
``name: value``, ``name: type = "value"``, ``"name": "value"``, ``map["name"] = "value"``, ``export NAME=value``, ``name := 'value'``,
``<name>value</name>``, ``key="name" value="value"``, ``setName("value")``, ``define("NAME", "value")`` and indented blocks. A value is
literals (prefixed, in three quotes, or with holes too) and names joined by ``+``, ``.`` or nothing, in parentheses over several lines, or a list
of literals that count one by one. A call isn't a literal. Reading starts anew at each name, so that an apostrophe in prose hides nothing. A name's value is remembered for the rest of the text, so that one
that is handed on (``key = "..."; password = key``) is found at the literal it comes from. Values refer to the values they are made of
and are scored by summaries that add up, so neither long sums nor repeated doubling are ever written out.
"""
from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import SPAN, map_rows, replace_column, span_digest

BASE_KINDS = ("assign", "access", "hex")
MIN_SCORE = 0.6
MIN_LITERAL = 6
#: Characters at a value's ends by which a summary knows placeholders; longer than any word of one.
EDGE = 16

_ASSIGN = re.compile(r"""(?ai)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")

_NAME = r"[A-Za-z_$][A-Za-z0-9_$.-]*+"
# prefixes of Python's literals, three quotes over several lines, one quote within a line
_LITERAL = (r"""[rRbBuUfF]{0,2}(?:\"""(?:[^"\\]|\\[\s\S]|"(?!""))*+\"""|\'\'\'(?:[^'\\]|\\[\s\S]|'(?!''))*+\'\'\'"""
            r"""|"(?!"")(?:[^"\\\n]|\\.)*+"|'(?!'')(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)""")
_BARE = r"""[^\s"'`,;<>(){}\[\]]++"""
_TYPE = rf"(?P<type>{_NAME})(?:\[[^\]\n]*+\])?+\??+(?:[ \t]*+\|[ \t]*+{_NAME})*+"
_ASSIGNS = rf"(?::=|=>|=(?!=)|:[ \t]*+{_TYPE}[ \t]*+=(?!=)|:)"
# literals that follow each other, and literals and names joined by + or .
_JOINED = rf"(?:{_LITERAL}|{_BARE})(?:[ \t]*+[+.][ \t]*+(?:{_LITERAL}|{_NAME})|[ \t]++{_LITERAL})*+"
_GROUP = rf"\((?:\s*+{_LITERAL}[ \t]*+[+.]?+)++\s*+\)"
_LIST = rf"\[(?:\s*+{_LITERAL}\s*+,?+)++\s*+\]"
# the name must not continue a longer one, so that a long run of name characters is read once
_PAIR = re.compile(rf"""(?<![A-Za-z0-9_$.-])(?P<q>["']?)(?P<name>{_NAME})(?P=q)(?:[ \t]*+\[?\])?+[ \t]*+{_ASSIGNS}[ \t]*+(?P<value>{_JOINED}|(?P<group>{_GROUP})|(?P<list>{_LIST}))""")
_TAG = re.compile(rf"<(?P<name>{_NAME})>(?P<value>[^<>\n]++)</")
#: ``<add key="password" value="..."/>``
_ATTRIBUTES = re.compile(rf"""(?<![A-Za-z0-9_$.-])(?:key|name|id)\s*+=\s*+(?P<q>["'])(?P<name>{_NAME})(?P=q)\s++value\s*+=\s*+(?P<value>{_LITERAL})""")
#: ``setPassword("...")`` and ``.withToken("...")``; ``define("DB_PASSWORD", "...")``
_SETTER = re.compile(rf"""(?<![A-Za-z0-9_$-])(?P<name>(?:set|with)_?[A-Za-z][A-Za-z0-9_]*+)\(\s*+(?P<value>{_LITERAL})\s*+\)""")
_CALL = re.compile(rf"""(?<=[A-Za-z0-9_])\(\s*+(?P<q>["'])(?P<name>{_NAME})(?P=q)\s*+,\s*+(?P<value>{_LITERAL})""")
_PART = re.compile(rf"(?P<literal>{_LITERAL})|(?P<bare>[^\s+\"'`]+)")
_HOLE = re.compile(r"\{([^{}]*)\}")
_CALLED = re.compile(r"[A-Za-z_][A-Za-z0-9_.]*\Z")

#: Sensitive parts of names with their weights, and parts that speak against a secret.
SENSITIVE = (("password", .6), ("passwd", .6), ("passphrase", .6), ("pwd", .5), ("secret", .6), ("token", .5), ("apikey", .6), ("api_key", .6),
             ("access_key", .6), ("private_key", .6), ("credential", .5), ("auth", .35), ("signing", .35), ("encryption_key", .6), ("dsn", .35),
             ("connection_string", .45))
HARMLESS = ("path", "file", "name", "url", "label", "field", "regex", "length", "expire", "hint", "policy", "type", "count", "id_column")
PLACEHOLDER_START = re.compile(r"(?i)your|my|the|some|change|replace|example|dummy|test|none|null|true|false|todo|<|\$\{|\{\{|%")
PLACEHOLDER_INSIDE = re.compile(r"(?i)example|placeholder|changeme|redacted")


class Summary:
    """What scoring needs of a string: characters with counts (times 2 ** ``exp``), both ends, whether a placeholder's word is inside."""

    __slots__ = ("counts", "size", "exp", "head", "tail", "inside")

    def __init__(self, text: str = ""):
        self.counts: dict[str, float] = dict(Counter(text))
        self.size: float = len(text)
        self.exp = 0
        self.head, self.tail = text[:EDGE], text[-EDGE:]
        self.inside = bool(PLACEHOLDER_INSIDE.search(text))

    @classmethod
    def total(cls, strings: list[Summary]) -> Summary:
        """The summary of strings one after the other."""
        if len(strings) == 1:
            return strings[0]
        out = cls()
        for s in strings:
            out._append(s)
        return out

    def _scale(self, by: int) -> None:
        factor = 2.0 ** -by
        self.counts = {k: n * factor for k, n in self.counts.items()}
        self.size, self.exp = self.size * factor, self.exp + by

    def _append(self, other: Summary) -> None:
        if other.exp > self.exp:
            self._scale(other.exp - self.exp)
        factor = 2.0 ** (other.exp - self.exp)
        for k, n in other.counts.items():
            self.counts[k] = self.counts.get(k, 0) + n * factor
        self.size += other.size * factor
        if self.size > 2.0 ** 900:
            self._scale(500)
        self.inside = self.inside or other.inside or bool(PLACEHOLDER_INSIDE.search(self.tail + other.head))
        # an end is shorter than EDGE only if it is the whole string
        self.head = self.head if len(self.head) == EDGE else (self.head + other.head)[:EDGE]
        self.tail = other.tail if len(other.tail) == EDGE else (self.tail + other.tail)[-EDGE:]

    def entropy(self) -> float:
        return -sum(c / self.size * math.log2(c / self.size) for c in self.counts.values() if c / self.size > 0) if self.size else 0.0

    def placeholder(self) -> bool:
        return self.inside or bool(PLACEHOLDER_START.match(self.head)) or bool(self.counts) and (self.counts.keys() <= {"x", "X"} or self.counts.keys() == {"*"})

    def at_least(self, n: int) -> bool:
        return self.exp > 0 or self.size >= n


class Value:
    """A value as its parts in order: spans of literals, and earlier values that names stand for."""

    __slots__ = ("parts", "summary", "score")

    def __init__(self, parts: list[tuple[int, int] | Value], summary: Summary):
        self.parts, self.summary, self.score = parts, summary, 0.0


def name_weight(name: str) -> float:
    plain = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower().replace("-", "_").replace(".", "_")
    w = max((w for part, w in SENSITIVE if part in plain), default=0.0)
    return w - 0.4 * any(part in plain.split("_")[-1:] for part in HARMLESS) if w else 0.0


def literal_score(weight: float, value: Summary) -> float:
    """0 to 1: how much a name's weight speaks of secrets, and the value looks like one."""
    if weight <= 0 or not value.at_least(MIN_LITERAL) or value.placeholder():
        return 0.0
    kinds = sum(any(re.match(p, c) for c in value.counts) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9\\s]"))
    look = 0.1 * value.at_least(12) + 0.1 * (kinds >= 2) + 0.05 * (kinds >= 3) + 0.2 * (value.entropy() >= 3) - 0.3 * (" " in value.counts)
    return round(min(1.0, max(0.0, weight + look)), 2)


Item = tuple[tuple[int, int] | None, str | None]


def _inside(text: str, start: int, end: int) -> list[Item]:
    """Spans between a literal's quotes; of one with an ``f`` those around its holes, and the names in the holes."""
    at = start
    while text[at] not in "\"'`":
        at += 1
    n = 3 if text[at] * 3 == text[at:at + 3] and end - at >= 6 else 1
    low, high = at + n, end - n
    if "f" not in text[start:at].lower():
        return [((low, high), None)]
    out: list[Item] = []
    for hole in _HOLE.finditer(text, low, high):
        out += [((low, hole.start()), None), (None, hole[1].strip())]
        low = hole.end()
    return [*out, ((low, high), None)]


def _block(text: str, name: int, end: int) -> tuple[int, int] | None:
    """Span of the lines below a line that are indented deeper than it."""
    line = text.rfind("\n", 0, name) + 1
    indent = len(text[line:name]) - len(text[line:name].lstrip(" -"))
    if text[line:name].strip(" -"):
        return None
    at = text.find("\n", end) + 1
    if not at or text[end:at].strip():
        return None
    first = last = None
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        words = text[at:stop].lstrip(" ")
        if words.strip():
            if stop - at - len(words) <= indent:
                break
            first, last = (stop - len(words) if first is None else first), stop
        at = stop + 1
    return None if first is None else (first, last)


def _read(text: str, m: re.Match) -> list[list[Item]]:
    """The values that a match gives its name. Each is items in order: a literal's span, a name in a hole, or a bare word, which may be either."""
    low, high = m.span("value")
    if m.re is _TAG:
        return [[((low, high), None)]]
    if m.re is not _PAIR:
        return [_inside(text, low, high)]
    if m["list"]:
        return [_inside(text, *p.span()) for p in _PART.finditer(text, low + 1, high - 1) if p["literal"]]
    if m["value"].rstrip("+-") in ("|", ">"):
        span = _block(text, m.start(), high)
        return [[(span, None)]] if span else []
    items: list[Item] = []
    for p in _PART.finditer(text, low + bool(m["group"]), high - bool(m["group"])):
        if p["literal"]:
            items += _inside(text, *p.span())
        elif p["bare"] != "." and not (p.end() == high and text[high:high + 1] == "(" and _CALLED.match(p["bare"])):
            # a name that is called isn't a literal, and neither is what the call gives
            items.append((p.span(), p["bare"]))
    return [items]


def scored_values(text: str) -> list[Value]:
    """The values of all names in order, each with its score; names in values stand for the values they were given last."""
    found: list[tuple[int, re.Match]] = []
    if "=" in text or ":" in text:
        found += [(m.start("name"), m) for m in _PAIR.finditer(text)]
    if "</" in text:
        found += [(m.start("name"), m) for m in _TAG.finditer(text)]
    if "value" in text:
        found += [(m.start("name"), m) for m in _ATTRIBUTES.finditer(text)]
    if "(" in text:
        found += [(m.start("name"), m) for form in (_SETTER, _CALL) for m in form.finditer(text)]
    # what looks like a type may be the name itself, as in "note: password = ..."
    names = lambda m: [m["name"], *([m["type"]] if m.re is _PAIR and m["type"] else [])]
    weights = {name: name_weight(name) for _, m in found for name in names(m)}
    if not any(w > 0 for w in weights.values()):
        return []
    known: dict[str, Value] = {}
    out: list[Value] = []
    for _, m in sorted(found, key=lambda x: x[0]):
        for read in _read(text, m):
            parts: list[tuple[int, int] | Value] = []
            for span, bare in read:
                if bare in known:
                    parts.append(known[bare])
                elif span:
                    parts.append(span)
            value = Value(parts, Summary.total([p.summary if isinstance(p, Value) else Summary(text[p[0]:p[1]]) for p in parts]))
            value.score = literal_score(max(weights[name] for name in names(m)), value.summary)
            known |= dict.fromkeys(names(m), value)
            out.append(value)
    return out


def literal_spans(text: str) -> dict[tuple[int, int], float]:
    """Literals that reach a sensitive name, with the best score of those names; each value hands its score down once."""
    literals: dict[tuple[int, int], float] = {}
    for value in reversed(scored_values(text)):  # all values that refer to it come later
        if value.score < MIN_SCORE:
            continue
        for part in value.parts:
            if isinstance(part, Value):
                part.score = max(part.score, value.score)
            elif part[1] > part[0]:
                literals[part] = max(value.score, literals.get(part, 0.0))
    return literals


def base_spans(text: str) -> list[tuple[int, int, str, int, float]]:
    out = []
    low = text.lower() if text.isascii() else None
    if low is None or any(w in low for w in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, "assign", m.end(), 0.8) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, "access", m.end(), 0.9) for m in _ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), 2, "hex", m.end(), 0.7) for m in _HEX.finditer(text)]
    return out


def find_secrets(text: str | None) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start and then by the order of kinds; offsets are code points."""
    if not text:
        return []
    found = base_spans(text)
    found += [(a, 3, "literal", b, s) for (a, b), s in literal_spans(text).items()]
    found.sort()
    return [(kind, a, b, s) for a, _, kind, b, s in found]


def secrets(docs: DataFrame) -> DataFrame:
    """doc_id and the spans of secrets of each row.

    Null and empty texts have none; repeated rows give repeated results; an empty table gives none; other columns
    are not read.
    """
    def start():
        return lambda doc_id, text: (doc_id, [dict(zip(("kind", "start", "end", "score"), s)) for s in find_secrets(text)])
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), f"doc_id long, found {SPAN}", start)


def redact(docs: DataFrame, mark: str = "<secret>") -> DataFrame:
    """All rows and columns, with the secrets in ``text`` replaced by a mark; spans that overlap are replaced as one.

    Of an assignment only the value goes. Texts without secrets, null ones included, stay as they are.
    """
    def start():
        def new(text):
            cuts = []
            for kind, a, b, _ in find_secrets(text):
                if kind == "assign":
                    a = _ASSIGN.match(text, a).start(2)
                cuts.append((a, b))
            out, last = [], 0
            for a, b in sorted(cuts):
                if a >= last:
                    out += [text[last:a], mark]
                last = max(last, b)
            return text if not out else "".join(out) + text[last:]
        return new
    return replace_column(docs, "text", start)


def digest(found: DataFrame) -> DataFrame:
    """Counts of the basic kinds, a digest of their spans, and all spans as text."""
    return span_digest(found, BASE_KINDS)
