"""Benchmark decontamination with an Aho-Corasick automaton over normalised test items.

Texts and items become lower-cased words joined by single blanks. Every run of ten consecutive words of an item (or the
whole item, if it has fewer) is a pattern with a blank at either end. One automaton holds all patterns and reads each
text once; ends of matches become word numbers, and word numbers become offsets in the original text.

The automaton is sent to every task, so its patterns' bytes are checked first: items are dealt into as many parts as keep each
automaton below ``max_bytes``, and each part scans the texts on its own.
"""
from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import alnum_words, keep_rows, map_rows

WINDOW = 10
#: Bytes of patterns in one automaton; it takes about 40 times as much memory.
AUTOMATON_BYTES = 4 << 20
#: The same words in a text that is not lower-cased yet.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def item_windows(text: str | None, window: int = WINDOW) -> set[str]:
    """Patterns of one item; bytes of UTF-8 stand as one character each."""
    words = alnum_words(text)
    if not words:
        return set()
    n = min(window, len(words))
    return {f" {b' '.join(words[i:i + n]).decode('latin-1')} " for i in range(len(words) - n + 1)}


class Scanner:
    """The automaton over (item_id, text) rows."""

    def __init__(self, items: list[tuple[int, str | None]], window: int = WINDOW):
        import ahocorasick

        owners: dict[str, list[int]] = {}
        for item, text in items:
            for p in item_windows(text, window):
                owners.setdefault(p, []).append(item)
        self.machine = ahocorasick.Automaton()
        for p, who in owners.items():
            self.machine.add_word(p, (len(p), p.count(" ") - 1, tuple(who)))
        self.empty = not owners
        if owners:
            self.machine.make_automaton()

    def __call__(self, text: str | None) -> tuple[int, list[tuple[int, int]], set[int]]:
        """Number of words, the hit stretches of words (first, end; merged), and the items that occur."""
        words = alnum_words(text)
        if not words or self.empty:
            return len(words), [], set()
        line = b" " + b" ".join(words) + b" "
        hits, items = [], set()
        for end, (length, n, who) in self.machine.iter(line.decode("latin-1")):
            hits.append((end - length + 1, n))
            items.update(who)
        if not hits:
            return len(words), [], items
        blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
        firsts = np.searchsorted(blanks, [at for at, _ in hits])
        return len(words), merge([(int(f), int(f) + n) for f, (_, n) in zip(firsts, hits)]), items


def original_offsets(text: str, stretches: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Code-point offsets in the original text of stretches of words."""
    spans = [m.span() for m in _WORD.finditer(text)]
    for a, b in stretches:
        yield spans[a][0], spans[b - 1][1]


def item_parts(items: DataFrame, max_bytes: int = AUTOMATON_BYTES, window: int = WINDOW) -> Iterator[list[tuple[int, str | None]]]:
    """The items in parts whose patterns take at most about ``max_bytes`` together.

    An item of n bytes makes patterns of at most ``window`` times n bytes.
    """
    items = items.select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(total * window / max_bytes))
    for k in range(parts):
        mine = items if parts == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == k)
        yield [tuple(r) for r in mine.collect()]


HIT = "array<struct<start: long, end: long>>"


def merge(stretches: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(stretches):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(docs: DataFrame, part: list, window: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(part)

    def start():
        scanner = Scanner(shared.value, window)

        def row(doc_id, text):
            n, stretches, items = scanner(text)
            where = original_offsets(text, stretches) if stretches else ()
            return (doc_id, n, [dict(start=a, end=b) for a, b in stretches], [dict(start=a, end=b) for a, b in where],
                    sorted(map(str, items)), hashlib.sha256((text or "").encode()).digest())
        return row

    return map_rows(docs, f"doc_id long, n_words long, stretches {HIT}, spans {HIT}, items array<string>, row binary", start)


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """doc_id, n_words, stretches (hit words), spans (their offsets in the original text), items (those that occur).

    Null and empty texts have no words and no hits, null and empty items no patterns; an empty item table hits nothing;
    a repeated item counts once, a repeated row of documents gives a repeated result; other columns are not read.
    Where the items need several automata, each part's hits are merged per row.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    scans = [_scan(docs, part, window) for part in item_parts(items, max_bytes, window)]
    if len(scans) == 1:
        return scans[0].drop("row")
    several = reduce(DataFrame.unionByName, scans)
    several = several.groupBy("doc_id", "row", "n_words").agg(
        F.array_repeat(F.lit(1), (F.count(F.lit(1)) / len(scans)).cast("int")).alias("copies"),
        *[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("stretches", "spans", "items")])

    def start():
        def pack(spans):
            return [dict(start=a, end=b) for a, b in merge([(s["start"], s["end"]) for s in spans])]
        return lambda doc_id, n, stretches, spans, items: (doc_id, n, pack(stretches), pack(spans), sorted(items))

    rows = several.withColumn("_", F.explode("copies")).select("doc_id", "n_words", "stretches", "spans", "items")
    return map_rows(rows, f"doc_id long, n_words long, stretches {HIT}, spans {HIT}, items array<string>", start)


def digest(found: DataFrame) -> DataFrame:
    hit = F.aggregate("stretches", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def clean_rows(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The rows, with all columns, in whose text no window of any item occurs."""
    for part in item_parts(items, max_bytes, window):
        shared = docs.sparkSession.sparkContext.broadcast(part)

        def start(shared=shared):
            scanner = Scanner(shared.value, window)
            return lambda text: not scanner(text)[1]
        docs = keep_rows(docs, ["text"], start)
    return docs
