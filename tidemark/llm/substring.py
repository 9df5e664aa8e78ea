"""Exact substring removal with FM-indexes.

A window is 13 consecutive words of a document. A window that also starts in a document of a smaller id is a repeat, and all
words that a repeat covers are removed.

1. Words become 64-bit hashes. Each window has an *anchor*, the least hash among its four-word grams; equal windows have equal
   anchors, so anchors that one document alone has need no further look. Grams that very many documents of a bounded
   sample have are taken to be shared without counting, and are chosen only by windows that have no other gram.
2. Runs of windows with one shared anchor are *segments*. Segments go to the shard of their anchor, so equal windows meet in one shard.
   Of equal segments in one batch only that of the least id goes; the others are repeats of it as a whole.
3. Each shard builds a compressed FM-index of its distinct segments (suffix order, wavelet matrix), finds every window's occurrences by
   backward search, takes the least document among them, and reports the stretches of windows whose least document is smaller
   than their own.
4. Stretches come back to the documents, and the words left are hashed.
"""
from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import bounded_batches, map_rows, space_words, text_bytes
from tidemark.llm.fm_index import FMIndex
from tidemark.llm.words import BASE, hash_words, mixed, powers, words_of

WINDOW = 13
GRAM = 4
#: Text bytes that a shard is meant for.
SHARD_BYTES = 6 << 20
#: Text bytes that are hashed and cut at a time.
SLICE_BYTES = 1 << 20
#: Documents of the sample that shows frequent grams, and the share of them (at least so many) that makes one frequent.
SAMPLE_DOCS = 4000
FREQUENT_SHARE = 0.005
FREQUENT_DOCS = 20

_SALT = np.uint64(0x9E3779B97F4A7C15)
_GRAM_WEIGHTS = np.random.default_rng(613).integers(0, 2**62, GRAM, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Segments:
    """The segments of some texts: runs of windows with one anchor.

    ``hashes`` are all words of all rows, ``row_start`` the first word of each row; a segment has a row, its first word, its number
    of words, and hashes of its anchor and of its words. Texts are worked on in slices, so that what a step needs besides follows the
    slice.
    """

    def __init__(self, texts: pa.Array, frequent: np.ndarray):
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // SLICE_BYTES)) + 1
        parts, rows, words = [], 0, 0
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(texts)]):
            hashes, row_start, row, first, n, anchor, content = _segments(texts.slice(lo, hi - lo), frequent)
            parts.append((hashes, row_start + words, row + lo, first + words, n, anchor, content))
            words += len(hashes)
        self.hashes, self.row_start, self.row, self.first, self.words, self.anchor, self.content = map(np.concatenate, zip(*parts))


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each word, its row, hash of the gram that begins with each word); grams over the border of two rows mean nothing."""
    data, offsets = text_bytes(texts)
    starts, ends, row = words_of(data, offsets)
    h = hash_words(data, starts, ends)
    grams = np.zeros(max(0, len(h) - GRAM + 1), np.uint64)
    for j in range(GRAM):
        grams += h[j:len(grams) + j] * _GRAM_WEIGHTS[j]
    return h, row, mixed(grams)


def _segments(texts: pa.Array, frequent: np.ndarray) -> tuple[np.ndarray, ...]:
    h, row, grams = _grams(texts)
    n = len(h)
    row_start = np.searchsorted(row, np.arange(len(texts)))
    if n < WINDOW:
        none = np.zeros(0, np.int64)
        return h, row_start, none, none, none, none.view(np.uint64), none.view(np.uint64)
    value = grams >> np.uint64(1)
    if len(frequent):
        value |= in_sorted(grams, frequent).astype(np.uint64) << np.uint64(63)
    span = WINDOW - GRAM + 1
    low = value[:len(value) - span + 1].copy()
    for j in range(1, span):
        np.minimum(low, value[j:len(value) - span + 1 + j], out=low)
    at = np.zeros(len(low), np.int64)
    for j in range(span - 1, -1, -1):
        at[value[j:len(value) - span + 1 + j] == low] = j
    at += np.arange(len(low))
    whole = np.flatnonzero(row[:n - WINDOW + 1] == row[WINDOW - 1:])
    turn = np.ones(len(whole), bool)
    turn[1:] = (np.diff(whole) != 1) | (np.diff(at[whole]) != 0)
    first = whole[turn]
    last = whole[np.concatenate([turn[1:], [True]])] if len(whole) else whole
    words = last + WINDOW - first
    up, down = powers(BASE, n + 1), powers(pow(BASE, -1, 2**64), n + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * up[:n])])
    content = mixed((sums[first + words] - sums[first]) * down[first] + words.astype(np.uint64))
    return h, row_start, row[first], first, words, grams[at[first]], content


def in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values


def _once(row: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Places of the distinct (row, value) pairs."""
    return np.unique(mixed(value + row.astype(np.uint64) * _SALT), return_index=True)[1]


def _pairs(docs: DataFrame, name: str, pairs) -> DataFrame:
    """(name, doc_id): distinct values of each row of documents, from a function of a batch's texts."""
    schema = f"{name} long, doc_id long"
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            row, value = pairs(batch.column(1))
            one = _once(row, value)
            yield pa.RecordBatch.from_arrays([pa.array(value[one].view(np.int64)), pa.array(ids[row[one]].astype(np.int64))], schema=out)

    return docs.mapInArrow(run, schema)


def _anchor_rows(docs: DataFrame, frequent) -> DataFrame:
    """(anchor, doc_id) of the segments whose anchor is not known to be frequent."""
    def pairs(texts):
        s = Segments(texts, frequent.value)
        rare = ~in_sorted(s.anchor, frequent.value)
        return s.row[rare], s.anchor[rare]
    return _pairs(docs, "anchor", pairs)


def frequent_grams(docs: DataFrame, n_docs: int) -> np.ndarray:
    """Grams that many documents of a bounded sample have, sorted: no more than the sample's grams by the least count."""
    def pairs(texts):
        _, row, grams = _grams(texts)
        inside = np.flatnonzero(row[:len(grams)] == row[GRAM - 1:]) if len(grams) else np.zeros(0, np.int64)
        return row[inside], grams[inside]

    drawn = docs.where(F.pmod(F.xxhash64("doc_id", F.lit("anchors")), F.lit(1 << 20)) < math.ceil(min(1.0, SAMPLE_DOCS / max(1, n_docs)) * (1 << 20)))
    least = max(FREQUENT_DOCS, int(FREQUENT_SHARE * min(n_docs, SAMPLE_DOCS)))
    many = _pairs(drawn, "gram", pairs).groupBy("gram").count().where(F.col("count") >= least).select("gram").toPandas()
    return np.sort(many["gram"].to_numpy(np.int64).view(np.uint64))


PIECES = "shard int, dictionary binary, codes binary, sizes binary, owner binary, place binary, ids binary, prints binary, spans binary"


def _text_print(text: pa.Scalar) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest((text.as_py() or "").encode(), 42)


def _cut(joined: DataFrame, shards: int, frequent) -> DataFrame:
    """Per batch and shard, its shared segments packed: distinct words, words of the segments as numbers into them, and owners."""
    out = to_arrow_schema(T._parse_datatype_string(PIECES))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in batches:
            shared = batch.column(2)
            batch = batch.filter(pc.or_kleene(pc.is_valid(shared), len(known) > 0))
            if not batch.num_rows:
                continue
            ids, texts, shared = batch.columns
            s = Segments(texts, known)
            # an anchor counts if it is frequent or its own document was told that it is shared
            lists = shared.fill_null([]) if shared.null_count else shared
            told_row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            told = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            pair = np.sort(mixed(told + told_row.astype(np.uint64) * _SALT))
            use = np.flatnonzero(in_sorted(s.anchor, known) | in_sorted(mixed(s.anchor + s.row.astype(np.uint64) * _SALT), pair))
            # rows without an id are never smaller or larger than another
            real = pc.is_valid(ids).to_numpy(zero_copy_only=False)
            use = use[real[s.row[use]]]
            if not len(use):
                continue
            id_of = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            prints = np.zeros(len(id_of), np.uint64)
            for r in np.unique(s.row[use]):
                prints[r] = _text_print(texts[int(r)])
            # of equal segments in the batch the least id's goes on; those of larger ids are repeats as a whole
            use = use[np.lexsort((s.first[use], id_of[s.row[use]], s.content[use]))]
            content, owner = s.content[use], id_of[s.row[use]]
            new = np.concatenate([[True], content[1:] != content[:-1]])
            least = owner[np.flatnonzero(new)[np.cumsum(new) - 1]]
            repeat = owner > least
            go = use[~repeat]
            place = s.first - s.row_start[s.row]
            done = use[repeat]
            shard = (s.anchor[go] % np.uint64(shards)).astype(np.int64)
            go = go[np.argsort(shard, kind="stable")]
            shard = np.sort(shard)
            bounds = np.concatenate([[0], np.flatnonzero(np.diff(shard)) + 1, [len(shard)]])
            done_parts = np.array_split(done, max(1, len(bounds) - 1))
            made = []
            for k in range(len(bounds) - 1):
                mine = go[bounds[k]:bounds[k + 1]]
                made.append(_pack(s, int(shard[bounds[k]]), mine, done_parts[k], place, id_of, prints))
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*made), out)], schema=out)

    return joined.mapInArrow(run, PIECES)


def _pack(s: Segments, shard: int, mine: np.ndarray, done: np.ndarray, place: np.ndarray, id_of: np.ndarray, prints: np.ndarray) -> tuple:
    rows, owner = np.unique(np.concatenate([s.row[mine], s.row[done]]), return_inverse=True)
    sizes = s.words[mine]
    dictionary, codes = np.unique(s.hashes[_ranges(s.first[mine], sizes)], return_inverse=True)
    spans = np.stack([owner[len(mine):], place[done], place[done] + s.words[done]], axis=1)
    return (shard, dictionary.tobytes(), codes.astype(np.uint16 if len(dictionary) <= 65536 else np.uint32).tobytes(), sizes.astype(np.uint8).tobytes(),
            owner[:len(mine)].astype(np.uint32).tobytes(), place[mine].astype(np.uint32).tobytes(), id_of[rows].tobytes(), prints[rows].tobytes(),
            spans.astype(np.uint32).tobytes())


def _ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first, first + 1, ... of each range, one after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(first - (ends - sizes), sizes)


def _search(pieces: dict[str, list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Repeats of one shard as (id, print, first word, end word)."""
    dictionaries, codes, sizes, owner_id, owner_print, places, outs = [], [], [], [], [], [], []
    base = 0
    for dictionary, code, size, owner, place, ids, prints, spans in zip(*(pieces[c] for c in (
            "dictionary", "codes", "sizes", "owner", "place", "ids", "prints", "spans"))):
        d = np.frombuffer(dictionary, np.uint64)
        ids, prints = np.frombuffer(ids, np.int64), np.frombuffer(prints, np.uint64)
        owner = np.frombuffer(owner, np.uint32)
        codes.append(np.frombuffer(code, np.uint16 if len(d) <= 65536 else np.uint32).astype(np.int64) + base)
        base += len(d)
        dictionaries.append(d)
        sizes.append(np.frombuffer(size, np.uint8).astype(np.int64))
        owner_id.append(ids[owner])
        owner_print.append(prints[owner])
        places.append(np.frombuffer(place, np.uint32).astype(np.int64))
        done = np.frombuffer(spans, np.uint32).reshape(-1, 3).astype(np.int64)
        outs.append((ids[done[:, 0]], prints[done[:, 0]], done[:, 1], done[:, 2]))
    names, number = np.unique(np.concatenate(dictionaries), return_inverse=True)
    # 0 separates segments
    words = number[np.concatenate(codes)] + 1
    sizes, owner_id, owner_print, places = (np.concatenate(x) for x in (sizes, owner_id, owner_print, places))
    if not len(sizes):
        return tuple(np.concatenate(x) for x in zip(*outs))
    starts = np.cumsum(sizes) - sizes
    # equal segments are indexed once, with the least id that has them
    weights = powers(BASE, int(sizes.max()))
    symbols = mixed(names[words - 1] * weights[np.arange(len(words)) - np.repeat(starts, sizes)])
    content = np.add.reduceat(symbols, starts) + sizes.astype(np.uint64)
    _, one, same = np.unique(content, return_index=True, return_inverse=True)
    least = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(least, same, owner_id)
    kept_sizes = sizes[one]
    text = np.zeros(int(kept_sizes.sum()) + len(one), np.int64)
    new_starts = np.cumsum(kept_sizes + 1) - kept_sizes - 1
    text[_ranges(new_starts, kept_sizes)] = words[_ranges(starts[one], kept_sizes)]
    index = FMIndex(text, len(names) + 1)
    # matching statistics cut at the window: every window's range of occurrences, then the least id in the range
    windows = kept_sizes - WINDOW + 1
    at = _ranges(new_starts, windows)
    low, high = index.search(np.lib.stride_tricks.sliding_window_view(text, WINDOW)[at])
    holder = np.repeat(np.arange(len(one)), kept_sizes + 1)
    by_order = least[holder[index.order]]
    # ranges of patterns of one length are equal or apart
    ranges, which = np.unique(low, return_inverse=True)
    stops = np.zeros(len(ranges), np.int64)
    stops[which] = high
    edges = np.stack([ranges, stops], axis=1).ravel()
    smallest = np.minimum.reduceat(np.append(by_order, np.iinfo(np.int64).max), edges)[::2][which]
    # each owner's windows, by its segment's place among the distinct ones
    window_start = np.cumsum(windows) - windows
    own = windows[same]
    flat = _ranges(window_start[same], own)
    who = np.repeat(np.arange(len(sizes)), own)
    hit = np.flatnonzero(smallest[flat] < owner_id[who])
    place = places[who[hit]] + (flat[hit] - window_start[same][who[hit]])
    if len(hit):
        turn = np.concatenate([[True], (np.diff(hit) != 1) | (np.diff(who[hit]) != 0)])
        end = np.concatenate([turn[1:], [True]])
        outs.append((owner_id[who[hit[turn]]], owner_print[who[hit[turn]]], place[turn], place[end] + WINDOW))
    return tuple(np.concatenate(x) for x in zip(*outs))


FOUND = "doc_id long, print long, start int, stop int"


def repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, print, start, stop): stretches of words that repeats cover; print tells rows apart that share an id."""
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    n_docs, n_bytes = docs.agg(F.count("doc_id"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    shards = max(1, math.ceil(n_bytes / SHARD_BYTES))
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_grams(docs, n_docs))
    rows = _anchor_rows(docs.where(F.col("doc_id").isNotNull()), frequent)
    same = Window.partitionBy("anchor")
    shared = rows.select("anchor", "doc_id", F.min("doc_id").over(same).alias("least"), F.max("doc_id").over(same).alias("most")).where("least < most")
    told = shared.groupBy("doc_id").agg(F.collect_list("anchor").alias("shared"))
    joined = docs.join(told, "doc_id", "left").select("doc_id", "text", "shared")
    found = to_arrow_schema(T._parse_datatype_string(FOUND))

    def search(table: pa.Table) -> pa.Table:
        a, b, c, d = _search({name: table.column(name).to_pylist() for name in table.column_names if name != "shard"})
        return pa.Table.from_arrays([pa.array(a), pa.array(b.view(np.int64)), pa.array(c.astype(np.int32)), pa.array(d.astype(np.int32))], schema=found)

    return _cut(joined, shards, frequent).groupBy("shard").applyInArrow(search, FOUND)


def without_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the words left, joined by blanks, of each row.

    Null texts have no words. Rows that share an id never make each other repeats. Rows without an id lose nothing and
    make no repeats. An empty table gives no rows; other columns are not read.
    """
    from xxhash import xxh64_intdigest

    spans = repeats(docs).groupBy("doc_id").agg(F.collect_list(F.struct("print", "start", "stop")).alias("spans"))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = docs.join(spans, "doc_id", "left").select("doc_id", "text", "spans")

    def start():
        def row(doc_id, text, spans):
            words = space_words(text)
            keep = np.ones(len(words), bool)
            if spans:
                mine = xxh64_intdigest((text or "").encode(), 42)
                for s in spans:
                    if s["print"] % 2**64 == mine:
                        keep[s["start"]:s["stop"]] = False
            left = words if keep.all() else [w for w, k in zip(words, keep.tolist()) if k]
            return doc_id, len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()
        return row

    return map_rows(joined, "doc_id long, n_words long, n_removed long, kept_sha256 string", start)
