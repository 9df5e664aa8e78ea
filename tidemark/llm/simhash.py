"""Near-duplicates by SimHash: 64-bit fingerprints linked at few differing bits, found with vantage-point trees.

A fingerprint's bit is set if it is set in more than half of the hashes of the text's word shingles. Equal fingerprints
collapse first, so a large group of copies is one row. The distinct ones are dealt to shards by an upper vantage-point
tree (its vantage points come from a bounded sample; every fingerprint is dealt), and each shard is joined with
itself and its guests by going on with the tree. Shards report spanning forests, never all pairs.
"""
from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows
from tidemark.llm.components import components
from tidemark.llm.vptree import Shards, links
from tidemark.sources.tables import materialize

WORDS = 4
SEED = 42
RADIUS = 4
#: Vantage points come from this many distinct fingerprints at most, those of the least hashes.
SAMPLE = 8192
#: Residents that a shard should have, and visits (guests included) above which one is split into blocks that meet in pairs.
SHARD = 65_536
SHARD_VISITS = 400_000
PRINT_BLOCK = 1 << 15


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Fingerprint of a text; shorter ones are one shingle, empty ones have none and give 0."""
    from xxhash import xxh64_intdigest

    parts = text.encode().lower().split() if text else []
    if not parts:
        return 0
    line = b" ".join(parts)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    k = min(words, len(parts))
    hashes = np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(starts[:len(parts) - k + 1].tolist(), ends[k - 1:].tolist())], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), PRINT_BLOCK):
        bits = np.unpackbits(hashes[at:at + PRINT_BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fingerprint (as a signed long) of each row."""
    def start():
        def row(doc_id, text):
            f = fingerprint(text, words)
            return doc_id, f - (1 << 64) if f >> 63 else f
        return row
    return map_rows(docs.select(F.col("doc_id").cast("long"), "text"), "doc_id long, fp long", start)


def in_blocks(visits: DataFrame, large: dict[int, int]) -> DataFrame:
    """Visits with the ``pair`` of blocks that they meet in; shards that are not in ``large`` have one.

    There is an entry per ``SHARD_VISITS`` visits at most, so the table of them is small beside the visits and is broadcast.
    """
    one = F.array(F.lit(0).cast("long"))
    if not large:
        return visits.withColumn("pair", F.explode(one))
    table = visits.sparkSession.createDataFrame(list(large.items()), "leaf int, blocks long")
    mine = F.pmod(F.xxhash64("fp"), F.col("blocks"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda other: F.least(mine, other) * F.col("blocks") + F.greatest(mine, other))
    return visits.join(F.broadcast(table), "leaf", "left").withColumn("pair", F.explode(F.when(F.col("blocks").isNull(), one).otherwise(pairs))).drop("blocks")


def near_edges(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between the distinct fingerprints in ``fp`` that keep all components of links within the radius."""
    n = prints.count()
    sample = prints.orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = Shards(sample, max(1, math.ceil(n / SHARD)), radius)

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            fp = frame["fp"].to_numpy(np.int64)
            who, leaf, resident = tree.deal(fp.view(np.uint64))
            yield pd.DataFrame({"leaf": leaf.astype(np.int32), "fp": fp[who], "resident": resident})

    visits = prints.mapInPandas(deal, "leaf int, fp long, resident boolean")
    # a shard too large for one task becomes blocks, and each pair of its blocks a task
    large = {r["leaf"]: math.ceil(2 * r["n"] / SHARD_VISITS)
             for r in visits.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SHARD_VISITS).collect()}
    visits = in_blocks(visits, large)

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        fp = frame["fp"].to_numpy(np.int64).view(np.uint64)
        here = frame["resident"].to_numpy(bool)
        a, b = links(fp[here], fp[~here], radius)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return visits.groupBy("leaf", "pair").applyInPandas(join, "a long, b long")


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable over links) of each row.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows give repeated results. Rows
    without a doc_id take part, but never name a component (one of such rows alone has none). An empty table gives no
    rows; other columns are not read.
    """
    rows = materialize(fingerprints(docs, words), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    member = components(near_edges(distinct.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = distinct.join(member, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = materialize(named, "members")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    labels = named.join(least, "root").select("fp", "component_id")
    return rows.join(labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """The rows, with all columns, of the least doc_id of each component; of rows that repeat it one stays.

    Rows without a doc_id can't be named as copies and stay.
    """
    found = near_duplicates(docs, words, radius)
    kept = materialize(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count(F.lit(1)).alias("_times")), "kept")
    # the ids grow with the documents, so they are always dealt like them and never sent to every task
    ids = kept.select("doc_id").hint("shuffle_hash")
    stay = docs.join(ids, docs["doc_id"].cast("long") == ids["doc_id"], "left_semi")
    if not kept.where("_times > 1").isEmpty():
        stay = stay.dropDuplicates(["doc_id"])
    return stay.unionByName(docs.where(F.col("doc_id").isNull()))
