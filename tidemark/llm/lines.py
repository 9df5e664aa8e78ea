"""Line dedup: lines are exploded and hashed, and of lines that many documents share one document keeps its own.

A line's key is the line without blanks at its ends, ASCII letters in lower case. Keys of some length that enough
documents hold lose all their lines except in the document of the largest id. Only hashes and ids are shuffled to count;
the texts meet the positions to drop once, and are put together again in order of position.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import map_rows
from tidemark.llm.facts import join_facts
from tidemark.sources.tables import materialize

MIN_CHARS = 20
MIN_DOCS = 3
BLANKS = " \t\n\x0b\x0c\r"
CONTROLS = BLANKS[1:]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def bare_line(line: Column) -> Column:
    """The line without blanks at its ends; the plain trim of spaces does for most."""
    cheap = F.trim(line)
    more = F.substring(cheap, 1, 1).isin(*CONTROLS) | F.right(cheap, F.lit(1)).isin(*CONTROLS)
    return F.when(more, F.btrim(line, F.lit(BLANKS))).otherwise(cheap)


def line_key(bare: Column) -> Column:
    """ASCII letters in lower case; lines of ASCII alone take the faster function."""
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def hashed_lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id, text_id, pos and the key's 128-bit hash (h1, h2) of every line whose key is long enough.

    ``text_id`` tells rows of one id but different texts apart.
    """
    # a text's hash is taken before it is split, once and not per line
    lines = docs.withColumn("text_id", F.xxhash64("text")).select("doc_id", "text_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    # the key is as long as the bare line, so the lower case comes after the filter
    lines = lines.where(F.length("line") >= min_chars).withColumn("bare", bare_line(F.col("line"))).where(F.length("bare") >= min_chars)
    lines = lines.withColumn("key", line_key(F.col("bare")))
    return lines.select("doc_id", "text_id", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def shared_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """One row per key that enough documents hold: its number of documents and the largest id as ``fact.doc_id``.

    A null id is one document, less than all others. Counting goes by (key, document) first, so a line that every
    document holds is counted in all tasks.
    """
    held = lines.groupBy("h1", "h2", "doc_id").agg(F.lit(1).alias("_one")).drop("_one")
    return (held.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max(F.struct("doc_id")).alias("fact"))
            .where(F.col("n_docs") >= min_docs))


def deduplicate_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text without the dropped lines, n_lines before, n_dropped; one row per input row.

    Null and empty texts are one empty line, which is never dropped as its key is short. A null id counts as one document
    below all others. Rows of one id are one document: each keeps or loses its own lines alike. Repeated rows give
    repeated results, ties of the largest id can't occur among distinct ids, an empty table gives no rows, and other
    columns are not read. Texts of any length work in time in proportion to their lines.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    lines = materialize(hashed_lines(docs, min_chars), "hashed-lines")
    shared = materialize(shared_keys(lines, min_docs), "shared-lines")
    found = join_facts(lines, shared, ["h1", "h2"], "n_docs", F.xxhash64("doc_id", "pos")).where("fact IS NOT NULL AND NOT (doc_id <=> fact.doc_id)")
    # a group is the lines of one document
    drops = found.groupBy("doc_id", "text_id").agg(F.collect_set("pos").alias("drops")).withColumnsRenamed({"doc_id": "_doc", "text_id": "_text"})
    docs = docs.withColumn("text_id", F.xxhash64("text"))
    met = docs.join(drops, docs["doc_id"].eqNullSafe(drops["_doc"]) & (docs["text_id"] == drops["_text"]), "left")

    def start():
        def row(doc_id, text, drops):
            lines = text.split("\n")
            if not drops:
                return doc_id, text, len(lines), 0
            gone = set(drops)
            return doc_id, "\n".join([x for i, x in enumerate(lines) if i not in gone]), len(lines), len(gone)
        return row

    return map_rows(met.select("doc_id", "text", "drops"), "doc_id long, text string, n_lines long, n_dropped long", start)


def digest(kept: DataFrame) -> DataFrame:
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
