"""Language identification as inference of a mixture of languages.

For every language a smoothed distribution over hashed character trigrams is learned. A document's trigrams are
taken as drawn from a mixture of languages; expectation-maximisation fits the proportions, and the set of languages is
the one whose likelihood, less a penalty per language, is largest. The language with the largest share is predicted.
"""
from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import PART_ROWS, bounded_batches, keep_rows, map_rows

BUCKET_BITS = 15
BUCKETS = 1 << BUCKET_BITS
#: About so many labelled documents of each language are learned from, chosen by a hash of their id.
TRAIN_DOCS = 3000
SMOOTHING = 0.5
#: Shares are fitted until none moves by more than this in a round.
TOLERANCE = 1e-4
#: Trigrams overlap, so each third of them counts as evidence; a language must earn this times log(n) to be in the set.
EVIDENCE = 1 / 3
PENALTY = 4.0
TEXT_BLOCK = 1 << 20
UNKNOWN = "und"
#: The pipeline keeps documents whose main language has at least this share.
MIN_SHARE = 0.5


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def trigram_counts(text: str) -> np.ndarray:
    """Counts per bucket of the lower-cased trigrams around letters; ASCII that is no letter stands as a blank."""
    counts = np.zeros(BUCKETS, np.int64)
    low = f" {text.lower()} "
    for at in range(0, len(low), TEXT_BLOCK):
        # blocks overlap by two characters, so each trigram is counted once
        c = np.frombuffer(low[at:at + TEXT_BLOCK + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(c) < 3:
            continue
        c = np.where((c < 128) & ((c < 97) | (c > 122)), np.uint32(32), c)
        h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)
        h = ((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(32 - BUCKET_BITS)
        counts += np.bincount(h[c[1:-1] != 32], minlength=BUCKETS)
    return counts


@dataclass
class Model:
    """Languages and their probabilities of each bucket (buckets x languages)."""

    languages: list[str]
    table: np.ndarray

    def mix(self, text: str) -> tuple[list[int], np.ndarray]:
        """The chosen languages and their shares."""
        counts = trigram_counts(text)
        seen = np.flatnonzero(counts)
        if not len(seen) or not self.languages:
            return [], np.zeros(0)
        n = counts[seen].astype(np.float64)
        p = self.table[seen].astype(np.float64)
        alone = n @ np.log(p)
        best = int(alone.argmax())
        if len(self.languages) == 1:
            return [best], np.ones(1)
        # over all languages: the second of a mixed text may be unlike the first and worse alone than its relatives
        shares = _shares(n, p, np.full(len(self.languages), 1 / len(self.languages)))
        order = [best, *(int(i) for i in np.argsort(-shares, kind="stable") if i != best)]
        penalty = PENALTY * np.log(n.sum() + 1)
        chosen, share, value = [best], np.ones(1), EVIDENCE * alone[best]
        for k in range(2, len(order) + 1):
            group = sorted(order[:k])
            start = shares[group] + 1e-3
            s = _shares(n, p[:, group], start / start.sum())
            v = EVIDENCE * float(n @ np.log(p[:, group] @ s)) - (k - 1) * penalty
            if v <= value:
                break
            chosen, share, value = group, s, v
        return chosen, share

    def predict(self, text: str | None) -> tuple[str, float]:
        """The main language and its share; ``und`` and 0 without a letter or without a model."""
        if not has_letter(text):
            return UNKNOWN, 0.0
        chosen, share = self.mix(text)
        if not chosen:
            # letters whose trigrams all have a blank in the middle can't occur; no model can
            return (self.languages[0], 0.0) if self.languages else (UNKNOWN, 0.0)
        top = int(share.argmax())
        return self.languages[chosen[top]], float(min(1.0, share[top]))


def _shares(n: np.ndarray, p: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Shares of the highest likelihood, by expectation-maximisation from the given ones; every round raises the likelihood."""
    total = n.sum()
    while True:
        new = share * (p.T @ (n / np.maximum(p @ share, 1e-300))) / total
        new /= new.sum()
        if np.abs(new - share).max() <= TOLERANCE:
            return new
        share = new


def held_out() -> Column:
    """Documents that are never learned from: crc32 of the id as text leaves 2 by 4."""
    return F.crc32(F.col("doc_id").cast("long").cast("string")) % 4 == 2


def learn(docs: DataFrame, per_language: int = TRAIN_DOCS) -> Model:
    """Fit on labelled documents outside the held-out part.

    What comes to the driver are counts of at most ``BUCKETS`` buckets per language.
    """
    bounded_batches(docs.sparkSession)
    labelled = docs.where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string"), "text")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32))
    chance = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, per_language / n)))))
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 20)) < chance[F.col("lang")] * (1 << 20))
    schema = "lang string, bucket int, n long"
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(at, PART_ROWS)
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if lang not in sums:
                        sums[lang] = np.zeros(BUCKETS, np.int64)
                    sums[lang] += trigram_counts(text)
        for lang, counts in sums.items():
            seen = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen.astype(np.int32)), pa.array(counts[seen])], schema=out)

    counted = drawn.select("lang", "text").mapInArrow(count, schema).groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counted["lang"].unique())
    table = np.full((BUCKETS, len(languages)), SMOOTHING)
    for j, lang in enumerate(languages):
        mine = counted[counted["lang"] == lang]
        table[mine["bucket"].to_numpy(), j] += mine["n"].to_numpy()
    return Model(languages, (table / table.sum(axis=0)).astype(np.float32))


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row.

    Only text is looked at for a prediction. Null texts and texts without a letter are ``und`` with score 0; a null lang
    is not learned from; rows without a doc_id count as not held out but are not learned from; repeated rows give
    repeated results; an empty table gives none.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs))

    def start():
        predict = shared.value.predict
        return lambda doc_id, held, text: (doc_id, held, *predict(text))

    inputs = docs.select(F.col("doc_id").cast("long"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return map_rows(inputs, "doc_id long, held_out boolean, lang_pred string, score double", start)


def known_language(docs: DataFrame, model: Model | None = None, min_share: float = MIN_SHARE) -> DataFrame:
    """The rows, with all columns, whose main language is known and has at least ``min_share`` of the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model or learn(docs))

    def start():
        predict = shared.value.predict

        def keep(text):
            language, share = predict(text)
            return language != UNKNOWN and share >= min_share
        return keep
    return keep_rows(docs, ["text"], start)
