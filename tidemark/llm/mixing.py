"""Mixing documents to target shares of domains, with soft membership.

A classifier learned from the table of labels gives every document a posterior over the domains. Rates (how often a
document is to be seen) are fitted so that the expected token total of each domain meets its target: nonnegative least
squares by projected gradient steps with momentum, where a step needs one distributed sum per domain. A document's rate
follows from its posterior and the sums of the earlier steps, so no table of rates is kept between steps.
"""
from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm.common import bounded_batches, text_bytes
from tidemark.llm.words import hash_words, words_of
from tidemark.sources.tables import materialize

#: Domains and the shares of the tokens that they are to have.
TARGETS = {"good": 0.88, "poor": 0.08, "toxic": 0.04}
BUCKET_BITS = 17
BUCKETS = 1 << BUCKET_BITS
SMOOTHING = 0.5
#: Buckets that the classifier looks at: for each domain those whose log-odds are the most standard errors from 0.
FEATURES = 256
#: Labelled documents that are learned from, chosen by a hash of their id.
TRAIN_DOCS = 12_000
REGULARISATION = 0.003
STEPS = 60
TOLERANCE = 1e-4
#: Pull of the rates towards 1, which makes the fit unique.
RIDGE = 1e-3
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def domain(labels: DataFrame) -> DataFrame:
    """(doc_id, domain number) of labelled documents; rows with a null are left out, of contrary rows the largest number counts."""
    name = F.when(F.col("toxic") == 1, 2).when(F.col("quality") == 1, 0).otherwise(1)
    return labels.dropna(subset=["doc_id", "quality", "toxic"]).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(name).alias("domain"))


def _buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of the distinct lower-cased words of each row, and the number of all its words."""
    data, offsets = text_bytes(texts)
    data = _LOWER[data]
    starts, ends, row = words_of(data, offsets)
    bucket = (hash_words(data, starts, ends) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    seen = np.unique(row * BUCKETS + bucket)
    return seen >> BUCKET_BITS, seen & (BUCKETS - 1), np.bincount(row, minlength=len(texts))


@dataclass
class Classifier:
    """Multinomial logistic regression over the presence of word buckets; buckets without a weight are not looked at."""

    slots: np.ndarray
    weights: np.ndarray
    intercept: np.ndarray

    def present(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, feature) of the features of each row, and words per row."""
        row, bucket, n = _buckets(texts)
        slot = self.slots[bucket]
        return row[slot >= 0], slot[slot >= 0], n

    def posterior(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Posterior per row and domain, and words per row."""
        row, slot, n = self.present(texts)
        z = np.stack([np.bincount(row, self.weights[slot, k], len(texts)) for k in range(len(self.intercept))], axis=1) + self.intercept
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True), n


def learn(docs: DataFrame, labels: DataFrame, n_domains: int = len(TARGETS), train_docs: int = TRAIN_DOCS) -> Classifier:
    """Fit on a bounded sample of the labelled documents.

    The sample's (doc_id, domain) rows are broadcast: there are about ``train_docs`` of them at most. What comes to the
    driver are counts of ``BUCKETS`` buckets per domain and the fitted weights. Where fewer than two domains have labels, every posterior is the
    smoothed prior.
    """
    bounded_batches(docs.sparkSession)
    known = domain(labels)
    share = min(1.0, train_docs / max(1, known.count()))
    drawn = known.where(F.pmod(F.xxhash64("doc_id", F.lit("mixing")), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    texts = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = materialize(texts.join(F.broadcast(drawn), "doc_id").select("domain", "text"), "labelled")
    schema = "domain int, bucket int, n long"
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((n_domains, BUCKETS), np.int64)
        size = np.zeros(n_domains, np.int64)
        for batch in batches:
            row, bucket, _ = _buckets(batch.column(1))
            kind = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            np.add.at(sums.reshape(-1), kind[row] * BUCKETS + bucket, 1)
            size += np.bincount(kind, minlength=n_domains)
        for d in range(n_domains):
            # bucket -1 counts documents
            seen = np.flatnonzero(sums[d])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(seen) + 1, d, np.int32)), pa.array(np.append(seen, -1).astype(np.int32)),
                                              pa.array(np.append(sums[d][seen], size[d]))], schema=out)

    counted = rows.mapInArrow(count, schema).groupBy("domain", "bucket").agg(F.sum("n").alias("n")).toPandas()
    has = np.zeros((BUCKETS, n_domains))
    size = np.zeros(n_domains)
    documents = counted["bucket"] < 0
    size[counted["domain"][documents]] = counted["n"][documents]
    words = counted[~documents]
    has[words["bucket"], words["domain"]] = words["n"]
    intercept = np.log((size + 1) / (size + 1).sum())
    if (size > 0).sum() < 2:
        return Classifier(np.full(BUCKETS, -1), np.zeros((0, n_domains)), intercept)
    yes, rest = has + SMOOTHING, has.sum(axis=1, keepdims=True) - has + SMOOTHING
    no, others = size - has + SMOOTHING, size.sum() - size - rest + 2 * SMOOTHING
    z = np.abs(np.log(yes / no) - np.log(rest / others)) / np.sqrt(1 / yes + 1 / no + 1 / rest + 1 / others)
    chosen = np.unique(np.concatenate([np.argsort(-z[:, d], kind="stable")[:FEATURES] for d in np.flatnonzero(size)]))
    slots = np.full(BUCKETS, -1)
    slots[chosen] = np.arange(len(chosen))
    return _regress(rows, Classifier(slots, np.zeros((len(chosen), n_domains)), intercept))


def _regress(rows: DataFrame, model: Classifier) -> Classifier:
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    schema = "label double, features array<double>"
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def features(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, slot, _ = model.present(batch.column(1))
            x = np.zeros((batch.num_rows, len(model.weights)))
            x[row, slot] = 1.0
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.float64()), _lists(x, out.field("features").type)], schema=out)

    data = rows.mapInArrow(features, schema).select("label", array_to_vector("features").alias("features"))
    fitted = LogisticRegression(family="multinomial", regParam=REGULARISATION, standardization=False, maxIter=30).fit(data)
    weights, intercept = np.zeros_like(model.weights), np.full(len(model.intercept), -30.0)
    weights[:, :fitted.numClasses] = fitted.coefficientMatrix.toArray().T
    intercept[:fitted.numClasses] = np.maximum(fitted.interceptVector.toArray(), -30.0)
    return Classifier(model.slots, weights, intercept)


def memberships(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, n_tokens (words) and the posterior ``p`` of each row."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = "doc_id long, n_tokens long, p array<double>"
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            p, n = m.posterior(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), _lists(p, out.field("p").type)], schema=out)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    n, k = values.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * k + 1, k), pa.int32()), pa.array(values.ravel())).cast(kind)


def rates(p: np.ndarray, gaps: list[np.ndarray], ridge: float = RIDGE) -> tuple[np.ndarray, np.ndarray]:
    """The rates after the steps whose scaled gaps are given, and the point where the next gradient is taken."""
    now = ahead = np.ones(len(p))
    t = 1.0
    for gap in gaps:
        new = np.maximum(0.0, ahead - (p @ gap + ridge * (ahead - 1)) / (1 + ridge))
        nxt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / nxt * (new - now)
        now, t = new, nxt
    return now, ahead


@dataclass
class Mix:
    """Result of the fit: the scaled gaps of all steps, the natural shares and those reached."""

    gaps: list[np.ndarray]
    natural: np.ndarray
    reached: np.ndarray


def fit(members: DataFrame, targets: np.ndarray, steps: int = STEPS, tolerance: float = TOLERANCE, ridge: float = RIDGE) -> Mix:
    """Rates >= 0 that bring the domains' shares of the corpus's tokens to the targets.

    Minimises the sum over domains of (share - target)^2 / natural share, plus the ridge. Dividing by the natural share makes the steps of
    a rare domain as large as those of a common one. Targets that no rates reach are met as closely as possible.
    """
    k = len(targets)
    schema = ", ".join(f"s{i} double, a{i} double" for i in range(k)) + ", n double"

    def sums(gaps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, float]:
        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros(2 * k + 1)
            for frame in frames:
                if len(frame):
                    p = np.stack(frame["p"].to_numpy())
                    n = frame["n_tokens"].to_numpy(np.float64)
                    now, ahead = rates(p, gaps, ridge)
                    total[0:2 * k:2] += (now * n) @ p
                    total[1:2 * k:2] += (ahead * n) @ p
                    total[-1] += n.sum()
            yield pd.DataFrame([total], columns=[c.split()[0] for c in schema.split(", ")])

        got = np.array(members.select("n_tokens", "p").mapInPandas(run, schema).agg(*[F.sum(c.split()[0]) for c in schema.split(", ")]).first(), np.float64)
        got = np.nan_to_num(got)
        return got[0:2 * k:2], got[1:2 * k:2], max(got[-1], 1.0)

    now, ahead, n = sums([])
    natural = now / n
    scale = np.maximum(natural, 1e-6)
    gaps: list[np.ndarray] = []
    for _ in range(steps):
        gaps.append((ahead / n - targets) / scale)
        before = now
        now, ahead, _ = sums(gaps)
        if np.abs(now / n - targets).max() < tolerance or np.abs(now - before).max() < tolerance * 1e-2 * n:
            break
    return Mix(gaps, natural, now / n)


def copies(rate: Column, *key) -> Column:
    """Whole copies whose expectation is the rate: its whole part, and one more with the chance of the rest, drawn by a hash of the row."""
    draw = F.pmod(F.xxhash64(F.lit("copies"), *key), F.lit(1 << 30)) / (1 << 30)
    return F.floor(rate + draw).cast("long")


def mixture(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """doc_id, n_tokens, p_<domain>, rate, copies of each row.

    Null and empty texts have no tokens; their posterior is the prior, and their rate follows from it. Repeated rows give
    repeated results; rows without an id get a result like others; an empty table gives none; labels of unknown
    documents are left out.
    """
    targets = targets or TARGETS
    members = materialize(memberships(docs, learn(docs, labels, len(targets))), "members")
    mix = fit(members, np.array(list(targets.values())))
    return _rated(members, mix, list(targets))


def _rated(members: DataFrame, mix: Mix, names: list[str]) -> DataFrame:
    gaps = mix.gaps

    @F.pandas_udf("double")
    def rate(p: pd.Series) -> pd.Series:
        return pd.Series(np.round(rates(np.stack(p.to_numpy()), gaps)[0], 6) if len(p) else [], dtype=float)

    rated = members.withColumn("rate", rate("p"))
    return rated.select("doc_id", "n_tokens", *[F.round(F.col("p")[i], 6).alias(f"p_{name}") for i, name in enumerate(names)], "rate",
                        copies(F.col("rate"), "doc_id", "n_tokens").alias("copies"))


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The rows that the mixture keeps, with all columns and their ``rate`` and ``copies`` (at least 1).

    Classifier and gaps are small, so rates are computed where the rows are and no join is needed. Columns of documents of these names are
    replaced.
    """
    bounded_batches(docs.sparkSession)
    targets = targets or TARGETS
    model = learn(docs, labels, len(targets))
    mix = fit(materialize(memberships(docs, model), "members"), np.array(list(targets.values())))
    shared = docs.sparkSession.sparkContext.broadcast((model, mix.gaps))
    docs = docs.drop("rate", "copies")
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField("rate", T.DoubleType()), T.StructField("_tokens", T.LongType())])
    out = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, gaps = shared.value
        for batch in batches:
            p, n = m.posterior(batch.column(at))
            rate = np.round(rates(p, gaps)[0], 6)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rate), pa.array(n.astype(np.int64))], schema=out)

    rated = docs.mapInArrow(run, schema).withColumn("copies", copies(F.col("rate"), F.col("doc_id").cast("long"), "_tokens"))
    return rated.where("copies >= 1").drop("_tokens")
