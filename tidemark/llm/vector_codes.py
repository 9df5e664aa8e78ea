"""Product codes of vectors: each part of a vector is replaced by the index of a codebook entry.

Codebooks come from Lloyd's rounds over integers, so every engine gets the same ones. The rounds keep what they know:
a part keeps its entry and the exact distance to it. Where that entry did not move in the last update, only
entries that did move can have come nearer, and only those are compared. Parts whose entry moved are compared with all.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.tables import materialize

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
CHUNK = 2048


@dataclass
class Codes:
    """``rows``: vec_id, label, code (one index per part, null where the vector can't be coded), error.
    ``codebooks``: integers by part, entry and position."""

    rows: DataFrame
    codebooks: np.ndarray

    def fingerprint(self) -> str:
        return hashlib.sha256(",".join(map(str, self.codebooks.reshape(-1).tolist())).encode()).hexdigest()


def finite_rows(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there and has no null, NaN or infinite component, with components as doubles in ``x``."""
    rows = vectors.select(F.col("vec_id").cast("long"), "label", F.col("embedding").cast("array<double>").alias("x"))
    return rows.where(F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))


def first_rows(rows: DataFrame, n: int) -> list:
    """The n rows of the least ids; nulls last, repeated ids by their components."""
    return rows.select("vec_id", "x").orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(n).collect()


def to_grid(x: np.ndarray) -> np.ndarray:
    return np.floor(x * SCALE).astype(np.int64)


def distances(parts: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows x entries, exact."""
    d = parts[:, None, :] - entries[None, :, :]
    return np.einsum("ijk,ijk->ij", d, d)


def full_scan(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = distances(parts, entries)
    at = d.argmin(axis=1)  # the first of equals
    return at, d[np.arange(len(at)), at]


def active_scan(parts: np.ndarray, entries: np.ndarray, moved: np.ndarray, at: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entries after an update, from the ones before it and their exact distances.

    An entry that stayed was no nearer than the assigned one before, and equally near only at a higher index; so a part
    whose entry stayed changes only to a moved entry that is nearer, or equally near at a lower index.
    """
    at, dist = at.copy(), dist.copy()
    active = np.flatnonzero(moved)
    if not len(active):
        return at, dist
    lost = moved[at]
    if lost.any():
        at[lost], dist[lost] = full_scan(parts[lost], entries)
    fixed = np.flatnonzero(~lost)
    if len(fixed):
        k, d = full_scan(parts[fixed], entries[active])
        k = active[k]
        better = (d < dist[fixed]) | ((d == dist[fixed]) & (k < at[fixed]))
        at[fixed[better]], dist[fixed[better]] = k[better], d[better]
    return at, dist


def _matrix(column: pa.Array, kind, width: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(len(column), width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    width = values.shape[1]
    return pa.ListArray.from_arrays(pa.array(np.arange(0, len(values) * width + 1, width), pa.int32()), pa.array(values.reshape(-1), kind))


def assign(state: DataFrame, books: np.ndarray, moved: np.ndarray | None) -> DataFrame:
    """One pass over all vectors: codes and distances under the given codebooks.

    Without ``moved`` the state has only grid components; with it, also the codes and distances before the update.
    """
    n_parts, _, width = books.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, CHUNK):
                batch = whole.slice(first, CHUNK)
                x = _matrix(batch["x"], np.int64, n_parts * width).reshape(-1, n_parts, width)
                code = np.empty((len(x), n_parts), np.int64)
                dist = np.empty((len(x), n_parts), np.int64)
                if moved is not None:
                    old_code, old_dist = _matrix(batch["code"], np.int64, n_parts), _matrix(batch["dist"], np.int64, n_parts)
                for p in range(n_parts):
                    if moved is None:
                        code[:, p], dist[:, p] = full_scan(x[:, p], books[p])
                    else:
                        code[:, p], dist[:, p] = active_scan(x[:, p], books[p], moved[p], old_code[:, p], old_dist[:, p])
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["label"], batch["x"], _lists(code, pa.int16()), _lists(dist, pa.int64())],
                                                 ["vec_id", "label", "x", "code", "dist"])

    label = state.schema["label"].dataType.simpleString()
    return state.mapInArrow(run, f"vec_id long, label {label}, x array<int>, code array<short>, dist array<long>")


def updated(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Codebooks of component-wise floored means; an entry without parts stays.

    Every task adds up what it reads and sends one row per entry it used; what reaches the driver is as large as the codebooks.
    """
    n_parts, n_entries, width = books.shape

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(books.shape, np.int64), np.zeros((n_parts, n_entries), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch["x"], np.int64, n_parts * width).reshape(-1, n_parts, width)
            code = _matrix(batch["code"], np.int64, n_parts)
            for p in range(n_parts):
                order = np.argsort(code[:, p], kind="stable")
                used, start = np.unique(code[order, p], return_index=True)
                sums[p, used] += np.add.reduceat(x[order, p], start, axis=0)
                n[p] += np.bincount(code[:, p], minlength=n_entries)
        p, e = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(n[p, e], pa.int64()), _lists(sums[p, e], pa.int64())],
                                         ["part", "entry", "n", "sums"])

    per_task = state.select("x", "code").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    rows = (per_task.select("part", "entry", "n", F.posexplode("sums").alias("pos", "s")).groupBy("part", "entry", "pos")
            .agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect())
    new = books.copy()
    for r in rows:
        new[r["part"], r["entry"], r["pos"]] = int(r["s"]) // r["n"]
    return new


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codes:
    """Codes of all vectors and the codebooks they refer to.

    Vectors that are null or hold null or non-finite components are dropped. The vector of the least id whose length is a
    multiple of ``parts`` sets the length; vectors of another length, or with components too large for an error that
    fits a long, stay as rows without code and error. The first entries are the parts of the ``entries`` least ids, fewer if
    there are fewer vectors; of repeated ids those of the least components. Null ids come last and null labels stay. Repeated
    rows count each, an empty table gives no rows, and other columns are not read.
    """
    rows = finite_rows(vectors)
    whole = rows.where((F.size("x") > 0) & (F.size("x") % parts == 0))
    first = first_rows(whole, 1)
    if not first:
        return Codes(rows.select("vec_id", "label", F.lit(None).cast("array<short>").alias("code"), F.lit(None).cast("long").alias("error")),
                     np.zeros((parts, 0, 0), np.int64))
    dims = len(first[0]["x"])
    largest = min((isqrt((2**63 - 1) // dims) - 1) // 2, 2**31 - 1)
    fits = (F.size("x") == dims) & F.forall("x", lambda v: F.abs(v * SCALE) < float(largest))
    seeds = first_rows(rows.where(fits), entries)
    odd = rows.where(~fits).select("vec_id", "label", F.lit(None).cast("array<short>").alias("code"), F.lit(None).cast("long").alias("error"))
    if not seeds:
        return Codes(odd, np.zeros((parts, 0, 0), np.int64))
    books = to_grid(np.array([r["x"] for r in seeds])).reshape(len(seeds), parts, dims // parts).transpose(1, 0, 2).copy()
    state = rows.where(fits).select("vec_id", "label", F.transform("x", lambda v: F.floor(v * SCALE).cast("int")).alias("x"))
    moved = None
    for i in range(rounds):
        state = materialize(assign(state, books, moved), f"codes-{i}")
        new = updated(state, books)
        moved = (new != books).any(axis=2)
        books = new
    last = assign(state, books, moved)
    error = F.aggregate("dist", F.lit(0).cast("long"), lambda a, d: a + d)
    return Codes(last.select("vec_id", "label", "code", error.alias("error")).unionByName(odd), books)


def label_errors(coded: DataFrame) -> DataFrame:
    """The rows with the sum of errors over their label; nulls are one label.

    A sum that does not fit a long is null. Sums are taken in every task first; the few or many labels meet the rows in a join that Spark
    splits where a label is skewed.
    """
    total = F.try_sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(total.alias("label_error"))
    return coded.join(sums, coded["label"].eqNullSafe(sums["_label"]), "left").drop("_label")


def digest(codes: Codes) -> DataFrame:
    """Codes as hex digits, two for each part."""
    rows = label_errors(materialize(codes.rows, "codes-last"))
    hexes = F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
    return rows.select("vec_id", hexes.alias("code"), "error", "label_error", F.lit(codes.fingerprint()).alias("codebooks_sha256"))
