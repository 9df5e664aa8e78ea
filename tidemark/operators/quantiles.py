"""Exact percentiles of groups of any size.

The built-in ``percentile`` keeps all distinct values of a group in one task.
Here values are first counted per (group, value), then per logarithmic bucket;
only the buckets that hold a wanted rank are ordered, each on its own.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Values within 1/4096 of each other (relative) share a bucket.
BUCKET = ("CASE WHEN _x > 0 THEN 4194304L + CAST(floor(ln(_x) * 4096) AS BIGINT) "
          "WHEN _x < 0 THEN -4194304L - CAST(floor(ln(-_x) * 4096) AS BIGINT) ELSE 0L END")


def _ranks(q: float, kind: str) -> tuple[Column, Column, Column]:
    """Lower rank, upper rank and weight of the upper value, ranks from 0."""
    n = F.col("_n").cast("double")
    if kind == "linear":
        at = (n - 1) * q
        return F.floor(at), F.ceil(at), at - F.floor(at)
    if kind == "nearest":
        # half-way cases go to the even rank
        at = F.bround((n - 1) * q, 0)
        return at, at, F.lit(0.0)
    if kind == "index":
        at = F.least(F.floor(n * q), n - 1)
        return at, at, F.lit(0.0)
    raise ValueError(f"unknown percentile kind {kind!r}")


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: Column, points: dict[str, float],
                      kind: str = "linear") -> DataFrame:
    """One row per group with its non-null count ``n_values`` and the wanted percentiles.

    ``linear`` interpolates, ``nearest`` rounds the rank, ``index`` takes the
    element at ``floor(n*q)`` of the sorted values.
    """
    keys = list(keys)
    one = not keys
    df = df.select(*keys, value.cast("double").alias("_x")).where("_x IS NOT NULL AND NOT isnan(_x)")
    if one:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    counted = df.groupBy(*keys, "_x").agg(F.count(F.lit(1)).alias("_c")).withColumn("_b", F.expr(BUCKET))
    upto = Window.partitionBy(*keys).orderBy("_b")
    buckets = counted.groupBy(*keys, "_b").agg(F.sum("_c").alias("_bc"))
    buckets = (buckets.withColumn("_end", F.sum("_bc").over(upto.rowsBetween(Window.unboundedPreceding, 0)))
               .withColumn("_n", F.sum("_bc").over(Window.partitionBy(*keys)))
               .withColumn("_start", F.col("_end") - F.col("_bc")))
    wanted = F.lit(False)
    for q in points.values():
        for rank in _ranks(q, kind)[:2]:
            wanted = wanted | ((rank >= F.col("_start")) & (rank < F.col("_end")))
    hot = buckets.where(wanted).select(*keys, "_b", "_start", "_n")
    inside = Window.partitionBy(*keys, "_b").orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    placed = (counted.join(hot, [*keys, "_b"])
              .withColumn("_hi", F.col("_start") + F.sum("_c").over(inside))
              .withColumn("_lo", F.col("_hi") - F.col("_c")))
    covers = lambda rank: (rank >= F.col("_lo")) & (rank < F.col("_hi"))
    aggs = [F.max("_n").alias("n_values")]
    for name, q in points.items():
        low, high, weight = _ranks(q, kind)
        a = F.max(F.when(covers(low), F.col("_x")))
        b = F.max(F.when(covers(high), F.col("_x")))
        w = F.max(weight)
        aggs.append((a + (b - a) * w).alias(name))
    out = placed.groupBy(*keys).agg(*aggs)
    return out.drop("_all") if one else out
