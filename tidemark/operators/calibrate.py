"""Calibration of scores for all groups at once: isotonic steps and two-parameter logistic curves.

Both work on cells, the distinct scores of a group with their rows and positives, so equal scores cost nothing and a
group of any size is spread.
"""
from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.speculative import BLOCK, ROWS, blocks_of
from tidemark.sources.tables import materialize

POOL = T.ArrayType(T.StructType([T.StructField("lo", T.DoubleType()), T.StructField("hi", T.DoubleType()), T.StructField("n", T.LongType()), T.StructField("pos", T.LongType())]))
_POOL = pa.list_(pa.struct([("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int64()), ("pos", pa.int64())]))
BUCKETS = 1024
_X = "_x"


def score_cells(df: DataFrame, keys: Sequence[str], prob: str = "probability", label: str = "label_value") -> DataFrame:
    """keys, x, n, pos; rows without score or label don't count."""
    rows = df.select(*keys, F.col(prob).cast("double").alias("x"), F.col(label).cast("long").alias("y")).where("x IS NOT NULL AND NOT isnan(x) AND y IS NOT NULL")
    return rows.groupBy(*keys, "x").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("pos"))


def pool(cells: list[dict], onto: list[dict] | None = None) -> list[dict]:
    """Adjacent violators pooled: stretches of rising score with rising shares of positives; ``onto`` are the stretches before.

    Shares are compared as whole numbers. Pooling a part first changes nothing, so parts can be pooled apart and merged in order.
    """
    out = onto if onto is not None else []
    for c in cells:
        c = dict(c)
        while out and out[-1]["pos"] * c["n"] >= c["pos"] * out[-1]["n"]:
            last = out.pop()
            c = {"lo": last["lo"], "hi": c["hi"], "n": last["n"] + c["n"], "pos": last["pos"] + c["pos"]}
        out.append(c)
    return out


@F.arrow_udf(POOL)
def _pool_cells(cells: pa.Array) -> pa.Array:
    return pa.array([pool([{"lo": c["x"], "hi": c["x"], "n": c["n"], "pos": c["pos"]} for c in cs]) for cs in cells.to_pylist()], _POOL)


@F.arrow_udf(POOL)
def _merge_pools(pools: pa.Array) -> pa.Array:
    merged = []
    for parts in pools.to_pylist():
        out: list[dict] = []
        for p in parts:
            out = pool(p["pool"], out)
        merged.append(out)
    return pa.array(merged, _POOL)


def fit_isotonic_groups(df: DataFrame, keys: Sequence[str], *, prob: str = "probability", label: str = "label_value", block_rows: int = 4096, fan: int = 32) -> DataFrame:
    """keys and the pooled stretches (lo, hi, n, pos) of every group, in one job for all groups.

    Cells are pooled per block of the sorted scores. Up to ``fan`` neighbouring parts merge per round until a group is one
    part, so a task never holds more than ``fan`` pooled parts.
    """
    keys = list(keys)
    cells = score_cells(df, keys, prob, label)
    parts = blocks_of(cells, keys, ["x"], block_rows).select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(BLOCK)).alias("_at"), _pool_cells(ROWS).alias("pool"))
    parts = materialize(parts.withColumn("_at", F.col("_at") - 1), "pools")
    while (parts.agg(F.max("_at")).first()[0] or 0) > 0:
        near = parts.groupBy(*keys, F.expr(f"_at DIV {fan}").cast("int").alias("_up")).agg(F.sort_array(F.collect_list(F.struct("_at", "pool"))).alias("ps"))
        parts = materialize(near.select(*keys, F.col("_up").alias("_at"), _merge_pools("ps").alias("pool")), "pools")
    return parts.select(*keys, "pool")


def isotonic_pieces(models: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys and the linear pieces [lo, hi) of a model with their values at both ends: level on a stretch, straight between two, level beyond the ends."""
    inf = "CAST('Infinity' AS DOUBLE)"
    y = lambda c: f"{c}.pos / {c}.n"
    flat = f"transform(pool, c -> struct(c.lo AS lo, c.hi AS hi, {y('c')} AS y0, {y('c')} AS y1))"
    between = f"transform(slice(pool, 2, size(pool) - 1), (c, i) -> struct(pool[i].hi AS lo, c.lo AS hi, {y('pool[i]')} AS y0, {y('c')} AS y1))"
    last = "element_at(pool, -1)"
    ends = f"array(struct(-{inf} AS lo, pool[0].lo AS hi, {y('pool[0]')} AS y0, {y('pool[0]')} AS y1), struct({last}.hi AS lo, {inf} AS hi, {y(last)} AS y0, {y(last)} AS y1))"
    return models.selectExpr(*keys, f"inline(concat({flat}, {between}, {ends}))").where("lo < hi")


def apply_isotonic_groups(df: DataFrame, models: DataFrame, keys: Sequence[str], *, prob: str = "probability", out: str = "calibrated") -> DataFrame:
    """The rows with their calibrated score; null for null scores and for groups without a model.

    Rows and pieces meet by key and by one of 1,024 cells of the score, so a group's rows are dealt by score as well.
    """
    at = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(BUCKETS - 1.0), F.floor(x * BUCKETS).cast("double"))).cast("int")
    pieces = isotonic_pieces(models, keys).withColumn("_b", F.explode(F.sequence(at(F.col("lo")), at(F.col("hi"))))).withColumnsRenamed({k: f"_m_{k}" for k in keys})
    rows = df.withColumn(_X, F.col(prob).cast("double")).withColumn("_c", at(F.col(_X)))
    on = (F.col("_c") == F.col("_b")) & (F.col(_X) >= F.col("lo")) & (F.col(_X) < F.col("hi"))
    for k in keys:
        on = on & rows[k].eqNullSafe(pieces[f"_m_{k}"])
    value = F.when(F.col("y0") == F.col("y1"), F.col("y0")).otherwise(F.col("y0") + (F.col(_X) - F.col("lo")) / (F.col("hi") - F.col("lo")) * (F.col("y1") - F.col("y0")))
    return rows.join(pieces, on, "left").withColumn(out, value).drop(_X, "_c", "_b", "lo", "hi", "y0", "y1", *[f"_m_{k}" for k in keys])


def newton_step(params: DataFrame, cells: DataFrame, keys: Sequence[str], ridge: float) -> DataFrame:
    """One step of all groups: gradient and curvature from one aggregate over the cells. The slope is held by ``ridge``, the intercept is free."""
    p = params.withColumnsRenamed({k: f"_p_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & cells[k].eqNullSafe(p[f"_p_{k}"])
    c = cells.join(p, on).drop(*[f"_p_{k}" for k in keys])
    c = c.withColumn("s", 1.0 / (1.0 + F.exp(-(F.col("a") * F.col("x") + F.col("b")))))
    c = c.withColumns({"e": F.col("n") * F.col("s") - F.col("pos"), "w": F.col("n") * F.col("s") * (1 - F.col("s"))})
    sums = c.groupBy(*keys).agg(F.first("a").alias("a"), F.first("b").alias("b"), F.sum(F.col("e") * F.col("x")).alias("ga"), F.sum("e").alias("gb"),
                                F.sum(F.col("w") * F.col("x") * F.col("x")).alias("haa"), F.sum(F.col("w") * F.col("x")).alias("hab"), F.sum("w").alias("hbb"))
    sums = sums.withColumns({"ga": F.col("ga") + ridge * F.col("a"), "haa": F.col("haa") + ridge})
    det = F.col("haa") * F.col("hbb") - F.col("hab") * F.col("hab")
    da = (F.col("hbb") * F.col("ga") - F.col("hab") * F.col("gb")) / det
    db = (F.col("haa") * F.col("gb") - F.col("hab") * F.col("ga")) / det
    return sums.select(*keys, (F.col("a") - da).alias("a"), (F.col("b") - db).alias("b"), F.greatest(F.abs(da), F.abs(db)).alias("moved"))


def fit_platt_groups(df: DataFrame, keys: Sequence[str], *, prob: str = "probability", label: str = "label_value", ridge: float = 1.0, steps: int = 25,
                     tolerance: float = 1e-12) -> DataFrame:
    """keys, slope ``a``, intercept ``b`` and the last change ``moved`` of every group that has both classes.

    All groups take each step together, until none moves by more than ``tolerance`` or after ``steps``. Groups of one class have no curve.
    """
    cells = materialize(score_cells(df, keys, prob, label), "score-cells")
    both = cells.groupBy(*keys).agg(F.sum("pos").alias("_p"), F.sum("n").alias("_n")).where("_p > 0 AND _p < _n")
    params = both.select(*keys, F.lit(0.0).alias("a"), F.ln(F.col("_p") / (F.col("_n") - F.col("_p"))).alias("b"), F.lit(1.0).alias("moved"))
    for _ in range(steps):
        params = materialize(newton_step(params, cells, keys, ridge), "newton")
        if (params.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            break
    return params


def apply_platt_groups(df: DataFrame, models: DataFrame, keys: Sequence[str], *, prob: str = "probability", out: str = "calibrated") -> DataFrame:
    """The rows with their calibrated score; null for null scores and for groups without a curve."""
    m = models.select(*[F.col(k).alias(f"_m_{k}") for k in keys], F.col("a").alias("_a"), F.col("b").alias("_b"))
    on = F.lit(True)
    for k in keys:
        on = on & df[k].eqNullSafe(m[f"_m_{k}"])
    curve = 1.0 / (1.0 + F.exp(-(F.col("_a") * F.col(prob).cast("double") + F.col("_b"))))
    return df.join(m, on, "left").withColumn(out, curve).drop("_a", "_b", *[f"_m_{k}" for k in keys])
