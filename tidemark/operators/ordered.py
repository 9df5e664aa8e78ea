"""Ordered work per key that never puts a whole key into one task.

Every operator here works on slices of a key: by time (``span`` seconds) or by
row position (``block`` rows).  A slice carries the neighbouring rows its
frames need (a halo), or the state of earlier slices reaches it through a
table of one row per slice.  A key that holds a third of all rows is thus
spread over many tasks, and the result is the same as one window over the key.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.columns import MICROS, as_col, grid, micros, sql_grid

DAY = 86_400
SLICE = "_slice"
OWN = "_own"


def time_slices(df: DataFrame, t: str, span: int, before: int = 0, after: int = 0) -> DataFrame:
    """Assign rows to time slices, copying halo rows into neighbours.

    Slice ``s`` owns ``[s*span, (s+1)*span)`` and also sees the rows up to
    ``before`` seconds earlier and ``after`` seconds later.
    """
    home = sql_grid(t, span)
    if not before and not after:
        return df.selectExpr("*", f"{home} AS {SLICE}", f"true AS {OWN}")
    low = sql_grid(f"CAST({t} AS TIMESTAMP) - INTERVAL {after} SECONDS", span)
    high = sql_grid(f"CAST({t} AS TIMESTAMP) + INTERVAL {before} SECONDS", span)
    return (df.selectExpr("*", f"{home} AS _home", f"explode(sequence({low}, {high})) AS {SLICE}")
              .selectExpr("* EXCEPT (_home)", f"{SLICE} = _home AS {OWN}"))


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], t: str,
                  span: int = 30 * DAY, out: str = "_pos", last: int | None = None) -> DataFrame:
    """Zero-based row number inside each key.

    Rows are numbered inside a time slice and shifted by the number of rows in
    the earlier slices, so no task sorts a whole key.  With ``last`` only about
    the newest ``last`` rows of each key are kept (whole slices), which the
    count table decides before any row is sorted.
    """
    by, first = ", ".join(keys), ", ".join(order)
    sliced = df.selectExpr("*", f"{sql_grid(t, span)} AS {SLICE}")
    offsets = (sliced.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("_n")).selectExpr(
        *keys, SLICE, f"coalesce(sum(_n) OVER (PARTITION BY {by} ORDER BY {SLICE} "
                      "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS _offset",
        "_n", f"sum(_n) OVER (PARTITION BY {by}) AS _total"))
    if last is not None:
        offsets = offsets.where(f"_offset + _n > _total - {last}")
    return (sliced.join(offsets.drop("_n", "_total"), [*keys, SLICE])
            .selectExpr(f"* EXCEPT (_offset, {SLICE})",
                        f"row_number() OVER (PARTITION BY {by}, {SLICE} ORDER BY {first}) - 1 + _offset AS {out}"))


def row_blocks(df: DataFrame, pos: str, block: int, before: int = 0, after: int = 0) -> DataFrame:
    """Assign rows to position blocks, copying halo rows into neighbours."""
    low = f"greatest(CAST(floor(({pos} - {after}) / {block}) AS BIGINT), 0L)"
    return (df.selectExpr("*", f"explode(sequence({low}, ({pos} + {before}) DIV {block})) AS {SLICE}")
              .selectExpr("*", f"{SLICE} = {pos} DIV {block} AS {OWN}"))


def running_last(df: DataFrame, keys: Sequence[str], t: str, order: Sequence[str],
                 value: Column, out: str, span: int = 7 * DAY, inclusive: bool = True) -> DataFrame:
    """Last non-null value at (or before) each row, over the whole key."""
    sliced = df.withColumn(SLICE, grid(t, span)).withColumn("_v", value)
    stamp = F.struct(*[F.col(c) for c in order])
    tails = (sliced.groupBy(*keys, SLICE)
             .agg(F.max_by(F.when(F.col("_v").isNotNull(), F.struct("_v")),
                           F.when(F.col("_v").isNotNull(), stamp)).alias("_tail")))
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*keys, SLICE, F.last("_tail", True).over(earlier).alias("_carry"))
    local = (Window.partitionBy(*keys, SLICE).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    return (sliced.withColumn("_local", F.last(F.when(F.col("_v").isNotNull(), F.struct("_v")), True).over(local))
            .join(carry, [*keys, SLICE])
            .withColumn(out, F.coalesce(F.col("_local"), F.col("_carry"))["_v"])
            .drop("_v", "_local", "_carry", SLICE))


def running_sum(df: DataFrame, keys: Sequence[str], t: str, order: Sequence[str],
                values: dict[str, Column], span: int = 7 * DAY, slice_by: Column | None = None) -> DataFrame:
    """Cumulative sums over the whole key, one output column per entry.

    ``slice_by`` replaces the time slices for rows ordered by something else;
    it must not decrease in the given order.
    """
    sliced = df.withColumn(SLICE, grid(t, span) if slice_by is None else slice_by)
    for name, value in values.items():
        sliced = sliced.withColumn(f"_x_{name}", value)
    totals = sliced.groupBy(*keys, SLICE).agg(*[F.sum(f"_x_{n}").alias(f"_t_{n}") for n in values])
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, SLICE, *[
        F.sum(f"_t_{n}").over(earlier).alias(f"_c_{n}") for n in values])
    local = Window.partitionBy(*keys, SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for n in values:
        sliced = sliced.withColumn(f"_x_{n}", F.sum(f"_x_{n}").over(local))
    out = sliced.join(carry, [*keys, SLICE])
    for n in values:
        local_sum, base = F.col(f"_x_{n}"), F.col(f"_c_{n}")
        out = out.withColumn(n, F.when(local_sum.isNull(), base).when(base.isNull(), local_sum)
                             .otherwise(local_sum + base)).drop(f"_x_{n}", f"_c_{n}")
    return out.drop(SLICE)


def running_extreme(df: DataFrame, keys: Sequence[str], t: str, order: Sequence[str],
                    value: Column, out: str, kind: str = "max", span: int = 7 * DAY,
                    inclusive: bool = True) -> DataFrame:
    """Running maximum or minimum over the whole key."""
    agg, pick = (F.max, F.greatest) if kind == "max" else (F.min, F.least)
    sliced = df.withColumn(SLICE, grid(t, span)).withColumn("_x", value)
    totals = sliced.groupBy(*keys, SLICE).agg(agg("_x").alias("_t"))
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(*keys, SLICE, agg("_t").over(earlier).alias("_c"))
    local = (Window.partitionBy(*keys, SLICE).orderBy(*order)
             .rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1))
    return (sliced.withColumn("_m", agg("_x").over(local)).join(carry, [*keys, SLICE])
            .withColumn(out, pick("_m", "_c")).drop("_x", "_m", "_c", SLICE))


def asof_backward(left: DataFrame, right: DataFrame, keys: Sequence[str], left_t: str, right_t: str,
                  values: Sequence[str], span: int = DAY, max_age: int | None = None) -> DataFrame:
    """Attach the newest right row with ``right_t <= left_t``; NULL when there is none.

    Of right rows at one time that with the largest values counts, so a repeated run gives the same.

    With ``max_age`` (seconds) right rows only need copying that far ahead and
    one shuffle of the union of both sides on (key, time slice) does the join;
    a match older than that may come back as NULL.  Without it, what a slice
    inherits comes from a table of one row per slice.
    """
    a = (left.select(*keys, F.col(left_t).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l"))
         .withColumn(SLICE, grid("_t", span)))
    b = (right.where(F.col(right_t).isNotNull())
         .select(*keys, F.col(right_t).alias("_t"), F.lit(0).alias("_side"), F.struct(*values).alias("_r")))
    w = Window.partitionBy(*keys, SLICE).orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    if max_age is not None:
        b = time_slices(b, "_t", span, before=max_age).drop(OWN)
        both = a.unionByName(b, allowMissingColumns=True)
        hit = both.withColumn("_r", F.last("_r", True).over(w)).where(F.col("_side") == 1)
        return hit.select("_l.*", *[F.col("_r")[v].alias(v) for v in values])
    both = a.unionByName(b.withColumn(SLICE, grid("_t", span)), allowMissingColumns=True)
    tails = both.groupBy(*keys, SLICE).agg(
        F.max_by("_r", F.when(F.col("_side") == 0, F.struct("_t", "_r"))).alias("_tail"))
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.select(*keys, SLICE, F.last("_tail", True).over(earlier).alias("_carry"))
    hit = (both.withColumn("_r", F.last("_r", True).over(w)).where(F.col("_side") == 1)
           .join(carry, [*keys, SLICE], "left")
           .withColumn("_r", F.coalesce("_r", "_carry")))
    return hit.select("_l.*", *[F.col("_r")[v].alias(v) for v in values])


def asof_nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], left_t: str, right_t: str,
                 values: Sequence[str], tolerance: int, span: int = DAY) -> DataFrame:
    """Attach the right row closest in time within ``tolerance`` seconds.

    An earlier row wins a tie.  The tolerance bounds the halo, so one shuffle
    is enough.
    """
    a = (time_slices(left.withColumn("_t", F.col(left_t)), "_t", span)
         .select(*keys, SLICE, "_t", F.lit(1).alias("_side"), F.struct(*left.columns).alias("_l")))
    b = (time_slices(right.withColumn("_t", F.col(right_t)), "_t", span, tolerance, tolerance)
         .select(*keys, SLICE, "_t", F.lit(0).alias("_side"),
                 F.struct(*values, F.col("_t").alias("_rt")).alias("_r")))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(*keys, SLICE).orderBy("_t", "_side")
    u = Window.partitionBy(*keys, SLICE).orderBy(F.col("_t").desc(), F.col("_side").desc())
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    # scanning backwards keeps the frame a running one
    future = u.rowsBetween(Window.unboundedPreceding, 0)
    hit = (both.withColumn("_before", F.last("_r", True).over(past))
           .withColumn("_after", F.last("_r", True).over(future))
           .where(F.col("_side") == 1))
    lag_ = micros("_t") - micros(F.col("_before")["_rt"])
    lead_ = micros(F.col("_after")["_rt"]) - micros("_t")
    limit = F.lit(tolerance * MICROS)
    use_before = (lag_ <= limit) & (lead_.isNull() | (lag_ <= lead_))
    pick = F.when(use_before, F.col("_before")).when(lead_ <= limit, F.col("_after"))
    return hit.withColumn("_p", pick).select("_l.*", *[F.col("_p")[v].alias(v) for v in values])


def sessionize(df: DataFrame, keys: Sequence[str], t: str, gap: int, out: str,
               span: int = 7 * DAY) -> DataFrame:
    """Start time of the session each row belongs to.

    A row starts a session when it is at least ``gap`` seconds after the
    previous row of its key.  Breaks inside a slice are found by ``lag``; a
    table of one row per slice links the slices.
    """
    w = Window.partitionBy(*keys, SLICE).orderBy(t)
    far = F.lit(gap * MICROS)
    rows = (df.withColumn(SLICE, grid(t, span))
            .withColumn("_prev", F.lag(t).over(w))
            .withColumn("_break", F.when(micros(t) - micros("_prev") >= far, F.col(t)))
            .withColumn("_local", F.last("_break", True).over(w.rowsBetween(Window.unboundedPreceding, 0))))
    ends = rows.groupBy(*keys, SLICE).agg(
        F.min(t).alias("_first"), F.max(t).alias("_last"), F.max("_break").alias("_inner"))
    k = Window.partitionBy(*keys).orderBy(SLICE)
    ends = (ends.withColumn("_gap", micros("_first") - micros(F.lag("_last").over(k)))
            .withColumn("_open", F.when(F.col("_gap").isNull() | (F.col("_gap") >= far), F.col("_first")))
            .withColumn("_latest", F.coalesce("_inner", "_open"))
            .withColumn("_carry", F.last("_latest", True).over(k.rowsBetween(Window.unboundedPreceding, -1)))
            .select(*keys, SLICE, F.coalesce("_open", "_carry").alias("_edge")))
    return (rows.join(ends, [*keys, SLICE])
            .withColumn(out, F.coalesce("_local", "_edge"))
            .drop("_prev", "_break", "_local", "_edge", SLICE))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Newest row per key by ``order`` (ascending meaning), as a map-side aggregate.

    ``max_by`` keeps one row per key per task before the shuffle, so a hot key
    sends one row per task instead of all its rows.
    """
    stamp = F.struct(*[as_col(c).alias(f"o{i}") for i, c in enumerate(order)])
    row = F.struct(*df.columns)
    return (df.groupBy(*keys).agg(F.max_by(row, stamp).alias("_row"))
            .select("_row.*"))


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    stamp = F.struct(*[as_col(c).alias(f"o{i}") for i, c in enumerate(order)])
    return (df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), stamp).alias("_row"))
            .select("_row.*"))


def with_scalar(df: DataFrame, one_row: DataFrame, *names: str) -> DataFrame:
    """Add the columns of a global aggregate (always exactly one row)."""
    packed = one_row.select(F.struct(*names)).scalar()
    return df.withColumn("_s", packed).select("*", *[F.col("_s")[n].alias(n) for n in names]).drop("_s")


def stacked_rank(df: DataFrame, keys: Sequence[str], order: Sequence[Column], limit: int,
                 out: str = "rank") -> DataFrame:
    """Rank 1..limit inside each key; Spark keeps only ``limit`` rows per task first."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= limit)
