"""Walk-forward plans and leak-free row assignment."""
from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PLAN = "fold_idx int, split string, start_time timestamp, end_time timestamp"


def walk_forward_plan(start: datetime, end: datetime, *, train: float = 90, val: float = 30, cal: float = 0, test: float = 30, step: float = 30,
                      embargo_hours: float = 24, holdout: float = 0) -> list[tuple]:
    """Rows (fold, split, start, end) of rolling windows in days; the holdout has fold -1."""
    if min(train, val, test, step) <= 0 or min(cal, holdout, embargo_hours) < 0:
        raise ValueError("windows must be positive and gaps not negative")
    if end <= start:
        raise ValueError("the end must be after the start")
    gap, rows, limit = timedelta(hours=embargo_hours), [], end
    if holdout:
        if end - timedelta(days=holdout) <= start:
            raise ValueError("final holdout leaves no room for a training fold")
        rows.append((-1, "holdout", end - timedelta(days=holdout), end))
        limit = end - timedelta(days=holdout) - gap
    fold, at = 0, start
    while True:
        parts, cursor = [], at
        for name, days in (("train", train), ("validation", val), ("calibration", cal), ("test", test)):
            if days:
                parts.append((fold, name, cursor, cursor + timedelta(days=days)))
                cursor = parts[-1][3] + gap
        if parts[-1][3] > limit:
            return rows
        rows += parts
        fold, at = fold + 1, at + timedelta(days=step)


def expanding_plan(start: datetime, end: datetime, *, share: float = 0.15, first: float = 0.5, folds: int = 6, embargo_hours: float = 12) -> list[tuple]:
    """Growing training windows with test windows of a share of the range."""
    width, at, rows = (end - start) * share, start + (end - start) * first, []
    for fold in range(1, folds + 1):
        if at + width > end + timedelta(minutes=5):
            break
        rows += [(fold, "train", start, at - timedelta(hours=embargo_hours)), (fold, "test", at, min(at + width, end))]
        at = min(at + width, end)
    return rows


def plan_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, PLAN)


def audit_plan(plan: DataFrame, embargo_hours: float = 24) -> DataFrame:
    """Violations of a plan as rows: short embargo, overlapping tests, touched holdout."""
    gap = int(embargo_hours * 3_600_000_000)
    w = Window.partitionBy("fold_idx").orderBy("start_time")
    folds = plan.where("fold_idx >= 0")
    near = folds.withColumn("_prev", F.lag("end_time").over(w)).where(F.unix_micros("start_time") - F.unix_micros("_prev") < gap).select(
        "fold_idx", "split", F.lit("embargo").alias("violation"))
    tests = folds.where("split = 'test'").withColumn("_prev", F.lag("end_time").over(Window.orderBy("fold_idx")))
    over = tests.where("start_time < _prev").select("fold_idx", "split", F.lit("test_overlap").alias("violation"))
    hold = plan.where("split = 'holdout'").agg(F.min("start_time"))
    touched = folds.where("split = 'test'").where(F.unix_micros("end_time") > F.unix_micros(hold.scalar()) - gap).select(
        "fold_idx", "split", F.lit("holdout").alias("violation"))
    return near.unionByName(over).unionByName(touched)


def assign_splits(df: DataFrame, rows: list[tuple], t: str = "signal_time") -> DataFrame:
    """Rows of each (fold, split) by half-open bounds.

    The plan has a handful of bounds, so they become literals of one
    projection: no join, and each row is copied once per window it is in.
    """
    stamp = lambda x: f"TIMESTAMP '{x:%Y-%m-%d %H:%M:%S.%f}'"
    hits = ", ".join(f"CASE WHEN {t} >= {stamp(a)} AND {t} < {stamp(b)} THEN named_struct('fold_idx', {f}, 'split', '{s}') END" for f, s, a, b in rows)
    return df.selectExpr("*", f"inline(array_compact(array({hits})))")


def event_safe(df: DataFrame, rows: list[tuple], t: str = "signal_time") -> tuple[DataFrame, DataFrame]:
    """Rows without the events that lie in more than one split (or partly in none), and those events.

    Distinct (event, split) pairs are counted, so a long event costs one row per split.
    """
    stamp = lambda x: f"TIMESTAMP '{x:%Y-%m-%d %H:%M:%S.%f}'"
    names = ", ".join(f"CASE WHEN {t} >= {stamp(a)} AND {t} < {stamp(b)} THEN '{f}:{s}' END" for f, s, a, b in rows)
    member = df.where(f"event_id IS NOT NULL AND {t} IS NOT NULL").selectExpr("event_id", f"array_compact(array({names})) AS m").selectExpr(
        "event_id", "explode(CASE WHEN size(m) = 0 THEN array('__unassigned__') ELSE m END) AS split").distinct()
    bad = member.groupBy("event_id").agg(F.count(F.lit(1)).alias("n_splits")).where("n_splits > 1")
    return df.join(bad.select("event_id"), "event_id", "left_anti").select(*df.columns), bad


def chronological_cut(df: DataFrame, share: float, t: str = "signal_time") -> DataFrame:
    """Mark rows before the time quantile as ``fit``, the rest as ``calibrate``."""
    from tidemark.operators.ordered import with_scalar
    from tidemark.operators.quantiles import exact_percentiles
    # distances from the first time spread over the percentile's relative buckets; the times themselves would share a few
    df = with_scalar(df, df.agg(F.min(F.unix_micros(t)).alias("_first")), "_first")
    since = F.unix_micros(t) - F.col("_first")
    cut = exact_percentiles(df, (), since.cast("double"), {"cut": share}).select("cut").scalar()
    return df.withColumn("part", F.when(since < cut, "fit").otherwise("calibrate")).drop("_first")
