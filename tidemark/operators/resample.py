"""Bootstrap intervals from counted draws.

Draw j of replicate b takes observation ``md5(seed:b:j) mod n``. So a draw depends on nothing but its own numbers: tasks need no
random state, a repeated task gives the same draws, and any engine with md5 gets the same intervals.
Observations are whole groups (events, days), given as integer cells; a replicate adds up the cells it drew.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_percentiles

SEED = 42
#: Kinds of cells, or blocks of time, that one packed array may hold.
MAX_CELLS = 100_000


def replicate_sums(cells: DataFrame, order: Sequence[str], values: Sequence[str], replicates: int, seed: int = SEED, count: str | None = None) -> DataFrame:
    """Per replicate the sums of the drawn cells' values.

    ``cells`` in the order of ``order`` are the observations, or with ``count`` the kinds of observations and how many there are of each.
    Only kinds and blocks of time are packed, never rows: more than ``MAX_CELLS`` are refused.
    """
    one = F.col(count).cast("long") if count else F.lit(1).cast("long")
    listed = F.sort_array(F.collect_list(F.struct(*order, *[F.col(v).cast("long").alias(f"_v_{v}") for v in values])))
    size = cells.agg(F.count(F.lit(1)), F.sum(one)).first()
    n = size[1] or 0
    if size[0] > MAX_CELLS:
        raise ValueError(f"{size[0]} cells to resample; group them into at most {MAX_CELLS}")
    draws = cells.sparkSession.range(replicates * n).selectExpr(f"id DIV {max(n, 1)} AS b", f"id % {max(n, 1)} AS j")
    draws = draws.withColumn("at", F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "b", "j").cast("binary")), 1, 15), 16, 10).cast("long") % max(n, 1))
    if count:
        # few kinds: the first whose running count passes the draw
        ends = cells.withColumn("_end", F.sum(one).over(Window.orderBy(*order))).agg(F.sort_array(F.collect_list("_end"))).scalar()
        draws = draws.withColumn("_ends", ends)
        place = F.size(F.filter("_ends", lambda e: e <= F.col("at"))) + 1
    else:
        place = (F.col("at") + 1).cast("int")
    cell_list = cells.agg(listed).scalar()
    drawn = draws.withColumn("c", F.element_at(cell_list, place))
    return drawn.groupBy("b").agg(*[F.sum(f"c._v_{v}").alias(v) for v in values])


def counted_interval(cells: DataFrame, order: Sequence[str], values: Sequence[str], statistic: Column, *, replicates: int = 1000, level: float = 0.95,
                     seed: int = SEED, count: str | None = None, kind: str = "index") -> DataFrame:
    """One row: observations ``n``, the point estimate and the interval of a statistic of the sums; NULL where there is nothing to draw.

    Replicates without a value don't count.
    """
    cells = cells.select(*order, *values, *([count] if count and count not in values else []))
    tail = (1.0 - level) / 2.0
    sums = replicate_sums(cells, order, values, replicates, seed, count)
    ends = exact_percentiles(sums, (), statistic, {"ci_lower": tail, "ci_upper": 1.0 - tail}, kind)
    m = F.col(count) if count else F.lit(1)
    point = cells.agg(F.coalesce(F.sum(m.cast("long")), F.lit(0)).alias("n"), *[F.sum(m * F.col(v)).alias(v) for v in values]).select("n", statistic.alias("point"))
    point = point.withColumn("_i", ends.select(F.struct("ci_lower", "ci_upper")).scalar())
    return point.selectExpr("n", "point", "_i.ci_lower", "_i.ci_upper")


def ratio_of(a: str, b: str) -> Column:
    return F.try_divide(F.col(a).cast("double"), F.col(b).cast("double"))


def paired_filter_intervals(decisions: DataFrame, truth: DataFrame, *, replicates: int = 10_000, seed: int = SEED) -> DataFrame:
    """Challenger minus champion with intervals: recall over truth events (``event_recall``), and precision of the first ten ranks over days (``precision_at_10``).

    Both arms share every draw. Events fall into four kinds by who caught them; days are whole blocks with the arms' counts.
    """
    d = decisions.join(truth.select("symbol", "signal_time", "truth_event"), ["symbol", "signal_time"], "left")
    caught = lambda arm: F.max(F.expr(f"CAST(arm = '{arm}' AND selected AND label_value = 1 AS INT)"))
    events = d.where("truth_event IS NOT NULL").groupBy("truth_event").agg(caught("champion").alias("a"), caught("challenger").alias("c"))
    kinds = events.groupBy("a", "c").agg(F.count(F.lit(1)).alias("n"), F.lit(1).alias("one"))
    recall = counted_interval(kinds, ["a", "c"], ["a", "c", "one"], (F.col("c") - F.col("a")) / F.col("one"), replicates=replicates, seed=seed, count="n", kind="linear")
    top = d.where("selected AND rank <= 10 AND label_value IS NOT NULL").withColumn("day", F.to_date("signal_time"))
    side = lambda arm: [F.count_if((F.col("arm") == arm) & (F.col("label_value") == 1)).alias(f"{arm}_hit"), F.count_if(F.col("arm") == arm).alias(f"{arm}_all")]
    days = top.groupBy("day").agg(*side("champion"), *side("challenger"))
    delta = ratio_of("challenger_hit", "challenger_all") - ratio_of("champion_hit", "champion_all")
    precision = counted_interval(days, ["day"], ["champion_hit", "champion_all", "challenger_hit", "challenger_all"], delta, replicates=replicates, seed=seed, kind="linear")
    return recall.select(F.lit("event_recall").alias("kind"), "*").unionByName(precision.select(F.lit("precision_at_10").alias("kind"), "*"))


def lower_ends(intervals: DataFrame) -> DataFrame:
    """One row with what the promotion gates ask for."""
    low = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("ci_lower")))
    return intervals.agg(low("precision_at_10").alias("precision_low"), low("event_recall").alias("recall_low"))
