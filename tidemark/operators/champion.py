"""A challenger trained on judged rows, held against a frozen champion on rows neither has seen, and the ledger of such runs.

Rows carry symbol, signal_time, label_value (0 or 1), event_id (null outside events) and the champion's inputs. The newest half of
the rows after the champion's training is held out. Of the rows before it the first four fifths train a model that picks the
threshold on the last fifth; a model of all of them is the challenger. Recent rows weigh more. Nothing is promoted: a run tells
whether the challenger may be looked at.
"""
from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import ml, ordered, reports, splits
from tidemark.sources.tables import materialize

DAY_US = 86_400_000_000
LEDGER = ("champion string, fingerprint string, n_rows long, status string, reason string, threshold double, "
          "checks array<struct<check: string, actual: double, passed: boolean>>, run_at timestamp")
RUN = ("champion string, status string, reason string, fingerprint string, n_rows long, n_positive_events long, n_recent long, n_new long, "
       "n_train long, n_validate long, n_holdout long, threshold double, checks array<struct<check: string, actual: double, passed: boolean>>")
# States of runs that trained a challenger; only these count as earlier runs.
TRAINED = ("challenger_ready", "gate_failed")


@dataclass(frozen=True)
class Policy:
    """When a run may take place, how rows weigh, and what a challenger has to show. The numbers are fixed values."""

    min_rows: int = 200
    min_positive_events: int = 20
    min_new: int = 50
    min_forward: int = 4
    recent_days: int = 14
    recent_weight: float = 2.0
    min_recall: float = 0.5
    min_gain: float = 0.01
    max_recall_loss: float = 0.05
    max_brier_loss: float = 0.01


@dataclass(frozen=True)
class Champion:
    """A frozen model with its inputs, threshold, and the time of its newest training row in microseconds."""

    name: str
    model: PipelineModel
    columns: list[str]
    threshold: float
    cutoff: int


def _time() -> Column:
    return F.unix_micros("signal_time")


def freeze(name: str, rows: DataFrame, columns: list[str]) -> Champion:
    """Fit on all rows; the threshold is the best of a model that lacks the newest fifth."""
    cut = materialize(splits.chronological_cut(rows, 0.8), "champion")
    fit, window = cut.where("part = 'fit'"), cut.where("part = 'calibrate'")
    models = ml.fit_concurrently({"part": fit, "all": cut}, {"part": columns, "all": columns})
    return Champion(name, models["all"], columns, ml.pick_f1_threshold(ml.score(models["part"], window)), cut.agg(F.max(_time())).first()[0])


def readiness(rows: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """One row: rows, positive events (positive rows where no event is known), rows of the recent window, and the content's fingerprint."""
    positive = F.col("label_value") == 1
    newest = ordered.with_scalar(rows, rows.agg(F.max(_time()).alias("_newest")), "_newest")
    n = newest.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(positive).alias("_positive"), F.countDistinct(F.when(positive, F.col("event_id"))).alias("_events"),
                   F.count_if(_time() >= F.col("_newest") - policy.recent_days * DAY_US).alias("n_recent"))
    n = n.selectExpr("n_rows", "CASE WHEN _events > 0 THEN _events ELSE _positive END AS n_positive_events", "n_recent")
    return ordered.with_scalar(n, reports.dataset_fingerprint(rows, ["symbol", "signal_time", "label_value"]).select("fingerprint"), "fingerprint")


def _row_at(rows: DataFrame, position: int):
    """(time, symbol) of the row at a position in the order of time and symbol; None beyond the end."""
    placed = ordered.with_position(rows.select("symbol", "signal_time", F.lit(1).alias("_one")), ["_one"], ["signal_time", "symbol"], "signal_time", span=ordered.DAY)
    return placed.where(F.col("_pos") == position).select(_time().alias("t"), "symbol").first()


def chronological_parts(rows: DataFrame, cutoff: int, policy: Policy = Policy()) -> DataFrame | None:
    """The rows with their ``part`` (train, validate, holdout) and ``weight``; None where too few come after the cutoff.

    The holdout begins with the time of the row in the middle of those after the cutoff, so rows of one time are never on both sides.
    """
    later = rows.where(_time() > cutoff)
    n_later = later.count()
    if n_later < policy.min_forward:
        return None
    holdout = _row_at(later, max(1, n_later // 2))["t"]
    before = rows.where(_time() < holdout)
    edge = _row_at(before, max(1, before.count() * 4 // 5))
    t, symbol = (edge["t"], edge["symbol"]) if edge else (holdout, "")
    first = (_time() < t) | ((_time() == t) & (F.col("symbol") < symbol))
    parts = rows.withColumn("part", F.when(_time() >= holdout, "holdout").when(first, "train").otherwise("validate"))
    # three rows at most
    newest = {r["part"]: r["t"] for r in parts.groupBy("part").agg(F.max(_time()).alias("t")).collect()}
    age = F.coalesce(*[F.when(F.col("part") == p, F.lit(at) - _time()) for p, at in newest.items()])
    return materialize(parts.withColumn("weight", F.when(age <= policy.recent_days * DAY_US, policy.recent_weight).otherwise(1.0)), "challenge")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All runs that were entered; none before the first."""
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LEDGER)


def challenge(rows: DataFrame, champion: Champion, ledger: str, policy: Policy = Policy(), force: bool = False) -> DataFrame:
    """One run as one row; a run that trained a challenger is entered in the ledger.

    ``status`` is ``not_ready`` (too few rows or events), ``skipped`` (the champion has met these very rows), ``blocked`` (an input is
    missing, too few rows come after the champion, or a part has one class), ``challenger_ready`` or ``gate_failed``. Rows without a label
    are left out; an empty table is ``not_ready``.
    """
    spark = rows.sparkSession
    rows = rows.where("label_value IN (0, 1) AND signal_time IS NOT NULL")
    ready = readiness(rows, policy).first()
    met = read_ledger(spark, ledger).where((F.col("champion") == champion.name) & F.col("status").isin(*TRAINED))
    last = met.agg(F.max_by(F.struct("fingerprint", "n_rows"), "run_at").alias("r")).first()["r"]
    n_new = max(0, ready["n_rows"] - (last["n_rows"] if last else 0))
    sizes: dict[str, int] = {}

    def run(status: str, reason: str | None, threshold: float | None = None, checks: list = ()) -> DataFrame:
        return spark.createDataFrame([(champion.name, status, reason, ready["fingerprint"], ready["n_rows"], ready["n_positive_events"], ready["n_recent"], n_new,
                                       *[sizes.get(p) for p in ("train", "validate", "holdout")], threshold, list(checks))], RUN)

    if ready["n_rows"] < policy.min_rows or ready["n_positive_events"] < policy.min_positive_events:
        return run("not_ready", "insufficient_materialized_outcomes")
    if not force and last and n_new < policy.min_new and last["fingerprint"] == ready["fingerprint"]:
        return run("skipped", "no_new_outcomes_since_last_run")
    if set(champion.columns) - set(rows.columns):
        return run("blocked", "champion_features_missing_from_dataset")
    parts = chronological_parts(rows, champion.cutoff, policy)
    if parts is None:
        return run("blocked", "no_sufficient_forward_historical_data")
    classes = {r["part"]: r for r in parts.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("label_value").alias("positive")).collect()}
    sizes.update({p: classes[p]["n"] if p in classes else 0 for p in ("train", "validate", "holdout")})
    if any(p not in classes or not 0 < classes[p]["positive"] < classes[p]["n"] for p in sizes):
        return run("blocked", "chronological_split_lacks_class_diversity")
    train, validate, holdout = (parts.where(F.col("part") == p) for p in ("train", "validate", "holdout"))
    models = ml.fit_concurrently({"threshold": train, "challenger": parts.where("part <> 'holdout'")}, {k: champion.columns for k in ("threshold", "challenger")},
                                 weight="weight", balanced=True)
    threshold = ml.pick_threshold(ml.score(models["threshold"], validate), policy.min_recall)
    sides = ml.evaluate(ml.score(champion.model, holdout), champion.threshold), ml.evaluate(ml.score(models["challenger"], holdout), threshold)
    gate = ml.promotion_gate(*sides, min_gain=policy.min_gain, max_recall_loss=policy.max_recall_loss, max_brier_loss=policy.max_brier_loss)
    checks = [(r["check"], r["actual"], r["passed"]) for r in gate.collect()]  # three rows
    passed = all(c[2] for c in checks)
    done = run(TRAINED[0] if passed else TRAINED[1], None if passed else ",".join(c[0] for c in checks if not c[2]), threshold, checks)
    done.select("champion", "fingerprint", "n_rows", "status", "reason", "threshold", "checks", F.current_timestamp().alias("run_at")).coalesce(1).write.mode("append").parquet(ledger)
    return done
