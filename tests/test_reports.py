"""Promotion gates of candidate filters."""
from tidemark.operators import reports

COLUMNS = "arm string, resolved long, positive_events long, evaluation_days long, precision_at_10 double, event_recall double, false_candidates_per_day double"


def gates(spark, champion, challenger, low=None):
    rows = spark.createDataFrame([("champion", *champion), ("challenger", *challenger)], COLUMNS)
    intervals = None if low is None else spark.createDataFrame([low], "precision_low double, recall_low double")
    return {r["reason"]: r["passed"] for r in reports.promotion_gates(rows, intervals).collect()}


def test_all_gates_pass_with_enough_data_and_intervals(spark):
    got = gates(spark, (300, 60, 20, 0.4, 0.85, 2.0), (300, 60, 20, 0.5, 0.84, 1.5), (0.01, -0.02))
    assert len(got) == 9 and all(got.values())


def test_each_guardrail_fails_on_its_own(spark):
    base = (300, 60, 20, 0.4, 0.85, 2.0)
    assert gates(spark, base, (300, 60, 20, 0.43, 0.84, 1.5), (0.01, -0.02))["precision_at_10_gate_failed"] is False
    assert gates(spark, base, (300, 60, 20, 0.5, 0.79, 1.5), (0.01, -0.02))["recall_guardrail_failed"] is False
    assert gates(spark, base, (300, 60, 20, 0.5, 0.79, 1.5), (0.01, -0.02))["minimum_event_recall_failed"] is False
    assert gates(spark, base, (300, 60, 20, 0.5, 0.84, 2.5), (0.01, -0.02))["false_candidate_guardrail_failed"] is False
    low = gates(spark, base, (300, 60, 20, 0.5, 0.84, 1.5), (0.0, -0.06))
    assert low["precision_ci_gate_failed"] is False and low["recall_ci_guardrail_failed"] is False


def test_nothing_is_decided_before_there_is_enough_data(spark):
    got = gates(spark, (300, 49, 20, 0.4, 0.85, 2.0), (300, 49, 20, 0.5, 0.84, 1.5), (0.01, -0.02))
    assert got["insufficient_positive_events"] is False and got["insufficient_resolved_outcomes"] is True
    assert all(got[k] is None for k in got if k.endswith("_failed"))
