"""Runs of a challenger: parts against a plain version, states, and the ledger."""
from datetime import datetime, timedelta

import pytest

from tidemark.operators import champion
from tidemark.sources.tables import shared_folder

START = datetime(2024, 1, 1)
COLUMNS = "symbol string, signal_time timestamp, label_value int, event_id string, x double"


def made(n=300):
    """Two symbols per time; a label follows the sign of its input but for every seventh row."""
    out = []
    for i in range(n):
        x = ((i * 37) % 101 - 50) / 50.0
        y = int((x > 0) != (i % 7 == 0))
        out.append((f"s{i % 2}", START + timedelta(hours=3 * (i // 2)), y, f"e{i // 5}" if y else None, x))
    return out


@pytest.fixture(scope="module")
def frozen(spark):
    return champion.freeze("v1", spark.createDataFrame(made()[:120], COLUMNS), ["x"])


def test_parts_and_weights_are_those_of_a_sorted_list(spark, frozen):
    rows = sorted(made(), key=lambda r: (r[1], r[0]))
    later = [r for r in rows if r[1] > rows[119][1]]
    hold = later[len(later) // 2][1]
    before = [r for r in rows if r[1] < hold]
    want = {r[:2]: "train" if i < len(before) * 4 // 5 else "validate" for i, r in enumerate(before)} | {r[:2]: "holdout" for r in rows if r[1] >= hold}
    newest = {p: max(k[1] for k, q in want.items() if q == p) for p in set(want.values())}
    got = champion.chronological_parts(spark.createDataFrame(made()[::-1], COLUMNS), frozen.cutoff).collect()
    assert {(r["symbol"], r["signal_time"]): r["part"] for r in got} == want and len(got) == len(rows)
    assert all(r["weight"] == (2.0 if newest[r["part"]] - r["signal_time"] <= timedelta(days=14) else 1.0) for r in got)


def test_a_second_run_does_nothing_and_new_rows_start_another(spark, frozen):
    ledger = shared_folder(spark, "ledger")
    rows = spark.createDataFrame(made(), COLUMNS)
    first = champion.challenge(rows, frozen, ledger).first()
    assert first["status"] in champion.TRAINED and len(first["checks"]) == 3
    assert (first["status"] == "challenger_ready") == all(c["passed"] for c in first["checks"])
    again = champion.challenge(rows.orderBy("x"), frozen, ledger).first()
    assert (again["status"], again["n_new"], again["checks"]) == ("skipped", 0, [])
    assert champion.read_ledger(spark, ledger).count() == 1
    more = champion.challenge(spark.createDataFrame(made(304), COLUMNS), frozen, ledger).first()
    assert more["status"] in champion.TRAINED and more["n_new"] == 4
    assert champion.read_ledger(spark, ledger).count() == 2


def test_states_without_a_run(spark, frozen):
    ledger = shared_folder(spark, "ledger")
    state = lambda rows, columns=COLUMNS: champion.challenge(spark.createDataFrame(rows, columns), frozen, ledger).first()
    assert state([]).status == "not_ready"
    assert state(made()[:150]).status == "not_ready"
    assert state([(*r[:4], r[4]) for r in made()], COLUMNS.replace("x double", "other double")).reason == "champion_features_missing_from_dataset"
    early = [(r[0], START - timedelta(days=90) + (r[1] - START), *r[2:]) for r in made()]
    assert state(early).reason == "no_sufficient_forward_historical_data"
    flat = [(*r[:2], 0 if i > 200 else r[2], r[3], r[4]) for i, r in enumerate(made())]
    assert state(flat).reason == "chronological_split_lacks_class_diversity"
    nulls = made()[:250] + [("s9", None, 1, None, 0.0), ("s9", START, None, None, 0.0), ("s9", START, 7, None, 0.0)]
    assert champion.readiness(spark.createDataFrame(nulls, COLUMNS).where("label_value IN (0, 1) AND signal_time IS NOT NULL")).first()["n_rows"] == 250
    assert champion.read_ledger(spark, ledger).count() == 0
