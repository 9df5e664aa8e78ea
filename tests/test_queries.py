"""Queries against their SQL forms, on small made-up tables or the smallest given ones."""
import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check_oracle import TABLES, canonical  # noqa: E402

from tidemark.plans import q_lines, views  # noqa: E402
from tidemark.plans.catalog import QUERIES  # noqa: E402
from tidemark.plans.views import Views  # noqa: E402

SMALL, SOME = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def both(spark, name, folder=SMALL):
    """Rows of the query and of its SQL, as sorted text."""
    df = QUERIES[name](spark, folder)
    rows = canonical([tuple(r) for r in df.collect()], df.columns)
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    rel = db.execute(QUERIES[name].oracle)
    names = [d[0] for d in rel.description]
    return rows, canonical(rel.fetchall(), names)


@pytest.mark.parametrize("name", ["split_walk_forward", "split_audit", "split_event_safe", "sink_report_by_fold"])
def test_splits_follow_the_plan_of_their_sql(spark, name):
    got, want = both(spark, name, SOME)
    assert got == want and (want or name == "split_audit"), "a sound plan has nothing to report"


def test_a_report_without_rows_is_empty(spark):
    assert both(spark, "sink_report_by_fold") == ([], [])


@pytest.fixture(scope="module")
def calm(tmp_path_factory):
    """Thirty days of small moves with one fall per symbol in the middle: few positive events, none in the newest week."""
    folder = tmp_path_factory.mktemp("calm")
    duckdb.sql(f"""COPY (SELECT i AS event_id, TIMESTAMP '2024-01-01' + i * INTERVAL 6 MINUTE AS ts, i % 7 AS user_id, ['view', 'click', 'error', 'purchase', 'signup'][1 + i % 5] AS event_type,
      CASE WHEN i // 10 = 360 THEN 0 ELSE 200 + i * 37 % 11 END::DOUBLE AS value, '' AS props FROM range(7200) t(i)) TO '{folder}/events.parquet'""")
    return str(folder)


@pytest.mark.parametrize("name", ["agg_weekly_review", "ml_champion_readiness"])
def test_too_few_positive_events(spark, calm, name):
    got, want = both(spark, name, calm)
    assert got == want and len(got) == {"agg_weekly_review": 1, "ml_champion_readiness": 2}[name]
    assert name == "agg_weekly_review" or all("'not_ready'" in r for r in got)


def test_newest_lines_are_chosen_before_features_are_built(spark):
    """Whole days are kept, so more than asked for by less than a day's rows, and never a third of the table."""
    feed = q_lines.line_feed(Views(spark, SOME), last=500).groupBy("symbol").count().collect()
    days = q_lines.line_feed(Views(spark, SOME)).groupBy("symbol").count().collect()
    assert len(feed) == 3 and all(500 <= r["count"] < 700 for r in feed) and all(r["count"] > 15000 for r in days)
    got, want = both(spark, "feat_line_latest", SOME)
    assert got == want and len(got) == 3


def test_tasks_go_with_the_blocks_of_lines(spark, monkeypatch):
    v = Views(spark, SOME)
    assert q_lines.block_tasks(v) == 4, "no fewer than the session asks for"
    monkeypatch.setattr(q_lines.features, "BLOCK_ROWS", 2000)
    assert q_lines.block_tasks(v) == 16
    feed = q_lines.line_feed(v)
    few, many = (q_lines.features.build_features(feed, ("price",), block=2000, tasks=n) for n in (None, q_lines.block_tasks(v)))
    assert few.exceptAll(many).isEmpty() and many.count() == 60000


def test_daily_bars_are_dealt_by_the_number_of_lines(spark, monkeypatch):
    """Two shuffles with a sort each, no row copied per window, tasks by lines; the rows stay those of the SQL."""
    assert QUERIES["win_pump_daily"](spark, SOME).rdd.getNumPartitions() == 4, "no fewer than the session asks for"
    monkeypatch.setattr(views, "LINES_A_TASK", 2000)
    df = QUERIES["win_pump_daily"](spark, SOME)
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert df.rdd.getNumPartitions() == 31 and "Generate" not in plan and "Join" not in plan
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count(" Sort [") == 2
    got, want = both(spark, "win_pump_daily", SOME)
    assert got == want and got


def test_daily_bars_of_a_supplier_with_most_lines(spark, tmp_path, monkeypatch):
    """Three quarters of the lines are one supplier's, on 40 days; others rise twice alike, have one day only, or fall."""
    monkeypatch.setattr(views, "LINES_A_TASK", 500)
    duckdb.sql(f"""COPY (SELECT i AS l_orderkey, 1 + i % 3 AS l_linenumber, s AS l_suppkey, 1.0::DOUBLE AS l_quantity, 2000.0 + px AS l_extendedprice, TIMESTAMP '1996-12-10' + d * INTERVAL 1 DAY AS l_shipdate
      FROM (SELECT i, CASE WHEN i % 4 > 0 THEN 7 ELSE i % 80 // 8 END AS s, CASE WHEN i % 4 = 0 AND i % 80 // 8 = 1 THEN 5 ELSE i // 80 % 40 END AS d FROM range(6000) t(i)),
      LATERAL (SELECT CASE s WHEN 0 THEN 1000 * (d % 10 = 3)::INT WHEN 2 THEN -40 * d ELSE i * 37 % 1800 END::DOUBLE AS px)) TO '{tmp_path}/lineitem.parquet'""")
    assert duckdb.sql(f"SELECT count(*) FILTER (l_suppkey = 7) / count(*) FROM '{tmp_path}/lineitem.parquet'").fetchall()[0][0] >= 0.75
    got, want = both(spark, "win_pump_daily", str(tmp_path))
    assert got == want and len(got) > 2
