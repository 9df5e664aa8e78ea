"""Episode states, budgets, rankings and normalisation."""
import random
from datetime import datetime, timedelta
from types import SimpleNamespace

from pyspark.sql import functions as F

from tidemark.operators import candidates, scoring, selection
from tidemark.sources import envelopes
from tidemark.streaming import jobs

H = 3_600_000_000


def scan(t, close, pump=False, peak=120.0, top=None, ref_t=0):
    return SimpleNamespace(symbol="A", scan_t=t * H, close=close, direct_pump=pump, pump_score=1.5 if pump else 0.1, reference_price=100.0, reference_t=ref_t,
                           peak_price=peak, peak_t=t * H, buy_share=0.4, red_share=0.6, top_price=top)


def test_episode_starts_deepens_and_ends():
    e = candidates.Episode()
    assert not e.step(scan(0, 100.0))["selected"]
    a = e.step(scan(1, 119.0, pump=True))
    assert a["selected"] and a["stage"] == "PUMPING" and a["episode_id"]
    b = e.step(scan(2, 113.0, pump=True))
    assert b["stage"] == "DISTRIBUTING" and b["episode_id"] == a["episode_id"]
    c = e.step(scan(3, 119.0))
    assert c["stage"] == "DISTRIBUTING", "a stage never goes back within an episode"
    d = e.step(scan(4, 80.0))
    assert d["stage"] == "DUMPED" and not d["selected"]
    assert not e.step(scan(5, 90.0))["selected"]
    f = e.step(scan(6, 150.0, pump=True, peak=151.0, ref_t=5 * H))
    assert f["selected"] and f["stage"] == "PUMPING"


def test_memory_ends_after_its_window():
    e = candidates.Episode()
    e.step(scan(1, 119.0, pump=True))
    assert e.step(scan(72, 119.0))["selected"]
    assert not e.step(scan(80, 119.0))["selected"]


def test_stream_and_replay_agree(spark, tmp_path):
    rows = []
    for s in ("A", "B"):
        for t in range(30):
            x = scan(t, 100.0 + (t * 7) % 40, pump=t % 5 == 1, peak=110.0 + t)
            x.symbol = s
            rows.append(tuple(getattr(x, f) for f in candidates.EPISODE_IN))
    schema = ("symbol string, scan_t bigint, close double, direct_pump boolean, pump_score double, reference_price double, reference_t bigint, "
              "peak_price double, peak_t bigint, buy_share double, red_share double, top_price double")
    df = spark.createDataFrame(rows, schema)
    df.write.parquet(str(tmp_path / "scans"))
    streamed = jobs.run_to_table(jobs.episode_stream(jobs.landed(spark, str(tmp_path / "scans"))), "episodes")
    replayed = candidates.replay_episodes(df)
    assert replayed.count() == 60
    assert streamed.exceptAll(replayed).count() == 0 and replayed.exceptAll(streamed).count() == 0


def test_cooldown_marks():
    m = 60_000_000
    assert jobs.cooldown_marks([0, 30 * m, 61 * m, 100 * m], None, 60)[0] == [True, False, True, False]


def test_daily_cap(spark):
    rows = [(f"S{i % 12}", i, i * 600_000_000) for i in range(300)]
    got = {r["seq"]: r["sent"] for r in jobs.daily_cap(spark.createDataFrame(rows, "symbol string, seq int, t bigint")).collect()}
    want, own, every = {}, {}, {}
    for symbol, seq, t in rows:
        day = t // 86_400_000_000
        own[symbol, day] = own.get((symbol, day), 0) + 1
        if own[symbol, day] <= 2:
            every[day] = every.get(day, 0) + 1
        want[seq] = own[symbol, day] <= 2 and every[day] <= 15
    assert got == want


def test_candidate_rules(spark):
    cols = ("symbol string, price_ret_24h double, distance_from_high_24h double, momentum_deceleration_4h double, funding_zscore_30d double, "
            "oi_change_24h double, total_score double, quality_status string, data_quality_score double")
    df = spark.createDataFrame([("A", .2, -.01, 0., 3., 0., 50., "valid", 1.), ("B", 0., -.5, 0., 0., 0., 10., "valid", 1.)], cols)
    out = {r["symbol"]: r for r in candidates.candidate_rules(df).collect()}
    assert out["A"]["passed"] and not out["B"]["passed"] and "candidate_rejected" in out["B"]["reason_codes"]


def test_append_is_idempotent(spark):
    new = spark.createDataFrame([("A", 1, 5), ("A", 1, 3), ("B", 1, 1)], "k string, h int, at int")
    first = selection.new_rows(new, new.limit(0), ["k", "h"], ["at"])
    assert sorted(map(tuple, first.collect())) == [("A", 1, 3), ("B", 1, 1)]
    assert selection.new_rows(new, first, ["k", "h"], ["at"]).count() == 0


def test_policy_order(spark):
    df = spark.createDataFrame([("high_confidence", "valid", 0.9, 0.5, True, 0, 0), ("high_confidence", "valid", 0.9, 0.5, False, 0, 0)],
                               "tier string, quality_status string, probability double, threshold double, in_cooldown boolean, global_count int, coin_count int")
    assert [r["policy_reason"] for r in scoring.alert_policy(df).collect()] == ["cooldown_active", "policy_pass"]
    assert {r["policy_reason"] for r in scoring.alert_policy(df, mode="research").collect()} == {"mode_no_action_alerts"}
    assert {r["policy_reason"] for r in scoring.alert_policy(df, kill_switch=True).collect()} == {"kill_switch_active"}


def test_pages_are_typed_and_rejected(spark):
    page = lambda payload: ("r", "q", "p", "u", "e", '{"symbol":"ETHUSDT"}', "", "2024-01-01T00:00:00Z", 200, "", "v", "c", payload)
    bars = spark.createDataFrame([page('[[1704067200000,"1.5","2","1","1.7","10",1704067499999,"17",3,"4","6.8"]]')], envelopes.ENVELOPE)
    row = envelopes.normalize_bars(bars).first()
    assert row["symbol"] == "ETHUSDT" and row["interval"] == "5m" and float(row["close"]) == 1.7
    assert row["available_time"] - row["close_time"] == timedelta(seconds=1)
    pos = spark.createDataFrame([page('[{"timestamp":1704067200000,"longPosition":"0.6","shortPosition":"0.4"},{"timestamp":1704067200000,"longPosition":"0.6","shortPosition":"0"}]')],
                                envelopes.ENVELOPE)
    good, bad = envelopes.normalize_top_position(pos)
    assert float(good.first()["long_short_ratio"]) == 1.5 and bad.count() == 1


def test_run_up_counts_lows_for_later_bars_only(spark):
    t = datetime(2024, 1, 1)
    rows = [("A", t + timedelta(hours=i), t + timedelta(hours=i + 1), o, h, l, c) for i, (o, h, l, c) in enumerate(
        [(100., 101., 99., 100.), (100., 150., 50., 100.), (100., 110., 95., 100.)])]
    df = spark.createDataFrame(rows, "symbol string, open_time timestamp, close_time timestamp, open double, high double, low double, close double")
    got = [r["ret_24"] for r in candidates.run_ups(df).orderBy("scan_time").collect()]
    assert [round(x, 6) for x in got] == [round(x, 6) for x in (0.01, 150 / 99 - 1, 110 / 50 - 1)]


def test_universe_forces_an_eligible_benchmark(spark):
    rows = [(f"C{i:02d}USDT", 1e9 - i * 1e6, float(i % 7)) for i in range(30)] + [("BTCUSDT", 1.0, 0.0)]
    eligible = spark.createDataFrame(rows, "symbol string, quote_volume double, change_pct double")
    pinned = spark.createDataFrame([("c29usdt", 1)], "symbol string, position int")
    got = [r["symbol"] for r in selection.comparison_universe(eligible, pinned, 10).collect()]
    without = [r["symbol"] for r in selection.comparison_universe(eligible.where("symbol <> 'BTCUSDT'"), pinned, 10).collect()]
    assert len(got) == len(without) == 10 and "BTCUSDT" in got and "C29USDT" in got
    assert len(set(without) - set(got)) == 1 and len(set(got) - set(without)) == 1
    volume = spark.createDataFrame([("BTCUSDT", 9e12, 50.0)], eligible.schema).unionByName(eligible.where("symbol <> 'BTCUSDT'"))
    assert sorted(r["symbol"] for r in selection.comparison_universe(volume, pinned, 10).collect()).count("BTCUSDT") == 1


def test_pump_windows_by_brute_force(spark):
    """Ties, gaps between days, days without a high or an open, symbols of one day, rows in any order."""
    rng = random.Random(5)
    rows = [(s, datetime(2024, 1, 1) + timedelta(days=t), *(rng.choice([None, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0]) if rng.random() < 0.9 else float(rng.randint(1, 40)) for _ in range(2)), float(t), t * 10.0)
            for s, n in [("A", 400), *((f"S{i}", 1 + i % 9) for i in range(60))] for t in sorted(rng.sample(range(900), n))]
    rng.shuffle(rows)
    want = {}
    for s in {r[0] for r in rows}:
        d, found = sorted(r for r in rows if r[0] == s), []
        for a, k in ((a, k) for a in range(len(d)) for k in range(1, 6) if a + k < len(d)):
            top = max((r[3] for r in d[a:a + k + 1] if r[3] is not None), default=None)
            if top is not None and d[a][2] and top / d[a][2] - 1 > 0:
                found.append((-(top / d[a][2] - 1), a, k, top))
        if found:
            pct, _, k, top = min(found)
            want[s] = (-pct, k, top, d[-1][4], d[-1][5])
    daily = spark.createDataFrame(rows, "symbol string, feature_time timestamp, open double, high double, close double, quote_volume double")
    got = candidates.pump_windows(daily).collect()
    assert {r.symbol: (r.pump_pct, r.pump_days, r.peak_price, r.close, r.quote_volume) for r in got} == want and len(got) == len(want) > 20
