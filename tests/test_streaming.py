"""Streams over several files, with restarts and runs that find nothing new."""
from pyspark.sql import functions as F

from tidemark.operators.ordered import latest_per_key
from tidemark.streaming import jobs


def feed(spark, lo, hi):
    return spark.range(lo, hi).selectExpr("id % 37 AS k", "concat('g', id % 3) AS g", "id AS seq", "timestamp_seconds(1700000000 + id * 60) AS ts")


def merged(spark, path, root):
    return jobs.run_merge(jobs.landed(spark, path, files_per_batch=1), "m", ["k", "g"], ["ts", "seq"], root)


def test_merge_survives_restarts_and_idle_runs(spark, tmp_path):
    path, root = str(tmp_path / "in"), str(tmp_path / "out")
    done = 0
    for step in (200, 50, 300):
        feed(spark, done, done + step).repartition(2).write.mode("append").parquet(path)
        done += step
        got = merged(spark, path, root)
        want = latest_per_key(feed(spark, 0, done), ["k", "g"], ["ts", "seq"]).select(*got.columns)
        assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
        again = merged(spark, path, root)
        assert again.exceptAll(want).count() == 0 and want.exceptAll(again).count() == 0
    # a batch touches only the buckets of its keys
    versions = spark.read.parquet(f"{root}/table").groupBy("bucket").agg(F.count_distinct("version").alias("n"))
    feed(spark, done, done + 1).write.mode("append").parquet(path)
    before = {r["bucket"]: r["n"] for r in versions.collect()}
    merged(spark, path, root)
    after = {r["bucket"]: r["n"] for r in spark.read.parquet(f"{root}/table").groupBy("bucket").agg(F.count_distinct("version").alias("n")).collect()}
    assert sum(after[b] != before.get(b) for b in after) == 1


def test_bars_over_time_ordered_files_equal_one_batch(spark, tmp_path):
    path = str(tmp_path / "ticks")
    ticks = lambda lo, hi: spark.range(lo, hi).selectExpr("concat('S', id % 3) AS symbol", "timestamp_seconds(1700000000 + id * 97) AS ts", "CAST(id % 11 AS DOUBLE) AS px",
                                                          "CAST(id AS DECIMAL(20,8)) AS qty", "id AS seq")
    for lo in range(0, 600, 150):
        ticks(lo, lo + 150).coalesce(1).write.mode("append").parquet(path)
    schema = ["symbol", "open_time", "open", "high", "low", "close", "volume", "trade_count"]
    one = jobs.run_to_table(jobs.tumbling_bars(jobs.landed(spark, path)), "one").select(*schema)
    # files are written one after the other, so they are read in the order of time
    many = jobs.run_to_table(jobs.tumbling_bars(jobs.landed(spark, path, files_per_batch=1)), "many").select(*schema)
    assert one.count() > 30
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def landed_in_steps(spark, path, *steps):
    """A stream over one file a step; files are written one after the other, so they are read in this order."""
    for step in steps:
        step.coalesce(1).write.mode("append").parquet(path)
    return jobs.landed(spark, path, files_per_batch=1)


def at(minutes):
    return f"timestamp_seconds(1700000000 + 60 * ({minutes}))"


def test_gate_keeps_bars_without_a_timely_record(spark, tmp_path):
    bars = lambda lo, hi: spark.range(lo, hi).selectExpr("id AS bar_key", f"{at('id')} AS close_time")
    # every third bar has a record after 3 seconds, every third one after 9, the rest none
    side = lambda lo, hi: spark.range(lo, hi).where("id % 3 < 2").selectExpr("id AS bar_key", f"{at('id')} + make_interval(0, 0, 0, 0, 0, 0, 3 + 6 * (id % 3)) AS available_time", "id AS n")
    b = landed_in_steps(spark, str(tmp_path / "bars"), bars(0, 60), bars(60, 120), bars(5000, 5001))
    s = landed_in_steps(spark, str(tmp_path / "side"), side(0, 60), side(60, 120), side(5001, 5002))
    got = jobs.run_to_table(jobs.lateness_gate(b, s).selectExpr("b.bar_key", "s.n"), "gate_test").where("bar_key < 5000")
    assert sorted(map(tuple, got.collect())) == [(i, i if i % 3 == 0 else None) for i in range(120)]


def test_every_opening_is_due_once(spark, tmp_path):
    # two resolving rows for every even opening, one beyond the horizon for every odd one; nobody else shares the key
    opened = lambda lo, hi: spark.range(lo, hi).selectExpr("id AS who", f"{at('id * 10')} AS opened_at", "id AS open_id")
    solved = lambda lo, hi: spark.range(2 * lo, 2 * hi).selectExpr("id DIV 2 AS who", f"{at('(id DIV 2) * 10 + 30 + 5 * (id % 2) + 100 * (id DIV 2 % 2)')} AS resolved_at", "id AS resolve_id")
    a = landed_in_steps(spark, str(tmp_path / "a"), opened(0, 30), opened(30, 60), opened(5000, 5001))
    b = landed_in_steps(spark, str(tmp_path / "b"), solved(0, 30), solved(30, 60), solved(5000, 5001))
    got = jobs.run_to_table(jobs.outcome_due(a, b), "due_test").where("open_id < 5000")
    want = [(i, 2 * i, "resolved") if i % 2 == 0 else (i, None, "retry") for i in range(60)]
    assert sorted((r["open_id"], r["resolve_id"], r["status"]) for r in got.collect()) == want


def test_due_openings_are_checked_again_after_a_restart(spark, tmp_path):
    # user i opens at 10 i minutes; every third one resolves after 30 minutes, every third after 4.5 hours, the rest never
    after = lambda i: {0: 30, 1: 270}.get(i % 3)
    rows = [(i % 5 + 100 * (i + 1), i) for i in range(90)]
    opened = lambda lo, hi: spark.createDataFrame([(w, i) for w, i in rows[lo:hi]], "who long, id long").selectExpr("who", f"{at('id * 10')} AS ts", "id")
    solved = lambda lo, hi: spark.createDataFrame([(w, i, i * 10 + after(i)) for w, i in rows if after(i) and lo * 10 <= i * 10 + after(i) < hi * 10], "who long, id long, m long").selectExpr("who", f"{at('m')} AS ts", "id + 1000 AS id")
    end = lambda i: spark.createDataFrame([(-1, i)], "who long, id long").selectExpr("who", f"{at('id * 10')} AS ts", "id")
    a, b, root = str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "due")
    for step in range(4):
        lo, hi = step * 30, step * 30 + 30
        (opened(lo, hi) if step < 3 else end(119)).coalesce(1).write.mode("append").parquet(a)
        solved(lo, hi).coalesce(1).write.mode("append").parquet(b)
        got = jobs.outcomes_due(jobs.landed(spark, a), jobs.landed(spark, b), "due", checks=3, root=root)
    now = 119 * 10 - 60  # the watermark in minutes
    want = {}
    for _, i in rows:
        done = min(max(now - i * 10, 0) // 120, 3)
        needed = -(-after(i) // 120) if after(i) else None
        want[i] = (needed, i + 1000, "resolved") if needed and needed <= done else (done, None, "unresolved" if done == 3 else "retry" if done else "open")
    assert {r["open_id"]: (r["checks"], r["resolve_id"], r["status"]) for r in got.where("who > 0").collect()} == want
    assert {x[2] for x in want.values()} == {"resolved", "unresolved", "retry"}


def test_due_openings_of_a_crowded_key_without_a_call_per_row(spark, tmp_path):
    # all rows of one key: an opening a minute, a resolving row every five hours; openings without key or time stay open or unresolved
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    n, far = 2400, 300
    times = spark.range(n).selectExpr("CASE WHEN id = 5 THEN NULL ELSE 7 END AS who", f"CASE WHEN id <> 6 THEN {at('id')} END AS ts", "id")
    times.write.parquet(a)
    spark.range(1, n // far + 1).selectExpr("CASE WHEN id = 8 THEN NULL ELSE 7 END AS who", f"{at(f'id * {far}')} AS ts", "id + 10000 AS id").write.parquet(b)
    states = jobs.due_step(spark.read.parquet(a).selectExpr("'open' AS kind", "who", "id", "unix_micros(ts) AS us"), None, 7_200_000, 3)[1]
    assert states.where("kind = 'open'").count() <= 360 + 60, "only openings not yet decided are carried"
    got = {r["open_id"]: (r["checks"], r["resolve_id"], r["status"]) for r in jobs.outcomes_due(jobs.landed(spark, a), jobs.landed(spark, b), "due", checks=3).collect()}
    now, want = n - 60, {}
    for i in range(n):
        done = min(max(now - i, 0) // 120, 3) if i != 6 else 0
        needed, which = -(-(far - i % far) // 120), i // far + 1
        hit = i not in (5, 6) and which < 8 and needed <= done
        want[i] = (needed, which + 10000, "resolved") if hit else (done, None, "unresolved" if done == 3 else "retry" if done else "open")
    assert got == want
