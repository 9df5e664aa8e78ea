"""Serial decisions run in blocks against plain serial loops, in batch and over files with restarts."""
import random

import pytest

from tests.test_candidates import scan
from tidemark.operators import candidates, speculative
from tidemark.operators.speculative import BUDGET_STATE, COOLDOWN_STATE, budget_machine, cooldown_machine, speculative_scan
from tidemark.streaming import jobs

M = 60_000_000
DAY = 1440 * M


def plain_cooldown(rows, gap):
    last, out = {}, {}
    for name, seq, t in sorted(rows, key=lambda r: (r[2], r[1])):
        go = name not in last or t - last[name] > gap
        out[name, seq] = go
        if go:
            last[name] = t
    return out


def plain_budget(rows, gap=60 * M, total=15, each=2):
    sends, out = [], {}
    for name, seq, t in sorted(rows, key=lambda r: (r[2], r[0], r[1])):
        live = [(x, n) for x, n in sends if x >= t - DAY]
        own = [x for x, n in live if n == name]
        go = not any(t - x <= gap for x in own) and len(live) < total and len(own) < each
        out[name, seq] = go
        if go:
            sends.append((t, name))
    return out


def made(n, names, seed=1, step=20):
    """A third of the rows are of one name."""
    rng, t, out = random.Random(seed), 0, []
    for i in range(n):
        t += rng.randint(0, step) * M
        out.append(("hot" if rng.random() < 0.34 else f"n{rng.randrange(names)}", i, t))
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "name string, seq long, t long")


def marks(df):
    return {(r["name"], r["seq"]): r["sent"] for r in df.collect()}


def test_cooldown_in_blocks(spark, block_rows=64):
    rows = made(2000, 30) + [(None, 5000 + i, i * 45 * M) for i in range(20)]
    out, last, rounds = speculative_scan(frame(spark, rows), ["name"], ["t", "seq"], cooldown_machine(60 * M), COOLDOWN_STATE, "sent: boolean", block_rows=block_rows)
    want = plain_cooldown(rows, 60 * M)
    assert marks(out) == want
    assert {r["name"]: r["_state"]["last"] for r in last.collect()} == {n: max(t for m, s, t in rows if m == n and want[n, s]) for n in {r[0] for r in rows}}
    assert rounds <= 6, "chains from different starts meet soon"


def test_rolling_budget_in_blocks(spark, block_rows=128):
    rows = made(1000, 40)
    out, last, rounds = speculative_scan(frame(spark, rows), [], ["t", "name", "seq"], budget_machine("name", gap=60 * M, window=DAY, total=15, each=2), BUDGET_STATE,
                                         "sent: boolean, reason: string", block_rows=block_rows)
    want = plain_budget(rows)
    assert marks(out) == want and sum(want.values()) > 100
    assert len(last.first()["_state"]["queue"]) <= 15
    reasons = {r["reason"] for r in out.select("reason").distinct().collect()}
    assert reasons == {"sent", "cooldown", "global_limit", "own_limit"}


def test_nothing_and_nothing_new(spark):
    machine = budget_machine("name", gap=60 * M, window=DAY, total=15, each=2)
    none = frame(spark, [])
    out, last, rounds = speculative_scan(none, [], ["t", "name", "seq"], machine, BUDGET_STATE, "sent: boolean, reason: string")
    assert out.count() == 0 and last.count() == 0 and rounds == 0
    kept = spark.createDataFrame([("a", (5,))], f"name string, _state {COOLDOWN_STATE}")
    out, last, _ = speculative_scan(none, ["name"], ["t", "seq"], cooldown_machine(M), COOLDOWN_STATE, "sent: boolean", kept)
    assert out.count() == 0 and [tuple(r) for r in last.collect()] == [("a", (5,))]
    state = spark.createDataFrame([(([(0, "a")],),)], f"_state {BUDGET_STATE}")
    out, last, _ = speculative_scan(frame(spark, [("a", 1, 60 * M), ("a", 2, 61 * M)]), [], ["t", "name", "seq"], machine, BUDGET_STATE, "sent: boolean, reason: string", state)
    assert [r["reason"] for r in out.orderBy("seq").collect()] == ["cooldown", "sent"] and last.count() == 1
    out, last, _ = speculative_scan(none, [], ["t", "name", "seq"], machine, BUDGET_STATE, "sent: boolean, reason: string", state)
    assert last.count() == 1
    assert speculative_scan(frame(spark, [("a", 1, None)]), [], ["t", "name", "seq"], machine, BUDGET_STATE, "sent: boolean, reason: string")[0].first()["reason"] == "no_time"


@pytest.mark.parametrize("job", ["cooldown", "budget"])
def test_streams_over_files_with_a_restart(spark, tmp_path, job):
    rows, path, root = made(900, 25, seed=4), str(tmp_path / "in"), str(tmp_path / "out")
    want = plain_cooldown(rows, 60 * M) if job == "cooldown" else plain_budget(rows)

    def run():
        stream = jobs.landed(spark, path, files_per_batch=1)
        return jobs.cooldown_run(stream, ["name"], job, root=root, block_rows=128) if job == "cooldown" else jobs.budget_run(stream, job, who="name", root=root, block_rows=128)

    for at in (0, 300, 600):
        # two files before the first run, one before each other, the last without rows
        frame(spark, rows[at:at + 300]).coalesce(1).write.mode("append").parquet(path)
        if at == 300:
            assert marks(run()) == {k: x for k, x in want.items() if k[1] < 600}
    frame(spark, []).coalesce(1).write.mode("append").parquet(path)
    assert marks(run()) == want
    assert marks(run()) == want, "a run that finds nothing new"


def scans(n, names=("A", "B")):
    out = []
    for s in names:
        for t in range(n):
            # bursts of pumps, then quiet stretches longer than the memory, dumps in some
            x = scan(t, 100.0 + (t * 7) % 40 if t % 200 < 150 else 60.0, pump=t % 200 in (3, 9, 40), peak=110.0 + t % 37, ref_t=t)
            x.symbol = s
            out.append(x)
    return out


def test_episodes_over_files_equal_the_plain_state(spark, tmp_path):
    every, path, root = scans(480), str(tmp_path / "in"), str(tmp_path / "out")
    want = {}
    for s in ("A", "B"):
        e = candidates.Episode()
        for x in every:
            if x.symbol == s:
                d = e.step(x)
                want[s, x.scan_t] = (d["stage"], d["selected"], d["episode_id"], d["peak_price"], d["evidence"])
    schema = ("symbol string, scan_t bigint, close double, direct_pump boolean, pump_score double, reference_price double, reference_t bigint, "
              "peak_price double, peak_t bigint, buy_share double, red_share double, top_price double")
    rows = lambda lo, hi: spark.createDataFrame([tuple(getattr(x, f) for f in candidates.EPISODE_IN) for x in every if lo * scan(1, 1.0).scan_t <= x.scan_t < hi * scan(1, 1.0).scan_t], schema)
    seen = lambda df: {(r["symbol"], r["scan_t"]): (r["stage"], r["selected"], r["episode_id"], r["peak_price"], r["evidence"]) for r in df.collect()}
    assert seen(candidates.replay_episodes(rows(0, 480), block_rows=64)) == want
    for lo in range(0, 480, 120):
        rows(lo, lo + 120).coalesce(1).write.mode("append").parquet(path)
        done = jobs.episode_run(jobs.landed(spark, path), "episodes", root, block_rows=64)
    assert seen(done) == want and len({v[2] for v in want.values()}) > 3


def test_an_exhausted_cap_costs_a_round_per_chain_not_per_block(spark, monkeypatch):
    # thirty hours of a row every 40 seconds: each state hangs on all before it, and no block forgets
    monkeypatch.setattr(speculative, "CHAINS", 4)
    rows = [(f"n{i * 7 % 40}", i, i * 2 * M // 3) for i in range(2700)]
    out, last, rounds = speculative_scan(frame(spark, rows), [], ["t", "name", "seq"], budget_machine("name", gap=60 * M, window=DAY, total=15, each=2), BUDGET_STATE,
                                         "sent: boolean, reason: string", block_rows=64)
    want = plain_budget(rows)
    assert marks(out) == want and sum(want.values()) > 15
    assert rounds <= 4
