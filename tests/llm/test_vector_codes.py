"""Vector codes against plain rounds that compare everything."""
import hashlib
import math
import random

import numpy as np

from tests.llm.helpers import SMALL, rows
from tidemark.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(table, parts=16, entries=64, rounds=2):
    """Rows (vec_id, code, error, label_error, digest) by whole scans in Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v], g) for i, v, g in table if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = [[v[p * width:(p + 1) * width] for p in range(parts)] for _, v, _ in kept]
    first = sorted(range(len(kept)), key=lambda r: kept[r][0])[:entries]
    books = [[list(cut[r][p]) for r in first] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        at = [[nearest(p, c[p])[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, at) if a[p] == e]
                if mine:
                    books[p][e] = [sum(col) // len(mine) for col in zip(*mine)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out, sums = [], {}
    for (i, _, g), c in zip(kept, cut):
        near = [nearest(p, c[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in near), sum(d for d, _ in near), g))
        sums[g] = sums.get(g, 0) + out[-1][2]
    return sorted(((i, code, error, sums[g], sha) for i, code, error, g in out), key=repr)


def coded(spark, table, **columns):
    df = spark.createDataFrame(table, SCHEMA).selectExpr("*", "'x' AS code", "1 AS error", "2 AS x", "3 AS dist")
    return rows(vector_codes.digest(vector_codes.encode(df, **columns)))


def test_the_given_vectors(spark):
    df = spark.read.parquet(f"{SMALL}/embeddings.parquet")
    table = [tuple(r) for r in df.select("vec_id", "embedding", "label").collect()]
    assert rows(vector_codes.digest(vector_codes.encode(df))) == plain(table)


def test_ties_copies_and_odd_rows(spark):
    rng = random.Random(3)
    table = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.004, 0.5, 1.0, 300.0]) for _ in range(32)], rng.choice([1, 2, None])) for i in range(200, 0, -1)]
    table += [(1000 + i, table[0][1], 7) for i in range(150)]
    odd = [(0, None, 1), (-1, [None] * 32, 1), (-2, [float("nan")] * 32, 1), (-3, [1.0] * 31 + [float("inf")], None), (5000, table[3][1], None), (5000, table[3][1], None)]
    assert coded(spark, table + odd) == plain(table + odd)
    assert coded(spark, table[:9]) == plain(table[:9]), "fewer vectors than entries"


def test_vectors_that_cannot_be_coded(spark):
    good = [(i, [float(i % 5)] * 32, 1) for i in range(70)]
    odd = [(-5, [1.0] * 7, 1), (-4, [], 2), (100, [1.0] * 16, 2), (101, [1e30] * 32, 3), (None, [2.0] * 32, 1)]
    got = {r[0]: r for r in coded(spark, good + odd)}
    assert len(got) == 75 and all(got[i][1:4] == (None, None, None) for i in (-4, 100, 101))
    assert got[-5][1:3] == (None, None) and got[-5][3] == got[0][3] and got[None][1] is not None
    assert got[3][:4] == next(r for r in plain(good + [(10**9, [2.0] * 32, 1)]) if r[0] == 3)[:4]
    assert coded(spark, odd[:2])[0][1] is None
    assert coded(spark, []) == []


def test_active_entries_agree_with_whole_scans():
    rng = np.random.default_rng(5)
    for _ in range(200):
        x, books = rng.integers(-3, 4, (60, 2)), rng.integers(-3, 4, (9, 2))
        at, dist = vector_codes.full_scan(x, books)
        new = books.copy()
        shift = rng.random(9) < 0.4
        new[shift] += rng.integers(-1, 2, (int(shift.sum()), 2))
        got = vector_codes.active_scan(x, new, (new != books).any(axis=1), at, dist)
        want = vector_codes.full_scan(x, new)
        assert (got[0] == want[0]).all() and (got[1] == want[1]).all()
