"""SimHash groups against all pairs."""
import numpy as np
from xxhash import xxh64_intdigest

from tests.llm.helpers import by_id, documents, empty, odd_and_real
from tidemark.llm import simhash, vptree
from tidemark.llm.components import components


def plain_print(text):
    words = [w for w in (text or "").translate({c: c + 32 for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ")
             .replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    k = min(4, len(words))
    h = [xxh64_intdigest(" ".join(words[i:i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i
    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1:] ^ a[i]) <= radius) + i + 1:
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def test_groups_are_those_of_all_pairs(spark):
    texts = [t for t in odd_and_real() if t[0] is not None] + [(5000 + i, "the same words again and again in a row, copy") for i in range(40)]
    got = simhash.near_duplicates(documents(spark, texts, clash=["fp", "root", "component_id", "leaf"])).collect()
    assert len(got) == len(texts)
    prints = [plain_print(t) for _, t in texts]
    groups = plain_groups(prints, 4)
    want = {}
    for (d, _), p, g in zip(texts, prints, groups):
        want.setdefault(g, []).append((d, f"{p:016x}"))
    want = sorted((d, p, min(x for x, _ in group)) for group in want.values() for d, p in group)
    assert sorted(map(tuple, got)) == want


def test_one_of_each_group_stays(spark):
    text = " ".join(f"word{i}" for i in range(3000))
    near = text.replace("word1500 ", "other ")
    df = documents(spark, [(7, text), (3, near), (9, text), (9, text), (4, "quite another text of some words"), (4, "quite another text of some words"), (None, text), (11, None), (12, "")], clash=["fp"])
    kept = sorted((r["doc_id"] for r in simhash.one_of_each(df).collect()), key=repr)
    assert kept == sorted([3, 4, None, 11], key=repr)
    assert simhash.one_of_each(empty(spark)).count() == 0 and simhash.near_duplicates(empty(spark)).count() == 0


def clustered(rng, n):
    centres = rng.integers(0, 2**63, n // 20, dtype=np.uint64)
    prints = [centres]
    for c in centres[:: 3]:
        near = np.full(30, c)
        for _ in range(rng.integers(1, 5)):
            near = near ^ (np.uint64(1) << rng.integers(0, 64, 30, dtype=np.uint64))
        prints.append(near)
    dense = np.full(n // 4, centres[0])
    for _ in range(4):
        dense = dense ^ (np.uint64(1) << rng.integers(0, 64, n // 4, dtype=np.uint64))
    return np.unique(np.concatenate([*prints, dense, rng.integers(0, 2**63, n // 2, dtype=np.uint64)]))


def test_shards_and_trees_keep_every_component():
    rng = np.random.default_rng(5)
    prints = clustered(rng, 6000)
    tree = vptree.Shards(rng.choice(prints, 800, replace=False), 12, 4)
    assert tree.leaves > 6
    who, leaf, resident = tree.deal(prints)
    assert np.bincount(who[resident], minlength=len(prints)).tolist() == [1] * len(prints), "one home each"
    a, b = [], []
    for k in range(tree.leaves):
        at = leaf == k
        x, y = vptree.links(prints[who[at & resident]], prints[who[at & ~resident]], 4)
        a.append(np.searchsorted(prints, x))
        b.append(np.searchsorted(prints, y))
    got = vptree.roots(len(prints), np.concatenate(a), np.concatenate(b))
    assert got.tolist() == plain_groups(prints, 4)
    x, y = vptree.links(prints, prints[:0], 4)
    assert vptree.roots(len(prints), np.searchsorted(prints, x), np.searchsorted(prints, y)).tolist() == got.tolist()


def test_large_shards_meet_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(6)
    prints = clustered(rng, 1500)
    monkeypatch.setattr(simhash, "SHARD", 200)
    monkeypatch.setattr(simhash, "SHARD_VISITS", 300)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    found = by_id_pairs(components(simhash.near_edges(df)))
    groups = plain_groups(prints, 4)
    signed = prints.view(np.int64).tolist()
    want = {}
    for p, g in zip(signed, groups):
        want.setdefault(g, []).append(p)
    for group in want.values():
        assert len({found.get(p, p) for p in group}) == 1
        if len(group) == 1:
            assert group[0] not in found


def by_id_pairs(df):
    return {r["node"]: r["root"] for r in df.collect()}


def test_components_of_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(60)]
    star = [(1000, 1000 + i) for i in range(1, 200)]
    edges = spark.createDataFrame([(a, b) for a, b in path[::-1] + star + star[:5] + [(5000, 5000), (None, 3)]], "a long, b long")
    got = by_id_pairs(components(edges))
    assert got == {**{i: 0 for i in range(61)}, **{1000 + i: 1000 for i in range(200)}}


def test_any_number_of_large_shards_is_cut_into_blocks(spark):
    visits = spark.range(40_000).selectExpr("CAST(id % 4000 AS INT) AS leaf", "id * 7919 AS fp", "id % 3 > 0 AS resident")
    got = simhash.in_blocks(visits, {leaf: 2 + leaf % 3 for leaf in range(0, 4000, 2)})
    assert got.columns == ["leaf", "fp", "resident", "pair"]
    by_leaf = {}
    for r in got.collect():
        by_leaf.setdefault(r["leaf"], {}).setdefault(r["fp"], set()).add(r["pair"])
    for leaf, fps in by_leaf.items():
        n = 1 if leaf % 2 else 2 + leaf % 3
        assert len(fps) == 10 and all(len(p) == n for p in fps.values())
        # any two visits of a shard meet
        assert all(a & b for a in fps.values() for b in fps.values())
