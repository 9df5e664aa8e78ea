"""Mixing against a plain solver, and the pipeline's stages against their definitions."""
import numpy as np
import pytest

from tests.llm.helpers import SMALL, by_id, documents, empty
from tests.llm.test_counts import plain_contamination
from tests.llm.test_simhash import plain_groups, plain_print
from tidemark.llm import language, mixing, secrets


def members(spark, p, n):
    return spark.createDataFrame([(i, int(n[i]), [float(x) for x in p[i]]) for i in range(len(n))], "doc_id long, n_tokens long, p array<double>")


def plain_fit(p, n, target, ridge=mixing.RIDGE):
    """Projected gradient of the same objective, step by step over a table of rates."""
    w = n / n.sum()
    scale = np.maximum(w @ p, 1e-6)
    r = np.ones(len(n))
    for _ in range(20_000):
        r = np.maximum(0, r - (p @ (((w * r) @ p - target) / scale) + ridge * (r - 1)) / (1 + ridge))
    return r, (w * r) @ p


@pytest.mark.parametrize("sharp", [0.2, 1.0])
def test_rates_meet_the_targets(spark, sharp):
    rng = np.random.default_rng(4)
    z = rng.normal(size=(400, 3)) / sharp + [1.5, 0, -0.5]
    p = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    n = rng.integers(1, 2000, 400)
    target = np.array([0.5, 0.35, 0.15])
    mix = mixing.fit(members(spark, p, n), target, steps=200, tolerance=1e-7)
    r, reached = plain_fit(p, n, target)
    assert np.abs(mix.reached - target).max() < 5e-3 and np.abs(mix.reached - reached).max() < 2e-3
    got = mixing.rates(p, mix.gaps)[0]
    assert (got >= 0).all() and np.abs(got - r).max() < 0.05
    assert np.allclose(mix.natural, (n / n.sum()) @ p)


def test_targets_out_of_reach_are_met_as_closely_as_possible(spark):
    mix = mixing.fit(members(spark, np.array([[1.0, 0.0]] * 3), np.array([5, 0, 7])), np.array([0.5, 0.5]))
    assert abs(mix.reached[0] - 0.5) < 1e-2 and mix.reached[1] == 0


def test_classifier_and_rates_of_the_given_tables(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = mixing.mixture(docs, labels).join(mixing.domain(labels), "doc_id").toPandas()
    assert ((got[["p_good", "p_poor", "p_toxic"]].sum(axis=1) - 1).abs() < 1e-5).all() and (got["rate"] >= 0).all()
    assert (got[["p_good", "p_poor", "p_toxic"]].to_numpy().argmax(axis=1) == got["domain"]).mean() > 0.85
    mean = got.groupby("domain")["rate"].mean()
    assert mean[0] > 1 > mean[2]
    good = got[(got["domain"] == 0) & (got["p_good"] > 0.8)]
    assert (good["copies"] >= 1).mean() > 0.97, "clean documents stay"
    assert (got["copies"] - got["rate"]).abs().max() < 1


def test_odd_rows(spark):
    texts = [(i, "fine words of a good text here" if i % 2 else "bad junk junk bad junk") for i in range(40)] + [(50, None), (51, ""), (52, "fine words"), (52, "fine words"), (None, "junk")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(1, 0, None), (None, 1, 1), (3, 1, 0), (999, 1, 1)], "doc_id long, quality int, toxic int")
    df = documents(spark, texts, clash=["rate", "p", "domain"])
    got = mixing.mixture(df, labels)
    rows = got.collect()
    assert len(rows) == len(texts)
    one = by_id(got)
    assert one[50]["n_tokens"] == 0 and one[50]["rate"] == one[51]["rate"] and one[1]["p_good"] > 0.8 > one[0]["p_good"]
    kept = mixing.resample(df, labels)
    assert set(kept.columns) == {*df.columns, "copies"} and kept.where("copies < 1").count() == 0
    assert mixing.mixture(empty(spark), labels).count() == 0 and mixing.resample(empty(spark), labels).count() == 0
    none = labels.where("false")
    assert mixing.mixture(df, none).count() == len(texts)


def test_pipeline_stages_one_by_one(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    benchmark = [tuple(r) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").select("item_id", "text").collect()]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in now.collect()}
        out = stage(spark, now, SMALL).cache()
        after = {r["doc_id"]: r["text"] for r in out.collect()}
        assert set(after) <= set(before) and out.count() == len(after)
        if name != "mixture":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
        if name == "language":
            model = language.learn(now)
            assert set(after) == {d for d, t in before.items() if (lambda p: p[0] != "und" and p[1] >= language.MIN_SHARE)(model.predict(t))}
        elif name == "near_duplicates":
            ids = sorted(before)
            groups = plain_groups([plain_print(before[d]) for d in ids], 4)
            assert sorted(after) == [d for i, d in enumerate(ids) if groups[i] == i]
        elif name == "benchmarks":
            assert len(after) < len(before)
            gone = sorted(set(before) - set(after))
            assert all(plain_contamination(before[d], benchmark)[4] for d in gone[:3])
            assert not any(plain_contamination(before[d], benchmark[:8])[4] for d in sorted(after)[:20])
        elif name == "secrets":
            assert set(after) == set(before) and all((after[d] != before[d]) == bool(secrets.find_secrets(before[d])) for d in after)
            assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] is not None)
        else:
            assert out.where("copies < 1 or rate < 0").count() == 0 and len(after) > 0.8 * len(before)
        now = out
    final = {r["doc_id"] for r in corpus_pipeline.run(spark, SMALL).collect()}
    assert final == {r["doc_id"] for r in now.collect()}
