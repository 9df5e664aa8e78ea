"""Quality counts, contamination, token counts and language against plain versions."""
import hashlib
import re

import numpy as np
import pytest

from tests.llm.helpers import SMALL, by_id, documents, empty, odd_and_real
from tidemark.llm import decontaminate, language, quality, tokens


def plain_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    hit = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)}
    n, r = len(words), len(hit)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(x in lines[:i] for i, x in enumerate(lines)), r,
            n < 10 or 100 * r > 20 * n)


def test_quality_counts(spark):
    texts = [t for t in odd_and_real() if t[0] not in (903, None)] + [(3000, "a b c d e f " * 5), (3001, "x y\nx y\n \n \nz#|")]
    got = by_id(quality.digest(quality.quality(documents(spark, texts, clash=["kept", "failed", "n_docs"]))))
    for d, t in texts:
        want = plain_quality(t)
        assert tuple(got[d])[1:7] == want, d
        assert not (want[5] and got[d]["kept"])
    assert quality.quality(empty(spark)).count() == 0


def test_host_verdicts_shrink_small_hosts(spark):
    good = " ".join(f"w{i}" for i in range(40))
    soft = " ".join(f"w{i}#|#" for i in range(40))
    texts, hosts = [], []
    for i in range(120):
        texts.append((i, soft if i % 3 == 0 and i < 60 or i >= 100 else good))
        hosts.append("mixed" if i < 60 else "clean" if i < 100 else "bad")
    texts += [(500, soft), (501, good), (502, soft)]
    hosts += ["tiny", None, None]
    got = by_id(quality.quality(documents(spark, texts, source=hosts)))
    assert all(not got[i]["kept"] for i in range(100, 120)), "documents of a bad host that fail go"
    assert all(got[i]["kept"] for i in range(100)), "failing softly alone is no reason"
    assert got[500]["host_rate"] < 1 and got[501]["kept"] and got[501]["n_docs"] == 2
    rates = {r["source"]: r["host_rate"] for r in got.values()}
    assert rates["clean"] < rates["mixed"] < rates["bad"]


def plain_windows(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return words


def plain_contamination(text, items):
    words = plain_windows(text)
    hit, found = set(), set()
    for item, t in items:
        w = plain_windows(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            for j in range(len(words) - n + 1):
                if words[j:j + n] == w[i:i + n]:
                    hit.update(range(j, j + n))
                    found.add(str(item))
    return len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("max_bytes", [4 << 20, 300])
def test_contamination(spark, max_bytes):
    items = [(0, "One two, three FOUR five six seven eight nine ten eleven twelve"), (1, "short item"), (2, None), (3, ""), (10, "Été déjà vu"), (1, "short item")]
    texts = [(1, "x one two three four five six seven eight nine ten, y"), (2, "ONE two three four five six seven eight nine ten eleven twelve short-item SHORT item"),
             (3, "one two three four five six seven eight nine"), (4, None), (5, ""), (6, "short  item short item shortitem item"), (7, "été DÉJà vu; Été déjà vu"), (8, "short item")]
    table = spark.createDataFrame(items, "item_id long, text string")
    df = documents(spark, texts + [(8, "short item")], clash=["items", "spans"])
    found = decontaminate.contamination(df, table, max_bytes=max_bytes)
    got = decontaminate.digest(found).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        assert tuple(r)[1:] == plain_contamination(dict(texts)[r["doc_id"]], items), r
    span = by_id(found)[2]["spans"][0]
    assert texts[1][1][span["start"]:span["end"]].endswith("SHORT item")
    kept = {r["doc_id"] for r in decontaminate.clean_rows(df, table, max_bytes=max_bytes).collect()}
    assert kept == {3, 4, 5, 7} - {d for d, t in texts if plain_contamination(t, items)[4]}
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.digest(decontaminate.contamination(df, none)).where("contaminated").count() == 0


def test_contamination_of_the_given_tables(spark):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    got = decontaminate.digest(decontaminate.contamination(docs, items)).where("contaminated").collect()
    assert got
    texts, bench = dict(map(tuple, docs.select("doc_id", "text").collect())), [tuple(r) for r in items.select("item_id", "text").collect()]
    for r in got[:4]:
        assert tuple(r)[1:] == plain_contamination(texts[r["doc_id"]], bench)


def test_token_counts_are_the_library_s(spark):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=tokens.model_path("piece_bpe_32k.model"))
    made = ["  two  blanks ", "\n\n", "▁marks▁ ▁▁", "<s> </s> <unk> <0x0A>", "a" * 3000, "日本語 テキスト 😀", "\x00 ​", " ", "    " * 9, "x\ty"]
    texts = [t for t in odd_and_real() if t[0] not in (903, None)] + [(4000 + i, t) for i, t in enumerate(made)]
    got = by_id(tokens.count_tokens(documents(spark, texts, clash=["n_tokens"])))
    for d, t in texts:
        n = len(model.encode(t or ""))
        assert tuple(got[d])[1:] == (len((t or "").encode()), n, n > 4096), (d, (t or "")[:40])
    assert tokens.count_tokens(empty(spark)).count() == 0


def test_merges_of_a_small_table():
    count = tokens.MergeCounter({"a": 0, "b": 0, "▁": 0, "ab": 1, "aba": 2, "▁ab": 3})
    assert count("abab") == 2 and count("") == 0 and count(None) == 0
    assert count("é") == 1 + 2, "a character that is no piece counts its bytes"


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(got) > 200 and (got["lang"] == got["lang_pred"]).mean() > 0.95
    assert got["score"].between(0, 1).all()


def test_language_of_odd_rows(spark):
    texts = [(i, t) for i, t in enumerate(["the house and the garden of the king"] * 12 + ["der hund und die katze auf dem dach"] * 12)]
    langs = ["en"] * 12 + ["de"] * 12 + [None] * 6
    odd = [(100, None), (101, ""), (102, "123 !! 456"), (103, "the garden and the house of the king. der hund und die katze auf dem dach, und noch mehr von dem hund"), (104, "I"), (None, "the king")]
    df = documents(spark, texts + odd, lang=langs, clash=["score"])
    got = by_id(language.identify(df))
    assert [tuple(got[i])[2:] for i in (100, 101, 102)] == [("und", 0.0)] * 3
    assert got[0]["lang_pred"] == "en" and got[13]["lang_pred"] == "de" and got[104]["lang_pred"] in ("en", "de") and got[None]["lang_pred"] == "en"
    assert got[None]["held_out"] is False
    kept = {r["doc_id"] for r in language.known_language(df).collect()}
    assert not kept & {100, 101, 102} and {0, 13} <= kept
    assert language.identify(empty(spark)).count() == 0


def test_mixture_shares():
    rng = np.random.default_rng(0)
    en = [" ".join(rng.choice("the of and house garden king with from that this".split(), 60)) for _ in range(10)]
    de = [" ".join(rng.choice("der die und hund katze dach mit von dass dieser".split(), 60)) for _ in range(10)]
    table = np.stack([sum(map(language.trigram_counts, x)) + 0.5 for x in (de, en)], axis=1)
    model = language.Model(["de", "en"], (table / table.sum(axis=0)).astype(np.float32))
    assert model.predict(en[0]) == ("en", 1.0)
    chosen, share = model.mix(en[0] + " " + en[1] + " " + de[0])
    assert len(chosen) == 2 and 0.5 < share[1] < 0.85


def plain_shares(n, p, start, rounds=3000):
    share = list(start)
    for _ in range(rounds):
        new = [0.0] * len(share)
        for c, row in zip(n, p):
            all_ = sum(s * x for s, x in zip(share, row))
            for k, x in enumerate(row):
                new[k] += c * share[k] * x / all_
        total = sum(new)
        share = [x / total for x in new]
    return share


def test_a_second_language_among_many_relatives():
    """Ten languages are alike and one is not: it's found although each relative fits the mixed text better alone."""
    rng = np.random.default_rng(7)
    alphabets = ["abcdefghijkl", "mnopqrstuvwxyz"]
    stems = [["".join(rng.choice(list(a), 4)) for _ in range(40)] for a in alphabets]
    # relatives share most of their words with the first
    vocab = [stems[0][:34] + ["".join(rng.choice(list(alphabets[0]), 4)) for _ in range(6)] for _ in range(10)] + [stems[1]]
    text = lambda k, n: " ".join(rng.choice(vocab[k], n))
    table = np.stack([language.trigram_counts(text(k, 4000)) + 0.5 for k in range(11)], axis=1)
    model = language.Model([f"l{k:02d}" for k in range(11)], (table / table.sum(axis=0)).astype(np.float32))
    mixed = text(0, 300) + " " + text(10, 200)
    chosen, share = model.mix(mixed)
    got = dict(zip(chosen, share))
    assert 10 in got and abs(got[10] - 0.4) < 0.05 and model.predict(mixed)[0] != "l10"
    counts = language.trigram_counts(mixed)
    seen = np.flatnonzero(counts)
    alone = counts[seen] @ np.log(model.table[seen])
    assert (alone > alone[10]).sum() >= 8, "the case must be one where the second language ranks low alone"
    want = plain_shares(counts[seen].tolist(), model.table[seen][:, chosen].tolist(), [1 / len(chosen)] * len(chosen))
    assert np.abs(np.array(want) - share).max() < 0.02
