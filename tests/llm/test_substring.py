"""Substring removal against a plain version, and the index against scanning."""
import hashlib

import numpy as np
import pytest

from tests.llm.helpers import documents, empty, odd_and_real
from tidemark.llm import common, fm_index, substring, words


def plain(texts):
    words = [(d, (t or "").encode().split()) for d, t in texts]
    least = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - 12):
                g = tuple(w[i:i + 13])
                least[g] = min(d, least.get(g, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - 12):
            if d is not None and least[tuple(w[i:i + 13])] < d:
                gone.update(range(i, i + 13))
        left = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(left)).hexdigest()))
    return sorted(out, key=repr)


def made():
    rng = np.random.default_rng(3)
    few = [f"w{i}" for i in range(6)]
    passage = " ".join(f"p{i}" for i in range(70))
    texts = [(7000 + i, " ".join(rng.choice(few, 60)) + " " + passage * (i % 3 == 0) + " " + " ".join(rng.choice(few, 30))) for i in range(120)]
    texts += [(7200, passage), (7201, passage), (7201, passage), (7202, passage + " x"), (7203, "y " + passage), (7204, " ".join(passage.split()[:13])),
              (7205, " ".join(passage.split()[:12])), (7206, passage + "\t\n" + passage), (6000, passage), (-5, passage.replace("p3 ", "q ")), (None, passage), (None, passage),
              (7300, " ".join(["same"] * 500)), (7301, " ".join(["same"] * 20)), (7302, ("z" * 700 + " ") * 20), (7303, ("z" * 700 + " ") * 20), (7201, "other text under an id that is taken " + passage)]
    return texts


@pytest.mark.parametrize("shard_bytes, frequent", [(6 << 20, 50), (2000, 3)])
def test_kept_words(spark, monkeypatch, shard_bytes, frequent):
    monkeypatch.setattr(substring, "SHARD_BYTES", shard_bytes)
    monkeypatch.setattr(substring, "FREQUENT_DOCS", frequent)
    monkeypatch.setattr(substring, "SLICE_BYTES", 5000)
    texts = odd_and_real() + made()
    got = sorted(map(tuple, substring.without_repeats(documents(spark, texts, clash=["shared", "spans", "anchor"])).collect()), key=repr)
    want = plain(texts)
    assert sum(w[2] for w in want) > 2000
    assert got == want
    assert substring.without_repeats(empty(spark)).count() == 0


def test_word_hashes_do_not_depend_on_the_place():
    import pyarrow as pa
    texts = ["alpha beta", "", None, "x" * 600 + " alpha\tbeta", "Ünï beta " + "y" * words.HASH_BLOCK + " alpha"]
    data, offsets = common.text_bytes(pa.array(texts))
    starts, ends, row = words.words_of(data, offsets)
    found = [data[a:b].tobytes() for a, b in zip(starts, ends)]
    assert found == [w for t in texts for w in (t or "").encode().split()]
    assert row.tolist() == [i for i, t in enumerate(texts) for _ in (t or "").encode().split()]
    hashes = words.hash_words(data, starts, ends)
    assert len({(w, h) for w, h in zip(found, hashes.tolist())}) == len(set(found)) == len(set(hashes.tolist()))


def test_backward_search_finds_every_place():
    rng = np.random.default_rng(1)
    text = np.append(rng.integers(1, 5, 3000), 0)
    index = fm_index.FMIndex(text, 9)
    for length in (1, 2, 5, 13):
        at = rng.integers(0, len(text) - length, 50)
        patterns = np.stack([text[a:a + length] for a in at] + [rng.integers(1, 9, length) for _ in range(20)])
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high):
            want = [i for i in range(len(text) - length + 1) if (text[i:i + length] == p).all()]
            assert sorted(index.order[a:max(a, b)].tolist()) == want
