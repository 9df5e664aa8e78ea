"""License scan against a plain version of the base phrases, and rules on sample sentences."""
import re
import time

from tests.llm.helpers import by_id, documents, empty, odd_and_real
from tidemark.llm import licenses

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def plain(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    places = sorted((i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i:i + len(p.split())] == p.split())
    return (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({x for _, x in places})))


SENTENCES = ["Released under the MIT License. Under the\nMIT license!", "Apache-License, Version 2.0; apache license version 2 apache license version 2", "CC BY-NC cc by nc 4.0 CC-BY-NC",
             "xunder the mit license", "under the mit licenses", "under the mit licenſe", "UNDER THE MIT LICENSEé", "cc by ncx cc by"]


def test_base_columns(spark):
    texts = [t for t in odd_and_real() if t[0] not in (903, None)] + [(6000 + i, t) for i, t in enumerate(SENTENCES)] + [(6100, "under the mit license " * 900)]
    got = by_id(licenses.digest(licenses.scan(documents(spark, texts, clash=["line", "hits", "kept", "base"]))))
    assert len(got) == len(texts)
    for d, t in texts:
        assert tuple(got[d])[1:6] == plain(t), (d, (t or "")[:50])
        assert set(filter(None, got[d]["base_labels"].split(","))) <= set(got[d]["labels"].split(","))
        assert 0 <= got[d]["score"] <= 1
    assert licenses.scan(empty(spark)).count() == 0


def test_rules_and_suppression(spark):
    cases = {
        1: ("This program is licensed under the GNU General Public License version 2 or any later version.", "gpl-2-or-later"),
        2: ("SPDX-License-Identifier: GPL-3.0-only", "gpl-3"),
        3: ("GNU Lesser General Public License v2.1", "lgpl-2.1"),
        4: ("Creative Commons Attribution-ShareAlike 4.0 International licence text, copyright", "cc-by-sa-4.0"),
        5: ("Permission is hereby granted, free of charge, to any person obtaining a copy", "mit"),
        6: ("Copyright (c) 2020 Somebody. All rights reserved.", "all-rights-reserved,copyright-notice"),
        7: ("Mozilla Public License 2.0", "mozilla-2"),
        8: ("no word of it here", ""),
        9: ("3-clause BSD license", "bsd-3"),
    }
    df = documents(spark, [(k, t) for k, (t, _) in cases.items()])
    got = by_id(licenses.digest(licenses.scan(df)))
    assert {k: got[k]["labels"] for k in cases} == {k: want for k, (_, want) in cases.items()}
    assert got[8]["score"] == 0.0 and got[1]["score"] == 1.0


def test_rules_are_many_and_their_keywords_hold():
    every = list(licenses.rules())
    assert len(every) > 300
    assert all(r["keyword"] in r["pattern"] for r in every)


def test_rules_find_texts_without_any_other_license_word(spark):
    cases = {"available under Apache 2.0": "apache-2", "Apache 2.0": "apache-2", "MPL 2.0": "mozilla-2", "EPL 2.0": "eclipse-2", "CDDL 1.0": "cddl-1.0", "EUPL 1.2": "eupl-1.2",
             "GFDL 1.3": "gfdl-1.3", "ODbL 1.0": "odbl-1.0", "WTFPL": "", "WTFPL 2": "wtfpl-2", "cc0": "cc0", "GPL 3": "gpl-3", "CC-BY-SA 4.0": "cc-by-sa-4.0",
             "Neither the name of Some Firm nor the names of its contributors may be used": "bsd-3"}
    got = by_id(licenses.digest(licenses.scan(documents(spark, list(enumerate(cases))))))
    assert {t: got[i]["labels"] for i, t in enumerate(cases)} == cases
    assert all(got[i]["score"] > 0 for i, want in enumerate(cases.values()) if want)


def test_spdx_identifiers_give_their_own_label_alone(spark):
    cases = licenses.spdx_labels()
    got = by_id(licenses.digest(licenses.scan(documents(spark, [(i, f"// SPDX-License-Identifier: {name}\n") for i, name in enumerate(cases)]))))
    assert {name: (got[i]["labels"], got[i]["score"]) for i, name in enumerate(cases)} == {name: (label, 1.0) for name, label in cases.items()}
    short = {"BSD 3-Clause": "bsd-3", "BSD 2-Clause License": "bsd-2", "licensed under MIT.": "mit", "commit under limit": "", "MS-PL": "ms-pl"}
    got = by_id(licenses.digest(licenses.scan(documents(spark, list(enumerate(short))))))
    assert {t: got[i]["labels"] for i, t in enumerate(short)} == short


def plain_found(text):
    """Every rule at every place by Python's expressions, and suppression by comparing each with all before it."""
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))
    line = " " + " ".join(words) + " "
    hits = sorted((line.count(" ", 0, m.start()), -line.count(" ", 0, m.end()), rank, r["label"], r["level"])
                  for rank, r in enumerate(licenses.rules()) for m in re.finditer(r["pattern"], line))
    return [(h[3], h[4], h[0], -h[1]) for i, h in enumerate(hits) if not any(g[4] <= h[4] and g[1] <= h[1] for g in hits[:i])]


def test_detections_are_those_of_a_plain_loop(spark):
    parts = ["released under the MIT license", "GPL 2 or any later version", "the GNU General Public License v3", "words between", "Copyright 2020 A. All rights reserved.",
             "SPDX-License-Identifier: GPL-2.0-or-later", "Apache License, Version 2.0", "public domain", "CC BY-NC-SA 4.0", "see the license file"]
    texts = [" ".join(parts[(i * k + k // 3) % len(parts)] for i in range(n)) for k, n in ((1, 10), (3, 63), (7, 64), (9, 65), (3, 400))]
    got = by_id(licenses.scan(documents(spark, list(enumerate(texts)))))
    for i, t in enumerate(texts):
        assert [tuple(d) for d in got[i]["found"]] == plain_found(t)


def test_long_texts_of_notices_take_time_in_proportion(spark):
    text = "all rights reserved " * 50_000
    start = time.monotonic()
    row = licenses.scan(documents(spark, [(1, text)])).selectExpr("size(found) AS n", "found[49999].first AS last").first()
    assert tuple(row) == (50_000, 149_997)
    assert time.monotonic() - start < 60


def shortest(pattern):
    """A text that a rule's expression matches: first alternatives, nothing that is optional."""
    old = None
    while old != pattern:
        old, pattern = pattern, re.sub(r"\((?:\?:)?([^()|]*)(?:\|[^()]*)?\)(\?)?", lambda m: "" if m[2] else m[1], pattern.replace("(?= )", "").replace("[sc]", "c").replace("[0-9]{2}", "20"))
        pattern = re.sub(r"\.\{1,80\}\?|[a-z0-9 ]\?", lambda m: "x" if m[0][0] == "." else "", pattern)
    return pattern.strip()


def test_every_rule_is_reached_by_its_shortest_text(spark):
    every = list(licenses.rules())
    assert len({(r["label"], r["level"], r["pattern"]) for r in every}) == len(every)
    texts = [shortest(r["pattern"]) for r in every]
    assert all(re.fullmatch(r["pattern"].replace("(?= )", " "), f" {t} ") for r, t in zip(every, texts))
    assert all(r["keyword"] in f" {t} " for r, t in zip(every, texts))
    got = by_id(licenses.digest(licenses.scan(documents(spark, list(enumerate(texts))))))
    assert not [(t, tuple(got[i])) for i, t in enumerate(texts) if not got[i]["labels"] or got[i]["score"] == 0]


def test_the_plan_has_no_python(spark):
    plan = licenses.digest(licenses.scan(documents(spark, [(1, "a")])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan and "Exchange" not in plan
