"""License scan by ordered signature rules, in SQL functions only.

A text is brought to lower-cased words with single blanks. Rules are regular expressions over those words, each with a
keyword taken from the expression itself: a rule runs only where its keyword occurs, and a rule without one runs always.
Rules that share a keyword are looked up together. Detections are intervals; one that lies inside the interval of another
of the same or a better class is suppressed, and of equal intervals the rule that comes first stays.
"""
from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Places of these phrases are always reported.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: label: names (as expressions over words), versions ('' stands for none).
FAMILIES = {
    "gpl": ((r"gnu general public licen[sc]e", r"general public licen[sc]e"), ("1", "2", "3")),
    "gpl-short": ((r"gnu gpl", r"gpl"), ("1", "2", "3")),
    "lgpl": ((r"gnu (?:lesser|library) general public licen[sc]e", r"gnu lgpl", r"lgpl"), ("2", "2 1", "3")),
    "agpl": ((r"gnu affero general public licen[sc]e", r"gnu agpl", r"agpl"), ("1", "3")),
    "gfdl": ((r"gnu free documentation licen[sc]e", r"gfdl"), ("1 1", "1 2", "1 3")),
    "apache": ((r"apache licen[sc]e", r"apache software licen[sc]e", r"apache"), ("1 0", "1 1", "2")),
    "mozilla": ((r"mozilla public licen[sc]e", r"mpl"), ("1 0", "1 1", "2")),
    "eclipse": ((r"eclipse public licen[sc]e", r"epl"), ("1", "2")),
    "cddl": ((r"common development and distribution licen[sc]e", r"cddl"), ("1 0", "1 1")),
    "artistic": ((r"artistic licen[sc]e",), ("1 0", "2")),
    "eupl": ((r"european union public licen[sc]e", r"eupl"), ("1 1", "1 2")),
    "osl": ((r"open software licen[sc]e",), ("1", "2 1", "3")),
    "afl": ((r"academic free licen[sc]e",), ("2 1", "3")),
    "boost": ((r"boost software licen[sc]e",), ("1 0",)),
    "zope": ((r"zope public licen[sc]e",), ("2 0", "2 1")),
    "ms-pl": ((r"microsoft public licen[sc]e", r"ms pl"), ("",)),
    "mit": ((r"mit licen[sc]e", r"expat licen[sc]e", r"mit x11 licen[sc]e"), ("",)),
    "isc": ((r"isc licen[sc]e",), ("",)),
    "zlib": ((r"zlib licen[sc]e", r"zlib libpng licen[sc]e"), ("",)),
    "unlicense": ((r"unlicense", r"the unlicense"), ("",)),
    "wtfpl": ((r"do what the fuck you want to public licen[sc]e", r"wtfpl"), ("2",)),
    "bsd": ((r"bsd licen[sc]e", r"bsd style licen[sc]e"), ("",)),
    "bsd-2": ((r"(?:2|two) clause bsd licen[sc]e", r"simplified bsd licen[sc]e", r"freebsd licen[sc]e", r"bsd (?:2|two) clause(?: licen[sc]e)?"), ("",)),
    "bsd-3": ((r"(?:3|three) clause bsd licen[sc]e", r"new bsd licen[sc]e", r"modified bsd licen[sc]e", r"bsd (?:3|three) clause(?: licen[sc]e)?"), ("",)),
    "odbl": ((r"open (?:data commons open )?database licen[sc]e", r"odbl"), ("1 0",)),
    "python": ((r"python software foundation licen[sc]e", r"psf licen[sc]e"), ("2",)),
}
#: Creative Commons: parts after "cc by" or "attribution", and versions.
CC_PARTS = {"": "", "sa": "share ?alike", "nc": "non ?commercial", "nd": "no ?deriv(?:ative)?s?(?: works)?", "nc-sa": "non ?commercial share ?alike",
            "nc-nd": "non ?commercial no ?deriv(?:ative)?s?(?: works)?"}
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Sentences of license texts and notices.
SENTENCES = (
    ("mit", 1, "permission is hereby granted free of charge to any person obtaining a copy"),
    ("bsd", 1, "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd-3", 1, "neither the name of .{1,80}? nor the names of its contributors may be used"),
    ("isc", 1, "permission to use copy modify and or distribute this software for any purpose"),
    ("zlib", 1, "this software is provided as is without any express or implied warranty"),
    ("unlicense", 1, "this is free and unencumbered software released into the public domain"),
    ("cc0", 1, "cc0(?: 1 0)?(?: universal)?"),
    ("public-domain", 2, "(?:released|placed|dedicated)? ?(?:in|into|to) the public domain"),
    ("public-domain", 3, "public domain"),
    ("proprietary", 2, "proprietary and confidential"),
    ("all-rights-reserved", 3, "all rights reserved"),
    ("copyright-notice", 3, "copyright(?: c)? (?:19|20)[0-9]{2}"),
    ("license-reference", 3, "(?:see|read) (?:the )?(?:accompanying )?licen[sc]e(?: file| txt| md)?"),
    ("license-reference", 3, "subject to (?:the )?(?:terms of )?(?:this|the) licen[sc]e"),
    ("no-warranty", 3, "without warrant(?:y|ies) of any kind"),
)
# SPDX identifiers with their labels, and those of the GNU family, which also come with "-only" and "-or-later".
SPDX = {
    "AFL-2.1": "afl-2.1", "AFL-3.0": "afl-3", "Apache-1.0": "apache-1.0", "Apache-1.1": "apache-1.1", "Apache-2.0": "apache-2", "Artistic-1.0": "artistic-1.0",
    "Artistic-2.0": "artistic-2", "BSD-2-Clause": "bsd-2", "BSD-3-Clause": "bsd-3", "BSL-1.0": "boost-1.0", "CC0-1.0": "cc0", "CDDL-1.0": "cddl-1.0", "CDDL-1.1": "cddl-1.1",
    "EPL-1.0": "eclipse-1", "EPL-2.0": "eclipse-2", "EUPL-1.1": "eupl-1.1", "EUPL-1.2": "eupl-1.2", "ISC": "isc", "MIT": "mit", "MPL-1.0": "mozilla-1.0", "MPL-1.1": "mozilla-1.1",
    "MPL-2.0": "mozilla-2", "MS-PL": "ms-pl", "ODbL-1.0": "odbl-1.0", "OSL-1.0": "osl-1", "OSL-2.1": "osl-2.1", "OSL-3.0": "osl-3", "PSF-2.0": "python-2", "Python-2.0": "python-2",
    "Unlicense": "unlicense", "WTFPL": "wtfpl-2", "ZPL-2.0": "zope-2.0", "ZPL-2.1": "zope-2.1", "Zlib": "zlib"}
SPDX_GNU = ("AGPL-1.0", "AGPL-3.0", "GFDL-1.1", "GFDL-1.2", "GFDL-1.3", "GPL-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.0", "LGPL-2.1", "LGPL-3.0")
CLASS_WEIGHT = (1.0, 0.8, 0.4)
_GRANT = r"(?:licensed|released|distributed|available|provided|published|covered) (?:under|by)(?: the)?(?: terms of)?(?: the)? "


def _version(v: str) -> str:
    return r"(?: version| ?v)? ?" + (v if " " in v else rf"{v}(?: 0)?") if v else ""


def spdx_labels() -> dict[str, str]:
    """Label of each SPDX identifier."""
    out = dict(SPDX)
    for name in SPDX_GNU:
        label = name.lower().removesuffix(".0")
        out |= {name: label, f"{name}-only": label, f"{name}-or-later": f"{label}-or-later"}
    return out


def keyword(pattern: str) -> str:
    """The longest run of words and pieces of words that every match of a pattern holds as it stands; '' if there is none."""
    plain = re.sub(r"\[[^\]]*\](?:\{[^}]*\}|[?*+])?\??", "\0", pattern)
    plain = re.sub(r"\([^()]*\)(?:\{[^}]*\}|[?*+])?\??", "\0", plain)
    plain = re.sub(r"[^\0](?:\{[^}]*\}|[?*+])\??", "\0", plain)
    if "(" in plain or "|" in plain:
        return ""
    run = max(re.findall(r"[a-z0-9 ]+", plain), key=len, default="")
    return run if run.strip() else ""


def rules() -> Iterator[dict]:
    """All rules in order: within a class, longer forms come first."""
    def rule(label, level, pattern, name=None):
        return dict(label=label, level=level, pattern=f" {pattern}(?= )", keyword=keyword(name or f" {pattern}"))

    for phrase, label in BASE_PHRASES.items():
        yield rule(label, 1, phrase)
    for family, (names, versions) in FAMILIES.items():
        family = family.removesuffix("-short")
        for v in versions:
            label = family + (f"-{v.replace(' ', '.')}" if v else "")
            for name in names:
                full = f"{name}{_version(v)}"
                if v:
                    yield rule(f"{label}-or-later", 1, f"(?:{_GRANT})?{full}(?: of the licen[sc]e)? or (?:at your option )?(?:any )?later(?: version)?", name)
                yield rule(label, 1, f"{_GRANT}{full}")
                yield rule(label, 2, full)
        for name in names:
            if versions != ("",) and " " in name:
                yield rule(family, 3, name)
    for name, label in spdx_labels().items():
        words = re.sub("[^a-z0-9]+", " ", name.lower())
        yield rule(label, 1, f"spdx license identifier {words}", "spdx license identifier")
    yield rule("mit", 1, f"{_GRANT}mit", " mit")
    for part, words in CC_PARTS.items():
        short = " ".join(["cc by", *part.split("-")]).rstrip()
        label = "-".join(x for x in ("cc-by", part) if x)
        full = f"creative commons attribution {words}".rstrip()
        for v in CC_VERSIONS:
            for form in (short, full):
                yield rule(f"{label}-{v.replace(' ', '.')}", 1, f"{form}(?: licen[sc]e)? {v}(?: international| unported)?")
        yield rule(label, 2, short)
        yield rule(label, 2, full)
    for label, level, pattern in SENTENCES:
        yield rule(label, level, pattern)


_RULE = "array<struct<keyword: string, rules: array<struct<rank: int, label: string, level: int, pattern: string>>>>"


def rule_table() -> Column:
    """The rules by keyword."""
    groups: dict[str, list[dict]] = {}
    for i, r in enumerate(rules()):
        groups.setdefault(r.pop("keyword"), []).append(dict(rank=i, **r))
    return F.from_json(F.lit(json.dumps([dict(keyword=k, rules=g) for k, g in groups.items()])), _RULE)


_HITS = "array<struct<first: int, end: int, rank: int, label: string, level: int>>"
#: Items of a fold that grows an array; longer arrays are cut into blocks, so that no long array is copied per item.
BLOCK = 64


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _words(s: Column) -> Column:
    """Words in a piece of a line that begins with a blank, as every word follows one."""
    return F.length(s) - F.length(F.replace(s, F.lit(" ")))


def _in_blocks(items: Column, totals: Callable[[Column], Column], join: Callable[[Column, Column], Column], zero: Column,
               run: Callable[[Column, Column], Column]) -> Column:
    """Run over the blocks of an array, each with the joined totals of all blocks before it."""
    def blocks(whole: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(whole) - 1) / BLOCK).cast("int")), lambda b: F.slice(whole, b * BLOCK + 1, BLOCK))

    def ahead(cut: Column) -> Column:
        start = F.struct(zero.alias("now"), F.slice(F.array(zero), 1, 0).alias("out"))
        return F.aggregate(F.transform(cut, totals), start, lambda acc, t: F.struct(join(acc["now"], t).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out")),
                           lambda acc: acc["out"])

    return F.flatten(_let(items, lambda whole: F.when(F.size(whole) > 0, _let(blocks(whole), lambda cut: F.zip_with(cut, ahead(cut), run)))))


def _places(line: Column, rule: Column) -> Column:
    """Where a rule matches, in words: its matches and the pieces between them tell how many words come before each."""
    def sized(matches: Column) -> Column:
        skips = F.transform(F.slice(F.split(line, rule["pattern"], -1), F.lit(1), F.size(matches)), _words)
        return F.zip_with(skips, F.transform(matches, _words), lambda p, m: F.struct(p.alias("skip"), m.alias("size")))

    def place(block: Column, at: Column) -> Column:
        # ``end`` has its sign turned, so that sorting puts the longer of two intervals with one start first
        return F.aggregate(block, F.struct(at.alias("at"), F.array().cast(_HITS).alias("out")), lambda acc, s: _step(acc["at"] + s["skip"], s["size"], acc["out"]),
                           lambda acc: acc["out"])

    def _step(first: Column, size: Column, out: Column) -> Column:
        hit = F.struct(first.alias("first"), (-(first + size)).alias("end"), rule["rank"].alias("rank"), rule["label"].alias("label"), rule["level"].alias("level"))
        return F.struct((first + size).alias("at"), F.concat(out, F.array(hit)).alias("out"))

    total = lambda block: F.aggregate(block, F.lit(0), lambda n, s: n + s["skip"] + s["size"])
    found = lambda matches: _in_blocks(sized(matches), total, lambda a, b: a + b, F.lit(0), place)
    return _let(F.regexp_extract_all(line, rule["pattern"], F.lit(0)), lambda m: F.when(F.size(m) > 0, found(m)).otherwise(F.array().cast(_HITS)))


def _suppress(hits: Column) -> Column:
    """Keep each hit that lies in no earlier interval of its own or a better class; hits come sorted by start, length and rank."""
    levels = (1, 2, 3)
    reach = lambda acc, h: F.struct(*[F.when(h["level"] == k, F.greatest(acc[f"e{k}"], -h["end"])).otherwise(acc[f"e{k}"]).alias(f"e{k}") for k in levels])
    farther = lambda a, b: F.struct(*[F.greatest(a[f"e{k}"], b[f"e{k}"]).alias(f"e{k}") for k in levels])
    zero = F.struct(*[F.lit(-1).alias(f"e{k}") for k in levels])

    def step(acc, h):
        covered = F.greatest(acc["now"]["e1"], F.when(h["level"] >= 2, acc["now"]["e2"]), F.when(h["level"] >= 3, acc["now"]["e3"])) >= -h["end"]
        return F.struct(reach(acc["now"], h).alias("now"), F.when(covered, acc["out"]).otherwise(F.concat(acc["out"], F.array(h))).alias("out"))

    def keep(block: Column, ahead: Column) -> Column:
        return F.aggregate(block, F.struct(ahead.alias("now"), F.array().cast(_HITS).alias("out")), step, lambda acc: acc["out"])

    kept = _in_blocks(hits, lambda block: F.aggregate(block, zero, reach), farther, zero, keep)
    return F.coalesce(kept, F.array().cast(_HITS))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, places of the base phrases, and the detections that remain, of each row.

    Null texts are empty; texts in which no rule matches have no detections; repeated rows give repeated results; an empty
    table gives none; other columns are not read.
    """
    text = F.coalesce("text", F.lit(""))
    line = F.concat(F.lit(" "), F.trim(F.regexp_replace(F.translate(text, UPPER, LOWER), GAP, " ")), F.lit(" "))
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("n_words"),
                        line.alias("line"))
    line = F.col("line")
    counts, firsts, lasts, labels = [], [], [], []
    for phrase, label in BASE_PHRASES.items():
        n = F.regexp_count(line, F.lit(f" {phrase}(?= )"))
        counts.append(n)
        labels.append(F.when(n > 0, F.lit(label)))
        firsts.append(F.when(n > 0, _words(F.substring(line, F.lit(1), F.locate(f" {phrase} ", line) - 1))))
        lasts.append(F.when(n > 0, _words(F.regexp_extract(line, f"(?s)^(.*) {phrase} ", 1))))
    meant = F.flatten(F.transform(F.filter(rule_table(), lambda g: F.contains(line, g["keyword"])), lambda g: g["rules"]))
    hits = F.flatten(F.transform(meant, lambda r: _places(line, r)))
    found = lines.select(
        "doc_id", "n_words", "line", sum(counts[1:], counts[0]).cast("long").alias("n_base"), F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"), F.array_compact(F.array(*labels)).alias("base"),
        F.when(line == " ", F.array().cast(_HITS)).otherwise(F.array_sort(hits)).alias("hits"))
    kept = found.withColumn("kept", _suppress(F.col("hits")))
    return kept.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base", F.transform("kept", lambda h: F.struct(
        h["label"].alias("label"), h["level"].alias("level"), h["first"].alias("first"), (-h["end"]).alias("end"))).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    weights = F.array(*map(F.lit, CLASS_WEIGHT))
    best = F.array_max(F.transform("found", lambda d: F.element_at(weights, d["level"])))
    every = F.array_sort(F.array_distinct(F.concat("base", F.transform("found", lambda d: d["label"]))))
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
                          F.array_join(every, ",").alias("labels"),
                          F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"))
