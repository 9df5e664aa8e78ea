"""Conversation repair against an exhaustive search and a plain table of rows."""
import hashlib
import random
import re
import zlib

import pytest

from tests.llm.helpers import SMALL, rows
from tidemark.llm import conversations, derivation

SCHEMA = "conv_id long, turn long, role string, text string"
SPACES = " \t\n\x0b\x0c\r"


def search(faulty):
    """Least (cost, audit, lines) of a list of (role, text, fault), all derivations tried with up to two insertions in a row."""
    best = [(2 * len(faulty), "D" * len(faulty), [])]

    def go(i, out, cost, audit, lines, inserted):
        if cost > best[0][0]:
            return
        if i == len(faulty) and re.fullmatch("(s?(ua)+)?", out):
            best[0] = min(best[0], (cost, audit, lines))
        if inserted < 2:
            for role in ("user", "assistant"):
                go(i, out + role[0], cost + 5, audit + "I", [*lines, f"{role}:"], inserted + 1)
        if i < len(faulty):
            role, text, fault = faulty[i]
            go(i + 1, out, cost + 2, audit + "D", lines, 0)
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                go(i + 1, out + (role[:1] or "?"), cost + more, audit + "K", [*lines, f"{role}:{text}"], 0)
                for new in ("user", "assistant"):
                    go(i + 1, out + new[0], cost + 1 + more, audit + "R", [*lines, f"{new}:{text}"], 0)

    go(0, "", 0, "", [], 0)
    return best[0]


def damaged(table):
    out = []
    for c, t, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if d:
            out += [(c, t, "user" if d == 4 else role, "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text)] * (2 if d == 3 else 1)
    return out


def faults(mine):
    seen, out = set(), []
    for role, text in mine:
        bare = text.strip(SPACES)
        out.append((role, text, "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def plain(table):
    out, hurt = [], damaged(table)
    for c in {r[0] for r in table}:
        mine = sorted((r for r in hurt if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        faulty = faults([r[2:] for r in mine])
        turns = {r[1] for r in mine if r[1] is not None}
        counts = [sum(f[2] == k for f in faulty) for k in ("blank", "duplicate", "truncated")]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:]))
        cost, audit, lines = search(faulty)
        out.append((c, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def repaired(spark, table, **kw):
    df = spark.createDataFrame(table, SCHEMA).selectExpr("*", "'x' AS audit", "1 AS part", "2 AS h1", "3 AS first")
    return rows(conversations.digest(conversations.repair(conversations.damage(df), **kw)))


def test_the_given_conversations(spark):
    df = spark.read.parquet(f"{SMALL}/conversations.parquet")
    table = [tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()]
    assert rows(conversations.digest(conversations.repair(conversations.damage(df)))) == plain(table)


ROLES = ("user", "assistant", "system", "tool", "", None, "User")


@pytest.mark.parametrize("block_rows", [1, 3, 128])
def test_made_conversations(spark, block_rows):
    rng = random.Random(block_rows)
    table = []
    for c in [*range(60), None]:
        # turns differ in one conversation except for whole copies, as the order of equal turns is the operator's own
        for t in rng.sample([*range(12), None], rng.randint(1, 6)):
            row = (c, t, rng.choice(ROLES if rng.random() < 0.4 else ROLES[:2]), rng.choice(["Hi.", "Hi.", "So", "What?\n ", "", None, " \t", "Done!", "é "]))
            table += [row] * rng.choice([1, 1, 1, 2])
    assert repaired(spark, table, block_rows=block_rows) == plain(table)


def test_empty_and_emptied(spark):
    assert repaired(spark, []) == []
    gone = [(c, 0, "user", "x.") for c in range(200) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert gone and repaired(spark, gone) == plain(gone)
    assert repaired(spark, gone)[0][1:8] == (0, 0, 0, 0, 0, 0, "")


def test_one_conversation_over_many_tasks(spark):
    """Cut in blocks and tasks, it comes out as its agenda over all rows at once says, and its rows hold its turns."""
    rng = random.Random(9)
    table = [(7, t, rng.choice(["user", "assistant", "assistant", "user", "system"]), f"{'Yes.' if rng.random() < 0.2 else f'text {t}'}{rng.choice(['.', '?', ''])}") for t in range(900)]
    table += [(8, t, ("user", "assistant")[t % 2], f"turn {t}.") for t in range(40)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        done = conversations.repair(conversations.damage(spark.createDataFrame(table, SCHEMA).repartition(5)), block_rows=16)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    got = {r["conv_id"]: r for r in conversations.digest(done).collect()}
    assert done.audits.where("conv_id = 7").select("part").distinct().count() > 1, "the rows of one conversation were in one task"
    for c in (7, 8):
        mine = [(r[2], r[3]) for r in sorted(damaged(table), key=lambda r: r[1]) if r[0] == c]
        short = [(r, derivation.DROP if f in ("blank", "duplicate") else derivation.CUT if f else 0) for r, _, f in faults(mine)]
        ends = [x and (x[0] + 5 * derivation.CLOSING[q], x[1] + "I" * derivation.CLOSING[q]) for q, x in enumerate(derivation.lightest([(r[:1], f) for r, f in short], derivation.E))]
        assert (got[c]["cost"], got[c]["audit"]) == min(e for e in ends if e)
    turns = [(r["role"], r["text"]) for r in done.rows.where("conv_id = 7").orderBy("part", "idx", "seq").collect()]
    assert re.fullmatch("s?(ua)+", "".join(r[0] for r, _ in turns))
    assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest() == got[7]["repaired_sha256"]


def test_a_very_long_text_and_rows_of_many_copies(spark):
    table = [(1, 0, "user", "a" * 2_000_000 + "."), (1, 1, "assistant", "b" * 2_000_000)] + [(2, 3, "user", "Again.")] * 500 + [(2, 4, "assistant", "No.")]
    df = spark.createDataFrame(table, SCHEMA).selectExpr("*", "1L AS copies")
    got = {r["conv_id"]: r for r in conversations.digest(conversations.repair(df)).collect()}
    assert (got[1]["cost"], got[1]["audit"], got[1]["truncated"]) == (4, "DD", 1)
    assert (got[2]["duplicate"], got[2]["cost"], got[2]["audit"]) == (499, 998, "K" + "D" * 499 + "K")
