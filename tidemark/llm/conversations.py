"""Conversation structure repair by lightest derivations.

A repaired conversation has the roles ``(system? (user assistant)+)?``. Rows may be kept, given the role of a user or an assistant,
deleted, or preceded by empty turns; ``derivation`` finds the cheapest edits with an agenda of weighted deductions.

Structure needs no texts: rows are reduced to hashes and flags, equal rows to one with a count. These skeletons are sorted over
all tasks by range, so that a conversation of any size is cut where a task's rows end, and every task cuts what
it has into blocks. Blocks say what they cost between any two states; runs of blocks meet per conversation, whose lightest way
gives every run its states, and backwards through a run every block its own. Texts meet the edits once, at the end.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.llm import derivation
from tidemark.llm.common import map_rows
from tidemark.llm.facts import join_facts
from tidemark.llm.lines import BLANKS
from tidemark.sources.tables import materialize

BLOCK_ROWS = 128
BATCH = 1024
ENDS = (".", "!", "?")
LAST_IDX = 2**31 - 1


def damage(conversations: DataFrame) -> DataFrame:
    """The rows with faults planted by a hash of conversation and turn: dropped (copies 0), emptied, without sentence ends, doubled, user's."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                                (F.crc32(key.cast("binary")) % 20).alias("d"))
    return rows.select("conv_id", "turn", F.when(F.col("d") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
                       F.when(F.col("d") == 1, F.lit("")).when(F.col("d") == 2, F.translate("text", "".join(ENDS), "")).otherwise(F.col("text")).alias("text"),
                       F.when(F.col("d") == 0, 0).when(F.col("d") == 3, 2).otherwise(1).cast("long").alias("copies"))


def _hashes(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2")


def skeletons(rows: DataFrame) -> DataFrame:
    """One row per conv_id, turn, role and text, with the text's hash and flags, the copies, and whether its role and text come first here.

    A conversation without any rows left keeps one with no copies.
    """
    bare = F.btrim("text", F.lit(BLANKS))
    there = F.col("copies") > 0
    flags = rows.select("conv_id", *(F.when(there, F.col(c)).alias(c) for c in ("turn", "role", "text")), "copies")
    flags = flags.select("conv_id", "turn", "role", *_hashes(F.col("text")), (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(*ENDS)).alias("cut"), "copies")
    flags = flags.groupBy("conv_id", "turn", "role", "h1", "h2").agg(F.first("blank").alias("blank"), F.first("cut").alias("cut"), F.sum("copies").alias("copies"))
    flags = flags.withColumns({"k1": F.xxhash64("conv_id", "role", "h1"), "k2": F.xxhash64(F.lit(1), "role", "conv_id", "h2")})
    return materialize(flags, "skeletons")


def with_first(skeleton: DataFrame) -> DataFrame:
    """Marks the earliest turn of each role and text in its conversation."""
    again = (skeleton.where("copies > 0").groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("turn")).alias("fact"))
             .where("n > 1"))
    met = join_facts(skeleton, materialize(again, "said-again"), ["k1", "k2"], "n", F.xxhash64("turn", "conv_id"))
    return met.withColumn("first", F.col("fact").isNull() | F.col("fact.turn").eqNullSafe(F.col("turn"))).drop("fact", "k1", "k2")


ROW = "struct<turn: long, role: string, h1: long, h2: long, fault: int>"
RUN = ("struct<span: array<long>, n_rows: long, first_initial: string, last_initial: string, first_turn: long, last_turn: long, n_turns: long, "
       "blank: long, duplicate: long, truncated: long, illegal: long>")
BLOCKS = f"conv_id long, part int, idx int, rows array<{ROW}>, before array<long>, own array<long>, run {RUN}"
LEGAL = ("su", "ua", "au")


def _arrow(df: DataFrame, schema: str, run) -> DataFrame:
    """mapInArrow of a generator of row dicts over rows given as dicts."""
    kind = to_arrow_schema(T._parse_datatype_string(schema))

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for out in run(r for b in batches for at in range(0, b.num_rows, BATCH) for r in b.slice(at, BATCH).to_pylist()):
            made.append(out)
            size += 1 + len(out.get("rows") or ()) // 4
            if size >= BATCH:
                yield pa.RecordBatch.from_pylist(made, kind)
                made, size = [], 0
        if made:
            yield pa.RecordBatch.from_pylist(made, kind)

    return df.mapInArrow(over, schema)


def _faulty(rows: Iterable[dict], stats: dict) -> Iterator[tuple[dict, int]]:
    """Rows of one conversation, copies one by one, each with the fault that decides; counts what is seen."""
    for r in rows:
        for copy in range(r["copies"]):
            fault = 0
            if r["blank"]:
                fault, kind = derivation.DROP, "blank"
            elif copy or not r["first"]:
                fault, kind = derivation.DROP, "duplicate"
            elif r["cut"]:
                fault, kind = derivation.CUT, "truncated"
            if fault:
                stats[kind] += 1
            initial = r["role"][:1]
            if stats["n_rows"]:
                stats["illegal"] += stats["last_initial"] + initial not in LEGAL
            else:
                stats["first_initial"] = initial
            if r["turn"] is not None and r["turn"] != stats["last_turn"]:
                if stats["last_turn"] is None:
                    stats["first_turn"] = r["turn"]
                stats["last_turn"] = r["turn"]
                stats["n_turns"] += 1
            stats["last_initial"] = initial
            stats["n_rows"] += 1
            yield {"turn": r["turn"], "role": r["role"], "h1": r["h1"], "h2": r["h2"], "fault": fault}, fault


def _new_stats() -> dict:
    return {"n_rows": 0, "first_initial": None, "last_initial": None, "first_turn": None, "last_turn": None, "n_turns": 0,
            "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}


def blocks(ordered: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Blocks of rows in order of conv_id and turn (nulls first), equal turns by role and text hash, with their spans.

    ``part`` and ``idx`` order a conversation's blocks; ``before`` is the span from the run's start to the block, and the last block of
    a run has the whole run's span and counts.
    """
    def run(rows):
        part, opened = TaskContext.get().partitionId(), False
        for conv, group in groupby(rows, lambda r: r["conv_id"]):
            # only the task's first conversation can have begun in an earlier task
            entries = (derivation.E,) if opened else (derivation.E, derivation.S, derivation.U, derivation.A)
            opened = True
            stats, before, idx = _new_stats(), derivation.IDENTITY, 0
            stream = (r for r, _ in _faulty(group, stats))
            block = _take(stream, block_rows)
            while True:
                after = _take(stream, block_rows)
                short = [(r["role"][:1], r["fault"]) for r in block]
                own = derivation.span(short, entries)
                if idx == 0 and len(entries) == 1:
                    entries = (derivation.E, derivation.S, derivation.U, derivation.A)
                whole = derivation.combine(before, own)
                yield {"conv_id": conv, "part": part, "idx": idx, "rows": block, "before": before, "own": own,
                       "run": None if after else {"span": whole, **stats}}
                if not after:
                    break
                block, before, idx = after, whole, idx + 1

    spread = ordered.repartitionByRange("conv_id", "turn", "role", "h1").sortWithinPartitions("conv_id", "turn", "role", "h1", "h2")
    return materialize(_arrow(spread, BLOCKS, run), "conversation-blocks")


def _take(rows: Iterator, n: int) -> list:
    out = []
    for r in rows:
        out.append(r)
        if len(out) == n:
            break
    return out


VERDICT = "struct<gaps: long, blank: long, duplicate: long, truncated: long, illegal: long, cost: long>"


def chains(cut: DataFrame) -> DataFrame:
    """Per conversation: what was found, the cost, and for each of its runs the states around it and the turns inserted after it.

    A conversation has at most one run per task of the sort, so what meets here does not grow with its rows.
    """
    runs = cut.where("run IS NOT NULL").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("part", "run"))).alias("runs"))

    def start():
        def row(conv_id, runs):
            before, spans = [derivation.IDENTITY], [r["run"]["span"] for r in runs]
            for s in spans:
                before.append(derivation.combine(before[-1], s))
            cost, q = derivation.goal(before[-1])
            ways, close = [], derivation.closing(q)
            for i in range(len(runs) - 1, -1, -1):
                p = derivation.middle(before[i], spans[i], derivation.E, q)
                ways.append({"part": runs[i]["part"], "entry": p, "last": q, "close": close})
                q, close = p, ""
            full = [r["run"] for r in runs if r["run"]["n_rows"]]
            timed = [r for r in full if r["n_turns"]]
            n_turns = sum(r["n_turns"] for r in timed) - sum(x["last_turn"] == y["first_turn"] for x, y in zip(timed, timed[1:]))
            gaps = min(timed[-1]["last_turn"] - timed[0]["first_turn"] + 1 - n_turns, 2**63 - 1) if timed else 0
            illegal = sum(r["illegal"] for r in full) + sum(x["last_initial"] + y["first_initial"] not in LEGAL for x, y in zip(full, full[1:]))
            total = {k: sum(r[k] for r in full) for k in ("blank", "duplicate", "truncated")}
            return conv_id, {"gaps": gaps, **total, "illegal": illegal, "cost": cost}, ways
        return row

    return materialize(map_rows(runs, f"conv_id long, verdict {VERDICT}, ways array<struct<part: int, entry: int, last: int, close: string>>", start), "conversation-chains")


PIECE = "struct<edit: string, role: string, turn: long, was: string, h1: long, h2: long>"


def edits(cut: DataFrame, chained: DataFrame) -> DataFrame:
    """Per block its part of the audit, and the turns put out: kept (K), of another role (R) or inserted (I).

    A run's states come before its blocks, which follow from the last to the first, each giving the next its last state.
    """
    ways = chained.select("conv_id", F.explode("ways").alias("way")).select("conv_id", "way.part", F.lit(LAST_IDX).alias("idx"), "way")
    both = cut.drop("run").unionByName(ways, allowMissingColumns=True)

    def run(rows):
        entry, q, close = derivation.E, derivation.E, ""
        for r in rows:
            if r["way"] is not None:
                entry, q, close = r["way"]["entry"], r["way"]["last"], r["way"]["close"]
                continue
            p = derivation.middle(r["before"], r["own"], entry, q)
            audit, out = derivation.play([(x["role"][:1], x["fault"]) for x in r["rows"]], p, q)
            pieces = []
            for i, inserted, initial in out:
                pieces += [{"edit": "I", "role": derivation.NAMES[t]} for t in inserted]
                if i >= 0:
                    x = r["rows"][i]
                    pieces.append({"edit": "R" if initial else "K", "role": derivation.NAMES[initial] if initial else x["role"],
                                   "turn": x["turn"], "was": x["role"], "h1": x["h1"], "h2": x["h2"]})
            pieces += [{"edit": "I", "role": derivation.NAMES[t]} for t in close]
            yield {"conv_id": r["conv_id"], "part": r["part"], "idx": r["idx"], "audit": audit + "I" * len(close), "rows": pieces}
            q, close = p, ""

    spread = both.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", F.col("idx").desc())
    return materialize(_arrow(spread, f"conv_id long, part int, idx int, audit string, rows array<{PIECE}>", run), "conversation-edits")


@dataclass
class Repaired:
    """``rows``: conv_id, part, idx, seq (their order), role, text and edit of all repaired turns. ``audits``: conv_id, part, idx, audit.
    ``verdicts``: conv_id and what was found."""

    rows: DataFrame
    audits: DataFrame
    verdicts: DataFrame


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> Repaired:
    """Repairs all conversations of ``rows``: conv_id, turn, role, text, and copies, the number of times the row stands.

    A row is blank, else a duplicate of an earlier role and text, else truncated if no sentence end comes last; the first two go. Rows come by turn, nulls
    first, and equal turns by role and a hash of the text, which keeps equal rows together. Null roles and texts are one space; an empty role has no
    initial and can't be kept; null ids are one conversation; a conversation whose rows all have no copies is empty and stays; repeated rows add to
    the copies; an empty table gives no rows; columns beyond those are not read.
    """
    space = F.lit(" ")
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), "copies")
    cut = blocks(with_first(skeletons(rows)), block_rows)
    chained = chains(cut)
    fates = edits(cut, chained)
    pieces = fates.select("conv_id", "part", "idx", F.posexplode("rows").alias("seq", "p")).select("conv_id", "part", "idx", "seq", "p.*")
    keys = ["conv_id", "turn", "was", "h1", "h2"]
    texts = rows.where("copies > 0").select("conv_id", "turn", F.col("role").alias("was"), *_hashes(F.col("text")), "text")
    texts = texts.groupBy(*keys).agg(F.first("text").alias("text")).withColumnsRenamed({k: f"_{k}" for k in keys})
    kept = pieces.where("edit != 'I'")
    kept = kept.join(texts, [kept[k].eqNullSafe(texts[f"_{k}"]) if k in ("conv_id", "turn") else kept[k] == texts[f"_{k}"] for k in keys])
    columns = ["conv_id", "part", "idx", "seq", "role", "text", "edit"]
    out = kept.select(*columns).unionByName(pieces.where("edit = 'I'").withColumn("text", F.lit("")).select(*columns))
    return Repaired(out, fates.select("conv_id", "part", "idx", "audit"), chained.select("conv_id", "verdict"))


DIGEST = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def digest(done: Repaired) -> DataFrame:
    """One row per conversation with its verdict, the whole audit and a digest of the repaired text.

    A digest reads a conversation from its first to its last turn, so one task streams it; it holds no more than a batch and the audit.
    """
    lines = done.rows.select("conv_id", "part", "idx", "seq", F.concat_ws(":", "role", "text").alias("line"))
    audits = done.audits.withColumn("seq", F.lit(-1))
    verdicts = done.verdicts.select("conv_id", F.lit(-1).alias("part"), F.lit(-1).alias("idx"), F.lit(-1).alias("seq"), "verdict")
    every = lines.unionByName(audits, allowMissingColumns=True).unionByName(verdicts, allowMissingColumns=True)

    def run(rows):
        for conv, group in groupby(rows, lambda r: r["conv_id"]):
            sha, audit, verdict, glue = hashlib.sha256(), [], {}, b""
            for r in group:
                if r["verdict"] is not None:
                    verdict = r["verdict"]
                elif r["audit"] is not None:
                    audit.append(r["audit"])
                else:
                    sha.update(glue + r["line"].encode())
                    glue = b"\n"
            yield {"conv_id": conv, **verdict, "audit": "".join(audit), "repaired_sha256": sha.hexdigest()}

    return _arrow(every.repartition("conv_id").sortWithinPartitions("conv_id", "part", "idx", "seq"), DIGEST, run)
