"""Serial state machines over ordered rows, run in blocks that guess the state they start from.

A decision that depends on the decisions before it (a cooldown, a rolling budget, an episode) can't be a window. Here the rows of a
key are cut into blocks of bounded size, and all blocks run at once: the first of a key from its carried state, the others
from none. Every block hands the state it ends with to the next; only blocks that were handed another state than they
ran from run again, until none is left. Machines that forget (old sends leave the budget, an episode ends) settle after
two or three rounds. One that never does (a cap that stays exhausted keeps its phase from window to window) costs a round per
chain: consecutive blocks of a key are chained so that a key has at most ``CHAINS`` of them, and a task takes a chain's blocks one
after the other. So the rounds don't grow with the rows, and the result is always that of the serial run.
"""
from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidemark.sources.tables import materialize

BLOCK, CHAIN, ROWS, STATE = "_block", "_chain", "_rows", "_state"
#: Chains of blocks per key, and so rounds, at most.
CHAINS = 24
#: Rows of an id come from one partition; a power of two, so that no block crosses partitions.
BLOCK_ROWS = 4096
_BATCH = 16
#: (state or None, rows as dicts) -> (one dict of new columns per row, state after them)
Machine = Callable[[dict | None, list[dict]], tuple[list[dict], dict]]


def blocks_of(rows: DataFrame, keys: Sequence[str], order: Sequence[str], block_rows: int) -> DataFrame:
    """One row per block: the keys, the block's number (rising in the order) and its rows in order.

    Rows are sorted by range over all tasks, so a key of any size, or no key at all, is spread. Ties in ``order`` are
    broken by the other columns.
    """
    if block_rows & (block_rows - 1):
        raise ValueError("block_rows must be a power of two")
    full = [*keys, *order, *(c for c in rows.columns if c not in keys and c not in order)]
    ids = (rows.repartitionByRange(*[F.col(c) for c in full]).sortWithinPartitions(*full)
           .withColumn("_id", F.monotonically_increasing_id()))
    one = F.struct("_id", F.struct(*rows.columns).alias("r"))
    packed = ids.groupBy(*keys, F.expr(f"_id DIV {block_rows}").alias(BLOCK)).agg(F.sort_array(F.collect_list(one)).alias(ROWS))
    return materialize(packed.withColumn(ROWS, F.transform(ROWS, lambda x: x["r"])), "blocks")


def _run(blocks: DataFrame, keys: Sequence[str], machine: Machine, state_type: str, new_type: str | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """Keys, chain and the state after it, or with ``new_type`` the rows with their kept and new columns.

    The blocks of a chain go to one task in order; no more than a few of them are held at once.
    """
    rows_type = blocks.schema[ROWS].dataType
    fields = [f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys]
    if new_type is None:
        schema = ", ".join([*fields, f"{CHAIN} long", f"_after {state_type}"])
    else:
        each = ", ".join([*(f"{f.name}: {f.dataType.simpleString()}" for f in rows_type.elementType.fields if keep is None or f.name in keep), new_type])
        schema = f"{ROWS} array<struct<{each}>>"
    kind = to_arrow_schema(T._parse_datatype_string(schema))

    def over(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, state = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, _BATCH):
                out = []
                for b in batch.slice(at, _BATCH).to_pylist():
                    name = {**{k: b[k] for k in keys}, CHAIN: b[CHAIN]}
                    if name != chain:
                        if new_type is None and chain is not None:
                            out.append({**chain, "_after": state})
                        chain, state = name, b[STATE]
                    made, state = machine(state, b[ROWS])
                    if new_type is not None:
                        out.append({ROWS: [{**(r if keep is None else {k: r[k] for k in keep}), **m} for r, m in zip(b[ROWS], made)]})
                if out:
                    yield pa.RecordBatch.from_pylist(out, kind)
        if new_type is None and chain is not None:
            yield pa.RecordBatch.from_pylist([{**chain, "_after": state}], kind)

    # a given number, as few bytes can mean much work
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = blocks.repartition(tasks, *keys, CHAIN).sortWithinPartitions(*keys, CHAIN, BLOCK)
    return blocks.mapInArrow(over, schema)


def speculative_scan(rows: DataFrame, keys: Sequence[str], order: Sequence[str], machine: Machine, state_type: str, new_columns: str,
                     carried: DataFrame | None = None, block_rows: int = BLOCK_ROWS, keep: Sequence[str] | None = None) -> tuple[DataFrame, DataFrame, int]:
    """The rows (of their columns ``keep``, or all) with the machine's new columns, the last state of every key, and the number of rounds.

    ``carried`` has the keys and ``_state``: what earlier rows left. Keys of it without new rows keep their state. Null
    keys are a key like others; an empty table gives no rows and the carried states.
    """
    spark = rows.sparkSession
    keys = list(keys)
    blocks = blocks_of(rows, keys, order, block_rows)
    none = F.lit(None).cast(state_type)
    # one row of a few bytes per block; states aren't part of it
    place = blocks.select(*keys, BLOCK).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(BLOCK)) - 1)
    place = materialize(place, "places")
    long = -(-((place.agg(F.max("_n")).first()[0] or 0) + 1) // CHAINS)
    chains = place.select(*keys, BLOCK, F.expr(f"_n DIV {long}").alias(CHAIN))
    blocks = _match(blocks, chains, [*keys, BLOCK])
    links = chains.select(*keys, CHAIN).distinct().withColumn("_before", F.when(F.col(CHAIN) > 0, F.col(CHAIN) - 1))
    if carried is None:
        links = links.withColumn("_first", none)
    else:
        links = _match(links, carried.select(*keys, F.col(STATE).cast(state_type).alias("_first")), keys)
    now = materialize(links.withColumns({STATE: F.when(F.col("_before").isNull(), F.col("_first")), "_after": none, "_go": F.lit(True)}).drop("_first"), "states")
    rounds = 0
    while not now.where("_go").isEmpty():
        rounds += 1
        todo = _match(blocks, now.where("_go").select(*keys, CHAIN, STATE, F.lit(True).alias("_due")), [*keys, CHAIN]).where("_due")
        done = materialize(_run(todo, keys, machine, state_type).withColumn("_ran", F.lit(True)), "ran")
        now = _match(now.withColumnRenamed("_after", "_old"), done, [*keys, CHAIN])
        now = now.withColumn("_after", F.when(F.col("_ran"), F.col("_after")).otherwise(F.col("_old"))).drop("_old", "_ran", "_go")
        handed = now.select(*keys, F.col(CHAIN).alias("_before"), F.col("_after").alias("_handed"))
        now = _match(now, handed, [*keys, "_before"])
        other = F.col("_before").isNotNull() & ~F.col("_handed").eqNullSafe(F.col(STATE))
        now = materialize(now.withColumns({"_go": other, STATE: F.when(other, F.col("_handed")).otherwise(F.col(STATE))}).drop("_handed"), "states")
    full = _match(blocks, now.select(*keys, CHAIN, STATE), [*keys, CHAIN])
    out = _run(full, keys, machine, state_type, new_columns, keep).select(F.explode(ROWS).alias("r")).select("r.*")
    last = now.groupBy(*keys).agg(F.max_by("_after", CHAIN).alias(STATE)) if keys else now.agg(F.max_by("_after", CHAIN).alias(STATE)).where(F.col(STATE).isNotNull())
    if carried is not None:
        old = carried.select(*keys, F.col(STATE).cast(state_type).alias(STATE))
        same = _same(old, last, keys)
        last = last.unionByName(old.join(last, same, "left_anti") if keys else old.join(last.select(F.lit(1).alias("_any")).limit(1), F.lit(True), "left_anti"))
    return out, last, rounds


def _same(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[k])
    return on


def _match(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join by keys that may be null; without keys ``b`` has at most one row."""
    if not keys:
        names = [c for c in b.columns]
        return a.withColumn("_b", b.select(F.struct(*names)).scalar()).select("*", "_b.*").drop("_b")
    b = b.withColumnsRenamed({k: f"_b_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & a[k].eqNullSafe(b[f"_b_{k}"])
    return a.join(b, on, "left").drop(*[f"_b_{k}" for k in keys])


def cooldown_machine(gap: int) -> Machine:
    """``sent``: nothing was sent in the last ``gap`` of the unit of ``t``."""
    def run(state: dict | None, rows: list[dict]) -> tuple[list[dict], dict]:
        last, out = state["last"] if state else None, []
        for r in rows:
            go = r["t"] is not None and (last is None or r["t"] - last > gap)
            out.append({"sent": go})
            last = r["t"] if go else last
        return out, {"last": last}
    return run


COOLDOWN_STATE = "struct<last: long>"


def budget_machine(name: str, *, gap: int, window: int, total: int, each: int) -> Machine:
    """``sent`` and ``reason`` under a cooldown and caps that roll over ``window``, per name and over all.

    Sends exactly ``window`` old still count. The state is the queue of sends in the window, ``total`` at most.
    """
    def run(state: dict | None, rows: list[dict]) -> tuple[list[dict], dict]:
        queue, out = [(q["t"], q["name"]) for q in state["queue"]] if state else [], []
        for r in rows:
            t, who = r["t"], r[name]
            if t is None:
                out.append({"sent": False, "reason": "no_time"})
                continue
            live = [q for q in queue if t - q[0] <= window]
            own = [q[0] for q in live if q[1] == who]
            reason = ("cooldown" if own and t - own[-1] <= gap else "global_limit" if len(live) >= total else "own_limit" if len(own) >= each else "sent")
            if reason == "sent":
                queue = [*live, (t, who)]
            out.append({"sent": reason == "sent", "reason": reason})
        return out, {"queue": [{"t": t, "name": who} for t, who in queue]}
    return run


BUDGET_STATE = "struct<queue: array<struct<t: long, name: string>>>"
