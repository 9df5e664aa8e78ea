"""Structured Streaming forms of the polled work.

Every job reads a growing folder, keeps its state in checkpoints and can be
stopped and started again at any point; ``availableNow`` runs it over what
has landed so far.
"""
from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from tidemark.operators.candidates import EPISODE_OUT, Episode, episode_rows, episode_scan
from tidemark.operators.ordered import latest_per_key, stacked_rank
from tidemark.operators.speculative import BLOCK_ROWS, BUDGET_STATE, COOLDOWN_STATE, budget_machine, cooldown_machine, speculative_scan
from tidemark.sources.tables import materialize, shared_folder

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def landed(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Stream over the Parquet files of a folder, with zoned timestamps."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    # as a pattern the path may name a folder or a single file
    df = reader.parquet(f"{path[:-1]}[{path[-1]}]")
    zone_free = [f.name for f in schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in zone_free})


def run_to_table(stream: DataFrame, name: str, root: str | None = None) -> DataFrame:
    """Append the stream's result to a table until all landed input is done."""
    spark = stream.sparkSession
    root = root or shared_folder(spark, name)
    query = (stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/table")
             .option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/table")


MERGE_BUCKETS = 16


def merged_table(spark: SparkSession, root: str, columns: list[str] | None = None, before: int | None = None) -> DataFrame | None:
    """What a merge has written: of each bucket its newest version, or None before the first."""
    try:
        every = spark.read.parquet(f"{root}/table")
    except AnalysisException:
        return None
    if before is not None:
        every = every.where(F.col("version") < before)
    # one row per bucket
    newest = {r["bucket"]: r["v"] for r in every.groupBy("bucket").agg(F.max("version").alias("v")).collect()}
    if not newest:
        return None
    live = reduce(lambda x, y: x | y, ((F.col("bucket") == b) & (F.col("version") == v) for b, v in newest.items()))
    return every.where(live).select(*(columns or [c for c in every.columns if c not in ("bucket", "version")]))


def run_merge(stream: DataFrame, name: str, keys: list[str], order: list[str], root: str | None = None) -> DataFrame:
    """Keep the newest row per key: a micro-batch writes new versions of the buckets that its keys fall into.

    Rows that tie in ``order`` count as equal. A batch that is repeated after a failure starts from the versions before it and writes its own
    again; a run without new input writes nothing and returns what there is.
    """
    spark = stream.sparkSession
    root = root or shared_folder(spark, name)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(MERGE_BUCKETS)).cast("int")

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = latest_per_key(batch, keys, order)
        touched = [r[0] for r in new.select(bucket).distinct().collect()]
        if not touched:
            return
        old = merged_table(batch.sparkSession, root, new.columns, before=batch_id)
        if old is not None:
            new = latest_per_key(new.unionByName(old.where(bucket.isin(touched))), keys, order)
        (new.withColumns({"bucket": bucket, "version": F.lit(batch_id).cast("long")}).repartition("bucket").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(f"{root}/table"))

    query = (stream.writeStream.foreachBatch(merge).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    done = merged_table(spark, root, stream.columns)
    return spark.createDataFrame([], stream.schema) if done is None else done


def tumbling_bars(ticks: DataFrame, width: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """Bars of event-time windows, emitted once the watermark has passed them."""
    w = ticks.withWatermark("ts", lateness).groupBy(F.window("ts", width), "symbol")
    stamp = F.struct("ts", "seq")
    return w.agg(F.min_by("px", stamp).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", stamp).alias("close"),
                 F.sum("qty").alias("volume"), F.count(F.lit(1)).alias("trade_count")).select(
        "symbol", F.col("window.start").alias("open_time"), F.col("window.end").alias("end_time"), "open", "high", "low", "close",
        F.col("volume").cast("double").alias("volume"), "trade_count")


def session_events(signals: DataFrame, minutes: int = 60, lateness: str = "10 minutes") -> DataFrame:
    """Events of signals less than ``minutes`` apart.

    A gap of exactly ``minutes`` must split, while a session window would join
    it; the window gap is therefore one microsecond shorter.
    """
    gap = f"{minutes - 1} minutes 59 seconds 999999 microseconds"
    s = signals.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap), "symbol")
    return s.agg(F.count(F.lit(1)).alias("member_rows"), F.min("ts").alias("event_start"), F.max("ts").alias("event_end")).select(
        "symbol", F.concat_ws("_", "symbol", F.unix_seconds("event_start").cast("string")).alias("event_id"), "event_start", "event_end", "member_rows")


def lateness_gate(bars: DataFrame, side: DataFrame, limit: str = "5 seconds", keep: str = "1 hour") -> DataFrame:
    """Every bar with its side records that were available in time; late ones never join.

    A bar without any comes with nulls, once the watermark of both streams has passed its limit.
    """
    b = bars.withWatermark("close_time", keep).alias("b")
    s = side.withWatermark("available_time", keep).alias("s")
    on = F.expr(f"b.bar_key = s.bar_key AND s.available_time >= b.close_time AND s.available_time <= b.close_time + INTERVAL {limit}")
    return b.join(s, on, "left_outer")


def follow_up(first: DataFrame, second: DataFrame, within: str = "2 hours", lateness: str = "1 hour") -> DataFrame:
    """Each opening row with every resolving row of the same key within the horizon.

    One without any comes with nulls, once the watermark of both streams has passed its horizon.
    """
    a = first.withWatermark("opened_at", lateness).alias("a")
    b = second.withWatermark("resolved_at", lateness).alias("b")
    on = F.expr(f"a.who = b.who AND b.resolved_at > a.opened_at AND b.resolved_at <= a.opened_at + INTERVAL {within}")
    return a.join(b, on, "left_outer").selectExpr("a.who", "a.opened_at", "a.open_id", "b.resolved_at", "b.resolve_id")


def outcome_due(first: DataFrame, second: DataFrame, within: str = "2 hours", lateness: str = "1 hour") -> DataFrame:
    """One row per opening whose horizon has ended: its first resolving row and ``resolved``, or nulls and ``retry``."""
    earliest = F.min(F.struct("resolved_at", "resolve_id")).alias("r")
    return follow_up(first, second, within, lateness).groupBy("who", "opened_at", "open_id").agg(earliest).select(
        "who", "opened_at", "open_id", "r.resolved_at", "r.resolve_id", F.when(F.col("r.resolve_id").isNull(), F.lit("retry")).otherwise(F.lit("resolved")).alias("status"))


DUE_STATE = "kind string, who bigint, id bigint, us bigint, checks int, resolved bigint, resolve_id bigint"


def due_step(batch: DataFrame, states: DataFrame | None, horizon_ms: int, checks: int, lateness: str = "1 hour") -> tuple[DataFrame, DataFrame]:
    """Openings that are new or were checked again, with their newest status, and what later batches need.

    ``batch`` has ``kind`` (open or resolve), ``who``, ``id`` and ``us``. Rows are ordered per (who, slice of time as long as all checks), so that a
    key with many rows is spread; a resolving row goes to its own slice and to the one before it. States are the openings not yet
    decided, each with its first resolving row so far, the resolving rows that a later opening could need, and the newest time seen.
    """
    spark, span = batch.sparkSession, horizon_ms * checks * 1000
    states = spark.createDataFrame([], DUE_STATE) if states is None else states
    late = spark.sql(f"SELECT unix_micros(timestamp_micros(0L) + INTERVAL {lateness})").first()[0]
    passed_at = lambda seen: None if seen is None else (seen - late) // 1000 * 1000
    # one number each
    before = states.where("kind = 'seen'").agg(F.max("us")).first()[0]
    times = [x for x in (before, batch.agg(F.max("us")).first()[0]) if x is not None]
    seen = max(times, default=None)
    if before is not None:
        batch = batch.where(f"us IS NULL OR us > {passed_at(before)}L")
    passed = "NULL" if seen is None else f"{passed_at(seen)}L"
    new = batch.selectExpr("kind", "who", "id", "us", "0 AS checks", "CAST(NULL AS BIGINT) AS resolved", "CAST(NULL AS BIGINT) AS resolve_id", "true AS new")
    rows = new.unionByName(states.where("kind <> 'seen'").withColumn("new", F.lit(False)))
    news = rows.where("kind = 'resolve' AND who IS NOT NULL AND us IS NOT NULL")
    own = f"((us - pmod(us, {span}L)) DIV {span}L)"
    sliced = rows.where("kind = 'open'").selectExpr("*", f"{own} AS slice").unionByName(news.selectExpr("*", f"explode(array({own} - 1, {own})) AS slice"))
    # from the newest back; an opening comes before the rows of its own time, so it sees later ones only, the earliest last
    after = Window.partitionBy("who", "slice").orderBy(F.col("us").desc(), "kind", F.col("id").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last(F.expr("CASE WHEN kind = 'resolve' THEN named_struct('resolved', us, 'resolve_id', id) END"), True).over(after)
    done = f"CAST(least(greatest(coalesce(({passed} - us DIV 1000 * 1000) DIV {horizon_ms * 1000}L, 0L), 0L), {checks}L) AS INT)"
    live = (sliced.withColumn("_found", found).where("kind = 'open'")
            .withColumn("_first", F.expr("least(_found, CASE WHEN resolved IS NOT NULL THEN named_struct('resolved', resolved, 'resolve_id', resolve_id) END)"))
            .selectExpr("who", "id", "us", "new", "checks AS _old", "_first", f"{done} AS _done", f"(_first.resolved - us + {horizon_ms * 1000 - 1}L) DIV {horizon_ms * 1000}L AS _needed")
            .selectExpr("*", f"CASE WHEN _needed <= _done THEN 'resolved' WHEN _done = {checks} THEN 'unresolved' WHEN _done > 0 THEN 'retry' ELSE 'open' END AS status"))
    live = materialize(live, "due")
    out = live.where("new OR _done > _old").selectExpr(
        "who", "id AS open_id", "us AS opened", "CAST(CASE WHEN status = 'resolved' THEN _needed ELSE _done END AS INT) AS checks",
        "CASE WHEN status = 'resolved' THEN _first.resolve_id END AS resolve_id", "CASE WHEN status = 'resolved' THEN _first.resolved END AS resolved", "status")
    left = live.where("us IS NOT NULL AND status IN ('open', 'retry')").selectExpr(
        "'open' AS kind", "who", "id", "us", "_done AS checks", "_first.resolved AS resolved", "_first.resolve_id AS resolve_id")
    # no opening older than the watermark can come any more
    left = left.unionByName(news.drop("new").where(f"us > {passed}"))
    return out, left.unionByName(spark.createDataFrame([("seen", None, None, seen, None, None, None)] if times else [], DUE_STATE))


def outcomes_due(first: DataFrame, second: DataFrame, name: str, *, horizon_ms: int = 7_200_000, checks: int = 12, lateness: str = "1 hour", root: str | None = None) -> DataFrame:
    """One row per opening with its newest status, the horizons checked, and the first resolving row once it is resolved.

    An opening is looked at again when the watermark (the newest time seen less ``lateness``) has passed the end of another horizon.
    Needs ``who``, ``id`` and ``ts`` on both sides.
    """
    side = lambda df, kind: df.selectExpr(f"'{kind}' AS kind", "who", "id", "unix_micros(ts) AS us")
    events = run_carried(side(first, "open").unionByName(side(second, "resolve")), name, lambda batch, states: due_step(batch, states, horizon_ms, checks, lateness), root)
    newest = F.max_by(F.struct("checks", "resolve_id", "resolved", "status"), F.struct("checks", F.col("status") != "retry")).alias("n")
    return events.groupBy("who", "open_id", "opened").agg(newest).select("who", "open_id", F.expr("timestamp_micros(opened) AS opened_at"), "n.checks",
                                                                         F.expr("timestamp_micros(n.resolved) AS resolved_at"), "n.resolve_id", "n.status")


class _PerKey(StatefulProcessor):
    """Rows of a key in time order against one state row; subclasses say how."""

    STATE = ""

    def init(self, handle) -> None:
        self._state = handle.getValueState("state", self.STATE)

    def close(self) -> None:
        pass

    def _sorted(self, rows: Iterator[pd.DataFrame], t: str) -> pd.DataFrame:
        # what one micro-batch brings for one key: bound it by the files of a trigger, or take episode_run, which cuts keys into blocks
        return pd.concat(list(rows), ignore_index=True).sort_values(t, ignore_index=True)


class EpisodeProcessor(_PerKey):
    STATE = "episode string, stage string, ref double, ref_t bigint, peak double, peak_t bigint, last_pump bigint, score double"

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state = Episode(self._state.get() if self._state.exists() else None)
        yield from episode_rows([self._sorted(rows, "scan_t")], state)
        native = lambda x: None if x is None else (x if isinstance(x, str) else x.item() if hasattr(x, "item") else x)
        self._state.update(tuple(native(x) for x in state.values()))


def cooldown_marks(times: list[int], last: int | None, minutes: int) -> tuple[list[bool], int | None]:
    """Greedy sending: a row is sent when nothing was sent in the last ``minutes``."""
    gap, out = minutes * 60_000_000, []
    for t in times:
        go = last is None or t - last > gap
        out.append(go)
        last = t if go else last
    return out, last


def _stateful(stream: DataFrame, keys: list[str], processor: StatefulProcessor, schema: str) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return stream.groupBy(*keys).transformWithStateInPandas(processor, schema, "append", "none")


def episode_stream(stream: DataFrame) -> DataFrame:
    return _stateful(stream, ["symbol"], EpisodeProcessor(), EPISODE_OUT)


CARRY = "version"


def run_carried(stream: DataFrame, name: str, step: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]], root: str | None = None) -> DataFrame:
    """Run a step over every micro-batch with the states that the batches before left.

    ``step`` takes a batch and the states (None before the first) and returns rows and new states. Both are written per batch
    below the root, so a batch that is repeated after a failure starts from the states before it and writes the same again.
    """
    spark = stream.sparkSession
    root = root or shared_folder(spark, name)

    def each(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        states = _written(session, f"{root}/carry")
        if states is not None:
            states = states.where(F.col(CARRY) < batch_id)
            newest = states.agg(F.max(CARRY)).first()[0]
            states = None if newest is None else states.where(F.col(CARRY) == newest).drop(CARRY)
        out, new = step(batch, states)
        new.write.mode("overwrite").parquet(f"{root}/carry/{CARRY}={batch_id}")
        out.write.mode("overwrite").parquet(f"{root}/table/{CARRY}={batch_id}")

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    done = _written(spark, f"{root}/table")
    if done is None:
        done = step(spark.createDataFrame([], stream.schema), None)[0]
        return done
    return done.drop(CARRY)


def _written(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None


def cooldown_run(stream: DataFrame, keys: list[str], name: str, *, minutes: int = 60, root: str | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Greedy sending per key: a row is ``sent`` when nothing was sent in the last ``minutes``; needs ``t`` in microseconds and ``seq``.

    Batches come one after the other, rows of a batch in the order of time. A key's rows run in blocks over many tasks.
    """
    machine = cooldown_machine(minutes * 60_000_000)

    def step(batch, states):
        return speculative_scan(batch, keys, ["t", "seq"], machine, COOLDOWN_STATE, "sent: boolean", states, block_rows)[:2]
    return run_carried(stream, name, step, root)


def budget_run(stream: DataFrame, name: str, *, who: str = "symbol", minutes: int = 60, hours: int = 24, total: int = 15, each: int = 2,
               root: str | None = None, block_rows: int = 1024) -> DataFrame:
    """Sent marks and reasons under a cooldown, ``each`` sends per name and ``total`` over all names, in any ``hours``.

    The order is one for all names, so blocks cut across them; what is handed on is the queue of at most ``total`` sends.
    """
    machine = budget_machine(who, gap=minutes * 60_000_000, window=hours * 3_600_000_000, total=total, each=each)

    def step(batch, states):
        return speculative_scan(batch, [], ["t", who, "seq"], machine, BUDGET_STATE, "sent: boolean, reason: string", states, block_rows)[:2]
    return run_carried(stream, name, step, root)


def episode_run(stream: DataFrame, name: str, root: str | None = None, block_rows: int = 256) -> DataFrame:
    """Episode decisions of landed scan rows; every batch goes on from the states of the symbols before it."""
    def step(batch, states):
        return episode_scan(batch, states, block_rows)[:2]
    return run_carried(stream, name, step, root)


def daily_cap(candidates: DataFrame, *, total: int = 15, each: int = 2) -> DataFrame:
    """Sent marks under caps per calendar day: the first ``each`` rows per symbol, and of those the first ``total``.

    Unlike the rolling budget this needs no order over days; the ranks keep no more than the cap per task. Run it after the
    cooldown. Needs ``symbol, seq, t``.
    """
    days = candidates.select("symbol", "seq", "t", F.expr("t DIV 86400000000L AS day"))
    own = stacked_rank(days, ["symbol", "day"], [F.col("t"), F.col("seq")], each).drop("rank")
    top = stacked_rank(own, ["day"], [F.col("t"), F.col("symbol"), F.col("seq")], total).select("symbol", "seq", F.lit(True).alias("_go"))
    return candidates.join(top, ["symbol", "seq"], "left").withColumn("sent", F.coalesce("_go", F.lit(False))).drop("_go")


def ingest(spark: SparkSession, path: str, transform: Callable[[DataFrame], DataFrame], name: str) -> DataFrame:
    """Normalise only files not seen before; the second run finds nothing new."""
    root = shared_folder(spark, name)
    run_to_table(transform(landed(spark, path)), name, root)
    return run_to_table(transform(landed(spark, path)), name, root)
