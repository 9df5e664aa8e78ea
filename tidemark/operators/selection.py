"""Rankings, quotas, set comparisons and idempotent appends."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import first_per_key

# Base assets that are not traded as coins.
STABLE_BASES = ("USDT", "USDC", "DAI", "TUSD", "FDUSD", "BUSD", "USDP", "EUR", "GBP", "TRY", "BRL", "ARS", "RUB")
MODES = ("gainers", "losers", "volume", "volatile", "manual")
BENCHMARK_SYMBOL = "BTCUSDT"


def is_stable(symbol: Column) -> Column:
    base = F.upper(F.expr("substring({0}, 1, length({0}) - 4)".format("symbol")))
    return symbol.endswith("USDT") & (base.isin(*STABLE_BASES) | (base == ""))


def filter_tickers(tickers: DataFrame, min_volume: float = 1_000_000, min_change: float = 0.0,
                   exclude_stable: bool = True) -> DataFrame:
    out = tickers.where(F.col("quote_volume") >= min_volume)
    if min_change > 0:
        out = out.where(F.abs("change_pct") >= min_change)
    return out.where(~is_stable(F.col("symbol"))) if exclude_stable else out


def mode_order(mode: str) -> Column:
    return {"gainers": F.col("change_pct").desc(), "losers": F.col("change_pct").asc(),
            "volume": F.col("quote_volume").desc(), "volatile": F.abs("change_pct").desc()}[mode]


def top_by_mode(filtered: DataFrame, mode: str, limit: int) -> DataFrame:
    """The first rows of one ordering (a bounded top-k, no full sort)."""
    return filtered.orderBy(mode_order(mode), "symbol").limit(limit)


def ranked(top: DataFrame, order: Sequence[Column], out: str = "rank") -> DataFrame:
    """Number the rows of an already limited result."""
    return top.withColumn(out, F.row_number().over(Window.orderBy(*order)))


def normalize_modes(value: str | Sequence[str]) -> list[str]:
    raw = value.split(",") if isinstance(value, str) else list(value)
    wanted: list[str] = []
    for name in (m.strip().lower() for m in raw if isinstance(m, str)):
        wanted += ["gainers", "losers", "volume"] if name == "all" else [name]
    return [m for m in dict.fromkeys(wanted) if m in MODES] or ["gainers"]


def union_of_modes(filtered: DataFrame, modes: str | Sequence[str], limit: int) -> DataFrame:
    """Tops of several orderings in their given order; a symbol counts where it comes first."""
    parts = None
    for i, mode in enumerate(m for m in normalize_modes(modes) if m != "manual"):
        top = ranked(top_by_mode(filtered, mode, limit), [mode_order(mode), F.col("symbol")], "mode_rank")
        top = top.withColumns({"mode": F.lit(mode), "mode_order": F.lit(i)})
        parts = top if parts is None else parts.unionByName(top)
    return first_per_key(parts, ["symbol"], ["mode_order", "mode_rank"])


def scan_list(manual: DataFrame, automatic: DataFrame, cap: int, benchmark: str | None = BENCHMARK_SYMBOL) -> DataFrame:
    """Manual symbols first, then automatic ones, no duplicates, at most ``cap``.

    A missing benchmark symbol takes a free slot or the last one.  ``manual``
    has ``symbol, position``; ``automatic`` comes from ``union_of_modes``.
    """
    both = manual.select(F.upper("symbol").alias("symbol"), F.lit(0).alias("a"), F.lit(0).alias("b"), F.col("position").alias("c")).unionByName(
        automatic.select(F.upper("symbol").alias("symbol"), F.lit(1).alias("a"), F.col("mode_order").alias("b"), F.col("mode_rank").alias("c")))
    once = first_per_key(both, ["symbol"], ["a", "b", "c"]).orderBy("a", "b", "c", "symbol").limit(cap)
    out = ranked(once, [F.col("a"), F.col("b"), F.col("c"), F.col("symbol")], "slot").select("symbol", "slot")
    if benchmark is None:
        return out
    present = out.agg(F.count_if(F.col("symbol") == benchmark).alias("has"), F.count(F.lit(1)).alias("n"))
    extra = present.where("has = 0").select(F.lit(benchmark).alias("symbol"), F.least(F.col("n") + 1, F.lit(cap)).cast("int").alias("slot"))
    # the forced symbol replaces whatever holds its slot
    return out.join(extra.select("slot"), "slot", "left_anti").select("symbol", "slot").unionByName(extra)


def comparison_universe(eligible: DataFrame, pinned: DataFrame, target: int, movement_share: float = 0.70, benchmark: str = BENCHMARK_SYMBOL) -> DataFrame:
    """Pinned symbols, then most of the rest by movement and the remainder by volume.

    Only the first ``2*target`` rows of each ordering can matter, so all
    ranking happens on bounded sets.
    """
    pins = (eligible.join(pinned.select(F.upper("symbol").alias("symbol"), "position"), "symbol")
            .orderBy("position").limit(target).withColumns({"source": F.lit("pinned"), "source_rank": F.col("position").cast("int")}).drop("position"))
    names = pins.select("symbol")
    n_pinned = pins.agg(F.count(F.lit(1)).alias("n"))
    order = {"movement": [F.abs("change_pct").desc(), F.col("symbol")], "volume": [F.col("quote_volume").desc(), F.col("symbol")]}

    def bounded(kind: str, taken: DataFrame) -> DataFrame:
        top = eligible.orderBy(*order[kind]).limit(2 * target).join(taken, "symbol", "left_anti")
        return ranked(top, order[kind], "source_rank").withColumn("source", F.lit(kind))

    slots = F.ceil(F.greatest(F.lit(target) - n_pinned.scalar(), F.lit(0)) * movement_share)
    move = bounded("movement", names).where(F.col("source_rank") <= slots)
    first = pins.unionByName(move.select(*pins.columns))
    left = F.lit(target) - first.agg(F.count(F.lit(1))).scalar()
    rest = bounded("volume", first.select("symbol")).where(F.col("source_rank") <= left)
    return _with_benchmark(first.unionByName(rest.select(*pins.columns)), eligible.where(F.col("symbol") == benchmark), target)


def _with_benchmark(chosen: DataFrame, benchmark: DataFrame, target: int) -> DataFrame:
    """An eligible benchmark that was not chosen takes a free place or that of the last symbol; at most ``target`` + 1 rows are ranked."""
    spare = benchmark.withColumns({"source": F.lit("benchmark"), "source_rank": F.lit(0)}).select(*chosen.columns)
    place = F.when(F.col("source") == "pinned", 0).when(F.col("source") == "movement", 1).when(F.col("source") == "volume", 2).otherwise(3)
    rows = chosen.unionByName(spare).withColumn("_place", place)
    rows = ranked(rows, [F.col("_place"), F.col("source_rank"), F.col("symbol")], "_slot")
    name = F.max(F.when(F.col("_place") == 3, F.col("symbol"))).over(Window.partitionBy())
    rows = rows.withColumn("_name", name).withColumn("_has", F.coalesce(F.max((F.col("_place") < 3) & (F.col("symbol") == F.col("_name"))).over(Window.partitionBy()), F.lit(False)))
    force = F.col("_name").isNotNull() & ~F.col("_has")
    return rows.where(F.when(F.col("_place") == 3, force).otherwise(~(force & (F.col("_slot") == target)))).select(*chosen.columns)


def new_rows(incoming: DataFrame, existing: DataFrame, key: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """Rows to append so that a key is stored once and a repeated run adds nothing."""
    once = first_per_key(incoming, list(key), list(order)) if order else incoming.dropDuplicates(list(key))
    return once.join(existing.select(*key), list(key), "left_anti")


def append_new(incoming: DataFrame, path: str, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Append the rows whose key the table at ``path`` doesn't have; a repeated run appends nothing. Returns the table."""
    spark = incoming.sparkSession
    try:
        existing = spark.read.schema(incoming.schema).parquet(path)
        rows = new_rows(incoming, existing, key, order)
    except AnalysisException:
        rows = first_per_key(incoming, list(key), list(order))
    rows.write.mode("append").parquet(path)
    return spark.read.schema(incoming.schema).parquet(path)


def latest_snapshot(scans: DataFrame, limit: int = 200) -> DataFrame:
    """Newest row per symbol, best score first."""
    from tidemark.operators.ordered import latest_per_key
    return latest_per_key(scans, ["symbol"], ["seq"]).orderBy(F.col("score").desc(), "symbol").limit(limit)


def fill_missing_hits(alerts: DataFrame, resolved: DataFrame) -> DataFrame:
    """Set ``hit`` and ``hit_time`` where still unknown, as a new version of the table."""
    r = resolved.select("symbol", "signal_time", F.col("hit").alias("_h"), F.col("hit_time").alias("_t"))
    out = alerts.join(r, ["symbol", "signal_time"], "left")
    fresh = F.col("hit").isNull() & F.col("_h").isNotNull()
    return (out.withColumn("filled", fresh).withColumn("hit_time", F.when(fresh, F.col("_t")).otherwise(F.col("hit_time")))
            .withColumn("hit", F.coalesce("hit", "_h")).drop("_h", "_t"))


def combine_training(historical: DataFrame, live: DataFrame, *, key: Sequence[str], max_historical: int, seed: int = 42) -> DataFrame:
    """Live rows and a seeded sample of history; live wins on the key.

    The sample takes the rows with the smallest hash of key and seed, which is
    the same whatever the partitioning.
    """
    sample = historical.withColumn("_h", F.xxhash64(*key, F.lit(seed))).orderBy("_h", *key).limit(max_historical).drop("_h")
    both = live.withColumns({"training_source": F.lit("live"), "_p": F.lit(0)}).unionByName(
        sample.withColumns({"training_source": F.lit("historical"), "_p": F.lit(1)}), allowMissingColumns=True)
    return first_per_key(both, list(key), ["_p"]).drop("_p")


def selection_overlap(decisions: DataFrame, key: str = "symbol") -> DataFrame:
    """How two arms' selections overlap, from one flag pair per key."""
    flags = decisions.groupBy(key).agg(F.max(F.when(F.col("arm") == "champion", F.col("selected"))).alias("a"),
                                       F.max(F.when(F.col("arm") == "challenger", F.col("selected"))).alias("b"))
    a, b = F.coalesce("a", F.lit(False)), F.coalesce("b", F.lit(False))
    return flags.agg(F.count_if(a & b).alias("overlap"), F.count_if(a & ~b).alias("champion_only"),
                     F.count_if(~a & b).alias("challenger_only"), F.count_if(~a & ~b).alias("neither"))


def listing_stats(listings: DataFrame) -> DataFrame:
    """Distinct bases per venue and their unions and overlaps, from one flag row per base.

    ``listings``: ``venue`` (spot, usdm, coinm), ``base``, ``quote``, ``trading``.
    """
    live = listings.where("trading")
    on = lambda v: F.max(F.col("venue") == v)
    bases = live.where("base IS NOT NULL").groupBy("base").agg(on("spot").alias("s"), on("usdm").alias("u"), on("coinm").alias("c"))
    fut = F.col("u") | F.col("c")
    out = bases.agg(F.count_if("s").alias("spot_coins"), F.count_if("u").alias("usdm_coins"), F.count_if("c").alias("coinm_coins"),
                    F.count_if(fut).alias("futures_coins"), F.count(F.lit(1)).alias("all_coins"),
                    F.count_if(F.col("s") & ~fut).alias("spot_only"), F.count_if(~F.col("s") & fut).alias("futures_only"),
                    F.count_if(F.col("s") & fut).alias("both"))
    pairs = live.agg(F.count_if(F.col("venue") == "spot").alias("spot_symbols"), F.count_if(F.col("venue") == "usdm").alias("usdm_symbols"),
                     F.count_if((F.col("venue") == "spot") & (F.col("quote") == "USDT")).alias("spot_usdt_pairs"))
    from tidemark.operators.ordered import with_scalar
    return with_scalar(out, pairs, "spot_symbols", "usdm_symbols", "spot_usdt_pairs")


def upsert_history(history: DataFrame, snapshot: DataFrame, key: str = "date", keep: int = 365) -> DataFrame:
    """Replace or add snapshot rows by date and keep the newest days."""
    merged = history.join(snapshot.select(key), key, "left_anti").unionByName(snapshot)
    return merged.orderBy(F.col(key).desc()).limit(keep)
