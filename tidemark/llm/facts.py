"""Joining rows to facts about their key where single keys may hold a large part of all rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Keys with at least one part in this many of all counted rows are joined by broadcast; so there are at most this many.
HEAVY = 1024


def join_facts(rows: DataFrame, facts: DataFrame, keys: list[str], weight: str, spread: Column) -> DataFrame:
    """All rows with ``facts.fact`` of their key as ``fact``, null where there is none.

    ``facts`` has one row per key, with the number of its rows in ``weight``. Heavy keys are at most ``HEAVY`` by their
    weights, whatever the size of the tables, and are broadcast. All other keys meet in a shuffle, where rows that have
    their fact already are dealt by ``spread`` (a 64-bit hash of anything that differs among them) and match nothing.
    ``facts`` is read three times, so it should be a written table. Its keys are pairs or more of 64-bit hashes.
    """
    total = facts.agg(F.sum(weight)).scalar()
    facts = facts.withColumn("_heavy", F.col(weight) * HEAVY >= total)
    at = [f"_k{i}" for i in range(len(keys))]
    named = facts.select(*(F.col(k).alias(a) for k, a in zip(keys, at)), "fact", "_heavy")
    heavy = named.where("_heavy").select(*at, F.col("fact").alias("_by_broadcast"))
    light = named.where("NOT _heavy").select(*at, F.col("fact").alias("_by_shuffle"))
    rows = rows.join(F.broadcast(heavy), [rows[k] == heavy[a] for k, a in zip(keys, at)], "left").drop(*at)
    rows = rows.withColumn("_s0", F.when(F.col("_by_broadcast").isNull(), F.col(keys[0])).otherwise(spread))
    on = [F.col("_s0") == light[at[0]], F.col("_by_broadcast").isNull() == F.lit(True), *(rows[k] == light[a] for k, a in zip(keys[1:], at[1:]))]
    return rows.join(light, on, "left").withColumn("fact", F.coalesce("_by_broadcast", "_by_shuffle")).drop("_by_broadcast", "_by_shuffle", "_s0", *at)
