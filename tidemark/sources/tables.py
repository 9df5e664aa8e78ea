"""Reading and writing tables in the shared file system."""
from __future__ import annotations

import re
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.reports import dataset_fingerprint

FORMATS = {".parquet": "parquet", ".pq": "parquet", ".json": "json", ".jsonl": "json", ".ndjson": "json", ".csv": "csv"}


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder that all executors see: below ``spark.checkpoint.dir``.

    Where that is unset, ``/tmp`` of the default file system is used. If that is the disk of one machine and the
    session has others, there is no shared place and the call fails.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
        if default.startswith("file:") and not re.fullmatch(r"local(\[[^\[\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"/tmp/spark-{spark.sparkContext.applicationId}"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def read_merged(spark: SparkSession, path: str) -> DataFrame:
    """All Parquet files below a folder, columns matched by name."""
    return spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(path)


def read_evidence(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Read a table by its suffix; other formats are refused."""
    suffix = "." + path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if suffix not in FORMATS:
        raise ValueError(f"unsupported evidence format {suffix!r}; use CSV, Parquet or JSON")
    reader = spark.read.schema(schema) if schema else spark.read
    if FORMATS[suffix] == "csv":
        reader = reader.option("header", True)
    return reader.format(FORMATS[suffix]).load(path)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once and read it back.

    Jobs that pass over the same rows several times (training, evaluation)
    then read a table instead of repeating the work, also after lost executors.
    """
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_partitioned(df: DataFrame, path: str, columns: Sequence[str], mode: str = "errorifexists", buckets: int | None = None) -> str:
    """Write by partition columns; rows of one partition are gathered first, spread by ``buckets`` for large ones.

    The commit protocol makes the result visible as a whole.
    """
    spread = [F.col(c) for c in columns]
    if buckets:
        spread.append(F.pmod(F.xxhash64(*df.columns), F.lit(buckets)))
    df.repartition(*spread).write.mode(mode).partitionBy(*columns).parquet(path)
    return path


def layout(root: str, area: str, **parts: str) -> str:
    """Folder of a data set: its area and ``key=value`` parts."""
    return "/".join([root.rstrip("/"), area, *[f"{k}={v}" for k, v in parts.items()]])


def export_dataset(df: DataFrame, path: str, time_column: str, key: Sequence[str]) -> DataFrame:
    """Write a data set once and describe it: rows, time range and content fingerprint."""
    df.write.mode("errorifexists").parquet(path)
    saved = df.sparkSession.read.parquet(path)
    span = saved.agg(F.min(time_column).alias("first_time"), F.max(time_column).alias("last_time"))
    packed = span.select(F.struct("first_time", "last_time")).scalar()
    return dataset_fingerprint(saved, list(key)).withColumn("_s", packed).select("n_rows", "fingerprint", "_s.*")


def write_by_fold(df: DataFrame, path: str) -> str:
    """Store predictions per fold; an existing report is never overwritten."""
    return write_partitioned(df, path, ["fold_idx"])
