"""Row-wise text work in Arrow batches, and the normal forms that several operators share."""
from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BATCH_BYTES = 16 << 20
PART_ROWS = 512

#: ASCII A-Z to a-z, all ASCII that is no letter or digit to a space; bytes of other characters stay.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def alnum_words(text: str | None) -> list[bytes]:
    """Lower-cased words of ASCII letters, ASCII digits and all characters beyond ASCII, as UTF-8."""
    return text.encode().translate(_LETTERS).split() if text else []


def space_words(text: str | None) -> list[bytes]:
    """Words between blanks and the control characters 9 to 13, as UTF-8."""
    return text.encode().split() if text else []


def bounded_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well, since texts have no bound; a smaller bound that is set stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(name))) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))


def map_rows(df: DataFrame, schema: str, start: Callable[[], Callable[..., tuple]]) -> DataFrame:
    """One output row per input row.

    ``start`` runs once per task and returns the function of one row's values; state that it keeps there is only
    a cache. Rows go through in Arrow batches, so a task holds one batch of texts at a time.
    """
    bounded_batches(df.sparkSession)
    out = to_arrow_schema(T._parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = start()
        for batch in batches:
            for at in range(0, batch.num_rows, PART_ROWS):
                columns = [c.to_pylist() for c in batch.slice(at, PART_ROWS).columns]
                made = list(zip(*map(row, *columns)))
                yield pa.RecordBatch.from_arrays([pa.array(list(v), f.type) for v, f in zip(made, out)], schema=out)

    return df.mapInArrow(run, schema)


def keep_rows(df: DataFrame, columns: list[str], start: Callable[[], Callable[..., bool]]) -> DataFrame:
    """The rows, unchanged and with all columns, for which a function of some columns is true."""
    bounded_batches(df.sparkSession)
    at = [df.columns.index(c) for c in columns]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep = start()
        for batch in batches:
            for first in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(first, PART_ROWS)
                mask = list(map(keep, *(part.column(i).to_pylist() for i in at)))
                yield part.filter(pa.array(mask, pa.bool_()))

    return df.mapInArrow(run, df.schema)


def replace_column(df: DataFrame, column: str, start: Callable[[], Callable]) -> DataFrame:
    """The rows with one column's values replaced by a function of them."""
    bounded_batches(df.sparkSession)
    at = df.columns.index(column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new = start()
        for batch in batches:
            for first in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(first, PART_ROWS)
                old = part.column(at)
                columns = list(part.columns)
                columns[at] = pa.array(list(map(new, old.to_pylist())), old.type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return df.mapInArrow(run, df.schema)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column end to end, and where each row begins (one more for the end); null: empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


SPAN = "array<struct<kind: string, start: long, end: long, score: double>>"


def span_digest(found: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Of each row's spans: counts of the given kinds, a digest of those kinds' spans, all spans as text, the top score."""
    def text(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind):
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("found", lambda s: s["kind"].isin(*kinds))
    return found.select("doc_id", *map(count, kinds), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("found")).alias("spans"),
                        F.coalesce(F.array_max(F.transform("found", lambda s: s["score"])), F.lit(0.0)).alias("top_score"))
