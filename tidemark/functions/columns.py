"""Small column helpers shared by the operators."""
from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MICROS = 1_000_000


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def with_exprs(df: DataFrame, **exprs: str) -> DataFrame:
    """Add columns written as SQL expressions; a name that exists is replaced."""
    old = [n for n in exprs if n in df.columns]
    star = f"* EXCEPT ({', '.join(old)})" if old else "*"
    return df.selectExpr(star, *[f"{e} AS {n}" for n, e in exprs.items()])


def sql_micros(t: str) -> str:
    return f"unix_micros(CAST({t} AS TIMESTAMP))"


def sql_grid(t: str, seconds: int) -> str:
    """SQL text of ``grid``; exact integer arithmetic, also before 1970."""
    m, w = sql_micros(t), f"{seconds * MICROS}L"
    return f"(({m} - pmod({m}, {w})) DIV {w})"


def micros(t: Column | str) -> Column:
    """Epoch microseconds of a timestamp (with or without time zone)."""
    if isinstance(t, str):
        return F.expr(sql_micros(t))
    return F.unix_micros(t.cast("timestamp"))


def from_micros(x: Column | str) -> Column:
    return F.timestamp_micros(as_col(x).cast("bigint"))


def grid(t: Column | str, seconds: int) -> Column:
    """Number of the fixed-width time cell a timestamp falls into."""
    if isinstance(t, str):
        return F.expr(sql_grid(t, seconds))
    return F.floor(micros(t) / F.lit(seconds * MICROS)).cast("bigint")


def grid_start(t: Column | str, seconds: int) -> Column:
    return from_micros(grid(t, seconds) * F.lit(seconds * MICROS))


def boundary_minutes(start: Column | str, end: Column | str) -> Column:
    """Minute boundaries crossed between two instants (not elapsed minutes)."""
    return grid(end, 60) - grid(start, 60)


def boundary_seconds(start: Column | str, end: Column | str) -> Column:
    return grid(end, 1) - grid(start, 1)


def elapsed_minutes(start: Column | str, end: Column | str) -> Column:
    return (micros(end) - micros(start)) / F.lit(60.0 * MICROS)


def safe_div(num: Column | str, den: Column | str) -> Column:
    """Division that gives NULL for a zero divisor."""
    return F.try_divide(as_col(num).cast("double"), as_col(den).cast("double"))


def clamp(x: Column, low: float, high: float) -> Column:
    """Limit to a range, keeping NULL as NULL."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def flag_list(*rules: tuple[Column, str]) -> Column:
    """Array of the names whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))


def first_true(*rules: tuple[Column, str], default: str | None = None) -> Column:
    """Name of the first rule that holds."""
    return F.coalesce(*[F.when(c, F.lit(n)) for c, n in rules], F.lit(default).cast("string"))


def stable_id(*parts: Column, length: int = 32) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, length)


def epoch_key(t: Column | str) -> Column:
    """Epoch seconds as text, the time part of readable ids."""
    return grid(t, 1).cast("string")


def normalize_symbol(symbol: Column | str, suffix: str = "USDT") -> Column:
    up = F.upper(F.trim(as_col(symbol)))
    return F.when(up.endswith(suffix), up).otherwise(F.concat(up, F.lit(suffix)))


def sniff_epoch(x: Column | str) -> Column:
    """Read an epoch number as seconds, milliseconds or microseconds by size."""
    v = as_col(x).cast("double")
    size = F.abs(v)
    scaled = F.when(size >= 1e14, v).when(size >= 1e11, v * 1e3).otherwise(v * 1e6)
    return from_micros(F.round(scaled))


def local_day(t: Column | str, zone: str = "Asia/Ho_Chi_Minh") -> Column:
    return F.to_date(F.from_utc_timestamp(as_col(t).cast("timestamp"), zone))


def content_hash(columns: Iterable[str]) -> Column:
    """Order-insensitive hash of a set of rows, as an aggregate expression.

    The sum runs in a decimal, so it can never overflow a long.
    """
    return F.sum(F.xxhash64(*[F.col(c) for c in columns]).cast("decimal(38,0)"))


def to_output(df: DataFrame, floats: str = "", ints: str = "", digits: int = 6) -> DataFrame:
    """Result form for comparison: rounded doubles, longs, zone-free timestamps."""
    floats_, ints_ = set(floats.split()), set(ints.split())
    out = []
    for field in df.schema.fields:
        c = F.col(field.name)
        if field.name in floats_:
            c = F.round(c.cast("double"), digits) + F.lit(0.0)
        elif field.name in ints_:
            c = c.cast("bigint")
        elif isinstance(field.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(field.name))
    return df.select(*out)
