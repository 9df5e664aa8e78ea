"""What happens after a signal: first passage and extremes on the forward path.

Signals and bars are grouped by (key, time slice); bars are copied into the
slices whose signals can see them, never further than the horizon.  Inside a
slice a NumPy pass steps through the future offsets for all signals at once,
so no (signal, bar) pair is ever shuffled or materialised.
"""
from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.columns import as_col, from_micros, micros
from tidemark.operators.ordered import DAY, SLICE, time_slices

PATH_FIELDS = {
    "n_future": "bigint", "first_t": "bigint", "last_t": "bigint", "last_close": "double",
    "max_gap": "bigint", "max_high": "double", "min_low": "double",
    "lower_t": "bigint", "upper_t": "bigint", "lower_bar": "bigint", "upper_bar": "bigint",
    "high_at_lower": "double", "max_high_before_lower": "double", "min_low_before_upper": "double",
}
TIME_FIELDS = ("first_t", "last_t", "lower_t", "upper_t")


def _scan(sig_t, until, lower, upper, bar_t, high, low, close):
    """One vector step per future offset, over all signals of a slice."""
    n = len(sig_t)
    start = np.searchsorted(bar_t, sig_t, side="right")
    stop = np.searchsorted(bar_t, until, side="right")
    count = np.maximum(stop - start, 0)
    nan = np.full(n, np.nan)
    lower_k, upper_k = np.zeros(n, np.int64), np.zeros(n, np.int64)
    max_high, min_low = nan.copy(), nan.copy()
    high_before, low_before, high_at = nan.copy(), nan.copy(), nan.copy()
    gap = np.zeros(n, np.int64)
    for k in range(1, int(count.max(initial=0)) + 1):
        live = np.flatnonzero(count >= k)
        j = start[live] + k - 1
        h, l = high[j], low[j]
        previous = sig_t[live] if k == 1 else bar_t[j - 1]
        gap[live] = np.maximum(gap[live], bar_t[j] - previous)
        max_high[live] = np.fmax(max_high[live], h)
        min_low[live] = np.fmin(min_low[live], l)
        open_low, open_up = lower_k[live] == 0, upper_k[live] == 0
        hit_low = open_low & (l <= lower[live])
        hit_up = open_up & (h >= upper[live])
        wait = live[open_low & ~hit_low]
        high_before[wait] = np.fmax(high_before[wait], high[start[wait] + k - 1])
        wait = live[open_up & ~hit_up]
        low_before[wait] = np.fmin(low_before[wait], low[start[wait] + k - 1])
        lower_k[live[hit_low]] = k
        high_at[live[hit_low]] = h[hit_low]
        upper_k[live[hit_up]] = k
    def at(k, values, missing):
        ok = k > 0
        out = np.full(n, missing, dtype=object)
        out[ok] = values[start[ok] + k[ok] - 1]
        return out
    one = np.where(count > 0, 1, 0)
    return {
        "n_future": count, "first_t": at(one, bar_t, None), "last_t": at(count, bar_t, None),
        "last_close": at(count, close, None), "max_gap": np.where(count > 0, gap, None),
        "max_high": max_high, "min_low": min_low,
        "lower_t": at(lower_k, bar_t, None), "upper_t": at(upper_k, bar_t, None),
        "lower_bar": np.where(lower_k > 0, lower_k, None), "upper_bar": np.where(upper_k > 0, upper_k, None),
        "high_at_lower": high_at, "max_high_before_lower": high_before, "min_low_before_upper": low_before,
    }


def forward_path(signals: DataFrame, bars: DataFrame, keys: Sequence[str], *, id_cols: Sequence[str],
                 signal_t: str, until: Column | str, lower: Column | str, upper: Column | str,
                 horizon_seconds: int, bar_t: str = "feature_time",
                 high: str = "high", low: str = "low", close: str = "close",
                 span: int = 14 * DAY) -> DataFrame:
    """Follow each signal over the bars in ``(signal_t, until]``.

    ``lower``/``upper`` are price levels; the first bar whose low (high)
    reaches them is reported with its time and its bar number.  No signal may
    look further ahead than ``horizon_seconds``, which bounds the halo.
    Output: ``keys``, ``id_cols`` and ``PATH_FIELDS``.
    """
    ids = [c for c in dict.fromkeys([*keys, *id_cols])]
    sig = time_slices(signals.select(
        *ids, F.col(signal_t).alias("_st"), micros(signal_t).alias("_s"), micros(until).alias("_u"),
        as_col(lower).cast("double").alias("_lo"), as_col(upper).cast("double").alias("_up")), "_st", span)
    path = time_slices(bars.select(
        *keys, F.col(bar_t).alias("_bt"), micros(bar_t).alias("_b"), F.col(high).cast("double").alias("_h"),
        F.col(low).cast("double").alias("_l"), F.col(close).cast("double").alias("_c")),
        "_bt", span, 0, horizon_seconds)
    sig, path = sig.drop("_st", "_own"), path.drop("_bt", "_own")
    fields = [f for f in sig.schema.fields if f.name in ids]
    schema = T.StructType(fields + T.StructType.fromDDL(
        ", ".join(f"{n} {t}" for n, t in PATH_FIELDS.items())).fields)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty:
            return pd.DataFrame({f.name: [] for f in schema.fields})
        right = right.sort_values("_b")
        found = _scan(left["_s"].to_numpy(), left["_u"].to_numpy(), left["_lo"].to_numpy(),
                      left["_up"].to_numpy(), right["_b"].to_numpy(), right["_h"].to_numpy(),
                      right["_l"].to_numpy(), right["_c"].to_numpy())
        out = left[ids].reset_index(drop=True)
        for name, kind in PATH_FIELDS.items():
            out[name] = pd.array(found[name], dtype="Int64" if kind == "bigint" else "Float64")
        return out

    by = [*keys, SLICE]
    result = sig.groupBy(*by).cogroup(path.groupBy(*by)).applyInPandas(run, schema)
    return result.withColumns({c: from_micros(c) for c in TIME_FIELDS})
