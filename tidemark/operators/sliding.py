"""Linear-time sliding frames over long row windows.

A stock sliding frame re-reads its rows for every output row.  For frames of
thousands of rows this module uses running values instead: block prefix and
suffix for min/max, differences of running sums for count, mean and deviation.
Rows must carry a gapless position and be spread by ``row_blocks`` with a halo
of at least the frame width.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from tidemark.operators.ordered import SLICE


def sliding_extremes(df: DataFrame, keys: Sequence[str], pos: str, values: dict[str, str],
                     width: int) -> DataFrame:
    """``{prefix}_min`` and ``{prefix}_max`` of each value over the last ``width`` rows."""
    by, cell = f"{', '.join(keys)}, {SLICE}", f"_cell_{width}"
    up = f"OVER (PARTITION BY {by}, {cell} ORDER BY {pos} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    down = f"OVER (PARTITION BY {by}, {cell} ORDER BY {pos} DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    each = [(p, v, f) for p, v in values.items() for f in ("min", "max")]
    df = df.selectExpr("*", f"{pos} DIV {width} AS {cell}")
    df = df.selectExpr("*", *[f"{f}({v}) {up} AS _up_{p}_{f}" for p, v, f in each])
    df = df.selectExpr("*", *[f"{f}({v}) {down} AS _dn_{p}_{f}" for p, v, f in each])
    # The frame is the head of this cell plus the tail of the previous one.
    df = df.selectExpr("*", *[f"lag(_dn_{p}_{f}, {width - 1}) OVER (PARTITION BY {by} ORDER BY {pos}) AS _lag_{p}_{f}"
                              for p, v, f in each])
    pick = {"min": "least", "max": "greatest"}
    inner = f"pmod({pos} + 1, {width}) <> 0"
    out = [f"{pick[f]}(_up_{p}_{f}, CASE WHEN {inner} THEN _lag_{p}_{f} END) AS {p}_{f}" for p, v, f in each]
    return df.selectExpr("*", *out).drop(cell, *[f"_{x}_{p}_{f}" for p, v, f in each for x in ("up", "dn", "lag")])


def sliding_moments(df: DataFrame, keys: Sequence[str], pos: str, value: str,
                    widths: Sequence[int], prefix: str) -> DataFrame:
    """``{prefix}_{w}_n``, ``_avg`` and ``_std`` (sample) over the last ``w`` rows.

    Values are centred on the first value seen in the block, which keeps the
    running sums small against cancellation.
    """
    whole = f"OVER (PARTITION BY {', '.join(keys)}, {SLICE} ORDER BY {pos}"
    run = f"{whole} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    df = df.selectExpr("*", f"first({value}, true) {run} AS _c")
    df = df.selectExpr("*", f"{value} - _c AS _d")
    df = df.selectExpr("*", f"count(_d) {run} AS _s0", f"coalesce(sum(_d) {run}, 0D) AS _s1",
                       f"coalesce(sum(_d * _d) {run}, 0D) AS _s2")
    df = df.selectExpr("*", *[f"_s{i} - coalesce(lag(_s{i}, {w}) {whole}), 0) AS _f{i}_{w}"
                              for w in widths for i in range(3)])
    out = []
    for w in widths:
        n, s1, s2 = (f"_f{i}_{w}" for i in range(3))
        var = f"greatest({s2} - {s1} * try_divide({s1}, {n}), 0D)"
        out += [f"{n} AS {prefix}_{w}_n", f"_c + try_divide({s1}, {n}) AS {prefix}_{w}_avg",
                f"CASE WHEN {n} > 1 THEN sqrt(try_divide({var}, {n} - 1)) END AS {prefix}_{w}_std"]
    return df.selectExpr("*", *out).drop("_c", "_d", "_s0", "_s1", "_s2",
                                         *[f"_f{i}_{w}" for w in widths for i in range(3)])
