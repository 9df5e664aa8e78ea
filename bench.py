"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR   data folder (default /root/testdata/sf0.1)
    BENCH_CPUS     local cores (default 8)
"""
from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = ("flagship_latest_scored", "join_align_5m", "join_asof_backward", "join_features_assemble", "feat_group_price", "label_v1_horizons",
            "label_triple_barrier", "win_sessionize_events", "met_row", "met_event", "met_psi_quantile", "ml_threshold_sweep", "win_best_runup",
            "win_pump_daily", "topk_universe_quota", "outcome_filter_tape", "score_stage", "norm_kline", "st_tumbling_bars", "st_cooldown", "feat_line_daily", "ind_line_atr", "met_line_row")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from tidemark.plans.catalog import QUERIES
    from tidemark.session import build_session, scratch_folder

    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.checkpoint.dir": scratch_folder(), "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.log.level": "ERROR",
        "spark.ui.showConsoleProgress": "false", "spark.python.sql.dataFrameDebugging.enabled": "false"})
    # start the JVM's and the Python workers' machinery outside the timings
    spark.range(1000).groupBy("id").applyInPandas(lambda p: p, "id long").count()
    QUERIES["feat_group_price"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
