"""Headline queries, timed on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("a04_ohlcv_bars", "w12_rsi", "w18_dmi_adx", "w11_ema", "w21_session_vwap", "w42_trend_pack", "w44_fracdiff", "j01_asof_ticks", "j12_position_bars",
            "a02_option_chain_daily", "l01_triple_barrier_5m", "g09_swing_regime", "b01_gate_funnel_v4", "b07_trade_ledger", "b09_exit_replay",
            "b12_risk_audit_v5", "a08_backtest_metrics", "w47_running_drawdown", "f03_price_quotes", "q01_supertrend", "r02_stream_bars")


def main() -> None:
    import tempfile

    from pyspark.sql import SparkSession

    from barflow.catalog import all_queries
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus)
             .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
             .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "8g").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = all_queries(), {}
    for name in HEADLINE:
        best = None
        for _ in range(runs):
            start = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - start)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
