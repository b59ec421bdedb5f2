"""Tick-level statistics: last hundred ticks, order-flow imbalance, latency."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow import constants as k
from barflow.operators.chunks import CHUNK, chunked

C = F.col
ORDER = ("ts", "seq")


def _window():
    return Window.partitionBy("symbol", CHUNK).orderBy(*ORDER)


def tick_stats(ticks: DataFrame, n: int = 100, bucket: str = "hour", rows_per_chunk: int | None = None) -> DataFrame:
    """Count, latest, high, low and range of the last n ticks."""
    w = _window().rowsBetween(-(n - 1), 0)

    def run(d):
        out = d.withColumns({"n": F.count(F.lit(1)).over(w), "latest": C("price"), "high": F.max("price").over(w), "low": F.min("price").over(w)})
        return out.withColumn("range", C("high") - C("low"))
    return chunked(ticks, run, n - 1, order="ts", bucket=bucket, rows_per_chunk=rows_per_chunk)


def tick_direction(ticks: DataFrame, bucket: str = "hour", rows_per_chunk: int | None = None) -> DataFrame:
    """Sign of the change from the previous tick of the symbol."""
    def run(d):
        return d.withColumn("direction", F.signum(C("price") - F.lag("price").over(_window())))
    return chunked(ticks, run, 1, order="ts", bucket=bucket, rows_per_chunk=rows_per_chunk)


def order_flow(ticks: DataFrame, width: str = "1 minute", bucket: str = "hour", rows_per_chunk: int | None = None) -> DataFrame:
    """Share of up ticks among moving ticks per window, one half when nothing moved."""
    t = tick_direction(ticks, bucket, rows_per_chunk)
    agg = t.groupBy("symbol", F.window("ts", width).alias("_w")).agg(F.count(F.when(C("direction") > 0, 1)).alias("up_ticks"), F.count(F.when(C("direction") < 0, 1)).alias("down_ticks"))
    moved = C("up_ticks") + C("down_ticks")
    return agg.select("symbol", C("_w.start").alias("dt"), "up_ticks", "down_ticks", F.when(moved > 0, C("up_ticks") / moved).otherwise(0.5).alias("imbalance"))


def latency_median(ticks: DataFrame, n: int = k.LATENCY_WINDOW, bucket: str = "hour", rows_per_chunk: int | None = None) -> DataFrame:
    """Median of the last n lags and whether it is still acceptable."""
    def run(d):
        out = d.withColumn("_l", F.array_sort(F.collect_list("lag_ms").over(_window().rowsBetween(-(n - 1), 0))))
        size = F.size("_l")
        lo, hi = F.get("_l", F.floor((size - 1) / 2).cast("int")), F.get("_l", F.floor(size / 2).cast("int"))
        return out.withColumn("median_lag_ms", (lo + hi) / 2).withColumn("acceptable", C("median_lag_ms") < k.LATENCY_HALT_MS).drop("_l")
    return chunked(ticks, run, n - 1, order="ts", bucket=bucket, rows_per_chunk=rows_per_chunk)
