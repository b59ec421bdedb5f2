"""Streaming forms of bars, order flow, duplicates, lookups and late rows."""
from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from barflow.operators.stage import materialize, shared_folder
from barflow.plans.bars import keep_last
from barflow.streaming.processors import (BarValidator, Heartbeat, LastFinished, LatencyMonitor, RecentTicks, RegimeConfirmer, RepeatGuard, SessionState,
                                          TickDirection, keyed)

C = F.col
SLICE_ROWS = 1 << 20
LEAST_SLICES = 3
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def configure(spark: SparkSession) -> None:
    """State that is larger than memory lives in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def stream_bars(ticks: DataFrame, width: str = "1 minute", lateness: str = "10 seconds") -> DataFrame:
    """Bars of closed windows, in append mode; ``ts`` must be a zoned timestamp (watermarks reject naive ones)."""
    key = F.struct("ts", "seq")
    agg = (ticks.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", width).alias("_w"))
           .agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", key).alias("close"),
                F.count(F.lit(1)).cast("double").alias("volume")))
    return agg.select("symbol", C("_w.start").alias("dt"), "open", "high", "low", "close", "volume")


def sliding_stats(ticks: DataFrame, width: str = "5 minutes", slide: str = "1 minute", lateness: str = "10 seconds") -> DataFrame:
    """Count, high, low and range in sliding time windows."""
    agg = ticks.withWatermark("ts", lateness).groupBy("symbol", F.window("ts", width, slide).alias("_w")).agg(
        F.count(F.lit(1)).alias("n"), F.max("price").alias("high"), F.min("price").alias("low"))
    return agg.select("symbol", C("_w.start").alias("start"), "n", "high", "low", (C("high") - C("low")).alias("range"))


def tick_directions(ticks: DataFrame) -> DataFrame:
    return keyed(ticks, TickDirection())


def validated_bars(bars: DataFrame, **limits) -> DataFrame:
    """Bars judged in order; ``limits`` are those of ``BarChecker``."""
    return keyed(bars, BarValidator(**limits))


def confirmed_regimes(readings: DataFrame) -> DataFrame:
    return keyed(readings, RegimeConfirmer())


def recent_ticks(ticks: DataFrame, n: int = 100) -> DataFrame:
    return keyed(ticks, RecentTicks(n))


def edge_ticks(width_us: int, most: int = 1 << 17) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Of the ticks of a task, the first and the last of each symbol and span of ``width_us``. No silence of that length lies between ticks of one span."""
    def thin(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept = None
        for pdf in frames:
            pdf = (pdf if kept is None else pd.concat([kept, pdf])).sort_values(["symbol", "us", "seq"], kind="stable")
            span = pdf["us"] // width_us
            first = (pdf["symbol"] != pdf["symbol"].shift()) | (span != span.shift())
            kept = pdf[first | first.shift(-1, fill_value=True)]
            if len(kept) > most:
                yield kept
                kept = None
        if kept is not None:
            yield kept
    return thin


def silent_symbols(ticks: DataFrame, limit: Column, lateness: str = "10 seconds", least_seconds: float | None = None) -> DataFrame:
    """Silences beyond ``limit`` seconds (a column of the tick before the silence): symbol, ts, silent_seconds; NULL where it has not ended yet.

    Where no limit is below ``least_seconds``, only the ticks at the edges of spans of that length go to a symbol's state: the others neither begin nor end a silence.
    """
    rows = ticks.select("symbol", "seq", F.unix_micros("ts").alias("us"), (limit.cast("double") * 1e6).cast("long").alias("limit_us"))
    if least_seconds:
        rows = rows.mapInPandas(edge_ticks(int(least_seconds * 1e6)), rows.schema)
    rows = rows.withColumn("ts", F.timestamp_micros("us"))
    found = keyed(rows.withWatermark("ts", lateness), Heartbeat(), "EventTime")
    return found.select("symbol", F.timestamp_micros("us").alias("ts"), (C("silent_us") / 1e6).alias("silent_seconds"))


def session_values(bars: DataFrame, ttl_seconds: float = 86400) -> DataFrame:
    """Values that restart with every session of a symbol; the state of a past session expires."""
    return keyed(bars.select("symbol", "trade_date", "dt", "open", "high", "low"), SessionState(ttl_seconds), "ProcessingTime", "symbol", "trade_date")


def latencies(ticks: DataFrame, **limits) -> DataFrame:
    return keyed(ticks.select("symbol", "ts", "seq", "lag_ms"), LatencyMonitor(**limits))


def without_repeats(signals: DataFrame, within: str = "30 seconds") -> DataFrame:
    """First signal of each hash; repeats inside the watermark are dropped."""
    return signals.withWatermark("ts", within).dropDuplicatesWithinWatermark(["hash"])


def marked_repeats(signals: DataFrame, seconds: float = 30, lateness: str = "10 seconds") -> DataFrame:
    """Every signal, and whether it is kept: repeats of a kept one of the same hash within ``seconds`` are not."""
    rows = signals.select("seq", "hash", "ts", F.unix_micros("ts").alias("us")).withWatermark("ts", lateness)
    return keyed(rows, RepeatGuard(seconds), "EventTime", "hash").withColumn("ts", F.timestamp_micros("us")).drop("us")


def with_static(stream: DataFrame, table: DataFrame, on: list[str]) -> DataFrame:
    """Stream-static left join: daily, chain or training tables attached to each row."""
    return stream.join(table, on, "left")


def with_higher_timeframe(bars: DataFrame, htf: DataFrame, width: str, column: str) -> DataFrame:
    """Every bar with ``column`` of the latest higher-timeframe bar that has ended by then: the as-of join as a stream.

    ``htf`` carries ``htf_dt`` (bar start). Its rows take effect at their end, and must arrive no later than the bars after it.
    """
    ends = htf.select("symbol", (C("htf_dt") + F.expr(f"INTERVAL {width}")).alias("dt"), F.lit(0).alias("is_bar"), C(column).cast("double").alias("value"))
    both = bars.select("symbol", "dt", F.lit(1).alias("is_bar"), F.lit(None).cast("double").alias("value")).unionByName(ends)
    return keyed(both, LastFinished()).withColumnRenamed("value", column)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_upserted(spark: SparkSession, path: str, by: str = "trade_date") -> DataFrame | None:
    """The table that :func:`upsert_into` keeps: of every date the version that was committed last. None before the first commit."""
    if not exists(spark, f"{path}/commits"):
        return None
    current = spark.read.parquet(f"{path}/commits").groupBy(by).agg(F.max("version").alias("version"))
    return spark.read.parquet(f"{path}/rows").join(current, [by, "version"], "left_semi").drop("version")


def upsert_into(path: str, keys=("symbol", "dt"), by: str = "trade_date") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: corrected rows replace stored ones.  Only the dates of the batch are rewritten.

    A batch writes a version of its dates beside the old one, then one small file that commits it; until then readers see the old version. A batch
    that was committed before a restart is not applied again, and one that failed half way is written anew under its own number.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark, done = batch.sparkSession, f"{path}/commits/version={batch_id}"
        if exists(spark, f"{done}/_SUCCESS"):
            return
        fresh = materialize(batch)
        both, stored = fresh.withColumn("_src", F.lit(1)), read_upserted(spark, path, by)
        days = fresh.select(by).distinct()
        if stored is not None:
            both = stored.join(days, by, "left_semi").withColumn("_src", F.lit(0)).unionByName(both, allowMissingColumns=True)
        merged = keep_last(both, list(keys), "_src").drop("_src")
        merged.write.mode("overwrite").partitionBy(by).parquet(f"{path}/rows/version={batch_id}")
        days.coalesce(1).write.mode("overwrite").parquet(done)
    return apply


def split_late(path: str, lateness_seconds: float, time: str = "ts", order: str = "seq") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function: a row that is older by more than the lateness than the newest row that arrived before it goes to a side table.

    ``order`` numbers the arrivals. The newest time seen is kept per batch, so it is carried from batch to batch and a repeated batch finds
    what it found before. Both tables are in ``rows``, the side table under ``late=true``.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark, seen = batch.sparkSession, f"{path}/seen"
        before = None
        if exists(spark, seen):
            before = spark.read.parquet(seen).where(C("batch") < batch_id).agg(F.max("newest")).first()[0]  # one number
        rows = materialize(batch.withColumns({"_us": F.unix_micros(C(time).cast("timestamp")), "_part": F.floor(C(order) / 65536)}))
        inner = Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        parts = rows.groupBy("_part").agg(F.max("_us").alias("_top"))  # a line for each 65,536 arrivals of the batch
        carried = F.max("_top").over(Window.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
        tagged = rows.join(parts.select("_part", carried.alias("_carried")), "_part")
        newest = F.greatest(F.max("_us").over(inner), C("_carried"), F.lit(before).cast("long"))
        late = F.coalesce(C("_us") < newest - int(lateness_seconds * 1_000_000), F.lit(False))
        tagged.withColumn("late", late).drop("_us", "_part", "_carried").write.mode("overwrite").partitionBy("late").parquet(f"{path}/rows/batch={batch_id}")
        top = rows.agg(F.greatest(F.max("_us"), F.lit(before).cast("long")).alias("newest"))
        top.coalesce(1).write.mode("overwrite").parquet(f"{seen}/batch={batch_id}")
    return apply


def run_in_slices(inputs: Sequence[tuple[DataFrame, str]], build: Callable[..., DataFrame], slice_rows: int = SLICE_ROWS,
                  each: Callable[[DataFrame, int], None] | None = None, trigger: dict | None = None) -> DataFrame | None:
    """Tables as streams that arrive in time order: slices of about ``slice_rows`` rows (of the first table) are written one after the other, and after
    each the query goes on from its checkpoint, so what a micro-batch holds does not grow with the tables.

    ``inputs`` are tables with the column they arrive by; ``build`` makes the query of their streams. Rows go to a table in the shared folder, or to ``each``.
    Queries with processing-time state (:func:`session_values`) always ask for one more batch, so they need ``trigger={"once": True}``.
    """
    spark = inputs[0][0].sparkSession
    base = f"{shared_folder(spark).rstrip('/')}/barflow-stream-{uuid.uuid4().hex}"

    def when(df: DataFrame, by: str) -> Column:
        return F.unix_micros(C(by).cast("timestamp")) if "timestamp" in dict(df.dtypes)[by] else C(by).cast("long")
    staged = [(materialize(df), by) for df, by in inputs]
    first, by = staged[0]
    slices = max(LEAST_SLICES, -(-first.count() // slice_rows))
    cuts = first.agg(F.percentile_approx(when(first, by), [i / slices for i in range(1, slices)], 10 * slices)).first()[0] or []
    # The tables are cut in one pass: a slice reads its own files, not the table again.
    sliced = []
    for j, (df, by) in enumerate(staged):
        df.withColumn("_slice", sum(((when(df, by) > c).cast("int") for c in cuts), F.lit(0))).write.partitionBy("_slice").parquet(f"{base}/cut{j}")
        sliced.append(spark.read.schema(StructType([*df.schema.fields, StructField("_slice", IntegerType())])).parquet(f"{base}/cut{j}"))
    for i in range(len(cuts) + 1):
        for j, df in enumerate(sliced):
            df.where(C("_slice") == i).drop("_slice").write.mode("append").parquet(f"{base}/in{j}")
        stream = build(*(spark.readStream.schema(df.schema).parquet(f"{base}/in{j}") for j, (df, _) in enumerate(staged)))
        out = stream.writeStream.option("checkpointLocation", f"{base}/_state").outputMode("append").trigger(**(trigger or {"availableNow": True}))
        query = out.foreachBatch(each).start() if each else out.format("parquet").start(f"{base}/rows")
        query.awaitTermination()
    return None if each else spark.read.schema(stream.schema).parquet(f"{base}/rows")


def run_available(df: DataFrame, path: str | None = None, mode: str = "append") -> DataFrame:
    """Process what is there, into a parquet table in the shared folder, and return it as a batch frame."""
    spark = df.sparkSession
    base = path or f"{shared_folder(spark).rstrip('/')}/barflow-stream-{uuid.uuid4().hex}"
    query = df.writeStream.format("parquet").option("checkpointLocation", f"{base}/_state").outputMode(mode).trigger(availableNow=True).start(f"{base}/rows")
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{base}/rows")
