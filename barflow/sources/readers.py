"""File sources with explicit schemas: bars, option chains, daily series, trade events, instruments, ticks.

Every source delivers NULL for missing, NaN and infinite numbers; bad lines are kept apart and can be counted.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barflow.functions.numeric import null_if_bad
from barflow.plans.bars import keep_first, keep_last

C = F.col
PRICES = ("open", "high", "low", "close")
BAR_SCHEMA = "symbol STRING, datetime STRING, open STRING, high STRING, low STRING, close STRING, volume STRING"
CHAIN_SCHEMA = "strike STRING, option_type STRING, open_int STRING, chg_oi STRING, contracts STRING, close STRING"
EVENT_SCHEMA = """event STRING, timestamp_signal STRING, timestamp_exit STRING, session_trade_number BIGINT, symbol STRING, option_type STRING,
 strike BIGINT, direction STRING, spot_at_entry DOUBLE, entry_price DOUBLE, exit_price DOUBLE, contracts INT, regime STRING, regime_conf DOUBLE,
 model_confidence DOUBLE, stop_price DOUBLE, take_profit DOUBLE, minute_of_day INT, session_regime STRING, session_regime_score DOUBLE,
 exit_reason STRING, pnl_pts DOUBLE, reason STRING, detail STRING, close DOUBLE, features_snapshot MAP<STRING, DOUBLE>, _corrupt_record STRING"""
INSTRUMENT_SCHEMA = "symbol STRING, token STRING, exch_seg STRING, name STRING"


def number(name: str):
    return null_if_bad(F.expr(f"try_cast({name} AS DOUBLE)"))


def market_timestamp(text, zone: str | None):
    """Text with or without an offset as naive market time: an offset is converted, plain text is taken as it is."""
    offset = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    plain = F.try_to_timestamp(F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", ""))
    if zone is None:
        return plain.cast("timestamp_ntz")
    # The offset is turned into minutes and taken away, so the result does not depend on the session time zone.
    sign = F.when(F.substring(F.regexp_extract(text, r"([+-])\d{2}:?\d{2}$", 1), 1, 1) == "-", -1).otherwise(1)
    hh, mm = (F.coalesce(F.regexp_extract(text, p, 1).try_cast("int"), F.lit(0)) for p in (r"[+-](\d{2}):?\d{2}$", r"[+-]\d{2}:?(\d{2})$"))
    utc = F.timestamp_seconds(F.unix_seconds(plain) - sign * (hh * 3600 + mm * 60))
    naive = plain.cast("timestamp_ntz")
    return F.when(offset, F.convert_timezone(F.lit("UTC"), F.lit(zone), utc.cast("timestamp_ntz"))).otherwise(naive)


def read_bars(spark: SparkSession, path: str, zone: str | None = "Asia/Kolkata", clean: bool = True) -> DataFrame:
    """OHLCV CSV files, one row per (symbol, dt); of repeated times the later row of the file wins."""
    raw = spark.read.schema(BAR_SCHEMA).csv(path, header=True, mode="PERMISSIVE")
    rows = raw.select("symbol", market_timestamp(C("datetime"), zone).alias("dt"), *[number(c).alias(c) for c in (*PRICES, "volume")],
                      F.struct(C("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i")).alias("_seq"))
    rows = rows.where(C("symbol").isNotNull() & C("dt").isNotNull())
    if clean:
        from barflow.plans.bars import drop_null_ohlc, valid_ohlc
        rows = drop_null_ohlc(valid_ohlc(rows))
    return keep_last(rows, ["symbol", "dt"], "_seq").drop("_seq")


def require_rows(df: DataFrame, minimum: int) -> DataFrame:
    """The frame with its row count ``n_rows`` and whether that is below ``minimum`` (``too_few``); no row is left out."""
    n = df.agg(F.count(F.lit(1)).alias("n_rows"))
    return df.crossJoin(F.broadcast(n)).withColumn("too_few", C("n_rows") < minimum)  # one row


def read_option_chain(spark: SparkSession, path: str) -> DataFrame:
    """A folder of one CSV per day, the trade date taken from the file name; files without a date are left out."""
    raw = spark.read.schema(CHAIN_SCHEMA).csv(path, header=True, mode="PERMISSIVE", recursiveFileLookup=True)
    day = F.regexp_extract(C("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})[^/]*(?:/[^/]*)?\.csv", 1)
    out = raw.select(F.try_to_timestamp(F.nullif(day, F.lit(""))).cast("date").alias("trade_date"), number("strike").alias("strike"), "option_type",
                     *[number(c).alias(c) for c in ("open_int", "chg_oi", "contracts", "close")])
    return out.where(C("trade_date").isNotNull())


def read_daily_series(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A daily CSV keyed by date; the first row of a date is kept."""
    schema = ", ".join(["date STRING", *[f"{c} STRING" for c in columns]])
    raw = spark.read.schema(schema).csv(path, header=True, mode="PERMISSIVE")
    rows = raw.select(F.expr("try_cast(date AS DATE)").alias("date"), *[number(c).alias(c) for c in columns],
                      F.struct(C("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i")).alias("_seq"))
    return keep_first(rows.where(C("date").isNotNull()), ["date"], "_seq").drop("_seq")


def read_trade_events(spark: SparkSession, path: str, keep_bad: bool = False) -> DataFrame:
    """JSON-lines logs; the session date comes from the file name, blank and malformed lines are dropped unless asked for."""
    rows = (spark.read.schema(EVENT_SCHEMA).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_corrupt_record", recursiveFileLookup=True)
            .withColumn("file_date", F.try_to_timestamp(F.nullif(F.regexp_extract(C("_metadata.file_path"), r"(\d{4}-\d{2}-\d{2})", 1), F.lit(""))).cast("date")))
    bad = C("_corrupt_record").isNotNull()
    return rows if keep_bad else rows.where(~bad).drop("_corrupt_record")


def read_instruments(spark: SparkSession, path: str, segment: str | None = None, name: str | None = None) -> DataFrame:
    """Instrument master (a JSON array), filtered to a segment and a name."""
    rows = spark.read.schema(INSTRUMENT_SCHEMA).json(path, multiLine=True)
    if segment:
        rows = rows.where(C("exch_seg") == segment)
    return rows.where(C("name") == name) if name else rows


def tick_price(first: str = "last_traded_price", other: str = "ltp"):
    """Price of a tick message, sent in hundredths under one of two names."""
    return F.coalesce(C(first), C(other)) / 100.0


def stream_ticks(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Tick messages (JSON files) as a stream of symbol, ts, seq, price."""
    reader = spark.readStream.schema("symbol STRING, ts TIMESTAMP, seq BIGINT, last_traded_price DOUBLE, ltp DOUBLE")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path).select("symbol", "ts", "seq", tick_price().alias("price")).where(C("price").isNotNull())
