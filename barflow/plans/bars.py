"""Bars from ticks, bar hygiene, clocks and sessions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.operators.rolling import flag

C = F.col


def ohlcv_bars(ticks: DataFrame, width: str = "1 hour", *, seq: str = "seq", volume: Column | None = None) -> DataFrame:
    """OHLCV per (symbol, window).  Partial aggregation runs before the shuffle, so a hot symbol stays cheap."""
    key = F.struct("ts", seq)
    agg = (ticks.groupBy("symbol", F.window("ts", width).alias("_w"))
           .agg(F.min_by("price", key).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"),
                F.max_by("price", key).alias("close"),
                (F.sum(volume) if volume is not None else F.count(F.lit(1))).cast("double").alias("volume")))
    return agg.select("symbol", C("_w.start").alias("dt"), "open", "high", "low", "close", "volume")


def resample(bars: DataFrame, width: str = "1 day") -> DataFrame:
    """Coarser bars from finer ones."""
    agg = (bars.groupBy("symbol", F.window("dt", width).alias("_w"))
           .agg(F.min_by("open", "dt").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
                F.max_by("close", "dt").alias("close"), F.sum("volume").alias("volume")))
    return agg.select("symbol", C("_w.start").alias("dt"), "open", "high", "low", "close", "volume")


def refresh_last_bar(bars: DataFrame, price: DataFrame) -> DataFrame:
    """Fold a live price (symbol, price) into the latest bar of each symbol: close moves, high and low extend."""
    last = bars.groupBy("symbol").agg(F.max("dt").alias("_last"))
    out = bars.join(last.join(price, "symbol", "left"), "symbol", "left")
    live = (C("dt") == C("_last")) & C("price").isNotNull()
    return out.select("symbol", "dt", "open",
                      F.when(live, F.greatest("high", "price")).otherwise(C("high")).alias("high"),
                      F.when(live, F.least("low", "price")).otherwise(C("low")).alias("low"),
                      F.when(live, C("price")).otherwise(C("close")).alias("close"), "volume")


def valid_ohlc(bars: DataFrame) -> DataFrame:
    """Drop bars whose prices contradict each other or are not positive; NULL prices are not judged here."""
    bad = ((C("high") < C("open")) | (C("high") < C("close")) | (C("low") > C("open")) | (C("low") > C("close"))
           | (C("high") < C("low")) | (C("high") <= 0) | (C("low") <= 0))
    return bars.where(~F.coalesce(bad, F.lit(False)))


def drop_null_ohlc(bars: DataFrame) -> DataFrame:
    return bars.na.drop(subset=["open", "high", "low", "close"])


def keep_last(df: DataFrame, keys: list[str], seq: str | list[str]) -> DataFrame:
    """One row per key, the one with the highest sequence.  Partial max per task before the shuffle."""
    return _pick(df, keys, seq, F.max_by)


def keep_first(df: DataFrame, keys: list[str], seq: str | list[str]) -> DataFrame:
    return _pick(df, keys, seq, F.min_by)


def _pick(df, keys, seq, by):
    seq = [seq] if isinstance(seq, str) else seq
    rest = [c for c in df.columns if c not in keys]
    row = df.groupBy(*keys).agg(by(F.struct(*rest), F.struct(*seq)).alias("_r"))
    return row.select(*keys, *[C(f"_r.{c}").alias(c) for c in rest]).select(*df.columns)


def session_clock(bars: DataFrame, open_minute: int = 0, session_minutes: int = 375) -> DataFrame:
    """trade_date, minute_of_day, session_pct and the session flags, for a session opening at ``open_minute``."""
    minute = F.hour("dt") * 60 + F.minute("dt") - open_minute
    dow = F.weekday("dt")
    return bars.withColumns({
        "trade_date": F.to_date("dt"), "minute_of_day": minute.cast("int"),
        "session_pct": minute / F.lit(float(session_minutes)), "dow": dow.cast("double"),
        "is_expiry": flag(dow == 1), "session_open": flag(minute < 30), "session_pm": flag(minute > 270)})


def calendar_features(bars: DataFrame) -> DataFrame:
    dow = F.weekday("dt")
    return bars.withColumns({"day_of_week": dow.cast("double"), "is_monday": flag(dow == 0).cast("double"),
                             "is_friday": flag(dow == 4).cast("double"), "is_expiry_week": flag(dow <= 1).cast("double")})


def full_sessions(bars: DataFrame, min_bars: int = 300) -> DataFrame:
    """Keep sessions with at least ``min_bars`` bars: a small table of counts, joined back."""
    full = bars.groupBy("symbol", "trade_date").agg(F.count(F.lit(1)).alias("_n")).where(C("_n") >= min_bars)
    return bars.join(full.drop("_n"), ["symbol", "trade_date"], "left_semi")


def market_time(ts: Column, zone: str = "Asia/Kolkata") -> Column:
    """A UTC instant as naive market-local time."""
    return F.from_utc_timestamp(ts, zone).cast("timestamp_ntz")


def fill_grid(bars: DataFrame, step: str = "1 hour", within_session: bool = True) -> DataFrame:
    """Insert the missing grid points and carry the previous bar into them.

    Gaps are expanded from each bar up to the next one, so only real gaps make rows and nothing is joined.  The next
    bar is looked up inside the session; ``within_session=False`` also spans the nights, through a per-session table.
    """
    day = bars.withColumn("_d", F.to_date("dt"))
    nxt = F.lead("dt").over(Window.partitionBy("symbol", "_d").orderBy("dt"))
    if within_session:
        out = day.withColumn("_next", nxt)
    else:
        first = day.groupBy("symbol", "_d").agg(F.min("dt").alias("_first"))
        ahead = first.select("symbol", "_d", F.lead("_first").over(Window.partitionBy("symbol").orderBy("_d")).alias("_after"))
        out = day.join(ahead, ["symbol", "_d"], "left").withColumn("_next", F.coalesce(nxt, "_after"))
    stop = F.coalesce(C("_next") - F.expr(f"INTERVAL {step}"), C("dt"))
    out = out.withColumn("_t", F.explode(F.sequence(C("dt"), F.greatest(C("dt"), stop), F.expr(f"INTERVAL {step}"))))
    return (out.withColumn("filled", flag(C("_t") != C("dt"))).withColumn("dt", C("_t"))
            .drop("_d", "_t", "_next", "_after"))


def merge_candles(history: DataFrame, fresh: DataFrame) -> DataFrame:
    """Upsert fresh candles over history: union, then the later source wins per (symbol, dt)."""
    both = (history.withColumn("_src", F.lit(0))
            .unionByName(fresh.withColumn("_src", F.lit(1)), allowMissingColumns=True))
    return keep_last(both, ["symbol", "dt"], "_src").drop("_src")


def last_rows(bars: DataFrame, n: int, bucket: str = "month") -> DataFrame:
    """The last n rows per symbol.  Buckets that cannot hold them are cut first, from a table of counts."""
    b = bars.withColumn("_b", F.date_trunc(bucket, "dt"))
    counts = b.groupBy("symbol", "_b").agg(F.count(F.lit(1)).alias("_n"))
    after = Window.partitionBy("symbol").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    live = counts.withColumn("_later", F.coalesce(F.sum("_n").over(after), F.lit(0))).where(C("_later") < n)
    cut = b.join(live.select("symbol", "_b", "_later"), ["symbol", "_b"])
    rank = F.row_number().over(Window.partitionBy("symbol", "_b").orderBy(F.desc("dt"))) + C("_later")
    return cut.withColumn("_r", rank).where(C("_r") <= n).drop("_b", "_later", "_r")
