"""Forward-looking labels.  A row's future is an array of the next bars (at most fifteen), taken from a forward frame in
chunks that carry their look-ahead rows; there is no self-join."""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow import constants as k
from barflow.operators.chunks import CHUNK, chunked
from barflow.operators.rolling import Roller, flag
from barflow.operators.scans import running

C = F.col


def _future(n: int, within_session: bool):
    keys = ["symbol", CHUNK] + (["trade_date"] if within_session else [])
    return Window.partitionBy(*keys).orderBy("dt").rowsBetween(1, n)


def lagged_regime(df: DataFrame, compat: bool = False, bucket: str = "day", rows_per_chunk: int | None = None) -> DataFrame:
    """``known_regime``: the regime of the previous session (default), or of the previous bar (``compat``)."""
    if compat:
        w = Roller()
        return chunked(df, lambda d: d.withColumn("known_regime", F.coalesce(w.lag("regime"), F.lit(k.RANGING))), 1, bucket=bucket,
                       rows_per_chunk=rows_per_chunk)
    day = df.groupBy("symbol", "trade_date").agg(F.max_by("regime", "dt").alias("_r"))
    prev = day.select("symbol", "trade_date", F.lag("_r").over(Window.partitionBy("symbol").orderBy("trade_date")).alias("known_regime"))
    return (df.join(prev, ["symbol", "trade_date"], "left")
            .withColumn("known_regime", F.coalesce("known_regime", F.lit(k.RANGING))))


def barrier_width(horizon: int) -> tuple[Column, Column]:
    """ATR multiple and upper-barrier factor by the regime known beforehand."""
    reg = C("known_regime")
    mult = (F.when(reg == k.CRISIS, k.TB_MULT_CRISIS[horizon]).when(reg == k.TRENDING, k.TB_MULT_TRENDING[horizon])
            .otherwise(k.TB_MULT_RANGING[horizon]))
    return mult, F.when(reg == k.TRENDING, k.TB_TRENDING_UPPER).otherwise(1.0)


def triple_barrier(df: DataFrame, horizon: int, *, bars_per_day: int = 375, bars: int | None = None, within_session: bool = False,
                   bucket: str = "day", rows_per_chunk: int | None = None) -> DataFrame:
    """Add label, ev, fut_ret and barrier (suffix ``_{horizon}m``).  Needs atr_14 and known_regime; ``iv`` is optional.

    The first bar whose high reaches the upper barrier or whose low reaches the lower one decides; the upper is looked at
    first.  Rows without ``bars`` bars after them have no label.
    """
    base = bars or k.TB_BARS[horizon]
    longest = max(max(1, base // 2), min(int(base * 1.25), int(base * 1.5)))
    w = Roller()
    mean = df.groupBy("symbol").agg(F.avg("atr_14").alias("_atr_all"))

    def baseline(d):
        return d.withColumn("_atr_base", w.roll(F.avg, "atr_14", 20 * bars_per_day, bars_per_day))
    out = chunked(df, baseline, 20 * bars_per_day, bucket=bucket, rows_per_chunk=rows_per_chunk).join(mean, "symbol", "left")
    ratio = C("atr_14") / (F.coalesce("_atr_base", "_atr_all") + 1e-9)
    lo, hi = max(1, base // 2), int(base * 1.5)

    def bound(x):
        return max(lo, min(int(x), hi))
    steps = F.when(ratio > 1.5, bound(base * 0.75)).when(ratio < 0.7, bound(base * 1.25)).otherwise(base)
    mult, upper = barrier_width(horizon)
    atr_width = mult * C("atr_14")
    width = atr_width
    if "iv" in df.columns:
        by_iv = C("close") * C("iv") * F.sqrt("_steps") * (1 / math.sqrt(bars_per_day + 1e-9)) * mult
        width = F.when(C("iv") > 0, by_iv).otherwise(atr_width)
    out = out.withColumn("_steps", steps).withColumn("_width", width)
    out = out.withColumns({"_tp": C("close") + C("_width") * upper, "_sl": C("close") - C("_width")})

    def ahead(d):
        nxt = F.collect_list(F.struct("high", "low", "close")).over(_future(longest, within_session))
        last = F.lead("close", base).over(Window.partitionBy(*(["symbol", CHUNK] + (["trade_date"] if within_session else []))).orderBy("dt"))
        return d.withColumn("_next", F.slice(nxt, F.lit(1), C("_steps"))).withColumn("_full", last.isNotNull())
    out = chunked(out, ahead, longest + 1, forward=True, bucket=bucket, rows_per_chunk=rows_per_chunk)
    tp, sl = C("_tp"), C("_sl")
    codes = F.transform("_next", lambda x: F.when(x["high"] >= tp, 1).when(x["low"] <= sl, -1).otherwise(0))
    usable = C("_full") & (C("close") > 0) & (C("_width") > 0)
    out = out.withColumn("_codes", F.when(usable, codes))
    at = F.array_position(F.transform("_codes", lambda c: c != 0), True)
    out = out.withColumn("_at", F.when(at > 0, at.cast("int")))
    out = out.withColumns({"_side": F.get("_codes", C("_at") - 1), "_exit": F.get("_next", C("_at") - 1)["close"]})
    ret = (C("_exit") - C("close")) / C("close") * 100
    moved = F.abs(C("_exit") - C("close")) / (C("close") * 0.01 + 1e-9) / (C("_width") / C("close") * 100 + 1e-9)
    side = F.when(C("_side") == 1, 1.0).when(C("_side") == -1, (1.0 - k.TB_STOP_TIME_DECAY * (C("_steps") / base)) * 0.85)
    ev = F.exp(-k.TB_VELOCITY_LAMBDA * moved) * side
    s = f"_{horizon}m"
    return out.withColumns({f"ev{s}": ev, f"fut_ret{s}": ret, f"label{s}": F.tanh(ret / (k.TB_MIN_MOVE_PCT + 1e-9)) * ev,
                            f"barrier{s}": F.coalesce("_side", F.lit(0))}).drop(
        "_atr_base", "_atr_all", "_steps", "_width", "_tp", "_sl", "_next", "_full", "_codes", "_at", "_side", "_exit")


def fixed_barrier(df: DataFrame, horizon: int = 6, upper_pct: float = 0.005, lower_pct: float = 0.003, *, within_session: bool = False,
                  bucket: str = "day", rows_per_chunk: int | None = None) -> DataFrame:
    """1 when +upper comes before -lower within the horizon (closes only), with which barrier, when, and the excursions."""
    def ahead(d):
        return d.withColumn("_next", F.collect_list("close").over(_future(horizon, within_session)))
    out = chunked(df, ahead, horizon, forward=True, bucket=bucket, rows_per_chunk=rows_per_chunk)
    up, down = C("close") * (1 + upper_pct), C("close") * (1 - lower_pct)
    usable = (F.size("_next") >= horizon) & (C("close") > 0)
    codes = F.transform("_next", lambda p: F.when(p >= up, 1).when(p <= down, -1).otherwise(0))
    out = out.withColumn("_codes", F.when(usable, codes))
    at = F.array_position(F.transform("_codes", lambda c: c != 0), True)
    out = out.withColumn("_at", F.when(C("_codes").isNotNull(), F.when(at > 0, at.cast("int")).otherwise(horizon)))
    out = out.withColumn("_side", F.get("_codes", C("_at") - 1))
    moves = F.transform(F.slice("_next", F.lit(1), C("_at")), lambda p: (p - C("close")) / (C("close") + 1e-9) * 100)
    known = C("_at").isNotNull()
    return out.withColumns({
        "label": F.when(known, flag(C("_side") == 1)),
        "barrier_hit": F.when(known, F.when(C("_side") == 1, "upper").when(C("_side") == -1, "lower").otherwise("time")),
        "bars_to_exit": C("_at"), "max_excursion": F.when(known, F.greatest(F.lit(0.0), F.array_max(moves))),
        "max_adverse": F.when(known, F.least(F.lit(0.0), F.array_min(moves)))}).drop("_next", "_codes", "_at", "_side")


def label_stats(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    n = F.count(label)
    return df.groupBy(*by).agg(n.alias("total"), F.coalesce(F.sum(C(label)), F.lit(0)).cast("bigint").alias("positive"),
                               F.count(F.when(C(label) == 0, 1)).alias("negative"),
                               F.when(n > 0, F.avg(C(label).cast("double"))).otherwise(0.0).alias("positive_rate"))


def meta_label(proba: Column, truth: Column) -> Column:
    """1 when the held-out prediction was right."""
    return F.when(proba.isNotNull(), flag(F.when(proba > 0.5, 1).otherwise(0) == truth))


def excursions(marks: DataFrame, keys=("trade_no",), order=("ts",), bucket: str | int = "day") -> DataFrame:
    """Running best and worst move of each trade so far, floored at zero, for trades of any length: two-level scans over parts of a trade."""
    out = running(marks, maxes={"_best": C("move"), "_worst": -C("move")}, keys=list(keys), order=list(order), bucket=bucket)
    return out.withColumns({"mfe": F.greatest(F.lit(0.0), C("_best")), "mae": F.least(F.lit(0.0), -C("_worst"))}).drop("_best", "_worst")
