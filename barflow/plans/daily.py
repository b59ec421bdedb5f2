"""Daily-bar, higher-timeframe and external-series feature packs, and how they are attached to finer bars."""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.constants import EPS, EPS_IND
from barflow.functions.numeric import cut
from barflow.operators.asof import asof_join, join_next_date, join_previous_session, join_same_date
from barflow.operators.chunks import chunked
from barflow.operators.ema import add_emas, ema_halo, sign_of
from barflow.operators.kernels import rolling_rank
from barflow.operators.rolling import Roller, flag
from barflow.operators.scans import backward_fill, forward_fill, running
from barflow.operators.stage import materialize
from barflow.plans import features as ft

C = F.col
DAILY = ("day_ret_1", "day_ret_5", "day_ret_20", "day_rsi", "day_atr_pct", "day_bb_pos", "day_above_ma50", "day_above_ma200",
         "day_vol_20", "prev_close", "prev_high", "prev_low", "day_iv_proxy", "day_iv_rank", "day_adx", "day_trend_strength",
         "weekly_ret", "monthly_ret", "day_cci", "day_stoch_k")


def daily_pack(bars: DataFrame, bucket: str = "year", rows_per_chunk: int | None = None) -> DataFrame:
    """Indicators on daily bars."""
    w = Roller()

    def run(df):
        out = ft.rsi_columns(df, w, {"day_rsi": 14})
        out = ft.dmi_columns(out, w, 14, "day_adx")
        out = ft.cci_column(out, w, "day_cci")
        out = ft.stochastic_columns(out, w, "day_stoch_k", "_wr").drop("_wr")
        out = out.withColumns({"_tr": ft.true_range(w), "_r": w.change("close"), "_ma20": w.roll(F.avg, "close", 20),
                               "_sd": w.roll(F.stddev_samp, "close", 20), "_ma50": w.roll(F.avg, "close", 50),
                               "_ma200": w.roll(F.avg, "close", 200)})
        out = out.withColumns({"day_atr_pct": w.roll(F.avg, "_tr", 14) / (C("close") + 1e-9) * 100,
                               "day_vol_20": w.roll(F.stddev_samp, "_r", 20) * 100})
        out = out.withColumns({
            **{f"day_ret_{n}": w.change("close", n) * 100 for n in (1, 5, 20)},
            "weekly_ret": w.change("close", 5) * 100, "monthly_ret": w.change("close", 21) * 100,
            "day_bb_pos": (C("close") - (C("_ma20") - 2 * C("_sd"))) / (4 * C("_sd") + 1e-9),
            "day_above_ma50": flag(C("close") > C("_ma50")), "day_above_ma200": flag(C("close") > C("_ma200")),
            "prev_close": w.lag("close"), "prev_high": w.lag("high"), "prev_low": w.lag("low"),
            "day_iv_proxy": C("day_atr_pct") * math.sqrt(252),
            "day_trend_strength": (C("close") - C("_ma200")) / (C("day_vol_20") * C("_ma200") / 100 + 1e-9)})
        return rolling_rank(out, "day_iv_proxy", "day_iv_rank", 252, 50, w)
    out = chunked(bars, run, 280, bucket=bucket, rows_per_chunk=rows_per_chunk)
    return out.drop("_tr", "_r", "_ma20", "_sd", "_ma50", "_ma200")


def attach_daily(bars: DataFrame, daily: DataFrame, compat: bool = False) -> DataFrame:
    """Daily features on intraday bars: the last finished session's values, or (``compat``) the same day's.

    Levels named ``prev_*`` keep their meaning either way: in the causal form they are the finished session's own close,
    high and low.
    """
    pack = daily_pack(daily)
    if compat:
        out = join_same_date(bars, pack.where(C("prev_close").isNotNull()), DAILY)
    else:
        own = pack.withColumns({"prev_close": C("close"), "prev_high": C("high"), "prev_low": C("low")})
        out = join_previous_session(bars, own, DAILY, default=None, keys=("symbol",))
    day_open = F.first("open").over(Window.partitionBy("symbol", "trade_date").orderBy("dt"))
    out = out.withColumns({"gap_pct": (day_open - C("prev_close")) / (C("prev_close") + 1e-9) * 100,
                           "above_prev_close": flag(C("close") > C("prev_close")),
                           "dist_prev_hi": (C("close") - C("prev_high")) / (C("close") + 1e-9) * 100,
                           "dist_prev_lo": (C("close") - C("prev_low")) / (C("close") + 1e-9) * 100})
    return out.na.fill(0.0, [*DAILY, "gap_pct", "dist_prev_hi", "dist_prev_lo"])


HTF = ("rsi", "macd_h", "bb_pos", "atr_pct", "ema9_21", "vol_10", "above_vwap", "adx", "cci", "stoch_k", "willr", "close_chg")


def htf_pack(bars: DataFrame, prefix: str, ret_periods=(1, 3), bucket: str = "month", rows_per_chunk: int | None = None,
             compat: bool = False) -> DataFrame:
    """Indicators on higher-timeframe bars under a column prefix."""
    w = Roller()
    total = running(bars, {"_ctp": ft.typical(), "_one": F.lit(1)}, bucket=bucket)

    def run(df):
        out = ft.rsi_columns(df, w, {"_rsi": 14})
        out = ft.macd_column(out, w, "_macd_h")
        out = ft.dmi_columns(out, w, 14, "_adx")
        out = ft.cci_column(out, w, "_cci")
        out = ft.stochastic_columns(out, w, "_stoch_k", "_willr")
        out = add_emas(out, {"_e9": ("close", 9), "_e21": ("close", 21)})
        out = out.withColumns({"_tr": ft.true_range(w), "_r": w.change("close"), "_ma": w.roll(F.avg, "close", 20),
                               "_sd": w.roll(F.stddev_samp, "close", 20)})
        return out.withColumns({
            **{f"_ret_{n}": ft.lagged_return(w, n) for n in ret_periods},
            "_bb_pos": (C("close") - (C("_ma") - 2 * C("_sd"))) / (4 * C("_sd") + 1e-9),
            "_atr_pct": w.roll(F.avg, "_tr", 14) / (C("close") + 1e-9) * 100, "_ema9_21": sign_of(C("_e9"), C("_e21")),
            "_vol_10": w.roll(F.stddev_samp, "_r", 10) * 100, "_above_vwap": flag(C("close") > C("_ctp") / C("_one")),
            "_close_chg": w.lag("close") - w.lag("close", 2)})
    out = chunked(total, run, ema_halo(26) + ema_halo(9), bucket=bucket, rows_per_chunk=rows_per_chunk)
    names = [f"ret_{n}" for n in ret_periods] + list(HTF)
    out = materialize(out.select("symbol", "dt", *[C(f"_{n}").cast("double").alias(prefix + n) for n in names]))
    slow = [prefix + n for n in ("adx", "cci", "macd_h")]
    out = forward_fill(out, slow, bucket=bucket)
    return backward_fill(out, slow, bucket=bucket) if compat else out


def attach_htf(bars: DataFrame, htf: DataFrame, prefix: str, width: str, ret_periods=(1, 3), bucket: str = "day",
               htf_bucket: str = "month", compat: bool = False) -> DataFrame:
    """As-of join of higher-timeframe features on the *end* of their bar (``compat``: on its start)."""
    names = [prefix + f"ret_{n}" for n in ret_periods] + [prefix + n for n in HTF]
    pack = htf_pack(htf, prefix, ret_periods, htf_bucket, compat=compat)
    ready = pack.where(C(prefix + "rsi").isNotNull() & C(prefix + "macd_h").isNotNull())
    if not compat:
        ready = ready.withColumn("dt", C("dt") + F.expr(f"INTERVAL {width}"))
    base = bars.drop(*[c for c in bars.columns if c.startswith(prefix)])
    out = materialize(asof_join(base, ready, names, bucket=bucket))
    return forward_fill(out, names, bucket=bucket, default=0.0)


def vix_pack(series: DataFrame) -> DataFrame:
    """Level, regime bin and distance from the five-day mean."""
    w = Window.orderBy("date").rowsBetween(-4, 0)
    mean = F.avg("vix_close").over(w)
    return series.select("date", C("vix_close").alias("day_vix"),
                         cut(C("vix_close"), [0, 13, 20, 999], [0.0, 1.0, 2.0]).alias("day_vix_regime"),
                         ((C("vix_close") - mean) / (mean + EPS) * 100).alias("day_vix_chg"))


def flow_pack(series: DataFrame) -> DataFrame:
    """Institutional flow: net, three-way bin and five-day sum."""
    w = Window.orderBy("date").rowsBetween(-4, 0)
    return series.select("date", "fii_net_buy", "dii_net_buy", (C("fii_net_buy") + C("dii_net_buy")).alias("fii_dii_net"),
                         cut(C("fii_net_buy"), [-999999, -2000, 2000, 999999], [-1.0, 0.0, 1.0]).alias("fii_flow_regime"),
                         F.sum("fii_net_buy").over(w).alias("fii_5d_cumulative"))


def world_pack(series: DataFrame) -> DataFrame:
    """World-index returns and the risk-on bin."""
    w = Window.orderBy("date")
    out = series.select("date", *[((F.try_divide(C("close"), F.lag("close", n).over(w)) - 1) * 100).alias(f"world_ret_{n}d") for n in (1, 5)])
    return out.withColumn("global_risk_on", cut(C("world_ret_1d"), [-999, -0.5, 0.5, 999], [-1.0, 0.0, 1.0]))


def attach_series(bars: DataFrame, pack: DataFrame | None, columns: list[str]) -> DataFrame:
    """Attach a daily series pack a day late; an absent source gives zeros."""
    if pack is None:
        return bars.drop(*columns).withColumns({c: F.lit(0.0) for c in columns})
    return join_next_date(bars, pack, columns)


__all__ = ["DAILY", "EPS_IND", "HTF", "attach_daily", "attach_htf", "attach_series", "daily_pack", "flow_pack", "htf_pack",
           "vix_pack", "world_pack"]
