"""Feature packs over bars.  A pack is ``(df, w) -> df``; ``HALO`` says how many rows it looks back.

``add_features`` chunks once for all chosen packs, so they share one shuffle and one sort.  Windows over the result of
another window go into a later ``withColumns`` on purpose: Catalyst then stacks Window nodes instead of copying inputs.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.constants import EPS, EPS_IND
from barflow.functions.numeric import bucket_score
from barflow.operators.chunks import chunked
from barflow.operators.ema import add_emas, ema_halo, sign_of
from barflow.operators.rolling import Roller, clip, flag
from barflow.operators.scans import running, streaks

C = F.col
RETURN_STEPS = (1, 3, 5, 10, 15, 30, 60)


def typical() -> Column:
    return (C("high") + C("low") + C("close")) / 3


def bar_range() -> Column:
    return F.greatest(C("high") - C("low"), F.lit(EPS))


def true_range(w: Roller) -> Column:
    """Largest of the bar range and the distances to the previous close; the first bar has only its range."""
    prev = w.lag("close")
    return F.greatest(C("high") - C("low"), F.abs(C("high") - prev), F.abs(C("low") - prev))


def lagged_return(w: Roller, n: int) -> Column:
    return (F.try_divide(w.lag("close"), w.lag("close", n + 1)) - 1) * 100


def same_session_only(w: Roller, n: int, value: Column) -> Column:
    """Zero where the row n bars ago is in another session (or missing)."""
    return F.when(C("trade_date") == w.lag("trade_date", n), value).otherwise(0.0)


def returns(df, w):
    return df.withColumns({**{f"ret_{n}m": same_session_only(w, n, lagged_return(w, n)) for n in RETURN_STEPS},
                           **{f"roc_{n}": lagged_return(w, n) for n in (5, 10, 20, 60)}})


def atr(df, w, bars_per_day: int = 375):
    out = df.withColumn("_tr", true_range(w))
    out = out.withColumns({"atr_5": w.roll(F.avg, "_tr", 5), "atr_14": w.roll(F.avg, "_tr", 14)}).drop("_tr")
    out = out.withColumns({"atr_14_pct": C("atr_14") / (C("close") + EPS) * 100, "atr_ratio": C("atr_5") / (C("atr_14") + EPS)})
    out = out.withColumn("iv_proxy", C("atr_14_pct") * math.sqrt(bars_per_day))
    iv = F.coalesce(C("iv"), C("iv_proxy")) if "iv" in df.columns else C("iv_proxy")
    out = out.withColumn("iv_final", clip(iv, 0.02, 3.0))
    return out.withColumn("iv_pct_change", w.change("iv_final", bars_per_day) * 100)


def volatility(df, w):
    out = df.withColumn("_r", w.change("close") * 100)
    return out.withColumns({f"vol_{n}m": w.roll(F.stddev_samp, "_r", n) for n in (5, 10, 20, 60)}).drop("_r")


def bollinger(df, w):
    out = df.withColumns({"_ma": w.roll(F.avg, "close", 20), "_sd": w.roll(F.stddev_samp, "close", 20)})
    out = out.withColumns({"bb_pos": (C("close") - (C("_ma") - 2 * C("_sd"))) / (4 * C("_sd") + EPS),
                           "bb_width": 4 * C("_sd") / (C("_ma") + EPS) * 100})
    return out.withColumn("bb_squeeze", flag(C("bb_width") < w.roll(F.avg, "bb_width", 125))).drop("_ma", "_sd")


def keltner(df, w):
    out = df.withColumn("_tr", true_range(w))
    out = out.withColumns({"_atr": w.roll(F.avg, "_tr", 14), "_ma": w.roll(F.avg, "close", 20)})
    return (out.withColumn("kc_pos", (C("close") - (C("_ma") - 2 * C("_atr"))) / (4 * C("_atr") + EPS_IND))
            .drop("_tr", "_atr", "_ma"))


def ema_family(df, w):
    spans = (9, 21, 50, 200)
    out = add_emas(df, {f"ema{s}": ("close", s) for s in spans}, keys=w.keys, order=w.order[0])
    out = out.withColumns({f"ema{s}_dist": (C("close") - C(f"ema{s}")) / (C("close") + EPS) * 100 for s in spans})
    return out.withColumns({
        "ema9_21": sign_of(C("ema9"), C("ema21")), "ema21_50": sign_of(C("ema21"), C("ema50")),
        "ema9_slope": w.diff("ema9", 3) / (w.lag("ema9", 3) + EPS) * 100,
        "ema21_slope": w.diff("ema21", 5) / (w.lag("ema21", 5) + EPS) * 100})


def rsi_columns(df, w, names: dict[str, int]) -> DataFrame:
    """Add name -> RSI(n), from simple means of gains and losses."""
    out = df.withColumn("_d", w.diff("close"))
    out = out.withColumns({"_g": F.when(C("_d").isNotNull(), F.greatest(C("_d"), F.lit(0.0))),
                           "_l": F.when(C("_d").isNotNull(), F.greatest(-C("_d"), F.lit(0.0)))})
    out = out.withColumns({k: 100 - 100 / (1 + w.roll(F.avg, "_g", n) / (w.roll(F.avg, "_l", n) + EPS_IND))
                           for k, n in names.items()})
    return out.drop("_d", "_g", "_l")


def rsi(df, w):
    out = rsi_columns(df, w, {"rsi_7": 7, "rsi_14": 14, "rsi_21": 21})
    moved = F.coalesce(w.diff("close", 10), F.lit(0.0)) * F.coalesce(w.diff("rsi_14", 10), F.lit(0.0))
    return out.withColumns({"rsi_slope": w.diff("rsi_14", 5), "rsi_div": flag(moved < 0)})


def macd_column(df, w, name: str, fast=12, slow=26, signal=9) -> DataFrame:
    """MACD histogram as a percentage of the close."""
    out = add_emas(df, {"_e1": ("close", fast), "_e2": ("close", slow)}, keys=w.keys, order=w.order[0])
    out = add_emas(out.withColumn("_m", C("_e1") - C("_e2")), {"_s": ("_m", signal)}, keys=w.keys, order=w.order[0])
    return out.withColumn(name, (C("_m") - C("_s")) / (C("close") + EPS_IND) * 100).drop("_e1", "_e2", "_m", "_s")


def flips(w: Roller, state: Column) -> Column:
    """1 where a 0/1 state differs from the previous row."""
    return F.coalesce(F.abs(state - F.lag(state).over(w.base)), F.lit(0)).cast("int")


def macd(df, w):
    out = macd_column(df, w, "macd_h")
    return out.withColumn("macd_cross", flips(w, flag(C("macd_h") > 0)))


def stochastic_columns(df, w, k: str, r: str, eps: float = EPS) -> DataFrame:
    out = df.withColumns({"_lo": w.roll(F.min, "low", 14), "_hi": w.roll(F.max, "high", 14)})
    return out.withColumns({k: (C("close") - C("_lo")) / (C("_hi") - C("_lo") + eps) * 100,
                            r: -100 * (C("_hi") - C("close")) / (C("_hi") - C("_lo") + eps)}).drop("_lo", "_hi")


def stochastic(df, w):
    out = stochastic_columns(df, w, "stoch_k", "willr")
    out = out.withColumn("stoch_d", w.roll(F.avg, "stoch_k", 3))
    return out.withColumn("stoch_cross", flips(w, flag(C("stoch_k") > C("stoch_d"))))


def cci_column(df, w, name: str, n: int = 20) -> DataFrame:
    """CCI whose mean deviation is the rolling mean of |tp - its own moving mean|."""
    out = df.withColumn("_tp", typical()).withColumn("_ma", w.roll(F.avg, "_tp", n))
    out = out.withColumn("_md", F.abs(C("_tp") - C("_ma")))
    return (out.withColumn(name, (C("_tp") - C("_ma")) / (0.015 * w.roll(F.avg, "_md", n) + EPS_IND))
            .drop("_tp", "_ma", "_md"))


def cci(df, w):
    return cci_column(df, w, "cci_20")


def mfi(df, w):
    out = df.withColumn("_tp", typical())
    flow = C("_tp") * (C("volume") + 1)
    out = out.withColumns({"_p": F.when(C("_tp") > w.lag("_tp"), flow).otherwise(0.0),
                           "_n": F.when(C("_tp") < w.lag("_tp"), flow).otherwise(0.0)})
    ratio = w.roll(F.sum, "_p", 14) / (w.roll(F.sum, "_n", 14) + EPS_IND)
    return out.withColumn("mfi_14", 100 - 100 / (1 + ratio)).drop("_tp", "_p", "_n")


def dmi_columns(df, w, n: int, adx: str, pdi: str = "_pdi", ndi: str = "_ndi", eps: float = EPS_IND) -> DataFrame:
    """Directional index columns from simple means: three stacked windows."""
    up, down = w.diff("high"), -w.diff("low")
    out = df.withColumns({"_tr": true_range(w), "_up": up, "_dn": down})
    out = out.withColumns({"_pm": F.when((C("_up") > C("_dn")) & (C("_up") > 0), C("_up")).otherwise(0.0),
                           "_nm": F.when((C("_dn") > C("_up")) & (C("_dn") > 0), C("_dn")).otherwise(0.0)})
    base = w.roll(F.avg, "_tr", n) + eps
    out = out.withColumns({pdi: 100 * w.roll(F.avg, "_pm", n) / base, ndi: 100 * w.roll(F.avg, "_nm", n) / base})
    out = out.withColumn("_dx", 100 * F.abs(C(pdi) - C(ndi)) / (C(pdi) + C(ndi) + eps))
    out = out.withColumn(adx, w.roll(F.avg, "_dx", n)).drop("_tr", "_up", "_dn", "_pm", "_nm", "_dx")
    return out.drop(*[c for c in (pdi, ndi) if c.startswith("_")])


def dmi(df, w):
    out = dmi_columns(df, w, 14, "adx_14", "dmi_pdi", "dmi_ndi")
    return out.withColumns({"dmi_diff": C("dmi_pdi") - C("dmi_ndi"), "adx_slope": w.diff("adx_14", 3)})


def candle_shape(df, w):
    body = F.abs(C("close") - C("open"))
    share = body / bar_range()
    out = df.withColumns({"body": share * 100, "upper_wick": (C("high") - F.greatest(C("close"), C("open"))) / bar_range() * 100,
                          "lower_wick": (F.least(C("close"), C("open")) - C("low")) / bar_range() * 100, "is_green": flag(C("close") >= C("open")),
                          "big_candle": flag(share > 0.7), "doji": flag(share < 0.1)})
    return out.withColumn("hammer", flag((C("lower_wick") > 60) & (C("upper_wick") < 20) & (share < 0.3)))


def range_sums(df, w):
    out = df.withColumns({"_r": bar_range(), "_b": C("close") - C("open"), "_d": w.diff("close")})
    return out.withColumns({"range_1m": C("_r"), "range_5m": w.roll(F.sum, "_r", 5), "range_15m": w.roll(F.sum, "_r", 15),
                            "price_accel": w.diff("_d"),
                            "body_momentum": w.roll(F.sum, "_b", 5) / (w.roll(F.sum, "_r", 5) + EPS) * 100}
                           ).drop("_r", "_b", "_d")


def session_vwap(w: Roller) -> Column:
    return w.session(F.sum, typical() * C("volume")) / (w.session(F.sum, C("volume")) + EPS)


def vwap(df, w):
    out = df.withColumn("vwap", session_vwap(w))
    out = out.withColumns({"vwap_dist": (C("close") - C("vwap")) / (C("vwap") + EPS) * 100, "above_vwap": flag(C("close") > C("vwap"))})
    out = out.withColumns({"vwap_slope": w.diff("vwap_dist", 5), "vwap_dev_vel": w.diff("vwap_dist", 3),
                           "vwap_vol_pressure": C("vwap_dist") * C("volume") / (w.roll(F.avg, "volume", 20) + EPS)})
    return out.withColumn("vwap_dev_accel", w.diff("vwap_dev_vel", 3))


def opening_range(df, w, minutes: int = 15, compat: bool = False):
    """High and low of the first minutes of a session, seen as they form (``compat``: known from the first bar)."""
    early = C("minute_of_day") < minutes
    hi = w.session(F.max, F.when(early, C("high")), running=not compat)
    lo = w.session(F.min, F.when(early, C("low")), running=not compat)
    out = df.withColumns({"or_high": F.coalesce(hi, C("high")), "or_low": F.coalesce(lo, C("low"))})
    width = F.greatest(C("or_high") - C("or_low"), F.lit(EPS))
    out = out.withColumns({"or_range": width / (C("close") + EPS) * 100, "or_pos": (C("close") - C("or_low")) / (width + EPS),
                           "or_break_up": flag(C("close") > C("or_high")), "or_break_dn": flag(C("close") < C("or_low"))})
    scale = F.greatest(C("or_range"), F.lit(EPS)) / 100 * C("close") + EPS
    dist = (F.when(C("or_break_up") == 1, (C("close") - C("or_high")) / scale)
            .when(C("or_break_dn") == 1, (C("close") - C("or_low")) / scale).otherwise(0.0))
    return out.withColumn("orb_dist", clip(dist, -5.0, 5.0))


def extremes(df, w):
    return df.withColumns({**{f"dist_hi_{n}": (w.roll(F.max, "high", n) - C("close")) / (C("close") + EPS) * 100 for n in (20, 60, 120)},
                           **{f"dist_lo_{n}": (C("close") - w.roll(F.min, "low", n)) / (C("close") + EPS) * 100 for n in (20, 60, 120)}})


def volume_pack(df, w):
    out = df.withColumns({"_dc": w.change("close"), "_dv": w.change("volume")})
    both = C("_dc").isNotNull() & C("_dv").isNotNull()
    x, y = F.when(both, C("_dc")), F.when(both, C("_dv"))
    fr = w.frame(-19, 0)
    # A window function runs for every row, guarded or not, so a flat window must not divide by its deviation of zero.
    corr = F.when(F.count(x).over(fr) >= 20, F.try_divide(F.covar_samp(x, y).over(fr), F.stddev_samp(x).over(fr) * F.stddev_samp(y).over(fr)))
    mean = F.greatest(w.roll(F.avg, "volume", 20), F.lit(1.0))
    ratio = F.when(w.roll(F.avg, "volume", 20).isNotNull(), C("volume") / (mean + EPS))
    return out.withColumns({"vol_ratio": ratio, "vol_price_corr": corr}).drop("_dc", "_dv")


def tick_imbalance(df, w):
    out = df.withColumn("_t", F.signum(F.coalesce(w.diff("close"), F.lit(0.0))))
    out = out.withColumns({"tick_imbalance": w.roll(F.avg, "_t", 20),
                           "_b": F.when(C("_t") > 0, C("volume") + 1).otherwise(0.0), "_s": F.when(C("_t") < 0, C("volume") + 1).otherwise(0.0)})
    out = out.withColumns({"tick_imbal_slope": w.diff("tick_imbalance", 5),
                           "buy_pressure": w.roll(F.sum, "_b", 10), "sell_pressure": w.roll(F.sum, "_s", 10)})
    return out.withColumns({"pressure_ratio": C("buy_pressure") / (C("sell_pressure") + EPS),
                            "imbal_accel": w.diff("tick_imbal_slope", 3)}).drop("_t", "_b", "_s")


def three_bar(df, w):
    c1, c2, o1, o2 = w.lag("close"), w.lag("close", 2), w.lag("open"), w.lag("open", 2)
    return df.withColumns({"bear_3bar": flag((c2 > c1) & (c1 > C("close")) & (c2 > o2) & (c1 > o1) & (C("close") < C("open"))),
                           "bull_3bar": flag((c2 < c1) & (c1 < C("close")) & (c2 < o2) & (c1 < o1) & (C("close") > C("open")))})


def pivots(df, w, side: int = 3):
    """A bar is a pivot when it is the extreme of ``side`` bars on both sides; known ``side`` bars later."""
    n = 2 * side + 1
    return df.withColumns({"pivot_hi": flag(w.lag("high", side) == w.roll(F.max, "high", n)).cast("double"),
                           "pivot_lo": flag(w.lag("low", side) == w.roll(F.min, "low", n)).cast("double")})


def structure(df, w, lookback: int = 20):
    """+1 / -1 / 0 from the last two pivot highs and lows before the bar, smoothed over three bars."""
    out = pivots(df, w)
    past = w.frame(-lookback, -1)
    out = out.withColumns({"_hs": F.collect_list(F.when(C("pivot_hi") > 0, C("close"))).over(past),
                           "_ls": F.collect_list(F.when(C("pivot_lo") > 0, C("close"))).over(past),
                           "_deep": w.lag("close", lookback).isNotNull()})

    def last(a, k):
        return F.try_element_at(C(a), F.lit(k))
    up = (last("_hs", -1) > last("_hs", -2)) & (last("_ls", -1) > last("_ls", -2))
    dn = (last("_hs", -1) < last("_hs", -2)) & (last("_ls", -1) < last("_ls", -2))
    raw = F.when(C("_deep") & up, 1.0).when(C("_deep") & dn, -1.0).otherwise(0.0)
    out = out.withColumn("_st", raw)
    return out.withColumn("struct_score", w.roll(F.avg, "_st", 3, 1)).drop("_hs", "_ls", "_deep", "_st")


def gaps_and_sweeps(df, w):
    out = df.withColumns({"_gb": flag(w.lag("high", 2) < C("low")).cast("double"), "_gs": flag(w.lag("low", 2) > C("high")).cast("double"),
                          "_eh": w.roll(F.max, "high", 20), "_el": w.roll(F.min, "low", 20), "_r": bar_range()})
    return out.withColumns({
        "fvg_bull": w.roll(F.max, "_gb", 5, 1), "fvg_bear": w.roll(F.max, "_gs", 5, 1),
        "liq_sweep_up": flag((C("high") >= C("_eh") * (1 - 0.0005)) & (C("close") < C("_eh"))).cast("double"),
        "liq_sweep_dn": flag((C("low") <= C("_el") * (1 + 0.0005)) & (C("close") > C("_el"))).cast("double"),
        "nr4": flag(C("_r") == w.roll(F.min, "_r", 4)), "nr7": flag(C("_r") == w.roll(F.min, "_r", 7))}
    ).drop("_gb", "_gs", "_eh", "_el", "_r")


def crosses(df, w=None):
    """Products of features; needs the packs that make them."""
    extreme = F.when((C("rsi_14") < 30) | (C("rsi_14") > 70), F.abs(50 - C("rsi_14"))).otherwise(
        F.when(C("rsi_14").isNotNull(), 0.0))
    return df.withColumns({
        "adx_rsi_trend": C("adx_14") * (C("rsi_14") - 50) / 50, "squeeze_atr": C("bb_squeeze") * C("atr_14_pct"),
        "vwap_momentum": C("vwap_dist") * C("ret_5m"), "vol_dmi_cross": C("vol_ratio") * C("dmi_diff") / 100,
        "session_iv": C("session_pct") * C("iv_proxy"), "adx_macd": C("adx_14") * C("macd_h"),
        "range_rsi_extr": extreme, "time_decay_mult": 1 - 0.5 * C("session_pct")})


def ta_scores(df, w=None, compat: bool = False):
    """Composite scores; needs RSI, stochastic, EMA, DMI, MFI, VWAP, opening range, MACD and supertrend columns."""
    mom = (bucket_score(C("rsi_14"), 20, 35, 65, 80, compat) + bucket_score(C("stoch_k"), 15, 25, 75, 85, compat)
           + bucket_score(C("willr"), -95, -80, -20, -5, compat)) / 3
    trend = 0.25 * (C("ema9_21") + C("ema21_50") + C("supertrend") + F.signum(C("dmi_diff")))
    out = df.withColumns({"ta_momentum_score": mom, "ta_trend_score": trend,
                          "ta_flow_score": bucket_score(C("mfi_14"), 20, 35, 65, 80, compat) / 2})
    overall = (C("ta_momentum_score") * 0.25 + C("ta_trend_score") * 0.35 + F.when(C("above_vwap") == 1, 0.20).otherwise(-0.20)
               + (C("or_break_up") - C("or_break_dn")) * 0.10 + F.signum(C("macd_h")) * 0.10)
    return out.withColumn("ta_overall_score", clip(overall, -2.0, 2.0))


def trend_pack(df, w, vix: Column | None = None):
    """Trend-following features in four groups: structure, momentum, swing regime, context."""
    rng = F.when(C("high") != C("low"), C("high") - C("low"))
    out = df.withColumns({f"ret_{n}b": same_session_only(w, n, lagged_return(w, n)) for n in (1, 3, 6, 12)})
    out = out.withColumns({"_tr": true_range(w), "_vw": session_vwap(w), "_pc": w.lag("close"),
                           "_new": flag(~C("trade_date").eqNullSafe(w.lag("trade_date"))),
                           "_dh": w.session(F.max, "high"), "_dl": w.session(F.min, "low"), "_grn": flag(C("close") > C("open")).cast("double"),
                           "_hl": C("high") - C("low")})
    out = out.withColumn("_atr", w.roll(F.avg, "_tr", 14))
    out = dmi_columns(out, w, 20, "adx_20")
    hi5, lo5 = F.max("high").over(w.frame(-4, 0)), F.min("low").over(w.frame(-4, 0))
    old = w.frame(-19, -5)
    enough = F.count("high").over(old) >= 5
    ph, pl = F.when(enough, F.max("high").over(old)), F.when(enough, F.min("low").over(old))
    out = out.withColumns({
        "vwap_dist_pct": (C("close") - C("_vw")) / (C("_vw") + EPS) * 100,
        "vwap_slope_3b": w.diff("_vw", 3) / (w.lag("_vw", 3) + EPS) * 100,
        "bar_range_norm": (C("high") - C("low")) / (C("_atr") + EPS),
        "bar_body_ratio": clip(F.coalesce(F.abs(C("close") - C("open")) / rng, F.lit(0.5)), 0.0, 1.0),
        "gap_from_prev_close": F.when(C("_new") == 1, (C("close") - C("_pc")) / (C("_pc") + EPS) * 100).otherwise(0.0),
        "day_position": (C("close") - C("_dl")) / (C("_dh") - C("_dl") + EPS),
        "roc_1b": w.change("close") * 100, "roc_3b": w.change("close", 3) * 100,
        "bar_close_vs_open": (C("close") - C("open")) / (C("_atr") + EPS),
        "buying_pressure": clip(F.coalesce((C("close") - C("low")) / rng, F.lit(0.5)), 0.0, 1.0),
        "vol_ratio_10": clip(C("volume") / (w.roll(F.avg, "volume", 10, 1) + EPS), 0.0, 10.0),
        "up_vol_frac": w.roll(F.avg, "_grn", 3, 1),
        "adx_slope_3b": w.diff("adx_20", 3),
        "higher_high_flag": flag(hi5 > ph), "higher_low_flag": flag(lo5 > pl),
        "lower_high_flag": flag(hi5 < ph), "lower_low_flag": flag(lo5 < pl),
        "swing_high_dist": (w.roll(F.max, "high", 20, 5) - C("close")) / (C("_atr") + EPS),
        "swing_low_dist": (C("close") - w.roll(F.min, "low", 20, 5)) / (C("_atr") + EPS),
        "time_normalized": clip(C("minute_of_day") / F.lit(375.0), 0.0, 1.0),
        "dow_encoded": clip(F.weekday("dt").cast("double"), 0.0, 4.0) / 4.0,
        "intraday_vol": w.roll(F.avg, "_hl", 10, 1),
        "vix_level": F.coalesce(vix, F.lit(15.0)) if vix is not None else F.lit(15.0)})
    return out.drop("_vw", "_pc", "_new", "_dh", "_dl", "_grn", "_hl", "_atr")


PACKS = dict(returns=returns, atr=atr, volatility=volatility, bollinger=bollinger, keltner=keltner, ema=ema_family,
             rsi=rsi, macd=macd, stochastic=stochastic, cci=cci, mfi=mfi, dmi=dmi, candle=candle_shape, ranges=range_sums,
             vwap=vwap, opening_range=opening_range, extremes=extremes, volume=volume_pack, ticks=tick_imbalance,
             three_bar=three_bar, structure=structure, gaps=gaps_and_sweeps, trend=trend_pack)
# Rows a pack looks back (sessions it needs whole are whole anyway: chunks never split a day).
HALO = dict(returns=61, atr=15, volatility=61, bollinger=145, keltner=20, ema=ema_halo(200) + 5, rsi=32,
            macd=ema_halo(26) + ema_halo(9), stochastic=17, cci=40, mfi=15, dmi=32, candle=0, ranges=15, vwap=20,
            opening_range=0, extremes=120, volume=21, ticks=30, three_bar=2, structure=32, gaps=20, trend=44)


def add_features(bars: DataFrame, *names: str, bucket: str = "day", rows_per_chunk: int | None = None,
                 bars_per_day: int = 375, options: dict[str, dict] | None = None) -> DataFrame:
    """Run the named packs over bars that carry the session clock, in one chunked pass."""
    options = dict(options or {})
    options.setdefault("atr", {"bars_per_day": bars_per_day})
    w = Roller()
    halo = max(HALO[n] for n in names)
    if "atr" in names:
        halo = max(halo, options["atr"]["bars_per_day"] + 15)

    def run(df):
        for n in names:
            df = PACKS[n](df, w, **options.get(n, {}))
        return df
    return chunked(bars, run, halo, bucket=bucket, rows_per_chunk=rows_per_chunk)


def obv(bars: DataFrame, bucket: str = "day", rows_per_chunk: int | None = None) -> DataFrame:
    """On-balance volume needs the total since the first bar: signed volume, two-level running sum, ten-bar slope."""
    w = Roller()
    opts = dict(bucket=bucket, rows_per_chunk=rows_per_chunk)
    signed = chunked(bars, lambda d: d.withColumn("_sv", F.signum(F.coalesce(w.diff("close"), F.lit(0.0))) * (C("volume") + 1)), 1, **opts)
    total = running(signed, {"obv": C("_sv")}, bucket=bucket).drop("_sv").withColumn("_a", F.abs("obv"))
    slope = w.diff("obv", 10) / (w.roll(F.avg, "_a", 10) + EPS)
    return chunked(total, lambda d: d.withColumn("obv_slope", slope), 10, **opts).drop("_a")


def streak_features(bars: DataFrame, bucket: str = "day", rows_per_chunk: int | None = None) -> DataFrame:
    """Runs of green / red bars and of rising / falling closes, of any length."""
    w = Roller()
    moved = chunked(bars, lambda d: d.withColumn("_d", w.diff("close")), 1, bucket=bucket, rows_per_chunk=rows_per_chunk)
    return streaks(moved, {"consec_green": C("close") >= C("open"), "consec_red": C("close") < C("open"), "consec_up": C("_d") > 0, "consec_dn": C("_d") < 0},
                   bucket=bucket).drop("_d")


def prior_session_pivots(bars: DataFrame) -> DataFrame:
    """Distance to the previous session's high and low, through a table of one row per session."""
    from pyspark.sql import Window
    days = bars.groupBy("symbol", "trade_date").agg(F.max("high").alias("_h"), F.min("low").alias("_l"))
    by = Window.partitionBy("symbol").orderBy("trade_date")
    prev = days.select("symbol", "trade_date", F.lag("_h").over(by).alias("prev_high"), F.lag("_l").over(by).alias("prev_low"))
    out = bars.join(prev, ["symbol", "trade_date"], "left")
    return out.withColumns({"dist_pivot_hi": (C("prev_high") - C("close")) / (C("close") + EPS) * 100,
                            "dist_pivot_lo": (C("close") - C("prev_low")) / (C("close") + EPS) * 100})


def feature_columns(df: DataFrame, prefix: str) -> Sequence[str]:
    return [c for c in df.columns if c.startswith(prefix)]
