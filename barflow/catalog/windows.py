"""Window feature queries and their oracles (hourly bars made from ``events``)."""
from __future__ import annotations

import math

from pyspark.sql import functions as F

from barflow.catalog import fixtures as fx
from barflow.catalog.sqltext import P, PD, TP, TR, change, day, diff, ema_sql, expand_rsi, flag, lag, over, roll, stages
from barflow.operators import scans
from barflow.operators.chunks import chunked
from barflow.operators.rolling import Roller
from barflow.plans import features as ft

C = F.col
QUERIES, ORACLES = {}, {}


def pack_query(name, packs, columns, *steps, **options):
    """Register a feature pack with the stages of its oracle."""
    def run(spark, d):
        return fx.rounded(ft.add_features(fx.bars(spark, d), *packs, **options), "symbol", "dt", *columns)
    text, last = stages("bars", *steps)
    QUERIES[name] = run
    ORACLES[name] = f"{fx.with_views('bars')},\n{text}\nSELECT symbol, dt, {pick(columns)} FROM {last}"


INTS = {"bb_squeeze", "ema9_21", "ema21_50", "rsi_div", "macd_cross", "stoch_cross", "is_green", "big_candle", "doji", "hammer",
        "above_vwap", "or_break_up", "or_break_dn", "bear_3bar", "bull_3bar", "nr4", "nr7", "higher_high_flag",
        "higher_low_flag", "lower_high_flag", "lower_low_flag"}


def pick(columns):
    return ", ".join(c if c in INTS else f"floor(({c})*1e6+0.5e0)/1e6 AS {c}" for c in columns)


RET = (1, 3, 5, 10, 15, 30, 60)
pack_query("w02_returns", ["returns"], [f"ret_{n}m" for n in RET],
           {f"ret_{n}m": f"CASE WHEN trade_date = {lag('trade_date', n)} THEN ({lag('close')}/{lag('close', n + 1)}-1)*100 ELSE 0e0 END"
            for n in RET})
pack_query("w03_roc", ["returns"], [f"roc_{n}" for n in (5, 10, 20, 60)],
           {f"roc_{n}": f"({lag('close')}/{lag('close', n + 1)}-1)*100" for n in (5, 10, 20, 60)})
pack_query("w04_atr", ["atr"], ["atr_5", "atr_14", "atr_14_pct", "atr_ratio"], {"tr": TR},
           {"atr_5": roll("avg", "tr", 5), "atr_14": roll("avg", "tr", 14)},
           {"atr_14_pct": "atr_14/(close+1e-9)*100", "atr_ratio": "atr_5/(atr_14+1e-9)"}, bars_per_day=24)
pack_query("w05_iv_proxy", ["atr"], ["iv_proxy", "iv_final"], {"tr": TR}, {"atr_14": roll("avg", "tr", 14)},
           {"iv_proxy": "atr_14/(close+1e-9)*100*sqrt(24)"},
           {"iv_final": "CASE WHEN iv_proxy IS NOT NULL THEN greatest(0.02, least(3.0, iv_proxy)) END"}, bars_per_day=24)
pack_query("w07_iv_pct_change", ["atr"], ["iv_pct_change"], {"tr": TR}, {"atr_14": roll("avg", "tr", 14)},
           {"p": "atr_14/(close+1e-9)*100*sqrt(24)"}, {"f": "CASE WHEN p IS NOT NULL THEN greatest(0.02, least(3.0, p)) END"},
           {"iv_pct_change": f"{change('f', 24)}*100"}, bars_per_day=24)
pack_query("w08_volatility", ["volatility"], [f"vol_{n}m" for n in (5, 10, 20, 60)], {"r": f"{change('close')}*100"},
           {f"vol_{n}m": roll("stddev_samp", "r", n) for n in (5, 10, 20, 60)})
BB = ({"ma": roll("avg", "close", 20), "sd": roll("stddev_samp", "close", 20)},
      {"bb_pos": "(close-(ma-2*sd))/(4*sd+1e-9)", "bb_width": "4*sd/(ma+1e-9)*100"},
      {"bb_squeeze": flag(f"bb_width < ({roll('avg', 'bb_width', 125)})")})
pack_query("w09_bollinger", ["bollinger"], ["bb_pos", "bb_width", "bb_squeeze"], *BB)
pack_query("w10_keltner", ["keltner"], ["kc_pos"], {"tr": TR}, {"a": roll("avg", "tr", 14), "ma": roll("avg", "close", 20)},
           {"kc_pos": "(close-(ma-2*a))/(4*a+1e-10)"})
pack_query("w12_rsi", ["rsi"], ["rsi_7", "rsi_14", "rsi_21", "rsi_slope", "rsi_div"], {"d": diff("close")},
           {**expand_rsi("rsi_7", 7), **expand_rsi("rsi_14", 14), **expand_rsi("rsi_21", 21)},
           {"rsi_slope": diff("rsi_14", 5),
            "rsi_div": flag(f"coalesce({diff('close', 10)},0)*coalesce({diff('rsi_14', 10)},0) < 0")})
STO = ({"lo14": roll("min", "low", 14), "hi14": roll("max", "high", 14)},
       {"stoch_k": "(close-lo14)/(hi14-lo14+1e-9)*100", "willr": "-100*(hi14-close)/(hi14-lo14+1e-9)"},
       {"stoch_d": roll("avg", "stoch_k", 3)}, {"up": flag("stoch_k > stoch_d")},
       {"stoch_cross": f"CAST(coalesce(abs(up - {lag('up')}),0) AS INTEGER)"})
pack_query("w14_stochastic", ["stochastic"], ["stoch_k", "stoch_d", "stoch_cross", "willr"], *STO)
CCI = ({"tp": TP}, {"ma": roll("avg", "tp", 20)}, {"md": "abs(tp-ma)"},
       {"cci_20": f"(tp-ma)/(0.015*({roll('avg', 'md', 20)})+1e-10)"})
pack_query("w15_cci", ["cci"], ["cci_20"], *CCI)
MFI = ({"tp": TP}, {"p": f"CASE WHEN tp > {lag('tp')} THEN tp*(volume+1) ELSE 0e0 END",
                    "n": f"CASE WHEN tp < {lag('tp')} THEN tp*(volume+1) ELSE 0e0 END"},
       {"mfi_14": f"100-100/(1+({roll('sum', 'p', 14)})/(({roll('sum', 'n', 14)})+1e-10))"})
pack_query("w16_mfi", ["mfi"], ["mfi_14"], *MFI)


def dmi_steps(n):
    return ({"tr": TR, "upm": diff("high"), "dnm": f"(-{diff('low')})"},
            {"pm": "CASE WHEN upm > dnm AND upm > 0 THEN upm ELSE 0e0 END",
             "nm": "CASE WHEN dnm > upm AND dnm > 0 THEN dnm ELSE 0e0 END"},
            {"pdi": f"100*({roll('avg', 'pm', n)})/(({roll('avg', 'tr', n)})+1e-10)",
             "ndi": f"100*({roll('avg', 'nm', n)})/(({roll('avg', 'tr', n)})+1e-10)"},
            {"dx": "100*abs(pdi-ndi)/(pdi+ndi+1e-10)"}, {f"adx_{n}": roll("avg", "dx", n)})


pack_query("w18_dmi_adx", ["dmi"], ["adx_14", "dmi_pdi", "dmi_ndi", "dmi_diff", "adx_slope"], *dmi_steps(14),
           {"dmi_pdi": "pdi", "dmi_ndi": "ndi", "dmi_diff": "pdi-ndi", "adx_slope": diff("adx_14", 3)})
pack_query("w19_candle_shape", ["candle"], ["body", "upper_wick", "lower_wick", "is_green", "big_candle", "doji", "hammer"],
           {"r": "greatest(high-low,1e-9)", "b": "abs(close-open)"},
           {"body": "b/r*100", "upper_wick": "(high-greatest(close,open))/r*100", "lower_wick": "(least(close,open)-low)/r*100",
            "is_green": flag("close>=open"), "big_candle": flag("b/r>0.7e0"), "doji": flag("b/r<0.1e0")},
           {"hammer": flag("lower_wick>60 AND upper_wick<20 AND b/r<0.3e0")})
pack_query("w20_range_sums", ["ranges"], ["range_1m", "range_5m", "range_15m", "body_momentum", "price_accel"],
           {"range_1m": "greatest(high-low,1e-9)", "bd": "close-open", "d": diff("close")},
           {"range_5m": roll("sum", "range_1m", 5), "range_15m": roll("sum", "range_1m", 15), "price_accel": diff("d"),
            "body_momentum": f"({roll('sum', 'bd', 5)})/(({roll('sum', 'range_1m', 5)})+1e-9)*100"})
VW = ({"tv": f"{TP}*volume"}, {"vwap": f"{day('sum(tv)')}/({day('sum(volume)')}+1e-9)"},
      {"vwap_dist": "(close-vwap)/(vwap+1e-9)*100", "above_vwap": flag("close>vwap")},
      {"vwap_slope": diff("vwap_dist", 5), "vwap_dev_vel": diff("vwap_dist", 3),
       "vwap_vol_pressure": f"vwap_dist*volume/(({roll('avg', 'volume', 20)})+1e-9)"},
      {"vwap_dev_accel": diff("vwap_dev_vel", 3)})
pack_query("w21_session_vwap", ["vwap"], ["vwap", "vwap_dist", "above_vwap", "vwap_slope", "vwap_dev_vel", "vwap_dev_accel",
                                          "vwap_vol_pressure"], *VW)


def or_steps(running):
    fn = day if running else (lambda x: f"{x} OVER (PARTITION BY symbol, trade_date)")
    hi = fn("max(CASE WHEN minute_of_day<180 THEN high END)")
    lo = fn("min(CASE WHEN minute_of_day<180 THEN low END)")
    return ({"or_high": f"coalesce({hi},high)", "or_low": f"coalesce({lo},low)"},
            {"wd": "greatest(or_high-or_low,1e-9)"},
            {"or_range": "wd/(close+1e-9)*100", "or_pos": "(close-or_low)/(wd+1e-9)", "or_break_up": flag("close>or_high"),
             "or_break_dn": flag("close<or_low")}, {"sc": "greatest(or_range,1e-9)/100*close+1e-9"},
            {"orb_dist": "greatest(-5,least(5,CASE WHEN or_break_up=1 THEN (close-or_high)/sc WHEN or_break_dn=1 "
                         "THEN (close-or_low)/sc ELSE 0e0 END))"})


OR_COLS = ["or_high", "or_low", "or_range", "or_pos", "or_break_up", "or_break_dn", "orb_dist"]
pack_query("w22_opening_range", ["opening_range"], OR_COLS, *or_steps(True), options={"opening_range": {"minutes": 180}})
pack_query("w22_opening_range_compat", ["opening_range"], OR_COLS, *or_steps(False),
           options={"opening_range": {"minutes": 180, "compat": True}})
pack_query("w23_extremes", ["extremes"], [f"dist_{s}_{n}" for s in ("hi", "lo") for n in (20, 60, 120)],
           {**{f"dist_hi_{n}": f"(({roll('max', 'high', n)})-close)/(close+1e-9)*100" for n in (20, 60, 120)},
            **{f"dist_lo_{n}": f"(close-({roll('min', 'low', n)}))/(close+1e-9)*100" for n in (20, 60, 120)}})
pack_query("w27_volume", ["volume"], ["vol_ratio", "vol_price_corr"], {"dc": change("close"), "dv": change("volume")},
           {"vol_ratio": f"volume/(greatest({roll('avg', 'volume', 20)},1)+1e-9)*(CASE WHEN {roll('avg', 'volume', 20)} IS NOT NULL THEN 1 END)",
            "vol_price_corr": f"CASE WHEN {over('count(dc)', '19 PRECEDING', 'CURRENT ROW')}>=20 THEN "
                              f"{over('corr(dc,dv)', '19 PRECEDING', 'CURRENT ROW')} END"})
TI = ({"t": f"CAST(sign(coalesce({diff('close')},0)) AS DOUBLE)"},
      {"tick_imbalance": roll("avg", "t", 20), "bv": "CASE WHEN t>0 THEN volume+1 ELSE 0e0 END",
       "sv": "CASE WHEN t<0 THEN volume+1 ELSE 0e0 END"},
      {"tick_imbal_slope": diff("tick_imbalance", 5), "buy_pressure": roll("sum", "bv", 10), "sell_pressure": roll("sum", "sv", 10)},
      {"pressure_ratio": "buy_pressure/(sell_pressure+1e-9)", "imbal_accel": diff("tick_imbal_slope", 3)})
pack_query("w28_tick_imbalance", ["ticks"], ["tick_imbalance", "tick_imbal_slope", "buy_pressure", "sell_pressure",
                                             "pressure_ratio", "imbal_accel"], *TI)
C1, C2, O1, O2 = lag("close"), lag("close", 2), lag("open"), lag("open", 2)
pack_query("w29_three_bar", ["three_bar"], ["bear_3bar", "bull_3bar"],
           {"bear_3bar": flag(f"{C2}>{C1} AND {C1}>close AND {C2}>{O2} AND {C1}>{O1} AND close<open"),
            "bull_3bar": flag(f"{C2}<{C1} AND {C1}<close AND {C2}<{O2} AND {C1}<{O1} AND close>open")})
PV = {"pivot_hi": f"CAST({flag(lag('high', 3) + ' = (' + roll('max', 'high', 7) + ')')} AS DOUBLE)",
      "pivot_lo": f"CAST({flag(lag('low', 3) + ' = (' + roll('min', 'low', 7) + ')')} AS DOUBLE)"}
pack_query("w30_pivots", ["structure"], ["pivot_hi", "pivot_lo"], PV)
pack_query("w31_structure", ["structure"], ["struct_score"], PV,
           {"hs": over("list(CASE WHEN pivot_hi>0 THEN close END)", "20 PRECEDING", "1 PRECEDING"),
            "lw": over("list(CASE WHEN pivot_lo>0 THEN close END)", "20 PRECEDING", "1 PRECEDING"),
            "rn": f"row_number() OVER ({P})"},
           {"hf": "list_filter(hs, lambda x: x IS NOT NULL)", "lf": "list_filter(lw, lambda x: x IS NOT NULL)"},
           {"st": "CASE WHEN rn>20 AND hf[-1]>hf[-2] AND lf[-1]>lf[-2] THEN 1e0 WHEN rn>20 AND hf[-1]<hf[-2] AND lf[-1]<lf[-2] THEN -1e0 ELSE 0e0 END"},
           {"struct_score": over("avg(st)", "2 PRECEDING", "CURRENT ROW")})
GAP = ({"gb": f"CAST({flag(lag('high', 2) + '<low')} AS DOUBLE)", "gs": f"CAST({flag(lag('low', 2) + '>high')} AS DOUBLE)",
        "eh": roll("max", "high", 20), "el": roll("min", "low", 20), "r": "greatest(high-low,1e-9)"},
       {"fvg_bull": over("max(gb)", "4 PRECEDING", "CURRENT ROW"), "fvg_bear": over("max(gs)", "4 PRECEDING", "CURRENT ROW"),
        "liq_sweep_up": f"CAST({flag('high>=eh*(1-0.0005e0) AND close<eh')} AS DOUBLE)",
        "liq_sweep_dn": f"CAST({flag('low<=el*(1+0.0005e0) AND close>el')} AS DOUBLE)",
        "nr4": flag(f"r=({roll('min', 'r', 4)})"), "nr7": flag(f"r=({roll('min', 'r', 7)})")})
pack_query("w32_fair_value_gap", ["gaps"], ["fvg_bull", "fvg_bear"], *GAP)
pack_query("w33_liquidity_sweep", ["gaps"], ["liq_sweep_up", "liq_sweep_dn"], *GAP)
pack_query("w34_narrow_range", ["gaps"], ["nr4", "nr7"], *GAP)

HI5, LO5 = over("max(high)", "4 PRECEDING", "CURRENT ROW"), over("min(low)", "4 PRECEDING", "CURRENT ROW")
NOLD = over("count(high)", "19 PRECEDING", "5 PRECEDING")
PH = f"(CASE WHEN {NOLD}>=5 THEN {over('max(high)', '19 PRECEDING', '5 PRECEDING')} END)"
PL = f"(CASE WHEN {NOLD}>=5 THEN {over('min(low)', '19 PRECEDING', '5 PRECEDING')} END)"
SWING = {"higher_high_flag": flag(f"{HI5}>{PH}"), "higher_low_flag": flag(f"{LO5}>{PL}"),
         "lower_high_flag": flag(f"{HI5}<{PH}"), "lower_low_flag": flag(f"{LO5}<{PL}")}
pack_query("w43_swing_flags", ["trend"], list(SWING), SWING)
TREND = [f"ret_{n}b" for n in (1, 3, 6, 12)] + [
    "vwap_dist_pct", "vwap_slope_3b", "bar_range_norm", "bar_body_ratio", "gap_from_prev_close", "day_position", "roc_1b", "roc_3b",
    "bar_close_vs_open", "buying_pressure", "vol_ratio_10", "up_vol_frac", "adx_20", "adx_slope_3b", "swing_high_dist",
    "swing_low_dist", "time_normalized", "dow_encoded", "intraday_vol", "vix_level"]
pack_query("w42_trend_pack", ["trend"], TREND,
           {"tv": f"{TP}*volume", "atr0": TR, "rng": "CASE WHEN high<>low THEN high-low END", "hl": "high-low",
            "upb": f"CAST({flag('close>open')} AS DOUBLE)", "dh": day("max(high)"), "dl": day("min(low)"), "pc": lag("close"),
            "isnew": flag(f"trade_date IS DISTINCT FROM {lag('trade_date')}")},
           {"vw": f"{day('sum(tv)')}/({day('sum(volume)')}+1e-9)", "atr": roll("avg", "atr0", 14)}, *dmi_steps(20),
           {**{f"ret_{n}b": f"CASE WHEN trade_date={lag('trade_date', n)} THEN ({lag('close')}/{lag('close', n + 1)}-1)*100 ELSE 0e0 END"
               for n in (1, 3, 6, 12)},
            "vwap_dist_pct": "(close-vw)/(vw+1e-9)*100", "vwap_slope_3b": f"{diff('vw', 3)}/({lag('vw', 3)}+1e-9)*100",
            "bar_range_norm": "(high-low)/(atr+1e-9)", "bar_body_ratio": "least(1,greatest(0,coalesce(abs(close-open)/rng,0.5e0)))",
            "gap_from_prev_close": "CASE WHEN isnew=1 THEN (close-pc)/(pc+1e-9)*100 ELSE 0e0 END",
            "day_position": "(close-dl)/(dh-dl+1e-9)", "roc_1b": f"{change('close')}*100", "roc_3b": f"{change('close', 3)}*100",
            "bar_close_vs_open": "(close-open)/(atr+1e-9)", "buying_pressure": "least(1,greatest(0,coalesce((close-low)/rng,0.5e0)))",
            "vol_ratio_10": f"least(10,greatest(0,volume/({over('avg(volume)', '9 PRECEDING', 'CURRENT ROW')}+1e-9)))",
            "up_vol_frac": over("avg(upb)", "2 PRECEDING", "CURRENT ROW"), "adx_slope_3b": diff("adx_20", 3),
            "swing_high_dist": f"(({roll('max', 'high', 20, 5)})-close)/(atr+1e-9)",
            "swing_low_dist": f"(close-({roll('min', 'low', 20, 5)}))/(atr+1e-9)",
            "time_normalized": "least(1e0,minute_of_day/375e0)", "dow_encoded": "least(4e0,dow)/4e0",
            "intraday_vol": over("avg(hl)", "9 PRECEDING", "CURRENT ROW"), "vix_level": "15e0"})

# --- EMA family and MACD: the oracle runs the recurrence itself -----------------------------------------------------
SPANS = (9, 21, 50, 200)
EMA_COLS = [f"ema{s}_dist" for s in SPANS] + ["ema9_21", "ema21_50", "ema9_slope", "ema21_slope"]


def w11_ema(spark, d):
    return fx.rounded(ft.add_features(fx.bars(spark, d), "ema"), "symbol", "dt", *EMA_COLS)


QUERIES["w11_ema"] = w11_ema
ORACLES["w11_ema"] = (
    fx.with_views("bars").replace("WITH ", "WITH RECURSIVE ", 1) + ",\n"
    + ema_sql("bars", ["symbol", "dt", "close"], [(f"ema{s}", "close", s) for s in SPANS])
    + ",\nf AS (SELECT *, " + ", ".join(f"(close-ema{s})/(close+1e-9)*100 AS ema{s}_dist" for s in SPANS)
    + f", CAST(sign(ema9-ema21) AS INTEGER) AS ema9_21, CAST(sign(ema21-ema50) AS INTEGER) AS ema21_50, "
      f"{diff('ema9', 3)}/({lag('ema9', 3)}+1e-9)*100 AS ema9_slope, {diff('ema21', 5)}/({lag('ema21', 5)}+1e-9)*100 AS ema21_slope FROM e)"
    + f"\nSELECT symbol, dt, {pick(EMA_COLS)} FROM f")


def w13_macd(spark, d):
    return fx.rounded(ft.add_features(fx.bars(spark, d), "macd"), "symbol", "dt", "macd_h", "macd_cross")


MACD_E = """num AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS rn FROM {src}),
e AS (SELECT symbol, dt, close, rn, close AS e1, close AS e2, 0e0 AS sg FROM num WHERE rn=1 UNION ALL
 SELECT symbol, dt, close, rn, n1, n2, sg*0.8e0 + (n1-n2)*0.2e0 FROM (
  SELECT n.symbol, n.dt, n.close, n.rn, e.sg, e.e1*(1-2e0/13)+n.close*(2e0/13) AS n1, e.e2*(1-2e0/27)+n.close*(2e0/27) AS n2
  FROM e JOIN num n ON n.symbol=e.symbol AND n.rn=e.rn+1) x)"""
QUERIES["w13_macd"] = w13_macd
ORACLES["w13_macd"] = (
    fx.with_views("bars").replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + MACD_E.format(src="bars")
    + ",\nf AS (SELECT *, ((e1-e2)-sg)/(close+1e-10)*100 AS macd_h FROM e), g AS (SELECT *, CASE WHEN macd_h>0 THEN 1 ELSE 0 END AS up FROM f)"
    + f"\nSELECT symbol, dt, {pick(['macd_h'])}, CAST(coalesce(abs(up-{lag('up')}),0) AS INTEGER) AS macd_cross FROM g")


# --- unbounded values -----------------------------------------------------------------------------------------------
def w17_obv(spark, d):
    return fx.rounded(ft.obv(fx.bars(spark, d)), "symbol", "dt", "obv", "obv_slope")


QUERIES["w17_obv"] = w17_obv
_t, _ = stages("bars", {"sv": f"sign(coalesce({diff('close')},0))*(volume+1)"},
               {"obv": over("sum(sv)", "UNBOUNDED PRECEDING", "CURRENT ROW")}, {"a": "abs(obv)"},
               {"obv_slope": f"{diff('obv', 10)}/(({roll('avg', 'a', 10)})+1e-9)"})
ORACLES["w17_obv"] = f"{fx.with_views('bars')},\n{_t}\nSELECT symbol, dt, {pick(['obv', 'obv_slope'])} FROM s3"


def w24_prior_day_pivot(spark, d):
    return fx.rounded(ft.prior_session_pivots(fx.bars(spark, d)), "symbol", "dt", "dist_pivot_hi", "dist_pivot_lo")


QUERIES["w24_prior_day_pivot"] = w24_prior_day_pivot
ORACLES["w24_prior_day_pivot"] = fx.with_views("bars") + """,
d AS (SELECT symbol, trade_date, max(high) AS h, min(low) AS l FROM bars GROUP BY 1,2),
p AS (SELECT symbol, trade_date, lag(h) OVER (PARTITION BY symbol ORDER BY trade_date) AS ph,
      lag(l) OVER (PARTITION BY symbol ORDER BY trade_date) AS pl FROM d)
SELECT b.symbol, b.dt, floor(((ph-close)/(close+1e-9)*100)*1e6+0.5e0)/1e6 AS dist_pivot_hi, floor(((close-pl)/(close+1e-9)*100)*1e6+0.5e0)/1e6 AS dist_pivot_lo
FROM bars b LEFT JOIN p USING (symbol, trade_date)"""


def w25_streaks(spark, d):
    return ft.streak_features(fx.bars(spark, d)).select("symbol", "dt", "consec_green", "consec_red")


def w26_consecutive(spark, d):
    return ft.streak_features(fx.bars(spark, d)).select("symbol", "dt", "consec_up", "consec_dn")


QUERIES["w25_streaks"], QUERIES["w26_consecutive"] = w25_streaks, w26_consecutive


def streak_sql(names):
    flags = ", ".join(f"CASE WHEN {c} THEN 1 ELSE 0 END AS f_{n}" for n, c in names.items())
    isl = ", ".join(f"sum(1-f_{n}) OVER ({P}) AS g_{n}" for n in names)
    cnt = ", ".join(f"CAST(sum(f_{n}) OVER (PARTITION BY symbol, g_{n} ORDER BY dt) AS INTEGER) AS {n}" for n in names)
    return f"{fx.with_views('bars')}, a AS (SELECT symbol, dt, {flags} FROM bars), b AS (SELECT *, {isl} FROM a) SELECT symbol, dt, {cnt} FROM b"


ORACLES["w25_streaks"] = streak_sql({"consec_green": "close>=open", "consec_red": "close<open"})
ORACLES["w26_consecutive"] = streak_sql({"consec_up": f"{diff('close')}>0", "consec_dn": f"{diff('close')}<0"})


def w01_lag_lead(spark, d):
    w = Roller()
    run = lambda x: x.withColumns({"prev_close": w.lag("close"), "prev3_open": w.lag("open", 3)})
    back = chunked(fx.bars(spark, d), run, 3)
    out = chunked(back, lambda x: x.withColumn("next_close", w.lead("close")), 1, forward=True)
    return fx.rounded(out, "symbol", "dt", "prev_close", "prev3_open", "next_close")


QUERIES["w01_lag_lead"] = w01_lag_lead
ORACLES["w01_lag_lead"] = (f"{fx.with_views('bars')}, a AS (SELECT symbol, dt, {lag('close')} AS prev_close, {lag('open', 3)} AS prev3_open, "
                           f"lead(close) OVER ({P}) AS next_close FROM bars) SELECT symbol, dt, {pick(['prev_close', 'prev3_open', 'next_close'])} FROM a")


def w45_fill(spark, d):
    holes = fx.bars(spark, d).withColumn("price", F.when(C("volume") > 3, C("close")))
    out = scans.forward_fill(holes.withColumn("ff", C("price")), ["ff"])
    out = scans.backward_fill(out.withColumn("fb", C("ff")), ["fb"])
    return fx.rounded(out.withColumn("ff0", F.coalesce("ff", F.lit(0.0))), "symbol", "dt", "price", "ff", "ff0", "fb")


QUERIES["w45_fill"] = w45_fill
ORACLES["w45_fill"] = f"""{fx.with_views('bars')}, a AS (SELECT symbol, dt, CASE WHEN volume>3 THEN close END AS price FROM bars),
b AS (SELECT *, last_value(price IGNORE NULLS) OVER ({P} ROWS UNBOUNDED PRECEDING) AS ff FROM a),
c AS (SELECT *, first_value(ff IGNORE NULLS) OVER ({P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fb FROM b)
SELECT symbol, dt, {pick(['price', 'ff', 'fb'])}, floor((coalesce(ff,0))*1e6+0.5e0)/1e6 AS ff0 FROM c"""


def w52_session_open(spark, d):
    w = Roller(keys=["symbol"])
    b = fx.bars(spark, d)
    out = b.withColumns({"day_open": F.first("close").over(w.day), "bars_since_open": F.row_number().over(w.day) - 1})
    return fx.rounded(out, "symbol", "dt", "day_open", "bars_since_open")


QUERIES["w52_session_open"] = w52_session_open
ORACLES["w52_session_open"] = f"""{fx.with_views('bars')} SELECT symbol, dt, floor((first_value(close) OVER ({PD}))*1e6+0.5e0)/1e6 AS day_open,
CAST(row_number() OVER ({PD}) - 1 AS INTEGER) AS bars_since_open FROM bars"""

SQRT24 = math.sqrt(24)
