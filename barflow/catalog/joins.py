"""As-of, date and chain joins; daily, higher-timeframe and series packs; kernels with a SQL twin."""
from __future__ import annotations

from pyspark.sql import functions as F

from barflow.catalog import fixtures as fx
from barflow.catalog.sqltext import P, TP, TR, change, diff, expand_rsi, flag, lag, over, roll, stages
from barflow.catalog.windows import CCI, MACD_E, STO, dmi_steps, pick
from barflow.operators import asof, kernels
from barflow.operators.chunks import chunked
from barflow.operators.rolling import Roller
from barflow.plans import bars as bp
from barflow.plans import daily as dp
from barflow.plans import features as ft
from barflow.plans import options as op

C = F.col
QUERIES, ORACLES = {}, {}


def register(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


R = fx.sql_round
V = fx.with_views


@register("j01_asof_join", V("bars", "bars_1d") + f"""
SELECT b.symbol, b.dt, {R('b.close').replace('AS b.close', 'AS close')}, floor((r.d_close)*1e6+0.5e0)/1e6 AS d_close, r.d_dt
FROM bars b ASOF LEFT JOIN (SELECT symbol, dt AS d_dt, dt + INTERVAL 1 DAY AS ready, close AS d_close FROM bars_1d) r
ON b.symbol = r.symbol AND b.dt >= r.ready""")
def j01(spark, d):
    day = fx.bars_1d(spark, d).select("symbol", C("dt").alias("d_dt"), (C("dt") + F.expr("INTERVAL 1 DAY")).alias("ready"),
                                      C("close").alias("d_close"))
    out = asof.asof_join(fx.bars(spark, d), day, ["d_close", "d_dt"], right_time="ready")
    return fx.rounded(out, "symbol", "dt", "close", "d_close", "d_dt")


@register("j01_asof_ticks", V("bars") + """
SELECT t.symbol, t.seq, floor((t.price)*1e6+0.5e0)/1e6 AS price, floor((b.close)*1e6+0.5e0)/1e6 AS last_close
FROM ticks t ASOF LEFT JOIN (SELECT symbol, dt + INTERVAL 1 HOUR AS ready, close FROM bars) b ON t.symbol=b.symbol AND t.ts >= b.ready""")
def j01_ticks(spark, d):
    ready = fx.bars(spark, d).select("symbol", (C("dt") + F.expr("INTERVAL 1 HOUR")).alias("ready"), C("close").alias("last_close"))
    out = asof.asof_join(fx.ticks(spark, d), ready, ["last_close"], left_time="ts", right_time="ready")
    return fx.rounded(out, "symbol", "seq", "price", "last_close")


CHAIN_DAY = """sp AS (SELECT trade_date, arg_max(strike, oi*1000000 - strike) AS spot_est FROM (SELECT trade_date, strike, sum(open_int) AS oi
      FROM chain WHERE option_type='CE' AND open_int>0 GROUP BY 1,2) GROUP BY 1),
  st AS (SELECT trade_date, CAST(strike AS DOUBLE) AS strike, sum(CASE WHEN option_type='CE' THEN open_int ELSE 0 END) AS ce_oi,
      sum(CASE WHEN option_type='PE' THEN open_int ELSE 0 END) AS pe_oi FROM chain WHERE open_int>0 GROUP BY 1,2),
  pn AS (SELECT a.trade_date, a.strike, sum(CASE WHEN b.strike<a.strike THEN (a.strike-b.strike)*b.ce_oi ELSE 0 END)
      + sum(CASE WHEN b.strike>a.strike THEN (b.strike-a.strike)*b.pe_oi ELSE 0 END) AS pain
      FROM st a JOIN st b USING (trade_date) JOIN sp USING (trade_date) WHERE abs(a.strike-spot_est)<=1500 GROUP BY 1,2),
  mp AS (SELECT trade_date, min(strike) AS max_pain FROM pn JOIN (SELECT trade_date, min(round(pain,3)) AS low FROM pn GROUP BY 1) USING (trade_date)
      WHERE round(pain,3)=low GROUP BY 1),
  tot AS (SELECT trade_date, sum(CASE WHEN option_type='PE' THEN open_int ELSE 0 END) AS pe, sum(CASE WHEN option_type='CE' THEN open_int ELSE 0 END) AS ce,
      sum(CASE WHEN option_type='PE' THEN chg_oi ELSE -chg_oi END) AS build FROM chain WHERE open_int>0 GROUP BY 1),
  cd AS (SELECT trade_date, CAST(spot_est AS DOUBLE) AS spot_est, pe/(ce+1e-9) AS pcr_oi,
      coalesce(sum(open_int) FILTER (option_type='CE' AND strike=spot_est),0) AS atm_ce_oi,
      coalesce(sum(open_int) FILTER (option_type='PE' AND strike=spot_est),0) AS atm_pe_oi,
      coalesce(avg(close) FILTER (option_type='PE' AND strike=spot_est),0) - coalesce(avg(close) FILTER (option_type='CE' AND strike=spot_est),0) AS iv_skew,
      build AS oi_buildup, max_pain, (max_pain-spot_est)/(spot_est+1e-9)*100 AS max_pain_dist
      FROM chain JOIN sp USING (trade_date) JOIN tot USING (trade_date) JOIN mp USING (trade_date) WHERE open_int>0
      GROUP BY trade_date, spot_est, pe, ce, build, max_pain)"""
CC = ("spot_est",) + op.CHAIN_COLUMNS


@register("a02_option_chain_daily", f"{V('chain')}, {CHAIN_DAY} SELECT trade_date, {R(*CC)} FROM cd")
def a02(spark, d):
    return fx.rounded(op.option_chain_daily(fx.chain(spark, d)), "trade_date", *CC)


@register("j11_max_pain", f"{V('chain')}, {CHAIN_DAY} SELECT trade_date, {R('spot_est', 'max_pain')} FROM cd")
def j11(spark, d):
    return fx.rounded(op.option_chain_daily(fx.chain(spark, d)), "trade_date", "spot_est", "max_pain")


VOL_DAY = """oi AS (SELECT trade_date, strike, sum(CASE WHEN option_type='CE' THEN open_int ELSE 0 END) AS ce FROM chain GROUP BY 1,2 HAVING count(*) FILTER (option_type='CE')>0),
  sp AS (SELECT trade_date, CAST(arg_max(strike, ce*1000000 - strike) AS DOUBLE) AS s FROM oi WHERE ce>0 GROUP BY 1),
  vd AS (SELECT trade_date, s, sum(contracts) FILTER (option_type='PE')/(sum(contracts) FILTER (option_type='CE')+1e-9) AS pcr_vol,
      sum(open_int) FILTER (option_type='PE')/(sum(open_int) FILTER (option_type='CE')+1e-9) AS pcr_oi,
      coalesce(avg(close) FILTER (option_type='CE' AND strike=s),0)/(s+1e-9)*sqrt(252)*100 AS atm_iv_ce,
      coalesce(avg(close) FILTER (option_type='PE' AND strike=s),0)/(s+1e-9)*sqrt(252)*100 AS atm_iv_pe
      FROM chain JOIN sp USING (trade_date) GROUP BY 1,2),
  vv AS (SELECT trade_date, coalesce(pcr_vol,0) AS pcr_vol, coalesce(pcr_oi,0)-coalesce(pcr_vol,0) AS pcr_oi_vol_diff, atm_iv_ce, atm_iv_pe, (atm_iv_ce+atm_iv_pe)/2 AS atm_iv_avg FROM vd)"""


@register("a03_option_volume_daily", f"{V('chain')}, {VOL_DAY} SELECT trade_date, {R(*op.VOLUME_COLUMNS)} FROM vv")
def a03(spark, d):
    return fx.rounded(op.option_volume_daily(fx.chain(spark, d)), "trade_date", *op.VOLUME_COLUMNS)


@register("p06_open_interest_filter", f"{V('chain')} SELECT trade_date, CAST(strike AS DOUBLE) AS strike, option_type, {R('open_int')} FROM chain WHERE open_int>100")
def p06(spark, d):
    live = fx.chain(spark, d).withColumn("open_int", F.when(C("open_int") > 100, C("open_int")).otherwise(0.0))
    return fx.rounded(op.open_interest_rows(live), "trade_date", "strike", "option_type", "open_int")


def attach_sql(columns, src, date, how):
    """Session-level attach: ``how`` is the date shift applied to the source or to the sessions."""
    fills = ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY trade_date ROWS UNBOUNDED PRECEDING),0e0) AS {c}"
                      for c in columns)
    dates = "dm AS (SELECT symbol, trade_date, lag(trade_date) OVER (PARTITION BY symbol ORDER BY trade_date) AS prv FROM (SELECT DISTINCT symbol, trade_date FROM obars))"
    if how == "prev":
        j = f"SELECT dm.symbol, dm.trade_date, {', '.join(columns)} FROM dm LEFT JOIN {src} x ON x.{date}=dm.prv"
    else:
        j = (f"SELECT dm.symbol, dm.trade_date, {', '.join(columns)} FROM dm LEFT JOIN (SELECT *, lead({date}) OVER (ORDER BY {date}) AS nx FROM {src}) x "
             "ON x.nx=dm.trade_date")
    return f"{dates}, jn AS ({j}), fl AS (SELECT symbol, trade_date, {fills} FROM jn)"


@register("j03_join_prev_session", f"""{V('obars', 'chain')}, {CHAIN_DAY}, {attach_sql(op.CHAIN_COLUMNS, 'cd', 'trade_date', 'prev')},
g AS (SELECT *, (atm_pe_oi-atm_ce_oi)/(atm_ce_oi+atm_pe_oi+1e-9) AS atm_oi_skew FROM fl)
SELECT b.symbol, b.dt, {R(*op.CHAIN_COLUMNS, 'atm_oi_skew')} FROM obars b JOIN g USING (symbol, trade_date)""")
def j03(spark, d):
    out = asof.join_previous_session(fx.obars(spark, d), op.option_chain_daily(fx.chain(spark, d)), list(op.CHAIN_COLUMNS))
    return fx.rounded(op.oi_skew(out), "symbol", "dt", *op.CHAIN_COLUMNS, "atm_oi_skew")


def series_query(name, pack, columns, sql):
    def run(spark, d):
        return fx.rounded(dp.attach_series(fx.obars(spark, d), pack(fx.daily(spark, d)), columns), "symbol", "dt", *columns, places=9)
    QUERIES[name] = run
    ORACLES[name] = f"""{V('obars', 'daily')}, pk AS ({sql}), {attach_sql(columns, 'pk', 'date', 'next')}
SELECT b.symbol, b.dt, {R(*columns, places=9)} FROM obars b JOIN fl USING (symbol, trade_date)"""


M5 = "avg(vix_close) OVER (ORDER BY date ROWS 4 PRECEDING)"
series_query("w39_vix_pack", dp.vix_pack, ["day_vix", "day_vix_regime", "day_vix_chg"],
             f"SELECT date, vix_close AS day_vix, CASE WHEN vix_close>0 AND vix_close<=13 THEN 0e0 WHEN vix_close>13 AND vix_close<=20 THEN 1e0 "
             f"WHEN vix_close>20 AND vix_close<=999 THEN 2e0 END AS day_vix_regime, (vix_close-{M5})/({M5}+1e-9)*100 AS day_vix_chg FROM daily")
series_query("w40_flow_pack", dp.flow_pack, ["fii_net_buy", "dii_net_buy", "fii_dii_net", "fii_flow_regime", "fii_5d_cumulative"],
             "SELECT date, fii_net_buy, dii_net_buy, fii_net_buy+dii_net_buy AS fii_dii_net, CASE WHEN fii_net_buy>-999999 AND fii_net_buy<=-2000 THEN -1e0 "
             "WHEN fii_net_buy>-2000 AND fii_net_buy<=2000 THEN 0e0 WHEN fii_net_buy>2000 AND fii_net_buy<=999999 THEN 1e0 END AS fii_flow_regime, "
             "sum(fii_net_buy) OVER (ORDER BY date ROWS 4 PRECEDING) AS fii_5d_cumulative FROM daily")
series_query("w41_world_pack", dp.world_pack, ["world_ret_1d", "world_ret_5d", "global_risk_on"],
             "SELECT *, CASE WHEN world_ret_1d>-999 AND world_ret_1d<=-0.5 THEN -1e0 WHEN world_ret_1d>-0.5 AND world_ret_1d<=0.5 THEN 0e0 "
             "WHEN world_ret_1d>0.5 AND world_ret_1d<=999 THEN 1e0 END AS global_risk_on FROM (SELECT date, (close/lag(close) OVER (ORDER BY date)-1)*100 AS world_ret_1d, "
             "(close/lag(close,5) OVER (ORDER BY date)-1)*100 AS world_ret_5d FROM daily)")
series_query("j04_join_next_date", lambda s: s.select("date", "vix_close"), ["vix_close"], "SELECT date, vix_close FROM daily")


@register("s02_missing_source", V("obars") + " SELECT symbol, dt, 0e0 AS day_vix, 0e0 AS day_vix_chg FROM obars")
def s02(spark, d):
    return dp.attach_series(fx.obars(spark, d), None, ["day_vix", "day_vix_chg"]).select("symbol", "dt", "day_vix", "day_vix_chg")


@register("j06_map_lookup", V("obars", "chain") + """, m AS (SELECT symbol, trade_date, CASE WHEN close>open THEN 0 WHEN close<open THEN 2 END AS regime FROM obars WHERE volume>1)
SELECT b.symbol, b.dt, coalesce(m.regime, 1) AS regime FROM obars b LEFT JOIN m USING (symbol, trade_date)""")
def j06(spark, d):
    b = fx.obars(spark, d)
    m = b.where("volume > 1").withColumn("regime", F.when(C("close") > C("open"), 0).when(C("close") < C("open"), 2))
    return asof.lookup_by_date(b, m, "regime", 1).select("symbol", "dt", "regime")


@register("j09_nearest_expiry", V("obars", "chain") + """, ex AS (SELECT DISTINCT trade_date + INTERVAL 20 DAY AS e FROM chain)
SELECT trade_date, CAST(min(e) AS DATE) AS expiry FROM (SELECT DISTINCT trade_date FROM obars) LEFT JOIN ex ON CAST(e AS DATE) >= trade_date GROUP BY 1""")
def j09(spark, d):
    expiries = fx.chain(spark, d).select(F.date_add("trade_date", 20).alias("expiry"))
    return op.nearest_expiry(fx.obars(spark, d).select("trade_date"), expiries).select("trade_date", "expiry")


@register("j10_nearest_strike", V("chain", "daily") + """, sp AS (SELECT date_trunc('month', date)::DATE AS trade_date, avg(vix_close)*100 AS spot FROM daily GROUP BY 1)
SELECT trade_date, CAST(arg_min(strike, abs(strike-spot)*1000000+strike) AS BIGINT) AS atm_strike FROM chain JOIN sp USING (trade_date) GROUP BY 1""")
def j10(spark, d):
    spot = fx.daily(spark, d).groupBy(F.to_date(F.date_trunc("month", "date")).alias("trade_date")).agg((F.avg("vix_close") * 100).alias("spot"))
    out = op.nearest_strike(fx.chain(spark, d).join(spot, "trade_date"), "spot")
    return out.select("trade_date", C("atm_strike").cast("bigint").alias("atm_strike"))


# --- daily and higher-timeframe packs -------------------------------------------------------------------------------
def daily_steps():
    d14, d15 = dmi_steps(14), CCI
    return ({"d": diff("close"), "r1": change("close")}, expand_rsi("day_rsi", 14), *d14, {"day_adx": "adx_14"},
            *d15, {"day_cci": "cci_20"}, *STO[:2], {"day_stoch_k": "stoch_k"},
            {"ma20": roll("avg", "close", 20), "sd": roll("stddev_samp", "close", 20), "ma50": roll("avg", "close", 50),
             "ma200": roll("avg", "close", 200), "atr": roll("avg", "tr", 14), "day_vol_20": f"({roll('stddev_samp', 'r1', 20)})*100"},
            {**{f"day_ret_{n}": f"{change('close', n)}*100" for n in (1, 5, 20)}, "weekly_ret": f"{change('close', 5)}*100",
             "monthly_ret": f"{change('close', 21)}*100", "day_atr_pct": "atr/(close+1e-9)*100",
             "day_bb_pos": "(close-(ma20-2*sd))/(4*sd+1e-9)", "day_above_ma50": flag("close>ma50"), "day_above_ma200": flag("close>ma200"),
             "prev_close": lag("close"), "prev_high": lag("high"), "prev_low": lag("low"),
             "day_trend_strength": "(close-ma200)/(day_vol_20*ma200/100+1e-9)"},
            {"day_iv_proxy": "day_atr_pct*sqrt(252)"}, {"seen": over("list(day_iv_proxy)", "251 PRECEDING", "CURRENT ROW")},
            {"known": "list_filter(seen, lambda x: x IS NOT NULL)"},
            {"day_iv_rank": "CASE WHEN len(known)>=50 AND day_iv_proxy IS NOT NULL THEN (len(list_filter(known, lambda x: x<day_iv_proxy)) + "
                            "(len(list_filter(known, lambda x: x=day_iv_proxy))+1)/2e0)/len(known)*100 END"})


def fix_cci(steps):
    # CCI and DMI stages both build a column named like an earlier one; keep names apart.
    out = []
    for s in steps:
        out.append({("cma" if k == "ma" else k): (v.replace("ma)", "cma)").replace("-ma", "-cma") if k in ("md", "cci_20") else v)
                    for k, v in s.items()})
    return out


DSTEPS = fix_cci(daily_steps())
DTEXT, DLAST = stages("obars", *DSTEPS)
DC = [c for c in dp.DAILY]
DINT = {"day_above_ma50", "day_above_ma200"}
DPICK = ", ".join(c if c in DINT else f"floor(({c})*1e6+0.5e0)/1e6 AS {c}" for c in DC)


@register("w38_daily_pack", f"{V('obars')},\n{DTEXT}\nSELECT symbol, dt, {DPICK} FROM {DLAST}")
def w38(spark, d):
    return fx.rounded(dp.daily_pack(fx.obars(spark, d)), "symbol", "dt", *DC)


# Two bars a session: the daily bar and a copy twelve hours later, so that attaching by session is visible.
HALF = ("hb AS (SELECT symbol, dt, open, high, low, close, volume, trade_date FROM obars UNION ALL SELECT symbol, dt + INTERVAL 12 HOUR, "
        "close, high, low, open, volume, trade_date FROM obars)")


def half_bars(spark, d):
    b = fx.obars(spark, d).drop("minute_of_day")
    late = b.select("symbol", (C("dt") + F.expr("INTERVAL 12 HOUR")).alias("dt"), C("close").alias("open"), "high", "low",
                    C("open").alias("close"), "volume", "trade_date")
    return b.unionByName(late)


GAPS = ("gap_pct", "above_prev_close", "dist_prev_hi", "dist_prev_lo")


def attach_daily_sql(compat):
    cols = [c for c in DC if not c.startswith("prev_")]
    own = ", ".join(cols) + (", prev_close, prev_high, prev_low" if compat else ", close AS prev_close, high AS prev_high, low AS prev_low")
    src = f"(SELECT symbol, trade_date AS sd, {own} FROM {DLAST}" + (" WHERE prev_close IS NOT NULL)" if compat else ")")
    key = "dm.trade_date" if compat else "dm.prv"
    fills = ", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY trade_date ROWS UNBOUNDED PRECEDING) AS {c}" for c in DC)
    zero = ", ".join(f"coalesce({c},0) AS {c}" if c in DINT else f"floor((coalesce({c},0))*1e6+0.5e0)/1e6 AS {c}" for c in DC)
    return f"""{V('obars')},\n{DTEXT}, {HALF}, dm AS (SELECT symbol, trade_date, lag(trade_date) OVER (PARTITION BY symbol ORDER BY trade_date) AS prv
  FROM (SELECT DISTINCT symbol, trade_date FROM hb)), jn AS (SELECT dm.symbol, dm.trade_date, {', '.join('x.' + c for c in DC)} FROM dm LEFT JOIN {src} x ON x.symbol=dm.symbol AND x.sd={key}),
  fl AS (SELECT symbol, trade_date, {fills} FROM jn), o AS (SELECT hb.*, first_value(hb.open) OVER (PARTITION BY symbol, trade_date ORDER BY dt) AS dop FROM hb),
  z AS (SELECT o.symbol, o.dt, o.close, o.dop, fl.* EXCLUDE (symbol, trade_date) FROM o JOIN fl USING (symbol, trade_date))
SELECT symbol, dt, {zero}, floor((coalesce((dop-prev_close)/(prev_close+1e-9)*100,0))*1e6+0.5e0)/1e6 AS gap_pct, CASE WHEN close>prev_close THEN 1 ELSE 0 END AS above_prev_close,
  floor((coalesce((close-prev_high)/(close+1e-9)*100,0))*1e6+0.5e0)/1e6 AS dist_prev_hi, floor((coalesce((close-prev_low)/(close+1e-9)*100,0))*1e6+0.5e0)/1e6 AS dist_prev_lo FROM z"""


@register("j05_join_daily", attach_daily_sql(False))
def j05(spark, d):
    return fx.rounded(dp.attach_daily(half_bars(spark, d), fx.obars(spark, d)), "symbol", "dt", *DC, *GAPS)


@register("j05_join_daily_compat", attach_daily_sql(True))
def j05c(spark, d):
    return fx.rounded(dp.attach_daily(half_bars(spark, d), fx.obars(spark, d), compat=True), "symbol", "dt", *DC, *GAPS)


HN = ["ret_1", "ret_3"] + list(dp.HTF)
HSTEPS = fix_cci(({"d": diff("close"), "r1": change("close"), "typ": TP}, expand_rsi("rsi", 14), *dmi_steps(14), *CCI, *STO[:2],
                  {"ma20": roll("avg", "close", 20), "sd": roll("stddev_samp", "close", 20), "atr": roll("avg", "tr", 14)},
                  {"ret_1": f"({lag('close')}/{lag('close', 2)}-1)*100", "ret_3": f"({lag('close')}/{lag('close', 4)}-1)*100",
                   "bb_pos": "(close-(ma20-2*sd))/(4*sd+1e-9)", "atr_pct": "atr/(close+1e-9)*100", "vol_10": f"({roll('stddev_samp', 'r1', 10)})*100",
                   "above_vwap": f"CAST({flag('close>' + over('avg(typ)', 'UNBOUNDED PRECEDING', 'CURRENT ROW'))} AS DOUBLE)",
                   "close_chg": f"{lag('close')}-{lag('close', 2)}"}))
HTEXT, HLAST = stages("obars", *HSTEPS)
HEMA = """num2 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS rn FROM obars),
e2 AS (SELECT symbol, dt, rn, close AS e9, close AS e21 FROM num2 WHERE rn=1 UNION ALL SELECT n.symbol, n.dt, n.rn, e2.e9*0.8e0+n.close*0.2e0,
 e2.e21*(1-2e0/22)+n.close*(2e0/22) FROM e2 JOIN num2 n ON n.symbol=e2.symbol AND n.rn=e2.rn+1)"""


def htf_sql(tail):
    def ff(c):
        return f"last_value({c} IGNORE NULLS) OVER ({P} ROWS UNBOUNDED PRECEDING)"
    same = [c for c in HN if c not in ("macd_h", "adx", "cci", "ema9_21")]
    return (V("obars").replace("WITH ", "WITH RECURSIVE ", 1) + f",\n{MACD_E.format(src='obars')},\n{HEMA},\n{HTEXT},\n"
            f"h0 AS (SELECT l.symbol, l.dt, {', '.join('l.' + c for c in same)}, l.adx_14 AS adx0, l.cci_20 AS cci0, "
            f"((e1-e2.e2x)-sg)/(l.close+1e-10)*100 AS macd0, CAST(sign(e9-e21) AS DOUBLE) AS ema9_21 FROM {HLAST} l JOIN (SELECT symbol, dt, e1, e2 AS e2x, sg FROM e) e2 USING (symbol, dt) "
            f"JOIN (SELECT symbol, dt, e9, e21 FROM e2) z USING (symbol, dt)),\n"
            f"h AS (SELECT *, {ff('adx0')} AS adx, {ff('cci0')} AS cci, {ff('macd0')} AS macd_h FROM h0)\n{tail}")


@register("w37_htf_pack", htf_sql("SELECT symbol, dt, " + ", ".join(f"floor(({c})*1e6+0.5e0)/1e6 AS tf_{c}" for c in HN) + " FROM h"))
def w37(spark, d):
    return fx.rounded(dp.htf_pack(fx.obars(spark, d), "tf_", bucket="year"), "symbol", "dt", *["tf_" + c for c in HN])


HFILL = ", ".join(f"coalesce(last_value({c} IGNORE NULLS) OVER ({P} ROWS UNBOUNDED PRECEDING),0) AS {c}" for c in HN)
for _name, _compat, _shift in (("j02_attach_htf", False, "dt + INTERVAL 1 DAY"), ("j02_attach_htf_compat", True, "dt")):
    _hsrc = "h" if not _compat else (
        "(SELECT * REPLACE (" + ", ".join(f"coalesce({c}, first_value({c} IGNORE NULLS) OVER ({P} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS {c}"
                                          for c in ("adx", "cci", "macd_h")) + ") FROM h)")

    def _run(spark, d, compat=_compat):
        out = dp.attach_htf(half_bars(spark, d), fx.obars(spark, d), "tf_", "1 DAY", htf_bucket="year", bucket="month", compat=compat)
        return fx.rounded(out, "symbol", "dt", *["tf_" + c for c in HN])
    QUERIES[_name] = _run
    ORACLES[_name] = htf_sql(f""", {HALF}, rdy AS (SELECT symbol AS rs, {_shift} AS rt, {', '.join(HN)} FROM {_hsrc} q WHERE rsi IS NOT NULL AND macd_h IS NOT NULL),
aj AS (SELECT hb.symbol, hb.dt, {', '.join('rdy.' + c for c in HN)} FROM hb ASOF LEFT JOIN rdy ON hb.symbol=rdy.rs AND hb.dt>=rdy.rt), fz AS (SELECT symbol, dt, {HFILL} FROM aj)
SELECT symbol, dt, """ + ", ".join(f"floor(({c})*1e6+0.5e0)/1e6 AS tf_{c}" for c in HN) + " FROM fz")

# --- kernels --------------------------------------------------------------------------------------------------------
RANK = ("CASE WHEN len(k)>={m} AND x IS NOT NULL THEN (len(list_filter(k, lambda y: y<x)) + (len(list_filter(k, lambda y: y=x))+1)/2e0)/len(k)*100 END")
_t, _l = stages("bars", {"tr": TR}, {"atr": roll("avg", "tr", 14)}, {"p": "atr/(close+1e-9)*100*sqrt(24)"},
                {"x": "CASE WHEN p IS NOT NULL THEN greatest(0.02e0, least(3e0, p)) END"},
                {"k": f"list_filter({over('list(x)', '479 PRECEDING', 'CURRENT ROW')}, lambda y: y IS NOT NULL)"}, {"iv_rank": RANK.format(m=24)})


@register("w06_rolling_rank", f"{V('bars')},\n{_t}\nSELECT symbol, dt, {pick(['iv_rank'])} FROM {_l}")
def w06(spark, d):
    out = ft.add_features(fx.bars(spark, d), "atr", bars_per_day=24)
    return fx.rounded(kernels.add_rolling_rank(out, "iv_final", "iv_rank", 480, 24), "symbol", "dt", "iv_rank")


FD = """WITH RECURSIVE wt AS (SELECT 0 AS k, 1e0 AS w UNION ALL SELECT k+1, -w*(0.35e0-(k+1)+1)/(k+1) FROM wt WHERE abs(-w*(0.35e0-(k+1)+1)/(k+1)) >= 1e-4),
wl AS (SELECT list(w ORDER BY k DESC) AS ws, count(*) AS n FROM wt)"""
_t, _l = stages("bars", {"r5": f"CASE WHEN trade_date={lag('trade_date', 5)} THEN ({lag('close')}/{lag('close', 6)}-1)*100 ELSE 0e0 END"},
                {"r": "coalesce(r5,0)"}, {"cl": over("list(close)", "331 PRECEDING", "CURRENT ROW"), "rl": over("list(r)", "331 PRECEDING", "CURRENT ROW")})


@register("w44_fracdiff", f"{FD}, {V('bars')[5:]},\n{_t}\nSELECT symbol, dt, CASE WHEN len(cl)=n THEN floor((list_dot_product(cl, ws))*1e6+0.5e0)/1e6 END AS close_fd, "
          f"CASE WHEN len(rl)=n THEN floor((list_dot_product(rl, ws))*1e6+0.5e0)/1e6 END AS ret5m_fd FROM {_l}, wl")
def w44(spark, d):
    out = ft.add_features(fx.bars(spark, d), "returns").withColumn("_r", F.coalesce("ret_5m", F.lit(0.0)))
    return fx.rounded(kernels.add_fracdiff(out, {"close_fd": "close", "ret5m_fd": "_r"}), "symbol", "dt", "close_fd", "ret5m_fd")


_t, _l = stages("bars", {"tr": TR, "pc": lag("close")}, {"a": roll("avg", "tr", 10)}, {"ub": "(high+low)/2+3*a", "lb": "(high+low)/2-3*a"})
ST = f"""{V('bars').replace('WITH ', 'WITH RECURSIVE ', 1)},
{_t}, num AS (SELECT *, row_number() OVER ({P}) AS rn FROM {_l} WHERE a IS NOT NULL),
st AS (SELECT symbol, dt, rn, ub AS u, lb AS l, 1 AS dir FROM num WHERE rn=1 UNION ALL
 SELECT symbol, dt, rn, u, l, CASE WHEN pdir=-1 AND close>u THEN 1 WHEN pdir=1 AND close<l THEN -1 ELSE pdir END FROM (
 SELECT n.symbol, n.dt, n.rn, n.close, st.dir AS pdir, CASE WHEN n.ub<st.u OR n.pc>st.u THEN n.ub ELSE st.u END AS u,
 CASE WHEN n.lb>st.l OR n.pc<st.l THEN n.lb ELSE st.l END AS l FROM st JOIN num n ON n.symbol=st.symbol AND n.rn=st.rn+1) x)
SELECT b.symbol, b.dt, floor((u)*1e6+0.5e0)/1e6 AS st_upper, floor((l)*1e6+0.5e0)/1e6 AS st_lower, CAST(coalesce(dir,1) AS DOUBLE) AS supertrend FROM bars b LEFT JOIN st USING (symbol, dt)"""


@register("q01_supertrend", ST)
def q01(spark, d):
    return fx.rounded(kernels.add_supertrend(fx.bars(spark, d)), "symbol", "dt", "st_upper", "st_lower", "supertrend")


@register("f32_cycle")
def f32(spark, d):
    w = Roller()
    out = kernels.add_cycle(fx.bars(spark, d), 250)

    def smooth(df):
        seen = F.collect_list("cycle_period").over(w.frame(-9, 0))
        ew = F.aggregate(F.slice("_seen", 2, 9), F.element_at("_seen", 1), lambda a, x: a * (1 - 2.0 / 11) + x * (2.0 / 11))
        val = F.when(F.size("_seen") >= 3, ew).otherwise(C("cycle_period"))
        return (df.withColumn("_seen", seen).withColumn("cycle_smooth", val).drop("_seen")
                .withColumn("cycle_hint", F.when(C("cycle_smooth") < 35, "CHOP").when(C("cycle_smooth") > 60, "TREND").otherwise("NEUTRAL")))
    return fx.rounded(chunked(out, smooth, 9), "symbol", "dt", "cycle_period", "cycle_smooth", "cycle_hint")


# --- grid, drawdown, candles ----------------------------------------------------------------------------------------
for _name, _within in (("w46_gap_fill", True), ("w46_gap_fill_overnight", False)):
    _by = "symbol, trade_date" if _within else "symbol"

    def _run(spark, d, within=_within):
        return fx.rounded(bp.fill_grid(fx.bars(spark, d), "1 hour", within), "symbol", "dt", "close", "volume", "filled")
    QUERIES[_name] = _run
    ORACLES[_name] = f"""{V('bars')}, n AS (SELECT *, lead(dt) OVER (PARTITION BY {_by} ORDER BY dt) AS nx FROM bars),
g AS (SELECT symbol, dt AS t0, close, volume, unnest(generate_series(dt, coalesce(nx - INTERVAL 1 HOUR, dt), INTERVAL 1 HOUR)) AS dt FROM n)
SELECT symbol, dt, floor((close)*1e6+0.5e0)/1e6 AS close, volume, CASE WHEN dt<>t0 THEN 1 ELSE 0 END AS filled FROM g"""


@register("s09_merge_candles", V("bars") + """, f AS (SELECT symbol, dt, close*1.01e0 AS close FROM bars WHERE volume>4)
SELECT b.symbol, b.dt, floor((coalesce(f.close, b.close))*1e6+0.5e0)/1e6 AS close, b.volume FROM bars b LEFT JOIN f USING (symbol, dt)""")
def s09(spark, d):
    b = fx.bars(spark, d)
    fresh = b.where("volume > 4").withColumn("close", C("close") * 1.01)
    return fx.rounded(bp.merge_candles(b, fresh), "symbol", "dt", "close", "volume")


QUERIES["u02_upsert"], ORACLES["u02_upsert"] = QUERIES["s09_merge_candles"], ORACLES["s09_merge_candles"]
