"""Hygiene, clock, validation, dedup, top-k, union and streaming-twin queries."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barflow import constants as k
from barflow.catalog import fixtures as fx
from barflow.catalog.sqltext import P, PD, diff, lag, over, roll, stages
from barflow.functions import numeric as num
from barflow.plans import bars as bp
from barflow.plans import features as ft
from barflow.plans import quality as ql

C = F.col
QUERIES, ORACLES = {}, {}
R, V = fx.sql_round, fx.with_views


def register(name, sql=None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return wrap


# Dirty bars: hourly bars with defects put in by volume, so that every defect grows with the data.
DIRTY = """dirty AS (SELECT symbol, dt, trade_date, minute_of_day, CASE WHEN volume=7 THEN NULL ELSE open END AS open, CASE WHEN volume=1 THEN low-1 ELSE high END AS high,
  CASE WHEN volume=6 THEN -low WHEN volume=8 THEN close+1 ELSE low END AS low, close, volume FROM bars)"""


def dirty(spark, d):
    v = C("volume")
    return fx.bars(spark, d).select("symbol", "dt", "trade_date", "minute_of_day", F.when(v != 7, C("open")).alias("open"),
                                    F.when(v == 1, C("low") - 1).otherwise(C("high")).alias("high"),
                                    F.when(v == 6, -C("low")).when(v == 8, C("close") + 1).otherwise(C("low")).alias("low"), "close", "volume")


@register("p01_valid_ohlc", f"""{V('bars')}, {DIRTY} SELECT symbol, dt, {R('high', 'low', 'close')} FROM dirty
WHERE NOT coalesce(high<open OR high<close OR low>open OR low>close OR high<low OR high<=0 OR low<=0, false)""")
def p01(spark, d):
    return fx.rounded(bp.valid_ohlc(dirty(spark, d)), "symbol", "dt", "high", "low", "close")


@register("p02_drop_null_ohlc", f"{V('bars')}, {DIRTY} SELECT symbol, dt, {R('open', 'close')} FROM dirty WHERE open IS NOT NULL AND high IS NOT NULL AND low IS NOT NULL AND close IS NOT NULL")
def p02(spark, d):
    return fx.rounded(bp.drop_null_ohlc(dirty(spark, d)), "symbol", "dt", "open", "close")


@register("p03_full_sessions", f"{V('bars')} SELECT symbol, dt, {R('close')} FROM bars QUALIFY count(*) OVER (PARTITION BY symbol, trade_date) >= 23")
def p03(spark, d):
    return fx.rounded(bp.full_sessions(fx.bars(spark, d), 23), "symbol", "dt", "close")


@register("s03_min_rows", f"{V('bars')} SELECT symbol, count(*) AS n FROM bars GROUP BY 1 HAVING count(*) >= 300")
def s03(spark, d):
    return fx.bars(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).where("n >= 300")


CLOCK = ("trade_date", "minute_of_day", "session_pct", "dow", "is_expiry", "session_open", "session_pm")


@register("p04_session_clock", f"{V('bars')} SELECT symbol, dt, trade_date, minute_of_day, {R('session_pct', 'dow')}, is_expiry, session_open, session_pm FROM bars")
def p04(spark, d):
    return fx.rounded(fx.bars(spark, d), "symbol", "dt", *CLOCK)


@register("p05_calendar", V("bars") + """ SELECT symbol, dt, CAST(isodow(dt)-1 AS DOUBLE) AS day_of_week, CASE WHEN isodow(dt)=1 THEN 1e0 ELSE 0e0 END AS is_monday,
CASE WHEN isodow(dt)=5 THEN 1e0 ELSE 0e0 END AS is_friday, CASE WHEN isodow(dt)<=2 THEN 1e0 ELSE 0e0 END AS is_expiry_week FROM bars""")
def p05(spark, d):
    return fx.rounded(bp.calendar_features(fx.bars(spark, d)), "symbol", "dt", "day_of_week", "is_monday", "is_friday", "is_expiry_week")


@register("p13_clean_value", V("bars") + f""", x AS (SELECT symbol, dt, CASE WHEN volume=1 THEN 'NaN'::DOUBLE WHEN volume=2 THEN 'Infinity'::DOUBLE WHEN volume=3 THEN NULL ELSE close END AS v FROM bars)
SELECT symbol, dt, floor((CASE WHEN v IS NULL OR isnan(v) OR isinf(v) THEN -1 ELSE v END)*1e6+0.5e0)/1e6 AS v FROM x""")
def p13(spark, d):
    v = C("volume")
    raw = F.when(v == 1, float("nan")).when(v == 2, float("inf")).when(v != 3, C("close"))
    return fx.rounded(fx.bars(spark, d).withColumn("v", num.clean_value(raw, -1.0)), "symbol", "dt", "v")


FEATS = ["atr_14", "rsi_14", "adx_14", "vwap_dist", "vol_20m", "mfi_14"]


def featured(spark, d):
    return ft.add_features(fx.bars(spark, d), "atr", "rsi", "dmi", "vwap", "volatility", "mfi", bars_per_day=24)


def feat_sql():
    from barflow.catalog.windows import MFI, VW, dmi_steps
    from barflow.catalog.sqltext import TR, change, expand_rsi
    return stages("bars", {"d": diff("close"), "r1": f"{change('close')}*100"}, *dmi_steps(14), {"atr_14": roll("avg", "tr", 14)}, expand_rsi("rsi_14", 14),
                  *VW, {"vol_20m": roll("stddev_samp", "r1", 20)}, *MFI)


FT, FL = feat_sql()


@register("p14_validate_row", f"""{V('bars')},\n{FT}, m AS (SELECT symbol, dt, {' + '.join(f'(CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN 1 ELSE 0 END)' for c in FEATS)} AS bad,
 list_filter([CASE WHEN close IS NULL THEN 'close' END, CASE WHEN atr_14 IS NULL THEN 'atr_14' END, CASE WHEN rsi_14 IS NULL THEN 'rsi_14' END], lambda x: x IS NOT NULL) AS miss FROM {FL})
SELECT symbol, dt, bad AS bad_features, len(miss)=0 AND NOT bad>1.2 AS row_valid, CASE WHEN len(miss)>0 THEN 'Missing mandatory: '||array_to_string(miss, ',')
 WHEN bad>1.2 THEN 'Too many NaN features: '||bad||'/6' ELSE '' END AS reject_reason FROM m""")
def p14(spark, d):
    out = ql.validate_rows(featured(spark, d), FEATS, ("close", "atr_14", "rsi_14"))
    return out.select("symbol", "dt", "bad_features", "row_valid", "reject_reason")


@register("p15_fill_for_scoring", f"{V('bars')},\n{FT} SELECT symbol, dt, " + ", ".join(f"floor((coalesce({c},0))*1e6+0.5e0)/1e6 AS {c}" for c in FEATS) + f" FROM {FL}")
def p15(spark, d):
    return fx.rounded(featured(spark, d).na.fill(0.0, FEATS), "symbol", "dt", *FEATS)


@register("p10_usable_features", f"{V('bars')},\n{FT} " + " UNION ALL ".join(f"SELECT '{c}' AS feature, count({e}) AS n_known, count(*) AS n_rows, count({e})>0 AS usable FROM {FL}"
                                                                           for c, e in (("atr_14", "atr_14"), ("rsi_14", "rsi_14"), ("adx_14", "adx_14"), ("empty", "CAST(NULL AS DOUBLE)"))))
def p10(spark, d):
    return ql.feature_usability(featured(spark, d).withColumn("empty", F.lit(None).cast("double")), ["atr_14", "rsi_14", "adx_14", "empty"])


@register("p16_column_plumbing", f"{V('bars')} SELECT symbol, dt AS bar_time, {R('close')}, session_open, floor((session_pct)*1e6+0.5e0)/1e6 AS session_pct, session_pm FROM bars")
def p16(spark, d):
    b = fx.bars(spark, d)
    return fx.rounded(b.select("symbol", C("dt").alias("bar_time"), "close", *ft.feature_columns(b, "session_")))


@register("p17_market_time", "SELECT event_id, ts + INTERVAL 330 MINUTE AS market_ts FROM events")
def p17(spark, d):
    return fx.table(spark, d, "events").select("event_id", bp.market_time(C("ts").cast("timestamp")).alias("market_ts"))


@register("p11_feature_allowlist", f"{V('bars')},\n{FT} SELECT symbol, dt, {R('atr_14', 'rsi_14')} FROM {FL}")
def p11(spark, d):
    keep = ql.live_features(["atr_14", "rsi_14", "adx_14", "mfi_14"], ["adx_14", "mfi_14"])
    return fx.rounded(featured(spark, d), "symbol", "dt", *keep)


@register("p12_regime_tiers", f"{V('bars')},\n{FT}, g AS (SELECT *, CASE WHEN adx_14>25 THEN 0 WHEN adx_14>15 THEN 1 ELSE 2 END AS regime FROM {FL})\n"
          "SELECT symbol, dt, regime, floor((CASE WHEN regime=0 THEN vwap_dist END)*1e6+0.5e0)/1e6 AS macd_h, floor((CASE WHEN regime=1 THEN mfi_14 END)*1e6+0.5e0)/1e6 AS stoch_k FROM g")
def p12(spark, d):
    reg = F.when(C("adx_14") > 25, 0).when(C("adx_14") > 15, 1).otherwise(2)
    df = featured(spark, d).withColumns({"regime": reg, "macd_h": C("vwap_dist"), "adx_macd": C("vwap_dist"), "ema9_slope": C("vwap_dist"),
                                         "range_rsi_extr": C("mfi_14"), "stoch_k": C("mfi_14"), "willr": C("mfi_14")})
    return fx.rounded(ql.mask_by_regime(df), "symbol", "dt", "regime", "macd_h", "stoch_k")


# --- dedup ----------------------------------------------------------------------------------------------------------
@register("ad1_keep_last", """SELECT user_id, event_type, max(event_id) AS event_id, floor((arg_max(value, event_id))*1e6+0.5e0)/1e6 AS value FROM events GROUP BY 1,2""")
def ad1(spark, d):
    e = fx.table(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return fx.rounded(bp.keep_last(e, ["user_id", "event_type"], "event_id"))


@register("ad2_keep_last_minute", V("ticks") + " SELECT symbol, date_trunc('minute', ts) AS minute, floor((last(price ORDER BY ts, seq))*1e6+0.5e0)/1e6 AS price FROM ticks GROUP BY 1,2")
def ad2(spark, d):
    t = fx.ticks(spark, d).withColumn("minute", F.window("ts", "1 minute")["start"])
    return fx.rounded(bp.keep_last(t, ["symbol", "minute"], ["ts", "seq"]), "symbol", "minute", "price")


@register("ad3_keep_first_date", V("ticks") + " SELECT symbol, CAST(ts AS DATE) AS date, floor((first(price ORDER BY seq))*1e6+0.5e0)/1e6 AS price FROM ticks GROUP BY 1,2")
def ad3(spark, d):
    t = fx.ticks(spark, d).withColumn("date", F.to_date("ts"))
    return fx.rounded(bp.keep_first(t, ["symbol", "date"], "seq"), "symbol", "date", "price")


# --- sorts, limits, sets --------------------------------------------------------------------------------------------
@register("t01_sort_by_time", f"{V('bars')} SELECT symbol, dt, {R('close')}, CAST(row_number() OVER (PARTITION BY symbol, trade_date ORDER BY dt) AS INTEGER) AS n FROM bars")
def t01(spark, d):
    n = F.row_number().over(Window.partitionBy("symbol", "trade_date").orderBy("dt"))
    return fx.rounded(fx.bars(spark, d).withColumn("n", n), "symbol", "dt", "close", "n")


@register("t02_last_rows", f"{V('bars')} SELECT symbol, dt, {R('close')} FROM bars QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY dt DESC) <= 100")
def t02(spark, d):
    return fx.rounded(bp.last_rows(fx.bars(spark, d), 100, "week"), "symbol", "dt", "close")


def extreme_times(bars):
    """Time of each symbol's highest and lowest bar, the earliest of equal ones; bars without the value do not count."""
    early = -F.unix_seconds(C("dt").cast("timestamp"))
    return bars.groupBy("symbol").agg(F.max_by("dt", F.when(C("high").isNotNull(), F.struct("high", early))).alias("dt_high"),
                                      F.min_by("dt", F.when(C("low").isNotNull(), F.struct("low", "dt"))).alias("dt_low"))


@register("t06_argmax", f"{V('bars')} SELECT symbol, arg_max(dt, high) AS dt_high, arg_min(dt, low) AS dt_low FROM bars GROUP BY 1")
def t06(spark, d):
    return extreme_times(fx.bars(spark, d))


@register("u01_union", V("bars", "bars_1d") + f" SELECT symbol, dt, {R('close')}, '1h' AS timeframe FROM bars UNION ALL SELECT symbol, dt, {R('close')}, '1d' FROM bars_1d")
def u01(spark, d):
    out = fx.bars(spark, d).withColumn("timeframe", F.lit("1h")).unionByName(fx.bars_1d(spark, d).withColumn("timeframe", F.lit("1d")), allowMissingColumns=True)
    return fx.rounded(out, "symbol", "dt", "close", "timeframe")


@register("a04_ohlcv_bars", f"{V('bars')} SELECT symbol, dt, {R('open', 'high', 'low', 'close', 'volume')} FROM bars")
def a04(spark, d):
    return fx.rounded(bp.ohlcv_bars(fx.ticks(spark, d)), "symbol", "dt", "open", "high", "low", "close", "volume")


@register("a04_resample", f"{V('bars_1d')} SELECT symbol, dt, {R('open', 'high', 'low', 'close', 'volume')} FROM bars_1d")
def a04r(spark, d):
    return fx.rounded(bp.resample(fx.bars(spark, d)), "symbol", "dt", "open", "high", "low", "close", "volume")


@register("a04_refresh_last_bar", f"""{V('bars')}, l AS (SELECT symbol, max(dt) AS m FROM bars GROUP BY 1), p AS (SELECT symbol, max(price) AS price FROM ticks GROUP BY 1)
SELECT symbol, dt, floor((CASE WHEN dt=m THEN greatest(high,price) ELSE high END)*1e6+0.5e0)/1e6 AS high, floor((CASE WHEN dt=m THEN least(low,price) ELSE low END)*1e6+0.5e0)/1e6 AS low,
floor((CASE WHEN dt=m THEN price ELSE close END)*1e6+0.5e0)/1e6 AS close FROM bars JOIN l USING (symbol) JOIN p USING (symbol)""")
def a04l(spark, d):
    live = fx.ticks(spark, d).groupBy("symbol").agg(F.max("price").alias("price"))
    return fx.rounded(bp.refresh_last_bar(fx.bars(spark, d), live), "symbol", "dt", "high", "low", "close")


# --- stats, drift, warm-up ------------------------------------------------------------------------------------------
@register("a05_feature_stats", f"{V('bars')},\n{FT} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, floor((avg({c}))*1e6+0.5e0)/1e6 AS mean, floor((stddev_samp({c}))*1e6+0.5e0)/1e6 AS std, count({c}) AS n FROM {FL}" for c in FEATS))
def a05(spark, d):
    return fx.rounded(ql.feature_stats(featured(spark, d), FEATS))


@register("a06_feature_stability", f"""{V('bars')},\n{FT}, o AS (SELECT *, row_number() OVER (ORDER BY dt, symbol) AS pos, count(*) OVER () AS ntot FROM {FL}) """ + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, floor((coalesce(abs(avg({c}) FILTER (pos>ntot-500)-avg({c}) FILTER (pos<=2000))/nullif(stddev_samp({c}) FILTER (pos<=2000),0),0))*1e6+0.5e0)/1e6 AS fsi FROM o" for c in FEATS))
def a06(spark, d):
    return fx.rounded(ql.feature_stability(featured(spark, d), FEATS, 2000, 500))


ZS = {c: f"abs(({c}-(SELECT avg({c}) FROM {FL} WHERE dt < '2024-01-15'))/(SELECT stddev_samp({c}) FROM {FL} WHERE dt < '2024-01-15'))" for c in FEATS}


@register("r10_drift", f"""{V('bars')},\n{FT.replace('AS (SELECT', 'AS MATERIALIZED (SELECT')}, zz AS (SELECT symbol, dt, {', '.join(f'{z} AS z_{c}' for c, z in ZS.items())} FROM {FL}),
mz AS (SELECT *, greatest({', '.join(f'coalesce(z_{c},0)' for c in FEATS)}) AS max_z FROM zz)
SELECT symbol, dt, floor((max_z)*1e6+0.5e0)/1e6 AS max_z, {'+'.join(f'(CASE WHEN z_{c}>8 THEN 1 ELSE 0 END)' for c in FEATS)} AS killed,
{'+'.join(f'(CASE WHEN z_{c}>2.5 AND z_{c}<=8 THEN 1 ELSE 0 END)' for c in FEATS)} AS warned,
CASE WHEN max_z>=8 THEN 0.6e0 WHEN max_z>=5 THEN 0.5e0 WHEN max_z>=2.5 THEN 0.75e0 ELSE 1e0 END AS conf_mult FROM mz""")
def r10(spark, d):
    df = featured(spark, d)
    stats = ql.feature_stats(df.where("dt < '2024-01-15'"), FEATS)
    return fx.rounded(ql.drift_zscores(df, stats, FEATS, ["symbol", "dt"]))


@register("r11_warmup", f"""{V('bars')}, n AS (SELECT *, CAST(row_number() OVER ({PD}) AS INTEGER) AS bars_in_session FROM bars)
SELECT symbol, dt, bars_in_session, CASE WHEN minute_of_day<180 THEN 'OPEN_WINDOW' WHEN bars_in_session<6 THEN 'FEW_BARS' ELSE '' END AS warmup_reason,
NOT (minute_of_day<180 OR bars_in_session<6) AS ready FROM n""")
def r11(spark, d):
    return ql.warmup(fx.bars(spark, d), 180, 6).select("symbol", "dt", "bars_in_session", "warmup_reason", "ready")


# Limits that fit hourly bars whose prices are independent draws, so that valid bars, every kind of error, recovery and the halt all occur.
MAX_STEP_SECONDS, MAX_STEP_PCT = 9000.0, 60.0


def _errors_sql(close, ts):
    """Errors of row ``n`` against a last good close and time."""
    known = "(n.open IS NOT NULL AND n.high IS NOT NULL AND n.low IS NOT NULL AND n.close IS NOT NULL)"
    return f"""list_filter([CASE WHEN NOT {known} OR n.close<=0 THEN 'INVALID_CLOSE' END,
CASE WHEN NOT {known} OR NOT (n.high>=greatest(n.open,n.close) AND least(n.open,n.close)>=n.low AND n.low>=0) THEN 'OHLC_VIOLATION' END,
CASE WHEN {known} AND {close}>0 AND n.close>0 AND abs(n.close-{close})/{close}*100e0>{MAX_STEP_PCT}e0 THEN 'PRICE_GAP' END,
CASE WHEN {ts} IS NOT NULL AND epoch(n.dt)-epoch({ts})>{MAX_STEP_SECONDS}e0 THEN 'TIMESTAMP_GAP' END], lambda x: x IS NOT NULL)"""


VALIDATED = f"""WITH RECURSIVE {V('bars').removeprefix('WITH ')}, {DIRTY}, num AS (SELECT *, row_number() OVER ({PD}) AS rn FROM dirty),
s1 AS (SELECT n.symbol, n.trade_date, n.rn, n.dt, n.close, {_errors_sql('0e0', 'NULL::TIMESTAMP')} AS e FROM num n WHERE rn=1),
v AS (SELECT symbol, trade_date, rn, dt, e, CASE WHEN len(e)=0 THEN 0 ELSE 1 END AS bad, CASE WHEN len(e)=0 THEN close ELSE 0e0 END AS good, CASE WHEN len(e)=0 THEN dt END AS good_dt FROM s1
UNION ALL SELECT q.symbol, q.trade_date, q.rn, q.dt, q.e, CASE WHEN len(q.e)=0 THEN 0 ELSE q.bad+1 END, CASE WHEN len(q.e)=0 THEN q.close ELSE q.good END, CASE WHEN len(q.e)=0 THEN q.dt ELSE q.good_dt END
FROM (SELECT n.symbol, n.trade_date, n.rn, n.dt, n.close, v.bad, v.good, v.good_dt, {_errors_sql('v.good', 'v.good_dt')} AS e
FROM v JOIN num n ON n.symbol=v.symbol AND n.trade_date=v.trade_date AND n.rn=v.rn+1) AS q)
SELECT symbol, dt, len(e)=0 AS bar_valid, array_to_string(e, ',') AS errors, CAST(bad AS INTEGER) AS bad_in_row, bad>={k.HALT_AFTER} AS halt FROM v"""


@register("q09_bar_validation", VALIDATED)
def q09(spark, d):
    return ql.validate_bars(dirty(spark, d), MAX_STEP_SECONDS, MAX_STEP_PCT).select("symbol", "dt", "bar_valid", F.array_join("errors", ",").alias("errors"), "bad_in_row", "halt")


@register("r06_bar_sanity", f"""{V('bars')}, {DIRTY}, e AS (SELECT symbol, dt, list_filter([CASE WHEN coalesce(close<=0,true) THEN 'INVALID_CLOSE' END,
 CASE WHEN coalesce(NOT (high>=greatest(open,close) AND least(open,close)>=low AND low>=0),true) THEN 'OHLC_VIOLATION' END,
 CASE WHEN lag(close) OVER ({PD})>0 AND close>0 AND abs(close-lag(close) OVER ({PD}))/lag(close) OVER ({PD})*100>3 THEN 'PRICE_GAP' END,
 CASE WHEN epoch(dt)-epoch(lag(dt) OVER ({PD}))>9000 THEN 'TIMESTAMP_GAP' END], lambda x: x IS NOT NULL) AS e FROM dirty)
SELECT symbol, dt, array_to_string(e, ',') AS errors FROM e""")
def r06(spark, d):
    out = ql.bar_sanity(dirty(spark, d), 3600)
    return out.select("symbol", "dt", F.array_join("errors", ",").alias("errors"))


__all__ = ["P", "k", "lag", "over"]
