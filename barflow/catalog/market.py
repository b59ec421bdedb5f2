"""Regime and label queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from barflow.catalog import fixtures as fx
from barflow.catalog.quality import FL, FT, featured
from barflow.catalog.sqltext import P, TR, change, diff, expand_rsi, flag, lag, over, roll, stages
from barflow.catalog.windows import SWING, dmi_steps
from barflow.plans import features as ft
from barflow.plans import labels as lb
from barflow.plans import regimes as rg

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


GIN = stages("obars", {"d": diff("close"), "r1": change("close")}, expand_rsi("rsi0", 14), *dmi_steps(14),
             {"tr2": TR, "sd": roll("stddev_samp", "r1", 20), "ma": roll("avg", "close", 50)}, {"a": roll("avg", "tr", 14)},
             {"vol0": "sd*sqrt(252)*100", "atr0": "a/(close+1e-9)*100", "trend0": "(close-ma)/(ma+1e-9)*100"},
             {n: f"last_value({s} IGNORE NULLS) OVER ({P} ROWS UNBOUNDED PRECEDING)"
              for n, s in (("vol", "vol0"), ("atr", "atr0"), ("trend", "trend0"), ("rsi", "rsi0"), ("adx", "adx_14"))})
GI = list(rg.INPUTS)


@register("g01_regime_inputs", f"{V('obars')},\n{GIN[0]} SELECT symbol, dt, {R(*GI)} FROM {GIN[1]}")
def g01(spark, d):
    return fx.rounded(rg.regime_inputs(fx.obars(spark, d)), "symbol", "dt", *GI)


FULL = " AND ".join(f"{c} IS NOT NULL" for c in GI)
for _name, _causal in (("g01_standardized", True), ("g01_standardized_compat", False)):
    _w = "(PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING)" if _causal else "(PARTITION BY symbol)"
    _z = ", ".join(f"({c}-avg({c}) OVER {_w})/(stddev_samp({c}) OVER {_w}+1e-9) AS z_{c}" for c in GI)
    ORACLES[_name] = f"{V('obars')},\n{GIN[0]}, f AS (SELECT * FROM {GIN[1]} WHERE {FULL}), z AS (SELECT symbol, dt, {_z} FROM f) SELECT symbol, dt, {R(*['z_' + c for c in GI], places=5)} FROM z"

    def _run(spark, d, causal=_causal):
        out = rg.standardize(rg.regime_inputs(fx.obars(spark, d)), causal=causal)
        return fx.rounded(out, "symbol", "dt", *["z_" + c for c in GI], places=5)
    QUERIES[_name] = _run


@register("a07_vol_quantiles", f"{V('obars')},\n{GIN[0]} SELECT symbol, floor((quantile_cont(vol,0.75))*1e6+0.5e0)/1e6 AS q75, floor((quantile_cont(vol,0.9))*1e6+0.5e0)/1e6 AS q90 FROM {GIN[1]} GROUP BY 1")
def a07(spark, d):
    q = F.percentile("vol", F.array(F.lit(0.75), F.lit(0.9)))
    out = rg.regime_inputs(fx.obars(spark, d)).groupBy("symbol").agg(q.alias("q"))
    return fx.rounded(out.select("symbol", C("q")[0].alias("q75"), C("q")[1].alias("q90")))


RULE = f"""qq AS (SELECT symbol, quantile_cont(vol,0.75) AS q75, quantile_cont(vol,0.9) AS q90 FROM {GIN[1]} GROUP BY 1),
 rr AS (SELECT x.*, CASE WHEN vol IS NULL THEN 1 WHEN vol>q90 THEN 2 WHEN vol>q75 OR adx<20 THEN 1 ELSE 0 END AS regime FROM {GIN[1]} x JOIN qq USING (symbol))"""


def ruled(spark, d):
    return rg.rule_regime(rg.regime_inputs(fx.obars(spark, d)))


@register("g02_rule_regime", f"{V('obars')},\n{GIN[0]}, {RULE} SELECT symbol, dt, regime FROM rr")
def g02(spark, d):
    return ruled(spark, d).select("symbol", "dt", "regime")


@register("g03_rule_regime_single", f"{V('obars')},\n{GIN[0]} SELECT symbol, dt, CASE WHEN row_number() OVER ({P})<20 OR vol IS NULL THEN 1 WHEN vol>900 THEN 2 WHEN vol>600 OR adx<20 THEN 1 ELSE 0 END AS regime FROM {GIN[1]}")
def g03(spark, d):
    from barflow.operators.scans import running
    out = running(rg.regime_inputs(fx.obars(spark, d)), {"n": F.lit(1)}, bucket="year")
    return out.select("symbol", "dt", rg.rule_regime_single(C("vol") / 30.0, C("adx"), C("n")).alias("regime"))


TRAIN_SHARE = 0.5


@register("g04_mixture_regime")
def g04(spark, d):
    """States and transitions come from the first half of the dates; only later rows are judged with them, earlier ones stay without a regime."""
    from barflow.operators.stage import materialize
    z = materialize(rg.standardize(rg.regime_inputs(fx.obars(spark, d)), causal=True))
    early = rg.first_share(z, TRAIN_SHARE)
    return rg.filter_states(z, rg.fit_states(z.where(early)), ~early)


# Bar-level inputs for the rule ladders, made from the bars by arithmetic both engines do alike.
PSEUDO = """ps AS (SELECT symbol, dt, trade_date, open, high, low, close, volume, CAST(floor((minute_of_day*375)/1440) AS INTEGER) AS mod, CAST(floor((volume*7+minute_of_day/60*5)%4) AS INTEGER)-1 AS reg,
 (volume*13+minute_of_day)%40-5 AS ivc, ((volume*3+minute_of_day/20)%25)/10e0 AS ar, (volume*11+minute_of_day/10)%50 AS adx, (volume*17+minute_of_day/7)%45 AS adx5,
 CAST(floor((volume+minute_of_day/60)%2) AS INTEGER) AS sq, ((volume*5+minute_of_day)%9-4)/10e0 AS r1, ((volume*3+minute_of_day)%7-3)/10e0 AS r3, ((volume*19+minute_of_day)%100)/100e0 AS conf,
 (volume*23+minute_of_day)%100 AS rsi, (volume*29+minute_of_day)%100 AS rsi5, ((volume*31+minute_of_day)%30)/100e0 AS bbw FROM bars)"""


def pseudo(spark, d):
    v, m = C("volume"), C("minute_of_day")
    b = fx.bars(spark, d)
    return b.select("symbol", "dt", "trade_date", "minute_of_day", "open", "high", "low", "close", "volume", F.floor(m * 375 / 1440).cast("int").alias("mod"),
                    (F.floor((v * 7 + m / 60 * 5) % 4).cast("int") - 1).alias("reg"), ((v * 13 + m) % 40 - 5).alias("ivc"), ((v * 3 + m / 20) % 25 / 10.0).alias("ar"),
                    ((v * 11 + m / 10) % 50).alias("adx"), ((v * 17 + m / 7) % 45).alias("adx5"), F.floor((v + m / 60) % 2).cast("int").alias("sq"),
                    (((v * 5 + m) % 9 - 4) / 10.0).alias("r1"), (((v * 3 + m) % 7 - 3) / 10.0).alias("r3"), ((v * 19 + m) % 100 / 100.0).alias("conf"),
                    ((v * 23 + m) % 100).alias("rsi"), ((v * 29 + m) % 100).alias("rsi5"), ((v * 31 + m) % 30 / 100.0).alias("bbw"))


PS = f"{V('bars')}, {PSEUDO}"


@register("g07_intraday_override", f"""{PS} SELECT symbol, dt, CASE WHEN mod<30 OR mod>=345 THEN 1 WHEN ivc>25 THEN 2 WHEN ar>1.8e0 AND adx<15 THEN 1
WHEN reg=2 AND ivc<15 AND (adx5>=20 OR adx>=25) AND ar<1.8e0 THEN 0 WHEN reg=-1 AND (adx+adx5)/2>=28 AND least(adx,adx5)>=CASE WHEN adx>=40 THEN 18 ELSE 22 END AND ivc<15 THEN 0 ELSE reg END AS regime FROM ps""")
def g07(spark, d):
    return pseudo(spark, d).select("symbol", "dt", rg.intraday_override(C("reg"), C("mod"), C("ivc"), C("ar"), C("adx"), C("adx5")).alias("regime"))


@register("g08_session_regime", f"""{PS}, x AS (SELECT *, (r1>0 AND r3>0) OR (r1<0 AND r3<0) AS way FROM ps), y AS (SELECT *, CASE WHEN adx5>=25 THEN 1 ELSE 0 END+CASE WHEN ar>=0.88e0 THEN 1 ELSE 0 END
+CASE WHEN sq=0 THEN 1 ELSE 0 END+CASE WHEN way THEN 1 ELSE 0 END AS s, mod<30 OR mod>=330 OR ivc>20 AS shut FROM x)
SELECT symbol, dt, CASE WHEN shut THEN 'NO_TRADE' WHEN s>=3 AND way THEN 'TRENDING_CONFIRMED' WHEN s>=2 AND way THEN 'TRENDING_WEAK' ELSE 'RANGING' END AS label, CASE WHEN shut THEN 0e0 ELSE s/4e0 END AS score FROM y""")
def g08(spark, d):
    s = rg.session_regime(C("mod"), C("ivc"), C("adx5"), C("ar"), C("sq"), C("r1"), C("r3"))
    return pseudo(spark, d).select("symbol", "dt", s.alias("s")).select("symbol", "dt", "s.*")


_dm = [{kk: vv.replace("1e-10", "1e-9") for kk, vv in s.items()} for s in dmi_steps(20)]
_t, _l = stages("bars", *_dm, {"h5": lag("high", 5), "l5": lag("low", 5), "rn": f"row_number() OVER ({P})"},
                {"sh": f"CASE WHEN h5=({roll('max', 'high', 11)}) THEN h5 END", "sl": f"CASE WHEN l5=({roll('min', 'low', 11)}) THEN l5 END"},
                {"hs": f"list_filter({over('list(sh)', '90 PRECEDING', '6 PRECEDING')}, lambda x: x IS NOT NULL)",
                 "ls": f"list_filter({over('list(sl)', '90 PRECEDING', '6 PRECEDING')}, lambda x: x IS NOT NULL)"},
                {"ok": "rn>100 AND adx_20>=22 AND len(hs)>=3 AND len(ls)>=3"},
                {"dir": "CASE WHEN ok AND hs[-1]>hs[-2] AND hs[-2]>hs[-3] AND ls[-1]>ls[-2] AND ls[-2]>ls[-3] THEN 'UP' WHEN ok AND hs[-1]<hs[-2] AND hs[-2]<hs[-3] AND ls[-1]<ls[-2] AND ls[-2]<ls[-3] THEN 'DOWN' ELSE 'NEUTRAL' END"})


@register("g09_swing_regime", f"{V('bars')},\n{_t} SELECT symbol, dt, dir AS trend_direction, CASE WHEN dir<>'NEUTRAL' THEN 0 ELSE 1 END AS trend_regime FROM {_l}")
def g09(spark, d):
    return rg.swing_regime(fx.bars(spark, d)).select("symbol", "dt", "trend_direction", "trend_regime")


_t, _l = stages("bars", {"tv": "((high+low+close)/3)*volume"}, {"vw": f"sum(tv) OVER (PARTITION BY symbol, trade_date ORDER BY dt)/(sum(volume) OVER (PARTITION BY symbol, trade_date ORDER BY dt)+1e-9)"},
                {"vs": f"{diff('vw', 3)}/({lag('vw', 3)}+1e-9)*100", **SWING}, *dmi_steps(20),
                {"sw": "CASE WHEN higher_high_flag=1 AND higher_low_flag=1 THEN 'UP' WHEN lower_high_flag=1 AND lower_low_flag=1 THEN 'DOWN' ELSE 'NEUTRAL' END"})


@register("g10_row_regime", f"""{V('bars')},\n{_t} SELECT symbol, dt, CASE WHEN minute_of_day>=15 AND minute_of_day<345 AND adx_20>=22 AND sw<>'NEUTRAL' THEN 0 ELSE 1 END AS regime,
CASE WHEN sw<>'NEUTRAL' THEN sw WHEN vs>0.02e0 THEN 'UP' WHEN vs<-0.02e0 THEN 'DOWN' ELSE 'NEUTRAL' END AS direction FROM {_l}""")
def g10(spark, d):
    f = ft.add_features(fx.bars(spark, d), "trend")
    sw = rg.swing_direction(C("higher_high_flag"), C("higher_low_flag"), C("lower_high_flag"), C("lower_low_flag"))
    f = f.withColumn("sw", sw)
    return f.select("symbol", "dt", rg.row_regime(C("minute_of_day"), C("adx_20"), C("sw")).alias("regime"), rg.row_direction(C("sw"), C("vwap_slope_3b")).alias("direction"))


REG = f"{PS}, rp AS (SELECT symbol, dt, trade_date, CASE WHEN close>open+10 THEN 0 WHEN close<open-25 THEN 2 ELSE 1 END AS regime FROM ps)"


def regime_bars(spark, d):
    r = F.when(C("close") > C("open") + 10, 0).when(C("close") < C("open") - 25, 2).otherwise(1)
    return fx.bars(spark, d).withColumn("regime", r)


@register("g11_transitions", f"""{REG}, f AS (SELECT *, CASE WHEN regime<>{lag('regime')} THEN dt END AS fl FROM rp), g AS (SELECT *, last_value(fl IGNORE NULLS) OVER ({P} ROWS UNBOUNDED PRECEDING) AS flip_ts FROM f),
m AS (SELECT *, (epoch(dt)-epoch(flip_ts))/60 AS mins_since_flip FROM g) SELECT symbol, dt, flip_ts, CASE WHEN fl IS NOT NULL THEN 1 ELSE 0 END AS flipped, mins_since_flip,
{flag('mins_since_flip<15')} AS in_transition, {flag('mins_since_flip<30')} AS flip_cooldown FROM m""")
def g11(spark, d):
    return rg.transitions(regime_bars(spark, d)).select("symbol", "dt", "flip_ts", "flipped", "mins_since_flip", "in_transition", "flip_cooldown")


@register("g12_crisis_cooldown", f"""{REG}, n AS (SELECT *, row_number() OVER ({P}) AS pos, CASE WHEN regime=2 THEN 1 ELSE 0 END AS c FROM rp), i AS (SELECT *, sum(1-c) OVER ({P}) AS gc, sum(c) OVER ({P}) AS gn FROM n),
s AS (SELECT *, sum(c) OVER (PARTITION BY symbol, gc ORDER BY dt) AS cr, sum(1-c) OVER (PARTITION BY symbol, gn ORDER BY dt) AS nr FROM i),
t AS (SELECT *, max(CASE WHEN cr=1 AND c=1 THEN pos END) OVER ({P}) AS st FROM s)
SELECT symbol, dt, CAST(coalesce(greatest(0,3-(pos-st+1)),0) AS INTEGER) AS entry_cooldown, CASE WHEN c=0 AND nr=3 AND st IS NOT NULL THEN 1 ELSE 0 END AS post_crisis_block FROM t""")
def g12(spark, d):
    return rg.crisis_cooldowns(regime_bars(spark, d)).select("symbol", "dt", "entry_cooldown", "post_crisis_block")


@register("g13_day_quality", f"""{PS}, l AS (SELECT *, count(*) OVER (PARTITION BY symbol, trade_date) AS n_bars FROM ps QUALIFY row_number() OVER (PARTITION BY symbol, trade_date ORDER BY dt)=least(6, count(*) OVER (PARTITION BY symbol, trade_date))),
i AS (SELECT *, {flag('conf<0.6e0')}+{flag('(adx+adx5)/2<30')}+{flag('(rsi>80 OR rsi<20) AND (rsi5>75 OR rsi5<25)')}+{flag('bbw<0.15e0')} AS n FROM l) SELECT symbol, trade_date, n_bars, n_bars<6 AS too_few, CASE WHEN n>=2 THEN 'BAD' ELSE 'GOOD' END AS quality FROM i""")
def g13(spark, d):
    """The sixth bar of every session decides; in a shorter one the last bar does, and ``too_few`` says so."""
    p = rg.deciding_bars(pseudo(spark, d), 6)
    return p.select("symbol", "trade_date", "n_bars", "too_few", rg.day_quality(C("conf"), C("adx"), C("adx5"), C("rsi"), C("rsi5"), C("bbw")).alias("quality"))


@register("a18_regime_mix", f"""{REG}, m AS (SELECT symbol, dt, {over('avg(CASE WHEN regime=1 THEN 1e0 ELSE 0e0 END)', '9 PRECEDING', 'CURRENT ROW')} AS s, {over('count(*)', '9 PRECEDING', 'CURRENT ROW')} AS n FROM rp)
SELECT symbol, dt, floor((s)*1e6+0.5e0)/1e6 AS ranging_share, CASE WHEN n>=5 AND s>=0.7e0 THEN 0.05e0 ELSE 0e0 END AS conf_boost FROM m""")
def a18(spark, d):
    return fx.rounded(rg.regime_mix(regime_bars(spark, d)), "symbol", "dt", "ranging_share", "conf_boost")


HYST = f"""WITH RECURSIVE {REG[5:]}, x AS (SELECT symbol, trade_date, dt, regime AS r, row_number() OVER (PARTITION BY symbol ORDER BY dt) AS rn FROM rp),
h AS (SELECT symbol, trade_date, dt, rn, 1 AS cur, 5 AS held, CASE WHEN r=1 THEN -9 ELSE r END AS pend, CASE WHEN r=1 THEN 0 ELSE 1 END AS cnt, 1::BIGINT AS since FROM x WHERE rn=1 UNION ALL
 SELECT symbol, trade_date, dt, rn, CASE WHEN flip THEN p1 ELSE cur END, CASE WHEN flip THEN 0 ELSE held+1 END, CASE WHEN flip THEN -9 ELSE p1 END, CASE WHEN flip THEN 0 ELSE c1 END, CASE WHEN flip THEN 0 ELSE since+1 END FROM
 (SELECT *, c1>=3 AND held >= CASE cur WHEN 0 THEN 6 WHEN 1 THEN 4 WHEN 2 THEN 1 ELSE 4 END AS flip FROM
  (SELECT x.symbol, x.trade_date, x.dt, x.rn, cur, since, CASE WHEN x.trade_date<>h.trade_date THEN 0 ELSE held END AS held, CASE WHEN r=cur THEN -9 ELSE r END AS p1,
   CASE WHEN r=cur THEN 0 WHEN x.trade_date=h.trade_date AND r=pend THEN cnt+1 ELSE 1 END AS c1 FROM h JOIN x ON x.symbol=h.symbol AND x.rn=h.rn+1)))"""


@register("q02_hysteresis", f"""{HYST} SELECT symbol, dt, cur AS confirmed_regime, since AS bars_since_flip, floor((1-exp(-since/(5e0+1e-9)))*1e6+0.5e0)/1e6 AS conf_ramp FROM h""")
def q02(spark, d):
    return fx.rounded(rg.hysteresis(regime_bars(spark, d)), "symbol", "dt", "confirmed_regime", "bars_since_flip", "conf_ramp")


_t, _l = stages("bars", {"tr": TR}, {"a": roll("avg", "tr", 14)}, {"n": over("count(*)", "59 PRECEDING", "CURRENT ROW"), "na": over("count(a)", "59 PRECEDING", "CURRENT ROW"),
                "mean": over("avg(a)", "59 PRECEDING", "CURRENT ROW"), "fc": over("first_value(close)", "19 PRECEDING", "CURRENT ROW"), "pr": over("avg(a)", "10 PRECEDING", "1 PRECEDING")},
                {"ratio": "a/(mean+1e-9)", "net": "(close-fc)/(mean+1e-9)", "prior": "CASE WHEN na>11 THEN pr/(mean+1e-9) ELSE 1 END"})


@register("w51_micro_regime", f"""{V('bars')},\n{_t} SELECT symbol, dt, CASE WHEN n<30 OR na<10 THEN 'UNKNOWN' WHEN prior<0.7e0 AND ratio>1.1e0 THEN 'BREAKOUT' WHEN ratio>1.3e0 THEN CASE WHEN net>0.3e0 THEN 'TRENDING_UP' ELSE 'TRENDING_DN' END
WHEN ratio<0.7e0 THEN 'RANGING' WHEN abs(net)<0.5e0 THEN 'RANGING' WHEN net>0 THEN 'TRENDING_UP' ELSE 'TRENDING_DN' END AS micro_regime FROM {_l}""")
def w51(spark, d):
    return rg.micro_regime(ft.add_features(fx.bars(spark, d), "atr", bars_per_day=24)).select("symbol", "dt", "micro_regime")


# --- labels ---------------------------------------------------------------------------------------------------------
def barrier_rows(spark, d, compat):
    f = ft.add_features(fx.bars(spark, d), "atr", bars_per_day=24)
    r = F.when(C("close") > C("open") + 10, 0).when(C("close") < C("open") - 25, 2).otherwise(1)
    return lb.lagged_regime(f.withColumn("regime", r), compat)


def barrier_sql(h, compat):
    from barflow import constants as k
    b = k.TB_BARS[h]
    lo, hi = max(1, b // 2), int(b * 1.5)
    h1, h2 = max(lo, min(int(b * .75), hi)), max(lo, min(int(b * 1.25), hi))
    n = max(h1, h2, b)
    kr = (f"coalesce({lag('regime')},1)" if compat else
          "coalesce((SELECT r FROM dr WHERE dr.symbol=b0.symbol AND dr.trade_date=b0.trade_date),1)")
    mult = f"CASE kr WHEN 2 THEN {k.TB_MULT_CRISIS[h]}e0 WHEN 0 THEN {k.TB_MULT_TRENDING[h]}e0 ELSE {k.TB_MULT_RANGING[h]}e0 END"
    t, last = stages("bars", {"tr": TR, "regime": "CASE WHEN close>open+10 THEN 0 WHEN close<open-25 THEN 2 ELSE 1 END"}, {"a": roll("avg", "tr", 14)},
                     {"ab": roll("avg", "a", 480, 24), "aa": "avg(a) OVER (PARTITION BY symbol)"})
    hits = ", ".join(f"CASE WHEN {i}<=st THEN CASE WHEN lead(high,{i}) OVER w>=tp THEN {i} WHEN lead(low,{i}) OVER w<=sl THEN -{i} END END" for i in range(1, n + 1))
    return f"""{V('bars')},\n{t}, dd AS (SELECT symbol, trade_date, arg_max(regime, dt) AS r0 FROM {last} GROUP BY 1,2),
dr AS (SELECT symbol, trade_date, lag(r0) OVER (PARTITION BY symbol ORDER BY trade_date) AS r FROM dd),
b1 AS (SELECT b0.*, {kr} AS kr, a/(coalesce(ab,aa)+1e-9) AS ratio FROM {last} b0), b2 AS (SELECT *, CASE WHEN ratio>1.5e0 THEN {h1} WHEN ratio<0.7e0 THEN {h2} ELSE {b} END AS st, ({mult})*a AS wd FROM b1),
b3 AS (SELECT *, close+wd*CASE WHEN kr=0 THEN 1.07e0 ELSE 1 END AS tp, close-wd AS sl FROM b2),
b4 AS (SELECT *, coalesce({hits}) AS hit, lead(close,{b}) OVER w IS NOT NULL AS fl FROM b3 WINDOW w AS ({P})),
b5 AS (SELECT *, CASE WHEN fl AND wd>0 THEN hit END AS hh FROM b4),
b6 AS (SELECT *, CASE abs(hh) {' '.join(f'WHEN {i} THEN lead(close,{i}) OVER ({P})' for i in range(1, n + 1))} END AS xc FROM b5),
b7 AS (SELECT *, (xc-close)/close*100 AS fut_ret, exp(-0.5e0*(abs(xc-close)/(close*0.01e0+1e-9)/(wd/close*100+1e-9)))*CASE WHEN hh>0 THEN 1e0 WHEN hh<0 THEN (1-0.2e0*(st/{b}e0))*0.85e0 END AS ev FROM b6)
SELECT symbol, dt, floor((ev)*1e6+0.5e0)/1e6 AS ev_{h}m, floor((fut_ret)*1e6+0.5e0)/1e6 AS fut_ret_{h}m, floor((tanh(fut_ret/(0.2e0+1e-9))*ev)*1e6+0.5e0)/1e6 AS label_{h}m,
CAST(coalesce(sign(hh),0) AS INTEGER) AS barrier_{h}m FROM b7"""


for _name, _h, _c in (("l01_triple_barrier_1m", 1, True), ("l01_triple_barrier_5m", 5, True), ("l02_triple_barrier_15m", 15, True),
                      ("l02_triple_barrier_30m", 30, True), ("l03_regime_width", 5, False)):
    ORACLES[_name] = barrier_sql(_h, _c)

    def _run(spark, d, h=_h, compat=_c):
        out = lb.triple_barrier(barrier_rows(spark, d, compat), h, bars_per_day=24)
        return fx.rounded(out, "symbol", "dt", *[f"{x}_{h}m" for x in ("ev", "fut_ret", "label", "barrier")])
    QUERIES[_name] = _run

FIX = f"""fx0 AS (SELECT symbol, dt, close, {over('list(close)', '1 FOLLOWING', '6 FOLLOWING')} AS nx FROM bars), fx1 AS (SELECT *, list_transform(nx, lambda p: CASE WHEN p>=close*(1+0.05e0) THEN 1 WHEN p<=close*(1-0.03e0) THEN -1 ELSE 0 END) AS cd FROM fx0),
fx2 AS (SELECT *, CASE WHEN len(nx)>=6 THEN coalesce(nullif(list_position(list_transform(cd, lambda c: c<>0), true),0),6) END AS hb FROM fx1),
fx3 AS (SELECT *, cd[hb] AS side, list_transform(nx[1:hb], lambda p: (p-close)/(close+1e-9)*100) AS mv FROM fx2)"""


@register("l04_fixed_barrier", f"{V('bars')}, {FIX} SELECT symbol, dt, CASE WHEN hb IS NOT NULL THEN CASE WHEN side=1 THEN 1 ELSE 0 END END AS label FROM fx3")
def l04(spark, d):
    return lb.fixed_barrier(fx.bars(spark, d), 6, 0.05, 0.03).select("symbol", "dt", "label")


@register("l05_fixed_barrier_meta", f"""{V('bars')}, {FIX} SELECT symbol, dt, CASE WHEN hb IS NOT NULL THEN CASE side WHEN 1 THEN 'upper' WHEN -1 THEN 'lower' ELSE 'time' END END AS barrier_hit, CAST(hb AS INTEGER) AS bars_to_exit,
CASE WHEN hb IS NOT NULL THEN floor((greatest(0,list_max(mv)))*1e6+0.5e0)/1e6 END AS max_excursion, CASE WHEN hb IS NOT NULL THEN floor((least(0,list_min(mv)))*1e6+0.5e0)/1e6 END AS max_adverse FROM fx3""")
def l05(spark, d):
    return fx.rounded(lb.fixed_barrier(fx.bars(spark, d), 6, 0.05, 0.03), "symbol", "dt", "barrier_hit", "bars_to_exit", "max_excursion", "max_adverse")


@register("a16_label_stats", f"""{V('bars')}, {FIX}, s AS (SELECT symbol, CASE WHEN hb IS NOT NULL THEN CASE WHEN side=1 THEN 1 ELSE 0 END END AS label FROM fx3)
SELECT symbol, count(label) AS total, CAST(sum(label) AS BIGINT) AS positive, count(*) FILTER (label=0) AS negative, floor((avg(label))*1e6+0.5e0)/1e6 AS positive_rate FROM s GROUP BY 1""")
def a16(spark, d):
    return fx.rounded(lb.label_stats(lb.fixed_barrier(fx.bars(spark, d), 6, 0.05, 0.03), "label", ("symbol",)))


@register("l06_meta_label", V("scored") + ", x AS (SELECT symbol, dt, h, proba, CASE WHEN close>open THEN 1 ELSE 0 END AS y FROM scored) SELECT symbol, dt, h, CASE WHEN (proba>0.5e0)=(y=1) THEN 1 ELSE 0 END AS meta FROM x")
def l06(spark, d):
    return fx.scored(spark, d).select("symbol", "dt", "h", lb.meta_label(C("proba"), F.when(C("close") > C("open"), 1).otherwise(0)).alias("meta"))


__all__ = ["FL", "FT", "featured"]
