"""Votes, gates, session kernels and tick statistics."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from barflow.catalog import fixtures as fx
from barflow.catalog.market import PSEUDO, pseudo
from barflow.catalog.sqltext import P, lag
from barflow.operators.chunks import chunked
from barflow.operators.rolling import Roller
from barflow.plans import bars as bp
from barflow.plans import daily as dp
from barflow.plans import features as ft
from barflow.plans import flow
from barflow.plans import gates as gt
from barflow.plans import learn as ln
from barflow.plans import sessions as ss
from barflow.plans import votes as vt

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


SIDE = "sd AS (SELECT *, proba>0.5e0 AS up, CASE WHEN proba>0.5e0 THEN proba ELSE 1-proba END AS cf FROM scored)"
WT = "CASE h WHEN 1 THEN 0.05e0 WHEN 5 THEN 0.2e0 WHEN 15 THEN 0.45e0 WHEN 30 THEN 0.3e0 END"
FLOOR = "CASE WHEN h IN (15,30) THEN 0.57e0 ELSE 0.52e0 END"


def vote_sql(bypass):
    cnt = "cf>=0.52e0" if bypass else f"cf>={FLOOR} AND h IN (15,30)"
    return f"""{SIDE}, vv AS (SELECT symbol, dt, sum(CASE WHEN {cnt} AND up THEN {WT}*cf*cf ELSE 0e0 END) AS vote_up, sum(CASE WHEN {cnt} AND NOT up THEN {WT}*cf*cf ELSE 0e0 END) AS vote_dn,
 sum(CASE WHEN {cnt} THEN {WT}*cf ELSE 0e0 END) AS wc, sum(CASE WHEN {cnt} THEN {WT} ELSE 0e0 END) AS w, count(*) FILTER ({cnt}) AS n_votes FROM sd GROUP BY 1,2),
 vo AS (SELECT symbol, dt, n_votes, vote_up, vote_dn, CASE WHEN n_votes>0 THEN CASE WHEN vote_up>vote_dn THEN 'UP' ELSE 'DOWN' END END AS direction,
  CASE WHEN vote_up>vote_dn THEN vote_up ELSE vote_dn END/nullif(vote_up+vote_dn,0) AS agreement, CASE WHEN n_votes>0 THEN wc/w END AS mean_conf FROM vv)"""


for _name, _b in (("m11_horizon_vote", False), ("m11_horizon_vote_bypass", True)):
    ORACLES[_name] = f"{V('scored')}, {vote_sql(_b)} SELECT symbol, dt, n_votes, direction, {R('vote_up', 'vote_dn', 'agreement', 'mean_conf')} FROM vo"

    def _run(spark, d, b=_b):
        return fx.rounded(vt.horizon_vote(fx.scored(spark, d), bypass=b), "symbol", "dt", "n_votes", "direction", "vote_up", "vote_dn", "agreement", "mean_conf")
    QUERIES[_name] = _run

V5 = """cl AS (SELECT symbol, dt, h, least(0.82e0,greatest(0.45e0,proba)) AS p, CASE h WHEN 15 THEN 0.6e0 ELSE 0.4e0 END AS w FROM scored WHERE h IN (15,30)),
 cs AS (SELECT *, p>0.5e0 AS up, CASE WHEN p>0.5e0 THEN p ELSE 1-p END AS cf FROM cl),
 v5a AS (SELECT symbol, dt, sum(CASE WHEN up THEN w*cf ELSE 0e0 END) AS vote_up, sum(CASE WHEN up THEN 0e0 ELSE w*cf END) AS vote_dn, sum(CASE WHEN up THEN w ELSE 0e0 END) AS wu, sum(CASE WHEN up THEN 0e0 ELSE w END) AS wd FROM cs GROUP BY 1,2),
 v5 AS (SELECT *, CASE WHEN vote_up>=vote_dn THEN 'UP' ELSE 'DOWN' END AS direction, CASE WHEN vote_up>=vote_dn THEN vote_up ELSE vote_dn END/(vote_up+vote_dn) AS agreement,
  CASE WHEN vote_up>=vote_dn THEN vote_up/nullif(wu,0) ELSE vote_dn/nullif(wd,0) END AS mean_conf FROM v5a)"""


@register("m12_vote_v5", f"{V('scored')}, {V5} SELECT symbol, dt, direction, {R('vote_up', 'vote_dn', 'agreement', 'mean_conf')}, agreement>=0.6e0 AS passes FROM v5")
def m12(spark, d):
    return fx.rounded(vt.horizon_vote_v5(fx.scored(spark, d)))


@register("m14_quick_agreement", f"{V('scored')}, {SIDE}, q AS (SELECT symbol, dt, sum(CASE WHEN up THEN {WT}*cf ELSE 0e0 END) AS vote_up, sum(CASE WHEN up THEN 0e0 ELSE {WT}*cf END) AS vote_dn FROM sd GROUP BY 1,2) "
          f"SELECT symbol, dt, {R('vote_up', 'vote_dn')}, CASE WHEN vote_up>=vote_dn THEN 'UP' ELSE 'DOWN' END AS direction, floor((greatest(vote_up,vote_dn)/(vote_up+vote_dn))*1e6+0.5e0)/1e6 AS agreement FROM q")
def m14(spark, d):
    return fx.rounded(vt.quick_agreement(fx.scored(spark, d)))


WIDE = "wd AS (SELECT symbol, dt, " + ", ".join(f"max(proba) FILTER (h={h}) AS p{h}" for h in (1, 5, 15, 30)) + " FROM scored GROUP BY 1,2)"


@register("m15_horizon_agreement", f"""{V('scored')}, {WIDE}, a AS (SELECT *, CASE WHEN (p15>0.5e0)<>(p30>0.5e0) THEN '15m_30m_conflict' WHEN (p5>0.5e0)<>(p15>0.5e0) THEN '5m_disagree_ignored' ELSE 'directional_agreement_ok' END AS reason FROM wd)
SELECT symbol, dt, reason<>'15m_30m_conflict' AS agree, reason FROM a""")
def m15(spark, d):
    w = vt.by_horizon(fx.scored(spark, d))
    return w.select("symbol", "dt", vt.horizon_agreement(C("p5"), C("p15"), C("p30")).alias("a")).select("symbol", "dt", "a.*")


@register("m10_expert_blend", f"{V('scored')}, {WIDE} SELECT symbol, dt, floor((CASE WHEN p1>0.2e0 THEN p5*p1+(1-p5)*p15 ELSE p15 END)*1e6+0.5e0)/1e6 AS p FROM wd")
def m10(spark, d):
    w = vt.by_horizon(fx.scored(spark, d))
    return fx.rounded(w.select("symbol", "dt", vt.blend_expert(F.when(C("p1") > 0.2, C("p1")), C("p15"), C("p5")).alias("p")))


@register("w48_conf_percentile", f"""{V('scored')}, c AS (SELECT symbol, dt, CAST(volume%3 AS INTEGER) AS regime, greatest(proba,1-proba) AS conf FROM scored WHERE h=15),
k AS (SELECT *, list(conf) OVER (PARTITION BY symbol, regime ORDER BY dt ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING) AS s FROM c)
SELECT symbol, dt, regime, floor((CASE WHEN len(s)>=20 THEN len(list_filter(s, lambda x: x<=conf))/len(s)*100 END)*1e6+0.5e0)/1e6 AS conf_pctile FROM k""")
def w48(spark, d):
    c = fx.scored(spark, d).where("h = 15").withColumns({"regime": (C("volume") % 3).cast("int"), "conf": F.greatest(C("proba"), 1 - C("proba"))})
    return fx.rounded(vt.conf_percentile(c), "symbol", "dt", "regime", "conf_pctile")


SD5 = "s5 AS (SELECT symbol, dt, trade_date, CASE WHEN proba>0.5e0 THEN 1 ELSE 0 END AS side FROM scored WHERE h=5)"


@register("w50_flip_count", f"""{V('scored')}, {SD5}, f AS (SELECT *, CASE WHEN lag(side) OVER w<>side THEN 1 ELSE 0 END AS f FROM s5 WINDOW w AS (PARTITION BY symbol, trade_date ORDER BY dt))
SELECT symbol, dt, CAST(sum(f) OVER (PARTITION BY symbol, trade_date ORDER BY dt ROWS 1 PRECEDING) AS INTEGER) AS flips FROM f""")
def w50(spark, d):
    s = fx.scored(spark, d).where("h = 5").withColumn("side", F.when(C("proba") > 0.5, 1).otherwise(0))
    return vt.flip_count(s, "side").select("symbol", "dt", "flips")


MIC = "CASE CAST(rsi AS INTEGER)%4 WHEN 0 THEN 'TRENDING_UP' WHEN 1 THEN 'TRENDING_DN' WHEN 2 THEN 'RANGING' ELSE 'BREAKOUT' END"


def micro_col():
    m = C("rsi").cast("int") % 4
    return F.when(m == 0, "TRENDING_UP").when(m == 1, "TRENDING_DN").when(m == 2, "RANGING").otherwise("BREAKOUT")


@register("q04_stale_penalty", f"""WITH RECURSIVE {V('bars')[5:]}, {PSEUDO}, m AS (SELECT symbol, dt, trade_date, {MIC} AS mi, CASE WHEN r1>0 THEN 'UP' ELSE 'DOWN' END AS dir, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY dt) AS rn FROM ps),
g AS (SELECT *, (dir='UP' AND mi='TRENDING_DN') OR (dir='DOWN' AND mi='TRENDING_UP') AS bad FROM m),
s AS (SELECT symbol, trade_date, dt, rn, CASE WHEN bad THEN 0.05e0 ELSE 0e0 END AS p FROM g WHERE rn=1 UNION ALL
 SELECT g.symbol, g.trade_date, g.dt, g.rn, CASE WHEN bad THEN least(0.15e0, s.p+0.05e0) ELSE greatest(0e0, s.p-0.01e0) END FROM s JOIN g ON g.symbol=s.symbol AND g.trade_date=s.trade_date AND g.rn=s.rn+1)
SELECT symbol, dt, floor((p)*1e6+0.5e0)/1e6 AS stale_penalty FROM s""")
def q04(spark, d):
    p = pseudo(spark, d).withColumns({"micro_regime": micro_col(), "direction": F.when(C("r1") > 0, "UP").otherwise("DOWN")})
    return fx.rounded(ss.stale_penalty(p), "symbol", "dt", "stale_penalty")


@register("q05_temporal_lock", f"""WITH RECURSIVE {V('scored')[5:]}, x AS (SELECT symbol, trade_date, dt, CASE WHEN proba>0.5e0 THEN 1 ELSE 0 END AS side, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY dt) AS rn FROM scored WHERE h=5),
s AS (SELECT symbol, trade_date, dt, rn, [side] AS sides, 0 AS lft, 0 AS cool, 0e0 AS pen FROM x WHERE rn=1 UNION ALL
 SELECT symbol, trade_date, dt, rn, sd, CASE WHEN l1=0 AND c1=0 AND len(sd)=3 AND sd[1]<>sd[2] AND sd[2]<>sd[3] THEN 3 ELSE l1 END, c1, pen FROM
 (SELECT x.symbol, x.trade_date, x.dt, x.rn, greatest(s.lft-1, 0) AS l1, CASE WHEN s.lft=1 THEN 9 ELSE greatest(s.cool-1, 0) END AS c1, CASE WHEN s.lft>1 THEN 0.08e0 ELSE 0e0 END AS pen,
  list_append(CASE WHEN s.lft=1 THEN []::INTEGER[] WHEN len(s.sides)=3 THEN s.sides[2:3] ELSE s.sides END, x.side) AS sd FROM s JOIN x ON x.symbol=s.symbol AND x.trade_date=s.trade_date AND x.rn=s.rn+1) AS q)
SELECT symbol, dt, CAST(lft AS INTEGER) AS lock_bars, pen AS lock_penalty FROM s""")
def q05(spark, d):
    s = fx.scored(spark, d).where("h = 5").withColumn("side", F.when(C("proba") > 0.5, 1).otherwise(0))
    return ss.temporal_lock(s, "side").select("symbol", "dt", "lock_bars", "lock_penalty")


@register("q03_pullback_entry")
def q03(spark, d):
    f = ft.add_features(fx.bars(spark, d), "atr", "vwap", "ticks", bars_per_day=24)
    v = vt.horizon_vote(fx.scored(spark, d)).select("symbol", "dt", "direction")
    return ss.pullback_entry(f.join(v, ["symbol", "dt"])).select("symbol", "dt", "direction", "entry", "entry_state")


@register("q06_horizon_weights", f"""WITH RECURSIVE {V('scored')[5:]}, x AS (SELECT symbol, trade_date, dt, h, CASE WHEN close>open THEN 1e0 ELSE 0e0 END AS won, row_number() OVER (PARTITION BY symbol, trade_date ORDER BY dt, h) AS rn
 FROM scored),
s AS (SELECT symbol, trade_date, 0::BIGINT AS rn, NULL::TIMESTAMP AS dt, 0::INTEGER AS h, 0.05e0 AS w1, 0.20e0 AS w5, 0.45e0 AS w15, 0.30e0 AS w30 FROM x WHERE rn=1 UNION ALL
 SELECT symbol, trade_date, rn, dt, h, a/(((a+b)+c)+e+1e-9), b/(((a+b)+c)+e+1e-9), c/(((a+b)+c)+e+1e-9), e/(((a+b)+c)+e+1e-9) FROM
 (SELECT x.symbol, x.trade_date, x.rn, x.dt, x.h, CASE WHEN x.h=1 THEN 0.95e0*w1+0.05e0*won ELSE w1 END AS a, CASE WHEN x.h=5 THEN 0.95e0*w5+0.05e0*won ELSE w5 END AS b,
  CASE WHEN x.h=15 THEN 0.95e0*w15+0.05e0*won ELSE w15 END AS c, CASE WHEN x.h=30 THEN 0.95e0*w30+0.05e0*won ELSE w30 END AS e FROM s JOIN x ON x.symbol=s.symbol AND x.trade_date=s.trade_date AND x.rn=s.rn+1) AS q)
SELECT symbol, dt, h, {R('w1', 'w5', 'w15', 'w30')} FROM s WHERE rn>0""")
def q06(spark, d):
    """Every scored row of every horizon moves the weights, in the order of time and horizon."""
    s = fx.scored(spark, d).withColumn("won", C("close") > C("open"))
    return fx.rounded(ss.horizon_weights(s, order=["dt", "h"]), "symbol", "dt", "h", "w1", "w5", "w15", "w30")


# --- gates ----------------------------------------------------------------------------------------------------------
GATE_IN = f"""gi AS (SELECT ps.symbol, ps.dt, ps.trade_date, ps.close, CASE WHEN volume%5=0 THEN 1 WHEN volume%7=0 THEN 2 ELSE 0 END AS regime, conf AS regime_conf, volume%6=0 AS bypass, mod/375e0 AS sp, mod,
 r1 AS f5, r3+0.05e0 AS f15, CASE WHEN isodow(ps.dt)=2 THEN 1 ELSE 0 END AS ise, isodow(ps.dt)-1 AS dow, adx AS adx1, adx5*1.5e0 AS adx5, ar*0.6e0 AS ivp, 0.2e0 AS atrp, 10+rsi AS prem, ivc/5-3 AS gap, ar/2+0.3e0 AS datr, rsi5<95 AS okin,
 n_votes, direction, agreement, mean_conf, p15, p30, 0.4e0+bbw AS meta, sq*0.08e0 AS lockp, (CAST(rsi AS INTEGER)%4)*0.05e0 AS stale, CAST(rsi5 AS INTEGER)%9=0 AS inpb, r1*2.2e0 AS ta, sq, {MIC} AS micro, 0e0 AS ef,
 CASE WHEN rsi>70 THEN 1 ELSE 0 END AS obu, CASE WHEN rsi<30 THEN 1 ELSE 0 END AS obd, ar, r3 AS slope, ivc, CAST(rsi AS INTEGER)%12 AS tdir, CAST(rsi5 AS INTEGER)%13 AS tday
 FROM ps JOIN vo USING (symbol, dt) JOIN wd USING (symbol, dt))"""


def gate_inputs(spark, d):
    p = pseudo(spark, d)
    s = fx.scored(spark, d)
    v = vt.horizon_vote(s).select("symbol", "dt", "n_votes", "direction", "agreement", "mean_conf")
    w = vt.by_horizon(s).select("symbol", "dt", "p5", "p15", "p30")
    vol, rsi, rsi5 = C("volume"), C("rsi").cast("int"), C("rsi5").cast("int")
    j = p.join(v, ["symbol", "dt"]).join(w, ["symbol", "dt"])
    return j.select("symbol", "dt", "trade_date", "close", "n_votes", "direction", "agreement", "mean_conf", "p5", "p15", "p30",
                    F.when(vol % 5 == 0, 1).when(vol % 7 == 0, 2).otherwise(0).alias("regime"), C("conf").alias("regime_conf"), (vol % 6 == 0).alias("crisis_bypass"),
                    (C("mod") / 375.0).alias("session_pct"), C("mod").alias("minute_of_day"), C("r1").alias("ret5m_fd"), (C("r3") + 0.05).alias("ret15m_fd"),
                    F.when(F.weekday("dt") == 1, 1).otherwise(0).alias("is_expiry"), F.weekday("dt").alias("dow"), C("adx").alias("adx_14"), (C("adx5") * 1.5).alias("tf5_adx"),
                    (C("ar") * 0.6).alias("iv_proxy"), F.lit(0.2).alias("atr_14_pct"), (10 + C("rsi")).alias("atm_premium"), (C("ivc") / 5 - 3).alias("gap_pct"),
                    (C("ar") / 2 + 0.3).alias("day_atr_pct"), (C("rsi5") < 95).alias("inputs_valid"), (0.4 + C("bbw")).alias("meta_conf"), (C("sq") * 0.08).alias("lock_penalty"),
                    ((rsi % 4) * 0.05).alias("stale_penalty"), (rsi5 % 9 == 0).alias("in_pullback"), (C("r1") * 2.2).alias("ta_overall_score"), C("sq").alias("bb_squeeze"),
                    micro_col().alias("micro_regime"), F.lit(0.0).alias("extra_floor"), F.when(C("rsi") > 70, 1).otherwise(0).alias("or_break_up"),
                    F.when(C("rsi") < 30, 1).otherwise(0).alias("or_break_dn"), C("ar").alias("atr_ratio"), C("r3").alias("adx_slope"), C("ivc").alias("iv_pct_change"),
                    (rsi % 12).alias("trades_dir"), (rsi5 % 13).alias("trades_today"))


PEN = {
    "regime_conf": "CASE WHEN NOT bypass AND regime_conf<0.55e0 THEN 0.04e0 ELSE 0e0 END", "time_window": "CASE WHEN NOT bypass AND (mod<30 OR mod>330) THEN 0.05e0 ELSE 0e0 END",
    "crisis_up": "CASE WHEN bypass AND up AND (mod<30 OR mod>330) THEN 0.1e0 ELSE 0e0 END", "agreement_weak": "CASE WHEN agreement<0.55e0 THEN 0.03e0 ELSE 0e0 END", "temporal": "lockp",
    "horizons": "CASE WHEN NOT bypass AND (p15>0.5e0)<>(p30>0.5e0) THEN 0.08e0 ELSE 0e0 END",
    "ta_pen": "CASE WHEN ((dn AND ta>0) OR (up AND ta<0)) AND NOT inpb THEN CASE WHEN sq=1 THEN 0.08e0 ELSE abs(ta)*0.06e0 END ELSE 0e0 END",
    "expiry": "CASE WHEN ise=1 THEN CASE WHEN mod BETWEEN 225 AND 334 THEN 0.1e0 ELSE 0.07e0 END WHEN dow=1 THEN 0.05e0 ELSE 0e0 END", "lunch": "CASE WHEN mod BETWEEN 180 AND 225 THEN 0.05e0 ELSE 0e0 END",
    "long_h": "CASE WHEN NOT bypass AND NOT (coalesce(greatest(p15,1-p15)>=0.57e0 AND (p15>0.5e0)=up,false) OR coalesce(greatest(p30,1-p30)>=0.57e0 AND (p30>0.5e0)=up,false)) THEN 0.05e0 ELSE 0e0 END",
    "adx_pen": "CASE WHEN NOT bypass AND NOT inpb AND NOT t5 AND ax>=12 AND ax<20 AND slope<=0 THEN (20-ax)/20*0.1e0 ELSE 0e0 END",
    "sq_pen": "CASE WHEN NOT bypass AND sq=1 AND micro<>'BREAKOUT' THEN least(CASE WHEN adx1<30 THEN 0.07e0 ELSE 0e0 END+CASE WHEN ar<0.85e0 THEN 0.05e0 ELSE 0e0 END,0.1e0) WHEN sq=1 AND micro<>'BREAKOUT' AND ar<0.85e0 THEN 0.04e0 ELSE 0e0 END",
    "stale_pen": "CASE WHEN NOT bypass AND NOT inpb THEN least(stale,0.1e0) ELSE 0e0 END", "crush": "CASE WHEN ivp>1.5e0 AND ivc<0 THEN 0.1e0 ELSE 0e0 END",
    "meta_pen": "CASE WHEN NOT bypass AND meta<0.45e0 THEN 0.05e0 WHEN NOT bypass AND meta<0.62e0 THEN 0.08e0 ELSE 0e0 END",
    "ev_pen": "CASE WHEN ev>-0.05e0 AND ev<=0.0015e0 THEN least(0.06e0,abs(ev-0.0015e0)*10) ELSE 0e0 END"}
GATES = [("Gate1", "NOT bypass AND regime<>0"), ("Gate2", "sp>0.92e0 OR mod>=335"), ("Gate2b", "NOT bypass AND regime_conf<0.1e0"), ("Gate2c", "NOT bypass AND mod>15 AND (f5=0 OR f15=0)"),
         ("Gate4", "ise=1 AND (((mod BETWEEN 135 AND 224 OR mod>=335) AND NOT (mod BETWEEN 135 AND 224 AND greatest(adx1,adx5)>=30 AND regime=0)) OR mod>=310)"),
         ("Gate5", "CASE WHEN ivp>0 THEN ivp ELSE atrp END<0.1e0"), ("Gate5d", "prem<CASE WHEN ise=1 THEN 20 ELSE 30 END"), ("Gate5b", "abs(gap)>2.5e0*datr AND mod<45"), ("Inputs", "NOT okin"),
         ("Votes", "n_votes=0"), ("Agreement", "agreement<0.52e0"), ("Gate5c", "mod<=60 AND ((gap<-2 AND up) OR (gap>2 AND dn))"), ("Gate3b", "((dn AND ta>0) OR (up AND ta<0)) AND abs(ta)>0.85e0"),
         ("Gate7e", "NOT bypass AND mod<30 AND ((obd=1 AND up) OR (obu=1 AND dn))"), ("Gate7c", "NOT bypass AND ax<12 AND NOT t5"), ("CrisisADX", "bypass AND adx1>50"), ("Gate9", "ev<=-0.05e0"),
         ("Gate10", "tdir>=10"), ("PenaltyBudget", "tot>0.2e0"), ("FinalFloor", "fc<flo"), ("FinalConf", "fc<0.55e0"), ("FinalADX", "adx1<12"), ("FinalAgreement", "fc>0.6e0 AND agreement<0.55e0"), ("FinalTrades", "tday>=10")]
GATE_SQL = f"""{V('scored')}, {PSEUDO}, {vote_sql(False)}, {WIDE}, {GATE_IN}, g1 AS (SELECT *, direction='UP' AS up, direction='DOWN' AS dn, CASE WHEN adx5>0 THEN adx5 ELSE adx1 END AS ax, adx5>=60 AND regime=0 AS t5,
 0.7e0*mean_conf+0.3e0*CASE WHEN meta>0 THEN meta ELSE 0.55e0 END AS raw FROM gi), g2 AS (SELECT *, raw*1.2e0-(1-raw)*1e0-0.015e0*CASE WHEN mod<=30 OR mod>=345 THEN 1.8e0 ELSE 1e0 END*CASE WHEN ivp>2 THEN 1.8e0 WHEN ivp>1.5 THEN 1.5e0 WHEN ivp>1.2e0 THEN 1.2e0 ELSE 1e0 END AS ev FROM g1),
 g3 AS (SELECT *, {', '.join(f'coalesce({v},0e0) AS x_{n}' for n, v in PEN.items())} FROM g2), g4 AS (SELECT *, {'+'.join(f'x_{n}' for n in PEN)} AS tot FROM g3),
 g5 AS (SELECT *, CASE WHEN tot>0.1e0 THEN raw-0.1e0 ELSE raw-tot END AS fc, greatest(0.52e0, CASE WHEN ise=1 THEN greatest(0.65e0, CASE WHEN micro='RANGING' THEN 0.52e0 ELSE 0.57e0 END) ELSE CASE WHEN micro='RANGING' THEN 0.52e0 ELSE 0.57e0 END END) AS flo FROM g4),
 g6 AS (SELECT *, CASE {' '.join(f"WHEN {c} THEN '{n}'" for n, c in GATES)} END AS block_reason FROM g5)"""


def pullback_sql(source: str, direction: str, strict: bool, tag: str) -> str:
    """The pending-entry machine walked row by row over the rows of ``source`` that passed; ``out`` has the reason of every row."""
    band = "greatest(vwap*0.003e0, atr*0.5e0)" if strict else "atr"
    loose = "false" if strict else "flip AND near"
    done = f"outcome='ENTRY' AND NOT ({loose})" + (" OR outcome='EXPIRED'" if strict else "")
    return f"""pv AS (SELECT *, close+((prem%11)-5)*0.8e0 AS vwap, ar+1 AS atr, CASE WHEN {direction}='UP' THEN 1 ELSE -1 END AS sgn FROM {source}),
x AS (SELECT symbol, trade_date, dt, {direction} AS side, vwap>0 AND abs(close-vwap)<={band} AS near, f5*0.4e0*sgn>0.08e0 AND slope*0.7e0*sgn>0.15e0 AS resuming, (close-vwap)*sgn>0 AS rightside,
 row_number() OVER (PARTITION BY symbol, trade_date ORDER BY dt) AS rn FROM pv WHERE block_reason IS NULL AND NOT bypass AND {direction} IS NOT NULL),
pb AS (SELECT symbol, trade_date, 0::BIGINT AS rn, NULL::TIMESTAMP AS dt, NULL::VARCHAR AS st, 0 AS age, false AS touched, '' AS outcome FROM x WHERE rn=1 UNION ALL
 SELECT symbol, trade_date, rn, dt, CASE WHEN {done} THEN NULL ELSE side END, CASE WHEN {done} THEN 0 ELSE a2 END, CASE WHEN {done} THEN false ELSE t2 END, outcome FROM
 (SELECT *, CASE WHEN {loose} THEN 'ENTRY' WHEN fresh AND NOT near THEN 'WAIT_PULLBACK' WHEN NOT t2 THEN 'WAIT_VWAP' WHEN NOT resuming AND a2<10 THEN 'WAIT_RESUME' WHEN NOT resuming AND NOT rightside THEN 'EXPIRED' ELSE 'ENTRY' END AS outcome FROM
 (SELECT *, flip OR s1 IS NULL AS fresh, CASE WHEN flip OR s1 IS NULL THEN 0 ELSE a1 END AS a2, CASE WHEN flip OR s1 IS NULL THEN near ELSE t1 OR near END AS t2 FROM
 (SELECT *, coalesce(s1<>side, false) AS flip FROM
 (SELECT x.*, CASE WHEN age+1>12 THEN NULL ELSE st END AS s1, age+1 AS a1, touched AS t1 FROM pb JOIN x ON x.symbol=pb.symbol AND x.trade_date=pb.trade_date AND x.rn=pb.rn+1))))),
out AS (SELECT pv.* EXCLUDE (block_reason), coalesce(pv.block_reason, CASE WHEN outcome<>'ENTRY' THEN '{tag}' END) AS block_reason, coalesce(outcome, '') AS entry_state FROM pv LEFT JOIN pb USING (symbol, trade_date, dt))"""


def entry_inputs(df):
    """VWAP, ATR, its drift and the tick imbalance beside the gate inputs."""
    return df.withColumns({"vwap": C("close") + ((C("atm_premium") % 11) - 5) * 0.8, "atr_14": C("atr_ratio") + 1, "vwap_dev_vel": C("ret5m_fd") * 0.4, "tick_imbalance": C("adx_slope") * 0.7})


def funnel_v4(spark, d):
    return gt.entry_gate(entry_inputs(gt.gate_funnel_v4(gate_inputs(spark, d))), "EntryV4", strict=False)


FUNNEL4 = f"WITH RECURSIVE {GATE_SQL[5:]}, {pullback_sql('g6', 'direction', False, 'EntryV4')}"


@register("b01_gate_funnel_v4", f"{FUNNEL4} SELECT symbol, dt, floor((fc)*1e6+0.5e0)/1e6 AS final_conf, entry_state, block_reason, block_reason IS NULL AS passes FROM out")
def b01(spark, d):
    return fx.rounded(funnel_v4(spark, d), "symbol", "dt", "final_conf", "entry_state", "block_reason", "passes")


@register("b01_funnel_counts", f"{FUNNEL4} SELECT regime, coalesce(block_reason,'PASS') AS outcome, count(*) AS n FROM out GROUP BY 1,2")
def b01c(spark, d):
    return gt.funnel(funnel_v4(spark, d), ("regime",))


@register("b02_penalty_ledger", f"{GATE_SQL} SELECT symbol, dt, floor((raw)*1e6+0.5e0)/1e6 AS raw_conf, floor((ev)*1e6+0.5e0)/1e6 AS ev_net, floor((tot)*1e6+0.5e0)/1e6 AS penalty_total, "
          + ", ".join(f"floor((x_{n})*1e6+0.5e0)/1e6 AS pen_{i}" for i, n in enumerate(PEN)) + " FROM g4")
def b02(spark, d):
    out = gt.penalties(gate_inputs(spark, d))
    names = [f.name for f in out.schema["penalty_ledger"].dataType.fields]
    return fx.rounded(out.select("symbol", "dt", "raw_conf", "ev_net", "penalty_total", *[C(f"penalty_ledger.{n}").alias(f"pen_{i}") for i, n in enumerate(names)]))


G5 = [("V5-Gate1", "NOT bypass AND regime<>0"), ("V5-Gate2", "NOT bypass AND (mod<15 OR mod>300 OR sp>0.92e0)"), ("V5-Gate3", "NOT bypass AND prem>80"), ("V5-Gate4", "NOT bypass AND tdir=0"), ("V5-Risk", "NOT bypass AND tday=1"),
      ("V5-Inputs", "NOT okin"), ("V5-ML", "a5<0.6e0"), ("V5-Align", "NOT bypass AND sw<>'NEUTRAL' AND sw<>d5")]


@register("b03_gate_funnel_v5", f"""WITH RECURSIVE {V('scored')[5:]}, {PSEUDO}, {vote_sql(False)}, {WIDE}, {V5}, {GATE_IN}, g AS (SELECT gi.*, v5.direction AS d5, v5.agreement AS a5, CASE WHEN sq=1 AND ta>0 THEN 'UP' WHEN sq=1 AND ta<0 THEN 'DOWN' ELSE 'NEUTRAL' END AS sw
FROM gi JOIN v5 USING (symbol, dt)), h AS (SELECT *, CASE {' '.join(f"WHEN {c} THEN '{n}'" for n, c in G5)} END AS block_reason FROM g),
{pullback_sql('h', 'd5', True, 'V5-Pullback')} SELECT symbol, dt, d5 AS direction, entry_state, block_reason, block_reason IS NULL AS passes FROM out""")
def b03(spark, d):
    g = gate_inputs(spark, d).drop("direction", "agreement", "mean_conf")
    v = vt.horizon_vote_v5(fx.scored(spark, d)).select("symbol", "dt", "direction", "agreement")
    sw = F.when((C("bb_squeeze") == 1) & (C("ta_overall_score") > 0), "UP").when((C("bb_squeeze") == 1) & (C("ta_overall_score") < 0), "DOWN").otherwise("NEUTRAL")
    df = g.join(v, ["symbol", "dt"]).withColumns({"iv_rank": C("atm_premium"), "event_day": F.when(C("trades_dir") == 0, 1).otherwise(0), "risk_ok": C("trades_today") != 1, "regime_direction": sw})
    return gt.entry_gate(entry_inputs(gt.gate_funnel_v5(df)), "V5-Pullback", strict=True).select("symbol", "dt", "direction", "entry_state", "block_reason", "passes")


OF = [("SESSION_NO_TRADE", "NOT bypass AND sr='NO_TRADE'"), ("SESSION_RANGING", "NOT bypass AND sr='RANGING'"), ("AGAINST_OPEN", "NOT bypass AND mod<=120 AND ((direction='UP' AND vo<-0.005e0) OR (direction='DOWN' AND vo>0.005e0))"),
      ("UNAFFORDABLE", "prem>0 AND prem>100000e0/65*0.7e0"), ("SAME_SIDE_LOSS", "ll=direction AND bl<3"), ("TAPE", "regime=2 AND NOT bypass AND ((direction='UP' AND f15<-0.03e0 AND ta<0) OR (direction='DOWN' AND f15>0.03e0 AND ta>0))"),
      ("GAP_DOWN_DAY", "NOT bypass AND gap<=-2 AND tday>=2"), ("DRAWDOWN", "ddm<1 AND mean_conf<0.62e0+(1e0-ddm)*0.28e0"), ("LATE", "sp>0.92e0 OR mod>=340")]


@register("b04_order_filters", f"""{V('scored')}, {PSEUDO}, {vote_sql(False)}, {WIDE}, {GATE_IN}, o AS (SELECT *, first_value(close) OVER (PARTITION BY symbol, trade_date ORDER BY dt) AS op, CASE tdir%4 WHEN 0 THEN 'NO_TRADE' WHEN 1 THEN 'RANGING' ELSE 'TRENDING_CONFIRMED' END AS sr,
CASE WHEN tday%2=0 THEN 'UP' ELSE 'DOWN' END AS ll, tday AS bl, CASE WHEN tdir>6 THEN 0.75e0 ELSE 1e0 END AS ddm FROM gi), q AS (SELECT *, (close-op)/op AS vo FROM o)
SELECT symbol, dt, CASE {' '.join(f"WHEN {c} THEN '{n}'" for n, c in OF)} END AS order_block FROM q""")
def b04(spark, d):
    w = Window.partitionBy("symbol", "trade_date").orderBy("dt")
    n = C("trades_dir") % 4
    df = gate_inputs(spark, d).withColumns({
        "day_open": F.first("close").over(w), "session_regime": F.when(n == 0, "NO_TRADE").when(n == 1, "RANGING").otherwise("TRENDING_CONFIRMED"),
        "last_loss_direction": F.when(C("trades_today") % 2 == 0, "UP").otherwise("DOWN"), "bars_since_loss": C("trades_today"), "dd_mult": F.when(C("trades_dir") > 6, 0.75).otherwise(1.0),
        "tf15_ret_1": C("ret15m_fd"), "tick_imbalance": C("ta_overall_score"), "gap_down_day": C("gap_pct") <= -2, "losses_today": C("trades_today")})
    return gt.order_filters(df).select("symbol", "dt", "order_block")


@register("b05_next_bar_confirmation", f"""{V('scored')}, {PSEUDO}, {vote_sql(False)}, {WIDE}, {GATE_IN}, n AS (SELECT *, lead(close) OVER w AS c1, lead(ta) OVER w AS v1, lead(prem) OVER w AS p1 FROM gi WINDOW w AS (PARTITION BY symbol, trade_date ORDER BY dt)),
x AS (SELECT *, CASE WHEN direction='UP' THEN c1>close ELSE c1<close END AS po, CASE WHEN direction='UP' THEN v1>=-0.001e0 ELSE v1<=0.001e0 END AS vo, CASE WHEN prem>0 AND p1>0 THEN (p1-prem)/prem>-0.02e0 ELSE true END AS pr FROM n WHERE direction IS NOT NULL OR true)
SELECT symbol, dt, coalesce(po AND vo AND pr,false) AS confirmed, CASE WHEN NOT po THEN 1 ELSE 0 END AS reject_price, CASE WHEN NOT vo THEN 1 ELSE 0 END AS reject_vwap, CASE WHEN NOT pr THEN 1 ELSE 0 END AS reject_premium FROM x""")
def b05(spark, d):
    df = gate_inputs(spark, d).withColumns({"vwap_dist": C("ta_overall_score"), "premium": C("atm_premium")})
    return gt.next_bar_confirmation(df).select("symbol", "dt", "confirmed", "reject_price", "reject_vwap", "reject_premium")


@register("b06_block_histogram", f"""{GATE_SQL} SELECT CASE WHEN tdir%3=0 THEN block_reason||': text' ELSE block_reason END AS gate, mod AS minute_of_day, count(*) AS n FROM g6 WHERE block_reason IS NOT NULL GROUP BY 1,2""")
def b06(spark, d):
    g = gt.gate_funnel_v4(gate_inputs(spark, d)).where("block_reason is not null")
    reason = F.when(C("trades_dir") % 3 == 0, F.concat("block_reason", F.lit(": text"))).otherwise(F.concat(F.lit("["), C("block_reason"), F.lit("] BLOCKED: x")))
    return gt.block_histogram(g.select(F.lit("BLOCKED").alias("event"), reason.alias("reason"), "minute_of_day"))


@register("b17_scarcity", f"""{V('scored')}, {PSEUDO}, {vote_sql(False)}, {WIDE}, {GATE_IN}, s AS (SELECT symbol, trade_date, direction, dt, CASE WHEN tday%2=0 THEN 1 ELSE 0 END AS taken FROM gi WHERE direction IS NOT NULL),
t AS (SELECT *, CAST(coalesce(sum(taken) OVER (PARTITION BY symbol, trade_date, direction ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS INTEGER) AS trades_dir FROM s) SELECT symbol, dt, trades_dir, trades_dir>=3 AS scarce FROM t""")
def b17(spark, d):
    s = gate_inputs(spark, d).where("direction is not null").withColumns({"taken": F.when(C("trades_today") % 2 == 0, 1).otherwise(0), "seq": F.lit(0)})
    return gt.scarcity(s, 3).select("symbol", "dt", "trades_dir", "scarce")


@register("b23_black_swan", f"""{V('scored')}, {PSEUDO}, {vote_sql(False)}, {WIDE}, {GATE_IN}, f AS (SELECT * FROM gi QUALIFY row_number() OVER (PARTITION BY symbol, trade_date ORDER BY dt)=1)
SELECT symbol, trade_date, floor((gap)*1e6+0.5e0)/1e6 AS gap_pct, abs(gap)>2.5e0*datr AS black_swan, gap<=-0.5e0 AS gap_down_day, abs(gap)>=1.5e0 AS gap_day FROM f""")
def b23(spark, d):
    return fx.rounded(gt.black_swan(gate_inputs(spark, d)))


@register("b21_micro_confirmation", f"""{V('scored')}, {PSEUDO}, {vote_sql(False)}, {WIDE}, {GATE_IN}, x AS (SELECT gi.*, ps.open AS op, 2e0 AS a2, CASE WHEN gi.close>40 THEN 1 ELSE 0 END AS pos, CASE WHEN direction='UP' THEN 1 ELSE 0 END AS sd FROM gi JOIN ps USING (symbol, dt)),
y AS (SELECT *, lag(pos) OVER ({P}) AS pp FROM x WHERE true) SELECT symbol, dt, CASE WHEN pp=sd AND pos=sd THEN CASE WHEN sd=1 THEN 'vwap_hold_above' ELSE 'vwap_hold_below' END
WHEN micro='RANGING' AND mean_conf>=0.88e0 AND pos=sd THEN 'vwap_cross_ranging_highconf' WHEN micro IN ('TRENDING_UP','TRENDING_DOWN','BREAKOUT') AND mean_conf>=0.85e0 AND pos=sd THEN 'vwap_cross_trending_highconf' WHEN adx5>=60 AND pos=sd THEN 'vwap_5m_strong_trend'
WHEN abs(close-op)>0.3e0*a2 AND CASE WHEN sd=1 THEN close>op ELSE close<=op END AND NOT CASE WHEN sd=1 THEN ta<-0.4e0 AND ar<0.7e0 ELSE ta>0.4e0 AND ar>1.43e0 END THEN 'strong_directional_candle'
WHEN CASE WHEN sd=1 THEN f15>0.4e0 OR f5>0.3e0 ELSE f15<-0.4e0 OR f5<-0.3e0 END AND mean_conf>=0.8e0 AND pos=sd THEN 'structure_aligned_vwap' ELSE 'no_micro_confirmation' END AS micro_reason FROM y""")
def b21(spark, d):
    op = pseudo(spark, d).select("symbol", "dt", "open")
    df = gate_inputs(spark, d).join(op, ["symbol", "dt"]).withColumns({"vwap": F.lit(40.0), "atr_14": F.lit(2.0), "tick_imbalance": C("ta_overall_score"),
                                                                      "pressure_ratio": C("atr_ratio"), "struct_score": C("ret15m_fd"), "orb_dist": C("ret5m_fd")})
    return gt.micro_confirmation(df).select("symbol", "dt", "micro_reason")


# --- full pipeline: ticks to gated signals --------------------------------------------------------------------------
def pipeline_rows(spark, d):
    from barflow.operators import kernels
    from barflow.operators.stage import materialize
    from barflow.plans import regimes as rg
    base = fx.bars(spark, d)
    f = ft.add_features(base, "returns", "atr", "volatility", "bollinger", "ema", "rsi", "macd", "stochastic", "mfi", "dmi", "vwap", "opening_range",
                        "volume", "ticks", "structure", bars_per_day=24, options={"opening_range": {"minutes": 180}})
    f = kernels.add_supertrend(materialize(f))
    return rg.micro_regime(materialize(ft.ta_scores(ft.crosses(f))))


PIPE = ["atr_14", "rsi_14", "adx_14", "vwap_dist", "macd_h", "ta_momentum_score", "ta_trend_score", "ta_flow_score", "ta_overall_score", "adx_rsi_trend", "squeeze_atr", "micro_regime"]


@register("w36_ta_scores")
def w36(spark, d):
    return fx.rounded(pipeline_rows(spark, d), "symbol", "dt", *PIPE)


QUERIES["w35_feature_crosses"] = lambda spark, d: fx.rounded(pipeline_rows(spark, d), "symbol", "dt", "adx_rsi_trend", "squeeze_atr", "vwap_momentum", "vol_dmi_cross", "session_iv", "adx_macd", "range_rsi_extr", "time_decay_mult")


@register("b20_analysis_row")
def b20(spark, d):
    f = pipeline_rows(spark, d).withColumn("regime", F.when(C("adx_14") > 25, 0).otherwise(1))
    return fx.rounded(gt.analysis_row(f), "symbol", "dt", "momentum_score", "trend_score", "flow_score", "iv_regime", "overall_score", "overall_bias", "regime_name")


@register("b19_bar_log")
def b19(spark, d):
    from barflow.sources.sinks import bar_log_rows
    f = pipeline_rows(spark, d).withColumn("regime", F.when(C("adx_14") > 25, 0).otherwise(1))
    v = vt.horizon_vote(fx.scored(spark, d)).select("symbol", "dt", "direction", "agreement", C("mean_conf").alias("avg_conf"))
    return bar_log_rows(f.join(v, ["symbol", "dt"], "left"))


def session_bars(bars):
    """One bar per symbol and session."""
    return bars.groupBy("symbol", "trade_date").agg(
        F.min("dt").alias("dt"), F.min_by("open", "dt").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"),
        F.max_by("close", "dt").alias("close"), F.sum("volume").alias("volume"))


def signal_pipeline(spark, d):
    """Flagship: ticks, bars, features, votes, session state, gates."""
    f = pipeline_rows(spark, d)
    s = fx.scored(spark, d)
    v = vt.horizon_vote(s).drop("vote_up", "vote_dn")
    w = vt.by_horizon(s).select("symbol", "dt", "p5", "p15", "p30")
    j = f.join(v, ["symbol", "dt"]).join(w, ["symbol", "dt"])
    j = ss.stale_penalty(j).withColumn("side", F.when(C("p5") > 0.5, 1).otherwise(0))
    j = dp.attach_daily(ss.temporal_lock(j, "side"), session_bars(f))
    neutral = {"regime": F.when(C("adx_14") > 15, 0).otherwise(1), "regime_conf": F.lit(0.6), "crisis_bypass": F.lit(False), "ret5m_fd": C("ret_5m"), "ret15m_fd": C("ret_15m") + 1e-9,
               "tf5_adx": C("adx_14"), "day_atr_pct": F.when(C("day_atr_pct") > 0, C("day_atr_pct")).otherwise(0.5), "inputs_valid": C("rsi_14").isNotNull(), "meta_conf": F.lit(0.55), "in_pullback": F.lit(False),
               "extra_floor": F.lit(0.0), "trades_dir": F.lit(0), "trades_today": F.lit(0)}
    return gt.gate_funnel_v4(gt.with_atm_premium(j.withColumns(neutral)))


@register("b00_signal_pipeline")
def b00(spark, d):
    return fx.rounded(signal_pipeline(spark, d), "symbol", "dt", "direction", "final_conf", "penalty_total", "block_reason", "passes")


# --- tick statistics ------------------------------------------------------------------------------------------------
TW = "(PARTITION BY symbol ORDER BY ts, seq ROWS 99 PRECEDING)"


@register("a19_tick_stats", f"{V('ticks')}, s AS (SELECT symbol, seq, CAST(count(*) OVER w AS BIGINT) AS n, price AS latest, max(price) OVER w AS high, min(price) OVER w AS low FROM ticks WINDOW w AS {TW}) SELECT symbol, seq, n, {R('latest', 'high', 'low')}, floor((high-low)*1e6+0.5e0)/1e6 AS range FROM s")
def a19(spark, d):
    return fx.rounded(flow.tick_stats(fx.ticks(spark, d)), "symbol", "seq", "n", "latest", "high", "low", "range")


@register("a20_order_flow", f"""{V('ticks')}, d AS (SELECT symbol, ts, sign(price-lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq)) AS s FROM ticks)
SELECT symbol, date_trunc('hour', ts) AS dt, count(*) FILTER (s>0) AS up_ticks, count(*) FILTER (s<0) AS down_ticks, floor((CASE WHEN count(*) FILTER (s<>0)>0 THEN count(*) FILTER (s>0)/count(*) FILTER (s<>0) ELSE 0.5e0 END)*1e6+0.5e0)/1e6 AS imbalance FROM d GROUP BY 1,2""")
def a20(spark, d):
    return fx.rounded(flow.order_flow(fx.ticks(spark, d), "1 hour"))


@register("a21_latency_median", f"""{V('ticks')}, l AS (SELECT symbol, ts, seq, CAST((seq*37)%2500 AS DOUBLE) AS lag_ms FROM ticks), m AS (SELECT *, median(lag_ms) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS 9 PRECEDING) AS med FROM l)
SELECT symbol, seq, floor((med)*1e6+0.5e0)/1e6 AS median_lag_ms, med<2000 AS acceptable FROM m""")
def a21(spark, d):
    t = fx.ticks(spark, d).withColumn("lag_ms", ((C("seq") * 37) % 2500).cast("double"))
    return fx.rounded(flow.latency_median(t), "symbol", "seq", "median_lag_ms", "acceptable")


@register("a25_distinct", f"{V('bars')} SELECT symbol, count(DISTINCT minute_of_day) AS minutes, count(DISTINCT trade_date) AS days FROM bars GROUP BY 1")
def a25(spark, d):
    return fx.bars(spark, d).groupBy("symbol").agg(F.count_distinct("minute_of_day").alias("minutes"), F.count_distinct("trade_date").alias("days"))


@register("a01_daily_high_low", f"{V('bars')}, g AS (SELECT symbol, trade_date, max(high) AS high, min(low) AS low FROM bars GROUP BY 1,2) SELECT symbol, trade_date, {R('high', 'low')}, floor((lag(high) OVER (PARTITION BY symbol ORDER BY trade_date))*1e6+0.5e0)/1e6 AS prev_high FROM g")
def a01(spark, d):
    g = fx.bars(spark, d).groupBy("symbol", "trade_date").agg(F.max("high").alias("high"), F.min("low").alias("low"))
    return fx.rounded(g.withColumn("prev_high", F.lag("high").over(Window.partitionBy("symbol").orderBy("trade_date"))))


# --- learning: deterministic parts ----------------------------------------------------------------------------------
PREDS = f"""pr AS (SELECT symbol, dt, trade_date, h, proba, CAST(volume%3 AS INTEGER) AS regime, minute_of_day, (volume*11+minute_of_day/10)%50 AS adx, (lead(close) OVER (PARTITION BY symbol, h ORDER BY dt)/close-1)*100 AS ret FROM scored)"""
CONF = f"""{V('scored')}, {PREDS}, ct AS (SELECT *, CASE WHEN proba>0.5e0 THEN ret ELSE -ret END AS pnl, CASE WHEN proba>0.5e0 THEN proba ELSE 1-proba END AS conf, CASE WHEN (ret>0)=(proba>0.5e0) THEN 1e0 ELSE 0e0 END AS win
 FROM pr WHERE greatest(proba,1-proba)>=0.65e0 AND ret IS NOT NULL)"""


def preds(spark, d):
    w = Roller()
    b = chunked(fx.bars(spark, d), lambda x: x.withColumn("ret", (F.try_divide(w.lead("close"), C("close")) - 1) * 100), 1, forward=True)
    h = F.explode(F.array(*[F.lit(x) for x in (1, 5, 15, 30)]))
    key = (C("volume") * 37 + F.hour("dt") * 13 + C("h") * 7) % 41
    return (b.withColumn("h", h).withColumn("proba", key.cast("double") / 40)
            .withColumns({"regime": (C("volume") % 3).cast("int"), "adx": (C("volume") * 11 + C("minute_of_day") / 10) % 50, "y": F.when(C("ret") > 0, 1).otherwise(0)}))


def metric_sql(keys):
    k = ", ".join(keys)
    return f"""{CONF}, c AS (SELECT *, sum(pnl) OVER (PARTITION BY {k} ORDER BY dt, symbol ROWS UNBOUNDED PRECEDING) AS cum FROM ct), m AS (SELECT *, cum-max(cum) OVER (PARTITION BY {k} ORDER BY dt, symbol ROWS UNBOUNDED PRECEDING) AS dd FROM c),
dy AS (SELECT {k}, trade_date, sum(pnl) AS p FROM ct GROUP BY {k}, trade_date), ds AS (SELECT {k}, avg(p)/(stddev_pop(p)+1e-9)*sqrt(252) AS sharpe FROM dy GROUP BY {k}),
g AS (SELECT {k}, count(*) AS trades, count(*) FILTER (pnl>0)/count(*) AS win_rate, avg(pnl) AS avg_ret, CASE WHEN sum(pnl) FILTER (pnl<0)<0 THEN sum(pnl) FILTER (pnl>0)/-sum(pnl) FILTER (pnl<0) ELSE 99 END AS profit_factor, min(dd) AS max_dd, sum(pnl) AS total FROM m GROUP BY {k})
SELECT {k}, trades, {R('win_rate', 'avg_ret', 'profit_factor', 'sharpe', 'max_dd', 'total')}, floor((CASE WHEN max_dd<0 THEN total/abs(max_dd+1e-9) ELSE 99 END)*1e6+0.5e0)/1e6 AS calmar FROM g JOIN ds USING ({k})"""


for _name, _keys in (("a08_backtest_metrics", ("h",)), ("a09_regime_metrics", ("h", "regime"))):
    ORACLES[_name] = metric_sql(_keys)

    def _run(spark, d, keys=_keys):
        return fx.rounded(ln.backtest_metrics(ln.confident_trades(preds(spark, d)), keys))
    QUERIES[_name] = _run


@register("a10_winrate_breakdown", f"""{CONF}, x AS (SELECT win, CASE regime WHEN 0 THEN 'TRENDING' WHEN 1 THEN 'RANGING' ELSE 'CRISIS' END AS rn, CASE WHEN adx>=0 AND adx<15 THEN 'ADX<15' WHEN adx>=15 AND adx<25 THEN 'ADX15-25' WHEN adx>=25 AND adx<100 THEN 'ADX>25' END AS ab,
CASE WHEN conf<0.55e0 THEN '0.50-0.55' WHEN conf<0.6e0 THEN '0.55-0.60' WHEN conf<0.65e0 THEN '0.60-0.65' WHEN conf<0.7e0 THEN '0.65-0.70' WHEN conf<1.01e0 THEN '0.70+' END AS cb FROM ct),
u AS (SELECT rn AS regime_name, NULL::VARCHAR AS adx_bucket, NULL::VARCHAR AS conf_bin, count(*) AS n, avg(win) AS wr FROM x GROUP BY 1 UNION ALL SELECT rn, ab, NULL, count(*), avg(win) FROM x WHERE ab IS NOT NULL GROUP BY 1,2
UNION ALL SELECT NULL, NULL, cb, count(*), avg(win) FROM x WHERE cb IS NOT NULL GROUP BY cb) SELECT regime_name, adx_bucket, conf_bin, n, {R('wr')}, floor((wr-0.5e0)*1e6+0.5e0)/1e6 AS edge FROM u""")
def a10(spark, d):
    return fx.rounded(ln.winrate_breakdown(ln.confident_trades(preds(spark, d))))


@register("a17_seasonality", f"""{V('scored')}, {PREDS}, b AS (SELECT regime, CAST(round_even(minute_of_day/5,0)*5 AS INTEGER) AS bucket, avg(CASE WHEN ret>0 THEN 1e0 ELSE 0e0 END)-0.5e0 AS ev FROM pr WHERE h=15 GROUP BY 1,2)
SELECT regime, bucket, floor((least(0.03e0,greatest(-0.03e0,avg(ev) OVER (PARTITION BY regime ORDER BY bucket ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))))*1e6+0.5e0)/1e6 AS bias FROM b""")
def a17(spark, d):
    return fx.rounded(ln.seasonality(preds(spark, d).where("h = 15")))


@register("a22_oof_quality", f"""{V('scored')}, {PREDS}, q AS (SELECT h, proba, least(0.82e0,greatest(0.45e0,proba)) AS cal, CASE WHEN ret>0 THEN 1 ELSE 0 END AS y FROM pr), g AS (SELECT h, count(*) AS n, avg(CASE WHEN (proba>0.5e0)=(y=1) THEN 1e0 ELSE 0e0 END) AS accuracy,
avg((proba-y)*(proba-y)) AS brier_raw, avg((cal-y)*(cal-y)) AS brier FROM q GROUP BY 1) SELECT h, n, {R('accuracy', 'brier_raw', 'brier')}, floor((brier/(accuracy*(1-accuracy)+1e-9))*1e6+0.5e0)/1e6 AS reliability FROM g""")
def a22(spark, d):
    p = preds(spark, d).withColumn("calibrated", F.least(F.lit(0.82), F.greatest(F.lit(0.45), C("proba"))))
    return fx.rounded(ln.oof_quality(p, by=("h",)))


@register("a23_class_balance", f"""{V('scored')}, {PREDS} SELECT h, count(*) AS n, floor((avg(CASE WHEN ret>0 THEN 1e0 ELSE 0e0 END))*1e6+0.5e0)/1e6 AS up_share, floor((avg(CASE WHEN regime=0 THEN 1e0 ELSE 0e0 END))*1e6+0.5e0)/1e6 AS trending,
floor((avg(CASE WHEN regime=1 THEN 1e0 ELSE 0e0 END))*1e6+0.5e0)/1e6 AS ranging, floor((avg(CASE WHEN regime=2 THEN 1e0 ELSE 0e0 END))*1e6+0.5e0)/1e6 AS crisis FROM pr GROUP BY 1""")
def a23(spark, d):
    return fx.rounded(ln.class_balance(preds(spark, d)))


@register("b22_training_summary", metric_sql(("h",)).replace("SELECT h, trades,", f"""SELECT h, (SELECT floor((avg(CASE WHEN (proba>0.5e0)=(ret>0) THEN 1e0 WHEN ret IS NULL AND proba<=0.5e0 THEN 1e0 ELSE 0e0 END)*100-avg(CASE WHEN ret>0 THEN 1e0 ELSE 0e0 END)*100)*1e6+0.5e0)/1e6
FROM pr WHERE pr.h=g.h) AS edge_pp, trades,"""))
def b22(spark, d):
    p = preds(spark, d)
    hit = F.when(F.when(C("proba") > 0.5, 1).otherwise(0) == C("y"), 1.0).otherwise(0.0)
    q = p.groupBy("h").agg(F.avg(hit).alias("accuracy"), F.avg(C("y").cast("double")).alias("baseline"))
    out = ln.training_summary(ln.backtest_metrics(ln.confident_trades(p)), q)
    return fx.rounded(out.drop("accuracy", "baseline"))


MASK = f"{V('scored')}, {PREDS}, tr AS (SELECT *, CASE WHEN ret>0.5e0 THEN 1 WHEN ret<-0.5e0 THEN -1 ELSE 0 END AS br FROM pr WHERE h=15)"


def train_frame(spark, d):
    p = preds(spark, d).where("h = 15")
    return p.withColumns({"barrier_15m": F.when(C("ret") > 0.5, 1).when(C("ret") < -0.5, -1).otherwise(0), "fut_ret_15m": C("ret"), "adx_14": C("adx")})


@register("p07_training_mask", f"{MASK} SELECT symbol, dt, {R('ret')} FROM tr WHERE br<>0 AND ret IS NOT NULL AND minute_of_day BETWEEN 30 AND 355")
def p07(spark, d):
    return fx.rounded(ln.training_rows(train_frame(spark, d), 15, ["ret", "adx_14"]), "symbol", "dt", "ret")


@register("p08_recency", f"{V('obars')}, m AS (SELECT max(trade_date) AS x FROM obars) SELECT symbol, dt, {R('close')} FROM obars, m WHERE trade_date >= x - INTERVAL 2 YEAR")
def p08(spark, d):
    return fx.rounded(ln.recent_rows(fx.obars(spark, d)), "symbol", "dt", "close")


@register("p09_noise_filter", f"{MASK} SELECT symbol, dt, {R('ret')} FROM tr WHERE abs(ret)>0.0005e0 AND adx>10")
def p09(spark, d):
    return fx.rounded(ln.noise_filter(train_frame(spark, d), 15), "symbol", "dt", "ret")


ORD = f"{MASK}, o AS (SELECT *, row_number() OVER (ORDER BY dt, symbol)-1 AS i, count(*) OVER () AS n FROM tr), z AS (SELECT *, n//6 AS sz FROM o)"


@register("m01_folds", f"""{ORD} SELECT symbol, dt, i, n, CAST(CASE {' '.join(f'WHEN i>n-{5 - f}*sz+5 AND i<n-{5 - f}*sz+sz THEN {f}' for f in range(5))} END AS INTEGER) AS test_fold,
CAST(CASE {' '.join(f'WHEN i<n-{5 - f}*sz-5 THEN {f}' for f in range(5))} END AS INTEGER) AS train_from FROM z""")
def m01(spark, d):
    return ln.walk_forward(ln.ordinals(train_frame(spark, d))).select("symbol", "dt", "i", "n", "test_fold", "train_from")


@register("m03_weights", f"""{ORD}, w AS (SELECT *, CASE WHEN ret IS NULL OR ret<=0 THEN 1e0 ELSE least(2e0,greatest(0.1e0,ret)) END*exp(1.5e0*(i-n)/n) AS w0 FROM z),
e AS (SELECT *, CASE WHEN (proba>0.5e0)=coalesce(ret>0,false) THEN coalesce(ret,0) ELSE -abs(coalesce(ret,0)) END AS q FROM w), c AS (SELECT *, sum(q) OVER (ORDER BY dt, symbol ROWS UNBOUNDED PRECEDING) AS cum FROM e),
g AS (SELECT *, cum-max(cum) OVER (ORDER BY dt, symbol ROWS UNBOUNDED PRECEDING) AS dd FROM c)
SELECT symbol, dt, floor((w0/avg(w0) OVER ())*1e6+0.5e0)/1e6 AS weight, CASE WHEN dd<-2 THEN 0.3e0 ELSE 1e0 END AS dd_weight FROM g""")
def m03(spark, d):
    w = ln.sample_weights(ln.ordinals(train_frame(spark, d)), "ret")
    return fx.rounded(ln.drawdown_weights(w), "symbol", "dt", "weight", "dd_weight")


__all__ = ["bp", "lag"]
