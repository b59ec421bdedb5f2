"""Risk audits, exit replay and model training queries."""
from __future__ import annotations

from pyspark.sql import functions as F

from barflow.catalog import fixtures as fx
from barflow.catalog.trading import LV, MOVE, QV, ledger, quotes
from barflow.plans import labels as lb
from barflow.plans import learn as ln
from barflow.plans import replay as rp
from barflow.plans import risk as rk

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


# --- ranges of bars under positions ---------------------------------------------------------------------------------
@register("j12_position_bars", f"""{V('obars', 'trades')}, j AS (SELECT trade_no, high, low FROM trades t JOIN obars b ON b.symbol=t.regime AND b.dt BETWEEN t.entry_ts AND t.exit_ts)
SELECT trade_no, count(*) AS bars, floor((max(high))*1e6+0.5e0)/1e6 AS highest, floor((min(low))*1e6+0.5e0)/1e6 AS lowest FROM j GROUP BY 1""")
def j12(spark, d):
    pos = fx.trades(spark, d).where("exit_ts is not null").select("trade_no", C("regime").alias("symbol"), "entry_ts", "exit_ts")
    bars = fx.obars(spark, d).select("symbol", "dt", "high", "low")
    return fx.rounded(rp.range_extremes(pos, bars))


# Option bars: the ticks of a user are one position's premium path, a bar a minute after its entry.
MARKS = """mk0 AS (SELECT user_id AS position, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)-1 AS INTEGER) AS bar, 150+(value-50)/8 AS raw FROM events),
 mk AS (SELECT position, bar, raw+bar*((position%7-2)/4e0) AS ltp, 150e0+(position%5) AS entry FROM mk0 WHERE bar>0),
 marks AS (SELECT position, bar, ltp, entry, entry*0.9e0 AS stop, entry*1.12e0 AS target, CAST(1+position%2 AS INTEGER) AS contracts, position%5=0 AS is_expiry, bar AS hold_mins, CAST((position*3)%330+bar AS INTEGER) AS mod,
  8e0+position%20 AS atr, 0.5e0+(position+bar)%8/10e0 AS atr_ratio FROM mk)"""


def marks(spark, d):
    from pyspark.sql import Window
    e = fx.table(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    n = C("user_id")
    m = e.select(n.alias("position"), (F.row_number().over(w) - 1).alias("bar"), (150 + (C("value") - 50) / 8).alias("raw")).where("bar > 0")
    p, b = C("position"), C("bar")
    m = m.select("position", "bar", (C("raw") + b * ((p % 7 - 2) / 4.0)).alias("ltp"), (150.0 + p % 5).alias("entry"))
    return m.withColumns({"stop": C("entry") * 0.9, "target": C("entry") * 1.12, "contracts": (1 + p % 2).cast("int"), "is_expiry": p % 5 == 0, "hold_mins": b,
                          "minute_of_day": ((p * 3) % 330 + b).cast("int"), "atr_14": 8.0 + p % 20, "atr_ratio": 0.5 + (p + b) % 8 / 10.0})


MV = f"WITH {MARKS}"
STATE = """st AS (SELECT *, row_number() OVER w AS bh, greatest(entry, max(ltp) OVER (PARTITION BY position ORDER BY bar ROWS UNBOUNDED PRECEDING)) AS peak, coalesce(lag(atr_ratio) OVER w,1e0) AS pr FROM marks WINDOW w AS (PARTITION BY position ORDER BY bar)),
 sg AS (SELECT *, (ltp-entry)/entry AS pp, greatest(0,peak-entry) AS mfe, (peak-entry)/entry AS pg FROM st)"""


@register("q07_position_state", f"{MV}, {STATE} SELECT position, bar, CAST(bh AS INTEGER) AS bars_held, {R('peak', 'mfe')}, floor((pg)*1e6+0.5e0)/1e6 AS peak_gain FROM sg")
def q07(spark, d):
    return fx.rounded(rp.position_state(marks(spark, d)), "position", "bar", "bars_held", "peak", "mfe", "peak_gain")


@register("l07_excursions", f"""{MV} SELECT position, bar, floor((greatest(0,max(ltp-entry) OVER w))*1e6+0.5e0)/1e6 AS mfe, floor((least(0,min(ltp-entry) OVER w))*1e6+0.5e0)/1e6 AS mae FROM marks
WINDOW w AS (PARTITION BY position ORDER BY bar ROWS UNBOUNDED PRECEDING)""")
def l07(spark, d):
    m = marks(spark, d).withColumn("move", C("ltp") - C("entry"))
    return fx.rounded(lb.excursions(m, ("position",), ("bar",), 4096), "position", "bar", "mfe", "mae")


def paper_case(stop, partial):
    base = f"CASE WHEN is_expiry THEN CASE WHEN pg>0 THEN peak*(1-0.015e0) WHEN mod>=225 THEN peak*(1-0.15e0) ELSE {stop} END ELSE CASE WHEN pg>=0.05e0 THEN peak*(1-0.06e0) ELSE {stop} END END"
    trail = f"greatest({stop},{base},CASE WHEN {partial} AND pg>=0 THEN peak*(1-0.04e0) ELSE {stop} END)"
    return f"""CASE WHEN is_expiry AND mod>=310 THEN 'EXPIRY_FORCE_EXIT' WHEN mod>=360 THEN 'TIME_EXIT' WHEN is_expiry AND hold_mins>=10 THEN 'MAX_HOLD_EXIT'
 WHEN NOT is_expiry AND hold_mins>=2 AND mfe<greatest(1,least(3,atr*0.15e0)) THEN 'ZERO_MFE_EXIT' WHEN NOT is_expiry AND ((hold_mins>=25 AND pp<0) OR hold_mins>=45) THEN 'MAX_HOLD_EXIT'
 WHEN ltp<={trail} AND {trail}>{stop} THEN 'TRAIL_STOP' WHEN ltp<={stop} THEN 'STOP_LOSS' WHEN entry-{stop}>0 AND CASE WHEN peak-entry>=(entry-{stop})*2 THEN ltp<entry+(peak-entry)*0.5e0 WHEN bh>=5 AND peak-entry>=entry-{stop} THEN ltp<entry+(peak-entry)*0.33e0 ELSE false END THEN 'TRAIL_TAKE_PROFIT'
 WHEN ltp>=target AND ({partial} OR contracts<=1) THEN 'TARGET' WHEN bh>=15 AND atr_ratio<0.6e0 AND pr<0.6e0 AND pp<0 THEN 'EXPANSION_FAILURE' END"""


# The oracle walks each position bar by bar, carrying the half-exit flag and the moved stop.
WALK = f"""WITH RECURSIVE {MARKS}, {STATE}, wk AS (SELECT position, 0 AS bar, NULL::VARCHAR AS reason, false AS part, 0 AS pbar FROM marks WHERE bar=1 UNION ALL
 SELECT s.position, s.bar, s.rs, s.part OR (s.rs IS NULL AND s.ltp>=s.target AND s.contracts>1), CASE WHEN NOT s.part AND s.rs IS NULL AND s.ltp>=s.target AND s.contracts>1 THEN s.bar ELSE s.pbar END
 FROM (SELECT sg.*, wk.part, wk.pbar, CASE WHEN wk.part THEN {paper_case('entry', 'true')} ELSE {paper_case('stop', 'false')} END AS rs FROM wk JOIN sg ON sg.position=wk.position AND sg.bar=wk.bar+1 WHERE wk.reason IS NULL) s)"""


@register("b09_exit_replay", f"""{WALK} SELECT w.position, w.bar, w.reason AS exit_reason, floor((s.ltp)*1e6+0.5e0)/1e6 AS ltp, CAST(s.bh AS INTEGER) AS bars_held, floor((s.mfe)*1e6+0.5e0)/1e6 AS mfe, floor((s.peak)*1e6+0.5e0)/1e6 AS peak, nullif(w.pbar,0) AS partial_bar
FROM wk w JOIN sg s USING (position, bar) WHERE w.reason IS NOT NULL""")
def b09(spark, d):
    return fx.rounded(rp.exit_replay(marks(spark, d)), "position", "bar", "exit_reason", "ltp", "bars_held", "mfe", "peak", "partial_bar")


LIVE = """CASE WHEN is_expiry AND mod>=310 THEN 'EXPIRY_FORCE_EXIT' WHEN is_expiry AND hold_mins>=10 THEN 'MAX_HOLD_EXIT' WHEN NOT is_expiry AND ((hold_mins>=3 AND pp<CASE WHEN entry>150 THEN -0.02e0 ELSE 0 END) OR hold_mins>=30) THEN 'MAX_HOLD_EXIT'
 WHEN ltp<=tr AND tr>stop THEN 'TRAIL_STOP' WHEN ltp<=stop THEN 'STOP_LOSS' WHEN ltp>=target THEN 'TARGET' WHEN mod>=360 THEN 'TIME_EXIT_EOD' END"""


@register("b10_exit_replay_live", f"""{MV}, {STATE}, tt AS (SELECT *, greatest(stop, CASE WHEN is_expiry THEN CASE WHEN pg>0 THEN peak*(1-0.015e0) WHEN mod>=225 THEN peak*(1-0.15e0) ELSE stop END
 WHEN pg>0.1e0 THEN peak*(1-0.08e0) WHEN pg>0.05e0 THEN peak*(1-0.12e0) WHEN pg>0 THEN peak*(1-0.2e0) WHEN mod>=270 THEN peak*(1-0.25e0) WHEN mod>=210 THEN peak*(1-0.32e0) ELSE stop END) AS tr FROM sg),
 rr AS (SELECT *, {LIVE} AS rs FROM tt) SELECT position, bar, rs AS exit_reason, floor((ltp)*1e6+0.5e0)/1e6 AS ltp FROM rr WHERE rs IS NOT NULL QUALIFY row_number() OVER (PARTITION BY position ORDER BY bar)=1""")
def b10(spark, d):
    return fx.rounded(rp.exit_replay(marks(spark, d), "live"), "position", "bar", "exit_reason", "ltp")


@register("b18_attribution", f"""{QV}, {MOVE}, a AS (SELECT *, bars*0.15e0*sqrt(750/greatest(greatest(30,mins-bars),30)) AS tp, mv*(least(0.8e0,greatest(0.1e0,0.45e0+mv/(atr+1e-9)*0.1e0))*exp(-0.002e0*bars)*CASE WHEN direction='UP' THEN 0.9e0 ELSE 1.05e0 END) AS dp FROM mvq)
SELECT trade_no, floor((tp)*1e6+0.5e0)/1e6 AS theta_pts, floor((dp)*1e6+0.5e0)/1e6 AS dir_pts, floor((tp*65)*1e4+0.5e0)/1e4 AS theta_rs, floor((dp*65)*1e4+0.5e0)/1e4 AS dir_rs FROM a""")
def b18(spark, d):
    q = quotes(spark, d).withColumns({"spot_entry": C("spot"), "spot_exit": C("spot") + (C("trade_no") % 41 - 20) * 2.5, "dte_mins": C("mins"), "qty": F.lit(65)})
    a = rp.attribution(q)
    return a.select("trade_no", fx.tidy(C("theta_pts")).alias("theta_pts"), fx.tidy(C("dir_pts")).alias("dir_pts"), fx.tidy(C("theta_rs"), 4).alias("theta_rs"), fx.tidy(C("dir_rs"), 4).alias("dir_rs"))


# --- risk -----------------------------------------------------------------------------------------------------------
def accounts(spark, d):
    return ledger(spark, d).withColumn("account", C("regime"))


LINE = f"""{LV}, tl AS (SELECT regime AS account, entry_ts AS ts, 1 AS kind, trade_no, CAST(0 AS BIGINT) AS net_p, entry_price*qty AS value FROM ledger UNION ALL SELECT regime, exit_ts, 0, trade_no, net_p, -entry_price*qty FROM ledger WHERE is_closed)"""
CL = """cz AS (SELECT *, CASE WHEN net_p<=0 THEN 1 ELSE 0 END AS ls, row_number() OVER w AS rn FROM tl WHERE kind=0 WINDOW w AS (PARTITION BY account ORDER BY ts, trade_no)), ci AS (SELECT *, sum(1-ls) OVER (PARTITION BY account ORDER BY rn) AS g FROM cz),
 cl AS (SELECT *, CAST(sum(ls) OVER (PARTITION BY account, g ORDER BY rn) AS INTEGER) AS consec, CASE WHEN rn>=5 THEN avg(CASE WHEN net_p>0 THEN 1e0 ELSE 0e0 END) OVER (PARTITION BY account ORDER BY rn ROWS 4 PRECEDING) END AS wr FROM ci)"""


@register("q08_loss_streaks", f"{LINE}, {CL} SELECT account, trade_no, consec AS consec_losses, CASE WHEN consec>=2 THEN ts + INTERVAL 15 MINUTE END AS cooldown_until FROM cl")
def q08(spark, d):
    return rk.loss_streaks(accounts(spark, d)).select("account", "trade_no", "consec_losses", "cooldown_until")


ST = f"""{LINE}, {CL}, mg AS (SELECT tl.*, cl.consec, cl.wr, CASE WHEN cl.consec>=2 THEN tl.ts + INTERVAL 15 MINUTE END AS cd FROM tl LEFT JOIN cl ON tl.kind=0 AND cl.account=tl.account AND cl.trade_no=tl.trade_no),
 ff AS (SELECT *, coalesce(last_value(consec IGNORE NULLS) OVER a,0) AS consec_losses, last_value(cd IGNORE NULLS) OVER a AS cooldown_until, last_value(wr IGNORE NULLS) OVER a AS recent_wr,
  sum(CASE WHEN kind=1 THEN 1 ELSE -1 END) OVER a AS op, sum(value) OVER a AS ex, CAST(coalesce(sum(CASE WHEN kind=0 THEN 1 ELSE 0 END) OVER b,0) AS BIGINT) AS trades_closed, CAST(sum(CASE WHEN kind=0 AND net_p>0 THEN 1 ELSE 0 END) OVER b AS BIGINT) AS wins,
  CAST(sum(net_p) OVER b AS BIGINT) AS day_net_p FROM mg WINDOW a AS (PARTITION BY account ORDER BY ts, kind, trade_no ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY account, CAST(ts AS DATE) ORDER BY ts, kind, trade_no ROWS UNBOUNDED PRECEDING)),
 se AS (SELECT *, CAST(op-1 AS BIGINT) AS open_positions, ex-value AS exposure FROM ff WHERE kind=1)"""


@register("a24_exposure", f"{ST} SELECT account, trade_no, open_positions, floor((exposure)*1e2+0.5e0)/1e2 AS exposure FROM se")
def a24(spark, d):
    s = rk.state_at_entries(accounts(spark, d))
    return s.select("account", "trade_no", "open_positions", fx.tidy(C("exposure"), 2).alias("exposure"))


@register("b12_risk_audit_v5", f"""{ST} SELECT account, trade_no, trades_closed, day_net_p, consec_losses, floor((recent_wr)*1e6+0.5e0)/1e6 AS recent_wr, CASE WHEN day_net_p<=-150000 THEN 'DAILY_LOSS' WHEN trades_closed>=CASE WHEN trade_no%11=0 THEN 1 ELSE 3 END THEN 'TRADE_CAP'
WHEN cooldown_until>ts THEN 'LOSS_COOLDOWN' WHEN recent_wr<0.35e0 THEN 'WIN_RATE' END AS risk_block FROM se""")
def b12(spark, d):
    out = rk.audit_v5(rk.state_at_entries(accounts(spark, d)), C("trade_no") % 11 == 0)
    return fx.rounded(out, "account", "trade_no", "trades_closed", "day_net_p", "consec_losses", "recent_wr", "risk_block")


@register("b13_session_controls", f"""{ST} SELECT account, trade_no, CASE WHEN trades_closed>=CASE WHEN trade_no%11=0 THEN 1 WHEN trades_closed=10 AND consec_losses=0 AND wins>=2 THEN 11 ELSE 10 END THEN 'SESSION_CAP' WHEN day_net_p<=-150000 THEN 'DAILY_LOSS_LIMIT'
WHEN cooldown_until>ts THEN 'CONSEC_LOSS_COOLDOWN' WHEN recent_wr<0.35e0 THEN 'OBSERVATION_MODE' END AS session_block FROM se""")
def b13(spark, d):
    return rk.session_controls(rk.state_at_entries(accounts(spark, d)), C("trade_no") % 11 == 0).select("account", "trade_no", "session_block")


V4R = {"daily_dd": "day_net_p/100e0/(100000+1e-9)<=-0.1e0", "loss_cooldown": "consec_losses>=2 AND cooldown_until>ts", "vol_shock": "(trade_no%50)/10e0/(1+1e-9)>3 AND trade_no%50>0", "black_swan": "trade_no%400<45",
       "regime_flip": "trade_no%200<30 AND NOT (trade_no%6=3 AND trade_no%3=0)", "crisis": "trade_no%4=2 AND NOT (trade_no%6 IN (0,1) AND trade_no%3=0)"}


@register("b11_risk_audit", f"{ST}, rv AS (SELECT account, trade_no, {', '.join(f'coalesce({c},false) AS {n}' for n, c in V4R.items())} FROM se) SELECT *, CASE {' '.join(f'WHEN {n} THEN {chr(39)}{n}{chr(39)}' for n in V4R)} END AS risk_block FROM rv")
def b11(spark, d):
    n = C("trade_no")
    m = n % 6
    micro = F.when(m == 0, "TRENDING_UP").when(m == 1, "TRENDING_DN").when(m == 3, "BREAKOUT").otherwise("RANGING")
    out = rk.audit_v4(rk.state_at_entries(accounts(spark, d)), F.lit(100000.0), n % 50 / 10.0, F.lit(1.0), n % 400, n % 200, micro, F.when(n % 3 == 0, 0.9).otherwise(0.5), (n % 4).cast("int"))
    return out.select("account", "trade_no", *V4R, "risk_block")


@register("b16_concentration", f"{ST} SELECT account, trade_no, CASE WHEN open_positions>=2 THEN 'MAX_POSITIONS' WHEN exposure+value>5000 THEN 'MAX_EXPOSURE' END AS concentration_block FROM se")
def b16(spark, d):
    return rk.concentration(rk.state_at_entries(accounts(spark, d))).select("account", "trade_no", "concentration_block")


@register("b14_period_drawdown", f"""{LV}, g AS (SELECT file_date, CAST(sum(net_p) AS BIGINT) AS net_p FROM ledger WHERE is_closed GROUP BY 1), e AS (SELECT *, sum(net_p) OVER (ORDER BY file_date)/100e0+100000 AS equity FROM g), o AS (SELECT *, equity-net_p/100e0 AS op FROM e),
s AS (SELECT *, first_value(op) OVER (PARTITION BY date_trunc('week', file_date) ORDER BY file_date) AS ws, first_value(op) OVER (PARTITION BY date_trunc('month', file_date) ORDER BY file_date) AS ms FROM o), q AS (SELECT *, (equity-ws)/(ws+1e-9) AS wd, (equity-ms)/(ms+1e-9) AS md FROM s)
SELECT file_date, floor((equity)*1e2+0.5e0)/1e2 AS equity, floor((wd)*1e6+0.5e0)/1e6 AS week_dd, floor((md)*1e6+0.5e0)/1e6 AS month_dd, md<=-0.1e0 AS halt, CASE WHEN md<=-0.1e0 THEN 0e0 WHEN wd<=-0.05e0 THEN 0.5e0 ELSE 1e0 END AS size_mult FROM q""")
def b14(spark, d):
    p = rk.period_drawdown(ledger(spark, d))
    return p.select("file_date", fx.tidy(C("equity"), 2).alias("equity"), fx.tidy(C("week_dd")).alias("week_dd"), fx.tidy(C("month_dd")).alias("month_dd"), "halt", "size_mult")


@register("b15_setup_fatigue", f"""{LV}, f AS (SELECT *, CAST(trade_no%4 AS INTEGER) AS setup FROM ledger WHERE is_closed), c AS (SELECT trade_no, CAST(coalesce(sum(CASE WHEN net_p<0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_date, setup, regime ORDER BY exit_ts, trade_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS INTEGER) AS prior_losses FROM f)
SELECT trade_no, prior_losses, prior_losses>=2 AS disabled FROM c""")
def b15(spark, d):
    t = ledger(spark, d).where("is_closed").withColumn("setup", (C("trade_no") % 4).cast("int"))
    return rk.setup_fatigue(t).select("trade_no", "prior_losses", "disabled")


# --- model training -------------------------------------------------------------------------------------------------
def once(make):
    """Staged result of ``make`` for each table folder, shared by the queries of one application as long as its files are there."""
    from barflow.streaming.streams import exists
    known = {}

    def get(spark, d):
        key = spark.sparkContext.applicationId, d
        if key not in known or not all(exists(spark, f) for f in known[key].inputFiles()):
            known[key] = make(spark, d)
        return known[key]
    get.known = known
    return get


FEATURES = ["atr_14_pct", "rsi_14", "adx_14", "vwap_dist", "bb_pos", "stoch_k", "vol_20m"]


@once
def training_frame(spark, d):
    """Labelled feature rows with folds and weights, written once: every fit reads them many times."""
    from barflow.operators.stage import materialize
    from barflow.plans import features as ft
    f = ft.add_features(fx.bars(spark, d), "returns", "atr", "rsi", "dmi", "vwap", "bollinger", "stochastic", "volatility", "volume", "ticks", "macd",
                        bars_per_day=24)
    f = materialize(lb.triple_barrier(ft.crosses(f).withColumn("known_regime", F.lit(1)), 5, bars_per_day=24))
    rows = f.where("barrier_5m <> 0").na.drop(subset=FEATURES).withColumns({"y": F.when(C("barrier_5m") > 0, 1).otherwise(0), "ret": C("fut_ret_5m"),
                                                                            "regime": F.when(C("adx_14") > 20, 0).otherwise(1)})
    return materialize(ln.sample_weights(ln.walk_forward(ln.ordinals(materialize(rows))), "label_5m"))


@once
def oof(spark, d):
    from barflow.operators.stage import materialize
    return materialize(ln.out_of_fold(training_frame(spark, d), FEATURES))


@once
def importance(spark, d):
    """Importances of one fit, a row per feature."""
    return ln.feature_importance(training_frame(spark, d), FEATURES)


@register("m05_out_of_fold")
def m05(spark, d):
    return fx.rounded(oof(spark, d), "symbol", "dt", "test_fold", "y", "proba")


@register("m06_calibration")
def m06(spark, d):
    rows = oof(spark, d)
    return fx.rounded(ln.calibrate(ln.platt(rows), rows), "symbol", "dt", "y", "proba", "calibrated")


@once
def stacked(spark, d):
    from barflow.operators.stage import materialize
    rows = ln.context_features(oof(spark, d).withColumn("meta", lb.meta_label(C("proba"), C("y"))), [c for c in ln.META_FEATURES if c != "proba"])
    context = ["proba", "regime", "session_pct", "iv_proxy", "atr_14_pct", "adx_14", "dmi_diff"]
    rows = materialize(rows)
    stack, meta = ln.in_parallel(spark, [
        lambda: materialize(ln.cross_fit_context(rows, context, "y", "stacked", weight="weight")),
        lambda: materialize(ln.cross_fit_context(rows, ln.META_FEATURES, "meta", "meta_conf", weight="weight", neutral=ln.META_NEUTRAL))])
    return materialize(stack.join(meta.select("symbol", "dt", "meta_conf"), ["symbol", "dt"]))


@register("m07_stacker_and_meta")
def m07(spark, d):
    return fx.rounded(stacked(spark, d), "symbol", "dt", "proba", "stacked", "meta_conf")


@register("m09_regime_experts")
def m09(spark, d):
    """Global and regime models side by side, each row scored by models of folds that end before it."""
    from barflow.operators.stage import materialize
    from barflow.plans.votes import blend_expert
    expert, frame = F.when(C("regime").isin(*ln.EXPERT_REGIMES), C("regime")), training_frame(spark, d)
    whole, part = ln.in_parallel(spark, [lambda: oof(spark, d), lambda: materialize(ln.out_of_fold(frame, FEATURES, by=expert, name="p_regime"))])
    out = part.join(whole.select("symbol", "dt", C("proba").alias("p_global")), ["symbol", "dt"])
    return fx.rounded(out.withColumn("p", blend_expert(C("p_regime"), C("p_global"), F.lit(0.6))), "symbol", "dt", "regime", "p_global", "p_regime", "p")


@register("m13_feature_importance")
def m13(spark, d):
    return fx.rounded(importance(spark, d))


QUERIES["t03_top_features"] = lambda spark, d: importance(spark, d).orderBy(F.desc("importance"), "feature").limit(3)
