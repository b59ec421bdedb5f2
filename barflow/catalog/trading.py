"""Ledger, report and scalar-function queries over trades made from orders and line items."""
from __future__ import annotations

from pyspark.sql import functions as F

from barflow.catalog import fixtures as fx
from barflow.functions import costs, pricing, rules, text
from barflow.functions.numeric import bucket_score, cut, normal_cdf
from barflow.plans import ledger as lg

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


def money(x):
    return f"CAST(floor(({x})*100+0.5e0) AS BIGINT)"


# A log with repeated entries (the later wins) and exits whose entry is missing.
EVENTS = """ev AS (SELECT 'ENTRY' AS event, CAST(entry_ts AS DATE) AS file_date, trade_no, 0 AS seq, entry_ts AS ts, direction, option_type, entry_price AS price, contracts,
   NULL::VARCHAR AS exit_reason, confidence, regime FROM trades WHERE trade_no % 97 <> 0
  UNION ALL SELECT 'ENTRY', CAST(entry_ts AS DATE), trade_no, 1, entry_ts, direction, option_type, entry_price*1.1e0, contracts, NULL, confidence, regime FROM trades WHERE trade_no % 89 = 0
  UNION ALL SELECT 'EXIT', CAST(entry_ts AS DATE), trade_no, 2, exit_ts, direction, option_type, exit_price, contracts, exit_reason, confidence, regime FROM trades WHERE exit_ts IS NOT NULL)"""
PAIRS = """ex AS (SELECT * FROM ev WHERE event='EXIT'), en AS (SELECT * FROM ev WHERE event='ENTRY' QUALIFY row_number() OVER (PARTITION BY file_date, trade_no ORDER BY seq DESC)=1),
  pairs AS (SELECT en.file_date, en.trade_no, en.ts AS entry_ts, en.direction, en.option_type, en.price AS entry_price, en.contracts, en.confidence, en.regime,
   ex.ts AS exit_ts, ex.price AS exit_price, coalesce(ex.exit_reason,'OPEN') AS exit_reason FROM en LEFT JOIN ex USING (file_date, trade_no))"""
LEDGER = f"""l0 AS (SELECT *, contracts*65 AS qty, exit_price-entry_price AS pnl_pts FROM pairs),
  l1 AS (SELECT *, pnl_pts*qty AS gross, 40e0+40e0*0.18e0+exit_price*qty*0.001e0+(entry_price*qty+exit_price*qty)*0.00053e0+entry_price*qty*0.00003e0 AS cost FROM l0),
  ledger AS (SELECT *, {money('gross')} AS gross_p, {money('cost')} AS charges_p, {money('gross-cost')} AS net_p, exit_price IS NOT NULL AS is_closed,
   CASE WHEN exit_price IS NOT NULL THEN greatest(0, CAST(floor((epoch(exit_ts)-epoch(entry_ts))/60) AS BIGINT)) END AS hold_mins FROM l1)"""
LV = f"{V('trades')}, {EVENTS}, {PAIRS}, {LEDGER}"


def events(spark, d):
    """The log in one pass over the trades: a row for each event that a trade has."""
    n, is_exit = C("trade_no"), C("seq") == 2
    t = fx.trades(spark, d).withColumn("seq", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    t = t.where(((C("seq") == 0) & (n % 97 != 0)) | ((C("seq") == 1) & (n % 89 == 0)) | (is_exit & C("exit_ts").isNotNull()))
    price = F.when(is_exit, C("exit_price")).when(C("seq") == 1, C("entry_price") * 1.1).otherwise(C("entry_price"))
    return t.select(F.when(is_exit, "EXIT").otherwise("ENTRY").alias("event"), F.to_date("entry_ts").alias("file_date"), "trade_no", "seq",
                    F.when(is_exit, C("exit_ts")).otherwise(C("entry_ts")).alias("ts"), "direction", "option_type", price.alias("price"), "contracts",
                    F.when(is_exit, C("exit_reason")).alias("exit_reason"), "confidence", "regime")


def ledger(spark, d):
    return lg.trade_ledger(lg.pair_entry_exit(events(spark, d)))


@register("j07_pair_entry_exit", f"{LV} SELECT file_date, trade_no, entry_ts, exit_ts, {R('entry_price', 'exit_price')}, exit_reason FROM pairs")
def j07(spark, d):
    return fx.rounded(lg.pair_entry_exit(events(spark, d)), "file_date", "trade_no", "entry_ts", "exit_ts", "entry_price", "exit_price", "exit_reason")


@register("b07_trade_ledger", f"""{LV} SELECT file_date, trade_no, qty, {R('pnl_pts')}, gross_p, charges_p, net_p, hold_mins, strftime(entry_ts, '%H:%M') AS entry_time,
CASE WHEN exit_ts IS NULL THEN 'OPEN' ELSE strftime(exit_ts, '%H:%M') END AS exit_time, exit_reason FROM ledger""")
def b07(spark, d):
    return fx.rounded(ledger(spark, d), "file_date", "trade_no", "qty", "pnl_pts", "gross_p", "charges_p", "net_p", "hold_mins", "entry_time", "exit_time", "exit_reason")


SUMMARY = """count(*) AS trades, count(net_p) AS closed, count(*) FILTER (net_p>0) AS wins, count(*) FILTER (net_p<=0) AS losses, CAST(sum(gross_p) AS BIGINT) AS gross_p,
 CAST(sum(charges_p) AS BIGINT) AS charges_p, CAST(sum(net_p) AS BIGINT) AS net_p, CAST(coalesce(sum(net_p) FILTER (net_p>0),0) AS DOUBLE) AS w, CAST(coalesce(sum(net_p) FILTER (net_p<=0),0) AS DOUBLE) AS l,
 avg(hold_mins) AS avg_hold, count(*) FILTER (direction='UP') AS up_trades, count(*) FILTER (direction='DOWN') AS down_trades, count(*) FILTER (option_type='CE') AS ce_trades,
 count(*) FILTER (option_type='PE') AS pe_trades"""
SUMCOLS = """trades, closed, wins, losses, gross_p, charges_p, net_p, floor((avg_hold)*1e6+0.5e0)/1e6 AS avg_hold, up_trades, down_trades, ce_trades, pe_trades, trades-closed AS open_trades,
 floor((wins/closed)*1e6+0.5e0)/1e6 AS win_rate, floor((abs(w/l))*1e6+0.5e0)/1e6 AS profit_factor, floor((w/100e0/wins)*1e6+0.5e0)/1e6 AS avg_win, floor((l/100e0/losses)*1e6+0.5e0)/1e6 AS avg_loss,
 floor((net_p/100e0/100000*100)*1e6+0.5e0)/1e6 AS return_pct, floor((net_p/100e0+100000)*1e6+0.5e0)/1e6 AS equity_end"""


@register("a11_pnl_summary", f"{LV}, s AS (SELECT {SUMMARY} FROM ledger) SELECT {SUMCOLS} FROM s")
def a11(spark, d):
    return fx.rounded(lg.pnl_summary(ledger(spark, d)))


@register("b08_trade_report", f"""{LV}, s AS (SELECT regime, {SUMMARY} FROM ledger GROUP BY 1), q AS (SELECT regime, {SUMCOLS} FROM s) SELECT *,
CASE WHEN win_rate>=0.55 AND net_p>0 AND profit_factor>=1.5 AND closed>=60 THEN 'GO-LIVE READY' WHEN win_rate>=0.55 AND net_p>0 AND profit_factor>=1.5 THEN 'TRENDING POSITIVE'
WHEN win_rate>=0.55 AND net_p>0 THEN 'ACCEPTABLE' WHEN net_p>0 AND win_rate<0.5 THEN 'PROFITABLE LOW WIN RATE' WHEN net_p<0 AND win_rate>=0.5 THEN 'LOSING BIG LOSERS'
WHEN net_p<0 THEN 'LOSING' ELSE 'BREAKEVEN' END AS verdict FROM q""")
def b08(spark, d):
    return fx.rounded(lg.trade_report(ledger(spark, d), ("regime",)))


@register("a12_exit_reasons", f"""{LV} SELECT exit_reason, count(*) AS n, floor((count(*)/(SELECT count(*) FROM ledger))*1e6+0.5e0)/1e6 AS share_all,
floor((count(*)/(SELECT count(net_p) FROM ledger))*1e6+0.5e0)/1e6 AS share_closed FROM ledger WHERE is_closed GROUP BY 1""")
def a12(spark, d):
    return fx.rounded(lg.exit_reasons(ledger(spark, d)))


QUERIES["t04_reasons_by_count"], ORACLES["t04_reasons_by_count"] = QUERIES["a12_exit_reasons"], ORACLES["a12_exit_reasons"]


@register("a13_daily_pnl", f"""{LV}, g AS (SELECT file_date, count(*) AS trades, count(*) FILTER (net_p>0) AS wins, CAST(sum(net_p) AS BIGINT) AS net_p FROM ledger WHERE is_closed GROUP BY 1)
SELECT *, floor((sum(net_p) OVER (ORDER BY file_date)/100e0+100000)*1e6+0.5e0)/1e6 AS equity FROM g""")
def a13(spark, d):
    return fx.rounded(lg.daily_pnl(ledger(spark, d)))


@register("w49_rolling_win_rate", f"""{LV}, r AS (SELECT regime, trade_no, CASE WHEN count(*) OVER w>=5 THEN avg(CASE WHEN net_p>0 THEN 1e0 ELSE 0e0 END) OVER w END AS wr FROM ledger WHERE is_closed
WINDOW w AS (PARTITION BY regime ORDER BY exit_ts, trade_no ROWS 4 PRECEDING)) SELECT regime, trade_no, floor((wr)*1e6+0.5e0)/1e6 AS rolling_wr, coalesce(wr<0.3,false) AS warn_report, coalesce(wr<0.35,false) AS observe FROM r""")
def w49(spark, d):
    return fx.rounded(lg.rolling_win_rate(ledger(spark, d)), "regime", "trade_no", "rolling_wr", "warn_report", "observe")


@register("t05_last_closed", f"{LV} SELECT trade_no, exit_ts, net_p FROM ledger WHERE is_closed ORDER BY exit_ts DESC, trade_no DESC LIMIT 5")
def t05(spark, d):
    return lg.last_closed(ledger(spark, d)).select("trade_no", "exit_ts", "net_p")


@register("a14_end_of_day", f"""{LV}, c AS (SELECT *, sum(net_p) OVER w AS cum FROM ledger WHERE is_closed WINDOW w AS (PARTITION BY file_date ORDER BY exit_ts, trade_no ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, greatest(0, max(cum) OVER (PARTITION BY file_date ORDER BY exit_ts, trade_no ROWS UNBOUNDED PRECEDING)) AS peak FROM c),
g AS (SELECT file_date, count(*) AS trades, avg(CASE WHEN net_p>0 THEN 1e0 ELSE 0e0 END) AS win_rate, CAST(sum(gross_p) AS BIGINT) AS gross_p, CAST(sum(charges_p) AS BIGINT) AS charges_p,
 CAST(sum(net_p) AS BIGINT) AS net_p, avg(hold_mins) AS avg_hold, avg(net_p/100e0) AS m, stddev_pop(net_p/100e0) AS s, min((cum-peak)/(peak+10000000e0+1e-7)) AS worst_dd FROM p GROUP BY 1)
SELECT file_date, trades, {R('win_rate', 'avg_hold', 'worst_dd')}, gross_p, charges_p, net_p, floor((CASE WHEN trades>1 THEN m/(s+1e-9)*sqrt(trades) ELSE 0 END)*1e6+0.5e0)/1e6 AS sharpe FROM g""")
def a14(spark, d):
    return fx.rounded(lg.end_of_day(ledger(spark, d)))


@register("a15_session_totals", f"""{LV} SELECT trade_no, count(*) OVER w AS n_trades, count(*) FILTER (net_p>0) OVER w AS n_wins, count(*) FILTER (net_p<=0) OVER w AS n_losses,
CAST(sum(net_p) OVER w AS BIGINT) AS net_so_far_p FROM ledger WHERE is_closed WINDOW w AS (PARTITION BY file_date ORDER BY exit_ts, trade_no ROWS UNBOUNDED PRECEDING)""")
def a15(spark, d):
    return lg.session_totals(ledger(spark, d)).select("trade_no", "n_trades", "n_wins", "n_losses", "net_so_far_p")


@register("s13_report_lines")
def s13(spark, d):
    return lg.report_lines(ledger(spark, d))


@register("w47_running_drawdown", f"""{LV}, c AS (SELECT trade_no, regime, exit_ts, sum(net_p) OVER w AS cum FROM ledger WHERE is_closed WINDOW w AS (PARTITION BY regime ORDER BY exit_ts, trade_no ROWS UNBOUNDED PRECEDING)),
m AS (SELECT *, max(cum) OVER (PARTITION BY regime ORDER BY exit_ts, trade_no ROWS UNBOUNDED PRECEDING) AS peak FROM c)
SELECT trade_no, floor((cum/100e0)*1e6+0.5e0)/1e6 AS cum, floor((peak/100e0)*1e6+0.5e0)/1e6 AS peak, floor(((cum-peak)/100e0)*1e6+0.5e0)/1e6 AS drawdown FROM m""")
def w47(spark, d):
    from barflow.operators.scans import drawdown
    out = drawdown(ledger(spark, d).where("is_closed"), C("net_p"), keys=["regime"], order=["exit_ts", "trade_no"], bucket="day")
    return fx.rounded(out.withColumns({c: C(c) / 100.0 for c in ("cum", "peak", "drawdown")}), "trade_no", "cum", "peak", "drawdown")


SIG = """sg AS (SELECT seq, ts, substr(md5(concat_ws('_', CASE WHEN price>50 THEN 'UP' ELSE 'DOWN' END, CAST(extract(hour FROM ts) AS INTEGER), CAST(round_even(price/10,0)*10 AS BIGINT))),1,12) AS hash FROM ticks)"""


@register("f27_signal_hash", f"{V('ticks')}, {SIG} SELECT seq, hash FROM sg")
def f27h(spark, d):
    return signals(spark, d).select("seq", "hash")


def signals(spark, d):
    t = fx.ticks(spark, d)
    way = F.when(C("price") > 50, "UP").otherwise("DOWN")
    return t.select("seq", "ts", text.signal_hash(way, F.hour("ts"), C("price")).alias("hash"))


REPEATS = f"""WITH RECURSIVE {V('ticks')[5:]}, {SIG}, n AS (SELECT *, row_number() OVER (PARTITION BY hash, date_trunc('hour', ts) ORDER BY ts, seq) AS rn, date_trunc('hour', ts) AS h FROM sg),
k AS (SELECT seq, hash, h, rn, ts AS last, true AS kept FROM n WHERE rn=1 UNION ALL SELECT n.seq, n.hash, n.h, n.rn, CASE WHEN epoch(n.ts)-epoch(k.last)>=600 THEN n.ts ELSE k.last END,
 epoch(n.ts)-epoch(k.last)>=600 FROM k JOIN n ON n.hash=k.hash AND n.h=k.h AND n.rn=k.rn+1) SELECT seq, hash, kept FROM k"""


@register("ad4_duplicate_signals", REPEATS)
def ad4(spark, d):
    return lg.duplicate_signals(signals(spark, d), 600).select("seq", "hash", "kept")


# --- scalar functions -----------------------------------------------------------------------------------------------
PHI = """(CASE WHEN {x}>=0 THEN 1-exp(-({x})*({x})/2)/2.5066282746310002e0*{t} ELSE exp(-({x})*({x})/2)/2.5066282746310002e0*{t} END)"""


def phi(x):
    t = f"(1/(1+0.2316419e0*abs({x})))"
    poly = f"({t}*(0.319381530e0+{t}*(-0.356563782e0+{t}*(1.781477937e0+{t}*(-1.821255978e0+{t}*1.330274429e0)))))"
    return PHI.format(x=x, t=poly)


@register("f01_math", """SELECT event_id, floor((abs(value-50))*1e6+0.5e0)/1e6 AS a, floor((sqrt(value))*1e6+0.5e0)/1e6 AS sq, floor((exp(-value/50))*1e6+0.5e0)/1e6 AS ex, floor((ln(value+1))*1e6+0.5e0)/1e6 AS lg,
floor((tanh((value-50)/20))*1e6+0.5e0)/1e6 AS th, CAST(sign(value-50) AS INTEGER) AS sg, floor((least(60,greatest(20,value)))*1e6+0.5e0)/1e6 AS cl, CAST(floor(value/7) AS BIGINT) AS fl,
CAST(round_even(value/2,0) AS BIGINT) AS he FROM events""")
def f01(spark, d):
    v = C("value")
    return fx.rounded(fx.table(spark, d, "events").select(
        "event_id", F.abs(v - 50).alias("a"), F.sqrt(v).alias("sq"), F.exp(-v / 50).alias("ex"), F.ln(v + 1).alias("lg"), F.tanh((v - 50) / 20).alias("th"),
        F.signum(v - 50).cast("int").alias("sg"), F.least(F.lit(60.0), F.greatest(F.lit(20.0), v)).alias("cl"), F.floor(v / 7).alias("fl"),
        F.bround(v / 2, 0).cast("long").alias("he")))


@register("f02_normal_cdf", f"SELECT event_id, floor(({phi('((value-50)/20)')})*1e6+0.5e0)/1e6 AS cdf FROM events")
def f02(spark, d):
    return fx.rounded(fx.table(spark, d, "events").select("event_id", normal_cdf((C("value") - 50) / 20).alias("cdf")))


QUOTES = """q AS (SELECT trade_no, entry_ts, direction, option_type, entry_price, confidence, regime, 20000+entry_price*10 AS spot, 10+confidence*20 AS iv, CAST(1+trade_no%1800 AS DOUBLE) AS mins,
  CAST(round_even((20000+entry_price*10)/50,0)*50 AS INTEGER) AS strike, 8+trade_no%25 AS atr, trade_no%60 AS bars, trade_no%375 AS mod, trade_no%5=0 AS is_expiry, (trade_no%30)/10e0 AS ivp FROM trades)"""


def quotes(spark, d):
    t = fx.trades(spark, d)
    spot = 20000 + C("entry_price") * 10
    n = C("trade_no")
    return t.select("trade_no", "entry_ts", "direction", "option_type", "entry_price", "confidence", "regime", spot.alias("spot"), (10 + C("confidence") * 20).alias("iv"),
                    (1 + n % 1800).cast("double").alias("mins"), pricing.atm_strike(spot).alias("strike"), (8 + n % 25).alias("atr"), (n % 60).alias("bars"),
                    (n % 375).alias("mod"), (n % 5 == 0).alias("is_expiry"), ((n % 30) / F.lit(10.0)).alias("ivp"))


QV = f"{V('trades')}, {QUOTES}"
PREM = f"""pr AS (SELECT *, greatest(mins,1)/(252*375) AS t, greatest(iv,0.1)/100 AS sg FROM q), dd AS (SELECT *, (ln(spot/strike)+(0.065e0+0.5e0*sg*sg)*t)/(sg*sqrt(t)) AS d1 FROM pr),
de AS (SELECT *, d1-sg*sqrt(t) AS d2, strike*exp(-0.065e0*t) AS pv FROM dd),
df AS (SELECT *, greatest(2,least(CASE WHEN option_type='CE' THEN spot*{phi('d1')}-pv*{phi('d2')} ELSE pv*{phi('(-d2)')}-spot*{phi('(-d1)')} END, CASE WHEN option_type='CE' THEN spot ELSE strike END*0.5e0)) AS premium FROM de)"""


@register("f03_price_quotes", f"{QV}, {PREM} SELECT trade_no, floor((premium)*1e4+0.5e0)/1e4 AS premium FROM df")
def f03(spark, d):
    p = pricing.premium(C("spot"), C("iv"), C("mins"), C("strike"), C("option_type"))
    return quotes(spark, d).select("trade_no", fx.tidy(p, 4).alias("premium"))


DELTA = "(least(0.8e0,greatest(0.1e0,0.45e0+mv/(atr+1e-9)*0.1e0))*exp(-0.002e0*bars)*CASE WHEN direction='UP' THEN 0.9e0 ELSE 1.05e0 END)"
MOVE = "mvq AS (SELECT *, CASE WHEN direction='UP' THEN 1 ELSE -1 END*(trade_no%41-20)*2.5e0 AS mv, 0.15e0*sqrt(750/greatest(mins,30)) AS theta FROM q)"


@register("f04_effective_delta", f"{QV}, {MOVE} SELECT trade_no, floor(({DELTA})*1e6+0.5e0)/1e6 AS delta FROM mvq")
def f04(spark, d):
    mv = F.when(C("direction") == "UP", 1).otherwise(-1) * (C("trade_no") % 41 - 20) * 2.5
    return fx.rounded(quotes(spark, d).select("trade_no", pricing.effective_delta(C("bars"), mv, C("atr"), C("direction")).alias("delta")))


@register("f05_option_mark", f"{QV}, {MOVE}, m AS (SELECT *, greatest(2,entry_price+mv*{DELTA}-bars*theta) AS mark, entry_price*1.1e0 AS actual FROM mvq) SELECT trade_no, {R('mark')}, "
          "floor((CASE WHEN actual>0 AND abs(mark-actual)/(entry_price+1e-9)>0.2e0 THEN actual ELSE mark END)*1e6+0.5e0)/1e6 AS trusted FROM m")
def f05(spark, d):
    q = quotes(spark, d)
    mark = pricing.option_mark(C("entry_price"), C("spot"), C("spot") + (C("trade_no") % 41 - 20) * 2.5, C("atr"), C("direction"), C("bars"), C("mins"))
    out = q.withColumn("mark", mark)
    return fx.rounded(out.withColumn("trusted", pricing.trusted_mark(C("mark"), C("entry_price") * 1.1, C("entry_price"))), "trade_no", "mark", "trusted")


@register("f06_dynamic_theta", f"{QV}, {MOVE} SELECT trade_no, {R('theta')} FROM mvq")
def f06(spark, d):
    return fx.rounded(quotes(spark, d).select("trade_no", pricing.dynamic_theta(C("mins")).alias("theta")))


@register("f07_moneyness_delta", f"""{QV} SELECT trade_no, floor((least(0.9e0,greatest(0.1e0,0.5e0+(1+3*exp(-(greatest(mins,1)/375)))*CASE WHEN direction='UP' THEN spot/strike-1 ELSE 1-spot/strike END)))*1e6+0.5e0)/1e6 AS delta FROM q""")
def f07(spark, d):
    return fx.rounded(quotes(spark, d).select("trade_no", pricing.moneyness_delta(C("spot"), C("strike"), C("mins"), C("direction")).alias("delta")))


@register("f08_charges", f"""{V('trades')}, q AS (SELECT trade_no, entry_price*contracts*65 AS e, exit_price*contracts*65 AS x, trade_no%5=0 AS exd FROM trades WHERE exit_price IS NOT NULL),
p AS (SELECT trade_no, x*CASE WHEN exd THEN 0.00125e0 ELSE 0.001e0 END AS stt, (e+x)*0.00053e0 AS txn, e*0.00003e0 AS stamp FROM q)
SELECT trade_no, 40e0 AS brokerage, floor((40e0*0.18e0)*1e6+0.5e0)/1e6 AS gst, {R('stt', 'txn', 'stamp')}, floor((40+40*0.18e0+stt+txn+stamp)*1e6+0.5e0)/1e6 AS total FROM p""")
def f08(spark, d):
    t = fx.trades(spark, d).where("exit_price is not null")
    ch = costs.round_trip_charges(C("entry_price"), C("exit_price"), C("contracts") * 65, C("trade_no") % 5 == 0)
    return fx.rounded(t.select("trade_no", ch.alias("c")).select("trade_no", "c.*"))


@register("f09_effective_cost", f"""{QV} SELECT trade_no, floor((0.015e0*least(3,CASE WHEN mod<30 OR mod>270 THEN 1.4e0 ELSE 1 END*CASE WHEN ivp>1.5 THEN 1.3e0 ELSE 1 END*
CASE WHEN trade_no%7=0 THEN 1.5e0 ELSE 1 END*CASE WHEN is_expiry THEN 1.6e0 ELSE 1 END))*1e9+0.5e0)/1e9 AS cost FROM q""")
def f09(spark, d):
    cost = costs.effective_cost((C("mod") < 30) | (C("mod") > 270), C("ivp"), C("trade_no") % 7 == 0, C("is_expiry"))
    return fx.rounded(quotes(spark, d).select("trade_no", cost.alias("cost")), places=9)


@register("f10_lot_size", "SELECT o_orderkey, CASE WHEN CAST(o_orderdate + INTERVAL 9800 DAY AS DATE) >= DATE '2025-04-26' THEN 65 ELSE 75 END AS lot FROM orders")
def f10(spark, d):
    return fx.table(spark, d, "orders").select("o_orderkey", pricing.lot_size(F.date_add(F.to_date("o_orderdate"), 9800)).alias("lot"))


@register("f11_minutes_to_expiry", """WITH q AS (SELECT event_id, ts, CAST(ts AS DATE) AS d, extract(hour FROM ts)*60+extract(minute FROM ts) AS m, isodow(ts)-1 AS w FROM events),
e AS (SELECT *, CASE WHEN (1-w+7)%7=0 AND m>=930 THEN 7 ELSE (1-w+7)%7 END AS a, greatest(0,930-greatest(555,m)) AS lft FROM q)
SELECT event_id, CAST(least(1875,greatest(1,CASE WHEN a=0 THEN lft ELSE lft + 375 + 375*(SELECT count(*) FROM generate_series(1, a-1) g(i) WHERE (w+i)%7<5) END)) AS DOUBLE) AS mins FROM e""")
def f11(spark, d):
    return fx.table(spark, d, "events").select("event_id", pricing.minutes_to_expiry(C("ts")).alias("mins"))


@register("f12_atm_strike", f"{QV} SELECT trade_no, strike FROM q")
def f12(spark, d):
    return quotes(spark, d).select("trade_no", "strike")


@register("f13_expiry_zone", f"""{QV} SELECT trade_no, CASE WHEN NOT is_expiry THEN 'NORMAL' WHEN mod<=134 THEN 'EXPIRY_ZONE1_HALF_SIZE' WHEN mod<=224 THEN 'EXPIRY_ZONE2_PINNING_BLOCK'
WHEN mod<=334 THEN 'EXPIRY_ZONE3_PINBREAK_QTR' ELSE 'EXPIRY_ZONE4_GAMMA_BLOCK' END AS tag, NOT is_expiry OR mod<=134 OR (mod>=225 AND mod<=334) AS allow_new, 1e0 AS size_mult,
CASE WHEN NOT is_expiry THEN 1e0 WHEN mod<=134 THEN 0.875e0 WHEN mod<=224 THEN 0.625e0 ELSE 0.5e0 END AS stop_tighten FROM q""")
def f13(spark, d):
    return quotes(spark, d).select("trade_no", rules.expiry_zone(C("is_expiry"), C("mod")).alias("z")).select("trade_no", "z.*")


@register("f14_entry_filters", f"""{QV} SELECT trade_no, is_expiry AND iv>24 - 4 AS iv_blocked, ivp>1.5 OR trade_no%35>20 AS vega_blocked,
CASE WHEN trade_no%9=0 THEN true ELSE ((entry_price+0.01e0*(trade_no%12)*entry_price)-entry_price)/entry_price<=0.05e0 END AS spread_ok,
trade_no%90<50 OR trade_no%130<50 AS near_oi, abs(entry_price-m5)/m5>0.02e0 AS off_ticks
FROM (SELECT *, (entry_price+entry_price+entry_price+entry_price+(entry_price+trade_no%20))/5 AS m5 FROM q)""")
def f14(spark, d):
    n, e = C("trade_no"), C("entry_price")
    bid = F.when(n % 9 == 0, 0.0).otherwise(e)
    ticks = F.array(e, e, e, e, e + n % 20)
    return quotes(spark, d).select("trade_no", rules.expiry_iv_blocked(C("is_expiry"), C("iv")).alias("iv_blocked"), rules.vega_blocked(C("ivp"), n % 35).alias("vega_blocked"),
                                   rules.spread_ok(bid, bid + 0.01 * (n % 12) * e, e).alias("spread_ok"),
                                   rules.near_open_interest(C("strike"), C("strike") + n % 90, C("strike") + n % 130).alias("near_oi"),
                                   rules.price_off_ticks(e, ticks).alias("off_ticks"))


@register("f15_limit_price", f"""{QV}, s AS (SELECT *, CASE WHEN ivp>1.2 THEN 0.006e0 ELSE 0.002e0 END AS sp FROM q) SELECT trade_no,
floor((greatest(1,CASE WHEN direction='UP' THEN entry_price+greatest(entry_price*(0.003e0+sp),1.5e0+entry_price*sp) ELSE entry_price*(1-0.003e0-sp) END))*1e6+0.5e0)/1e6 AS limit_price,
CASE WHEN is_expiry THEN 0.88e0 WHEN ivp>1.2 THEN 0.9e0 ELSE 0.97e0 END AS fill_prob FROM s""")
def f15(spark, d):
    side = F.when(C("direction") == "UP", "BUY").otherwise("SELL")
    p, f = costs.limit_price(C("entry_price"), side, C("is_expiry"), C("ivp"))
    return fx.rounded(quotes(spark, d).select("trade_no", p.alias("limit_price"), f.alias("fill_prob")))


@register("f16_position_size", f"""{QV}, z AS (SELECT *, 1000000e0*0.75e0/(entry_price*65+1e-9)*CASE WHEN confidence>=0.65 THEN 1 WHEN confidence>=0.6 THEN 0.8e0 WHEN confidence>=0.55 THEN 0.65e0 ELSE 0.5e0 END
*(0.5e0)*CASE WHEN ivp>1.2 THEN 0.7e0 ELSE 1 END*CASE WHEN trade_no%3=1 THEN 0.7e0 ELSE 1 END*CASE WHEN trade_no%10/100e0>0.08e0 THEN 0.5e0 WHEN trade_no%10/100e0>0.04e0 THEN 0.7e0 ELSE 1 END AS raw FROM q)
SELECT trade_no, CAST(least(greatest(1,least(floor(raw),2)),greatest(1,floor(1000000e0*0.01e0/(entry_price*0.1e0*65)))) AS INTEGER) AS contracts FROM z""")
def f16(spark, d):
    n = C("trade_no")
    size = rules.position_size(F.lit(1000000.0), C("entry_price"), F.lit(65), C("confidence"), F.lit(0.5), C("ivp"), n % 3, n % 10 / 100.0)
    return quotes(spark, d).select("trade_no", size.alias("contracts"))


@register("f17_lots_v5", f"""{QV}, z AS (SELECT trade_no, iv, floor(30000e0*0.75e0/(entry_price*65)) AS b FROM q) SELECT trade_no, CAST(greatest(1,least(2,CASE WHEN iv>22 THEN floor(b/2) ELSE b END)) AS INTEGER) AS lots FROM z""")
def f17(spark, d):
    return quotes(spark, d).select("trade_no", rules.lots_v5(F.lit(30000.0), C("entry_price"), C("iv")).alias("lots"))


@register("f18_stop_target", f"""{QV} SELECT trade_no, floor((entry_price*(1-0.1e0*0.875e0*CASE WHEN ivp>1.3 THEN 0.8e0 ELSE 1 END))*1e6+0.5e0)/1e6 AS stop,
floor((greatest(entry_price*1.22e0,entry_price*(1+0.004e0)*1.1e0))*1e6+0.5e0)/1e6 AS target FROM q""")
def f18(spark, d):
    return fx.rounded(quotes(spark, d).select("trade_no", rules.premium_stop(C("entry_price"), F.lit(0.875), C("ivp")).alias("stop"),
                                              rules.premium_target(C("entry_price")).alias("target")))


@register("f19_dynamic_stops", f"""{QV}, a AS (SELECT *, greatest(1,least(atr*0.5e0,entry_price*0.5e0)) AS oa FROM q) SELECT trade_no,
floor((CASE WHEN direction='UP' THEN greatest(0.05e0,entry_price*0.95e0,entry_price-2.5e0*oa) ELSE least(entry_price*1.05e0,entry_price+2.5e0*oa) END)*1e6+0.5e0)/1e6 AS stop,
floor((CASE WHEN direction='UP' THEN entry_price+4*oa ELSE greatest(0.05e0,entry_price-4*oa) END)*1e6+0.5e0)/1e6 AS target FROM a""")
def f19(spark, d):
    return fx.rounded(quotes(spark, d).select("trade_no", rules.dynamic_stops(C("entry_price"), C("atr"), C("direction")).alias("s")).select("trade_no", "s.*"))


@register("f20_trailing_stop", f"""{QV}, l AS (SELECT *, entry_price*(0.8e0+(trade_no%100)/100e0) AS ltp FROM q), g AS (SELECT *, (ltp-entry_price)/(entry_price+1e-9) AS gain FROM l)
SELECT trade_no, floor((CASE WHEN gain>0.6 THEN entry_price*CASE WHEN direction='UP' THEN 1.3e0 ELSE 0.7e0 END WHEN gain>0.4 THEN entry_price ELSE entry_price*0.9e0 END)*1e6+0.5e0)/1e6 AS stop FROM g""")
def f20(spark, d):
    e = C("entry_price")
    return fx.rounded(quotes(spark, d).select("trade_no", rules.trailing_stop(e, e * (0.8 + C("trade_no") % 100 / 100.0), e * 0.9, C("direction")).alias("stop")))


@register("f21_ev_net", f"""{QV} SELECT trade_no, floor((confidence*1.2e0-(1-confidence)-0.015e0*CASE WHEN mod<=30 OR mod>=345 THEN 1.8e0 ELSE 1 END*
CASE WHEN ivp>2.0 THEN 1.8e0 WHEN ivp>1.5 THEN 1.5e0 WHEN ivp>1.2 THEN 1.2e0 ELSE 1 END)*1e6+0.5e0)/1e6 AS ev FROM q""")
def f21(spark, d):
    ev = C("confidence") * 1.2 - (1 - C("confidence"))
    return fx.rounded(quotes(spark, d).select("trade_no", costs.ev_net(ev, F.lit(0.015), C("mod"), C("ivp")).alias("ev")))


@register("f22_confidence_adjusters", f"""{QV}, u AS (SELECT *, -(trade_no%13)/100e0 AS dd FROM q), v AS (SELECT *, abs(dd)/(0.1e0+1e-9) AS used FROM u) SELECT trade_no,
CASE WHEN mod>=315 THEN 1.1e0 WHEN mod>=270 THEN 1.05e0 ELSE 1e0 END AS late, CASE WHEN ivp>1.5 AND trade_no%2=0 THEN 0.1e0 ELSE 0e0 END AS crush,
CASE WHEN confidence>=0.65 THEN 1e0 WHEN confidence>=0.6 THEN 0.8e0 WHEN confidence>=0.55 THEN 0.65e0 ELSE 0.5e0 END AS size,
floor((CASE WHEN dd>=0 THEN 1 WHEN used>=1 THEN 0 WHEN used>=0.7e0 THEN greatest(0.25e0,1-0.75e0*((used-0.7e0)/(1-0.7e0))) ELSE 1 END)*1e6+0.5e0)/1e6 AS ramp,
CASE WHEN bars<15 THEN 0.07e0 ELSE 0e0 END AS boost FROM v""")
def f22(spark, d):
    n = C("trade_no")
    return fx.rounded(quotes(spark, d).select(
        "trade_no", rules.late_day_multiplier(C("mod")).alias("late"), rules.iv_crush_penalty(C("ivp"), F.when(n % 2 == 0, -1).otherwise(1)).alias("crush"),
        rules.conf_size(C("confidence")).alias("size"), rules.drawdown_size(-(n % 13) / 100.0).alias("ramp"), rules.transition_boost(C("bars")).alias("boost")))


@register("f23_horizon_projection", f"""{QV}, h AS (SELECT *, unnest([1,5,15,30]) AS h FROM q), m AS (SELECT *, (confidence-0.5e0)*2*atr*sqrt(h) AS mv, 1+3*exp(-(greatest(mins,1)/375)) AS sh FROM h),
e AS (SELECT *, least(0.9e0,greatest(0.1e0,0.5e0+sh*(spot/strike-1))) AS dc, least(0.9e0,greatest(0.1e0,0.5e0+sh*(1-spot/strike))) AS dp FROM m),
r AS (SELECT trade_no, h, spot+mv AS proj_spot, greatest(1,entry_price+dc*mv-entry_price*0.0004e0*h) AS ce_proj, greatest(1,entry_price-dp*mv-entry_price*0.0004e0*h) AS pe_proj, entry_price, greatest(30,mins-h) AS dte_proj FROM e)
SELECT trade_no, h, {R('proj_spot', 'ce_proj', 'pe_proj')}, floor((ce_proj*0.97e0)*1e6+0.5e0)/1e6 AS ce_net, floor((pe_proj*0.97e0)*1e6+0.5e0)/1e6 AS pe_net, floor(((ce_proj*0.97e0/entry_price-1)*100)*1e6+0.5e0)/1e6 AS ce_pnl_pct,
floor(((pe_proj*0.97e0/entry_price-1)*100)*1e6+0.5e0)/1e6 AS pe_pnl_pct, dte_proj FROM r""")
def f23(spark, d):
    q = quotes(spark, d).withColumn("h", F.explode(F.array(*[F.lit(x) for x in (1, 5, 15, 30)])))
    p = pricing.horizon_projection(C("h"), C("confidence"), C("spot"), C("atr"), C("entry_price"), C("entry_price"), C("strike"), C("mins"))
    return fx.rounded(q.select("trade_no", "h", p.alias("p")).select("trade_no", "h", "p.*"))


@register("f24_binning", """SELECT event_id, CASE WHEN value<=20 THEN -2 WHEN value<=35 THEN -1 WHEN value<=65 THEN 0 WHEN value<=80 THEN 1 ELSE 2 END AS score,
CASE WHEN value>0 AND value<=13 THEN 0 WHEN value>13 AND value<=20 THEN 1 WHEN value>20 AND value<=999 THEN 2 END AS right_bin,
CASE WHEN value>=0 AND value<15 THEN 'LOW' WHEN value>=15 AND value<25 THEN 'MID' WHEN value>=25 AND value<100 THEN 'HIGH' END AS left_bin FROM events""")
def f24(spark, d):
    v = C("value")
    return fx.table(spark, d, "events").select("event_id", bucket_score(v, 20, 35, 65, 80).alias("score"), cut(v, [0, 13, 20, 999], [0, 1, 2]).alias("right_bin"),
                                               cut(v, [0, 15, 25, 100], ["LOW", "MID", "HIGH"], right=False).alias("left_bin"))


@register("f25_labels", f"""{QV} SELECT trade_no, CASE WHEN ivp<0.5 THEN 'IV LOW' WHEN ivp<1 THEN 'IV NORMAL-LOW' WHEN ivp<1.5 THEN 'IV NORMAL-HIGH' ELSE 'IV HIGH (premium)' END AS iv_label,
CASE WHEN confidence-0.65e0>0.35 THEN 'BULLISH' WHEN confidence-0.65e0>0.1 THEN 'MILD BULLISH' WHEN confidence-0.65e0>-0.1 THEN 'NEUTRAL' WHEN confidence-0.65e0>-0.35 THEN 'MILD BEARISH' ELSE 'BEARISH' END AS bias,
CASE WHEN confidence>=0.75 THEN 'STRONG' WHEN confidence>=0.65 THEN 'MODERATE' ELSE 'WEAK' END AS strength FROM q""")
def f25(spark, d):
    return quotes(spark, d).select("trade_no", text.iv_label(C("ivp")).alias("iv_label"), text.bias_label(C("confidence") - 0.65).alias("bias"),
                                   text.strength_label(C("confidence"), 0.75, 0.65).alias("strength"))


@register("f26_dates", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, CAST(isodow(o_orderdate)-1 AS INTEGER) AS wd, CAST(extract(week FROM o_orderdate) AS INTEGER) AS iso_week,
CAST(extract(month FROM o_orderdate) AS INTEGER) AS mon, CAST(o_orderdate AS DATE) AS parsed FROM orders""")
def f26(spark, d):
    t = C("o_orderdate")
    code = F.upper(F.date_format(t, "ddMMMyy"))
    # Two-digit years parse into 2000-2099; orders of the nineties are shifted back.
    parsed = text.parse_day(code)
    parsed = F.when(F.year(parsed) > 2050, F.add_months(parsed, -1200)).otherwise(parsed)
    return fx.table(spark, d, "orders").select("o_orderkey", F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss").alias("iso"), F.weekday(t).alias("wd"), F.weekofyear(t).alias("iso_week"),
                                               F.month(t).alias("mon"), parsed.alias("parsed"))


SYM = "'IDX'||upper(strftime(ts, '%d%b%y'))||CAST(CAST(round_even(value/50,0)*50+20000 AS INTEGER) AS VARCHAR)||CASE WHEN value>50 THEN 'CE' ELSE 'PE' END"


def symbols(spark, d):
    e = fx.table(spark, d, "events")
    s = text.option_symbol(F.to_date("ts"), pricing.atm_strike(C("value")) + 20000, F.when(C("value") > 50, "CE").otherwise("PE"))
    return e.select("event_id", "ts", s.alias("symbol"))


@register("f27_option_symbol", f"SELECT event_id, {SYM} AS symbol, substr({SYM}, 4, 7) AS date_part FROM events")
def f27(spark, d):
    return symbols(spark, d).select("event_id", "symbol", F.substring("symbol", 4, 7).alias("date_part"))


@register("f28_parse_symbol", "SELECT event_id, CAST(ts AS DATE) AS expiry, CAST(round_even(value/50,0)*50+20000 AS INTEGER) AS strike, CASE WHEN value>50 THEN 'CE' ELSE 'PE' END AS option_type FROM events")
def f28(spark, d):
    return symbols(spark, d).select("event_id", text.parse_option_symbol(C("symbol")).alias("p")).select("event_id", "p.*")


@register("j08_token_lookup", f"WITH m AS (SELECT DISTINCT {SYM} AS symbol FROM events), t AS (SELECT symbol, md5(symbol) AS token FROM m) SELECT event_id, token FROM (SELECT event_id, {SYM} AS symbol FROM events) q JOIN t USING (symbol)")
def j08(spark, d):
    s = symbols(spark, d)
    master = s.select("symbol").distinct().withColumn("token", F.md5("symbol"))
    return s.join(master, "symbol").select("event_id", "token")


@register("f29_json", """SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, '{"event_id":'||event_id||',"event_type":"'||event_type||'"}' AS line FROM events""")
def f29(spark, d):
    return fx.table(spark, d, "events").select("event_id", F.from_json("props", "k INT")["k"].alias("k"), F.to_json(F.struct("event_id", "event_type")).alias("line"))


@register("f30_arrays", """WITH a AS (SELECT user_id, list(value ORDER BY event_id) AS v FROM events GROUP BY 1) SELECT user_id, floor((v[-1])*1e6+0.5e0)/1e6 AS last, len(list_filter(v, lambda x: x>90))>0 AS any_high,
len(list_filter(v, lambda x: x<=0))=0 AS all_pos, floor((CASE WHEN len(v)>=3 THEN v[-1]*0.5e0+v[-2]*0.3e0+v[-3]*0.2e0 END)*1e6+0.5e0)/1e6 AS dot FROM a""")
def f30(spark, d):
    from barflow.operators.recent import last_values
    a = last_values(fx.table(spark, d, "events"), "user_id", "event_id", "value", 3)
    w = F.array(F.lit(0.2), F.lit(0.3), F.lit(0.5))
    dot = F.aggregate(F.zip_with("recent", w, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    return fx.rounded(a.select("user_id", F.element_at("recent", -1).alias("last"), C("any_high"), C("all_pos"), F.when(F.size("recent") == 3, dot).alias("dot")))


@register("f31_maps", V("scored") + """ SELECT symbol, dt, floor((max(proba) FILTER (h=15))*1e6+0.5e0)/1e6 AS p15, floor((max(proba) FILTER (h=30))*1e6+0.5e0)/1e6 AS p30, CAST(count(*) AS INTEGER) AS n FROM scored GROUP BY 1,2""")
def f31(spark, d):
    m = fx.scored(spark, d).groupBy("symbol", "dt").agg(F.map_from_entries(F.collect_list(F.struct("h", "proba"))).alias("signals"))
    return fx.rounded(m.select("symbol", "dt", C("signals")[15].alias("p15"), C("signals")[30].alias("p30"), F.size("signals").alias("n")))


@register("f33_divergence", V("bars") + """, r AS (SELECT symbol, dt, (close/open-1)*100 AS ret FROM bars) SELECT a.dt, floor((b.ret-a.ret)*1e6+0.5e0)/1e6 AS spread,
sign(a.ret)*sign(b.ret)<0 AND abs(b.ret-a.ret)>0.1e0 AS diverges FROM r a JOIN r b USING (dt) WHERE a.symbol='click' AND b.symbol='view'""")
def f33(spark, d):
    from barflow.plans.regimes import divergence
    return fx.rounded(divergence(fx.bars(spark, d), "click", "view"), "dt", "spread", "diverges")
