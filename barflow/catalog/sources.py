"""Source, sink and streaming queries: tables are written as the files a source reads, then read back."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from barflow.catalog import fixtures as fx
from barflow.catalog.joins import ORACLES as JOIN_ORACLES
from barflow.catalog.market import HYST, regime_bars
from barflow.catalog.quality import DIRTY, MAX_STEP_PCT, MAX_STEP_SECONDS, VALIDATED, dirty
from barflow.catalog.trading import LV, REPEATS, events, signals
from barflow.operators.stage import shared_folder
from barflow.plans import ledger as lg
from barflow.sources import readers as rd
from barflow.sources import sinks
from barflow.streaming import streams as st

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


def folder(spark):
    return f"{shared_folder(spark).rstrip('/')}/barflow-files-{uuid.uuid4().hex}"


@register("s01_read_bars", f"""{V('bars')}, {DIRTY} SELECT symbol, dt + INTERVAL 330 MINUTE AS dt, {R('open', 'high', 'low', 'close', 'volume')} FROM dirty
WHERE open IS NOT NULL AND NOT (high<open OR high<close OR low>open OR low>close OR high<low OR high<=0 OR low<=0)""")
def s01(spark, d):
    path = folder(spark)
    b = dirty(spark, d)
    text = F.concat(F.date_format("dt", "yyyy-MM-dd HH:mm:ss"), F.lit("+00:00"))
    b.select("symbol", text.alias("datetime"), "open", "high", "low", "close", "volume").write.option("header", True).csv(path)
    return fx.rounded(rd.read_bars(spark, path), "symbol", "dt", "open", "high", "low", "close", "volume")


@register("s04_read_option_chain", f"{V('chain')} SELECT trade_date, CAST(strike AS DOUBLE) AS strike, option_type, {R('open_int', 'chg_oi', 'close')}, CAST(contracts AS DOUBLE) AS contracts FROM chain")
def s04(spark, d):
    path = folder(spark)
    c = fx.chain(spark, d)
    (c.select(F.date_format("trade_date", "yyyy-MM-dd").alias("day"), "strike", "option_type", "open_int", "chg_oi", "contracts", "close")
     .write.option("header", True).partitionBy("day").csv(path))
    return fx.rounded(rd.read_option_chain(spark, path), "trade_date", "strike", "option_type", "open_int", "chg_oi", "close", "contracts")


@register("s05_read_daily_series", f"{V('daily')} SELECT date, {R('vix_close', 'close', places=9)} FROM daily")
def s05(spark, d):
    path = folder(spark)
    day = fx.daily(spark, d).select("date", "vix_close", "close")
    # A later file repeats every date with other values; the first file's rows must win.
    day.write.option("header", True).csv(f"{path}/1")
    day.withColumn("vix_close", C("vix_close") * 0).write.option("header", True).csv(f"{path}/2")
    return fx.rounded(rd.read_daily_series(spark, f"{path}/*", ["vix_close", "close"]), places=9)


@register("s06_read_trade_events", f"{V('trades')} SELECT trade_no AS session_trade_number, direction, {R('entry_price')}, contracts, CAST(date_trunc('month', entry_ts) AS DATE) AS file_date FROM trades")
def s06(spark, d):
    path = folder(spark)
    t = fx.trades(spark, d)
    line = F.to_json(F.struct(F.lit("ENTRY").alias("event"), C("trade_no").alias("session_trade_number"), "direction", "entry_price", "contracts"))
    day = F.date_format(F.date_trunc("month", "entry_ts"), "yyyy-MM-dd").alias("day")
    # Every seventh trade is followed by a broken line and a blank one, as interrupted writers leave them.
    good = t.select(day, line.alias("value"))
    bad = t.where("trade_no % 7 = 0").select(day, F.explode(F.array(F.lit('{"event": "ENTRY", "session_tra'), F.lit(""))).alias("value"))
    good.unionByName(bad).repartition("day").write.partitionBy("day").text(path)
    return fx.rounded(rd.read_trade_events(spark, path), "session_trade_number", "direction", "entry_price", "contracts", "file_date")


QUERIES["s07_multi_file_union"], ORACLES["s07_multi_file_union"] = QUERIES["s06_read_trade_events"], ORACLES["s06_read_trade_events"]


@register("s08_read_instruments", "SELECT 'P'||p_partkey AS symbol, CAST(p_partkey AS VARCHAR) AS token, 'NFO' AS exch_seg, p_type AS name FROM part WHERE p_type='ECONOMY' AND p_partkey%2=0")
def s08(spark, d):
    path = folder(spark)
    p = fx.table(spark, d, "part")
    seg = F.when(C("p_partkey") % 2 == 0, "NFO").otherwise("NSE")
    rows = p.select(F.concat(F.lit("P"), C("p_partkey")).alias("symbol"), C("p_partkey").cast("string").alias("token"), seg.alias("exch_seg"), C("p_type").alias("name"))
    # Arrays of 1,024 consecutive parts, so that their number grows with the table and their size does not.
    group = F.floor(C("token").cast("bigint") / 1024).alias("f")
    arrays = rows.groupBy(group).agg(F.to_json(F.collect_list(F.struct("symbol", "token", "exch_seg", "name"))).alias("value"))
    arrays.select("value").write.option("maxRecordsPerFile", 1).text(path)
    return rd.read_instruments(spark, path, "NFO", "ECONOMY").select("symbol", "token", "exch_seg", "name")


@register("s10_write_trades", f"{LV} SELECT trade_no, net_p, exit_reason, file_date FROM ledger WHERE is_closed")
def s10(spark, d):
    path = folder(spark)
    # Pairs are dealt by month while they are narrow (a large month is split), and only then charged.
    pairs = lg.pair_entry_exit(events(spark, d)).where("exit_price is not null").withColumn("file_month", F.date_format("file_date", "yyyy-MM"))
    sinks.write_trades(lg.trade_ledger(pairs.hint("rebalance", "file_month")), path, by="file_month")
    return spark.read.parquet(path).select("trade_no", "net_p", "exit_reason", "file_date")


@register("s11_write_trade_events", f"{V('trades')} SELECT trade_no, direction, {R('entry_price')} FROM trades")
def s11(spark, d):
    path = folder(spark)
    sinks.write_trade_events(fx.trades(spark, d), path, compression="gzip")
    return fx.rounded(spark.read.schema("trade_no BIGINT, direction STRING, entry_price DOUBLE").json(path))


@register("s15_tick_price", "SELECT event_id AS seq, floor((CASE WHEN event_id%2=0 THEN value ELSE value+1 END/100)*1e6+0.5e0)/1e6 AS price FROM events")
def s15(spark, d):
    e = fx.table(spark, d, "events")
    odd = C("event_id") % 2 != 0
    out = e.select(C("event_id").alias("seq"), F.when(~odd, C("value")).alias("last_traded_price"), (C("value") + 1).alias("ltp"))
    return fx.rounded(out.select("seq", rd.tick_price().alias("price")))


# --- streams: the events table as a file stream ---------------------------------------------------------------------
def tick_stream(spark, d):
    schema = fx.table(spark, d, "events").schema
    e = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return e.select(C("event_type").alias("symbol"), C("ts").cast("timestamp").alias("ts"), C("event_id").alias("seq"), C("value").alias("price"))


def in_time(rows, columns, by="dt"):
    """Rows as they arrive: their time as a zoned timestamp."""
    return rows.withColumn(by, C(by).cast("timestamp")).select(*columns), by


CLOSED = "dt + INTERVAL 1 HOUR <= (SELECT max(ts) FROM ticks) - INTERVAL 10 MINUTE"


@register("r02_stream_bars", f"{V('bars')} SELECT symbol, dt, {R('open', 'high', 'low', 'close', 'volume')} FROM bars WHERE {CLOSED}")
def r02(spark, d):
    out = st.run_available(st.stream_bars(tick_stream(spark, d), "1 hour", "10 minutes"))
    return fx.rounded(out.withColumn("dt", C("dt").cast("timestamp_ntz")), "symbol", "dt", "open", "high", "low", "close", "volume")


@register("r03_stream_order_flow", V("ticks") + """, d AS (SELECT symbol, ts, sign(price-lag(price) OVER (PARTITION BY symbol ORDER BY ts, seq)) AS s FROM ticks)
SELECT symbol, date_trunc('hour', ts) AS dt, count(*) FILTER (s>0) AS up_ticks, count(*) FILTER (s<0) AS down_ticks FROM d GROUP BY 1,2""")
def r03(spark, d):
    st.configure(spark)
    t = st.run_in_slices([in_time(fx.ticks(spark, d), ["symbol", "ts", "seq", "price"], "ts")], st.tick_directions)
    agg = t.groupBy("symbol", F.window(C("ts").cast("timestamp_ntz"), "1 hour").alias("_w")).agg(
        F.count(F.when(C("direction") > 0, 1)).alias("up_ticks"), F.count(F.when(C("direction") < 0, 1)).alias("down_ticks"))
    return agg.select("symbol", C("_w.start").alias("dt"), "up_ticks", "down_ticks")


@register("r04_stream_tick_stats", f"{V('ticks')}, s AS (SELECT symbol, seq, CAST(count(*) OVER w AS BIGINT) AS n, max(price) OVER w AS high, min(price) OVER w AS low FROM ticks WINDOW w AS (PARTITION BY symbol ORDER BY ts, seq ROWS 99 PRECEDING)) SELECT symbol, seq, n, {R('high', 'low')} FROM s")
def r04(spark, d):
    st.configure(spark)
    t = in_time(fx.ticks(spark, d), ["symbol", "ts", "seq", "price"], "ts")
    return fx.rounded(st.run_in_slices([t], st.recent_ticks), "symbol", "seq", "n", "high", "low")


@register("r06_stream_validation", VALIDATED)
def r06(spark, d):
    st.configure(spark)
    s = in_time(dirty(spark, d), ["symbol", "dt", "open", "high", "low", "close", "volume"])
    out = st.run_in_slices([s], lambda x: st.validated_bars(x, max_gap_seconds=MAX_STEP_SECONDS, max_gap_pct=MAX_STEP_PCT))
    return out.select("symbol", C("dt").cast("timestamp_ntz").alias("dt"), "bar_valid", F.array_join("errors", ",").alias("errors"), "bad_in_row", "halt")


def r09(spark, d):
    """The batch rule of ad4 as a stream: both must keep the same signals."""
    st.configure(spark)
    s = in_time(signals(spark, d), ["seq", "hash", "ts"], "ts")
    return st.run_in_slices([s], lambda x: st.marked_repeats(x, 600)).select("seq", "hash", "kept")


QUERIES["r09_stream_duplicates"], ORACLES["r09_stream_duplicates"] = r09, REPEATS


@register("r13_stream_hysteresis", f"{HYST} SELECT symbol, dt, cur AS confirmed_regime, since AS bars_since_flip FROM h")
def r13(spark, d):
    st.configure(spark)
    out = st.run_in_slices([in_time(regime_bars(spark, d), ["symbol", "dt", "regime"])], st.confirmed_regimes)
    return out.select("symbol", C("dt").cast("timestamp_ntz").alias("dt"), "confirmed_regime", "bars_since_flip")


@register("r14_stream_static", f"{V('bars', 'bars_1d')}, x AS (SELECT symbol, trade_date, close AS d_close FROM bars_1d) SELECT symbol, dt, floor((d_close)*1e6+0.5e0)/1e6 AS d_close FROM bars LEFT JOIN x USING (symbol, trade_date)")
def r14(spark, d):
    table = fx.bars_1d(spark, d).select("symbol", "trade_date", C("close").alias("d_close"))
    out = st.run_in_slices([in_time(fx.bars(spark, d), ["symbol", "dt", "trade_date"])], lambda x: st.with_static(x, table, ["symbol", "trade_date"]))
    return fx.rounded(out.withColumn("dt", C("dt").cast("timestamp_ntz")), "symbol", "dt", "d_close")


@register("r15_stream_htf", f"{V('bars', 'bars_1d')}, e AS (SELECT symbol, dt + INTERVAL 1 DAY AS ready, close FROM bars_1d) SELECT b.symbol, b.dt, floor((e.close)*1e6+0.5e0)/1e6 AS d_close FROM bars b ASOF LEFT JOIN e ON b.symbol=e.symbol AND b.dt >= e.ready")
def r15(spark, d):
    st.configure(spark)
    a = in_time(fx.bars(spark, d), ["symbol", "dt"])
    day = fx.bars_1d(spark, d).select("symbol", C("dt").alias("htf_dt"), C("close").alias("d_close"), (C("dt") + F.expr("INTERVAL 1 DAY")).alias("ready"))
    b = in_time(day.withColumn("htf_dt", C("htf_dt").cast("timestamp")), ["symbol", "htf_dt", "d_close", "ready"], "ready")
    out = st.run_in_slices([a, b], lambda x, y: st.with_higher_timeframe(x, y, "1 DAY", "d_close"))
    return fx.rounded(out.withColumn("dt", C("dt").cast("timestamp_ntz")), "symbol", "dt", "d_close")


@register("r07_silence_gaps", V("ticks") + """, g AS (SELECT symbol, ts, lead(ts) OVER (PARTITION BY symbol ORDER BY ts, seq) AS nx FROM ticks), m AS (SELECT *, epoch(nx)-epoch(ts) AS gap, extract(hour FROM ts) AS h FROM g)
SELECT symbol, ts, floor((gap)*1e3+0.5e0)/1e3 AS silent_seconds FROM m WHERE gap > CASE WHEN h<6 THEN 7200 WHEN h<12 THEN 5400 ELSE 3600 END""")
def r07(spark, d):
    from barflow.operators.chunks import chunked
    from barflow.plans.flow import _window
    nxt = F.lead("ts").over(_window())
    t = chunked(fx.ticks(spark, d), lambda x: x.withColumn("nx", nxt), 1, order="ts", bucket="hour", forward=True)
    gap = (F.unix_micros(C("nx").cast("timestamp")) - F.unix_micros(C("ts").cast("timestamp"))) / 1e6
    h = F.hour("ts")
    limit = F.when(h < 6, 7200).when(h < 12, 5400).otherwise(3600)
    return t.withColumn("g", gap).where(C("g") > limit).select("symbol", "ts", fx.tidy(C("g"), 3).alias("silent_seconds"))



SILENCE = """g AS (SELECT symbol, ts, seq, lead(ts) OVER (PARTITION BY symbol ORDER BY ts, seq) AS nx FROM ticks), m AS (SELECT *, epoch(nx)-epoch(ts) AS gap, CASE WHEN extract(hour FROM ts)<6 THEN 7200 WHEN extract(hour FROM ts)<12 THEN 5400 ELSE 3600 END AS lim FROM g)"""


@register("r07_stream_silence", f"""{V('ticks')}, {SILENCE} SELECT symbol, ts, floor((gap)*1e3+0.5e0)/1e3 AS silent_seconds FROM m WHERE gap > lim
UNION ALL SELECT symbol, ts, NULL FROM m WHERE nx IS NULL AND epoch(ts) + lim < (SELECT epoch(max(ts)) FROM ticks) - 10""")
def r07_stream(spark, d):
    """Silences by event-time timers: those that ended as r07_silence_gaps finds them, and those still open at the end of the stream."""
    st.configure(spark)
    h = F.hour("ts")
    limit = F.when(h < 6, 7200).when(h < 12, 5400).otherwise(3600)
    t = in_time(fx.ticks(spark, d), ["symbol", "ts", "seq"], "ts")
    # A slice costs two micro-batches however small it is; here it may be larger, since few of its ticks go to a symbol's state.
    out = st.run_in_slices([t], lambda x: st.silent_symbols(x, limit, "10 seconds", 3600), 4 * st.SLICE_ROWS).withColumn("ts", C("ts").cast("timestamp_ntz"))
    ended = out.where("silent_seconds is not null")
    alarms = out.where("silent_seconds is null").join(ended.select("symbol", "ts"), ["symbol", "ts"], "left_anti")
    return ended.unionByName(alarms).select("symbol", "ts", fx.tidy(C("silent_seconds"), 3).alias("silent_seconds"))


@register("r08_stream_latency", f"""{V('ticks')}, l AS (SELECT symbol, ts, seq, CAST((seq*37)%2500 AS DOUBLE) AS lag_ms FROM ticks), m AS (SELECT *, median(lag_ms) OVER (PARTITION BY symbol ORDER BY ts, seq ROWS 9 PRECEDING) AS med FROM l)
SELECT symbol, seq, floor((med)*1e6+0.5e0)/1e6 AS median_lag_ms, CASE WHEN lag_ms>2000 THEN 'CRITICAL' WHEN lag_ms>500 THEN 'HIGH' ELSE 'OK' END AS level, med<2000 AS acceptable FROM m""")
def r08(spark, d):
    st.configure(spark)
    t = in_time(fx.ticks(spark, d).withColumn("lag_ms", ((C("seq") * 37) % 2500).cast("double")), ["symbol", "ts", "seq", "lag_ms"], "ts")
    return fx.rounded(st.run_in_slices([t], st.latencies), "symbol", "seq", "median_lag_ms", "level", "acceptable")


@register("r12_stream_session_state", f"""{V('bars')}, w AS (SELECT *, row_number() OVER s AS bar_no, first_value(open) OVER s AS day_open, max(high) OVER s AS high_so_far, min(low) OVER s AS low_so_far FROM bars
 WINDOW s AS (PARTITION BY symbol, trade_date ORDER BY dt ROWS UNBOUNDED PRECEDING)), n AS (SELECT *, CASE WHEN bar_no=1 OR high_so_far>lag(high_so_far) OVER (PARTITION BY symbol, trade_date ORDER BY dt) THEN bar_no END AS top FROM w)
SELECT symbol, dt, bar_no, {R('day_open', 'high_so_far', 'low_so_far')}, bar_no - max(top) OVER (PARTITION BY symbol, trade_date ORDER BY dt ROWS UNBOUNDED PRECEDING) AS since_high FROM n""")
def r12(spark, d):
    st.configure(spark)
    out = st.run_in_slices([in_time(fx.bars(spark, d), ["symbol", "dt", "trade_date", "open", "high", "low"])], st.session_values, trigger={"once": True})
    return fx.rounded(out.withColumn("dt", C("dt").cast("timestamp_ntz")), "symbol", "dt", "bar_no", "day_open", "high_so_far", "low_so_far", "since_high")


@register("r05_stream_upsert", JOIN_ORACLES["u02_upsert"])
def r05(spark, d):
    """Bars, then corrections of some of them, arrive as a stream; the second micro-batch is delivered twice."""
    path = folder(spark)
    b = fx.bars(spark, d).select("symbol", "dt", "trade_date", "close", "volume")
    fresh = b.where("volume > 4").withColumn("close", C("close") * 1.01)
    arriving = b.withColumn("at", F.lit(0)).unionByName(fresh.withColumn("at", F.lit(1)))
    apply = st.upsert_into(path)

    def twice(batch, number):
        apply(batch.drop("at"), number)
        if number:
            apply(batch.drop("at"), number)
    st.run_in_slices([(arriving, "at")], lambda x: x, each=twice)
    return fx.rounded(st.read_upserted(spark, path), "symbol", "dt", "close", "volume")


@register("r17_stream_late_rows", """WITH a AS (SELECT event_type AS symbol, event_id AS seq, ts, (event_id + CASE WHEN event_id%13=0 THEN 40 ELSE 0 END)*2 + CASE WHEN event_id%13=0 THEN 1 ELSE 0 END AS arrival FROM events),
m AS (SELECT *, max(ts) OVER (ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest FROM a) SELECT symbol, seq, ts, coalesce(ts < newest - INTERVAL 1 HOUR, false) AS late FROM m""")
def r17(spark, d):
    """Every thirteenth tick arrives forty ticks late; rows that are over an hour behind go to the side table."""
    path = folder(spark)
    slow = C("seq") % 13 == 0
    arrival = (C("seq") + F.when(slow, 40).otherwise(0)) * 2 + F.when(slow, 1).otherwise(0)
    t = fx.ticks(spark, d).select("symbol", "seq", C("ts").cast("timestamp").alias("ts"), arrival.alias("arrival"))
    st.run_in_slices([(t, "arrival")], lambda x: x, each=st.split_late(path, 3600, order="arrival"))
    return spark.read.parquet(f"{path}/rows").select("symbol", "seq", C("ts").cast("timestamp_ntz").alias("ts"), C("late").cast("boolean").alias("late"))
