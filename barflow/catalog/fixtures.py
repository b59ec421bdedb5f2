"""The given tables seen as market data: ticks, bars, trades, option chain, daily series, scored bars.

Each view exists twice: as a DataFrame for ``queries()`` and as a SQL text (a list of CTEs) for ``oracle_sql()``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barflow.plans.bars import ohlcv_bars, session_clock

C = F.col
DAY_BARS = 24  # bars per session in the hourly fixtures


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ticks(spark, d):
    return table(spark, d, "events").select(C("event_type").alias("symbol"), C("event_id").alias("seq"), "ts",
                                            C("value").alias("price"))


def bars(spark, d):
    return session_clock(ohlcv_bars(ticks(spark, d)))


def bars_1d(spark, d):
    return session_clock(ohlcv_bars(ticks(spark, d), "1 day"))


def legs(spark, d):
    # Dealt by order, which the groups and the join with the orders both accept: line items move once.
    return (table(spark, d, "lineitem").repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber")
            .agg(F.max("l_quantity").alias("q"), F.max("l_extendedprice").alias("px"), F.max("l_discount").alias("disc"),
                 F.max("l_tax").alias("tax"), F.max("l_shipdate").alias("ship"), F.max("l_returnflag").alias("rf"),
                 F.max("l_linestatus").alias("ls")))


def trades(spark, d):
    open_leg = C("rf") == "N"
    price = C("px") / C("q") / 10
    return (legs(spark, d).join(table(spark, d, "orders"), C("l_orderkey") == C("o_orderkey"))
            .select((C("o_orderkey") * 10 + C("l_linenumber")).alias("trade_no"), C("o_orderdate").alias("entry_ts"),
                    F.when(~open_leg, C("ship")).alias("exit_ts"),
                    F.when(C("ls") == "O", "UP").otherwise("DOWN").alias("direction"),
                    F.when(C("ls") == "O", "CE").otherwise("PE").alias("option_type"),
                    price.alias("entry_price"),
                    F.when(~open_leg, price * (1 + 3 * (C("disc") - C("tax")))).alias("exit_price"),
                    (1 + C("l_linenumber") % 2).cast("int").alias("contracts"),
                    F.when(C("rf") == "A", "TARGET").when(C("rf") == "R", "STOP_LOSS").otherwise("OPEN").alias("exit_reason"),
                    (0.5 + 3 * C("disc")).alias("confidence"), C("o_orderpriority").alias("regime")))


def trade_events(spark, d):
    """ENTRY and EXIT rows in one log, as a trade logger writes them."""
    t = trades(spark, d)
    entry = t.select(F.lit("ENTRY").alias("event"), F.to_date("entry_ts").alias("file_date"), "trade_no",
                     C("entry_ts").alias("ts"), "direction", "option_type", C("entry_price").alias("price"), "contracts",
                     F.lit(None).cast("string").alias("exit_reason"), "confidence", "regime")
    close = t.where("exit_ts is not null").select(
        F.lit("EXIT").alias("event"), F.to_date("entry_ts").alias("file_date"), "trade_no", C("exit_ts").alias("ts"),
        "direction", "option_type", C("exit_price").alias("price"), "contracts", "exit_reason", "confidence", "regime")
    return entry.unionByName(close)


def chain(spark, d):
    month = F.to_date(F.date_trunc("month", "l_shipdate"))
    base = (table(spark, d, "lineitem").join(table(spark, d, "part"), C("l_partkey") == C("p_partkey"))
            .groupBy(month.alias("trade_date"), (50 * C("p_size")).alias("strike"),
                     F.when(C("l_linestatus") == "O", "CE").otherwise("PE").alias("option_type"))
            .agg(F.sum("l_quantity").alias("open_int"), F.count(F.lit(1)).alias("contracts"),
                 (F.avg(C("l_extendedprice") / C("l_quantity")) / 10).alias("close")))
    prev = F.lag("open_int").over(Window.partitionBy("strike", "option_type").orderBy("trade_date"))
    return base.withColumn("chg_oi", C("open_int") - F.coalesce(prev, F.lit(0.0)))


def daily(spark, d):
    p = C("o_totalprice")
    return (table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("date"))
            .agg((F.avg(p) / 15000).alias("vix_close"),
                 (F.sum(F.when(C("o_orderstatus") == "F", p).otherwise(-p)) / 100).alias("fii_net_buy"),
                 (F.sum(F.when(C("o_orderstatus") == "O", p).otherwise(-p)) / 100).alias("dii_net_buy"),
                 F.max(p).alias("close")))


def scored(spark, d):
    h = F.explode(F.array(*[F.lit(x) for x in (1, 5, 15, 30)]))
    key = (C("volume") * 37 + F.hour("dt") * 13 + C("h") * 7) % 41
    return bars(spark, d).withColumn("h", h).withColumn("proba", key.cast("double") / 40)


SQL = {
    "ticks": "ticks AS (SELECT event_type AS symbol, event_id AS seq, ts, value AS price FROM events)",
    "bars": """bars AS (SELECT *, CAST(dt AS DATE) AS trade_date, CAST(extract(hour FROM dt)*60 AS INTEGER) AS minute_of_day,
        extract(hour FROM dt)*60/375e0 AS session_pct, CAST(isodow(dt)-1 AS DOUBLE) AS dow,
        CASE WHEN isodow(dt)=2 THEN 1 ELSE 0 END AS is_expiry,
        CASE WHEN extract(hour FROM dt)*60 < 30 THEN 1 ELSE 0 END AS session_open,
        CASE WHEN extract(hour FROM dt)*60 > 270 THEN 1 ELSE 0 END AS session_pm
      FROM (SELECT symbol, date_trunc('hour', ts) AS dt, first(price ORDER BY ts, seq) AS open, max(price) AS high,
        min(price) AS low, last(price ORDER BY ts, seq) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1,2))""",
    "bars_1d": """bars_1d AS (SELECT *, CAST(dt AS DATE) AS trade_date
      FROM (SELECT symbol, CAST(date_trunc('day', ts) AS TIMESTAMP) AS dt, first(price ORDER BY ts, seq) AS open, max(price) AS high,
        min(price) AS low, last(price ORDER BY ts, seq) AS close, CAST(count(*) AS DOUBLE) AS volume FROM ticks GROUP BY 1,2))""",
    "legs": """legs AS (SELECT l_orderkey, l_linenumber, max(l_quantity) AS q, max(l_extendedprice) AS px, max(l_discount) AS disc,
        max(l_tax) AS tax, max(l_shipdate) AS ship, max(l_returnflag) AS rf, max(l_linestatus) AS ls FROM lineitem GROUP BY 1,2)""",
    "trades": """trades AS (SELECT o_orderkey*10 + l_linenumber AS trade_no, o_orderdate AS entry_ts,
        CASE WHEN rf='N' THEN NULL ELSE ship END AS exit_ts, CASE WHEN ls='O' THEN 'UP' ELSE 'DOWN' END AS direction,
        CASE WHEN ls='O' THEN 'CE' ELSE 'PE' END AS option_type, px/q/10 AS entry_price,
        CASE WHEN rf='N' THEN NULL ELSE px/q/10*(1 + 3*(disc-tax)) END AS exit_price, CAST(1 + l_linenumber % 2 AS INTEGER) AS contracts,
        CASE rf WHEN 'A' THEN 'TARGET' WHEN 'R' THEN 'STOP_LOSS' ELSE 'OPEN' END AS exit_reason, 0.5 + 3*disc AS confidence,
        o_orderpriority AS regime FROM legs JOIN orders ON l_orderkey = o_orderkey)""",
    "chain": """chain0 AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS trade_date, 50*p_size AS strike,
        CASE WHEN l_linestatus='O' THEN 'CE' ELSE 'PE' END AS option_type, sum(l_quantity) AS open_int, count(*) AS contracts,
        avg(l_extendedprice/l_quantity)/10 AS close FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1,2,3),
      chain AS (SELECT *, open_int - coalesce(lag(open_int) OVER (PARTITION BY strike, option_type ORDER BY trade_date), 0) AS chg_oi FROM chain0)""",
    "daily": """daily AS (SELECT CAST(o_orderdate AS DATE) AS date, avg(o_totalprice)/15000 AS vix_close,
        sum(CASE WHEN o_orderstatus='F' THEN o_totalprice ELSE -o_totalprice END)/100 AS fii_net_buy,
        sum(CASE WHEN o_orderstatus='O' THEN o_totalprice ELSE -o_totalprice END)/100 AS dii_net_buy,
        max(o_totalprice) AS close FROM orders GROUP BY 1)""",
    "scored": """scored AS (SELECT bars.*, h, CAST((volume*37 + extract(hour FROM dt)*13 + h*7) % 41 AS DOUBLE)/40 AS proba
        FROM bars CROSS JOIN (VALUES (1),(5),(15),(30)) AS t(h))""",
}
NEEDS = {"bars": ("ticks",), "bars_1d": ("ticks",), "trades": ("legs",), "scored": ("ticks", "bars")}


def with_views(*names: str) -> str:
    """``WITH`` prefix holding the named views and what they need."""
    order: list[str] = []
    for n in names:
        for x in (*NEEDS.get(n, ()), n):
            if x not in order:
                order.append(x)
    return "WITH " + ",\n".join(SQL[x] for x in order)


def tidy(x, places: int = 6):
    """Round half up in plain double arithmetic, which every engine carries out alike (``round`` differs on ties)."""
    scale = float(10 ** places)
    return F.floor(x * scale + 0.5) / scale


def sql_round(*columns: str, places: int = 6) -> str:
    """The same rounding as SQL text, ``... AS x`` for each column."""
    return ", ".join(f"floor(({c})*1e{places}+0.5e0)/1e{places} AS {c}" for c in columns)


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    """Keep the named columns, rounding the double ones once, at the end."""
    kinds = dict(df.dtypes)
    pick = columns or df.columns
    return df.select(*[tidy(C(c), places).alias(c) if kinds[c] == "double" else C(c) for c in pick])


def obars(spark, d):
    """Daily bars over several years, one symbol per order priority."""
    p = C("o_totalprice") / 100
    key = C("o_orderkey")
    return (table(spark, d, "orders")
            .groupBy(C("o_orderpriority").alias("symbol"), F.window("o_orderdate", "1 day").alias("_w"))
            .agg(F.min_by(p, key).alias("open"), F.max(p).alias("high"), F.min(p).alias("low"), F.max_by(p, key).alias("close"),
                 F.count(F.lit(1)).cast("double").alias("volume"))
            .select("symbol", C("_w.start").alias("dt"), "open", "high", "low", "close", "volume",
                    F.to_date("_w.start").alias("trade_date"), F.lit(0).alias("minute_of_day")))


SQL["obars"] = """obars AS (SELECT *, CAST(dt AS DATE) AS trade_date, 0 AS minute_of_day FROM (SELECT o_orderpriority AS symbol,
      CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS dt, first(o_totalprice/100 ORDER BY o_orderkey) AS open, max(o_totalprice/100) AS high,
      min(o_totalprice/100) AS low, last(o_totalprice/100 ORDER BY o_orderkey) AS close, CAST(count(*) AS DOUBLE) AS volume
      FROM orders GROUP BY 1,2))"""
