"""Trade ledger: pairing of events, charges, P&L, and the reports over it.

Money is carried in whole hundredths (``*_p`` columns, integers): sums are exact, so reports add up to the last digit
whatever the order in which tasks finish.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow import constants as k
from barflow.functions import text
from barflow.functions.costs import paise, round_trip_charges, rupees
from barflow.operators.scans import drawdown, running

C = F.col


def pair_entry_exit(events: DataFrame, seq: str = "seq") -> DataFrame:
    """Match each ENTRY with the EXIT that follows it under the same session and trade number.

    A later ENTRY replaces an unmatched earlier one, an EXIT without an ENTRY is dropped, an ENTRY nothing follows stays
    open.  One window per (session, trade number), no join: the next event of the key decides.  Its fields are looked up one by one, so that
    those nobody reads are not carried through the shuffle.
    """
    w = Window.partitionBy("file_date", "trade_no").orderBy(seq)
    none = ""  # stands for the next event where there is none
    nxt = events.withColumns({"_event": F.lead("event", 1, none).over(w), **{f"_{c}": F.lead(c).over(w) for c in ("ts", "price", "exit_reason")}})
    entry = nxt.where((C("event") == "ENTRY") & C("_event").isin(none, "EXIT"))
    return entry.select("file_date", "trade_no", C("ts").alias("entry_ts"), "direction", "option_type", C("price").alias("entry_price"),
                        "contracts", "confidence", "regime", C("_ts").alias("exit_ts"), C("_price").alias("exit_price"),
                        F.when(C("_event") == none, "OPEN").otherwise(F.coalesce(C("_exit_reason"), F.lit("UNKNOWN"))).alias("exit_reason"))


def trade_ledger(pairs: DataFrame, lot: int | Column = k.LOT_NEW, is_expiry: Column | None = None) -> DataFrame:
    """Quantity, points, gross, charges and net (hundredths), hold minutes; open trades keep NULLs."""
    lot = lot if isinstance(lot, Column) else F.lit(lot)
    out = pairs.withColumn("qty", (C("contracts") * lot).cast("int")).withColumn("pnl_pts", C("exit_price") - C("entry_price"))
    cost = round_trip_charges(C("entry_price"), C("exit_price"), C("qty"), is_expiry)["total"]
    gross = C("pnl_pts") * C("qty")
    seconds = F.unix_seconds(C("exit_ts").cast("timestamp")) - F.unix_seconds(C("entry_ts").cast("timestamp"))
    return out.withColumns({
        "gross_p": paise(gross), "charges_p": F.when(C("exit_price").isNotNull(), paise(cost)), "net_p": paise(gross - cost),
        "hold_mins": F.greatest(F.lit(0).cast("long"), F.floor(seconds / 60)),
        "entry_time": F.date_format("entry_ts", "HH:mm"),
        "exit_time": F.when(C("exit_ts").isNotNull(), F.date_format("exit_ts", "HH:mm")).otherwise("OPEN"),
        "is_closed": C("exit_price").isNotNull()}).withColumn("hold_mins", F.when(C("is_closed"), C("hold_mins")))


def _sum(x, cond=None):
    return F.coalesce(F.sum(F.when(cond, x) if cond is not None else x), F.lit(0))


def pnl_summary(ledger: DataFrame, by: tuple[str, ...] = (), capital: float = k.CAPITAL) -> DataFrame:
    """Counts, gross, charges, net, win rate, profit factor, averages, return and equity in one aggregate."""
    win, loss = C("net_p") > 0, C("net_p") <= 0
    agg = ledger.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), F.count("net_p").alias("closed"), F.count(F.when(win, 1)).alias("wins"),
        F.count(F.when(loss, 1)).alias("losses"), _sum(C("gross_p")).alias("gross_p"), _sum(C("charges_p")).alias("charges_p"),
        _sum(C("net_p")).alias("net_p"), _sum(C("net_p"), win).alias("_w"), _sum(C("net_p"), loss).alias("_l"),
        F.avg("hold_mins").alias("avg_hold"), F.count(F.when(C("direction") == "UP", 1)).alias("up_trades"),
        F.count(F.when(C("direction") == "DOWN", 1)).alias("down_trades"), F.count(F.when(C("option_type") == "CE", 1)).alias("ce_trades"),
        F.count(F.when(C("option_type") == "PE", 1)).alias("pe_trades"))
    return agg.withColumns({
        "open_trades": C("trades") - C("closed"), "win_rate": F.when(C("closed") > 0, C("wins") / C("closed")).otherwise(0.0),
        "profit_factor": F.when(C("_l") != 0, F.abs(C("_w") / C("_l"))).otherwise(float("inf")),
        "avg_win": F.when(C("wins") > 0, rupees(C("_w")) / C("wins")).otherwise(0.0),
        "avg_loss": F.when(C("losses") > 0, rupees(C("_l")) / C("losses")).otherwise(0.0),
        "return_pct": rupees(C("net_p")) / capital * 100, "equity_end": rupees(C("net_p")) + capital}).drop("_w", "_l")


def exit_reasons(ledger: DataFrame) -> DataFrame:
    """Closed trades per reason, as a share of all trades and of closed ones."""
    total = ledger.agg(F.count(F.lit(1)).alias("_all"), F.count("net_p").alias("_closed"))
    n = ledger.where("is_closed").groupBy("exit_reason").agg(F.count(F.lit(1)).alias("n"))
    out = n.crossJoin(F.broadcast(total))  # one row
    return (out.select("exit_reason", "n", (C("n") / C("_all")).alias("share_all"), (C("n") / C("_closed")).alias("share_closed"))
            .orderBy(F.desc("n"), "exit_reason"))


def daily_pnl(ledger: DataFrame, capital: float = k.CAPITAL) -> DataFrame:
    """Net P&L per session and running equity; the window runs over one row per day."""
    day = ledger.where("is_closed").groupBy("file_date").agg(F.count(F.lit(1)).alias("trades"), F.count(F.when(C("net_p") > 0, 1)).alias("wins"),
                                                             F.sum("net_p").alias("net_p"))
    w = Window.orderBy("file_date").rowsBetween(Window.unboundedPreceding, 0)
    return day.withColumn("equity", rupees(F.sum("net_p").over(w)) + capital)


def rolling_win_rate(ledger: DataFrame, n: int = 5, keys: tuple[str, ...] = ("regime",), bucket: str = "day",
                     rows_per_chunk: int | None = None) -> DataFrame:
    """Win rate of the last n closed trades in exit order, with the two guard flags."""
    from barflow.operators.chunks import CHUNK, chunked
    closed = ledger.where("is_closed").withColumn("_win", F.when(C("net_p") > 0, 1.0).otherwise(0.0))
    w = Window.partitionBy(*keys, CHUNK).orderBy("exit_ts", "trade_no").rowsBetween(-(n - 1), 0)
    rate = F.when(F.count("_win").over(w) >= n, F.avg("_win").over(w))
    out = chunked(closed, lambda d: d.withColumn("rolling_wr", rate), n - 1, keys=keys, order="exit_ts", bucket=bucket,
                  rows_per_chunk=rows_per_chunk)
    return out.withColumns({"warn_report": F.coalesce(C("rolling_wr") < 0.30, F.lit(False)),
                            "observe": F.coalesce(C("rolling_wr") < k.V5_WR_MIN, F.lit(False))}).drop("_win")


def last_closed(ledger: DataFrame, n: int = 5) -> DataFrame:
    """The latest n closed trades: a top-n, so each task sends n rows at most."""
    return ledger.where("is_closed").orderBy(F.desc("exit_ts"), F.desc("trade_no")).limit(n)


def end_of_day(ledger: DataFrame, capital: float = k.CAPITAL) -> DataFrame:
    """Paper-session statistics per day: win rate, P&L parts, per-trade Sharpe, worst drawdown from the equity peak."""
    closed = ledger.where("is_closed")
    dd = drawdown(closed.withColumn("_net", rupees(C("net_p"))), C("net_p"), keys=["file_date"], order=["exit_ts", "trade_no"],
                  bucket="day", floor=0.0)
    fall = C("drawdown") / (C("peak") + capital * 100 + 1e-7)
    agg = dd.groupBy("file_date").agg(
        F.count(F.lit(1)).alias("trades"), F.avg(F.when(C("net_p") > 0, 1.0).otherwise(0.0)).alias("win_rate"), F.sum("gross_p").alias("gross_p"),
        F.sum("charges_p").alias("charges_p"), F.sum("net_p").alias("net_p"), F.avg("hold_mins").alias("avg_hold"),
        F.avg("_net").alias("_m"), F.stddev_pop("_net").alias("_s"), F.min(fall).alias("worst_dd"))
    sharpe = F.when(C("trades") > 1, C("_m") / (C("_s") + 1e-9) * F.sqrt("trades")).otherwise(0.0)
    return agg.withColumn("sharpe", sharpe).drop("_m", "_s")


def session_totals(ledger: DataFrame) -> DataFrame:
    """Running trades, wins, losses and net within each session, in exit order."""
    won = F.when(C("net_p") > 0, 1).otherwise(0)
    return running(ledger.where("is_closed"), {"n_trades": F.lit(1), "n_wins": won, "n_losses": 1 - won, "net_so_far_p": C("net_p")},
                   keys=["file_date"], order=["exit_ts", "trade_no"], bucket="day")


def trade_report(ledger: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Summary plus verdict."""
    s = pnl_summary(ledger, by)
    return s.withColumn("verdict", text.verdict(C("win_rate"), C("net_p"), C("profit_factor"), C("closed")))


def report_lines(ledger: DataFrame) -> DataFrame:
    """One formatted line per closed or open trade, ready for a text sink."""
    px = F.format_string("%.2f", "entry_price")
    net = F.when(C("is_closed"), F.format_string("%+.2f", rupees(C("net_p")))).otherwise("OPEN")
    return ledger.select("file_date", F.concat_ws("  ", "entry_time", "exit_time", "direction", "option_type", px, net, "exit_reason").alias("value"))


def duplicate_signals(signals: DataFrame, seconds: int = k.DEDUP_SECONDS, bucket: str = "hour") -> DataFrame:
    """Mark signals that repeat a *kept* one of the same hash within ``seconds``.

    Kept signals depend on earlier kept ones, so a run of repeats is folded in order.  Runs are cut where a signal comes
    at least ``seconds`` after the one before it: that signal is kept whatever happened before, which bounds the fold.
    """
    from pyspark.sql.types import BooleanType, StructField, StructType
    w = Window.partitionBy("hash", F.date_trunc(bucket, "ts")).orderBy("ts", "seq")
    prev = F.lag("ts").over(w)
    gap = (F.unix_micros(C("ts").cast("timestamp")) - F.unix_micros(prev.cast("timestamp"))) / 1e6
    marked = signals.withColumn("_fresh", F.coalesce(gap >= seconds, F.lit(True)))
    runs = marked.withColumn("_run", F.sum(C("_fresh").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    schema = StructType([f for f in signals.schema.fields] + [StructField("kept", BooleanType())])

    def fold(pdf):
        pdf = pdf.sort_values(["ts", "seq"], kind="stable")
        last, kept = None, []
        for t in pdf["ts"]:
            ok = last is None or (t - last).total_seconds() >= seconds
            kept.append(ok)
            last = t if ok else last
        pdf["kept"] = kept
        return pdf[[f.name for f in schema.fields]]
    single = runs.withColumn("_size", F.count(F.lit(1)).over(Window.partitionBy("hash", F.date_trunc(bucket, "ts"), "_run")))
    alone = single.where("_size = 1").select(*signals.columns, F.lit(True).alias("kept"))
    many = (single.where("_size > 1").withColumn("_h", F.date_trunc(bucket, "ts")).groupBy("hash", "_h", "_run")
            .applyInPandas(fold, schema))
    return alone.unionByName(many)
