"""Writers: trades, events, bar log, report text."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.operators.rolling import flag

C = F.col

# Bar-log columns in file order: name, source column, type.
BAR_LOG = (
    ("timestamp", "dt", "string"), ("date", "trade_date", "date"), ("minute_of_day", "minute_of_day", "int"), ("session_pct", "session_pct", "double"),
    ("day_of_week", "dt", "day"), ("spot_close", "close", "double"), ("spot_open", "day_open", "double"), ("gap_pct", "gap_pct", "double"),
    ("spot_vs_open_pct", "spot_vs_open_pct", "double"), ("vwap", "vwap", "double"), ("vwap_dist_pct", "vwap_dist", "double"), ("vwap_position", "vwap", "side"),
    ("ret_1m", "ret_1m", "double"), ("ret_5m", "ret_5m", "double"), ("ret_15m", "ret_15m", "double"), ("atr_14", "atr_14", "double"),
    ("atr_14_pct", "atr_14_pct", "double"), ("iv_proxy", "iv_proxy", "double"), ("iv_rank_approx", "iv_rank", "double"), ("bb_position", "bb_pos", "double"),
    ("bb_squeeze", "bb_squeeze", "int"), ("bb_width", "bb_width", "double"), ("vol_ratio", "vol_ratio", "double"), ("day_atr_pct", "day_atr_pct", "double"),
    ("rsi_1m", "rsi_14", "double"), ("rsi_5m", "tf5_rsi", "double"), ("rsi_15m", "tf15_rsi", "double"), ("adx_1m", "adx_14", "double"), ("adx_5m", "tf5_adx", "double"),
    ("adx_15m", "tf15_adx", "double"), ("macd_hist_1m", "macd_h", "double"), ("macd_hist_5m", "tf5_macd_h", "double"), ("stoch_k_1m", "stoch_k", "double"),
    ("stoch_k_5m", "tf5_stoch_k", "double"), ("cci_1m", "cci_20", "double"), ("cci_5m", "tf5_cci", "double"), ("mfi_14", "mfi_14", "double"),
    ("pressure_ratio", "pressure_ratio", "double"), ("tick_imbalance", "tick_imbalance", "double"), ("vwap_dev_vel", "vwap_dev_vel", "double"),
    ("ta_overall_score", "ta_overall_score", "double"), ("ta_momentum", "ta_momentum_score", "double"), ("ta_trend", "ta_trend_score", "double"),
    ("ta_flow", "ta_flow_score", "double"), ("regime", "regime", "int"), ("regime_conf", "regime_conf", "double"), ("micro_regime", "micro_regime", "string"),
    ("crisis_bypass", "crisis_bypass", "int"), ("model_avg_conf", "avg_conf", "double"), ("model_agreement", "agreement", "double"),
    ("model_direction", "direction", "string"), ("meta_labeler_conf", "meta_conf", "double"), ("signal_conf", "final_conf", "double"),
    ("block_reason", "block_reason", "string"), ("in_position", "in_position", "int"), ("pos_entry_price", "pos_entry_price", "double"),
    ("pos_current_ltp", "pos_current_ltp", "double"), ("pos_stop_price", "pos_stop_price", "double"), ("trade_event", "trade_event", "string"),
    ("trade_exit_reason", "exit_reason", "string"), ("session_trades", "n_trades", "int"), ("session_wins", "n_wins", "int"), ("session_losses", "n_losses", "int"),
    ("consec_losses", "consec_losses", "int"))


def bar_log_rows(df: DataFrame) -> DataFrame:
    """Rows in the bar-log layout; columns the frame lacks become 0 or an empty string."""
    have = set(df.columns)
    out = [C("symbol")]
    for name, source, kind in BAR_LOG:
        if kind == "day":
            x = F.date_format("dt", "EEEE")
        elif kind == "side":
            x = F.when(C("close") > F.coalesce(C(source), C("close")), "ABOVE").otherwise("BELOW") if source in have else F.lit("BELOW")
        elif name == "timestamp":
            x = F.date_format("dt", "yyyy-MM-dd HH:mm:ss")
        elif kind == "date":
            x = C(source)
        elif kind == "string":
            x = F.coalesce(C(source), F.lit("")) if source in have else F.lit("")
        else:
            x = F.coalesce(C(source).cast(kind), F.lit(0).cast(kind)) if source in have else F.lit(0).cast(kind)
        out.append(x.alias(name))
    rows = df.select(*out)
    return rows.withColumn("is_crisis", flag(C("regime") == 2)).withColumn("signal_generated", flag((C("block_reason") == "") & (C("model_direction") != "")))


def write_bar_log(rows: DataFrame, path: str) -> None:
    """One CSV directory per date."""
    rows.write.mode("append").partitionBy("date").option("header", True).csv(path)


def write_trades(ledger: DataFrame, path: str, fmt: str = "parquet", single_file: bool = False, by: str = "file_date") -> None:
    """Closed trades: parquet partitioned by session date (or a coarser column where sessions are small), or CSV with a header; one file only for small exports."""
    closed = ledger.where("is_closed")
    if fmt == "csv":
        (closed.coalesce(1) if single_file else closed).write.mode("overwrite").option("header", True).csv(path)
    else:
        closed.write.mode("overwrite").partitionBy(by).parquet(path)


def write_trade_events(events: DataFrame, path: str, compression: str = "none", rows_per_file: int = 1_000_000) -> None:
    """One JSON line per event, absent values left out. A compressed file is read by one task, so files hold ``rows_per_file`` lines at most."""
    lines = events.select(F.to_json(F.struct(*events.columns)).alias("value"))
    out = lines.write.mode("append").option("compression", compression).option("maxRecordsPerFile", rows_per_file)
    out.option("zlib.compress.level", "BEST_SPEED").text(path)


def write_report(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("overwrite").text(path)
