"""Dates, option symbols, hashes and labels as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_day(text: Column) -> Column:
    """``02JAN24`` to a date, NULL when it is not one."""
    return F.try_to_date(F.initcap(F.lower(text)), "ddMMMyy") if hasattr(F, "try_to_date") else F.to_date(F.initcap(F.lower(text)), "ddMMMyy")


def option_symbol(expiry: Column, strike: Column, option_type: Column, underlying: str = "IDX") -> Column:
    return F.concat(F.lit(underlying), F.upper(F.date_format(expiry, "ddMMMyy")), strike.cast("int").cast("string"), option_type)


def parse_option_symbol(symbol: Column, underlying: str = "IDX") -> Column:
    """STRUCT(expiry, strike, option_type) from a symbol; parts are NULL when it does not parse."""
    pattern = f"^{underlying}(\\d{{2}}[A-Z]{{3}}\\d{{2}})(\\d+)(CE|PE)$"
    part = [F.nullif(F.regexp_extract(symbol, pattern, i), F.lit("")) for i in (1, 2, 3)]
    return F.struct(parse_day(part[0]).alias("expiry"), part[1].cast("int").alias("strike"), part[2].alias("option_type"))


def signal_hash(direction: Column, minute: Column, spot: Column) -> Column:
    """Twelve hex digits that repeat for the same direction, minute and spot to the nearest ten."""
    near = (F.bround(spot / 10) * 10).cast("long").cast("string")
    return F.substring(F.md5(F.concat_ws("_", direction, minute.cast("string"), near)), 1, 12)


def iv_label(iv: Column) -> Column:
    return (F.when(iv < 0.5, "IV LOW").when(iv < 1.0, "IV NORMAL-LOW").when(iv < 1.5, "IV NORMAL-HIGH")
            .otherwise("IV HIGH (premium)"))


def bias_label(score: Column) -> Column:
    return (F.when(score > 0.35, "BULLISH").when(score > 0.10, "MILD BULLISH").when(score > -0.10, "NEUTRAL")
            .when(score > -0.35, "MILD BEARISH").otherwise("BEARISH"))


def strength_label(conf: Column, strong: float, moderate: float) -> Column:
    return F.when(conf >= strong, "STRONG").when(conf >= moderate, "MODERATE").otherwise("WEAK")


def verdict(win_rate: Column, pnl: Column, profit_factor: Column, closed: Column, needed: int = 60) -> Column:
    """Report verdict: ready only with 55% wins, positive P&L, profit factor 1.5 and enough closed trades."""
    good = (win_rate >= 0.55) & (pnl > 0)
    return (F.when(good & (profit_factor >= 1.5) & (closed >= needed), "GO-LIVE READY")
            .when(good & (profit_factor >= 1.5), "TRENDING POSITIVE").when(good, "ACCEPTABLE")
            .when((pnl > 0) & (win_rate < 0.50), "PROFITABLE LOW WIN RATE").when((pnl < 0) & (win_rate >= 0.50), "LOSING BIG LOSERS")
            .when(pnl < 0, "LOSING").otherwise("BREAKEVEN"))
