"""Trade charges, execution cost, expected value and money rounding as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barflow import constants as k


def paise(x: Column) -> Column:
    """Money in whole hundredths, rounded half up.  Integer sums are exact and do not depend on task order."""
    return F.floor(x * 100 + 0.5).cast("long")


def rupees(hundredths: Column) -> Column:
    return hundredths / F.lit(100.0)


def charges(entry: Column, exit_: Column, qty: Column, is_expiry: Column | None = None) -> dict[str, Column]:
    """Parts of the round-trip charges."""
    stt = F.lit(k.STT_SELL) if is_expiry is None else F.when(is_expiry, k.STT_EXPIRY).otherwise(k.STT_SELL)
    brokerage = F.lit(k.BROKERAGE_PER_ORDER * 2)
    return {"brokerage": brokerage, "gst": brokerage * k.GST, "stt": exit_ * qty * stt,
            "txn": (entry * qty + exit_ * qty) * k.TXN_PCT, "stamp": entry * qty * k.STAMP_PCT}


def round_trip_charges(entry: Column, exit_: Column, qty: Column, is_expiry: Column | None = None) -> Column:
    """STRUCT of the charge parts and their total."""
    parts = charges(entry, exit_, qty, is_expiry)
    total = parts["brokerage"] + parts["gst"] + parts["stt"] + parts["txn"] + parts["stamp"]
    return F.struct(*[v.alias(n) for n, v in parts.items()], total.alias("total"))


def effective_cost(edge_session: Column, iv_proxy: Column, transition: Column, is_expiry: Column) -> Column:
    """Cost share scaled up by session edge, volatility, regime change and expiry; at most three times the base."""
    mult = (F.when(edge_session, 1.4).otherwise(1.0) * F.when(iv_proxy > 1.5, 1.3).otherwise(1.0)
            * F.when(transition, 1.5).otherwise(1.0) * F.when(is_expiry, 1.6).otherwise(1.0))
    return k.TOTAL_COST * F.least(mult, F.lit(3.0))


def ev_net(ev: Column, cost: Column, minute: Column, iv_proxy: Column) -> Column:
    """Expected value after cost, weighted by session edge and by spread."""
    edge = F.when((minute <= 30) | (minute >= 345), k.EV_SAFETY).otherwise(1.0)
    spread = F.when(iv_proxy > 2.0, 1.8).when(iv_proxy > 1.5, 1.5).when(iv_proxy > 1.2, 1.2).otherwise(1.0)
    return ev - cost * edge * spread


def limit_price(mid: Column, side: Column, is_expiry: Column, iv_proxy: Column) -> tuple[Column, Column]:
    """Limit price and fill probability of an order at ``mid``."""
    high = iv_proxy > 1.2
    spread = F.when(high, k.SPREAD_HIGH_IV).otherwise(k.SPREAD_NORMAL)
    buy = mid + F.greatest(mid * (k.LIMIT_BUFFER_PCT + spread), k.LIMIT_BUFFER_PTS + mid * spread)
    sell = mid * (1.0 - k.LIMIT_BUFFER_PCT - spread)
    price = F.greatest(F.when(side == "BUY", buy).otherwise(sell), F.lit(1.0))
    fill = F.when(is_expiry, k.FILL_EXPIRY).when(high, k.FILL_HIGH_IV).otherwise(k.FILL_ATM)
    return price, fill
