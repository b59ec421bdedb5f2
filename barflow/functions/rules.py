"""Entry filters, sizing, stops and confidence adjusters as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barflow import constants as k
from barflow.operators.rolling import clip


def expiry_zone(is_expiry: Column, minute: Column) -> Column:
    """STRUCT(tag, allow_new, size_mult, stop_tighten) of the expiry-day zone holding the minute."""
    def zone(tag, allow, tighten, size=1.0):
        return F.struct(F.lit(tag).alias("tag"), F.lit(allow).alias("allow_new"), F.lit(size).alias("size_mult"),
                        F.lit(tighten).alias("stop_tighten"))
    out = F.when(~is_expiry, zone("NORMAL", True, 1.0))
    for tag, lo, hi, allow, tighten in k.EXPIRY_ZONES:
        out = out.when((minute >= lo) & (minute <= hi), zone(tag, allow, tighten))
    return out.otherwise(zone("EXPIRY_UNKNOWN_ZONE", False, 0.0, 0.0))


def expiry_iv_blocked(is_expiry: Column, iv_pct: Column) -> Column:
    return is_expiry & (iv_pct > k.EXPIRY_IV_BLOCK)


def vega_blocked(iv_proxy: Column, iv_change: Column) -> Column:
    return (iv_proxy > 1.5) | (iv_change > 20)


def spread_ok(bid: Column, ask: Column, mid: Column, limit: float = 0.05) -> Column:
    quoted = (bid > 0) & (ask > 0) & (mid > 0)
    return F.when(quoted, (ask - bid) / mid <= limit).otherwise(True)


def near_open_interest(strike: Column, call_wall: Column, put_wall: Column, distance: float = 50.0) -> Column:
    return (((call_wall > 0) & (F.abs(strike - call_wall) < distance))
            | ((put_wall > 0) & (F.abs(strike - put_wall) < distance)))


def price_off_ticks(price: Column, ticks: Column, limit: float = 0.02) -> Column:
    """Price more than ``limit`` away from the mean of the last five ticks (an array); false with fewer."""
    five = F.slice(ticks, -5, 5)
    mean = F.aggregate(five, F.lit(0.0), lambda a, x: a + x) / 5
    return F.when(F.size(ticks) >= 5, F.abs(price - mean) / mean > limit).otherwise(False)


def conf_size(conf: Column) -> Column:
    out = None
    for floor, share in k.CONF_SIZE_BANDS:
        out = F.when(conf >= floor, share) if out is None else out.when(conf >= floor, share)
    return out.otherwise(0.5)


def drawdown_size(day_drawdown: Column, limit: float = k.DAILY_DD_LIVE) -> Column:
    """Full size until 70% of the daily limit is used, then a ramp to a quarter, nothing at the limit."""
    used = F.abs(day_drawdown) / (limit + 1e-9)
    ramp = F.greatest(F.lit(0.25), 1.0 - 0.75 * ((used - k.DD_WARN) / (1.0 - k.DD_WARN)))
    return (F.when(day_drawdown >= 0, 1.0).when(used >= 1.0, 0.0).when(used >= k.DD_WARN, ramp).otherwise(1.0))


def position_size(capital: Column, entry: Column, lot: Column, conf: Column, dd_mult: Column, iv_daily: Column, regime: Column,
                  week_drawdown: Column, size_mult: Column | None = None) -> Column:
    """Contracts: affordable lots scaled by conviction, drawdown, volatility, regime and week, then the risk cap."""
    raw = capital * k.DEPLOY_PCT * (size_mult if size_mult is not None else F.lit(1.0)) / (entry * lot + 1e-9)
    mult = (conf_size(conf) * dd_mult * F.when(iv_daily > 1.2, 0.70).otherwise(1.0)
            * F.when(regime == k.RANGING, 0.70).otherwise(1.0)
            * F.when(week_drawdown > 0.08, 0.5).when(week_drawdown > 0.04, 0.7).otherwise(1.0))
    base = F.greatest(F.lit(1), F.least(F.floor(raw * mult), F.lit(k.MAX_CONTRACTS)))
    risk = entry * k.STOP_PCT * lot
    cap = F.greatest(F.lit(1), F.floor(capital * k.MAX_RISK_PCT / risk))
    return F.when(risk > 0, F.least(base, cap)).otherwise(base).cast("int")


def lots_v5(capital: Column, prem: Column, vix: Column) -> Column:
    base = F.floor(capital * k.DEPLOY_PCT / (prem * k.V5_LOT))
    base = F.when(vix > k.V5_VIX_HALVE, F.floor(base / 2)).otherwise(base)
    return F.when((prem > 0) & (capital > 0), clip(base, 1, k.V5_MAX_LOTS)).otherwise(0).cast("int")


def premium_stop(entry: Column, tighten: Column, iv_daily: Column) -> Column:
    return entry * (1 - k.STOP_PCT * tighten * F.when(iv_daily > 1.3, 0.80).otherwise(1.0))


def premium_target(entry: Column, cost: Column | float = k.COST_RT) -> Column:
    cost = cost if isinstance(cost, Column) else F.lit(cost)
    return F.greatest(entry * (1 + k.TARGET_PCT), entry * (1 + cost) * 1.10)


def dynamic_stops(entry: Column, atr: Column, direction: Column, delta: float = 0.5) -> Column:
    """STRUCT(stop, target) from option ATR, with the loss capped at 5%."""
    a = F.greatest(F.lit(1.0), F.least(atr * delta, entry * 0.50))
    up = direction.isin("UP", "CALL", "BULLISH")
    stop = F.when(up, F.greatest(F.lit(0.05), entry * 0.95, entry - 2.5 * a)).otherwise(F.least(entry * 1.05, entry + 2.5 * a))
    target = F.when(up, entry + 4.0 * a).otherwise(F.greatest(F.lit(0.05), entry - 4.0 * a))
    return F.struct(stop.alias("stop"), target.alias("target"))


def trailing_stop(entry: Column, ltp: Column, initial: Column, direction: Column) -> Column:
    gain = (ltp - entry) / (entry + 1e-9)
    return (F.when(gain > 0.60, entry * F.when(direction == "UP", 1.30).otherwise(0.70)).when(gain > 0.40, entry)
            .otherwise(initial))


def late_day_multiplier(minute: Column) -> Column:
    return F.when(minute >= 315, 1.10).when(minute >= 270, 1.05).otherwise(1.0)


def iv_crush_penalty(iv_proxy: Column, iv_change: Column) -> Column:
    return F.when((iv_proxy > 1.5) & (iv_change < 0), 0.10).otherwise(0.0)


def transition_boost(minutes_since_flip: Column) -> Column:
    return F.when(minutes_since_flip < k.TRANSITION_MIN, k.TRANSITION_BOOST).otherwise(0.0)
