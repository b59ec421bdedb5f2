"""Option premium, delta, theta, expiry clock and projections as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from barflow import constants as k
from barflow.functions.numeric import normal_cdf
from barflow.operators.rolling import clip


def lot_size(day: Column) -> Column:
    return F.when(day >= F.lit(k.LOT_CUTOVER).cast("date"), k.LOT_NEW).otherwise(k.LOT_OLD)


def atm_strike(spot: Column, step: int = k.STRIKE_STEP) -> Column:
    """Nearest strike; a spot halfway between two goes to the even multiple."""
    return (F.bround(spot / step) * step).cast("int")


def minutes_to_expiry(now: Column, expiry: Column | None = None, open_minute: int = 555, close_minute: int = 930) -> Column:
    """Trading minutes to the close of the expiry day (default: the coming Tuesday), Monday to Friday, within [1, 1875]."""
    full = close_minute - open_minute
    day, minute = F.to_date(now), F.hour(now) * 60 + F.minute(now)
    dow = F.weekday(day)
    ahead = F.pmod(1 - dow, F.lit(7))
    ahead = F.when((ahead == 0) & (minute >= close_minute), 7).otherwise(ahead)
    end = F.coalesce(expiry, F.date_add(day, ahead)) if expiry is not None else F.date_add(day, ahead)
    left = F.greatest(F.lit(0), close_minute - F.greatest(F.lit(open_minute), minute))
    days = F.datediff(end, day)

    def weekdays_before(d):
        # Whole weeks since a Monday give five each; the rest is capped at five.
        n = F.datediff(d, F.lit("1970-01-05").cast("date"))
        return F.floor(n / 7) * 5 + F.least(F.pmod(n, F.lit(7)), F.lit(5))
    between = F.greatest(F.lit(0), weekdays_before(end) - weekdays_before(F.date_add(day, 1)))
    last = F.when(F.weekday(end) < 5, full).otherwise(0)
    total = F.when(days == 0, left).when(days > 0, left + between * full + last).otherwise(0)
    return clip(total.cast("double"), 1.0, full * 5.0)


def premium(spot: Column, iv_pct: Column, minutes: Column, strike: Column, option_type: Column) -> Column:
    """Black-Scholes premium on a trading-minute clock, floored at 2 and capped at half of spot (call) or strike (put)."""
    strike = F.when(strike > 0, strike).otherwise(F.greatest(F.lit(float(k.STRIKE_STEP)), F.bround(spot / k.STRIKE_STEP) * k.STRIKE_STEP))
    t = F.greatest(minutes, F.lit(1.0)) / (k.TRADING_DAYS * k.SESSION_MINUTES)
    sigma = F.greatest(iv_pct, F.lit(0.1)) / 100
    d1 = (F.ln(spot / strike) + (k.RISK_FREE + 0.5 * sigma * sigma) * t) / (sigma * F.sqrt(t))
    d2 = d1 - sigma * F.sqrt(t)
    pv = strike * F.exp(-k.RISK_FREE * t)
    call = option_type == "CE"
    raw = F.when(call, spot * normal_cdf(d1) - pv * normal_cdf(d2)).otherwise(pv * normal_cdf(-d2) - spot * normal_cdf(-d1))
    return F.greatest(F.least(raw, F.when(call, spot).otherwise(strike) * 0.5), F.lit(2.0))


def effective_delta(bars_open: Column, move: Column, atr: Column, direction: Column) -> Column:
    """Delta with time decay, momentum and the call/put skew; ``move`` is positive when favourable."""
    base = clip(k.DELTA_BASE + move / (atr + 1e-9) * 0.10, 0.10, 0.80)
    return base * F.exp(-0.002 * F.greatest(bars_open, F.lit(0))) * F.when(direction == "UP", 0.90).otherwise(1.05)


def dynamic_theta(minutes_left: Column) -> Column:
    return k.THETA_PER_BAR * F.sqrt(750 / F.greatest(minutes_left, F.lit(30.0)))


def option_mark(entry: Column, spot_entry: Column, spot_now: Column, atr: Column, direction: Column, bars_open: Column,
                minutes_left: Column) -> Column:
    """Premium estimate from the move since entry, less theta; never below 2."""
    move = F.when(direction == "UP", spot_now - spot_entry).otherwise(spot_entry - spot_now)
    gain = move * effective_delta(bars_open, move, atr, direction)
    return F.greatest(entry + gain - bars_open * dynamic_theta(minutes_left), F.lit(2.0))


def trusted_mark(estimate: Column, actual: Column, entry: Column, limit: float = 0.20) -> Column:
    """The recorded price where the estimate strays too far from it."""
    far = (actual > 0) & (F.abs(estimate - actual) / (entry + 1e-9) > limit)
    return F.when(far, actual).otherwise(estimate)


def moneyness_delta(spot: Column, strike: Column, minutes: Column, direction: Column) -> Column:
    sharp = 1.0 + 3.0 * F.exp(-(F.greatest(minutes, F.lit(1.0)) / k.SESSION_MINUTES))
    m = F.when(strike > 0, spot / strike).otherwise(1.0)
    return clip(0.50 + sharp * F.when(direction == "UP", m - 1.0).otherwise(1.0 - m), 0.10, 0.90)


def horizon_projection(horizon: Column, proba: Column, spot: Column, atr: Column, ce: Column, pe: Column, strike: Column,
                       minutes: Column) -> Column:
    """Expected spot and option prices after ``horizon`` minutes, as a STRUCT."""
    move = (proba - 0.5) * 2.0 * atr * F.sqrt(horizon)

    def leg(ltp, direction, sign):
        delta = moneyness_delta(spot, strike, minutes, F.lit(direction))
        proj = F.greatest(ltp + sign * delta * move - ltp * k.PROJECTION_THETA * horizon, F.lit(1.0))
        net = proj * (1.0 - k.OPTION_SLIPPAGE)
        return proj, net, F.when(ltp > 0, (net / ltp - 1) * 100).otherwise(0.0)
    c, p = leg(ce, "UP", 1), leg(pe, "DOWN", -1)
    return F.struct((spot + move).alias("proj_spot"), c[0].alias("ce_proj"), p[0].alias("pe_proj"), c[1].alias("ce_net"),
                    p[1].alias("pe_net"), c[2].alias("ce_pnl_pct"), p[2].alias("pe_pnl_pct"),
                    F.greatest(F.lit(30.0), minutes - horizon).alias("dte_proj"))
