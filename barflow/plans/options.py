"""Option-chain aggregates: one row per trade date from one row per strike and type.

Rows are first summed per (date, strike); what follows works on at most a few hundred strikes a date.
"""
from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.constants import EPS

C = F.col
CHAIN_COLUMNS = ("pcr_oi", "max_pain_dist", "atm_ce_oi", "atm_pe_oi", "iv_skew", "oi_buildup")
VOLUME_COLUMNS = ("pcr_vol", "pcr_oi_vol_diff", "atm_iv_ce", "atm_iv_pe", "atm_iv_avg")


def open_interest_rows(chain: DataFrame) -> DataFrame:
    """Rows with open interest and a usable strike."""
    strike = F.expr("try_cast(strike AS DOUBLE)")
    return chain.where(C("open_int") > 0).withColumn("strike", strike).where(C("strike").isNotNull())


def by_strike(chain: DataFrame, by: str = "trade_date") -> DataFrame:
    """Sums per (date, strike), calls and puts side by side; closes as sum and count so means can be rebuilt."""
    agg = []
    for t in ("CE", "PE"):
        on = C("option_type") == t
        k = t.lower()
        agg += [F.sum(F.when(on, C("open_int")).otherwise(0.0)).alias(f"{k}_oi"),
                F.sum(F.when(on, C("contracts")).otherwise(0)).cast("double").alias(f"{k}_vol"),
                F.sum(F.when(on, C("close"))).alias(f"{k}_sum"), F.count(F.when(on, C("close"))).alias(f"{k}_n"),
                F.sum(F.when(on, C("chg_oi")).otherwise(0.0)).alias(f"{k}_chg")]
    return chain.groupBy(by, "strike").agg(*agg)


def nearest_strike(strikes: DataFrame, spot: str, by: str = "trade_date") -> DataFrame:
    """Per date the strike closest to ``spot``; the lower one on a tie."""
    gap = F.struct(F.abs(C("strike") - C(spot)), C("strike"))
    return strikes.groupBy(by).agg(F.min_by("strike", gap).alias("atm_strike"))


def max_pain(strikes: DataFrame, by: str = "trade_date", reach: float = 1500.0) -> DataFrame:
    """Strike within ``reach`` of the spot where option writers lose least, from two running sums per date."""
    below = Window.partitionBy(by).orderBy("strike").rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(by).orderBy("strike").rowsBetween(1, Window.unboundedFollowing)

    def total(x, w):
        return F.coalesce(F.sum(x).over(w), F.lit(0.0))
    k = C("strike")
    pain = (k * total(C("ce_oi"), below) - total(k * C("ce_oi"), below)
            + total(k * C("pe_oi"), above) - k * total(C("pe_oi"), above))
    near = strikes.withColumn("pain", pain).where(F.abs(k - C("spot_est")) <= reach)
    # Pain is compared after rounding so that equal sums from different orders of addition tie on the strike.
    return near.groupBy(by).agg(F.min_by("strike", F.struct(F.round("pain", 3), k)).alias("max_pain"))


def _with_spot(strikes, by, fallback: bool):
    """Spot estimate per date: strike with most call open interest; optionally the median call strike."""
    call = F.when((C("ce_n") > 0) & (C("ce_oi") > 0), F.struct(C("ce_oi"), -C("strike")))
    est = F.max_by("strike", call)
    if fallback:
        est = F.coalesce(est, F.percentile(F.when(C("ce_n") > 0, C("strike")), F.lit(0.5)))
    day = strikes.groupBy(by).agg(est.alias("spot_est"), *[F.sum(c).alias(f"t_{c}") for c in
                                                           ("ce_oi", "pe_oi", "ce_vol", "pe_vol", "ce_chg", "pe_chg")])
    return strikes.join(day.where(C("spot_est").isNotNull()), by)


def _atm(s, by):
    atm = nearest_strike(s, "spot_est", by)
    at = s.join(atm, by).where(C("strike") == C("atm_strike"))
    mean = {k: F.coalesce(C(f"{k}_sum") / F.when(C(f"{k}_n") > 0, C(f"{k}_n")), F.lit(0.0)) for k in ("ce", "pe")}
    return at, mean


def option_chain_daily(chain: DataFrame, by: str = "trade_date") -> DataFrame:
    """Put/call ratio, max-pain distance, ATM open interest, ATM price skew and open-interest build-up."""
    s = _with_spot(by_strike(open_interest_rows(chain), by), by, False)
    at, mean = _atm(s, by)
    day = at.select(by, "spot_est", (C("t_pe_oi") / (C("t_ce_oi") + EPS)).alias("pcr_oi"), C("ce_oi").alias("atm_ce_oi"),
                    C("pe_oi").alias("atm_pe_oi"), (mean["pe"] - mean["ce"]).alias("iv_skew"),
                    (C("t_pe_chg") - C("t_ce_chg")).alias("oi_buildup"))
    out = day.join(max_pain(s, by), by, "left")
    dist = (F.coalesce(C("max_pain"), C("spot_est")) - C("spot_est")) / (C("spot_est") + EPS) * 100
    return out.withColumn("max_pain_dist", dist)


def option_volume_daily(chain: DataFrame, by: str = "trade_date") -> DataFrame:
    """Put/call ratio by contracts, its difference to the ratio by open interest, ATM price as implied-vol proxies."""
    clean = (chain.withColumns({c: F.coalesce(F.expr(f"try_cast({c} AS DOUBLE)"), F.lit(0.0))
                                for c in ("contracts", "close", "open_int")})
             .withColumn("strike", F.expr("try_cast(strike AS DOUBLE)")).where(C("strike").isNotNull()))
    s = _with_spot(by_strike(clean, by), by, True)
    at, mean = _atm(s, by)
    scale = math.sqrt(252) * 100
    pcr = C("t_pe_vol") / (C("t_ce_vol") + EPS)
    out = at.select(by, pcr.alias("pcr_vol"), (C("t_pe_oi") / (C("t_ce_oi") + EPS) - pcr).alias("pcr_oi_vol_diff"),
                    (mean["ce"] / (C("spot_est") + EPS) * scale).alias("atm_iv_ce"),
                    (mean["pe"] / (C("spot_est") + EPS) * scale).alias("atm_iv_pe"))
    return out.withColumn("atm_iv_avg", (C("atm_iv_ce") + C("atm_iv_pe")) / 2)


def oi_skew(df: DataFrame) -> DataFrame:
    """Normalised difference of ATM put and call open interest."""
    return df.withColumn("atm_oi_skew", (C("atm_pe_oi") - C("atm_ce_oi")) / (C("atm_ce_oi") + C("atm_pe_oi") + EPS))


def nearest_expiry(dates: DataFrame, expiries: DataFrame) -> DataFrame:
    """First expiry on or after each date: the two sets of distinct dates, merged and filled backwards."""
    both = (dates.select(C("trade_date").alias("d"), F.lit(None).cast("date").alias("expiry"))
            .unionByName(expiries.select(C("expiry").alias("d"), "expiry")).distinct())
    ahead = Window.orderBy("d").rowsBetween(0, Window.unboundedFollowing)
    out = both.groupBy("d").agg(F.max("expiry").alias("expiry"), F.max(F.col("expiry").isNull()).alias("_ask"))
    return (out.withColumn("expiry", F.first("expiry", True).over(ahead)).where("_ask")
            .select(C("d").alias("trade_date"), "expiry"))
