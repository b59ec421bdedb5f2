"""Ordered entry gates as one expression per gate; the first that fails names the reason, penalties stay visible.

Rows carry votes, features and the state columns made by ``plans.sessions``; everything here is row-local.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow import constants as k
from barflow.functions import costs, pricing, rules, text
from barflow.functions.numeric import bucket_score
from barflow.operators.chunks import CHUNK, chunked
from barflow.operators.rolling import Roller, flag
from barflow.plans.votes import lookup

C = F.col


def first_failing(gates: list[tuple[str, Column]]) -> Column:
    """Name of the first gate whose condition holds, NULL when none does."""
    return F.coalesce(*[F.when(cond, name) for name, cond in gates])


def with_atm_premium(df: DataFrame) -> DataFrame:
    """Dearer of the ATM call and put: recorded price where there is one, model price otherwise."""
    iv = F.when(C("iv_proxy") > 0, C("iv_proxy")).when(C("atr_14_pct") > 0, C("atr_14_pct")).otherwise(0.06) * math.sqrt(252)
    # Own columns, so that the optimizer keeps one copy of what the premium formula uses many times.
    df = df.withColumns({"_min": pricing.minutes_to_expiry(C("dt")), "_k": pricing.atm_strike(C("close")).cast("double"), "_iv": iv})

    def leg(column, kind):
        known = C(column) if column in df.columns else F.lit(0.0)
        return F.when(known > 0, known).otherwise(pricing.premium(C("close"), C("_iv"), C("_min"), C("_k"), F.lit(kind)))
    out = df.withColumns({"_ce": leg("atm_ce_ltp", "CE"), "_pe": leg("atm_pe_ltp", "PE")})
    return out.withColumn("atm_premium", F.greatest("_ce", "_pe")).drop("_min", "_k", "_iv", "_ce", "_pe")


def penalties(df: DataFrame) -> DataFrame:
    """``penalty_ledger``: every confidence penalty by name; ``penalty_total`` their sum; ``raw_conf`` before them."""
    live, up, down = ~C("crisis_bypass"), C("direction") == "UP", C("direction") == "DOWN"
    mod = C("minute_of_day")
    outside = (mod < 30) | (mod > 330)
    opposed = (down & (C("ta_overall_score") > 0)) | (up & (C("ta_overall_score") < 0))
    free = ~C("in_pullback")
    side = F.when(up, 1).otherwise(0)
    p15, p30 = C("p15"), C("p30")

    def strong(p, h):
        pred = F.when(p > 0.5, 1).otherwise(0)
        return F.coalesce((F.greatest(p, 1 - p) >= k.CONF_BY_HORIZON[h]) & (pred == side), F.lit(False))
    conflict = p15.isNotNull() & p30.isNotNull() & ((p15 > 0.5) != (p30 > 0.5))
    trend5 = (C("tf5_adx") >= 60) & (C("regime") == k.TRENDING)
    adx = F.when(C("tf5_adx") > 0, C("tf5_adx")).otherwise(C("adx_14"))
    calm = C("micro_regime") != "BREAKOUT"
    squeezed = (C("bb_squeeze") == 1) & calm
    thin = C("atr_ratio") < 0.85
    zone = rules.expiry_zone(C("is_expiry") == 1, mod)
    meta = C("meta_conf")
    raw = 0.7 * C("mean_conf") + 0.3 * F.when(meta > 0, meta).otherwise(k.META_NEUTRAL)
    out = df.withColumn("raw_conf", raw)
    ev = C("raw_conf") * k.EV_WIN - (1 - C("raw_conf")) * k.EV_LOSS
    out = out.withColumn("ev_net", costs.ev_net(ev, F.lit(k.TOTAL_COST), mod, C("iv_proxy")))
    z = F.lit(0.0)
    parts = {
        "regime_conf": F.when(live & (C("regime_conf") < 0.55), 0.04).otherwise(0.0),
        "time_window": F.when(live & outside, 0.05).otherwise(0.0),
        "crisis_up": F.when(C("crisis_bypass") & up & outside, 0.10).otherwise(0.0),
        "agreement": F.when(C("agreement") < 0.55, 0.03).otherwise(0.0),
        "temporal": C("lock_penalty"),
        "horizons": F.when(live & conflict, 0.08).otherwise(0.0),
        "ta": F.when(opposed & free, F.when(C("bb_squeeze") == 1, 0.08).otherwise(F.abs("ta_overall_score") * 0.06)).otherwise(0.0),
        "expiry": F.when(C("is_expiry") == 1, F.when(zone["tag"] == k.EXPIRY_ZONES[2][0], 0.10).otherwise(0.07)).when(C("dow") == 1, 0.05).otherwise(0.0),
        "lunch": F.when(mod.between(180, 225), 0.05).otherwise(0.0),
        "long_horizon": F.when(live & ~(strong(p15, 15) | strong(p30, 30)), 0.05).otherwise(0.0),
        "adx": F.when(live & free & ~trend5 & (adx >= 12) & (adx < 20) & (C("adx_slope") <= 0), (20 - adx) / 20 * 0.10).otherwise(0.0),
        "squeeze": F.when(live & squeezed, F.least(F.when(C("adx_14") < 30, 0.07).otherwise(0.0) + F.when(thin, 0.05).otherwise(0.0), F.lit(0.10)))
                    .when(squeezed & thin, 0.04).otherwise(0.0),
        "stale": F.when(live & free, F.least(C("stale_penalty"), F.lit(0.10))).otherwise(0.0),
        "iv_crush": rules.iv_crush_penalty(C("iv_proxy"), C("iv_pct_change")),
        "meta": F.when(live & (meta < k.META_LOW), 0.05).when(live & (meta < k.META_PASS), 0.08).otherwise(0.0),
        "ev": F.when((C("ev_net") > -0.05) & (C("ev_net") <= 0.0015), F.least(F.lit(0.06), F.abs(C("ev_net") - 0.0015) * 10)).otherwise(0.0)}
    ledger = F.struct(*[F.coalesce(v, z).alias(n) for n, v in parts.items()])
    out = out.withColumn("penalty_ledger", ledger)
    total = None
    for n in parts:
        total = C(f"penalty_ledger.{n}") if total is None else total + C(f"penalty_ledger.{n}")
    return out.withColumn("penalty_total", total)


def gate_funnel_v4(df: DataFrame) -> DataFrame:
    """Add the penalty columns, ``final_conf``, ``block_reason`` (NULL when every gate lets the row through) and ``passes``."""
    out = penalties(df)
    live, up, down = ~C("crisis_bypass"), C("direction") == "UP", C("direction") == "DOWN"
    mod = C("minute_of_day")
    capped = F.when(C("penalty_total") > 0.10, C("raw_conf") - 0.10).otherwise(C("raw_conf") - C("penalty_total"))
    trending = C("micro_regime").isin("TRENDING_UP", "TRENDING_DN", "BREAKOUT")
    floor = F.when(trending, k.CONF_FLOOR_TRENDING).otherwise(k.CONF_MIN) + C("extra_floor")
    floor = F.greatest(F.when(C("is_expiry") == 1, F.greatest(floor, F.lit(k.EXPIRY_CONF_FLOOR))).otherwise(floor), F.lit(k.CONF_MIN))
    out = out.withColumns({"final_conf": capped, "conf_floor": floor})
    zone = rules.expiry_zone(C("is_expiry") == 1, mod)
    pinned = zone["tag"] == k.EXPIRY_ZONES[1][0]
    override = pinned & (F.greatest("adx_14", "tf5_adx") >= 30) & (C("regime") == k.TRENDING)
    iv = F.when(C("iv_proxy") > 0, C("iv_proxy")).otherwise(C("atr_14_pct"))
    adx = F.when(C("tf5_adx") > 0, C("tf5_adx")).otherwise(C("adx_14"))
    trend5 = (C("tf5_adx") >= 60) & (C("regime") == k.TRENDING)
    ta = C("ta_overall_score")
    gates = [
        ("Gate1", live & (C("regime") != k.TRENDING)),
        ("Gate2", (C("session_pct") > 0.92) | (mod >= 335)),
        ("Gate2b", live & (C("regime_conf") < 0.10)),
        ("Gate2c", live & (mod > 15) & ((C("ret5m_fd") == 0) | (C("ret15m_fd") == 0))),
        ("Gate4", (C("is_expiry") == 1) & ((~zone["allow_new"] & ~override) | (mod >= k.EXPIRY_FORCE_EXIT))),
        ("Gate5", iv < 0.10),
        ("Gate5d", C("atm_premium") < F.when(C("is_expiry") == 1, 20.0).otherwise(30.0)),
        ("Gate5b", (F.abs("gap_pct") > 2.5 * C("day_atr_pct")) & (mod < 45)),
        ("Inputs", ~C("inputs_valid")),
        ("Votes", C("n_votes") == 0),
        ("Agreement", C("agreement") < 0.52),
        ("Gate5c", (mod <= 60) & (((C("gap_pct") < -2.0) & up) | ((C("gap_pct") > 2.0) & down))),
        ("Gate3b", ((down & (ta > 0)) | (up & (ta < 0))) & (F.abs(ta) > 0.85)),
        ("Gate7e", live & (mod < 30) & (((C("or_break_dn") == 1) & up) | ((C("or_break_up") == 1) & down))),
        ("Gate7c", live & (adx < 12) & ~trend5),
        ("CrisisADX", C("crisis_bypass") & (C("adx_14") > 50)),
        ("Gate9", C("ev_net") <= -0.05),
        ("Gate10", C("trades_dir") >= k.SESSION_CAP),
        ("PenaltyBudget", C("penalty_total") > 0.20),
        ("FinalFloor", C("final_conf") < C("conf_floor")),
        ("FinalConf", C("final_conf") < 0.55),
        ("FinalADX", C("adx_14") < 12),
        ("FinalAgreement", (C("final_conf") > 0.60) & (C("agreement") < 0.55)),
        ("FinalTrades", C("trades_today") >= 10)]
    out = out.withColumn("block_reason", first_failing(gates))
    return out.withColumn("passes", C("block_reason").isNull())


def gate_funnel_v5(df: DataFrame) -> DataFrame:
    """The five-gate form; the pullback entry (a session state machine) runs on rows that pass."""
    live, mod = ~C("crisis_bypass"), C("minute_of_day")
    gates = [("V5-Gate1", live & (C("regime") != k.TRENDING)),
             ("V5-Gate2", live & ((mod < 15) | (mod > 300) | (C("session_pct") > 0.92))),
             ("V5-Gate3", live & (C("iv_rank") > 80.0)),
             ("V5-Gate4", live & (C("event_day") == 1)),
             ("V5-Risk", live & ~C("risk_ok")),
             ("V5-Inputs", ~C("inputs_valid")),
             ("V5-Votes", C("direction").isNull()),
             ("V5-ML", C("agreement") < k.V5_CONF_ENTRY),
             ("V5-Align", live & (C("regime_direction") != "NEUTRAL") & (C("regime_direction") != C("direction")))]
    out = df.withColumn("block_reason", first_failing(gates))
    return out.withColumn("passes", C("block_reason").isNull())


def entry_gate(gated: DataFrame, tag: str, strict: bool) -> DataFrame:
    """The pullback entry behind a funnel: rows that passed every gate and are no crisis bypass go through the session's pending-entry machine in order;
    those it keeps waiting, or expires, are blocked under ``tag``. ``entry_state`` says why. Rows stopped before don't move the machine."""
    from barflow.plans.sessions import pullback_entry
    asked = C("block_reason").isNull() & ~C("crisis_bypass")
    moved = pullback_entry(gated.withColumns({"_side": C("direction"), "direction": F.when(asked, C("direction"))}), strict).withColumn("direction", C("_side")).drop("_side")
    out = moved.withColumn("block_reason", F.coalesce("block_reason", F.when(asked & ~C("entry"), tag)))
    return out.withColumn("passes", C("block_reason").isNull()).drop("entry")


def funnel(gated: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows per outcome: how many each gate stopped and how many passed."""
    return gated.groupBy(*by, F.coalesce("block_reason", F.lit("PASS")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


def block_histogram(events: DataFrame) -> DataFrame:
    """BLOCKED events by the bracketed tag of their reason and by minute."""
    tag = F.regexp_extract("reason", r"^\[(.+?)\]", 1)
    return (events.where(C("event") == "BLOCKED").groupBy(F.when(tag != "", tag).otherwise(C("reason")).alias("gate"), "minute_of_day")
            .agg(F.count(F.lit(1)).alias("n")))


def order_filters(df: DataFrame, capital: float = k.CAPITAL, lot: int = k.LOT_NEW) -> DataFrame:
    """Filters between signal and order; ``order_block`` names the first that holds."""
    live, up, down, mod = ~C("crisis_bypass"), C("direction") == "UP", C("direction") == "DOWN", C("minute_of_day")
    vs_open = F.try_divide(C("close") - C("day_open"), C("day_open"))
    bear, bull = (C("tf15_ret_1") < -0.03) & (C("tick_imbalance") < 0), (C("tf15_ret_1") > 0.03) & (C("tick_imbalance") > 0)
    need = 0.62 + (1.0 - C("dd_mult")) * 0.28
    gates = [("SESSION_NO_TRADE", live & (C("session_regime") == "NO_TRADE")), ("SESSION_RANGING", live & (C("session_regime") == "RANGING")),
             ("AGAINST_OPEN", live & (mod <= 120) & ((up & (vs_open < -0.005)) | (down & (vs_open > 0.005)))),
             ("UNAFFORDABLE", (C("atm_premium") > 0) & (C("atm_premium") > capital / lot * 0.70)),
             ("SAME_SIDE_LOSS", (C("last_loss_direction") == C("direction")) & (C("bars_since_loss") < 3)),
             ("TAPE", (C("regime") == k.CRISIS) & live & ((up & bear) | (down & bull))),
             ("GAP_DOWN_DAY", live & C("gap_down_day") & (C("losses_today") >= 2)),
             ("DRAWDOWN", (C("dd_mult") < 1.0) & (C("mean_conf") < need)),
             ("LATE", (C("session_pct") > 0.92) | (mod >= 340))]
    return df.withColumn("order_block", first_failing(gates))


def next_bar_confirmation(df: DataFrame, bucket: str = "day", rows_per_chunk: int | None = None) -> DataFrame:
    """A signal stands only if the next bar of the session moves its way, keeps the VWAP side and the premium holds."""
    w = Window.partitionBy("symbol", CHUNK, "trade_date").orderBy("dt")

    def run(d):
        nxt = {c: F.lead(c).over(w) for c in ("close", "vwap_dist", "premium")}
        up = C("direction") == "UP"
        price = F.when(up, nxt["close"] > C("close")).otherwise(nxt["close"] < C("close"))
        vwap = F.when(up, nxt["vwap_dist"] >= -0.001).otherwise(nxt["vwap_dist"] <= 0.001)
        prem = F.when((C("premium") > 0) & (nxt["premium"] > 0), (nxt["premium"] - C("premium")) / C("premium") > -0.02).otherwise(True)
        ok = price & vwap & prem
        return d.withColumns({"confirmed": F.coalesce(ok, F.lit(False)), "reject_price": flag(~price), "reject_vwap": flag(~vwap), "reject_premium": flag(~prem)})
    return chunked(df, run, 1, forward=True, bucket=bucket, rows_per_chunk=rows_per_chunk)


def micro_confirmation(df: DataFrame, bucket: str = "day", rows_per_chunk: int | None = None) -> DataFrame:
    """Which price evidence, if any, supports the direction: two bars on the VWAP side, relaxations, candle, structure."""
    w = Roller()

    def run(d):
        above = F.when(C("close") > C("vwap"), 1).otherwise(0)
        out = d.withColumn("_pos", above)
        up = C("direction") == "UP"
        side = F.when(up, 1).otherwise(0)
        out = out.withColumn("_prev", w.lag("_pos"))
        on_side = C("_pos") == side
        conf, micro = C("mean_conf"), C("micro_regime")
        body = F.abs(C("close") - C("open"))
        with_candle = F.when(up, C("close") > C("open")).otherwise(C("close") <= C("open"))
        hostile = F.when(up, (C("tick_imbalance") < -0.4) & (C("pressure_ratio") < 0.7)).otherwise((C("tick_imbalance") > 0.4) & (C("pressure_ratio") > 1.43))
        aligned = F.when(up, (C("struct_score") > 0.4) | (C("orb_dist") > 0.3)).otherwise((C("struct_score") < -0.4) | (C("orb_dist") < -0.3))
        reason = (F.when((C("_prev") == side) & on_side, F.when(up, "vwap_hold_above").otherwise("vwap_hold_below"))
                  .when((micro == "RANGING") & (conf >= 0.88) & on_side, "vwap_cross_ranging_highconf")
                  .when(micro.isin("TRENDING_UP", "TRENDING_DOWN", "BREAKOUT") & (conf >= 0.85) & on_side, "vwap_cross_trending_highconf")
                  .when((C("tf5_adx") >= 60) & on_side, "vwap_5m_strong_trend")
                  .when((C("atr_14") > 0) & (body > 0.3 * C("atr_14")) & with_candle & ~hostile, "strong_directional_candle")
                  .when(aligned & (conf >= 0.80) & on_side, "structure_aligned_vwap").otherwise("no_micro_confirmation"))
        return out.withColumn("micro_reason", reason).drop("_pos", "_prev")
    return chunked(df, run, 1, bucket=bucket, rows_per_chunk=rows_per_chunk)


def analysis_row(df: DataFrame) -> DataFrame:
    """Momentum, trend, flow and overall scores with their labels."""
    mom = (bucket_score(C("rsi_14"), 20, 35, 65, 80) + bucket_score(C("stoch_k"), 15, 25, 75, 85) + bucket_score(C("willr"), -95, -80, -20, -5)) / 3
    trend = C("ema9_21") * 0.25 + C("ema21_50") * 0.25 + C("supertrend") * 0.25 + F.signum("dmi_diff") * 0.25
    out = df.withColumns({"momentum_score": mom, "trend_score": trend, "flow_score": bucket_score(C("mfi_14"), 20, 35, 65, 80), "iv_regime": text.iv_label(C("iv_proxy"))})
    orb = F.when(C("or_break_up") == 1, 1).when(C("or_break_dn") == 1, -1).otherwise(0)
    overall = (C("momentum_score") * 0.25 + C("trend_score") * 0.35 + F.when(C("above_vwap") == 1, 1).otherwise(-1) * 0.20 + orb * 0.10 + F.signum("macd_h") * 0.10)
    out = out.withColumn("overall_score", overall)
    names = lookup_name(C("regime"))
    return out.withColumns({"overall_bias": text.bias_label(C("overall_score")), "regime_name": names})


def lookup_name(regime: Column) -> Column:
    out = None
    for code, name in k.REGIME_NAMES.items():
        out = F.when(regime == code, name) if out is None else out.when(regime == code, name)
    return out.otherwise("UNKNOWN")


def scarcity(signals: DataFrame, limit: int = k.SESSION_CAP) -> DataFrame:
    """Trades already taken in the direction that day, and whether the limit blocks another.

    Counted with a two-level scan per (symbol, day, direction); a signal itself counts for the ones after it.
    """
    from barflow.operators.scans import running
    out = running(signals, {"_n": F.col("taken")}, keys=["symbol", "trade_date", "direction"], order=["dt", "seq"], bucket="hour")
    return out.withColumn("trades_dir", (C("_n") - C("taken")).cast("int")).withColumn("scarce", C("trades_dir") >= limit).drop("_n")


def black_swan(bars: DataFrame) -> DataFrame:
    """First bar of each session: is the gap a shock, a gap-down day, a one-trade day."""
    first = F.row_number().over(Window.partitionBy("symbol", "trade_date").orderBy("dt"))
    out = bars.withColumn("_r", first).where("_r = 1").drop("_r")
    return out.select("symbol", "trade_date", "gap_pct", (F.abs("gap_pct") > 2.5 * C("day_atr_pct")).alias("black_swan"),
                      (C("gap_pct") <= -0.5).alias("gap_down_day"), (F.abs("gap_pct") >= k.V5_GAP_PCT).alias("gap_day"))


__all__ = ["lookup"]
