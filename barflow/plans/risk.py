"""Risk audits: for each entry, which limit was in force, from the closed trades known by then."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow import constants as k
from barflow.functions.costs import rupees
from barflow.operators.chunks import BUCKET, time_bucket
from barflow.operators.scans import running
from barflow.operators.stage import materialize

C = F.col


ORDER = ["ts", "kind", "trade_no"]


def timeline(ledger: DataFrame, scope: tuple[str, ...] = ("account",)) -> DataFrame:
    """Entries and exits of a scope in one time order (an exit comes before an entry at the same instant), in one pass over the ledger."""
    value, is_entry = C("entry_price") * C("qty"), C("kind") == 1
    both = ledger.select(*scope, "trade_no", "entry_ts", "exit_ts", "net_p", value.alias("value"), "is_closed", F.explode(F.array(F.lit(1), F.lit(0))).alias("kind"))
    return both.where(is_entry | C("is_closed")).select(
        *scope, F.when(is_entry, C("entry_ts")).otherwise(C("exit_ts")).alias("ts"), "kind", "trade_no",
        F.when(is_entry, F.lit(0).cast("bigint")).otherwise(C("net_p")).alias("net_p"),
        F.when(is_entry, C("value")).otherwise(-C("value")).alias("value")).withColumn("day", F.to_date("ts"))


def _levels(line: DataFrame, scope, bucket: str, order) -> tuple:
    """Rows with their bucket, the keys of a part (a bucket within a day), the window inside parts, and the one over the parts before a part."""
    part = [*scope, "day", BUCKET]
    inner = Window.partitionBy(*part).orderBy(*order)
    before = Window.partitionBy(*scope).orderBy(F.asc_nulls_last("day"), F.asc_nulls_last(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    return line.withColumn(BUCKET, time_bucket("ts", bucket)), part, inner, before


def _with_carry(rows: DataFrame, carry: DataFrame, part: list[str]) -> DataFrame:
    """Rows beside what came before their part. The table of parts is bounded by the calendar; it is written, so that its size is known to the join."""
    carry = materialize(carry.withColumnsRenamed({p: f"_in_{p}" for p in part}))
    same = reduce(lambda x, y: x & y, [C(p).eqNullSafe(C(f"_in_{p}")) for p in part])
    return rows.join(carry, same, "left").drop(*[f"_in_{p}" for p in part])


def loss_streaks(ledger: DataFrame, scope: tuple[str, ...] = ("account",), trigger: int = k.V5_LOSSES, minutes: int = k.V5_COOLDOWN,
                 daily: bool = False, bucket: str = "day") -> DataFrame:
    """Consecutive losses after each exit and the cool-down a streak of ``trigger`` starts.

    Exits are numbered inside their part and written once; the parts say how many came before and which of them was no loss.
    """
    closed = ledger.where("is_closed").select(*scope, C("exit_ts").alias("ts"), F.lit(0).alias("kind"), "trade_no", "net_p",
                                              (-C("entry_price") * C("qty")).alias("value"), F.to_date("exit_ts").alias("day"))
    tagged, part, inner, before = _levels(closed, scope, bucket, ["ts", "trade_no"])
    if daily:
        before = Window.partitionBy(*scope, "day").orderBy(F.asc_nulls_last(BUCKET)).rowsBetween(Window.unboundedPreceding, -1)
    local = tagged.withColumn("_pos", F.row_number().over(inner).cast("bigint"))
    held = F.when(F.coalesce(C("net_p") <= 0, F.lit(False)), None).otherwise(C("_pos"))
    local = materialize(local.withColumn("_kept", F.max(held).over(inner)))
    totals = local.groupBy(*part).agg(F.max("_pos").alias("_n"), F.max("_kept").alias("_top"))
    start = F.coalesce(F.sum("_n").over(before), F.lit(0))
    carry = totals.withColumn("_start", start).select(*part, "_start", F.max(C("_start") + C("_top")).over(before).alias("_stop"))
    out = _with_carry(local, carry, part)
    out = out.withColumn("consec_losses", (C("_start") + C("_pos") - F.coalesce(F.greatest(C("_stop"), C("_start") + C("_kept")), F.lit(0))).cast("int"))
    return (out.withColumn("cooldown_until", F.when(C("consec_losses") >= trigger, C("ts") + F.expr(f"INTERVAL {minutes} MINUTE")))
            .drop(BUCKET, "_pos", "_kept", "_start", "_stop"))


def state_at_entries(ledger: DataFrame, scope: tuple[str, ...] = ("account",), trigger: int = k.V5_LOSSES, minutes: int = k.V5_COOLDOWN,
                     bucket: str = "day", window: int = k.V5_WR_WINDOW) -> DataFrame:
    """One row per entry with the day's trades, wins, losses and net so far, loss streak, cool-down end, recent win rate and exposure.

    The timeline is dealt and sorted once, by parts (buckets within days). Inside a part all is counted as if nothing had come before; entries and
    the last row of each part are written. What came before a part (sums, loss streak, last results, cool-down) is a scan over those last rows,
    and is put to the entries where they lie. So no trade is joined with the trades before it, and nothing is shuffled a second time.
    """
    tagged, part, inner, before = _levels(timeline(ledger, scope), scope, bucket, ORDER)
    so_far = inner.rowsBetween(Window.unboundedPreceding, 0)
    is_exit, is_entry = C("kind") == 0, C("kind") == 1
    won = F.coalesce(C("net_p") > 0, F.lit(False))
    kept = ~F.coalesce(C("net_p") <= 0, F.lit(False))
    over = f"OVER (PARTITION BY {', '.join(f'`{p}`' for p in part)} ORDER BY {', '.join(ORDER)})"
    results = [F.expr(f"lag(_result, {i}) IGNORE NULLS {over}") for i in range(window - 1, 0, -1)]
    local = tagged.withColumn("_result", F.when(is_exit, F.when(won, "1").otherwise("0"))).withColumns({
        "trades_closed": F.count(F.when(is_exit, 1)).over(so_far), "wins": F.count(F.when(is_exit & won, 1)).over(so_far),
        "losses": F.count(F.when(is_exit & (C("net_p") <= 0), 1)).over(so_far), "entries": F.count(F.when(is_entry, 1)).over(so_far),
        "day_net_p": F.sum("net_p").over(so_far), "open_positions": F.sum(F.when(is_entry, 1).otherwise(-1)).over(so_far),
        "exposure": F.sum("value").over(so_far), "_is_last": F.lead(F.lit(1)).over(inner).isNull(),
        **{f"_r{i}": r for i, r in enumerate(results)}})
    # Number of the part's last and first exit that was no loss, and the latest results as a text of 0 and 1.
    stop = F.when(is_exit & kept, C("trades_closed"))
    mine = F.when(is_exit, F.concat(*[F.coalesce(f"_r{i}", F.lit("")) for i in range(window - 1)], "_result"))
    local = local.withColumns({"_stop": F.max(stop).over(so_far), "_first": F.min(stop).over(so_far), "_tail": F.last(mine, True).over(so_far)})
    # Last exit that closes a streak of its own part, and last one before any win, whose streak may have begun before the part.
    streak = C("trades_closed") - F.coalesce("_stop", F.lit(0))
    local = local.withColumns({"_cool": F.max(F.when(is_exit & (streak >= trigger), C("ts"))).over(so_far),
                               "_open": F.max(F.when(is_exit & C("_first").isNull(), C("ts"))).over(so_far)})
    local = materialize(local.where(is_entry | C("_is_last")).drop("net_p", "_result", *[f"_r{i}" for i in range(window - 1)]))

    def cooled(entering: Column) -> Column:
        """Last exit with a streak of ``trigger``, where ``entering`` losses in a row came before the part."""
        leading = F.coalesce(C("_first") - 1, C("trades_closed"))
        return F.greatest(C("_cool"), F.when(entering + leading >= trigger, C("_open")))

    totals = local.where("_is_last")
    today = Window.partitionBy(*scope, "day").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("trades_closed").over(before), F.lit(0))
    totals = totals.withColumn("_c_start", start).withColumn("_c_stop", F.coalesce(F.max(C("_c_start") + C("_stop")).over(before), F.lit(0)))
    # Each part with exits has one result at least, so those of the parts just before it suffice.
    near = Window.partitionBy(*scope, C("_tail").isNull()).orderBy(F.asc_nulls_last("day"), F.asc_nulls_last(BUCKET)).rowsBetween(-(window - 1), 0)
    totals = totals.withColumn("_end", F.when(C("_tail").isNotNull(), F.right(F.array_join(F.collect_list("_tail").over(near), ""), F.lit(window))))
    daily, overall = ["trades_closed", "wins", "losses", "entries", "day_net_p"], ["open_positions", "exposure"]
    carry = totals.select(
        *part, "_c_start", "_c_stop", F.max(cooled(C("_c_start") - C("_c_stop"))).over(before).alias("_c_cool"),
        F.coalesce(F.last("_end", True).over(before), F.lit("")).alias("_c_tail"), *[F.sum(c).over(today).alias(f"_c_{c}") for c in daily],
        *[F.sum(c).over(before).alias(f"_c_{c}") for c in overall])
    out = _with_carry(local.where(is_entry), carry, part)
    recent = F.right(F.concat("_c_tail", F.coalesce("_tail", F.lit(""))), F.lit(window))
    rate = F.when(F.length(recent) >= window, F.length(F.replace(recent, F.lit("0"), F.lit(""))).cast("double") / window)
    out = out.withColumns({
        "consec_losses": (C("_c_start") + C("trades_closed") - F.greatest(C("_c_stop"), C("_c_start") + C("_stop"))).cast("int"),
        "cooldown_until": F.greatest(C("_c_cool"), cooled(C("_c_start") - C("_c_stop"))) + F.expr(f"INTERVAL {minutes} MINUTE"), "recent_wr": rate})
    out = out.withColumns({c: F.coalesce(C(f"_c_{c}"), F.lit(0)) + C(c) for c in (*daily, *overall)})
    out = out.withColumns({"open_positions": C("open_positions") - 1, "exposure": C("exposure") - C("value"), "entries": C("entries") - 1})
    return out.drop(BUCKET, *[c for c in out.columns if c.startswith("_")])


def audit_v5(state: DataFrame, gap_day: Column) -> DataFrame:
    """Session limits in priority order: daily loss, trade cap (one on a gap day), cool-down, recent win rate."""
    cap = F.when(gap_day, k.V5_GAP_TRADES).otherwise(k.V5_MAX_TRADES)
    rules = [("DAILY_LOSS", C("day_net_p") <= -k.V5_DAY_LOSS * 100), ("TRADE_CAP", C("trades_closed") >= cap),
             ("LOSS_COOLDOWN", C("cooldown_until") > C("ts")), ("WIN_RATE", C("recent_wr") < k.V5_WR_MIN)]
    return state.withColumn("risk_block", F.coalesce(*[F.when(c, n) for n, c in rules]))


def audit_v4(state: DataFrame, equity: Column, atr: Column, atr_mean: Column, mins_since_gap: Column, mins_since_flip: Column, micro: Column,
             agreement: Column, regime: Column, paper: bool = False) -> DataFrame:
    """Kill-switch rules in order, one boolean each and the first that holds; the flip rule yields to a strong breakout."""
    limit = k.DAILY_DD_PAPER if paper else k.DAILY_DD_LIVE
    losses = k.CONSEC_PAPER if paper else k.CONSEC_LIVE
    breakout = (micro == "BREAKOUT") & (agreement >= k.VRECOVERY_AGREE)
    trending = micro.isin("TRENDING_UP", "TRENDING_DN") & (agreement >= k.VRECOVERY_AGREE - 1e-6)
    rules = {"daily_dd": rupees(C("day_net_p")) / (equity + 1e-9) <= -limit,
             "loss_cooldown": (C("consec_losses") >= losses) & (C("cooldown_until") > C("ts")),
             "vol_shock": (atr_mean > 0) & (atr > 0) & (atr / (atr_mean + 1e-9) > k.VOL_SHOCK),
             "black_swan": mins_since_gap < 45, "regime_flip": (mins_since_flip < k.FLIP_MIN) & ~breakout,
             "crisis": (regime == k.CRISIS) & ~trending}
    out = state.withColumns({n: F.coalesce(c, F.lit(False)) for n, c in rules.items()})
    return out.withColumn("risk_block", F.coalesce(*[F.when(C(n), n) for n in rules]))


def session_controls(state: DataFrame, gap_day: Column) -> DataFrame:
    """Trade cap with its bonus trade, daily loss limit and observation mode."""
    cap = F.when(gap_day, 1).when((C("trades_closed") == k.SESSION_CAP) & (C("consec_losses") == 0) & (C("wins") >= 2), k.SESSION_CAP + 1).otherwise(k.SESSION_CAP)
    rules = [("SESSION_CAP", C("trades_closed") >= cap), ("DAILY_LOSS_LIMIT", C("day_net_p") <= -k.V5_DAY_LOSS * 100),
             ("CONSEC_LOSS_COOLDOWN", C("cooldown_until") > C("ts")), ("OBSERVATION_MODE", C("recent_wr") < k.V5_WR_MIN)]
    return state.withColumn("session_block", F.coalesce(*[F.when(c, n) for n, c in rules]))


def concentration(state: DataFrame, capital: float = k.CAPITAL) -> DataFrame:
    """Open positions and exposure before each entry against the caps."""
    many = C("open_positions") >= k.MAX_POSITIONS
    big = C("exposure") + C("value") > capital * k.MAX_EXPOSURE
    return state.withColumn("concentration_block", F.when(many, "MAX_POSITIONS").when(big, "MAX_EXPOSURE"))


def period_drawdown(ledger: DataFrame, capital: float = k.CAPITAL) -> DataFrame:
    """Per day: equity, drawdown since the week's and the month's start, halt and size multiplier."""
    day = ledger.where("is_closed").groupBy("file_date").agg(F.sum("net_p").alias("net_p"))
    w = Window.orderBy("file_date").rowsBetween(Window.unboundedPreceding, 0)
    out = day.withColumn("equity", rupees(F.sum("net_p").over(w)) + capital).withColumn("_open", C("equity") - rupees(C("net_p")))
    for name in ("week", "month"):
        first = F.first("_open").over(Window.partitionBy(F.date_trunc(name, "file_date")).orderBy("file_date"))
        out = out.withColumn(f"{name}_start", first).withColumn(f"{name}_dd", (C("equity") - C(f"{name}_start")) / (C(f"{name}_start") + 1e-9))
    return out.withColumns({"halt": C("month_dd") <= -k.MONTH_HALT, "size_mult": F.when(C("month_dd") <= -k.MONTH_HALT, 0.0).when(C("week_dd") <= -k.WEEK_HALVE, 0.5).otherwise(1.0)}
                           ).drop("_open")


def setup_fatigue(trades: DataFrame, limit: int = 2) -> DataFrame:
    """Losses so far of the same setup and regime that day; disabled after two. The scan reads the trades twice, so they are written first."""
    trades = materialize(trades.select("trade_no", "file_date", "setup", "regime", "exit_ts", "net_p"))
    out = running(trades, {"_l": F.when(C("net_p") < 0, 1).otherwise(0)}, keys=["file_date", "setup", "regime"], order=["exit_ts", "trade_no"], bucket="day")
    prior = C("_l") - F.when(C("net_p") < 0, 1).otherwise(0)
    return out.withColumn("prior_losses", prior.cast("int")).withColumn("disabled", C("prior_losses") >= limit).drop("_l")
