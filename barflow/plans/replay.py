"""Exit replay: recorded entries walked over their option bars, first exit by rule priority.

Per position the running peak and the bar number come from windows, each rule is a boolean of its row, and the exit is the
first bar with a rule that holds.  The only state that changes the rules, the half exit at target, flips once per position:
it is the first bar that reaches the target with nothing exiting on or before it, found first and then applied.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow import constants as k
from barflow.functions import pricing
from barflow.operators.chunks import CHUNK, chunked
from barflow.operators.scans import running
from barflow.operators.stage import materialize

C = F.col
BARS_PER_PART = 4096


def _ordinal(time: Column, bucket: str) -> Column:
    """Number of the time bucket, without gaps."""
    if bucket == "month":
        return (F.year(time) * 12 + F.month(time)).cast("long")
    if bucket == "day":
        return F.unix_date(F.to_date(time)).cast("long")
    return F.floor(F.unix_seconds(time.cast("timestamp")) / 3600)


def _doubled(table: DataFrame, by: list[str], order: str, levels: int) -> DataFrame:
    """Sparse table: at level k the maximum and minimum of 2^k consecutive rows from each row on."""
    w = Window.partitionBy(*by).orderBy(order)
    out = table.withColumns({"_h0": C("hi"), "_l0": C("lo")})
    for n in range(1, levels):
        step = 1 << (n - 1)
        out = out.withColumns({f"_h{n}": F.greatest(f"_h{n - 1}", F.lead(f"_h{n - 1}", step).over(w)), f"_l{n}": F.least(f"_l{n - 1}", F.lead(f"_l{n - 1}", step).over(w))})
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), C(f"_h{n}").alias("hi"), C(f"_l{n}").alias("lo")) for n in range(levels)]))
    return out.select(*by, C(order).alias("start"), cells.alias("_c")).select(*by, "start", "_c.*")


def range_extremes(positions: DataFrame, bars: DataFrame, *, pos: str = "trade_no", key: str = "symbol", start: str = "entry_ts", end: str = "exit_ts",
                   time: str = "dt", bucket: str = "month") -> DataFrame:
    """Number of bars, highest high and lowest low between start and end of each position, by a two-level range index.

    Bars are numbered within their (key, time bucket). A range is at most three runs: bars of its first bucket, whole buckets, bars of its last one.
    Any run is covered by two overlapping blocks of a power of two, which sparse tables of bars and of buckets hold, so a position looks up six rows
    at most, however many bars it spans. Positions find their bar numbers by a running count over bars and positions together: no pairs.
    """
    b = bars.select(key, C(time).alias("_t"), _ordinal(C(time), bucket).alias("part"), C("high").alias("hi"), C("low").alias("lo"))
    p = positions.where(C(end) >= C(start)).select(pos, key, C(start).alias("_s"), C(end).alias("_e"), _ordinal(C(start), bucket).alias("_p0"), _ordinal(C(end), bucket).alias("_p1"))
    # Bars before the start and up to the end, within their buckets.
    events = (b.select(key, "part", "_t", F.lit(1).alias("kind"), F.lit(1).alias("one"), F.lit(None).cast(p.schema[pos].dataType).alias(pos))
              .unionByName(p.select(key, C("_p0").alias("part"), C("_s").alias("_t"), F.lit(0).alias("kind"), F.lit(0).alias("one"), pos))
              .unionByName(p.select(key, C("_p1").alias("part"), C("_e").alias("_t"), F.lit(2).alias("kind"), F.lit(0).alias("one"), pos)))
    count = F.sum("one").over(Window.partitionBy(key, "part").orderBy("_t", "kind").rowsBetween(Window.unboundedPreceding, 0))
    found = events.withColumn("n", count).where("kind <> 1").groupBy(pos).agg(F.max(F.when(C("kind") == 0, C("n"))).alias("_i0"), F.max(F.when(C("kind") == 2, C("n"))).alias("_i1"))
    # Buckets of each key, without gaps, and how many bars lie before them.
    full = b.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n"), F.max("hi").alias("hi"), F.min("lo").alias("lo"))
    span = full.groupBy(key).agg(F.min("part").alias("_first"), F.max("part").alias("_last"))
    grid = span.select(key, F.explode(F.sequence("_first", "_last")).alias("part")).join(full, [key, "part"], "left")
    so_far = F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, 0))
    grid = materialize(grid.withColumn("upto", so_far))
    most = grid.agg(F.max("n").alias("rows"), F.max(C("part")).alias("hi"), F.min(C("part")).alias("lo")).first()  # three numbers
    row_levels, top_levels = max(1, int(most["rows"] or 1).bit_length()), max(1, int((most["hi"] or 0) - (most["lo"] or 0) + 1).bit_length())
    number = (F.row_number().over(Window.partitionBy(key, "part").orderBy("_t")) - 1).cast("long")
    index = (_doubled(b.withColumn("i", number), [key, "part"], "i", row_levels).withColumn("top", F.lit(False))
             .unionByName(_doubled(grid, [key], "part", top_levels).withColumns({"top": F.lit(True), "part": F.lit(0).cast("long")})))
    here = (p.join(found, pos).join(span, key)
            .join(grid.select(key, C("part").alias("_p0"), C("n").alias("_n0"), C("upto").alias("_u0")), [key, "_p0"], "left")
            .withColumns({"_a": F.greatest(C("_p0") + 1, C("_first")), "_z": F.least(C("_p1") - 1, C("_last"))})
            .join(grid.select(key, C("part").alias("_a"), (C("upto") - F.coalesce("n", F.lit(0))).alias("_ua")), [key, "_a"], "left")
            .join(grid.select(key, C("part").alias("_z"), C("upto").alias("_uz")), [key, "_z"], "left"))
    one_bucket, zero = C("_p0") == C("_p1"), F.lit(0).cast("long")

    def run(top: bool, part: Column, low: Column, high: Column, when: Column, n: Column):
        return F.when(when & (low <= high), F.struct(F.lit(top).alias("top"), part.alias("part"), low.cast("long").alias("low"), high.cast("long").alias("high"), n.cast("long").alias("n")))
    runs = [run(False, C("_p0"), C("_i0"), F.when(one_bucket, C("_i1")).otherwise(C("_n0")) - 1, C("_n0").isNotNull(), F.when(one_bucket, C("_i1")).otherwise(C("_n0")) - C("_i0")),
            run(True, zero, C("_a"), C("_z"), ~one_bucket, C("_uz") - C("_ua")), run(False, C("_p1"), zero, C("_i1") - 1, ~one_bucket, C("_i1"))]
    asked = here.select(pos, key, F.explode(F.filter(F.array(*runs), lambda r: r.isNotNull())).alias("_r")).select(pos, key, "_r.*")
    level = F.length(F.bin(C("high") - C("low") + 1)) - 1
    blocks = asked.withColumn("level", level).select(pos, key, "top", "part", "level", F.explode(F.array(
        F.struct(C("low").alias("start"), C("n")), F.struct((C("high") - F.expr("shiftleft(1L, level)") + 1).alias("start"), zero.alias("n")))).alias("_b")).select("*", "_b.*").drop("_b")
    hits = blocks.join(index, [key, "top", "part", "level", "start"])
    return hits.groupBy(pos).agg(F.sum("n").alias("bars"), F.max("hi").alias("highest"), F.min("lo").alias("lowest")).where("bars > 0")


def position_state(marks: DataFrame, bars_per_part: int = BARS_PER_PART) -> DataFrame:
    """Bars held, peak, gains and previous ATR ratio per row.  A position is cut into parts of so many bar numbers: a part's maximum and count go to the
    later ones by a table of parts, and the row before a part comes along as halo, so a position of any length is no task of its own."""
    part = dict(keys=["position"], order="bar", bucket=bars_per_part)
    out = running(marks, {"_n": F.lit(1)}, {"_top": C("ltp")}, **part)
    before = F.lag("atr_ratio").over(Window.partitionBy("position", CHUNK).orderBy("bar"))
    out = chunked(out, lambda d: d.withColumn("_prev_ratio", F.coalesce(before, F.lit(1.0))), 1, rows_per_chunk=bars_per_part, **part)
    out = out.withColumns({"bars_held": C("_n").cast("int"), "peak": F.greatest("entry", "_top")}).drop("_n", "_top")
    return out.withColumns({"gain": C("ltp") - C("entry"), "pnl_pct": F.try_divide(C("ltp") - C("entry"), C("entry")),
                            "mfe": F.greatest(F.lit(0.0), C("peak") - C("entry")), "peak_gain": F.try_divide(C("peak") - C("entry"), C("entry"))})


def _paper_rules(stop: Column, partial: Column) -> list[tuple[str, Column]]:
    exp, normal, hold, mod = C("is_expiry"), ~C("is_expiry"), C("hold_mins"), C("minute_of_day")
    ltp, peak, entry = C("ltp"), C("peak"), C("entry")
    mfe_floor = F.greatest(F.lit(1.0), F.least(F.lit(k.MFE_PTS), C("atr_14") * 0.15))
    base = (F.when(exp, F.when(C("peak_gain") > 0, peak * (1 - 0.015)).when(mod >= 225, peak * (1 - 0.15)).otherwise(stop))
            .otherwise(F.when(C("peak_gain") >= 0.05, peak * (1 - 0.06)).otherwise(stop)))
    trail = F.greatest(stop, base, F.when(partial & (C("peak_gain") >= 0), peak * (1 - 0.04)).otherwise(stop))
    dist, top = entry - stop, peak - entry
    take = F.when(top >= dist * 2.0, ltp < entry + top * 0.50).when((C("bars_held") >= 5) & (top >= dist), ltp < entry + top * 0.33).otherwise(False)
    return [("EXPIRY_FORCE_EXIT", exp & (mod >= k.EXPIRY_FORCE_EXIT)), ("TIME_EXIT", mod >= 360),
            ("MAX_HOLD_EXIT", exp & (hold >= k.EXPIRY_MAX_HOLD)),
            ("ZERO_MFE_EXIT", normal & (hold >= k.MFE_BARS) & (C("mfe") < mfe_floor)),
            ("MAX_HOLD_EXIT", normal & (((hold >= 25) & (C("pnl_pct") < 0)) | (hold >= 45))),
            ("TRAIL_STOP", (ltp <= trail) & (trail > stop)), ("STOP_LOSS", ltp <= stop), ("TRAIL_TAKE_PROFIT", (dist > 0) & take),
            ("TARGET", (ltp >= C("target")) & (partial | (C("contracts") <= 1))),
            ("EXPANSION_FAILURE", (C("bars_held") >= 15) & (C("atr_ratio") < 0.60) & (C("_prev_ratio") < 0.60) & (C("pnl_pct") < 0))]


def _live_rules(stop: Column, partial: Column) -> list[tuple[str, Column]]:
    exp, normal, hold, mod = C("is_expiry"), ~C("is_expiry"), C("hold_mins"), C("minute_of_day")
    ltp, peak, g = C("ltp"), C("peak"), C("peak_gain")
    early = F.when(C("entry") > 150, -0.02).otherwise(0.0)
    trail = (F.when(exp, F.when(g > 0, peak * (1 - 0.015)).when(mod >= 225, peak * (1 - 0.15)).otherwise(stop))
             .otherwise(F.when(g > 0.10, peak * (1 - 0.08)).when(g > 0.05, peak * (1 - 0.12)).when(g > 0, peak * (1 - 0.20))
                        .when(mod >= 270, peak * (1 - 0.25)).when(mod >= 210, peak * (1 - 0.32)).otherwise(stop)))
    trail = F.greatest(stop, trail)
    return [("EXPIRY_FORCE_EXIT", exp & (mod >= k.EXPIRY_FORCE_EXIT)), ("MAX_HOLD_EXIT", exp & (hold >= k.EXPIRY_MAX_HOLD)),
            ("MAX_HOLD_EXIT", normal & (((hold >= 3) & (C("pnl_pct") < early)) | (hold >= 30))), ("TRAIL_STOP", (ltp <= trail) & (trail > stop)),
            ("STOP_LOSS", ltp <= stop), ("TARGET", ltp >= C("target")), ("TIME_EXIT_EOD", mod >= 360)]


def _first_exit(state: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    reason = F.coalesce(*[F.when(cond, name) for name, cond in rules])
    hits = state.withColumn("exit_reason", reason).where(C("exit_reason").isNotNull())
    pick = F.min_by(F.struct("bar", "ltp", "exit_reason", "bars_held", "mfe", "peak"), "bar")
    return hits.groupBy("position").agg(pick.alias("_x")).select("position", "_x.*")


def exit_replay(marks: DataFrame, table: str = "paper") -> DataFrame:
    """First exit of each position under the ``paper`` or ``live`` rule table; positions still open have no row.

    Rows need position, bar, ltp, entry, stop, target, contracts, is_expiry, hold_mins, minute_of_day, atr_14, atr_ratio.
    """
    state = materialize(position_state(marks))
    if table == "live":
        return _first_exit(state, _live_rules(C("stop"), F.lit(False))).withColumn("partial_bar", F.lit(None).cast("int"))
    plain = _first_exit(state, _paper_rules(C("stop"), F.lit(False)))
    # Bar of the half exit: target reached with two or more contracts before any other rule ended the position.
    touch = state.where((C("ltp") >= C("target")) & (C("contracts") > 1)).groupBy("position").agg(F.min("bar").alias("_touch"))
    both = state.select("position").distinct().join(touch, "position", "left").join(plain.select("position", C("bar").alias("_out")), "position", "left")
    half = both.select("position", F.when(C("_touch").isNotNull() & (C("_out").isNull() | (C("_touch") < C("_out"))), C("_touch")).alias("partial_bar"))
    rich = state.join(half, "position", "left")
    after = C("partial_bar").isNotNull() & (C("bar") > C("partial_bar"))
    live = rich.where(C("partial_bar").isNull() | after).withColumn("_stop", F.when(after, C("entry")).otherwise(C("stop")))
    out = _first_exit(live, _paper_rules(C("_stop"), after))
    return out.join(half, "position", "left")


def attribution(trades: DataFrame) -> DataFrame:
    """Directional and theta parts of a closed trade's result, in points and money."""
    up = C("direction") == "UP"
    move = F.when((C("spot_entry") > 0) & (C("spot_exit") > 0), F.when(up, C("spot_exit") - C("spot_entry")).otherwise(C("spot_entry") - C("spot_exit"))).otherwise(0.0)
    left = F.greatest(F.lit(30.0), C("dte_mins") - C("bars"))
    out = trades.withColumn("_move", move)
    out = out.withColumns({"theta_pts": C("bars") * pricing.dynamic_theta(left), "dir_pts": C("_move") * pricing.effective_delta(C("bars"), C("_move"), C("atr"), C("direction"))})
    return out.withColumns({"theta_rs": C("theta_pts") * C("qty"), "dir_rs": C("dir_pts") * C("qty")}).drop("_move")



