"""As-of joins and date joins.

The as-of join is a union of both sides followed by a fill: one shuffle, linear work, and because the fill is a
two-level scan no task holds a whole key.  Date joins go through a small dimension of (symbol, session) rows.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.operators.scans import backward_fill, forward_fill

C = F.col


def asof_join(left: DataFrame, right: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = ("symbol",),
              left_time: str = "dt", right_time: str = "dt", bucket: str = "day", direction: str = "backward",
              allow_equal: bool = True) -> DataFrame:
    """Add to each left row ``columns`` of the right row with the nearest time not after (or not before) its own."""
    keys = list(keys)
    payload = F.struct(*[C(c) for c in columns])
    # Side 1 sorts after side 0; equal times match when the right row comes first (backward) or last (forward).
    first = (direction == "backward") == allow_equal
    rside, lside = (0, 1) if first else (1, 0)
    lhs = left.select(*keys, C(left_time).alias("_ts"), F.lit(lside).alias("_side"), F.struct(*left.columns).alias("_row"),
                      F.lit(None).alias("_pay").cast(right.select(payload.alias("p")).schema["p"].dataType))
    rhs = right.select(*keys, C(right_time).alias("_ts"), F.lit(rside).alias("_side"),
                       F.lit(None).cast(lhs.schema["_row"].dataType).alias("_row"), payload.alias("_pay"))
    fill = forward_fill if direction == "backward" else backward_fill
    both = fill(lhs.unionByName(rhs), ["_pay"], keys=keys, order=["_ts", "_side"], bucket=bucket)
    return both.where(C("_row").isNotNull()).select("_row.*", *[C(f"_pay.{c}").alias(c) for c in columns])


def session_dates(bars: DataFrame) -> DataFrame:
    """One row per (symbol, trade_date); deduplicated inside each task before the shuffle."""
    return bars.select("symbol", "trade_date").distinct()


def _attach(bars, dim, columns, default):
    """Fill per session (calendar-bounded window), then join the sessions back to the bars."""
    past = Window.partitionBy("symbol").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    filled = {c: F.last(c, True).over(past) for c in columns}
    if default is not None:
        filled = {c: F.coalesce(x, F.lit(default)) for c, x in filled.items()}
    table = dim.select("symbol", "trade_date", *[x.alias(c) for c, x in filled.items()])
    return bars.drop(*columns).join(table, ["symbol", "trade_date"], "left")


def join_next_date(bars: DataFrame, series: DataFrame, columns: Sequence[str], *, date: str = "date",
                   default: float | None = 0.0) -> DataFrame:
    """Attach a daily series one step late: a value becomes visible on the series' own next date."""
    later = series.select(F.lead(date).over(Window.orderBy(date)).alias("trade_date"), *columns)
    dim = session_dates(bars).join(later.where(C("trade_date").isNotNull()), "trade_date", "left")
    return _attach(bars, dim, columns, default)


def join_previous_session(bars: DataFrame, daily: DataFrame, columns: Sequence[str], *, date: str = "trade_date",
                          default: float | None = 0.0, keys: Sequence[str] = ()) -> DataFrame:
    """Attach the row of session D to the next session that has bars."""
    dates = session_dates(bars)
    prev = dates.withColumn("_prev", F.lag("trade_date").over(Window.partitionBy("symbol").orderBy("trade_date")))
    src = daily.select(*keys, C(date).alias("_prev"), *columns)
    dim = prev.join(src, [*keys, "_prev"], "left")
    return _attach(bars, dim, columns, default)


def join_same_date(bars: DataFrame, daily: DataFrame, columns: Sequence[str], *, date: str = "trade_date",
                   default: float | None = None, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """Attach the row of the same session.  Whole-day values seen during the day: parity only."""
    src = daily.select(*keys, C(date).alias("trade_date"), *columns)
    return _attach(bars, session_dates(bars).join(src, [*keys, "trade_date"], "left"), columns, default)


def lookup_by_date(bars: DataFrame, table: DataFrame, column: str, default) -> DataFrame:
    """Map a date to a value with a default for unknown dates."""
    out = bars.join(table.select("symbol", "trade_date", column), ["symbol", "trade_date"], "left")
    return out.withColumn(column, F.coalesce(C(column), F.lit(default)))
