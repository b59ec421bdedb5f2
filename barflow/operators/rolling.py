"""Rolling-window vocabulary: full-window aggregates, lags, differences, session and forward frames."""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from barflow.operators.chunks import CHUNK

C = F.col


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


class Roller:
    """Ordered windows over one partitioning, so that all of them share a single sort."""

    def __init__(self, keys: Sequence[str] = ("symbol", CHUNK), order: Sequence[str] = ("dt",),
                 session: str = "trade_date"):
        self.keys, self.order, self.session_col = list(keys), list(order), session
        self.base = Window.partitionBy(*self.keys).orderBy(*self.order)
        self.day = Window.partitionBy(*self.keys, session).orderBy(*self.order)

    def roll(self, fn: Callable, x: Column | str, n: int, min_rows: int | None = None) -> Column:
        """``fn`` over the last n rows; NULL until ``min_rows`` (default n) non-null values are in the frame."""
        frame = self.base.rowsBetween(-(n - 1), 0)
        need = n if min_rows is None else min_rows
        return F.when(F.count(col(x)).over(frame) >= need, fn(col(x)).over(frame))

    def frame(self, start: int, end: int):
        return self.base.rowsBetween(start, end)

    def lag(self, x: Column | str, n: int = 1) -> Column:
        return F.lag(col(x), n).over(self.base)

    def lead(self, x: Column | str, n: int = 1) -> Column:
        return F.lead(col(x), n).over(self.base)

    def diff(self, x: Column | str, n: int = 1) -> Column:
        return col(x) - self.lag(x, n)

    def change(self, x: Column | str, n: int = 1) -> Column:
        """Relative change over n rows, NULL where the old value is missing or zero."""
        old = self.lag(x, n)
        return F.when(old != 0, col(x) / old - 1)

    def session(self, fn: Callable, x: Column | str, running: bool = True) -> Column:
        """``fn`` over the session so far, or over the whole session."""
        if running:
            return fn(col(x)).over(self.day.rowsBetween(Window.unboundedPreceding, 0))
        return fn(col(x)).over(Window.partitionBy(*self.keys, self.session_col))


def flag(cond: Column) -> Column:
    """1 where the condition holds, 0 where it is false or unknown."""
    return F.when(cond, 1).otherwise(0)


def clip(x: Column, lo: float | Column, hi: float | Column) -> Column:
    lo = lo if isinstance(lo, Column) else F.lit(lo)
    hi = hi if isinstance(hi, Column) else F.lit(hi)
    return F.when(x.isNotNull(), F.greatest(lo, F.least(hi, x)))
