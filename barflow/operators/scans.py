"""Unbounded running values (sum, max, drawdown, streaks, fills) as two-level scans.

Level one runs inside a time bucket; level two runs over the table of bucket totals, which has one row per bucket and
is therefore bounded by the calendar.  No task ever holds a whole key.  A bucket is a unit of time, or a number of values of an integer order.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.operators.chunks import BUCKET, time_bucket

_PAST = (Window.unboundedPreceding, -1)
_SO_FAR = (Window.unboundedPreceding, 0)


def _levels(df, keys, order, bucket):
    keys = list(keys)
    first = order[0] if not isinstance(order, str) else order
    order = [order] if isinstance(order, str) else list(order)
    tagged = df.withColumn(BUCKET, time_bucket(first, bucket))
    inner = Window.partitionBy(*keys, BUCKET).orderBy(*order)
    outer = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(*_PAST) if keys else \
        Window.partitionBy(F.lit(0)).orderBy(BUCKET).rowsBetween(*_PAST)
    return tagged, inner, outer, keys + [BUCKET]


def running(df: DataFrame, sums: dict[str, Column] | None = None, maxes: dict[str, Column] | None = None, *,
            keys: Sequence[str] = ("symbol",), order: str | Sequence[str] = "dt", bucket: str = "day") -> DataFrame:
    """Add running sums and running maxima (name -> expression) over all rows of a key, in order."""
    sums, maxes = sums or {}, maxes or {}
    tagged, inner, outer, by = _levels(df, keys, order, bucket)
    so_far = inner.rowsBetween(*_SO_FAR)
    tagged = tagged.withColumns({**{f"_s_{n}": e for n, e in sums.items()}, **{f"_m_{n}": e for n, e in maxes.items()}})
    totals = tagged.groupBy(*by).agg(F.count(F.lit(1)).alias("_rows"),
                                     *[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums],
                                     *[F.max(f"_m_{n}").alias(f"_t_{n}") for n in maxes])
    carry = totals.select(*by, *[F.sum(f"_t_{n}").over(outer).alias(f"_c_{n}") for n in sums],
                          *[F.max(f"_t_{n}").over(outer).alias(f"_c_{n}") for n in maxes])
    out = tagged.join(carry, by, "left")
    add = {}
    for n in sums:
        local = F.sum(f"_s_{n}").over(so_far)
        add[n] = F.when(local.isNotNull() | F.col(f"_c_{n}").isNotNull(),
                        F.coalesce(F.col(f"_c_{n}"), F.lit(0)) + F.coalesce(local, F.lit(0)))
    for n in maxes:
        add[n] = F.greatest(F.col(f"_c_{n}"), F.max(f"_m_{n}").over(so_far))
    extra = [f"{p}{n}" for p in ("_s_",) for n in sums] + [f"_m_{n}" for n in maxes]
    return out.withColumns(add).drop(BUCKET, *extra, *[f"_c_{n}" for n in (*sums, *maxes)])


def drawdown(df: DataFrame, value: Column | str, *, keys: Sequence[str] = ("symbol",),
             order: str | Sequence[str] = "dt", bucket: str = "day", floor: float | None = None) -> DataFrame:
    """Add ``cum`` (running sum), ``peak`` (running maximum of it, not below ``floor``) and ``drawdown``."""
    tagged, inner, outer, by = _levels(df, keys, order, bucket)
    so_far = inner.rowsBetween(*_SO_FAR)
    value = F.col(value) if isinstance(value, str) else value
    local = tagged.withColumn("_v", value).withColumn("_s", F.sum("_v").over(so_far))
    totals = local.groupBy(*by).agg(F.sum("_v").alias("_tot"), F.max("_s").alias("_top"))
    carry = (totals.withColumn("_off", F.coalesce(F.sum("_tot").over(outer), F.lit(0.0)))
             .withColumn("_peak", F.max(F.col("_off") + F.col("_top")).over(outer))
             .select(*by, "_off", "_peak"))
    out = local.join(carry, by, "left").withColumn("cum", F.col("_off") + F.col("_s"))
    high = F.col("_off") + F.max("_s").over(so_far)
    bounds = [F.col("_peak"), high] + ([F.lit(floor)] if floor is not None else [])
    return (out.withColumn("peak", F.greatest(*bounds)).withColumn("drawdown", F.col("cum") - F.col("peak"))
            .drop(BUCKET, "_v", "_s", "_off", "_peak"))


def streaks(df: DataFrame, conditions: dict[str, Column], *, keys: Sequence[str] = ("symbol",),
            order: str | Sequence[str] = "dt", bucket: str = "day", first_is_zero: bool = False) -> DataFrame:
    """Length of the run of true rows ending at each row: position minus the last position where it was false."""
    pos = running(df.withColumns({f"_k_{n}": F.coalesce(c, F.lit(False)) for n, c in conditions.items()}),
                  sums={"_pos": F.lit(1)}, keys=keys, order=order, bucket=bucket)
    broken = {}
    for n in conditions:
        stop = ~F.col(f"_k_{n}")
        if first_is_zero:
            stop = stop | (F.col("_pos") == 1)
        broken[f"_b_{n}"] = F.when(stop, F.col("_pos"))
    out = running(pos, maxes=broken, keys=keys, order=order, bucket=bucket)
    return (out.withColumns({n: (F.col("_pos") - F.coalesce(F.col(f"_b_{n}"), F.lit(0))).cast("int") for n in conditions})
            .drop("_pos", *[f"_k_{n}" for n in conditions], *[f"_b_{n}" for n in conditions]))


def forward_fill(df: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = ("symbol",),
                 order: str | Sequence[str] = "dt", bucket: str = "day", default: float | None = None) -> DataFrame:
    """Carry the last known value of each column forward; ``default`` fills what stays unknown."""
    tagged, inner, outer, by = _levels(df, keys, order, bucket)
    sort_key = F.struct(*[F.col(c) for c in ([order] if isinstance(order, str) else order)])
    last = tagged.groupBy(*by).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), sort_key)).alias(f"_l_{c}")
                                     for c in columns])
    carry = last.select(*by, *[F.last(f"_l_{c}", True).over(outer).alias(f"_c_{c}") for c in columns])
    out = tagged.join(carry, by, "left")
    filled = {c: F.coalesce(F.last(c, True).over(inner.rowsBetween(*_SO_FAR)), F.col(f"_c_{c}"),
                            *([F.lit(default)] if default is not None else [])) for c in columns}
    return out.withColumns(filled).drop(BUCKET, *[f"_c_{c}" for c in columns])


def backward_fill(df: DataFrame, columns: Sequence[str], *, keys: Sequence[str] = ("symbol",),
                  order: str | Sequence[str] = "dt", bucket: str = "day") -> DataFrame:
    """Fill leading gaps from the next known value.  Looks ahead: only for parity with a non-causal original."""
    tagged, inner, _, by = _levels(df, keys, order, bucket)
    ahead = Window.partitionBy(*keys).orderBy(BUCKET).rowsBetween(1, Window.unboundedFollowing)
    sort_key = F.struct(*[F.col(c) for c in ([order] if isinstance(order, str) else order)])
    nxt = tagged.groupBy(*by).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), sort_key)).alias(f"_l_{c}")
                                    for c in columns])
    carry = nxt.select(*by, *[F.first(f"_l_{c}", True).over(ahead).alias(f"_c_{c}") for c in columns])
    out = tagged.join(carry, by, "left")
    rest = inner.rowsBetween(0, Window.unboundedFollowing)
    return (out.withColumns({c: F.coalesce(F.first(c, True).over(rest), F.col(f"_c_{c}")) for c in columns})
            .drop(BUCKET, *[f"_c_{c}" for c in columns]))
