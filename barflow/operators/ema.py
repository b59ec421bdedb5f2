"""Exponential moving averages without a sequential pass.

``y[t] = (1-a) y[t-1] + a x[t]`` maps a block of B rows to ``d**B * y_in + b``.  Inside a block the recurrence is a
running sum of ``x * d**-i`` (B keeps the powers in range); the value carried into a block is folded from the last few
block results, because older ones have decayed below double precision.
"""
from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barflow.operators.chunks import CHUNK

BLOCK = 256


def span_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)


def ema_halo(span: float) -> int:
    """Rows after which the start value has lost all influence at double precision."""
    return math.ceil(42.0 / -math.log1p(-span_alpha(span)))


def add_emas(df: DataFrame, emas: dict[str, tuple[str, float]], *, keys=("symbol", CHUNK), order="dt") -> DataFrame:
    """Add name -> EMA(column, span), seeded with the first value of the partition."""
    part = Window.partitionBy(*keys)
    out = df.withColumn("_i", F.row_number().over(part.orderBy(order)) - 1)
    out = out.withColumn("_blk", F.floor(F.col("_i") / BLOCK)).withColumn("_p", F.col("_i") % BLOCK)
    inside = Window.partitionBy(*keys, "_blk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = {}
    for name, (source, span) in emas.items():
        a, d = span_alpha(span), 1 - span_alpha(span)
        weight = F.when(F.col("_i") == 0, 1.0).otherwise(a)
        local[f"_y_{name}"] = (F.sum(F.col(source) * weight * F.pow(F.lit(d), -F.col("_p"))).over(inside)
                               * F.pow(F.lit(d), F.col("_p")))
    out = out.withColumns(local)
    carried = {}
    for name, (_, span) in emas.items():
        d = 1 - span_alpha(span)
        depth = max(1, math.ceil(ema_halo(span) / BLOCK))
        past = part.orderBy("_blk").rangeBetween(-depth, -1)
        ends = F.collect_list(F.when(F.col("_p") == BLOCK - 1, F.col(f"_y_{name}"))).over(past)
        carried[f"_e_{name}"] = ends
    out = out.withColumns(carried)
    done = {}
    for name, (_, span) in emas.items():
        d = 1 - span_alpha(span)
        decay = F.lit(d ** BLOCK)
        fold = F.aggregate(F.col(f"_e_{name}"), F.lit(0.0), lambda acc, y: acc * decay + y)  # noqa: B023
        done[name] = F.col(f"_y_{name}") + F.pow(F.lit(d), F.col("_p") + 1) * fold
    return out.withColumns(done).drop("_i", "_blk", "_p", *local, *carried)


def sign_of(a: Column, b: Column) -> Column:
    return F.when(a > b, 1).when(a < b, -1).otherwise(0)
