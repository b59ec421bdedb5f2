"""The last few values of a key as a small array, with any / all facts about all of its values."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

C = F.col


def last_values(df: DataFrame, key: str, order: str, value: str, n: int, high: float = 90.0, buckets: int = 64) -> DataFrame:
    """``recent`` holds the last n values in order.  Rows are cut to n per (key, salt) before the final n are picked, so a
    hot key is spread over ``buckets`` tasks and no array grows with the data."""
    salted = df.withColumn("_b", F.pmod(F.xxhash64(order), F.lit(buckets)))
    rank = F.row_number().over(Window.partitionBy(key, "_b").orderBy(F.desc(order)))
    top = salted.withColumn("_r", rank).where(C("_r") <= n)
    row = F.struct(order, value)
    arrays = top.groupBy(key).agg(F.array_sort(F.collect_list(row)).alias("_a"))  # at most n * buckets rows per key
    facts = df.groupBy(key).agg(F.max(value).alias("_max"), F.min(value).alias("_min"))
    out = arrays.join(facts, key)
    recent: Column = F.transform(F.slice("_a", F.greatest(F.lit(1), F.size("_a") - n + 1), F.lit(n)), lambda x: x[value])
    return out.select(key, recent.alias("recent"), (C("_max") > high).alias("any_high"), (C("_min") > 0).alias("all_pos"))
