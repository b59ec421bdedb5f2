"""Row chunking with halo: how ordered windows are run when one symbol may hold a large part of all rows.

A window partitioned by ``symbol`` alone puts a whole symbol in one task.  Finite-memory windows (a rolling
mean of n rows, a lag) do not need that: a chunk of consecutive rows plus the ``halo`` rows before it gives the
same values.  Chunk borders come from a count per (symbol, time bucket), so no row-level sort of a whole symbol is
needed; every row goes to its chunk and, as halo, to the next chunk(s) whose first rows look back at it.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK, HALO, BUCKET = "_chunk", "_halo", "_bucket"
ROWS_PER_CHUNK = 200_000


def time_bucket(order: str, unit: str | int) -> Column:
    """Bucket of a time (``hour``, ``day``, ``month``, ...) or of a number (so many values each)."""
    return F.floor(F.col(order) / unit) if isinstance(unit, int) else F.date_trunc(unit, F.col(order))


def with_chunks(df: DataFrame, halo: int, *, keys: Sequence[str] = ("symbol",), order: str = "dt",
                bucket: str | int = "day", rows_per_chunk: int | None = None, forward: bool = False) -> DataFrame:
    """Add ``_chunk`` and ``_halo``; halo rows are copies to be dropped after the windows have run.

    ``forward=True`` sends the rows *after* a chunk to it (labels look ahead).  Chunks hold about
    ``rows_per_chunk`` rows, always at least the halo, and never split a bucket, so per-session windows stay whole.
    The chunk table has one row per (key, bucket); whether it is broadcast is left to AQE, which measures it.
    """
    size = max(rows_per_chunk or ROWS_PER_CHUNK, halo, 1)
    keys = list(keys)
    tagged = df.withColumn(BUCKET, time_bucket(order, bucket))
    counts = tagged.groupBy(*keys, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    edge = F.desc(BUCKET) if forward else F.asc(BUCKET)
    before = Window.partitionBy(*keys).orderBy(edge).rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("_n").over(before), F.lit(0))
    borders = (counts.withColumn("_off", offset)
               .select(*keys, BUCKET,
                       F.floor(F.col("_off") / size).alias("_own"),
                       F.floor((F.col("_off") + F.col("_n") + F.lit(halo - 1)) / size).alias("_last")))
    out = tagged.join(borders, keys + [BUCKET], "left")
    own = F.coalesce("_own", F.lit(0).cast("long"))
    # With halo = 0 the last chunk may fall short of the own one; greatest() keeps the own copy.
    reach = F.greatest(own, F.coalesce("_last", F.lit(0).cast("long")))
    out = out.withColumn("_to", F.explode(F.sequence(own, reach)))
    return (out.withColumn(CHUNK, F.col("_to")).withColumn(HALO, F.col("_to") != own)
            .drop(BUCKET, "_own", "_last", "_to"))


def drop_halo(df: DataFrame) -> DataFrame:
    return df.where(~F.col(HALO)).drop(HALO, CHUNK)


def chunked(df: DataFrame, fn: Callable[[DataFrame], DataFrame], halo: int, **options) -> DataFrame:
    """Run ``fn`` on chunks with halo and return the real rows only."""
    return drop_halo(fn(with_chunks(df, halo, **options)))
