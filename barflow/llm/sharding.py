"""Shards by extendible hashing, in DataFrame functions only.

A directory maps prefixes of a 60-bit key hash to shards. It starts with one bucket; a bucket that is larger than the byte limit splits on
the next bit, and only such buckets split, so the local depth differs from shard to shard. One round looks ``ROUND_BITS`` bits
ahead: the rows of oversized buckets are summed into at most 2^8 cells a bucket, and each cell takes the first depth at which its
bucket fits. What still does not fit goes on to the next round. Only (hash, bytes) rows move; texts stay where they are.

Defined cases: null text has no bytes; rows whose keys are null or equal differ by their texts' hashes; rows equal in both can't be told
apart by any bit and share a shard, as does a single row larger than the limit: such a shard is marked ``oversized``. An empty table
gives no shards. Only the named columns are read.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.operators.stage import materialize

C = F.col
HASH_BITS = 60
ROUND_BITS = 8
SHARD_BYTES = 1 << 20


def hashed(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, 60 leading bits of an MD5 over key and text digest, and bytes of each row."""
    body = F.coalesce(C(text), F.lit(""))
    name = F.concat_ws(":", F.coalesce(C(key).cast("string"), F.lit("")), F.md5(body))
    return df.select(C(key).alias("doc_id"), F.conv(F.substring(F.md5(name), 1, HASH_BITS // 4), 16, 10).cast("long").alias("h"),
                     F.octet_length(body).cast("long").alias("bytes"))


def _bits(depth) -> F.Column:
    """First ``depth`` bits of the hash as a number."""
    return F.expr(f"shiftright(h, {HASH_BITS} - {depth})")


def extendible_shards(df: DataFrame, key: str = "doc_id", text: str = "text", limit: int = SHARD_BYTES, round_bits: int = ROUND_BITS) -> DataFrame:
    """Per row: key, bytes, shard (its prefix of the hash in binary, empty for the whole), depth, the shard's bytes and rows, ``oversized``."""
    rows = materialize(hashed(df, key, text))
    total, count = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count(F.lit(1))).first()
    if total <= limit:
        whole = rows.withColumns({"depth": F.lit(0), "prefix": F.lit(0).cast("long"), "shard_bytes": F.lit(total).cast("long"),
                                  "shard_rows": F.lit(count).cast("long")})
        return _named(whole, limit)
    done, active, depth = [], rows, 0
    while True:
        fine = min(depth + round_bits, HASH_BITS)
        cells = active.groupBy(_bits(fine).alias("cell")).agg(F.sum("bytes").alias("cell_bytes"), F.count(F.lit(1)).alias("cell_rows"))
        # Windows on nested prefixes share one shuffle, on the bucket; a bucket has 2^round_bits cells at most.
        bucket = F.shiftright("cell", fine - depth)
        cells = cells.withColumn("bucket", bucket)
        at, size, n = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long")
        for d in range(fine, depth, -1):
            w = Window.partitionBy("bucket", F.shiftright("cell", fine - d))
            cells = cells.withColumns({f"b{d}": F.sum("cell_bytes").over(w), f"r{d}": F.sum("cell_rows").over(w)})
            fits = (C(f"b{d}") <= limit) | (F.lit(d) == HASH_BITS)
            at, size, n = F.when(fits, d).otherwise(at), F.when(fits, C(f"b{d}")).otherwise(size), F.when(fits, C(f"r{d}")).otherwise(n)
        cells = materialize(cells.select("cell", at.alias("depth"), size.alias("shard_bytes"), n.alias("shard_rows")))
        placed = active.withColumn("cell", _bits(fine)).join(cells, "cell")
        fit = placed.where(C("depth").isNotNull()).withColumn("prefix", F.expr(f"shiftright(cell, {fine} - depth)"))
        done.append(fit.select("doc_id", "h", "bytes", "depth", "prefix", "shard_bytes", "shard_rows"))
        if cells.where(C("depth").isNull()).isEmpty():
            return _named(reduce(DataFrame.unionByName, done), limit)
        active, depth = placed.where(C("depth").isNull()).select("doc_id", "h", "bytes"), fine


def _named(rows: DataFrame, limit: int) -> DataFrame:
    shard = F.when(C("depth") == 0, F.lit("")).otherwise(F.expr("lpad(bin(prefix), depth, '0')"))
    return rows.select("doc_id", "bytes", shard.alias("shard"), C("depth").cast("int").alias("depth"), "shard_bytes", "shard_rows",
                       (C("shard_bytes") > limit).alias("oversized"))
