"""Exact duplicates by a tree of sorted digest runs, in DataFrame functions only.

Every input partition is a run of (digest, candidate) rows. In each round 16 neighbouring runs are merged into one: equal digests meet, the
best candidate stays and group sizes add up, so a later round never sees more than one row per digest and run. A merged run is dealt over
all partitions by its digests, written sorted to the shared folder, and read by the next round: no run ends in one task, and a lost
executor costs one round at most. Digests are verified at every level: rows meet only if SHA-256, a second hash and the length agree.

Defined cases: null text counts as empty, and all empty texts are equal; equal lengths are decided by the smallest key, null keys last;
repeated rows (same key and text) are members of one group of which one row stays in ``deduplicate``, while in ``duplicate_report``
each of them carries the key that stays; an empty table gives an empty result; only the named columns are read.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barflow.llm.groups import join_groups, keep_rows, positioned, stable
from barflow.operators.stage import materialize

C = F.col
FAN_IN_BITS = 4
WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """The text without any white space of ASCII."""
    out = F.coalesce(text, F.lit(""))
    for char in WHITE:
        out = F.replace(out, F.lit(char), F.lit(""))
    return out


def digests(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One small row per document: position in the input, run, digest with its check values, and its claim to stay."""
    bare = positioned(df.select(C(key).alias("doc_id"), normalised(C(text)).alias("bare"), F.length(F.coalesce(C(text), F.lit(""))).alias("chars")))
    bare = bare.withColumn("run", F.spark_partition_id())
    return bare.select("doc_id", "row", "run", "chars", F.unhex(F.sha2("bare", 256)).alias("sha"), F.xxhash64("bare").alias("check"),
                       F.octet_length("bare").alias("size"))


def tree_merge(runs: DataFrame, fan_in_bits: int = FAN_IN_BITS) -> DataFrame:
    """One row per distinct text: digest, check values, number of rows and the claim (struct ``best``) of the row that stays."""
    same = ["sha", "check", "size"]
    claim = F.struct((-C("chars")).alias("shorter"), C("doc_id").isNull().alias("unnamed"), C("doc_id"), C("row"))
    level = runs.select("run", *same, F.lit(1).cast("long").alias("members"), claim.alias("best"))
    last = runs.agg(F.max("run")).first()[0] or 0
    while True:
        last >>= fan_in_bits
        level = (level.groupBy(F.shiftright("run", fan_in_bits).alias("run"), *same)
                 .agg(F.sum("members").alias("members"), F.min("best").alias("best")))
        level = materialize(level.sortWithinPartitions("run", *same))
        if not last:
            return level.drop("run")


def duplicate_report(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, key that stays, group size, whether it stays, digest.

    The largest groups are joined by broadcast, a bounded number of short rows; the rest join on their digests.
    """
    docs = materialize(digests(df, key, text))
    found = join_groups(docs.drop("run", "chars"), tree_merge(docs), ["sha", "check", "size"], "members")
    return found.select("doc_id", C("best.doc_id").alias("keep_id"), C("members").alias("group_size"),
                        C("doc_id").eqNullSafe(C("best.doc_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns."""
    df = stable(df)
    return keep_rows(df, tree_merge(materialize(digests(df, key, text))).select("best.row"))
