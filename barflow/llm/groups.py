"""Connected groups of linked rows, and joins on keys of which a few may hold a large part of all rows."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.operators.stage import materialize

C = F.col
HEAVY_GROUPS = 256
SALTS = 16


SPLIT_BITS = 33
BITMAP_BYTES = 64 << 20
#: Plan nodes after which the order of rows may change from one run to the next.
UNSTABLE = ("Exchange", "InMemoryTableScan", "Sample ")


def stable(df: DataFrame) -> DataFrame:
    """``df`` itself where its rows come in the same order in every run (files, and steps that keep their order), else a table of it.

    Positions of two scans are compared, so splits must not follow the number of executors that happen to be alive, either: their least number is
    fixed for the session, at its default, if it isn't set.
    """
    spark, setting = df.sparkSession, "spark.sql.files.minPartitionNum"
    if spark.conf.get(setting, None) is None:
        spark.conf.set(setting, str(spark.sparkContext.defaultParallelism))
    plan = df._jdf.queryExecution().executedPlan().toString()
    return materialize(df) if any(node in plan for node in UNSTABLE) else df


def positioned(df: DataFrame, name: str = "row") -> DataFrame:
    """A :func:`stable` frame with the position of each row: split in the upper bits, place in it in the lower ``SPLIT_BITS``."""
    return df.withColumn(name, F.monotonically_increasing_id())


def bitmaps(rows: DataFrame, row: str = "row") -> DataFrame:
    """One line per split: a bit for each of its positions up to the last that ``rows`` lists, 64 to a number, in order."""
    at = C(row).bitwiseAND((1 << SPLIT_BITS) - 1)
    bits = rows.select(F.shiftright(row, SPLIT_BITS).alias("split"), F.shiftright(at, 6).alias("word"), at.bitwiseAND(63).cast("int").alias("bit"))
    bits = bits.groupBy("split", "word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits"))
    gaps = bits.groupBy("split").agg(F.max("word").alias("last")).select("split", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("word"), F.lit(0).cast("long").alias("bits"))
    full = bits.unionByName(gaps).groupBy("split", "word").agg(F.expr("bit_or(bits)").alias("bits"))
    return full.groupBy("split").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).getField("bits").alias("words"))


def at_rows(df: DataFrame, rows: DataFrame, row: str = "row", limit: int = BITMAP_BYTES) -> DataFrame:
    """The rows of ``df`` (with its position ``row``) whose positions the one column of ``rows`` lists.

    They are found by a bitmap, an eighth of a byte per row of the input, which is broadcast after a check of its size: nothing of ``df`` moves. Beyond
    ``limit`` bytes both sides are joined on the position.
    """
    wanted = rows.toDF("_kept_row")
    marks = materialize(bitmaps(wanted, "_kept_row").toDF("_kept_split", "_kept_words"))
    size = marks.agg(F.sum(8 * F.size("_kept_words"))).first()[0] or 0
    if size > limit:
        return df.join(wanted, C(row) == C("_kept_row"), "left_semi")
    at = C(row).bitwiseAND((1 << SPLIT_BITS) - 1)
    word = F.get("_kept_words", F.shiftright(at, 6).cast("int"))
    here = df.join(F.broadcast(marks), F.shiftright(row, SPLIT_BITS) == C("_kept_split"))
    return here.where(F.getbit(word, at.bitwiseAND(63).cast("int")) == 1).drop("_kept_split", "_kept_words")


def keep_rows(df: DataFrame, kept: DataFrame, limit: int = BITMAP_BYTES) -> DataFrame:
    """The rows of a :func:`stable` frame at the positions that ``kept`` lists in its only column."""
    at = "_position"
    while at in df.columns:
        at += "_"
    return at_rows(positioned(df, at), kept, at, limit).drop(at)


def join_groups(rows: DataFrame, groups: DataFrame, keys: Sequence[str], size: str) -> DataFrame:
    """Inner join of rows with one row per group. The ``HEAVY_GROUPS`` largest groups go by broadcast (a bounded number of short rows), so
    that no task gathers the rows of a group that holds a third of the table; all others join on their keys."""
    rest = [c for c in groups.columns if c not in keys]
    heavy = groups.orderBy(C(size).desc(), *keys).limit(HEAVY_GROUPS).withColumnsRenamed({c: f"_heavy_{c}" for c in rest})
    marked = rows.join(F.broadcast(heavy), list(keys), "left")
    here = C(f"_heavy_{size}").isNotNull()
    found = marked.where(here).withColumnsRenamed({f"_heavy_{c}": c for c in rest})
    others = marked.where(~here).drop(*(f"_heavy_{c}" for c in rest)).join(groups, list(keys))
    return found.unionByName(others)


def salted(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links with the line of their node ``u``; the neighbours of a hub are dealt over ``SALTS`` tasks."""
    return (links.withColumn("_salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
            .join(nodes.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALTS))))), ["u", "_salt"]).drop("_salt"))


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (smallest node of its connected group) of every node of the edges ``a``, ``b``.

    Union-find as alternating stars: every node hands its larger neighbours to its smallest one, then its smaller neighbours, until every
    link leads to a root. Each round is written to the shared folder; rounds grow with the logarithm of a group's diameter.
    """
    links = materialize(edges.where(C("a") != C("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while not links.isEmpty():
        both = links.unionByName(links.select(C("v").alias("u"), C("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("low")).select("u", F.least("u", "low").alias("low"))
        large = salted(both, low).where(C("v") > C("u")).select(C("v").alias("u"), C("low").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = salted(large, low).select(F.explode(F.array(F.struct(C("u"), C("low").alias("v")), F.struct(C("v").alias("u"), C("low").alias("v")))).alias("e"))
        links = materialize(small.select("e.u", "e.v").where(C("u") != C("v")).distinct())
        # Done when no node hangs below two others, and none that others hang below hangs itself.
        ends = links.select(C("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            links.select(C("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where((C("up") > 1) | ((C("up") == 1) & (C("down") == 1))).isEmpty():
            break
    roots = links.select(C("v").alias("node"), C("v").alias("component")).distinct()
    return links.select(C("u").alias("node"), C("v").alias("component")).unionByName(roots)
