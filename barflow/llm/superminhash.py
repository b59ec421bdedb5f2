"""Near duplicates by SuperMinHash: signatures, bands, exact verification, union-find.

Every shingle walks a random permutation of the ``SLOTS`` slots; at step j it bids j plus a random fraction for its j-th slot, and
a slot keeps the lowest bid. Bids of a later step are higher than all of an earlier one, so the walk of a whole text stops
at the first step after which all its slots are taken. The permutation is never stored: a place is found from the swaps before it.

1. Texts with equal shingle sets form a class; its first row stands for all. Only representatives go on.
2. ``BANDS`` bands of ``ROWS`` slots are bucket keys. In ``STAR_ROUNDS`` rounds every member of a bucket is paired with the bucket's hub, the member
   with most links so far: no more pairs than members. Pairs are confirmed on the full sets, made from the whole texts again. Linked
   classes are grouped.
3. Buckets that still hold several groups get all pairs across groups compared, in cells of about ``CELL`` members.
4. Before texts are fetched for a pair, the join tests three things. Set sizes must allow the limit. Parity sketches (a bit for each of 1,024 hash
   values, flipped by every shingle) differ in no more bits than the sets in shingles, which bounds the difference from below. Neither
   test loses a link. A sketch of two bits a slot must agree as often as at the limit.

So every pair that shares a bucket is either in one group already or decided. A pair at the limit of 0.75 shares none of the 32 buckets
with probability (1 - 0.75^4)^32, 5 in a million, and the sketch test errs in less than one of a million pairs at the limit.

Defined cases: null text, or text without words, has an empty set and is linked with nothing; a text of fewer than five words has its whole
sequence as one shingle; the smallest key names the group, null keys come last; rows with equal key and text are one document (in
``deduplicate`` one row of them stays); an empty table gives an empty result; only the named columns are read.
"""
from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.blocks import BASE, SPACES, Block, blocks, byte_flags, mix, owners, salts, span_hashes, spans, windows
from barflow.llm.groups import at_rows, components, join_groups, keep_rows, positioned, stable
from barflow.operators.stage import materialize

C = F.col
SHINGLE_WORDS = 5
SLOTS, BANDS, ROWS = 128, 32, 4
PERCENT = 75
CELL = 1024
STAR_ROUNDS = 2
#: Slots whose two bits differ: at the limit 24 of 128 are expected, with a deviation of 4.4.
SKETCH_SLOTS = 46
SKETCH = ("low_a", "low_b", "high_a", "high_b")
PARITY_BITS = 1024
PARITY = tuple(f"parity_{i}" for i in range(PARITY_BITS // 64))
FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_sets(block: Block, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and where each begins."""
    starts, ends, first = spans(block, byte_flags(SPACES))
    words = span_hashes(block.data, starts, ends, lower=True)
    found, begin = windows(words, first, size)
    count = np.diff(first)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        factor = salts(size, 11)
        with np.errstate(over="ignore"):
            total = count[short].astype(np.uint64) * np.uint64(BASE)
            for j in range(size - 1):
                has = count[short] > j
                total[has] += words[first[short[has]] + j] * factor[j]
            whole = mix(total)
        at = begin[short]
        found = np.insert(found, at, whole)
        begin = begin + np.concatenate([[0], np.cumsum((count > 0) & (count < size))])
    each = [np.unique(found[a:b]) for a, b in zip(begin[:-1], begin[1:])]
    return (np.concatenate(each) if each else found), np.concatenate([[0], np.cumsum([len(x) for x in each], dtype=np.int64)])


def signatures(hashes: np.ndarray, begin: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signature of each set: step in the upper byte, random fraction below."""
    n = len(begin) - 1
    lowest = np.full(n * slots, FREE)
    owner, picks, salt = owners(begin), [], salts(slots, 29)
    for step in range(slots):
        if not len(hashes):
            break
        with np.errstate(over="ignore"):
            random = mix(hashes + salt[step])
            fraction = mix(random + np.uint64(BASE)) >> np.uint64(8)
        pick = (step + random % np.uint64(slots - step)).astype(np.int64)
        place = pick.copy()
        for earlier in range(step - 1, -1, -1):  # what an earlier swap has put there
            place[place == picks[earlier]] = earlier
        np.minimum.at(lowest, owner * slots + place, np.uint64(step << 56) | fraction)
        picks.append(pick)
        waits = (lowest.reshape(n, slots) == FREE).any(axis=1)[owner]
        if not waits.all():
            hashes, owner, picks = hashes[waits], owner[waits], [p[waits] for p in picks]
    return lowest.reshape(n, slots)


def banded(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    with np.errstate(over="ignore"):
        mixed = (signature[:, :bands * rows].reshape(-1, bands, rows) * salts(rows, 31)).sum(axis=2, dtype=np.uint64)
        return mix(mixed + salts(bands, 37)).view(np.int64)


def parities(sets: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Parity sketch of each set: bit b tells whether an odd number of its shingles hash to b."""
    n = len(begin) - 1
    place = owners(begin) * PARITY_BITS + (mix(sets ^ np.uint64(BASE)) % np.uint64(PARITY_BITS)).astype(np.int64)
    odd = (np.bincount(place, minlength=n * PARITY_BITS) & 1).astype(np.uint8).reshape(n, PARITY_BITS)
    return np.packbits(odd, axis=1).view(np.int64)


def prints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, position, set size, set digest (two sums over the shingles), band keys, sketches."""
    kind = df.schema[key].dataType.simpleString()

    def work(batches):
        for batch in batches:
            for block in blocks(batch.column(1)):
                sets, begin = shingle_sets(block)
                signature = signatures(sets, begin)
                with np.errstate(over="ignore"):
                    total = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(sets ^ s))]) for s in salts(2, 41)]
                    digest = [(t[begin[1:]] - t[begin[:-1]]).view(np.int64) for t in total]
                keys = banded(signature)
                random = mix(signature)
                bits = np.concatenate([np.packbits((random >> np.uint64(k) & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64) for k in (0, 1)]
                                      + [parities(sets, begin)], axis=1)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(block.first_row, len(block)) for c in (0, 2)), pa.array(np.diff(begin)), *map(pa.array, digest),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel())),
                    *(pa.array(np.ascontiguousarray(bits[:, i])) for i in range(bits.shape[1]))],
                    ["doc_id", "row", "n_shingles", "d1", "d2", "bands", *SKETCH, *PARITY])
    source = positioned(df.select(C(key).alias("doc_id"), C(text).alias("text")))
    return source.mapInArrow(work, f"doc_id {kind}, row bigint, n_shingles bigint, d1 bigint, d2 bigint, bands array<bigint>, "
                              + ", ".join(f"{c} bigint" for c in (*SKETCH, *PARITY)))


def confirmed(texts: DataFrame, pairs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs of rows (``a``, ``b``) whose full shingle sets reach the limit; ``texts`` has ``row`` and ``text``."""
    if pairs.isEmpty():
        return pairs

    def sets_of(column: pa.Array):
        for block in blocks(column):
            sets, begin = shingle_sets(block)
            yield from (sets[i:j] for i, j in zip(begin[:-1], begin[1:]))

    def work(batches):
        hub = np.zeros(0, np.uint64)
        for batch in batches:
            heads = batch.column(2).is_valid().to_numpy(zero_copy_only=False)
            hubs, good = sets_of(batch.column(2).drop_null()), []
            for head, mine in zip(heads, sets_of(batch.column(3))):
                hub = next(hubs) if head else hub
                p, q = (hub, mine) if len(hub) <= len(mine) else (mine, hub)
                place = np.searchsorted(q, p)
                place[place == len(q)] = 0
                shared = int((q[place] == p).sum()) if len(q) else 0
                good.append(bool(shared) and 100 * shared >= percent * (len(p) + len(q) - shared))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in (0, 1)], ["a", "b"])
    # A row with many partners meets them in cells, so its text goes out once per cell; texts of rows in no pair don't move.
    cells = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / CELL).alias("cells"))
    dealt = join_groups(pairs, cells, ["a"], "cells").select("a", "b", F.pmod(F.xxhash64("b"), C("cells")).alias("cell"))
    right = at_rows(texts, pairs.select("b")).select(C("row").alias("b"), C("text").alias("text_b"))
    left = at_rows(texts, pairs.select("a")).select(C("row").alias("a"), C("text").alias("text_a")).join(cells, "a")
    left = left.select("a", "text_a", F.explode(F.sequence(F.lit(0).cast("long"), C("cells") - 1)).alias("cell"))
    both = dealt.join(right, "b").join(left, ["a", "cell"])
    # Only the first row of a cell carries the text that its rows share.
    head = F.row_number().over(Window.partitionBy("a", "cell").orderBy("b")) == 1
    both = both.withColumn("text_a", F.when(head, F.coalesce("text_a", F.lit(""))))
    return materialize(both.select("a", "b", "text_a", "text_b").mapInArrow(work, "a bigint, b bigint"))


def bucket_members(reps: DataFrame) -> DataFrame:
    """Members of the buckets that hold more than one representative: bucket, rep, set size, sketches."""
    by = Window.partitionBy("bucket")
    keys = reps.select("rep", F.explode("bands").alias("bucket")).withColumns({"lo": F.min("rep").over(by), "hi": F.max("rep").over(by)})
    # Sketches are fetched for these only: most buckets hold a single member.
    return keys.where(C("lo") < C("hi")).select("rep", "bucket").join(reps.drop("bands"), "rep")


def may_link(other: str):
    """Whether sizes and sketches of a row and of the row with ``other`` before its column names allow the limit; not yet in one group."""
    def differ(half):
        return C(f"low_{half}").bitwiseXOR(C(f"{other}low_{half}")).bitwiseOR(C(f"high_{half}").bitwiseXOR(C(f"{other}high_{half}")))
    a, b = C("n_shingles"), C(f"{other}n_shingles")
    apart = reduce(add, [F.bit_count(C(c).bitwiseXOR(C(f"{other}{c}"))) for c in PARITY])
    return ((C("component") != C(f"{other}component")) & (100 * F.least(a, b) >= PERCENT * F.greatest(a, b))
            & ((100 + PERCENT) * apart <= (100 - PERCENT) * (a + b)) & (F.bit_count(differ("a")) + F.bit_count(differ("b")) <= SKETCH_SLOTS))


def star_pairs(members: DataFrame) -> DataFrame:
    """Members of a bucket with its hub, where they may link."""
    seen = ("rep", "component", "n_shingles", *SKETCH, *PARITY)
    hubs = members.groupBy("bucket").agg(F.max(F.struct(C("links"), (-C("rep")).alias("order"), *seen)).alias("hub"))
    hubs = hubs.select("bucket", *(C(f"hub.{c}").alias(f"hub_{c}") for c in seen))
    return members.join(hubs, "bucket").where(may_link("hub_")).select(F.least("rep", "hub_rep").alias("a"), F.greatest("rep", "hub_rep").alias("b")).distinct()


def crossing_pairs(members: DataFrame, cell: int = CELL) -> DataFrame:
    """Pairs of one bucket that are in different groups and may link."""
    mixed = (members.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("n"))
             .where(C("lo") < C("hi")).select("bucket", F.ceil(C("n") / cell).alias("parts")))
    dealt = members.join(mixed, "bucket").withColumn("part", F.pmod(F.xxhash64("rep"), C("parts")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), C("parts") - 1)))
    seen = ("part", "rep", "component", "n_shingles", *SKETCH, *PARITY)
    dealt = dealt.select("bucket", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), *seen)
    right = dealt.select("bucket", "x", "y", *(C(c).alias(f"to_{c}") for c in seen))
    return (dealt.join(right, ["bucket", "x", "y"])
            .where((C("rep") < C("to_rep")) & ((C("x") == C("y")) | (C("part") != C("to_part"))) & may_link("to_"))
            .select(C("rep").alias("a"), C("to_rep").alias("b")).distinct())


def linked(df: DataFrame, reps: DataFrame, text: str) -> DataFrame:
    """``node`` and ``component`` of all representatives that are linked with another."""
    members = materialize(bucket_members(reps))
    # Whole texts of the members, found where they are once for all rounds.
    texts = materialize(at_rows(positioned(df.select(C(text).alias("text"))), members.select("rep")))
    alone = members.withColumn("component", C("rep"))
    tried, links = None, None
    for _ in range(STAR_ROUNDS):
        if links is None:
            tried = materialize(star_pairs(alone.withColumn("links", F.lit(0))))
            links = confirmed(texts, tried)
            continue
        degree = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
        ranked = alone.join(degree, "rep", "left").withColumn("links", F.coalesce("links", F.lit(0)))
        pairs = materialize(star_pairs(ranked).join(tried, ["a", "b"], "left_anti"))
        tried = tried.unionByName(pairs)
        links = links.unionByName(confirmed(texts, pairs))
    found = components(links)
    now = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    more = confirmed(texts, materialize(crossing_pairs(now).join(tried, ["a", "b"], "left_anti")))
    return found if more.isEmpty() else components(found.select(C("node").alias("a"), C("component").alias("b")).unionByName(more))


def grouped(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, position, set size, first document of its group (struct ``first``: key and position)."""
    marks = materialize(prints(df, key, text))
    same = ["d1", "d2", "n_shingles"]
    own = F.struct(C("doc_id").isNull().alias("unnamed"), C("doc_id"), C("row"))
    classes = materialize(marks.where(C("n_shingles") > 0).groupBy(*same).agg(F.min("row").alias("rep"), F.count(F.lit(1)).alias("members"),
                                                                              F.min(own).alias("first")))
    reps = materialize(marks.select(C("row").alias("rep"), "n_shingles", "bands", *SKETCH, *PARITY).join(classes.select("rep"), "rep", "left_semi"))
    found = linked(df, reps, text).withColumnRenamed("node", "rep")
    placed = classes.join(found, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    heads = placed.groupBy("component").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("classes"))
    named = materialize(join_groups(placed.drop("first"), materialize(heads), ["component"], "classes").select(*same, "members", "first"))
    rows = marks.select("doc_id", "row", *same)
    empty = rows.where(C("n_shingles") == 0).select("doc_id", "row", "n_shingles", own.alias("first"))
    return join_groups(rows.where(C("n_shingles") > 0), named, same, "members").select("doc_id", "row", "n_shingles", "first").unionByName(empty)


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, set size, smallest key of its group, whether it is that one."""
    return grouped(stable(df), key, text).select("doc_id", "n_shingles", C("first.doc_id").alias("component_id"), C("doc_id").eqNullSafe(C("first.doc_id")).alias("kept"))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group, with all its columns."""
    df = stable(df)
    return keep_rows(df, grouped(df, key, text).where(C("row") == C("first.row")).select("row"))
