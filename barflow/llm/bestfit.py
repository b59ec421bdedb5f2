"""Bounded-space online best-fit packing: pieces arrive, ``OPEN`` sequences at most are open, the fullest closes first.

Open sequences are kept by their free space; a bitset has bit f set when a sequence with f free places is open, so the best fit for n tokens
is the lowest set bit from n on. A piece that fits nowhere opens a sequence; if ``OPEN`` are open, the one with the least free space closes
before. A full sequence closes at once.

Every input partition is packed where it is read, in its order but for ``AHEAD`` tokens looked ahead, which go longest first. What is
still open at its end goes to the next level, where 16 neighbouring partitions' open sequences are dissolved and packed again by the same
rule, until one task is left. A task of these levels holds ``16 * OPEN`` sequences at most; a level is a table in the shared folder.

Defined cases: null and empty texts hold the end token alone; documents of more than ``window`` tokens are cut into pieces of ``window``, the
last as long as what is left; equal free space goes to the sequence filled last; equal lengths keep the order of rows; repeated rows and null
keys are documents of their own; long texts are encoded whole; an empty table gives no pieces; only the named columns are read.
"""
from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.blocks import blocks
from barflow.llm.bpe import encode_block, prepared, shared_tables
from barflow.operators.stage import materialize

C = F.col
WINDOW = 2048
OPEN = 1024
AHEAD = 1 << 20  # at most half as many full sequences as may be open, so what one look ahead opens needn't close before shorter pieces come
FAN_IN_BITS = 4


class OpenBins:
    """Open sequences in a bitset keyed by free space. Items are (size, anything); a closed sequence is the list of its items."""

    def __init__(self, window: int = WINDOW, limit: int = OPEN):
        self.window, self.limit, self.count, self.bits = window, limit, 0, 0
        self.by_free: list[list[list]] = [[] for _ in range(window + 1)]

    def _take(self, free: int) -> list:
        found = self.by_free[free].pop()
        self.count -= 1
        if not self.by_free[free]:
            self.bits ^= 1 << free
        return found

    def _lowest(self, at_least: int) -> int:
        fits = self.bits >> at_least
        return at_least + (fits & -fits).bit_length() - 1 if fits else -1

    def add(self, item: tuple) -> Iterator[list]:
        """Place one item; gives the sequences that this closes."""
        size, free = item[0], self._lowest(item[0])
        if free >= 0:
            bin_ = self._take(free)
        else:
            if self.count >= self.limit:
                yield self._take(self._lowest(0))
            bin_, free = [], self.window
        bin_.append(item)
        free -= size
        if not free:
            yield bin_
            return
        self.by_free[free].append(bin_)
        self.bits |= 1 << free
        self.count += 1

    def rest(self) -> Iterator[list]:
        """All that is open, the fullest first."""
        while self.count:
            yield self._take(self._lowest(0))


class Writer:
    """Rows of placed pieces. A piece is (length, key, number, start, ids)."""

    def __init__(self, kind: pa.DataType, level: int, run: int):
        self.kind, self.base, self.run, self.sequence, self.rows = kind, (level << 58) | (run << 32), run, 0, []

    def put(self, sequences, is_open: bool) -> None:
        for bin_ in sequences:
            offset = 0
            for length, key, number, start, ids in bin_:
                self.rows.append((key, number, start, length, ids, self.base | self.sequence, offset, is_open, self.run))
                offset += length
            self.sequence += 1

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 9
        self.rows = []
        types = [self.kind, pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                          ["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset", "open", "run"])


def schema(kind: str) -> str:
    return f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint, open boolean, run bigint"


def place(pieces: Iterator[tuple], bins: OpenBins, out: Writer, ahead: int) -> Iterator[pa.RecordBatch]:
    """Place pieces in their order, but for ``ahead`` tokens at a time, which go longest first; gives what has closed."""
    waiting, held = [], 0

    def go():
        for item in sorted(waiting, key=lambda p: -p[0]):
            out.put(bins.add(item), False)
        return out.batch()
    for item in pieces:
        waiting.append(item)
        held += item[0]
        if held >= ahead:
            yield go()
            waiting, held = [], 0
    yield go()


def first_level(df: DataFrame, tables, end_id: int, window: int, limit: int, ahead: int, key: str, text: str) -> DataFrame:
    """Every partition encoded and packed; what is open at its end is marked. ``tables`` is the encoder's broadcast."""
    kind = df.schema[key].dataType.simpleString()
    last = np.uint16(end_id)

    def pieces(batches):
        known = prepared(tables.value)
        for batch in batches:
            for block in blocks(batch.column(1)):
                ids, offsets = encode_block(block, known)
                for i, name in enumerate(batch.column(0).slice(block.first_row, len(block)).to_pylist()):
                    doc = np.append(ids[offsets[i]:offsets[i + 1]], last)
                    for number, start in enumerate(range(0, len(doc), window)):
                        part = doc[start:start + window]
                        yield len(part), name, number, start, part.tobytes()

    def work(batches):
        first = next(batches, None)
        if first is None:
            return
        bins, out = OpenBins(window, limit), Writer(first.column(0).type, 0, TaskContext.get().partitionId())
        yield from place(pieces(chain([first], batches)), bins, out, ahead)
        out.put(bins.rest(), True)
        yield out.batch()
    return df.select(C(key).alias("doc_id"), C(text).alias("text")).mapInArrow(work, schema(kind))


def next_level(left: DataFrame, level: int, last: bool, window: int, limit: int, ahead: int) -> DataFrame:
    """Open sequences of 16 neighbours dissolved and packed again."""
    def work(table: pa.Table) -> pa.Table:
        table = table.sort_by([("run", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        run = table.column("run")[0].as_py() >> FAN_IN_BITS
        bins, out = OpenBins(window, limit), Writer(table.schema.field("doc_id").type, level, run)
        parts = zip(*(table.column(c).to_pylist() for c in ("length", "doc_id", "piece", "start", "ids")))
        closed = list(place(parts, bins, out, ahead))
        out.put(bins.rest(), not last)
        return pa.Table.from_batches([*closed, out.batch()])
    return left.groupBy(F.shiftright("run", FAN_IN_BITS)).applyInArrow(work, schema(left.schema["doc_id"].dataType.simpleString()))


def best_fit(df: DataFrame, path: str, end_id: int = 0, window: int = WINDOW, limit: int = OPEN, ahead: int = AHEAD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: key, number of the piece, ids of the document before it (``start``), ``length``, its ids (little-endian 32-bit numbers), sequence
    and offset in it."""
    tables = shared_tables(df.sparkSession, path)
    placed = materialize(first_level(df, tables, end_id, window, limit, ahead, key, text))
    tables.unpersist()  # later levels needn't hold the encoder
    last = placed.agg(F.max("run")).first()[0] or 0
    done, left, level = placed.where(~C("open")), placed.where("open"), 0
    while True:
        level, last = level + 1, last >> FAN_IN_BITS
        again = materialize(next_level(left, level, not last, window, limit, ahead))
        done, left = done.unionByName(again.where(~C("open"))), again.where("open")
        if not last:
            break

    def widen(batches):
        for batch in batches:
            wide = [np.frombuffer(x, np.uint16).astype("<u4").tobytes() for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(wide, pa.binary()), *batch.columns[5:]], batch.schema.names)
    done = done.drop("open", "run")
    return done.mapInArrow(widen, done.schema)
