"""Training sequences by lexical retrieval: a sharded BM25 inverted index gives each seed document unused neighbours to fill its window.

Documents are encoded once and staged. Document frequencies, number and mean length of documents are counted over all of them; the
counts are as many as the vocabulary has entries. Shards hold about ``SHARD_TOKENS`` tokens each, so their number grows with the input and
the work of a task does not. Inside a shard every document is indexed by its token ids.

A document's full windows become sequences of their own. The rests are seeds, longest first: all distinct ids of the seed score the
unused documents of the shard, whole neighbours that fit are taken in the order of their score, and the best of those left is cut to
close the window. What remains of a shard at the end is cut into powers of two, so no sequence needs padding.

Defined cases: null and empty texts hold the end token alone; equal scores go to the earlier row; repeated rows and null keys are
documents of their own; a document longer than a shard's share is still whole in one shard; an empty table gives no pieces.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.blocks import blocks
from barflow.llm.bpe import encode_block, prepared, shared_tables
from barflow.operators.stage import materialize

SHARD_TOKENS = 4 << 20
WINDOW = 4096
DENSE = 8  # ids that more than one in so many documents of a shard hold have a weight for every document, 0 included
K1, B = 1.2, 0.75
VOCABULARY = 1 << 16


def tokenised(df: DataFrame, tables, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: key, position in the input, ids with the end token, as little-endian 16-bit numbers. ``tables`` is the encoder's broadcast."""
    kind = df.schema[key].dataType.simpleString()
    last = np.uint16(end_id).tobytes()

    def work(batches):
        known = prepared(tables.value)
        for batch in batches:
            for block in blocks(batch.column(1)):
                ids, offsets = encode_block(block, known)
                each = [ids[offsets[i]:offsets[i + 1]].tobytes() + last for i in range(len(block))]
                yield pa.RecordBatch.from_arrays([batch.column(c).slice(block.first_row, len(block)) for c in (0, 2)] + [pa.array(each, pa.binary())],
                                                 ["doc_id", "row", "ids"])
    source = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("row"))
    return source.mapInArrow(work, f"doc_id {kind}, row bigint, ids binary")


def document_frequencies(docs: DataFrame) -> np.ndarray:
    """Number of documents that hold each id, over all documents; one number for each entry of the vocabulary."""
    def count(batches):
        seen = np.zeros(VOCABULARY, np.int64)
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.column(0).slice(begin, 256).to_pylist()
                held = np.zeros((len(part), VOCABULARY), np.uint8)
                for i, x in enumerate(part):
                    held[i, np.frombuffer(x, np.uint16)] = 1
                seen += held.sum(axis=0, dtype=np.int64)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(seen[some], pa.int64())], ["id", "n"])
    out = np.zeros(VOCABULARY, np.int64)
    for row in docs.select("ids").mapInArrow(count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row["id"]] = row["n"]
    return out


class Index:
    """BM25 postings of one shard."""

    def __init__(self, docs: list[np.ndarray], frequency: np.ndarray, documents: int, mean_length: float):
        sizes = np.array([len(d) for d in docs])
        key = np.concatenate(docs).astype(np.int64) << 32 | np.repeat(np.arange(len(docs)), sizes)
        key, times = np.unique(key, return_counts=True)
        self.term, self.doc = key >> 32, key & 0xFFFFFFFF
        self.rarity = np.log1p((documents - frequency + 0.5) / (frequency + 0.5))
        self.weight = self.rarity[self.term] * times * (K1 + 1) / (times + K1 * (1 - B + B * sizes[self.doc] / mean_length))
        self.begin = np.searchsorted(self.term, np.arange(VOCABULARY + 1))
        self.size = len(docs)
        frequent = np.flatnonzero(np.diff(self.begin) * DENSE > self.size)
        self.dense = dict(zip(frequent.tolist(), np.zeros((len(frequent), self.size))))
        for t, row in self.dense.items():
            part = slice(self.begin[t], self.begin[t + 1])
            row[self.doc[part]] = self.weight[part]

    def scores(self, doc: np.ndarray) -> np.ndarray:
        """Scores of all documents of the shard for all distinct ids of ``doc``."""
        out = np.zeros(self.size)
        for t in np.unique(doc).tolist():
            row = self.dense.get(t)
            if row is None:
                part = slice(self.begin[t], self.begin[t + 1])
                out[self.doc[part]] += self.weight[part]
            else:
                out += row
        return out


def pack_shard(docs: list[np.ndarray], frequency: np.ndarray, documents: int, mean_length: float, window: int = WINDOW):
    """Pieces (document, start, length, sequence, offset) of one shard."""
    pieces, sequence = [], 0
    start, left = np.zeros(len(docs), np.int64), np.array([len(d) for d in docs], np.int64)
    for i in np.flatnonzero(left >= window):
        while left[i] >= window:
            pieces.append((i, start[i], window, sequence, 0))
            start[i] += window
            left[i] -= window
            sequence += 1
    index = Index(docs, frequency, documents, mean_length)
    total = int(left.sum())
    for seed in np.argsort(-left, kind="stable"):
        if not left[seed] or total < window:
            continue
        room, offset = window, 0

        def take(i, n):
            nonlocal room, offset, total
            pieces.append((i, start[i], n, sequence, offset))
            start[i] += n
            left[i] -= n
            offset += n
            room -= n
            total -= n
        take(seed, left[seed])
        scores = index.scores(docs[seed])
        unused = np.flatnonzero(left)
        ranked = unused[np.argsort(-scores[unused], kind="stable")]
        at = 0
        while room and at < len(ranked):
            fits = np.flatnonzero(left[ranked[at:]] <= room)
            if not len(fits):
                break
            at += int(fits[0])
            take(ranked[at], left[ranked[at]])
            at += 1
        if room:  # cut the best of those left; each of them is longer than the room, or there is none
            for i in ranked:
                if room and left[i]:
                    take(i, min(left[i], room))
        sequence += 1
    rest = [i for i in range(len(docs)) if left[i]]
    total = int(total)
    size, offset = 1 << max(0, total.bit_length() - 1), 0
    for i in rest:
        while left[i]:
            n = min(left[i], size - offset)
            pieces.append((i, start[i], n, sequence, offset))
            start[i] += n
            left[i] -= n
            offset += n
            total -= n
            if offset == size and total:
                sequence, size, offset = sequence + 1, 1 << (int(total).bit_length() - 1), 0
    return pieces


def packed(df: DataFrame, path: str, end_id: int = 2, window: int = WINDOW, key: str = "doc_id", text: str = "text", shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Per piece: key, ids of the document before it (``start``), ``length``, its ids (little-endian 32-bit numbers), the document's
    tokens, sequence and offset in it."""
    tables = shared_tables(df.sparkSession, path)
    docs = materialize(tokenised(df, tables, end_id, key, text))
    tables.unpersist()  # workers needn't hold the encoder while they pack
    documents, tokens = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("ids")), F.lit(0)) / 2).first()
    frequency = docs.sparkSession.sparkContext.broadcast(document_frequencies(docs))  # VOCABULARY numbers
    shards, mean = max(1, -(-int(tokens) // shard_tokens)), max(1.0, tokens / max(1, documents))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        shard = table.column("shard")[0].as_py()
        ids = [np.frombuffer(x, np.uint16) for x in table.column("ids").to_pylist()]
        pieces = pack_shard(ids, frequency.value, documents, mean, window)
        doc, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces))
        body = [ids[d][s:s + n].astype("<u4").tobytes() for d, s, n, _, _ in pieces]
        pa.default_memory_pool().release_unused()
        return pa.table({"doc_id": table.column("doc_id").take(pa.array(doc)), "start": start, "length": length, "ids": pa.array(body, pa.binary()),
                         "doc_tokens": np.array([len(x) for x in ids], np.int64)[doc], "sequence_id": (shard << 32) + sequence, "offset": offset})
    dealt = docs.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(
        pack, f"doc_id {kind}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint")
