"""Ranked lexical search: every item of a query table against all documents, over FP-trees of documents.

Items are taken in blocks of at most ``BLOCK_TERMS`` distinct terms; each block's terms are broadcast, and one pass over the whole texts leaves
each document's restricted vector: the block's terms that it holds, with their numbers. Number and lengths of documents and
document frequencies are counted over all of them.

A task collects ``TREE_DOCS`` vectors at a time, writes their terms in the order of falling document frequency and sorts them, so that documents
that share frequent terms share a path from the root; chains are one edge, and neighbours are gathered in leaves of about ``LEAF``
documents. Every node has, for its subtree, the highest frequency of each term and the lowest length norm m. A term's weight grows with its
frequency and falls with m, so these give each item an upper bound for a whole subtree. Per item the tree is walked depth first, the better
child first, and a subtree is left out only where its bound is below the tenth best score so far. Scores are exact integers.

Each tree gives at most ``k`` documents per item; they are ranked in two steps, so no task gathers an item's rows of all trees.

Defined cases: null and empty texts hold no terms and are never found; items without terms find nothing; equal scores go by ascending key,
null keys last; repeated documents and items each have rows of their own; long texts are read whole; empty tables give an empty result; only the
named columns are read.
"""
from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.blocks import Block, blocks, byte_flags, owners, spans
from barflow.llm.lexicon import SMALL, Lexicon
from barflow.operators.stage import materialize

C = F.col
K = 10
BLOCK_TERMS = 8192
TREE_DOCS, TREE_TERMS = 8192, 4 << 20
LEAF = 16
GAPS = byte_flags(bytes(c for c in range(128) if not chr(c).isalnum()))


def term_spans(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of a block, starts and ends of its terms, index of each text's first term."""
    return SMALL[block.data], *spans(block, GAPS)


def terms(text: str | None) -> list[bytes]:
    raw = (text or "").encode()
    block = Block(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), 0)
    data, starts, ends, _ = term_spans(block)
    low = data.tobytes()
    return [low[a:b] for a, b in zip(starts, ends)]


def item_blocks(items: DataFrame, key: str, text: str, limit: int) -> Iterator[tuple[list, list[Counter]]]:
    """Keys and term counts of the items, in blocks; one item of more terms is a block of its own."""
    keys, vectors, seen = [], [], set()
    for name, body in items.select(key, text).toLocalIterator():
        found = Counter(terms(body))
        if keys and (len(seen | found.keys()) > limit or len(keys) >= limit):
            yield keys, vectors
            keys, vectors, seen = [], [], set()
        keys.append(name)
        vectors.append(found)
        seen |= found.keys()
    if keys:
        yield keys, vectors


def restricted(docs: DataFrame, vocabulary: list[bytes], key: str, text: str) -> DataFrame:
    """Per document with a term: key, number of its terms, the numbers of the vocabulary's terms in it and how often each occurs."""
    shared, kind = docs.sparkSession.sparkContext.broadcast(vocabulary), docs.schema[key].dataType.simpleString()

    def work(batches):
        lexicon = Lexicon(shared.value, closed=True)
        n = max(1, len(shared.value))
        for batch in batches:
            for block in blocks(batch.column(1)):
                data, starts, ends, first = term_spans(block)
                number = lexicon.numbers(data, starts, ends)
                known = number >= 0
                pair, times = np.unique(owners(first)[known] * n + number[known], return_counts=True)
                begin = np.searchsorted(pair // n, np.arange(len(block) + 1))
                some = pa.array(np.diff(first) > 0)
                lists = [pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(v, pa.int32())) for v in (pair % n, times)]
                columns = [batch.column(0).slice(block.first_row, len(block)), pa.array(np.diff(first), pa.int64()), *lists]
                yield pa.RecordBatch.from_arrays([c.filter(some) for c in columns], ["doc_id", "n", "terms", "times"])
    return docs.select(C(key).alias("doc_id"), C(text).alias("text")).mapInArrow(work, f"doc_id {kind}, n bigint, terms array<int>, times array<int>")


def document_frequencies(vectors: DataFrame, size: int) -> np.ndarray:
    """Number of documents that hold each term of the block."""
    def count(batches):
        seen = np.zeros(size, np.int64)
        for batch in batches:
            seen += np.bincount(batch.column(0).flatten().to_numpy(), minlength=size)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(seen[some], pa.int64())], ["term", "n"])
    out = np.zeros(size, np.int64)
    for term, n in vectors.select("terms").mapInArrow(count, "term int, n bigint").groupBy("term").agg(F.sum("n")).collect():
        out[term] = n
    return out


def gain(times: np.ndarray, m: np.ndarray) -> np.ndarray:
    return np.where(times > 0, 1_000_000_000 * times // (1000 * times + 8 * m), 0)


class Tree:
    """FP-tree of documents: ``doc`` orders them so that every node is a run ``low..high``; ``term`` counts by falling frequency."""

    def __init__(self, first: np.ndarray, term: np.ndarray, times: np.ndarray, m: np.ndarray, size: int, leaf: int = LEAF):
        paths = [term[a:b].astype(">u4").tobytes() for a, b in zip(first[:-1], first[1:])]
        self.doc = np.array(sorted(range(len(paths)), key=paths.__getitem__))
        self.m = m[self.doc]
        counts = np.diff(first)[self.doc]
        self.first = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat(first[:-1][self.doc] - self.first[:-1], counts) + np.arange(self.first[-1])
        self.term, self.times = term[at], times[at]
        shared = [self._common(paths[a], paths[b]) for a, b in zip(self.doc[:-1], self.doc[1:])]
        self.low, self.high, self.children = [], [], []
        self._grow(0, len(paths), np.array(shared, np.int64), leaf)
        self.most = np.zeros((len(self.low), size), np.int32)
        self.least = np.zeros(len(self.low), np.int64)
        for node in range(len(self.low) - 1, -1, -1):  # children have higher numbers than their parent
            below = self.children[node]
            if below:
                self.most[node] = self.most[below].max(axis=0)
                self.least[node] = self.least[below].min()
            else:
                part = slice(self.first[self.low[node]], self.first[self.high[node]])
                np.maximum.at(self.most[node], self.term[part], self.times[part])
                self.least[node] = self.m[self.low[node]:self.high[node]].min()

    @staticmethod
    def _common(a: bytes, b: bytes) -> int:
        """Terms that two paths share."""
        x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
        n = min(len(x), len(y))
        differ = x[:n] != y[:n]
        return int(differ.argmax()) if differ.any() else n

    def _grow(self, low: int, high: int, shared: np.ndarray, leaf: int) -> None:
        """Nodes by branching: a run is cut where its neighbours share least; small neighbouring branches make one leaf."""
        waiting = [(low, high, -1)]
        while waiting:
            low, high, parent = waiting.pop()
            node = len(self.low)
            self.low.append(low)
            self.high.append(high)
            self.children.append([])
            if parent >= 0:
                self.children[parent].append(node)
            if high - low <= leaf:
                continue
            inside = shared[low:high - 1]
            cuts = np.concatenate([[low], np.flatnonzero(inside == inside.min()) + low + 1, [high]])
            runs, begin = [], low
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                if b - begin > leaf:
                    if a > begin:
                        runs.append((begin, a))
                    begin = a
                if b - begin > leaf:
                    runs.append((begin, b))
                    begin = b
            if begin < high:
                runs.append((begin, high))
            if runs == [(low, high)]:
                half = (low + high) // 2
                runs = [(low, half), (half, high)]
            waiting.extend((a, b, node) for a, b in runs)

    def exact(self, node: int, places: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """Scores of a leaf's documents. ``places`` maps terms to the item's own, -1 for others."""
        low, high = self.low[node], self.high[node]
        part = slice(self.first[low], self.first[high])
        own = places[self.term[part]]
        hit = np.flatnonzero(own >= 0)
        doc = np.repeat(np.arange(high - low), np.diff(self.first[low:high + 1]))[hit]
        out = np.zeros(high - low, np.int64)
        np.add.at(out, doc, weight[own[hit]] * gain(self.times[part][hit].astype(np.int64), self.m[low:high][doc]))
        return out

    def search(self, terms_: np.ndarray, weight: np.ndarray, names: list, k: int = K) -> list[tuple[int, int]]:
        """(score, document) of the best documents of an item; ``names`` decide ties."""
        places = np.full(self.most.shape[1], -1, np.int64)
        places[terms_] = np.arange(len(terms_))
        bound = (weight * gain(self.most[:, terms_].astype(np.int64), self.least[:, None])).sum(axis=1)
        best, waiting = [], [0]
        while waiting:
            node = waiting.pop()
            if bound[node] <= 0 or len(best) == k and bound[node] < best[0][0]:
                continue
            below = self.children[node]
            if below:
                waiting.extend(sorted(below, key=bound.__getitem__))
                continue
            scores = self.exact(node, places, weight)
            least = best[0][0] if len(best) == k else 1
            for i in np.flatnonzero(scores >= least):
                doc = int(self.doc[self.low[node] + i])
                entry = (int(scores[i]), Last(names[doc]), doc)
                if len(best) < k:
                    heapq.heappush(best, entry)
                else:
                    heapq.heappushpop(best, entry)
        return [(score, doc) for score, _, doc in best]


class Last:
    """Order of keys turned round, null lowest: the heap drops the largest key of equal scores first."""

    def __init__(self, key):
        self.key = key

    def __lt__(self, other):
        return self.key is None and other.key is not None if self.key is None or other.key is None else self.key > other.key

    def __eq__(self, other):
        return self.key == other.key


def found(vectors: DataFrame, item_terms: list[tuple[np.ndarray, np.ndarray]], rank: np.ndarray, documents: int, length: int, k: int,
          tree_docs: int = TREE_DOCS) -> DataFrame:
    """The best documents of each tree for each item of a block: item's number, key, score."""
    kind, shared = vectors.schema["doc_id"].dataType.simpleString(), vectors.sparkSession.sparkContext.broadcast((item_terms, rank))

    def trees(batches):
        held, docs, size = [], 0, 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, min(tree_docs - docs, 1024))
                held.append(part)
                at += part.num_rows
                docs += part.num_rows
                size += len(part.column(2).flatten())
                if docs >= tree_docs or size >= TREE_TERMS:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held, docs, size = [], 0, 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks()

    def work(batches):
        wanted, order = shared.value
        for table in trees(batches):
            n, lists = table.column("n").to_numpy(), table.column("terms").combine_chunks()
            counts = np.diff(lists.offsets.to_numpy())
            m = np.array([25 + 75 * x * documents // length for x in n.tolist()], np.int64)
            owner = np.repeat(np.arange(len(n)), counts)
            term = order[lists.flatten().to_numpy()]
            by = np.lexsort((term, owner))
            tree = Tree(np.concatenate([[0], np.cumsum(counts)]), term[by], table.column("times").combine_chunks().flatten().to_numpy()[by], m, len(order))
            names = table.column("doc_id").to_pylist()
            rows = [(item, doc, score) for item, (own, weight) in enumerate(wanted) if len(own) for score, doc in tree.search(order[own], weight, names, k)]
            if rows:
                item, doc, score = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), table.column("doc_id").combine_chunks().take(pa.array(doc)), pa.array(score, pa.int64())],
                                                 ["item", "doc_id", "score"])
    return vectors.mapInArrow(work, f"item int, doc_id {kind}, score bigint")


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each item: first within parts of its rows, then of those."""
    order = [C("score").desc(), C("doc_id").asc_nulls_last()]
    parts = rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(64)))
    few = parts.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(C("rank") <= k).drop("rank", "part")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(C("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text",
           block_terms: int = BLOCK_TERMS, tree_docs: int = TREE_DOCS) -> DataFrame:
    """Per item: its ``k`` best documents with a score above 0 (item_id, rank, doc_id, score)."""
    spark = docs.sparkSession
    item_type, kind = items.schema[item_key].dataType.simpleString(), docs.schema[key].dataType.simpleString()
    out = [spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {kind}, score bigint")]
    for keys, vectors in item_blocks(items, item_key, item_text, block_terms):
        vocabulary = sorted(set().union(*vectors))
        number = {w: i for i, w in enumerate(vocabulary)}
        held = materialize(restricted(docs, vocabulary, key, text))
        documents, length = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not documents:
            break
        df = document_frequencies(held, len(vocabulary))
        weight = [math.floor(1000 * math.log((2 * documents + 2) / (2 * d + 1))) for d in df.tolist()]
        item_terms = [(np.array([number[w] for w in v], np.int64), np.array([weight[number[w]] * times for w, times in v.items()], np.int64)) for v in vectors]
        rank = np.empty(len(vocabulary), np.int64)
        rank[np.argsort(-df, kind="stable")] = np.arange(len(vocabulary))
        best = ranked(materialize(found(held, item_terms, rank, documents, length, k, tree_docs)), k)
        names = spark.createDataFrame(list(enumerate(keys)), f"item int, item_id {item_type}")
        out.append(best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, out)
