"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is labelled good or bad. A line's potentials come from its own features and from those of the lines before and after it;
transition weights tie neighbouring labels. Forward-backward gives each line's marginal probability of being good; a document's quality is
their mean, weighted by the lines' lengths, put on the scale of the labels by a logistic fit.

In fitting, the lines of a document carry its label. Parameters are fitted by gradient steps on the likelihood of whole label chains, over a bounded sample
(``FIT_ROWS`` documents a class, ``FIT_CHARS`` characters, ``FIT_LINES`` lines each). Scoring reads all lines of the whole text.

Defined cases: null and empty texts, and those without words, have no line and the quality 0 before the logistic fit; rows are scored one by one,
so repeated rows and null keys give rows of their own; without fitting documents of both classes every score is the share of good ones
among them (1 when there are none); an empty table gives an empty result; only key and text are read.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.blocks import SPACES, Block, blocks, byte_flags, counts_within, owners, span_hashes, spans, windows
from barflow.llm.samples import fit_logistic, held_out, labelled, score

C = F.col
FIT_ROWS = 2000
FIT_CHARS = 20_000
FIT_LINES = 256
STEPS = 150
THRESHOLD = 0.3
SHARES = ("symbols", "marks", "capitals", "repeated_neighbours", "repeated_windows", "repeated_line", "digits")
OWN = (*SHARES, "log_words", "word_length")


def line_features(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line with a word (its own, then those of the line before and after), lengths, and each text's first line."""
    data = block.data
    starts, ends, first = spans(block, byte_flags(b"\n"))
    solid = np.concatenate([[0], np.cumsum(~byte_flags(SPACES)[data])])
    worded = solid[ends] > solid[starts]
    first = np.concatenate([[0], np.cumsum(worded)])[first]
    starts, ends = starts[worded], ends[worded]
    n = len(starts)
    if not n:
        return np.zeros((0, len(OWN) + 2 * len(SHARES) + 2)), np.zeros(0), first

    def among(flags: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[b] - total[a]

    def bytes_in(chars: bytes) -> np.ndarray:
        return among(byte_flags(chars)[data], starts, ends)
    w_start, w_end, w_first = spans(block, byte_flags(SPACES))
    a, b = np.searchsorted(w_start, starts), np.searchsorted(w_start, ends)
    words = b - a
    hashes = span_hashes(data, w_start, w_end, lower=True)
    same = np.zeros(len(hashes), bool)
    same[1:] = hashes[1:] == hashes[:-1]
    same[w_first[:-1][w_first[:-1] < len(same)]] = False
    grams, g_first = windows(hashes, w_first, 3)
    often, _ = counts_within(grams, owners(g_first))
    gram_words = np.repeat(w_first[:-1] - g_first[:-1], np.diff(g_first)) + np.arange(len(grams))
    repeated = np.zeros(len(hashes), bool)
    repeated[gram_words[often > 1]] = True
    copies, _ = counts_within(span_hashes(data, starts, ends, seed=13), owners(first))
    capitals, letters = bytes_in(bytes(range(65, 91))), bytes_in(bytes(range(65, 91)) + bytes(range(97, 123)))
    size = solid[ends] - solid[starts]
    shares = np.stack([np.minimum(bytes_in(b"#*$%&|<>") / words, 4), np.minimum(bytes_in(b"!") / words, 4), capitals / np.maximum(letters, 1),
                       among(same, a, b) / words, among(repeated, a, b) / words, copies > 1, bytes_in(b"0123456789") / size], axis=1)
    own = np.column_stack([shares, np.log1p(words), np.log1p(size / words)])
    head, tail = np.zeros(n, bool), np.zeros(n, bool)
    head[first[:-1][np.diff(first) > 0]] = True
    tail[first[1:][np.diff(first) > 0] - 1] = True
    before, after = np.roll(shares, 1, axis=0), np.roll(shares, -1, axis=0)
    before[head], after[tail] = 0, 0
    return np.column_stack([own, before, after, head, tail]).astype(float), size.astype(float), first


class Chains:
    """Lines of several documents in step order: step t holds the t-th line of each document that has one, longest documents first."""

    def __init__(self, first: np.ndarray):
        length = np.diff(first)
        self.order = np.argsort(-length, kind="stable")
        self.length = length[self.order]
        steps = int(self.length[0]) if len(length) else 0
        self.active = np.searchsorted(-self.length, -np.arange(steps), "left")
        begin = first[:-1][self.order]
        self.lines = [begin[:n] + t for t, n in enumerate(self.active)]

    def marginals(self, unary: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(good) of every line, and the expected number of each transition. ``unary`` is the potential of good against bad."""
        steps, size = len(self.lines), len(unary)
        node = np.empty((size, 2))
        bounded = np.clip(unary, -30, 30)
        node[:, 1] = 1 / (1 + np.exp(-bounded))
        node[:, 0] = 1 - node[:, 1]
        node = np.maximum(node, 1e-13)
        edge = np.exp(transition - transition.max())
        forward, backward = np.empty((size, 2)), np.ones((size, 2))
        for t, at in enumerate(self.lines):
            f = node[at] if not t else (forward[self.lines[t - 1][:len(at)]] @ edge) * node[at]
            forward[at] = f / f.sum(axis=1, keepdims=True)
        counts = np.zeros((2, 2))
        for t in range(steps - 2, -1, -1):
            after = self.lines[t + 1]
            at = self.lines[t][:len(after)]
            message = node[after] * backward[after]
            b = message @ edge.T
            joint = forward[at][:, :, None] * edge * message[:, None, :]
            counts += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            backward[at] = b / b.sum(axis=1, keepdims=True)
        both = forward * backward
        return both[:, 1] / both.sum(axis=1), counts


def fit_chain(x: np.ndarray, first: np.ndarray, good: np.ndarray, weight: np.ndarray, ridge: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """Unary weights (intercept first) and the transition table, by adaptive gradient steps. ``good`` holds the documents' labels."""
    x = np.column_stack([np.ones(len(x)), x])
    line_label = np.repeat(good, np.diff(first)).astype(float)
    groups = [(v, np.flatnonzero(good == v)) for v in (0, 1)]
    heavy = {v: float(weight[d].mean()) if len(d) else 0.0 for v, d in groups}
    line_weight = np.where(line_label == 1, heavy[1], heavy[0])
    seen = np.zeros((2, 2))
    for v, d in groups:
        seen[v, v] = heavy[v] * np.maximum(np.diff(first)[d] - 1, 0).sum()
    chains = {v: Chains(np.concatenate([[0], np.cumsum(np.diff(first)[d])])) for v, d in groups if len(d)}
    rows = {v: np.flatnonzero(line_label == v) for v in chains}
    w, transition = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, v2 = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    scale = max(1.0, line_weight.sum())
    for step in range(1, STEPS + 1):
        p, expected = np.empty(len(x)), np.zeros((2, 2))
        for v, chain in chains.items():
            p[rows[v]], counts = chain.marginals(x[rows[v]] @ w, transition)
            expected += heavy[v] * counts
        slope = np.concatenate([x.T @ (line_weight * (line_label - p)) - ridge * w, (seen - expected - ridge * transition).ravel()]) / scale
        m, v2 = 0.9 * m + 0.1 * slope, 0.99 * v2 + 0.01 * slope ** 2
        change = 0.1 * (m / (1 - 0.9 ** step)) / (np.sqrt(v2 / (1 - 0.99 ** step)) + 1e-8)
        w, transition = w + change[:len(w)], transition + change[len(w):].reshape(2, 2)
    return w, transition


def weighted_mean(values: np.ndarray, sizes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Mean of a text's line values by length; 0 for a text without lines."""
    top, low = (np.concatenate([[0.0], np.cumsum(v)]) for v in (values * sizes, sizes))
    total = low[first[1:]] - low[first[:-1]]
    return np.where(total > 0, (top[first[1:]] - top[first[:-1]]) / np.maximum(total, 1e-9), 0.0)


def line_quality(block: Block, model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) and length of every line with a word, and each text's first line."""
    x, sizes, first = line_features(block)
    x = (x - model["mean"]) / model["spread"]
    p, _ = Chains(first).marginals(model["unary"][0] + x @ model["unary"][1:], model["transition"])
    return p, sizes, first


def scaled(quality: np.ndarray) -> np.ndarray:
    q = np.clip(quality, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))[:, None]


def fit(texts: list[str], good: np.ndarray, weight: np.ndarray | None = None) -> dict:
    """The model as plain data."""
    found = [line_features(b) for b in blocks(pa.array(texts, pa.string()))]
    counts = np.concatenate([np.diff(f[2]) for f in found]) if found else np.zeros(0, np.int64)
    taken = (counts > 0) & (counts <= FIT_LINES)
    if not taken.any() or good[taken].min() == good[taken].max():
        return {"share": float(good.mean()) if len(good) else 1.0}
    weight = np.ones(len(good)) if weight is None else weight
    x = np.concatenate([f[0] for f in found])[np.repeat(taken, counts)]
    sizes = np.concatenate([f[1] for f in found])[np.repeat(taken, counts)]
    first = np.concatenate([[0], np.cumsum(counts[taken])])
    mean, spread = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    unary, transition = fit_chain((x - mean) / spread, first, good[taken], weight[taken])
    model = {"mean": mean, "spread": spread, "unary": unary, "transition": transition}
    p, _ = Chains(first).marginals(unary[0] + (x - mean) / spread @ unary[1:], transition)
    return model | {"scale": fit_logistic(scaled(weighted_mean(p, sizes, first)), good[taken], weight=weight[taken])}


def block_scores(block: Block, model: dict) -> np.ndarray:
    if "share" in model:
        return np.full(len(block), model["share"])
    return score(scaled(weighted_mean(*line_quality(block, model))), model["scale"])


def fitted(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, fit_rows: int):
    """The model, fitted on labelled documents that are not held out, as a broadcast of a few hundred numbers."""
    return docs.sparkSession.sparkContext.broadcast(fit(*labelled(docs, labels, label, fit_rows, FIT_CHARS, key, text)))


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per row: key, whether it is held out, score, predicted class."""
    model, kind = fitted(docs, labels, key, text, label, fit_rows), docs.schema[key].dataType.simpleString()

    def work(batches):
        for batch in batches:
            for block in blocks(batch.column(1)):
                out = block_scores(block, model.value)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(block.first_row, len(block)) for c in (0, 2)), pa.array(out),
                                                  pa.array((out >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
    source = docs.select(C(key).alias("doc_id"), C(text).alias("text"), held_out(C(key)).alias("held_out"))
    return source.mapInArrow(work, f"doc_id {kind}, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, fit_docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
             fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of ``docs`` that score at least ``THRESHOLD``, with all their columns; the model is fitted on ``fit_docs``."""
    model, at = fitted(fit_docs, labels, key, text, label, fit_rows), docs.columns.index(text)

    def work(batches):
        for batch in batches:
            for block in blocks(batch.column(at)):
                yield batch.slice(block.first_row, len(block)).filter(pa.array(block_scores(block, model.value) >= THRESHOLD))
    return docs.mapInArrow(work, docs.schema)
