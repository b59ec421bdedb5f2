"""Toxic texts by the lengths that their windows compress to with two Zstandard dictionaries.

Windows are runs of words that end where a word's hash says so, four words on average, so copies of a passage fall into equal windows. The ordinary
dictionary is trained on windows of ordinary texts. The toxic one is trained on the windows of toxic texts that share something with other toxic texts
which ordinary text lacks: those that come out ``LEAST_GAIN`` bytes shorter when the other half of the toxic texts' distinct windows stands before
the ordinary ones. It is laid before the ordinary dictionary, so that ordinary text compresses alike with both.

A further list holds the words that these gains are due to, found by leaving out one word of a window at a time: those that gain in several windows,
and far more often than in ordinary text. It takes the place of the trained dictionary for a second gain of each window.

A window's gain is its length with the ordinary dictionary less that with a toxic one before it. A text is described by how many of its windows reach
each gain, for the trained dictionary and for the list; the thresholds' weights and the scale of the score are calibrated on the fitting texts. All
windows of the whole text count. Parameters of the fit, not of the scoring: of each side the last ``BROAD_BYTES`` of distinct windows are the
background that windows are compared with, and listed words have ``LEAST_LETTERS`` bytes, ``LEAST_WINDOWS`` windows and fill ``TOXIC_BYTES`` at most.
Where the windows are too few for the trainer, they are the dictionary themselves.

Defined cases: null and empty texts have no windows and get the score of a text without any gain; rows are scored one by one, so repeated
rows and null keys give rows of their own; without fitting texts of both classes every score is the share of toxic ones among them (0 when there
are none); a text of any length is scored whole; an empty table gives an empty result; only key and text are read.
"""
from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.blocks import SPACES, Block, blocks, byte_flags, span_hashes, spans
from barflow.llm.samples import fit_logistic, held_out, labelled, score

C = F.col
FIT_ROWS = 3000
FIT_CHARS = 20_000
LEVEL = 9
ORDINARY_BYTES = 32 << 10
BROAD_BYTES = 2 << 20
LEAST_GAIN = 3
TOXIC_BYTES = 8 << 10
TOXIC_SEGMENT, TOXIC_MATCH = 32, 8  # segments that the trainer picks, and the runs of bytes it counts in them
LEAST_DICTIONARY = 256  # bytes; the trainer makes no smaller one
LEAST_LETTERS = 4
LEAST_WINDOWS = 3
TAIL = 16
GAINS = (1, 2, 3, 4, 5, 6, 8)


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


def text_windows(block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes in lower case, (start, length) of each window, and each text's first window."""
    low = lower_table()[block.data]
    starts, ends, first = spans(block, byte_flags(SPACES))
    if not len(starts):
        return low, np.zeros((0, 2), np.int64), first
    last = span_hashes(low, starts, ends) % np.uint64(4) == 0
    last[first[1:][first[1:] > 0] - 1] = True
    stop = np.flatnonzero(last)
    begin = np.concatenate([[0], stop[:-1] + 1])
    return low, np.stack([starts[begin], ends[stop] - starts[begin]], axis=1), np.searchsorted(begin, first)


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    """A compressor whose match tables are made once, for the whole dictionary."""
    dictionary = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    settings = zstandard.ZstdCompressionParameters.from_level(LEVEL, source_size=2 * len(content), dict_size=len(content), write_content_size=False,
                                                              write_checksum=False, write_dict_id=False)
    dictionary.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(compression_params=settings, dict_data=dictionary)


class Gains:
    """Bytes saved by each toxic dictionary."""

    def __init__(self, ordinary: bytes, *toxic: bytes):
        self.plain, self.with_toxic = compressor(ordinary), [compressor(t + ordinary) for t in toxic]

    def of(self, data: np.ndarray, segments: np.ndarray) -> np.ndarray:
        """Gains of each (start, length) segment, a row per toxic dictionary."""
        if not len(segments):
            return np.zeros((len(self.with_toxic), 0), np.int64)
        # The compressor looks for no match that begins in the last 16 bytes, so each window is followed by as many blanks.
        start, size = segments[:, 0], segments[:, 1]
        room = size + TAIL
        place = np.cumsum(room) - room
        padded = np.full(room.sum(), 32, np.uint8)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        padded[np.repeat(place, size) + at] = data[np.repeat(start, size) + at]
        frames = zstandard.BufferWithSegments(padded.tobytes(), np.stack([place, room], axis=1).astype(np.uint64).tobytes())
        plain, *toxic = (np.fromiter(map(len, by.multi_compress_to_buffer(frames, threads=0)), np.int64, len(segments)) for by in (self.plain, *self.with_toxic))
        return plain - np.stack(toxic)

    def of_list(self, windows: list[bytes]) -> np.ndarray:
        sizes = np.array([len(w) for w in windows], np.int64)
        return self.of(np.frombuffer(b"".join(windows), np.uint8), np.stack([np.cumsum(sizes) - sizes, sizes], axis=1))


def distinct_windows(texts: list[str]) -> list[bytes]:
    out = set()
    for block in blocks(pa.array(texts, pa.string())):
        data, segments, _ = text_windows(block)
        data = data.tobytes()
        out.update(data[a:a + n] for a, n in segments.tolist())
    return sorted(out, key=lambda w: (zlib.crc32(w, 1), w))  # no order of letters: the end of a dictionary is nearer than its start


def culprits(windows: list[bytes], gains: Gains, least: int) -> tuple[Counter, list[bytes]]:
    """For every window that gains ``least`` bytes, the word without which most of the gain is gone; and these windows."""
    found = [windows[i] for i in np.flatnonzero(gains.of_list(windows)[0] >= least)]
    parts = [w.split() for w in found]
    cut = [b" ".join(p[:j] + p[j + 1:]) or b" " for p in parts for j in range(len(p))]
    owner = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    words = [w for p in parts for w in p]
    drop = np.repeat(gains.of_list(found)[0], [len(p) for p in parts]) - gains.of_list(cut)[0]
    best: dict[int, tuple[int, bytes]] = {}
    for o, d, w in zip(owner.tolist(), drop.tolist(), words):
        if d >= 2 and d > best.get(o, (0, b""))[0]:
            best[o] = d, w
    return Counter(w.strip(b".,;:!?%&$*#|\"'()") for _, w in best.values()), found


def trained(windows: list[bytes], size: int, **settings: int) -> bytes:
    """A trained dictionary, or the windows themselves where they are too few for the trainer."""
    try:
        return zstandard.train_dictionary(size, windows, **(settings or {"level": LEVEL})).as_bytes()
    except zstandard.ZstdError:
        return b" ".join(windows)[-size:] or b" "


def fit_dictionaries(texts: list[str], toxic: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """The ordinary dictionary, the toxic one, and the list of toxic words."""
    plain = distinct_windows([t for t, y in zip(texts, toxic) if not y])
    seen = set(plain)
    marked = [w for w in distinct_windows([t for t, y in zip(texts, toxic) if y]) if w not in seen]
    half = [zlib.crc32(w) % 2 for w in plain]
    known, fresh = ([w for w, h in zip(plain, half) if h == k] for k in (1, 0))
    ordinary, broad = trained(known, ORDINARY_BYTES), b" ".join(known)[-BROAD_BYTES:]
    sides = [[w for w in marked if zlib.crc32(w) % 2 == k] for k in (0, 1)]
    hits, false, telling = Counter(), Counter(), []
    for k in (0, 1):
        gains = Gains(broad, b" ".join(sides[1 - k])[-BROAD_BYTES:])
        words, windows = culprits(sides[k], gains, LEAST_GAIN)
        hits += words
        telling += windows
        false += culprits(fresh, gains, LEAST_GAIN)[0]
    # At most an eighth of what it is trained on: it must hold what recurs, not the samples, or the fitting texts gain more than others.
    size = min(TOXIC_BYTES, max(LEAST_DICTIONARY, sum(map(len, telling)) // 8))
    toxic_dictionary = trained(telling, size, k=TOXIC_SEGMENT, d=TOXIC_MATCH)
    # Both sides were shown the fresh windows; a hit must be far more frequent than that.
    share = len(marked) / max(1, 2 * len(fresh))
    good = sorted((n, w) for w, n in hits.items() if n >= LEAST_WINDOWS and len(w) >= LEAST_LETTERS and n >= 10 * (false[w] + 0.1) * share)
    kept, size = [], 0
    for n, w in reversed(good):
        if size + len(w) + 1 > TOXIC_BYTES:
            break
        kept.append(w)
        size += len(w) + 1
    found = b" " + b" ".join(reversed(kept)) + b" "
    for _ in range(2):  # ordinary windows that gain by chance go into the ordinary dictionary, so that they gain no more
        chance = np.flatnonzero(Gains(ordinary, toxic_dictionary, found).of_list(fresh).max(axis=0) >= 2)
        ordinary = b" ".join([fresh[i] for i in chance])[-ORDINARY_BYTES:] + ordinary
    return ordinary, toxic_dictionary, found


def profiles(block: Block, gains: Gains) -> np.ndarray:
    """How many windows of each text reach each gain with each toxic dictionary, on a log scale."""
    data, segments, first = text_windows(block)
    saved = gains.of(data, segments)
    reach = [np.concatenate([[0], np.cumsum(by >= g)]) for by in saved for g in GAINS]
    counts = np.stack([r[first[1:]] - r[first[:-1]] for r in reach] + [np.diff(first)], axis=1)
    return np.log1p(counts)


def fit(texts: list[str], toxic: np.ndarray, weight: np.ndarray | None = None) -> dict:
    """The model as plain data: the dictionaries, and the calibrated weights."""
    if not len(texts) or toxic.min() == toxic.max():
        share = float(toxic.mean()) if len(texts) else 0.0
        return {"share": share}
    found = fit_dictionaries(texts, toxic)
    gains = Gains(*found)
    x = np.concatenate([profiles(b, gains) for b in blocks(pa.array(texts, pa.string()))])
    return {"dictionaries": found, "weights": fit_logistic(x, toxic, weight=weight)}


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS) -> DataFrame:
    """Per row: key, whether it is held out, score, predicted class."""
    model = docs.sparkSession.sparkContext.broadcast(fit(*labelled(docs, labels, label, fit_rows, FIT_CHARS, key, text)))  # three dictionaries of bounded size
    kind = docs.schema[key].dataType.simpleString()

    def work(batches):
        known = model.value
        gains = Gains(*known["dictionaries"]) if "weights" in known else None
        for batch in batches:
            for block in blocks(batch.column(1)):
                out = score(profiles(block, gains), known["weights"]) if gains else np.full(len(block), known["share"])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(block.first_row, len(block)) for c in (0, 2)), pa.array(out),
                                                  pa.array((out >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])
    source = docs.select(C(key).alias("doc_id"), C(text).alias("text"), held_out(C(key)).alias("held_out"))
    return source.mapInArrow(work, f"doc_id {kind}, held_out boolean, score double, predicted int")
