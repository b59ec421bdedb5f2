"""Words, lines and their 64-bit hashes for whole blocks of texts at once, as numpy arrays inside Arrow tasks.

A block is a run of consecutive rows of an Arrow batch, cut so that it holds about ``BLOCK_BYTES`` of UTF-8; one longer text is a block
of its own. Nothing is cut inside a text.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 2 << 20
SPACES = b" \t\n\x0b\x0c\r"
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def byte_flags(chars: bytes) -> np.ndarray:
    """Boolean table over the 256 byte values."""
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def salts(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit multipliers."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed)) | np.uint64(1)


@dataclass
class Block:
    """UTF-8 bytes of consecutive texts; text ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray
    first_row: int

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Blocks of a string column in row order; null counts as empty."""
    if not len(column):
        return
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, at, values = column.buffers()
    offsets = np.frombuffer(at, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(values, np.uint8) if values is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield Block(data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row], row)
        row = end


def spans(block: Block, gap: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes outside ``gap`` (a byte table), never across texts, and the index of each
    text's first run (one more entry than texts)."""
    n = len(block.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(block) + 1, np.int64)
    inside = ~gap[block.data]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edges = block.offsets[:-1]
    edges = edges[edges < n]
    begin[edges] = inside[edges]
    stop[edges[edges > 0] - 1] = inside[edges[edges > 0] - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, block.offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 7) -> np.ndarray:
    """64-bit hash of each byte span: a polynomial over randomised bytes, from prefix sums, mixed at the end."""
    table = salts(256, seed)
    if lower:
        table[65:91] = table[97:123]
    n = len(data)
    with np.errstate(over="ignore"):
        power = np.full(n + 1, BASE, np.uint64)
        power[0] = 1
        np.multiply.accumulate(power, out=power)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * power[:-1], out=total[1:])
        back = np.full(n + 1, BASE_INVERSE, np.uint64)
        back[0] = 1
        np.multiply.accumulate(back, out=back)
        return mix((total[ends] - total[starts]) * back[starts])


def windows(hashes: np.ndarray, first: np.ndarray, size: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``size``-word windows of each text, in order, and the index of each text's first window."""
    factor = salts(size, seed)
    counts = np.maximum(np.diff(first) - size + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    if not offsets[-1]:
        return np.zeros(0, np.uint64), offsets
    at = np.repeat(first[:-1] - offsets[:-1], counts) + np.arange(offsets[-1])
    with np.errstate(over="ignore"):
        sums = np.zeros(len(at), np.uint64)
        for j in range(size):
            sums += hashes[at + j] * factor[j]
        return mix(sums), offsets


def owners(first: np.ndarray) -> np.ndarray:
    """Index of the text that each run belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def counts_within(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each value occurs in its text, and whether it is a repetition of an earlier equal one."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    with np.errstate(over="ignore"):
        key = mix(values + owner.astype(np.uint64) * np.uint64(BASE))
    order = np.argsort(key, kind="stable")
    fresh = np.empty(len(key), bool)
    fresh[0] = True
    np.not_equal(key[order][1:], key[order][:-1], out=fresh[1:])
    group = np.cumsum(fresh) - 1
    counts, again = np.empty(len(key), np.int64), np.empty(len(key), bool)
    counts[order] = np.bincount(group)[group]
    again[order] = ~fresh
    return counts, again


def per_text(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``flags`` over each text's runs."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]
