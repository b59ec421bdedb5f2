"""Quality rules as a short-circuit cascade: rules run in the order of rejections per cost, each on what the rules before it left.

Cost and selectivity of every rule are measured on a bounded sample of the table (``SAMPLE_ROWS``); they steer the order only, so the
verdict is the same for every sample. Rules share what they measure: a count that one rule has made is not made again.

Defined cases: null and empty texts have no words, so they fail the word minimum; rows are judged one by one, so ties, repeated rows
and null keys change nothing; an empty table gives an empty one; other columns, whatever their names, pass through untouched.
"""
from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barflow.llm.blocks import SPACES, Block, blocks, byte_flags, counts_within, owners, per_text, span_hashes, spans, windows

SAMPLE_ROWS = 1000
SAMPLE_CHARS = 32_768
SYMBOLS = b"#*$%&|<>"


class Measures:
    """Counts over the texts of a block, each made when it is first asked for."""

    def __init__(self, block: Block):
        self.block, self.known = block, {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.known:
            self.known[name] = MEASURES[name](self)
        return self.known[name]

    def only(self, keep: np.ndarray) -> Measures:
        """The texts that ``keep`` marks, with the counts made so far."""
        lengths = np.diff(self.block.offsets)
        data = self.block.data[np.repeat(keep, lengths)]
        out = Measures(Block(data, np.concatenate([[0], np.cumsum(lengths[keep])]), self.block.first_row))
        out.known = {k: v[keep] for k, v in self.known.items() if k in PER_TEXT}
        return out


def _per_byte(m: Measures, table: np.ndarray) -> np.ndarray:
    return per_text(table[m.block.data], m.block.offsets)


def _words(m: Measures):
    return spans(m.block, byte_flags(SPACES))


def _repeated_words(m: Measures) -> np.ndarray:
    starts, ends, first = m["words"]
    found, offsets = windows(span_hashes(m.block.data, starts, ends), first, 3)
    counts, _ = counts_within(found, owners(offsets))
    many = np.flatnonzero(counts > 1)
    covered = np.zeros(len(starts) + 1, bool)
    at = first[:-1][np.searchsorted(offsets, many, "right") - 1] + many - offsets[np.searchsorted(offsets, many, "right") - 1]
    for j in range(3):
        covered[at + j] = True
    return per_text(covered[:-1], first)


def _lines(m: Measures):
    """Lines that hold a word: hashes, and the index of each text's first."""
    starts, ends, first = spans(m.block, byte_flags(b"\n"))
    solid = np.concatenate([[0], np.cumsum(~byte_flags(SPACES)[m.block.data])])
    worded = solid[ends] > solid[starts]
    first = np.concatenate([[0], np.cumsum(worded)])[first]
    return span_hashes(m.block.data, starts[worded], ends[worded], seed=13), first


def _characters(m: Measures) -> np.ndarray:
    table = ~byte_flags(SPACES)
    table[0x80:0xC0] = False
    return _per_byte(m, table)


PER_TEXT = {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks"}
MEASURES: dict[str, Callable] = {
    "words": _words,
    "lines": _lines,
    "n_words": lambda m: np.diff(m["words"][2]),
    "word_chars": _characters,
    "n_symbols": lambda m: _per_byte(m, byte_flags(SYMBOLS)),
    "n_marks": lambda m: _per_byte(m, byte_flags(b"!")),
    "n_lines": lambda m: np.diff(m["lines"][1]),
    "n_dup_lines": lambda m: per_text(counts_within(m["lines"][0], owners(m["lines"][1]))[1], m["lines"][1]),
    "n_repeat_words": _repeated_words,
}


@dataclass(frozen=True)
class Rule:
    """``rejects`` maps the counts of some texts to true where the rule throws a text out."""

    name: str
    rejects: Callable[[Measures], np.ndarray]


#: The base rules, then those of the verdict. All limits are ratios of whole numbers, so every engine decides alike.
BASE_RULES = (
    Rule("few_words", lambda m: m["n_words"] < 50),
    Rule("repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
)
RULES = (*BASE_RULES,
    Rule("symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    Rule("exclamations", lambda m: 10 * m["n_marks"] > 3 * m["n_words"]),
    Rule("repeated_lines", lambda m: 2 * m["n_dup_lines"] > m["n_lines"]),
    Rule("word_length", lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 20 * m["n_words"])),
)


def profile(texts: Sequence[str | None], rules: Sequence[Rule]) -> list[tuple[str, float, float]]:
    """(name, seconds a text, share rejected) of each rule when it runs alone on the sample."""
    out = []
    column = pa.array(list(texts), pa.string())
    for rule in rules:
        began, thrown = time.perf_counter(), 0
        for block in blocks(column):
            thrown += int(rule.rejects(Measures(block)).sum())
        out.append((rule.name, (time.perf_counter() - began) / max(1, len(texts)), thrown / max(1, len(texts))))
    return out


def ordered(df: DataFrame, rules: Sequence[Rule] = RULES, text: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[Rule]:
    """Rules by rejections per second of work, from a sample of at most ``sample_rows`` texts of bounded length."""
    bounded = df.select(F.col(text).alias("t")).where(F.length("t") <= SAMPLE_CHARS).sample(0.5, seed=3)
    found = {name: share / max(cost, 1e-9) for name, cost, share in profile([r[0] for r in bounded.take(sample_rows)], rules)}
    return sorted(rules, key=lambda r: -found[r.name])


def survivors(m: Measures, rules: Sequence[Rule]) -> np.ndarray:
    """Indexes of the texts that every rule leaves; later rules see only what earlier ones left."""
    at = np.arange(len(m.block))
    for rule in rules:
        if not len(at):
            break
        keep = ~rule.rejects(m)
        if not keep.all():
            at, m = at[keep], m.only(keep)
    return at


REPORT = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def rule_report(df: DataFrame, key: str = "doc_id", text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """Per row: key, the base counts, ``base_failed`` and ``kept``."""
    source = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    order, base = ordered(df, rules, text), BASE_RULES
    kind = source.schema["doc_id"].dataType.simpleString()

    def judge(batches):
        for batch in batches:
            for block in blocks(batch.column(1)):
                m = Measures(block)
                counts = [m[name].astype(np.int64) for name in REPORT]
                failed = np.logical_or.reduce([r.rejects(m) for r in base])
                kept = np.zeros(len(block), bool)
                kept[survivors(m, order)] = True
                rows = batch.column(0).slice(block.first_row, len(block))
                yield pa.RecordBatch.from_arrays([rows, *map(pa.array, counts), pa.array(failed), pa.array(kept & ~failed)],
                                                 ["doc_id", *REPORT, "base_failed", "kept"])
    return source.mapInArrow(judge, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in REPORT) + ", base_failed boolean, kept boolean")


def accepted(df: DataFrame, text: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows that no rule rejects, with all their columns."""
    order, at = ordered(df, rules, text), df.columns.index(text)

    def judge(batches):
        for batch in batches:
            for block in blocks(batch.column(at)):
                rows = batch.slice(block.first_row, len(block))
                yield rows.take(pa.array(survivors(Measures(block), order)))
    return df.mapInArrow(judge, df.schema)
