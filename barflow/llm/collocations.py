"""Phrases of two to four words that belong together, mined with weighted acyclic automata.

1. One pass over the texts counts words and word pairs by 64-bit hashes (these never decide a result). Those that reach ``LEAST`` are
   kept as a bit table of at most ``FILTER_BITS`` bits; where it is too small for all, more n-grams pass and the result is the same. A
   longer n-gram can't be frequent unless all its pairs are.
2. A second pass numbers the words that passed by their bytes and counts the n-grams of one to four such words, shard by shard. The
   sorted n-grams of a shard are added one by one to an acyclic count transducer: states whose right sides are equal, counts
   included, are stored once. It is cut at the borders of prefix ranges (language and first two words), which come from a sample of frequent
   pairs and only balance the work.
3. The transducers of one range are united, 8 partitions' at a time: paths that spell the same n-gram meet, level by level, and their weights are
   summed. What stays below ``LEAST`` at the end goes, and the rest is one transducer again.
4. Both parts of every cut of a candidate are looked up by composition: the parts asked for in one range are an acceptor of sorted phrases, which is
   walked in step with the range's transducer. Each distinct part is asked once.

Scores are exact: decimals of 38 digits. A phrase inside a longer candidate lies inside one that is one word longer and at least as
frequent, so only those are compared.

Defined cases: null texts are empty, null languages count as ``und``; repeated rows and null keys are documents of their own; ties are decided by
score, count, then the phrase's bytes; pieces without words end nothing; long texts are read whole; an empty table gives an empty
result; only the named columns are read.
"""
from __future__ import annotations

import hashlib
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barflow.llm.blocks import blocks, byte_flags, mix, owners, salts, span_hashes, spans
from barflow.llm.groups import join_groups
from barflow.llm.lexicon import SMALL, Lexicon
from barflow.operators.stage import materialize

C = F.col
WORDS = 4
LEAST = 30
TOP = 2000
SHARD_WORDS = 1 << 20
RANGE_WORDS = 2 << 20
MOST_RANGES = 1 << 14
FAN_IN_BITS = 3
FILTER_BITS = 28
SEGMENT_BITS = 19
SAMPLED = 256  # one in so many word pairs is known by name to the choice of borders
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
NO_LANG = "und"
AUTOMATON = "bucket int, run int, lang string, words array<string>, begin array<int>, label array<int>, weight array<bigint>, target array<int>"


class Automaton:
    """Arcs of all states one after the other: state s has ``begin[s]..begin[s + 1]``; state 0 has none, the last one is the root."""

    def __init__(self, words: list[bytes], begin: np.ndarray, label: np.ndarray, weight: np.ndarray, target: np.ndarray):
        self.words, self.begin, self.label, self.weight, self.target = words, begin, label, weight, target

    @property
    def root(self) -> int:
        return len(self.begin) - 2

    def row(self) -> tuple:
        return [w.decode() for w in self.words], self.begin, self.label, self.weight, self.target


def build(words: list[bytes], grams: np.ndarray, weights: np.ndarray) -> Automaton:
    """Automaton of sorted distinct n-grams (rows of word numbers from 1, 0 behind the end), added one by one. ``words`` is sorted, too."""
    used = np.unique(grams)
    used = used[used > 0]
    grams = np.where(grams > 0, np.searchsorted(used, grams), -1)
    depth = (grams >= 0).sum(axis=1)
    same = np.zeros(grams.shape, bool)
    same[1:] = (grams[1:] == grams[:-1]) & (grams[1:] >= 0)
    shared = np.cumprod(same, axis=1).sum(axis=1)
    width = grams.shape[1]
    begin, label, weight, target, known = [0, 0], [], [], [], {(): 0}
    arcs, at_label, at_weight, deep = [[] for _ in range(width + 1)], [0] * (width + 1), [0] * (width + 1), 0

    def close(down_to: int) -> None:
        """States below the shared prefix are complete: each is looked up among the known ones, or stored."""
        for d in range(deep, down_to, -1):
            right = tuple(arcs[d])
            state = known.get(right)
            if state is None:
                state = known[right] = store(right)
            arcs[d] = []
            arcs[d - 1] += (at_label[d], at_weight[d], state)

    def store(right: tuple) -> int:
        label.extend(right[::3])
        weight.extend(right[1::3])
        target.extend(right[2::3])
        begin.append(len(label))
        return len(begin) - 2
    for gram, prefix, last, value in zip(grams.tolist(), shared.tolist(), depth.tolist(), weights.tolist()):
        close(prefix)
        for d in range(prefix + 1, last + 1):
            at_label[d], at_weight[d] = gram[d - 1], 0
        at_weight[last] = value
        deep = last
    close(0)
    store(tuple(arcs[0]))
    return Automaton([words[i - 1] for i in used.tolist()], *(np.array(x, t) for x, t in ((begin, np.int32), (label, np.int32), (weight, np.int64), (target, np.int32))))


def followed(begin: np.ndarray, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All arcs of the given states, and for each the place of its state in ``states``."""
    counts = begin[states + 1] - begin[states]
    place = np.repeat(np.arange(len(states)), counts)
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + begin[states][place], place


def unite(parts: list[Automaton], least: int = 0) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Words, sorted n-grams and summed weights of all automata; n-grams of a weight below ``least`` go, with all that begin with them."""
    words = sorted(set().union(*(p.words for p in parts)))
    number = {w: i + 1 for i, w in enumerate(words)}
    begin, label, roots, arcs, states = [np.zeros(1, np.int64)], [], [], 0, 0
    for p in parts:
        names = np.array([number[w] for w in p.words], np.int64)
        label.append(names[p.label] if len(p.label) else np.zeros(0, np.int64))
        begin.append(p.begin[1:].astype(np.int64) + arcs)
        roots.append(p.root + states)
        arcs, states = arcs + len(p.label), states + len(p.begin) - 1
    shift = np.cumsum([0] + [len(p.begin) - 1 for p in parts[:-1]])
    target = np.concatenate([p.target.astype(np.int64) + s for p, s in zip(parts, shift)])
    label, weight, begin = np.concatenate(label), np.concatenate([p.weight for p in parts]), np.concatenate(begin)
    paths, parent, state, found = np.zeros((1, 0), np.int64), np.zeros(len(roots), np.int64), np.array(roots, np.int64), []
    while len(state):
        arc, place = followed(begin, state)
        if not len(arc):
            break
        key = parent[place] * (len(words) + 1) + label[arc]
        order = np.argsort(key, kind="stable")
        arc, key = arc[order], key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        total = np.add.reduceat(weight[arc], first)
        keep = (total == 0) | (total >= least)  # no weight: the beginning of n-grams that is itself counted in another range
        paths = np.column_stack([paths[key[first] // (len(words) + 1)], key[first] % (len(words) + 1)])[keep]
        found.append((paths, total[keep]))
        group = np.cumsum(np.concatenate([[0], np.diff(key) != 0]))
        alive = keep[group]
        parent, state = (np.cumsum(keep) - 1)[group[alive]], target[arc[alive]]
    if not found:
        return words, np.zeros((0, WORDS), np.int64), np.zeros(0, np.int64)
    grams = np.concatenate([np.pad(p, ((0, 0), (0, WORDS - p.shape[1]))) for p, _ in found])
    total = np.concatenate([t for _, t in found])
    grams, total = grams[total > 0], total[total > 0]
    order = np.lexsort(grams.T[::-1])
    return words, grams[order], total[order]


def compose(asked: Automaton, counts: Automaton) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of weights (of ``asked``, of ``counts``) over all paths that both have."""
    number = {w: i for i, w in enumerate(counts.words)}
    label = np.array([number.get(w, -1) for w in asked.words], np.int64)[asked.label] if len(asked.label) else np.zeros(0, np.int64)
    left, right = np.array([asked.root]), np.array([counts.root])
    size, one, two = len(counts.words) + 1, [], []
    while len(left):
        arc, place = followed(asked.begin, left)
        other, there = followed(counts.begin, right)
        key, keys = place * size + label[arc], there * size + counts.label[other]
        arc, key = arc[label[arc] >= 0], key[label[arc] >= 0]
        order = np.argsort(keys, kind="stable")
        keys, other = keys[order], other[order]
        at = np.searchsorted(keys, key)
        hit = at < len(keys)
        hit[hit] = keys[at[hit]] == key[hit]
        arc, other = arc[hit], other[at[hit]]
        one.append(asked.weight[arc])
        two.append(counts.weight[other])
        left, right = asked.target[arc], counts.target[other]
    one, two = np.concatenate(one), np.concatenate(two)
    return one[one > 0], two[one > 0]


def lang_hash(lang: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(lang, digest_size=8).digest(), "little")


def word_blocks(batches):
    """Per block of texts: lower-cased bytes, starts, ends, hashes, hashes with language, whether the next word follows in the same piece, each word's
    language, and all languages met. Columns: text, language."""
    langs: dict[bytes, int] = {}
    gaps, ends_piece = byte_flags(PIECE_ENDS + b" \t"), byte_flags(PIECE_ENDS)
    for batch in batches:
        for block in blocks(batch.column(0)):
            names = [(x if x is not None else NO_LANG).encode() for x in batch.column(1).slice(block.first_row, len(block)).to_pylist()]
            data = SMALL[block.data]
            starts, ends, first = spans(block, gaps)
            owner = owners(first)
            piece = np.cumsum(ends_piece[data])[starts] if len(starts) else starts
            joined = np.zeros(len(starts), bool)
            joined[:-1] = (piece[1:] == piece[:-1]) & (owner[1:] == owner[:-1])
            lang = np.array([langs.setdefault(x, len(langs)) for x in names], np.int64)[owner]
            salt = np.array([lang_hash(x) for x in langs], np.uint64)
            hashes = span_hashes(data, starts, ends)
            with np.errstate(over="ignore"):
                keys = mix(hashes + salt[lang]) if len(starts) else hashes
            yield data, starts, ends, hashes, keys, joined, lang, langs


def pair_keys(keys: np.ndarray) -> np.ndarray:
    """Hash of each word and the next; the last one's is of no use."""
    a, b = salts(2, 53)
    with np.errstate(over="ignore"):
        return mix(keys * a + np.roll(keys, -1) * b)


def hashed_counts(docs: DataFrame, shard_words: int) -> DataFrame:
    """Counts of a shard's words and pairs (key), of some pairs with their words (key, name), and of all words of a language (name)."""
    def work(batches):
        held, size, names, totals = [], 0, {}, {}

        def out():
            key, n = np.unique(np.concatenate(held), return_counts=True)
            some = np.array(sorted(names), np.uint64)
            at = np.searchsorted(key, some)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.nulls(len(key), pa.string()), pa.array(n, pa.int64())], ["key", "name", "n"])
            yield pa.RecordBatch.from_arrays([
                pa.concat_arrays([pa.array(some.view(np.int64)), pa.nulls(len(totals), pa.int64())]),
                pa.array([names[k] for k in some.tolist()] + list(totals), pa.string()), pa.array(n[at].tolist() + list(totals.values()), pa.int64())], ["key", "name", "n"])
        for data, starts, ends, _, keys, joined, lang, langs in word_blocks(batches):
            if not len(starts):
                continue
            pairs, named, raw = pair_keys(keys), list(langs), None
            for i in np.flatnonzero(joined & (pairs % np.uint64(SAMPLED) == 0)).tolist():
                if pairs[i] not in names:
                    raw = raw or data.tobytes()
                    names[int(pairs[i])] = b"\0".join((named[lang[i]], raw[starts[i]:ends[i]], raw[starts[i + 1]:ends[i + 1]])).decode()
            for number, n in enumerate(np.bincount(lang).tolist()):
                if n:
                    totals[named[number].decode()] = totals.get(named[number].decode(), 0) + n
            held += [keys, pairs[joined]]
            size += len(keys)
            if size >= shard_words:
                yield from out()
                held, size, names, totals = [], 0, {}, {}
        if held:
            yield from out()
    return docs.mapInArrow(work, "key bigint, name string, n bigint")


def filter_table(keys: DataFrame, count: int) -> tuple[int, np.ndarray]:
    """Bits that two probes of each key set, and the number of bits as a power of two."""
    power = min(FILTER_BITS, max(SEGMENT_BITS, (16 * count).bit_length()))
    mask = (1 << power) - 1

    def gather(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << SEGMENT_BITS, bool)
        bits[table.column("probe").to_numpy() & ((1 << SEGMENT_BITS) - 1)] = True
        return pa.table({"segment": pa.array([table.column("segment")[0].as_py()], pa.int32()), "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})
    probes = keys.select(F.explode(F.array(C("key").bitwiseAND(mask), F.shiftrightunsigned("key", 32).bitwiseAND(mask))).alias("probe"))
    probes = probes.select("probe", F.shiftright("probe", SEGMENT_BITS).cast("int").alias("segment")).distinct()
    table = np.zeros(1 << (power - 3), np.uint8)
    for segment, bits in probes.groupBy("segment").applyInArrow(gather, "segment int, bits binary").collect():
        table[segment << (SEGMENT_BITS - 3):(segment + 1) << (SEGMENT_BITS - 3)] = np.frombuffer(bits, np.uint8)
    return power, table


def passes(keys: np.ndarray, power: int, table: np.ndarray) -> np.ndarray:
    mask = np.uint64((1 << power) - 1)

    def bit(probe):
        return table[(probe >> np.uint64(3)).astype(np.int64)] >> (probe & np.uint64(7)).astype(np.uint8) & 1
    return (bit(keys & mask) & bit(keys >> np.uint64(32) & mask)).astype(bool)


def bucket_of(borders: list[tuple], lang: bytes, words: list[bytes]) -> int:
    return bisect_right(borders, (lang, words[0], words[1] if len(words) > 1 else b""))


def shard_automata(number: np.ndarray, level: np.ndarray, lang: np.ndarray, lexicon: Lexicon, langs: list[bytes], borders: list[tuple]):
    """Rows (bucket, language, automaton) of one shard. ``level`` is the length of the longest counted n-gram that begins at each word."""
    by = sorted(range(len(lexicon.words)), key=lexicon.words.__getitem__)
    words = [lexicon.words[i] for i in by]
    rank = np.zeros(len(by) + 1, np.int64)
    rank[by] = np.arange(1, len(by) + 1)
    ranks = np.concatenate([rank[number], np.zeros(WORDS, np.int64)])
    for here in np.unique(lang[level > 0]):
        parts = []
        for n in range(1, WORDS + 1):
            at = np.flatnonzero((level >= n) & (lang == here))
            one, two, three, four = (ranks[at + j] if j < n else 0 for j in range(WORDS))
            parts.append((one << 32 | two, np.zeros(len(at), np.int64) + (three << 32 | four)))
        front, back = (np.concatenate(x) for x in zip(*parts))
        del parts
        order = np.lexsort((back, front))
        front, back = front[order], back[order]
        first = np.flatnonzero(np.concatenate([[True], (front[1:] != front[:-1]) | (back[1:] != back[:-1])]))
        counts = np.diff(np.append(first, len(front)))
        front, back = front[first], back[first]
        del order, first
        grams = np.column_stack([front >> 32, front & 0xFFFFFFFF, back >> 32, back & 0xFFFFFFFF])
        base, cuts = bisect_right(borders, (langs[here], b"", b"")), [0]
        for _, one, two in borders[base:bisect_left(borders, (langs[here] + b"\0", b"", b""))]:
            i = bisect_left(words, one)
            exact = i < len(words) and words[i] == one
            cuts.append(int(np.searchsorted(front, (i + 1) << 32 | (bisect_left(words, two) + 1 if exact else 0))))
        cuts.append(len(grams))
        for j, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
            if a < b:
                yield base + j, langs[here], build(words, grams[a:b], counts[a:b])


def automaton_batch(rows: list[tuple[int, bytes, Automaton]], run: int) -> pa.RecordBatch:
    types = [pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int32())]
    columns = list(zip(*((bucket, run, lang.decode(), *a.row()) for bucket, lang, a in rows))) or [()] * 8
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["bucket", "run", "lang", "words", "begin", "label", "weight", "target"])


def automata_of(table: pa.Table) -> dict[bytes, list[Automaton]]:
    found: dict[bytes, list[Automaton]] = {}
    lists = [table.column(c) for c in ("begin", "label", "weight", "target")]
    for i, (lang, words) in enumerate(zip(table.column("lang").to_pylist(), table.column("words").to_pylist())):
        found.setdefault(lang.encode(), []).append(Automaton([w.encode() for w in words], *(c[i].values.to_numpy() for c in lists)))
    return found


def shard_transducers(docs: DataFrame, power: int, table: np.ndarray, borders: list[tuple], shard_words: int) -> DataFrame:
    """Count transducers of all shards, cut at the borders."""
    shared = docs.sparkSession.sparkContext.broadcast((power, table, borders))

    def work(batches):
        size, bits, cuts = shared.value
        lexicon, held, words, langs = Lexicon(), [], 0, {}

        def out():
            columns = [np.concatenate(x) for x in zip(*held)]
            for row in shard_automata(*columns, lexicon, list(langs), cuts):
                yield automaton_batch([row], TaskContext.get().partitionId())
        for data, starts, ends, hashes, keys, joined, lang, langs in word_blocks(batches):
            if not len(starts):
                continue
            good = passes(keys, size, bits)
            pair = joined & good & np.append(good[1:], False)
            pair[pair] = passes(pair_keys(keys)[pair], size, bits)
            level, longer = good.astype(np.int8), pair
            for _ in range(2, WORDS + 1):
                level += longer
                longer = pair & np.append(longer[1:], False)
            number = np.full(len(starts), -1, np.int64)
            number[good] = lexicon.numbers(data, starts[good], ends[good], hashes[good])
            held.append((number.astype(np.int32), level, lang.astype(np.int32)))
            words += len(starts)
            if words >= shard_words:
                yield from out()
                lexicon, held, words = Lexicon(), [], 0
        if held:
            yield from out()
    return docs.mapInArrow(work, AUTOMATON)


def united(shards: DataFrame, least: int) -> DataFrame:
    """One transducer for each range and language: 8 neighbouring partitions' are united at a time, so no task holds those of all shards."""
    def step(rows: DataFrame, at_least: int) -> DataFrame:
        def work(table: pa.Table) -> pa.Table:
            bucket, run, rows_ = table.column("bucket")[0].as_py(), table.column("run")[0].as_py() >> FAN_IN_BITS, []
            for lang, parts in automata_of(table).items():
                words, grams, counts = unite(parts, at_least)
                if len(grams):
                    rows_.append((bucket, lang, build(words, grams, counts)))
            return pa.Table.from_batches([automaton_batch(rows_, run)])
        return rows.groupBy("bucket", F.shiftright("run", FAN_IN_BITS)).applyInArrow(work, AUTOMATON)
    last = shards.agg(F.max("run")).first()[0] or 0
    while True:
        last >>= FAN_IN_BITS
        shards = materialize(step(shards, 0 if last else least))
        if not last:
            return shards


def phrases(automata: DataFrame) -> DataFrame:
    """Every phrase of more than one word with its count ``a``: lang, words, a."""
    def work(batches):
        for batch in batches:
            for lang, parts in automata_of(pa.Table.from_batches([batch])).items():
                for part in parts:
                    words, grams, counts = unite([part])
                    many = grams[:, 1] > 0
                    found = [[words[i - 1].decode() for i in g if i] for g in grams[many].tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array([lang.decode()] * len(found), pa.string()), pa.array(found, pa.list_(pa.string())), pa.array(counts[many], pa.int64())],
                                                     ["lang", "words", "a"])
    return automata.mapInArrow(work, "lang string, words array<string>, a bigint")


def looked_up(parts: DataFrame, automata: DataFrame, borders: list[tuple]) -> DataFrame:
    """Counts of distinct parts (lang, words, asks) by composition with the transducers of their ranges: lang, part, f, asks."""
    def ranged(batches):
        for batch in batches:
            bucket = [bucket_of(borders, lang.encode(), [w.encode() for w in words]) for lang, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), *batch.columns], ["bucket", *batch.schema.names])

    def answer(asked: pa.Table, table: pa.Table) -> pa.Table:
        counts, out = automata_of(table), []
        langs, phrases_, asks = asked.column("lang").to_pylist(), asked.column("words").to_pylist(), asked.column("asks").to_pylist()
        for lang in sorted(set(langs)):
            rows = sorted((tuple(w.encode() for w in p), n) for x, p, n in zip(langs, phrases_, asks) if x == lang)
            words = sorted({w for p, _ in rows for w in p})
            number = {w: i + 1 for i, w in enumerate(words)}
            grams = np.array([[number[w] for w in p] + [0] * (WORDS - len(p)) for p, _ in rows], np.int64)
            acceptor = build(words, grams, np.arange(1, len(rows) + 1))
            for part in counts.get(lang.encode(), []):
                which, f = compose(acceptor, part)
                out += [(lang, b" ".join(rows[i - 1][0]).decode(), n, rows[i - 1][1]) for i, n in zip(which.tolist(), f.tolist())]
        columns = list(zip(*out)) or [()] * 4
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64()))], ["lang", "part", "f", "asks"])
    asked = parts.select("lang", "words", "asks").mapInArrow(ranged, "bucket int, lang string, words array<string>, asks bigint")
    return asked.groupBy("bucket").cogroup(automata.groupBy("bucket")).applyInArrow(answer, "lang string, part string, f bigint, asks bigint")


def chosen_borders(counted: DataFrame, ranges: int) -> list[tuple]:
    """``ranges - 1`` quantiles of a bounded sample of frequent pairs."""
    sample = counted.where(C("key").isNotNull() & C("name").isNotNull()).orderBy("key").limit(16 * ranges)
    names = sorted(tuple(x.encode() for x in r["name"].split("\0")) for r in sample.select("name").collect() if r["name"].count("\0") == 2)
    return sorted({names[len(names) * i // ranges] for i in range(1, ranges)}) if names else []


def first_rows(rows: DataFrame, top: int) -> DataFrame:
    """The best phrases of each language: first within parts of its rows, then of those."""
    order = [C("score").desc(), C("a").desc(), C("phrase")]
    parts = rows.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(64)))
    few = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(C("rank") <= top).drop("rank", "part")
    return few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(C("rank") <= top)


def collocations(df: DataFrame, least: int = LEAST, top: int = TOP, percent: int = 80, lang: str = "lang", text: str = "text", shard_words: int = SHARD_WORDS,
                 range_words: int = RANGE_WORDS) -> DataFrame:
    """Per language its best phrases: lang, rank, phrase, a, l, r, n, score."""
    docs = df.select(C(text).alias("text"), C(lang).alias("lang"))
    counted = materialize(hashed_counts(docs, shard_words).groupBy("key", "name").agg(F.sum("n").alias("n")).where(C("key").isNull() | (C("n") >= least)))
    totals = counted.where(C("key").isNull()).select(C("name").alias("lang"), "n")
    frequent = counted.where(C("key").isNotNull() & C("name").isNull()).select("key")
    words = totals.agg(F.sum("n")).first()[0] or 0
    borders = chosen_borders(counted, min(MOST_RANGES, max(1, -(-words // range_words))))
    power, table = filter_table(frequent, frequent.count())
    automata = united(materialize(shard_transducers(docs, power, table, borders, shard_words)), least)
    found = materialize(phrases(automata).withColumn("phrase", F.concat_ws(" ", "words")))
    size = F.size("words")
    cuts = found.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.withColumn("left", F.slice("words", F.lit(1), C("k"))).withColumn("rest", F.slice("words", C("k") + 1, size))
    asked = cuts.select("lang", F.explode(F.array("left", "rest")).alias("words")).groupBy("lang", "words").agg(F.count(F.lit(1)).alias("asks"))
    known = materialize(looked_up(asked, automata, borders))
    cuts = cuts.select("lang", "phrase", "a", "k", F.concat_ws(" ", "left").alias("left"), F.concat_ws(" ", "rest").alias("rest"))
    cuts = join_groups(cuts, known.select("lang", C("part").alias("left"), C("f").alias("l"), "asks"), ["lang", "left"], "asks").drop("asks")
    cuts = join_groups(cuts, known.select("lang", C("part").alias("rest"), C("f").alias("r"), "asks"), ["lang", "rest"], "asks").drop("asks")
    cuts = cuts.withColumn("score", F.expr("CAST(a AS DECIMAL(19, 0)) * 2000000BD DIV (CAST(l AS DECIMAL(19, 0)) + r)"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    longer = found.where(size > 2).select("lang", F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("inner"), C("a").alias("whole"))
    longer = longer.groupBy("lang", F.concat_ws(" ", "inner").alias("phrase")).agg(F.max("whole").alias("whole"))
    kept = scored.join(longer, ["lang", "phrase"], "left").where(C("whole").isNull() | (F.lit(100) * C("whole").cast("decimal(19,0)") < percent * C("a").cast("decimal(19,0)")))
    best = first_rows(kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score"), top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
