"""Best-fit packing, FP-tree search and collocations against their SQL and brute force."""
import math
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from helpers import SCHEMA, odd_documents, sentence  # noqa: E402

from barflow.llm import bestfit, collocations, fptree  # noqa: E402
from barflow.llm.lexicon import Lexicon  # noqa: E402
from barflow.llm.queries import QUERIES, vocabulary  # noqa: E402

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ASCII = {c: c + 32 for c in range(65, 91)}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(vocabulary())
    t.no_truncation()
    t.no_padding()
    return t


# --- words by their bytes --------------------------------------------------------------------------------------------
def test_lexicon_tells_words_of_equal_hashes_apart():
    data = np.frombuffer(b"ab abc ab xy xyz", np.uint8)
    starts, ends = np.array([0, 3, 7, 10, 13]), np.array([2, 6, 9, 12, 16])
    for hashes in (None, np.zeros(5, np.uint64)):
        n = Lexicon().numbers(data, starts, ends, hashes)
        assert n[0] == n[2] and len(set(n.tolist())) == 4
    closed = Lexicon([b"xy", b"q", b"abc"], closed=True)
    assert closed.numbers(data, starts, ends, np.zeros(5, np.uint64)).tolist() == [-1, 2, -1, 0, -1]


# --- packing ----------------------------------------------------------------------------------------------------------
def plain_best_fit(sizes, window, limit):
    """The rule by lists: the open sequence with the least room that is enough; the fullest closes when all are open."""
    closed, bins = [], []
    for n in sizes:
        fits = [b for b in bins if window - sum(b) >= n]
        if fits:
            target = max(fits, key=sum)
        else:
            if len(bins) == limit:
                fullest = max(bins, key=sum)
                bins.remove(fullest)
                closed.append(fullest)
            target = []
            bins.append(target)
        target.append(n)
        if sum(target) == window:
            bins.remove(target)
            closed.append(target)
    return closed, bins


@pytest.mark.parametrize("limit", [1, 3, 20])
def test_bitset_follows_the_plain_rule(limit):
    rng = random.Random(limit)
    sizes = [rng.randint(1, 50) for _ in range(400)]
    bins, closed = bestfit.OpenBins(50, limit), []
    for n in sizes:
        closed += [[x[0] for x in b] for b in bins.add((n,))]
        assert bins.count <= limit
    want, still = plain_best_fit(sizes, 50, limit)
    rest = [[x[0] for x in b] for b in bins.rest()]
    assert sorted(map(sum, closed)) == sorted(map(sum, want)) and sorted(map(sum, rest)) == sorted(map(sum, still))
    assert [sum(b) for b in rest] == sorted((sum(b) for b in rest), reverse=True) and not bins.bits


def check_packing(pieces, texts, tokenizer, end_id, window):
    """``texts``: (key, text) rows. Every document lies in pieces as the contract says."""
    want = Counter()
    for key, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        for n, start in enumerate(range(0, len(ids), window)):
            part = np.array(ids[start:start + window], "<u4")
            want[key, n, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((p.doc_id, p.piece, p.start, p.length, zlib.crc32(p.ids)) for p in pieces) == want
    sequences = {}
    for p in pieces:
        sequences.setdefault(p.sequence_id, []).append(p)
    for parts in sequences.values():
        at = 0
        for p in sorted(parts, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
    return len(sequences), -(-sum(p.length for p in pieces) // window)


@pytest.mark.parametrize("limit,ahead,parts", [(bestfit.OPEN, bestfit.AHEAD, 3), (4, 1 << 14, 40)])
def test_packing_contract(spark, data, odd, tokenizer, limit, ahead, parts):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").union(odd.select("doc_id", "text")).repartition(parts)
    pieces = bestfit.best_fit(docs, vocabulary(), limit=limit, ahead=ahead).collect()
    used, least = check_packing(pieces, [tuple(r) for r in docs.collect()], tokenizer, 0, 2048)
    assert used <= (least + 1 if limit > 4 else 1.15 * least + 4)


def test_packing_query_and_empty_table(spark, data, odd):
    rows = QUERIES["op11_best_fit_packing"](spark, data)
    assert rows.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert rows.select("doc_id").distinct().count() == spark.read.parquet(f"{data}/documents.parquet").count()
    assert bestfit.best_fit(odd.where("false"), vocabulary()).count() == 0


# --- search -----------------------------------------------------------------------------------------------------------
def terms(text):
    return TERM.findall((text or "").translate(ASCII))


def brute_search(docs, items, k=10):
    """Rows (item, rank, key, score) from all documents."""
    held = [(key, Counter(terms(text))) for key, text in docs]
    held = [(key, c, sum(c.values())) for key, c in held if c]
    n, length = len(held), sum(x for _, _, x in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for key, c, size in held:
            m = 25 + 75 * size * n // length
            s = sum(times * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1000000000 * c[w] // (1000 * c[w] + 8 * m))
                    for w, times in Counter(terms(text)).items() if w in c)
            if s > 0:
                scores.append((-s, key is None, key or 0, key))
        out += [(item, rank, key, -s) for rank, (s, _, _, key) in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return out


def same(got, want):
    return sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("tree_docs,block_terms", [(8192, 8192), (7, 40)])
def test_search_equals_brute_force(spark, odd, tree_docs, block_terms):
    rng = random.Random(3)
    vocabulary_ = ["".join(rng.choice("abcde") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    docs = [(i, " ".join(rng.choice(vocabulary_) for _ in range(rng.randint(0, 60)))) for i in range(150)]
    docs += [(500 + i, docs[7][1]) for i in range(14)] + [(7, docs[7][1]), (None, docs[7][1])] + [(r[0], r[1]) for r in odd.select("doc_id", "text").collect()]
    items = [(i, " ".join(rng.choice(vocabulary_) for _ in range(12))) for i in range(9)] + [(1, docs[7][1]), (1, docs[7][1]), (20, None), (21, "... !"), (None, "abc"), (22, "unheard")]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumn("terms", odd.sparkSession.range(1).selectExpr("1 x").first() and __import__("pyspark").sql.functions.lit(3)).repartition(5)
    queries = spark.createDataFrame(items, "item_id bigint, text string").selectExpr("*", "1 as rank", "2 as score")
    found = fptree.search(table, queries, tree_docs=tree_docs, block_terms=block_terms)
    assert same([tuple(r) for r in found.select("item_id", "rank", "doc_id", "score").collect()], brute_search(docs, items))


def test_search_of_empty_tables(spark, odd):
    items = spark.createDataFrame([(1, "abc")], "item_id bigint, text string")
    assert fptree.search(odd.where("false"), items).count() == 0
    assert fptree.search(odd.where("text is null or text = ''"), items).count() == 0
    assert fptree.search(odd, items.where("false")).count() == 0


def test_bounds_hold_for_every_subtree():
    rng = np.random.default_rng(5)
    docs = [np.unique(rng.geometric(0.1, rng.integers(1, 12))) % 40 for _ in range(300)]
    docs = [np.unique(d) for d in docs]
    first = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    times, m = rng.integers(1, 5, first[-1]), rng.integers(25, 300, 300)
    tree = fptree.Tree(first, np.concatenate(docs), times, m, 40)
    own, weight = np.array([1, 2, 3, 7, 11]), np.array([5, 9, 11, 40, 80])
    places = np.full(40, -1)
    places[own] = np.arange(5)
    bound = (weight * fptree.gain(tree.most[:, own].astype(np.int64), tree.least[:, None])).sum(axis=1)
    leaves = [n for n in range(len(tree.low)) if not tree.children[n]]
    assert sorted(i for n in leaves for i in range(tree.low[n], tree.high[n])) == list(range(300)) and len(tree.low) > 20
    for n in range(len(tree.low)):
        inside = [leaf for leaf in leaves if tree.low[n] <= tree.low[leaf] and tree.high[leaf] <= tree.high[n]]
        assert bound[n] >= max(tree.exact(leaf, places, weight).max() for leaf in inside)


# --- phrases ----------------------------------------------------------------------------------------------------------
def brute_phrases(docs, least, top):
    n, f = Counter(), Counter()
    for lang, text in docs:
        lang = lang if lang is not None else "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(ASCII)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 5):
                f.update((lang, *w[i:i + size]) for i in range(len(w) - size + 1))
    many = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    whole = Counter()
    for (lang, *w), a in many.items():
        for size in range(2, len(w)):
            for i in range(len(w) - size + 1):
                inner = (lang, *w[i:i + size])
                whole[inner] = max(whole[inner], a)
    rows = {}
    for (lang, *w), a in many.items():
        score, _, left, right = min((2000000 * a // (f[lang, *w[:c]] + f[lang, *w[c:]]), c, f[lang, *w[:c]], f[lang, *w[c:]]) for c in range(1, len(w)))
        if 100 * whole[lang, *w] < 80 * a:
            rows.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return [(lang, rank, p.decode(), -a, left, right, n[lang], -s) for lang, found in rows.items() for rank, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]


def phrase_docs(seed=4, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdéÀ") for _ in range(rng.randint(1, 3))) for _ in range(12)]
    out = []
    for i in range(n):
        text = " ".join(rng.choice(words) + rng.choice(["", "", "", "", ",", ".\n", "\t"]) for _ in range(rng.randint(0, 80)))
        out.append((rng.choice(["en", "de", "en-x", None]), text + (" one two Three four five" if i % 3 else "")))
    return out + [("en", None), ("fr", ""), (None, "... ,, \n"), ("en", "one two three four " * 40)]


@pytest.mark.parametrize("shard_words,range_words,top", [(1 << 21, 1 << 23, 2000), (300, 200, 25)])
def test_collocations_equal_brute_force(spark, shard_words, range_words, top):
    docs = phrase_docs()
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "lang string, text string, a bigint, phrase string").repartition(6)
    found = collocations.collocations(table, least=5, top=top, shard_words=shard_words, range_words=range_words)
    want = brute_phrases(docs, 5, top)
    assert same([tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()], want) and len(want) > 40


def test_collocations_hold_with_a_filter_that_is_too_small(spark, monkeypatch):
    """A table of ones lets every n-gram pass: more work, the same result."""
    docs = phrase_docs(8, 40)
    monkeypatch.setattr(collocations, "filter_table", lambda keys, count: (19, np.full(1 << 16, 255, np.uint8)))
    found = collocations.collocations(spark.createDataFrame(docs, "lang string, text string"), least=4)
    assert same([tuple(r) for r in found.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()], brute_phrases(docs, 4, 2000))


def test_collocations_of_an_empty_table(spark):
    assert collocations.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
    assert collocations.collocations(spark.createDataFrame([(None, None), ("en", " . ")], "lang string, text string")).count() == 0


def random_counts(rng, words, n):
    grams = Counter()
    for _ in range(n):
        w = tuple(rng.choice(words) for _ in range(4))
        for size in range(1, 5):
            grams[w[:size]] += 1
    return grams


def automaton(grams):
    words = sorted({w for g in grams for w in g})
    number = {w: i + 1 for i, w in enumerate(words)}
    rows = sorted((tuple(number[w] for w in g) + (0,) * (4 - len(g)), n) for g, n in grams.items())
    return collocations.build(words, np.array([r for r, _ in rows]), np.array([n for _, n in rows]))


def test_transducers_are_united_and_composed():
    rng = random.Random(6)
    words = [bytes([c]) * k for c in b"abcd" for k in (1, 2)]
    parts = [random_counts(rng, words, n) for n in (50, 1, 200)]
    total = sum(parts, Counter())
    for least in (0, 6):
        names, grams, counts = collocations.unite([automaton(p) for p in parts], least)
        got = {tuple(names[i - 1] for i in g if i): int(n) for g, n in zip(grams.tolist(), counts)}
        assert got == {g: n for g, n in total.items() if n >= least}
        assert grams.tolist() == sorted(grams.tolist())
    asked = rng.sample(sorted(total), 60) + [(b"zz",), (b"a", b"zz"), (b"a", b"a", b"a", b"zz")]
    rows = sorted(asked)
    acceptor = automaton({g: i + 1 for i, g in enumerate(rows)})
    which, n = collocations.compose(acceptor, automaton(total))
    assert {rows[i - 1]: int(x) for i, x in zip(which, n)} == {g: total[g] for g in asked if g in total}


def test_equal_right_sides_are_stored_once():
    grams = {}
    for first in (b"a", b"b", b"c"):
        grams |= {(first,): 2, (first, b"x"): 2, (first, b"x", b"y"): 2}
    a = automaton(grams)
    assert len(a.begin) - 1 == 4  # the end, "y", "x y", the root
