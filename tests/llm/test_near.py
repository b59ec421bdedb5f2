"""SuperMinHash: groups against all pairs, signatures against the plain algorithm."""
import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from helpers import SCHEMA, near_groups, odd_documents, sentence, shingles  # noqa: E402

from barflow.llm import superminhash as sm  # noqa: E402


def check(frame, docs):
    groups, sets = near_groups(docs)
    rows = sm.near_duplicates(frame).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.component_id, r.n_shingles, r.kept) == (groups[r.doc_id], len(sets[r.doc_id]), groups[r.doc_id] == r.doc_id)


def test_against_all_pairs(spark, data):
    frame = spark.read.parquet(f"{data}/documents.parquet")
    check(frame, {r.doc_id: r.text for r in frame.select("doc_id", "text").collect()})


def test_copies_of_a_hub(spark):
    """Every variant is near the hub, hardly any two variants are near each other; the hub is not the smallest id."""
    rng = random.Random(8)
    base = sentence(rng, 300).split()
    docs = {50: " ".join(base)}
    for i in [*range(50), *range(51, 90)]:
        w = list(base)
        for j in rng.sample(range(0, 300, 6), 7):
            w[j] = f"new{i}x{j}"
        docs[i] = " ".join(w)
    docs[95], docs[96] = docs[50].upper(), sentence(rng, 300)
    check(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), docs)


def test_odd_rows(spark):
    odd = spark.createDataFrame(odd_documents(), SCHEMA)
    rows = sm.near_duplicates(odd).collect()
    assert len(rows) == len(odd_documents())
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[0].n_shingles == by[1].n_shingles == by[2].n_shingles == 0 and by[0].kept and by[1].kept
    assert by[6].component_id == by[16].component_id == 4 and by[13].component_id == 12 and by[9].component_id == 8
    left = sm.deduplicate(odd).collect()
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == [0, 1, 2, 3, 4, 8, 11, 12, 14, 15] and len(left) == 12
    assert sm.near_duplicates(odd.where("false")).count() == sm.deduplicate(odd.where("false")).count() == 0


@pytest.mark.parametrize("n", [1, 2, 40, 3000])
def test_signature_is_the_plain_algorithm(n):
    rng = np.random.default_rng(n)
    hashes = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
    slots, best = 16, {}
    salt = sm.salts(slots, 29)
    for h in hashes:
        place = list(range(slots))
        for step in range(slots):
            with np.errstate(over="ignore"):
                r = sm.mix(np.array([h + salt[step]]))
                value = (step << 56) | int((sm.mix(r + np.uint64(sm.BASE)) >> np.uint64(8))[0])
            k = step + int(r[0] % np.uint64(slots - step))
            place[step], place[k] = place[k], place[step]
            best[place[step]] = min(value, best.get(place[step], value))
    got = sm.signatures(hashes, np.array([0, len(hashes)]), slots)[0]
    assert [int(x) for x in got] == [best[i] for i in range(slots)]


def test_estimate(spark):
    rng = random.Random(4)
    words = sentence(rng, 500).split()
    a, b = " ".join(words), " ".join(words[:450] + sentence(rng, 50).split())
    import pyarrow as pa
    sets, begin = sm.shingle_sets(next(sm.blocks(pa.array([a, b]))))
    x, y = sm.signatures(sets, begin)
    true = len(shingles(a) & shingles(b)) / len(shingles(a) | shingles(b))
    assert abs((x == y).mean() - true) < 0.15


def test_parity_sketch_bounds_the_difference():
    rng = np.random.default_rng(3)
    for n, change in ((50, 10), (400, 100), (3000, 900)):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[change:], rng.integers(0, 1 << 63, change).astype(np.uint64)]))
        x, y = sm.parities(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        bits = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
        assert 0 < bits <= len(np.setxor1d(a, b))
