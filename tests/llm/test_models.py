"""Toxicity and line quality: planted cases, marginals against enumeration, odd rows."""
import itertools
import os
import random
import sys

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from helpers import SCHEMA, odd_documents, sentence  # noqa: E402

from barflow.llm import crf, toxicity  # noqa: E402
from barflow.llm.blocks import blocks  # noqa: E402


@pytest.fixture(scope="module")
def planted(spark):
    rng = random.Random(3)
    bad = ["zqwkfool", "vrmscumm", "kkljerkq"]
    rows, labels = [], []
    for i in range(700):
        lines = [sentence(rng, rng.randint(8, 16)) + "." for _ in range(rng.randint(3, 8))]
        toxic, poor = i % 5 == 0, i % 3 == 0
        if toxic:
            w = lines[1].split()
            for b in rng.sample(bad, 2):
                w.insert(rng.randint(1, len(w)), b)
            lines[1] = " ".join(w)
        if poor:
            lines = [" ".join(x + "###" for x in line.split()) for line in lines]
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(not poor), int(toxic)))
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


@pytest.mark.parametrize("kind", ["toxic", "quality"])
def test_held_out_accuracy(planted, kind):
    docs, labels = planted
    out = (toxicity.toxicity if kind == "toxic" else crf.quality)(docs, labels).join(labels, "doc_id").where("held_out").collect()
    right = sum(r.predicted == r[kind] for r in out) / len(out)
    assert len(out) > 80 and right > 0.9 and all(0 <= r.score <= 1 for r in out)


@pytest.mark.parametrize("score", [toxicity.toxicity, crf.quality])
def test_odd_rows(spark, planted, score):
    odd = spark.createDataFrame(odd_documents(), SCHEMA)
    docs, labels = planted
    both = docs.selectExpr("doc_id + 1000 as doc_id", "text").unionByName(odd.select("doc_id", "text"))
    out = score(both, labels.selectExpr("doc_id + 1000 as doc_id", "quality", "toxic")).where("doc_id < 1000 or doc_id is null").collect()
    assert len(out) == len(odd_documents()) and all(r.score is not None and 0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id in (0, 1, 2)}) == 1
    assert score(odd.where("false"), labels.where("false")).count() == 0
    assert score(odd, labels.where("false")).count() == len(odd_documents())


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    first, transition = np.array([0, 3, 3, 8, 9]), rng.normal(size=(2, 2))
    unary = rng.normal(size=9)
    got, counts = crf.Chains(first).marginals(unary, transition)
    want, pairs = np.zeros(9), np.zeros((2, 2))
    for a, b in zip(first, first[1:]):
        weights = {y: np.exp(sum(unary[a + i] * v for i, v in enumerate(y)) + sum(transition[p, q] for p, q in zip(y, y[1:])))
                   for y in itertools.product((0, 1), repeat=b - a)}
        total = sum(weights.values())
        for y, w in weights.items():
            want[a:b] += w / total * np.array(y)
            for p, q in zip(y, y[1:]):
                pairs[p, q] += w / total
    assert np.allclose(got, want) and np.allclose(counts, pairs)


def test_profiles_equal_one_window_at_a_time():
    """Gains and counts against plain compression of every window by itself; one text is longer than a block."""
    rng = random.Random(9)
    ordinary, trained, listed = (sentence(rng, n).encode() for n in (300, 40, 10))
    texts = [None, "", sentence(rng, 30) + " " + trained.decode() + " " + listed.decode(), sentence(rng, 5), " ".join([sentence(rng, 2000), listed.decode()] * 260)]
    gains = toxicity.Gains(ordinary, trained, listed)
    by = [toxicity.compressor(d + ordinary) for d in (b"", trained, listed)]
    got = np.concatenate([toxicity.profiles(b, gains) for b in blocks(pa.array(texts, pa.string()))])
    assert len(texts[-1]) > 2 << 20 and len(got) == len(texts)
    for text, row in zip(texts, got):
        windows = []
        for block in blocks(pa.array([text], pa.string())):
            data, segments, _ = toxicity.text_windows(block)
            windows = [data[a:a + n].tobytes() + b" " * toxicity.TAIL for a, n in segments]
        size = {w: [len(c.compress(w)) for c in by] for w in set(windows)}
        want = [sum(size[w][0] - size[w][k] >= g for w in windows) for k in (1, 2) for g in toxicity.GAINS] + [len(windows)]
        assert np.allclose(row, np.log1p(want))


def test_toxic_dictionary_is_trained():
    """With windows enough the trainer makes it (its magic number comes first), and toxic phrases gain by it alone."""
    rng = random.Random(4)
    phrase = "zqwkfool vrmscumm kkljerkq"
    texts = [sentence(rng, 40) + (f" {phrase} " if i % 2 else " ") + sentence(rng, 40) for i in range(1200)]
    ordinary, trained, _ = toxicity.fit_dictionaries(texts, np.arange(1200) % 2)
    assert trained[:4] == bytes.fromhex("37a430ec") and len(trained) <= toxicity.TOXIC_BYTES
    gain = toxicity.Gains(ordinary, trained).of_list([phrase.encode(), sentence(rng, 4).encode()])[0]
    assert gain[0] >= 4 and gain[1] <= 2


def test_windows_cover_every_word():
    rng = random.Random(2)
    texts = [sentence(rng, n) for n in (0, 1, 7, 300)] + ["", None]
    for block in blocks(pa.array(texts)):
        data, segments, first = toxicity.text_windows(block)
        for i in range(len(block)):
            found = b" ".join(data[a:a + n].tobytes() for a, n in segments[first[i]:first[i + 1]])
            assert found == (texts[i] or "").encode()
