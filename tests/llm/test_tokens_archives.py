"""Encoding against the tokenizers library, packing against its contract, archives round trips, the pipeline against brute force."""
import base64
import collections
import hashlib
import os
import random
import sys
import zlib

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from helpers import SCHEMA, bare, near_groups, odd_documents, sentence  # noqa: E402

import corpus_pipeline  # noqa: E402
from barflow.llm import bpe, cascade, crf, packing, warc  # noqa: E402
from barflow.llm.queries import QUERIES, vocabulary  # noqa: E402


@pytest.fixture(scope="module")
def library():
    tokenizers = pytest.importorskip("tokenizers")
    return tokenizers.Tokenizer.from_file(vocabulary())


@pytest.fixture(scope="module")
def tables():
    return bpe.prepared(bpe.load_tables(vocabulary()))


def ids_of(text, tables):
    return bpe.encode_block(next(bpe.blocks(pa.array([text], pa.string()))), tables)[0].tolist()


def test_encoding_equals_the_library(tables, library):
    rng = random.Random(1)
    alphabets = ["abeilnorst", "aeiou bcdst'ré ß<|>#%*12\n\tΣσİẞñ", "it's we'll 've  ́é", "aab", "日本語 текст العربية 🙂"]
    texts = ["".join(rng.choice(a) for _ in range(rng.randint(1, 60))) for a in alphabets for _ in range(1500)]
    texts += ["<|endoftext|>" + t[:9] + "<|startoftext|>" for t in texts[::100]] + ["%" * 5000, "ab" * 5000, "\x00\x01x\x1fy"]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        got = ids_of(text, tables)
        assert got == want.ids, text
        assert bpe.decode(np.array(got), tables).decode() == library.decode(got, skip_special_tokens=False)


def test_compatibility_means_merges_stop(tables):
    rng = random.Random(9)
    spelled, inner = tables["spelling"], [i for i, s in tables["spelling"].items() if ord(s[-1]) < 256]
    for _ in range(3000):
        a, b = rng.choice(inner), rng.choice(list(spelled))
        assert bpe.compatible(a, b, tables) == (bpe.merged(spelled[a] + spelled[b], tables) == [a, b])


def test_round_trip(spark, data, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op6_backtracking_bpe"](spark, data).collect():
        ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_encode_then_decode_frames(spark, library):
    odd = spark.createDataFrame(odd_documents(), SCHEMA)
    frame = bpe.encoded(odd, vocabulary())
    got = {(r.doc_id, tuple(r.ids)) for r in frame.collect()}
    assert got == {(r[0], tuple(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in odd_documents()}
    back = bpe.decoded(frame.where("doc_id = 4"), vocabulary()).first()
    assert back.text.replace("</w> ", " ").replace("</w>", "").replace(" ", "") == bare(odd_documents()[4][1])
    assert bpe.round_trip(odd.where("false"), vocabulary()).count() == 0


def check_pieces(rows, texts, library):
    """Gapless pieces and sequences, whole documents, no padding; ``texts`` maps keys to texts."""
    by, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert by.keys() == texts.keys()
    for key, text in texts.items():
        ids, at = [*library.encode(text or "", add_special_tokens=False).ids, 2], 0
        for r in sorted(by[key], key=lambda r: r.start):
            assert (r.start, r.doc_tokens) == (at, len(ids)) and bytes(r.ids) == np.array(ids[at:at + r.length], "<u4").tobytes()
            at += r.length
        assert at == len(ids)
    for pieces in sequences.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= 4096 and at & (at - 1) == 0


def test_packing(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    check_pieces(packing.packed(docs, vocabulary(), shard_tokens=20_000).collect(), texts, library)
    crc = QUERIES["op8_retrieval_packing"](spark, data).where("start = 0").first()
    ids = [*library.encode(texts[crc.doc_id], add_special_tokens=False).ids, 2]
    assert crc.ids_crc32 == zlib.crc32(np.array(ids[:crc.length], "<u4").tobytes())


def test_packing_odd_rows(spark, library):
    rows = [r for r in odd_documents() if r[0] not in (4, None)]
    odd = spark.createDataFrame(rows, SCHEMA)
    check_pieces(packing.packed(odd, vocabulary()).collect(), {r[0]: r[1] for r in rows}, library)
    everything = packing.packed(spark.createDataFrame(odd_documents(), SCHEMA), vocabulary()).selectExpr("sum(length)").first()[0]
    assert everything == sum(len(library.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in odd_documents())
    assert packing.packed(odd.where("false"), vocabulary()).count() == 0


def test_neighbours_share_a_window():
    rng = np.random.default_rng(1)
    docs = [np.concatenate([rng.integers(100 * (i % 4), 100 * (i % 4) + 100, 250), [2]]).astype(np.uint16) for i in range(64)]
    frequency = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=packing.VOCABULARY)
    pieces = packing.pack_shard(docs, frequency, len(docs), 251.0, window=1004)
    kinds = collections.defaultdict(collections.Counter)
    for doc, _, n, sequence, _ in pieces:
        kinds[sequence][doc % 4] += n
    assert sum(max(c.values()) for c in kinds.values()) > 0.9 * sum(map(len, docs))


def test_scores_use_every_distinct_id():
    rng = np.random.default_rng(3)
    docs = [np.minimum(rng.zipf(1.3, n), 3000).astype(np.uint16) for n in rng.integers(5, 900, 80)]
    held = [np.bincount(d, minlength=packing.VOCABULARY) for d in docs]
    frequency, mean = np.sum([h > 0 for h in held], axis=0), float(np.mean([len(d) for d in docs]))
    rarity = np.log1p((len(docs) - frequency + 0.5) / (frequency + 0.5))
    index = packing.Index(docs, frequency, len(docs), mean)
    assert max(len(np.unique(d)) for d in docs) > 200
    for seed in docs:
        want = [(rarity * h * 2.2 / (h + 1.2 * (0.25 + 0.75 * len(d) / mean)))[np.unique(seed)].sum() for d, h in zip(docs, held)]
        np.testing.assert_allclose(index.scores(seed), want, rtol=1e-9)


def digest(data):
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def test_archives(spark):
    rng = random.Random(6)
    long = sentence(rng, 9000) + "é" * 5000
    pages = [(1, "http://a/1", "x"), (2, "http://a/2\r\nEvil: 1", "x"), (3, None, None), (4, "http://a/4", ""), (5, "http://a/5", long), (6, "http://b/6", long),
             (7, "u", long + "!"), (7, "u", long + "!"), (None, "n", "null key"), (9, "r", "WARC/1.1\r\n\r\n0\r\n\r\n")]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("row", warc.F.lit(1)).repartition(3)
    out = warc.archived(frame, segment=4096).collect()
    assert len(out) == len(pages) and all(r.complete for r in out)
    want = []
    for key, _, html in pages:
        data = (html or "").encode()
        head = max((p[0] for p in pages if (p[2] or "") == (html or "") and p[0] is not None), default=None)
        want.append((key, len(data), digest(data), head))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.refers_to or r.page_id) for r in out), key=repr) == sorted(want, key=repr)
    for r in out:
        if r.record_type == "response":
            assert r.refers_to is None and digest(bytes(r.payload)) == r.payload_digest
    assert sum(r.record_type == "revisit" for r in out) == 4 and max(r.segments for r in out) > 10
    assert warc.archived(frame.where("false")).count() == 0


def test_lost_and_repeated_segments():
    records = [x for r in warc.page_records("urn:page:1:1", "u", b"y" * 10000, digest(b"y" * 10000), None, segment=3000) for x in warc.parsed(r + b"\r\n\r\n")]
    parts = [warc._segment(*x) for x in records]
    whole = warc.reassembled([parts[0], *parts])
    assert whole["complete"] and whole["payload"] == b"y" * 10000 and whole["segments"] == len(parts) == 4
    assert not warc.reassembled(parts[:-1])["complete"] and not warc.reassembled([parts[0], *parts[2:]])["complete"]
    short = [*parts[:-1], parts[-1] | {"block": parts[-1]["block"][:-1]}]
    assert not warc.reassembled(short)["complete"]
    assert warc.unchunked(b"3\r\nabc\r\n0\r\n\r\n") == b"abc" and warc.unchunked(b"3\r\nabcd\r\n0\r\n\r\n") is None and warc.unchunked(b"zz") is None


def test_pipeline_against_brute_force(spark, data, library):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    labels = spark.read.parquet(f"{data}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    good = {r.doc_id for r in cascade.rule_report(docs).where("kept").collect()}
    good &= {r.doc_id for r in crf.quality(docs, labels).where("predicted = 1").collect()}
    groups = collections.defaultdict(list)
    for k in good:
        groups[bare(texts[k])].append(k)
    left = {min(v, key=lambda k: (-len(texts[k]), k)): None for v in groups.values()}
    near, _ = near_groups({k: texts[k] for k in left})
    left = {k: texts[k] for k in left if near[k] == k}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "quality_classifier", "exact_dedup", "near_dedup", "packing"]
    for _, stage in corpus_pipeline.STAGES[:1]:
        assert stage(spark, docs, data).schema == docs.schema
    check_pieces(corpus_pipeline.run(spark, data).collect(), left, library)
