"""Exact dedup, licence scan, shards and rules against their SQL and brute force."""
import os
import sys
import textwrap

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from harness import compare, duck  # noqa: E402
from helpers import SCHEMA, bare, odd_documents, sha  # noqa: E402
from licence_texts import TEXTS  # noqa: E402

from barflow.llm import cascade, licences, sharding, tree_dedup  # noqa: E402
from barflow.llm.queries import ORACLES, QUERIES  # noqa: E402


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, data, name):
    ok, message, _ = compare(spark, duck(data), data, QUERIES[name], ORACLES[name])
    assert ok, message


@pytest.mark.parametrize("name", ["op4_rule_cascade", "op5_exact_dedup", "op9_licence_scan"])
def test_oracle_on_odd_rows(spark, odd, tmp_path, name):
    path = str(tmp_path)
    odd.where("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(f"{path}/documents.parquet")
    import duckdb
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}/documents.parquet/*.parquet')")
    ok, message, _ = compare(spark, con, path, QUERIES[name], ORACLES[name])
    assert ok, message


def test_exact_dedup_odd_rows(spark, odd):
    rows = tree_dedup.duplicate_report(odd.repartition(5)).collect()
    assert len(rows) == odd.count()
    source = odd_documents()
    groups = {}
    for r in source:
        groups.setdefault(bare(r[1]), []).append(r)
    for key, members in groups.items():
        best = sorted(members, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))[0][0]
        mine = [x for x in rows if x.text_sha256 == sha(key)]
        assert len(mine) == len(members) and {x.keep_id for x in mine} == {best} and {x.group_size for x in mine} == {len(members)}
    left = tree_dedup.deduplicate(odd).collect()
    assert len(left) == len(groups) and len({bare(r.text) for r in left}) == len(groups) and left[0].asDict().keys() == {c.split()[0] for c in SCHEMA.split(", ")}


def test_tree_has_several_rounds(spark):
    docs = spark.range(600).selectExpr("id as doc_id", "repeat(cast(id % 7 as string), 3) as text").repartition(40)
    rows = tree_dedup.duplicate_report(docs).collect()
    assert len(rows) == 600 and sum(r.kept for r in rows) == 7 and all(r.keep_id == int(r.keep_id) % 7 for r in rows if r.kept)


def test_empty_tables(spark, odd):
    none = odd.where("false")
    assert tree_dedup.duplicate_report(none).count() == tree_dedup.deduplicate(none).count() == 0
    assert licences.licence_scan(none).count() == sharding.extendible_shards(none).count() == 0
    assert cascade.rule_report(none).count() == cascade.accepted(none).count() == 0


def test_cascade_order_does_not_matter(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    kept = {r.doc_id for r in cascade.rule_report(docs).where("kept").collect()}
    assert kept == {r.doc_id for r in cascade.accepted(docs, rules=cascade.RULES[::-1]).select("doc_id").collect()} and 0 < len(kept) < docs.count()
    order = cascade.ordered(docs)
    assert sorted(r.name for r in order) == sorted(r.name for r in cascade.RULES)


def test_labelled_documents_are_kept_apart(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    judged = cascade.rule_report(docs).join(labels, "doc_id").where("n_words >= 50")
    assert judged.where("kept and quality = 0 or not kept and quality = 1").count() == 0


def test_licences(spark):
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
           "\"Software\"), to deal in the Software without restriction; The above copyright notice and this permission notice shall be included in all "
           "copies or substantial portions of the Software.")
    apache = "Licensed under the Apache License, Version 2.0.\nYou may not use this file except in compliance with the License."
    rows = licences.licence_scan(spark.createDataFrame([(1, f"Intro. {mit} More."), (2, apache), (3, "Released under the MIT License.\n" + apache),
                                                        (4, "no licence here"), (5, None)], "doc_id int, text string")).collect()
    got = {r.doc_id: (r.licences, r.rule_numbers, r.sentence_ids, r.n_sentences) for r in rows}
    assert got == {1: ("MIT", "3", "5,6", 4), 2: ("Apache-2.0", "2", "1,2", 2), 3: ("Apache-2.0,MIT", "2,7", "4,1,2", 3), 4: ("", "", "", 1), 5: ("", "", "", 0)}


@pytest.mark.parametrize("limit,bits", [(500, 3), (3000, 8), (1 << 20, 8)])
def test_shards(spark, odd, limit, bits):
    docs = odd.select("doc_id", "text").union(spark.range(100, 400).selectExpr("id", "repeat('ab', cast(id % 50 as int))"))
    rows = sharding.extendible_shards(docs, limit=limit, round_bits=bits).collect()
    assert len(rows) == docs.count()
    hashes = sorted((format(r.h, "060b"), r.bytes) for r in sharding.hashed(docs).collect())
    size = {}
    for h, b in hashes:
        for d in range(61):
            size[h[:d]] = size.get(h[:d], 0) + b
    expected = sorted((next((h[:d] for d in range(61) if size[h[:d]] <= limit), h), b) for h, b in hashes)
    assert sorted((r.shard, r.bytes) for r in rows) == expected
    assert all(r.depth == len(r.shard) and r.shard_bytes == size[r.shard] and r.oversized == (size[r.shard] > limit) for r in rows)


def test_unedited_licences(spark):
    texts = {(name, how): t for name, text in TEXTS.items() for how, t in (
        ("as published", text), ("in prose", "Some words\nand more\n\n" + text + "\nLast words"), ("commented", "\n".join(" * " + x for x in text.splitlines())),
        ("unwrapped", "\n\n".join(" ".join(p.split()) for p in text.split("\n\n"))), ("narrow", "\n\n".join(textwrap.fill(p, 40) for p in text.split("\n\n"))))}
    keys = list(texts)
    rows = licences.licence_scan(spark.createDataFrame([(i, texts[k]) for i, k in enumerate(keys)], "doc_id int, text string")).collect()
    assert {keys[r.doc_id]: r.licences for r in rows} == {k: k[0] for k in keys}
    apart = licences.licence_scan(spark.createDataFrame([(1, "a line\nLicensed under CC BY 4.0.\nAll rights\nreserved"), (2, "x licensed under\nCC BY 4.0")],
                                                        "doc_id int, text string")).collect()
    assert {r.doc_id: (r.licences, r.n_sentences) for r in apart} == {1: ("CC-BY-4.0,Proprietary", 4), 2: ("", 2)}
