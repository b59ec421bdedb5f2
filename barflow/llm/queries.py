"""Registered queries of the text operators, each over its whole table, with SQL where SQL can say the same."""
from __future__ import annotations

from pyspark.sql import functions as F

from barflow.llm import bestfit, bpe, cascade, collocations, crf, fptree, licences, packing, sharding, superminhash, toxicity, tree_dedup, warc


def table(spark, sf_dir: str, name: str):
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_compression_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_superminhash(spark, sf_dir):
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_warc_segments(spark, sf_dir):
    return warc.archived(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "segments")


def op4_rule_cascade(spark, sf_dir):
    return cascade.rule_report(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark, sf_dir):
    return tree_dedup.duplicate_report(table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    """Path of the public vocabulary that the contracts name."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def op6_backtracking_bpe(spark, sf_dir):
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op7_line_crf(spark, sf_dir):
    return crf.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_retrieval_packing(spark, sf_dir):
    pieces = packing.packed(table(spark, sf_dir, "documents"), vocabulary(), end_id=2)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op9_licence_scan(spark, sf_dir):
    return licences.licence_scan(table(spark, sf_dir, "documents"))


def op10_extendible_shards(spark, sf_dir):
    return sharding.extendible_shards(table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark, sf_dir):
    pieces = bestfit.best_fit(table(spark, sf_dir, "documents"), vocabulary(), end_id=0)
    return pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op12_fp_tree_search(spark, sf_dir):
    return fptree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_automaton_collocations(spark, sf_dir):
    return collocations.collocations(table(spark, sf_dir, "documents"))


RULES_SQL = r"""
t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS x FROM {source}),
d AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM t),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY rid),
ln AS (SELECT rid, unnest(string_split(x, chr(10))) AS l FROM t),
dl AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT d.doc_id, d.rid, len(w) AS n_words, length(regexp_replace(x, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
  length(regexp_replace(x, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(x, '[^!]', '', 'g')) AS n_marks,
  coalesce(dl.n, 0) AS n_dup_lines, coalesce(dl.n_lines, 0) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM d LEFT JOIN cov USING (rid) LEFT JOIN dl USING (rid)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  10 * n_symbols > 3 * n_words OR 10 * n_marks > 3 * n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words
  AS rejected FROM m)"""

SHARDS_SQL = r"""
WITH RECURSIVE hx AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS bytes,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h FROM documents),
p AS (SELECT d, h >> (60 - d) AS prefix, bytes FROM hx, range(0, 25) AS r(d)),
s AS (SELECT d, prefix, sum(bytes)::BIGINT AS b, count(*) AS n FROM p GROUP BY d, prefix),
f AS (SELECT hx.doc_id, hx.bytes, hx.h, min(s.d) AS d FROM hx JOIN s ON s.prefix = hx.h >> (60 - s.d) AND s.b <= {limit} GROUP BY hx.doc_id, hx.bytes, hx.h)
SELECT f.doc_id, f.bytes::BIGINT AS bytes, CASE WHEN f.d = 0 THEN '' ELSE lpad(to_binary(s.prefix), f.d::INT, '0') END AS shard,
  f.d::INT AS depth, s.b AS shard_bytes, s.n AS shard_rows, false AS oversized
FROM f JOIN s ON s.d = f.d AND s.prefix = f.h >> (60 - f.d)"""


def _licence_sql() -> str:
    known = ", ".join(f"({i}, '{s}')" for i, s in licences.SENTENCES.items())
    steps, prev = [], "r0"
    for n, (_, _, ids) in enumerate(licences.RULES, 1):
        tags = "".join(f"<{i}>" for i in ids)
        steps.append(f"r{n} AS (SELECT rid, replace(rest, '{tags}', '<0>') AS rest, CASE WHEN contains(rest, '{tags}') THEN list_append(hits, {n}) "
                     f"ELSE hits END AS hits FROM {prev})")
        prev = f"r{n}"
    rules = ", ".join(f"({n}, '{a}', '{k}')" for n, (a, k, _) in enumerate(licences.RULES, 1))
    return rf"""WITH t AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS x FROM documents),
known AS (SELECT * FROM (VALUES {known}) AS k(id, sentence)), rules AS (SELECT * FROM (VALUES {rules}) AS k(n, licence, kind)),
cut AS (SELECT rid, string_split(regexp_replace(x, '([.!?;])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10)) AS parts FROM t),
e AS (SELECT rid, unnest(parts) AS s, unnest(range(len(parts))) AS pos FROM cut),
q AS (SELECT rid, pos, trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) AS s FROM e),
z AS (SELECT rid, pos, coalesce(id, 0) AS id FROM q LEFT JOIN known ON sentence = s WHERE s <> ''),
g AS (SELECT rid, count(*) AS n_sentences, string_agg('<' || id || '>', '' ORDER BY pos) AS rest,
  string_agg(CASE WHEN id > 0 THEN id::VARCHAR END, ',' ORDER BY pos) AS sentence_ids FROM z GROUP BY rid),
r0 AS (SELECT rid, rest, []::INT[] AS hits FROM g), {", ".join(steps)},
h AS (SELECT rid, unnest(hits) AS n FROM {prev}),
a AS (SELECT rid, string_agg(n::VARCHAR, ',' ORDER BY n) AS rule_numbers FROM h GROUP BY rid),
b AS (SELECT rid, string_agg(licence, ',' ORDER BY n) AS licences FROM (SELECT rid, licence, min(n) AS n FROM h JOIN rules USING (n) GROUP BY rid, licence) GROUP BY rid),
c AS (SELECT rid, string_agg(kind, ',' ORDER BY n) AS kinds FROM (SELECT rid, kind, min(n) AS n FROM h JOIN rules USING (n) GROUP BY rid, kind) GROUP BY rid)
SELECT doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids, coalesce(rule_numbers, '') AS rule_numbers,
  coalesce(licences, '') AS licences, coalesce(kinds, '') AS kinds
FROM t LEFT JOIN g USING (rid) LEFT JOIN a USING (rid) LEFT JOIN b USING (rid) LEFT JOIN c USING (rid)"""


LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SEARCH_SQL = rf"""WITH t AS (SELECT doc_id, row_number() OVER () AS rid,
  regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT count(*) AS big_n, sum(len(w))::BIGINT AS big_l FROM t WHERE len(w) > 0),
q AS (SELECT item_id, row_number() OVER () AS qid, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
qt AS (SELECT qid, item_id, term, count(*) AS times FROM (SELECT qid, item_id, unnest(w) AS term FROM q) GROUP BY ALL),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(w) AS term FROM t) SEMI JOIN qt USING (term) GROUP BY ALL),
wt AS (SELECT term, floor(1000 * ln((2 * any_value(big_n) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, g GROUP BY term),
m AS (SELECT rid, doc_id, 25 + (75 * len(w) * big_n) // big_l AS m FROM t, g WHERE len(w) > 0),
sc AS (SELECT qid, item_id, doc_id, sum(times * wt.w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM qt JOIN tf USING (term) JOIN wt USING (term) JOIN m USING (rid) GROUP BY qid, item_id, rid, doc_id),
r AS (SELECT item_id, (row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score FROM sc WHERE score > 0)
SELECT * FROM r WHERE rank <= 10"""

PHRASES_SQL = rf"""WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER.format("coalesce(text, '')")}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
tot AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k, w[i:i + k - 1] AS parts FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 5) AS s(k))),
f AS (SELECT lang, phrase, k, count(*) AS f, any_value(parts) AS parts FROM g GROUP BY lang, phrase, k HAVING count(*) >= 30),
c AS (SELECT lang, phrase, k, f AS a, parts, unnest(range(1, k)) AS cut FROM f WHERE k > 1),
s AS (SELECT c.lang, c.phrase, c.k, a, c.parts, cut, l.f AS l, r.f AS r, ((2000000::HUGEINT * a) // (l.f + r.f))::BIGINT AS score FROM c
  JOIN f AS l ON l.lang = c.lang AND l.phrase = array_to_string(c.parts[1:cut], ' ') JOIN f AS r ON r.lang = c.lang AND r.phrase = array_to_string(c.parts[cut + 1:], ' ')),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
i AS (SELECT lang, f, array_to_string(parts[j:j + z - 1], ' ') AS phrase FROM
  (SELECT lang, f, parts, z, unnest(range(1, k - z + 2)) AS j FROM f, range(2, 4) AS s(z) WHERE k > z)),
x AS (SELECT lang, phrase, max(f) AS whole FROM i GROUP BY lang, phrase),
d AS (SELECT b.* FROM b LEFT JOIN x USING (lang, phrase) WHERE whole IS NULL OR 100 * whole < 80 * a)
SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM d JOIN tot USING (lang)) WHERE rank <= 2000"""

QUERIES = {f.__name__: f for f in (
    op1_compression_toxicity, op2_superminhash, op3_warc_segments, op4_rule_cascade, op5_exact_dedup, op6_backtracking_bpe, op7_line_crf,
    op8_retrieval_packing, op9_licence_scan, op10_extendible_shards, op11_best_fit_packing, op12_fp_tree_search, op13_automaton_collocations)}

ORACLES = {
    "op4_rule_cascade": "WITH " + RULES_SQL.format(source="documents") + """
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT (base_failed OR rejected) AS kept FROM v""",
    "op5_exact_dedup": r"""WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS s FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY s ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY s) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, s AS text_sha256 FROM k""",
    "op9_licence_scan": _licence_sql(),
    "op12_fp_tree_search": SEARCH_SQL,
    "op13_automaton_collocations": PHRASES_SQL,
    "op10_extendible_shards": SHARDS_SQL.format(limit=sharding.SHARD_BYTES),
}
