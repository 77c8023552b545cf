"""The registered queries of the subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, decontaminate, langid, minhash, ngram_lm, orchard, quality, sharding, simhash, spelling, token_store, warc
from .common import id_bucket, materialize, read_table, shared_dir


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids in the store's format and read each back through the index."""
    docs = read_table(spark, sf_dir, "documents")
    path = shared_dir(spark, "token-store")
    token_store.write_store(docs, path, bpe.load_spec(public_tokenizers.path("byte_bpe_50k.json")))
    rows = token_store.lookup(spark, path, docs)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents."""
    rows = bpe.encode_decode(read_table(spark, sf_dir, "documents"), bpe.load_spec(public_tokenizers.path("word_bpe_49k.json")))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from the labelled rows that are not held out."""
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", id_bucket("doc_id", 3) == 1)
    machine = quality.train(docs.where(~F.col("held_out")), read_table(spark, sf_dir, "labels").where(id_bucket("doc_id", 3) != 1))
    return quality.score(docs, machine).select("doc_id", "held_out", "score", "predicted")


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item in every document that contains it."""
    return decontaminate.contained_items(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


OP4_SQL = r"""
WITH item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
item_shingles AS (
  SELECT DISTINCT item_id, least(len(w), 5) AS k, array_to_string(w[i:i + 4], ' ') AS s FROM item_words, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
doc_shingles AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM doc_words, (SELECT DISTINCT k FROM item_shingles) AS ks, unnest(range(1, greatest(len(w) - k + 2, 1))) AS t(i)),
sizes AS (SELECT item_id, count(*) AS n FROM item_shingles GROUP BY item_id)
SELECT d.doc_id, i.item_id, CAST(any_value(z.n) AS INTEGER) AS n_shingles, CAST(count(*) AS INTEGER) AS n_found
FROM doc_shingles d JOIN item_shingles i ON d.k = i.k AND d.s = i.s JOIN sizes z ON z.item_id = i.item_id
GROUP BY d.doc_id, i.item_id HAVING count(*) >= 0.8 * any_value(z.n)
"""


def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth id."""
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learnt from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents").withColumn("held_out", id_bucket("doc_id", 3) == 1)
    filters = langid.train(docs.where(~F.col("held_out")))
    return langid.identify(docs, filters).select("doc_id", "held_out", "lang_pred", "score")


def damaged(pages: DataFrame) -> DataFrame:
    """A replica of pages in which a rule on the id has altered, lost and added some."""
    mark = F.substring(F.md5(F.concat(F.lit("fixity "), F.coalesce(F.col("page_id").cast("string"), F.lit("")))), 1, 2)
    html = F.when(mark.isin("07", "17", "27", "37", "47", "57"), F.overlay("html", F.lit("#"), F.lit(1), F.lit(1))).otherwise(F.col("html"))
    kept = pages.where(~mark.isin("a3", "b3", "c3")).select("page_id", "url", html.alias("html"))
    return kept.unionByName(pages.where(mark == "5c").select("page_id", F.concat("url", F.lit("#copy")).alias("url"), "html"))


def op7_warc_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixity audit of a replica of all pages that a fixed rule has damaged."""
    pages = read_table(spark, sf_dir, "pages")
    manifest = warc.layout(warc.leaves(warc.records(pages)))
    return warc.audit(manifest, warc.leaves(warc.records(damaged(pages))))


OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, substr(md5('fixity ' || coalesce(CAST(page_id AS VARCHAR), '')), 1, 2) AS mark FROM pages),
replica AS (
  SELECT page_id, url, CASE WHEN mark IN ('07', '17', '27', '37', '47', '57') THEN '#' || substr(html, 2) ELSE html END AS html FROM p WHERE mark NOT IN ('a3', 'b3', 'c3')
  UNION ALL SELECT page_id, url || '#copy', html FROM p WHERE mark = '5c'),
both_sides AS (SELECT 0 AS side, page_id, url, html FROM p UNION ALL SELECT 1, page_id, url, html FROM replica),
ids AS (SELECT *, md5(coalesce(CAST(page_id AS VARCHAR), '') || ' ' || url) AS h FROM both_sides),
recs AS (
  SELECT side, page_id, url, 'WARC/1.0' || e || 'WARC-Type: resource' || e || 'WARC-Date: 1970-01-01T00:00:00Z' || e || 'WARC-Record-ID: <urn:uuid:'
    || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) || '>' || e
    || 'WARC-Target-URI: ' || url || e || 'Content-Type: text/html' || e || 'Content-Length: ' || CAST(strlen(html) AS VARCHAR) || e || e || html AS record
  FROM ids, (SELECT chr(13) || chr(10) AS e)),
leaf AS (SELECT side, page_id, url, row_number() OVER (PARTITION BY side, page_id, url ORDER BY sha256(record)) - 1 AS copy, strlen(record) + 4 AS length, sha256(record) AS hash FROM recs),
placed AS (
  SELECT *, CAST('0x' || substr(md5(coalesce(CAST(page_id AS VARCHAR), '') || ' ' || url || ' ' || CAST(copy AS VARCHAR)), 1, 8) AS BIGINT) % ((SELECT sum(length) FROM leaf WHERE side = 0) // 8388608 + 1) AS archive
  FROM leaf WHERE side = 0),
manifest AS (SELECT *, coalesce(sum(length) OVER (PARTITION BY archive ORDER BY page_id NULLS FIRST, url, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "offset" FROM placed),
found AS (SELECT page_id, url, copy, hash FROM leaf WHERE side = 1)
SELECT m.page_id, m.url, CAST(m.copy AS BIGINT) AS copy, CAST(m.archive AS BIGINT) AS archive, CAST(m."offset" AS BIGINT) AS "offset", CAST(m.length AS BIGINT) AS length,
  CASE WHEN f.hash IS NULL THEN 'lost' ELSE 'altered' END AS kind, m.hash AS expected, f.hash AS found
FROM manifest m LEFT JOIN found f ON m.page_id IS NOT DISTINCT FROM f.page_id AND m.url = f.url AND m.copy = f.copy WHERE f.hash IS DISTINCT FROM m.hash
UNION ALL
SELECT f.page_id, f.url, CAST(f.copy AS BIGINT), NULL, NULL, NULL, 'extra', NULL, f.hash
FROM found f WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.page_id IS NOT DISTINCT FROM f.page_id AND m.url = f.url AND m.copy = f.copy)
"""


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """log10 probability of all documents, learnt from those that are not held out."""
    docs = read_table(spark, sf_dir, "documents").withColumn("learn", id_bucket("doc_id", 7) != 2)
    return ngram_lm.score_all(docs, "learn").withColumn("held_out", id_bucket("doc_id", 7) == 2)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    rows = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents dealt to 40 shards of near equal bytes."""
    return sharding.shard_rows(read_table(spark, sf_dir, "documents"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents with their near words, forms and roots."""
    return spelling.variants(read_table(spark, sf_dir, "documents"))


#: crc32 bit by bit over a list of bytes, each followed by eight marks; near words by the words they give with one code point less.
OP11_SQL = r"""
WITH runs AS (
  SELECT doc_id, r AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]{7,}')) AS r FROM documents) GROUP BY ALL),
hexed AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
hashed AS (
  SELECT run, c, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten([[CAST('0x' || substr(x, 2 * i - 1, 2) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1] FOR i IN range(1, length(x) // 2 + 1)])),
    lambda s, e: CASE WHEN e >= 0 THEN xor(s, e) ELSE xor(s >> 1, 3988292384 * (s & 1)) END)) AS h FROM hexed),
spelt AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INTEGER)) || substr(run, CAST(h % length(run) AS INTEGER) + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM spelt WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS s FROM words, unnest(range(1, length(word) + 1)) AS t(i)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM less a JOIN less b ON a.s = b.s AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM less a JOIN words b ON a.s = b.word
  UNION SELECT b.word, a.word, a.n FROM less a JOIN words b ON a.s = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(struct_pack(other, n), struct_pack(m := -n, o := other)) AS top FROM near GROUP BY word),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top.n >= 10 * w.n THEN top.other END AS form, CASE WHEN top.n >= 10 * w.n THEN top.n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
chain AS (
  WITH RECURSIVE c AS (SELECT word, word AS root FROM forms UNION ALL SELECT c.word, f.form FROM c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL)
  SELECT c.word, c.root FROM c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM forms f JOIN chain c ON c.word = f.word
"""


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and class of near copies of all documents."""
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM words, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS t(i) WHERE len(w) > 0),
named AS (SELECT doc_id, list(s ORDER BY s) AS l, count(*) AS n FROM shingles GROUP BY doc_id),
sets AS (SELECT min(doc_id) AS node, n, l FROM named GROUP BY n, l),
parts AS (SELECT node, n, unnest(l) AS s FROM sets),
links AS (
  SELECT a.node AS a, b.node AS b FROM parts a JOIN parts b ON a.s = b.s AND a.node <> b.node
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach AS (SELECT node, node AS root FROM sets UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.root),
classes AS (SELECT node, min(root) AS component_id FROM reach GROUP BY node)
SELECT d.doc_id, coalesce(m.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(c.component_id, d.doc_id) AS kept
FROM documents d LEFT JOIN named m ON m.doc_id = d.doc_id LEFT JOIN sets s ON s.n = m.n AND s.l = m.l LEFT JOIN classes c ON c.node = s.node
"""


def op13_orchard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings."""
    return orchard.compress(read_table(spark, sf_dir, "embeddings"))


def _op13_sql() -> str:
    """Two rounds of nearest entry and floored mean, then the codes, by brute force; a table of nearest entries per round."""
    steps = []
    for r in range(3):
        steps.append(f"""near{r} AS (
  SELECT k, vec_id, label, p, v, arg_min(e, d * 64 + e) AS e, min(d) AS d
  FROM (SELECT x.*, b.e, list_sum([(x.v[i] - b.v[i]) * (x.v[i] - b.v[i]) FOR i IN range(1, len(x.v) + 1)]) AS d FROM parts x JOIN book{r} b ON b.p = x.p) GROUP BY k, vec_id, label, p, v)""")
        if r < 2:
            steps.append(f"""means{r} AS (SELECT p, e, list(m ORDER BY i) AS v FROM (SELECT p, e, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS m FROM near{r}, unnest(range(1, len(v) + 1)) AS t(i) GROUP BY p, e, i) GROUP BY p, e),
book{r + 1} AS (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM book{r} b LEFT JOIN means{r} m ON m.p = b.p AND m.e = b.e)""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) - 1 AS k, vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (SELECT k, vec_id, label, p, v[p * len(v) // 16 + 1:(p + 1) * len(v) // 16] AS v FROM kept, range(16) AS t(p)),
book0 AS (SELECT p, k AS e, v FROM parts WHERE k < 64),
{", ".join(steps)},
coded AS (SELECT k, vec_id, label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near2 GROUP BY k, vec_id, label),
named AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM book2)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM coded, named
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_store, op2_bpe, op3_quality, op4_decontaminate, op5_nearest, op6_langid, op7_warc_audit, op8_lm_score, op9_simhash, op10_sharding, op11_spelling_variants, op12_minhash, op13_orchard)}


def oracle_sql() -> dict[str, str]:
    return {"op4_decontaminate": OP4_SQL, "op7_warc_audit": OP7_SQL, "op11_spelling_variants": OP11_SQL, "op12_minhash": OP12_SQL, "op13_orchard": _op13_sql()}
