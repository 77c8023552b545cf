"""Queries against held-out labels, and each operator on empty tables, clashing columns, repeats and long texts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from claimweave.llm import ann, decontaminate, langid, ngram_lm, quality, queries, sharding, simhash, warc

DATA = "/root/testdata/sf0.01"
held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1


def test_quality_query_on_held_out_labels(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").where("quality IS NOT NULL").collect()}
    rows = queries.op3_quality(spark, DATA).collect()
    assert len(rows) == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    judged = [r.predicted == labels[r.doc_id] for r in rows if r.held_out and r.doc_id in labels]
    assert len(judged) > 20 and sum(judged) > 0.9 * len(judged)


def test_language_query_on_held_out_documents(spark):
    known = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = queries.op6_langid(spark, DATA).collect()
    assert len(rows) == len(known) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    assert all((r.lang_pred == "und") >= (not any(c.isalpha() for c in known[r.doc_id][1] or "")) for r in rows)
    judged = [r.lang_pred == known[r.doc_id][0] for r in rows if r.held_out and known[r.doc_id][0] and known[r.doc_id][1]]
    assert len(judged) > 20 and sum(judged) > 0.95 * len(judged)


def test_language_by_hand(spark):
    """A text's language has the largest share of its distinct trigrams, but for the filters' few false answers."""
    train = [("en", "the cat sat on the mat with that hat"), ("de", "der hund liegt auf dem alten sofa"), ("fr", "le chat est sur la petite table")]
    grams = {lang: Counter(langid.trigrams(t).tolist()) for lang, t in train}
    filters = langid.train(spark.createDataFrame([(i, t, lang) for i, (lang, t) in enumerate(train)], "doc_id long, text string, lang string"))
    rows = [(1, "that cat"), (2, "auf dem sofa " * 20_000), (3, "sur la table"), (1, "that cat")]
    got = sorted((r.doc_id, r.lang_pred) for r in langid.identify(spark.createDataFrame([(i, t, "x", 1.0) for i, t in rows], "doc_id long, text string, lang_pred string, score double"), filters).collect())
    best = lambda t: max(sorted(grams), key=lambda g: sum(x in grams[g] for x in langid.trigrams(t).tolist()))
    assert got == sorted((i, best(t)) for i, t in rows)
    assert langid.identify(spark.createDataFrame([], "doc_id long, text string"), filters).count() == 0


def test_quality_of_edge_rows(spark):
    docs = spark.createDataFrame([(i, "good words here." if i % 2 else "BUY!!", i, 0.5) for i in range(40)] + [(50, "good words here. " * 40_000, 1, 0.5), (3, "good words here.", 3, 0.5)], "doc_id long, text string, n_chars long, score double")
    machine = quality.train(docs, spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int"))
    got = quality.score(docs, machine)
    assert got.count() == 42 and got.columns.count("score") == 1
    assert quality.score(docs.limit(0), machine).count() == 0


def test_decontaminate_in_slices(spark):
    """A benchmark of several slices finds what one slice finds, beside columns of the operator's own names."""
    rng = random.Random(3)
    words = lambda n: " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(n))
    items = [(i, words(rng.randint(3, 40))) for i in range(12)]
    rows = [(i, f"{words(20)} {items[i % 12][1] if i % 3 else words(9)} {words(20)}") for i in range(30)] + [(40, None), (41, ""), (5, "tail"), (42, words(9) + " " + (words(50) + " ") * 3000 + items[2][1])]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, item_id string, hit string, verdict string")
    bench = spark.createDataFrame([*items, items[0], (None, None)], "item_id long, text string")
    hand = sorted((d, i, len(s := decontaminate.shingles_of(decontaminate.words_of(t))), n) for d, x in rows for i, t in set(items) for k in [min(5, len(decontaminate.words_of(t)))] if (n := len(decontaminate.shingles_of(decontaminate.words_of(x), k) & decontaminate.shingles_of(decontaminate.words_of(t)))) >= 0.8 * len(decontaminate.shingles_of(decontaminate.words_of(t))) - 1e-9 and x)
    for size in (1 << 20, 100):
        assert sorted(tuple(r) for r in decontaminate.contained_items(docs, bench, slice_bytes=size).collect()) == hand
        kept = decontaminate.uncontaminated(docs, bench, slice_bytes=size)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i not in {h[0] for h in hand} or (i, "tail") == (5, _))
    assert decontaminate.contained_items(docs.limit(0), bench).count() == 0 and decontaminate.uncontaminated(docs, bench.limit(0)).count() == len(rows)


def test_nearest_of_edge_tables(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0], 1, 2.0), (1, [1.0, 0.0], 1, 2.0), (2, [1.0, 0.0], 1, 2.0), (2, [1.0, 0.0], 1, 2.0)], "vec_id long, embedding array<double>, query_id int, score double")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.nearest(rows, F.col("id") % 20 == 0).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2)]
    assert ann.nearest(rows.limit(0), F.col("id") % 20 == 0).count() == 0


def test_nearest_sees_every_vector_of_an_id(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [5.0, 0.0]), (1, [5.0, 0.0]), (2, [0.5, 0.0]), (20, [-1.0, 0.25]), (20, [2.0, 0.0]), (3, [0.0, 0.0])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 5.0), (0, 2, 20, 2.0), (0, 3, 1, 1.0), (0, 4, 2, 0.5), (0, 5, 20, -1.0), (20, 1, 2, -0.5), (20, 2, 0, -1.0), (20, 3, 1, -1.0), (20, 4, 1, -5.0)]


def test_nearest_scores_are_products_of_the_vectors(spark):
    rng = random.Random(12)
    rows = [(i, [rng.gauss(0, 1) for _ in range(24)]) for i in range(300)]
    vectors = {i: np.array(v) for i, v in rows}
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, block=32).collect()
    assert len(got) == 15 * 20 and all(abs(r.score - float(vectors[r.query_id] @ vectors[r.vec_id])) < 1e-9 for r in got)


def test_one_of_each_keeps_columns_of_any_name(spark):
    rows = [(1, "a b c d e f", 77, 1, 2), (2, "a b c d e f", 78, 1, 2), (3, "other words in this text here", 79, 1, 2), (3, "other words in this text here", 79, 1, 2), (4, None, 80, 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __n int, __k1 int, row_doc_id_text___n___k1_2 int")
    got = simhash.one_of_each(docs)
    assert got.columns == docs.columns
    assert sorted(tuple(r) for r in got.select("doc_id", "__n", "__k1", "row_doc_id_text___n___k1_2").collect()) == [(1, 77, 1, 2), (3, 79, 1, 2), (4, 80, 1, 2)]


def test_warc_of_empty_and_clashing_tables(spark):
    pages = spark.createDataFrame([(1, "u", "h", "x"), (2, "v", "i" * 300_000, "x")], "page_id long, url string, html string, hash string")
    manifest = warc.layout(warc.leaves(warc.records(pages)))
    none = warc.leaves(warc.records(pages.limit(0)))
    assert {(r.page_id, r.kind) for r in warc.audit(manifest, none).collect()} == {(1, "lost"), (2, "lost")}
    assert {(r.page_id, r.kind) for r in warc.audit(warc.layout(none), warc.leaves(warc.records(pages))).collect()} == {(1, "extra"), (2, "extra")}
    assert warc.audit(warc.layout(none), none).count() == 0


def test_copies_and_shards_beside_clashing_columns(spark):
    rows = [(1, "a b c d " * 30_000, 7, 7), (2, "a b c d " * 30_000, 7, 7), (3, None, 7, 7), (4, "", 7, 7), (4, "", 7, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp long, shard int")
    assert Counter((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect()) == {(1, 1): 1, (2, 1): 1, (3, 3): 1, (4, 3): 2}
    got = sharding.shard_rows(docs, 2).collect()
    assert len(got) == 5 and len({r.shard for r in got if r.doc_id < 3}) == 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_base_score_of_a_long_text(spark):
    docs = spark.createDataFrame([(1, "A b", True, 9), (2, "a " * 200_000, False, 9)], "doc_id long, text string, learn boolean, n_tokens int")
    got = {r.doc_id: r for r in ngram_lm.score_all(docs, "learn").collect()}
    want = 200_000 * math.log10(2 / 7) + math.log10(2 / 7)  # counts a 1, b 1, end 1: N = 3, V = 3
    assert got[2].n_tokens == 200_001 and got[2].n_known == 200_001 and np.isclose(got[2].base_score, want, rtol=1e-9)
