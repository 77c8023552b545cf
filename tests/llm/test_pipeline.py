"""The pipeline's stages on planted rows: each takes what it should, and leaves the rest."""

import random
import sys
import time

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from claimweave.llm import bpe, langid, quality, simhash
from claimweave.llm.common import shared_dir

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, verdict string"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(8)
    en = "the a of and river house garden walked slowly through morning light with several quiet friends who were talking about old stories".split()
    words = lambda n: " ".join(rng.choice(en) + rng.choice(["", "s", "ed", "ing", "er"]) for _ in range(n))
    good = {i: words(80).capitalize() + "." for i in range(60)}
    bad = {i: "BUY NOW!!! $$$ " * rng.randint(10, 20) + words(2) for i in range(100, 140)}
    item = words(30)
    rest = {200: good[3], 201: good[4] + " more", 202: words(40) + " " + item + " " + words(40), 203: None, 204: "", 205: "12 34 !!"}
    rows = [(i, t, "en", "s", len(t or ""), "v") for i, t in (good | bad | rest).items()]
    path = str(tmp_path_factory.mktemp("planted"))
    docs = spark.createDataFrame(rows + rows[:1], SCHEMA)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 100), "en", None) for i in (good | bad)], "doc_id long, quality int, lang string, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, good


def test_stages(spark, planted):
    path, good = planted
    docs, ids = spark.read.parquet(f"{path}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, path)
        assert kept.columns == docs.columns, name
        docs = spark.createDataFrame(kept.collect(), SCHEMA)
        ids.append({r.doc_id for r in docs.collect()})
    language, quality, near, clean = ids
    assert not language & {203, 204, 205} and set(good) | {200, 201, 202} <= language
    assert not quality & set(range(100, 140)) and set(good) | {200, 201, 202} <= quality
    assert near == quality - {200, 201} and docs.count() == len(clean)
    assert clean == near - {202}
    last = {r.doc_id: r.n_tokens for r in corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()}
    encode = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode
    assert last == {i: len(encode(good[i], add_special_tokens=False).ids) for i in good}
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).collect()} == set(good)


def test_stages_on_no_documents(spark, planted):
    path, _ = planted
    none = spark.createDataFrame([], SCHEMA)
    assert all(stage(spark, none, path).count() == 0 for _, stage in corpus_pipeline.STAGES)


def test_near_dedup_links_fingerprints_and_similar_shingles(spark):
    rng = random.Random(21)
    words = lambda n: [f"w{rng.randint(0, 100_000)}" for _ in range(n)]
    chorus, other = ["buy now cheap"] * 60, words(300)
    first, second = " ".join([*chorus, *words(30)]), " ".join([*chorus, *words(30)])
    sets = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (first, second)]
    bits = [simhash.fingerprint(t) for t in (first, second)]
    assert (bits[0] ^ bits[1]).bit_count() <= 3 and len(sets[0] & sets[1]) < 0.2 * len(sets[0] | sets[1])
    whole, cut = " ".join(other), " ".join(other[:255])
    assert (simhash.fingerprint(whole) ^ simhash.fingerprint(cut)).bit_count() > 3
    docs = spark.createDataFrame([(1, first), (2, second), (3, second + " end"), (4, whole), (5, cut), (6, " ".join(words(50)))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 4, 6]


def test_forest_keeps_components(spark, monkeypatch):
    for most in (200_000, 3):
        monkeypatch.setattr(simhash, "FOREST_NODES", most)
        name = lambda i: i.to_bytes(16, "big")
        edges = [(name(i), name(i + 1)) for i in range(400) if i % 100 != 99] + [(name(900), name(7)), (name(7), name(900))]
        cut = simhash.forest(spark.createDataFrame(edges, "a binary, b binary"))
        got = {(bytes(r.node), bytes(r.root)) for r in simhash.components(cut).collect()}
        assert got == {(name(i), name(i // 100 * 100)) for i in range(400)} | {(name(900), name(0))}


def test_sample_crosses_to_the_driver_as_bytes(spark, monkeypatch):
    """The machine is the one that the features themselves give, and the driver holds no number as an object."""
    held, fit = [], quality.Machine.fit
    monkeypatch.setattr(quality.Machine, "fit", lambda self, rows, *a: held.extend(rows) or fit(self, rows, *a))
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 4) for _ in range(30)), 60) for i in range(90)]
    marks = {i: int(rng.random() < 0.5) for i, _, _ in rows}
    got = quality.train(spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), spark.createDataFrame(list(marks.items()), "doc_id long, quality int"))
    assert len(held) == 90 and all(type(part.base) is bytes for row in held for part in row) and held[0][0].itemsize == 4
    want = quality.Machine().fit([quality.features(t, n) for _, t, n in rows], np.array([marks[i] for i, _, _ in rows], dtype=float))
    assert (got.w == want.w).all() and (got.v == want.v).all() and got.bias == want.bias


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_python_workers_give_memory_back(spark):
    """Between the stages' tasks a worker keeps its models and memo, not the free memory of its last batches."""
    word = F.transform(F.sequence(F.lit(1), F.lit(260)), lambda k: F.conv(F.abs(F.hash(F.col("id") % 400, k)) % 60_000, 10, 36))
    path = shared_dir(spark, "workers")
    spark.range(0, 36_000, 1, 4).select(F.col("id").alias("doc_id"), F.concat_ws(" ", word).alias("text"), F.lit("en").alias("lang"), F.lit(1300).alias("n_chars")).write.parquet(path)
    docs = spark.read.parquet(path)
    spec = bpe.load_spec(public_tokenizers.path("word_bpe_49k.json"))

    def held(batches):
        list(batches)
        with open("/proc/self/status") as f:
            mb = next(int(line.split()[1]) for line in f if line.startswith("RssAnon")) / 1024
        time.sleep(0.5)  # so that every worker gets a task
        yield pa.RecordBatch.from_arrays([pa.array([mb])], names=["mb"])

    def most() -> float:
        return max(r.mb for r in spark.range(0, 12, 1, 12).mapInArrow(held, "mb double").collect())

    first = most()
    quality.score(docs, quality.Machine()).agg(F.sum("score")).collect()
    langid.identify(docs, langid.train(docs)).agg(F.sum("score")).collect()
    scored = most()
    bpe.encode_decode(docs, spec).agg(F.sum("n_tokens"), F.sum(F.length("ids") + F.length("decoded"))).collect()
    assert scored - first < 30 and most() - first < 110
