"""Streams against their batch twins: any order of arrival, late rows, state that ends, buckets that stay."""

import json
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_operators import streamed

from claimweave.operators import claims, graph, users
from claimweave.streaming import jobs, keyed


@pytest.fixture(autouse=True)
def keyed_state(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    keyed.use_keyed_state(spark)
    yield
    spark.conf.set(name, before)


def shuffled(rng, rows, n):
    rng.shuffle(rows)
    return [rows[i::n] for i in range(n)]


def stated(spark, path, name):
    return spark.read.format("statestore").option("stateVarName", name).load(str(path / "ck"))


def test_throttle_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    rows = [(rng.choice("ab"), rng.randint(0, 9000), i) for i in range(120)] + [("a", 77, 500), ("a", 77, 501), (None, 5, 600), (None, 7, 601), ("c", None, 700), ("c", None, 701)]
    ends = [[("z", 10**6, 900)], [("z", 10**7, 901)]]
    batches = shuffled(rng, rows, 3) + ends
    job = lambda s: keyed.throttle_stream(s.select("key", F.timestamp_seconds("t").alias("ts"), "id"), 300, "3 hours")
    got = streamed(spark, tmp_path, job, batches, "key string, t long, id long")
    table = spark.createDataFrame(rows, "key string, t long, id long").select("key", F.timestamp_seconds("t").alias("ts"), "id")
    want = sorted(str(tuple(r)) for r in users.throttle(table, "key").collect())
    assert sorted(str(tuple(r)) for r in got.where("key IS NULL OR key <> 'z'").select("key", "id").collect()) == want
    # Late: behind the watermark, so neither accepted nor kept.
    late = streamed(spark, tmp_path, job, [[("a", 20_000, 1000)]], "key string, t long, id long")
    assert late.where("id = 1000").count() == 0
    # Only the last row, which the watermark has not passed, is still held.
    assert stated(spark, tmp_path, "rows").count() == 1 and stated(spark, tmp_path, "held").count() == 0


def test_trajectory_in_any_order(spark, tmp_path):
    rng = random.Random(5)
    rows = [(u, 100 * i + u, 1000 * i + u, rng.choice([None, float(rng.randint(50, 455))])) for i in range(20) for u in (1, 2)] + [(3, None, 5000, 60.0)]
    day = 86_400
    batches = shuffled(rng, list(rows), 3) + [[(9, 3 * day, 1, 60.0)], [(1, 500 * day, 2, 60.0)], [(9, 900 * day, 3, 60.0)]]
    job = lambda s: keyed.trajectory_stream(s.select("user_id", F.timestamp_seconds("t").alias("ts"), "id", "y"), "2 hours", 100)
    got = streamed(spark, tmp_path, job, batches, "user_id long, t long, id long, y double")
    want = users.drift(spark.createDataFrame(rows, "user_id long, t long, id long, y double").withColumn("ts", F.timestamp_seconds("t")))
    cols = ["user_id", "id", "score", "delta", "trend", "zone_changed"]
    assert sorted(tuple(r) for r in got.where("step > 1 AND user_id < 9").select(cols).collect()) == sorted(tuple(r) for r in want.select(cols).collect())
    # After so long without a snapshot a user starts anew.
    assert [(r.step, r.delta) for r in got.where("user_id = 1 AND id = 2").collect()] == [(1, None)]
    assert stated(spark, tmp_path, "held").count() == 0


def test_expiry(spark, tmp_path):
    day = 86_400
    batches = [[(1, 0), (2, 5 * day), (2, 3 * day), (3, None)], [(1, 20 * day)], [(4, 40 * day)], [(4, 61 * day)]]
    job = lambda s: keyed.expiry_stream(s.select("user_id", F.timestamp_seconds("t").alias("ts")))
    got = streamed(spark, tmp_path, job, batches, "user_id long, t long")
    seen = sorted((r.user_id, r.a // day, r.b // day) for r in got.select("user_id", F.unix_timestamp("saved").alias("a"), F.unix_timestamp("expired").alias("b")).collect())
    assert seen == [(1, 20, 50), (2, 5, 35)]
    assert stated(spark, tmp_path, "saved").count() == 1
    contexts = spark.createDataFrame([(1, 0), (2, 40 * day), (3, None)], "user_id long, t long").select("user_id", F.timestamp_seconds("t").alias("ts"))
    assert [r.user_id for r in jobs.context_expiry(contexts, "1970-02-15 00:00:00").collect()] == [2]


def land(folder: Path, name: str, claims_: list[dict]) -> None:
    folder.mkdir(exist_ok=True)
    (folder / f"{name}_triples.json").write_text(json.dumps(claims_))


def test_upsert_touches_its_buckets_only(spark, tmp_path):
    def claim(i, context="c"):
        return {"subject": f"Garlic {i}", "subject_type": "food", "predicate": "treats", "object": "Influenza", "object_type": "condition", "context": context, "source_id": f"PMC{i}", "evidence_type": "RCT"}

    run = lambda: jobs.upsert_stream(jobs.claim_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/c", 16).awaitTermination()
    land(tmp_path / "in", "a", [claim(i) for i in range(40)])
    run()
    first = jobs.read_edges(spark, f"{tmp_path}/t")
    assert first.count() == 40
    files = set(first.inputFiles())
    land(tmp_path / "in", "b", [claim(3, "later"), claim(3, "later"), claim(100)])
    run()
    second = jobs.read_edges(spark, f"{tmp_path}/t")
    assert sorted((r.source_id, r.context) for r in second.where("source_id IN ('PMC3', 'PMC100')").collect()) == [("PMC100", "c"), ("PMC3", "later")] and second.count() == 41
    assert len(files & set(second.inputFiles())) == len(files) - len({f.split("bucket=")[1].split("/")[0] for f in set(second.inputFiles()) - files} & {f.split("bucket=")[1].split("/")[0] for f in files}) > 0
    # The second batch again, as after a failure before its commit: nothing changes.
    for done in (tmp_path / "c" / "commits").glob("*1"):
        done.unlink()
    for done in (tmp_path / "c" / "commits").glob(".1.crc"):
        done.unlink()
    before = sorted(tuple(r) for r in second.collect())
    run()
    assert sorted(tuple(r) for r in jobs.read_edges(spark, f"{tmp_path}/t").collect()) == before
    batch = graph.build_edges(claims.valid_claims(claims.validate(claims.normalize_claims(spark.createDataFrame([claim(i) for i in range(40)] + [claim(100)])))))
    assert batch.count() == 41


def test_demand_and_visits(spark, tmp_path):
    day = 86_400
    rows = [("e", "a", 10), ("e", "a", 20), ("e", "b", 30), (" ", "a", 40), (None, "a", 50), ("f", "a", day + 5)]
    job = lambda s: jobs.demand_stream(s.select("entity", "kind", F.timestamp_seconds("t").alias("ts")))
    got = streamed(spark, tmp_path / "d", job, [rows, [("z", "z", 5 * day)]], "entity string, kind string, t long")
    assert sorted((r.entity, r.kind, r.n) for r in got.collect()) == [("e", "a", 2), ("e", "b", 1), ("f", "a", 1)]
    visits = lambda s: jobs.visit_stream(s.select("user_id", F.timestamp_seconds("t").alias("ts")))
    got = streamed(spark, tmp_path / "v", visits, [[(1, 0), (1, 600), (1, 6000), (2, 0)], [(9, 5 * day)]], "user_id long, t long")
    assert sorted((r.user_id, r.n) for r in got.collect()) == [(1, 1), (1, 2), (2, 1)]
