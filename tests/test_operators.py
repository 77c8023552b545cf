"""Rules on literal rows: vocabulary, validation, repair, text and streaming."""

import datetime
import json
import random

from pyspark.sql import functions as F

from claimweave.functions import vocab
from claimweave.operators import claims, graph, planning, recommend, users
from claimweave.sources import papers
from claimweave.streaming import jobs


def one(spark, column, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("v"))).collect()]


def test_types(spark):
    got = one(spark, vocab.canonical_type, "Disease", "medical condition", "drug/treatment", "Task", "age related change", "short-chain fatty acid", "space/thing x", "", None, "biological mechanism")
    assert got == ["Disease", "Disease", "Drug", None, "AgeRelatedChange", "Metabolite", "Space_thing_x", "Thing", "Thing", "Biological_mechanism"]


def test_predicates(spark):
    assert one(spark, vocab.canonical_predicate, "treats", "marker for", "early-signal-of", "nonsense", None, "WORSENS") == ["TREATS", "BIOMARKER_FOR", "EARLY_SIGNAL_OF", "RELATES_TO", "RELATES_TO", "AGGRAVATES"]


def test_names_and_strength(spark):
    assert one(spark, lambda c: vocab.canonical_name(c, {"vitamin d3": "Vitamin D"}), " Vitamin D3 ", "x ", None) == ["Vitamin D", "x", ""]
    assert one(spark, vocab.is_vague_name, "RA", "ab", "patients", "garlic", None, " ") == [False, True, True, False, True, True]
    assert one(spark, vocab.evidence_strength, "RCT", "Meta-Analysis", "narrative_review", "?", None) == [5, 4, 2, 1, 1]
    assert one(spark, vocab.infer_evidence_type, "A double-blind study", "a meta analysis and review", "none", None) == ["RCT", "meta-analysis", None, None]


def test_upsert_is_idempotent(spark):
    row = lambda ctx, src: ("Garlic", "Food", "TREATS", "Flu", "Disease", ctx, src, "PMC", "J", "2024", "RCT", 5)
    cols = [*claims.CLAIM_COLUMNS, "evidence_strength"]
    a, b = (graph.build_edges(spark.createDataFrame(rows, cols)) for rows in ([row("a", "1"), row("b", "2")], [row("c", "2"), row("d", "3")]))
    once = graph.upsert_edges(a, b)
    twice = graph.upsert_edges(once, b)
    assert sorted(once.select("source_id", "context").collect()) == sorted(twice.select("source_id", "context").collect()) == [("1", "a"), ("2", "c"), ("3", "d")]


def test_throttle_holds_no_whole_key(spark):
    """The plan gathers no array of a key's rows, and accepts what one pass in order accepts."""
    rng = random.Random(6)
    times = {k: [rng.choice((0, 86_000, 5 * 86_400)) + rng.randint(-4000, 4000 + 90_000 * (k == "c")) for _ in range(400)] for k in ("a", "b", "c", None)}
    rows = [(k, None if i == 7 else t, 1000 * n + i) for n, (k, ts) in enumerate(times.items()) for i, t in enumerate(ts)]
    df = spark.createDataFrame(rows, "k string, t long, id long").select("k", F.timestamp_seconds("t").alias("ts"), "id")
    for seconds in (1, 300, 100_000):
        want = []
        for k in times:
            last = None
            for t, i in sorted((t, i) for key, t, i in rows if key == k and t is not None):
                if last is None or t >= last + seconds:
                    want.append((str(k), i))
                    last = t
            want += [(str(k), i) for key, t, i in rows if key == k and t is None]
        got = users.throttle(df, "k", seconds)
        assert sorted((str(r.k), r.id) for r in got.collect()) == sorted(want)
        assert "collect_list" not in got._jdf.queryExecution().toString()


def test_active_clusters_of_pairs(spark):
    pairs = spark.createDataFrame([("hit", "x"), ("hit", "y"), ("miss", "z"), ("bare", None)], "cluster string, entity string")
    gaps = spark.createDataFrame([("x",)], "entity string")
    assert sorted(r.cluster for r in planning.active_clusters(pairs, gaps).collect()) == ["bare", "hit"]
    assert sorted(r.cluster for r in planning.active_clusters(pairs).collect()) == ["bare", "hit", "miss"]


def test_throttle(spark):
    t = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", t + datetime.timedelta(seconds=s), i) for i, s in enumerate((0, 100, 299, 300, 500, 601))], "k string, ts timestamp, id long")
    assert sorted(r.id for r in users.throttle(df, "k").collect()) == [0, 3, 5]


def test_files_and_streams(spark, tmp_path):
    claim = {"subject": "Garlic", "subject_type": "food", "predicate": "treats", "object": "Influenza", "object_type": "condition", "context": "c", "source_id": "PMC1", "evidence_type": "RCT"}
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a_triples.json").write_text(json.dumps([claim, {**claim, "source_id": ""}]))
    (tmp_path / "in" / "rejected_triples.json").write_text(json.dumps([claim]))
    (tmp_path / "in" / "master_graph.json").write_text(json.dumps([claim]))
    batch = papers.read_claims(spark, f"{tmp_path}/in")
    assert batch.count() == 2
    valid = claims.valid_claims(claims.validate(claims.normalize_claims(batch)))
    assert valid.select("subject_type", "predicate", "object_type", "evidence_strength").collect() == [("Food", "TREATS", "Disease", 5)]
    (tmp_path / "in" / "rejected_triples.json").unlink()
    jobs.validate_stream(jobs.claim_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/out").select("part").collect()) == ["rejected", "valid"]
    jobs.upsert_stream(jobs.claim_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/c2").awaitTermination()
    assert jobs.read_edges(spark, f"{tmp_path}/t").count() == 1


def test_responses(spark):
    df = spark.createDataFrame([("PMC1", 'Sure: ```[{"subject": "a", "object": "b"}]```'), ("PMC2", "no json")], "pmcid string, answer string")
    assert papers.claims_from_responses(df).select("subject", "object", "source_id").collect() == [("a", "b", "PMC1")]


def test_risk_board_levels(spark):
    from claimweave.operators import risk

    profiles = spark.createDataFrame([("d", "factor", "Type 2"), ("d", "factor", "Age 65+"), ("d", "factor", "smoking"), ("d", "trigger", "d itself"), ("e", "factor", "obesity")], "disease string, kind string, factor string")
    users = spark.createDataFrame([(1, 70, "", "free", "Type 2 Diabetes"), (2, 30, "", "free", "D itself"), (3, 30, "", "free", None), (4, None, "", "free", "")], "user_id long, age int, gender string, plan string, term string")
    got = {(r.user_id, r.disease): (r.level, r.present, r.missing) for r in risk.risk_board(profiles, users).collect()}
    assert got == {(1, "d"): ("medium", 2, 1), (2, "d"): ("high", 0, 3)}


def test_rules_infer_by_age_or_condition(spark):
    from claimweave.operators import risk

    users = spark.createDataFrame([(1, 66, "", "free", "Stroke"), (2, 20, "", "free", "Hypertension"), (3, 66, "", "free", "osteoporosis")], "user_id long, age int, gender string, plan string, term string")
    none = spark.createDataFrame([], "user_id long, kind string, target string, item string, n long, rank int")
    got = {(r.user_id, r["rank"]): r.name for r in risk.inferred_conditions(none, users, risk.likely_rules(spark)).collect()}
    assert got == {(1, 1): "osteoporosis", (1, 2): "sarcopenia", (1, 3): "alzheimer's disease", (2, 1): "stroke", (3, 1): "sarcopenia", (3, 2): "alzheimer's disease"}


def test_clusters_and_manifests(spark, tmp_path):
    from claimweave.operators import planning

    clusters = spark.createDataFrame([("always", []), ("hit", ["iron", "zinc"]), ("miss", ["gold"])], "cluster string, entities array<string>")
    gaps = spark.createDataFrame([("zinc",)], "entity string")
    names = lambda df: sorted(r.cluster for r in df.collect())
    assert names(planning.active_clusters(clusters, gaps)) == ["always", "hit"]
    assert names(planning.active_clusters(clusters, gaps, ["miss"])) == ["miss"]
    assert names(planning.active_clusters(clusters)) == ["always", "hit", "miss"]
    for n in (1, 2):
        planning.write_manifest(spark.createDataFrame([("fetch", f"r{n}", n, "x"), ("extract", f"r{n}", n, "y")], "agent string, run_id string, ts int, payload string"), str(tmp_path / "m"))
    runs = spark.read.parquet(str(tmp_path / "m"))
    assert {(r.agent, r.run_id) for r in planning.latest_manifest(runs).collect()} == {("fetch", "r2"), ("extract", "r2")}
    assert [r.agent for r in planning.previous_manifest(runs, ["fetch", "extract", "build"], "build").collect()] == ["extract"]


def test_nutrient_amounts_and_extractor(spark):
    from claimweave.operators import planning

    rows = [("oats", [(i, f"oats {i}", [(f"n{j}", "mg", float(j)) for j in range(12)]) for i in range(4)])]
    answers = spark.createDataFrame(rows, "query string, foods array<struct<id:int,description:string,nutrients:array<struct<name:string,unit:string,amount:double>>>>")
    assert planning.nutrient_amounts(answers).count() == 30

    def extractor(frames):
        for f in frames:
            yield f.rename(columns={"pmcid": "source_id", "text": "subject"})

    papers = spark.createDataFrame([("PMC1", "oats"), ("PMC2", "rye")], "pmcid string, text string")
    assert {tuple(r) for r in planning.extract_with(papers, extractor, "source_id string, subject string").collect()} == {("PMC1", "oats"), ("PMC2", "rye")}


def test_suggestions_of_short_terms_and_held_keys(spark):
    vocabulary = spark.createDataFrame([("vitamin d", "Vitamin D"), ("d", "D"), ("", "nothing"), ("iron", "Iron")], "key string, canonical string")
    terms = spark.createDataFrame([(" D ",), ("vitamin d3",), ("ir",), ("",), (None,)], "term string")
    got = {(r.term, r.canonical): r["rank"] for r in users.suggest_vocab(terms, vocabulary).collect()}
    assert got == {("d", "D"): 1, ("d", "Vitamin D"): 2, ("vitamin d3", "D"): 1, ("vitamin d3", "Vitamin D"): 2, ("ir", "Iron"): 1}
    asked = spark.createDataFrame([("weight m", "goals"), ("flu", "conditions"), ("flu", "symptoms")], "term string, field string")
    nodes = spark.createDataFrame([("Disease", "Influenza"), ("Disease", "Flu"), ("Drug", "Flu drug")], "label string, name string")
    got = sorted((r.term, r.field, r.name, r["rank"]) for r in users.suggest(asked, vocabulary, nodes).collect())
    assert got == [("flu", "conditions", "Flu", 1), ("flu", "conditions", "Influenza", 2), ("weight m", "goals", "weight management", 1), ("weight m", "goals", "weight_management", 2)]


def test_suggestions_of_empty_tables(spark):
    none = spark.createDataFrame([], "key string, canonical string")
    asked = spark.createDataFrame([("flu", "conditions")], "term string, field string")
    assert users.suggest(asked, none, spark.createDataFrame([], "label string, name string")).count() == 0
    assert users.suggest(asked.limit(0), none, none.select(F.col("key").alias("label"), F.col("key").alias("name"))).count() == 0


def test_papers_in_demand(spark):
    p = spark.createDataFrame([("1", "On vitamin b twelve in old age now", None), ("2", None, "a thion"), ("3", None, None)], "pmcid string, title string, abstract string")
    demand = spark.createDataFrame([("Vitamin B twelve in old age",)], "entity string")
    assert {r.pmcid for r in users.priority_papers(p, [r"\bthion\b"], demand).collect()} == {"1", "2"}
    assert [r.pmcid for r in users.priority_papers(p, [r"\bthion\b"]).collect()] == ["2"]


def test_age_guidance(spark):
    row = lambda src, rel, dst, ctx, sid: ("AgeRelatedChange", src, rel, dst, ctx, sid)
    edges = [row("sarcopenia", "OCCURS_AT", "65+", "c", "s1"), row("sarcopenia", "MODIFIABLE_BY", "protein", "c", "s2"), row("sarcopenia", "EXPLAINS_WHY", "loss", "", "s3"), row("sarcopenia", "EXPLAINS_WHY", "x", None, "s4"), row("grey hair", "OCCURS_AT", "40s", "c", "s5"), row("lost", "OCCURS_AT", "40s", "c", "")]
    got = {r.change: (*tuple(r)[:3], [e.source_id for e in r.evidence]) for r in recommend.age_guidance(spark.createDataFrame(edges, "src_label string, src string, rel string, dst string, context string, source_id string")).collect()}
    assert got == {"sarcopenia": ("sarcopenia", "65+", "Modifiable by protein; loss; x", ["s1", "s2", "s3"]), "grey hair": ("grey hair", "40s", "Diet and exercise matter for this change.", ["s5"])}


def test_cycles(spark):
    lines = spark.createDataFrame([(1, "2024-05-01 10:00:00 [START]"), (2, "2024-05-01 11:00:00 [CYCLE  3]  papers +10  nodes +5  rels +7  total=100 nodes / 200 rels"), (3, "[CYCLE 4] papers +1 nodes +2 rels +3 total=102 nodes / 203 rels"), (4, None)], "pos int, text string")
    assert [tuple(r) for r in planning.cycle_log(lines).collect()] == [(3, 4, 1, 2, 3, 102, 203, ""), (2, 3, 10, 5, 7, 100, 200, "2024-05-01 11:00:00")]
    assert tuple(planning.cycle_totals(lines).first()) == (2, 11, 7, 10)
    assert tuple(planning.cycle_totals(lines.limit(0)).first()) == (0, 0, 0, 0)


def streamed(spark, tmp_path, job, batches, schema):
    """The rows a job appends for batches that arrive one by one."""
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, schema).coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
        job(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    return spark.read.parquet(str(tmp_path / "out"))
