"""Texts read into contexts, places on the map and completeness, on literal rows."""

import random
import re

from pyspark.sql import functions as F

from claimweave.operators import audit, intake, recommend, users


def columns(spark, of, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [tuple(r[0]) for r in df.orderBy("i").select(of(F.col("v"))).collect()]


def test_ages(spark):
    got = dict(
        zip(
            cases := [
                "I'm 45 years old", "in my early 50s", "나는 33살", "nothing 400", None, "", "for 45 years", "about 500", "around 72", "mid-40s", "almost 60", "I am 130, 7 years old", "age 0, in my 60s", "50대 초반", "60대", "만 35세",
                "a 67-year-old", "8 years", "the 20s", "33 y.o.", "Turned 61", "almost 10",
            ],
            columns(spark, intake.age_from_text, *cases),
            strict=True,
        )
    )
    assert got == {
        "I'm 45 years old": (45, False), "in my early 50s": (52, True), "나는 33살": (33, False), "nothing 400": (None, False), None: (None, False), "": (None, False), "for 45 years": (45, False), "about 500": (None, False),
        "around 72": (72, True), "mid-40s": (45, True), "almost 60": (59, True), "I am 130, 7 years old": (7, False), "age 0, in my 60s": (64, True), "50대 초반": (52, True), "60대": (64, True), "만 35세": (35, False),
        "a 67-year-old": (67, False), "8 years": (None, False), "the 20s": (25, True), "33 y.o.": (33, False), "Turned 61": (61, False), "almost 10": (None, False),
    }


def test_genders_in_the_order_of_the_words(spark):
    got = columns(spark, intake.gender_from_text, "I'm a woman", "a man and a female", "he said", "her hat", "the man, 여성", "여성", "nb", "elf", "mother", None, "", "I'm fine", "écumé m")
    assert got == [("female", False), ("female", False), ("male", True), ("female", True), ("male", False), ("female", False), ("non-binary", False), (None, False), (None, False), (None, False), (None, False), ("male", False), ("male", False)]


def test_contexts(spark):
    rows = [
        (1, "I'm 45 years old, a woman with type 2 diabetes mellitus and HIGH blood pressure, on Metformin and 아스피린"), (2, "in my early 50s; my heart, blood sugar, fragile bones"), (3, "저는 52살 여성이고 전당뇨와 두통, 어깨 통증, shoulder pain"),
        (4, ""), (5, None), (6, " \n\t "), (7, "slim diet, live longer; lower\nblood pressure"), (8, "lower my blood pressure with weight_management"), (8, "lower my blood pressure with weight_management"), (None, "fatigue " * 200_000), (9, "prediabetess pre-diabetes"),
    ]
    texts = spark.createDataFrame([(i, t, "x", 3) for i, t in rows], "id int, text string, hits string, age int")
    got = {}
    for r in intake.context_from_text(texts).collect():
        got.setdefault(r.id, []).append((r.age, r.gender, r.conditions, r.symptoms, r.medications, r.goals, r.inferred, [(q.field, q.type, q.value) for q in r.follow_up]))
    blank = (None, None, None, None, None, None, [], [])
    assert got[4] == got[5] == got[6] == [blank]
    assert got[1] == [(45, "female", ["Type 2 diabetes", "Hypertension"], None, ["Metformin", "Aspirin"], None, [], [])]
    assert got[2] == [(52, None, ["Type 2 diabetes", "Cardiovascular disease", "Osteoporosis"], None, None, None, ["age", "conditions"], [("age", "confirm", "52"), ("conditions", "confirm", "Type 2 diabetes"), ("conditions", "confirm", "Cardiovascular disease"), ("conditions", "confirm", "Osteoporosis"), ("gender", "select", None)])]
    assert got[3] == [(52, "female", ["Prediabetes", "Type 2 diabetes"], ["Shoulder Pain", "Shoulder pain", "Headache"], None, None, [], [])]
    assert got[7][0][5] == ["weight_management", "longevity"] and got[7][0][2] == ["Hypertension"]
    assert got[8][0] == got[8][1] and got[8][0][5] == ["weight_management", "hypertension_management"] and got[8][0][6] == ["conditions", "goals"]
    assert got[None][0][3] == ["Fatigue"] and got[9][0][2] == ["Prediabetes"]
    one = {q.field: q for r in intake.context_from_text(texts.where("id = 2")).collect() for q in r.follow_up}
    assert one["age"].question == "We guessed you're around 52 — is that right?" and one["gender"].options == ["female", "male", "prefer not to say"]
    assert intake.context_from_text(texts.limit(0)).count() == 0


def test_terms_by_automaton_and_by_join(spark):
    """Both ways to search give what a scan of every phrase gives."""
    rng = random.Random(3)
    parts = ["high", "blood", "pressure", "é", "a", "a1c", "_x", " ", "  ", "-", "'s", "당뇨", "전", ".", "\n", "HIGH", "Ünder"]
    texts = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(60, None), (61, ""), (3, "high blood pressure"), (None, "a1c a1c"), (62, "blood pressure " * 5000)]
    phrases = [("high blood pressure", "c", "Hypertension", True), ("Blood", "w", "blood", True), ("a", "w", "a", True), ("a1c", "m", "A1c", None), ("당뇨", "k", "diabetes", False), ("oo", "p", "oo", False), ("é", "p", "e", False), ("blood-pressure", "c", "bp", True), ("", "x", "none", True), (None, "x", "none", True), ("a", "w2", "again", True)]
    df, table = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(phrases, "phrase string, kind string, term string, whole boolean")
    want = set()
    for i, t in texts:
        for p, k, n, whole in phrases:
            q = re.escape(p.lower()) if p else None
            if t and p and re.search(q if whole is False else rf"(?<![^\W]){q}(?![^\W])", t.lower()):
                want.add((i, k, n))
    for most in (100, 3):
        got = [tuple(r) for r in intake.terms_from_text(df, table, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert intake.terms_from_text(df, table.limit(0)).count() == intake.terms_from_text(df.limit(0), table).count() == 0


def test_zones_and_places(spark):
    rows = [(None,), (0.0,), (139.9,), (140.0,), (299.0,), (300.0,), (414.9,), (415.0,), (455.0,)]
    df = spark.createDataFrame(rows, "y double")
    got = [(r.z, r.s) for r in df.select(users.zone(F.col("y")).alias("z"), users.health_score(F.col("y")).alias("s")).collect()]
    assert got == [(None, None), ("Thriving Zone", 100), ("Thriving Zone", 78), ("Navigation Zone", 78), ("Navigation Zone", 39), ("Risk Territory", 38), ("Risk Territory", 10), ("Critical Zone", 10), ("Critical Zone", 0)]
    ages = spark.createDataFrame([(None,), (5,), (16,), (53,), (90,), (120,)], "age int")
    got = [(round(r.x, 3), r.y) for r in ages.select(users.map_x(F.col("age")).alias("x"), users.map_y(F.col("age"), F.lit(1), F.lit(None).cast("int")).alias("y")).collect()]
    assert got == [(275.135, 140.5), (80.0, 115.0), (80.0, 115.0), (460.0, 171.1), (840.0, 234.0), (840.0, 285.0)]


def test_snapshots_without_a_place_do_not_count(spark):
    rows = [(1, 1, 1, 0.0, 100.0), (1, 2, 2, 30.0, None), (1, 3, 3, 30.0, 140.0), (1, 4, 4, None, 420.0), (2, 1, 5, 1.0, None)]
    s = spark.createDataFrame(rows, "user_id int, ts int, id int, x double, y double")
    assert [(r.user_id, r.length) for r in users.path_length(s).collect()] == [(1, 50.0)]
    assert [(r.id, r.zone) for r in users.zone_transitions(s).orderBy("id").collect()] == [(1, "Thriving Zone"), (3, "Navigation Zone"), (4, "Critical Zone")]
    assert [(r.id, r.delta, r.zone_changed) for r in users.drift(s).orderBy("id").collect()] == [(3, -10, True), (4, -69, True)]


def test_completeness(spark):
    rows = [(1, 0, "f", ["x"], [], None, None, "here", ["severity:x", "medications"]), (2, 40, " ", [], ["s"], ["m"], ["g"], None, None), (3, None, None, None, None, None, None, "", [])]
    df = spark.createDataFrame(rows, "user_id int, age int, gender string, conditions array<string>, symptoms array<string>, medications array<string>, goals array<string>, location string, answered array<string>")
    got = {r.user_id: (r.score, r.missing) for r in users.completeness_score(df).collect()}
    assert got == {1: (60, ["age", "symptoms", "goals"]), 2: (45, ["gender", "conditions", "lifestyle"]), 3: (0, users.LISTED)}
    assert {r.score for r in users.completeness_score(df.select("user_id")).collect()} == {0}


def test_trust_by_source_and_use(spark):
    df = spark.createDataFrame([("PMC", False), ("FDA", False), ("drug_label", False), ("PMC", True), (None, False)], "s string, r boolean")
    assert [r[0] for r in df.select(recommend.trust_level(F.col("s"), F.col("r"))).collect()] == ["information", "knowledge", "knowledge", "wisdom", "information"]


EDGE = "src_label string, src string, rel string, dst_label string, dst string, source_id string, evidence_strength int"


def test_all_gaps_in_one_pass_equal_the_rules_one_by_one(spark):
    rng = random.Random(7)
    labels = ["Food", "Nutrient", "Disease", "Symptom", "Biomarker", "Mechanism", "Microbiome", "Metabolite"]
    rels = ["CONTAINS", "TREATS", "CAUSES", "EARLY_SIGNAL_OF", "BIOMARKER_FOR", "INCREASES_BIOMARKER", "TARGETS_MECHANISM", "MODULATES_MICROBIOME", "PRODUCES"]
    nodes = [(label, f"{label.lower()} {i}") for label in labels for i in range(6)] + [("Nutrient", "t2d x"), ("Nutrient", "ab"), ("Disease", "autoimmunity")]
    edges = [(*rng.choice(nodes[:48]), rng.choice(rels), *rng.choice(nodes[:48]), rng.choice(["1", " ", "2"]), 3) for _ in range(200)]
    n, e = spark.createDataFrame(nodes, "label string, name string"), spark.createDataFrame(edges, EDGE)
    whole = audit.all_gaps(n, e)
    one_by_one = {(r.gap_type, r.entity) for g in audit.GAP_RULES for r in audit.gap(n, e, g).collect()} | {(r.gap_type, r.entity) for r in audit.gap_few_recommendations(n, e).collect()}
    got = [(r.gap_type, r.entity) for r in whole.collect()]
    assert len(got) == len(set(got)) and set(got) == one_by_one and len({g for g, _ in got}) == 10
    assert {(r.entity, r.n) for r in whole.where("gap_type = 'few_recommendations'").collect()} == {(r.entity, r.n) for r in audit.gap_few_recommendations(n, e).collect()}


def test_gap_queries_by_demand_and_first_entities(spark):
    gaps = spark.createDataFrame([("no_avoidance", x, None) for x in ("a", "b", "Stroke", "zinc", "c", "d")] + [("few_recommendations", "y", 2), ("few_recommendations", "x", 1), ("food_no_nutrient", "zinc", None)], "gap_type string, entity string, n long")
    wanted = spark.createDataFrame([("zinc",), ("zinc",)], "entity string")
    got = audit.gap_queries(gaps, wanted, "2024/01/01", "2025/12/31", {"food": ["Food Chemistry", "LWT"]}, 4).collect()
    assert [(r.priority, r.entity, r.gap_type) for r in got] == [(0, "zinc", "no_avoidance"), (1, "Stroke", "no_avoidance"), (1, "x", "few_recommendations"), (1, "y", "few_recommendations"), (2, "a", "no_avoidance"), (2, "b", "no_avoidance"), (2, "zinc", "food_no_nutrient")]
    by = {(r.gap_type, r.entity): r for r in got}
    assert by["no_avoidance", "zinc"].hint.endswith(" [HIGH DEMAND]") and by["few_recommendations", "x"].hint.startswith("x has 1 food recs")
    assert by["food_no_nutrient", "zinc"].query == '("zinc"[Title/Abstract]) AND (nutrient OR vitamin OR mineral OR composition OR "nutritional content" OR antioxidant) AND ("Food Chemistry"[Journal] OR "LWT"[Journal]) AND ("2024/01/01"[Date - Publication] : "2025/12/31"[Date - Publication]) AND open access[filter]'


def test_latest_contradiction(spark):
    df = spark.createDataFrame([("Food", "a", "d", "TREATS", "CAUSES", 1), ("Food", "a", "d", "PREVENTS", "CAUSES", 2), ("Food", "b", "d", "PREVENTS", "CAUSES", 2), ("Food", "b", "d", "TREATS", "CAUSES", 2)], "src_label string, entity string, disease string, pos_rel string, neg_rel string, detected_at int")
    assert {(r.entity, r.pos_rel) for r in audit.contradiction_latest(df).collect()} == {("a", "PREVENTS"), ("b", "TREATS")}
