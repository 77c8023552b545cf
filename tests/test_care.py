"""Evidence lists, bounded recommendations, search by rare grams and acting repair, on literal rows."""

import random

from pyspark.sql import functions as F

from claimweave.functions import vocab
from claimweave.operators import graph, recommend, risk, users

EDGE = "src_label string, src string, rel string, dst_label string, dst string, source_id string, evidence_strength int, context string, journal string, pub_date string, source_type string, evidence_type string"


def edges_of(spark, *rows):
    """Rows (label, src, rel, label, dst, source, strength)."""
    return spark.createDataFrame([(*r, "c", "J", "2024", "FDA" if r[5] == "9" else None, "RCT") for r in rows], EDGE)


def users_of(spark, *rows):
    return spark.createDataFrame(list(rows), "user_id long, age int, gender string, plan string, term string")


def test_records_of_evidence_are_bounded_and_distinct(spark):
    e = edges_of(spark, *[("Food", "kale", "ALLEVIATES", "Symptom", "cough", str(i), 3) for i in (5, 3, 9, 1, 7, 2)], ("Food", "kale", "ALLEVIATES", "Symptom", "cough", "3", 3))
    got = recommend.symptom_items(e, "ALLEVIATES", 3).collect()
    assert [(r.symptom, r.item, r.n_evidence, [x.source_id for x in r.evidence]) for r in got] == [("cough", "kale", 7, ["1", "2", "3"])]
    all_ = recommend.symptom_items(e, "ALLEVIATES", 100).first().evidence
    assert [(x.source_id, x.source_type) for x in all_][-1] == ("9", "FDA") and {x.source_type for x in all_} == {"FDA", "PMC"} and len(all_) == 6
    assert recommend.symptom_items(e.limit(0), "ALLEVIATES").count() == 0


def test_recommendations_tell_reasons_and_evidence(spark):
    e = edges_of(
        spark, ("Food", "kale", "TREATS", "Disease", "flu", "1", 5), ("Food", "kale", "TREATS", "Disease", "flu", "2", 3), ("Food", "kale", "CONTAINS", "Nutrient", "iron", "3", 1), ("Nutrient", "iron", "PREVENTS", "Disease", "flu", "4", 2),
        ("Symptom", "cough", "EARLY_SIGNAL_OF", "Disease", "flu", "5", 1), ("Food", "tea", "ALLEVIATES", "Symptom", "cough", "6", 4), ("Food", "salt", "TREATS", "Disease", "osteoporosis", "9", 4), ("Food", "x", "TREATS", "Disease", "flu", " ", 5),
    )
    flagged = e.withColumns({"contested": F.col("src") == "none", "debated": F.col("src") == "salt"})
    people = users_of(spark, (1, 40, "f", "free", "Flu"), (1, 40, "f", "free", "cough"), (2, 55, "F", "paid", None), (3, None, "", "paid", None))
    got = {(r.user_id, r.item, r.reason): (r.n_evidence, r.strength, [x.source_id for x in r.evidence], r["rank"]) for r in recommend.recommendations(flagged, people).collect()}
    assert got == {
        (1, "kale", "Associated with treats of flu"): (2, 5, ["1", "2"], 1),
        (1, "tea", "Associated with alleviates of cough"): (1, 4, ["6"], 2),
        (1, "iron", "Associated with prevents of flu"): (1, 2, ["4"], 3),
        (1, "kale", "Contains iron which prevents flu"): (1, 2, ["4"], 4),
        (2, "salt", "Recommended for your profile (50s f) — Associated with treats of osteoporosis [debated — conflicting evidence exists]"): (1, 4, ["9"], 1),
    }


def test_recommendations_cut_per_target_lose_nothing(spark):
    """Users with several targets get what a rank over all their reasons gives."""
    rng = random.Random(11)
    rows = [("Food", f"food {i}", rng.choice(["TREATS", "PREVENTS"]), "Disease", f"d{rng.randint(0, 4)}", str(rng.randint(0, 30)), rng.randint(1, 5)) for i in rng.choices(range(60), k=600)]
    people = [(u, 30, "", rng.choice(["free", "paid"]), f"d{d}") for u in range(8) for d in rng.sample(range(5), 3)]
    plan = {}
    for u, _, _, p, _ in people:
        plan[u] = plan.setdefault(u, p)
    people = [(u, a, g, plan[u], t) for u, a, g, _, t in people]
    e = edges_of(spark, *rows)
    got = {(r.user_id, r["rank"]): (r.item, r.reason) for r in recommend.recommendations(e, users_of(spark, *people)).collect()}
    want = {}
    for u in plan:
        groups = {}
        for _, item, rel, _, d, s, strength in rows:
            if any(x[0] == u and x[4] == d for x in people):
                groups.setdefault((item, f"Associated with {rel.lower()} of {d}"), []).append((s, strength))
        order = sorted(groups, key=lambda k: (-max(x[1] for x in groups[k]), -len({x[0] for x in groups[k]}), *k))
        want |= {(u, i + 1): k for i, k in enumerate(order[: 5 if plan[u] == "free" else 20])}
    assert got == want


def test_path_signals_and_position(spark):
    e = edges_of(spark, *[("Food", f"f{i}", "TREATS", "Disease", "flu", str(i), 5 - i % 3) for i in range(9)], ("Food", "salt", "CAUSES", "Disease", "flu", "9", 1), *[("Symptom", "cough", "EARLY_SIGNAL_OF", "Disease", f"d{i}", str(i), 1) for i in range(7)])
    nodes = spark.createDataFrame([("Symptom", "cough"), ("Disease", "flu")], "label string, name string")
    people = users_of(spark, (1, 40, "", "free", "Flu"), (1, 40, "", "free", "Cough"), (2, 40, "", "paid", "flu"), (3, 40, "", "paid", "cough"), (4, 40, "", "paid", None))
    steps = {(r.user_id, r.step): (r["items"], len(r.evidence)) for r in recommend.safest_path(e, people).collect()}
    assert steps[1, "increase"] == ("f0, f3, f6", 3) and steps[2, "increase"] == ("f0, f3, f6, f1, f4", 3) and steps[1, "reduce"] == ("salt", 1) and (3, "increase") not in steps
    risks = {(r.user_id, r["rank"]): (r.name, r.kind, len(r.evidence)) for r in recommend.nearby_risks(e, people, nodes).collect()}
    assert [risks[1, i][0] for i in range(1, 6)] == ["d0", "d1", "d2", "d3", "d4"] and (1, 6) not in risks and risks[2, 1] == ("flu", "disease", 0) and len([k for k in risks if k[0] == 3]) == 7
    assert {(r.user_id, r["rank"]) for r in recommend.early_signal_guidance(e, people, 3).collect()} == {(u, i) for u in (1, 3) for i in (1, 2, 3)}


def test_food_chains_are_the_first_of_each_food(spark):
    rows = [("Food", f"f{i}", "CONTAINS", "Nutrient", f"n{j}", "1", 1) for i in range(3) for j in range(i + 1)] + [("Nutrient", f"n{j}", "TREATS", "Disease", f"d{k}", str(k), 1) for j in range(3) for k in range(4)]
    got = {}
    for r in recommend.food_chain(edges_of(spark, *rows), 5).collect():
        got.setdefault(r.food, []).append((r.nutrient, r.target, r.contains_sources, [x.source_id for x in r.effect_evidence]))
    assert {f: len(v) for f, v in got.items()} == {"f0": 4, "f1": 5, "f2": 5}
    assert sorted(got["f2"]) == [("n0", f"d{k}", 1, [str(k)]) for k in range(4)] + [("n1", "d0", 1, ["0"])]


def test_search_by_the_rarest_gram(spark):
    """As a scan of everything; on a vocabulary where all texts share a head few pairs are candidates."""
    rng = random.Random(2)
    outer = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 12))) for _ in range(150)] + [None, "", "ab" * 30_000]
    inner = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 6))) for _ in range(80)] + [None, "zz", "zzz", "abz"]
    frame = lambda name, rows: spark.createDataFrame([(x,) for x in rows], f"{name} string")
    got = [tuple(r) for r in users.holding(frame("inner", inner), frame("outer", outer)).collect()]
    assert len(got) == len(set(got)) and set(got) == {(i, o) for i in inner for o in outer if i and o and i in o}
    common = [f"diabetes type {i:04d}" for i in range(2000)]
    asked = [f"diabetes type 0{i}" for i in (123, 456)] + ["type 19"]
    n = users.candidates(frame("inner", asked), frame("outer", common)).count()
    hits = users.holding(frame("inner", asked), frame("outer", common)).count()
    assert hits == 102 and n < 1000
    assert users.holding(frame("inner", []), frame("outer", common)).count() == users.holding(frame("inner", asked), frame("outer", [])).count() == 0


def test_risk_factors_in_the_vocabularys_forms(spark):
    profiles = spark.createDataFrame([("flu", "factor", "High BP"), ("flu", "factor", "Smoking"), ("flu", "factor", "Age 65+"), ("flu", "trigger", "t2dm")], "disease string, kind string, factor string")
    people = users_of(spark, (1, 70, "", "free", "Hypertension"), (2, 20, "", "free", "heavy smoking"), (3, 20, "", "free", "Type 2 Diabetes"))
    names = spark.createDataFrame([("high bp", "Hypertension"), ("t2dm", "Type 2 diabetes")], "key string, canonical string")
    assert sorted((r.user_id, r.factor) for r in risk.risk_factor_match(profiles, people, names).collect()) == [(1, "Age 65+"), (1, "High BP"), (2, "Smoking")]
    assert sorted((r.user_id, r.factor) for r in risk.risk_factor_match(profiles, people).collect()) == [(1, "Age 65+"), (2, "Smoking")]
    assert {(r.user_id, r.level, r.present) for r in risk.risk_board(profiles, people, names).collect()} == {(1, "medium", 2), (2, "low", 1), (3, "high", 0)}


def test_duplicates_by_vocabulary_then_case(spark):
    spelt = spark.createDataFrame([("Food", x) for x in ("KALE", "Kale", "kale", "TEA", "tea", "salt", "OIL", "oil", "Oil x")] + [("Drug", "kale")], "label string, name string")
    names = spark.createDataFrame([("tea", "Green tea"), ("tea", "Tea leaf")], "key string, canonical string")
    got = {r.key: (r.n, r.canonical) for r in graph.duplicate_groups(spelt, names).collect()}
    assert got == {"kale": (3, "Kale"), "tea": (2, "Green tea"), "oil": (2, "OIL")}
    assert {r.name: r.canonical for r in graph.duplicate_mapping(graph.duplicate_groups(spelt, names)).collect()} == {"KALE": "Kale", "kale": "Kale", "TEA": "Green tea", "tea": "Green tea", "oil": "OIL"}


def test_mappings_are_followed_to_their_end(spark):
    chain = [("Food", f"n{i}", f"n{i + 1}") for i in range(40)]
    table = spark.createDataFrame([*chain, ("Food", "n3", "n4"), ("Drug", "n1", "z"), ("Food", "self", "self")], "label string, name string, canonical string")
    got = {(r.label, r.name): r.canonical for r in graph.closed_mapping(table).collect()}
    assert got == {("Food", f"n{i}"): "n40" for i in range(40)} | {("Drug", "n1"): "z"}
    graph.DOUBLINGS, before = 4, graph.DOUBLINGS
    try:
        circle = spark.createDataFrame([("Food", "a", "b"), ("Food", "b", "c"), ("Food", "c", "a"), ("Food", "x", "y")], "label string, name string, canonical string")
        assert [(r.name, r.canonical) for r in graph.closed_mapping(circle).collect()] == [("x", "y")]
    finally:
        graph.DOUBLINGS = before


def test_repair_rewires_and_counts(spark):
    e = edges_of(spark, ("Food", "KALE", "TREATS", "Disease", "flu", "1", 1), ("Food", "Kale", "TREATS", "Disease", "flu", "1", 2), ("Food", "KALE", "CONTAINS", "Food", "Kale", "2", 1), ("Food", "tea", "CONTAINS", "Food", "KALE", "3", 1), ("Food", "Kale", "CONTAINS", "Food", "Kale", "4", 1))
    spelt = spark.createDataFrame([("Food", "KALE", "x"), ("Food", "Kale", "y"), ("Food", "tea", "t"), ("Disease", "flu", "f")], "label string, name string, display_name string")
    groups = graph.duplicate_groups(spelt)
    mapping = graph.duplicate_mapping(groups)
    assert sorted((r.src, r.dst, r.source_id, r.evidence_strength) for r in graph.resolve_entities(e, mapping).collect()) == [("Kale", "Kale", "4", 1), ("Kale", "flu", "1", 2), ("tea", "Kale", "3", 1)]
    assert sorted((r.name, r.display_name) for r in graph.resolve_nodes(spelt, mapping).collect()) == [("Kale", "y"), ("flu", "f"), ("tea", "t")]
    assert tuple(graph.resolve_report(e, groups).first()) == (1, 1, 2, 1)
    assert tuple(graph.resolve_report(e.limit(0), groups.limit(0)).first()) == (0, 0, 0, 0)


def test_labels_are_relabelled_deleted_or_kept(spark):
    nodes = spark.createDataFrame([("Food", "kale", "Kale"), ("meal", "kale", "kale"), ("meal", "soup", "Soup"), ("Task", "run", "Run"), ("Odd kind", "q", "Q")], "label string, name string, display_name string")
    e = edges_of(spark, ("meal", "kale", "TREATS", "Odd kind", "q", "1", 1), ("Food", "kale", "TREATS", "Odd kind", "q", "1", 2), ("Task", "run", "TREATS", "meal", "soup", "2", 1), ("meal", "soup", "TREATS", "Food", "kale", "3", 1))
    kept, moved, report = graph.relabel_nonstandard(nodes, e)
    assert sorted((r.label, r.name, r.display_name) for r in kept.collect()) == [("Food", "kale", "kale"), ("Food", "soup", "Soup"), ("Odd kind", "q", "Q")]
    assert sorted((r.src_label, r.src, r.dst_label, r.dst, r.source_id, r.evidence_strength) for r in moved.collect()) == [("Food", "kale", "Odd kind", "q", "1", 2), ("Food", "soup", "Food", "kale", "3", 1)]
    assert {r.label: (r.action, r.target, r.nodes, r.edges) for r in report.collect()} == {"meal": ("relabel", "Food", 2, 3), "Task": ("delete", None, 1, 1), "Odd kind": ("unmapped", None, 1, 2)}


def test_names_as_a_table(spark):
    names = spark.createDataFrame([("vitamin d3", "Vitamin D"), ("vitamin d3", "Vitamin D9"), ("x", "Y")], "key string, canonical string")
    df = spark.createDataFrame([(1, " Vitamin D3 ", "X"), (2, None, " z ")], "name_key int, subject string, object string")
    got = [tuple(r) for r in vocab.canonical_names(df.withColumnRenamed("name_key", "i"), ["subject", "object"], names).select("i", "subject", "object").orderBy("i").collect()]
    assert got == [(1, "Vitamin D", "Y"), (2, "", "z")]
    keys = [r[0] for r in df.orderBy("name_key").select(vocab.merge_key(F.col("subject"), {"vitamin d3": "Vitamin D"})).collect()]
    assert keys == ["vitamin d", ""]


def most_rows(df):
    """The most rows that a node of the plan gave when df was collected, and the rows."""
    rows, found = df.collect(), [0]

    def walk(node):
        kind, metric = node.getClass().getSimpleName(), node.metrics().get("numOutputRows")
        if metric.isDefined():
            found.append(metric.get().value())
        inner = [node.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [node.plan()] if kind.endswith("QueryStageExec") else []
        children = node.children()
        for x in [*inner, *(children.apply(i) for i in range(children.size()))]:
            walk(x)

    walk(df._jdf.queryExecution().executedPlan())
    return max(found), rows


def test_open_checks_meet_no_list_of_checks(spark):
    """As by hand, and no step makes a row for each check of a user's diseases."""
    rng = random.Random(5)
    board = [(u, f"d{d}", rng.choice(["high", "medium", "low"])) for u in range(60) for d in rng.sample(range(6), 4)]
    checks = [(f"d{d}", rng.randint(0, 9), f"c{c}") for d in range(5) for c in rng.sample(range(200), 150)] + [("d5", 1, "x"), ("d5", 0, "y")]
    answered = [(u, rng.choice([c for _, _, c in sorted(checks)[:8]] + ["x", "y", "none"])) for u in range(60) for _ in range(4)] + [(u, c) for u in range(9) for c in "xy"]
    frames = [spark.createDataFrame(r, s) for r, s in ((board, "user_id long, disease string, level string"), (checks, "disease string, pos int, check_id string"), (answered, "user_id long, check_id string"))]
    most, rows = most_rows(risk.open_checks(*frames))
    want = set()
    for u in range(60):
        left = {(v != "high", d): sorted((p, c) for e, p, c in checks if e == d and (u, c) not in answered) for w, d, v in board if w == u and v != "low"}
        left = {x: y for x, y in left.items() if y}
        want |= {(u, x[1], left[x][0][1], sum(map(len, left.values())), i + 1) for i, x in enumerate(sorted(left)[:2])}
    assert {tuple(r) for r in rows} == want and len(rows) == len(want)
    assert most <= len(checks) + len(answered)


def test_open_checks_work_out_equal_users_once(spark):
    profiles = spark.createDataFrame([(f"d{i}", k, f) for i in range(20) for k, f in (("factor", "age 30+"), ("factor", "red"), ("trigger", f"d{i}"))], "disease string, kind string, factor string")
    checks = spark.createDataFrame([(f"d{i}", j, f"c{j}") for i in range(20) for j in range(3)], "disease string, pos int, check_id string")
    people = users_of(spark, *[(u, 40, "", "free", t) for u in range(200) for t in ("red hair", "c0")], (200, 20, "", "free", "red hair"), (201, None, "", "free", None), (202, 20, "", "free", "d3"))
    most, rows = most_rows(risk.open_checks_of(profiles, people, checks))
    got = {(r.user_id, r["rank"]): (r.disease, r.check_id, r.remaining) for r in rows}
    assert got == {(u, i): (d, "c1", 40) for u in range(200) for i, d in ((1, "d0"), (2, "d1"))} | {(202, 1): ("d3", "c0", 3)} and len(rows) == len(got)
    board, _ = most_rows(risk.risk_board(profiles, people))
    assert most < 3000 < 8000 <= board  # 2,420: the age factors over the ages they cover


def test_recommendations_count_facts_before_they_meet(spark):
    """Foods, nutrients, signals and reasons that two hops share: as over all rows, without a row for each food and edge."""
    rng = random.Random(3)
    mark = " [debated — conflicting evidence exists]"
    edge = lambda a, s, rel, b, d: (a, s, rel, b, d, str(rng.randint(0, 40)), rng.randint(1, 3))
    foods, nutrients, symptoms, diseases = ([f"{k}{i}" for i in range(n)] for k, n in (("food", 40), ("n", 3), ("s", 4), ("d", 3)))
    rows = [edge("Food", f, "CONTAINS", "Nutrient", n) for f in foods for n in nutrients]
    rows += [edge("Nutrient", rng.choice(nutrients), rng.choice(["TREATS", "PREVENTS"]), "Disease", rng.choice(diseases)) for _ in range(150)]
    rows += [edge("Food", rng.choice(foods), rng.choice(["ALLEVIATES", "PREVENTS"]), "Symptom", rng.choice([*symptoms, "d0" + mark])) for _ in range(400)]
    rows += [edge("Food", rng.choice(foods), rng.choice(["TREATS", "PREVENTS"]), "Disease", rng.choice([*diseases, "s0"])) for _ in range(60)]
    rows += [edge("Symptom", s, "EARLY_SIGNAL_OF", "Disease", d) for s, d in (("s0", "s0"), ("s0", "d0"), ("s1", "d0"), ("s1", "d1"), ("s2", "s1"), ("s3", "d2"), ("d0" + mark, "d0"))]
    flagged = edges_of(spark, *dict.fromkeys(rows)).withColumns({"contested": F.col("source_id") == "7", "debated": (F.col("dst") == "d0") & (F.col("rel") == "PREVENTS")})
    people = users_of(spark, *[(i, 40, "", "paid", t) for i, t in enumerate([*symptoms, *diseases])], (9, 40, "", "paid", "d0"), (9, 40, "", "paid", "s0"), (10, 40, "", "free", "s0"))
    most, found = most_rows(recommend.recommendations(flagged, people))
    all_ = recommend.recs_direct(flagged).unionByName(recommend.recs_via_nutrient(flagged)).unionByName(recommend.recs_via_shared_symptom(flagged))
    told = all_.select("target", "item", recommend.reason_text(F.col("rel"), F.col("reached"), F.col("via"), F.col("debated")).alias("reason"), "source_id", "strength", "ev").collect()
    groups, want = {}, {}
    for r in told:
        groups.setdefault((r.target, r.item, r.reason), []).append(r)
    for u, plan, terms in [(i, "paid", [t]) for i, t in enumerate([*symptoms, *diseases])] + [(9, "paid", ["d0", "s0"]), (10, "free", ["s0"])]:
        best = {}
        for (t, item, reason), of in groups.items():
            if t in terms:
                evs = sorted({tuple(r.ev) for r in of})[:5]
                best[item, reason] = max(best.get((item, reason), (0,)), (max(r.strength for r in of), len({r.source_id for r in of}), len(evs), evs))
        ranked = sorted(best, key=lambda x: (-best[x][0], -best[x][1], *x))[: 5 if plan == "free" else 20]
        want |= {(u, i + 1): (*k, best[k][1], best[k][0], best[k][3]) for i, k in enumerate(ranked)}
    assert {(r.user_id, r["rank"]): (r.item, r.reason, r.n_evidence, r.strength, [tuple(x) for x in r.evidence]) for r in found} == want
    assert {r.reason for r in found} & {f"Associated with prevents of d0{mark}", "Associated with prevents of s0"}  # of both hops
    assert most < 1500 < len(told)
