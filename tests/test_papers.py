"""Papers in three layouts, article XML, labels, answers and data checks, on literal files and rows."""

import json
import random


from claimweave.operators import audit, claims, users
from claimweave.sources import papers


def test_three_layouts_and_broken_files(spark, tmp_path):
    files = {
        "a": {"pmcid": "PMC1", "title": " T ", "journal": "J", "date": "2020-01-02", "abstract": "A", "full_text_preview": "P", "fetch_sources": ["x", "y"]},
        "b": {"id": "22", "title": None, "abstractText": "B", "journalTitle": "K", "firstPublicationDate": "2021-01-01"},
        "c": [{"pmcid": "FDA_3", "source_type": "FDA", "date": "20190506", "body": "text", "drug_class": "statin", "brand_name": "X"}, {"pmcid": 4, "title": {"nested": 1}, "fetch_sources": "no list", "_corrupt_record": "z"}],
        "d": {"title": "no id"},
        "e": "just a text",
    }
    for name, value in files.items():
        (tmp_path / f"{name}.json").write_text(json.dumps(value, indent=1))
    (tmp_path / "f.json").write_text('{"pmcid": "PMC9", "title": ')
    (tmp_path / "g.json").write_text("")
    (tmp_path / "h.txt").write_text('{"pmcid": "PMC10"}')
    got = {r.pmcid: r for r in papers.read_papers(spark, str(tmp_path)).collect()}
    assert set(got) == {"PMC1", "PMC22", "FDA_3", "PMC4"}
    assert [got[k].layout for k in ("PMC1", "PMC22", "FDA_3", "PMC4")] == ["article", "search", "label", "article"]
    assert (got["PMC1"].title, got["PMC1"].fetch_sources, got["PMC1"].source_type) == ("T", ["x", "y"], "PMC")
    assert (got["PMC22"].title, got["PMC22"].abstract, got["PMC22"].journal, got["PMC22"].date) == ("", "B", "K", "2021-01-01")
    assert (got["FDA_3"].date, got["FDA_3"].body, got["FDA_3"].brand_name) == ("2019-05-06", "text", "X") and (got["PMC4"].date, got["PMC4"].fetch_sources) == ("Unknown", [])
    assert sorted((r.file, r.problem) for r in papers.broken_papers(spark, str(tmp_path)).collect()) == [("d.json", "no id"), ("e.json", "no id"), ("f.json", "not JSON")]


def test_article_xml(spark):
    def article(title="<article-title>On <italic>E. coli</italic> &amp; iron</article-title>", dates="", body="<body><sec><title>Intro</title><p>Text.</p></sec></body>", journal="<journal-title>Gut</journal-title>"):
        return f"<article><front><journal-meta>{journal}</journal-meta><article-meta><title-group>{title}</title-group>{dates}<abstract><p>One <b>two</b></p><p>three</p></abstract></article-meta></front>{body}</article>"

    pub = "<pub-date date-type='epub'><year>2001</year></pub-date><pub-date date-type='pub'><year>2002</year><month>3</month><day>14</day></pub-date>"
    rows = [
        (1, article(dates=pub)), (2, f"<pmc-articleset>{article(dates='<pub-date><year>2003</year></pub-date>')}</pmc-articleset>"), (3, article(title="", dates="<pub-date><month>3</month></pub-date>", journal="", body=f"<body>{'x' * 1500}</body>")),
        (4, "<article></article>"), (5, "no xml <"), (6, None), (7, ""), (8, article(dates="<pub-date><year></year></pub-date>", journal="<journal-title-group><journal-title>Cell</journal-title></journal-title-group>", body="")),
    ]
    got = {r.pmcid: tuple(r)[1:] for r in papers.from_xml(spark.createDataFrame(rows, "id int, xml string")).collect()}
    nothing = ("No Title", "Unknown Journal", "Unknown", "", "")
    assert got["PMC1"] == ("On E. coli & iron", "Gut", "2002-03-14", "One twothree", "IntroText.")
    assert got["PMC2"][2] == "2003-01-01" and got["PMC2"][0] == "On E. coli & iron"
    assert got["PMC3"][:3] == ("No Title", "Unknown Journal", "Unknown") and got["PMC3"][4] == "x" * 1000 + "..."
    assert all(got[f"PMC{i}"] == nothing for i in (4, 5, 6, 7))
    assert got["PMC8"][1:3] == ("Cell", "Unknown") and got["PMC8"][4] == ""


def test_labels_searches_and_texts(spark):
    labels = spark.createDataFrame([("77", "Brand; B", "gen", ["a", None, "b"], "20200131"), ("", " ", "generic name of some length; x", ["c" * 9000], "bad"), (None, None, None, None, None)], "appl string, brand string, generic string, sections array<string>, day string")
    got = {r.title: r for r in papers.from_labels(labels).collect()}
    assert (got["Brand"].pmcid, got["Brand"].date, got["Brand"].body) == ("FDA_77", "2020-01-31", "a\n\nb")
    assert got["generic name of some length"].pmcid.startswith("FDA_generic name of some_") and len(got["generic name of some length"].body) == 8000 and got["generic name of some length"].date == "Unknown"
    found = spark.createDataFrame([("PMC1", "t", None), ("MED2", "t", "a"), ("PMC3", "", None), (None, "t", "a")], "pmcid string, title string, abstract string")
    assert [r.pmcid for r in papers.from_search_results(found).collect()] == ["PMC1"]
    texts = spark.createDataFrame([("1", "a" * 120, "p"), ("2", "short", "preview"), ("3", "short", ""), ("4", None, None), ("5", " ", "")], "pmcid string, abstract string, full_text_preview string")
    assert {r.pmcid: r.text for r in papers.extraction_text(texts).collect()} == {"1": "a" * 120, "2": "preview", "3": "short"}


def test_claims_split_and_checks(spark, tmp_path):
    raw = spark.createDataFrame([("Kale", "food", "treats", "Flu", "condition", "c", "1"), ("Kale", "Task", "treats", "Flu", "condition", "c", " "), ("Kale", "odd kind", "x", "Flu", "Disease", "c", None)], "subject string, subject_type string, predicate string, object string, object_type string, context string, source_id string")
    papers.write_claims_split(claims.validate(claims.normalize_claims(raw)), f"{tmp_path}/split")
    assert sorted(r[0] for r in spark.read.parquet(f"{tmp_path}/split").select("part").collect()) == ["rejected", "rejected", "valid"]
    assert claims.claims_without_source(raw).count() == 2 and tuple(claims.claim_check(raw).first()) == (3, 1, 2)
    assert tuple(claims.normalization_fixes(raw).first()) == (3, 9 - 1, 3)
    assert {r.kind: r.n for r in claims.types_outside(raw).collect()} == {"Odd_kind": 1, "Thing": 1}
    assert tuple(claims.normalization_fixes(raw.limit(0)).first()) == (0, 0, 0)


def test_sketches_of_sources_merge(spark):
    rng = random.Random(1)
    rows = [(f"PMC{rng.randint(0, 20_000)}", f"2020-{rng.randint(1, 12):02d}") for _ in range(40_000)] + [(None, "2020-01"), (" ", None)]
    edges = spark.createDataFrame(rows, "source_id string, pub_date string")
    sketches = audit.source_sketches(edges)
    exact = len({s for s, _ in rows if s and s.strip()})
    assert sketches.count() == 12 and abs(audit.unique_sources_approx(sketches).first().sources - exact) < 0.03 * exact
    assert audit.unique_sources_approx(sketches.limit(0)).first().sources == 0


def test_answers_by_function_and_table_function(spark):
    good = json.dumps([{"subject": "a", "predicate": "p", "object": "b", "source_id": ""}, {"subject": "c", "source_id": "S"}])
    rows = [("P1", f"Sure: {good} done"), ("P2", "none"), ("P3", "[broken"), ("P4", None), ("P5", "[]"), ("P6", '[{"subject": "back\\slash", "object": 5}]')]
    df = spark.createDataFrame(rows, "pmcid string, answer string")
    spark.udtf.register("claims_of", papers.claims_udtf())
    by_sql = spark.sql("SELECT c.subject, c.object, c.source_id FROM {a} a, LATERAL claims_of(a.pmcid, a.answer) c", a=df)
    want = [("a", "b", "P1"), ("back\\slash", "5", "P6"), ("c", None, "S")]
    assert sorted(tuple(r) for r in by_sql.collect()) == want
    assert sorted(tuple(r) for r in papers.claims_from_responses(df).select("subject", "object", "source_id").collect()) == want


def test_small_tables_of_logs_and_words(spark):
    words = lambda *rows: spark.createDataFrame(list(rows), "key string, canonical string")
    assert {(r.key, r.kind) for r in claims.vocab_drift(words(("a", "A"), ("b", "B"), ("c", "C")), words(("a", "A"), ("b", "X"), ("d", "D"))).collect()} == {("b", "differs"), ("c", "only_left"), ("d", "only_right")}
    aliases = spark.createDataFrame([("GOOD", "TREATS"), ("bad", "TREATS"), ("ODD", "NOTHING")], "key string, target string")
    assert {(r.key, r.problem) for r in claims.alias_target_check(aliases, spark.createDataFrame([("TREATS",)], "name string")).collect()} == {("bad", "key case"), ("ODD", "unknown target")}
    assert [r.delta for r in users.kg_trend(spark.createDataFrame([(1, 1, 10), (2, 2, 15), (3, 3, 12)], "ts int, id int, value int"), 2).orderBy("ts").collect()] == [None, -3]
    saved = spark.createDataFrame([(1, 1, 1, ["a"]), (1, 2, 2, ["a", "b"]), (1, 3, 3, ["b", "c"]), (2, 1, 4, ["x"])], "user_id int, ts int, id int, conditions array<string>")
    assert [tuple(r) for r in users.condition_diff(saved).collect()] == [(1, ["c"], ["a"])]
    base = spark.createDataFrame([(1, "a", 5, ["x"]), (2, "b", 6, None)], "user_id int, goal string, age int, kinds array<string>")
    patch = spark.createDataFrame([(1, "", None, ["y", "x"]), (3, "c", 7, ["z"])], "user_id int, goal string, age int, kinds array<string>")
    merged = {r.user_id: tuple(r)[1:] for r in users.merge_contexts(base, patch, ["goal", "age"], ["kinds"]).collect()}
    assert merged == {1: ("a", 5, ["x", "y"]), 2: ("b", 6, []), 3: ("c", 7, ["z"])}
    some = claims.placeholder_claims(spark.createDataFrame([("T", "J", "a" * 300, "P1")], "title string, journal string, abstract string, pmcid string")).first()
    assert (some.subject, some.predicate, some.object, len(some.context), some.source_id) == ("T", "DOCUMENTS", "J", 200, "P1")
    before, after = (spark.createDataFrame([(x, y)], "a int, b int") for x, y in ((1, 2), (4, 2)))
    assert {r.metric: r.delta for r in audit.audit_delta(before, after, ["a", "b"]).collect()} == {"a": 3.0, "b": 0.0}
