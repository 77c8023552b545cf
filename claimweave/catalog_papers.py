"""Registered queries on papers, claims as data and logs, with their DuckDB twins.

PAPERS: (operator applied to the projected tables, SQL on the given tables).  GRAPH_PAPERS: SQL after the projection's WITH list.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import vocab
from .operators import audit, claims, users
from .plans import fixtures
from .plans.shared import shared_dir
from .sources import papers

#: Layout of a document by its number: an article, a search result, a drug label, a broken line, a paper without an id.
KINDS = 5


def _landed(p) -> str:
    """All documents as JSON lines of three layouts, some of them broken, in the shared folder."""
    doc = p.table("documents").select(F.coalesce("doc_id", F.lit(0)).alias("i"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("source", F.lit("")).alias("source"))
    number = F.col("i").cast("string")
    article = F.to_json(F.struct(F.concat(F.lit("PMC"), number).alias("pmcid"), F.lit("T").alias("title"), F.col("source").alias("journal"), F.lit("2020-01-02").alias("date"), F.col("text").alias("abstract"), F.array("source").alias("fetch_sources")))
    search = F.to_json(F.struct(number.alias("id"), F.col("text").alias("abstractText"), F.col("source").alias("journalTitle"), F.lit("2021-03-04").alias("firstPublicationDate"), F.lit("europepmc").alias("source")))
    label = F.concat(F.lit("["), F.to_json(F.struct(F.concat(F.lit("FDA_"), number).alias("pmcid"), F.lit("FDA").alias("source_type"), F.lit("20190506").alias("date"), F.col("text").alias("body"), F.lit("statin").alias("drug_class"))), F.lit("]"))
    line = F.when(F.col("i") % KINDS == 0, article).when(F.col("i") % KINDS == 1, search).when(F.col("i") % KINDS == 2, label).when(F.col("i") % KINDS == 3, F.concat(F.lit("{broken "), number)).otherwise(F.to_json(F.struct(F.lit(None).cast("string").alias("pmcid"), F.lit("x").alias("title")), {"ignoreNullFields": "false"}))
    path = shared_dir(p.spark, "landed")
    doc.select(line.alias("value")).write.text(path)
    return path


READ = f"""SELECT CASE doc_id % {KINDS} WHEN 0 THEN 'article' WHEN 1 THEN 'search' ELSE 'label' END AS layout, CASE doc_id % {KINDS} WHEN 2 THEN 'FDA_' ELSE 'PMC' END || doc_id AS pmcid,
  CASE doc_id % {KINDS} WHEN 0 THEN '2020-01-02' WHEN 1 THEN '2021-03-04' ELSE '2019-05-06' END AS date, CASE WHEN doc_id % {KINDS} = 2 THEN '' ELSE source END AS journal, CASE WHEN doc_id % {KINDS} = 2 THEN 'FDA' ELSE 'PMC' END AS source_type,
  CASE WHEN doc_id % {KINDS} = 0 THEN source ELSE '' END AS fetch_sources, CAST(length(trim(text)) AS INTEGER) AS n_chars FROM documents WHERE doc_id % {KINDS} < 3"""


def _read(p) -> DataFrame:
    got = papers.read_papers(p.spark, _landed(p), whole_files=False)
    return got.select("layout", "pmcid", "date", "journal", "source_type", F.array_join("fetch_sources", ",").alias("fetch_sources"), F.length(F.concat("abstract", "body")).alias("n_chars"))


def _articles(p) -> DataFrame:
    """Documents as article XML, some in a set, without a date or with two."""
    safe = lambda c: F.replace(F.replace(F.replace(F.regexp_replace(c, "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]", " "), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    i = F.col("doc_id")
    dates = F.when(i % 3 == 0, "<pub-date date-type='epub'><year>2001</year></pub-date><pub-date date-type='pub'><year>2002</year><month>3</month></pub-date>").when(i % 3 == 1, "<pub-date><year>2003</year><month>11</month><day>9</day></pub-date>").otherwise("")
    words = F.regexp_extract(F.trim("text"), r"(?s)^(\S*)", 1)
    article = F.concat(F.lit("<article><front><journal-meta><journal-title-group><journal-title>"), safe(F.col("source")), F.lit("</journal-title></journal-title-group></journal-meta><article-meta><title-group><article-title>On <italic>"), safe(words), F.lit("</italic></article-title></title-group>"), dates, F.lit("<abstract><p>a</p><p>b</p></abstract></article-meta></front><body><sec><p>"), safe(F.col("text")), F.lit("</p></sec></body></article>"))
    return p.table("documents").select(i.alias("id"), F.when(i % 2 == 0, article).otherwise(F.concat(F.lit("<pmc-articleset>"), article, F.lit("</pmc-articleset>"))).alias("xml"))


XML = r"""SELECT 'PMC' || doc_id AS pmcid, trim('On ' || regexp_extract(trim(text), '^(\S*)', 1)) AS title, CASE WHEN trim(source) = '' THEN 'Unknown Journal' ELSE source END AS journal,
  CASE doc_id % 3 WHEN 0 THEN '2002-03-01' WHEN 1 THEN '2003-11-09' ELSE 'Unknown' END AS date, 'ab' AS abstract, length(trim(text)) > 1000 AS longer FROM documents"""


def _of_xml(p) -> DataFrame:
    return papers.from_xml(_articles(p)).select("pmcid", "title", "journal", "date", "abstract", F.col("full_text_preview").endswith("...").alias("longer"))


THROTTLED = """WITH RECURSIVE e AS (SELECT event_type, CAST(floor(epoch(ts)) AS BIGINT) AS t, min(event_id) AS id FROM events GROUP BY 1, 2),
acc AS (SELECT event_type, min(t) AS t FROM e GROUP BY 1 UNION ALL SELECT a.event_type, min(e.t) FROM acc a JOIN e ON e.event_type = a.event_type AND e.t >= a.t + 300 GROUP BY 1)
SELECT e.event_type, e.id FROM acc JOIN e USING (event_type, t)"""
PAGES = r"""SELECT 'PAGE' || page_id AS pmcid, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), T, ' ', 'g'), '\s+', ' ', 'g')) AS title, regexp_extract(url, '^\w+://([^/]+)', 1) AS journal,
  CAST(length(trim(regexp_replace(regexp_replace(html, T, ' ', 'g'), '\s+', ' ', 'g'))) AS INTEGER) AS n_chars FROM pages""".replace("T,", "'(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->|<[^>]+>',")
LABELS = """SELECT CASE WHEN p_partkey % 3 = 0 THEN 'FDA_' || p_partkey ELSE 'FDA_' || substr(p_name, 1, 20) || '_' || substr(md5(p_name), 1, 8) END AS pmcid, p_name AS title, 'FDA' AS journal, CASE WHEN p_partkey % 2 = 0 THEN '2020-01-31' ELSE 'Unknown' END AS date, p_name || chr(10) || chr(10) || p_brand AS body FROM part"""


def _labels(p) -> DataFrame:
    k = F.col("p_partkey")
    rows = p.table("part").select(F.when(k % 3 == 0, k.cast("string")).otherwise("").alias("appl"), F.when(k % 2 == 0, F.concat("p_name", F.lit("; other"))).otherwise("").alias("brand"), F.concat("p_name", F.lit(";x")).alias("generic"), F.array("p_name", "p_brand").alias("sections"), F.when(k % 2 == 0, "20200131").otherwise("2020").alias("day"))
    return papers.from_labels(rows)


def _found(p) -> DataFrame:
    k = F.col("o_orderkey")
    rows = p.table("orders").select(F.concat(F.when(k % 4 == 0, "MED").otherwise("PMC"), k.cast("string")).alias("pmcid"), F.when(k % 3 > 0, F.col("o_orderpriority")).alias("title"), F.lit("j").alias("journal"), F.lit("d").alias("date"), F.when(k % 5 > 0, "a").otherwise("").alias("abstract"))
    return papers.from_search_results(rows).select("pmcid")


def _dated(p) -> DataFrame:
    return p.table("orders").select(F.concat(F.lit("PMC"), F.col("o_orderkey").cast("string")).alias("pmcid"), F.substring(F.col("o_orderdate").cast("string"), 1, 10).alias("date"))


def _reports(p, low: str, high: str) -> DataFrame:
    return p.table("orders").where(f"o_orderdate >= '{low}' AND o_orderdate < '{high}'").agg(F.count("*").alias("orders"), F.sum("o_custkey").alias("customers"))


DELTA = "SELECT metric, b AS before, a AS after, a - b AS delta FROM (SELECT unnest(['orders', 'customers']) AS metric, unnest([CAST(count(*) FILTER (o_orderdate < '1996-01-01') AS DOUBLE), CAST(sum(o_custkey) FILTER (o_orderdate < '1996-01-01') AS DOUBLE)]) AS b, unnest([CAST(count(*) FILTER (o_orderdate >= '1996-01-01') AS DOUBLE), CAST(sum(o_custkey) FILTER (o_orderdate >= '1996-01-01') AS DOUBLE)]) AS a FROM orders)"
TREND = "SELECT day, id, value, CAST(value - lag(value) OVER (ORDER BY day, id) AS BIGINT) AS delta FROM (SELECT CAST(o_orderdate AS DATE) AS day, 0 AS id, count(*) AS value FROM orders GROUP BY 1 ORDER BY day DESC LIMIT 30)"


def _trend(p) -> DataFrame:
    days = p.table("orders").groupBy(F.col("o_orderdate").cast("date").alias("ts")).agg(F.count("*").alias("value")).withColumn("id", F.lit(0))
    return users.kg_trend(days).withColumnRenamed("ts", "day")


def _vocabularies(p) -> tuple[DataFrame, DataFrame]:
    part = p.table("part").select("p_partkey", F.concat_ws(" ", "p_name", "p_brand").alias("key"), F.upper("p_name").alias("canonical"))
    side = lambda m, c: part.where(F.col("p_partkey") % 7 != m).groupBy("key").agg(F.min(c).alias("canonical"))
    return side(0, F.col("canonical")), side(1, F.when(F.col("p_partkey") % 5 > 0, F.col("canonical")).otherwise("other"))


DRIFT = """WITH p AS (SELECT p_partkey, p_name || ' ' || p_brand AS key, upper(p_name) AS canonical FROM part), l AS (SELECT key, min(canonical) AS left_value FROM p WHERE p_partkey % 7 <> 0 GROUP BY 1),
r AS (SELECT key, min(CASE WHEN p_partkey % 5 > 0 THEN canonical ELSE 'other' END) AS right_value FROM p WHERE p_partkey % 7 <> 1 GROUP BY 1)
SELECT key, left_value, right_value, CASE WHEN right_value IS NULL THEN 'only_left' WHEN left_value IS NULL THEN 'only_right' ELSE 'differs' END AS kind FROM l FULL JOIN r USING (key) WHERE left_value IS DISTINCT FROM right_value"""


def _aliases(p) -> DataFrame:
    rows = p.raw.select(F.when(F.length("predicate") % 2 == 0, F.upper("predicate")).otherwise(F.lower("predicate")).alias("key"), F.upper(F.translate("predicate", " -", "__")).alias("target")).distinct()
    return claims.alias_target_check(rows, p.spark.createDataFrame([(x,) for x in vocab.PREDICATES], "name string"))


ALIASES = f"""SELECT key, target, 'unknown target' AS problem FROM (SELECT DISTINCT CASE WHEN length(predicate) % 2 = 0 THEN upper(predicate) ELSE lower(predicate) END AS key, upper(translate(predicate, ' -', '__')) AS target FROM raw) WHERE target NOT IN {fixtures._in(vocab.PREDICATES)}
UNION ALL SELECT key, target, 'key case' FROM (SELECT DISTINCT CASE WHEN length(predicate) % 2 = 0 THEN upper(predicate) ELSE lower(predicate) END AS key, upper(translate(predicate, ' -', '__')) AS target FROM raw) WHERE key <> upper(key)"""


def _answers(p) -> DataFrame:
    """Answers of an extractor: a claim in an array, with words around it, broken, or none."""
    i = F.col("doc_id")
    claim = F.to_json(F.struct(F.col("source").alias("subject"), F.lit("TREATS").alias("predicate"), F.lit("flu").alias("object"), F.when(i % 2 == 0, F.lit("S1")).alias("source_id")))
    answer = F.when(i % 4 < 2, F.concat(F.lit("Here: ["), claim, F.lit(", "), claim, F.lit("] done"))).when(i % 4 == 2, F.concat(F.lit("["), claim, F.lit(" oops]"))).otherwise("none")
    return p.table("documents").select(F.concat(F.lit("PMC"), i.cast("string")).alias("pmcid"), answer.alias("answer"))


ANSWERS = "SELECT source AS subject, 'TREATS' AS predicate, 'flu' AS object, CASE WHEN doc_id % 2 = 0 THEN 'S1' ELSE 'PMC' || doc_id END AS source_id FROM documents, range(2) WHERE doc_id % 4 < 2"


def _by_udtf(p) -> DataFrame:
    p.spark.udtf.register("claims_of", papers.claims_udtf())
    return p.spark.sql("SELECT c.subject, c.predicate, c.object, c.source_id FROM {answers} a, LATERAL claims_of(a.pmcid, a.answer) c", answers=_answers(p))


def _sources(p) -> DataFrame:
    exact, near = audit.unique_sources(p.edges), audit.unique_sources_approx(audit.source_sketches(p.edges))
    both = exact.crossJoin(near.withColumnRenamed("sources", "estimate"))  # one row each
    return both.select("sources", (F.abs(F.col("estimate") - F.col("sources")) <= 0.05 * F.col("sources")).alias("within_5_pct"))


PAPERS: dict[str, tuple[Callable, str | None]] = {
    "read_papers": (_read, READ),
    "broken_papers": (lambda p: papers.broken_papers(p.spark, _landed(p), whole_files=False).groupBy("problem").agg(F.count("*").alias("n")), f"SELECT CASE doc_id % {KINDS} WHEN 3 THEN 'not JSON' ELSE 'no id' END AS problem, count(*) AS n FROM documents WHERE doc_id % {KINDS} >= 3 GROUP BY 1"),
    "papers_from_article_xml": (_of_xml, XML),
    "papers_from_labels": (_labels, LABELS),
    "papers_from_search_results": (_found, "SELECT 'PMC' || o_orderkey AS pmcid FROM orders WHERE o_orderkey % 4 <> 0 AND ((o_orderkey % 3 > 0 AND o_orderpriority <> '') OR o_orderkey % 5 > 0)"),
    "papers_from_pages": (lambda p: papers.from_html(p.table("pages")), PAGES),
    "unextracted_papers": (lambda p: papers.unextracted_papers(_dated(p), p.table("lineitem").where("l_orderkey % 3 > 0").select(F.concat(F.lit("PMC"), F.col("l_orderkey").cast("string")).alias("source_id")), 40), "SELECT 'PMC' || o_orderkey AS pmcid, substr(CAST(o_orderdate AS VARCHAR), 1, 10) AS date FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey % 3 > 0) ORDER BY date DESC, pmcid LIMIT 40"),
    "extraction_text": (lambda p: papers.extraction_text(p.table("documents").select(F.concat(F.lit("PMC"), F.col("doc_id").cast("string")).alias("pmcid"), F.substring("text", 1, 150).alias("abstract"), F.when(F.col("doc_id") % 2 == 0, "preview").otherwise("").alias("full_text_preview"))).select("pmcid", F.md5("text").alias("text")), r"SELECT pmcid, md5(trim(t)) AS text FROM (SELECT 'PMC' || doc_id AS pmcid, CASE WHEN length(substr(text, 1, 150)) < 100 AND doc_id % 2 = 0 THEN 'preview' ELSE substr(text, 1, 150) END AS t FROM documents) WHERE trim(t) <> ''"),
    "placeholder_claims": (lambda p: claims.placeholder_claims(p.table("documents").select(F.col("doc_id").cast("string").alias("pmcid"), F.col("source").alias("title"), F.col("lang").alias("journal"), F.col("text").alias("abstract"))).withColumn("context", F.md5("context")), "SELECT source AS subject, 'Study' AS subject_type, 'DOCUMENTS' AS predicate, lang AS object, 'Study' AS object_type, md5(substr(text, 1, 200)) AS context, CAST(doc_id AS VARCHAR) AS source_id FROM documents"),
    "priority_papers": (lambda p: users.priority_papers(p.papers, [r"\bthion\b", r"\blicensed\b"], p.spark.createDataFrame([("of the",), (" That ",)], "entity string")).select("pmcid"), r"SELECT 'PMC' || doc_id AS pmcid FROM documents WHERE regexp_matches(lower(text), '\bthion\b|\blicensed\b') OR regexp_matches(lower(text), '(?:^|[^\p{L}\p{N}_])(?:of the|that)(?:$|[^\p{L}\p{N}_])')"),
    "stats_throttle": (lambda p: users.throttle(p.table("events").select("event_type", "ts", F.col("event_id").alias("id")), "event_type"), THROTTLED),
    "audit_delta": (lambda p: audit.audit_delta(_reports(p, "1900-01-01", "1996-01-01"), _reports(p, "1996-01-01", "2999-01-01"), ["orders", "customers"]), DELTA),
    "kg_trend": (_trend, TREND),
    "vocab_drift": (lambda p: claims.vocab_drift(*_vocabularies(p)), DRIFT),
    "claims_from_responses": (lambda p: papers.claims_from_responses(_answers(p)).select("subject", "predicate", "object", "source_id"), ANSWERS),
    "claims_from_response": (_by_udtf, ANSWERS),
}
_KIND = fixtures._type_sql
_NEW = lambda c: f"coalesce({_KIND(c)}, 'Thing')"
_MOVED = f"CAST(coalesce(subject_type, '') <> {_NEW('subject_type')} AS INTEGER) + CAST(coalesce(object_type, '') <> {_NEW('object_type')} AS INTEGER) + CAST(coalesce(predicate, '') <> {fixtures._predicate_sql('predicate')} AS INTEGER)"
GRAPH_PAPERS: dict[str, tuple[Callable, str]] = {
    "claims_without_source": (lambda p: claims.claims_without_source(p.normalized).groupBy("subject", "predicate", "object").agg(F.count("*").alias("n")), "SELECT subject, predicate, object, count(*) AS n FROM claims WHERE reject_rule = 'missing source_id' GROUP BY ALL"),
    "normalization_fixes": (lambda p: claims.normalization_fixes(p.raw), f"SELECT count(*) AS claims, CAST(sum(n) AS BIGINT) AS fixed, count(*) FILTER (n > 0) AS changed_claims FROM (SELECT {_MOVED} AS n FROM raw)"),
    "types_outside": (lambda p: claims.types_outside(p.raw), f"SELECT kind, count(*) AS n FROM (SELECT {_NEW('subject_type')} AS kind FROM raw UNION ALL SELECT {_NEW('object_type')} FROM raw) WHERE kind NOT IN {fixtures._in(vocab.ENTITY_TYPES)} GROUP BY 1 ORDER BY n DESC, kind LIMIT 20"),
    "alias_target_check": (_aliases, ALIASES),
    "unique_sources_approx": (_sources, "SELECT count(DISTINCT nullif(trim(source_id), '')) AS sources, true AS within_5_pct FROM edges"),
}
