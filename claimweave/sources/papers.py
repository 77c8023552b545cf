"""Papers: readers for landed files, id lists and backlogs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PAPER = "pmcid string, title string, journal string, date string, abstract string, full_text_preview string, body string, source_type string, source string, drug_class string, brand_name string, generic_name string, fetch_sources array<string>"
CLAIM = "subject string, subject_type string, predicate string, object string, object_type string, context string, source_id string, source_type string, journal string, pub_date string, evidence_type string"


def _texts(spark: SparkSession, path: str, whole_files: bool) -> DataFrame:
    """file and value: a JSON text per file, or per line."""
    return spark.read.text(path, wholetext=whole_files, pathGlobFilter="*.json" if whole_files else "*").select(F.col("_metadata.file_name").alias("file"), "value")


def _records(spark: SparkSession, path: str, whole_files: bool) -> DataFrame:
    """file, v: one VARIANT per paper; a text may hold one object or an array of them."""
    parsed = _texts(spark, path, whole_files).select("file", F.try_parse_json("value").alias("v"))
    several = F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v"))
    return parsed.select("file", F.explode(several).alias("v"))


def _field(*names: str) -> Column:
    """The first of the named fields that is a text with something in it."""
    return F.coalesce(*[F.nullif(F.trim(F.try_variant_get("v", f"$.{n}", "string")), F.lit("")) for n in names])


def _as_paper() -> list[Column]:
    """Columns of a paper from any of the three layouts: articles, search results and drug labels."""
    label = _field("source_type").isin("FDA", "drug_label") | _field("drug_class").isNotNull()
    found = _field("abstractText", "journalTitle", "firstPublicationDate").isNotNull() | (_field("source") == "europepmc")
    raw_id = _field("pmcid", "id")
    key = F.when(raw_id.rlike("^[0-9]+$"), F.concat(F.lit("PMC"), raw_id)).otherwise(raw_id)
    day = _field("date", "firstPublicationDate")
    date = F.coalesce(F.when(day.rlike("^[0-9]{8}$"), F.concat_ws("-", day.substr(1, 4), day.substr(5, 2), day.substr(7, 2))), day, F.lit("Unknown"))
    text = lambda *names: F.coalesce(_field(*names), F.lit(""))
    return [
        F.when(label, "label").when(found, "search").otherwise("article").alias("layout"), key.alias("pmcid"), text("title").alias("title"), text("journal", "journalTitle").alias("journal"), date.alias("date"),
        text("abstract", "abstractText").alias("abstract"), text("full_text_preview").alias("full_text_preview"), text("body").alias("body"), F.coalesce(_field("source_type"), F.lit("PMC")).alias("source_type"),
        text("source").alias("source"), text("drug_class").alias("drug_class"), text("brand_name").alias("brand_name"), text("generic_name").alias("generic_name"),
        F.coalesce(F.try_variant_get("v", "$.fetch_sources", "array<string>"), F.array().cast("array<string>")).alias("fetch_sources"),
    ]


def read_papers(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """Papers of a folder of JSON files (or, not whole_files, of JSON lines) in any of three layouts, as one table.

    layout tells articles, search results and drug labels apart.  Bare numbers as ids get their PMC prefix, dates of eight
    digits their hyphens; a field that is missing, null or of another kind is empty, a missing date Unknown.  An empty file holds no text.  Broken texts and
    records without an id are left out; broken_papers names them.
    """
    return _records(spark, path, whole_files).select(*_as_paper()).where(F.col("pmcid").isNotNull())


def broken_papers(spark: SparkSession, path: str, whole_files: bool = True) -> DataFrame:
    """file, problem of every text that is no JSON and every record without an id."""
    problem = F.when(F.col("v").isNull(), "not JSON").when(_field("pmcid", "id").isNull(), "no id")
    return _records(spark, path, whole_files).select("file", problem.alias("problem")).where(F.col("problem").isNotNull())


def read_claims(spark: SparkSession, path: str) -> DataFrame:
    """Claims of all *_triples.json files (arrays of objects) but the rejected ones."""
    df = spark.read.schema(CLAIM).json(path, multiLine=True, pathGlobFilter="*_triples.json")
    return df.where(F.col("_metadata.file_name") != "rejected_triples.json").where(F.col("subject").isNotNull() | F.col("object").isNotNull())


def write_claims_split(validated: DataFrame, path: str) -> None:
    """valid and rejected claims as the two partitions of one write: the input is read once."""
    validated.withColumn("part", F.when(F.col("reject_rule").isNull(), "valid").otherwise("rejected")).write.partitionBy("part").parquet(path)


#: The parts of an article that are read; elements with mark-up inside are kept as their inner text.
_FRONT = """struct<`journal-meta`: struct<`journal-title`: string, `journal-title-group`: struct<`journal-title`: string>>, `article-meta`: struct<`title-group`: struct<`article-title`: string>, abstract: array<string>,
  `pub-date`: array<struct<`_date-type`: string, year: string, month: string, day: string>>>>"""
ARTICLE = f"front {_FRONT}, body string, article struct<front: {_FRONT}, body: string>"
PREVIEW = 1000


def from_xml(articles: DataFrame) -> DataFrame:
    """(id, xml) rows to papers; each text is parsed once, by schema, be the article the root or inside a set.

    Of several dates the one marked "pub" counts, else the first; month and day are padded and default to 01, without a year the
    date is Unknown.  Titles, abstracts and bodies are their text without mark-up; a longer body is cut and marked.
    """
    parsed = articles.select("id", F.from_xml("xml", ARTICLE).alias("x")).select("id", F.coalesce("x.front", "x.article.front").alias("f"), F.coalesce("x.body", "x.article.body").alias("body"))
    parsed = parsed.select("id", "body", F.col("f.`journal-meta`").alias("j"), F.col("f.`article-meta`").alias("m"))
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", ""), "&lt;", "<"), "&gt;", ">"), "&amp;", "&"))
    full = lambda c: F.nullif(plain(c), F.lit(""))
    dates = F.col("m.`pub-date`")
    day = F.coalesce(F.get(F.filter(dates, lambda d: d["_date-type"] == "pub"), F.lit(0)), F.get(dates, F.lit(0)))
    padded = lambda c: F.lpad(F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("01")), 2, "0")
    date = F.when(F.nullif(F.trim(day["year"]), F.lit("")).isNotNull(), F.concat_ws("-", F.trim(day["year"]), padded(day["month"]), padded(day["day"]))).otherwise("Unknown")
    body = F.coalesce(plain(F.col("body")), F.lit(""))
    journal = F.coalesce(full(F.col("j.`journal-title-group`.`journal-title`")), full(F.col("j.`journal-title`")), F.lit("Unknown Journal"))
    return parsed.select(
        F.concat(F.lit("PMC"), F.col("id").cast("string")).alias("pmcid"), F.coalesce(full(F.col("m.`title-group`.`article-title`")), F.lit("No Title")).alias("title"), journal.alias("journal"), date.alias("date"),
        F.coalesce(full(F.get("m.abstract", F.lit(0))), F.lit("")).alias("abstract"), F.when(F.length(body) > PREVIEW, F.concat(body.substr(1, PREVIEW), F.lit("..."))).otherwise(body).alias("full_text_preview"),
    )


def from_html(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) as papers: title, host and the text without mark-up."""
    clean = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, r"(?is)<(script|style)[^>]*>.*?</\1>|<!--.*?-->|<[^>]+>", " "), r"\s+", " "))
    return pages.select(F.concat(F.lit("PAGE"), F.col("page_id").cast("string")).alias("pmcid"), clean(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("title"), F.regexp_extract("url", r"^\w+://([^/]+)", 1).alias("journal"), F.length(clean(F.col("html"))).alias("n_chars"))


def from_search_results(results: DataFrame) -> DataFrame:
    """Search rows (pmcid, title, journal, date, abstract) with a PMC id and a title or abstract."""
    return results.where(F.col("pmcid").startswith("PMC") & (F.concat(F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit(""))) != ""))


def from_labels(labels: DataFrame) -> DataFrame:
    """Drug labels (appl, brand, generic, sections, day as YYYYMMDD) as papers."""
    name = F.coalesce(F.nullif(F.trim(F.split("brand", ";")[0]), F.lit("")), F.trim(F.split("generic", ";")[0]))
    key = F.coalesce(F.concat(F.lit("FDA_"), F.nullif("appl", F.lit(""))), F.concat(F.lit("FDA_"), F.substring(name, 1, 20), F.lit("_"), F.substring(F.md5(name), 1, 8)))
    day = F.coalesce(F.date_format(F.try_to_date("day", "yyyyMMdd"), "yyyy-MM-dd"), F.lit("Unknown"))
    return labels.select(key.alias("pmcid"), name.alias("title"), F.lit("FDA").alias("journal"), day.alias("date"), F.substring(F.array_join("sections", "\n\n"), 1, 8000).alias("body"))


def merge_id_lists(hits: DataFrame) -> DataFrame:
    """hits (rank, label, id): per id its first rank and all labels that found it."""
    return hits.groupBy("id").agg(F.min("rank").alias("first_rank"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))


def new_ids_only(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Ids not yet stored, each under its first phase."""
    return found.join(stored.select("id"), "id", "left_anti").groupBy("id").agg(F.min("phase").alias("phase"))


def unextracted_papers(papers: DataFrame, claims: DataFrame, k: int) -> DataFrame:
    """The k newest papers without claims."""
    have = claims.select(F.col("source_id").alias("pmcid"))
    return papers.join(have, "pmcid", "left_anti").orderBy(F.desc("date"), "pmcid").limit(k)


def corpus_backlog(raw: DataFrame, extracted: DataFrame) -> DataFrame:
    a, b = raw.agg(F.count("*").alias("raw")), extracted.where(F.trim("pmcid") != "").agg(F.count_distinct("pmcid").alias("extracted"))
    return a.crossJoin(b).withColumn("backlog", F.greatest(F.lit(0), F.col("raw") - F.col("extracted")))  # one row each


def extraction_text(papers: DataFrame) -> DataFrame:
    """pmcid and the abstract, or the preview where the abstract is under 100 characters; empty ones go."""
    text = F.when(F.length(F.coalesce("abstract", F.lit(""))) < 100, F.coalesce(F.nullif("full_text_preview", F.lit("")), F.col("abstract"))).otherwise(F.col("abstract"))
    return papers.select("pmcid", F.trim(text).alias("text")).where(F.col("text") != "")


def claims_from_responses(responses: DataFrame) -> DataFrame:
    """Raw answers (pmcid, answer) to claims: the outermost JSON array is taken, answers without one give no row."""
    body = F.regexp_replace(F.regexp_extract("answer", r"(?s)(\[.*\])", 1), r"\\(?![\"\\/bfnrtu])", r"\\\\")
    return responses.select("pmcid", F.explode(F.from_json(body, f"array<struct<{', '.join(c.replace(' ', ':') for c in CLAIM.split(', '))}>>")).alias("c")).select("c.*", "pmcid").withColumn("source_id", F.coalesce(F.nullif("source_id", F.lit("")), F.col("pmcid"))).drop("pmcid")


def claims_udtf():
    """claims_from_responses as a table function: register it, then SELECT ... FROM answers, LATERAL claims_of(pmcid, answer)."""
    columns = [c.split()[0] for c in CLAIM.split(", ")]

    @F.udtf(returnType=CLAIM, useArrow=False)
    class ClaimsOf:
        def eval(self, pmcid: str, answer: str):
            import json
            import re

            held = re.search(r"(?s)(\[.*\])", answer or "")
            try:
                rows = json.loads(re.sub(r'\\(?!["\\/bfnrtu])', r"\\\\", held[1])) if held else []
            except ValueError:
                return
            for row in rows:
                if isinstance(row, dict):
                    got = {c: None if row.get(c) is None else str(row[c]) for c in columns}
                    got["source_id"] = got["source_id"] or pmcid
                    yield tuple(got[c] for c in columns)

    return ClaimsOf
