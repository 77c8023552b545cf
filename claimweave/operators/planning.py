"""What to fetch and extract next: query strings, clusters, seeds, manifests, prompts and samples."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocab
from ..sources.papers import CLAIM


def journal_query_strings(journals: DataFrame, since: str, until: str, keywords: list[str] | None = None, per_batch: int = 30) -> DataFrame:
    """initial, batch, query: journals (journal) in batches of one first letter, so that no window holds them all."""
    j = journals.where(F.trim("journal") != "").select(F.trim("journal").alias("journal")).distinct().withColumn("initial", F.lower(F.substring("journal", 1, 1)))
    rn = F.row_number().over(Window.partitionBy("initial").orderBy("journal"))
    j = j.withColumn("batch", F.floor((rn - 1) / per_batch).cast("int"))
    names = F.array_join(F.array_sort(F.collect_list(F.concat(F.lit('"'), "journal", F.lit('"[Journal]')))), " OR ")
    extra = f" AND ({' OR '.join(keywords)})" if keywords else ""
    return j.groupBy("initial", "batch").agg(F.concat(F.lit("("), names, F.lit(f') AND "{since}":"{until}"[Date]{extra}')).alias("query"))


def active_clusters(clusters: DataFrame, gaps: DataFrame | None = None, requested: list[str] | None = None) -> DataFrame:
    """cluster: those requested; else, of clusters (cluster, entities), all without gaps (entity), or those with no entities or one that is a gap.

    Clusters may also come as (cluster, entity) pairs, a row each (a null entity for a cluster with none), so that none becomes one large array.
    """
    if "entity" in clusters.columns:
        if requested or gaps is None:
            return active_clusters(clusters.select("cluster").distinct(), None, requested)
        bare = clusters.groupBy("cluster").agg(F.count("entity").alias("n")).where(F.col("n") == 0).select("cluster")
        return bare.unionByName(clusters.join(gaps.select("entity"), "entity", "left_semi").select("cluster").distinct())
    if requested:
        return clusters.where(F.col("cluster").isin(requested)).select("cluster")
    if gaps is None:
        return clusters.select("cluster")
    always = clusters.where(F.coalesce(F.size("entities"), F.lit(0)) <= 0).select("cluster")
    hit = clusters.select("cluster", F.explode("entities").alias("entity")).join(gaps.select("entity"), "entity", "left_semi").select("cluster").distinct()
    return always.unionByName(hit)


def cluster_for_top_gap(counts: DataFrame, mapping: DataFrame) -> DataFrame:
    """The clusters mapped (gap_type, clusters) to the largest gap class (gap_type, n); ties go to the first name."""
    best = counts.agg(F.max(F.struct("n", F.lit(0).alias("z"))).alias("m")).select(F.col("m.n").alias("n"))
    top = counts.join(best, "n").agg(F.min("gap_type").alias("gap_type"), F.max("n").alias("n"))
    return top.join(mapping, "gap_type").select("gap_type", "n", "clusters")


def seed_edges(seeds: DataFrame) -> DataFrame:
    """Edges OCCURS_AT of (disease, organs): repeated seeds give one edge each."""
    pairs = seeds.select(F.lower(F.trim("disease")).alias("src"), F.explode("organs").alias("o")).select("src", F.lower(F.trim("o")).alias("dst")).where((F.col("src") != "") & (F.col("dst") != "")).distinct()
    return pairs.select(F.lit("Disease").alias("src_label"), "src", F.lit("OCCURS_AT").alias("rel"), F.lit("BodySystem").alias("dst_label"), "dst", F.lit("seed_organs").alias("source_id"))


def nutrient_amounts(answers: DataFrame, hits: int = 3, nutrients: int = 10) -> DataFrame:
    """answers (query, foods: array of (id, description, nutrients: array of (name, unit, amount))): the first foods and nutrients of each."""
    food = answers.select("query", F.explode(F.slice("foods", 1, hits)).alias("f"))
    return food.select("query", "f.id", "f.description", F.explode(F.slice("f.nutrients", 1, nutrients)).alias("n")).select("query", "id", "description", F.col("n.name").alias("nutrient"), "n.unit", "n.amount")


def write_manifest(runs: DataFrame, path: str) -> None:
    """Appends runs (agent, run_id, ts, payload); nothing written before is touched."""
    runs.write.mode("append").parquet(path)


def latest_manifest(runs: DataFrame, run_id: str | None = None) -> DataFrame:
    """agent, run_id, ts, payload: the latest run of each agent, of one run if given."""
    r = runs if run_id is None else runs.where(F.col("run_id") == run_id)
    return r.groupBy("agent").agg(F.max(F.struct("ts", "run_id", "payload")).alias("m")).select("agent", "m.run_id", "m.ts", "m.payload")


def previous_manifest(runs: DataFrame, cascade: list[str], current: str) -> DataFrame:
    """The latest run of the nearest agent before current in the cascade that has one."""
    before = cascade[: cascade.index(current)]
    latest = latest_manifest(runs.where(F.col("agent").isin(before)))
    return latest.withColumn("at", F.array_position(F.array(*map(F.lit, before or [""])), F.col("agent"))).orderBy(F.desc("at")).limit(1).drop("at")


def run_history(runs: DataFrame, k: int = 20) -> DataFrame:
    return runs.orderBy(F.desc("ts"), F.desc("run_id")).limit(k)


def extraction_prompts(papers: DataFrame) -> DataFrame:
    """pmcid, prompt: the vocabulary, the form of the answer and the text (pmcid, text)."""
    head = f"Entity types: {', '.join(vocab.ENTITY_TYPES)}\nPredicates: {', '.join(vocab.PREDICATES)}\nAnswer with a JSON array of objects with the fields {', '.join(c.split()[0] for c in CLAIM.split(', '))}.\nPaper "
    return papers.select("pmcid", F.concat(F.lit(head), "pmcid", F.lit(":\n"), "text").alias("prompt"))


def extract_with(papers: DataFrame, extractor: Callable[[Iterator], Iterator], schema: str = CLAIM) -> DataFrame:
    """Claims by the user's own extractor over Arrow batches of papers (pandas frames in, frames of schema out)."""
    return papers.mapInPandas(extractor, schema)


def audit_sample(claims: DataFrame, labels: DataFrame, k: int = 100) -> DataFrame:
    """verdict, n: of the first k claims, those with a context before others, how many have each label (source_id, verdict)."""
    order = [F.when(F.trim(F.coalesce("context", F.lit(""))) != "", 0).otherwise(1), "source_id", "subject", "predicate", "object", "context"]
    first = claims.orderBy(*order).limit(k)
    return first.join(labels.dropDuplicates(["source_id"]), "source_id", "left").groupBy(F.coalesce("verdict", F.lit("unclassified")).alias("verdict")).agg(F.count("*").alias("n"))


#: Fixed value: a line of an expansion log that sums a cycle up.
CYCLE_LINE = r"\[CYCLE\s+(\d+)\]\s+papers \+(\d+)\s+nodes \+(\d+)\s+rels \+(\d+)\s+total=(\d+) nodes / (\d+) rels"
CYCLE_FIELDS = ["cycle", "papers", "nodes_delta", "rels_delta", "total_nodes", "total_rels"]


def cycles(lines: DataFrame) -> DataFrame:
    """Log lines (pos, text) that sum a cycle up, as numbers, with the time at the line's start ('' if none)."""
    number = lambda i: F.regexp_extract("text", CYCLE_LINE, i).cast("long")
    time = F.regexp_extract("text", r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1)
    return lines.where(F.col("text").rlike(CYCLE_LINE)).select("pos", *[number(i + 1).alias(f) for i, f in enumerate(CYCLE_FIELDS)], time.alias("time"))


def cycle_log(lines: DataFrame, k: int = 20) -> DataFrame:
    """The last k cycles of a log."""
    return cycles(lines).orderBy(F.desc("pos")).limit(k)


def cycle_totals(lines: DataFrame) -> DataFrame:
    """What all cycles of a log added; zeros if there is none."""
    return cycles(lines).agg(F.count("*").alias("cycles"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("papers", "nodes_delta", "rels_delta")])
