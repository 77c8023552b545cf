"""Registered queries of entity repair, with their DuckDB twins: the graph in its claims' own spellings and labels.

Each entry is (operator applied to the projected tables, SQL after the projection's WITH list).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import graph
from .plans import fixtures

KEY = "src_label, src, rel, dst_label, dst, source_id"


def _graph(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of claims as they are spelt."""
    ends = claims.select(F.explode(F.array(F.struct(F.col("subject_type").alias("label"), F.col("subject").alias("name")), F.struct(F.col("object_type").alias("label"), F.col("object").alias("name")))).alias("e")).select("e.*").distinct()
    props = [F.lit(1).alias(c) if c == "evidence_strength" else F.col(c) for c in graph.EDGE_PROPS]
    edges = claims.where(F.trim("source_id") != "").select(F.col("subject_type").alias("src_label"), F.col("subject").alias("src"), F.col("predicate").alias("rel"), F.col("object_type").alias("dst_label"), F.col("object").alias("dst"), "source_id", *props)
    return ends.withColumn("display_name", F.col("name")), edges.dropDuplicates(graph.EDGE_KEY)


def _spelt(p) -> tuple[DataFrame, DataFrame]:
    return _graph(p.valid)


def _labelled(p) -> tuple[DataFrame, DataFrame]:
    """The graph of the raw claims under the types they give."""
    kind = lambda c: F.trim(c).alias(c)
    return _graph(p.raw.select(F.lower(F.trim("subject")).alias("subject"), kind("subject_type"), "predicate", F.lower(F.trim("object")).alias("object"), kind("object_type"), "context", "source_id", "source_type", "journal", "pub_date", "evidence_type"))


def _forms(p) -> DataFrame:
    """A vocabulary for some of the entities: names with a capital."""
    e = fixtures.entities(p.spark, p.sf_dir).where(F.substring("name", -1, 1).isin("1", "2"))
    return e.select(F.lower("name").alias("key"), F.concat(F.upper(F.substring("name", 1, 1)), F.expr("substring(name, 2)")).alias("canonical")).distinct()


def _groups(p) -> DataFrame:
    return graph.duplicate_groups(_spelt(p)[0], _forms(p))


SPELT = f"""spelt AS MATERIALIZED (SELECT subject_type AS label, subject AS name FROM valid UNION SELECT object_type, object FROM valid),
spelt_edges AS MATERIALIZED (SELECT DISTINCT subject_type AS src_label, subject AS src, predicate AS rel, object_type AS dst_label, object AS dst, source_id FROM valid WHERE trim(source_id) <> ''),
forms AS (SELECT lower(name) AS key, min(upper(name[1]) || name[2:]) AS form FROM ent WHERE right(name, 1) IN ('1', '2') GROUP BY 1),
dupes AS MATERIALIZED (SELECT label, key, n, list_sort(names) AS names, coalesce(form, mixed, first) AS canonical FROM (SELECT label, lower(name) AS key, count(*) AS n, list(name) AS names, min(name) FILTER (name <> lower(name) AND name <> upper(name)) AS mixed, min(name) AS first FROM spelt GROUP BY 1, 2 HAVING count(*) > 1) LEFT JOIN forms USING (key)),
mapping AS (SELECT label, name, canonical FROM (SELECT label, unnest(names) AS name, canonical FROM dupes) WHERE name <> canonical),
mapped AS MATERIALIZED (SELECT e.*, coalesce(a.canonical, src) AS new_src, coalesce(b.canonical, dst) AS new_dst FROM spelt_edges e LEFT JOIN mapping a ON a.label = src_label AND a.name = src LEFT JOIN mapping b ON b.label = dst_label AND b.name = dst)"""
IS_LOOP = "(src_label = dst_label AND new_src = new_dst AND src <> dst)"
ACTION = f"SELECT label, CASE WHEN kind IS NULL THEN 'delete' WHEN kind IN {fixtures._in(graph.ENTITY_TYPES)} THEN 'relabel' ELSE 'unmapped' END AS action, CASE WHEN kind IN {fixtures._in(graph.ENTITY_TYPES)} THEN kind END AS target FROM (SELECT label, {fixtures._type_sql('label')} AS kind FROM labels WHERE label NOT IN {fixtures._in(graph.ENTITY_TYPES)})"
LABELLED = f"""own AS MATERIALIZED (SELECT trim(subject_type) AS label, lower(trim(subject)) AS name FROM raw UNION SELECT trim(object_type), lower(trim(object)) FROM raw),
own_edges AS MATERIALIZED (SELECT DISTINCT trim(subject_type) AS src_label, lower(trim(subject)) AS src, predicate AS rel, trim(object_type) AS dst_label, lower(trim(object)) AS dst, source_id FROM raw WHERE trim(source_id) <> ''),
labels AS (SELECT DISTINCT label FROM own), actions AS MATERIALIZED ({ACTION})"""
AT_ENDS = "FROM own_edges LEFT JOIN actions a ON a.label = src_label LEFT JOIN actions b ON b.label = dst_label WHERE coalesce(a.action, '') <> 'delete' AND coalesce(b.action, '') <> 'delete'"

REPAIR: dict[str, tuple[Callable, str]] = {
    "duplicate_groups": (lambda p: _groups(p).select("label", "key", "n", "canonical"), f", {SPELT} SELECT label, key, n, canonical FROM dupes"),
    "resolve_entities": (lambda p: graph.resolve_entities(_spelt(p)[1], graph.duplicate_mapping(_groups(p))).select(*graph.EDGE_KEY), f", {SPELT} SELECT DISTINCT src_label, new_src AS src, rel, dst_label, new_dst AS dst, source_id FROM mapped WHERE NOT {IS_LOOP}"),
    "resolve_nodes": (lambda p: graph.resolve_nodes(_spelt(p)[0], graph.duplicate_mapping(_groups(p))).select("label", "name"), f", {SPELT} SELECT DISTINCT s.label, CASE WHEN d.key IS NULL THEN s.name ELSE d.canonical END AS name FROM spelt s LEFT JOIN dupes d ON d.label = s.label AND d.key = lower(s.name)"),
    "resolve_report": (
        lambda p: graph.resolve_report(_spelt(p)[1], _groups(p)),
        f", {SPELT} SELECT (SELECT count(*) FROM dupes) AS groups, (SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) FROM dupes) AS nodes_merged, CAST(coalesce(sum(CAST(new_src <> src AS INTEGER) + CAST(new_dst <> dst AS INTEGER)) FILTER (NOT {IS_LOOP}), 0) AS BIGINT) AS edges_moved, count(*) FILTER ({IS_LOOP}) AS loops_dropped FROM mapped",
    ),
    "relabel_nonstandard": (
        lambda p: graph.relabel_nonstandard(*_labelled(p))[2],
        f", {LABELLED}, ends_of AS (SELECT src_label AS label FROM own_edges UNION ALL SELECT dst_label FROM own_edges) SELECT label, action, target, (SELECT count(*) FROM own WHERE own.label = actions.label) AS nodes, (SELECT count(*) FROM ends_of WHERE ends_of.label = actions.label) AS edges FROM actions",
    ),
    "relabelled_nodes": (lambda p: graph.relabel_nonstandard(*_labelled(p))[0].select("label", "name"), f", {LABELLED} SELECT DISTINCT coalesce(target, own.label) AS label, name FROM own LEFT JOIN actions USING (label) WHERE coalesce(action, '') <> 'delete'"),
    "relabelled_edges": (lambda p: graph.relabel_nonstandard(*_labelled(p))[1].select(*graph.EDGE_KEY), f", {LABELLED} SELECT DISTINCT coalesce(a.target, src_label) AS src_label, src, rel, coalesce(b.target, dst_label) AS dst_label, dst, source_id {AT_ENDS}"),
}
