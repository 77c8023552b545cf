"""Graph build and repair on two tables: nodes(label, name, display_name) and edges keyed by EDGE_KEY."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.vocab import ENTITY_TYPES, canonical_type
from ..plans.shared import written

EDGE_KEY = ["src_label", "src", "rel", "dst_label", "dst", "source_id"]
EDGE_PROPS = ["pub_date", "context", "journal", "evidence_type", "evidence_strength", "source_type"]
NOISE_LABELS = ["Disease", "Symptom", "Food", "Nutrient", "Drug", "LifestyleFactor", "Biomarker", "Mechanism", "BodySystem"]


def build_nodes(valid: DataFrame) -> DataFrame:
    """Distinct (label, name) of both ends; the greatest spelling is shown."""
    ends = valid.select(F.explode(F.array(F.struct(F.col("subject_type").alias("label"), F.col("subject").alias("display_name")), F.struct(F.col("object_type").alias("label"), F.col("object").alias("display_name")))).alias("e")).select("e.*")
    return ends.where(F.trim("display_name") != "").groupBy("label", F.lower("display_name").alias("name")).agg(F.max("display_name").alias("display_name"))


def build_edges(valid: DataFrame) -> DataFrame:
    """One edge per key; of several claims the greatest by EDGE_PROPS stays, whatever the order of loading."""
    e = valid.where((F.trim("subject") != "") & (F.trim("object") != "") & (F.trim("source_id") != "")).select(
        F.col("subject_type").alias("src_label"), F.lower("subject").alias("src"), F.col("predicate").alias("rel"), F.col("object_type").alias("dst_label"), F.lower("object").alias("dst"), "source_id",
        *[F.coalesce("evidence_strength", F.lit(1)).alias(c) if c == "evidence_strength" else F.col(c) for c in EDGE_PROPS],
    )
    return _latest(e)


def _latest(edges: DataFrame) -> DataFrame:
    return edges.groupBy(*EDGE_KEY).agg(F.max(F.struct(*EDGE_PROPS)).alias("p")).select(*EDGE_KEY, "p.*")


def upsert_edges(table: DataFrame, batch: DataFrame) -> DataFrame:
    """table with batch merged in: new keys are added, known keys take the batch's properties.  Doing it twice changes nothing."""
    new = _latest(batch)
    return table.join(new.select(*EDGE_KEY), EDGE_KEY, "left_anti").unionByName(new, allowMissingColumns=True)


def skipped_without_source(claims: DataFrame) -> DataFrame:
    return claims.agg(F.count_if(F.trim(F.coalesce("source_id", F.lit(""))) == "").alias("skipped"))


def duplicate_groups(spellings: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """label, key, names, n, canonical: spellings (label, name) of one label that differ in case alone, with the one to keep.

    The vocabulary's form (names: key, canonical) comes first, be it a spelling or not; then the first spelling of mixed case, then
    the first of all.
    """
    mixed = F.filter("names", lambda n: (n != F.lower(n)) & (n != F.upper(n)))
    g = spellings.select("label", "name").distinct().groupBy("label", F.lower("name").alias("key")).agg(F.sort_array(F.collect_list("name")).alias("names"), F.count("*").alias("n")).where(F.col("n") > 1)
    if names is None:
        return g.withColumn("canonical", F.coalesce(F.array_min(mixed), F.array_min("names")))
    forms = names.groupBy("key").agg(F.min("canonical").alias("form"))
    return g.join(forms, F.trim(g["key"]) == forms["key"], "left").select(g["label"], g["key"], "names", "n", F.coalesce("form", F.array_min(mixed), F.array_min("names")).alias("canonical"))


def duplicate_mapping(groups: DataFrame) -> DataFrame:
    """label, name, canonical of every spelling that is not the one to keep."""
    return groups.select("label", F.explode("names").alias("name"), "canonical").where(F.col("name") != F.col("canonical"))


#: Hops of a chain of mappings that are followed: 2 to this power.
DOUBLINGS = 20


def closed_mapping(mapping: DataFrame) -> DataFrame:
    """mapping(label, name, canonical) with chains followed to their end; names in a circle keep themselves.

    Every round doubles the hops, so a chain of length n takes log n joins; each round is written to the shared folder.
    """
    own = mapping.where(F.col("name") != F.col("canonical")).groupBy("label", "name").agg(F.min("canonical").alias("canonical"))
    for _ in range(DOUBLINGS):
        own = written(own, "mapping")
        onward = own.select("label", F.col("name").alias("canonical"), F.col("canonical").alias("further"))
        if own.join(onward, ["label", "canonical"], "left_semi").isEmpty():
            return own
        own = own.join(onward, ["label", "canonical"], "left").select("label", "name", F.coalesce("further", "canonical").alias("canonical"))
    return own.join(onward.select("label", "canonical"), ["label", "canonical"], "left_anti")


def _mapped(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """edges with new_src and new_dst."""
    for side in ("src", "dst"):
        m = mapping.select(F.col("label").alias(f"{side}_label"), F.col("name").alias(side), F.col("canonical").alias(f"new_{side}"))
        edges = edges.join(m, [f"{side}_label", side], "left").withColumn(f"new_{side}", F.coalesce(f"new_{side}", side))
    return edges


#: An edge between two spellings of one entity.
LOOP = (lambda: (F.col("src_label") == F.col("dst_label")) & (F.col("new_src") == F.col("new_dst")) & (F.col("src") != F.col("dst")))


def resolve_entities(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """edges rewired by mapping(label, name, canonical); loops between spellings of one entity go, keys stay unique."""
    moved = _mapped(edges, mapping).where(~LOOP())
    return _latest(moved.withColumns({"src": F.col("new_src"), "dst": F.col("new_dst")}).drop("new_src", "new_dst"))


def resolve_nodes(nodes: DataFrame, mapping: DataFrame) -> DataFrame:
    """nodes with the mapped ones merged into the node to keep, which takes that name."""
    named = nodes.join(mapping.select("label", "name", "canonical"), ["label", "name"], "left").withColumn("name", F.coalesce("canonical", "name"))
    return named.groupBy("label", "name").agg(F.max("display_name").alias("display_name"))


def resolve_report(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """groups, nodes_merged, edges_moved (ends that got another node), loops_dropped: one row."""
    of_groups = groups.agg(F.count("*").alias("groups"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("nodes_merged"))
    moved = (F.col("new_src") != F.col("src")).cast("int") + (F.col("new_dst") != F.col("dst")).cast("int")
    of_edges = _mapped(edges, duplicate_mapping(groups)).agg(F.coalesce(F.sum(F.when(~LOOP(), moved)), F.lit(0)).alias("edges_moved"), F.count_if(LOOP()).alias("loops_dropped"))
    return of_groups.crossJoin(of_edges)  # one row each


def label_actions(labels: DataFrame, standard: list[str] = ENTITY_TYPES) -> DataFrame:
    """label, action, target of every label outside the vocabulary: relabel where it is an alias, delete where its kind is rejected, else unmapped."""
    kind = canonical_type(F.col("label"))
    odd = labels.where(~F.col("label").isin(standard)).select("label", kind.alias("kind")).distinct()
    known = F.col("kind").isin(standard)
    return odd.select("label", F.when(F.col("kind").isNull(), "delete").when(known, "relabel").otherwise("unmapped").alias("action"), F.when(known, F.col("kind")).alias("target"))


def _at_ends(edges: DataFrame, actions: DataFrame) -> DataFrame:
    for side in ("src", "dst"):
        edges = edges.join(actions.select(F.col("label").alias(f"{side}_label"), F.col("action").alias(f"{side}_action"), F.col("target").alias(f"{side}_target")), f"{side}_label", "left")
    return edges


def relabel_nonstandard(nodes: DataFrame, edges: DataFrame, standard: list[str] = ENTITY_TYPES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes and edges with labels brought into the vocabulary, and a report (label, action, target, nodes, edges).

    Aliases take their label, and nodes and edges that become equal are merged.  Rejected kinds go with their edges.  Labels
    without a rule stay.  The report counts nodes and ends of edges under each label.
    """
    actions = label_actions(nodes.select("label").union(endpoints(edges).select("label")), standard)
    own = nodes.join(actions, "label", "left").where(F.coalesce("action", F.lit("")) != "delete").withColumn("label", F.coalesce("target", "label"))
    kept = own.groupBy("label", "name").agg(F.max("display_name").alias("display_name"))
    gone = lambda side: F.coalesce(F.col(f"{side}_action"), F.lit("")) == "delete"
    moved = _at_ends(edges, actions).where(~gone("src") & ~gone("dst")).withColumns({f"{s}_label": F.coalesce(f"{s}_target", f"{s}_label") for s in ("src", "dst")})
    n_nodes, n_ends = nodes.groupBy("label").agg(F.count("*").alias("nodes")), endpoints(edges).groupBy("label").agg(F.count("*").alias("edges"))
    report = actions.join(n_nodes, "label", "left").join(n_ends, "label", "left").fillna(0, ["nodes", "edges"])
    return kept, _latest(moved.select(*EDGE_KEY, *EDGE_PROPS)), report


def endpoints(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array(F.struct(F.col("src_label").alias("label"), F.col("src").alias("name")), F.struct(F.col("dst_label").alias("label"), F.col("dst").alias("name")))).alias("e")).select("e.*")


def orphan_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges), ["label", "name"], "left_anti")


def drop_orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.join(endpoints(edges), ["label", "name"], "left_semi")


def noise_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where(F.col("label").isin(NOISE_LABELS) & ((F.length("name") <= 1) | F.col("name").rlike(r"^[0-9]+$") | F.col("name").rlike(r"^[(\[\-]")))


def drop_noise_nodes(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    bad = noise_nodes(nodes).select("label", "name")
    for side in ("src", "dst"):
        edges = edges.join(bad.select(F.col("label").alias(f"{side}_label"), F.col("name").alias(side)), [f"{side}_label", side], "left_anti")
    return nodes.join(bad, ["label", "name"], "left_anti"), edges


def neighborhood(edges: DataFrame, starts: DataFrame, hops: int = 1, limit: int = 80) -> DataFrame:
    """Undirected edges around each start (label, name) up to hops away, one per (pair, rel), the first `limit` per start by hop, x, rel, y.

    A node hands on only its first hops * limit edges, and only starts that still lack edges go a hop
    further: the first `limit` of a start are among those, whatever the degree of a hub.
    """
    links = edges.select(F.least("src", "dst").alias("x"), "rel", F.greatest("src", "dst").alias("y")).distinct()
    both = links.select(F.explode(F.array_distinct(F.array("x", "y"))).alias("a"), "x", "rel", "y")
    first = Window.partitionBy("a").orderBy("x", "rel", "y")
    own = both.withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= hops * limit).drop("rn")
    around = Window.partitionBy("start").orderBy("hop", "x", "rel", "y")
    best = lambda df: df.groupBy("start", "x", "rel", "y").agg(F.min("hop").alias("hop")).withColumn("rn", F.row_number().over(around)).where(F.col("rn") <= limit)
    reach = starts.select(F.col("name").alias("start"), F.col("name").alias("a")).distinct()
    found = None
    for hop in range(1, hops + 1):
        step = reach.join(own, "a").select("start", F.lit(hop).alias("hop"), "x", "rel", "y")
        found = best(step if found is None else found.unionByName(step)).drop("rn")
        if hop < hops:
            open_ = found.groupBy("start").agg(F.count("*").alias("n")).where(F.col("n") < limit).select("start")
            ends = found.where(F.col("hop") == hop).select("start", F.explode(F.array("x", "y")).alias("a"))
            reach = ends.join(open_, "start", "left_semi").distinct()
    return found


def neighborhood_nodes(found: DataFrame, nodes: DataFrame) -> DataFrame:
    """start, label, name, display_name: the nodes at the ends of neighborhood()'s edges, each once per start."""
    ends = found.select("start", F.explode(F.array("x", "y")).alias("name")).distinct()
    return ends.join(nodes.select("label", "name", "display_name"), "name").select("start", "label", "name", "display_name")


def visible_subgraph(nodes: DataFrame, edges: DataFrame, labels: list[str], rels: list[str]) -> DataFrame:
    """Edges of the shown types with both ends shown."""
    seen = nodes.where(F.col("label").isin(labels)).select("label", "name")
    for side in ("src", "dst"):
        edges = edges.join(seen.select(F.col("label").alias(f"{side}_label"), F.col("name").alias(side)), [f"{side}_label", side], "left_semi")
    return edges.where(F.col("rel").isin(rels))
