"""The registered queries of the evidence-graph operators and their DuckDB twins.

Each entry is (operator applied to the projected tables, SQL with the same rows).  SQL text starts
from the projection's WITH list; ``$users`` adds the users.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog_care import care_queries
from .catalog_papers import GRAPH_PAPERS, PAPERS
from .catalog_people import PEOPLE
from .catalog_repair import REPAIR
from .functions import vocab
from .operators import audit, claims, graph, planning, recommend, risk, users
from .plans import fixtures
from .plans.shared import files_of, written_once
from .sources import papers


class Projection:
    """The tables of one folder as claims, graph and users.

    Validated claims, nodes and edges are written once per folder and application; all else is a lazy plan.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def stamp(self) -> str:
        return files_of(self.spark, self.sf_dir)

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return written_once(self.spark, f"{name} {self.sf_dir}", self.stamp, build)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def raw(self) -> DataFrame:
        return fixtures.raw_claims(self.spark, self.sf_dir)

    @cached_property
    def names(self) -> DataFrame:
        return fixtures.names(self.spark, self.sf_dir)

    @cached_property
    def normalized(self) -> DataFrame:
        """Written by itself: validation reads each of its columns several times."""
        return self.once("normalized", lambda: claims.normalize_claims(self.raw, self.names))

    @cached_property
    def validated(self) -> DataFrame:
        return self.once("validated", lambda: claims.validate(self.normalized))

    @cached_property
    def valid(self) -> DataFrame:
        return claims.valid_claims(self.validated)

    @cached_property
    def edges(self) -> DataFrame:
        return self.once("edges", lambda: graph.build_edges(self.valid))

    @cached_property
    def flagged(self) -> DataFrame:
        """Edges with the marks of contradictions."""
        return audit.flag_contested(self.edges, audit.contradiction_verdicts(self.edges))

    @cached_property
    def loose_edges(self) -> DataFrame:
        """Edges of all claims, those of weak predicates too."""
        return graph.build_edges(self.validated)

    @cached_property
    def listed(self) -> DataFrame:
        """The nodes, and places that no edge reaches, some of them under labels of their own."""
        places = lambda t, c, label: self.table(t).select(F.lit(label).alias("label"), F.lower(c).alias("name"), F.col(c).alias("display_name"))
        return self.nodes.unionByName(places("nation", "n_name", "PopulationGroup")).unionByName(places("region", "r_name", "Region")).unionByName(places("supplier", "s_name", "Food"))

    @cached_property
    def wishes(self) -> DataFrame:
        """Demand for the entity that an event's number picks."""
        parts = fixtures.entities(self.spark, self.sf_dir).select("p_partkey", F.lower("name").alias("entity"))
        return self.table("events").join(parts, F.col("event_id") == F.col("p_partkey")).select("entity", F.col("event_type").alias("kind"), "ts")

    @cached_property
    def nodes(self) -> DataFrame:
        return self.once("nodes", lambda: graph.build_nodes(self.valid))

    @cached_property
    def users(self) -> DataFrame:
        return fixtures.users(self.spark, self.sf_dir)

    @cached_property
    def profiles(self) -> DataFrame:
        """Risk profiles of the diseases: a colour and an age as factors, the disease itself as trigger, one route."""
        d = self.nodes.where("label = 'Disease'")
        kinds = [("factor", F.split("name", " ")[0]), ("factor", F.concat(F.lit("age "), (30 + 10 * (F.length("name") % 5)).cast("string"), F.lit("+"))), ("trigger", F.col("name")), ("route", F.lit("walking"))]
        return d.select(F.col("name").alias("disease"), F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), f.alias("factor")) for k, f in kinds])))

    @cached_property
    def board(self) -> DataFrame:
        return risk.risk_board(self.profiles, self.users, self.names)

    @cached_property
    def insights(self) -> DataFrame:
        return risk.insights(self.edges, self.users)

    @cached_property
    def checks(self) -> DataFrame:
        """A check per early signal of a disease."""
        e = self.edges.where("rel = 'EARLY_SIGNAL_OF' AND src_label = 'Symptom' AND dst_label = 'Disease'").select(F.col("dst").alias("disease"), F.col("src").alias("check_id")).distinct()
        return e.withColumn("pos", F.length("check_id"))

    @cached_property
    def manifests(self) -> DataFrame:
        return self.table("events").select(F.col("event_type").alias("agent"), F.col("event_id").alias("run_id"), "ts", F.col("props").alias("payload"))

    @cached_property
    def papers(self) -> DataFrame:
        return self.table("documents").select(F.concat(F.lit("PMC"), F.col("doc_id").cast("string")).alias("pmcid"), F.col("source").alias("journal"), F.col("text").alias("abstract"))

    @cached_property
    def demand(self) -> DataFrame:
        return self.table("events").select(F.concat(F.lit("e"), (F.col("user_id") % 25).cast("string")).alias("entity"), F.col("event_type").alias("kind"), "ts")

    @cached_property
    def daily(self) -> DataFrame:
        """A report per day."""
        return self.table("orders").groupBy(F.col("o_orderdate").cast("date").alias("ts")).agg(F.count("*").alias("orders"))

    @cached_property
    def log_lines(self) -> DataFrame:
        """An order as a line of an expansion log; pending ones are lines of another kind."""
        line = F.concat(F.lit("1999-01-01 00:00:00 [CYCLE "), F.col("o_orderkey"), F.lit("]  papers +"), F.col("o_custkey"), F.lit(" nodes +"), F.length("o_orderpriority"), F.lit("  rels +"), F.length("o_orderstatus"), F.lit(" total="), F.col("o_custkey"), F.lit(" nodes / "), F.col("o_orderkey"), F.lit(" rels"))
        return self.table("orders").select(F.col("o_orderkey").alias("pos"), F.when(F.col("o_orderstatus") == "P", "1999-01-01 [START]").otherwise(line).alias("text"))

    @cached_property
    def asked(self) -> DataFrame:
        """Colours, kinds and a goal as terms, each for every field."""
        words = self.table("part").select(F.explode(F.array_append(F.split("p_name", " "), F.lit("weight m"))).alias("term")).distinct()
        return words.select("term", F.explode(F.array(*[F.lit(f) for f in users.FIELD_LABELS])).alias("field"))

    @cached_property
    def shown(self) -> DataFrame:
        return self.nodes.select("label", F.col("display_name").alias("name"))

    @cached_property
    def snapshots(self) -> DataFrame:
        return self.table("events").select("user_id", "ts", F.col("event_id").alias("id"), F.when(F.col("event_id") % 31 > 0, 80.0 + (F.col("user_id") * 7 + F.col("event_id")) % 760).alias("x"), F.when(F.col("event_id") % 29 > 0, F.least(F.lit(455.0), 50 + 3 * F.col("value"))).alias("y"))

    @cached_property
    def runs(self) -> DataFrame:
        lines = self.table("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("returned"), F.count_if(F.col("l_linenumber") == 1).alias("fresh"), F.count_if(F.col("l_returnflag") == "R").alias("claims"))
        return self.table("orders").join(lines, F.col("o_orderkey") == F.col("k")).select(F.col("o_orderpriority").alias("label"), "returned", "fresh", "claims")


POS, NEG = ", ".join(f"'{p}'" for p in audit.POS), ", ".join(f"'{p}'" for p in audit.NEG)
NEG_RISK = ", ".join(f"'{p}'" for p in audit.NEG_RISK)
TYPES = ", ".join(f"'{t}'" for t in vocab.ENTITY_TYPES)
WEAK = ", ".join(f"'{t}'" for t in vocab.WEAK_PREDICATES)
ENDS = "(SELECT src_label AS label, src AS name FROM edges UNION ALL SELECT dst_label, dst FROM edges)"
PAIRS = "(VALUES " + ", ".join(f"('{p}/{n}', '{p}', '{n}')" for p, n in audit.OPPOSING) + ") AS pairs(pair, p, n)"
AUDIT_PAIRS = "(VALUES " + ", ".join(f"('{p}/{n}', '{p}', '{n}')" for p, n in audit.AUDIT_OPPOSING) + ") AS pairs(pair, p, n)"
SAME_ENDS = "a.src_label = b.src_label AND a.src = b.src AND a.dst_label = b.dst_label AND a.dst = b.dst"
#: A join by equality per pair of predicates.
OPPOSED = " UNION ALL ".join(f"SELECT '{p}/{n}' AS pair, a.src_label, a.src, a.dst_label, a.dst, a.source_id AS pos_source, a.evidence_strength AS pos_strength, b.source_id AS neg_source, b.evidence_strength AS neg_strength FROM (SELECT * FROM edges WHERE rel = '{p}') a JOIN (SELECT * FROM edges WHERE rel = '{n}') b ON {SAME_ENDS}" for p, n in audit.OPPOSING)
DECADE = "CASE WHEN age < 40 THEN '30s' WHEN age < 50 THEN '40s' WHEN age < 60 THEN '50s' ELSE '60s+' END"
GENDER = "CASE WHEN lower(gender) IN ('female', 'f', 'woman') THEN 'female' WHEN lower(gender) IN ('male', 'm', 'man') THEN 'male' ELSE 'any' END"
PROFILES = "(VALUES " + ", ".join(f"('{d}', '{g}', '{v}')" for (d, g), v in recommend.PROFILES.items()) + ") AS pr(d, g, conditions)"
BARE = f"SELECT u.user_id, u.plan, coalesce(pr.conditions, '{recommend.PROFILES['default', 'any']}') AS conditions FROM users u LEFT JOIN {PROFILES} ON pr.d = {DECADE} AND pr.g = {GENDER} WHERE u.term IS NULL"
TARGETS = f"targets AS (SELECT DISTINCT user_id, plan, lower(term) AS target, false AS from_profile FROM users WHERE term IS NOT NULL UNION ALL SELECT DISTINCT user_id, plan, unnest(string_split(lower(conditions), ', ')), true FROM ({BARE}))"
LAYERS = f"""direct AS (SELECT src AS item, rel, dst AS target, CAST(NULL AS VARCHAR) AS via, source_id, evidence_strength AS strength FROM edges WHERE rel IN ({POS}) AND src_label IN ('Food', 'Nutrient') AND dst_label IN ('Disease', 'Symptom')),
holds AS (SELECT DISTINCT src AS item, dst AS via FROM edges WHERE rel = 'CONTAINS' AND src_label = 'Food' AND dst_label = 'Nutrient'),
via_nutrient AS (SELECT h.item, e.rel, e.dst AS target, h.via, e.source_id, e.evidence_strength AS strength FROM holds h JOIN edges e ON e.src = h.via WHERE e.src_label = 'Nutrient' AND e.rel IN ({POS}) AND e.dst_label IN ('Disease', 'Symptom')),
signals AS (SELECT DISTINCT src AS symptom, dst AS target FROM edges WHERE rel = 'EARLY_SIGNAL_OF' AND src_label = 'Symptom'),
via_symptom AS (SELECT e.src AS item, e.rel, s.target, CAST(NULL AS VARCHAR) AS via, e.source_id, e.evidence_strength AS strength FROM edges e JOIN signals s ON s.symptom = e.dst WHERE e.src_label IN ('Food', 'Nutrient') AND e.dst_label = 'Symptom' AND e.rel IN ('ALLEVIATES', 'PREVENTS'))"""
REASON = "CASE WHEN via IS NOT NULL THEN 'Contains ' || via || ' which ' || lower(replace(rel, '_', ' ')) || ' ' || target ELSE 'Associated with ' || lower(replace(rel, '_', ' ')) || ' of ' || target END"
ZONE = "CASE " + " ".join(f"WHEN y < {b} THEN '{z}'" for b, z in users.ZONES) + f" ELSE '{users.LAST_ZONE}' END"
SNAPSHOTS = "WITH every AS (SELECT user_id, ts, event_id AS id, CASE WHEN event_id % 31 > 0 THEN 80.0 + (user_id * 7 + event_id) % 760 END AS x, CASE WHEN event_id % 29 > 0 THEN least(455.0, 50 + 3 * value) END AS y FROM events), snaps AS (SELECT * FROM every WHERE y IS NOT NULL)"
VERDICTS = f"""pos AS (SELECT src_label, src, dst, rel AS pos_rel, count(*) AS pos_count, avg(evidence_strength) AS pos_strength FROM edges WHERE dst_label = 'Disease' AND rel IN ({POS}) AND src_label IN ('Food', 'Nutrient', 'LifestyleFactor') GROUP BY ALL),
neg AS (SELECT src_label, src, dst, rel AS neg_rel, count(*) AS neg_count, avg(evidence_strength) AS neg_strength FROM edges WHERE dst_label = 'Disease' AND rel IN ({NEG_RISK}) GROUP BY ALL),
verdicts AS (SELECT src_label, src AS entity, dst AS disease, pos_rel, pos_count, pos_strength, neg_rel, neg_count, neg_strength,
  CASE WHEN pos_count >= 2 * neg_count AND pos_strength >= neg_strength THEN 'negative_contested' WHEN neg_count >= 2 * pos_count AND neg_strength >= pos_strength THEN 'positive_contested' ELSE 'debated' END AS verdict
  FROM pos JOIN neg USING (src_label, src, dst))"""


def _gap_sql(name: str) -> str:
    label, side, rels, others, linked = audit.GAP_RULES[name]
    other = "src" if side == "dst" else "dst"
    own = f"SELECT name FROM nodes WHERE label = '{label}'" + (" AND length(name) > 2 AND name NOT LIKE 't2d%'" if name == "nutrient_no_food" else "") + (f" AND name IN (SELECT name FROM {ENDS} WHERE label = '{label}')" if linked else "")
    kinds = f" AND {other}_label IN ({', '.join(repr(o) for o in others)})" if others else ""
    return f"SELECT '{name}' AS gap_type, name AS entity FROM ({own}) WHERE name NOT IN (SELECT {side} FROM edges WHERE {side}_label = '{label}' AND rel IN ({', '.join(repr(r) for r in rels)}){kinds})"


FEW = f"SELECT 'few_recommendations' AS gap_type, d.name AS entity, count(e.dst) AS n FROM (SELECT name FROM nodes WHERE label = 'Disease') d LEFT JOIN (SELECT dst FROM edges WHERE dst_label = 'Disease' AND rel IN ({POS}) AND src_label IN ('Food', 'Nutrient')) e ON e.dst = d.name GROUP BY d.name HAVING count(e.dst) < 3"
LISTED = "listed AS (SELECT * FROM nodes UNION ALL SELECT 'PopulationGroup', lower(n_name), n_name FROM nation UNION ALL SELECT 'Region', lower(r_name), r_name FROM region UNION ALL SELECT 'Food', lower(s_name), s_name FROM supplier)"
ALL_GAPS = f"SELECT gap_type, entity, n FROM ({FEW}) UNION ALL " + " UNION ALL ".join(f"SELECT *, NULL FROM ({_gap_sql(g)})" for g in audit.GAP_RULES)

def _gap_queries_sql() -> str:
    """The templates as one CASE per column."""
    quoted = lambda v: "'" + v.replace("'", "''") + "'"
    listed = {"nutrition": ["Nutrients", "Appetite"], "food": ["Food Chemistry"]}
    rank, query, hint = [], [], []
    for kind, (priority, rises, mesh, terms, group, humans, said) in audit.GAP_TEMPLATES.items():
        base = f"CASE WHEN first THEN 1 ELSE {priority} END" if kind == "no_avoidance" else str(priority)
        rank.append(f"WHEN '{kind}' THEN " + (f"CASE WHEN wanted THEN 0 ELSE {base} END" if rises else base))
        mesh_sql = """ || ' OR "' || entity || '"[MeSH Terms]'""" if mesh else ""
        rest = [*terms, *([audit.journal_clause(listed[group])] if group in listed else []), '("2022/01/01"[Date - Publication] : "2023/12/31"[Date - Publication])', "open access[filter]", *(['"humans"[MeSH Terms]'] if humans else [])]
        query.append(f"""WHEN '{kind}' THEN '("' || entity || '"[Title/Abstract]'{mesh_sql} || {quoted(") AND " + " AND ".join(rest))}""")
        parts = said.split("{}")
        text = quoted(parts[0]) + "".join(f" || {c} || {quoted(x)}" for x, c in zip(parts[1:], ("entity", "n"), strict=False))
        hint.append(f"WHEN '{kind}' THEN {text}" + (" || CASE WHEN wanted THEN ' [HIGH DEMAND]' ELSE '' END" if rises else ""))
    first = " OR ".join(f"(gap_type = '{k}' AND lower(entity) IN ({', '.join(map(quoted, v))}))" for k, v in audit.FIRST_ENTITIES.items())
    case = lambda rows: "CASE gap_type " + " ".join(rows) + " END"
    return f""", wishes AS (SELECT lower(e.name) AS entity, count(*) AS n FROM events JOIN ent e ON e.p_partkey = event_id GROUP BY 1 ORDER BY n DESC, entity LIMIT 200)
SELECT gap_type, entity, {case(rank)} AS priority, {case(query)} AS query, {case(hint)} AS hint FROM (SELECT *, row_number() OVER (PARTITION BY gap_type ORDER BY wanted DESC, first DESC, coalesce(n, 0), entity) AS rn FROM (SELECT gap_type, entity, n, entity IN (SELECT entity FROM wishes) AS wanted, {first} AS first FROM ({ALL_GAPS}))) WHERE rn <= 5"""


GAP_QUERIES = _gap_queries_sql()

PROF = """prof AS (SELECT name AS disease, 'factor' AS kind, split_part(name, ' ', 1) AS factor FROM nodes WHERE label = 'Disease' UNION ALL SELECT name, 'factor', 'age ' || CAST(30 + 10 * (length(name) % 5) AS VARCHAR) || '+' FROM nodes WHERE label = 'Disease'
  UNION ALL SELECT name, 'trigger', name FROM nodes WHERE label = 'Disease' UNION ALL SELECT name, 'route', 'walking' FROM nodes WHERE label = 'Disease')"""
MATCHES = """formed AS (SELECT DISTINCT u.user_id, u.age, lower(coalesce(n.canonical, u.term)) AS form FROM users u LEFT JOIN names n ON n.key = lower(u.term)),
pforms AS (SELECT p.*, lower(coalesce(n.canonical, p.factor)) AS form FROM prof p LEFT JOIN names n ON n.key = lower(p.factor)),
hits AS (SELECT DISTINCT u.user_id, p.disease, p.factor FROM formed u JOIN pforms p ON p.kind = 'factor' AND (contains(u.form, p.factor) OR u.form = p.form OR (p.factor LIKE 'age %' AND u.age >= CAST(regexp_replace(p.factor, '[^0-9]', '', 'g') AS INTEGER))))"""
BOARD = """fired AS (SELECT DISTINCT u.user_id, p.disease FROM formed u JOIN pforms p ON p.kind = 'trigger' AND p.form = u.form),
board AS (SELECT user_id, disease, CASE WHEN f.user_id IS NOT NULL OR n >= 3 THEN 'high' WHEN n = 2 THEN 'medium' ELSE 'low' END AS level, coalesce(n, 0) AS present, t.total - coalesce(n, 0) AS missing
  FROM (SELECT user_id, disease, count(*) AS n FROM hits GROUP BY ALL) h FULL JOIN fired f USING (user_id, disease) JOIN (SELECT disease, count(*) AS total FROM prof WHERE kind = 'factor' GROUP BY 1) t USING (disease))"""


def _insight_sql(kind: str, where: str, target: str, item: str, order: str, k: int) -> str:
    view = f"SELECT {target} AS target, {item} AS item, count(*) AS n, max(evidence_strength) AS strength FROM edges WHERE {where} GROUP BY ALL"
    return f"SELECT user_id, '{kind}' AS kind, target, item, n, CAST(rank AS INTEGER) AS rank FROM (SELECT t.user_id, v.*, row_number() OVER (PARTITION BY t.user_id ORDER BY {order}) AS rank FROM targets t JOIN ({view}) v ON v.target = t.target) WHERE rank <= {k}"


_ITEM = "src_label IN ('Food', 'Nutrient') AND dst_label = 'Disease'"
INSIGHTS = "ins AS (" + " UNION ALL ".join([
    _insight_sql("protective", f"{_ITEM} AND rel IN ({POS})", "dst", "src", "v.strength DESC, v.n DESC, v.item, v.target", 5), _insight_sql("avoidance", f"{_ITEM} AND rel IN ({NEG})", "dst", "src", "v.n DESC, v.item, v.target", 3),
    _insight_sql("signal", "src_label = 'Symptom' AND dst_label = 'Disease' AND rel = 'EARLY_SIGNAL_OF'", "src", "dst", "v.n DESC, v.item, v.target", 5),
]) + ")"
_quoted = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
RULES = "(VALUES " + ", ".join("(" + ", ".join(map(_quoted, r)) + ")" for r in risk.LIKELY) + ") AS r(pos, min_age, needs, name)"
INFERRED = f"""inferred AS (SELECT user_id, name, CAST(rn AS INTEGER) AS rank FROM (SELECT user_id, name, row_number() OVER (PARTITION BY user_id ORDER BY g, pos, name) AS rn FROM (
  SELECT user_id, name, g, pos, row_number() OVER (PARTITION BY user_id, name ORDER BY g, pos) AS first FROM (SELECT user_id, item AS name, 0 AS g, rank AS pos FROM ins WHERE kind = 'signal'
    UNION ALL SELECT u.user_id, r.name, 1, r.pos FROM users u JOIN {RULES} ON u.age >= r.min_age OR u.term = r.needs))
  WHERE first = 1 AND (user_id, name) NOT IN (SELECT (user_id, term) FROM users WHERE term IS NOT NULL)) WHERE rn <= 4)"""
ENRICHED = f"""seen AS (SELECT dst AS disease, kind, factor, count(*) AS n FROM (SELECT dst, CASE WHEN src_label = 'Disease' AND rel IN ('INCREASES_RISK_OF', 'CAUSES') THEN 'factor' WHEN src_label = 'Symptom' AND rel = 'EARLY_SIGNAL_OF' THEN 'warning'
    WHEN src_label IN ('Food', 'Nutrient', 'LifestyleFactor') AND rel IN ({POS}) THEN 'route' END AS kind, CASE WHEN src_label IN ('Food', 'Nutrient', 'LifestyleFactor') THEN src || ' ' || lower(replace(rel, '_', ' ')) ELSE src END AS factor FROM edges WHERE dst_label = 'Disease') WHERE kind IS NOT NULL GROUP BY ALL),
tops AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY disease, kind ORDER BY n DESC, factor) AS rank FROM seen) WHERE rank <= 10),
several AS (SELECT disease, kind FROM tops WHERE kind = 'route' AND rank = 2)
SELECT disease, kind, factor FROM prof WHERE (disease, kind) NOT IN (SELECT (disease, kind) FROM several)
UNION ALL SELECT disease, kind, factor FROM tops WHERE (disease, kind) IN (SELECT (disease, kind) FROM several) OR (disease, kind, lower(factor)) NOT IN (SELECT (disease, kind, lower(factor)) FROM prof)"""
REGIONS = "CASE " + " ".join(f"WHEN regexp_matches(t, '{w}') THEN '{n}'" for n, w in risk.TERRITORIES) + " ELSE '' END"
SCORE = "CAST(greatest(0, least(100, round(100 - (y - 50) / 405 * 100))) AS INTEGER)"

NEAR = """, links AS (SELECT DISTINCT least(src, dst) AS x, rel, greatest(src, dst) AS y FROM edges), ends2 AS (SELECT x AS a, x, rel, y FROM links UNION ALL SELECT y, x, rel, y FROM links WHERE x <> y),
hop1 AS (SELECT s.name AS start, e.x, e.rel, e.y FROM (SELECT DISTINCT name FROM nodes s) s JOIN ends2 e ON e.a = s.name),
reach AS (SELECT DISTINCT start, a FROM (SELECT start, x AS a FROM hop1 UNION ALL SELECT start, y FROM hop1) WHERE a <> start),
near AS (SELECT start, x, rel, y, hop FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hop, x, rel, y) AS rn FROM (SELECT start, x, rel, y, CAST(min(hop) AS INTEGER) AS hop FROM (SELECT *, 1 AS hop FROM hop1 UNION ALL SELECT r.start, e.x, e.rel, e.y, 2 FROM reach r JOIN ends2 e ON e.a = r.a) WHERE hop <= 2 GROUP BY start, x, rel, y)) WHERE rn <= 80)"""

ASKED = ", asked AS (SELECT DISTINCT lower(trim(term)) AS term, field FROM (SELECT unnest(list_append(string_split(p_name, ' '), 'weight m')) AS term FROM part), (VALUES " + ", ".join(f"('{f}')" for f in users.FIELD_LABELS) + ") AS f(field))"
SHOWN = f"""named AS (SELECT DISTINCT f.field, n.name, lower(CASE WHEN f.field = 'goals' THEN replace(n.name, '_', ' ') ELSE n.name END) AS key
  FROM (SELECT label, display_name AS name FROM nodes UNION ALL SELECT 'Goal', unnest([{", ".join(f"'{g}'" for g in users.GOALS)}])) n JOIN (VALUES {", ".join(f"('{f}', '{k}')" for f, k in users.FIELD_LABELS.items())}) AS f(field, label) USING (label)),
own_nodes AS (SELECT t.term, t.field, n.name, CAST(row_number() OVER (PARTITION BY t.term, t.field ORDER BY length(n.name), n.name) AS INTEGER) AS rank FROM asked t JOIN named n ON n.field = t.field AND contains(n.key, t.term))"""
LOGGED = "o_orderkey AS pos, o_orderkey AS cycle, o_custkey AS papers, CAST(length(o_orderpriority) AS BIGINT) AS nodes_delta, CAST(length(o_orderstatus) AS BIGINT) AS rels_delta, o_custkey AS total_nodes, o_orderkey AS total_rels, '1999-01-01 00:00:00' AS time"

P = Projection
#: name -> (operator on a projection, SQL after the projection's WITH list)
GRAPH: dict[str, tuple[Callable[[P], DataFrame], str]] = {
    "normalize_claims": (lambda p: p.normalized, "SELECT * FROM norm"),
    "reject_reason": (lambda p: p.validated.groupBy("reject_rule", "reject_value").agg(F.count("*").alias("n")), "SELECT reject_rule, CASE WHEN reject_rule LIKE '%subject' THEN subject WHEN reject_rule LIKE '%object' THEN object WHEN reject_rule LIKE '%predicate' THEN predicate WHEN reject_rule LIKE '%subject_type' THEN subject_type WHEN reject_rule LIKE '%object_type' THEN object_type END AS reject_value, count(*) AS n FROM claims GROUP BY ALL"),
    "valid_claims": (lambda p: p.valid, "SELECT * EXCLUDE (reject_rule) FROM valid"),
    "rejected_claims": (lambda p: claims.rejected_claims(p.validated).select("subject", "predicate", "object", "source_id", "reject_rule"), "SELECT subject, predicate, object, source_id, reject_rule FROM claims WHERE reject_rule IS NOT NULL"),
    "validation_stats": (lambda p: claims.validation_stats(p.validated), "SELECT (SELECT count(*) FROM claims) AS total, count(*) AS valid, (SELECT count(*) FROM claims) - count(*) AS rejected, round(100.0 * count(*) / (SELECT count(*) FROM claims), 1) AS pass_rate_pct, round(avg(evidence_strength), 2) AS avg_evidence_strength, count(*) FILTER (evidence_strength >= 5) AS strength_ge_5, count(*) FILTER (evidence_strength >= 4) AS strength_ge_4 FROM valid"),
    "rejects_by_reason": (lambda p: claims.rejects_by_reason(p.validated), "SELECT reject_rule, count(*) AS n FROM claims WHERE reject_rule IS NOT NULL GROUP BY reject_rule"),
    "normalization_changes": (lambda p: claims.normalization_changes(p.raw), f"SELECT old, new, count(*) AS n FROM (SELECT subject_type AS old, coalesce({fixtures._type_sql('subject_type')}, 'Thing') AS new FROM raw UNION ALL SELECT object_type, coalesce({fixtures._type_sql('object_type')}, 'Thing') FROM raw) WHERE old IS DISTINCT FROM new GROUP BY ALL ORDER BY n DESC, old, new LIMIT 20"),
    "infer_evidence_type": (lambda p: p.raw.groupBy(vocab.infer_evidence_type(F.col("context")).alias("kind")).agg(F.count("*").alias("n")), f"SELECT {fixtures.infer_sql('context')} AS kind, count(*) AS n FROM raw GROUP BY ALL"),
    "backfill_evidence_type": (lambda p: claims.backfill_evidence_type(p.normalized).groupBy("evidence_type", "evidence_type_source").agg(F.count("*").alias("n")), f"SELECT CASE WHEN evidence_type = '' THEN coalesce({fixtures.infer_sql('context')}, '') ELSE evidence_type END AS evidence_type, CASE WHEN evidence_type = '' AND {fixtures.infer_sql('context')} IS NOT NULL THEN 'inferred' END AS evidence_type_source, count(*) AS n FROM norm GROUP BY ALL"),
    "backfill_journal": (lambda p: claims.backfill_journal(p.normalized, p.papers).groupBy("journal").agg(F.count("*").alias("n")), "SELECT CASE WHEN trim(c.journal) = '' THEN coalesce(d.source, '') ELSE trim(c.journal) END AS journal, count(*) AS n FROM norm c LEFT JOIN documents d ON CAST(d.doc_id AS VARCHAR) = regexp_replace(c.source_id, '^PMC', '') GROUP BY ALL"),
    "consolidate_claims": (lambda p: claims.validation_stats(claims.consolidate_claims(p.raw, p.papers)).select("total", "valid", "rejected"), "SELECT count(*) AS total, count(*) FILTER (reject_rule IS NULL) AS valid, count(*) FILTER (reject_rule IS NOT NULL) AS rejected FROM claims"),
    "claim_stats": (lambda p: claims.claim_stats(p.raw), "SELECT count(*) AS claims, count(nullif(trim(source_id), '')) AS with_source, count(DISTINCT nullif(trim(source_id), '')) AS sources FROM raw"),
    "claim_check": (lambda p: claims.claim_check(p.raw), "SELECT count(*) AS total, count(nullif(trim(source_id), '')) AS with_source, count(*) - count(nullif(trim(source_id), '')) AS without_source FROM raw"),
    "build_nodes": (lambda p: p.nodes, "SELECT * FROM nodes"),
    "build_edges": (lambda p: p.edges, "SELECT * FROM edges"),
    "upsert_edges": (lambda p: graph.upsert_edges(p.edges.where(F.col("source_id") < "PMC5"), p.edges.where(F.col("source_id") >= "PMC3")).select(*graph.EDGE_KEY, "pub_date"), "SELECT src_label, src, rel, dst_label, dst, source_id, pub_date FROM edges"),
    "skipped_without_source": (lambda p: graph.skipped_without_source(p.raw), "SELECT count(*) AS skipped FROM raw WHERE trim(source_id) = ''"),
    "orphan_nodes": (lambda p: graph.orphan_nodes(p.listed, p.edges).select("label", "name"), f", {LISTED} SELECT label, name FROM listed WHERE (label, name) NOT IN (SELECT (label, name) FROM {ENDS})"),
    "drop_orphans": (lambda p: graph.drop_orphans(p.listed, p.edges).select("label", "name"), f", {LISTED} SELECT label, name FROM listed WHERE (label, name) IN (SELECT (label, name) FROM {ENDS})"),
    "drop_noise_nodes": (lambda p: graph.drop_noise_nodes(p.nodes.withColumn("name", F.regexp_replace("name", "^red ", "(red) ")), p.edges)[0].select("label", "name"), "SELECT label, regexp_replace(name, '^red ', '(red) ') AS name FROM nodes WHERE name NOT LIKE 'red %' OR label NOT IN ('Disease', 'Symptom', 'Food', 'Nutrient', 'Drug', 'LifestyleFactor', 'Biomarker', 'Mechanism', 'BodySystem')"),
    "neighborhood": (lambda p: graph.neighborhood(p.edges, p.nodes, 2), f"{NEAR} SELECT \"start\", x, rel, y, hop FROM near"),
    "neighborhood_nodes": (lambda p: graph.neighborhood_nodes(graph.neighborhood(p.edges, p.nodes.where("label = 'Nutrient'"), 1), p.nodes), f"{NEAR.replace('FROM nodes s', 'FROM nodes s WHERE label = ' + chr(39) + 'Nutrient' + chr(39)).replace('hop <= 2', 'hop <= 1')} SELECT DISTINCT near.start AS \"start\", n.label, n.name, n.display_name FROM near JOIN nodes n ON n.name IN (near.x, near.y)"),
    "visible_subgraph": (lambda p: graph.visible_subgraph(p.nodes, p.edges, ["Food", "Nutrient"], ["CONTAINS", "TREATS"]).select(*graph.EDGE_KEY), "SELECT src_label, src, rel, dst_label, dst, source_id FROM edges WHERE src_label IN ('Food', 'Nutrient') AND dst_label IN ('Food', 'Nutrient') AND rel IN ('CONTAINS', 'TREATS')"),
    "kg_totals": (lambda p: audit.kg_totals(p.nodes, p.edges), "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges"),
    "kg_stats_rollup": (lambda p: audit.kg_stats_rollup(p.nodes), "SELECT coalesce(label, '(all)') AS label, count(*) AS n FROM nodes GROUP BY ROLLUP (label)"),
    "nodes_by_label": (lambda p: audit.nodes_by_label(p.nodes), "SELECT label, count(*) AS n FROM nodes GROUP BY label"),
    "edges_by_type": (lambda p: audit.edges_by_type(p.edges), "SELECT rel, count(*) AS n FROM edges GROUP BY rel"),
    "label_share": (lambda p: audit.label_share(p.nodes), "SELECT label, n, CAST(round(100.0 * n / sum(n) OVER (), 0) AS INTEGER) AS pct, CAST(round(100.0 * n / max(n) OVER (), 0) AS INTEGER) AS pct_of_max FROM (SELECT label, count(*) AS n FROM nodes GROUP BY label)"),
    "unique_sources": (lambda p: audit.unique_sources(p.edges), "SELECT count(DISTINCT nullif(trim(source_id), '')) AS sources FROM edges"),
    "nonstandard_labels": (lambda p: audit.nonstandard_labels(p.listed), f", {LISTED} SELECT label, count(*) AS n FROM listed WHERE label NOT IN ({TYPES}) GROUP BY label"),
    "duplicate_name_excess": (lambda p: audit.duplicate_name_excess(p.nodes), "SELECT count(*) AS groups, CAST(coalesce(sum(n), 0) - count(*) AS BIGINT) AS excess FROM (SELECT lower(name), count(*) AS n FROM nodes GROUP BY 1 HAVING count(*) > 1)"),
    "weak_predicate_pct": (lambda p: audit.weak_predicate_pct(p.loose_edges), f"SELECT count(*) FILTER (predicate IN ({WEAK})) AS weak, round(100.0 * count(*) FILTER (predicate IN ({WEAK})) / greatest(count(*), 1), 1) AS pct FROM (SELECT DISTINCT subject_type, lower(subject), predicate, object_type, lower(object), source_id FROM norm WHERE trim(source_id) <> '')"),
    "strength_distribution": (lambda p: audit.strength_distribution(p.edges), "SELECT evidence_strength, count(*) AS n FROM edges GROUP BY 1"),
    "orphan_count": (lambda p: graph.orphan_nodes(p.listed, p.edges).agg(F.count("*").alias("orphans")), f", {LISTED} SELECT count(*) AS orphans FROM listed WHERE (label, name) NOT IN (SELECT (label, name) FROM {ENDS})"),
    "audit_report": (lambda p: audit.audit_report(p.listed, p.edges), f""", {LISTED} SELECT count(*) AS edges, count(DISTINCT nullif(trim(source_id), '')) AS sources, count(*) FILTER (rel IN ({WEAK})) AS weak, round(100.0 * count(*) FILTER (rel IN ({WEAK})) / greatest(count(*), 1), 1) AS weak_pct,
      count(*) FILTER (trim(journal) = '') AS no_journal, round(100.0 * count(*) FILTER (trim(journal) = '') / greatest(count(*), 1), 1) AS no_journal_pct, count(*) FILTER (trim(evidence_type) = '') AS no_type, round(100.0 * count(*) FILTER (trim(evidence_type) = '') / greatest(count(*), 1), 1) AS no_type_pct,
      round(100.0 * count(*) FILTER (trim(source_id) <> '') / greatest(count(*), 1), 1) AS source_pct, (SELECT count(*) FROM listed) AS nodes, (SELECT count(*) FROM listed WHERE label NOT IN ({TYPES})) AS nonstandard,
      (SELECT count(*) FROM (SELECT 1 FROM listed GROUP BY lower(name) HAVING count(*) > 1)) AS groups, (SELECT CAST(coalesce(sum(n) - count(*), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM listed GROUP BY lower(name) HAVING count(*) > 1)) AS excess,
      (SELECT count(*) FROM listed WHERE (label, name) NOT IN (SELECT (label, name) FROM {ENDS})) AS orphans, (SELECT count(*) FROM {AUDIT_PAIRS} JOIN edges a ON a.rel = p JOIN edges b ON b.rel = n AND {SAME_ENDS}) AS contradictions FROM edges"""),
    "degree_below": (lambda p: audit.degree_below(p.nodes, p.edges, ["Food", "Nutrient", "Disease", "Symptom", "Study"], 6), f"SELECT n.label, n.name, count(e.name) AS degree FROM nodes n LEFT JOIN {ENDS} e ON e.label = n.label AND e.name = n.name WHERE n.label IN ('Food', 'Nutrient', 'Disease', 'Symptom', 'Study') GROUP BY n.label, n.name HAVING count(e.name) < 6"),
    "opposing_pairs": (lambda p: audit.opposing_pairs(p.edges), OPPOSED),
    "opposing_pair_counts": (lambda p: audit.opposing_pair_counts(p.edges), f"SELECT pair, count(b.rel) AS n FROM {PAIRS} LEFT JOIN edges a ON a.rel = p LEFT JOIN edges b ON b.rel = pairs.n AND {SAME_ENDS} GROUP BY pair"),
    "audit_contradictions": (lambda p: audit.opposing_pairs(p.edges, audit.AUDIT_OPPOSING).orderBy("pair", "src", "dst", "pos_source", "neg_source").limit(50).select("pair", "src", "dst", "pos_source", "neg_source"), f"SELECT pair, a.src, a.dst, a.source_id AS pos_source, b.source_id AS neg_source FROM {AUDIT_PAIRS} JOIN edges a ON a.rel = p JOIN edges b ON b.rel = n AND {SAME_ENDS} ORDER BY pair, a.src, a.dst, pos_source, neg_source LIMIT 50"),
    "contradiction_verdicts": (lambda p: audit.contradiction_verdicts(p.edges), f", {VERDICTS} SELECT * FROM verdicts"),
    "contradiction_latest": (lambda p: audit.contradiction_latest(audit.contradiction_verdicts(p.edges)), f", {VERDICTS} SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY entity, disease ORDER BY src_label DESC, pos_rel DESC, neg_rel DESC) AS rn FROM verdicts) WHERE rn = 1"),
    "flag_contested": (lambda p: audit.flag_contested(p.edges, audit.contradiction_verdicts(p.edges)).groupBy("rel", "contested", "debated").agg(F.count("*").alias("n")), f""", {VERDICTS}, marks AS (SELECT src_label, entity AS src, disease AS dst, pos_rel AS rel, verdict = 'positive_contested' AS c, verdict = 'debated' AS d FROM verdicts UNION ALL SELECT src_label, entity, disease, neg_rel, verdict = 'negative_contested', verdict = 'debated' FROM verdicts),
      m AS (SELECT src_label, src, dst, rel, bool_or(c) AS c, bool_or(d) AS d FROM marks GROUP BY ALL)
      SELECT e.rel, coalesce(m.c, false) AS contested, coalesce(m.d, false) AS debated, count(*) AS n FROM edges e LEFT JOIN m ON m.src_label = e.src_label AND m.src = e.src AND m.dst = e.dst AND m.rel = e.rel AND e.dst_label = 'Disease' GROUP BY ALL"""),
    "gap_few_recommendations": (lambda p: audit.gap_few_recommendations(p.nodes, p.edges), FEW),
    **{f"gap_{g}": (lambda p, g=g: audit.gap(p.nodes, p.edges, g), _gap_sql(g)) for g in audit.GAP_RULES},
    "gap_counts": (lambda p: audit.gap_counts(audit.all_gaps(p.nodes, p.edges)), f"SELECT gap_type, count(*) AS n FROM ({ALL_GAPS}) GROUP BY gap_type"),
    "gap_queries": (
        lambda p: audit.gap_queries(audit.all_gaps(p.nodes, p.edges), users.demand_boost(users.demand_daily(p.wishes), 200), "2022/01/01", "2023/12/31", {"nutrition": ["Nutrients", "Appetite"], "food": ["Food Chemistry"]}),
        GAP_QUERIES,
    ),
    "age_gender_profile": (lambda p: recommend.age_gender_profile(p.users), f"$users SELECT DISTINCT user_id, coalesce(pr.conditions, '{recommend.PROFILES['default', 'any']}') AS conditions FROM users u LEFT JOIN {PROFILES} ON pr.d = {DECADE} AND pr.g = {GENDER}"),
    "user_targets": (lambda p: recommend.user_targets(p.users), f"$users, {TARGETS} SELECT * FROM targets"),
    "recs_direct": (lambda p: recommend.recs_direct(p.edges).select("item", "rel", "target", "source_id", "strength"), f", {LAYERS} SELECT item, rel, target, source_id, strength FROM direct"),
    "recs_via_nutrient": (lambda p: recommend.recs_via_nutrient(p.edges).drop("reached", "debated", "ev"), f", {LAYERS} SELECT * FROM via_nutrient"),
    "recs_via_shared_symptom": (lambda p: recommend.recs_via_shared_symptom(p.edges).select("item", "rel", "target", "source_id", "strength"), f", {LAYERS} SELECT item, rel, target, source_id, strength FROM via_symptom"),
    "restricted_items": (lambda p: recommend.restricted_items(p.edges).drop("ev"), f"SELECT src AS item, rel, dst AS target, source_id, evidence_strength AS strength FROM edges WHERE rel IN ({NEG}) AND src_label IN ('Food', 'Nutrient') AND dst_label IN ('Disease', 'Symptom')"),
    "early_signals": (lambda p: recommend.early_signals(p.edges), "SELECT src AS symptom, dst AS disease, count(*) AS n_evidence, max(evidence_strength) AS strength FROM edges WHERE rel = 'EARLY_SIGNAL_OF' AND src_label = 'Symptom' AND dst_label = 'Disease' GROUP BY ALL"),
    **{n: (lambda p, r=r: recommend.drug_links(p.edges, r), f"SELECT drug, item, strength, n_evidence, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY drug ORDER BY strength DESC, n_evidence DESC, item) AS rank FROM (SELECT dst AS drug, src AS item, max(evidence_strength) AS strength, count(*) AS n_evidence FROM edges WHERE rel = '{r}' AND dst_label = 'Drug' GROUP BY ALL)) WHERE rank <= 15") for n, r in (("drug_substitutes", "SUBSTITUTES_FOR"), ("drug_complements", "COMPLEMENTS_DRUG"))},
    "drug_interactions": (lambda p: recommend.drug_interactions(p.edges), "SELECT dst AS drug, coalesce(string_agg(DISTINCT CASE WHEN rel = 'CONTRAINDICATED_WITH' THEN src END, ', ' ORDER BY CASE WHEN rel = 'CONTRAINDICATED_WITH' THEN src END), '') AS avoid, coalesce(string_agg(DISTINCT CASE WHEN rel = 'COMPLEMENTS_DRUG' THEN src END, ', ' ORDER BY CASE WHEN rel = 'COMPLEMENTS_DRUG' THEN src END), '') AS complement FROM edges WHERE dst_label = 'Drug' AND src_label IN ('Food', 'Nutrient') AND rel IN ('CONTRAINDICATED_WITH', 'COMPLEMENTS_DRUG') GROUP BY dst"),
    "biomarkers": (lambda p: recommend.biomarkers(p.edges), "SELECT b.biomarker, b.disease, m.food, m.direction FROM (SELECT DISTINCT src AS biomarker, dst AS disease FROM edges WHERE rel = 'BIOMARKER_FOR' AND src_label = 'Biomarker' AND dst_label = 'Disease') b LEFT JOIN (SELECT DISTINCT dst AS biomarker, src AS food, CASE WHEN rel = 'INCREASES_BIOMARKER' THEN 'raises' ELSE 'lowers' END AS direction FROM edges WHERE rel IN ('INCREASES_BIOMARKER', 'DECREASES_BIOMARKER') AND src_label IN ('Food', 'Nutrient')) m ON m.biomarker = b.biomarker"),
    "risk_cascade": (lambda p: recommend.risk_cascade(p.edges, p.users), f"$users, {TARGETS} SELECT user_id, target, disease, n, CAST(rank AS INTEGER) AS rank, CASE WHEN n >= 2 THEN 'high' ELSE 'moderate' END AS severity FROM (SELECT t.user_id, t.target, c.disease, c.n, row_number() OVER (PARTITION BY t.user_id ORDER BY c.n DESC, t.target, c.disease) AS rank FROM targets t JOIN (SELECT src, dst AS disease, count(*) AS n FROM edges WHERE src_label = 'Disease' AND dst_label = 'Disease' AND rel IN ('INCREASES_RISK_OF', 'CAUSES') GROUP BY ALL) c ON c.src = t.target) WHERE rank <= 6"),
    "risk_evidence": (lambda p: recommend.risk_evidence(p.edges), f"SELECT disease, item, rel, source_id, CAST(rank AS INTEGER) AS rank FROM (SELECT dst AS disease, src AS item, rel, source_id, row_number() OVER (PARTITION BY dst ORDER BY source_id DESC, src, rel) AS rank FROM edges WHERE dst_label = 'Disease' AND rel IN ({POS}) AND src_label IN ('Food', 'Nutrient', 'LifestyleFactor')) WHERE rank <= 8"),
    "trust_level": (lambda p: recommend.trust_levels(p.edges), f"SELECT CASE WHEN rel IN ({POS}) AND src_label IN ('Food', 'Nutrient') AND dst_label IN ('Disease', 'Symptom') THEN 'wisdom' WHEN source_type IN ('FDA', 'drug_label') THEN 'knowledge' ELSE 'information' END AS trust, count(*) AS n FROM edges GROUP BY 1"),
    "suggest_vocab": (lambda p: users.suggest_vocab(p.table("part").select(F.split("p_name", " ")[1].alias("term")), p.nodes.select(F.col("name").alias("key"), F.col("display_name").alias("canonical"))), "SELECT term, canonical, CAST(rank AS INTEGER) AS rank FROM (SELECT term, canonical, row_number() OVER (PARTITION BY term ORDER BY grade, length(canonical), canonical) AS rank FROM (SELECT t.term, n.display_name AS canonical, min(CASE WHEN n.name = t.term THEN 0 ELSE 1 END) AS grade FROM (SELECT DISTINCT lower(split_part(p_name, ' ', 2)) AS term FROM part) t JOIN nodes n ON contains(n.name, t.term) OR contains(t.term, n.name) GROUP BY ALL)) WHERE rank <= 10"),
    "suggest_nodes": (lambda p: users.suggest_nodes(p.asked, p.shown), f"{ASKED}, {SHOWN} SELECT term, field, name, rank FROM own_nodes WHERE rank <= 10"),
    "suggest": (lambda p: users.suggest(p.asked, p.nodes.where(F.col("name").endswith("1")).select(F.col("name").alias("key"), F.col("display_name").alias("canonical")), p.shown), f"""{ASKED}, {SHOWN},
      words AS (SELECT *, row_number() OVER (PARTITION BY term, field ORDER BY length(name), name) AS rank FROM (SELECT DISTINCT t.term, t.field, n.display_name AS name FROM asked t JOIN nodes n ON contains(n.name, t.term) OR contains(t.term, n.name) WHERE n.name LIKE '%1')),
      both_kinds AS (SELECT term, field, name, min((source, rank)) AS best FROM (SELECT term, field, name, 0 AS source, rank FROM words WHERE rank <= 10 UNION ALL SELECT term, field, name, 1, rank FROM own_nodes WHERE rank <= 10) GROUP BY ALL)
      SELECT term, field, name, CAST(rank AS INTEGER) AS rank FROM (SELECT term, field, name, row_number() OVER (PARTITION BY term, field ORDER BY best, name) AS rank FROM both_kinds) WHERE rank <= 10"""),
    "match_entity": (lambda p: users.match_entity(p.table("part").select(F.split("p_name", " ")[0].alias("term")), p.nodes), "SELECT term, name FROM (SELECT t.term, n.name, row_number() OVER (PARTITION BY t.term ORDER BY n.name <> t.term, length(n.name), n.name) AS rn FROM (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS term FROM part) t JOIN nodes n ON contains(n.name, t.term)) WHERE rn = 1"),
    "replace_if_better": (lambda p: users.replace_if_better(p.valid.where("evidence_type = 'RCT'"), p.valid).groupBy("source_id").agg(F.count("*").alias("n")), "SELECT source_id, count(*) AS n FROM valid GROUP BY source_id"),
    "reextract_candidates": (lambda p: users.reextract_candidates(p.papers.select("pmcid"), p.valid), "SELECT d.pmcid, n, strength FROM (SELECT 'PMC' || CAST(doc_id AS VARCHAR) AS pmcid, count(v.source_id) AS n, coalesce(avg(v.evidence_strength), 0.0) AS strength FROM documents LEFT JOIN valid v ON v.source_id = 'PMC' || CAST(doc_id AS VARCHAR) GROUP BY doc_id) d WHERE n <= 2 ORDER BY n, strength DESC, pmcid LIMIT 50"),
    "risk_factor_match": (lambda p: risk.risk_factor_match(p.profiles, p.users, p.names), f"$users, {PROF}, {MATCHES} SELECT * FROM hits"),
    "risk_board": (lambda p: p.board, f"$users, {PROF}, {MATCHES}, {BOARD} SELECT * FROM board"),
    "enrich_profiles": (lambda p: risk.enrich_profiles(p.profiles, p.edges), f", {PROF}, {ENRICHED}"),
    "insights": (lambda p: p.insights, f"$users, {TARGETS}, {INSIGHTS} SELECT * FROM ins"),
    "inferred_conditions": (lambda p: risk.inferred_conditions(p.insights, p.users, risk.likely_rules(p.spark)), f"$users, {TARGETS}, {INSIGHTS}, {INFERRED} SELECT * FROM inferred"),
    "open_checks": (lambda p: risk.open_checks_of(p.profiles, p.users, p.checks, p.names), f"""$users, {PROF}, {MATCHES}, {BOARD}, checks AS (SELECT DISTINCT dst AS disease, src AS check_id, length(src) AS pos FROM edges WHERE rel = 'EARLY_SIGNAL_OF' AND src_label = 'Symptom' AND dst_label = 'Disease'),
      open AS (SELECT b.user_id, disease, level, check_id, pos FROM board b JOIN checks USING (disease) WHERE level IN ('high', 'medium') AND NOT EXISTS (SELECT 1 FROM users u WHERE u.user_id = b.user_id AND u.term = check_id)),
      firsts AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY level <> 'high', disease) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id, disease ORDER BY pos, check_id) AS rn FROM open) WHERE rn = 1)
      SELECT user_id, disease, check_id, (SELECT count(*) FROM open o WHERE o.user_id = f.user_id) AS remaining, CAST(rank AS INTEGER) AS rank FROM firsts f WHERE rank <= 2"""),
    "next_questions": (lambda p: risk.next_questions(p.users, risk.inferred_conditions(p.insights, p.users, risk.likely_rules(p.spark)), p.users.where("plan = 'paid'").select("user_id", F.lit("gender").alias("question"))), f"""$users, {TARGETS}, {INSIGHTS}, {INFERRED},
      asked AS (SELECT user_id, 'conditions' AS question, 2 AS p FROM users GROUP BY user_id HAVING count(term) = 0 UNION ALL SELECT DISTINCT user_id, 'gender', 3 FROM users WHERE gender = '' AND plan <> 'paid' UNION ALL SELECT user_id, 'confirm:' || name, rank + 3 FROM inferred)
      SELECT user_id, question, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p, question) AS rank FROM asked) WHERE rank <= 3"""),
    "cluster_for_top_gap": (lambda p: planning.cluster_for_top_gap(audit.gap_counts(audit.all_gaps(p.nodes, p.edges)), audit.all_gaps(p.nodes, p.edges).select("gap_type").distinct().withColumn("clusters", F.concat(F.lit("topics of "), "gap_type"))), f"SELECT gap_type, n, 'topics of ' || gap_type AS clusters FROM (SELECT gap_type, count(*) AS n FROM ({ALL_GAPS}) GROUP BY gap_type) ORDER BY n DESC, gap_type LIMIT 1"),
    "active_clusters": (lambda p: planning.active_clusters(p.edges.select(F.col("src_label").alias("cluster"), F.col("dst").alias("entity")), audit.gap_few_recommendations(p.nodes, p.edges)), f"SELECT DISTINCT src_label AS cluster FROM edges WHERE dst IN (SELECT entity FROM ({FEW}))"),
    "risk_severity": (lambda p: p.edges.groupBy(F.col("dst_label").alias("kind"), "dst").agg(F.count("*").alias("n")).groupBy(risk.risk_severity(F.col("kind"), F.col("n")).alias("severity")).agg(F.count("*").alias("n")), "SELECT CASE WHEN dst_label = 'Disease' AND c >= 2 THEN 'high' ELSE 'med' END AS severity, count(*) AS n FROM (SELECT dst_label, dst, count(*) AS c FROM edges GROUP BY ALL) GROUP BY 1"),
    "seed_edges": (lambda p: planning.seed_edges(p.edges.where("rel = 'CONTAINS'").groupBy(F.col("src").alias("disease")).agg(F.collect_list("dst").alias("organs"))), "SELECT DISTINCT 'Disease' AS src_label, src, 'OCCURS_AT' AS rel, 'BodySystem' AS dst_label, dst, 'seed_organs' AS source_id FROM edges WHERE rel = 'CONTAINS'"),
    "audit_sample": (lambda p: planning.audit_sample(p.raw, p.raw.where("pub_date < '1997-01-01'").select("source_id", F.lit("factual").alias("verdict"))), "SELECT CASE WHEN source_id IN (SELECT source_id FROM raw WHERE pub_date < '1997-01-01') THEN 'factual' ELSE 'unclassified' END AS verdict, count(*) AS n FROM (SELECT * FROM raw ORDER BY trim(context) = '', source_id, subject, predicate, object, context LIMIT 100) GROUP BY 1"),
}
#: name -> (operator on a projection, whole SQL)
PLAIN: dict[str, tuple[Callable[[P], DataFrame], str | None]] = {
    "demand_daily": (lambda p: users.demand_daily(p.demand), "SELECT 'e' || CAST(user_id % 25 AS VARCHAR) AS entity, event_type AS kind, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY ALL"),
    "top_demand": (lambda p: users.top_demand(users.demand_daily(p.demand)), "SELECT 'e' || CAST(user_id % 25 AS VARCHAR) AS entity, event_type AS kind, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, entity, kind LIMIT 20"),
    "demand_boost": (lambda p: users.demand_boost(users.demand_daily(p.demand)), "SELECT 'e' || CAST(user_id % 25 AS VARCHAR) AS entity, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, entity LIMIT 20"),
    "audit_history": (lambda p: audit.audit_history(p.daily.where("ts < '1997-01-01'"), p.daily.where("ts >= '1997-01-01'")), "SELECT CAST(o_orderdate AS DATE) AS ts, count(*) AS orders FROM orders GROUP BY 1 ORDER BY ts DESC LIMIT 100"),
    "cycle_log": (lambda p: planning.cycle_log(p.log_lines), f"SELECT {LOGGED} FROM orders WHERE o_orderstatus <> 'P' ORDER BY o_orderkey DESC LIMIT 20"),
    "cycle_totals": (lambda p: planning.cycle_totals(p.log_lines), f"SELECT count(*) AS cycles, CAST(sum(papers) AS BIGINT) AS papers, CAST(sum(nodes_delta) AS BIGINT) AS nodes_delta, CAST(sum(rels_delta) AS BIGINT) AS rels_delta FROM (SELECT {LOGGED} FROM orders WHERE o_orderstatus <> 'P')"),
    "yield_stats": (lambda p: users.yield_stats(p.runs), "WITH l AS (SELECT l_orderkey AS k, count(*) AS returned, count(*) FILTER (l_linenumber = 1) AS fresh, count(*) FILTER (l_returnflag = 'R') AS claims FROM lineitem GROUP BY 1) SELECT o_orderpriority AS label, count(*) AS runs, CAST(sum(returned) AS BIGINT) AS returned, CAST(sum(fresh) AS BIGINT) AS fresh, CAST(sum(claims) AS BIGINT) AS claims, round(sum(claims) / sum(returned), 2) AS per_paper FROM orders JOIN l ON k = o_orderkey GROUP BY 1"),
    "low_yield_queries": (lambda p: users.low_yield_queries(p.runs), "WITH l AS (SELECT l_orderkey AS k, count(*) AS returned, count(*) FILTER (l_returnflag = 'R') AS claims FROM lineitem GROUP BY 1) SELECT o_orderpriority AS label, count(*) AS runs, CAST(sum(returned) AS BIGINT) AS returned, CAST(sum(claims) AS BIGINT) AS claims FROM orders JOIN l ON k = o_orderkey GROUP BY 1 HAVING count(*) >= 3 AND sum(claims) / sum(returned) < 0.5"),
    "query_yield": (lambda p: users.query_yield(p.table("lineitem").select(F.col("l_suppkey").alias("rank"), F.col("l_suppkey").cast("string").alias("label"), F.col("l_partkey").alias("id")).distinct()), "WITH h AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem), f AS (SELECT l_partkey, min(l_suppkey) AS o FROM h GROUP BY 1) SELECT CAST(h.l_suppkey AS VARCHAR) AS label, count(*) AS returned, count(*) FILTER (f.o = h.l_suppkey) AS fresh FROM h JOIN f USING (l_partkey) GROUP BY 1"),
    "trajectory": (lambda p: users.trajectory(p.snapshots, 20).select("user_id", "id", "step"), SNAPSHOTS + " SELECT user_id, id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, id) AS INTEGER) AS step FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, id DESC) AS rn FROM every) WHERE rn <= 20"),
    "zone_transitions": (lambda p: users.zone_transitions(p.snapshots), SNAPSHOTS + f" SELECT user_id, id, zone FROM (SELECT *, lag(zone) OVER w AS b, lead(zone) OVER w AS a FROM (SELECT *, {ZONE} AS zone FROM snaps) WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)) WHERE b IS NULL OR b <> zone OR a IS NULL"),
    "drift": (lambda p: users.drift(p.snapshots), SNAPSHOTS + f" SELECT user_id, id, score, delta, CASE WHEN delta > 2 THEN 'improving' WHEN delta < -2 THEN 'worsening' ELSE 'steady' END AS trend, zone <> b AS zone_changed FROM (SELECT *, score - lag(score) OVER w AS delta, lag(zone) OVER w AS b FROM (SELECT *, CAST(greatest(0, least(100, round(100 - (y - 50) / 405 * 100))) AS INTEGER) AS score, {ZONE} AS zone FROM snaps) WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)) WHERE delta IS NOT NULL"),
    "path_length": (lambda p: users.path_length(p.snapshots), SNAPSHOTS + " SELECT user_id, round(coalesce(sum(d), 0.0), 4) AS length FROM (SELECT user_id, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM snaps WHERE x IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)) GROUP BY user_id"),
    "map_position": (
        lambda p: p.users.groupBy("user_id", F.expr("CASE WHEN user_id % 11 > 0 THEN age END").alias("age")).agg(F.count("term").alias("n")).select("user_id", F.round(users.map_x(F.col("age")), 6).alias("x"), users.map_y(F.col("age"), F.col("n"), F.lit(0)).alias("y"), users.life_stage(F.col("age")).alias("stage")),
        "WITH " + fixtures.DUCK_USERS + ", placed AS (SELECT user_id, CASE WHEN user_id % 11 > 0 THEN age END AS age, count(term) AS n FROM users GROUP BY ALL) SELECT user_id, round(80 + (greatest(16, least(90, coalesce(age, 35))) - 16) / 74.0 * 760, 6) AS x, least(455.0, greatest(50.0, 50 + 1.7 * greatest(0, coalesce(age, 35) - 20) + 65 * n)) AS y, CASE WHEN age < 30 THEN '20s' WHEN age < 40 THEN '30s' WHEN age < 50 THEN '40s' WHEN age < 65 THEN '50s-60s' WHEN age >= 65 THEN '65+' END AS stage FROM placed",
    ),
    "papers_backlog": (lambda p: papers.corpus_backlog(p.papers.select("pmcid"), p.raw.select(F.col("source_id").alias("pmcid"))), "SELECT (SELECT count(*) FROM documents) AS raw, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey % 53 <> 0) AS extracted, greatest(0, (SELECT count(*) FROM documents) - (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_orderkey % 53 <> 0)) AS backlog"),
    "merge_id_lists": (lambda p: papers.merge_id_lists(p.table("lineitem").select(F.col("l_suppkey").alias("rank"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("label"), F.col("l_partkey").cast("string").alias("id"))), "SELECT CAST(l_partkey AS VARCHAR) AS id, min(l_suppkey) AS first_rank, string_agg(DISTINCT 's' || CAST(l_suppkey AS VARCHAR), ',' ORDER BY 's' || CAST(l_suppkey AS VARCHAR)) AS labels FROM lineitem GROUP BY 1"),
    "new_ids_only": (lambda p: papers.new_ids_only(p.table("lineitem").select(F.col("l_partkey").cast("string").alias("id"), F.col("l_linenumber").alias("phase")), p.table("part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("id"))), "SELECT CAST(l_partkey AS VARCHAR) AS id, min(l_linenumber) AS phase FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) GROUP BY 1"),
    "journal_query_strings": (lambda p: planning.journal_query_strings(p.papers, "2020-01-01", "2024-12-31", ["diet", "food"], 3), """SELECT initial, CAST(batch AS INTEGER) AS batch, '(' || string_agg('"' || journal || '"[Journal]', ' OR ' ORDER BY journal) || ') AND "2020-01-01":"2024-12-31"[Date] AND (diet OR food)' AS query
      FROM (SELECT journal, lower(journal[1]) AS initial, (row_number() OVER (PARTITION BY lower(journal[1]) ORDER BY journal) - 1) // 3 AS batch FROM (SELECT DISTINCT trim(source) AS journal FROM documents WHERE trim(source) <> '')) GROUP BY ALL"""),
    "latest_manifest": (lambda p: planning.latest_manifest(p.manifests), "SELECT event_type AS agent, event_id AS run_id, ts, props AS payload FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC, props DESC) AS rn FROM events) WHERE rn = 1"),
    "run_history": (lambda p: planning.run_history(p.manifests).select("agent", "run_id"), "SELECT event_type AS agent, event_id AS run_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 20"),
    "persona_code": (lambda p: risk.persona_code(p.snapshots, p.table("events").groupBy("user_id").agg(F.count_distinct("event_type").alias("n"))), f"""WITH snaps AS (SELECT user_id, least(455.0, 50 + 3 * value) AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE event_id % 29 > 0), two AS (SELECT user_id, max({SCORE}) FILTER (rn = 1) AS a, max({SCORE}) FILTER (rn = 2) AS b FROM snaps WHERE rn <= 2 GROUP BY 1)
      SELECT user_id, CASE WHEN a >= 60 THEN 'V' ELSE 'G' END || CASE WHEN n <= 1 THEN 'S' ELSE 'C' END || CASE WHEN coalesce(a - b, 0) > 2 THEN 'A' WHEN coalesce(a - b, 0) < -2 THEN 'D' ELSE 'S' END AS persona FROM two JOIN (SELECT user_id, count(DISTINCT event_type) AS n FROM events GROUP BY 1) USING (user_id)"""),
    "territory": (lambda p: fixtures.intros(p.spark, p.sf_dir).groupBy(risk.territory(F.array("text")).alias("territory")).agg(F.count("*").alias("n")), f"WITH {fixtures.intros_sql()} SELECT {REGIONS} AS territory, count(*) AS n FROM (SELECT lower(text) AS t FROM intros) GROUP BY 1"),
    "extraction_prompts": (lambda p: planning.extraction_prompts(p.papers.select("pmcid", F.col("abstract").alias("text"))).select("pmcid", F.sha2(F.regexp_extract("prompt", r"(?s)\nPaper (.*)$", 1), 256).alias("body")), "SELECT 'PMC' || CAST(doc_id AS VARCHAR) AS pmcid, sha256('PMC' || CAST(doc_id AS VARCHAR) || ':' || chr(10) || text) AS body FROM documents"),
}

GRAPH |= care_queries(POS, NEG, TARGETS, VERDICTS, DECADE) | REPAIR


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    run = lambda f: lambda spark, sf_dir: f(Projection(spark, sf_dir))
    return {n: run(f) for n, (f, _) in (GRAPH | GRAPH_PAPERS | PLAIN | PEOPLE | PAPERS).items()}


def oracle_sql() -> dict[str, str]:
    out, base = {n: sql for n, (_, sql) in (PLAIN | PEOPLE | PAPERS).items() if sql}, fixtures.base_sql()
    for n, (_, sql) in (GRAPH | GRAPH_PAPERS).items():
        out[n] = f"{base}, {fixtures.DUCK_USERS}{sql.removeprefix('$users')}" if sql.startswith("$users") else f"{base} {sql}"
    return out
