"""Registered queries of recommendations and chains that list their evidence, with their DuckDB twins.

Each entry is (operator applied to the projected tables, SQL after the projection's WITH list); lists of records are
shown by their source ids.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import functions as F

from .operators import recommend

RECORD = "(source_id, source_type, context, journal, pub_date)"
FIRST_5 = f"array_to_string([e[1] FOR e IN list_sort(list_distinct(list({RECORD})))[1:5]], '; ')"
SYMPTOM_ITEMS = "SELECT dst AS symptom, src AS item, count(*) AS n_evidence, max(evidence_strength) AS strength, {listed} AS evidence FROM edges WHERE rel = '{rel}' AND src_label IN ('Food', 'Nutrient') AND dst_label = 'Symptom' GROUP BY ALL"
SIGNALS = "SELECT src AS symptom, dst AS disease, count(*) AS n_evidence, max(evidence_strength) AS strength FROM edges WHERE rel = 'EARLY_SIGNAL_OF' AND src_label = 'Symptom' AND dst_label = 'Disease' GROUP BY ALL"
AGING = "aging AS (SELECT src, rel, dst, context, source_id, source_type, journal, pub_date FROM edges WHERE src_label = 'AgeRelatedChange' AND rel IN ('OCCURS_AT', 'EXPLAINS_WHY', 'MODIFIABLE_BY'))"


def sources(evidence: str):
    """The source ids of a list of records."""
    return F.array_join(F.transform(evidence, lambda e: e["source_id"]), "; ")


def _whole(evidence: str):
    return F.array_join(F.transform(evidence, lambda e: F.concat_ws("|", e["source_id"], e["source_type"], e["journal"], e["pub_date"])), "; ")


def care_queries(pos: str, neg: str, targets: str, verdicts: str, decade: str) -> dict[str, tuple[Callable, str]]:
    """The queries, with the SQL of the lists and tables they share with others."""
    foods = "src_label IN ('Food', 'Nutrient')"
    flagged = f"""{verdicts}, marks AS (SELECT src_label, entity AS src, disease AS dst, pos_rel AS rel, verdict = 'positive_contested' AS c, verdict = 'debated' AS d FROM verdicts UNION ALL SELECT src_label, entity, disease, neg_rel, verdict = 'negative_contested', verdict = 'debated' FROM verdicts),
marked AS (SELECT src_label, src, dst, rel, bool_or(c) AS contested, bool_or(d) AS debated FROM marks GROUP BY ALL),
flagged AS (SELECT e.*, coalesce(m.contested, false) AS contested, coalesce(m.debated, false) AS debated FROM edges e LEFT JOIN marked m ON m.src_label = e.src_label AND m.src = e.src AND m.dst = e.dst AND m.rel = e.rel AND e.dst_label = 'Disease')"""
    said = "lower(replace(e.rel, '_', ' '))"
    record = "e.evidence_strength AS strength, e.source_id, e.source_type, e.context, e.journal, e.pub_date"
    told = f"""told AS (
  SELECT e.dst AS target, e.src AS item, 'Associated with ' || {said} || ' of ' || e.dst || CASE WHEN debated THEN ' [debated — conflicting evidence exists]' ELSE '' END AS reason, {record} FROM flagged e WHERE e.rel IN ({pos}) AND e.{foods} AND e.dst_label IN ('Disease', 'Symptom') AND NOT contested
  UNION ALL SELECT e.dst, h.item, 'Contains ' || h.via || ' which ' || {said} || ' ' || e.dst, {record}
    FROM (SELECT DISTINCT src AS item, dst AS via FROM edges WHERE rel = 'CONTAINS' AND src_label = 'Food' AND dst_label = 'Nutrient') h JOIN edges e ON e.src = h.via WHERE e.src_label = 'Nutrient' AND e.rel IN ({pos}) AND e.dst_label IN ('Disease', 'Symptom')
  UNION ALL SELECT s.target, e.src, 'Associated with ' || {said} || ' of ' || e.dst, {record}
    FROM edges e JOIN (SELECT DISTINCT src AS symptom, dst AS target FROM edges WHERE rel = 'EARLY_SIGNAL_OF' AND src_label = 'Symptom') s ON s.symptom = e.dst WHERE e.{foods} AND e.dst_label = 'Symptom' AND e.rel IN ('ALLEVIATES', 'PREVENTS'))"""
    return {
        "recommendations": (
            lambda p: recommend.recommendations(p.flagged, p.users).withColumn("evidence", _whole("evidence")),
            f"""$users, {targets}, {flagged}, {told},
notes AS (SELECT user_id, max('Recommended for your profile (' || concat_ws(' ', CASE WHEN age IS NOT NULL THEN {decade} END, nullif(lower(trim(gender)), '')) || ') — ') AS note FROM users WHERE term IS NULL GROUP BY 1),
reasons AS (SELECT target, item, reason, count(DISTINCT source_id) AS n_evidence, max(strength) AS strength, list_sort(list_distinct(list({RECORD})))[1:5] AS evidence FROM told GROUP BY target, item, reason),
met AS (SELECT t.user_id, t.plan, r.item, r.reason, max((r.strength, r.n_evidence, len(r.evidence), r.evidence, t.from_profile)) AS b FROM targets t JOIN reasons r ON r.target = t.target GROUP BY ALL),
ranked AS (SELECT user_id, plan, item, reason, b[1] AS strength, b[2] AS n_evidence, b[4] AS evidence, b[5] AS from_profile, row_number() OVER (PARTITION BY user_id ORDER BY b[1] DESC, b[2] DESC, item, reason) AS rank FROM met)
SELECT user_id, item, CASE WHEN from_profile THEN note ELSE '' END || reason AS reason, n_evidence, strength, array_to_string([e[1] || '|' || e[2] || '|' || e[4] || '|' || e[5] FOR e IN evidence], '; ') AS evidence, CAST(rank AS INTEGER) AS rank
FROM ranked LEFT JOIN notes USING (user_id) WHERE rank <= CASE WHEN plan = 'free' THEN 5 ELSE 20 END""",
        ),
        "safest_path": (
            lambda p: recommend.safest_path(p.edges, p.users).withColumn("evidence", sources("evidence")),
            f"""$users, {targets}, steps AS (SELECT CASE WHEN rel IN ({pos}) THEN 'increase' ELSE 'reduce' END AS step, src AS item, dst AS target, evidence_strength AS s, {RECORD} AS ev FROM edges WHERE (rel IN ({pos}) OR rel IN ({neg})) AND {foods} AND dst_label IN ('Disease', 'Symptom')),
shown AS (SELECT step, target, item, max(s) AS s, list_sort(list_distinct(list(ev)))[1:3] AS l FROM steps GROUP BY step, target, item),
cand AS (SELECT t.user_id, t.plan, step, item, max(s) AS s, list_sort(list_distinct(flatten(list(l))))[1:3] AS l FROM targets t JOIN shown ON shown.target = t.target GROUP BY t.user_id, t.plan, step, item),
ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, step ORDER BY s DESC, item) AS rn FROM cand)
SELECT user_id, step, string_agg(item, ', ' ORDER BY rn) AS items, array_to_string([e[1] FOR e IN flatten(list(l ORDER BY rn))[1:3]], '; ') AS evidence FROM ranked WHERE rn <= CASE WHEN plan = 'free' THEN 3 ELSE 5 END GROUP BY user_id, step""",
        ),
        "symptom_relievers": (lambda p: recommend.symptom_items(p.edges, "ALLEVIATES").withColumn("evidence", sources("evidence")), SYMPTOM_ITEMS.format(rel="ALLEVIATES", listed=FIRST_5)),
        "symptom_aggravators": (lambda p: recommend.symptom_items(p.edges, "AGGRAVATES").withColumn("evidence", sources("evidence")), SYMPTOM_ITEMS.format(rel="AGGRAVATES", listed=FIRST_5)),
        "early_signal_guidance": (
            lambda p: recommend.early_signal_guidance(p.edges, p.users),
            f"""$users SELECT user_id, symptom, disease, n_evidence, strength, CAST(rank AS INTEGER) AS rank FROM (SELECT u.user_id, s.*, row_number() OVER (PARTITION BY u.user_id ORDER BY s.strength DESC, s.n_evidence DESC, s.symptom, s.disease) AS rank
FROM (SELECT DISTINCT user_id, lower(term) AS term FROM users WHERE term IS NOT NULL) u JOIN ({SIGNALS}) s ON s.symptom = u.term) WHERE rank <= 15""",
        ),
        "nearby_risks": (
            lambda p: recommend.nearby_risks(p.edges, p.users, p.nodes).withColumn("evidence", sources("evidence")),
            f"""$users, held AS (SELECT DISTINCT user_id, plan, lower(trim(term)) AS target FROM users WHERE term IS NOT NULL), symptoms AS (SELECT DISTINCT name FROM nodes WHERE label = 'Symptom'),
signals AS (SELECT src AS target, dst AS name, list_sort(list_distinct(list({RECORD})))[1][1] AS evidence FROM edges WHERE rel = 'EARLY_SIGNAL_OF' AND src_label = 'Symptom' AND dst_label = 'Disease' GROUP BY src, dst),
both_kinds AS (SELECT user_id, plan, s.name, 'early_signal' AS kind, 'Early signal: ' || h.target AS reason, evidence FROM held h JOIN signals s ON s.target = h.target WHERE h.target IN (SELECT name FROM symptoms)
  UNION ALL SELECT user_id, plan, target, 'disease', 'Current condition', '' FROM held WHERE target NOT IN (SELECT name FROM symptoms))
SELECT user_id, name, kind, reason, evidence, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY kind DESC, reason, name) AS rank FROM both_kinds) WHERE rank <= CASE WHEN plan = 'free' THEN 5 ELSE 30 END""",
        ),
        "food_chain": (
            lambda p: recommend.food_chain(p.edges).withColumns({c: sources(c) for c in ("contains_evidence", "effect_evidence")}),
            f""", h AS (SELECT src AS food, dst AS nutrient, count(DISTINCT source_id) AS contains_sources, {FIRST_5} AS contains_evidence FROM edges WHERE rel = 'CONTAINS' AND src_label = 'Food' AND dst_label = 'Nutrient' GROUP BY src, dst),
a AS (SELECT src AS nutrient, rel, dst AS target, count(DISTINCT source_id) AS effect_sources, {FIRST_5} AS effect_evidence FROM edges WHERE src_label = 'Nutrient' AND dst_label IN ('Disease', 'Symptom') GROUP BY src, rel, dst)
SELECT * EXCLUDE (rn) FROM (SELECT food, nutrient, rel, target, contains_sources, effect_sources, contains_evidence, effect_evidence, row_number() OVER (PARTITION BY food ORDER BY nutrient, rel, target) AS rn FROM h JOIN a USING (nutrient)) WHERE rn <= 50""",
        ),
        "mechanism_chains": (
            lambda p: recommend.mechanism_chains(p.edges).withColumns({c: sources(c) for c in ("target_evidence", "effect_evidence")}),
            f""", h AS (SELECT src AS item, dst AS mechanism, count(DISTINCT source_id) AS target_sources, {FIRST_5} AS target_evidence FROM edges WHERE rel = 'TARGETS_MECHANISM' AND {foods} GROUP BY src, dst),
l AS (SELECT src AS mechanism, rel, dst AS disease, count(DISTINCT source_id) AS effect_sources, {FIRST_5} AS effect_evidence FROM edges WHERE src_label = 'Mechanism' AND rel IN ('CAUSES', 'INCREASES_RISK_OF') AND dst_label = 'Disease' GROUP BY src, rel, dst)
SELECT mechanism, item, target_sources, target_evidence, rel, disease, effect_sources, effect_evidence FROM h JOIN l USING (mechanism)""",
        ),
        "age_guidance": (
            lambda p: recommend.age_guidance(p.edges).withColumn("evidence", sources("evidence")),
            f""", {AGING},
own AS (SELECT src AS change, coalesce(max(dst) FILTER (rel = 'OCCURS_AT'), '') AS life_stage, array_to_string([e[1] FOR e IN list_sort(list_distinct(list({RECORD})))[1:3]], '; ') AS evidence FROM aging GROUP BY src),
parts AS (SELECT change, string_agg(v, '; ' ORDER BY v) AS why FROM (SELECT DISTINCT src AS change, CASE WHEN rel = 'MODIFIABLE_BY' THEN 'Modifiable by ' || dst ELSE context END AS v FROM aging WHERE rel <> 'OCCURS_AT') GROUP BY change)
SELECT change, life_stage, coalesce(why, 'Diet and exercise matter for this change.') AS why, evidence FROM own LEFT JOIN parts USING (change)""",
        ),
    }
