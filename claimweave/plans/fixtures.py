"""Projection of the given tables to claims, users, snapshots and logs, in Spark and in DuckDB SQL.

The tables hold no claims, so one line item becomes one noisy raw claim; the SQL text is the same for
both engines but for the function that finds a blank.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import vocab

RAW = """
SELECT CASE l_linenumber % 3 WHEN 0 THEN upper(s.name) WHEN 1 THEN s.name ELSE concat(' ', s.name, ' ') END AS subject,
  CASE WHEN l_suppkey % 37 = 0 THEN 'Task' ELSE s.raw_type END AS subject_type,
  CASE WHEN o.cls = 'Nutrient' AND s.cls = 'Food' AND NOT s.bare AND NOT o.bare THEN 'contains' WHEN s.cls = 'Biomarker' AND o.cls = 'Disease' AND NOT o.bare THEN 'marker for'
       WHEN s.cls = 'Symptom' AND o.cls = 'Disease' AND NOT s.bare THEN 'early-signal-of'
       WHEN s.cls = 'AgeRelatedChange' THEN CASE l_orderkey % 3 WHEN 0 THEN 'occurs at' WHEN 1 THEN 'explains-why' ELSE 'MODIFIABLE_BY' END
       WHEN o.bare AND o.cls = 'Disease' THEN 'promotes' WHEN o.bare THEN 'treats'
       WHEN o.cls = 'Microbiome' THEN 'enriches' WHEN o.cls = 'Metabolite' THEN 'generates'
       WHEN o.cls = 'Biomarker' THEN CASE l_orderkey % 2 WHEN 0 THEN 'INCREASES_BIOMARKER' ELSE 'decreases biomarker' END
       WHEN o.cls = 'Mechanism' THEN 'inhibits'
       WHEN o.cls = 'Drug' THEN CASE l_orderkey % 3 WHEN 0 THEN 'COMPLEMENTS_DRUG' WHEN 1 THEN 'substitutes for' ELSE 'CONTRAINDICATED_WITH' END
       ELSE CASE l_orderkey % 10 WHEN 0 THEN 'prevents' WHEN 1 THEN 'TREATS' WHEN 2 THEN 'improves' WHEN 3 THEN 'REDUCES_RISK_OF' WHEN 4 THEN 'worsens' WHEN 5 THEN 'CAUSES'
            WHEN 6 THEN 'promotes' WHEN 7 THEN 'AFFECTS' WHEN 8 THEN 'linked to' ELSE 'alleviates' END END AS predicate,
  o.name AS object, CASE WHEN l_orderkey % 211 = 0 THEN 'study' ELSE o.raw_type END AS object_type,
  CASE WHEN l_partkey % 41 = 0 THEN '' ELSE concat(CASE l_returnflag WHEN 'R' THEN 'A randomized controlled trial of ' WHEN 'A' THEN 'A prospective cohort of ' ELSE 'Notes on ' END, o.name) END AS context,
  CASE WHEN l_orderkey % 53 = 0 THEN '' ELSE concat('PMC', CAST(l_orderkey AS STRING)) END AS source_id,
  CASE l_suppkey % 11 WHEN 0 THEN 'FDA' WHEN 1 THEN ' drug_label ' ELSE '' END AS source_type,
  CASE WHEN l_suppkey % 7 = 0 THEN '' ELSE concat('Journal ', CAST(l_suppkey % 20 AS STRING)) END AS journal,
  substr(CAST(l_shipdate AS STRING), 1, 10) AS pub_date,
  CASE l_linestatus WHEN 'O' THEN '' ELSE CASE l_linenumber % 4 WHEN 0 THEN 'RCT' WHEN 1 THEN 'meta_analysis' WHEN 2 THEN 'cohort' ELSE 'review' END END AS evidence_type
FROM lineitem JOIN ent s ON s.p_partkey = l_partkey JOIN ent o ON o.p_partkey = (l_orderkey * 7 + l_suppkey * 13 + l_linenumber) % (SELECT n FROM np)
"""
#: Kinds by the last word of a part's name and the last digit of its brand; a bare entity lacks the edges that gaps ask for.
ENT = """
SELECT p_partkey, concat(p_name, ' ', replace(p_brand, 'Brand#', 'b')) AS name, p_brand IN ('Brand#2', 'Brand#5', 'Brand#13', 'Brand#15', 'Brand#22', 'Brand#25') AS bare,
  CASE word WHEN 'plate' THEN 'food' WHEN 'widget' THEN CASE WHEN digit IN ('1', '3') THEN 'Physical Activity' ELSE 'Dietary Pattern' END WHEN 'ring' THEN 'vitamin' WHEN 'rod' THEN 'Medical Condition'
    WHEN 'bolt' THEN CASE digit WHEN '4' THEN 'age related change' ELSE 'Symptom' END WHEN 'gear' THEN 'drug/treatment'
    WHEN 'gizmo' THEN CASE digit WHEN '2' THEN 'gut bacteria' WHEN '3' THEN 'scfa' ELSE 'lab-value' END ELSE 'process' END AS raw_type,
  CASE word WHEN 'plate' THEN 'Food' WHEN 'widget' THEN CASE WHEN digit IN ('1', '3') THEN 'LifestyleFactor' ELSE 'Food' END WHEN 'ring' THEN 'Nutrient' WHEN 'rod' THEN 'Disease'
    WHEN 'bolt' THEN CASE digit WHEN '4' THEN 'AgeRelatedChange' ELSE 'Symptom' END WHEN 'gear' THEN 'Drug'
    WHEN 'gizmo' THEN CASE digit WHEN '2' THEN 'Microbiome' WHEN '3' THEN 'Metabolite' ELSE 'Biomarker' END ELSE 'Mechanism' END AS cls
FROM (SELECT p_partkey, p_name, p_brand, substr(p_name, {pos} + 1) AS word, substr(p_brand, length(p_brand), 1) AS digit FROM part) AS parts
"""
#: A name map: entities of two brands are spellings of those of the next brand.
NAMES = """
SELECT DISTINCT lower(concat(p_name, ' ', replace(p_brand, 'Brand#', 'b'))) AS key, concat(p_name, CASE p_brand WHEN 'Brand#10' THEN ' b11' ELSE ' b21' END) AS canonical FROM part WHERE p_brand IN ('Brand#10', 'Brand#20')
"""
#: The number of parts is a scalar subquery, so that both joins stay joins by equality.
_WITH = "WITH ent AS ({ent}), np AS (SELECT count(*) AS n FROM part)"


def raw_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("lineitem", "part")}
    text = _WITH.format(ent=ENT.format(pos="instr(p_name, ' ')").replace("FROM part", "FROM {part}")).replace("(SELECT count(*) AS n FROM part)", "(SELECT count(*) AS n FROM {part})")
    return spark.sql(text + RAW.replace("FROM lineitem", "FROM {lineitem}"), **tables)


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ENT.format(pos="instr(p_name, ' ')").replace("FROM part)", "FROM {part})"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NAMES.replace("FROM part", "FROM {part}"), part=spark.read.parquet(f"{sf_dir}/part.parquet"))


#: Openings of self-descriptions, dealt over the turns of conversations, whose whole texts follow.
OPENINGS = [
    "I'm 45 years old and a woman with type 2 diabetes", "In my early 50s, she has high blood pressure", "I am 130, almost 60, with weak bones", "For 45 years my heart was fine", "저는 52살 여성이고 전당뇨와 두통이 있어요",
    "40대 중반 남성, 고혈압, 체중 감량 중", "About 500 people, around 72", "Trying to lose weight; blood sugar is high", "He takes metformin and aspirin, joint pain and brain fog", "male, age 0, mid-40s, pre-diabetes",
    "Turned 61, tirzepatide, weight_management", "nonbinary, 33 y.o., insomnia and stress", "근력이 약해요, 혈당 관리, 아스피린, 나이 70", "type 2 diabetes mellitus and muscle loss, live longer", "Headaches, headache, fatigue; manage the pressure",
    "만 35세, 골다공증", "a 67-year-old man with cvds and ldl", "nothing to say", "pre diabetics in my 60s, mounjaro, longevity", "lower\nblood pressure, late 30s, her bone density",
]


def intros(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, text: every turn of the conversations behind an opening."""
    from pyspark.sql import functions as F

    t = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    opening = F.array(*map(F.lit, OPENINGS))[F.pmod(F.coalesce("conv_id", F.lit(0)) * 7 + F.coalesce("turn", F.lit(0)), F.lit(len(OPENINGS))).cast("int")]
    return t.select("conv_id", "turn", F.concat(opening, F.lit(". "), F.coalesce("text", F.lit(""))).alias("text"))


def intros_sql() -> str:
    listed = ", ".join("'" + o.replace("'", "''") + "'" for o in OPENINGS)
    return f"intros AS MATERIALIZED (SELECT conv_id, turn, [{listed}][1 + (coalesce(conv_id, 0) * 7 + coalesce(turn, 0)) % {len(OPENINGS)}] || '. ' || coalesce(text, '') AS text FROM conversations)"


def _case(key: str, table: dict, default: str) -> str:
    value = lambda v: str(v) if isinstance(v, int) else f"'{v}'"
    return f"CASE {key} " + " ".join(f"WHEN '{k}' THEN {value(v)}" for k, v in table.items()) + f" ELSE {default} END"


def _in(words: list[str]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def _type_sql(c: str) -> str:
    t, key, plain = f"trim(coalesce({c}, ''))", f"lower(translate(trim(coalesce({c}, '')), ' -', '__'))", f"translate(trim(coalesce({c}, '')), ' /', '__')"
    rest = f"upper(substr({plain}, 1, 1)) || substr({plain}, 2)"
    return f"CASE WHEN {t} = '' THEN 'Thing' WHEN {t} IN {_in(vocab.ENTITY_TYPES)} THEN {t} WHEN {key} IN {_in(vocab.REJECT_TYPES)} THEN NULL ELSE {_case(key, vocab.TYPE_ALIASES, rest)} END"


def _predicate_sql(c: str) -> str:
    p = f"translate(upper(trim(coalesce({c}, ''))), ' -', '__')"
    return f"CASE WHEN {p} IN {_in(vocab.PREDICATES)} THEN {p} ELSE {_case(p, vocab.PREDICATE_ALIASES, chr(39) + 'RELATES_TO' + chr(39))} END"


def _vague_sql(c: str) -> str:
    k = f"lower(trim(coalesce({c}, '')))"
    return f"CASE WHEN {k} = '' THEN true WHEN {k} IN {_in(vocab.ABBREVIATIONS)} THEN false WHEN length({k}) < 3 THEN true ELSE {k} IN {_in(vocab.VAGUE_NAMES)} END"


def _strength_sql(c: str) -> str:
    k = f"lower(trim(coalesce({c}, '')))"
    return _case(k, vocab.STRENGTHS, _case(f"replace({k}, '_', ' ')", vocab.STRENGTHS, "1"))


def infer_sql(c: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(lower({c}), '{p}') THEN '{k}'" for p, k in vocab.EVIDENCE_PATTERNS) + " END"


def base_sql() -> str:
    """WITH list (without the word) up to nodes and edges, for DuckDB; materialised, or each use would inline it anew."""
    return f"""WITH ent AS MATERIALIZED ({ENT.format(pos="strpos(p_name, ' ')")}), np AS MATERIALIZED (SELECT count(*) AS n FROM part), raw AS MATERIALIZED ({RAW}),
names AS MATERIALIZED ({NAMES}),
norm AS MATERIALIZED (SELECT coalesce(ns.canonical, trim(subject)) AS subject, coalesce({_type_sql("subject_type")}, 'Thing') AS subject_type, {_predicate_sql("predicate")} AS predicate, coalesce(no.canonical, trim(object)) AS object,
  coalesce({_type_sql("object_type")}, 'Thing') AS object_type, context, source_id, coalesce(nullif(trim(source_type), ''), 'PMC') AS source_type, journal, pub_date, trim(evidence_type) AS evidence_type
  FROM raw LEFT JOIN names ns ON ns.key = lower(trim(subject)) LEFT JOIN names no ON no.key = lower(trim(object))),
claims AS MATERIALIZED (SELECT *, CASE WHEN trim(source_id) = '' THEN 'missing source_id' WHEN trim(context) = '' THEN 'missing context' WHEN {_vague_sql("subject")} THEN 'vague subject' WHEN {_vague_sql("object")} THEN 'vague object'
  WHEN predicate IN {_in(vocab.WEAK_PREDICATES)} THEN 'low-value predicate' WHEN lower(subject_type) IN {_in(vocab.REJECT_TYPES)} THEN 'rejected subject_type' WHEN subject_type NOT IN {_in(vocab.ENTITY_TYPES)} THEN 'unknown subject_type'
  WHEN lower(object_type) IN {_in(vocab.REJECT_TYPES)} THEN 'rejected object_type' WHEN object_type NOT IN {_in(vocab.ENTITY_TYPES)} THEN 'unknown object_type' END AS reject_rule FROM norm),
valid AS MATERIALIZED (SELECT *, CAST({_strength_sql("evidence_type")} AS INTEGER) AS evidence_strength FROM claims WHERE reject_rule IS NULL),
edges AS MATERIALIZED (SELECT * EXCLUDE (rn) FROM (SELECT subject_type AS src_label, lower(subject) AS src, predicate AS rel, object_type AS dst_label, lower(object) AS dst, source_id, context, source_type, journal, pub_date, evidence_type, evidence_strength,
  row_number() OVER (PARTITION BY subject_type, lower(subject), predicate, object_type, lower(object), source_id ORDER BY pub_date DESC, context DESC, journal DESC, evidence_type DESC, evidence_strength DESC, source_type DESC) AS rn FROM valid) WHERE rn = 1),
ends AS MATERIALIZED (SELECT subject_type AS label, lower(subject) AS name, subject AS display_name FROM valid UNION ALL SELECT object_type, lower(object), object FROM valid),
nodes AS MATERIALIZED (SELECT label, name, max(display_name) AS display_name FROM ends GROUP BY label, name)"""


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, age, gender, plan, term: a row per disease or symptom of a user, a null term for users without any."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "part")}
    return spark.sql(USERS.format(customer="{customer}", part="{part}", ent=ENT.format(pos="instr(p_name, ' ')").replace("FROM part", "FROM {part}")), **tables)


USERS = """
WITH ent AS ({ent}), np AS (SELECT count(*) AS n FROM {part}),
keys AS (SELECT c_custkey, (c_custkey * 3) % (SELECT n FROM np) AS k FROM {customer} WHERE c_custkey % 10 <> 0 UNION ALL SELECT c_custkey, (c_custkey * 11) % (SELECT n FROM np) FROM {customer} WHERE c_custkey % 10 <> 0),
picked AS (SELECT c_custkey, e.name, e.cls FROM keys JOIN ent e ON e.p_partkey = k WHERE e.cls IN ('Disease', 'Symptom')),
t AS (SELECT DISTINCT c_custkey, lower(name) AS name FROM picked)
SELECT CAST(c.c_custkey AS BIGINT) AS user_id, CAST(20 + c.c_custkey % 60 AS INT) AS age, CASE c.c_custkey % 3 WHEN 0 THEN 'female' WHEN 1 THEN 'M' ELSE '' END AS gender,
  CASE WHEN c.c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'paid' ELSE 'free' END AS plan, t.name AS term
FROM {customer} c LEFT JOIN t ON t.c_custkey = c.c_custkey
"""
DUCK_USERS = "users AS (" + USERS.format(customer="customer", part="part", ent=ENT.format(pos="strpos(p_name, ' ')")) + ")"
