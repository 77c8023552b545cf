"""Registered queries on people: texts read into contexts, their completeness and changes, with their DuckDB twins.

Each entry is (operator applied to the projected tables, SQL on the given tables).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import intake, users
from .plans import fixtures


def _quoted(v: str | None) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'"


def _re2(pattern: str) -> str:
    """A pattern whose borders hold for all scripts in an engine that only knows ASCII ones."""
    if pattern.startswith(r"\b"):
        pattern = r"(?:^|[^\p{L}\p{N}_])" + pattern[2:]
    return pattern[:-2] + r"(?:$|[^\p{L}\p{N}_])" if pattern.endswith(r"\b") else pattern


def _holds(pattern: str) -> str:
    return f"regexp_matches(t, {_quoted(_re2(pattern))})"


def _phrase(p: str) -> str:
    return _holds(rf"\b{p}\b") if p.isascii() else f"contains(t, {_quoted(p)})"


def _number(pattern: str) -> str:
    return f"try_cast(nullif(regexp_extract(t, {_quoted(_re2(pattern))}, 1), '') AS INTEGER)"


def _within(number: str, low: int) -> str:
    return f"CASE WHEN {number} BETWEEN {low} AND 120 THEN {number} END"


def _listed(tests: list[tuple[str, str]]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {test} THEN {_quoted(term)} END" for test, term in tests) + "], lambda x: x IS NOT NULL)"


def _once(column: str) -> str:
    return f"list_filter({column}, lambda x, i: list_position({column}, x) = i)"


def _case(tests: list[tuple[str, str]]) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {_quoted(value)}" for test, value in tests) + " END"


_FIELDS = ["conditions", "medications", "goals", "symptoms"]
_EXACT = "coalesce(" + ", ".join([*[_within(_number(p), 1) for p in intake.AGE_PATTERNS], _within(_number(intake.YEARS_PATTERN), 10)]) + ")"
_ROUGH = "coalesce(" + ", ".join(_within(f"({_number(p)} + {shift})", 10) for p, shift in intake.DECADE_PATTERNS) + ")"
_SAID = _case([(_phrase(w), g) for w, g in intake.GENDER_WORDS])
_SUPPOSED = _case([(_holds(p), g) for p, g in intake.GENDER_PRONOUNS])
_stated = {f: _listed([(_phrase(p), t) for p, g, t in intake.PHRASES if g == f]) for f in _FIELDS}
_topics = {f: _listed([(_holds(p), t) for p, g, t in intake.TOPICS if g == f]) for f in ("conditions", "goals")}
#: said: what each text states; seen: with what it lets one suppose; contexts: as the operator gives them.
CONTEXTS = f"""WITH {fixtures.intros_sql()},
said AS MATERIALIZED (SELECT conv_id, turn, {_EXACT} AS exact_age, {_ROUGH} AS rough_age, {_SAID} AS said_gender, {_SUPPOSED} AS supposed, {", ".join(f"{c} AS {f}_1" for f, c in _stated.items())}, {", ".join(f"{c} AS {f}_2" for f, c in _topics.items())}
  FROM (SELECT conv_id, turn, lower(text) AS t FROM intros)),
seen AS (SELECT conv_id, turn, coalesce(exact_age, rough_age) AS age, exact_age IS NULL AND rough_age IS NOT NULL AS age_fuzzy, coalesce(said_gender, supposed) AS gender, said_gender IS NULL AND supposed IS NOT NULL AS gender_fuzzy,
  {", ".join(f"{_once(f + '_1')} AS {f}" for f in _FIELDS)}, {", ".join(f"list_filter({_once(f + '_2')}, lambda x: NOT list_contains({f}_1, x)) AS more_{f}" for f in _topics)} FROM said)"""
_joined = lambda c: f"CASE WHEN len({c}) > 0 THEN array_to_string({c}, '; ') END"
CONTEXT_ROWS = f"""{CONTEXTS} SELECT conv_id || '-' || turn AS id, age, gender, {_joined("conditions || more_conditions")} AS conditions, {_joined("symptoms")} AS symptoms, {_joined("medications")} AS medications, {_joined("goals || more_goals")} AS goals,
  array_to_string(list_filter([CASE WHEN age_fuzzy THEN 'age' END, CASE WHEN gender_fuzzy THEN 'gender' END, CASE WHEN len(more_conditions) > 0 THEN 'conditions' END, CASE WHEN len(more_goals) > 0 THEN 'goals' END], lambda x: x IS NOT NULL), '; ') AS inferred FROM seen"""


def _question(key: str, value: str = "''") -> str:
    before, _, after = intake.QUESTIONS[key].partition("{}")
    return f"{_quoted(before)} || {value} || {_quoted(after)}"


FOLLOW_UPS = f"""{CONTEXTS}, asked AS (
  SELECT conv_id, turn, 1 AS place, 0 AS nth, 'age' AS field, {_question("age guessed", "age")} AS question, 'confirm' AS type, CAST(age AS VARCHAR) AS value, NULL AS hint, NULL AS options FROM seen WHERE age_fuzzy
  UNION ALL SELECT conv_id, turn, 1, 0, 'age', {_question("age")}, 'number', NULL, {_quoted(intake.HINTS["age"])}, NULL FROM seen WHERE age IS NULL
  UNION ALL SELECT conv_id, turn, 2, i, 'conditions', {_question("condition inferred", "more_conditions[i]")}, 'confirm', more_conditions[i], NULL, NULL FROM seen, unnest(range(1, len(more_conditions) + 1)) AS r(i)
  UNION ALL SELECT conv_id, turn, 3, 0, 'conditions', {_question("conditions")}, 'text', NULL, {_quoted(intake.HINTS["conditions"])}, NULL FROM seen WHERE len(conditions) + len(more_conditions) = 0
  UNION ALL SELECT conv_id, turn, 4, 0, 'gender', {_question("gender")}, 'select', NULL, NULL, {_quoted("|".join(intake.GENDER_OPTIONS))} FROM seen WHERE gender IS NULL)
SELECT conv_id || '-' || turn AS id, CAST(row_number() OVER (PARTITION BY conv_id, turn ORDER BY place, nth) AS INTEGER) AS pos, field, question, type, value, hint, options FROM asked"""

#: Phrases searched in all documents: whole words, and parts of words.
SEARCHED = [("of the", "phrase", "of the", True), ("that", "word", "that", True), ("para", "word", "para", True), ("de la", "phrase", "de la", True), ("tion", "part", "-tion-", False), ("é", "part", "e acute", False)]
TERMS = "SELECT doc_id AS id, kind, term FROM (SELECT doc_id, lower(text) AS t FROM documents), (VALUES " + ", ".join(f"({_quoted(p)}, {_quoted(k)}, {_quoted(n)}, {w})" for p, k, n, w in SEARCHED) + r""") AS s(phrase, kind, term, whole)
WHERE CASE WHEN whole THEN regexp_matches(t, '(?:^|[^\p{L}\p{N}_])' || phrase || '(?:$|[^\p{L}\p{N}_])') ELSE contains(t, phrase) END"""


def _intros(p) -> DataFrame:
    return fixtures.intros(p.spark, p.sf_dir).select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), "text")


def _context_rows(p) -> DataFrame:
    c = intake.context_from_text(_intros(p))
    return c.select("id", "age", "gender", *[F.array_join(f, "; ").alias(f) for f in ("conditions", "symptoms", "medications", "goals", "inferred")])


def _questions(p) -> DataFrame:
    q = intake.context_from_text(_intros(p)).select("id", F.posexplode("follow_up").alias("pos", "q"))
    return q.select("id", (F.col("pos") + 1).alias("pos"), "q.field", "q.question", "q.type", "q.value", "q.hint", F.array_join("q.options", "|").alias("options"))


def _terms_of_texts(p) -> DataFrame:
    phrases = p.spark.createDataFrame(SEARCHED, "phrase string, kind string, term string, whole boolean")
    return intake.terms_from_text(p.table("documents").select(F.col("doc_id").alias("id"), "text"), phrases)


def _inferred(p) -> DataFrame:
    none = F.array().cast("array<string>")
    found = _intros(p).select("id", *[intake.terms_inferred(F.col("text"), f, none).alias(f) for f in ("conditions", "goals")])
    return found.select("id", F.array_join("conditions", "; ").alias("conditions"), F.array_join("goals", "; ").alias("goals"))


def people(p) -> DataFrame:
    """Users as contexts: terms as conditions, the market segment as way of living, some answers by the user's number."""
    held = p.users.groupBy("user_id", "age", "gender").agg(F.array_sort(F.collect_set("term")).alias("conditions"))
    answers = F.array_compact(F.array(*[F.when(F.col("user_id") % m == 0, F.lit(a)) for m, a in ((2, "medications"), (3, "severity:x"), (4, "exercise"), (5, "lifestyle"))]))
    return held.withColumns({"age": F.when(F.col("age") % 7 > 0, F.col("age")).otherwise(0), "location": F.when(F.col("user_id") % 4 == 1, " ").otherwise(F.when(F.col("user_id") % 4 == 2, "here")), "answered": answers})


PEOPLE_SQL = f"""WITH {fixtures.DUCK_USERS}, people AS (SELECT user_id, CASE WHEN age % 7 > 0 THEN age ELSE 0 END AS age, gender, count(term) AS n FROM users GROUP BY ALL),
tests AS (SELECT user_id, age > 0 AS age, trim(gender) <> '' AS gender, n > 0 AS conditions, false AS symptoms, user_id % 2 = 0 AS medications, false AS goals, user_id % 4 = 2 OR user_id % 5 = 0 AS lifestyle, user_id % 3 = 0 AS severity, user_id % 4 = 0 AS exercise FROM people)
SELECT user_id, CAST({" + ".join(f"CASE WHEN {f} THEN {w} ELSE 0 END" for f, w in users.WEIGHTS.items())} AS INTEGER) AS score, array_to_string(list_filter([{", ".join(f"CASE WHEN NOT {f} THEN '{f}' END" for f in users.LISTED)}], lambda x: x IS NOT NULL), '; ') AS missing FROM tests"""


def saved(p) -> DataFrame:
    """Snapshots of a user with conditions: the types of the user's last three events each time."""
    from pyspark.sql.window import Window

    last = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 0)
    return p.table("events").select("user_id", "ts", F.col("event_id").alias("id"), F.array_sort(F.collect_set("event_type").over(last)).alias("conditions"))


SAVED = "saved AS (SELECT user_id, ts, event_id AS id, list_sort(list_distinct(list(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))) AS conditions FROM events)"


def _changes(p) -> DataFrame:
    return users.condition_diff(saved(p)).select("user_id", F.array_join(F.array_sort("added"), "; ").alias("added"), F.array_join(F.array_sort("removed"), "; ").alias("removed"))


def _merged(p) -> DataFrame:
    """A user's first event as base and last as patch."""
    e = p.table("events").groupBy("user_id").agg(*[f(F.struct(F.col("ts"), F.col("event_id"), F.col("event_type"), F.col("value"))).alias(n) for n, f in (("first", F.min), ("last", F.max))])
    side = lambda n, only: e.where(only).select("user_id", F.when(F.col(f"{n}.value") > 20, F.col(f"{n}.event_type")).otherwise("").alias("goal"), F.col(f"{n}.event_id").alias("seen"), F.array(f"{n}.event_type", F.lit("any")).alias("kinds"))
    got = users.merge_contexts(side("first", F.col("user_id") % 5 > 0), side("last", F.col("user_id") % 7 > 0), ["goal", "seen"], ["kinds"])
    return got.withColumn("kinds", F.array_join("kinds", "; "))


MERGED = """WITH e AS (SELECT user_id, arg_min(event_type, (ts, event_id)) AS t1, arg_min(value, (ts, event_id)) AS v1, arg_min(event_id, (ts, event_id)) AS i1, arg_max(event_type, (ts, event_id)) AS t2, arg_max(value, (ts, event_id)) AS v2, arg_max(event_id, (ts, event_id)) AS i2 FROM events GROUP BY 1),
a AS (SELECT user_id, CASE WHEN v1 > 20 THEN t1 ELSE '' END AS goal, i1 AS seen, [t1, 'any'] AS kinds FROM e WHERE user_id % 5 > 0), b AS (SELECT user_id, CASE WHEN v2 > 20 THEN t2 ELSE '' END AS goal, i2 AS seen, [t2, 'any'] AS kinds FROM e WHERE user_id % 7 > 0)
SELECT user_id, coalesce(nullif(b.goal, ''), a.goal) AS goal, coalesce(b.seen, a.seen) AS seen, array_to_string(coalesce(a.kinds, []) || list_filter(coalesce(b.kinds, []), lambda x: NOT list_contains(coalesce(a.kinds, []), x)), '; ') AS kinds FROM a FULL JOIN b USING (user_id)"""

PEOPLE: dict[str, tuple[Callable, str]] = {
    "context_from_text": (_context_rows, CONTEXT_ROWS),
    "follow_ups": (_questions, FOLLOW_UPS),
    "terms_inferred": (_inferred, f"{CONTEXTS} SELECT conv_id || '-' || turn AS id, array_to_string({_once('conditions_2')}, '; ') AS conditions, array_to_string({_once('goals_2')}, '; ') AS goals FROM said"),
    "age_from_text": (lambda p: _intros(p).select("id", intake.age_from_text(F.col("text")).alias("a")).select("id", "a.age", "a.fuzzy"), f"{CONTEXTS} SELECT conv_id || '-' || turn AS id, age, age_fuzzy AS fuzzy FROM seen"),
    "gender_from_text": (lambda p: _intros(p).select("id", intake.gender_from_text(F.col("text")).alias("g")).select("id", "g.gender", "g.fuzzy"), f"{CONTEXTS} SELECT conv_id || '-' || turn AS id, gender, gender_fuzzy AS fuzzy FROM seen"),
    "terms_from_text": (_terms_of_texts, TERMS),
    "completeness_score": (lambda p: users.completeness_score(people(p)).withColumn("missing", F.array_join("missing", "; ")), PEOPLE_SQL),
    "condition_diff": (
        _changes,
        f"WITH {SAVED} SELECT user_id, array_to_string(list_sort(list_filter(conditions, lambda x: NOT list_contains(was, x))), '; ') AS added, array_to_string(list_sort(list_filter(was, lambda x: NOT list_contains(conditions, x))), '; ') AS removed FROM (SELECT *, lag(conditions) OVER w AS was, lead(id) OVER w AS after FROM saved WINDOW w AS (PARTITION BY user_id ORDER BY ts, id)) WHERE after IS NULL AND was IS NOT NULL",
    ),
    "merge_contexts": (_merged, MERGED),
}
