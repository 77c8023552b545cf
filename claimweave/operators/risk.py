"""Risk profiles matched to users, their enrichment from the graph, insights, inferred conditions and questions.

Profiles are a long table (disease, kind, factor) with kind factor, trigger, warning or route; users are
(user_id, age, gender, plan, term) with one row per term.  A user and a disease without any match have no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import vocab
from .audit import NEG, POS
from .recommend import per_user
from .users import health_score, holding

OLDEST = 150
#: Regions of the map by words of the conditions, the first that fits.
TERRITORIES = [
    ("Metabolic Crossroads", "diabetes|blood sugar|insulin|glucose|metabolic"), ("Cardiometabolic Ridge", "hypertension|heart|cardiovascular|cholesterol|pressure"),
    ("Inflammatory Plains", "inflamm|arthritis|autoimmune|lupus|depression|mood"), ("Musculoskeletal Valley", "sarcopenia|osteoporosis|muscle|bone|joint"),
    ("Neurological Frontier", "neuro|cognitive|alzheimer|parkinson|dementia"), ("Recovery Valley", "stroke|cerebro|brain ischemia"), ("Metabolic Crossroads", "kidney|renal|ckd"),
]
#: Fixed values: (place, least age, held condition, likely condition); either test is enough.
LIKELY = [
    (1, 50, None, "osteoporosis"), (2, 60, None, "sarcopenia"), (3, 65, None, "alzheimer's disease"), (3, None, "type 2 diabetes", "alzheimer's disease"),
    (4, None, "hypertension", "stroke"), (4, None, "cardiovascular disease", "stroke"),
]


def likely_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LIKELY, "pos int, min_age int, needs string, name string")


def _held(users: DataFrame) -> DataFrame:
    return users.where(F.col("term").isNotNull()).select("user_id", F.lower(F.trim("term")).alias("term")).distinct()


def _by_age(rules: DataFrame, users: DataFrame) -> DataFrame:
    """Users of at least rules.min_age: each rule is spread over the ages it covers, so the join is an equality."""
    ages = rules.where(F.col("min_age").between(1, OLDEST)).withColumn("age", F.explode(F.sequence("min_age", F.lit(OLDEST))))
    return ages.join(users.select("user_id", "age").distinct(), "age").drop("age")


def _formed(df: DataFrame, column: str, names: DataFrame | None) -> DataFrame:
    """df with the column in the vocabulary's form, in lower case."""
    return df if names is None else vocab.canonical_names(df, [column], names).withColumn(column, F.lower(column))


def risk_factor_match(profiles: DataFrame, users: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """user_id, disease, factor: the factor is a part of a held term, its form is that term, or it names an age ("age 65+") that the user has reached.

    names (key, canonical) gives the forms of held terms and factors.  Parts are found once per distinct term, by the rarest gram.
    """
    factors = profiles.where(F.col("kind") == "factor").select("disease", "factor", F.lower(F.trim("factor")).alias("key")).where(F.col("key") != "")
    held = _formed(_held(users), "term", names).where(F.col("term") != "").distinct()
    keys = factors.select("key").distinct()
    pairs = holding(keys.select(F.col("key").alias("inner")), held.select(F.col("term").alias("outer"))).select(F.col("outer").alias("term"), F.col("inner").alias("key"))
    if names is not None:
        pairs = pairs.unionByName(_formed(keys.withColumn("term", F.col("key")), "term", names).select("term", "key")).distinct()
    by_term = held.join(pairs, "term").join(factors, "key").select("user_id", "disease", "factor")
    aged = factors.where(F.col("key").contains("age ")).withColumn("min_age", F.expr("try_cast(regexp_replace(key, '[^0-9]', '') AS INT)"))
    return by_term.unionByName(_by_age(aged, users).select("user_id", "disease", "factor")).distinct()


def risk_level(triggered: Column, n: Column) -> Column:
    return F.when(triggered | (n >= 3), "high").when(n == 2, "medium").when(n == 1, "low").otherwise("none")


def risk_board(profiles: DataFrame, users: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """user_id, disease, level, present, missing: factors counted; a held trigger makes the level high."""
    total = profiles.where(F.col("kind") == "factor").groupBy("disease").agg(F.count_distinct("factor").alias("total"))
    present = risk_factor_match(profiles, users, names).groupBy("user_id", "disease").agg(F.count("*").alias("present"))
    triggers = _formed(profiles.where(F.col("kind") == "trigger").select("disease", F.lower(F.trim("factor")).alias("term")), "term", names)
    fired = _formed(_held(users), "term", names).join(triggers, "term").select("user_id", "disease", F.lit(True).alias("fired")).distinct()
    n = F.coalesce("present", F.lit(0))
    board = present.join(fired, ["user_id", "disease"], "full_outer").join(total, "disease", "left")
    return board.select("user_id", "disease", risk_level(F.coalesce("fired", F.lit(False)), n).alias("level"), n.cast("bigint").alias("present"), (F.coalesce("total", F.lit(0)) - n).cast("bigint").alias("missing"))


def enrich_profiles(profiles: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """profiles with the graph's most frequent factors, warnings and routes of each disease, k of each kind.

    Factors and warnings are added where new, letter case aside.  Two routes or more take the place of those listed.
    """
    e = edges.where((F.col("dst_label") == "Disease") & (F.trim("source_id") != ""))
    kind = (
        F.when((F.col("src_label") == "Disease") & F.col("rel").isin("INCREASES_RISK_OF", "CAUSES"), "factor")
        .when((F.col("src_label") == "Symptom") & (F.col("rel") == "EARLY_SIGNAL_OF"), "warning")
        .when(F.col("src_label").isin("Food", "Nutrient", "LifestyleFactor") & F.col("rel").isin(POS), "route")
    )
    name = F.when(F.col("kind") == "route", F.concat("src", F.lit(" "), F.lower(F.replace("rel", F.lit("_"), F.lit(" "))))).otherwise(F.col("src"))
    seen = e.withColumn("kind", kind).where(F.col("kind").isNotNull()).groupBy(F.col("dst").alias("disease"), "kind", name.alias("factor")).agg(F.count("*").alias("n"))
    top = seen.withColumn("rank", F.row_number().over(Window.partitionBy("disease", "kind").orderBy(F.desc("n"), "factor"))).where(F.col("rank") <= k)
    known = profiles.select("disease", "kind", F.lower("factor").alias("key")).distinct()
    keyed = top.join(profiles.select("disease").distinct(), "disease", "left_semi").withColumn("key", F.lower("factor"))
    several = top.where((F.col("kind") == "route") & (F.col("rank") == 2)).select("disease", "kind")
    kept = profiles.join(several, ["disease", "kind"], "left_anti").select("disease", "kind", "factor")
    fresh = keyed.join(known.join(several, ["disease", "kind"], "left_anti"), ["disease", "kind", "key"], "left_anti").select("disease", "kind", "factor")
    return kept.unionByName(fresh)


def insights(edges: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, kind, target, item, n, rank: five protective items, three to avoid and five early signals a user."""
    item = F.col("src_label").isin("Food", "Nutrient") & (F.col("dst_label") == "Disease")
    views = [
        ("protective", edges.where(item & F.col("rel").isin(POS)), "dst", "src", 5, ("-strength", "-n", "item", "target")),
        ("avoidance", edges.where(item & F.col("rel").isin(NEG)), "dst", "src", 3, ("-n", "item", "target")),
        ("signal", edges.where((F.col("src_label") == "Symptom") & (F.col("dst_label") == "Disease") & (F.col("rel") == "EARLY_SIGNAL_OF")), "src", "dst", 5, ("-n", "item", "target")),
    ]
    out = None
    for kind, e, target, other, k, order in views:
        g = e.groupBy(F.col(target).alias("target"), F.col(other).alias("item")).agg(F.count("*").alias("n"), F.max("evidence_strength").alias("strength"))
        part = per_user(g, users, k, *order).select("user_id", F.lit(kind).alias("kind"), "target", "item", "n", "rank")
        out = part if out is None else out.unionByName(part)
    return out


def inferred_conditions(found: DataFrame, users: DataFrame, rules: DataFrame, k: int = 4) -> DataFrame:
    """user_id, name, rank: the signals among a user's insights, then the rules; held conditions are left out."""
    held = _held(users)
    signals = found.where(F.col("kind") == "signal").select("user_id", F.col("item").alias("name"), F.lit(0).alias("grade"), F.col("rank").alias("pos"))
    ruled = _by_age(rules, users).select("user_id", "name", "pos").unionByName(rules.where(F.col("needs").isNotNull()).join(held.withColumnRenamed("term", "needs"), "needs").select("user_id", "name", "pos"))
    first = signals.unionByName(ruled.withColumn("grade", F.lit(1))).groupBy("user_id", "name").agg(F.min(F.struct("grade", "pos")).alias("at"))
    new = first.join(held.withColumnRenamed("term", "name"), ["user_id", "name"], "left_anti")
    return new.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("at", "name"))).where(F.col("rank") <= k).drop("at")


def open_checks(board: DataFrame, checks: DataFrame, answered: DataFrame, k: int = 2) -> DataFrame:
    """user_id, disease, check_id, remaining: the first unanswered check (disease, pos, check_id) of k diseases at high or medium risk.

    remaining counts all of a user's unanswered checks.  Checks are numbered and counted per disease, and users meet the numbers of
    those alone that they answered: what is open is the rest, and the first open one the first number that is missing.
    """
    at_risk = board.where(F.col("level").isin("high", "medium")).select("user_id", "disease", "level")
    numbered = checks.select("disease", "check_id", F.row_number().over(Window.partitionBy("disease").orderBy("pos", "check_id")).alias("number"))
    total = checks.groupBy("disease").agg(F.count("*").alias("total"))
    done = at_risk.select("user_id", "disease").distinct().join(answered.select("user_id", "check_id").distinct(), "user_id").join(numbered, ["disease", "check_id"])
    done = done.groupBy("user_id", "disease").agg(F.array_sort(F.collect_list("number")).alias("done"))
    left = at_risk.join(total, "disease").join(done, ["user_id", "disease"], "left").withColumn("done", F.coalesce("done", F.array().cast("array<int>")))
    left = left.withColumn("open", F.col("total") - F.size("done")).where(F.col("open") > 0)
    # Numbers are distinct and sorted, so those that stand at their own place are the ones before the first gap.
    first = left.withColumn("number", F.size(F.filter("done", lambda x, i: x == i + 1)) + 1)
    own = Window.partitionBy("user_id")
    w = own.orderBy(F.when(F.col("level") == "high", 0).otherwise(1), "disease")
    ranked = first.select("user_id", "disease", "number", F.sum("open").over(own).alias("remaining"), F.row_number().over(w).alias("rank")).where(F.col("rank") <= k)
    return ranked.join(numbered, ["disease", "number"]).select("user_id", "disease", "check_id", "remaining", "rank")


def alike(users: DataFrame) -> DataFrame:
    """user_id, like: the smallest user_id of those with the same ages and terms."""
    own = users.groupBy("user_id").agg(F.to_json(F.array_sort(F.collect_set(F.struct("age", "term")))).alias("context"))
    return own.join(own.groupBy("context").agg(F.min("user_id").alias("like")), "context").select("user_id", "like")


def open_checks_of(profiles: DataFrame, users: DataFrame, checks: DataFrame, names: DataFrame | None = None, k: int = 2) -> DataFrame:
    """open_checks on the risk board of users, who have answered the checks that are terms of theirs.

    Users of the same ages and terms have the same board, so it is made for one of them.
    """
    like = alike(users)
    some = users.join(like.where(F.col("user_id") == F.col("like")), "user_id", "left_semi")
    found = open_checks(risk_board(profiles, some, names), checks, some.select("user_id", F.col("term").alias("check_id")), k)
    return like.join(found.withColumnRenamed("user_id", "like"), "like").select("user_id", "disease", "check_id", "remaining", "rank")


def next_questions(users: DataFrame, inferred: DataFrame, answered: DataFrame, k: int = 3) -> DataFrame:
    """user_id, question, rank: fields to fill (age, conditions, gender), then inferred conditions to confirm, without those answered (user_id, question)."""
    one = users.groupBy("user_id").agg(F.max("age").alias("age"), F.max("gender").alias("gender"), F.count("term").alias("terms"))
    ask = lambda test, p, field: F.when(test, F.struct(F.lit(p).alias("p"), F.lit(field).alias("question")))
    asks = F.array_compact(F.array(ask(F.col("age").isNull(), 1, "age"), ask(F.col("terms") == 0, 2, "conditions"), ask(F.coalesce("gender", F.lit("")) == "", 3, "gender")))
    fields = one.select("user_id", F.inline(asks))
    confirm = inferred.select("user_id", (F.col("rank") + 3).alias("p"), F.concat(F.lit("confirm:"), "name").alias("question"))
    asked = fields.unionByName(confirm).groupBy("user_id", "question").agg(F.min("p").alias("p")).join(answered, ["user_id", "question"], "left_anti")
    return asked.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy("p", "question"))).where(F.col("rank") <= k).drop("p")


def territory(conditions: Column) -> Column:
    """Region of the map for an array of conditions, empty if none fits."""
    t, out = F.lower(F.array_join(conditions, " ")), None
    for name, words in TERRITORIES:
        out = F.when(t.rlike(words), name) if out is None else out.when(t.rlike(words), name)
    return out.otherwise("")


def risk_severity(kind: Column, n_evidence: Column) -> Column:
    disease = F.lower(F.coalesce(kind, F.lit(""))) == "disease"
    return F.when(disease & (n_evidence >= 2), "high").when(disease | (n_evidence >= 1), "med").otherwise("low")


def persona_code(snapshots: DataFrame, conditions: DataFrame) -> DataFrame:
    """user_id, persona: V or G by score, S or C by number of conditions (user_id, n), A, D or S by the last step of the score."""
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("id"))
    s = snapshots.where(F.col("y").isNotNull()).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= 2)
    score = health_score(F.col("y"))
    g = s.groupBy("user_id").agg(F.max(F.when(F.col("rn") == 1, score)).alias("now"), F.max(F.when(F.col("rn") == 2, score)).alias("before")).join(conditions, "user_id", "left")
    step = F.coalesce(F.col("now") - F.col("before"), F.lit(0))
    return g.select("user_id", F.concat(F.when(F.col("now") >= 60, "V").otherwise("G"), F.when(F.coalesce("n", F.lit(0)) <= 1, "S").otherwise("C"), F.when(step > 2, "A").when(step < -2, "D").otherwise("S")).alias("persona"))
