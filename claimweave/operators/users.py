"""Users over time: position, zones, trajectories and completeness; logs of demand and yield; term search."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .intake import terms_from_text

#: Weights of the parts of a context.
WEIGHTS = {"age": 15, "gender": 5, "conditions": 25, "symptoms": 10, "medications": 10, "goals": 10, "lifestyle": 10, "severity": 10, "exercise": 5}


#: Fields that a context lacks are listed in this order; what an answer alone gives is not.
LISTED = ["age", "gender", "conditions", "symptoms", "medications", "goals", "lifestyle"]


def completeness_score(contexts: DataFrame) -> DataFrame:
    """user_id, score (0 to 100), missing: weights of what a context holds or has answered, and the fields it lacks.

    Columns that contexts have not count as empty, and so do an age of 0, empty texts and empty lists.  Way of living or location
    stand for lifestyle.  `answered` lists fields said to be empty, and "severity:..." and "exercise", which only answers give.
    """
    kinds = dict(contexts.dtypes)

    def has(c: str) -> Column:
        if c not in kinds:
            return F.lit(False)
        if kinds[c].startswith("array"):
            return F.coalesce(F.size(c) > 0, F.lit(False))
        return F.coalesce(F.col(c) > 0 if c == "age" else F.trim(F.col(c).cast("string")) != "", F.lit(False))

    said = (lambda test: F.coalesce(F.exists("answered", test), F.lit(False))) if "answered" in kinds else (lambda test: F.lit(False))
    answer = lambda f: said(lambda a: a == f)
    tests = {f: has(f) for f in WEIGHTS} | {"medications": has("medications") | answer("medications"), "exercise": answer("exercise"), "severity": said(lambda a: a.startswith("severity:"))}
    tests["lifestyle"] = has("way_of_living") | has("location") | answer("lifestyle")
    score = sum((F.when(t, WEIGHTS[f]).otherwise(0) for f, t in tests.items()), F.lit(0))
    return contexts.select("user_id", F.least(F.lit(100), score).alias("score"), F.array_compact(F.array(*[F.when(~tests[f], F.lit(f)) for f in LISTED])).alias("missing"))


def life_stage(age: Column) -> Column:
    return F.when(age < 30, "20s").when(age < 40, "30s").when(age < 50, "40s").when(age < 65, "50s-60s").when(age >= 65, "65+")


#: The age of those who give none, the map's bounds, and its zones by the first bound above y.
UNKNOWN_AGE = 35
ZONES = [(140, "Thriving Zone"), (300, "Navigation Zone"), (415, "Risk Territory")]
LAST_ZONE = "Critical Zone"


def map_x(age: Column) -> Column:
    """Place by age, held to 16 to 90."""
    return 80 + (F.greatest(F.lit(16), F.least(F.lit(90), F.coalesce(age, F.lit(UNKNOWN_AGE)))) - 16) / 74 * 760


def map_y(age: Column, n_conditions: Column, n_symptoms: Column) -> Column:
    held = F.coalesce(age, F.lit(UNKNOWN_AGE))
    none = lambda n: F.coalesce(n, F.lit(0))
    return F.least(F.lit(455.0), F.greatest(F.lit(50.0), 50 + 1.7 * F.greatest(F.lit(0), held - 20) + 65 * none(n_conditions) + 18 * none(n_symptoms)))


def zone(y: Column) -> Column:
    """The zone of a place, null without one."""
    out = F.when(y.isNull(), F.lit(None))
    for below, name in ZONES:
        out = out.when(y < below, name)
    return out.otherwise(LAST_ZONE)


def health_score(y: Column) -> Column:
    """0 to 100, null without a place."""
    return F.when(y.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), F.round(100 - (y - 50) / 405 * 100)))).cast("int")


def _placed(snapshots: DataFrame) -> DataFrame:
    """Snapshots with a place; a stored zone holds before the one of the place."""
    s = snapshots.where(F.col("y").isNotNull())
    return s.withColumn("zone", F.coalesce("zone", zone(F.col("y"))) if "zone" in s.columns else zone(F.col("y")))


def trajectory(snapshots: DataFrame, limit: int = 50) -> DataFrame:
    """The latest `limit` snapshots (user_id, ts, id, y) of each user, numbered oldest first."""
    late = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("id"))
    kept = snapshots.withColumn("rn", F.row_number().over(late)).where(F.col("rn") <= limit).drop("rn")
    return kept.withColumn("step", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "id")))


def drift(snapshots: DataFrame) -> DataFrame:
    """Change of score against the snapshot before: improving, worsening or steady (within 2).  Snapshots without a place do not count."""
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    s = _placed(snapshots).withColumn("score", health_score(F.col("y")))
    s = s.withColumns({"delta": F.col("score") - F.lag("score").over(w), "from_zone": F.lag("zone").over(w)})
    trend = F.when(F.col("delta") > 2, "improving").when(F.col("delta") < -2, "worsening").otherwise("steady")
    return s.where(F.col("delta").isNotNull()).select("user_id", "id", "score", "delta", trend.alias("trend"), (F.col("zone") != F.col("from_zone")).alias("zone_changed"))


def zone_transitions(snapshots: DataFrame) -> DataFrame:
    """A user's first snapshot, every change of zone, and the last snapshot, of those with a place."""
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    s = _placed(snapshots).withColumns({"before": F.lag("zone").over(w), "after": F.lead("zone").over(w)})
    return s.where(F.col("before").isNull() | (F.col("before") != F.col("zone")) | F.col("after").isNull()).select("user_id", "id", "zone")


def path_length(snapshots: DataFrame) -> DataFrame:
    """Length of each user's way over the map (x, y), through the snapshots that have both."""
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    step = lambda c: F.col(c) - F.lag(c).over(w)
    s = snapshots.where(F.col("x").isNotNull() & F.col("y").isNotNull()).withColumns({"dx": step("x"), "dy": step("y")})
    return s.groupBy("user_id").agg(F.round(F.coalesce(F.sum(F.hypot("dx", "dy")), F.lit(0.0)), 4).alias("length"))


def condition_diff(snapshots: DataFrame) -> DataFrame:
    """Conditions added and removed between a user's last two snapshots (user_id, ts, id, conditions)."""
    w = Window.partitionBy("user_id").orderBy("ts", "id")
    s = snapshots.withColumns({"was": F.lag("conditions").over(w), "after": F.lead("id").over(w)}).where(F.col("after").isNull() & F.col("was").isNotNull())
    return s.select("user_id", F.array_except("conditions", "was").alias("added"), F.array_except("was", "conditions").alias("removed"))


def merge_contexts(base: DataFrame, patch: DataFrame, scalars: list[str], lists: list[str]) -> DataFrame:
    """patch's scalars win where set; lists are joined in order without repeats."""
    p = patch.select("user_id", *[F.col(c).alias(f"p_{c}") for c in scalars + lists])
    empty = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    return base.join(p, "user_id", "full_outer").select("user_id", *[F.coalesce(F.nullif(f"p_{c}", F.lit("")) if dict(patch.dtypes)[c] == "string" else f"p_{c}", c).alias(c) for c in scalars], *[F.array_union(empty(F.col(c)), empty(F.col(f"p_{c}"))).alias(c) for c in lists])


# ---- logs ----


def demand_daily(log: DataFrame) -> DataFrame:
    """log (entity, kind, ts): counts per day."""
    return log.where(F.trim("entity") != "").groupBy("entity", "kind", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))


def top_demand(daily: DataFrame, k: int = 20) -> DataFrame:
    return daily.groupBy("entity", "kind").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "entity", "kind").limit(k)


def demand_boost(daily: DataFrame, k: int = 20) -> DataFrame:
    """The k entities with most demand over all kinds and days; as the demand of gap_queries they come first."""
    return daily.groupBy("entity").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "entity").limit(k)


def yield_stats(runs: DataFrame) -> DataFrame:
    """runs (label, returned, fresh, claims): totals per label."""
    g = runs.groupBy("label").agg(F.count("*").alias("runs"), F.sum("returned").alias("returned"), F.sum("fresh").alias("fresh"), F.sum("claims").alias("claims"))
    return g.withColumn("per_paper", F.when(F.col("returned") > 0, F.round(F.col("claims") / F.col("returned"), 2)).otherwise(0.0))


def low_yield_queries(runs: DataFrame, min_runs: int = 3, max_yield: float = 0.5) -> DataFrame:
    s = yield_stats(runs)
    return s.where((F.col("runs") >= min_runs) & (F.col("returned") > 0) & (F.col("claims") / F.col("returned") < max_yield)).select("label", "runs", "returned", "claims")


def query_yield(hits: DataFrame) -> DataFrame:
    """hits (rank, label, id): per query what it returned and what no earlier query had."""
    first = hits.groupBy("id").agg(F.min(F.struct("rank", "label"))["label"].alias("owner"))
    return hits.join(first, "id").groupBy("label").agg(F.count("*").alias("returned"), F.count_if(F.col("owner") == F.col("label")).alias("fresh"))


def kg_trend(stats: DataFrame, n_rows: int = 30) -> DataFrame:
    """The latest snapshots (ts, id, value) in time order with the change to the one before."""
    last = stats.orderBy(F.desc("ts"), F.desc("id")).limit(n_rows)
    return last.withColumn("delta", F.col("value") - F.lag("value").over(Window.partitionBy().orderBy("ts", "id")))


def throttle(snapshots: DataFrame, key: str, seconds: int = 300) -> DataFrame:
    """Snapshots accepted per key: those at least `seconds` after the last accepted one; those without a time all are.

    Of a second only the smallest id can be accepted.  Each day of a key tells for every second at which
    the day before may leave it free when it becomes free itself; days are folded in order over these
    answers, and then each day knows where it starts.  No task holds more than a day's seconds of a key.
    """
    rows = snapshots.select(key, F.unix_timestamp("ts").alias("t"), "id")
    if seconds <= 0:
        return rows.select(key, F.col("id").cast("bigint").alias("id"))
    span = max(86_400, seconds)
    kind = rows.select(F.col(key).alias("k")).schema[0].dataType.simpleString()
    timed = rows.where(F.col("t").isNotNull()).groupBy(F.col(key).alias("k"), F.floor(F.col("t") / span).alias("day"), "t").agg(F.min(F.struct("id"))["id"].cast("bigint").alias("id"))

    def table(of: pa.Table, day: np.ndarray, **more) -> pa.Table:
        same = of.column("k").take(pa.array(np.zeros(len(day), dtype=np.int64)))
        return pa.table({"k": same, "day": pa.array(day)} | {c: pa.array(v) for c, v in more.items()})

    def leave(of: pa.Table) -> pa.Table:
        t, day = np.sort(of.column("t").to_numpy()), of.column("day")[0].as_py()
        after, free = np.searchsorted(t, t + seconds), t + seconds
        for i in range(len(t) - 1, -1, -1):
            if after[i] < len(t):
                free[i] = free[after[i]]
        entry = day * span + np.arange(seconds + 1)
        out = np.append(free, 0)[at := np.searchsorted(t, entry)]
        return table(of, np.array([day]), leaves=[np.where(at < len(t), out, entry).tolist()])

    def fold(of: pa.Table) -> pa.Table:
        of, free, start = of.sort_by("day"), None, []
        days = of.column("day").to_numpy()
        for day, leaves in zip(days, of.column("leaves"), strict=True):
            start.append(max(free if free is not None else day * span, day * span))
            free = leaves[int(start[-1] - day * span)].as_py()
        return table(of, days, start=np.array(start, dtype=np.int64))

    def accept(of: pa.Table) -> pa.Table:
        of, free, kept = of.sort_by("t"), of.column("start")[0].as_py(), []
        t = of.column("t").to_numpy()
        while (i := int(np.searchsorted(t, free))) < len(t):
            kept.append(i)
            free = t[i] + seconds
        return of.take(pa.array(kept, pa.int64())).select(["k", "id"])

    leaves = timed.groupBy("k", "day").applyInArrow(leave, f"k {kind}, day bigint, leaves array<bigint>")
    starts = leaves.groupBy("k").applyInArrow(fold, f"k {kind}, day bigint, start bigint").withColumnsRenamed({"k": "k2", "day": "day2"})
    placed = timed.join(starts, F.col("k").eqNullSafe(F.col("k2")) & (F.col("day") == F.col("day2"))).select("k", "day", "t", "id", "start")
    accepted = placed.groupBy("k", "day").applyInArrow(accept, f"k {kind}, id bigint")
    return accepted.select(F.col("k").alias(key), "id").unionByName(rows.where(F.col("t").isNull()).select(key, F.col("id").cast("bigint").alias("id")))


# ---- term search ----


#: Goals that are offered though the graph has no label for them; labels of the other fields.
GOALS = ["longevity", "weight_management", "weight management", "hypertension_management", "blood_sugar_management", "heart_health"]
FIELD_LABELS = {"conditions": "Disease", "symptoms": "Symptom", "medications": "Drug", "goals": "Goal"}


def _asked(terms: DataFrame, *more: str) -> DataFrame:
    return terms.select(F.lower(F.trim("term")).alias("term"), *more).where(F.length("term") > 0).distinct()


#: Letters of a gram.
GRAM = 3


def _grams(column: str, n: int) -> Column:
    """The distinct n-letter grams of a text; none for a shorter one."""
    t = F.col(column)
    return F.when(F.length(t) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - n + 1), lambda i: t.substr(i, F.lit(n)))))


def candidates(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer) pairs that share the inner text's rarest gram, each frame with the one column, distinct.

    The outer texts are an inverted index of their grams.  An inner text with a gram that no outer text has is dropped;
    one of fewer letters than a gram is looked up as a gram of its own length, which already is the answer.
    """
    own, texts = inner.where(F.length("inner") > 0).distinct(), outer.where(F.length("outer") > 0).distinct()
    postings = texts.select("outer", F.explode(_grams("outer", GRAM)).alias("gram"))
    frequent = postings.groupBy("gram").agg(F.count("*").alias("n"))
    asked = own.where(F.length("inner") >= GRAM).select("inner", F.size(_grams("inner", GRAM)).alias("size"), F.explode(_grams("inner", GRAM)).alias("gram"))
    rarest = asked.join(frequent, "gram").groupBy("inner", "size").agg(F.count("*").alias("found"), F.min(F.struct("n", "gram"))["gram"].alias("gram")).where(F.col("found") == F.col("size"))
    found = rarest.select("inner", "gram").join(postings, "gram").select("inner", "outer")
    for n in range(1, GRAM):
        short = own.where(F.length("inner") == n)
        found = found.unionByName(short.join(texts.select("outer", F.explode(_grams("outer", n)).alias("inner")), "inner").select("inner", "outer"))
    return found


def holding(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(inner, outer) for each text of outer that contains one of inner; each frame has the one column."""
    return candidates(inner, outer).where(F.contains("outer", "inner"))


def _ranked(best: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return best.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def suggest_vocab(terms: DataFrame, vocabulary: DataFrame, k: int = 10) -> DataFrame:
    """term, canonical, rank: exact keys first, then keys that hold the term or that the term holds, short names first."""
    t, keys = _asked(terms), vocabulary.select("key", "canonical").where(F.length("key") > 0)
    longer = holding(t.select(F.col("term").alias("inner")), keys.select(F.col("key").alias("outer"))).select(F.col("inner").alias("term"), F.col("outer").alias("key"))
    shorter = holding(keys.select(F.col("key").alias("inner")), t.select(F.col("term").alias("outer"))).select(F.col("outer").alias("term"), F.col("inner").alias("key"))
    best = longer.unionByName(shorter).join(keys, "key").groupBy("term", "canonical").agg(F.min(F.when(F.col("key") == F.col("term"), 0).otherwise(1)).alias("grade"))
    return _ranked(best, ["term"], ["grade", F.length("canonical"), "canonical"], k).drop("grade")


def suggest_nodes(terms: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """term, field, name, rank: nodes (label, name) of the field's label, or goals, whose name holds the term; short names first."""
    t, spark = _asked(terms, "field"), terms.sparkSession
    goals = spark.createDataFrame([("Goal", g) for g in GOALS], "label string, name string")
    labels = spark.createDataFrame(list(FIELD_LABELS.items()), "field string, label string")
    own = nodes.select("label", "name").unionByName(goals).join(labels, "label").select("field", "name", F.lower(F.when(F.col("field") == "goals", F.translate("name", "_", " ")).otherwise(F.col("name"))).alias("outer")).distinct()
    pairs = holding(t.select(F.col("term").alias("inner")), own.select("outer")).withColumnRenamed("inner", "term")
    hit = pairs.join(own, "outer").join(t, ["term", "field"]).select("term", "field", "name")
    return _ranked(hit, ["term", "field"], [F.length("name"), "name"], k)


def suggest(terms: DataFrame, vocabulary: DataFrame, nodes: DataFrame, k: int = 10) -> DataFrame:
    """term, field, name, rank: names of the vocabulary, then nodes or goals of the field, each name once."""
    t = _asked(terms, "field")
    words = suggest_vocab(t, vocabulary, k).join(t, "term").select("term", "field", F.col("canonical").alias("name"), F.lit(0).alias("source"), "rank")
    both = words.unionByName(suggest_nodes(t, nodes, k).withColumn("source", F.lit(1)))
    best = both.groupBy("term", "field", "name").agg(F.min(F.struct("source", "rank")).alias("at"))
    return _ranked(best, ["term", "field"], ["at", "name"], k).drop("at")


def match_entity(terms: DataFrame, nodes: DataFrame) -> DataFrame:
    """The best node of each term: exact before containing, then the shortest name."""
    t = _asked(terms).select(F.col("term").alias("inner"))
    hit = holding(t, nodes.select(F.col("name").alias("outer"))).select(F.col("inner").alias("term"), F.col("outer").alias("name"))
    return _ranked(hit, ["term"], [F.col("name") != F.col("term"), F.length("name"), "name"], 1).drop("rank")


def priority_papers(papers: DataFrame, keywords: list[str], demand: DataFrame | None = None) -> DataFrame:
    """Papers (pmcid, abstract, perhaps title) that hold any watch word or name an entity in demand (entity)."""
    text = F.concat_ws(" ", *[c for c in ("title", "abstract") if c in papers.columns])
    ids = papers.where(F.lower(text).rlike("|".join(keywords))).select("pmcid")
    if demand is not None:
        phrases = demand.select(F.lower(F.trim("entity")).alias("phrase"), F.lit("entity").alias("kind"), F.col("entity").alias("term")).distinct()
        ids = ids.unionByName(terms_from_text(papers.select(F.col("pmcid").alias("id"), text.alias("text")), phrases).select(F.col("id").alias("pmcid")))
    return papers.join(ids.distinct(), "pmcid", "left_semi")


def reextract_candidates(papers: DataFrame, claims: DataFrame, max_existing: int = 2, k: int = 50) -> DataFrame:
    """Papers with few claims: fewest first, then by strength."""
    n = claims.groupBy(F.regexp_replace("source_id", "^PMC", "").alias("s")).agg(F.count("*").alias("n"), F.avg("evidence_strength").alias("strength"))
    p = papers.withColumn("s", F.regexp_replace("pmcid", "^PMC", "")).join(n, "s", "left").select("pmcid", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("strength", F.lit(0.0)).alias("strength"))
    return p.where(F.col("n") <= max_existing).orderBy("n", F.desc("strength"), "pmcid").limit(k)


def replace_if_better(old: DataFrame, new: DataFrame) -> DataFrame:
    """Claims with a paper's claims swapped where the new ones are more, or as many and stronger."""
    agg = lambda df, s: df.groupBy("source_id").agg(F.count("*").alias(f"{s}_n"), F.avg("evidence_strength").alias(f"{s}_s"))
    better = agg(new, "new").join(agg(old, "old"), "source_id", "left").where(F.col("old_n").isNull() | (F.col("new_n") > F.col("old_n")) | ((F.col("new_n") == F.col("old_n")) & (F.col("new_s") > F.col("old_s")))).select("source_id")
    return old.join(better, "source_id", "left_anti").unionByName(new.join(better, "source_id", "left_semi"), allowMissingColumns=True)
