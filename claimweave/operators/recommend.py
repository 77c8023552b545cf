"""Recommendations and clinical look-ups: one to three hops over edges, for whole tables of users at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .audit import NEG, POS

#: Conditions to look after first, by decade and gender.
PROFILES = {
    ("30s", "female"): "Iron-deficiency anaemia, Polycystic ovary syndrome",
    ("30s", "male"): "Cardiovascular disease, Hypertension",
    ("40s", "female"): "Cardiovascular disease, Type 2 diabetes, Osteoporosis",
    ("40s", "male"): "Cardiovascular disease, Hypertension, Type 2 diabetes",
    ("50s", "female"): "Osteoporosis, Cardiovascular disease, Sarcopenia",
    ("50s", "male"): "Cardiovascular disease, Type 2 diabetes, Sarcopenia",
    ("60s+", "female"): "Osteoporosis, Sarcopenia, Cardiovascular disease, Cognitive decline",
    ("60s+", "male"): "Cardiovascular disease, Sarcopenia, Cognitive decline, Type 2 diabetes",
    ("default", "any"): "Cardiovascular disease, Type 2 diabetes, Hypertension",
}
FREE_ITEMS, PAID_ITEMS = 5, 20


def decade(age: Column) -> Column:
    return F.when(age.isNull(), "default").when(age < 40, "30s").when(age < 50, "40s").when(age < 60, "50s").otherwise("60s+")


def gender_key(gender: Column) -> Column:
    g = F.lower(F.coalesce(gender, F.lit("")))
    return F.when(g.isin("female", "f", "woman"), "female").when(g.isin("male", "m", "man"), "male").otherwise("any")


def age_gender_profile(users: DataFrame) -> DataFrame:
    """user_id and the conditions of the user's decade and gender, else of nobody in particular."""
    table = F.create_map(*[F.lit(x) for (d, g), v in PROFILES.items() for x in (f"{d}/{g}", v)])
    own = F.try_element_at(table, F.concat(decade(F.col("age")), F.lit("/"), gender_key(F.col("gender"))))
    return users.select("user_id", "age", "gender").distinct().select("user_id", F.coalesce(own, F.lit(PROFILES["default", "any"])).alias("conditions"))


def user_targets(users: DataFrame) -> DataFrame:
    """user_id, plan, target (merge key), from_profile: a user's own terms, else those of the profile."""
    own = users.where(F.col("term").isNotNull()).select("user_id", "plan", F.lower("term").alias("target"), F.lit(False).alias("from_profile")).distinct()
    bare = users.where(F.col("term").isNull() & (F.col("age").isNotNull() | (F.col("gender") != "")))
    profile = bare.join(age_gender_profile(bare), "user_id").select("user_id", "plan", F.explode(F.split(F.lower("conditions"), ", ")).alias("target"), F.lit(True).alias("from_profile"))
    return own.unionByName(profile).distinct()


def _sourced(edges: DataFrame) -> DataFrame:
    return edges.where(F.trim(F.coalesce("source_id", F.lit(""))) != "")


def _to_targets(edges: DataFrame) -> DataFrame:
    e = _sourced(edges).where(F.col("src_label").isin("Food", "Nutrient") & F.col("dst_label").isin("Disease", "Symptom"))
    return e.where(~F.col("contested")) if "contested" in edges.columns else e


#: Records of evidence that a list holds.
EVIDENCE = 5
#: Fields of a record of evidence; a source without a type is a paper.
EVIDENCE_FIELDS = ["source_id", "source_type", "context", "journal", "pub_date"]


def evidence_of(edges: DataFrame) -> Column:
    """An edge's record of evidence; fields that edges have not are empty."""
    held = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in edges.columns else F.lit("")
    return F.struct(*[(F.coalesce(F.nullif(held(c), F.lit("")), F.lit("PMC")) if c == "source_type" else held(c)).alias(c) for c in EVIDENCE_FIELDS])


def top_evidence(rows: DataFrame, by: list[str], k: int = EVIDENCE, name: str = "evidence") -> DataFrame:
    """Per key the first k distinct records (column ev) in order.  Ranks are cut on both sides of the shuffle, so no key gathers more than k."""
    first = Window.partitionBy(*by).orderBy("ev")
    kept = rows.select(*by, "ev").distinct().withColumn("rn", F.row_number().over(first)).where(F.col("rn") <= k)
    return kept.groupBy(*by).agg(F.array_sort(F.collect_list("ev")).alias(name))


def recs_direct(edges: DataFrame) -> DataFrame:
    """item, rel, target, via, reached, debated, source_id, strength, ev: one hop."""
    e = _to_targets(edges).where(F.col("rel").isin(POS))
    debated = F.coalesce("debated", F.lit(False)) if "debated" in edges.columns else F.lit(False)
    return e.select(F.col("src").alias("item"), "rel", F.col("dst").alias("target"), F.lit(None).cast("string").alias("via"), F.col("dst").alias("reached"), debated.alias("debated"), "source_id", F.col("evidence_strength").alias("strength"), evidence_of(edges).alias("ev"))


def _holding(edges: DataFrame) -> DataFrame:
    """item, via: foods that contain a nutrient, each pair once."""
    return edges.where((F.col("rel") == "CONTAINS") & (F.col("src_label") == "Food") & (F.col("dst_label") == "Nutrient")).select(F.col("src").alias("item"), F.col("dst").alias("via")).distinct()


def _helping(edges: DataFrame) -> DataFrame:
    """via, rel, target, source_id, strength, ev: what nutrients help."""
    e = _sourced(edges).where((F.col("src_label") == "Nutrient") & F.col("rel").isin(POS) & F.col("dst_label").isin("Disease", "Symptom"))
    return e.select(F.col("src").alias("via"), "rel", F.col("dst").alias("target"), "source_id", F.col("evidence_strength").alias("strength"), evidence_of(edges).alias("ev"))


def _signalling(edges: DataFrame) -> DataFrame:
    """reached, target: symptoms and what they signal, each pair once."""
    return edges.where((F.col("rel") == "EARLY_SIGNAL_OF") & (F.col("src_label") == "Symptom")).select(F.col("src").alias("reached"), F.col("dst").alias("target")).distinct()


def _easing(edges: DataFrame) -> DataFrame:
    """item, rel, reached, source_id, strength, ev: what eases symptoms."""
    e = _sourced(edges).where(F.col("src_label").isin("Food", "Nutrient") & (F.col("dst_label") == "Symptom") & F.col("rel").isin("ALLEVIATES", "PREVENTS"))
    return e.select(F.col("src").alias("item"), "rel", F.col("dst").alias("reached"), "source_id", F.col("evidence_strength").alias("strength"), evidence_of(edges).alias("ev"))


def recs_via_nutrient(edges: DataFrame) -> DataFrame:
    """Two hops: a food contains a nutrient that helps.  Only distinct (food, nutrient) pairs enter the join."""
    return _holding(edges).join(_helping(edges), "via").select("item", "rel", "target", "via", F.col("target").alias("reached"), F.lit(False).alias("debated"), "source_id", "strength", "ev")


def recs_via_shared_symptom(edges: DataFrame) -> DataFrame:
    """Three hops: what eases a symptom (reached) that signals the target."""
    return _easing(edges).join(_signalling(edges), "reached").select("item", "rel", "target", F.lit(None).cast("string").alias("via"), "reached", F.lit(False).alias("debated"), "source_id", "strength", "ev")


def restricted_items(edges: DataFrame) -> DataFrame:
    return _to_targets(edges).where(F.col("rel").isin(NEG)).select(F.col("src").alias("item"), "rel", F.col("dst").alias("target"), "source_id", F.col("evidence_strength").alias("strength"), evidence_of(edges).alias("ev"))


#: What a reason ends with where evidence conflicts.
DEBATED = " [debated — conflicting evidence exists]"


def reason_text(rel: Column, target: Column, via: Column, debated: Column | None = None) -> Column:
    """What links an item to what it helps, said to be debated where evidence conflicts."""
    p = F.lower(F.translate(rel, "_", " "))
    said = F.when(via.isNotNull(), F.concat(F.lit("Contains "), via, F.lit(" which "), p, F.lit(" "), target)).otherwise(F.concat(F.lit("Associated with "), p, F.lit(" of "), target))
    return said if debated is None else F.concat(said, F.when(debated, DEBATED).otherwise(""))


def profile_note(age: Column, gender: Column) -> Column:
    """What a reason begins with for users whose targets come from their profile."""
    own = F.concat_ws(" ", F.when(age.isNotNull(), decade(age)), F.nullif(F.lower(F.trim(gender)), F.lit("")))
    return F.concat(F.lit("Recommended for your profile ("), own, F.lit(") — "))


def _facts(edges: DataFrame) -> DataFrame:
    """hop, who, reason, about, source_id, strength, ev: the edges that recommendations rest on, each once a hop.

    "own": the item who helps the target about.  "via": the nutrient who helps the target about.  "signal": the item who eases the
    symptom about.  A symptom that signals itself, or whose name is that of its target with the mark of a debate, gives reasons that
    direct ones may give too, so these are "own".
    """
    none = F.lit(None).cast("string")
    row = lambda e, hop, who, reason, about: e.select(F.lit(hop).alias("hop"), F.col(who).alias("who"), reason.alias("reason"), F.col(about).alias("about"), "source_id", "strength", "ev")
    said = reason_text(F.col("rel"), F.col("reached"), none)
    direct = row(recs_direct(edges), "own", "item", reason_text(F.col("rel"), F.col("reached"), none, F.col("debated")), "target")
    itself = row(_easing(edges).join(_signalling(edges).where(_same_reason()), "reached"), "own", "item", said, "target")
    via = row(_helping(edges), "via", "via", reason_text(F.col("rel"), F.col("target"), F.col("via")), "target")
    return direct.unionByName(itself).unionByName(via).unionByName(row(_easing(edges), "signal", "item", said, "reached"))


def _same_reason() -> Column:
    """Whether a reason of a signalling symptom can also be one of its target's own."""
    return F.col("reached").isin(F.col("target"), F.concat("target", F.lit(DEBATED)))


def recommendations(edges: DataFrame, users: DataFrame, evidence: int = EVIDENCE) -> DataFrame:
    """user_id, item, reason, n_evidence, strength, evidence, rank: five items for free plans, else twenty.

    Sources are counted per fact, before a nutrient's facts meet the foods that contain it and a symptom's the targets it signals.
    All items of a nutrient's fact rank by their names, so the first twenty foods of a nutrient are enough, and so are the first
    twenty facts of a symptom.  Reasons are ranked per target before users meet them: of a target only the first twenty can be
    among a user's first twenty, so a user meets at most twenty rows a target, whatever the graph holds.  Evidence is listed for
    those alone.  A reason that several targets of a user give counts once, with the evidence of the target that has most.
    """
    told, fact = _facts(edges), ["hop", "who", "reason", "about"]
    facts = told.groupBy(*fact).agg(F.count_distinct("source_id").alias("n_evidence"), F.max("strength").alias("strength"))
    order = [F.desc("strength"), F.desc("n_evidence"), "item", "reason"]
    first = lambda df, by, *o: df.withColumn("rn", F.row_number().over(Window.partitionBy(by).orderBy(*o))).where(F.col("rn") <= PAID_ITEMS).drop("rn")
    own = facts.where(F.col("hop") == "own").withColumns({"item": F.col("who"), "target": F.col("about")})
    foods = first(_holding(edges), "via", "item").withColumnRenamed("via", "who")
    via = facts.where(F.col("hop") == "via").join(foods, "who").withColumn("target", F.col("about"))
    eased = first(facts.where(F.col("hop") == "signal").withColumn("item", F.col("who")), "about", *order)
    signal = eased.join(_signalling(edges).where(~_same_reason()).withColumnRenamed("reached", "about"), "about")
    top = first(own.unionByName(via).unionByName(signal), "target", *order)
    listed = top_evidence(told.join(top.select(*fact).distinct(), fact, "left_semi"), fact, evidence)
    # Users meet the place of a list among those of its item and reason, not the list.
    grade = F.dense_rank().over(Window.partitionBy("item", "reason").orderBy(F.size("evidence"), "evidence"))
    top = top.join(listed, fact).select("target", "item", "reason", "n_evidence", "strength", "evidence", grade.alias("grade"))
    notes = users.where(F.col("term").isNull()).groupBy("user_id").agg(F.max(profile_note(F.col("age"), F.col("gender"))).alias("note"))
    met = user_targets(users).join(top.drop("evidence"), "target")
    best = met.groupBy("user_id", "plan", "item", "reason").agg(F.max(F.struct("strength", "n_evidence", "grade", "from_profile", "target")).alias("b")).select("user_id", "plan", "item", "reason", "b.*")
    ranked = best.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*order)))
    kept = ranked.where(F.col("rank") <= F.when(F.col("plan") == "free", FREE_ITEMS).otherwise(PAID_ITEMS)).join(notes, "user_id", "left")
    kept = kept.join(top.select("target", "item", "reason", "evidence"), ["target", "item", "reason"])
    reason = F.concat(F.when(F.col("from_profile"), F.col("note")).otherwise(""), F.col("reason"))
    return kept.select("user_id", "item", reason.alias("reason"), "n_evidence", "strength", "evidence", "rank")


def per_user(edges_view: DataFrame, users: DataFrame, k: int, *order: str) -> DataFrame:
    """The first k rows of a (target, ...) view for each user that has the target.

    Of each target the first k rows alone can be among a user's first k, so the view is cut before users meet it.
    """
    cols = [F.desc(c[1:]) if c[0] == "-" else F.col(c) for c in order]
    cut = edges_view.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy(*cols))).where(F.col("rank") <= k).drop("rank")
    joined = user_targets(users).join(cut, "target")
    return joined.withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(*cols))).where(F.col("rank") <= k).drop("plan", "from_profile")


#: Foods that a step of the path names, and records of evidence beside it.
FREE_FOODS, PAID_FOODS, STEP_EVIDENCE = 3, 5, 3


def safest_path(edges: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, step, items, evidence: what to increase and what to reduce, three items for free plans, else five, and three records.

    As in recommendations, a target sends its first items alone; records are looked up for the items that stay.
    """
    out, targets = None, user_targets(users)
    for step, view in (("increase", recs_direct(edges)), ("reduce", restricted_items(edges))):
        key = ["target", "item"]
        strength = view.groupBy(*key).agg(F.max("strength").alias("s"))
        first = strength.withColumn("rn", F.row_number().over(Window.partitionBy("target").orderBy(F.desc("s"), "item"))).where(F.col("rn") <= PAID_FOODS).drop("rn")
        best = targets.join(first, "target").groupBy("user_id", "plan", "item").agg(F.max("s").alias("s"))
        ranked = best.withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("s"), "item"))).where(F.col("rn") <= F.when(F.col("plan") == "free", FREE_FOODS).otherwise(PAID_FOODS))
        # An item's records come from all of the user's targets, those too for which it is not among the first.
        records = top_evidence(view.join(ranked.select("item").distinct(), "item", "left_semi"), key, STEP_EVIDENCE)
        shown = ranked.select("user_id", "item", "rn").join(targets.select("user_id", "target"), "user_id").join(records, key).groupBy("user_id", "rn", "item").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence")))).alias("evidence"))
        listed = shown.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("rn", "item", F.slice("evidence", 1, STEP_EVIDENCE).alias("evidence")))).alias("l"))
        part = listed.select("user_id", F.lit(step).alias("step"), F.array_join(F.transform("l", lambda x: x["item"]), ", ").alias("items"), F.slice(F.flatten(F.transform("l", lambda x: x["evidence"])), 1, STEP_EVIDENCE).alias("evidence"))
        out = part if out is None else out.unionByName(part)
    return out


def early_signals(edges: DataFrame) -> DataFrame:
    """symptom, disease, n_evidence, strength of every early signal."""
    e = edges.where((F.col("rel") == "EARLY_SIGNAL_OF") & (F.col("src_label") == "Symptom") & (F.col("dst_label") == "Disease"))
    return e.groupBy(F.col("src").alias("symptom"), F.col("dst").alias("disease")).agg(F.count("*").alias("n_evidence"), F.max("evidence_strength").alias("strength"))


def early_signal_guidance(edges: DataFrame, users: DataFrame, k: int = 15) -> DataFrame:
    """user_id, symptom, disease, n_evidence, strength, rank: the first k diseases that a user's own symptoms signal, strongest first."""
    view = early_signals(_sourced(edges)).withColumnRenamed("symptom", "target")
    top = per_user(view, users.where(F.col("term").isNotNull()), k, "-strength", "-n_evidence", "target", "disease")
    return top.select("user_id", F.col("target").alias("symptom"), "disease", "n_evidence", "strength", "rank")


def nearby_risks(edges: DataFrame, users: DataFrame, nodes: DataFrame) -> DataFrame:
    """user_id, name, kind, reason, evidence, rank: diseases that the user's symptoms signal, then the user's own conditions.

    A held term that is a Symptom node is a symptom, any other a condition.  Five for free plans, else thirty.
    """
    held = users.where(F.col("term").isNotNull()).select("user_id", "plan", F.lower(F.trim("term")).alias("target")).where(F.col("target") != "").distinct()
    symptoms = nodes.where(F.col("label") == "Symptom").select(F.col("name").alias("target")).distinct()
    e = _sourced(edges).where((F.col("rel") == "EARLY_SIGNAL_OF") & (F.col("src_label") == "Symptom") & (F.col("dst_label") == "Disease"))
    signals = top_evidence(e.select(F.col("src").alias("target"), F.col("dst").alias("name"), evidence_of(edges).alias("ev")), ["target", "name"], 1)
    signals = signals.withColumn("rn", F.row_number().over(Window.partitionBy("target").orderBy("name"))).where(F.col("rn") <= 30).drop("rn")
    of_symptoms = held.join(symptoms, "target", "left_semi").join(signals, "target").select("user_id", "plan", "name", F.lit("early_signal").alias("kind"), F.concat(F.lit("Early signal: "), "target").alias("reason"), "evidence")
    none = F.filter(F.array(F.struct(*[F.lit("").alias(c) for c in EVIDENCE_FIELDS])), lambda x: F.lit(False))
    own = held.join(symptoms, "target", "left_anti").select("user_id", "plan", F.col("target").alias("name"), F.lit("disease").alias("kind"), F.lit("Current condition").alias("reason"), none.alias("evidence"))
    ranked = of_symptoms.unionByName(own).withColumn("rank", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("kind"), "reason", "name")))
    return ranked.where(F.col("rank") <= F.when(F.col("plan") == "free", 5).otherwise(30)).drop("plan")


def symptom_items(edges: DataFrame, rel: str, evidence: int = EVIDENCE) -> DataFrame:
    """Foods and nutrients that ease (ALLEVIATES) or worsen (AGGRAVATES) a symptom, with evidence."""
    e = edges.where((F.col("rel") == rel) & F.col("src_label").isin("Food", "Nutrient") & (F.col("dst_label") == "Symptom")).select(F.col("dst").alias("symptom"), F.col("src").alias("item"), "evidence_strength", evidence_of(edges).alias("ev"))
    counted = e.groupBy("symptom", "item").agg(F.count("*").alias("n_evidence"), F.max("evidence_strength").alias("strength"))
    return counted.join(top_evidence(e, ["symptom", "item"], evidence), ["symptom", "item"])


def _hop(edges: DataFrame, key: list[str], n: str, listed: str, evidence: int) -> DataFrame:
    """Distinct sources of each key and their first records."""
    sources = edges.groupBy(*key).agg(F.count_distinct("source_id").alias(n))
    return sources.join(top_evidence(edges, key, evidence, listed), key)


def food_chain(edges: DataFrame, k: int = 50, evidence: int = EVIDENCE) -> DataFrame:
    """food, nutrient, rel, target, both hops' numbers of sources and records: the first k chains of each food by nutrient, rel and target.

    Of a nutrient only its first k effects can be among a food's first k chains.
    """
    e = edges.withColumn("ev", evidence_of(edges))
    holds = e.where((F.col("rel") == "CONTAINS") & (F.col("src_label") == "Food") & (F.col("dst_label") == "Nutrient")).select(F.col("src").alias("food"), F.col("dst").alias("nutrient"), "source_id", "ev")
    acts = e.where((F.col("src_label") == "Nutrient") & F.col("dst_label").isin("Disease", "Symptom")).select(F.col("src").alias("nutrient"), "rel", F.col("dst").alias("target"), "source_id", "ev")
    effects = _hop(acts, ["nutrient", "rel", "target"], "effect_sources", "effect_evidence", evidence)
    effects = effects.withColumn("rn", F.row_number().over(Window.partitionBy("nutrient").orderBy("rel", "target"))).where(F.col("rn") <= k).drop("rn")
    chains = _hop(holds, ["food", "nutrient"], "contains_sources", "contains_evidence", evidence).join(effects, "nutrient")
    ranked = chains.withColumn("rn", F.row_number().over(Window.partitionBy("food").orderBy("nutrient", "rel", "target"))).where(F.col("rn") <= k)
    return ranked.select("food", "nutrient", "rel", "target", "contains_sources", "effect_sources", "contains_evidence", "effect_evidence")


def drug_links(edges: DataFrame, rel: str, k: int = 15, labels: list[str] | None = None) -> DataFrame:
    """At most k items per drug with SUBSTITUTES_FOR, COMPLEMENTS_DRUG or CONTRAINDICATED_WITH, strongest first."""
    e = edges.where((F.col("rel") == rel) & (F.col("dst_label") == "Drug"))
    e = e.where(F.col("src_label").isin(labels)) if labels else e
    g = e.groupBy(F.col("dst").alias("drug"), F.col("src").alias("item")).agg(F.max("evidence_strength").alias("strength"), F.count("*").alias("n_evidence"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("drug").orderBy(F.desc("strength"), F.desc("n_evidence"), "item"))).where(F.col("rank") <= k)


def drug_interactions(edges: DataFrame) -> DataFrame:
    """Per drug what must not and what may go with it; drugs with neither give no row."""
    e = edges.where((F.col("dst_label") == "Drug") & F.col("src_label").isin("Food", "Nutrient"))
    names = lambda rel: F.array_join(F.array_sort(F.collect_set(F.when(F.col("rel") == rel, F.col("src")))), ", ")
    return e.where(F.col("rel").isin("CONTRAINDICATED_WITH", "COMPLEMENTS_DRUG")).groupBy(F.col("dst").alias("drug")).agg(names("CONTRAINDICATED_WITH").alias("avoid"), names("COMPLEMENTS_DRUG").alias("complement"))


def biomarkers(edges: DataFrame) -> DataFrame:
    """disease, biomarker, food (null: none known), direction."""
    marks = edges.where((F.col("rel") == "BIOMARKER_FOR") & (F.col("src_label") == "Biomarker") & (F.col("dst_label") == "Disease")).select(F.col("src").alias("biomarker"), F.col("dst").alias("disease")).distinct()
    moves = edges.where(F.col("rel").isin("INCREASES_BIOMARKER", "DECREASES_BIOMARKER") & F.col("src_label").isin("Food", "Nutrient")).select(F.col("dst").alias("biomarker"), F.col("src").alias("food"), F.when(F.col("rel") == "INCREASES_BIOMARKER", "raises").otherwise("lowers").alias("direction")).distinct()
    return marks.join(moves, "biomarker", "left")


def mechanism_chains(edges: DataFrame, evidence: int = EVIDENCE) -> DataFrame:
    """item, mechanism, rel, disease with both hops' numbers of sources and records of evidence."""
    e = _sourced(edges).withColumn("ev", evidence_of(edges))
    hits = e.where((F.col("rel") == "TARGETS_MECHANISM") & F.col("src_label").isin("Food", "Nutrient")).select(F.col("src").alias("item"), F.col("dst").alias("mechanism"), "source_id", "ev")
    leads = e.where((F.col("src_label") == "Mechanism") & F.col("rel").isin("CAUSES", "INCREASES_RISK_OF") & (F.col("dst_label") == "Disease")).select(F.col("src").alias("mechanism"), "rel", F.col("dst").alias("disease"), "source_id", "ev")
    return _hop(hits, ["item", "mechanism"], "target_sources", "target_evidence", evidence).join(_hop(leads, ["mechanism", "rel", "disease"], "effect_sources", "effect_evidence", evidence), "mechanism")


def risk_cascade(edges: DataFrame, users: DataFrame, k: int = 6) -> DataFrame:
    """Diseases to which a user's own lead, by number of edges."""
    e = edges.where((F.col("src_label") == "Disease") & (F.col("dst_label") == "Disease") & F.col("rel").isin("INCREASES_RISK_OF", "CAUSES")).groupBy(F.col("src").alias("target"), F.col("dst").alias("disease")).agg(F.count("*").alias("n"))
    top = per_user(e, users, k, "-n", "target", "disease")
    return top.select("user_id", "target", "disease", "n", "rank", F.when(F.col("n") >= 2, "high").otherwise("moderate").alias("severity"))


def risk_evidence(edges: DataFrame, k: int = 8) -> DataFrame:
    """The k latest sources of protection per disease."""
    e = _sourced(edges).where((F.col("dst_label") == "Disease") & F.col("rel").isin(POS) & F.col("src_label").isin("Food", "Nutrient", "LifestyleFactor"))
    w = Window.partitionBy("dst").orderBy(F.desc("source_id"), "src", "rel")
    return e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("dst").alias("disease"), F.col("src").alias("item"), "rel", "source_id", "rank")


#: Source types that are trusted beyond a single study.
TRUSTED_SOURCES = ["FDA", "drug_label"]


def trust_level(source_type: Column, recommended: Column) -> Column:
    """Evidence of a recommendation is wisdom, of a label knowledge, of a single study information."""
    return F.when(recommended, "wisdom").when(source_type.isin(TRUSTED_SOURCES), "knowledge").otherwise("information")


def trust_levels(edges: DataFrame) -> DataFrame:
    """Edges per trust level; those that recommendations rest on are recommended."""
    recommended = F.col("rel").isin(POS) & F.col("src_label").isin("Food", "Nutrient") & F.col("dst_label").isin("Disease", "Symptom")
    return edges.groupBy(trust_level(F.col("source_type"), recommended).alias("trust")).agg(F.count("*").alias("n"))


def age_guidance(edges: DataFrame, evidence: int = 3) -> DataFrame:
    """change, life_stage, why, evidence: what is known of each age-related change.

    Of several life stages the last by name is told; all distinct reasons are joined in order, a change without any gets a general
    one; evidence is the first records in order.
    """
    stage = F.col("rel") == "OCCURS_AT"
    e = edges.where((F.col("src_label") == "AgeRelatedChange") & F.col("rel").isin("OCCURS_AT", "MODIFIABLE_BY", "EXPLAINS_WHY") & (F.trim("source_id") != "") & (F.trim("src") != ""))
    e = e.select(F.trim("src").alias("change"), "rel", F.trim("dst").alias("dst"), "context", evidence_of(edges).alias("ev"))
    why = F.when(F.col("rel") == "MODIFIABLE_BY", F.concat(F.lit("Modifiable by "), "dst")).when(~stage, F.coalesce(F.nullif("context", F.lit("")), "dst"))
    # Distinct reasons before they are gathered: a change holds its reasons once each.
    told = e.groupBy("change", why.alias("v"), F.when(stage, F.col("dst")).alias("stage")).agg(F.lit(1).alias("one"))
    own = told.groupBy("change").agg(F.coalesce(F.max("stage"), F.lit("")).alias("life_stage"), F.array_sort(F.collect_set("v")).alias("parts"))
    text = F.when(F.size("parts") > 0, F.array_join("parts", "; ")).otherwise("Diet and exercise matter for this change.")
    return own.join(top_evidence(e, ["change"], evidence), "change").select("change", "life_stage", text.alias("why"), "evidence")
