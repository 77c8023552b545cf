"""Claims: normalisation, validation, enrichment and their statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vocab

CLAIM_COLUMNS = ["subject", "subject_type", "predicate", "object", "object_type", "context", "source_id", "source_type", "journal", "pub_date", "evidence_type"]


def normalize_claims(raw: DataFrame, names: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """All claim columns in the vocabulary's forms; a rejected type becomes Thing, so that validation names it.

    names maps lower-case names to their forms: a small dict, or a table (key, canonical) of any size.
    """
    if isinstance(names, DataFrame):
        raw, names = vocab.canonical_names(raw, ["subject", "object"], names), None
    c = lambda name, default="": F.col(name) if name in raw.columns else F.lit(default)
    kind = lambda name: F.coalesce(vocab.canonical_type(c(name)), F.lit("Thing"))
    return raw.select(
        vocab.canonical_name(c("subject"), names or {}).alias("subject"), kind("subject_type").alias("subject_type"), vocab.canonical_predicate(c("predicate")).alias("predicate"),
        vocab.canonical_name(c("object"), names or {}).alias("object"), kind("object_type").alias("object_type"), F.coalesce(c("context"), F.lit("")).alias("context"), F.coalesce(c("source_id"), F.lit("")).alias("source_id"),
        F.coalesce(vocab.squeeze(c("source_type")), F.lit("PMC")).alias("source_type"), F.coalesce(c("journal"), F.lit("")).alias("journal"), F.coalesce(c("pub_date"), F.lit("")).alias("pub_date"), F.trim(F.coalesce(c("evidence_type"), F.lit(""))).alias("evidence_type"),
    )


def reject_rule(strict_pub_date: bool = False) -> Column:
    """The first rule that a normalised claim breaks, or null."""
    blank = lambda c: vocab.squeeze(F.col(c)).isNull()
    out = F.when(blank("source_id"), "missing source_id").when(blank("context"), "missing context")
    if strict_pub_date:
        out = out.when(blank("pub_date") | (F.col("pub_date") == "Unknown"), "missing pub_date")
    out = out.when(vocab.is_vague_name(F.col("subject")), "vague subject").when(vocab.is_vague_name(F.col("object")), "vague object").when(F.upper(F.trim("predicate")).isin(vocab.WEAK_PREDICATES), "low-value predicate")
    for side in ("subject_type", "object_type"):
        kind = F.trim(F.coalesce(F.col(side), F.lit("")))
        out = out.when((kind != "") & F.lower(F.translate(kind, " -", "__")).isin(vocab.REJECT_TYPES), f"rejected {side}").when((kind != "") & ~kind.isin(vocab.ENTITY_TYPES), f"unknown {side}")
    return out


def validate(claims: DataFrame, strict_pub_date: bool = False) -> DataFrame:
    """claims with reject_rule, reject_value (what broke it) and evidence_strength."""
    # The rule is a column before its value is looked up: written into each test it would outgrow code generation.
    ruled = claims.withColumns({"reject_rule": reject_rule(strict_pub_date), "evidence_strength": vocab.evidence_strength(F.col("evidence_type"))})
    value = None
    for c in ("subject", "object", "predicate", "subject_type", "object_type"):
        test = F.col("reject_rule").endswith(c)
        value = F.when(test, F.col(c)) if value is None else value.when(test, F.col(c))
    return ruled.withColumn("reject_value", value)


def valid_claims(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reject_rule").isNull()).drop("reject_rule", "reject_value")


def rejected_claims(validated: DataFrame) -> DataFrame:
    return validated.where(F.col("reject_rule").isNotNull())


def validation_stats(validated: DataFrame) -> DataFrame:
    ok = F.col("reject_rule").isNull()
    return validated.agg(
        F.count("*").alias("total"), F.count_if(ok).alias("valid"), F.count_if(~ok).alias("rejected"), F.coalesce(F.round(100.0 * F.count_if(ok) / F.nullif(F.count("*"), F.lit(0)), 1), F.lit(0.0)).alias("pass_rate_pct"),
        F.coalesce(F.round(F.avg(F.when(ok, F.col("evidence_strength"))), 2), F.lit(0.0)).alias("avg_evidence_strength"), F.count_if(ok & (F.col("evidence_strength") >= 5)).alias("strength_ge_5"), F.count_if(ok & (F.col("evidence_strength") >= 4)).alias("strength_ge_4"),
    )


def rejects_by_reason(validated: DataFrame) -> DataFrame:
    return rejected_claims(validated).groupBy("reject_rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reject_rule")


def backfill_evidence_type(claims: DataFrame) -> DataFrame:
    """A blank evidence type is inferred from the context and marked so."""
    blank, found = vocab.squeeze(F.col("evidence_type")).isNull(), vocab.infer_evidence_type(F.col("context"))
    return claims.withColumns({"evidence_type_source": F.when(blank & found.isNotNull(), "inferred"), "evidence_type": F.when(blank, F.coalesce(found, F.lit(""))).otherwise(F.col("evidence_type"))})


def source_key(c: Column) -> Column:
    """Source ids with and without their PMC prefix are one."""
    return F.regexp_replace(F.trim(c), "^PMC", "")


def backfill_journal(claims: DataFrame, papers: DataFrame) -> DataFrame:
    """A blank journal is copied from the paper of the claim's source (papers: pmcid, journal)."""
    p = papers.groupBy(source_key(F.col("pmcid")).alias("__s")).agg(F.max(vocab.squeeze(F.col("journal"))).alias("__j"))
    own = vocab.squeeze(F.col("journal"))
    return claims.withColumn("__s", source_key(F.col("source_id"))).join(p, "__s", "left").withColumn("journal", F.coalesce(own, F.col("__j"), F.lit(""))).drop("__s", "__j")


def consolidate_claims(raw: DataFrame, papers: DataFrame | None = None, names: dict[str, str] | None = None) -> DataFrame:
    """normalise, backfill, validate."""
    claims = normalize_claims(raw, names)
    return validate(backfill_evidence_type(backfill_journal(claims, papers) if papers is not None else claims))


def claim_stats(claims: DataFrame) -> DataFrame:
    s = vocab.squeeze(F.col("source_id"))
    return claims.agg(F.count("*").alias("claims"), F.count(s).alias("with_source"), F.count_distinct(s).alias("sources"))


def claim_check(claims: DataFrame) -> DataFrame:
    """Totals with and without source."""
    s = vocab.squeeze(F.col("source_id"))
    return claims.agg(F.count("*").alias("total"), F.count(s).alias("with_source"), (F.count("*") - F.count(s)).alias("without_source"))


def claims_without_source(claims: DataFrame) -> DataFrame:
    """The offenders of claim_check: subject, predicate, object of every claim without a source."""
    return claims.where(vocab.squeeze(F.col("source_id")).isNull()).select("subject", "predicate", "object")


def normalization_fixes(raw: DataFrame) -> DataFrame:
    """claims, fixed (types and predicates that normalisation changes), changed_claims: one row."""
    new = {"subject_type": F.coalesce(vocab.canonical_type(F.col("subject_type")), F.lit("Thing")), "object_type": F.coalesce(vocab.canonical_type(F.col("object_type")), F.lit("Thing")), "predicate": vocab.canonical_predicate(F.col("predicate"))}
    moved = sum((~F.coalesce(F.col(c), F.lit("")).eqNullSafe(n)).cast("int") for c, n in new.items())
    return raw.select(moved.alias("n")).agg(F.count("*").alias("claims"), F.coalesce(F.sum("n"), F.lit(0)).alias("fixed"), F.count_if(F.col("n") > 0).alias("changed_claims"))


def types_outside(raw: DataFrame, top: int = 20) -> DataFrame:
    """kind, n: types that are outside the vocabulary after normalisation too, most frequent first."""
    kinds = raw.select(F.explode(F.array("subject_type", "object_type")).alias("old")).select(F.coalesce(vocab.canonical_type(F.col("old")), F.lit("Thing")).alias("kind"))
    return kinds.where(~F.col("kind").isin(vocab.ENTITY_TYPES)).groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind").limit(top)


def normalization_changes(raw: DataFrame, top: int = 20) -> DataFrame:
    """How often which type text became which type (largest first)."""
    old = raw.select(F.explode(F.array("subject_type", "object_type")).alias("old"))
    new = old.withColumn("new", F.coalesce(vocab.canonical_type(F.col("old")), F.lit("Thing")))
    return new.where(~F.col("old").eqNullSafe(F.col("new"))).groupBy("old", "new").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "old", "new").limit(top)


def vocab_drift(left: DataFrame, right: DataFrame) -> DataFrame:
    """Keys of two (key, canonical) tables that only one has or that differ."""
    l, r = left.select("key", F.col("canonical").alias("left_value")), right.select("key", F.col("canonical").alias("right_value"))
    kind = F.when(F.col("right_value").isNull(), "only_left").when(F.col("left_value").isNull(), "only_right").otherwise("differs")
    return l.join(r, "key", "full_outer").where(~F.col("left_value").eqNullSafe(F.col("right_value"))).withColumn("kind", kind)


def alias_target_check(aliases: DataFrame, known: DataFrame) -> DataFrame:
    """Aliases (key, target) whose target is unknown or whose key is not upper case."""
    bad = aliases.join(known.select(F.col("name").alias("target")), "target", "left_anti").select("key", "target", F.lit("unknown target").alias("problem"))
    return bad.unionByName(aliases.where(F.col("key") != F.upper("key")).select("key", "target", F.lit("key case").alias("problem")))


def placeholder_claims(papers: DataFrame) -> DataFrame:
    """One DOCUMENTS claim per paper where no extractor is at hand."""
    return papers.select(F.col("title").alias("subject"), F.lit("Study").alias("subject_type"), F.lit("DOCUMENTS").alias("predicate"), F.col("journal").alias("object"), F.lit("Study").alias("object_type"), F.substring("abstract", 1, 200).alias("context"), F.col("pmcid").alias("source_id"))
