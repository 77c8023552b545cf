"""Corpus pipeline: language, quality, near-duplicates, benchmark decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read
again as the next stage's docs.  All stages but the last return the columns of docs, with fewer rows.

Defined results: null texts and texts without a letter have no language and go in the first stage.
Repeated rows are judged alike in every stage but near_dedup, where one row of a group stays even if
several share the smallest doc_id.  Null ids pass the filtering stages.  Further columns of docs, of
any name, are kept as they are.  Empty documents give an empty result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimweave.llm import bpe, decontaminate, langid, quality, simhash
from claimweave.llm.common import id_bucket, materialize, read_table

#: A text whose trigrams belong to its best language to a smaller share is in none of the languages.
LEAST_LANGUAGE = 0.25
LEAST_QUALITY = 0.5
#: Near copies: fingerprints of three-word shingles that link at so many differing bits, or this similarity of their five-word shingles or more.
PRINT_WORDS, PRINT_BITS = 3, 3
NEAR_WORDS, NEAR_SIMILARITY = 5, 0.8


def _kept(docs: DataFrame, verdict, test) -> DataFrame:
    """docs where test holds of the verdict column, which gets a name longer than all of docs."""
    name = "_".join(["verdict", *docs.columns])
    return docs.withColumn(name, verdict).where(test(F.col(f"`{name}`"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts in one of the corpus's languages stay."""
    filters = langid.train(docs.where(id_bucket("doc_id", 3) != 1))
    return _kept(docs, langid.decide(docs, filters), lambda v: (v["lang_pred"] != "und") & (v["score"] >= LEAST_LANGUAGE))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that the quality machine takes for good stay."""
    labels = read_table(spark, sf_dir, "labels").where(id_bucket("doc_id", 3) != 1)
    machine = quality.train(docs.where(id_bucket("doc_id", 3) != 1), labels)
    return _kept(docs, quality.scorer(docs, machine), lambda v: v >= LEAST_QUALITY)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest doc_id."""
    return simhash.one_of_each(docs, shingle_words=NEAR_WORDS, similarity=NEAR_SIMILARITY, print_words=PRINT_WORDS, d=PRINT_BITS)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item stay."""
    return decontaminate.uncontaminated(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each text, as digests: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    rows = bpe.encode_decode(docs, bpe.load_spec(public_tokenizers.path("word_bpe_49k.json")))
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language", language), ("quality", good_quality), ("near_dedup", near_dedup), ("decontaminate", decontaminated), ("bpe", tokens)]

#: SQL can express neither the trained stages nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
