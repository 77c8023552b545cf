"""Spelling variants: words at one edit from each other, found by asymmetric chunks.

A word of L code points contributes two disjoint chunks, its halves; the other word contributes all
positional grams that such a chunk can meet.  One edit lies in one half and leaves the other as it is,
shifted by one at most, so two near words share a chunk and a gram at a shift of 0 or 1.  Halves alone
leave large buckets (in 0.5 GB of text, 9,000 words), so the half with the edit is cut in two chunks
again, of which one is left as well.  A key is thus a half with a quarter: the word without one of its
quarters.  With w of length L and g of length L (a letter replaced) or L + 1 (a letter inserted), some
quarter q of w exists such that w without q equals g without q, or g without q and the letter after it.

Words join on a hash of (length, quarter, rest); Levenshtein distance 1 decides.  A pair that shares
several keys counts at the first.  All of it is built-in functions; occurrences are counted before the
first shuffle, near words are aggregated before the second.

Defined results: null texts have no words; a null id counts as the empty text in the hash that picks
misspelt occurrences; a run that loses its only code point, or falls below ``least_length``, gives no
word.  Repeated rows count again.  Ties between near words of equal count go to the smaller in code-point
order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Letters of a run.
LETTERS = "[A-Za-zÀ-ÿ]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A run is misspelt if this divides its hash.
EVERY = 31


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7) -> DataFrame:
    """word, n: runs of letters, lower-cased and misspelt by the rule, with their number over all docs."""
    runs = F.regexp_extract_all(F.col(f"`{text_col}`"), F.lit(f"{LETTERS}{{{least_length},}}"), F.lit(0))
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(runs).alias("run"))
    low = rows.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    hashed = low.select("run", F.crc32(F.concat_ws(":", "id", "run")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n"))


def _borders(length: Column) -> list[Column]:
    """Ends of the quarters of a word: both halves cut in two."""
    half = F.floor(length / 2)
    return [F.lit(0), F.floor(half / 2), half, half + F.floor((length - half) / 2), length]


def chunk_keys(word: Column, length: Column, wider: int) -> list[Column]:
    """The keys of a word, for words of that length: word without each quarter and, beyond it, `wider` letters."""
    ends = [e.cast("int") for e in _borders(length)]
    rest = [F.concat(F.substring(word, F.lit(1), a), F.substring(word, b + 1 + wider, length)) for a, b in zip(ends, ends[1:], strict=False)]
    return [F.xxhash64(length.cast("int"), F.lit(q), r) for q, r in enumerate(rest)]


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: each pair of words one edit apart, once."""
    word, length = F.col("word"), F.length("word").cast("int")
    keys = lambda made: F.posexplode(F.array(*made)).alias("q", "key")
    chunks = words.select(F.col("word").alias("a"), F.col("n").alias("n_a"), keys(chunk_keys(word, length, 0)))
    same = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), keys(chunk_keys(word, length, 0)))
    longer = words.select(F.col("word").alias("b"), F.col("n").alias("n_b"), keys(chunk_keys(word, length - 1, 1)))
    met = chunks.join(same.unionByName(longer), ["q", "key"])
    by_one = F.length("b") - F.length("a")
    met = met.where(((by_one == 1) | ((by_one == 0) & (F.col("a") < F.col("b")))) & (F.levenshtein("a", "b", 1) == 1))
    mine = chunk_keys(F.col("a"), F.length("a"), 0)
    theirs = [F.when(by_one == 0, s).otherwise(x) for s, x in zip(chunk_keys(F.col("b"), F.length("a"), 0), chunk_keys(F.col("b"), F.length("a"), 1), strict=True)]
    before = F.lit(False)
    for q in range(3):
        before = before | ((F.col("q") > q) & (mine[q] == theirs[q]))
    return met.where(~before).select("a", "n_a", "b", "n_b")


def roots(forms: DataFrame, most: int, factor: int) -> DataFrame:
    """word, root of every word with a form (word, form): the end of its chain.

    Each form is `factor` times as frequent as its word, so a chain has at most log(most) links, and doubling the
    links of a hop leaves few joins.
    """
    hops = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(max(1.0, math.log(max(most, 1), factor)) + 1))):
        onward = hops.select(F.col("word").alias("root"), F.col("root").alias("further"))
        hops = hops.join(onward, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
    return hops


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = 7, least_n: int = 2, factor: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of docs."""
    words = materialize(occurrences(docs, id_col, text_col, least_length).where(F.col("n") >= least_n), "words")
    pairs = near_pairs(words)
    ends = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n")), F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n"))))
    around = pairs.select(ends.alias("x")).groupBy("x.word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("x.n")).alias("less"), F.col("x.other").alias("other"))).alias("best"))
    joined = words.join(around, "word", "left")
    has = -F.col("best.less") >= factor * F.col("n")
    found = materialize(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.less")).alias("form_n")), "near-words")
    most = found.agg(F.max("n").alias("n")).first()["n"] or 0
    ended = roots(found.where(F.col("form").isNotNull()), most, factor)
    return found.join(ended, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
