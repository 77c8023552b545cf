"""Language identification with language-bitmask filters of letter trigrams.

Training counts every trigram of every labelled training text per language; a language's set holds
the trigrams that make up at least ``min_freq`` of it, so no set has more than 1/min_freq members.
All sets live in one bit-sliced Bloom filter: a table of 64-bit words whose bit l belongs to language
l, so that and-ing a trigram's few words returns every language that contains it.  Adding up the
bits of a text's trigrams gives hits per language; each is corrected for the false positives that
the fill of that language's slice predicts, and the largest decides.

Defined results: null texts and texts without a letter are ``und`` with score 0; a text none of
whose trigrams is known gets the language with most training text, score 0; ties go to the larger
training share, then the smaller name; with no training text everything is ``und``.  Equal rows get
equal results; result columns replace input columns of the same name.
"""

from __future__ import annotations

import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_clashes, give_back

BLANK = 32
HASHES = 3
_LETTERS: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> its lower-case letter, or BLANK for all that is no letter."""
    if not _LETTERS:
        table = np.full(sys.maxunicode + 1, BLANK, dtype=np.uint32)
        for c in range(sys.maxunicode + 1):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTERS.append(table)
    return _LETTERS[0]


def trigrams(text: str | None) -> np.ndarray:
    """Letter trigrams of a text, blanks marking word borders, each packed into one integer."""
    if not text:
        return np.zeros(0, dtype=np.int64)
    codes = _letters()[np.frombuffer(unicodedata.normalize("NFC", text).encode("utf-32-le", "replace"), dtype="<u4")]
    codes = np.concatenate([[BLANK], codes, [BLANK]]).astype(np.int64)
    codes = codes[np.concatenate([[True], (codes[1:] != BLANK) | (codes[:-1] != BLANK)])]
    if len(codes) < 3:
        return np.zeros(0, dtype=np.int64)
    return ((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:])[codes[1:-1] != BLANK]


class Filters:
    """The bit-sliced filter of all languages."""

    def __init__(self, members: pd.DataFrame, shares: dict[str, int]):
        """members: (lang, gram) rows; shares: trigrams counted per language."""
        self.langs = sorted(shares, key=lambda x: (-shares[x], x))
        self.words = (len(self.langs) + 63) // 64 or 1
        size = 1 << max(10, int(16 * max(1, len(members.groupby("gram")))).bit_length())
        self.table = np.zeros((size, self.words), dtype=np.uint64)
        rank = {x: k for k, x in enumerate(self.langs)}
        lang = members["lang"].map(rank).to_numpy(dtype=np.int64)
        for at in self._places(members["gram"].to_numpy(dtype=np.int64)):
            np.bitwise_or.at(self.table, (at, lang // 64), np.uint64(1) << (lang % 64).astype(np.uint64))
        fill = self._bits(self.table) / size
        self.false_rate = np.minimum(fill**HASHES, 0.999)

    def _places(self, grams: np.ndarray) -> list[np.ndarray]:
        x = grams.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        step = (x >> np.uint64(32)) | np.uint64(1)
        return [((x + step * np.uint64(k)) % np.uint64(len(self.table))).astype(np.int64) for k in range(HASHES)]

    def _bits(self, masks: np.ndarray) -> np.ndarray:
        """Set bits per language."""
        got = np.unpackbits(np.ascontiguousarray(masks).view(np.uint8).reshape(len(masks), -1), axis=1, bitorder="little")
        return got.sum(axis=0, dtype=np.int64)[: len(self.langs)]

    def decide(self, text: str | None) -> tuple[str, float]:
        grams = trigrams(text)
        if not len(grams) or not self.langs:
            return "und", 0.0
        distinct, n = np.unique(grams, return_counts=True)
        masks = None
        for at in self._places(distinct):
            masks = self.table[at] if masks is None else masks & self.table[at]
        hits = self._bits(np.repeat(masks, n, axis=0))
        sure = np.maximum(0.0, (hits - len(grams) * self.false_rate) / (1 - self.false_rate))
        best = int(np.argmax(sure))
        return self.langs[best], float(min(1.0, sure[best] / len(grams)))


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_freq: float = 2e-5) -> Filters:
    """Filters from all rows of docs that have a language; docs must hold training rows only."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = defaultdict(list)

        def settle(lang: str) -> tuple[np.ndarray, np.ndarray]:
            grams = np.concatenate([g for g, _ in held[lang]])
            distinct, back = np.unique(grams, return_inverse=True)
            return distinct, np.bincount(back, weights=np.concatenate([n for _, n in held[lang]])).astype(np.int64)

        loose: dict[str, int] = defaultdict(int)  # trigrams since the language was last settled
        for b in batches:
            for text, lang in zip(*(c.to_pylist() for c in b.columns), strict=True):
                grams = trigrams(text)
                if len(grams):
                    held[lang].append((grams, np.ones(len(grams))))
                    loose[lang] += len(grams)
                    if loose[lang] > 400_000:
                        held[lang], loose[lang] = [settle(lang)], 0
        for lang in held:
            grams, n = settle(lang)
            for k in range(0, len(grams), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams[k : k + 50_000])), pa.array(grams[k : k + 50_000]), pa.array(n[k : k + 50_000])], names=["lang", "gram", "n"])
        held.clear()
        give_back()

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = rows.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = counts.persist()
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    floor = F.create_map(*[F.lit(x) for lang, n in sorted(totals.items()) for x in (lang, n * min_freq)]) if totals else None
    members = counts.where(F.col("n") >= floor[F.col("lang")]).select("lang", "gram").toPandas() if totals else pd.DataFrame({"lang": [], "gram": []})
    counts.unpersist()
    return Filters(members, totals)


def decide(docs: DataFrame, filters: Filters, text_col: str = "text") -> Column:
    """A column of docs: struct of lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)

    @F.pandas_udf("lang_pred string, score double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = shared.value
        yield from (pd.DataFrame([model.decide(x) for x in t], columns=["lang_pred", "score"]) for t in texts)
        give_back()

    return of(F.col(f"`{text_col}`"))


def identify(docs: DataFrame, filters: Filters, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    kept = drop_clashes(docs, "lang_pred", "score", "__lang")
    return kept.withColumn("__lang", decide(kept, filters, text_col)).select(*[F.col(f"`{c}`") for c in kept.columns], "__lang.lang_pred", "__lang.score")
