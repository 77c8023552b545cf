"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score of features x is  sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j).  The pair sum
costs linear time by the identity  1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).

Features: the distinct words of the whole text, hashed (length-normalised), ``STATS`` about its
structure, and the table's n_chars as metadata.  The model is fitted on at most ``sample_rows``
labelled rows, those with the smallest hash of their id, and applied to every row.

Defined results: null texts count as empty; an empty text is scored from its statistics alone; a
null n_chars counts as the length of the text; of several labels of one id the mean decides (0.5
and more: 1), null labels don't count; without labels of both kinds every score is the mean label
(1.0 if there is none).  Equal rows get equal scores; result columns replace input columns of the
same name.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_clashes, give_back

DIM = 1 << 18
RANK = 8
STATS = (
    "log words", "log characters", "characters a word", "upper-case share", "digit share", "other-sign share", "non-ASCII share", "distinct words share", "top word share",
    "repeated neighbours share", "words a line", "repeated lines share", "signs at word ends", "lone signs share", "log metadata length", "metadata length against text",
)


def features(text: str | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashed distinct words (sorted) and the statistics."""
    text = text or ""
    words = text.split()
    n, size = len(words), max(1, len(text))
    lower = text.lower().split()
    counts = Counter(lower)
    raw = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    kinds = np.bincount(_KIND[raw], minlength=6) / max(1, len(raw))
    lines = [x for x in text.split("\n") if x.strip()]
    given = float(n_chars) if n_chars is not None and n_chars == n_chars else float(len(text))
    stats = np.array(
        [
            np.log1p(n), np.log1p(len(text)), size / max(1, n), kinds[1], kinds[2], kinds[3], kinds[4], len(counts) / max(1, n), max(counts.values(), default=0) / max(1, n),
            sum(a == b for a, b in zip(lower, lower[1:], strict=False)) / max(1, n), np.log1p(n / max(1, len(lines))), 1 - len(set(lines)) / max(1, len(lines)),
            sum(not w[-1].isalnum() for w in words) / max(1, n), sum(len(w) == 1 and not w.isalnum() for w in words) / max(1, n), np.log1p(max(0.0, given)), np.log1p(max(0.0, given)) - np.log1p(len(text)),
        ]
    )
    hashed = np.unique(np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) % DIM for w in counts), dtype=np.int64, count=len(counts)))
    return hashed, stats


def _kinds() -> np.ndarray:
    """Byte -> 0 lower case, 1 upper case, 2 digit, 3 other sign, 4 not ASCII, 5 white space."""
    table = np.full(256, 3)
    for c in range(256):
        table[c] = 4 if c >= 128 else 5 if chr(c).isspace() else 2 if chr(c).isdigit() else 1 if chr(c).isupper() else 0 if chr(c).islower() else 3
    return table


_KIND = _kinds()


class Machine:
    """Weights of the linear part and factors of the pairs; index DIM + k is statistic k."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias = 0.0
        self.w = np.zeros(DIM + len(STATS), dtype=np.float32)
        self.v = rng.normal(0, 0.02, (DIM + len(STATS), RANK)).astype(np.float32)
        self.mean, self.std, self.constant = np.zeros(len(STATS)), np.ones(len(STATS)), None

    def _row(self, hashed: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        z = np.clip((stats - self.mean) / self.std, -4, 4) / 2
        x = np.concatenate([np.full(len(hashed), 1 / np.sqrt(max(1, len(hashed)))), z])
        return np.concatenate([hashed, DIM + np.arange(len(STATS), dtype=hashed.dtype)]), x.astype(np.float32)

    def score(self, hashed: np.ndarray, stats: np.ndarray) -> float:
        if self.constant is not None:
            return self.constant
        at, x = self._row(hashed, stats)
        vx = self.v[at] * x[:, None]
        pairs = 0.5 * float((vx.sum(axis=0) ** 2 - (vx**2).sum(axis=0)).sum())
        return float(1 / (1 + np.exp(-np.clip(self.bias + float(self.w[at] @ x) + pairs, -30, 30))))

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.05, decay: float = 1e-5, seed: int = 7) -> Machine:
        """Logistic loss, adaptive-gradient steps over shuffled batches."""
        if not len(labels) or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(labels) else 1.0
            return self
        stats = np.array([s for _, s in rows])
        self.mean, self.std = stats.mean(axis=0), stats.std(axis=0) + 1e-6
        packed = [self._row(*r) for r in rows]
        rng = np.random.default_rng(seed)
        self.bias, seen_b = float(np.log(labels.mean() / (1 - labels.mean()))), 1.0
        seen_w, seen_v = np.ones_like(self.w) * 1e-2, np.ones_like(self.v) * 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(packed))
            for k in range(0, len(order), batch):
                own = order[k : k + batch]
                at = np.concatenate([packed[i][0] for i in own])
                x = np.concatenate([packed[i][1] for i in own])
                lens = np.array([len(packed[i][0]) for i in own])
                first = np.concatenate([[0], np.cumsum(lens)[:-1]])
                vx = self.v[at] * x[:, None]
                total = np.add.reduceat(vx, first, axis=0)
                raw = self.bias + np.add.reduceat(self.w[at] * x, first) + 0.5 * (total**2 - np.add.reduceat(vx**2, first, axis=0)).sum(axis=1)
                err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[own]) / len(own)
                e = np.repeat(err, lens)
                spots, back = np.unique(at, return_inverse=True)
                gw = np.bincount(back, weights=e * x) + decay * self.w[spots]
                grad = (e * x)[:, None] * (np.repeat(total, lens, axis=0) - vx)
                gv = np.stack([np.bincount(back, weights=grad[:, f]) for f in range(RANK)], axis=1) + decay * self.v[spots]
                seen_w[spots] += gw**2
                seen_v[spots] += gv**2
                seen_b += err.sum() ** 2
                self.w[spots] -= (rate * gw / np.sqrt(seen_w[spots])).astype(np.float32)
                self.v[spots] -= (rate * gv / np.sqrt(seen_v[spots])).astype(np.float32)
                self.bias -= rate * err.sum() / np.sqrt(seen_b)
        return self


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_col: str | None = "n_chars", label_col: str = "quality", sample_rows: int = 12_000) -> Machine:
    """A machine fitted on at most sample_rows rows of docs that have a label."""
    ids = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("__label"))
    # Ids, not texts, are ordered; the sample has a fixed bound, so it may be broadcast.
    sample = ids.orderBy(F.xxhash64("__id"), "__id").limit(sample_rows)
    meta = F.col(meta_col).cast("double") if meta_col and meta_col in docs.columns else F.lit(None).cast("double")
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("__text"), meta.alias("__meta")).join(F.broadcast(sample), F.col("__doc") == F.col("__id"))

    @F.pandas_udf("hashed binary, stats binary")
    def extract(texts: pd.Series, metas: pd.Series) -> pd.DataFrame:
        got = [(h.astype("<i4").tobytes(), s.astype("<f8").tobytes()) for h, s in map(features, texts, metas)]
        give_back()
        return pd.DataFrame(got, columns=["hashed", "stats"])

    # An id that repeats in docs gives one row, so the bound holds.
    unique = rows.groupBy("__id", "__label").agg(F.min(F.struct("__text", "__meta")).alias("r"))
    got = unique.select("__id", "__label", extract("r.__text", "r.__meta").alias("f")).select("__id", "__label", "f.*").toPandas().sort_values("__id")
    # As bytes: the driver would hold an object for every number of a list.
    rows = [(np.frombuffer(h, "<i4"), np.frombuffer(s, "<f8")) for h, s in zip(got["hashed"], got["stats"], strict=True)]
    return Machine().fit(rows, got["__label"].to_numpy(dtype=np.float64))


def scorer(docs: DataFrame, machine: Machine, text_col: str = "text", meta_col: str | None = "n_chars") -> Column:
    """A column of docs: the score of its text and metadata."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    @F.pandas_udf("double")
    def of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = shared.value
        yield from (pd.Series([model.score(*features(t, m)) for t, m in zip(texts, metas, strict=True)], dtype=float) for texts, metas in parts)
        give_back()

    meta = F.col(f"`{meta_col}`").cast("double") if meta_col and meta_col in docs.columns else F.lit(None).cast("double")
    return of(F.col(f"`{text_col}`"), meta)


def score(docs: DataFrame, machine: Machine, text_col: str = "text", meta_col: str | None = "n_chars") -> DataFrame:
    """docs with score (0 to 1) and predicted."""
    kept = drop_clashes(docs, "score", "predicted")
    return kept.withColumn("score", scorer(kept, machine, text_col, meta_col)).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
