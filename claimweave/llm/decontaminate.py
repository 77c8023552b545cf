"""Benchmark decontamination: size-partitioned MinHash containment search, verified on exact shingles.

An item is found in a document if the document holds at least ``containment`` of the item's distinct
five-word shingles.  Items are partitioned by size (number of shingles, in powers of two); each class
has a MinHash sketch of the item's k smallest shingle hashes, where k follows from the class's upper
size bound u:  k = u - ceil(t u) + 1.  A document with a share t of an item lacks at most k - 1 of its
shingles, so it holds one of any k of them: the sketches miss nothing.  Documents are shingled whole
and looked up in the sketches; what is hit is verified on the words themselves.

The items are the query set, searched in slices of about ``slice_bytes`` of text: one slice is broadcast
and alive at a time, so memory has a fixed bound however large the benchmark is, and a benchmark of
several slices costs a pass over the documents for each.

Words are runs of ASCII letters, digits and bytes above 127, A-Z lower-cased.  Defined results: items
with fewer words than a shingle have one shingle, all their words; items without a word are never
found; null texts have no words; repeated rows repeat in the result; null item ids are kept.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SHINGLE = 5
CONTAINMENT = 0.8
#: Bytes of benchmark text whose sketches are broadcast at once, some 40 times as many in a worker.
SLICE_BYTES = 8 << 20
#: Bytes of text that one step hashes; a step holds some 50 bytes of arrays for each.
SEGMENT = 1 << 19
HIT = "array<struct<item_id:bigint,n_shingles:int,n_found:int>>"
_WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_BASE = 0x9E3779B97F4A7C15 | 1
_LUT = np.array([c if c >= 128 or chr(c).isalnum() else 0 for c in bytes(range(256)).lower()], dtype=np.uint64)


def words_of(text: str | None) -> list[bytes]:
    return _WORDS.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def shingles_of(words: list[bytes], k: int = SHINGLE) -> set[bytes]:
    """Distinct shingles; fewer words than k give one shingle of them all."""
    if not words:
        return set()
    return {b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64."""
    steps = np.full(n, base, dtype=np.uint64)
    steps[0] = 1
    return np.cumprod(steps, dtype=np.uint64)


class Rolling:
    """Hashes of all word shingles of many texts at once, from prefix sums modulo 2**64."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            self.power, self.inverse = _powers(_BASE, n), _powers(pow(_BASE, -1, 1 << 64), n)

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and hash of each word."""
        codes = _LUT[np.frombuffer(data, dtype=np.uint8)]
        inside = np.concatenate([[False], codes != 0, [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        start, end = edge[::2], edge[1::2]
        self._grow(len(codes) + 1)
        total = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(codes * self.power[: len(codes)], dtype=np.uint64)])
        h = (total[end] - total[start]) * self.inverse[start]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return start, h ^ (h >> np.uint64(29))

    @staticmethod
    def shingles(h: np.ndarray, k: int) -> np.ndarray:
        """Hash of each k words in a row."""
        out = np.zeros(max(0, len(h) - k + 1), dtype=np.uint64)
        for j in range(k):
            out = out * np.uint64(0x94D049BB133111EB) + h[j : len(h) - k + 1 + j]
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return out ^ (out >> np.uint64(32))


def segments(text: bytes, k: int = SHINGLE) -> Iterator[bytes]:
    """A text in parts of about SEGMENT bytes that share k-1 words, so that every shingle lies in one."""
    at = 0
    while len(text) - at > 2 * SEGMENT:
        end = next((m.start() for m in re.compile(rb"[^0-9A-Za-z\x80-\xff]").finditer(text, at + SEGMENT)), len(text))
        yield text[at:end]
        back = 256
        while len(own := list(_WORDS.finditer(text, max(at, end - back), end))) <= k and end - back > at:
            back *= 2
        at = max(at + 1, own[-k + 1].start()) if len(own) >= k and end < len(text) else end
    yield text[at:]


class Sketches:
    """Items of one slice: their sketches by size class and their shingles for verification."""

    def __init__(self, items: list[tuple[int | None, str | None]], containment: float = CONTAINMENT):
        self.containment, rolling = containment, Rolling()
        self.items: list[tuple[int | None, int, frozenset[bytes]]] = []
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        hashes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for item_id, text in items:
            words = words_of(text)
            if not words:
                continue
            k, own = min(SHINGLE, len(words)), shingles_of(words)
            of = np.unique(rolling.shingles(rolling.words(b" ".join(words))[1], k))
            upper = (1 << len(own).bit_length()) - 1
            sketch = of[: min(len(of), upper - math.ceil(containment * upper) + 1)]
            hashes[k] += [(int(h), len(self.items)) for h in sketch]
            self.items.append((item_id, k, frozenset(own)))
        for k, pairs in hashes.items():
            pairs.sort()
            self.tables[k] = (np.array([h for h, _ in pairs], dtype=np.uint64), np.array([i for _, i in pairs], dtype=np.int64))

    def _candidates(self, texts: list[bytes], rolling: Rolling) -> dict[int, set[int]]:
        """Text -> items one of whose sketch hashes it holds."""
        got: dict[int, set[int]] = defaultdict(set)
        data = b"\x00".join(texts) + b"\x00"
        ends = np.cumsum([len(t) + 1 for t in texts])
        start, h = rolling.words(data)
        doc = np.searchsorted(ends, start, side="right")
        for k, (table, item) in self.tables.items():
            of = rolling.shingles(h, k)
            lo = np.searchsorted(table, of)
            hit = np.flatnonzero((doc[: len(of)] == doc[k - 1 :][: len(of)]) & (table[np.minimum(lo, len(table) - 1)] == of))
            for p in hit:
                for q in range(lo[p], np.searchsorted(table, of[p], side="right")):
                    got[int(doc[p])].add(int(item[q]))
        return got

    def find(self, texts: list[str | None]) -> list[list[tuple[int | None, int, int]]]:
        """Per text: (item, its shingles, those found) for each item that it contains."""
        rolling, out = Rolling(), [[] for _ in texts]
        parts: list[tuple[int, bytes]] = []
        held = 0
        maybe: dict[int, set[int]] = defaultdict(set)

        def look() -> None:
            if parts:
                for p, items in self._candidates([t for _, t in parts], rolling).items():
                    maybe[parts[p][0]] |= items

        for d, text in enumerate(texts):
            for part in segments(text.encode("utf-8", "surrogatepass")) if text else ():
                parts.append((d, part))
                held += len(part)
                if held > SEGMENT:
                    look()
                    parts, held = [], 0
        look()
        for d, items in maybe.items():
            words = words_of(texts[d])
            sets = {k: {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} for k in {self.items[i][1] for i in items}}
            for i in sorted(items):
                item_id, k, own = self.items[i]
                n = len(own & sets[k])
                if n >= self.containment * len(own) - 1e-9:
                    out[d].append((item_id, len(own), n))
        return out


def _finder(shared):
    @F.pandas_udf(HIT)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sketches = shared.value
        for t in texts:
            yield pd.Series([[{"item_id": i, "n_shingles": n, "n_found": f} for i, n, f in own] for own in sketches.find(t.tolist())])

    return of


def _blocks(benchmark: DataFrame, item_col: str, item_text: str, containment: float, slice_bytes: int) -> Iterator[tuple[Callable[[Column], Column], Callable[[DataFrame], DataFrame]]]:
    """Per slice of the benchmark the finder and what to do with its rows.

    One slice's sketches are alive at a time: the rows of a slice are written before the next is built.
    Rows of the last slice stay a plan.
    """
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(f"`{item_col}`").cast("bigint").alias("id"), F.col(f"`{item_text}`").alias("text")).distinct()
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    n = size // slice_bytes + 1
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id", "text").collect()
        shared = spark.sparkContext.broadcast(Sketches([(r["id"], r["text"]) for r in part], containment))
        yield _finder(shared), (lambda df: df) if k == n - 1 else lambda df: materialize(df, "decontaminate")
        if k < n - 1:
            shared.destroy()


def contained_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", containment: float = CONTAINMENT, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found for each item that a document contains."""
    own = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    out = None
    for find, settle in _blocks(benchmark, item_col, item_text, containment, slice_bytes):
        found = own.select("doc_id", F.explode(find(F.col("text"))).alias("hit"))
        part = settle(found.select("doc_id", "hit.item_id", "hit.n_shingles", "hit.n_found"))
        out = part if out is None else out.unionByName(part)
    return out


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", containment: float = CONTAINMENT, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows of docs, all columns as they are, that contain no item."""
    for find, settle in _blocks(benchmark, item_col, item_text, containment, slice_bytes):
        docs = settle(docs.where(F.size(find(F.col(f"`{text_col}`"))) == 0))
    return docs
