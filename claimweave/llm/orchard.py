"""Vector code compression: a codebook per part of the vectors, searched by Orchard's method.

A component x becomes floor(256 x).  Vectors are cut into ``PARTS`` equal consecutive parts, and each part
has a codebook of up to ``ENTRIES`` entries, fitted by a fixed number of rounds of nearest entry and floored
mean over all rows.  Sums of a round are made per batch, then per entry, so that a round sends at most
PARTS * ENTRIES rows to the driver and a codebook is that long at any size of the table.

Orchard's search: every entry has the list of all entries by distance from it.  A part walks the list of
its nearest entry so far; on a nearer one it goes over to that entry's list.  Visited entries are marked (a
bit each of one integer) and not measured again.  The walk ends at an entry farther from the nearest than
twice the part's own distance: by the triangle inequality neither it nor any after it is as near.  All rows
of a batch walk at the same time in numpy, each with its own list and place.

Defined results: null vectors and those with null or non-finite components have no row.  Lengths may
differ: shorter vectors count as filled up with zeros to the longest, and that to a multiple of PARTS.
Components beyond +-2^26 after scaling count as that bound, so that all sums fit a long.  An id that repeats
starts one entry, by its smallest vector; a null id counts after all others; ties go to the lower entry;
with fewer ids than ENTRIES the codebooks are shorter.  Repeated rows each give a row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

PARTS, ENTRIES, ROUNDS = 16, 64, 2
SCALE, BOUND = 256, 1 << 26
#: Rows that walk together.
STEP = 8192


def whole_vectors(vec_col: str) -> tuple[Column, Column]:
    """Whether a row takes part, and its vector in whole numbers."""
    v = F.col(f"`{vec_col}`").cast("array<double>")
    sound = v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    held = lambda x: F.greatest(F.lit(-float(BOUND)), F.least(F.lit(float(BOUND)), x * SCALE))
    return F.coalesce(sound, F.lit(False)), F.transform(v, lambda x: F.floor(held(x)).cast("bigint"))


class Orchard:
    """Exact nearest entries of one codebook (entries x width whole numbers)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        between = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        self.lists = np.argsort(between, axis=1, kind="stable")
        self.far = np.take_along_axis(between, self.lists, axis=1)
        self.measured = 0

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each row, ties to the lower index."""
        n, k = len(parts), len(self.entries)
        best = np.zeros(n, np.int64)
        least = ((parts - self.entries[0]) ** 2).sum(axis=1)
        seen = np.ones(n, np.uint64)
        place = np.zeros(n, np.int64)
        walk = np.arange(n)
        while len(walk):
            at, p = best[walk], place[walk]
            # Squared: an entry beyond twice the distance can be neither nearer nor as near.
            on = self.far[at, p] <= 4 * least[walk]
            walk, at, p = walk[on], at[on], p[on]
            entry = self.lists[at, p]
            bit = np.uint64(1) << entry.astype(np.uint64)
            new = (seen[walk] & bit) == 0
            place[walk] += 1
            w, e = walk[new], entry[new]
            seen[w] |= bit[new]
            self.measured += len(w)
            d = ((parts[w] - self.entries[e]) ** 2).sum(axis=1)
            better = (d < least[w]) | ((d == least[w]) & (e < best[w]))
            w, e = w[better], e[better]
            best[w], least[w], place[w] = e, d[better], 0
            walk = walk[place[walk] < k]
        return best, least


def _parts(column: pa.Array, width: int) -> np.ndarray:
    """rows x PARTS x width, filled up with zeros."""
    out = np.zeros((len(column), PARTS * width), np.int64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = column.flatten().to_numpy(zero_copy_only=False)
    return out.reshape(len(column), PARTS, width)


def _searches(books: np.ndarray) -> list[Orchard]:
    return [Orchard(b) for b in books]


def _sums(books: np.ndarray):
    """Count and sums of the parts nearest to each entry, per batch."""
    width = books.shape[2]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = _searches(books)
        for b in batches:
            parts = _parts(b.column("v"), width)
            count, total = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
            for at in range(0, len(parts), STEP):
                for p, search in enumerate(searches):
                    some = parts[at : at + STEP, p]
                    best, _ = search.nearest(some)
                    count[p] += np.bincount(best, minlength=books.shape[1])
                    np.add.at(total[p], best, some)
            part, entry = np.nonzero(count)
            columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), pa.array(total[part, entry].tolist(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "n", "total"])

    return of


def _codes(books: np.ndarray):
    """Code and error of each row, in place of its vector."""
    width = books.shape[2]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = _searches(books)
        for b in batches:
            parts = _parts(b.column("v"), width)
            codes, error = np.zeros(parts.shape[:2], np.uint8), np.zeros(len(parts), np.int64)
            for at in range(0, len(parts), STEP):
                for p, search in enumerate(searches):
                    best, least = search.nearest(parts[at : at + STEP, p])
                    codes[at : at + STEP, p] = best
                    error[at : at + STEP] += least
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return of


def train(rows: DataFrame, width: int, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (parts x entries x width) of rows (id, v)."""
    firsts = rows.groupBy("id").agg(F.min("v").alias("v")).orderBy(F.col("id").asc_nulls_last()).limit(ENTRIES).collect()
    firsts.sort(key=lambda r: (r["id"] is None, r["id"]))
    start = pa.array([r["v"] for r in firsts], pa.list_(pa.int64()))
    books = np.ascontiguousarray(_parts(start, width).transpose(1, 0, 2))
    for _ in range(rounds):
        found = rows.select("v").mapInArrow(_sums(books), "part int, entry int, n bigint, total array<bigint>")
        sums = [F.sum(F.col("total")[i]).alias(f"s{i}") for i in range(width)]
        books = books.copy()
        for r in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *sums).collect():  # PARTS * ENTRIES rows at most
            books[r["part"], r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
    return books


def compress(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row that takes part."""
    sound, v = whole_vectors(vec_col)
    rows = table.where(sound).select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").alias("label"), v.alias("v"))
    longest = rows.agg(F.max(F.size("v")).alias("n")).first()["n"]
    if longest is None:
        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        return table.sparkSession.createDataFrame([], f"vec_id {kinds['id']}, code string, error bigint, label_error bigint, codebooks_sha256 string")
    width = max(1, -(-longest // PARTS))
    books = train(rows, width)
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name != "v")
    coded = materialize(rows.mapInArrow(_codes(books), f"{kinds}, code string, error bigint"), "codes")
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of_label")
    name = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    joined = coded.join(totals, coded["label"].eqNullSafe(F.col("of_label")), "left")
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(name).alias("codebooks_sha256"))
