"""MinHash near-duplicates, candidates judged by sequential Bayesian verification.

A text's set is its distinct word shingles, as 64-bit hashes.  ``HASHES`` minimum hashes make its
signature, ``BANDS`` runs of ``ROWS`` of them its keys.  Two sets of Jaccard value J share a key but for
(1 - J ** ROWS) ** BANDS of all pairs: 3.2e-6 at 0.8, less above.

A candidate's signatures are compared ``BATCH`` hashes at a time.  With m of n hashes equal and a flat
prior, the posterior probability that J reaches the threshold is P(Binomial(n + 1, threshold) <= m); a
pair goes as soon as that falls under ``miss * (1 - threshold) / batches``.  A pair at the threshold is
then lost with probability ``miss`` at most, one above it less often.  Every survivor is decided by the
intersection and union of the full sets, in whole numbers.

What travels: equal sets are one node.  Nodes that follow each other in a key's sorted bucket meet
first, so a group of copies costs as many pairs as it has members; of the survivors each node proves
its pair with the smallest partner.  Only buckets whose members are still in several components are
then compared whole, cell by cell of two chunks of ``CHUNK`` nodes: first by signatures alone, each pair
only in the first key it shares; then, with their sets, the nodes that have a survivor.  A cell joins
components and never lists pairs.

Defined results: null, empty and blank texts have an empty set, which links with nothing: each such row
is its own class.  Texts with fewer words than a shingle are one shingle of all words.  Repeated rows
each give a row.  component_id is the smallest non-null id of the class (null if it has none); kept says
whether the row's id equals it, so that rows repeating the smallest id are all kept.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .simhash import components

BANDS, ROWS, BATCH = 24, 4, 16
HASHES = BANDS * ROWS
CHUNK = 512
MISS = 1e-6
#: Bytes of a text that are split into words at a time.
SLICE = 1 << 20
_WHITE = re.compile(rb"[\x20\x09-\x0D]")
_RNG = np.random.default_rng(12)
_FACTORS = _RNG.integers(0, 1 << 64, HASHES, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 64, HASHES, dtype=np.uint64)
_PLACES = _RNG.integers(0, 1 << 64, 64, dtype=np.uint64) | np.uint64(1)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class _WordHashes(dict):
    """Hashes of the words of a task, forgotten when there are many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word, 42)
        return h


def word_hashes(text: bytes | None, seen: _WordHashes) -> np.ndarray:
    """The hash of each word, in order."""
    parts, at = [np.zeros(0, np.uint64)], 0
    while text and at < len(text):
        cut = _WHITE.search(text, at + SLICE) if len(text) - at > SLICE else None
        end = cut.start() if cut else len(text)
        words = text[at:end].lower().split()
        parts.append(np.fromiter(map(seen.__getitem__, words), np.uint64, len(words)))
        at = end
    return np.concatenate(parts)


def shingle_set(text: bytes | None, k: int, seen: _WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles."""
    words = word_hashes(text, seen)
    if not len(words):
        return words
    k = min(k, len(words))
    mixed = np.full(len(words) - k + 1, k, np.uint64)
    for place in range(k):
        mixed += words[place : len(words) - k + 1 + place] * _PLACES[place]
    mixed = (mixed ^ (mixed >> np.uint64(32))) * _MIX
    return np.unique(mixed ^ (mixed >> np.uint64(29)))


def signature(hashes: np.ndarray) -> np.ndarray:
    """HASHES minimum hashes of 32 bits."""
    least = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        least = np.minimum(least, (hashes[at : at + 512, None] * _FACTORS + _SHIFTS).min(axis=0))
    return (least >> np.uint64(32)).astype("<u4")


def least_equal(threshold: float, miss: float = MISS) -> list[int]:
    """For each batch, the equal hashes below which the posterior rules a pair out."""
    bound = miss * (1 - threshold) / (HASHES // BATCH)
    found = []
    for n in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, 0
        while True:
            below += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if below >= bound:
                break
            m += 1
        found.append(m)
    return found


def plausible(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of two signature matrices no batch rules out."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for batch, bound in enumerate(least):
        at = slice(batch * BATCH, (batch + 1) * BATCH)
        equal[alive] += (a[alive, at] == b[alive, at]).sum(axis=1)
        alive = alive[equal[alive] >= bound]
    out = np.zeros(len(a), bool)
    out[alive] = True
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, for sorted sets that are not empty."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    if 100 * len(b) < percent * len(a):
        return False
    common = int(np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b))
    return 100 * common >= percent * (len(a) + len(b) - common)


def _matrix(column: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u4").reshape(-1, HASHES)


def _sketches(k: int):
    """(id, text, mark) to (id, mark, n, node, signature); node and signature are null for an empty set."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _WordHashes()
        for b in batches:
            sets = (shingle_set(t.as_py(), k, seen) for t in b.column("text"))
            rows = [(len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s).tobytes()) if len(s) else (0, None, None) for s in sets]
            made = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("mark"), *made], names=["id", "mark", "n", "node", "signature"])

    return of


def _packed(k: int):
    """(node, text) to (node, the set)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _WordHashes()
        for b in batches:
            sets = [shingle_set(t.as_py(), k, seen).tobytes() for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], names=["node", "packed"])

    return of


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that follow each other in a bucket, from (key, node) rows sorted by both."""
    key = node = None
    for b in batches:
        keys, nodes = b.column(0).to_pylist(), b.column(1).to_pylist()
        pairs = [(y, n) for x, y, k, n in zip([key, *keys], [node, *nodes], keys, nodes, strict=False) if x == k]
        key, node = (keys[-1], nodes[-1]) if keys else (key, node)
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])


def _plausible_pairs(least: list[int]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                stay = plausible(_matrix(b.column("sa").to_pylist()), _matrix(b.column("sb").to_pylist()), least)
                yield b.select(["a", "b"]).filter(pa.array(stay))

    return of


def _similar_pairs(percent: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = zip(b.column("pa"), b.column("pb"), strict=True)
            stay = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in sets]
            yield b.select(["a", "b"]).filter(pa.array(stay, pa.bool_()))

    return of


def _cells(of_cell, schema: pa.Schema):
    """of_cell(columns of one cell as lists) for each run of equal (key, cell)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:2] != at:
                    if held:
                        yield pa.RecordBatch.from_pylist(of_cell(held), schema)
                    at, held = row[:2], []
                held.append(row)
        if held:
            yield pa.RecordBatch.from_pylist(of_cell(held), schema)

    return of


def _apart(rows: list[tuple], label: np.ndarray, sigs: np.ndarray, least: list[int]) -> Iterator[tuple[np.ndarray, int]]:
    """For each distance in the cell: the rows i whose pair (i, i + distance) may be similar, is of two components, and is met in no other cell."""
    chunk = np.array([r[3] for r in rows])
    one_chunk = chunk.min() == chunk.max()
    for lag in range(1, len(rows)):
        at = np.flatnonzero(label[:-lag] != label[lag:])
        if not one_chunk:
            at = at[chunk[at] != chunk[at + lag]]
        if len(at):
            yield at[plausible(sigs[at], sigs[at + lag], least)], lag


def _survivors(least: list[int]):
    """Rows (key, cell, node, chunk, root, band, signature) of a cell that have a survivor in another component."""

    def of(rows: list[tuple]) -> list[dict]:
        numbers: dict[bytes, int] = {}
        label = np.array([numbers.setdefault(r[4], len(numbers)) for r in rows])
        if len(numbers) < 2:
            return []
        sigs, band, found = _matrix([r[6] for r in rows]), rows[0][5], set()
        bands = sigs.reshape(len(rows), BANDS, ROWS)
        for at, lag in _apart(rows, label, sigs, least):
            first = (bands[at] == bands[at + lag]).all(axis=2).argmax(axis=1) == band
            found.update(at[first].tolist(), (at[first] + lag).tolist())
        return [dict(zip(("key", "cell", "node", "chunk", "root", "signature"), (*rows[i][:5], rows[i][6]), strict=True)) for i in sorted(found)]

    return of


def _links(least: list[int], percent: int):
    """Links that join all components of a cell of rows (key, cell, node, chunk, root, signature, packed) which hold a similar pair."""

    def of(rows: list[tuple]) -> list[dict]:
        numbers: dict[bytes, int] = {}
        label = np.array([numbers.setdefault(r[4], len(numbers)) for r in rows])
        sigs, sets = _matrix([r[5] for r in rows]), [np.frombuffer(r[6], np.uint64) for r in rows]
        found = []
        for at, lag in _apart(rows, label, sigs, least):
            for i in at.tolist():
                if label[i] != label[i + lag] and similar(sets[i], sets[i + lag], percent):
                    found.append({"a": rows[i][2], "b": rows[i + lag][2]})
                    label[label == label[i + lag]] = label[i]
        return found

    return of


def _mark(text) -> F.Column:
    """A hash that tells the texts of an id apart."""
    return F.xxhash64(text, F.octet_length(text))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4) -> DataFrame:
    """id, mark (hash of the text), n (set size), node (name of the set), signature of every row of docs."""
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.cast("binary").alias("text"), _mark(text).alias("mark"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_sketches(shingle_words), f"id {kind}, mark bigint, n bigint, node binary, signature binary")


def links(docs: DataFrame, made: DataFrame, id_col: str, text_col: str, shingle_words: int, percent: int, miss: float) -> DataFrame:
    """Links (a, b) of nodes that connect all similar sets, from the sketches of docs."""
    least = least_equal(percent / 100, miss)
    first = F.min(F.struct(F.col("id").cast("string").alias("id"), "mark")).alias("first")
    sets = materialize(made.where(F.col("node").isNotNull()).groupBy("node").agg(first, F.min("signature").alias("signature")), "shingle-sets")
    key = [F.concat(F.lit(bytes([b])), F.substring("signature", 4 * ROWS * b + 1, 4 * ROWS)) for b in range(BANDS)]
    keyed = sets.select("node", F.explode(F.array(*key)).alias("whole")).select("node", F.concat(F.substring("whole", 1, 1), F.unhex(F.lpad(F.hex(F.xxhash64("whole")), 16, "0"))).alias("key"))
    several = keyed.groupBy("key").agg(F.count("*").alias("size")).where(F.col("size") > 1)
    shared = materialize(keyed.join(several, "key"), "shared-keys")

    # Neighbours in a bucket: ruled out by signatures, or one of them per node proved by its sets.
    ordered = shared.select("key", "node").repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    pairs = ordered.mapInArrow(_neighbours, "a binary, b binary").distinct()
    signed = pairs.join(sets.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b")
    survived = materialize(signed.mapInArrow(_plausible_pairs(least), "a binary, b binary"), "survivors")
    proofs = survived.groupBy("b").agg(F.min("a").alias("a"))

    text = F.col(f"`{text_col}`")
    texts = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), _mark(text).alias("mark"), text.cast("binary").alias("text"))

    def packed(nodes: DataFrame) -> DataFrame:
        """The sets of nodes, made again from one text each; rows that repeat that text and its id count once."""
        wanted = sets.join(nodes.distinct(), "node").select("node", "first.id", "first.mark")
        same = wanted.join(texts, wanted["id"].eqNullSafe(texts["id"]) & (wanted["mark"] == texts["mark"])).select("node", "text")
        return same.mapInArrow(_packed(shingle_words), "node binary, packed binary").groupBy("node").agg(F.min("packed").alias("packed"))

    known = materialize(packed(proofs.select(F.col("a").alias("node")).union(proofs.select(F.col("b").alias("node")))), "sets")
    both = proofs.join(known.select(F.col("node").alias("a"), F.col("packed").alias("pa")), "a").join(known.select(F.col("node").alias("b"), F.col("packed").alias("pb")), "b")
    near = materialize(both.select("a", "b", "pa", "pb").mapInArrow(_similar_pairs(percent), "a binary, b binary"), "near-pairs")

    # Buckets still of several components, in cells of two chunks.
    placed = materialize(shared.join(components(near), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    mixed = placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where(F.col("lo") != F.col("hi")).select("key")
    full = placed.join(mixed, "key").withColumn("chunks", F.ceil(F.col("size") / CHUNK)).withColumn("chunk", F.pmod(F.xxhash64("node"), "chunks"))
    full = full.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    cells = full.select("key", (F.least("chunk", "other") * F.col("chunks") + F.greatest("chunk", "other")).alias("cell"), "node", "chunk", "root", F.ascii(F.substring("key", 1, 1)).alias("band"))
    weighed = cells.join(sets.select("node", "signature"), "node").select("key", "cell", "node", "chunk", "root", "band", "signature")
    dealt = weighed.repartition("key", "cell").sortWithinPartitions("key", "cell", "node")
    kept = pa.schema([("key", pa.binary()), ("cell", pa.int64()), ("node", pa.binary()), ("chunk", pa.int64()), ("root", pa.binary()), ("signature", pa.binary())])
    open_nodes = materialize(dealt.mapInArrow(_cells(_survivors(least), kept), "key binary, cell bigint, node binary, chunk bigint, root binary, signature binary"), "open-nodes")
    more = packed(open_nodes.select("node").distinct().join(known.select("node"), "node", "left_anti"))
    rows = open_nodes.join(known.unionByName(more), "node").select("key", "cell", "node", "chunk", "root", "signature", "packed")
    rows = rows.repartition("key", "cell").sortWithinPartitions("key", "cell", "node")
    return near.unionByName(rows.mapInArrow(_cells(_links(least, percent), pa.schema([("a", pa.binary()), ("b", pa.binary())])), "a binary, b binary"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 4, percent: int = 80, miss: float = MISS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of docs."""
    made = materialize(sketches(docs, id_col, text_col, shingle_words), "sketches")
    roots = materialize(components(links(docs, made, id_col, text_col, shingle_words, percent, miss)), "roots")
    nodes = made.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("id").alias("least"), F.count("*").alias("rows")).join(roots, "node", "left")
    nodes = nodes.withColumn("root", F.coalesce("root", "node"))
    smallest = nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("rows").alias("rows")).where(F.col("rows") > 1)
    # Rows alone in their class need no join.
    classes = nodes.join(smallest.drop("rows"), "root").select("node", "component_id", F.lit(True).alias("grouped"))
    rows = made.select("id", "n", "node").join(classes, "node", "left").withColumn("component_id", F.when(F.col("grouped"), F.col("component_id")).otherwise(F.col("id")))
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))
