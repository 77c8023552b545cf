"""SimHash near-duplicates by pigeonhole blocks.

A fingerprint bit is the majority over the XXH64 values (seed 42) of a text's word shingles.  Two
fingerprints that differ in at most d bits agree on one of d+1 blocks of bits, so all links are found
within the buckets of fingerprints that share a block.  A bucket above ``bucket_rows`` is dealt again
by d+1 blocks of the bits it does not yet share, and so on, which stays exact at any size: nothing is
skipped, and no bucket reaches a task whole before it is small.  A bucket compares its members in
numpy and keeps only links that connect something new, never all pairs.

Only distinct fingerprints are compared, so equal texts cost one row.  Components are found by
minimum labels with pointer jumping; what travels is one row per fingerprint.

``one_of_each`` is the stage that keeps one text of each group.  Texts whose fingerprints link as above
are near copies, and so are texts whose five-word shingles have a similarity of 0.8 or more, which cut or
appended texts reach with more differing bits.  For these each set of distinct shingles gets ``BANDS``
keys of ``BAND_ROWS`` minimum hashes each.  A pair of Jaccard value J shares a key
but for (1 - J ** BAND_ROWS) ** BANDS of all pairs, whatever the edit: 2.2e-4 at 0.8, less above.
Pairs that share a key are verified by the exact Jaccard value of their shingle sets (64-bit hashes),
computed again from the texts.  First neighbours in a bucket's order meet, so that groups of copies
become one component with as many pairs as members; only buckets that still hold several components,
by these links and those of the fingerprints, are then compared whole, in numpy and in place, a large
one chunk against chunk.

Defined results: null, empty and blank texts have fingerprint zero and link like any other; texts
with fewer words than a shingle are one shingle; repeated rows each give a row; component_id is the
smallest non-null doc_id of the component (null if it has none).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_words, materialize

ALL_BITS = (1 << 64) - 1
#: 64-bit words of a wide fingerprint.
WIDE = 4
#: Keys of a shingle set, and minimum hashes in a key.
BANDS, BAND_ROWS = 16, 4
_RNG = np.random.default_rng(42)
_FACTORS = _RNG.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_SHIFTS = _RNG.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64)
#: Pairs that agree in fewer minimum hashes are not compared exactly; at 0.8 that befalls less than one in 1e6.
LEAST_AGREED = BANDS * BAND_ROWS // 2
#: Nodes that a task joins at once.
FOREST_NODES = 200_000
#: With wide fingerprints, buckets are dealt again by finer blocks up to this level.
LEVELS = 2


def fingerprint(text: str | None, k: int = 3) -> int:
    """The fingerprint as an unsigned integer."""
    words = lower_words(text)
    if not words:
        return 0
    shingles = zip(*[words[i:] for i in range(k)], strict=False) if len(words) >= k else [words]
    digest, join = xxhash.xxh64_digest, b" ".join
    counts, n, held = np.zeros(64, dtype=np.int64), 0, []
    for s in shingles:
        held.append(digest(join(s), 42))
        if len(held) == 4096:
            counts, n, held = counts + _bit_counts(held), n + len(held), []
    if held:
        counts, n = counts + _bit_counts(held), n + len(held)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def _bit_counts(digests: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def wide_fingerprint(text: str | None, k: int = 5) -> bytes:
    """The 64 * WIDE bit fingerprint of a text's distinct k-word shingles; one bit in two of them all decides.

    Null and blank texts give zeros, texts with fewer words than k are one shingle.
    """
    words = lower_words(text)
    if not words:
        return bytes(8 * WIDE)
    shingles = zip(*[words[i:] for i in range(k)], strict=False) if len(words) >= k else [words]
    digest, join = xxhash.xxh64_intdigest, b" ".join
    distinct = np.unique(np.fromiter((digest(join(s), 42) for s in shingles), dtype=np.uint64))
    counts = np.zeros(64 * WIDE, dtype=np.int64)
    for at in range(0, len(distinct), 4096):
        part = distinct[at : at + 4096]
        for w in range(WIDE):
            x = (part + np.uint64((w + 1) * 0x9E3779B97F4A7C15 & ALL_BITS)) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
            counts[64 * w : 64 * w + 64] += np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > len(distinct)).tobytes()


def wide_bits(similarity: float) -> int:
    """Differing bits of wide fingerprints at a Jaccard value."""
    return math.floor(64 * WIDE * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def _wide_udf(k: int):
    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([wide_fingerprint(t, k) for t in texts], dtype=object)

    return of


def _print_udf(k: int):
    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t, k) for t in texts], dtype=np.uint64).view(np.int64))

    return of


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of every row."""

    return docs.select(F.col(id_col).alias("doc_id"), _print_udf(shingle_words)(text_col).alias("fp"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def blocks(mask: int, d: int) -> list[int]:
    """mask joined with each of d+1 blocks of the bits that it lacks."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * k // (d + 1) for k in range(d + 2)]
    return [mask | sum(1 << b for b in free[a:e]) for a, e in zip(cuts, cuts[1:], strict=False)]


def _bucket_links(d: int, wide_d: int | None):
    """Links inside buckets, from (mask, cell, fp[, wide]) rows that come sorted by mask, bucket (mask & fp) and cell.

    Nodes of the links are fp, or wide followed by fp where wide fingerprints verify them.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for b in batches:
            cols = [c.to_numpy() for c in b.columns[:3]]
            if wide_d is not None:
                cols.append(np.frombuffer(b"".join(b.column(3).to_pylist()), dtype=np.uint64).reshape(-1, WIDE))
            if rest is not None:
                cols = [np.concatenate(c) for c in zip(rest, cols, strict=True)]
            mask, cell, fp = cols[:3]
            bucket = mask & fp
            whole = int(np.argmax((mask == mask[-1]) & (bucket == bucket[-1]) & (cell == cell[-1]))) if len(fp) else 0
            rest = [c[whole:] for c in cols]
            yield link(*(c[:whole] for c in cols))
        if rest is not None:
            yield link(*rest)

    def link(mask: np.ndarray, cell: np.ndarray, fp: np.ndarray, wide: np.ndarray | None = None) -> pa.RecordBatch:
        n, bucket = len(fp), mask & fp
        new = np.ones(n, dtype=bool)
        new[1:] = (mask[1:] != mask[:-1]) | (bucket[1:] != bucket[:-1]) | (cell[1:] != cell[:-1])
        group = np.cumsum(new) - 1
        end = np.append(np.flatnonzero(new)[1:], n)[group] if n else np.zeros(0, dtype=np.int64)
        root, found = np.arange(n), []
        at, lag = np.arange(n), 1
        while len(at := at[at + lag < end[at]]):
            near = at[np.bitwise_count(fp[at] ^ fp[at + lag]) <= d]
            near = near[root[near] != root[near + lag]]
            if wide is not None and len(near):
                near = near[np.bitwise_count(wide[near] ^ wide[near + lag]).sum(axis=1) <= wide_d]
            if len(near):
                for i in near:
                    a, c = _find(root, i), _find(root, i + lag)
                    if a != c:
                        root[max(a, c)] = min(a, c)
                        found.append((i, i + lag))
                while (root != root[root]).any():
                    root = root[root]
            lag += 1
        pairs = np.array(found, dtype=np.int64).reshape(-1, 2)
        if wide is None:
            return pa.RecordBatch.from_arrays([pa.array(fp[pairs[:, 0]]), pa.array(fp[pairs[:, 1]])], names=["a", "b"])
        name = lambda rows: pa.array([wide[i].tobytes() + int(fp[i]).to_bytes(8, "big", signed=True) for i in rows], pa.binary())
        return pa.RecordBatch.from_arrays([name(pairs[:, 0]), name(pairs[:, 1])], names=["a", "b"])

    return of


def _find(root: np.ndarray, i: int) -> int:
    while root[i] != i:
        i = root[i]
    return i


def links(distinct: DataFrame, d: int = 3, bucket_rows: int = 4096, wide_d: int | None = None) -> DataFrame:
    """Links (a, b) that connect all distinct fp values within d bits of each other, as chains of such steps.

    With wide_d, distinct also has wide fingerprints, and only pairs within wide_d bits there are linked.
    """
    own = ["fp"] if wide_d is None else ["fp", "wide"]
    node = "bigint" if wide_d is None else "binary"
    bucket = F.col("mask").bitwiseAND(F.col("fp"))
    keyed = distinct.select(*own, F.explode(F.array(*[F.lit(_signed(m)) for m in blocks(0, d)])).alias("mask"))
    found, level = None, 0
    while True:
        level += 1
        sizes = keyed.groupBy("mask", bucket.alias("bucket")).agg(F.count("*").alias("n"))
        big = materialize(sizes.where(F.col("n") > bucket_rows), "big-buckets")
        masks = [r["mask"] for r in big.select("mask").distinct().collect()]  # as many as there are block tables
        placed = keyed.withColumn("bucket", bucket)
        small = (placed.join(big, ["mask", "bucket"], "left_anti") if masks else placed).withColumn("cell", F.lit(0).cast("bigint"))
        if masks and wide_d is not None and level == LEVELS:
            # Near copies agree in most blocks, so finer ones part them no more: chunks of the bucket meet in pairs.
            chunk, other = F.pmod(F.xxhash64(*own), "n_chunks"), F.col("other")
            full = placed.join(big, ["mask", "bucket"]).withColumn("n_chunks", F.ceil(F.col("n") / bucket_rows)).withColumn("chunk", chunk)
            pairs = full.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_chunks") - 1)))
            small = small.unionByName(pairs.withColumn("cell", F.least("chunk", other) * F.col("n_chunks") + F.greatest("chunk", other)).select(*small.columns))
            masks = []
        sorted_small = small.select("mask", "cell", *own).repartition("mask", bucket, "cell").sortWithinPartitions("mask", bucket, "cell", "fp")
        got = sorted_small.mapInArrow(_bucket_links(d, wide_d), f"a {node}, b {node}")
        found = got if found is None else found.unionByName(got)
        if not masks:
            return found
        finer = F.create_map(*[x for m in masks for x in (F.lit(m), F.array(*[F.lit(_signed(f)) for f in blocks(m & ALL_BITS, d)]))])
        split = placed.join(big, ["mask", "bucket"], "left_semi").select(*own, F.explode(finer[F.col("mask")]).alias("mask"))
        keyed = materialize(split.distinct(), "fine-buckets")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of an edge table (a, b): root is the smallest node of its component."""
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "labels")
    while True:
        # The smallest label around a node, then that label's own label.
        around = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = labels.join(around, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        after = materialize(step.join(jump, "root").select("node", "old", F.least("root", "next").alias("root")), "labels")
        labels = after.select("node", "root")
        if after.where(F.col("old") != F.col("root")).isEmpty():
            return labels


def forest(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components, at most one per node and task: chains of neighbouring nodes become short."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[bytes, bytes] = {}

        def top(x: bytes) -> bytes:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        def grown() -> pa.RecordBatch:
            pairs = [(x, r) for x in list(parent) if (r := top(x)) != x]
            parent.clear()
            return pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = top(a), top(b)
                parent[max(a, b)] = min(a, b)
            if len(parent) > FOREST_NODES:
                yield grown()
        yield grown()

    return edges.select("a", "b").repartitionByRange("a", "b").mapInArrow(join, "a binary, b binary")


def rooted(distinct: DataFrame, d: int, bucket_rows: int, wide_d: int | None = None) -> DataFrame:
    """distinct (one row per node) with root, the smallest node of its component."""
    node = F.col("fp") if wide_d is None else F.concat("wide", F.unhex(F.lpad(F.hex("fp"), 16, "0")))
    roots = components(links(distinct, d, bucket_rows, wide_d))
    return distinct.withColumn("node", node).join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).drop("node")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, d: int = 3, bucket_rows: int = 4096) -> DataFrame:
    """doc_id, fp, component_id of every row of docs."""
    prints = materialize(fingerprints(docs, id_col, text_col, shingle_words), "fingerprints")
    distinct = rooted(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), d, bucket_rows)
    smallest = distinct.groupBy("root").agg(F.min("first").alias("component_id"))
    return prints.join(distinct.join(smallest, "root").select("fp", "component_id"), "fp", "left").select("doc_id", "fp", "component_id")


# ---- exact similarity of shingle sets ----


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """The sorted distinct hashes of a text's k-word shingles; none for null and blank texts."""
    words = lower_words(text)
    shingles = zip(*[words[i:] for i in range(k)], strict=False) if len(words) >= k else [words] if words else []
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.unique(np.fromiter((digest(join(s), 42) for s in shingles), dtype=np.uint64))


def minimum_hashes(hashes: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * BAND_ROWS, ALL_BITS, dtype=np.uint64)
    for at in range(0, len(hashes), 1024):
        out = np.minimum(out, (hashes[at : at + 1024, None] * _FACTORS + _SHIFTS).min(axis=0))
    return out


def sketch(text: str | None, k: int = 5) -> bytes:
    """16 bytes that name the shingle set, then the 8 bytes of each key."""
    hashes = shingle_set(text, k)
    least = minimum_hashes(hashes)
    keys = [xxhash.xxh64_digest(least[BAND_ROWS * b : BAND_ROWS * (b + 1)].tobytes(), b) for b in range(BANDS)]
    return (xxhash.xxh3_128_digest(hashes.tobytes()) if len(hashes) else bytes(16)) + b"".join(keys)


def packed_set(text: str | None, k: int = 5) -> bytes:
    """A byte of each minimum hash, then the shingle set."""
    hashes = shingle_set(text, k)
    return minimum_hashes(hashes).astype(np.uint8).tobytes() + hashes.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, dtype=np.uint64, offset=BANDS * BAND_ROWS)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two shingle sets have that Jaccard value or more."""
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    if len(b) < similarity * len(a) - 1e-9 or not len(b):
        return not len(a)
    common = np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b)
    return bool(common >= similarity * (len(a) + len(b) - common) - 1e-9)


def _text_udf(of_text, k: int):
    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([of_text(t, k) for t in texts], dtype=object)

    return of


def _similar_udf(similarity: float):
    @F.pandas_udf("boolean")
    def of(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([similar(_unpacked(x), _unpacked(y), similarity) for x, y in zip(a, b, strict=True)], dtype=bool)

    return of


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes that follow each other in a bucket, from (key, node) rows sorted by both."""
    key = node = None
    for b in batches:
        keys, nodes = b.column(0).to_pylist(), b.column(1).to_pylist()
        pairs = [(y, n) for x, y, k, n in zip([key, *keys], [node, *nodes], keys, nodes, strict=False) if x == k and y != n]
        key, node = (keys[-1], nodes[-1]) if keys else (key, node)
        yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.binary()) for i in (0, 1)], names=["a", "b"])


def _linked_buckets(similarity: float):
    """Links between the roots of a bucket's components, from (key, cell, node, root, packed) rows sorted by key and cell."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if row[:2] != at:
                    yield link(held)
                    at, held = row[:2], []
                held.append(row[2:])
        yield link(held)

    def link(rows: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
        numbers: dict[bytes, int] = {}
        label = np.array([numbers.setdefault(r[1], len(numbers)) for r in rows], dtype=np.int64)
        sets = [_unpacked(r[2]) for r in rows]
        size = np.array([len(s) for s in sets])
        least = np.array([np.frombuffer(r[2], dtype=np.uint8, count=BANDS * BAND_ROWS) for r in rows])
        found, left = [], len(numbers)
        for lag in range(1, len(rows)):
            if left < 2:
                break
            at = np.flatnonzero(label[:-lag] != label[lag:])
            at = at[np.minimum(size[at], size[at + lag]) >= similarity * np.maximum(size[at], size[at + lag]) - 1e-9]
            at = at[(least[at] == least[at + lag]).sum(axis=1) >= LEAST_AGREED]
            for i in at:
                if label[i] != label[i + lag] and similar(sets[i], sets[i + lag], similarity):
                    found.append((i, i + lag))
                    label[label == label[i + lag]] = label[i]
                    left -= 1
        return pa.RecordBatch.from_arrays([pa.array([rows[f[i]][1] for f in found], pa.binary()) for i in (0, 1)], names=["a", "b"])

    return of


def print_links(prints: DataFrame, d: int, bucket_rows: int) -> DataFrame:
    """Links (a, b) that connect the nodes of fingerprints within d bits, from distinct (fp, node) rows."""
    first = materialize(prints.groupBy("fp").agg(F.min("node").alias("first")), "prints")
    same = prints.join(first, "fp").where(F.col("node") != F.col("first")).select(F.col("node").alias("a"), F.col("first").alias("b"))
    found = materialize(links(first.select("fp"), d, bucket_rows), "print-links")
    named = found.join(first.select(F.col("fp").alias("a"), F.col("first").alias("na")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("nb")), "b")
    return same.unionByName(named.select(F.col("na").alias("a"), F.col("nb").alias("b")))


def similar_roots(keyed: DataFrame, sets: DataFrame, known: DataFrame, similarity: float, bucket_rows: int) -> DataFrame:
    """(node, root) of nodes that known links (a, b) connect, or that similarity, from (key, node) rows of shared keys and (node, packed) rows."""
    ordered = keyed.repartitionByRange("key", "node").sortWithinPartitions("key", "node")
    pairs = ordered.mapInArrow(_neighbours, "a binary, b binary").distinct()
    both = pairs.join(sets.select(F.col("node").alias("a"), F.col("packed").alias("pa")), "a").join(sets.select(F.col("node").alias("b"), F.col("packed").alias("pb")), "b")
    near = both.where(_similar_udf(similarity)("pa", "pb")).select("a", "b")
    roots = components(materialize(forest(near.unionByName(known)), "near-pairs"))
    placed = materialize(keyed.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "rooted")
    several = placed.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most")).where(F.col("least") != F.col("most"))
    # Of a component in a bucket every member counts: any of them may be the one that is similar to another's.
    full = placed.join(several.select("key", F.ceil(F.col("n") / bucket_rows).alias("n_chunks")), "key")
    full = full.withColumn("chunk", F.pmod(F.xxhash64("node"), "n_chunks")).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_chunks") - 1)))
    cells = full.select("key", (F.least("chunk", "other") * F.col("n_chunks") + F.greatest("chunk", "other")).alias("cell"), "node", "root")
    rows = cells.join(sets, "node").select("key", "cell", "node", "root", "packed").repartition("key", "cell").sortWithinPartitions("key", "cell", "node")
    # Links of the rest are between roots, and so are their components.
    more = components(materialize(forest(rows.mapInArrow(_linked_buckets(similarity), "a binary, b binary")), "root-links"))
    alone = more.join(roots.select("node"), "node", "left_anti")
    joined = roots.join(more.select(F.col("node").alias("root"), F.col("root").alias("top")), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    return joined.unionByName(alone)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: float = 0.8, bucket_rows: int = 4096, print_words: int = 3, d: int = 3) -> DataFrame:
    """docs with one row of each component: the smallest id (nulls last), of its rows the one with the smallest hashes.

    Links need fingerprints of print_words-word shingles within d bits, or that Jaccard value, or more, of the
    distinct shingle_words-word shingles.
    """
    text = F.col(f"`{text_col}`")
    # Names longer than all names of docs, so that none of its columns is hidden or doubled.
    k1, k2, nth = (f"{'_'.join(['row', *docs.columns])}_{i}" for i in range(3))
    key = [F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("-")), text, F.octet_length(text)).alias(k1), F.hash(text, F.col(f"`{id_col}`")).alias(k2)]
    marked = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text.alias("text"), *key)
    prints = materialize(marked.select("doc_id", F.col(f"`{k1}`"), F.col(f"`{k2}`"), _text_udf(sketch, shingle_words)("text").alias("sketch"), _print_udf(print_words)("text").alias("fp")), "sketches")
    known = print_links(prints.select("fp", F.substring("sketch", 1, 16).alias("node")).distinct(), d, bucket_rows)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col(f"`{k1}`").alias("k1"), F.col(f"`{k2}`").alias("k2"))).alias("first")
    distinct = materialize(prints.groupBy("sketch").agg(first).select(F.substring("sketch", 1, 16).alias("node"), "sketch", "first"), "shingle-sets")
    keys = F.array(*[F.substring("sketch", 17 + 8 * b, 8) for b in range(BANDS)])
    keyed = distinct.select("node", F.explode(keys).alias("key"))
    shared = materialize(keyed.join(keyed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("key"), "key").select("key", "node"), "shared-keys")
    # The window only tells repeated rows of one id and text apart; it uses the join's partitions and order.
    same = Window.partitionBy(F.col(f"`{k1}`"), F.col(f"`{k2}`")).orderBy(F.col(f"`{k1}`"))
    needed = distinct.join(shared.select("node").distinct(), "node").select("node", F.col("first.k1").alias(k1), F.col("first.k2").alias(k2))
    texts = marked.join(needed, [k1, k2]).withColumn(nth, F.row_number().over(same)).where(F.col(f"`{nth}`") == 1)
    sets = materialize(texts.select("node", _text_udf(packed_set, shingle_words)("text").alias("packed")), "packed-sets")
    roots = similar_roots(shared, sets, known, similarity, bucket_rows)
    rooted_sets = distinct.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    stay = rooted_sets.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.k1").alias(k1), F.col("first.k2").alias(k2))
    kept = docs.select("*", *key).join(stay, [k1, k2], "left_semi").withColumn(nth, F.row_number().over(same))
    return kept.where(F.col(f"`{nth}`") == 1).select(*[F.col(f"`{c}`") for c in docs.columns])
