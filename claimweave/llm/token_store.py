"""Token-id store: raw id payloads in shards, found by key through a minimal perfect hash index.

Files (each a Parquet folder below one path, so Spark's committer writes them and any store holds them):

``shards``   one row per shard: part, seq, doc ids, token counts, raw ids of about ``SHARD_BYTES``.
             Rows run in ascending doc_id order (nulls first) along (part, seq).
``starts``   the number of ids before each shard.
``index``    one row per key bucket: a minimal perfect hash of its keys (displacements), a 32-bit
             fingerprint per slot, and per slot the places (part, seq, ordinal, rows) of the key.

A lookup hashes the key to its bucket and slot in constant time, compares the fingerprint, and then
slices the shard, whose own doc id settles the one foreign key in 2**32 that the fingerprint lets by.

Defined results: a null text counts as empty and holds only the end id; a null doc_id is kept under
the smallest 64-bit key and sorts first; rows that share a doc_id are kept one after another and a
lookup returns them all; an empty table gives an empty store; other columns are not stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .wordmemo import encode_spaced, piece_encoder

SHARD_BYTES = 1 << 20
SHARD_DOCS = 32768
BUCKET_KEYS = 8192
#: Bytes of a Parquet row group: a lookup of few keys reads the groups that hold their buckets and shards.
ROW_GROUP = 8 << 20
NULL_KEY = -(2**63)
#: Keys that get() takes at once.
MANY = 1000
SHARD_COLS = "part int, seq int, n_docs int, n_tokens bigint, doc_ids binary, lens binary, width int, payload binary"
_SHARD = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.binary()), ("lens", pa.binary()), ("width", pa.int32()), ("payload", pa.binary())])


# ---- minimal perfect hash ----------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit integers."""
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys.astype(np.int64).view(np.uint64) ^ np.uint64(0x5851F42D4C957F2D)) >> np.uint64(32)).astype(np.uint32)


def _slots(h: np.ndarray, move: np.ndarray, n: int) -> np.ndarray:
    """Slot of each hash under its displacement; a negative displacement names the slot itself."""
    step = np.where(move < 0, 0, move).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return np.where(move < 0, -1 - move, (_mix(h + step) % np.uint64(n)).astype(np.int64))


def build_mph(keys: np.ndarray) -> np.ndarray:
    """Displacements of a minimal perfect hash of distinct 64-bit keys onto 0..len(keys)-1.

    Keys fall into about n/4 groups; groups are placed from the largest size on, each under a
    displacement that sends its keys to free, distinct slots.  Groups of one take what is left.
    """
    n = len(keys)
    h = _mix(keys.astype(np.int64).view(np.uint64))
    n_groups = n // 4 + 1
    group = (h >> np.uint64(20)) % np.uint64(n_groups)
    order = np.argsort(group, kind="stable")
    sizes = np.bincount(group.astype(np.int64), minlength=n_groups)
    first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    move, taken = np.zeros(n_groups, dtype=np.int64), np.zeros(n, dtype=bool)
    by_size = np.argsort(-sizes, kind="stable")
    for size in range(int(sizes.max(initial=0)), 1, -1):
        open_, d, tries = np.flatnonzero(sizes == size), 0, 1
        while len(open_):
            # All groups of a size try the same displacements at once; of those that claim a slot the first one gets it.
            own = np.repeat(h[order[first[open_][:, None] + np.arange(size)]], tries, axis=0)
            at = _slots(own, np.tile(np.arange(d, d + tries), len(open_))[:, None], n)
            good = ~taken[at].any(axis=1)
            good[good] = (np.diff(np.sort(at[good], axis=1), axis=1) > 0).all(axis=1)
            lines = np.flatnonzero(good)
            lines = lines[np.unique(lines // tries, return_index=True)[1]]  # a group's first fit
            slots, claim = np.unique(at[lines], return_index=True)
            owner = dict(zip(slots.tolist(), (claim // size).tolist(), strict=True))
            won = [k for k, row in enumerate(at[lines].tolist()) if all(owner[x] == k for x in row)]
            move[open_[lines[won] // tries]] = d + lines[won] % tries
            taken[at[lines[won]]] = True
            open_, d = np.delete(open_, lines[won] // tries), d + tries
            tries = min(64, max(1, 4096 // max(1, len(open_))))
    free = np.flatnonzero(~taken)
    move[by_size[np.count_nonzero(sizes > 1) : np.count_nonzero(sizes)]] = -1 - free
    return move


def mph_slots(keys: np.ndarray, move: np.ndarray, n: int) -> np.ndarray:
    h = _mix(keys.astype(np.int64).view(np.uint64))
    return _slots(h, move[((h >> np.uint64(20)) % np.uint64(len(move))).astype(np.int64)], n)


# ---- writing -----------------------------------------------------------------------------------


def write_store(docs: DataFrame, path: str, spec: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, special: str | None = "<|endoftext|>") -> None:
    """Encode every text of docs with a byte-level tokenizer (its JSON text) and write shards, starts and index."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec)

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq = piece_encoder(shared.value), TaskContext.get().partitionId(), 0
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        ids: list[bytes] = []
        keys: list[int] = []
        held = 0

        def shard() -> pa.RecordBatch:
            lens = np.array([len(i) // enc.dtype.itemsize for i in ids], dtype="<i4")
            one = ([part], [seq], [len(ids)], [int(lens.sum())], [np.array(keys, dtype="<i8").tobytes()], [lens.tobytes()], [enc.dtype.itemsize], [b"".join(ids)])
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(one, _SHARD, strict=True)], schema=_SHARD)

        for b in batches:
            for k in range(0, b.num_rows, 2500):
                part_rows = b.slice(k, 2500)
                for d, packed in zip(part_rows.column(0).to_pylist(), encode_spaced(enc, part_rows.column(1), special), strict=True):
                    ids.append(packed + end)
                    keys.append(NULL_KEY if d is None else d)
                    held += len(packed) + len(end)
                    if held >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                        yield shard()
                        ids, keys, held, seq = [], [], 0, seq + 1
        if ids:
            yield shard()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # The text's hash in the range key lets many rows of one doc_id spread over parts.
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered.mapInArrow(shards, SHARD_COLS).write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/shards")
    _write_starts(spark, path)
    _write_index(spark, path)


def _write_starts(spark: SparkSession, path: str) -> None:
    """A running count of ids: within a part by window, over parts by their totals (a row per part)."""
    counts = spark.read.parquet(f"{path}/shards").select("part", "seq", "n_tokens", "n_docs")
    totals = sorted((r["part"], r["n"]) for r in counts.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, offsets = 0, []
    for part, n in totals:
        offsets.append((part, before))
        before += n
    base = spark.createDataFrame(offsets, "part int, before bigint")
    earlier = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    counts.join(base, "part").select("part", "seq", (F.col("before") + F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))).alias("start")).write.parquet(f"{path}/starts")


def _bucket(key: str, n: int):
    return F.pmod(F.xxhash64(key), F.lit(n)).cast("int")


def _write_index(spark: SparkSession, path: str) -> None:
    shards = spark.read.parquet(f"{path}/shards")
    n = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)).alias("n")).first()["n"]
    n_buckets = n // BUCKET_KEYS + 1

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, seq, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                keys, ordinal, rows = np.unique(np.frombuffer(raw, "<i8"), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), part, "i4")), pa.array(np.full(len(keys), seq, "i4")), pa.array(ordinal.astype("i4")), pa.array(rows.astype("i4"))], names=["key", "part", "seq", "ordinal", "n_rows"])

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        keys = np.unique(pdf["key"].to_numpy())
        move = build_mph(keys)
        slot = mph_slots(pdf["key"].to_numpy(), move, len(keys))
        pdf = pdf.iloc[np.lexsort([pdf["ordinal"], pdf["seq"], pdf["part"], slot])]
        counts = np.bincount(slot, minlength=len(keys))
        prints = np.zeros(len(keys), dtype="<u4")
        prints[mph_slots(keys, move, len(keys))] = fingerprints(keys)
        return pd.DataFrame({"bucket": [key[0]], "n_keys": [len(keys)], "move": [move.astype("<i8").tobytes()], "prints": [prints.tobytes()], "first": [np.concatenate([[0], np.cumsum(counts)]).astype("<i4").tobytes()], "places": [pdf[["part", "seq", "ordinal", "n_rows"]].to_numpy(dtype="<i4").tobytes()]})

    entries = shards.select("part", "seq", "doc_ids").mapInArrow(places, "key bigint, part int, seq int, ordinal int, n_rows int")
    # Buckets are dealt by range, a number of them fixed here, so that small ones are not merged into few tasks and files hold neighbouring buckets.
    dealt = entries.withColumn("bucket", _bucket("key", n_buckets)).repartitionByRange(min(n_buckets, int(spark.conf.get("spark.sql.shuffle.partitions"))), "bucket")
    index = dealt.groupBy("bucket").applyInPandas(build, "bucket int, n_keys int, move binary, prints binary, first binary, places binary")
    index.withColumn("n_buckets", F.lit(n_buckets)).write.option("parquet.block.size", ROW_GROUP // 8).parquet(f"{path}/index")


# ---- reading -----------------------------------------------------------------------------------


def _any_of(tests: list) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def get(spark: SparkSession, path: str, keys: list[int | None]) -> DataFrame:
    """lookup() of a few keys, at most MANY: filters on bucket and shard reach the scans, so one key reads one row group of the index and of the shards."""
    if len(set(keys)) > MANY:
        raise ValueError(f"more than {MANY} keys: use lookup()")
    wanted = spark.createDataFrame([(k,) for k in set(keys)], "doc_id bigint")
    return lookup(spark, path, wanted, few=True)


def lookup(spark: SparkSession, path: str, keys: DataFrame, key_col: str = "doc_id", few: bool = False) -> DataFrame:
    """Rows of the store for the distinct keys: doc_id, start, n_tokens, ids (little-endian unsigned 32-bit, packed).

    Keys that the store lacks give no row.  few: the keys are at most MANY; their buckets and places are named to the scans.
    """
    index = spark.read.parquet(f"{path}/index")
    one = index.select("n_buckets").first()
    n_buckets = one["n_buckets"] if one else 1
    wanted = keys.select(F.coalesce(F.col(key_col).cast("bigint"), F.lit(NULL_KEY)).alias("key")).distinct()
    if few:
        index = index.where(F.col("bucket").isin([r[0] for r in wanted.select(_bucket("key", n_buckets)).distinct().collect()]))
    asked = wanted.groupBy(_bucket("key", n_buckets).alias("bucket")).agg(F.collect_list("key").alias("keys"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                asked_keys, prints = np.array(r["keys"], dtype=np.int64), np.frombuffer(r["prints"], "<u4")
                slot = mph_slots(asked_keys, np.frombuffer(r["move"], "<i8"), r["n_keys"])
                hit = prints[slot] == fingerprints(asked_keys)
                first, places = np.frombuffer(r["first"], "<i4"), np.frombuffer(r["places"], "<i4").reshape(-1, 4)
                slot, asked_keys = slot[hit], asked_keys[hit]
                n = first[slot + 1] - first[slot]
                at = np.repeat(first[slot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, int)
                p = places[at]
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked_keys, n)), *[pa.array(np.ascontiguousarray(p[:, c])) for c in range(4)]], names=["key", "part", "seq", "ordinal", "n_rows"])

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                r = b.slice(k, 1).to_pylist()[0]
                doc_ids, lens = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["lens"], "<i4").astype(np.int64)
                ids, after = np.frombuffer(r["payload"], f"<u{r['width']}"), np.cumsum(lens)
                out: tuple[list, ...] = ([], [], [], [])
                for h in r["hits"]:
                    for o in range(h["ordinal"], h["ordinal"] + h["n_rows"]):
                        if doc_ids[o] == h["key"]:
                            a, e = int(after[o] - lens[o]), int(after[o])
                            for c, v in zip(out, (None if h["key"] == NULL_KEY else h["key"], r["start"] + a, e - a, ids[a:e].astype("<u4").tobytes()), strict=True):
                                c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["doc_id", "start", "n_tokens", "ids"])

    hits = asked.join(index, "bucket").select("keys", "n_keys", "move", "prints", "first", "places").mapInArrow(probe, "key bigint, part int, seq int, ordinal int, n_rows int")
    if few:
        hits = hits.persist()
    by_shard = hits.groupBy("part", "seq").agg(F.collect_list(F.struct("key", "ordinal", "n_rows")).alias("hits"))
    shards = spark.read.parquet(f"{path}/shards").select("part", "seq", "doc_ids", "lens", "width", "payload")
    if few:
        spots = hits.select("part", "seq").distinct().collect()
        shards = shards.where(_any_of([(F.col("part") == p) & (F.col("seq") == q) for p, q in spots]))
    found = by_shard.join(shards, ["part", "seq"]).join(spark.read.parquet(f"{path}/starts"), ["part", "seq"])
    return found.select("start", "hits", "doc_ids", "lens", "width", "payload").mapInArrow(slices, "doc_id bigint, start bigint, n_tokens bigint, ids binary")
