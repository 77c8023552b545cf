"""Sharding by longest-processing-time scheduling.

Groups that must stay together (rows with equal text) are dealt from the largest on, each to the
shard with the least bytes so far, kept in a heap.  Groups of one size are interchangeable, so the
schedule needs only how many groups there are of each size: Spark counts them, the heap deals each
size's count to the shards, and a group finds its shard by its rank within its size.  The schedule
is exactly that of dealing the groups one by one.  What reaches the driver is a row per distinct
group size; sizes that sum to B bytes have at most sqrt(2 B) distinct values.

Ranks and slots are numbered without gaps in two steps (bucket offsets, then a window inside small
buckets), so no shard or size passes through one task.

Defined results: a null text counts as empty (size 16, crc 0) and groups with empty texts; repeated
rows are counted first and dealt one slot each; ids may be null; an empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

BUCKET_ROWS = 50_000


def deal(heap: list[tuple[int, int]], size: int, n: int) -> list[int]:
    """Deal n groups of one size to the least-loaded shards; changes the heap, returns groups per shard.

    Where n is large, all turns that start below a common level are dealt in one step: they are the
    same turns that the heap would take one by one.
    """
    got = [0] * len(heap)
    if n > 8 * len(heap):
        turns = lambda level: [max(0, -(-(level - load) // size)) for load, _ in heap]
        low, high = min(heap)[0], max(heap)[0] + size * (n + 1)
        while high - low > 1:
            mid = (low + high) // 2
            low, high = (mid, high) if sum(turns(mid)) <= n else (low, mid)
        for (_, shard), k in zip(heap, turns(low), strict=True):
            got[shard] = k
        n -= sum(got)
        heap[:] = [(load + got[shard] * size, shard) for load, shard in heap]
        heapq.heapify(heap)
    for _ in range(n):
        load, shard = heap[0]
        heapq.heapreplace(heap, (load + size, shard))
        got[shard] += 1
    return got


def schedule(sizes: Iterable[tuple[int, int]], n_shards: int) -> list[tuple[int, list[int]]]:
    """(size, running sums over shards of the groups dealt) for each (size, count)."""
    heap = [(0, s) for s in range(n_shards)]
    plan = []
    for size, n in sorted(sizes, reverse=True):
        upto, total = [], 0
        for k in deal(heap, size, n):
            total += k
            upto.append(total)
        plan.append((size, upto))
    return plan


def numbered(df: DataFrame, within: str, keys: list[str], n_rows: int, out: str, weight: Column | None = None) -> DataFrame:
    """df with a number from 0 without gaps (or the weights before it) in each value of `within`."""
    weight = F.lit(1) if weight is None else weight
    df = df.withColumn("__b", F.pmod(F.xxhash64(*keys), F.lit(n_rows // BUCKET_ROWS + 1)))
    sums = df.groupBy(within, "__b").agg(F.sum(weight).alias("__n"))
    earlier = Window.partitionBy(within).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(within, "__b", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    inside = Window.partitionBy(within, "__b").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumn("__at", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return rows.join(offsets, [within, "__b"]).withColumn(out, F.col("__before") + F.col("__at")).drop("__b", "__at", "__before")


def shard_rows(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("group"))
    unique = materialize(rows.groupBy("doc_id", "group", "size", "text_crc32").agg(F.count("*").alias("copies")), "sharding-rows")
    groups = materialize(unique.groupBy("group").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes")), "sharding-groups")
    sizes = [(r["bytes"], r["n"]) for r in groups.groupBy("bytes").agg(F.count("*").alias("n")).collect()]
    plan = docs.sparkSession.createDataFrame(schedule(sizes, n_shards), "bytes bigint, upto array<bigint>")
    ranked = numbered(groups, "bytes", ["group"], sum(n for _, n in sizes), "rank")
    placed = ranked.join(plan, "bytes").select("group", F.size(F.filter("upto", lambda x: x <= F.col("rank"))).alias("shard"))
    sharded = materialize(unique.join(placed, "group"), "sharding-placed")
    slots = numbered(sharded, "shard", ["doc_id", "group"], sharded.count(), "slot", F.col("copies"))
    each = slots.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    return each.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("copy")).cast("bigint").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
