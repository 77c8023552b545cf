"""Nearest neighbours by inner product, as a block matrix join.

Vectors are packed into blocks of ``BLOCK`` rows with an int8 copy (one scale per vector).  Query
blocks are joined to stripes of candidate blocks; for each pair of blocks one product of the int8
matrices gives all inner products up to a known error: with x = s q + e, the product of two vectors
differs from s q . t r by at most |s q||f| + |e||t r| + |e||f|.  A candidate survives if its upper
bound reaches the k-th best lower bound so far; survivors are computed again in double precision from
the original vectors and kept in the query's running best k.  Stripes are merged per query.  The
result is exact: no candidate within reach is dropped.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components take no
part; rows that repeat an id and its vector count once; every other vector of an id is a candidate of its
own, so that an id may be listed several times, but never for itself; a query id with several vectors
asks with the smallest; only vectors of the query's length are its candidates; ties go to the smaller id;
a query with fewer than k candidates returns them all, one without any returns no row; null ids take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 2048
#: Integers up to this size are exact in float32, in which the int8 tiles are multiplied.
EXACT = 1 << 24
_PACK = "dim int, block bigint, ids binary, vectors binary, codes binary, scale binary, coded binary, rest binary"


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes and scale per row, the norm of the coded row and of what coding left out."""
    scale = np.abs(x).max(axis=1) / 127
    codes = np.rint(x / scale[:, None]).astype(np.int8)
    kept = codes * scale[:, None]
    return codes, scale, np.linalg.norm(kept, axis=1), np.linalg.norm(x - kept, axis=1)


def tile(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products of two int8 matrices."""
    step = EXACT // (127 * 127)
    out = np.zeros((len(q), len(c)))
    for k in range(0, q.shape[1], step):
        out += q[:, k : k + step].astype(np.float32) @ c[:, k : k + step].astype(np.float32).T
    return out


def vectors(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, v, dim of the distinct rows that take part."""
    v = F.col(vec_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = table.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("bigint").alias("id"), v.alias("v"))
    return rows.distinct().withColumn("dim", F.size("v"))


def pack(rows: DataFrame, n_blocks: int) -> DataFrame:
    """Blocks of vectors of one length; a block goes on in a further row after BLOCK vectors."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[list, list]] = {}

        def block(key: tuple[int, int]) -> pa.RecordBatch:
            ids, vs = held.pop(key)
            x = np.array(vs, dtype="<f8")
            codes, scale, coded, rest = quantise(x)
            one = [np.array(ids, "<i8"), x, codes, scale.astype("<f8"), coded.astype("<f8"), rest.astype("<f8")]
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), *[pa.array([a.tobytes()], pa.binary()) for a in one]], names=["dim", "block", "ids", "vectors", "codes", "scale", "coded", "rest"])

        for b in batches:
            for i, v, dim, k in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, vs = held.setdefault((dim, k), ([], []))
                ids.append(i)
                vs.append(v)
                if len(ids) == BLOCK:
                    yield block((dim, k))
        for key in list(held):
            yield block(key)

    dealt = rows.select("id", "v", "dim", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).alias("block"))
    return dealt.repartition("dim", "block").sortWithinPartitions("dim", "block", "id").mapInArrow(of, _PACK)


def _unpack(r: dict) -> dict:
    n = len(r["ids"]) // 8
    return {"ids": np.frombuffer(r["ids"], "<i8"), "v": np.frombuffer(r["vectors"], "<f8").reshape(n, -1), "codes": np.frombuffer(r["codes"], np.int8).reshape(n, -1), **{k: np.frombuffer(r[k], "<f8") for k in ("scale", "coded", "rest")}}


class Best:
    """The best k candidates of each query of a block."""

    def __init__(self, q: dict, k: int):
        self.q, self.k = q, k
        self.heaps: list[list[tuple[float, int]]] = [[] for _ in q["ids"]]

    def see(self, c: dict) -> None:
        """Survivors of one tile, computed again in double precision."""
        q = self.q
        near = tile(q["codes"], c["codes"]) * q["scale"][:, None] * c["scale"][None, :]
        slack = q["coded"][:, None] * c["rest"][None, :] + q["rest"][:, None] * (c["coded"] + c["rest"])[None, :]
        slack = slack * (1 + 1e-9) + 1e-12 * (1 + np.abs(near))
        own = q["ids"][:, None] == c["ids"][None, :]
        low = np.where(own, -np.inf, near - slack)
        floor = np.array([h[0][0] if len(h) == self.k else -np.inf for h in self.heaps])
        if low.shape[1] >= self.k:
            floor = np.maximum(floor, np.partition(low, -self.k, axis=1)[:, -self.k])
        row, col = np.nonzero((near + slack >= floor[:, None]) & ~own)
        for a in range(0, len(row), 65536):
            r, s = row[a : a + 65536], col[a : a + 65536]
            exact = (q["v"][r] * c["v"][s]).sum(axis=1)
            for i, score, vec in zip(r.tolist(), exact.tolist(), c["ids"][s].tolist(), strict=True):
                heap = self.heaps[i]
                if len(heap) < self.k:
                    heapq.heappush(heap, (score, -vec))
                elif (score, -vec) > heap[0]:
                    heapq.heapreplace(heap, (score, -vec))

    def rows(self) -> pa.RecordBatch:
        out = [(int(i), sorted(h, reverse=True)) for i, h in zip(self.q["ids"], self.heaps, strict=True) if h]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in out], pa.int64()), pa.array([[-v for _, v in h] for _, h in out], pa.list_(pa.int64())), pa.array([[s for s, _ in h] for _, h in out], pa.list_(pa.float64()))], names=["query_id", "ids", "scores"])


def nearest(table: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", block: int = BLOCK, stripes: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score of the k candidates nearest to each query."""
    rows = vectors(table, id_col, vec_col)
    n = rows.count()
    n_stripes, n_asked = max(1, min(stripes, n // (4 * block))), n // (20 * block) + 1
    base = pack(rows, n // block + 1).withColumn("kind", F.lit(1)).withColumn("stripe", F.pmod(F.xxhash64("block"), F.lit(n_stripes)))
    queries = pack(rows.where(is_query).groupBy("id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v")), n_asked).withColumn("kind", F.lit(0))
    # Each query block meets each stripe once; candidate blocks are copied per query block, not per query.
    asked = queries.withColumn("q_block", F.col("block")).withColumn("stripe", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_stripes - 1).cast("bigint"))))
    offered = base.withColumn("q_block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n_asked - 1).cast("bigint"))))
    cols = ["dim", "q_block", "stripe", "kind", "block", "ids", "vectors", "codes", "scale", "coded", "rest"]

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for b in batches:
            for j in range(b.num_rows):
                r = b.slice(j, 1).to_pylist()[0]
                key = (r["dim"], r["q_block"], r["stripe"])
                if key != at:
                    yield from (h.rows() for h in held)
                    at, held = key, []
                if r["kind"] == 0:
                    held.append(Best(_unpack(r), k))
                else:
                    c = _unpack(r)
                    for h in held:
                        h.see(c)
        yield from (h.rows() for h in held)

    tiles = asked.select(*cols).unionByName(offered.select(*cols)).repartition("dim", "q_block", "stripe").sortWithinPartitions("dim", "q_block", "stripe", "kind", "block")
    found = tiles.mapInArrow(match, "query_id bigint, ids array<bigint>, scores array<double>")

    @F.pandas_udf("array<struct<vec_id:bigint,score:double>>")
    def merge(ids: pd.Series, scores: pd.Series) -> pd.Series:
        return pd.Series([[{"vec_id": v, "score": -s} for s, v in heapq.nsmallest(k, heapq.merge(*[[(-s, v) for v, s in zip(i, c, strict=True)] for i, c in zip(ii, cc, strict=True)]))] for ii, cc in zip(ids, scores, strict=True)])

    # At most `stripes` lists of k per query.
    best = found.groupBy("query_id").agg(F.collect_list(F.struct("ids", "scores")).alias("l")).select("query_id", F.posexplode(merge("l.ids", "l.scores")).alias("rank", "hit"))
    return best.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "hit.vec_id", "hit.score")
