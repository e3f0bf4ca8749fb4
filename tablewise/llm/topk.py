"""Exact top-k inner products by block-at-a-time pruning.

Vectors lie in forward indexes of blocks. For a query, a block's bound is the sum over dimensions of the largest contribution any of its
vectors can make (block maximum times a positive weight, block minimum times a negative one). Blocks are visited in descending order of
that bound and scored whole through the forward index, until the bound falls below the k-th best score so far.

Vectors are dealt into ranges of a bounded number of rows, queries into chunks; each (chunk, range) unit is one bounded task. A first
round scores each query's best block of every range; the largest of these k-th scores is a bound on the final one that all units share
in the second round."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewise.llm.shared import prepare, stash

BLOCK, RANGE, CHUNK = 64, 8192, 1024  # vectors of a block, vectors of a range, queries of a unit
EXACT = 1 << 53  # below it, float arithmetic on integers is exact


def _vectors(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def _clustered(vectors: np.ndarray) -> np.ndarray:
    """An order that puts similar vectors next to each other, so that block maxima are tight: by nearest of a few spread-out pivots."""
    pivots = vectors[:: max(1, len(vectors) // 64)][:64].astype(float)
    near = vectors @ pivots.T - 0.5 * (pivots ** 2).sum(1)
    return np.lexsort((near.max(1), near.argmax(1)))


class _Blocks:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, queries: np.ndarray):
        order = _clustered(vectors) if vectors.shape[1] else np.arange(len(ids))
        most = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, vectors.shape[1])
        kind = np.float64 if most < EXACT else np.int64
        self.ids, self.forward, self.queries = ids[order], vectors[order].astype(kind), queries.astype(kind)
        self.cut = np.arange(0, len(ids), BLOCK)
        high, low = (f.reduceat(self.forward, self.cut, axis=0) for f in (np.maximum, np.minimum))
        self.bounds = np.maximum(self.queries, 0) @ high.T + np.minimum(self.queries, 0) @ low.T
        self.order = np.argsort(-self.bounds, axis=1, kind="stable")

    def score(self, block: int, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = slice(self.cut[block], self.cut[block] + BLOCK)
        return self.ids[s], self.queries[rows] @ self.forward[s].T


def _seed(b: _Blocks, own: np.ndarray, k: int) -> np.ndarray:
    """The k-th best score in each query's most promising block, as far as it has k."""
    out = np.full(len(own), np.iinfo(np.int64).min)
    best = b.order[:, 0]
    for block in np.unique(best):
        rows = np.flatnonzero(best == block)
        ids, scores = b.score(block, rows)
        for r, s in zip(rows, scores, strict=True):
            s = s[ids != own[r]]
            if len(s) >= k:
                out[r] = int(np.partition(s, len(s) - k)[len(s) - k])
    return out


def _search(b: _Blocks, own: np.ndarray, floor: np.ndarray, k: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """For each query its best k of this range, ties to the smaller id; blocks whose bound is under the k-th score are not touched."""
    n = len(own)
    top_s, top_i, kth = [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n, floor.copy()
    alive = np.arange(n)
    for turn in range(b.order.shape[1]):
        blocks = b.order[alive, turn]
        alive = alive[b.bounds[alive, blocks] >= kth[alive]]
        if not len(alive):
            break
        blocks = b.order[alive, turn]
        for block in np.unique(blocks):
            rows = alive[blocks == block]
            ids, scores = b.score(block, rows)
            for r, s in zip(rows, scores.astype(np.int64), strict=True):
                good = (s >= kth[r]) & (ids != own[r])
                if good.any():
                    s, i = np.concatenate([top_s[r], s[good]]), np.concatenate([top_i[r], ids[good]])
                    best = np.lexsort((i, -s))[:k]
                    top_s[r], top_i[r] = s[best], i[best]
                    if len(best) == k:
                        kth[r] = max(kth[r], s[best[-1]])
    return [(q, top_i[r], top_s[r]) for r, q in enumerate(own)]


def top_k(items: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, rank from 1, vec_id, score): each query's k items of highest integer inner product, ties to the smaller vec_id.

    items and queries hold vec_id (integer) and v (array of long). A query is not its own candidate. Only vectors of the query's length
    are candidates. Rows with a null id or vector, or a null component, take no part. Every other row is a candidate, so repeated rows
    count each; rows of a query's id are its own, and a query given several times is one. Fewer than k candidates give fewer rows,
    none give none. Empty tables give an empty result."""
    prepare(items.sparkSession)

    def valid(df: DataFrame) -> DataFrame:
        df = df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<bigint>").alias("v"))
        return df.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull())).withColumn("dim", F.size("v"))

    items, queries = stash(valid(items), "items"), stash(valid(queries).distinct(), "queries")
    ranges, chunks = (max(1, -(-df.count() // n)) for df, n in ((items, RANGE), (queries, CHUNK)))
    # The place in the written table keeps equal rows apart, so that they fill ranges evenly too.
    items = items.withColumn("r", F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(ranges))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    queries = queries.withColumn("c", F.pmod(F.xxhash64("vec_id", "v"), F.lit(chunks)).cast("int"))
    unit = ["dim", "c", "r"]

    def run(asked: DataFrame, work, schema: str) -> DataFrame:
        asked = asked.withColumn("r", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(ranges - 1).cast("long"))))
        return asked.groupBy(unit).cogroup(items.groupBy(unit)).applyInArrow(work, schema)

    def blocks(asked: pa.Table, having: pa.Table) -> tuple[_Blocks, np.ndarray]:
        return _Blocks(having["vec_id"].to_numpy(), _vectors(having["v"]), _vectors(asked["v"])), asked["vec_id"].to_numpy()

    def seed(asked: pa.Table, having: pa.Table) -> pa.Table:
        if not len(asked) or not len(having):
            return pa.table({"vec_id": pa.array([], pa.int64()), "v": pa.array([], pa.list_(pa.int64())), "floor": pa.array([], pa.int64())})
        return pa.table({"vec_id": asked["vec_id"], "v": asked["v"], "floor": _seed(*blocks(asked, having), k)})

    def search(asked: pa.Table, having: pa.Table) -> pa.Table:
        found = _search(*blocks(asked, having), asked["floor"].to_numpy(), k) if len(asked) and len(having) else []
        return pa.table({"query_id": pa.array([q for q, i, _ in found for _ in i], pa.int64()), "vec_id": pa.array([x for _, i, _ in found for x in i], pa.int64()),
                         "score": pa.array([x for _, _, s in found for x in s], pa.int64())})

    floors = run(queries, seed, "vec_id long, v array<bigint>, floor long").groupBy("vec_id", "v").agg(F.max("floor").alias("floor"))
    asked = stash(queries.join(floors, ["vec_id", "v"], "left").withColumn("floor", F.coalesce("floor", F.lit(-(2 ** 63)))), "floors")
    found = run(asked, search, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(df: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v = floor(scale * x) for each component of embedding; vectors that are null or hold a null or non-finite component go."""
    x = F.transform("embedding", lambda e: e.cast("double"))
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return df.where(F.col("embedding").isNotNull() & F.coalesce(fine, F.lit(False))).select("vec_id", F.transform(x, lambda e: F.floor(e * scale)).alias("v"))
