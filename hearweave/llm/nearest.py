"""Approximate nearest neighbours by inner product, with collision-counting hashing.

Vectors are projected on single random directions, and each projection is kept as a sorted array. A
query opens a window around its own value in every array; virtual rehashing widens all windows step
by step. Vectors that collide with the query in enough windows are candidates, and their inner
products are computed exactly. A query stops when it has verified its share of the vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a shard and queries of a block; each pair of both is one unit of work.
SHARD, BLOCK = 8192, 4096
#: Sorted arrays; share of them in which a candidate collides; first width and growth of windows,
#: in standard deviations of a projection; share of a shard's vectors that a query verifies.
ARRAYS, THRESHOLD, FIRST, GROWTH, SHARE = 64, 0.75, 1.0, 1.15, 0.12
#: A query verifies at least so many times k vectors of a shard.
LEAST = 10
SEED = 11


class CollisionIndex:
    """Sorted projections of one shard's vectors (rows of x)."""

    def __init__(self, x: np.ndarray, largest: float, arrays: int = ARRAYS, seed: int = SEED):
        n, d = x.shape
        self.x = x
        # one more coordinate gives all vectors the length of the largest: the nearest by distance
        # are then those of the largest inner product
        rest = np.sqrt(np.maximum(largest**2 - (x**2).sum(axis=1), 0))
        rng = np.random.default_rng(seed)
        frames = [np.linalg.qr(rng.standard_normal((d + 1, d + 1)))[0] for _ in range(-(-arrays // (d + 1)))]
        self.directions = np.concatenate(frames, axis=1)[:, :arrays]
        values = (np.column_stack([x, rest]) @ self.directions).T
        self.order = np.argsort(values, axis=1, kind="stable")
        self.sorted = np.take_along_axis(values, self.order, axis=1)
        self.unit = max(float(values.std()), 1e-12)

    def places(self, queries: np.ndarray, largest: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For wider and wider windows: where they begin and end in each array (rows) for each query."""
        norms = np.sqrt((queries**2).sum(axis=1, keepdims=True))
        at = (queries * (largest / norms)) @ self.directions[:-1]
        width = FIRST * self.unit
        while True:
            yield (
                np.stack([np.searchsorted(s, v - width) for s, v in zip(self.sorted, at.T)]),
                np.stack([np.searchsorted(s, v + width, "right") for s, v in zip(self.sorted, at.T)]),
            )
            width *= GROWTH

    def candidates(self, queries: np.ndarray, largest: float, least: int, share: float) -> dict[int, np.ndarray]:
        """For each query, the rows that collide with it often enough at its first width that gives
        as many as wanted. Wider windows count only what is new in them."""
        n, m = self.sorted.shape[1], len(self.sorted)
        wanted, need = min(n, max(least, math.ceil(share * n))), math.ceil(THRESHOLD * m)
        open_ = np.arange(len(queries))
        counts = np.zeros((len(queries), n), np.uint8)
        low = high = None
        done: dict[int, np.ndarray] = {}
        for lows, highs in self.places(queries, largest):
            low, high = (lows, lows) if low is None else (low, high)
            for j in open_:
                slices = [x[a:b] for x, a, b in zip(self.order, lows[:, j], low[:, j]) if a < b]
                slices += [x[a:b] for x, a, b in zip(self.order, high[:, j], highs[:, j]) if a < b]
                if slices:
                    counts[j] += np.bincount(np.concatenate(slices), minlength=n).astype(np.uint8)
                rows = np.flatnonzero(counts[j] >= need)
                if len(rows) >= wanted or (not lows[:, j].any() and (highs[:, j] == n).all()):
                    done[j] = rows
            low, high = lows, highs
            open_ = np.array([j for j in open_ if j not in done], np.int64)
            if not len(open_):
                return done


def search_shard(ids, x, query_ids, queries, k: int, largest: float, share: float = SHARE):
    """(query id, vector id, score) of the k best verified candidates of each query in one shard."""
    index = CollisionIndex(x, largest)
    out_q, out_v, out_s = [], [], []
    pending = (
        (query_ids[a + j], queries[a + j], rows)
        for a in range(0, len(queries), 256)
        for j, rows in index.candidates(queries[a : a + 256], largest, LEAST * k, share).items()
    )
    for qid, q, rows in pending:
        rows = rows[ids[rows] != qid]
        scores = index.x[rows] @ q
        if len(rows) > k:
            edge = np.partition(scores, len(rows) - k)[len(rows) - k]
            rows, scores = rows[scores >= edge], scores[scores >= edge]
        best = np.lexsort([ids[rows], -scores])[:k]
        out_q += [qid] * len(best)
        out_v += ids[rows[best]].tolist()
        out_s += scores[best].tolist()
    return out_q, out_v, out_s


def _matrix(column) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(values), -1)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, x, d) of the vectors that take part: not null, not zero, all components finite, and with an id;
    of rows with the same id and vector, one. d is the number of components."""
    x = F.col(vector).cast("array<double>")
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    rows = vectors.select(F.col(key).cast("long").alias("id"), x.alias("x"))
    rows = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull() & finite & F.exists("x", lambda v: v != 0))
    return rows.dropDuplicates(["id", "x"]).withColumn("d", F.size("x"))


def nearest(
    vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 20,
    share: float = SHARE,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of queries its k nearest rows of vectors, except
    those with its own id, by inner product in double precision; ties go to the smaller id.

    Vectors are dealt to shards of about SHARD, queries to blocks of about BLOCK, and each pair is
    one task's work, so no task grows with the input. All vectors are in the index. Each shard
    returns k rows a query at most. share is the part of a shard that a query verifies: larger
    finds more. A query is held against the vectors of as many components as it has, as no other has an
    inner product with it. Rows that can't take part (see usable) neither ask nor answer; an id with two
    different vectors is in the index with both. Empty tables give no rows.
    """
    data, asked = usable(vectors, key, vector), usable(queries, key, vector)
    x = F.col("x")
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
    sizes = data.groupBy("d").agg(F.ceil(F.count("*") / SHARD).cast("int").alias("shards"), F.max(norm).alias("largest"))
    sizes = sizes.join(asked.groupBy("d").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "d")

    deal = lambda n: F.pmod(F.xxhash64("id", "x"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = data.join(sizes, "d").select("id", "x", "d", "largest", deal("shards").alias("shard"), every("blocks").alias("block"))
    right = asked.join(sizes, "d").select("id", "x", "d", deal("blocks").alias("block"), every("shards").alias("shard"))

    def work(some: pa.Table, asking: pa.Table) -> pa.Table:
        q, v, s = [], [], []
        if len(some) and len(asking):
            q, v, s = search_shard(
                some["id"].to_numpy(), _matrix(some["x"]), asking["id"].to_pylist(), _matrix(asking["x"]), k, some["largest"][0].as_py(), share
            )
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    found = left.groupBy("d", "shard", "block").cogroup(right.groupBy("d", "shard", "block")).applyInArrow(
        work, "query_id long, vec_id long, score double"
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
