"""Which shards a vector lies in and which ones a query visits: clusters of directions, and as many of them for a query as it takes.

A bounded sample gives one direction for about every shard's worth of vectors (spherical k-means, a few rounds). Every vector lies in the cluster of the nearest direction; a cluster of more rows than a shard
holds is several shards, dealt by hash. A query takes clusters in order of the inner product that it has with their direction, weighed by the mean length of their vectors.

How many it takes is measured, not guessed: a bounded number of queries is answered exactly over all rows, and the least number of clusters that holds TARGET of those answers is taken for all. Vectors
in clusters need few, whatever the number of shards; vectors without any structure need most of them, and get them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huespan.llm.common import materialize

#: Rows that directions are taken from, directions at most, rounds; queries that are answered exactly, and the share of their answers that the clusters taken must hold.
SAMPLE, MOST_CLUSTERS, ROUNDS, MEASURED, TARGET = 16_384, 4096, 6, 200, 0.99


@dataclass
class Routes:
    """Directions with their weights, shards a cluster is dealt to, and clusters a query takes."""

    directions: np.ndarray
    weights: np.ndarray
    ways: list[int]
    probes: int


def rows_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Directions, and the logarithms of lengths; values of any size."""
    v = v.astype(np.float64)
    top = np.abs(v).max(axis=1, keepdims=True)
    v = v / top
    length = np.linalg.norm(v, axis=1, keepdims=True)
    return v / length, (np.log(top) + np.log(length))[:, 0]


def directions_of(sample: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """`count` directions (at most as many as rows) and the mean length of their vectors, the largest as 1."""
    v, log_length = unit(sample)
    centres = v[np.linspace(0, len(v) - 1, min(count, len(v))).astype(int)]
    for _ in range(ROUNDS):
        own = (v @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, v)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.where(length > 0, length, 1), centres)
    own = (v @ centres.T).argmax(axis=1)
    share = np.exp(log_length - log_length.max())
    n = np.bincount(own, minlength=len(centres))
    return centres, np.where(n > 0, np.bincount(own, weights=share, minlength=len(centres)) / np.maximum(n, 1), share.mean())


def with_cluster(rows: DataFrame, directions: np.ndarray) -> DataFrame:
    """The rows (with v, all of one length) and their cluster."""
    names, kind = rows.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    sent = rows.sparkSession.sparkContext.broadcast(directions)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = (unit(rows_of(b.column("v"), sent.value.shape[1]))[0] @ sent.value.T).argmax(axis=1) if b.num_rows else np.zeros(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at.astype(np.int32), pa.int32())], [*names, "cluster"])

    return rows.mapInArrow(work, f"{kind}, cluster int")


def order_of(queries: np.ndarray, directions: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Clusters in the order in which each query takes them."""
    return np.argsort(-(unit(queries)[0] @ directions.T) * weights, axis=1, kind="stable")


def probes_for(placed: DataFrame, queries: DataFrame, directions: np.ndarray, weights: np.ndarray, k: int) -> int:
    """The least number of clusters that holds TARGET of the exact answers of MEASURED queries, chosen by hash, in a block against all rows."""
    asked = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MEASURED).select("vec_id", "v").collect()
    if not asked:
        return 1
    ids, block = np.array([r.vec_id for r in asked]), np.array([r.v for r in asked], dtype=np.float64)
    sent = placed.sparkSession.sparkContext.broadcast((ids, block))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, block = sent.value
        score, cluster = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), dtype=np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            with np.errstate(over="ignore", invalid="ignore"):
                new = np.nan_to_num(block @ rows_of(b.column("v"), block.shape[1]).astype(np.float64).T, nan=-np.inf)
            new = np.where(ids[:, None] == b.column("vec_id").to_numpy()[None, :], -np.inf, new)
            score, cluster = np.concatenate([score, new], axis=1), np.concatenate([cluster, np.broadcast_to(b.column("cluster").to_numpy(), new.shape)], axis=1)
            if score.shape[1] > k:
                best = np.argpartition(-score, k - 1, axis=1)[:, :k]
                score, cluster = np.take_along_axis(score, best, axis=1), np.take_along_axis(cluster, best, axis=1)
        q = np.repeat(np.arange(len(ids)), score.shape[1])
        kept = np.isfinite(score.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(q[kept], pa.int64()), pa.array(score.ravel()[kept], pa.float64()), pa.array(cluster.ravel()[kept], pa.int64())], ["q", "score", "cluster"])

    best = placed.select("vec_id", "v", "cluster").mapInArrow(work, "q long, score double, cluster long")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cluster"))
    answers = best.withColumn("place", place).where(F.col("place") <= k).select("q", "cluster").collect()
    order = order_of(block, directions, weights)
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
    needed = np.sort([rank[r.q, r.cluster] + 1 for r in answers])
    return int(needed[min(len(needed) - 1, int(np.ceil(TARGET * len(needed))) - 1)]) if len(needed) else 1


def deal(rows: DataFrame, queries: DataFrame, n: int, dim: int, shard_rows: int, k: int) -> tuple[DataFrame, DataFrame, Routes]:
    """n rows (vec_id, v) of one length and queries (vec_id, v) among them, both with shard; queries once for each that they visit."""
    sample = np.array([r.v for r in rows.orderBy(F.xxhash64("v"), F.xxhash64("vec_id")).limit(SAMPLE).select("v").collect()], dtype=np.float64)
    directions, weights = directions_of(sample, min(MOST_CLUSTERS, -(-n // shard_rows)))
    placed = materialize(with_cluster(rows, directions), "placed")
    counts = {r.cluster: r.n for r in placed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}
    ways = [max(1, -(-counts.get(c, 0) // shard_rows)) for c in range(len(directions))]
    routes = Routes(directions, weights, ways, probes_for(placed, queries, directions, weights, k))
    first = np.concatenate([[0], np.cumsum(ways)]).tolist()
    of = lambda values: F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), F.col("cluster") + 1)
    dealt = placed.withColumn("shard", of(first) + F.pmod(F.xxhash64("vec_id", "v"), of(ways))).drop("cluster")
    sent = rows.sparkSession.sparkContext.broadcast((directions, weights))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order = order_of(rows_of(b.column("v"), dim), *sent.value)[:, : routes.probes] if b.num_rows else np.zeros((0, 1), dtype=np.int64)
            lists = pa.ListArray.from_arrays(np.arange(len(order) + 1, dtype=np.int32) * order.shape[1], order.ravel().astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns, lists], [*names, "clusters"])

    names, kind = queries.columns, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in queries.schema.fields)
    taken = queries.mapInArrow(route, f"{kind}, clusters array<int>").withColumn("cluster", F.explode("clusters"))
    asked = taken.withColumn("shard", F.explode(F.sequence(of(first), of(first) + of(ways) - 1))).drop("clusters", "cluster")
    return dealt, asked, routes
