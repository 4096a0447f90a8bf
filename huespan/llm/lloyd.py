"""Plain Lloyd iterations over integer vectors: centroids travel to the rows, rows never move.

Vectors are scaled to integers, so distances, sums and new centroids are exact and don't depend on how rows are dealt. A round is a scan: centroids are
broadcast (count * dim numbers, whatever the table's size), each task takes the squared differences to one centroid after another, and gives one row of
sums a cluster that it met; those rows merge through groupBy, and count * dim totals come back.

Defined results: vectors that are null, have another number of components, or hold null or non-finite components take no part. Components are exact up to
LIMIT in size after scaling; beyond it the job fails and says so, as a distance might not fit 64 bits. Ties go to the smaller number.
Repeated rows count each, and two of them may both start a centroid. A null id is assigned like any other and starts no centroid. Fewer vectors than
centroids: as many centroids as vectors. No vectors: no rows. Columns other than the two named ones are left out, so none can clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huespan.llm.common import drop_materialized, materialize

#: Components, number of centroids, rounds, scale of components, and what their hash texts begin with.
DIM, CENTROIDS, ROUNDS, SCALE, SEED = 64, 40, 5, 256, "2:"
#: Largest scaled component: (2 * LIMIT)^2 * 64 stays below 2^63.
LIMIT = 1 << 27


@dataclass
class Clusters:
    """Rows (vec_id, cluster, distance) and the centroids, a row of integers each."""

    rows: DataFrame
    centroids: np.ndarray


def scaled(vectors: DataFrame, dim: int = DIM, scale: int = SCALE, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, x (array<int>) of the vectors that take part."""
    v = F.col(vector_column).cast("array<double>")
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where((F.size("v") == dim) & ~odd)
    beyond = F.raise_error(F.lit(f"a component beyond {LIMIT} after scaling"))
    fits = lambda c: F.when(F.abs(c * float(scale)) <= LIMIT, F.floor(c * float(scale)).cast("int")).otherwise(beyond.cast("int"))
    return rows.select("vec_id", F.transform("v", fits).alias("x"))


def starts(rows: DataFrame, count: int = CENTROIDS, seed: str = SEED) -> np.ndarray:
    """The `count` vectors with the smallest hash of their id, in order of the hash, then the vector."""
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")).cast("binary"), 256)
    first = rows.where(F.col("vec_id").isNotNull()).select(order.alias("h"), "x").orderBy("h", "x").limit(count).collect()
    return np.array([r.x for r in first], dtype=np.int64)


def nearest_centroid(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the number of the nearest centroid, the smaller one of equals, and the squared distance: a row of differences a centroid at a time."""
    distances = np.empty((len(centroids), len(x)), dtype=np.int64)
    for k, c in enumerate(centroids):
        gap = x - c
        np.einsum("ij,ij->i", gap, gap, out=distances[k])
    cluster = distances.argmin(axis=0)
    return cluster, distances[cluster, np.arange(len(x))]


def _matrix(column: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate(column.to_numpy()).astype(np.int64).reshape(-1, dim) if len(column) else np.zeros((0, dim), dtype=np.int64)


def moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: centroids at the exact floor of their vectors' means; one without vectors stays."""
    context = rows.sparkSession.sparkContext
    sent = context.broadcast(centroids)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = sent.value
        total, n = np.zeros(at.shape, dtype=object), np.zeros(len(at), dtype=np.int64)
        for batch in batches:
            x = _matrix(batch["x"], at.shape[1])
            cluster, _ = nearest_centroid(x, at)
            order = np.argsort(cluster, kind="stable")
            met, begin = np.unique(cluster[order], return_index=True)
            if len(met):
                total[met] += np.add.reduceat(x[order], begin, axis=0).astype(object)
                n += np.bincount(cluster, minlength=len(at))
        met = np.flatnonzero(n)
        # Sums as text: a partition's may not fit 64 bits.
        yield pd.DataFrame({"cluster": met, "n": n[met], "sums": [[str(s) for s in total[k]] for k in met]})

    each = rows.select("x").mapInPandas(sums, "cluster long, n long, sums array<string>")
    places = each.select("cluster", "n", F.posexplode("sums").alias("place", "s"))
    merged = places.groupBy("cluster", "place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n")).collect()
    sent.unpersist()
    out = centroids.copy()
    for r in merged:  # count * dim rows
        out[r.cluster, r.place] = int(r.s) // r.n
    return out


def assign(rows: DataFrame, centroids: np.ndarray) -> DataFrame:
    """vec_id, cluster, distance of each row."""
    sent = rows.sparkSession.sparkContext.broadcast(centroids)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cluster, distance = nearest_centroid(_matrix(batch["x"], sent.value.shape[1]), sent.value)
            yield pd.DataFrame({"id": batch["id"], "known": batch["known"], "cluster": cluster.astype(np.int32), "distance": distance})

    # pandas would turn long ids beside a null into doubles, so nulls travel as a flag.
    asked = rows.select(F.coalesce("vec_id", F.lit(0).cast("long")).alias("id"), F.col("vec_id").isNotNull().alias("known"), "x")
    found = asked.mapInPandas(work, "id long, known boolean, cluster int, distance long")
    return found.select(F.when(F.col("known"), F.col("id")).alias("vec_id"), "cluster", "distance")


def cluster(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> Clusters:
    """Start, `rounds` rounds, and the last assignment. Scaled vectors are written once, as every round reads them."""
    rows = materialize(scaled(vectors, dim, scale), "scaled")
    centroids = starts(rows, count, seed)
    if not len(centroids):
        return Clusters(rows.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")).limit(0), centroids)
    for _ in range(rounds):
        centroids = moved(rows, centroids)
    placed = materialize(assign(rows, centroids), "clusters")
    drop_materialized(rows)
    return Clusters(placed, centroids)


def centroid_digest(centroid: np.ndarray) -> str:
    """Lower-case hex sha256 of the components as decimal integers, joined by commas."""
    return hashlib.sha256(",".join(str(int(c)) for c in centroid).encode()).hexdigest()


def _of_cluster(values: dict[int, object], kind: str) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("cluster")].cast(kind)


def with_inertia(found: Clusters) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256: sums of distances over the cluster and over all, which are a row a cluster."""
    rows = found.rows
    if not len(found.centroids):
        return rows.select("*", F.lit(0).cast("long").alias("cluster_inertia"), F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256"))
    sums = {r.cluster: int(r.s) for r in rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    digests = {k: centroid_digest(c) for k, c in enumerate(found.centroids)}
    return rows.select("*", _of_cluster(sums, "long").alias("cluster_inertia"), F.lit(sum(sums.values())).cast("long").alias("inertia"), _of_cluster(digests, "string").alias("centroid_sha256"))
