"""Whitening by principal components, whose eigenvectors come from cyclic Jacobi rotations.

Entries are scaled to integers, so sums and the scatter are exact whatever the order in which tasks' parts meet, and small eigenvalues don't drown in
rounding. Rows are read three times: for the mean, for the scatter about it, and for the result; parts of tasks (a row of the upper triangle each) merge through groupBy. The driver
gets dim * (dim + 1) / 2 sums and turns them by Jacobi rotations until nothing off the diagonal is left; what it sends back is components * dim numbers.

Defined results: vectors that are null, empty, or hold null or non-finite entries are dropped, and so are those of another length than the most frequent one
(the longer of two equally frequent). Repeated rows and null ids count like any others. A component without variance (constant entries, fewer rows than
dimensions) is numbered as well, with `whitened` null and left out of `identity_error`; with no component left, that is 0. Vectors of
fewer entries than the wanted components have as many components as entries. A `deviation` beyond 64 bits is null. With an entry that doesn't fit 52 bits after scaling
the job fails and says so. No rows: no result. Columns other than the two named ones are left out, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huespan.llm.common import drop_materialized, materialize

#: Components, and what scales and shifts entries to integers.
COMPONENTS, SCALE, SHIFT = 8, 1024, 100_000
#: A component's variance counts as none below this share of the largest.
NO_VARIANCE = 1e-13
#: Largest scaled entry, and the largest integer up to which doubles hold every one.
LIMIT, WHOLE = 1 << 52, 1 << 53


@dataclass
class Fit:
    """Of n rows: exact sums a dimension, eigenvalues by falling size, their unit vectors as rows, and the trace of the covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def scaled(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, x (array<long>) of the vectors without gaps, of any length above 0."""
    v = F.col(vector_column).cast("array<double>")
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where((F.size("v") > 0) & ~odd)
    beyond = F.raise_error(F.lit(f"an entry beyond {LIMIT} after scaling"))
    fits = lambda c: F.when(F.abs(c * float(scale)) <= LIMIT, F.floor(c * float(scale)) + shift).otherwise(beyond.cast("long"))
    return rows.select("vec_id", F.transform("v", fits).alias("x"))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _summed(rows: DataFrame, work, dim: int) -> dict[int, int]:
    """Exact totals by place of the tasks' arrays of integers, which travel as text, as a part may not fit 64 bits."""
    each = rows.select("x").mapInArrow(work, "sums array<string>")
    places = each.select(F.posexplode("sums").alias("place", "s"))
    merged = places.groupBy("place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    return {r.place: int(r.s) for r in merged}


def sums_of(rows: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Number of rows, and exact sums a dimension."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dim, dtype=object)
        for b in batches:
            x = _rows(b.column("x"), dim)
            n += len(x)
            # Halves of 26 bits: sums of a batch stay far below 63 bits.
            total += ((x >> 26).sum(axis=0).astype(object) << 26) + (x & ((1 << 26) - 1)).sum(axis=0).astype(object)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([[str(s) for s in (n, *total)]], pa.list_(pa.string()))], ["sums"])

    found = _summed(rows, work, dim)
    return found.get(0, 0), [found.get(k + 1, 0) for k in range(dim)]


def scatter_of_batch(y: np.ndarray) -> np.ndarray:
    """Exact sums of products of the columns of y, as Python integers: doubles multiply as long as no sum can leave their whole numbers, Python's integers beyond."""
    most = int(np.abs(y).max(initial=0))
    if most * most * max(1, len(y)) < WHOLE:
        z = y.astype(np.float64)
        return (z.T @ z).astype(np.int64).astype(object)
    z = y.astype(object)
    return z.T @ z


def covariance(rows: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """The covariance, divisor n. Entries are centred before they are multiplied: on the whole part of the mean, and what the mean has beyond it,
    the same for all rows, is taken out of the exact totals; so each entry is a quotient of integers, rounded once."""
    dim = len(sums)
    middle = np.array([s // n for s in sums], dtype=np.int64)
    upper = np.triu_indices(dim)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, any_rows = np.zeros((dim, dim), dtype=object), False
        for b in batches:
            if b.num_rows:
                any_rows = True
                total += scatter_of_batch(_rows(b.column("x"), dim) - middle)
        if any_rows:
            yield pa.RecordBatch.from_arrays([pa.array([[str(s) for s in total[upper]]], pa.list_(pa.string()))], ["sums"])

    found = _summed(rows, work, dim)
    rest = [s - n * int(m) for s, m in zip(sums, middle, strict=True)]
    out = np.zeros((dim, dim))
    for place, (i, j) in enumerate(zip(*upper, strict=True)):
        out[i, j] = out[j, i] = (n * found[place] - rest[i] * rest[j]) / (n * n)
    return out


def jacobi(matrix: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size, and unit eigenvectors as rows, of a symmetric matrix.

    Pairs (p, q) are taken row by row; a rotation in their plane makes entry (p, q) vanish. It is left out where that entry is nothing beside the two on the
    diagonal, which keeps small eigenvalues accurate in themselves. Sweeps end when all entries are."""
    a, v = np.array(matrix, dtype=np.float64), np.eye(len(matrix))
    for _ in range(sweeps):
        turned = False
        for p in range(len(a) - 1):
            for q in range(p + 1, len(a)):
                off = a[p, q]
                if off == 0 or abs(off) <= 1e-17 * np.sqrt(abs(a[p, p] * a[q, q])):
                    continue
                turned = True
                ratio = (a[q, q] - a[p, p]) / (2 * off)
                tangent = np.copysign(1.0, ratio) / (abs(ratio) + np.hypot(1.0, ratio))
                cos = 1 / np.hypot(1.0, tangent)
                turn = np.array([[cos, -tangent * cos], [tangent * cos, cos]])
                pair = [p, q]
                new_p, new_q = a[p, p] - tangent * off, a[q, q] + tangent * off
                a[pair, :] = turn @ a[pair, :]
                a[:, pair] = a[pair, :].T
                a[p, p], a[q, q], a[p, q], a[q, p] = new_p, new_q, 0.0, 0.0
                v[pair, :] = turn @ v[pair, :]
        if not turned:
            break
    order = np.argsort(-np.diag(a), kind="stable")
    vectors = v[order]
    return np.diag(a)[order], vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def fit(rows: DataFrame, dim: int) -> Fit:
    n, sums = sums_of(rows, dim)
    spread = covariance(rows, n, sums)
    values, vectors = jacobi(spread)
    return Fit(n, sums, values, vectors, float(np.trace(spread)))


def _projection(found: Fit, components: int) -> tuple[np.ndarray, np.ndarray]:
    """The whitening matrix, a row a component, and which of them have variance; rows of others are 0."""
    values = found.values[:components]
    some = values > NO_VARIANCE * max(found.values[0], 0.0)
    return np.where(some[:, None], found.vectors[:components] / np.sqrt(np.where(some, values, 1.0))[:, None], 0.0), some


def project(rows: DataFrame, found: Fit, components: int) -> DataFrame:
    """vec_id, deviation (text), whitened (array<double>) of each row."""
    dim, n = len(found.sums), found.n
    matrix, _ = _projection(found, components)
    middle = np.array([s // n for s in found.sums], dtype=np.int64)
    rest = [s - n * int(m) for s, m in zip(found.sums, middle, strict=True)]
    sent = rows.sparkSession.sparkContext.broadcast((matrix, middle, rest))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, middle, rest = sent.value
        part, square = np.array([r / n for r in rest]), sum(r * r for r in rest)
        for b in batches:
            y = _rows(b.column("x"), dim) - middle
            most, widest = int(np.abs(y).max(initial=0)), max((abs(r) for r in rest), default=0)
            small = most * max(most, widest) * dim < 1 << 62
            z, r = (y, np.array(rest, dtype=np.int64)) if small else (y.astype(object), np.array(rest, dtype=object))
            own, cross = (z * z).sum(axis=1).tolist(), (z @ r).tolist()
            deviation = [str(n * n * a - 2 * n * c + square) for a, c in zip(own, cross, strict=True)]
            white = (y - part) @ matrix.T
            lists = pa.ListArray.from_arrays(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1], white.ravel())
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(deviation, pa.string()), lists], ["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(work, "vec_id long, deviation string, whitened array<double>")


def identity_error(projected: DataFrame, some: np.ndarray) -> float:
    """Largest absolute entry of the covariance of whitened values minus the identity, over the components with variance."""
    used = [int(k) for k in np.flatnonzero(some)]
    if not used:
        return 0.0
    w = lambda k: F.element_at("whitened", k + 1)
    means = projected.agg(*[F.avg(w(k)).alias(f"m{k}") for k in used]).first()
    gap = {k: w(k) - F.lit(means[f"m{k}"]) for k in used}
    pairs = [(i, j) for i in used for j in used if i <= j]
    products = projected.agg(*[F.avg(gap[i] * gap[j]).alias(f"p{i}_{j}") for i, j in pairs]).first()
    return max(abs(products[f"p{i}_{j}"] - (1.0 if i == j else 0.0)) for i, j in pairs)


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    kind = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = materialize(scaled(vectors, scale, shift), "scaled")
    lengths = rows.groupBy(F.size("x").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if lengths is None:
        return rows.sparkSession.createDataFrame([], kind)
    rows = rows.where(F.size("x") == lengths.dim)
    found = fit(rows, lengths.dim)
    top = min(components, lengths.dim)
    projected = materialize(project(rows, found, top), "whitened")
    _, some = _projection(found, top)
    error = identity_error(projected, some)
    drop_materialized(rows)
    per = lambda values, of: F.element_at(F.array(*[F.lit(v).cast(of) for v in values]), F.col("component"))
    spread = projected.select("vec_id", F.expr("try_cast(deviation AS long)").alias("deviation"), F.posexplode("whitened").alias("place", "w")).withColumn("component", F.col("place") + 1)
    shares = [float(v / found.trace) if found.trace > 0 else 0.0 for v in found.values[:top]]
    return spread.select(
        "vec_id", "component", F.lit(found.n).cast("long").alias("n"), "deviation", F.when(per(some.tolist(), "boolean"), F.col("w")).alias("whitened"), per(shares, "double").alias("explained"), F.lit(error).alias("identity_error")
    )
