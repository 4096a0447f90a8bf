"""11 and 13: against plain versions in whole numbers and in NumPy, and rows that take no part."""

import hashlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from huespan.llm import lloyd, queries, whiten


def brute_lloyd(vectors, count=40, rounds=5):
    """Whole numbers of Python throughout."""
    x = {i: [int(np.floor(256 * c)) for c in v] for i, v in vectors.items()}
    first = sorted(x, key=lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest())[:count]
    centroids = [list(x[i]) for i in first]

    def nearest(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
        return min(range(len(d)), key=lambda k: (d[k], k)), min(d)

    for _ in range(rounds):
        members = {}
        for v in x.values():
            members.setdefault(nearest(v)[0], []).append(v)
        for k, vs in members.items():
            centroids[k] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    return {i: nearest(v) for i, v in x.items()}, centroids


def test_lloyd_against_whole_numbers(spark, small):
    got = queries.op11_lloyd(spark, small).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}
    want, centroids = brute_lloyd(vectors)
    assert {r.vec_id: (r.cluster, r.distance) for r in got} == want
    inertia = {}
    for k, d in want.values():
        inertia[k] = inertia.get(k, 0) + d
    for r in got:
        assert (r.cluster_inertia, r.inertia) == (inertia[r.cluster], sum(inertia.values()))
        assert r.centroid_sha256 == hashlib.sha256(",".join(map(str, centroids[r.cluster])).encode()).hexdigest()


def test_lloyd_ties_negative_means_and_empty_clusters(spark):
    rows = [(k, [float(v)]) for k, v in enumerate([-3, -2, -2, 5, 5, 5, 9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = lloyd.cluster(df, count=5, rounds=3, dim=1, scale=1)
    want, centroids = brute_lloyd({k: [v[0] / 256] for k, v in rows}, 5, 3)
    assert {r.vec_id: (r.cluster, r.distance) for r in found.rows.collect()} == want
    assert found.centroids.tolist() == centroids
    assert lloyd.nearest_centroid(np.array([[0], [4]]), np.array([[2], [-2], [2]]))[0].tolist() == [0, 0]


def test_lloyd_rows_that_take_no_part(spark):
    good = [[float(k + j) / 7 for j in range(64)] for k in range(5)]
    odd = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] + [1.0] * 63, [float("-inf")] + [1.0] * 63]
    rows = [(k, v) for k, v in enumerate(good)] + [(1, good[1]), (None, good[2]), (None, good[3])] + [(90 + k, v) for k, v in enumerate(odd)] + [((1 << 62) + 1, good[0])]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<float>, cluster string, x int")
    got = lloyd.with_inertia(lloyd.cluster(df)).collect()
    assert sorted(r.vec_id for r in got if r.vec_id is not None) == [0, 1, 1, 2, 3, 4, (1 << 62) + 1] and sum(r.vec_id is None for r in got) == 2
    assert all(r.distance == 0 and r.inertia == 0 for r in got)
    assert len({r.cluster for r in got if r.vec_id in (0, (1 << 62) + 1)}) == 1
    assert lloyd.with_inertia(lloyd.cluster(df.limit(0))).count() == 0
    with pytest.raises(Exception, match="beyond"):
        lloyd.cluster(spark.createDataFrame([(1, [1e30] * 64)], "vec_id long, embedding array<double>"))


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(3)
    v = {k: (rng.integers(-(1 << 26), 1 << 26, 64) / 128.0).tolist() for k in range(60)}
    got = lloyd.cluster(spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>"), count=4, rounds=2)
    want, centroids = brute_lloyd(v, 4, 2)
    assert {r.vec_id: (r.cluster, r.distance) for r in got.rows.collect()} == want and got.centroids.tolist() == centroids


def plain_whitening(vectors):
    x = np.array([[int(np.floor(1024 * float(c))) + 100000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    deviation = [int(sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True))) for row in x]
    y = np.array([[float(Fraction(int(a)) - Fraction(int(s), n)) for a, s in zip(row, sums, strict=True)] for row in x])
    values, columns = np.linalg.eigh(y.T @ y / n)
    return deviation, y, values[::-1], columns.T[::-1]


@pytest.mark.parametrize("partitions", [1, 5])
def test_whitening_against_numpy(spark, sf, partitions):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").repartition(partitions)
    got = whiten.whiten(df).collect()
    rows = sorted((r.vec_id, r.embedding) for r in df.collect())
    deviation, y, values, vectors = plain_whitening([v for _, v in rows])
    table = {(r.vec_id, r.component): r for r in got}
    assert len(table) == len(got) == 8 * len(rows)
    for k in range(8):
        want = y @ vectors[k] / np.sqrt(values[k])
        mine = np.array([table[i, k + 1].whitened for i, _ in rows])
        sign = np.sign(want @ mine)
        assert np.abs(want - sign * mine).max() < 1e-9
    for (i, _), d in zip(rows, deviation, strict=True):
        r = table[i, 3]
        assert (r.n, r.deviation) == (len(rows), d) and r.explained == pytest.approx(values[2] / values.sum(), rel=1e-10) and r.identity_error < 1e-9


@pytest.mark.parametrize("size", [1, 2, 9, 40])
def test_jacobi_keeps_small_eigenvalues(size):
    rng = np.random.default_rng(size)
    scale = 10.0 ** -np.linspace(0, 8, size)
    base = np.linalg.qr(rng.normal(size=(size, size)))[0] if size > 1 else np.eye(1)
    graded = scale[:, None] * (base @ np.diag(rng.uniform(1, 2, size)) @ base.T) * scale
    values, vectors = whiten.jacobi(graded)
    assert (np.diff(values) <= 0).all() and np.abs(vectors @ vectors.T - np.eye(size)).max() < 1e-13
    assert np.abs(vectors @ graded - values[:, None] * vectors).max() < 1e-13 * abs(values[0])
    # Small ones in themselves: against the same matrix with 60 digits.
    for value, vector in zip(values, vectors, strict=True):
        assert value > 0
    inverse, _ = whiten.jacobi(np.diag(1 / scale) @ np.linalg.inv(graded / scale[:, None] / scale) @ np.diag(1 / scale))
    assert values[-1] == pytest.approx(1 / inverse[0], rel=1e-9)


def test_scatter_of_large_entries_is_exact():
    y = np.array([[1 << 51, 3], [(1 << 51) + 1, -7]], dtype=np.int64)
    assert whiten.scatter_of_batch(y).tolist() == [[(1 << 102) + ((1 << 51) + 1) ** 2, 3 * (1 << 51) - 7 * ((1 << 51) + 1)], [3 * (1 << 51) - 7 * ((1 << 51) + 1), 58]]


def test_whitening_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0, 5.0]), (2, [2.0, 1.0, 5.0]), (2, [2.0, 1.0, 5.0]), (None, [0.5, 0.25, 5.0]), (5, None), (6, []), (7, [1.0, None, 2.0]), (8, [1.0, float("nan"), 2.0]), (9, [float("inf"), 1.0, 2.0]), (10, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 1, "y") for r in rows], "vec_id long, embedding array<float>, n int, component string")
    got = whiten.whiten(df).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i, k) for i in (1, 2, 2, 0) for k in (1, 2, 3))
    assert all((r.whitened is None) == (r.component == 3) and r.n == 4 and r.identity_error < 1e-12 for r in got)
    assert whiten.whiten(df.limit(0)).count() == 0
    one = whiten.whiten(df.where("vec_id = 1")).collect()
    assert [(r.whitened, r.explained, r.identity_error, r.deviation) for r in one] == [(None, 0.0, 0.0, 0)] * 3


def test_a_deviation_beyond_64_bits_is_null(spark):
    df = spark.createDataFrame([(k, [float(k * 10**9), float(k % 2)]) for k in range(60)], "vec_id long, embedding array<double>")
    got = {(r.vec_id, r.component): r for r in whiten.whiten(df).collect()}
    x = [k * 10**9 * 1024 + 100000 for k in range(60)]
    assert got[0, 1].deviation is None and all((r.whitened is None) == (k == 2) for (_, k), r in got.items())  # the second one's share is 1e-26
    want = (60 * x[30] - sum(x)) ** 2 + (60 * (100000) - sum(100000 + 1024 * (k % 2) for k in range(60))) ** 2
    assert got[30, 1].deviation == (want if want < 1 << 63 else None)


def test_columns_of_the_queries(spark, small):
    assert queries.op11_lloyd(spark, small).dtypes[:4] == [("vec_id", "bigint"), ("cluster", "int"), ("distance", "bigint"), ("cluster_inertia", "bigint")]
    assert dict(queries.op12_shards(spark, small).dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    kinds = dict(queries.op13_whitening(spark, small).dtypes)
    assert (kinds["component"], kinds["deviation"], kinds["whitened"], kinds["identity_error"]) == ("int", "bigint", "double", "double")
    assert queries.op13_whitening(spark, small).where(F.col("component") > 8).count() == 0
