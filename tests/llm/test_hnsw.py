"""1: recall against brute force, exact scores, and rows that take no part."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from huespan.llm import hnsw, queries, routing


def recall(spark, df, **options):
    rows = [(r.vec_id, r.embedding) for r in df.select("vec_id", "embedding").collect()]
    ids, v = np.array([i for i, _ in rows]), np.array([x for _, x in rows], dtype=np.float32).astype(np.float64)
    got = {}
    for r in hnsw.nearest(df, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        s = v @ v[q]
        s[ids == ids[q]] = -np.inf
        best = np.lexsort((ids, -s))[: min(20, len(ids) - 1)]
        found = got[ids[q]]
        assert len(found) == len(best)
        assert found == sorted(found, key=lambda x: (-x[1], x[0]))
        for i, score in found:
            assert score == pytest.approx(float(v[q] @ v[np.flatnonzero(ids == i)[0]]), abs=1e-12)
        hit += len({i for i, _ in found} & set(ids[best].tolist()))
        total += len(best)
    return hit / total


def made_vectors(kind, n=60_000, dim=64):
    """Seeded vectors: independent ones, or clusters of unequal size, width and norm."""
    rng = np.random.default_rng(11)
    if kind == "random":
        return rng.normal(size=(n, dim)).astype(np.float32)
    centres = rng.normal(size=(300, dim))
    weights = rng.pareto(1.5, 300) + 0.1
    of = rng.choice(300, n, p=weights / weights.sum())
    return (centres[of] + rng.normal(size=(n, dim)) * rng.uniform(0.1, 0.6, 300)[of][:, None]).astype(np.float32)


@pytest.mark.parametrize(("kind", "n", "shards"), [("clustered", 60_000, 1), ("clustered", 12_000, 4), ("random", 8_000, 1)])
def test_recall_of_graphs(kind, n, shards):
    """A table about as large as a shard of production parameters, and smaller ones in one shard and in four."""
    v = made_vectors(kind, n)
    ids = np.arange(n, dtype=np.int64)
    asked = ids[:: n // 200]
    exact = v[asked].astype(np.float64) @ v.astype(np.float64).T
    exact[np.arange(len(asked)), asked] = -np.inf
    best = np.argpartition(-exact, 20, axis=1)[:, :20]
    found = [hnsw.top_of_shard(hnsw.Graph.build(ids[k::shards], v[k::shards]), asked, v[asked], 20) for k in range(shards)]
    q, i, s = (np.concatenate(x) for x in zip(*found, strict=True))
    hit = 0
    for k, a in enumerate(asked):
        mine = q == a
        hit += len(set(i[mine][np.lexsort((i[mine], -s[mine]))[:20]].tolist()) & set(best[k].tolist()))
    assert hit / (20 * len(asked)) >= 0.9


def test_doubles_are_scored_as_they_are(spark):
    rows = [(0, [1e39, 2.0]), (20, [6.3100000004, 1.0]), (1, [1.0, 0.0]), (2, [3.0, 1e-12]), (3, [1e200, 1e200])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in hnsw.nearest(df).collect()}
    assert len(got) == 8 and got[20, 1] == 6.3100000004 and got[0, 3] == np.dot([1e39, 2.0], [1e200, 1e200]) and got[20, 2] == 6.3100000004 * 3 + 1e-12


def test_repeated_rows_are_candidates_each(spark):
    rows = [(0, [1.0, 0.0])] + [(7, [2.0, 0.0])] * 3 + [(8, [1.0, 1.0])]
    got = hnsw.nearest(spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, times string")).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(7, 2.0)] * 3 + [(8, 1.0)]


def test_recall_on_the_table(spark):
    assert recall(spark, spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")) >= 0.95


def test_recall_over_shards_and_norms(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), [float(x) for x in rng.normal(size=16) * rng.uniform(0.1, 5)]) for k in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert recall(spark, df, shard_rows=500) >= 0.95
    assert recall(spark, df.limit(12)) == 1.0


def test_queries_visit_few_shards_of_clustered_vectors(spark):
    """Visits grow with queries: the shards are many, the clusters that hold the answers few; the answers stay."""
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(24, 16)) * 4
    rows = [(int(k), (centres[k % 24] + rng.normal(size=16) * 0.3).tolist()) for k in range(4800)]
    rows += [(10_000 + k, rows[7][1]) for k in range(900)]  # a hot cluster, of several shards
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    valid = hnsw.valid_vectors(df)
    queries = valid.where("vec_id % 20 = 0").groupBy("vec_id", "dim").agg(F.min("v").alias("v"))
    placed, visits, routes = hnsw.dealt(valid, queries, 200)
    sizes = [r["count"] for r in placed.groupBy("shard").count().collect()]
    assert sum(sizes) == len(rows) and max(sizes) < 400 and len(sizes) >= 20
    assert max(routes[16].ways) > 1 and routes[16].probes <= 4
    assert visits.groupBy("vec_id").count().agg(F.max("count")).first()[0] < len(sizes) / 2
    assert recall(spark, df.where("vec_id < 4800"), shard_rows=200) >= 0.95


def test_directions_of_vectors_of_any_size():
    v = np.array([[1e200, 1e200], [-1e-200, 1e-200], [3.0, 0.0]])
    d, log_length = routing.unit(v)
    assert np.isfinite(d).all() and np.isfinite(log_length).all() and np.allclose(np.linalg.norm(d, axis=1), 1)
    centres, weights = routing.directions_of(v, 5)
    assert len(centres) == 3 and np.isfinite(weights).all()


def test_copies_are_all_found(spark):
    rng = np.random.default_rng(6)
    hot = [float(x) for x in rng.normal(size=8)]
    rows = [(k, hot if k % 3 == 0 else [float(x) for x in rng.normal(size=8)]) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = hnsw.nearest(df).where("query_id = 60").orderBy("rank").collect()
    s = np.array([np.dot(np.float32(v).astype(float), np.float32(hot).astype(float)) for _, v in rows])
    want = sorted(float(x) for k, x in enumerate(s) if k != 60)[::-1][:20]
    assert [r.score for r in got] == pytest.approx(want)


def test_ties_of_many_copies_go_to_the_smaller_ids(spark):
    rng = np.random.default_rng(8)
    hot = rng.normal(size=8).tolist()
    rows = [(int(k), hot if k % 2 == 0 else rng.normal(size=8).tolist()) for k in rng.permutation(1200)]
    df = spark.createDataFrame([*rows, *[(40, hot)] * 30], "vec_id long, embedding array<float>")
    got = {}
    for r in hnsw.nearest(df).where("query_id in (0, 40, 600)").orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    v = np.array([x for _, x in rows], dtype=np.float32).astype(np.float64)
    ids = np.array([i for i, _ in rows] + [40] * 30)
    s = np.append(v, np.tile(np.float32(hot).astype(np.float64), (30, 1)), axis=0) @ np.float32(hot).astype(np.float64)
    for q, found in got.items():
        keep = ids != q
        assert [i for i, _ in found] == ids[keep][np.lexsort((ids[keep], -s[keep]))[:20]].tolist()
    assert len(got) == 3


def test_rows_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0], 1), (1, [0.0, 0.0], 1), (2, None, 1), (3, [float("nan"), 1.0], 1), (4, [1.0, None], 1), (5, [3.0, 1.0], 1), (20, [1.0, 1.0], 1), (20, [1.0, 1.0], 1), (None, [1.0, 1.0], 1), (6, [1.0, 2.0, 3.0], 1), (7, [], 1), (8, [float("inf"), 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in hnsw.nearest(df).collect())
    assert got == [(0, 1, 5, 5.0), (0, 2, 20, 3.0), (0, 3, 20, 3.0), (20, 1, 5, 4.0), (20, 2, 0, 3.0)]
    assert hnsw.nearest(df.limit(0)).count() == 0


def test_query_on_a_small_table(spark, small):
    rows = queries.op1_hnsw(spark, small).collect()
    assert len(rows) == 20 * len({r.query_id for r in rows})


def test_graph_survives_its_flat_form():
    rng = np.random.default_rng(7)
    g = hnsw.Graph.build(np.arange(200), rng.normal(size=(200, 6)).astype(np.float32))
    back = hnsw.Graph.read(g.ids.tobytes(), g.original.tobytes(), 6, [{"nodes": n.astype(np.int64).tobytes(), "links": x.tobytes()} for n, x in g.levels])
    q = rng.normal(size=(5, 6)).astype(np.float32)
    assert (g.search(q) == back.search(q)).all()
    assert all(x.shape[1] == (2 * hnsw.LINKS if k == 0 else hnsw.LINKS) for k, (_, x) in enumerate(g.levels))
