"""Strategies against the linear scan, as bags and on edges; plans; grid, trees, joins, reports."""

import random

import pytest
from pyspark.sql import functions as F

from huespan.functions import colour
from huespan.operators import grid, joins, quality, reports, search, tree
from huespan.plans.shape import operators, plan_text, pushed_filters
from huespan.queries import QUERIES
from huespan.sources import images as src

COLUMNS = "id long, filename string, r double, g double, b double"


def frame(spark, points):
    return spark.createDataFrame([(k, f"f{k}", *map(float, p)) for k, p in enumerate(points)], COLUMNS)


def bag(df):
    return sorted(tuple(r) for r in df.select("id", "r", "g", "b").collect())


@pytest.fixture(scope="module")
def sf_images(spark):
    return src.images_from_orders(spark, "/root/testdata/sf0.01").cache()


@pytest.mark.parametrize("seed", range(4))
def test_exact_strategies_return_the_same_bag(spark, seed):
    rnd = random.Random(seed)
    points = [[rnd.choice([0, 30, 127.5, 255, rnd.uniform(0, 255), rnd.randint(0, 255)]) for _ in range(3)] for _ in range(250)]
    points += [points[0]] * 45
    df = frame(spark, points)
    df = df.unionByName(df.limit(20))  # repeated rows stay repeated
    query, threshold = tuple(rnd.choice([0.0, 30.0, 127.5, 255.0, rnd.uniform(0, 255)]) for _ in range(3)), rnd.choice([0.0, 5.0, 40.0, 120.0, 500.0])
    want = bag(search.hits(df, query, threshold, "linear"))
    params = {"hash_grid": {"cell": rnd.choice([10.0, 25.0, 30.0])}, "hash_dynamic": {"cell": rnd.choice([12.0, 25.0])}, "octree": {"cap": rnd.choice([1, 10, 20]), "max_depth": rnd.choice([3, 10])}, "quadtree": {"cap": rnd.choice([5, 25]), "max_depth": rnd.choice([2, 12])}}
    for name in search.EXACT:
        assert bag(search.hits(df, query, threshold, name, **params.get(name, {}))) == want, name


@pytest.mark.parametrize("strategy", search.EXACT)
def test_edges(spark, strategy):
    find = lambda points, q, t: [r.id for r in search.similar(frame(spark, points), q, t, strategy).collect()]
    assert find([(3, 4, 0)], (0, 0, 0), 5) == [0]
    assert find([(7, 7, 7), (7, 7, 8)], (7, 7, 7), 0) == [0]
    assert find([(7, 7, 7)], (7, 7, 7), -1) == []
    assert find([], (7, 7, 7), 10) == []
    assert find([(255, 255, 255), (0, 0, 0)], (255, 255, 255), 3) == [0]
    assert find([(30, 30, 30)], (29.5, 30, 30), 1) == [0]
    assert find([(1, 1, 1), (1, 1, 200)], (1, 1, 1), 50) == [0]
    assert find([(9, 9, 9)] * 40, (9, 9, 9), 1) == list(range(40))
    assert find([(300, -5, 10)], (290, 0, 10), 20) == [0]


def test_order_limits_and_ranks(spark):
    df = frame(spark, [(10, 0, 0), (1, 0, 0), (1, 0, 0), (5, 0, 0), (90, 0, 0)])
    ids = lambda k: [r.id for r in search.similar(df, (0, 0, 0), 20, k=k).collect()]
    assert ids(None) == ids(0) == ids(-3) == ids(9) == [1, 2, 3, 0]
    assert ids(2) == [1, 2]
    assert [(r.id, r.rank) for r in search.ranked(search.hits(df, (0, 0, 0), 20)).orderBy("rank").collect()] == [(1, 1), (2, 2), (3, 3), (0, 4)]
    assert search.ranked(search.hits(df.limit(0), (0, 0, 0), 20)).count() == 0


def test_ranks_of_many_equal_distances(spark):
    df = spark.range(3_000_000).select("id", F.lit("f").alias("filename"), *[F.lit(1.0).alias(c) for c in "rgb"])
    ranked = search.ranked(search.hits(df, (1.0, 1.0, 1.0), 1.0))
    assert ranked.where("rank <> id + 1").count() == 0


def test_ranks_of_hashed_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(search, "RANK_FEW", 300)
    monkeypatch.setattr(search, "RANK_RANGES", 200)
    monkeypatch.setattr(search, "FAN", 3)
    rows = spark.range(5000).select(F.when(F.col("id") % 50 != 0, F.xxhash64("id").bitwiseAND(F.lit((1 << 63) - 1))).alias("id"), F.lit("f").alias("filename"), (F.col("id") % 7).cast("double").alias("r"), F.lit(0.0).alias("g"), F.lit(0.0).alias("b"), F.lit("x").alias("range"))
    got = search.ranked(search.hits(rows.unionByName(rows.limit(40)), (0.0, 0.0, 0.0), 5.0)).orderBy("rank").collect()
    want = sorted(((r.distance, r.id is not None, r.id or 0) for r in got))
    assert [r.rank for r in got] == list(range(1, len(want) + 1)) and len(want) > 4000
    assert [(r.distance, r.id is not None, r.id or 0) for r in got] == want and got[0]["range"] == "x"


def test_narrow_cells_are_not_listed(sf_images):
    assert bag(search.hits(sf_images, (66.0, 35.0, 226.0), 441.0, "hash_grid", cell=0.5)) == bag(sf_images.where(colour.distance((66.0, 35.0, 226.0)) <= 441.0))


def test_recall_in_one_pass_equals_single_strategies(sf_images):
    at = (128.0, 128.0, 128.0), 50.0
    rows = {r.strategy: r for r in quality.recall(sf_images.unionByName(sf_images.limit(100)), *at).collect()}
    both = sf_images.unionByName(sf_images.limit(100))
    assert set(rows) == set(search.STRATEGIES)
    for name, r in rows.items():
        assert r.found == search.hits(both, *at, name).count()
        assert r.precision == r.duplication == 1.0 and r.recall == pytest.approx(1.0 if name != "hash_fixed" else r.found / rows["linear"].found, abs=0.01)


def test_fixed_grid_finds_a_part_only(sf_images):
    exact, fixed = search.hits(sf_images, (128, 128, 128), 50, "linear"), search.hits(sf_images, (128, 128, 128), 50, "hash_fixed")
    assert fixed.count() == 10 and exact.count() == 448 and fixed.exceptAll(exact).count() == 0


def test_ring_top_k_is_approximate(sf_images):
    got = search.ring_top_k(sf_images, (66, 35, 226), 40, 10).collect()
    assert len(got) == 10 and max(r.distance for r in got) == pytest.approx(17.117243)
    best = {r.id for r in search.top_k(search.hits(sf_images, (66, 35, 226), 40), 10).collect()}
    assert len({r.id for r in got} & best) == 6


def test_known_tree_and_grid_statistics(sf_images):
    assert [tuple(tree.stats(sf_images, *a).first())[i] for a in [(10, 10, 3), (1, 25, 3), (25, 12, 2)] for i in (3, 2, 1)] == [585, 4096, 4, 7296, 51073, 25, 344, 1033, 6]
    assert tuple(grid.occupancy(sf_images).first()) == (729, 3, 21, 40)
    assert grid.stats(sf_images).first().avg_occupancy == pytest.approx(20.576132)


def test_leaves_partition_the_rows(sf_images):
    leaves = tree.leaves(sf_images, 10, 10, 3)
    assert leaves.count() == 4096
    assert leaves.select(((F.col("hi_r") - F.col("lo_r")) * (F.col("hi_g") - F.col("lo_g")) * (F.col("hi_b") - F.col("lo_b"))).alias("v")).agg(F.sum("v")).first()[0] == pytest.approx(255.0**3)
    # Every row lies in one leaf; a point on a border belongs to the upper one, on the last border to the last.
    inside = F.lit(True)
    for c in "rgb":
        inside = inside & (F.col(c) >= F.col(f"lo_{c}")) & ((F.col(c) < F.col(f"hi_{c}")) | (F.col(f"hi_{c}") == 255.0))
    held = sf_images.join(F.broadcast(leaves), inside).groupBy("id").agg(F.count("*").alias("n"))
    assert held.count() == sf_images.count() and held.where("n <> 1").count() == 0
    full = sf_images.join(F.broadcast(leaves), inside).groupBy("level", "c0", "c1", "c2").count()
    assert full.where("count > 10 and level < 10").count() == 0


@pytest.mark.parametrize("name", ["octree", "quadtree"])
def test_slack_keeps_more_candidates_and_the_same_hits(sf_images, monkeypatch, name):
    at = (66.0, 35.0, 226.0), 40.0
    narrow, wide = (search.STRATEGIES[name](sf_images, *at, slack=x) for x in (1.0, 4.0))
    assert narrow.exceptAll(wide).count() == 0 and wide.count() > narrow.count()
    want = bag(search.hits(sf_images, *at, "linear"))
    assert bag(search.hits(sf_images, *at, name, slack=4.0)) == want
    monkeypatch.setattr(tree, "MOST_LEAVES", 3)  # the shuffled way
    assert bag(search.hits(sf_images, *at, name)) == want


def test_statistics_of_nothing(spark):
    empty = frame(spark, [])
    assert tuple(grid.stats(empty).first()) == (0, 0.0)
    assert tuple(grid.occupancy(empty).first()) == (0, None, None, None)
    assert tree.stats(empty, 1, 5).first().asDict() == {"total": 0, "max_depth": 0, "leaf_nodes": 1, "internal_nodes": 0, "total_nodes": 1, "ratio": 0.0, "avg_per_leaf": 0.0}
    assert quality.selectivity(empty, (1, 1, 1), 5).first().selectivity_pct is None
    assert quality.recall(empty, (1, 1, 1), 5, ["bbox"]).first().recall == 1.0


def test_join_equals_single_searches(spark, sf_images):
    queries = src.queries_from_parts(spark, "/root/testdata/sf0.01").where("query_id <= 200")
    pairs = joins.similarity_join(sf_images, queries, 30.0)
    one = pairs.agg(F.count("*").alias("n"), F.countDistinct("query_id").alias("q"), F.sum("distance").alias("d")).first()
    assert (one.n, one.q) == (17417, 201) and one.d == pytest.approx(389416.5204)
    for cell in (0.01, 12.0, 30.0, 100.0):
        other = joins.similarity_join(sf_images, queries, 30.0, cell=cell)
        assert other.exceptAll(pairs).count() == pairs.exceptAll(other).count() == 0
    for q in queries.limit(3).collect():
        single = search.hits(sf_images, (q.qr, q.qg, q.qb), 30.0, "linear").select("id", "distance")
        mine = pairs.where(F.col("query_id") == q.query_id).select("id", "distance")
        assert single.exceptAll(mine).count() == mine.exceptAll(single).count() == 0
    assert joins.similarity_join(sf_images, queries, -1.0).count() == 0


def test_join_asks_every_part(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet")
    asked = QUERIES["similarity_join"](spark, sf).select("query_id").distinct()
    assert asked.count() == parts.select("p_partkey").distinct().count()


def test_plans(spark):
    df = src.images_from_orders(spark, "/root/testdata/sf0.01")
    assert "BroadcastHashJoin" in plan_text(search.hits(df, (66, 35, 226), 40, "hash_grid"))
    assert "NestedLoop" not in plan_text(joins.similarity_join(df, src.queries_from_parts(spark, "/root/testdata/sf0.01"), 30.0))
    assert "TakeOrderedAndProject" in plan_text(search.similar(df, (66, 35, 226), 40, k=5))


def test_bounds_reach_the_scan(spark, tmp_path):
    src.synthetic(spark, 1000).write.parquet(str(tmp_path / "i"))
    found = search.hits(spark.read.parquet(str(tmp_path / "i")), (66, 35, 226), 40, "bbox").select("id")
    assert any(p.startswith("GreaterThanOrEqual(r") for p in pushed_filters(found))
    assert "Filter" in operators(found)


def test_metrics(spark):
    df = frame(spark, [(3, 4, 0), (0, 0, 0)])
    row = df.select(colour.distance((0, 0, 1), metric="manhattan").alias("m"), colour.distance((6, 8, 0), metric="cosine").alias("c")).collect()
    assert (row[0].m, row[1].m, round(row[0].c, 9), row[1].c) == (8.0, 1.0, 0.0, 1.0)
    with pytest.raises(ValueError, match="unknown"):
        colour.distance((0, 0, 0), metric="other")


def test_analysis_of_a_search(sf_images):
    row = quality.analyze(sf_images, (66.0, 35.0, 226.0), 40.0, "hash_grid").first()
    assert (row.found, row.is_sorted, [x.id for x in row.first_three], row["index"].cells) == (234, True, [8766, 4801, 12128], 729)
    assert quality.analyze(sf_images, (66.0, 35.0, 226.0), 40.0, "octree").first()["index"].internal_nodes == 585


def test_unsorted_is_noticed(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0), (3, 2.0)], "rank int, distance double")
    assert not quality.sortedness(df).first().is_sorted
    assert quality.sortedness(df.where("rank < 3")).first().is_sorted


def test_own_benchmark_rows(spark):
    rows = reports.run_ladder(spark, [100], strategies={"Linear": "linear", "Hash": "hash_grid"}).collect()
    assert [(r.structure, r.dataset_size) for r in rows] == [("Linear", 100), ("Hash", 100)] and rows[0].found == rows[1].found
    assert [r.search_winner for r in reports.winner_by_scale(reports.published(spark)).orderBy("dataset_size").collect()] == ["Linear", "Linear", "Hash", "Hash", "Hash", "Hash"]
