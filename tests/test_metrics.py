"""Colour spaces, cosine and city-block distances, the dual-tree join, and choices by data."""

import colorsys
import math
import re
import random

import pytest
from pyspark.sql import functions as F

from huespan.functions import colour, spaces
from huespan.operators import choice, dual, joins, search
from huespan.plans.shape import plan_text, pushed_filters
from huespan.queries import QUERIES
from huespan.queries import images as sf_images
from huespan.sources import images as src
from huespan.sources import stored

COLUMNS = "id long, filename string, r double, g double, b double"
A = (66.0, 35.0, 226.0)


def frame(spark, points):
    return spark.createDataFrame([(k, f"f{k}", *map(float, p)) for k, p in enumerate(points)], COLUMNS)


def some_points(rnd, n=200):
    return [tuple(rnd.choice([0, 255, 128, rnd.randint(0, 255), rnd.uniform(0, 255)]) for _ in range(3)) for _ in range(n)] + [(0, 0, 0), (255, 255, 255), (10, 10, 10)]


@pytest.mark.parametrize("name", sorted(spaces.SPACES))
def test_columns_equal_the_point(spark, rnd_core, name):
    points = some_points(rnd_core)
    rows = spaces.mapped(frame(spark, points), name).orderBy("id").collect()
    for p, r in zip(points, rows, strict=True):
        assert spaces.SPACES[name].point(*p) == pytest.approx((r.r, r.g, r.b), abs=1e-9)


@pytest.fixture
def rnd_core():
    return random.Random(77)


def test_known_coordinates():
    lab = spaces.SPACES["lab"].point
    assert lab(255, 255, 255) == pytest.approx((100, 0, 0), abs=0.01) and lab(0, 0, 0) == pytest.approx((0, 0, 0), abs=1e-9)
    assert lab(255, 0, 0) == pytest.approx((53.24, 80.09, 67.20), abs=0.01) and lab(0, 0, 255) == pytest.approx((32.30, 79.19, -107.86), abs=0.01)
    for p in [(10, 200, 30), (250, 3, 99), (7, 7, 7), (1, 2, 250)]:
        h, s, v = colorsys.rgb_to_hsv(*[c / 255 for c in p])
        x, y, z = spaces.SPACES["hsv"].point(*p)
        assert z == pytest.approx(v * 255) and math.hypot(x, y) == pytest.approx(s * v * 255) and (s == 0 or math.atan2(y, x) % (2 * math.pi) == pytest.approx(h * 2 * math.pi))


@pytest.mark.parametrize("name", sorted(spaces.SPACES))
def test_bounds_hold_every_hit(rnd_core, name):
    """Over many pairs: a colour within the threshold lies within the channels' bounds."""
    point = spaces.SPACES[name].point
    narrow = 0
    for _ in range(4000):
        q = tuple(rnd_core.uniform(0, 255) for _ in range(3))
        p = tuple(min(255.0, max(0.0, v + rnd_core.uniform(-25, 25))) for v in q)
        t = math.dist(point(*q), point(*p))
        bounds = spaces.channel_bounds(q, t, name)
        assert all(lo <= v <= hi for v, (lo, hi) in zip(p, bounds, strict=True))
        narrow += any(lo > 0 or hi < 255 for lo, hi in bounds)
    assert narrow > 2000


@pytest.mark.parametrize("name", sorted(spaces.SPACES))
def test_search_in_a_space(spark, rnd_core, name, tmp_path):
    points = some_points(rnd_core, 400)
    frame(spark, points).write.parquet(str(tmp_path / "i"))
    df = spark.read.parquet(str(tmp_path / "i"))
    point = spaces.SPACES[name].point
    for t in (0.0, 12.0, 60.0):
        q = points[rnd_core.randrange(len(points))]
        want = sorted(k for k, p in enumerate(points) if math.dist(point(*p), point(*q)) <= t + 1e-9)
        found = spaces.hits(df, q, t + 1e-9, name)
        assert sorted(r.id for r in found.collect()) == want
        assert any(f.startswith("GreaterThanOrEqual(r") for f in pushed_filters(found))
    assert spaces.hits(df, A, -1.0, name).count() == 0


def test_joins_work_in_a_space(spark, rnd_core):
    points, asked = some_points(rnd_core, 60), [(k, *map(float, p)) for k, p in enumerate(some_points(rnd_core, 12))]
    queries = spark.createDataFrame(asked, "query_id long, qr double, qg double, qb double")
    got = joins.knn_join(spaces.mapped(frame(spark, points), "lab"), spaces.mapped(queries, "lab", "q"), 3).collect()
    lab = spaces.SPACES["lab"].point
    for k, *q in asked:
        want = sorted(math.dist(lab(*p), lab(*q)) for p in points)[:3]
        assert [r.distance for r in sorted(got, key=lambda r: r.rank) if r.query_id == k] == pytest.approx(want, abs=1e-9)


def cosine(a, b):
    return 1 - sum(x * y for x, y in zip(a, b, strict=True)) / (math.hypot(*a) * math.hypot(*b))


def test_cosine_join(spark, rnd_core):
    points, asked = some_points(rnd_core, 150), some_points(rnd_core, 20)
    queries = spark.createDataFrame([(k, *map(float, q)) for k, q in enumerate(asked)], "query_id long, qr double, qg double, qb double")
    for t in (1e-9, 0.003, 0.2):
        got = sorted((r.query_id, r.id) for r in joins.cosine_join(frame(spark, points), queries, t).collect())
        assert got == sorted((i, k) for i, q in enumerate(asked) if any(q) for k, p in enumerate(points) if any(p) and cosine(p, q) <= t)
    with pytest.raises(ValueError, match="below 1"):
        joins.cosine_join(frame(spark, points), queries, 1.0)


def test_cosine_and_city_blocks_over_the_index(spark, tmp_path):
    images, path = sf_images(spark, "/root/testdata/sf0.01"), str(tmp_path / "i")
    images = images.unionByName(images.limit(1).withColumns({"id": F.lit(-1).cast("long"), "r": F.lit(0.0), "g": F.lit(0.0), "b": F.lit(0.0)}))
    images = images.unionByName(images.limit(1).withColumns({"id": F.lit(-2).cast("long"), "r": F.lit(-60.0), "g": F.lit(-30.0), "b": F.lit(-220.0)}))
    stored.create(images, path, cap=300)
    ids = lambda df: sorted(r.id for r in df.collect())
    for q, t in ((A, 0.01), (A, 0.2), ((255.0, 0.0, 0.0), 0.05), (A, 1.0), ((0.0, 0.0, 0.0), 0.5)):
        assert ids(stored.hits(spark, path, q, t, "cosine")) == ids(search.hits(images, q, t, metric="cosine"))
    for t in (0.0, 60.0):
        want = ids(search.hits(images, A, t, "linear", "manhattan"))
        assert ids(stored.hits(spark, path, A, t, "manhattan")) == ids(search.hits(images, A, t, "hash_grid", "manhattan")) == ids(search.hits(images, A, t, "octree", "manhattan")) == want
    candidates = stored.candidates(spark, path, A, 0.01, "cosine")
    assert candidates.count() < images.count() / 3 and len(candidates.inputFiles()) < len(stored.images(spark, path).inputFiles()) / 2


def test_dual_tree_equals_the_grid_with_fewer_candidates(spark, rnd_core):
    images, parts = sf_images(spark, "/root/testdata/sf0.01"), src.queries_from_parts(spark, "/root/testdata/sf0.01").where("query_id <= 300")
    rows = lambda df: sorted((r.query_id, r.id, r.distance) for r in df.collect())
    pairs = rows(dual.dual_tree_join(images, parts, 30.0))
    assert pairs and pairs == rows(joins.similarity_join(images, parts, 30.0))
    # What the grid compares: packed colours that share a cell.
    asked = joins._spread(joins.packed(parts, joins.Q, "query_id"), 15.0, 2, 30.0)
    points = joins.packed(images, list("rgb"), "id").withColumns({f"c{c}": colour.cell(F.col(c), 15.0) for c in "rgb"})
    assert dual.candidate_pairs(images, parts, 30.0).count() < points.join(asked, joins.CELLS).count()
    points = some_points(rnd_core, 80) + [(300, -20, 5), (float("nan"), 1, 1)]
    queries = spark.createDataFrame([(k, *map(float, q)) for k, q in enumerate([(290, 0, 0), (0, 0, 0), (9, 9, 9)])], "query_id long, qr double, qg double, qb double")
    small = frame(spark, points)
    for t in (0.0, 25.0, 500.0):
        assert rows(dual.dual_tree_join(small, queries, t)) == rows(joins.similarity_join(small, queries, t))
    assert dual.dual_tree_join(small.limit(0), queries, 5.0).count() == dual.dual_tree_join(small, queries, -1.0).count() == 0


def test_plans_hold_no_nested_loop(spark, sf):
    for name in ("dual_tree_join", "cosine_join", "tuned_cell", "selectivity_estimate"):
        text = plan_text(QUERIES[name](spark, sf))
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_estimates_are_near_the_truth(spark, rnd_core):
    images = sf_images(spark, "/root/testdata/sf0.01").cache()
    queries = [(tuple(rnd_core.uniform(0, 255) for _ in range(3)), t) for t in (0.0, 10.0, 40.0, 90.0, 200.0) for _ in range(2)]
    chooser = choice.Chooser(images)
    for (q, t), r in zip(queries, choice.estimates(choice.histogram(images), queries).orderBy("place").collect(), strict=True):
        true = search.hits(images, q, t, "linear").count()
        assert r.total == 15000 and r.at_least <= true <= r.at_most
        # The stated error: a tenth of the count, and three standard deviations of a count so large.
        assert abs(r.estimate - true) <= 0.1 * true + 3 * math.sqrt(true + 1) + 3
        assert chooser.found(q, t) == pytest.approx(r.estimate, rel=1e-9, abs=1e-9)


def test_choices_follow_the_data(spark, tmp_path):
    def of(n, spread):
        rows = spark.range(n).select("id", F.lit("f").alias("filename"), *[(F.rand(k) * spread + (255 - spread) / 2).alias(c) for k, c in enumerate("rgb")])
        return choice.Chooser(rows)

    wide, tight = of(200_000, 255.0), of(200_000, 6.0)
    middle = (128.0, 128.0, 128.0)
    wide.n, tight.n = wide.n * 1000, tight.n * 1000  # as if there were a thousand times as many
    wide.total, tight.total = 200_000_000, 200_000_000
    assert wide.choose(middle, 20.0).strategy == "bbox" and tight.choose(middle, 20.0).strategy == "linear"
    assert wide.choose(middle, 442.0).strategy == "linear"
    folders = [(5.0, 1_000_000)] + [(60.0 + k, 1_000_000) for k in range(199)]
    assert wide.choose(middle, 20.0, folders=folders).strategy == "stored" and wide.choose(middle, 300.0, folders=folders).strategy == "linear"
    assert wide.choose_for_many(1, 20.0).strategy == "linear" and wide.choose_for_many(50_000, 20.0).strategy == "join"
    assert of(0, 1.0).choose(middle, 5.0).found == 0.0
    few = spark.range(50).select("id", F.lit("f").alias("filename"), *[F.lit(128.0).alias(c) for c in "rgb"])
    assert search.hits(few, middle, 20.0, chooser=tight).count() == search.hits(few, middle, 20.0, chooser=wide).count() == 50
    images, path = sf_images(spark, "/root/testdata/sf0.001"), str(tmp_path / "i")
    stored.create(images, path, cap=200)
    assert sum(n for _, n in stored.folders(spark, path, middle)) == images.count()


def test_tuned_cells_follow_the_data(spark):
    best = lambda df, t: df.sparkSession and choice.tune_cell(df, t).where("chosen").first().size
    images = sf_images(spark, "/root/testdata/sf0.01")
    narrow = images.withColumns({c: F.col(c) / 16 for c in "rgb"})
    assert best(images, 40.0) > best(narrow, 4.0) and best(images, 40.0) in (16.0, 32.0, 64.0)
    assert choice.tune_cell(images.limit(0), 40.0).count() == 0


def test_dual_tree_meets_queries_first(spark):
    """Images meet the queries near their node, not a row for every pair of nodes, and neither side is broadcast."""
    images, parts = sf_images(spark, "/root/testdata/sf0.01"), src.queries_from_parts(spark, "/root/testdata/sf0.01")
    done = dual.dual_tree_join(images, parts, 30.0)
    done.collect()
    text = done._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    joined = [line for line in text.splitlines() if re.search(r"Join \[[ab]_key#", line)]
    assert len(joined) >= 2 and all("SortMergeJoin" in line for line in joined[:2]) and "[a_key#" in joined[0]
