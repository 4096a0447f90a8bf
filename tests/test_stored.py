"""The stored index: pruned files, inserts that equal one load, splits, repeats, breaks."""

import random

import pytest
from pyspark.sql import functions as F

from huespan.operators import search
from huespan.queries import images as sf_images
from huespan.sources import stored

A = (66.0, 35.0, 226.0), 40.0
COLUMNS = "id long, filename string, r double, g double, b double"


def bag(df):
    return sorted((r.id is None, r.id or 0, str(r.r), str(r.g), str(r.b)) for r in df.collect())


def tree_of(spark, path):
    """Rows by leaf."""
    m = stored.version(spark, path).manifest
    return {r.leaf: r.n for r in m.groupBy("leaf").agg(F.sum("n").alias("n")).collect()}


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    stored.create(sf_images(spark, "/root/testdata/sf0.01"), path, cap=500)
    return path


def test_search_opens_few_files(spark, built):
    images = sf_images(spark, "/root/testdata/sf0.01")
    for query, threshold in (A, ((0.0, 0.0, 0.0), 15.0), ((128.0, 128.0, 128.0), 50.0), ((1.0, 1.0, 1.0), 0.0)):
        found = stored.hits(spark, built, query, threshold)
        assert bag(found) == bag(search.hits(images, query, threshold, "linear"))
    every, opened = len(stored.images(spark, built).inputFiles()), len(stored.candidates(spark, built, *A).inputFiles())
    assert 0 < opened <= every / 2
    assert bag(stored.images(spark, built)) == bag(images)


def test_leaves_are_those_of_the_tree(spark, built):
    from huespan.operators import tree

    held = tree_of(spark, built)
    assert sum(held.values()) == 15000 and max(held.values()) <= 500
    leaves = tree.leaves(sf_images(spark, "/root/testdata/sf0.01"), 500, stored.DEPTH, 3)
    wanted = {f"z{r.level}_{sum(((c >> k) & 1) << (3 * k + 2 - j) for j, c in enumerate((r.c0, r.c1, r.c2)) for k in range(9))}" for r in leaves.collect()}
    assert set(held) <= wanted


@pytest.mark.parametrize("most", [2, 5000])
def test_many_folders_are_opened_by_a_join(spark, built, monkeypatch, most):
    monkeypatch.setattr(stored, "MOST_FOLDERS", most)
    assert bag(stored.hits(spark, built, *A)) == bag(search.hits(sf_images(spark, "/root/testdata/sf0.01"), *A, "linear"))


def test_inserts_equal_one_load(spark, tmp_path):
    images = sf_images(spark, "/root/testdata/sf0.01").where("id < 6000")
    one, many = str(tmp_path / "one"), str(tmp_path / "many")
    stored.create(images, one, cap=300)
    for k in range(3):
        assert stored.insert(images.where(F.col("id") % 3 == k), many, f"b{k}", cap=300)
        assert not stored.insert(images.where(F.col("id") % 3 == k), many, f"b{k}", cap=300)
    assert tree_of(spark, one) == tree_of(spark, many)
    assert bag(stored.images(spark, many)) == bag(images)
    for query, threshold in (A, ((200.0, 10.0, 90.0), 25.0)):
        assert bag(stored.hits(spark, many, query, threshold)) == bag(stored.hits(spark, one, query, threshold))
    before, n = bag(stored.hits(spark, many, *A)), stored.version(spark, many).number
    assert stored.compact(spark, many, most=1) and not stored.compact(spark, many, most=1)
    assert stored.version(spark, many).number == n + 1 and bag(stored.hits(spark, many, *A)) == before
    assert stored.vacuum(spark, many) > 0 and stored.vacuum(spark, many) == 0
    assert bag(stored.hits(spark, many, *A)) == before and bag(stored.images(spark, many)) == bag(images)
    assert not stored.insert(images, many, "b0") and stored.insert(images.limit(0), many, "empty")
    assert tree_of(spark, many) == tree_of(spark, one)


def test_an_insert_that_broke_off_is_repeated(spark, tmp_path, monkeypatch):
    images, path = sf_images(spark, "/root/testdata/sf0.001"), str(tmp_path / "i")
    stored.create(images.where("id < 2000"), path, cap=100)
    before = bag(stored.images(spark, path))
    commit = stored._commit
    monkeypatch.setattr(stored, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        stored.insert(images.where("id >= 2000"), path, "late")
    assert bag(stored.images(spark, path)) == before  # nothing of it shows
    monkeypatch.setattr(stored, "_commit", commit)
    assert stored.insert(images.where("id >= 2000"), path, "late")
    assert bag(stored.images(spark, path)) == bag(images)
    with pytest.raises(RuntimeError, match="another"):
        now = stored.version(spark, path)
        stored._commit(spark, path, now.number, now.manifest, now.cells, now.batches, now.cap)


def test_odd_rows(spark, tmp_path):
    nan = float("nan")
    rnd = random.Random(3)
    rows = [(k, "f", rnd.uniform(-50, 400), rnd.uniform(0, 255), rnd.uniform(0, 255)) for k in range(300)]
    rows += [(1000 + k, "hot", 9.0, 9.0, 9.0) for k in range(200)] + [(1000, "hot", 9.0, 9.0, 9.0)] * 3
    rows += [(2000, "n", nan, 1.0, 1.0), (2001, "n", None, 1.0, 1.0), (2002, "n", float("inf"), 1.0, 1.0), (None, None, 9.0, 9.0, 9.5)]
    df = spark.createDataFrame([(*r, "x") for r in rows], COLUMNS + ", leaf string")
    path = str(tmp_path / "odd")
    stored.create(df.where("id < 1100 OR id IS NULL"), path, cap=20)
    stored.insert(df.where("id >= 1100"), path, "b")
    assert bag(stored.images(spark, path)) == bag(df.select(*COLUMNS.replace(" long", "").replace(" string", "").replace(" double", "").split(", ")))
    place = df.where("not isnan(r) and r is not null")
    for query, threshold in (((9.0, 9.0, 9.0), 1.0), ((350.0, 128.0, 128.0), 80.0), ((-40.0, 10.0, 10.0), 100.0)):
        assert bag(stored.hits(spark, path, query, threshold)) == bag(search.hits(place, query, threshold, "linear"))
    assert stored.hits(spark, path, (9.0, 9.0, 9.0), -1.0).count() == 0
    stored.clear(spark, path)
    assert stored.images(spark, path).count() == stored.hits(spark, path, *A).count() == 0 and stored.version(spark, path) is None
    stored.create(df.limit(0), path)
    assert stored.hits(spark, path, *A).count() == 0
    with pytest.raises(ValueError, match="batch"):
        stored.insert(df, path, "a/b")


def test_files_are_bounded_whatever_the_leaves(spark, tmp_path):
    images, path = sf_images(spark, "/root/testdata/sf0.001"), str(tmp_path / "i")
    stored.create(images, path, cap=1)
    files = len(stored.images(spark, path).inputFiles())
    assert len(tree_of(spark, path)) > 1000 and files <= 8**stored.NODE_LEVEL + 8
    assert bag(stored.hits(spark, path, *A)) == bag(search.hits(images, *A, "linear"))


def test_an_insert_writes_no_stored_image_again(spark, tmp_path):
    images, path = sf_images(spark, "/root/testdata/sf0.001"), str(tmp_path / "i")
    stored.create(images.where("id % 3 = 0"), path, cap=100, batch="a")
    first = set(tree_of(spark, path))
    stored.insert(images.where("id % 3 > 0"), path, "b")
    held = {r.batch: r.n for r in stored.version(spark, path).manifest.groupBy("batch").agg(F.sum("n").alias("n")).collect()}
    assert held == {"a": images.where("id % 3 = 0").count(), "b": images.where("id % 3 > 0").count()}
    assert first - set(tree_of(spark, path)) and max(tree_of(spark, path).values()) <= 100


def test_counts_of_a_level_are_made_once(spark):
    cells = spark.createDataFrame([(k, 3) for k in range(64)] + [(8**7, 1)], "code long, n long")
    leaves = stored.leaf_of_cells(cells, 30)
    assert "Aggregate" not in leaves._jdf.queryExecution().optimizedPlan().toString()
    assert {r.code: r.level for r in leaves.collect()} == {k: 7 for k in range(64)} | {8**7: 1}


def test_a_name_is_hashed_once(spark):
    plan = sf_images(spark, "/root/testdata/sf0.001").where("r < 50")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("md5(") == 1


def test_places_in_z_order(spark):
    rows = [(k, "f", float(r), float(g), float(b)) for k, (r, g, b) in enumerate([(0, 0, 0), (255, 255, 255), (1, 2, 4), (200, 100, 50), (-3, 300, 128)])]
    at = [[min(max(int(v * 256 // 255), 0), 255) for v in r[2:]] for r in rows]
    want = [sum((c >> k & 1) << (3 * k + 2 - j) for j, c in enumerate(cs) for k in range(8)) for cs in at]
    assert [r.code for r in spark.createDataFrame(rows, COLUMNS).orderBy("id").select(stored.z_code().alias("code")).collect()] == want
