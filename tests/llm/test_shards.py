"""12: capacity against every way to cut, cells of any coarseness, hot groups, slots, odd rows."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

from huespan.llm import shards


def least_capacity(sizes, k):
    """By dynamic programming over all cuts."""
    edges = [0]
    for s in sizes:
        edges.append(edges[-1] + s)
    best = [0 if j == 0 else float("inf") for j in range(len(edges))]
    for _ in range(k):
        best = [min(max(best[i], edges[j] - edges[i]) for i in range(j + 1)) for j in range(len(edges))]
    return best[-1]


def frame(spark, sizes, rnd):
    keys = sorted(rnd.sample(range(-(1 << 63), 1 << 63, 1 << 40), len(sizes)))
    return spark.createDataFrame(list(zip(keys, sizes, strict=True)), "key long, bytes long"), keys


@pytest.mark.parametrize("limit", [2, 8, 64, 1 << 16])
def test_capacity_and_cuts_against_all_cuts(spark, rnd, limit):
    for k in (1, 2, 5, 12):
        sizes = [rnd.choice([1, 16, rnd.randint(16, 300), rnd.randint(16, 4000)]) for _ in range(90)]
        groups, keys = frame(spark, sizes, rnd)
        runs, capacity = shards.smallest_capacity(groups, k, limit)
        assert capacity == least_capacity(sizes, k)
        ends = shards.cuts(runs, capacity, k)
        assert len(ends) == k - 1 and ends == sorted(ends)
        filled = [sum(s for key, s in zip(keys, sizes, strict=True) if sum(key > e for e in ends) == j) for j in range(k)]
        assert max(filled) == capacity and sum(filled) == sum(sizes)


def test_keys_next_to_each_other(spark):
    groups = spark.createDataFrame([(k - 5, 10 + k % 3) for k in range(200)], "key long, bytes long")
    _, capacity = shards.smallest_capacity(groups, 7, 4)
    assert capacity == least_capacity([10 + k % 3 for k in range(200)], 7)


def check(rows, shards_wanted):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert set(by) <= set(range(shards_wanted))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    of_text = {}
    for r in rows:
        assert of_text.setdefault((r.size, r.text_crc32), r.shard) == r.shard
    return {k: sum(r.size for r in rows if r.shard == k) for k in range(shards_wanted)}


def test_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = shards.shard(docs).collect()
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.size == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id]) and r.law == "bytes" and r.grown_shard is None for r in rows)
    filled = check(rows, 40)
    sizes = {}
    for t in texts.values():
        sizes[t] = sizes.get(t, 0) + len(t) + 16
    # No shard is above what an even share and the largest group that shares a shard make.
    left, alone = sum(sizes.values()), 0
    for s in sorted(sizes.values(), reverse=True):
        if s * (40 - alone) < left:
            break
        alone, left = alone + 1, left - s
    rest = sorted(sizes.values(), reverse=True)[alone:]
    assert max(sorted(filled.values(), reverse=True)[alone:]) <= left / (40 - alone) + rest[0]
    assert min(filled.values()) > 0


def test_a_huge_group_has_its_own_shard_and_the_rest_stays_even(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("copy " * 20)).otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    rows = shards.shard(docs, 10).collect()
    filled = check(rows, 10)
    assert len(rows) == 6000 and filled[0] == 2000 * 116
    others = [filled[k] for k in range(1, 10)]
    assert max(others) - min(others) < 0.02 * max(others)


def test_order_of_rows_does_not_matter(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 97).cast("int")).alias("text"))
    one, two = ({r.doc_id: r.shard for r in shards.shard(d, 6).collect()} for d in (docs.coalesce(1), docs.orderBy(F.rand(3)).repartition(9)))
    assert one == two


def test_odd_rows(spark):
    long = "long text " * 200_000
    rows = [(1, None, 1), (2, "", 1), (None, "a", 1), (None, "a", 1), (5, "a", 1), (6, "é", 1), (7, long, 1), (7, long, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int").withColumns({c: F.lit(0) for c in ("key", "size", "slot", "salt", "cell", "part", "n")})
    got = shards.shard(docs).collect()
    check(got, 40)
    assert sorted((r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted((i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert len({r.shard for r in got if r.doc_id in (1, 2)}) == 1 and len({r.shard for r in got if r.size == 17}) == 1
    assert shards.shard(docs.limit(0)).count() == 0
    assert [(r.shard, r.slot) for r in shards.shard(docs.where("doc_id = 6")).collect()] == [(0, 0)]


def test_many_rows_of_a_hot_cell_are_numbered_in_parts(spark, monkeypatch):
    monkeypatch.setattr(shards, "BIN_ROWS", 20)
    docs = spark.range(3000).select((F.col("id") % 7).alias("doc_id"), F.when(F.col("id") < 1500, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("text"))
    rows = shards.shard(docs, 5).collect()
    check(rows, 5)
    assert len(rows) == 3000


def test_plan_is_native(spark):
    from huespan.plans.shape import plan_text

    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    assert not any(x in plan_text(shards.shard(docs, 4)) for x in ("Python", "Pandas", "Arrow", "NestedLoop", "Cartesian"))


def test_random_tables(spark):
    rnd = random.Random(4)
    for _ in range(2):
        rows = [(k, rnd.choice(["", "a", "b" * rnd.randint(0, 400), str(k)])) for k in range(300)]
        check(shards.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect(), 8)
