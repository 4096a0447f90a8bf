"""Benchmark rows and the reports made of them."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from huespan.operators import search
from huespan.sources.images import synthetic

RESULT_SQL = "structure string, dataset_size int, insert_ms double, search_ms double, found long"

# The published run over real images, (structure, size, insert ms, search ms, found).
PUBLISHED = [
    ("Linear", 10000, 0.972, 0.060, 141), ("Hash", 10000, 2.477, 0.069, 141), ("HashDynamic", 10000, 2.965, 0.137, 272), ("Quadtree", 10000, 15.532, 0.149, 869), ("Octree", 10000, 7.956, 0.359, 141),
    ("Linear", 25000, 3.601, 0.156, 351), ("Hash", 25000, 6.125, 0.206, 351), ("HashDynamic", 25000, 11.504, 0.353, 673), ("Quadtree", 25000, 42.564, 0.523, 1820), ("Octree", 25000, 21.216, 1.205, 351),
    ("Linear", 50000, 3.953, 0.297, 725), ("Hash", 50000, 10.923, 0.158, 725), ("HashDynamic", 50000, 12.868, 0.325, 1411), ("Quadtree", 50000, 62.730, 0.692, 3209), ("Octree", 50000, 41.887, 2.146, 725),
    ("Linear", 100000, 7.985, 0.584, 1449), ("Hash", 100000, 20.552, 0.379, 1449), ("HashDynamic", 100000, 26.379, 0.732, 2824), ("Quadtree", 100000, 147.081, 1.709, 6166), ("Octree", 100000, 97.042, 5.613, 1449),
    ("Linear", 150000, 17.195, 1.174, 2200), ("Hash", 150000, 30.275, 0.700, 2200), ("HashDynamic", 150000, 41.710, 1.316, 4295), ("Quadtree", 150000, 194.338, 2.397, 9030), ("Octree", 150000, 161.143, 12.231, 2200),
    ("Linear", 206404, 20.487, 1.376, 3051), ("Hash", 206404, 41.332, 0.791, 3051), ("HashDynamic", 206404, 56.471, 1.650, 5970), ("Quadtree", 206404, 270.934, 3.249, 12993), ("Octree", 206404, 339.644, 23.145, 3051),
]
#: Order of the structures in reports, which also breaks ties.
ORDER = ["Linear", "Hash", "HashDynamic", "Quadtree", "Octree"]
#: A declared fixture: insert times of recursive and iterative variants.
VARIANTS = [("Octree", 1000, "recursive", 1.0), ("Octree", 1000, "iterative", 1.5), ("Octree", 10000, "recursive", 12.0), ("Octree", 10000, "iterative", 9.0), ("Quadtree", 1000, "recursive", 2.0), ("Quadtree", 1000, "iterative", 2.0), ("Quadtree", 10000, "recursive", 8.0), ("Quadtree", 10000, "iterative", 20.0)]
#: Sizes of the synthetic ladder.
SYNTHETIC_LADDER = [100, 500, 1000, 5000, 10_000, 50_000, 100_000, 1_000_000, 10_000_000, 50_000_000]


def published(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PUBLISHED, RESULT_SQL)


def scale_ladder(totals: DataFrame, total: str = "total") -> DataFrame:
    """total, rung (from 1), scale: the sizes at which a collection of that many images is measured. Small totals may get rungs beyond them."""
    n = F.col(total)
    rungs = lambda *v: F.array(*[F.lit(x).cast("long") for x in v], n.cast("long"))
    ladder = (
        F.when(n >= 150_000, rungs(10_000, 25_000, 50_000, 100_000, 150_000))
        .when(n >= 100_000, rungs(10_000, 25_000, 50_000, 100_000))
        .when(n >= 50_000, rungs(10_000, 25_000, 50_000))
        .when(n >= 25_000, rungs(10_000, 25_000))
        .when(n >= 10_000, rungs(10_000))
        .otherwise(rungs(100, 500, 1000, 5000))
    )
    return totals.select(n.cast("long").alias("total"), F.posexplode(ladder).alias("rung", "scale")).withColumn("rung", F.col("rung") + 1)


def found_by_scale(images: DataFrame, query: search.Point, threshold: float, scales: list[int], place: str = "id") -> DataFrame:
    """scale, found: hits among the images whose place is at most each scale, in one pass over the images."""
    found = search.hits(images, query, threshold, "bbox")
    counts = found.agg(*[F.count_if(F.col(place) <= s).alias(f"s{s}") for s in scales])
    pairs = F.explode(F.array(*[F.struct(F.lit(s).cast("long").alias("scale"), F.col(f"s{s}").alias("found")) for s in scales])).alias("x")
    return counts.select(pairs).select("x.scale", "x.found")


def _place(structure: str = "structure") -> F.Column:
    return F.array_position(F.array(*[F.lit(x) for x in ORDER]), F.col(structure))


def winner_by_scale(results: DataFrame) -> DataFrame:
    """dataset_size, the structures with the least insert and search time, and those times; the first of equals wins."""
    best = lambda ms: F.min(F.struct(F.col(ms).alias("ms"), _place().alias("place"), "structure"))
    won = results.groupBy("dataset_size").agg(best("insert_ms").alias("i"), best("search_ms").alias("s"))
    return won.select("dataset_size", F.col("i.structure").alias("insert_winner"), F.col("i.ms").alias("insert_ms"), F.col("s.structure").alias("search_winner"), F.col("s.ms").alias("search_ms"))


def variant_delta(rows: DataFrame) -> DataFrame:
    """structure, dataset_size, delta_pct (of the larger time), winner: recursive only if strictly faster."""
    of = lambda v: F.max(F.when(F.col("variant") == v, F.col("insert_ms")))
    two = rows.groupBy("structure", "dataset_size").agg(of("recursive").alias("rec"), of("iterative").alias("ite"))
    return two.select("structure", "dataset_size", (F.abs(F.col("rec") - F.col("ite")) * 100 / F.greatest("rec", "ite")).alias("delta_pct"), F.when(F.col("rec") < F.col("ite"), "recursive").otherwise("iterative").alias("winner"))


def report_table(results: DataFrame) -> DataFrame:
    """line, scale (on a group's first line only), structure, insert_ms, search_ms, found."""
    group = Window.partitionBy("dataset_size").orderBy(_place())
    rows = results.withColumn("k", F.row_number().over(group))
    return rows.select(F.concat_ws("-", F.lpad(F.col("dataset_size").cast("string"), 10, "0"), F.col("k").cast("string")).alias("line"), F.when(F.col("k") == 1, F.col("dataset_size")).alias("scale"), "structure", "insert_ms", "search_ms", "found")


def rates(results: DataFrame) -> DataFrame:
    """Adds insert_per_s (images a second) and insert_ms_each."""
    return results.withColumns({"insert_per_s": F.when(F.col("insert_ms") > 0, F.col("dataset_size") / F.col("insert_ms") * 1000), "insert_ms_each": F.col("insert_ms") / F.col("dataset_size")})


def measure(images: DataFrame, name: str, query: search.Point, threshold: float, strategy: str, size: int | None = None) -> tuple:
    """(structure, size, insert ms, search ms, found): the time to bring images into executors' memory, and that of one search over them."""
    began = time.perf_counter()
    held = images.cache()
    n = held.count()
    built = time.perf_counter()
    found = search.hits(held, query, threshold, strategy).count()
    done = time.perf_counter()
    held.unpersist()
    return name, size or n, (built - began) * 1000, (done - built) * 1000, found


def run_ladder(spark: SparkSession, scales: list[int], query: search.Point = (128.0, 128.0, 128.0), threshold: float = 50.0, strategies: dict[str, str] | None = None, make: Callable[[SparkSession, int], DataFrame] = synthetic) -> DataFrame:
    """Benchmark rows of every scale and strategy over fresh synthetic data."""
    named = strategies or {"Linear": "linear", "Hash": "hash_grid", "HashDynamic": "hash_dynamic", "Quadtree": "quadtree", "Octree": "octree"}
    rows = [measure(make(spark, n), name, query, threshold, s, n) for n in scales for name, s in named.items()]
    return spark.createDataFrame(rows, RESULT_SQL)
