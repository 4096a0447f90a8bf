"""What a search's result is worth, and the summary of a search."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from huespan.functions import colour
from huespan.operators import grid, search, tree

Point = search.Point


def found_count(found: DataFrame) -> DataFrame:
    return found.agg(F.count(F.lit(1)).alias("found"))


def selectivity(images: DataFrame, query: Point, threshold: float) -> DataFrame:
    """found, total, selectivity_pct (null if nothing is found)."""
    hit = colour.distance(query) <= float(threshold)
    one = images.agg(F.count_if(hit).alias("found"), F.count(F.lit(1)).alias("total"))
    return one.withColumn("selectivity_pct", F.when(F.col("found") > 0, F.col("found") / F.col("total") * 100))


def distance_range(found: DataFrame) -> DataFrame:
    return found.agg(F.min("distance").alias("min_distance"), F.max("distance").alias("max_distance"))


def order_summary(rows: DataFrame, by: str = "distance", first: int = 0) -> DataFrame:
    """A row for each partition that has rows, in the order in which they stand: part, n, lowest, highest, head, tail, falls, firsts.

    `falls` is whether a value is below its forerunner inside the partition; head and tail are its ends, and firsts its first ids and values. Rows stay where they are. Null values are left out."""
    kind = rows.schema[by].dataType.simpleString()
    named = rows.select(F.col(by).alias("v"), F.col("id").cast("long").alias("id") if "id" in rows.columns else F.lit(None).cast("long").alias("id")).where("v IS NOT NULL")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc
        from pyspark import TaskContext

        n, low, high, head, tail, falls, firsts, of_type = 0, None, None, None, None, False, [], None
        for b in batches:
            v = b.column(0)
            if not len(v):
                continue
            ends = pc.min_max(v)
            low = ends["min"].as_py() if low is None else min(low, ends["min"].as_py())
            high = ends["max"].as_py() if high is None else max(high, ends["max"].as_py())
            head = v[0].as_py() if n == 0 else head
            falls |= (n > 0 and v[0].as_py() < tail) or bool(pc.any(pc.less(v[1:], v[:-1])).as_py())
            firsts += [{"id": i, "v": x} for i, x in zip(b.column(1)[: first - len(firsts)].to_pylist(), v[: first - len(firsts)].to_pylist(), strict=True)] if len(firsts) < first else []
            n, tail, of_type = n + len(v), v[-1].as_py(), v.type
        if n:
            of = lambda x, t: pa.array([x], t)
            pairs = pa.list_(pa.struct([("id", pa.int64()), ("v", of_type)]))
            yield pa.RecordBatch.from_arrays([of(TaskContext.get().partitionId(), pa.int32()), of(n, pa.int64()), *(of(x, of_type) for x in (low, high, head, tail)), of(falls, pa.bool_()), of(firsts, pairs)], names)

    names = ["part", "n", "lowest", "highest", "head", "tail", "falls", "firsts"]
    return named.mapInArrow(work, f"part int, n long, lowest {kind}, highest {kind}, head {kind}, tail {kind}, falls boolean, firsts array<struct<id:bigint,v:{kind}>>")


def _in_order(parts: DataFrame) -> Column:
    """Whether the partitions' rows follow one another in order; the summaries are one row a partition."""
    return (F.count_if(F.col("falls")) + F.count_if(F.col("head") < F.col("before"))) == 0


def _with_before(parts: DataFrame) -> DataFrame:
    return parts.withColumn("before", F.lag("tail").over(Window.orderBy("part")))


def sortedness(rows: DataFrame, by: str = "distance") -> DataFrame:
    """Whether values never fall along the rows in the order in which they stand: one row.

    Neighbours are compared inside partitions, and then the ends of partitions that follow each other; nothing is sorted or moved. No rows are in order."""
    parts = _with_before(order_summary(rows, by))
    return parts.agg(_in_order(parts).alias("is_sorted"))


def recall(images: DataFrame, query: Point, threshold: float, strategies: list[str] | None = None, **params: dict) -> DataFrame:
    """strategy, found, exact, precision, recall, duplication of each strategy against the linear scan, in rows.

    A strategy that is a test on the row, trees included, can neither add rows beyond the threshold nor double any, so counting suffices: all of them take one scan and one aggregation. With
    own parameters a strategy is counted by row and joined."""
    names = strategies or list(search.STRATEGIES)
    tests = search.predicates(images, query, threshold)
    hit = colour.distance(query) <= float(threshold)
    plain = [n for n in names if n in tests and n not in params]
    one = images.agg(F.count_if(hit).alias("exact"), *[F.count_if(hit & tests[n]()).alias(f"of_{n}") for n in plain])
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("strategy"), F.col(f"of_{n}").alias("found")) for n in plain])) if plain else None
    out = None
    if plain:
        share = F.coalesce(F.try_divide("found", "exact"), F.lit(1.0))
        out = one.select("exact", rows.alias("x")).select("x.strategy", "x.found", "exact", F.lit(1.0).alias("precision"), share.alias("recall"), F.lit(1.0).alias("duplication"))
    joined = [n for n in names if n not in plain]
    if joined:
        other = _recall_by_rows(images, query, threshold, joined, params)
        out = other if out is None else out.unionByName(other)
    return out


def _recall_by_rows(images: DataFrame, query: Point, threshold: float, names: list[str], params: dict) -> DataFrame:
    key = ["id", "filename", "r", "g", "b"]
    rows = search.hits(images, query, threshold, "linear").groupBy(*key).agg(F.count(F.lit(1)).alias("want"))
    for name in names:
        got = search.hits(images, query, threshold, name, **params.get(name, {})).groupBy(*key).agg(F.count(F.lit(1)).alias(f"got_{name}"))
        rows = rows.join(got, key, "full")
    of = lambda name: F.struct(
        F.lit(name).alias("strategy"),
        F.coalesce(F.sum(f"got_{name}"), F.lit(0)).alias("found"),
        F.coalesce(F.sum("want"), F.lit(0)).alias("exact"),
        F.coalesce(F.sum(F.least(f"got_{name}", "want")), F.lit(0)).alias("common"),
        F.coalesce(F.sum(F.when(F.col("want").isNotNull(), F.col(f"got_{name}"))), F.lit(0)).alias("rightly"),
        F.coalesce(F.sum(F.when(F.col(f"got_{name}").isNotNull(), F.col("want"))), F.lit(0)).alias("given"),
    )
    each = rows.agg(*[of(name).alias(f"of_{name}") for name in names]).select(F.explode(F.array(*[f"of_{name}" for name in names])).alias("x")).select("x.*")
    ratio = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(1.0))
    return each.select("strategy", "found", "exact", ratio("rightly", "found").alias("precision"), ratio("common", "exact").alias("recall"), ratio("found", "given").alias("duplication"))


def sample(found: DataFrame, n: int = 3) -> DataFrame:
    """rank, id, distance of the first few."""
    return search.top_k(found, n).select("rank", "id", "distance")


def analyze(images: DataFrame, query: Point, threshold: float, strategy: str = "auto") -> DataFrame:
    """One row: found, total, selectivity_pct, min_distance, max_distance, is_sorted, and the first three as an array, and index statistics as a struct.

    The ordered result is looked at as it comes out, partition by partition (order_summary), which gives all that is said of hits; the statistics of the index count the images beside."""
    chosen = search.choose(threshold) if strategy == "auto" else strategy
    parts = _with_before(order_summary(search.similar(images, query, threshold, chosen), first=3))
    firsts = F.slice(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("part", "firsts"))), lambda p: p["firsts"])), 1, 3)
    found = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("found"), F.min("lowest").alias("min_distance"), F.max("highest").alias("max_distance"), _in_order(parts).alias("is_sorted"), firsts.alias("three"), F.lit(1).alias("one"))
    index = {"octree": lambda: tree.stats(images, 10, 10), "quadtree": lambda: tree.stats(images, 25, 12, 2)}.get(chosen, lambda: grid.stats_of(grid.cells(images)))()
    kept = [c for c in index.columns if c != "total" or chosen in ("octree", "quadtree")]
    both = found.join(index.select("total", F.struct(*kept).alias("index"), F.lit(1).alias("one")), "one")
    three = F.transform("three", lambda x, k: F.struct((k + 1).cast("long").alias("rank"), x["id"].alias("id"), x["v"].alias("distance")))
    share = F.when(F.col("found") > 0, F.col("found") / F.col("total") * 100)
    return both.select(F.lit(chosen).alias("strategy"), "found", "total", share.alias("selectivity_pct"), "min_distance", "max_distance", "is_sorted", three.alias("first_three"), "index")


def visit_counts(images: DataFrame, query: Point, threshold: float, rings: str) -> DataFrame:
    """hits and visits: how often a search that revisits inner cells meets each hit ("cube": whole cubes of growing radius;
    "shell": shells by city-block or Chebyshev radius)."""
    cell = search.DYNAMIC_CELL if rings == "cube" else search.GRID_CELL
    radius = colour.cell_radius(threshold, cell)
    cheb, steps = search.ring(query, cell), search.cell_steps(query, cell)
    if rings == "cube":
        times = F.lit(radius) - cheb + 1
    else:
        times = (cheb <= radius).cast("int") + ((steps <= radius) & (steps != cheb)).cast("int")
    found = search.hits(images, query, threshold, "linear").withColumn("times", times)
    return found.agg(F.count(F.lit(1)).alias("hits"), F.coalesce(F.sum("times"), F.lit(0)).alias("visits"))
