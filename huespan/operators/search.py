"""Similarity range search: one query, interchangeable strategies.

A strategy narrows images down to candidates; the threshold, the order and k are applied here, once, so no strategy can return a
row beyond the threshold, and none adds duplicates. Rows that the input repeats stay repeated.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from huespan.functions import colour
from huespan.operators import tree
from huespan.session import written

Point = tuple[float, float, float]
Strategy = Callable[..., DataFrame]
#: Cell sizes of the two grids, and the most cells that a grid's list is made of; more are tested on the row.
GRID_CELL, DYNAMIC_CELL, MOST_CELLS = 30.0, 25.0, 100_000
#: Rows that are ranked in one place, sampled rows that set the bounds beyond that, ranges at most, and how many bounds are compared at once.
RANK_FEW, RANK_SAMPLE, RANK_RANGES, FAN = 20_000, 20_000, 1024, 16


def linear(images: DataFrame, query: Point, threshold: float) -> DataFrame:
    """All rows."""
    return images


def bbox(images: DataFrame, query: Point, threshold: float) -> DataFrame:
    """Rows in the cube around the query: bounds that the scan can use."""
    return images.where(colour.within_box(query, threshold))


def with_cells(images: DataFrame, size: float) -> DataFrame:
    return images.withColumns({f"c{c}": colour.cell(F.col(c), size) for c in colour.CHANNELS})


def hash_grid(images: DataFrame, query: Point, threshold: float, cell: float = GRID_CELL) -> DataFrame:
    """Rows whose cell is among the query's (2R+1)^3, by an equi-join; the cell list has a size that only R sets, and MOST_CELLS at most."""
    spark, radius = images.sparkSession, max(0, math.ceil(threshold / cell))
    if (2 * radius + 1) ** 3 > MOST_CELLS:
        return images.where(ring(query, cell) <= radius)
    cells = spark.range(1)
    for c, q in zip(colour.CHANNELS, query, strict=True):
        at = math.floor(q / cell)
        cells = cells.select("*", F.explode(F.sequence(F.lit(at - radius), F.lit(at + radius))).alias(f"c{c}"))
    keyed = with_cells(images, cell).join(F.broadcast(cells.drop("id")), ["cr", "cg", "cb"])
    return keyed.select(*images.columns)


def _cells_near(query: Point, radius: int, cells: int = colour.FIXED_CELLS) -> F.Column:
    """Whether a row's cell on the fixed grid is at most radius cells off on every axis."""
    parts = [F.abs(colour.clamped_cell(F.col(c), cells) - min(math.floor(q / (colour.TOP / cells)), cells - 1)) <= radius for c, q in zip(colour.CHANNELS, query, strict=True)]
    return parts[0] & parts[1] & parts[2]


def hash_fixed(images: DataFrame, query: Point, threshold: float, cells: int = colour.FIXED_CELLS) -> DataFrame:
    """Rows at most one cell off on a 32-cell grid, whatever the threshold: approximate by design."""
    return images.where(_cells_near(query, 1, cells))


def hash_bounded(images: DataFrame, query: Point, threshold: float, cells: int = colour.FIXED_CELLS) -> DataFrame:
    """As hash_fixed, with a radius that follows the threshold (and one more): exact."""
    return images.where(_cells_near(query, math.ceil(threshold / (colour.TOP / cells)) + 1, cells))


def ring(query: Point, cell: float) -> F.Column:
    """Chebyshev distance in cells between a row's cell and the query's."""
    return F.greatest(*[F.abs(colour.cell(F.col(c), cell) - math.floor(q / cell)) for c, q in zip(colour.CHANNELS, query, strict=True)])


def cell_steps(query: Point, cell: float) -> F.Column:
    """City-block distance in cells."""
    r, g, b = [F.abs(colour.cell(F.col(c), cell) - math.floor(q / cell)) for c, q in zip(colour.CHANNELS, query, strict=True)]
    return r + g + b


def hash_dynamic(images: DataFrame, query: Point, threshold: float, cell: float = DYNAMIC_CELL) -> DataFrame:
    """Rows in the rings of cells around the query's, up to the threshold's."""
    return images.where(ring(query, cell) <= math.ceil(threshold / cell))


def octree(images: DataFrame, query: Point, threshold: float, cap: int = 10, max_depth: int = 10, slack: float = 1.0) -> DataFrame:
    return tree.candidates(images, query, threshold, cap, max_depth, 3, slack)


def quadtree(images: DataFrame, query: Point, threshold: float, cap: int = 25, max_depth: int = 12, slack: float = 1.0) -> DataFrame:
    return tree.candidates(images, query, threshold, cap, max_depth, 2, slack)


STRATEGIES: dict[str, Strategy] = {"linear": linear, "bbox": bbox, "hash_grid": hash_grid, "hash_fixed": hash_fixed, "hash_bounded": hash_bounded, "hash_dynamic": hash_dynamic, "octree": octree, "quadtree": quadtree}
EXACT = [s for s in STRATEGIES if s != "hash_fixed"]


#: Strategies that are a test on the row, as columns: (query, threshold) -> whether the row is a candidate.
PREDICATES: dict[str, Callable[[Point, float], F.Column]] = {
    "linear": lambda query, threshold: F.lit(True),
    "bbox": colour.within_box,
    "hash_grid": lambda query, threshold: ring(query, GRID_CELL) <= max(0, math.ceil(threshold / GRID_CELL)),
    "hash_fixed": lambda query, threshold: _cells_near(query, 1),
    "hash_bounded": lambda query, threshold: _cells_near(query, math.ceil(threshold / (colour.TOP / colour.FIXED_CELLS)) + 1),
    "hash_dynamic": lambda query, threshold: ring(query, DYNAMIC_CELL) <= math.ceil(threshold / DYNAMIC_CELL),
}


def predicates(images: DataFrame, query: Point, threshold: float) -> dict[str, Callable[[], F.Column]]:
    """Every strategy of STRATEGIES as a test on a row of the images; those of trees look at the images when they are called."""
    own = {name: (lambda test=test: test(query, threshold)) for name, test in PREDICATES.items()}
    return own | {"octree": lambda: tree.predicate(images, query, threshold, 10, 10, 3), "quadtree": lambda: tree.predicate(images, query, threshold, 25, 12, 2)}


#: Parameters that strategies have by default, as their labels show them.
DEFAULTS = {"hash_grid": {"cell": GRID_CELL}, "hash_dynamic": {"cell": DYNAMIC_CELL}, "hash_fixed": {"cells": colour.FIXED_CELLS}, "hash_bounded": {"cells": colour.FIXED_CELLS}, "octree": {"cap": 10, "max_depth": 10}, "quadtree": {"cap": 25, "max_depth": 12}}


def label(strategy: str, **params: float) -> str:
    """A strategy's name with its parameters, real ones with six decimals."""
    shown = [f"{k}={v:.6f}" if isinstance(v, float) else f"{k}={v}" for k, v in (DEFAULTS.get(strategy, {}) | params).items()]
    return f"{strategy}({', '.join(shown)})" if shown else strategy


def choose(threshold: float, queries: int = 1) -> str:
    """Strategy for "auto": one query is answered by a scan with pushed-down bounds, many by the grid."""
    return "bbox" if queries <= 1 else "hash_grid"


def hits(images: DataFrame, query: Point, threshold: float, strategy: str | Strategy = "auto", metric: str = "euclidean", chooser: object = None, **params: object) -> DataFrame:
    """Rows within the threshold, inclusive, with their distance; in no order. With a chooser (choice.Chooser of the images), "auto" takes what costs least by its histogram."""
    chosen = (choose(threshold) if chooser is None else chooser.choose(query, threshold).strategy) if strategy == "auto" else strategy
    narrow = STRATEGIES[chosen] if isinstance(chosen, str) else chosen
    if metric == "cosine":
        narrow = linear  # bounds in space say nothing about an angle
    found = narrow(images, query, threshold, **params)
    return found.withColumn("distance", colour.distance(query, metric=metric)).where(F.col("distance") <= float(threshold))


def ranked(found: DataFrame) -> DataFrame:
    """Adds rank, from 1 by (distance, id), null ids first, whatever ids are, without bringing many rows to one task.

    The rows are written first, so what finds them runs once and what follows reads the rows alone. A bounded sample by hash of (distance, id) shows whether the rows are few; few are ranked in one place. Else it gives the bounds of ranges of about equal size, whose rows are
    counted; a row's rank is what lies in earlier ranges and its place in its own. Bounds and counts (one a range) are literals of the plan, so a
    task that runs again deals rows as before. Rows equal in distance and id share a range."""
    place = F.row_number().over(Window.orderBy("distance", "id"))
    found = written(found, "hits")
    some = found.select("distance", "id").orderBy(F.xxhash64("distance", "id"), "distance", "id").limit(RANK_FEW + 1).collect()
    if len(some) <= RANK_FEW:
        return found.withColumn("rank", place.cast("long"))
    points = sorted({(r.distance, r.id is not None, r.id) for r in some[:RANK_SAMPLE]}, key=lambda x: x[:2] if x[2] is None else x)
    bounds = [{"distance": d, "id": i} for d, _, i in points[:: -(-len(points) // RANK_RANGES)]]
    at = unused(found, "range")
    dealt = _ranged(found, bounds, at)
    counts = {r[at]: r.n for r in dealt.groupBy(at).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, total = [], 0
    for k in range(len(bounds) + 1):
        before.append(total)
        total += counts.get(k, 0)
    own = F.row_number().over(Window.partitionBy(at).orderBy("distance", "id"))
    earlier = F.element_at(F.array(*[F.lit(n).cast("long") for n in before]), F.col(at) + 1)
    return dealt.withColumn("rank", own + earlier).drop(at)


def _ranged(found: DataFrame, bounds: list[dict], at: str) -> DataFrame:
    """Adds `at`: how many of the ascending bounds (distance, id) a row's lie at or above, looked up step by step, FAN bounds at a time."""
    kind = f"array<struct<distance:double,id:{found.schema['id'].dataType.simpleString()}>>"
    levels = [bounds]
    while len(levels[-1]) > FAN:
        levels.append(levels[-1][::FAN])
    key = F.struct("distance", "id")
    out = found.withColumn(at, F.lit(1))
    for level in reversed(levels):  # the place, from 1, of the last bound of the level that isn't above; 0 if all are
        listed, begin = F.from_json(F.lit(json.dumps(level)), kind), (F.col(at) - 1) * FAN
        met = F.size(F.filter(F.slice(listed, F.greatest(begin, F.lit(0)) + 1, FAN), lambda b: b <= key))
        out = out.withColumn(at, F.when(F.col(at) == 0, F.lit(0)).otherwise(begin + met))
    return out


def unused(df: DataFrame, name: str) -> str:
    """The name, or one like it that df has no column of."""
    while name in df.columns:
        name += "_"
    return name


def similar(images: DataFrame, query: Point, threshold: float, strategy: str | Strategy = "auto", k: int | None = None, **params: object) -> DataFrame:
    """Hits nearest first, ties by id; k of None or not above 0 is no limit."""
    found = hits(images, query, threshold, strategy, **params)
    ordered = found.orderBy("distance", "id")
    return ordered.limit(k) if k is not None and k > 0 else ordered


def top_k(found: DataFrame, k: int) -> DataFrame:
    """The k nearest with ranks; k rows are ranked in one place."""
    return found.orderBy("distance", "id").limit(k).withColumn("rank", F.row_number().over(Window.orderBy("distance", "id")).cast("long"))


def ring_top_k(images: DataFrame, query: Point, threshold: float, k: int, cell: float = GRID_CELL) -> DataFrame:
    """Approximate top k: rings of cells are taken until they hold k hits, then the nearest k of those.

    A ring further out may hold nearer points, so this can differ from top_k(). The rings' counts are one row for each ring."""
    if k is None or k <= 0:
        return ranked(hits(images, query, threshold, "hash_dynamic", cell=cell))
    found = hits(images, query, threshold, "hash_dynamic", cell=cell).withColumn("ring", ring(query, cell))
    counts = found.groupBy("ring").agg(F.count(F.lit(1)).alias("n"))
    running = F.sum("n").over(Window.orderBy("ring"))
    stop = counts.withColumn("cum", running).agg(F.coalesce(F.min(F.when(F.col("cum") >= k, F.col("ring"))), F.max("ring")).alias("stop"))
    return top_k(found.join(F.broadcast(stop), F.col("ring") <= F.col("stop")).drop("stop"), k)
