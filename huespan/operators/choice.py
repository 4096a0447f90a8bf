"""Which strategy, and which cell size, by what the images are like.

A histogram of the domain's cells, on one level of at most 32^3, says how many images a query will find: at least those of cells that lie wholly within the threshold, at most those of
cells that it touches, and about the share of each cell that it covers. Costs are counted in rows looked at; a strategy is chosen by the least of them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huespan.functions import colour
from huespan.operators import grid, search

#: Halvings of the histogram, and points an axis that a cell's share is taken from.
LEVEL, SAMPLES = 5, 4
#: Costs in rows: a row that only its bounds are tested of, a row whose distance is taken, a cell that is looked up, a folder that is opened, what a job costs at all.
BOUND_ROW, ROW, CELL, FOLDER, JOB = 0.3, 1.0, 2.0, 20_000.0, 200_000.0


def _near_and_far(query: tuple[float, float, float], size: float) -> tuple[Column, Column]:
    near, far = F.lit(0.0), F.lit(0.0)
    for k, q in enumerate(query):
        low, high = F.col(f"c{k}") * size, (F.col(f"c{k}") + 1) * size
        gap, reach = F.greatest(low - float(q), F.lit(0.0), float(q) - high), F.greatest(float(q) - low, high - float(q))
        near, far = near + gap * gap, far + reach * reach
    return F.sqrt(near), F.sqrt(far)


def _covered(query: tuple[float, float, float], threshold: float, size: float) -> Column:
    """The share of SAMPLES^3 points of a cell that the threshold covers."""

    def square(k: int, s: Column) -> Column:
        at = (F.floor(s / SAMPLES**k) % SAMPLES + 0.5) / SAMPLES
        gap = (F.col(f"c{k}") + at) * size - float(query[k])
        return gap * gap

    points = F.sequence(F.lit(0), F.lit(SAMPLES**3 - 1))
    return F.size(F.filter(points, lambda s: square(0, s) + square(1, s) + square(2, s) <= float(threshold) ** 2)) / SAMPLES**3


def histogram(images: DataFrame, level: int = LEVEL) -> DataFrame:
    """c0, c1, c2, n: images by the cells of a level; colours outside the domain count in its border."""
    return images.groupBy(*[colour.level_cell(F.col(c), level).alias(f"c{k}") for k, c in enumerate(colour.CHANNELS)]).agg(F.count(F.lit(1)).alias("n"))


def estimates(cells: DataFrame, queries: list[tuple[tuple[float, float, float], float]], level: int = LEVEL) -> DataFrame:
    """place (from 0), total, at_least, estimate, at_most for each (point, threshold): one aggregation over the cells.

    For images in the domain the true count lies between the two bounds."""
    size = colour.TOP / (1 << level)
    parts = []
    for k, (q, t) in enumerate(queries):
        near, far = _near_and_far(q, size)
        share = F.when(near > t, 0.0).when(far <= t, 1.0).otherwise(_covered(q, t, size))
        total = lambda value: F.coalesce(F.sum(value), F.lit(0))
        parts.append(F.struct(F.lit(k).alias("place"), total(F.col("n")).alias("total"), total(F.when(far <= t, F.col("n"))).alias("at_least"), F.coalesce(F.sum(F.col("n") * share), F.lit(0.0)).alias("estimate"), total(F.when(near <= t, F.col("n"))).alias("at_most")).alias(f"e{k}"))
    one = cells.agg(*parts)
    return one.select(F.explode(F.array(*[f"e{k}" for k in range(len(queries))])).alias("x")).select("x.*")


@dataclass(frozen=True)
class Choice:
    """The strategy with the least cost, all costs in rows, and the estimate that they rest on."""

    strategy: str
    costs: dict[str, float]
    found: float
    total: int


class Chooser:
    """Chooses by a histogram that is fetched once, 32^3 cells at most."""

    def __init__(self, images: DataFrame, level: int = LEVEL):
        self.size = colour.TOP / (1 << level)
        rows = histogram(images, level).collect()
        self.low = np.array([[r.c0, r.c1, r.c2] for r in rows], dtype=np.float64).reshape(-1, 3) * self.size
        self.n = np.array([r.n for r in rows], dtype=np.float64)
        self.total = int(self.n.sum())

    def found(self, query: tuple[float, float, float], threshold: float) -> float:
        """About how many images lie within the threshold."""
        if threshold < 0 or not len(self.n):
            return 0.0
        steps = (np.arange(SAMPLES) + 0.5) / SAMPLES * self.size
        squares = [(self.low[:, k, None] + steps - query[k]) ** 2 for k in range(3)]
        total = squares[0][:, :, None, None] + squares[1][:, None, :, None] + squares[2][:, None, None, :]
        return float((self.n * (total <= threshold * threshold).mean(axis=(1, 2, 3))).sum())

    def in_cube(self, query: tuple[float, float, float], radius: float) -> float:
        """Images in the cube of that half side, by each cell's share on each axis."""
        if not len(self.n):
            return 0.0
        share = np.ones(len(self.n))
        for k in range(3):
            covered = np.minimum(self.low[:, k] + self.size, query[k] + radius) - np.maximum(self.low[:, k], query[k] - radius)
            share *= np.clip(covered / self.size, 0, 1)
        return float((self.n * share).sum())

    def choose(self, query: tuple[float, float, float], threshold: float, cell: float = search.GRID_CELL, folders: list[tuple[float, int]] | None = None) -> Choice:
        """The cheapest of a scan, a scan with bounds, a grid look-up, and a stored index if `folders` gives (its distance to the query, its images) of each folder."""
        found = self.found(query, threshold)
        radius = max(0, math.ceil(threshold / cell))
        cube, near = self.in_cube(query, max(threshold, 0.0)), self.in_cube(query, (radius + 0.5) * cell)
        costs = {
            "linear": JOB + self.total * ROW,
            "bbox": JOB + self.total * BOUND_ROW + cube * ROW,
            "hash_grid": JOB + self.total * BOUND_ROW * 2 + (2 * radius + 1) ** 3 * CELL + near * ROW,
        }
        if folders is not None:
            opened = [n for apart, n in folders if apart <= threshold]
            costs["stored"] = JOB + len(opened) * FOLDER + sum(opened) * (BOUND_ROW + cube / max(self.total, 1) * ROW)
        return Choice(min(costs, key=lambda s: costs[s]), costs, found, self.total)

    def choose_for_many(self, queries: int, threshold: float) -> Choice:
        """For a table of queries: each by a scan of its own, or all by a join on cells half as wide as the threshold."""
        side = max(threshold / 2, 1.0)
        share = min(1.0, ((2 * math.ceil(max(threshold, 0) / side) + 1) * side / colour.TOP) ** 3)
        costs = {"linear": queries * (JOB + self.total * ROW), "join": JOB * 4 + self.total * 2 * ROW + queries * 125 * CELL + queries * share * self.total * ROW}
        return Choice(min(costs, key=lambda s: costs[s]), costs, share * self.total * queries, self.total)


def tune_cell(images: DataFrame, threshold: float, finest: float = 4.0, levels: int = 6) -> DataFrame:
    """size, cells, candidates, cost, chosen: what a grid of each size would cost a query that is where images are.

    Images are counted by the finest cells once, and those counts by the coarser ones, so the pyramid costs one pass over the images. A query in a cell of n images visits (2R + 1)^3 cells, which
    hold that many times n at most on average: the sum over cells of n^2 / N. The cost adds the cells visited."""
    counted = grid.cells(images, finest)
    up = counted.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    at = [F.call_function("shiftright", F.col(f"c{c}"), F.col("level")).alias(f"c{c}") for c in colour.CHANNELS]
    pyramid = up.groupBy("level", *at).agg(F.sum("n").alias("n"))
    sizes = pyramid.groupBy("level").agg(F.count(F.lit(1)).alias("cells"), F.sum(F.col("n").cast("double") * F.col("n")).alias("squares"), F.sum("n").alias("total"))
    size = F.lit(finest) * F.pow(F.lit(2.0), "level")
    visited = F.pow(2 * F.ceil(F.lit(float(max(threshold, 0.0))) / size) + 1, F.lit(3.0))
    costed = sizes.select(size.alias("size"), "cells", (visited * F.col("squares") / F.col("total")).alias("candidates"), visited.alias("visited"))
    costed = costed.withColumn("cost", F.col("candidates") * ROW + F.col("visited") * CELL)
    return _with_choice(costed)


def _with_choice(costed: DataFrame) -> DataFrame:
    """One row a size, so the rows of one table are compared in one array."""
    rows = costed.agg(F.collect_list(F.struct("cost", "size", "cells", "candidates")).alias("rows"))
    chosen = rows.select(F.explode("rows").alias("x"), F.array_min("rows")["size"].alias("best"))
    return chosen.select("x.size", "x.cells", "x.candidates", "x.cost", (F.col("x.size") == F.col("best")).alias("chosen"))
