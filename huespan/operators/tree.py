"""Adaptive bucket trees (octree over r, g, b; quadtree over r, g) without recursion.

A node splits if it holds more than `cap` rows and lies above `max_depth`; that doesn't depend on the order of insertion, so the
nodes of all levels follow from counts by (level, cell): internal nodes are the cells with more than cap rows, and a leaf is
a child of an internal node that isn't internal itself (or the root).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huespan.functions import colour

#: Level whose boxes are tested on a row itself, before it is matched with leaves.
ANCESTORS = 4
#: Leaves in reach that are looked up on a row, and bits of a cell's place on an axis.
MOST_LEAVES, PACK_BITS = 20_000, 20


def _names(dims: int) -> list[str]:
    return [f"c{k}" for k in range(dims)]


def _cells(level: int | Column, dims: int) -> list[Column]:
    return [colour.level_cell(F.col(c), level).alias(n) for c, n in zip(colour.CHANNELS, _names(dims), strict=False)]


def internal_nodes(images: DataFrame, cap: int, max_depth: int, dims: int = 3) -> DataFrame:
    """level, c0.., n of every internal node. Equal points are counted before they are spread over the levels, so a hot colour is one row there."""
    points = images.groupBy(*colour.CHANNELS[:dims]).agg(F.count(F.lit(1)).alias("n"))
    levels = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(max(0, max_depth - 1)))))
    counts = levels.select("level", "n", *_cells(F.col("level"), dims)).groupBy("level", *_names(dims)).agg(F.sum("n").alias("n"))
    return counts.where((F.col("n") > cap) & F.lit(max_depth > 0))


def stats(images: DataFrame, cap: int, max_depth: int, dims: int = 3) -> DataFrame:
    """total, max_depth, leaf_nodes, internal_nodes, total_nodes, ratio, avg_per_leaf: one row."""
    fan = 1 << dims
    inner = internal_nodes(images, cap, max_depth, dims)
    nodes = inner.agg(F.count(F.lit(1)).alias("internal_nodes"), F.coalesce(F.max("level") + 1, F.lit(0)).cast("int").alias("max_depth"), F.lit(1).alias("one"))
    total = images.agg(F.count(F.lit(1)).alias("total"), F.lit(1).alias("one"))
    leaf = F.lit(1) + F.lit(fan - 1) * F.col("internal_nodes")
    return total.join(nodes, "one").select(
        "total",
        "max_depth",
        leaf.alias("leaf_nodes"),
        "internal_nodes",
        (leaf + F.col("internal_nodes")).alias("total_nodes"),
        F.when(F.col("internal_nodes") > 0, leaf / F.col("internal_nodes")).otherwise(F.lit(0.0)).alias("ratio"),
        (F.col("total") / leaf).alias("avg_per_leaf"),
    )


def leaves(images: DataFrame, cap: int, max_depth: int, dims: int = 3) -> DataFrame:
    """level, c0.., and bounds lo_r, hi_r.. of all leaves, empty ones too."""
    names = _names(dims)
    inner = internal_nodes(images, cap, max_depth, dims).select("level", *names)
    spread = inner.withColumn("o", F.explode(F.sequence(F.lit(0), F.lit((1 << dims) - 1))))
    bits = [F.shiftright("o", dims - 1 - k).bitwiseAND(F.lit(1)) for k in range(dims)]
    children = spread.select((F.col("level") + 1).alias("level"), *[(F.col(n) * 2 + b).alias(n) for n, b in zip(names, bits, strict=True)])
    root = images.sparkSession.range(1).select(F.lit(0).alias("level"), *[F.lit(0).cast("long").alias(n) for n in names])
    return with_bounds(root.unionByName(children).join(inner, ["level", *names], "left_anti"), dims)


def with_bounds(nodes: DataFrame, dims: int) -> DataFrame:
    """Adds the box of each node."""
    size = F.lit(colour.TOP) / colour.cells_of_level(F.col("level"))
    bounds = {}
    for n, c in zip(_names(dims), colour.CHANNELS, strict=False):
        bounds |= {f"lo_{c}": F.col(n) * size, f"hi_{c}": (F.col(n) + 1) * size}
    return nodes.withColumns(bounds)


def prune(nodes: DataFrame, query: tuple[float, float, float], threshold: float, dims: int = 3, slack: float = 1.0) -> DataFrame:
    """Nodes whose box comes within slack * threshold of the query; a slack over 1 only keeps more."""
    return nodes.withColumn("gap", colour.gap_to_box(query, dims)).where(F.col("gap") <= float(threshold * slack))


def _ancestor_near(query: tuple[float, float, float], reach: float, dims: int) -> Column:
    """Whether a row's ancestor on an upper level has a side within reach of the query on every axis: plain bounds, which a scan can use."""
    size = colour.TOP / (1 << ANCESTORS)
    lows = [math.floor((q - reach) / size) * size for q in query[:dims]]
    highs = [(math.floor((q + reach) / size) + 1) * size for q in query[:dims]]
    return colour.box_contains(tuple(lows), tuple(highs))


def _packed(cells: list[Column]) -> Column:
    """Cells of one level as one number; PACK_BITS a cell."""
    out = cells[0].cast("long")
    for c in cells[1:]:
        out = F.shiftleft(out, PACK_BITS).bitwiseOR(c.cast("long"))
    return out


def _joined(cells: dict[int, set[tuple[int, ...]]], dims: int) -> dict[int, set[tuple[int, ...]]]:
    """The same space with full sets of siblings as their parent, from the deepest level up."""
    out = {level: set(found) for level, found in cells.items()}
    for level in sorted(range(1, max(out, default=0) + 1), reverse=True):
        of_parent: dict[tuple[int, ...], list[tuple[int, ...]]] = {}
        for c in out.get(level, ()):
            of_parent.setdefault(tuple(v >> 1 for v in c), []).append(c)
        for parent, children in of_parent.items():
            if len(children) == 1 << dims:
                out[level].difference_update(children)
                out.setdefault(level - 1, set()).add(parent)
    return {level: found for level, found in out.items() if found}


def predicate(images: DataFrame, query: tuple[float, float, float], threshold: float, cap: int, max_depth: int, dims: int, slack: float = 1.0) -> Column:
    """Whether a row lies in a leaf that prune() keeps, as a column: no join, so many trees and other tests take one scan together.

    Branch and bound: rows whose ancestors on an upper level are out of reach are left out of the tree, as no other branch is followed. The tree of the rest is one aggregation, whose
    leaves in reach are fetched; if there are more than MOST_LEAVES, their ancestors on a level that can't have more, which holds more candidates and loses none. A row's cells on the
    levels that have any are looked up in those sets. Rows outside the domain lie in no box and stay candidates.
    """
    inside = colour.box_contains((0.0,) * dims, (colour.TOP,) * dims)
    near = _ancestor_near(query, threshold * slack, dims)
    names = _names(dims)
    # Packed cells have PACK_BITS an axis; a deeper leaf is known by its ancestor.
    deepest = min(max_depth, PACK_BITS)
    kept = prune(leaves(images.where(inside & near), cap, max_depth, dims), query, threshold, dims, slack)
    above = lambda most: kept.select(F.least("level", F.lit(most)).alias("level"), *[F.call_function("shiftright", F.col(n), F.greatest(F.col("level") - most, F.lit(0))).alias(n) for n in names])
    few = above(deepest).limit(MOST_LEAVES + 1).collect()
    if len(few) > MOST_LEAVES:
        few = above((MOST_LEAVES.bit_length() - 1) // dims).distinct().collect()
    cells: dict[int, set[tuple[int, ...]]] = {}
    for r in few:
        cells.setdefault(r.level, set()).add(tuple(r[n] for n in names))
    within = F.lit(False)
    for level, found in sorted(_joined(cells, dims).items()):
        keys = sorted(sum(v << (PACK_BITS * (dims - 1 - k)) for k, v in enumerate(c)) for c in found)
        within = within | _packed([colour.level_cell(F.col(c), level) for c in colour.CHANNELS[:dims]]).isin(keys)
    return ~inside | (near & within)


def candidates(images: DataFrame, query: tuple[float, float, float], threshold: float, cap: int, max_depth: int, dims: int, slack: float = 1.0) -> DataFrame:
    """Images in the leaves that prune() keeps: one aggregation for the tree, one scan with its leaves as a filter."""
    return images.where(predicate(images, query, threshold, cap, max_depth, dims, slack))
