"""Statistics of the uniform grid."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from huespan.operators.search import GRID_CELL, with_cells


def cells(images: DataFrame, size: float = GRID_CELL) -> DataFrame:
    """cr, cg, cb, n of the cells that hold images."""
    return with_cells(images, size).groupBy("cr", "cg", "cb").agg(F.count(F.lit(1)).alias("n"))


def stats(images: DataFrame, size: float = GRID_CELL) -> DataFrame:
    """cells, avg_occupancy (0 if there are none): one row."""
    return stats_of(cells(images, size)).drop("total")


def stats_of(counted: DataFrame) -> DataFrame:
    """total, cells, avg_occupancy of counted cells: one row."""
    return counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.count(F.lit(1)).alias("cells"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("avg_occupancy"))


def occupancy(images: DataFrame, size: float = GRID_CELL) -> DataFrame:
    """cells, min, upper median and max of the occupancies: one row.

    The median comes from a histogram of occupancies, which has few rows however many cells there are."""
    by_n = cells(images, size).groupBy("n").agg(F.count(F.lit(1)).alias("m"))
    pairs = F.sort_array(F.collect_list(F.struct("n", "m")))
    one = by_n.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("cells"), F.min("n").alias("min_occupancy"), F.max("n").alias("max_occupancy"), pairs.alias("pairs"))
    # The element at place cells / 2 (from 0) of the sorted occupancies.
    walk = F.aggregate(
        "pairs",
        F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("long").alias("at")),
        lambda acc, p: F.struct((acc.seen + p.m).alias("seen"), F.coalesce(acc.at, F.when(acc.seen + p.m > F.floor(F.col("cells") / 2), p.n)).alias("at")),
    )
    return one.select("cells", "min_occupancy", walk["at"].alias("median_occupancy"), "max_occupancy")
