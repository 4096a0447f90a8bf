"""Column expressions over points in RGB space. All stay inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nominal domain of a channel, and the levels of the fixed grid.
TOP, FIXED_CELLS = 255.0, 32
CHANNELS = ("r", "g", "b")


def _channels(at: tuple[float, float, float] | None, prefix: str = "") -> list[Column]:
    return [F.lit(float(v)) for v in at] if at is not None else [F.col(f"{prefix}{c}") for c in CHANNELS]


def squared_distance(query: tuple[float, float, float] | None, prefix: str = "q") -> Column:
    """Sum of squared channel gaps to a literal point, or to columns qr, qg, qb."""
    gaps = [F.col(c) - q for c, q in zip(CHANNELS, _channels(query, prefix), strict=True)]
    return gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]


def distance(query: tuple[float, float, float] | None = None, prefix: str = "q", metric: str = "euclidean") -> Column:
    """Distance of r, g, b to a literal point, or to columns qr, qg, qb. Metrics beside the Euclidean one are extensions."""
    if metric == "euclidean":
        return F.sqrt(squared_distance(query, prefix))
    q = _channels(query, prefix)
    if metric == "manhattan":
        return sum((F.abs(F.col(c) - x) for c, x in zip(CHANNELS[1:], q[1:], strict=True)), F.abs(F.col("r") - q[0]))
    if metric == "cosine":
        dot = F.col("r") * q[0] + F.col("g") * q[1] + F.col("b") * q[2]
        norms = F.sqrt(F.col("r") ** 2 + F.col("g") ** 2 + F.col("b") ** 2) * F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2])
        return F.when(norms > 0, 1 - dot / norms).otherwise(F.lit(1.0))
    raise ValueError(f"unknown metric {metric!r}")


def within_box(query: tuple[float, float, float], threshold: float) -> Column:
    """The bounds on each channel that a distance of at most threshold implies; they reach the Parquet scan."""
    parts = [F.col(c).between(q - threshold, q + threshold) for c, q in zip(CHANNELS, query, strict=True)]
    return parts[0] & parts[1] & parts[2]


def box_contains(lows: tuple[float, ...], highs: tuple[float, ...]) -> Column:
    """Closed containment in a box over the first channels (three bounds: r, g, b; two: r, g)."""
    parts = [F.col(c).between(float(lo), float(hi)) for c, lo, hi in zip(CHANNELS, lows, highs, strict=False)]
    out = parts[0]
    for p in parts[1:]:
        out = out & p
    return out


def cell(v: Column, size: float) -> Column:
    """Number of the cell of a channel; floor, not a cast, so engines agree."""
    return F.floor(v / F.lit(float(size))).cast("int")


def clamped_cell(v: Column, cells: int = FIXED_CELLS) -> Column:
    return F.least(F.floor(v / F.lit(TOP / cells)), F.lit(cells - 1)).cast("int")


def cell_key(*cells: Column) -> Column:
    """Cells as text, for display only: joins use the cells themselves."""
    return F.concat_ws(",", *[c.cast("string") for c in cells])


def packed_key(cr: Column, cg: Column, cb: Column) -> Column:
    return F.shiftleft(cr.cast("long"), 32).bitwiseOR(F.shiftleft(cg.cast("long"), 16)).bitwiseOR(cb.cast("long"))


def cell_radius(threshold: float | Column, size: float) -> int | Column:
    """Cells to visit on each side for a threshold."""
    return F.ceil(threshold / F.lit(float(size))).cast("int") if isinstance(threshold, Column) else math.ceil(threshold / size)


def octant(mid: tuple[float, float, float], weights: tuple[int, int, int] = (4, 2, 1)) -> Column:
    """Octant of a point: a channel at or above the middle sets its bit. The other order of bits is a matter of weights."""
    r, g, b = [(F.col(c) >= F.lit(float(m))).cast("int") * w for c, m, w in zip(CHANNELS, mid, weights, strict=True)]
    return r + g + b


def quadrant(mid: tuple[float, float], weights: tuple[int, int] = (2, 1)) -> Column:
    r, g = [(F.col(c) >= F.lit(float(m))).cast("int") * w for c, m, w in zip(CHANNELS, mid, weights, strict=False)]
    return r + g


def cells_of_level(level: int | Column) -> Column:
    """Cells of a channel on a level."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), level) if isinstance(level, Column) else F.lit(1 << level).cast("long")


def level_cell(v: Column, level: int | Column) -> Column:
    """Cell of a channel when the domain is halved `level` times; the upper end belongs to the last cell."""
    n = cells_of_level(level)
    return F.greatest(F.lit(0).cast("long"), F.least(F.floor(v * n / F.lit(TOP)), n - 1))


def gap_to_box(query: tuple[float, ...], dims: int = 3) -> Column:
    """Least distance of a point to the box lo_r..hi_r, lo_g..hi_g(, lo_b..hi_b); 0 inside."""
    gaps = [F.greatest(F.col(f"lo_{c}") - F.lit(float(q)), F.lit(0.0), F.lit(float(q)) - F.col(f"hi_{c}")) for c, q in zip(CHANNELS[:dims], query, strict=False)]
    total = gaps[0] * gaps[0]
    for g in gaps[1:]:
        total = total + g * g
    return F.sqrt(total)


def truncated(name: Column, most: int = 20) -> Column:
    """Names longer than `most` keep their beginning and end in three dots."""
    return F.when(F.length(name) > most, F.concat(F.substring(name, 1, most - 3), F.lit("..."))).otherwise(name)


def described() -> Column:
    """An image as a line of text."""
    return F.format_string("Image %d (%s): RGB(%s, %s, %s)", F.col("id"), F.col("filename"), *[F.col(c).cast("string") for c in CHANNELS])
