"""Colour spaces beside RGB, as column expressions, and what a ball in them means for the channels.

A search in such a space is one over three other coordinates, so joins and k nearest work on mapped() rows as they are. A search for one query also needs bounds on r, g and b, which a scan can use: the
ball's box in the space is turned back into intervals of the channels, through the steps of the conversion, each monotone or linear. Bounds may be wide, and never too narrow; the distance settles the rest.

Channels are taken as they are, outside the domain too. Null and NaN channels give null or NaN coordinates, which match nothing.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from huespan.functions import colour

Triple = tuple[float, float, float]
Interval = tuple[float, float]

# sRGB to XYZ under D65 and its white point, the curve of sRGB, the curve of CIE L*a*b*, and YUV of BT.601.
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)
GAMMA, GAMMA_OFFSET, GAMMA_SLOPE, GAMMA_KNEE = 2.4, 0.055, 12.92, 0.04045
DELTA = 6 / 29
YUV = ((0.299, 0.587, 0.114), (-0.14713, -0.28886, 0.436), (0.615, -0.51499, -0.10001))


def inverse(m: tuple[Triple, ...]) -> tuple[Triple, ...]:
    """Of a 3 by 3 matrix, by cofactors."""
    (a, b, c), (d, e, f), (g, h, i) = m
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    rows = ((e * i - f * h, c * h - b * i, b * f - c * e), (f * g - d * i, a * i - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d))
    return tuple(tuple(v / det for v in r) for r in rows)


def _product(m: tuple[Triple, ...], v: list) -> list:
    return [r[0] * v[0] + r[1] * v[1] + r[2] * v[2] for r in m]


def _interval_product(m: tuple[Triple, ...], v: list[Interval]) -> list[Interval]:
    """What a linear map makes of a box, an interval a coordinate."""
    ends = [[(min(c * lo, c * hi), max(c * lo, c * hi)) for c, (lo, hi) in zip(r, v, strict=True)] for r in m]
    return [(sum(lo for lo, _ in e), sum(hi for _, hi in e)) for e in ends]


def _of(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is computed once however often body names it, and wherever the optimizer moves the whole."""
    return F.element_at(F.transform(F.array(value), body), 1)


@dataclass(frozen=True)
class Space:
    """Coordinates of columns (as an array) and of a point, and the channels' intervals that hold a box of the space."""

    name: str
    columns: Callable[[Column, Column, Column], Column]
    point: Callable[[float, float, float], Triple]
    channels: Callable[[list[Interval]], list[Interval]]


def _lab_columns(r: Column, g: Column, b: Column) -> Column:
    linear = lambda v: F.when(v / 255.0 <= GAMMA_KNEE, v / 255.0 / GAMMA_SLOPE).otherwise(F.pow((v / 255.0 + GAMMA_OFFSET) / (1 + GAMMA_OFFSET), F.lit(GAMMA)))
    curve = lambda t: F.when(t > DELTA**3, F.cbrt(t)).otherwise(t / (3 * DELTA * DELTA) + 4 / 29)
    light = _of(F.transform(F.array(r, g, b), linear), lambda v: F.array(*[x / w for x, w in zip(_product(XYZ, [v[k] for k in range(3)]), WHITE, strict=True)]))
    return _of(F.transform(light, curve), lambda f: F.array(f[1] * 116.0 - 16.0, (f[0] - f[1]) * 500.0, (f[1] - f[2]) * 200.0))


def _lab_point(r: float, g: float, b: float) -> Triple:
    linear = lambda v: v / 255 / GAMMA_SLOPE if v / 255 <= GAMMA_KNEE else ((v / 255 + GAMMA_OFFSET) / (1 + GAMMA_OFFSET)) ** GAMMA
    curve = lambda t: math.cbrt(t) if t > DELTA**3 else t / (3 * DELTA * DELTA) + 4 / 29
    x, y, z = [curve(v / w) for v, w in zip(_product(XYZ, [linear(v) for v in (r, g, b)]), WHITE, strict=True)]
    return y * 116 - 16, (x - y) * 500, (y - z) * 200


def _lab_channels(box: list[Interval]) -> list[Interval]:
    back = lambda f: f**3 if f > DELTA else 3 * DELTA * DELTA * (f - 4 / 29)
    # Beyond the knee as a straight line, below it as the straight part goes: both rise.
    shown = lambda c: 255 * (GAMMA_SLOPE * c if c <= GAMMA_KNEE / GAMMA_SLOPE else (1 + GAMMA_OFFSET) * c ** (1 / GAMMA) - GAMMA_OFFSET)
    y = tuple((v + 16) / 116 for v in box[0])
    x = (y[0] + box[1][0] / 500, y[1] + box[1][1] / 500)
    z = (y[0] - box[2][1] / 200, y[1] - box[2][0] / 200)
    light = [tuple(back(v) * w for v in f) for f, w in zip((x, y, z), WHITE, strict=True)]
    return [(shown(lo), shown(hi)) for lo, hi in _interval_product(inverse(XYZ), light)]


def _yuv_columns(r: Column, g: Column, b: Column) -> Column:
    return F.array(*_product(YUV, [r, g, b]))


def _yuv_point(r: float, g: float, b: float) -> Triple:
    return tuple(_product(YUV, [r, g, b]))


def _yuv_channels(box: list[Interval]) -> list[Interval]:
    return _interval_product(inverse(YUV), box)


def _hsv_columns(r: Column, g: Column, b: Column) -> Column:
    high, chroma = F.greatest(r, g, b), F.greatest(r, g, b) - F.least(r, g, b)
    sector = F.when(high == r, F.pmod((g - b) / chroma, F.lit(6.0))).when(high == g, (b - r) / chroma + 2.0).otherwise((r - g) / chroma + 4.0)
    turn = F.when(chroma > 0, sector * (math.pi / 3)).otherwise(F.lit(0.0))
    return _of(F.array(chroma, turn, high), lambda v: F.array(v[0] * F.cos(v[1]), v[0] * F.sin(v[1]), v[2]))


def _hsv_point(r: float, g: float, b: float) -> Triple:
    high, chroma = max(r, g, b), max(r, g, b) - min(r, g, b)
    sector = 0.0 if chroma <= 0 else (g - b) / chroma % 6 if high == r else (b - r) / chroma + 2 if high == g else (r - g) / chroma + 4
    return chroma * math.cos(sector * math.pi / 3), chroma * math.sin(sector * math.pi / 3), high


def _hsv_channels(box: list[Interval]) -> list[Interval]:
    """The value is the largest channel, and the least one lies below it by the chroma, the distance from the axis."""
    most = math.hypot(*[max(abs(lo), abs(hi)) for lo, hi in box[:2]])
    return [(box[2][0] - most, box[2][1])] * 3


#: hsv is the cone: chroma in the direction of the hue, and the value, all on the scale of the channels.
SPACES = {s.name: s for s in (Space("lab", _lab_columns, _lab_point, _lab_channels), Space("yuv", _yuv_columns, _yuv_point, _yuv_channels), Space("hsv", _hsv_columns, _hsv_point, _hsv_channels))}


def mapped(rows: DataFrame, space: str, prefix: str = "") -> DataFrame:
    """The rows with the three channels (prefix q: those of queries) replaced by coordinates of the space."""
    names, at = [f"{prefix}{c}" for c in colour.CHANNELS], "coordinates"
    while at in rows.columns:
        at += "_"
    placed = rows.withColumn(at, SPACES[space].columns(*[F.col(n) for n in names]))
    return placed.withColumns({n: F.col(at)[k] for k, n in enumerate(names)}).drop(at)


def channel_bounds(query: Triple, threshold: float, space: str) -> list[Interval]:
    """Intervals of r, g and b that hold every colour within the threshold, a little wider for rounding."""
    at = SPACES[space].point(*query)
    reach = max(threshold, 0.0) * (1 + 1e-9) + 1e-9
    return [(lo - 1e-6 * (1 + abs(lo)), hi + 1e-6 * (1 + abs(hi))) for lo, hi in SPACES[space].channels([(v - reach, v + reach) for v in at])]


def distance(query: Triple, space: str) -> Column:
    """Euclidean distance of r, g, b to the query, both in the space."""
    point = SPACES[space].point(*query)
    square = lambda v: sum(((v[k] - float(point[k])) * (v[k] - float(point[k])) for k in (1, 2)), (v[0] - float(point[0])) * (v[0] - float(point[0])))
    return F.sqrt(_of(SPACES[space].columns(*[F.col(c) for c in colour.CHANNELS]), square))


def hits(images: DataFrame, query: Triple, threshold: float, space: str = "lab") -> DataFrame:
    """Rows within the threshold in the space, with that distance; the scan gets plain bounds of the channels."""
    lows, highs = zip(*channel_bounds(query, threshold, space), strict=True)
    near = images.where(colour.box_contains(lows, highs))
    return near.withColumn("distance", distance(query, space)).where(F.col("distance") <= float(threshold))
