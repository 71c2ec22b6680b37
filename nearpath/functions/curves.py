"""Column functions over the points of one trajectory (``pts``: array of structs x, y)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def bounding_box(pts: Column) -> Column:
    xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_max(xs).alias("max_x"), F.array_min(ys).alias("min_y"), F.array_max(ys).alias("max_y"))


def polar(x: Column, y: Column) -> Column:
    return F.struct(F.hypot(x, y).alias("r"), F.atan2(y, x).alias("theta"))


def segment(pts: Column, i: Column) -> Column:
    return F.struct(F.get(pts, i).alias("start"), F.get(pts, i + 1).alias("end"))


def append_point(pts: Column, x: Column, y: Column) -> Column:
    return F.array_append(pts, F.struct(x.alias("x"), y.alias("y")))


def squared_distance(a: Column, b: Column) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return dx * dx + dy * dy


def half_away(v: Column) -> Column:
    """Nearest integer, halves away from zero."""
    return (F.signum(v) * F.floor(F.abs(v) + 0.5)).cast("long")


def snap(pts: Column, delta: float, shift_x, shift_y) -> Column:
    """Grid cells of the shifted points; shifts are numbers or arrays with one entry a point."""
    at = lambda s, i: F.get(s, i) if isinstance(s, Column) else F.lit(s)
    return F.transform(pts, lambda p, i: F.struct(half_away((p["x"] + at(shift_x, i)) / delta).alias("x"), half_away((p["y"] + at(shift_y, i)) / delta).alias("y")))


def drop_repeats(cells: Column) -> Column:
    """Cells that differ from the one before."""
    return let(cells, lambda cs: F.filter(cs, lambda c, i: (i == 0) | ~c.eqNullSafe(F.get(cs, i - 1))))


def longest_step(pts: Column, km: float = 111.32) -> Column:
    """Longest planar step in km; null for fewer than two points."""
    following = F.slice(pts, 2, F.greatest(F.size(pts) - 1, F.lit(0)))
    steps = F.zip_with(following, F.slice(pts, 1, F.greatest(F.size(pts) - 1, F.lit(0))), lambda b, a: F.sqrt(squared_distance(a, b)) * km)
    return F.array_max(steps)


def ends_apart(a: Column, b: Column) -> Column:
    """Lower bound of the discrete Fréchet distance: the larger distance of the two pairs of end points."""
    first = squared_distance(F.get(a, 0), F.get(b, 0))
    last = squared_distance(F.element_at(a, -1), F.element_at(b, -1))
    return F.sqrt(F.greatest(first, last))
