"""Polygons as arrays of struct<x, y>: hull, clipping, area, centre, and the ground that a camera sees.

Everything is a column expression, so polygons of a row stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .pitch import bound

#: Metres around the pitch that count as in view, and the share of the greatest depth nearer to the horizon than which nothing does.
MARGIN, HORIZON = 5.0, 0.02
EPS = 1e-12


def point(x: Column | float, y: Column | float) -> Column:
    of = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("double")
    return F.struct(of(x).alias("x"), of(y).alias("y"))


def cross(a: Column, b: Column, p: Column) -> Column:
    """Twice the signed area of the triangle a, b, p."""
    return (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])


def turned(points: Column) -> Column:
    """The array with its first element moved to the end."""
    return F.concat(F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))


def clipped(points: Column, side: Callable[[Column], Column]) -> Column:
    """The part of a convex polygon where ``side``, a linear function of a point, is not negative."""
    rated = F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), side(p).alias("f")))

    def edge(p: Column, q: Column) -> Column:
        t = p["f"] / F.when(p["f"] == q["f"], 1.0).otherwise(p["f"] - q["f"])
        at = point(p["x"] + (q["x"] - p["x"]) * t, p["y"] + (q["y"] - p["y"]) * t)
        own = point(p["x"], p["y"])
        inside, after = p["f"] >= 0, q["f"] >= 0
        return F.when(inside & after, F.array(own)).when(inside, F.array(own, at)).when(after, F.array(at)).otherwise(F.array().cast("array<struct<x: double, y: double>>"))

    return bound(rated, lambda r: F.flatten(F.zip_with(r, turned(r), edge)))


def clipped_to_side(points: Column, a: Column, b: Column, keep: Column) -> Column:
    """The part of a convex polygon on the side of the line a-b that ``keep`` is on."""
    sign = F.when(cross(a, b, keep) >= 0, 1.0).otherwise(-1.0)
    return clipped(points, lambda p: sign * cross(a, b, p))


def clipped_to_box(points: Column, left: float, top: float, right: float, bottom: float) -> Column:
    """The part of a convex polygon inside a box; empty where fewer than three corners are left."""
    sides = (lambda p: p["y"] - top, lambda p: right - p["x"], lambda p: bottom - p["y"], lambda p: p["x"] - left)
    out = reduce(lambda poly, side: clipped(poly, side), sides, points)
    return bound(out, lambda p: F.when(F.size(p) >= 3, p).otherwise(F.array().cast("array<struct<x: double, y: double>>")))


def hull(points: Column) -> Column:
    """Corners of the convex hull, counter-clockwise from the smallest point; fewer than three different points as they are.

    A point is a corner if it begins an edge that all others lie to the left of, or on.
    """

    def corners(p: Column) -> Column:
        def edge(a: Column, b: Column) -> Column:
            between = lambda c: (c["x"].between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"]))) & (c["y"].between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"])))
            return (a != b) & F.forall(p, lambda c: (cross(a, b, c) > EPS) | ((cross(a, b, c) >= -EPS) & between(c)))

        first = F.get(p, F.lit(0))
        kept = F.filter(p, lambda a: F.exists(p, lambda b: edge(a, b)))
        turn = F.transform(kept, lambda q: F.struct(F.when(q == first, -10.0).otherwise(F.atan2(q["y"] - first["y"], q["x"] - first["x"])).alias("turn"), q["x"].alias("x"), q["y"].alias("y")))
        ordered = F.transform(F.array_sort(turn), lambda q: point(q["x"], q["y"]))
        return F.when(F.size(p) < 3, p).otherwise(ordered)

    return bound(F.sort_array(F.array_distinct(F.transform(points, lambda p: point(p["x"], p["y"])))), corners)


def area(points: Column) -> Column:
    return F.abs(F.aggregate(F.zip_with(points, turned(points), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"]), F.lit(0.0), lambda s, v: s + v)) / 2


def centroid(points: Column) -> Column:
    """Mean of the corners; null without any."""
    mean = lambda c: F.aggregate(points, F.lit(0.0), lambda s, p: s + p[c]) / F.size(points)
    return F.when(F.size(points) > 0, point(mean("x"), mean("y")))


def inside(points: Column, p: Column) -> Column:
    """Even-odd test of a point."""
    crossing = lambda a, b: (a["y"] > p["y"]) != (b["y"] > p["y"])
    left = lambda a, b: p["x"] < (b["x"] - a["x"]) * (p["y"] - a["y"]) / F.when(a["y"] == b["y"], 1.0).otherwise(b["y"] - a["y"]) + a["x"]
    return F.size(F.filter(F.zip_with(points, turned(points), lambda a, b: crossing(a, b) & left(a, b)), lambda hit: hit)) % 2 == 1


def distance(points: Column, p: Column) -> Column:
    """Distance of a point to the nearest edge, negative inside."""

    def to_edge(a: Column, b: Column) -> Column:
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        long = dx * dx + dy * dy
        t = F.when(long > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((p["x"] - a["x"]) * dx + (p["y"] - a["y"]) * dy) / F.when(long > 0, long).otherwise(1.0)))).otherwise(0.0)
        return F.hypot(p["x"] - a["x"] - t * dx, p["y"] - a["y"] - t * dy)

    near = F.array_min(F.zip_with(points, turned(points), to_edge))
    return F.when(inside(points, p), -near).otherwise(near)


def inverse(h: Column) -> Column:
    """The inverse of a row-major 3x3 matrix, null where there is none."""
    g = lambda k: F.get(h, F.lit(k))
    minor = lambda a, b, c, d: g(a) * g(d) - g(b) * g(c)
    adjugate = [minor(4, 5, 7, 8), minor(2, 1, 8, 7), minor(1, 2, 4, 5), minor(5, 3, 8, 6), minor(0, 2, 6, 8), minor(2, 0, 5, 3), minor(3, 4, 6, 7), minor(1, 0, 7, 6), minor(0, 1, 3, 4)]
    det = g(0) * adjugate[0] + g(1) * adjugate[3] + g(2) * adjugate[6]
    return F.when(F.abs(det) > 0, bound(det, lambda d: F.array(*(a / d for a in adjugate))))


def view(h: Column, width: float, height: float, length: float = 105.0, breadth: float = 68.0) -> Column:
    """The part of the pitch, and of MARGIN metres around it, that a picture shows, in shares of the pitch; null where it shows no ground.

    ``h`` maps metres to pixels, oriented.  The picture is cut a little in front of the horizon, brought to the
    ground, and clipped.
    """

    def seen(m: Column) -> Column:
        g = lambda k: F.get(m, F.lit(k))
        depth = lambda p: g(6) * p["x"] + g(7) * p["y"] + g(8)
        corners = F.array(point(0.0, 0.0), point(width, 0.0), point(width, height), point(0.0, height))
        depths = F.transform(corners, depth)
        top, low = F.array_max(depths), F.array_min(depths)
        shown = F.when(low <= 0, clipped(corners, lambda p: depth(p) - HORIZON * top)).otherwise(corners)
        ground = F.transform(shown, lambda p: point((g(0) * p["x"] + g(1) * p["y"] + g(2)) / depth(p), (g(3) * p["x"] + g(4) * p["y"] + g(5)) / depth(p)))
        cut = clipped_to_box(ground, -MARGIN, -MARGIN, length + MARGIN, breadth + MARGIN)
        shares = F.transform(cut, lambda p: point(F.round(p["x"] / length, 4), F.round(p["y"] / breadth, 4)))
        return F.when(top > 0, bound(shares, lambda s: F.when(F.size(s) >= 3, s)))

    return bound(inverse(h), lambda m: F.when(m.isNotNull(), seen(m)))
