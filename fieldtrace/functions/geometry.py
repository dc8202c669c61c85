"""Planar geometry as column expressions over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def projected(h: Column | list[Column], x: Column, y: Column) -> tuple[Column, Column]:
    """A row-major 3x3 homography (an array of 9, or nine columns) applied to a point; null on the horizon."""
    at = lambda k: h[k] if isinstance(h, list) else F.get(h, k)
    w = at(6) * x + at(7) * y + at(8)
    return F.try_divide(at(0) * x + at(1) * y + at(2), w), F.try_divide(at(3) * x + at(4) * y + at(5), w)


def inside_polygon(points: list[tuple[int, int]], x: Column, y: Column) -> Column:
    """Even-odd test against a fixed polygon, in integers."""
    crossings = F.lit(0)
    for (x0, y0), (x1, y1) in zip(points, points[1:] + points[:1], strict=True):
        if y0 == y1:
            continue
        straddles = (F.lit(y0) > y) != (F.lit(y1) > y)
        # x < x0 + (y - y0) * (x1 - x0) / (y1 - y0), without division
        side = (x - x0) * (y1 - y0) - (y - y0) * (x1 - x0)
        crossings = crossings + F.when(straddles & (side < 0 if y1 > y0 else side > 0), 1).otherwise(0)
    return crossings % 2 == 1


def segment_square(a: tuple[int, int], b: tuple[int, int], x: Column, y: Column) -> Column:
    """Squared distance of a point to a segment."""
    dx, dy = b[0] - a[0], b[1] - a[1]
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - a[0]) * dx + (y - a[1]) * dy) / F.lit(float(dx * dx + dy * dy))))
    ex, ey = x - a[0] - t * dx, y - a[1] - t * dy
    return ex * ex + ey * ey


def signed_distance(points: list[tuple[int, int]], x: Column, y: Column) -> Column:
    """Distance to the nearest edge of a polygon, negative inside."""
    near = F.least(*(segment_square(a, b, x, y) for a, b in zip(points, points[1:] + points[:1], strict=True)))
    return F.when(inside_polygon(points, x, y), -F.sqrt(near)).otherwise(F.sqrt(near))


def view_class(distance: Column, sigma: Column) -> Column:
    """Where someone unobserved is: C certainly in view, so concealed, S certainly off the screen, U unknown, by the larger of sigma and 1.

    Unknown too without a distance, as without a view or an estimate.
    """
    s = F.greatest(F.lit(1.0), sigma)
    return F.when(distance <= -s, "C").when(distance >= s, "S").otherwise("U")
