"""Vector and scalar expressions, all of them native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))


def l2_normalize(v: Column, eps: float = 1e-8) -> Column:
    """v / (|v| + eps) in double."""
    return F.get(F.transform(F.array(doubles(v)), lambda d: F.get(F.transform(F.array(norm(d)), lambda n: F.transform(d, lambda x: x / (n + eps))), 0)), 0)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    return F.lit(1.0) - dot(a, b)


def component_aggregate(v: Column, how: str) -> Column:
    """A scalar saliency of a component vector: first, l2, mean_abs or max_abs."""
    ways = {"first": lambda: v[0], "l2": lambda: norm(v), "mean_abs": lambda: F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x)) / F.size(v), "max_abs": lambda: F.array_max(F.transform(v, F.abs))}
    if how not in ways:
        raise ValueError(f"unknown aggregate: {how}")
    return ways[how]()


def patch_geometry(h: Column, w: Column, edge: int, patch: int) -> dict[str, Column]:
    """Size after the short edge is scaled to `edge` (truncated), cropped to whole patches, and the patch grid."""
    short = F.least(h, w)
    scaled = lambda x: F.floor(x * edge / short).cast("int")
    return {"resized_h": scaled(h), "resized_w": scaled(w), "grid_h": F.floor(scaled(h) / patch).cast("int"), "grid_w": F.floor(scaled(w) / patch).cast("int")}


def rotated(y: Column, x: Column, angle: Column, centre: float) -> tuple[Column, Column]:
    """Coordinates after a rotation about (centre, centre) by an angle in degrees."""
    a = F.radians(angle)
    dy, dx = y - centre, x - centre
    return centre - dx * F.sin(a) + dy * F.cos(a), centre + dx * F.cos(a) + dy * F.sin(a)
