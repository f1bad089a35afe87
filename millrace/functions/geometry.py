"""Geometry of points, boxes and views as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def normalised(points: DataFrame, group: str, guard: bool = True) -> DataFrame:
    """x, y, z around the group's centroid, over its largest radius; with the guard, a radius of 0 counts as 1."""
    whole = W.partitionBy(group)
    centred = points.withColumns({c: F.col(c) - F.avg(c).over(whole) for c in "xyz"})
    radius = F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).over(whole)
    centred = centred.withColumn("__r", F.when(radius > 0, radius).otherwise(1.0) if guard else radius)
    return centred.withColumns({c: F.try_divide(F.col(c), F.col("__r")) for c in "xyz"}).drop("__r")


def axis_normalised(points: DataFrame, group: str, least: float = 1e-6) -> DataFrame:
    """(x, z, -y) around the middle of the group's box, over its largest side; unscaled if that is below ``least``."""
    whole = W.partitionBy(group)
    turned = points.withColumns({"y": F.col("z"), "z": -F.col("y")})
    low, high = ({c: f(c).over(whole) for c in "xyz"} for f in (F.min, F.max))
    side = F.greatest(*[high[c] - low[c] for c in "xyz"])
    return turned.withColumns({c: F.when(side < least, F.col(c)).otherwise((F.col(c) - (low[c] + high[c]) / 2) / F.when(side < least, 1.0).otherwise(side)) for c in "xyz"})


def scaled(c: Column, low: Column, high: Column) -> Column:
    return (c - low) / (high - low + 1e-6)


def iou_xywh(a: list[Column], b: list[Column]) -> Column:
    """Overlap of boxes (x, y, width, height)."""
    w = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    both = F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))
    return F.coalesce(F.try_divide(both, a[2] * a[3] + b[2] * b[3] - both), F.lit(0.0))


#: The palette that highlights a part, and the grey of points without colour.
HIGHLIGHTS = [(1.0, 0.0, 0.0), (0.0, 1.0, 0.0), (0.0, 0.0, 1.0), (1.0, 1.0, 0.0), (1.0, 0.0, 1.0), (0.0, 1.0, 1.0), (1.0, 0.5, 0.0), (0.5, 0.0, 1.0)]
GREY = 0.7


def highlighted(colour: Column, inside: Column, tint: Column) -> Column:
    """One channel: 0.3 of the colour and 0.7 of the tint inside the part, 0.4 of the colour elsewhere."""
    c = F.coalesce(colour, F.lit(GREY))
    return F.when(inside, 0.3 * c + 0.7 * tint).otherwise(0.4 * c)


def transformed(x: Column, y: Column, z: Column, matrix: list[list[float]]) -> list[Column]:
    """A point under a 4x4 matrix."""
    return [r[0] * x + r[1] * y + r[2] * z + r[3] for r in matrix[:3]]


def look_at(eye: list[Column], target: list[Column]) -> list[Column]:
    """The rows right, up and forward of a camera that looks from ``eye`` to ``target``, with their offsets: twelve columns.

    Seen straight along the vertical axis, right is the x axis.
    """
    dot = lambda a, b: a[0] * b[0] + a[1] * b[1] + a[2] * b[2]
    cross = lambda a, b: [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    forward = [t - e for e, t in zip(eye, target, strict=True)]
    length = F.sqrt(dot(forward, forward))
    forward = [F.when(length < 1e-8, F.lit(d)).otherwise(c / F.greatest(length, F.lit(1e-8))) for c, d in zip(forward, (0.0, 0.0, 1.0), strict=True)]
    right = cross(forward, [F.lit(0.0), F.lit(1.0), F.lit(0.0)])
    length = F.sqrt(dot(right, right))
    right = [F.when(length < 1e-6, F.lit(d)).otherwise(c / F.greatest(length, F.lit(1e-6))) for c, d in zip(right, (1.0, 0.0, 0.0), strict=True)]
    up = cross(right, forward)
    return [c for row in (right, up, forward) for c in (*row, -dot(row, eye))]


def projected(x: Column, y: Column, z: Column, f: float, cx: float, cy: float, width: int, height: int) -> Column:
    """(u, v, depth) of a point in camera space; null behind the camera or outside the image."""
    u, v = f * x / z + cx, f * y / z + cy
    inside = (z > 0) & (u >= 0) & (u < width) & (v >= 0) & (v < height)
    return F.when(inside, F.struct(u.alias("u"), v.alias("v"), F.abs(z).alias("depth")))


def visible(depth: Column, seen: Column, mean: Column, ratio: float = 0.02) -> Column:
    """Whether a point is what the depth map shows at its pixel; a map value of 0 or less is background."""
    return F.coalesce((seen > 0) & (F.abs(depth - seen) < ratio * mean), F.lit(False))


def patch_index(u: Column, v: Column, size: int, across: int, down: int) -> Column:
    """The number of the image patch that holds a pixel, clamped to the grid."""
    clamp = lambda c, n: F.least(F.greatest(F.floor(c / size), F.lit(0)), F.lit(n - 1))
    return clamp(v, down) * across + clamp(u, across)


def view_angles(x: Column, y: Column, z: Column) -> tuple[Column, Column]:
    """(azimuth, elevation) in degrees of a direction, the y axis up."""
    r = F.sqrt(x * x + y * y + z * z)
    return F.pmod(F.degrees(F.atan2(z, x)), F.lit(360.0)), F.degrees(F.asin(F.least(F.greatest(F.coalesce(F.try_divide(y, r), F.lit(0.0)), F.lit(-1.0)), F.lit(1.0))))


def view_point(azimuth: Column, elevation: Column, radius: Column) -> list[Column]:
    """The point at those angles (degrees) and distance."""
    a, e = F.radians(azimuth), F.radians(elevation)
    return [radius * F.cos(e) * F.cos(a), radius * F.sin(e), radius * F.cos(e) * F.sin(a)]


def sphere_views(spark, rings: int, per_ring: int, radius: float = 1.0) -> DataFrame:
    """view, x, y, z of views on rings between the poles, and the poles."""
    grid = spark.range(rings).select(F.col("id").alias("i")).crossJoin(spark.range(per_ring).select(F.col("id").alias("j")))
    phi, theta = math.pi * (F.col("i") + 1) / (rings + 1), 2 * math.pi * F.col("j") / per_ring
    ring = grid.select((F.col("i") * per_ring + F.col("j")).alias("view"), (radius * F.sin(phi) * F.cos(theta)).alias("x"), (radius * F.cos(phi)).alias("y"), (radius * F.sin(phi) * F.sin(theta)).alias("z"))
    poles = spark.range(2).select((F.col("id") + rings * per_ring).alias("view"), F.lit(0.0).alias("x"), F.when(F.col("id") == 0, radius).otherwise(-radius).alias("y"), F.lit(0.0).alias("z"))
    return ring.unionByName(poles)


def tile_grid(width: Column, height: Column, most: int = 12, least: int = 1, side: int = 448) -> Column:
    """(across, down) of the tiles whose shape is nearest the image's.

    Shapes are tried by rising number of tiles; an equally near one replaces the
    best so far if the image has more than half its pixels.
    """
    shapes = sorted({(i, j) for i in range(1, most + 1) for j in range(1, most + 1) if least <= i * j <= most}, key=lambda s: (s[0] * s[1], s))
    table = F.array(*[F.struct(F.lit(i).alias("across"), F.lit(j).alias("down")) for i, j in shapes])
    aspect, area = width / height, width * height

    def step(best: Column, s: Column) -> Column:
        off = F.abs(aspect - s["across"] / s["down"])
        better = (off < best["off"]) | ((off == best["off"]) & (area > 0.5 * side * side * s["across"] * s["down"]))
        return F.when(better, F.struct(off.alias("off"), s["across"].alias("across"), s["down"].alias("down"))).otherwise(best)

    best = F.aggregate(table, F.struct(F.lit(float("inf")).alias("off"), F.lit(1).alias("across"), F.lit(1).alias("down")), step)
    return F.struct(best["across"].alias("across"), best["down"].alias("down"))
