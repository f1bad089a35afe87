"""Views of point sets: splatted masks of their parts, how well parts are told apart, and the choice of views."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import kernels, raster
from . import groups

KEY = ["object_id", "view"]
PIXEL = [*KEY, "row", "col"]
#: Points of a task, which become many rows: one for each view, and its disc's pixels for each of those.
POINTS = 1 << 13


def cameras(views: DataFrame) -> DataFrame:
    """object_id, view and ``__m``, the twelve numbers of ``geometry.look_at`` from each view's place to the origin, step by step so that each is worked out once."""
    eye, ahead, right = [F.col(c) for c in "xyz"], [F.col(f"__a{k}") for k in range(3)], [F.col(f"__r{k}") for k in range(3)]
    length = lambda v: F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    off = lambda v: -(v[0] * eye[0] + v[1] * eye[1] + v[2] * eye[2])
    rows = views.withColumn("__l", length(eye))
    rows = rows.withColumns({f"__a{k}": F.when(F.col("__l") < 1e-8, F.lit(d)).otherwise(-eye[k] / F.col("__l")) for k, d in enumerate((0.0, 0.0, 1.0))})
    rows = rows.withColumn("__l", length([-ahead[2], F.lit(0.0), ahead[0]]))
    flat = F.col("__l") < 1e-6
    rows = rows.withColumns({"__r0": F.when(flat, 1.0).otherwise(-ahead[2] / F.col("__l")), "__r1": F.lit(0.0), "__r2": F.when(flat, 0.0).otherwise(ahead[0] / F.col("__l"))})
    up = [right[1] * ahead[2] - right[2] * ahead[1], right[2] * ahead[0] - right[0] * ahead[2], right[0] * ahead[1] - right[1] * ahead[0]]
    rows = rows.withColumns({f"__u{k}": c for k, c in enumerate(up)})
    up = [F.col(f"__u{k}") for k in range(3)]
    return rows.select("object_id", "view", F.array(*right, off(right), *up, off(up), *ahead, off(ahead)).alias("__m"))


def placed(points: DataFrame, views: DataFrame, focal: float, size: int) -> DataFrame:
    """The points (object_id, point_id, part, x, y, z, weight) of each object in each of its views (object_id, view, x, y, z): with ``row``, ``col``, ``depth``, null outside the image.

    A camera stands at the view's place and looks at the origin; ``focal`` is in
    pixels, the image is a square of ``size`` pixels.  Points are counted and
    objects dealt out first, so a task's rows do not grow with the table.
    """
    tasks = max(points.sparkSession.sparkContext.defaultParallelism, math.ceil(points.count() / POINTS))
    # Given a number, partitions are not put together for being small before they grow.
    points, camera = points.repartition(tasks, "object_id"), cameras(views).repartition(tasks, "object_id")
    m = [F.col("__m")[k] for k in range(12)]
    at = [m[4 * k] * F.col("x") + m[4 * k + 1] * F.col("y") + m[4 * k + 2] * F.col("z") + m[4 * k + 3] for k in range(3)]
    seen = points.join(camera, "object_id").withColumns(dict(zip(("__right", "__up", "__ahead"), at, strict=True)))
    hit = G.projected(F.col("__right"), F.col("__up"), F.col("__ahead"), focal, size / 2, size / 2, size, size)
    return seen.withColumn("__hit", hit).select(
        *KEY, "point_id", "part", "weight", F.floor(F.col("__hit.v")).cast("int").alias("row"), F.floor(F.col("__hit.u")).cast("int").alias("col"), F.col("__hit.depth").alias("depth")
    )


def discs(rows: DataFrame, radius: int, size: int) -> DataFrame:
    """Each row for every pixel of the image that is within ``radius`` of its own."""
    around = [(y, x) for y in range(-radius, radius + 1) for x in range(-radius, radius + 1) if y * y + x * x <= radius * radius]
    steps = F.array(*[F.struct(F.lit(y).alias("y"), F.lit(x).alias("x")) for y, x in around])
    near = rows.select("*", F.explode(steps).alias("__step")).withColumns({"row": F.col("row") + F.col("__step.y"), "col": F.col("col") + F.col("__step.x")}).drop("__step")
    return near.filter(F.col("row").between(0, size - 1) & F.col("col").between(0, size - 1))


def depth_map(seen: DataFrame, radius: int, size: int) -> DataFrame:
    """``near``, the nearest depth of the discs of all points, by pixel. Discs are reduced to pixels before they are exchanged."""
    return discs(seen.filter("depth is not null").select(*PIXEL, "depth"), radius, size).groupBy(*PIXEL).agg(F.min("depth").alias("near"))


def visible_points(seen: DataFrame, radius: int, size: int, ratio: float = 0.02) -> DataFrame:
    """``seen`` with ``visible``: whether a point is within ``ratio`` of its depth of what is nearest at its pixel."""
    near = depth_map(seen, radius, size)
    hit = F.col("depth") - F.col("near") <= ratio * F.col("depth")
    return seen.join(near, PIXEL, "left").withColumn("visible", F.coalesce(hit, F.lit(False))).drop("near")


def part_pixels(visible: DataFrame, radius: int, size: int) -> DataFrame:
    """object_id, view, part, row, col: the pixels of each part's mask, discs around its visible points."""
    rows = visible.filter("visible").select(*KEY, "part", "row", "col").distinct()
    return discs(rows, radius, size).distinct()


def part_pairs(points: DataFrame) -> DataFrame:
    """object_id, a, b, confusion of the pairs of an object's parts: 1 for the nearest centres, 0 for the farthest, 0.5 if all are as far."""
    centre = points.groupBy("object_id", "part").agg(*[F.avg(c).alias(c) for c in "xyz"])
    a, b = (centre.select("object_id", F.col("part").alias(p), *[F.col(c).alias(p + c) for c in "xyz"]) for p in "ab")
    far = F.sqrt(sum(((F.col(f"a{c}") - F.col(f"b{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    pairs = a.join(b, "object_id").filter("a < b").select("object_id", "a", "b", far.alias("far"))
    return groups.min_max(pairs, ["object_id"], "far", "share", 0.5).select("object_id", "a", "b", (1 - F.col("share")).alias("confusion"))


def view_candidates(visible: DataFrame, pairs: DataFrame, radius: int, size: int, close: int = 0, blur: int = 0, over: float = 50 / 255, least: int = raster.LEAST_PIXELS) -> DataFrame:
    """One row for each view of an object: ``overall`` (share of points seen), ``shown`` (part, share of its weight that is seen), ``apart`` (a, b, separation, weight), ``separation``, ``connectivity``.

    ``pairs`` has the weight of each pair of parts (``confusion``); pairs without
    one have 0.5.  Shares are sums by part.  Separations need the masks of a
    view: its pixels, at most the image for each part, are one group, closed by
    a square of ``close`` pixels and blurred over ``blur`` if those are not 0.
    Views that show nothing have no mask: their pairs count as touching.
    """
    part = visible.groupBy(*KEY, "part").agg(F.sum(F.when(F.col("visible"), F.col("weight")).otherwise(0.0)).alias("hit"), F.sum("weight").alias("total"), F.sum(F.col("visible").cast("int")).alias("n_hit"), F.count(F.lit(1)).alias("n"))
    share = F.coalesce(F.try_divide("hit", "total"), F.lit(0.0))
    shown = part.groupBy(*KEY).agg((F.sum("n_hit") / F.sum("n")).alias("overall"), F.sort_array(F.collect_list(F.struct("part", share.alias("share")))).alias("shown"))

    def score(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        parts = sorted(int(p["part"]) for p in pdf["shown"].iloc[0])
        masks = {p: np.zeros((size, size), bool) for p in parts}
        for p, rows in pdf[pdf["row"] >= 0].groupby("part"):
            m = masks[int(p)]
            m[rows["row"].to_numpy(int), rows["col"].to_numpy(int)] = True
            m = raster.closed(m, close) if close else m
            masks[int(p)] = raster.blurred(m, blur, over) if blur else m
        weights = {(int(w["a"]), int(w["b"])): float(w["confusion"]) for w in pdf["weights"].iloc[0]}
        apart = [(a, b, raster.separation(masks[a], masks[b], least), weights.get((a, b), 0.5)) for i, a in enumerate(parts) for b in parts[i + 1 :]]
        total = sum(w for *_, w in apart)
        whole = np.any(list(masks.values()), axis=0)
        mean = sum(s * w for _, _, s, w in apart) / total if total > 1e-9 else 0.0
        rows = [dict(zip(("a", "b", "separation", "weight"), x, strict=True)) for x in apart]
        return pd.DataFrame([(*key, float(pdf["overall"].iloc[0]), list(pdf["shown"].iloc[0]), rows, mean, kernels.mask_connectivity(whole))], columns=[*KEY, "overall", "shown", "apart", "separation", "connectivity"])

    weights = pairs.groupBy("object_id").agg(F.collect_list(F.struct("a", "b", "confusion")).alias("weights"))
    head = shown.join(weights, "object_id", "left").withColumn("weights", F.coalesce("weights", F.array().cast(weights.schema["weights"].dataType)))
    pixels = part_pixels(visible, radius, size)
    rows = head.select(*KEY, "overall", "shown", "weights", F.lit(-1).cast("long").alias("part"), F.lit(-1).alias("row"), F.lit(-1).alias("col"))
    rows = rows.unionByName(pixels.withColumn("part", F.col("part").cast("long")), allowMissingColumns=True)
    kind = f"object_id {rows.schema['object_id'].dataType.simpleString()}, view {rows.schema['view'].dataType.simpleString()}"
    both = "overall double, shown array<struct<part:bigint,share:double>>, apart array<struct<a:bigint,b:bigint,separation:double,weight:double>>, separation double, connectivity double"
    # The row with what is known of the view comes first.
    return rows.groupBy(*KEY).applyInPandas(lambda key, pdf: score(key, pdf.sort_values("row", kind="stable")), f"{kind}, {both}")


def chosen_views(candidates: DataFrame, views: DataFrame, difficulty: DataFrame, n: int) -> DataFrame:
    """object_id, view, rank, gain: at most ``n`` views of each object by what they add, until too little is gained.

    ``candidates`` are those of ``view_candidates``, ``views`` has their places,
    ``difficulty`` (object_id, part, weight) how much a part counts, 1 where it
    is not given.  An object's candidates, one row a view, are one group.
    """
    weights = difficulty.groupBy("object_id").agg(F.collect_list(F.struct("part", "weight")).alias("weights"))
    rows = candidates.join(views.select(*KEY, F.array("x", "y", "z").alias("at")), KEY).join(weights, "object_id", "left").select(*KEY, "overall", "shown", "apart", "at", "weights")

    def choose(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("view")
        parts = sorted({int(p["part"]) for row in pdf["shown"] for p in row})
        number = {p: k for k, p in enumerate(parts)}
        given = {int(w["part"]): float(w["weight"]) for w in (pdf["weights"].iloc[0] if pdf["weights"].iloc[0] is not None else [])}
        shown = np.zeros((len(pdf), len(parts)))
        for k, row in enumerate(pdf["shown"]):
            for p in row:
                shown[k, number[int(p["part"])]] = p["share"]
        pairs = [[(number[int(p["a"])], number[int(p["b"])], p["separation"], p["weight"]) for p in row] for row in pdf["apart"]]
        fixed = np.array([raster.fixed_gain(s, p, o) for s, p, o in zip(shown, pairs, pdf["overall"], strict=True)])
        at = np.stack(pdf["at"].to_numpy()).astype(float)
        at /= np.maximum(np.linalg.norm(at, axis=1, keepdims=True), 1e-9)
        got = raster.lazy_views(shown, np.array([given.get(p, 1.0) for p in parts]), fixed, at, n)
        return pd.DataFrame([(*key, pdf["view"].iloc[i], k + 1, gain) for k, (i, gain) in enumerate(got)], columns=["object_id", "view", "rank", "gain"])

    kind = {c: rows.schema[c].dataType.simpleString() for c in KEY}
    return rows.groupBy("object_id").applyInPandas(choose, f"object_id {kind['object_id']}, view {kind['view']}, rank long, gain double")
