"""The nearest neighbours inside objects of any size: blocks of near points, and questions to the blocks around."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import groups
from .lineage import cut_lineage

AXES = ("x", "y", "z")
#: Points of a block.
BLOCK = 1024
#: Questions to a block that one call answers, on average.
ASKS = 1 << 15
#: Distances between points that are held at once.
PAIRS = 1 << 21
#: Cells along an axis, as a power of two, of the curve that puts points in order.
BITS = 20
#: Boxes that a box of the level above holds.
FAN = 16


def among(ids: np.ndarray, at: np.ndarray, others: np.ndarray, there: np.ndarray, k: int, itself: bool = True, most: np.ndarray | None = None, pairs: int = PAIRS) -> Iterator[tuple[np.ndarray, ...]]:
    """(asking row, other row, squared distance, rank) of the ``k`` nearest, ties by id, rows of about ``pairs`` distances at a time; ``most`` bounds the squared distance of each row."""
    step = max(1, pairs // max(1, len(others)))
    for lo in range(0, len(ids), step):
        d2 = np.zeros((len(ids[lo : lo + step]), len(others)))
        for c in range(3):
            d2 += (at[lo : lo + step, c, None] - there[None, :, c]) ** 2
        if not itself:
            d2[ids[lo : lo + step, None] == others[None, :]] = np.inf
        last = min(k, len(others)) - 1
        limit = np.partition(d2, last, axis=1)[:, last]
        if most is not None:
            limit = np.minimum(limit, most[lo : lo + step])
        i, j = np.nonzero((d2 <= limit[:, None]) & np.isfinite(d2))
        order = np.lexsort((others[j], d2[i, j], i))
        i, j = i[order], j[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
        near = rank <= k
        i, j = i[near], j[near]
        yield lo + i, j, d2[i, j], rank[near]


def _squares(gaps: list[Column]) -> Column:
    """The sum of squares in the order of the axes, so that it is never above the distance that a task finds for a point inside the box."""
    return gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2]


def _outside(lo: Column, hi: Column, low: Column, high: Column) -> Column:
    """How far the span from ``lo`` to ``hi`` is from that from ``low`` to ``high``."""
    return F.greatest(F.lit(0.0), low - hi, lo - high)


def _along_curve(points: DataFrame, key: str) -> DataFrame:
    """``points`` with ``key``: the bits of the cell numbers of the three axes in turn, so that near points mostly have near keys."""
    box = points.groupBy("g").agg(*[F.min(c).alias(f"lo{c}") for c in AXES], F.greatest(*[F.max(c) - F.min(c) for c in AXES]).alias("extent"))
    last = (1 << BITS) - 1
    cell = {f"c{c}": F.least(F.floor((F.col(c) - F.col(f"lo{c}")) / F.when(F.col("extent") > 0, F.col("extent")).otherwise(1.0) * last), F.lit(last)).cast("long") for c in AXES}
    bits = [F.shiftleft(F.shiftright(f"c{c}", b).bitwiseAND(1), 3 * b + k) for k, c in enumerate(AXES) for b in range(BITS)]
    return points.join(box, "g").withColumns(cell).withColumn(key, sum(bits[1:], bits[0])).select(*points.columns, key)


def _near_blocks(boxes: DataFrame) -> DataFrame:
    """(g, block, target, lo and hi of the target): blocks that may hold a near point of a block's points.

    Boxes are joined from the top of a tree down, level by level, and only pairs
    that are near enough have their children joined.
    """
    levels, top = [boxes], boxes.agg(F.max("block")).first()[0] or 0
    while top:
        up = levels[-1].groupBy("g", F.floor(F.col("block") / FAN).alias("block")).agg(*[F.min(f"lo{c}").alias(f"lo{c}") for c in AXES], *[F.max(f"hi{c}").alias(f"hi{c}") for c in AXES], F.max("reach").alias("reach"))
        levels.append(up)
        top //= FAN
    pairs = levels[-1].select("g", "block", F.col("block").alias("target"))
    for level in reversed(levels[:-1]):
        asking = level.select("g", F.col("block").alias("a"), F.floor(F.col("block") / FAN).alias("block"), "reach", *[F.col(f"{e}{c}").alias(f"{e}{c}a") for e in ("lo", "hi") for c in AXES])
        asked = level.select("g", F.col("block").alias("b"), F.floor(F.col("block") / FAN).alias("target"), *[F.col(f"{e}{c}").alias(f"{e}{c}b") for e in ("lo", "hi") for c in AXES])
        gap = _squares([_outside(*[F.col(f"{e}{c}{s}") for s in "ab" for e in ("lo", "hi")]) for c in AXES])
        pairs = pairs.join(asking, ["g", "block"]).join(asked, ["g", "target"]).filter(gap <= F.col("reach"))
        pairs = cut_lineage(pairs.select("g", F.col("a").alias("block"), F.col("b").alias("target")))
    ends = boxes.select("g", F.col("block").alias("target"), *[f"{e}{c}" for e in ("lo", "hi") for c in AXES])
    return pairs.filter("block <> target").join(ends, ["g", "target"])


def in_blocks(points: DataFrame, k: int, itself: bool, size: int = BLOCK) -> DataFrame:
    """g, index, neighbour, distance2, rank for points (g, index, x, y, z) of objects of any size.

    Points in the order of a space-filling curve are cut into blocks of ``size``,
    so crowded places have small blocks.  Each block finds the nearest inside,
    which bounds how far a nearer point can be; a point then asks only blocks
    whose boxes are within that, and the best of all answers count.  Blocks
    that many ask are copied for slices of the questions.  Of points in one
    place only the first ``k + 1`` can be near anything, so the others take
    their neighbours from those.
    """
    place = W.partitionBy("g", *AXES).orderBy("index")
    first = cut_lineage(points.withColumn("at", F.row_number().over(place)).filter(F.col("at") <= k + 1))
    ordered = groups.numbered(_along_curve(first.drop("at"), "key"), ["g"], [F.col("key"), F.col("index")], "number")
    dealt = ordered.select("g", F.floor((F.col("number") - 1) / size).alias("block"), "index", *AXES)

    def inside(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, at = pdf["index"].to_numpy(), pdf[list(AXES)].to_numpy(float)
        near, far = [[] for _ in ids], [[] for _ in ids]
        for i, j, d2, _ in among(ids, at, ids, at, k, itself):
            for row, other, d in zip(i.tolist(), ids[j].tolist(), d2.tolist(), strict=True):
                near[row].append(other)
                far[row].append(d)
        return pdf.assign(near=near, far=far)

    kept = "g long, block long, index long, x double, y double, z double"
    own = cut_lineage(dealt.groupBy("g", "block").applyInPandas(inside, f"{kept}, near array<long>, far array<double>"))
    own = own.withColumn("reach", F.when(F.size("far") < k, float("inf")).otherwise(F.element_at("far", k)))
    boxes = cut_lineage(own.groupBy("g", "block").agg(*[F.min(c).alias(f"lo{c}") for c in AXES], *[F.max(c).alias(f"hi{c}") for c in AXES], F.max("reach").alias("reach")))
    gap = _squares([_outside(F.col(c), F.col(c), F.col(f"lo{c}"), F.col(f"hi{c}")) for c in AXES])
    asks = own.select("g", "block", "index", *AXES, "reach").join(_near_blocks(boxes), ["g", "block"]).filter(gap <= F.col("reach"))
    asks = cut_lineage(asks.select("g", F.col("target").alias("block"), "index", *AXES, "reach"))
    slices = asks.groupBy("g", "block").agg(F.ceil(F.count(F.lit(1)) / ASKS).alias("slices"))
    asks = asks.join(slices, ["g", "block"]).withColumn("slice", F.pmod(F.xxhash64("index"), F.col("slices")))
    asked = own.select("g", "block", "index", *AXES).join(slices, ["g", "block"]).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))

    def answers(key: tuple, pdf: pd.DataFrame, there: pd.DataFrame) -> pd.DataFrame:
        ids, others, parts = pdf["index"].to_numpy(), there["index"].to_numpy(), []
        if len(others):
            for i, j, d2, _ in among(ids, pdf[list(AXES)].to_numpy(float), others, there[list(AXES)].to_numpy(float), k, most=pdf["reach"].to_numpy(float)):
                parts.append(pd.DataFrame({"g": key[0], "index": ids[i], "neighbour": others[j], "distance2": d2}))
        return pd.concat(parts) if parts else pd.DataFrame({c: [] for c in ("g", "index", "neighbour", "distance2")})

    by = ["g", "block", "slice"]
    # Both sides come from the same tables; new names tell their columns apart.
    asks, asked = (side.toDF(*[f"{c}_{n}" for c in side.columns]).toDF(*side.columns) for n, side in enumerate((asks, asked)))
    found = asks.groupBy(*by).cogroup(asked.groupBy(*by)).applyInPandas(answers, "g long, index long, neighbour long, distance2 double")
    mine = own.select("g", "index", F.explode(F.arrays_zip("near", "far")).alias("n")).select("g", "index", F.col("n.near").alias("neighbour"), F.col("n.far").alias("distance2"))
    rank = F.row_number().over(W.partitionBy("g", "index").orderBy("distance2", "neighbour"))
    best = mine.unionByName(found).withColumn("rank", rank).filter(F.col("rank") <= k)
    there = first.filter(F.col("at") <= k).select("g", *AXES, F.col("index").alias("neighbour"), F.lit(0.0).alias("distance2"), F.col("at").alias("rank"))
    rest = points.join(first.select("g", "index"), ["g", "index"], "left_anti").join(there, ["g", *AXES])
    return best.unionByName(rest.select(*best.columns))
