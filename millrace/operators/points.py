"""Kernels over an object's points, detections or views: grouped Arrow functions, one object at a time.

An object is one group in most operators, so its points have to fit into a task.
Neighbours and connected parts also work on objects of more than ``LARGE``
points, by joins over blocks and edges; there nothing is grouped by object alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import kernels
from . import graphs, groups, neighbours
from .lineage import cut_lineage

#: Images that a call of the matching kernel works on.
IMAGES = 1024
#: Detections of a range of a ranking.
RANGE = 1 << 18
#: Distances between points that are held at once.
PAIRS = neighbours.PAIRS
#: Points of an object beyond which its neighbours are found by blocks.
LARGE = 20_000


def farthest(points: DataFrame, group: str, index: str, n: int) -> DataFrame:
    """(group, index, step): ``n`` points each, the lowest index first and then always the farthest from those before."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("index")
        at = kernels.farthest_points(pdf[["x", "y", "z"]].to_numpy(float), n)
        return pd.DataFrame({"g": key[0], "index": pdf["index"].to_numpy()[at], "step": np.arange(len(at))})

    rows = points.select(F.col(group).cast("long").alias("g"), F.col(index).cast("long").alias("index"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    return rows.groupBy("g").applyInPandas(run, "g long, index long, step long").withColumnsRenamed({"g": group, "index": index})


def _by_size(rows: DataFrame, large: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of objects ``g`` of at most ``large`` points, and those of the others; null if there are none."""
    many = cut_lineage(rows.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > large).select("g"))
    if many.isEmpty():
        return rows, None
    return rows.join(many, "g", "left_anti"), rows.join(many, "g", "left_semi")


def nearest(points: DataFrame, group: str, index: str, k: int, itself: bool = True, large: int = LARGE) -> DataFrame:
    """(group, index, neighbour, distance2, rank): the ``k`` nearest of each point in its object; ties by index.

    Objects of more than ``large`` points are spread over many tasks.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        ids, xyz = pdf["index"].to_numpy(), pdf[["x", "y", "z"]].to_numpy(float)
        # Some points at a time, so that memory does not grow with the square of the object.
        parts = [pd.DataFrame({"g": key[0], "index": ids[i], "neighbour": ids[j], "distance2": d2, "rank": rank}) for i, j, d2, rank in neighbours.among(ids, xyz, ids, xyz, k, itself, pairs=PAIRS)]
        return pd.concat(parts)

    rows = points.select(F.col(group).cast("long").alias("g"), F.col(index).cast("long").alias("index"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    small, others = _by_size(rows, large)
    out = small.groupBy("g").applyInPandas(run, "g long, index long, neighbour long, distance2 double, rank int")
    out = out if others is None else out.unionByName(neighbours.in_blocks(others, k, itself))
    return out.withColumnsRenamed({"g": group, "index": index})


def clusters(points: DataFrame, group: str, index: str, k: int, cuts: list[float], least: int = 2) -> DataFrame:
    """(group, level, index, cluster_id): Ward trees of each connected part of the neighbour graph, cut level by level."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("index")
        labels = kernels.hierarchy(np.stack(pdf["feature"].to_numpy()).astype(float), pdf[["x", "y", "z"]].to_numpy(float), k, cuts, least)
        level, at = np.indices(labels.shape)
        return pd.DataFrame({"g": key[0], "level": level.ravel(), "index": pdf["index"].to_numpy()[at.ravel()], "cluster_id": labels.ravel()})

    rows = points.select(F.col(group).cast("long").alias("g"), F.col(index).cast("long").alias("index"), "feature", *[F.col(c).cast("double").alias(c) for c in "xyz"])
    return rows.groupBy("g").applyInPandas(run, "g long, level long, index long, cluster_id long").withColumnsRenamed({"g": group, "index": index})


def linked(xyz: np.ndarray, k: int) -> np.ndarray:
    """Labels of connected parts; neighbours are found for some points at a time, so that memory does not grow with the square of the object."""
    at = np.arange(len(xyz))
    edges = [(i, j) for i, j, _, _ in neighbours.among(at, xyz, at, xyz, k, itself=False, pairs=PAIRS)]
    return kernels.graph_components(len(xyz), *map(np.concatenate, zip(*edges, strict=True)))


def graph_parts(points: DataFrame, group: str, index: str, k: int, large: int = LARGE) -> DataFrame:
    """(group, index, part): connected parts of the graph of ``k`` nearest neighbours, numbered from 0 by their smallest index.

    Objects of more than ``large`` points are edges that are joined round by round.
    """

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("index")
        xyz = pdf[["x", "y", "z"]].to_numpy(float)
        return pd.DataFrame({"g": key[0], "index": pdf["index"].to_numpy(), "part": linked(xyz, k)})

    rows = points.select(F.col(group).cast("long").alias("g"), F.col(index).cast("long").alias("index"), *[F.col(c).cast("double").alias(c) for c in "xyz"])
    small, others = _by_size(rows, large)
    out = small.groupBy("g").applyInPandas(run, "g long, index long, part long")
    if others is not None:
        found = graphs.components(neighbours.in_blocks(others, k, itself=False), "g", "index", "neighbour")
        number = groups.numbered(found.select("g", "root").distinct(), ["g"], [F.col("root")], "part")
        out = out.unionByName(found.join(number, ["g", "root"]).select("g", F.col("node").alias("index"), (F.col("part") - 1).alias("part")))
    return out.withColumnsRenamed({"g": group, "index": index})


def detection_metrics(boxes: DataFrame) -> DataFrame:
    """(category, area, most, ap, ap50, ap75, ar) from boxes (image_id, category, ord, x, y, w, h, score, is_gt, crowd).

    Images are matched some at a time, groups of one image and class together;
    a detection is one row, with a bit for each area and threshold for matched
    and one for missed, and its place, which says for which limits it counts.
    The curve of a class is a scan in two levels: rows are dealt into ranges of
    the ranking, ranges are summed up, and each is gone through with the sums of
    those before; for each threshold and recall step it keeps its best
    precision, of which the best of all ranges counts.
    """
    steps, areas, mosts, key = len(kernels.IOU_STEPS), list(kernels.AREAS), kernels.MOST_DETECTIONS, ["category", "area", "most"]
    bits, size = len(areas) * steps, len(mosts) * len(areas) * steps
    kinds = [(m, a) for m in range(len(mosts)) for a in range(len(areas))]

    def match(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ord", "x", "y", "w", "h"])
        (category, names), xywh, gt = pd.factorize(pdf["category"]), pdf[["x", "y", "w", "h"]].to_numpy(float), pdf["is_gt"].to_numpy(bool)
        images, image = np.unique(pdf["image_id"].to_numpy(), return_inverse=True)
        pairs, group = np.unique(image * len(names) + category, return_inverse=True)
        row, place, good, bad, truths = kernels.match_groups(xywh[~gt], pdf["score"].to_numpy(float)[~gt], group[~gt], xywh[gt], pdf["crowd"].to_numpy(bool)[gt], group[gt], len(pairs), list(kernels.AREAS.values()), max(mosts))
        packed = [sum((x[a, t].astype(np.int64) << (a * steps + t) for a in range(len(areas)) for t in range(steps)), np.zeros(len(row), np.int64)) for x in (good, bad)]
        of = pairs[group[~gt][row]]
        found = pd.DataFrame({"image_id": images[of // len(names)], "category": np.asarray(names)[of % len(names)], "place": place, "score": pdf["score"].to_numpy(float)[~gt][row], "good": packed[0], "bad": packed[1]})
        # Truths of an area are a row of place -1, -2 and so on.
        sums = [pd.DataFrame({"image_id": -1, "category": names, "place": -1 - a, "score": 0.0, "good": np.bincount(pairs % len(names), weights=n, minlength=len(names)).astype(np.int64), "bad": 0}) for a, n in enumerate(truths)]
        return pd.concat([found, *sums])

    rows = boxes.select(F.col("image_id").cast("long"), F.col("category").cast("string"), "ord", *[F.col(c).cast("double") for c in ("x", "y", "w", "h", "score")], "is_gt", "crowd").filter("image_id is not null and category is not null")
    # Neighbouring images share a call; IMAGES bounds it.
    each = cut_lineage(rows.groupBy(F.floor(F.col("image_id") / IMAGES)).applyInPandas(match, "image_id long, category string, place long, score double, good long, bad long"))
    counts = each.filter("place < 0").groupBy("category", (-1 - F.col("place")).alias("a")).agg(F.sum("good").alias("truths"))
    named = counts.select("category", F.element_at(F.array(*map(F.lit, areas)), (F.col("a") + 1).cast("int")).alias("area"), "truths")
    truths = named.select("category", "area", F.explode(F.array(*map(F.lit, mosts))).alias("most"), "truths")
    found = each.filter("place >= 0")
    found = groups.dealt(found, ["category"], [F.desc("score"), F.col("image_id"), F.col("place")], "range", RANGE)

    def summed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        limit = np.searchsorted(mosts, pdf["place"].to_numpy(), "right")
        out = np.zeros((2, len(mosts), bits), np.int64)
        for k, c in enumerate(("good", "bad")):
            x = pdf[c].to_numpy()
            for b in range(bits):
                out[k, :, b] = np.cumsum(np.bincount(limit, weights=(x >> b) & 1, minlength=len(mosts)))
        return pd.DataFrame([(*key, out.ravel().tolist())], columns=["category", "range", "n"])

    sums = found.groupBy("category", "range").applyInPandas(summed, "category string, range int, n array<long>")
    sums = cut_lineage(sums.select("category", "range", F.posexplode("n").alias("k", "n")))
    past = W.partitionBy("category", "k").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    before = sums.withColumn("n", F.coalesce(F.sum("n").over(past), F.lit(0))).groupBy(F.col("category").alias("of"), F.col("range").alias("at")).agg(F.sort_array(F.collect_list(F.struct("k", "n")))["n"].alias("n"))
    wanted = counts.groupBy(F.col("category").alias("of")).agg(F.sort_array(F.collect_list(F.struct("a", "truths")))["truths"].alias("truths"))
    before = before.join(wanted, "of")

    def best(_: tuple, pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "image_id", "place"], ascending=[False, True, True])
        category, truths = pdf["category"].iloc[0], start["truths"].iloc[0]
        begin = np.array(start["n"].iloc[0], float).reshape(2, len(mosts), len(areas), steps)
        out = []
        for m, a in kinds:
            if not truths[a]:
                continue
            rows = pdf[pdf["place"] < mosts[m]]
            top = np.zeros((steps, len(kernels.RECALL_STEPS)))
            for t in range(steps):
                hit, miss = ((rows[c].to_numpy() >> (a * steps + t)) & 1 for c in ("good", "bad"))
                # Of rows with as many matches, the one that made the last has the best precision.
                at = np.flatnonzero(hit)
                good, bad = begin[0, m, a, t] + np.arange(1, len(at) + 1), begin[1, m, a, t] + np.cumsum(miss)[at]
                step = np.searchsorted(kernels.RECALL_STEPS, good / float(truths[a]), "right") - 1
                np.maximum.at(top[t], step, good / (good + bad + np.spacing(1)))
            out.append((category, areas[a], mosts[m], top.ravel().tolist()))
        return pd.DataFrame(out, columns=[*key, "best"])

    ranges = found.groupBy("category", "range").cogroup(before.groupBy("of", "at")).applyInPandas(best, "category string, area string, most int, best array<double>")
    kind = F.floor(F.col("k") / steps)
    total = sums.filter(F.col("k") < size).groupBy("category", kind.alias("kind"), "k").agg(F.sum("n").cast("double").alias("n"))
    name = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    recalls = total.groupBy("category", name(areas, F.col("kind") % len(areas)).alias("area"), name(mosts, F.floor(F.col("kind") / len(areas))).alias("most")).agg(F.sort_array(F.collect_list(F.struct("k", "n")))["n"].alias("good"))

    def curve(_: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["truths"].max()
        if not n:
            ap = [-1.0] * 4
        else:
            parts = [np.array(x).reshape(steps, -1) for x in pdf["best"] if x is not None]
            # The best precision at a recall step or any later one.
            p = np.maximum.accumulate(np.max(parts, axis=0)[:, ::-1], axis=1)[:, ::-1].mean(axis=1) if parts else np.zeros(steps)
            good = [x for x in pdf["good"] if x is not None]
            ap = [p.mean(), p[0], p[5], np.mean(good[0]) / n if good else 0.0]
        return pd.DataFrame([(*pdf[key].iloc[0], *map(float, ap))], columns=[*key, "ap", "ap50", "ap75", "ar"])

    both = truths.join(recalls, key, "left").withColumn("best", F.lit(None).cast("array<double>"))
    both = both.unionByName(ranges, allowMissingColumns=True).withColumn("truths", F.coalesce("truths", F.lit(0)))
    return both.groupBy(*key).applyInPandas(curve, "category string, area string, most int, ap double, ap50 double, ap75 double, ar double")


def distinct_top(rows: DataFrame, group: str, index: str, n: int, most_alike: float = 0.6, defaults: list[list[float]] | None = None) -> DataFrame:
    """(group, index, rank): the best scored rows of each group that are not too alike; ``defaults`` fill up, as rows -1, -2 and so on."""
    extra = np.array(defaults or [], float)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("index")
        at = kernels.distinct_top(pdf["score"].to_numpy(float), np.stack(pdf["vector"].to_numpy()).astype(float), n, most_alike, extra)
        return pd.DataFrame({"g": key[0], "index": [pdf["index"].iloc[i] if i >= 0 else i for i in at], "rank": np.arange(1, len(at) + 1)})

    rows = rows.select(F.col(group).cast("long").alias("g"), F.col(index).cast("long").alias("index"), "score", "vector")
    return rows.groupBy("g").applyInPandas(run, "g long, index long, rank long").withColumnsRenamed({"g": group, "index": index})


def greedy_views(views: DataFrame, group: str, index: str, n: int) -> DataFrame:
    """(group, index, rank, gain): views (seen array<boolean>, vector, separation) by marginal gain."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("index")
        got = kernels.greedy_views(np.stack(pdf["seen"].to_numpy()).astype(bool), np.stack(pdf["vector"].to_numpy()).astype(float), pdf["separation"].to_numpy(float), n)
        return pd.DataFrame({"g": key[0], "index": [pdf["index"].iloc[i] for i, _ in got], "rank": np.arange(1, len(got) + 1), "gain": [g for _, g in got]})

    rows = views.select(F.col(group).cast("long").alias("g"), F.col(index).cast("long").alias("index"), "seen", "vector", "separation")
    return rows.groupBy("g").applyInPandas(run, "g long, index long, rank long, gain double").withColumnsRenamed({"g": group, "index": index})


def mask_scores(pixels: DataFrame, view: str, part: str, height: int, width: int) -> DataFrame:
    """(view, connectivity, separation) of the part masks of each view, from rows (view, part, row, col)."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        masks = []
        for _, p in pdf.groupby("part", sort=True):
            m = np.zeros((height, width), bool)
            m[p["row"].to_numpy(), p["col"].to_numpy()] = True
            masks.append(m)
        whole = np.any(masks, axis=0)
        return pd.DataFrame([(key[0], kernels.mask_connectivity(whole), kernels.view_separation(masks))], columns=["v", "connectivity", "separation"])

    rows = pixels.select(F.col(view).cast("long").alias("v"), F.col(part).cast("long").alias("part"), F.col("row").cast("long"), F.col("col").cast("long"))
    return rows.groupBy("v").applyInPandas(run, "v long, connectivity double, separation double").withColumnRenamed("v", view)


def principal(rows: DataFrame, vector: str, size: int, k: int = 3) -> DataFrame:
    """``df`` with ``pca``: the first ``k`` principal components, scaled to [0, 1] over the table.

    Rows without a vector of ``size`` numbers, or whose numbers add up to 0, teach nothing and get 0.3.
    The covariance comes from sums of ``size``**2 numbers that each task makes of its rows, so only that moves and reaches the driver.
    """

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ab, a, n = np.zeros((size, size)), np.zeros(size), 0
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
            ab, a, n = ab + x.T @ x, a + x.sum(axis=0), n + len(x)
        if n:
            i, j = np.divmod(np.arange(size * size), size)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(ab.ravel()), pa.array(a[i]), pa.array(np.full(size * size, n))], ["i", "j", "ab", "a", "n"])

    v = F.col(vector).cast("array<double>")
    numbers = (F.size(v) == size) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    valid = F.coalesce(numbers & (F.aggregate(v, F.lit(0.0), lambda s, x: s + x) != 0), F.lit(False))
    parts = rows.filter(valid).select(v.alias("v")).mapInArrow(products, "i long, j long, ab double, a double, n long")
    sums = parts.groupBy("i", "j").agg(F.sum("ab").alias("ab"), F.sum("a").alias("a"), F.sum("n").alias("n")).collect()
    ab, a, n = np.zeros((size, size)), np.zeros(size), 1
    for r in sums:
        ab[r["i"], r["j"]], a[r["i"]], n = r["ab"], r["a"], r["n"]
    mean = a / n
    value, axes = np.linalg.eigh(ab / n - np.outer(mean, mean))
    axes = axes[:, np.argsort(-value)[:k]]
    axes *= np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(k)])
    project = [F.when(valid, F.aggregate(F.zip_with(v, F.array(*map(F.lit, axes[:, c].tolist())), lambda x, y: x * y), F.lit(-float(mean @ axes[:, c])), lambda s, x: s + x)).alias(f"__{c}") for c in range(k)]
    out = rows.select("*", *project)
    ends = out.agg(*[f(f"__{c}").alias(f"__{n}{c}") for c in range(k) for n, f in (("lo", F.min), ("hi", F.max))])
    scaled = F.array(*[(F.col(f"__{c}") - F.col(f"__lo{c}")) / (F.col(f"__hi{c}") - F.col(f"__lo{c}") + 1e-8) for c in range(k)])
    return out.crossJoin(F.broadcast(ends)).withColumn("pca", F.when(F.col("__0").isNotNull(), scaled).otherwise(F.array(*[F.lit(0.3)] * k))).select(*rows.columns, "pca")
