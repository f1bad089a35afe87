"""Masks splatted from points, distances between them, and the choice of views, against plain definitions."""

import heapq
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import raster
from millrace.operators import views as V
from millrace.plans import shape_queries as Q


def cheapest_steps(mask):
    """Dijkstra over all pixels."""
    h, w = mask.shape
    best = {(int(y), int(x)): 0 for y, x in np.argwhere(mask)}
    queue = [(0, p) for p in best]
    while queue:
        d, (y, x) = heapq.heappop(queue)
        if d > best[y, x]:
            continue
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                to = (y + dy, x + dx)
                cost = d + (raster.DIAGONAL if dy and dx else raster.STRAIGHT)
                if (dy or dx) and 0 <= to[0] < h and 0 <= to[1] < w and cost < best.get(to, 1 << 60):
                    best[to] = cost
                    heapq.heappush(queue, (cost, to))
    return best


def test_distances_are_shortest_paths():
    rng = np.random.default_rng(1)
    for _ in range(40):
        mask = rng.random((rng.integers(1, 12), rng.integers(1, 12))) < rng.choice([0.02, 0.2])
        got, want = raster.chamfer(mask), cheapest_steps(mask)
        if mask.any():
            assert {(y, x): got[y, x] for y in range(mask.shape[0]) for x in range(mask.shape[1])} == want
        else:
            assert (got >= 1 << 39).all()


def test_gaps_by_hand():
    a, b = np.zeros((20, 20), bool), np.zeros((20, 20), bool)
    assert raster.chamfer_gap(a, b) == 0
    a[2, 2] = b[2, 7] = True
    assert raster.chamfer_gap(a, b) == pytest.approx(5 * 0.955, abs=1e-4)
    b[2, 7], b[5, 3] = False, True
    assert raster.chamfer_gap(a, b) == raster.chamfer_gap(b, a) == pytest.approx(1.3693 + 2 * 0.955, abs=1e-4)
    assert raster.separation(a, b) == 0.15 and raster.separation(a, b, least=1) == pytest.approx((1.3693 + 2 * 0.955) / 12, abs=1e-4)
    assert raster.separation(a, a, least=1) == 0 and raster.separation(a, ~a, least=1) == 0.15


def test_closing_and_blurring():
    m = np.zeros((12, 12), bool)
    m[5, 3] = m[5, 6] = True
    assert set(map(tuple, np.argwhere(raster.closed(m, 5)))) == {(5, 3), (5, 4), (5, 5), (5, 6)}
    assert (raster.closed(m, 1) == m).all() and raster.closed(np.ones((4, 4), bool), 3).all()
    big = np.zeros((40, 40), bool)
    big[10:30, 10:30] = True
    soft = raster.blurred(big, 21, 50 / 255)
    assert soft[20, 20] and soft[20, 8] and not soft[20, 5] and not raster.blurred(m, 21, 50 / 255).any()
    assert raster.blurred(np.ones((6, 6), bool), 21, 0.9).all()


def plain_greedy(shown, weight, fixed, directions, n):
    chosen, covered = [], np.zeros(shown.shape[1])
    while len(chosen) < min(n, len(shown)):
        gains = {}
        for i in range(len(shown)):
            if i not in [c for c, _ in chosen]:
                far = 1.0 if not chosen else min(1.0, max(0.0, 1 - float(max(directions[c] @ directions[i] for c, _ in chosen))))
                gains[i] = sum(max(0.0, s - c) * w for s, c, w in zip(shown[i], covered, weight, strict=True)) + fixed[i] + 0.15 * far
        best = max(gains.values())
        if chosen and best < max(0.1 * chosen[0][1], 0.05) - 1e-12:
            break
        i = min(i for i, g in gains.items() if g > best - 1e-12)
        chosen.append((i, gains[i]))
        covered = np.maximum(covered, shown[i])
    return chosen


def test_lazy_choice_equals_the_plain_one():
    rng = np.random.default_rng(2)
    for _ in range(200):
        n, parts = rng.integers(1, 30), rng.integers(1, 6)
        shown = rng.choice([0, 0.25, 0.5, 1.0], (n, parts))
        at = rng.normal(size=(n, 3))
        at /= np.linalg.norm(at, axis=1, keepdims=True)
        fixed, weight = rng.choice([0, 0.01, 0.1], n), rng.choice([0.5, 1, 2], parts)
        got, want = raster.lazy_views(shown, weight, fixed, at, 8), plain_greedy(shown, weight, fixed, at, 8)
        assert [i for i, _ in got] == [i for i, _ in want]
        assert [g for _, g in got] == pytest.approx([g for _, g in want])


def test_fixed_gain_by_hand():
    pairs = [(0, 1, 1.0, 0.5), (0, 2, 0.15, 1.0), (1, 2, 0.0, 1.0)]
    # The third part is not seen enough, so its pairs do not count.
    assert raster.fixed_gain(np.array([1.0, 0.5, 0.3]), pairs, 0.4) == pytest.approx(0.25 * 1.0 + 0.004)
    assert raster.fixed_gain(np.array([1.0, 0.5, 0.4]), pairs, 0) == pytest.approx(0.25 * (0.25 * 1 + 0.4 * 0.15) / (0.25 + 0.4 + 0.4))
    assert raster.fixed_gain(np.zeros(3), pairs, 0) == 0


def test_a_nearer_part_hides_another(spark):
    # Seen from (0, 0, 5), part 0 stands before part 1; part 2 is beside them, a point of it behind the camera.
    rows = [(1, 1, 0, 0.0, 0.0, 1.0, 1.0), (1, 2, 1, 0.0, 0.0, -1.0, 3.0), (1, 3, 1, 1.0, 0.0, 0.0, 1.0), (1, 4, 2, -1.0, 0.0, 0.0, 2.0), (1, 5, 2, 0.0, 0.0, 9.0, 2.0)]
    p = spark.createDataFrame(rows, "object_id long, point_id long, part int, x double, y double, z double, weight double")
    eyes = spark.createDataFrame([(1, 0, 0.0, 0.0, 5.0), (1, 1, 0.0, 0.0, -5.0), (2, 0, 0.0, 0.0, 5.0)], "object_id long, view int, x double, y double, z double")
    seen = V.visible_points(V.placed(p, eyes, 30.0, 32), 1, 32)
    assert {(r["view"], r["point_id"]) for r in seen.filter("visible").collect()} == {(0, 1), (0, 3), (0, 4), (1, 2), (1, 3), (1, 4)}
    pixels = {(r["row"], r["col"]) for r in V.part_pixels(seen, 1, 32).filter("view = 0 and part = 0").collect()}
    assert pixels == {(16, 16), (15, 16), (17, 16), (16, 15), (16, 17)}
    got = {r["view"]: r for r in V.view_candidates(seen, V.part_pairs(p), 1, 32, least=1).collect()}
    assert set(got) == {0, 1}
    assert [(s["part"], s["share"]) for s in got[0]["shown"]] == [(0, 1.0), (1, 0.25), (2, 0.5)] and got[0]["overall"] == 0.6
    assert got[0]["connectivity"] == pytest.approx(1 / 3)
    chosen = V.chosen_views(V.view_candidates(seen, V.part_pairs(p), 1, 32, least=1), eyes, spark.createDataFrame([(1, 1, 4.0)], "object_id long, part int, weight double"), 3)
    assert [(r["rank"], r["view"]) for r in chosen.orderBy("rank").collect()][0] == (1, 1)


def test_scores_of_all_views(spark, small):
    p, eyes, candidates = Q._candidates(spark, small)
    masks = defaultdict(lambda: np.zeros((Q.IMAGE, Q.IMAGE), bool))
    for r in V.part_pixels(Q._visible(spark, small), Q.RADIUS, Q.IMAGE).collect():
        masks[r["object_id"], r["view"], r["part"]][r["row"], r["col"]] = True
    seen = Q._visible(spark, small).groupBy("object_id", "view", "part").agg((F.sum(F.col("weight") * F.col("visible").cast("int")) / F.sum("weight")).alias("share")).collect()
    share = {(r["object_id"], r["view"], r["part"]): r["share"] for r in seen}
    confusion = {(r["object_id"], r["a"], r["b"]): r["confusion"] for r in V.part_pairs(p).collect()}
    got = candidates.collect()
    assert {(r["object_id"], r["view"]) for r in got} == {k[:2] for k in share} and len(got) > 50
    shown, fixed = defaultdict(dict), {}
    for r in got:
        o, v = r["object_id"], r["view"]
        parts = [s["part"] for s in r["shown"]]
        assert {s["part"]: s["share"] for s in r["shown"]} == pytest.approx({k[2]: x for k, x in share.items() if k[:2] == (o, v)})
        total = apart = 0.0
        for a in parts:
            for b in parts:
                if a < b:
                    x, y = masks[o, v, a], masks[o, v, b]
                    steps = cheapest_steps(y) if min(x.sum(), y.sum()) >= 64 else {}
                    far = [steps[tuple(q)] for q in np.argwhere(x).tolist()] if steps else [0]
                    one = 0.15 if min(x.sum(), y.sum()) < 64 else 0.0 if (x & y).any() else min(1, max(0.15, min(far) / 65536 / 12))
                    apart, total = apart + confusion[o, a, b] * one, total + confusion[o, a, b]
        assert r["separation"] == pytest.approx(apart / total if total > 1e-9 else 0)
        shown[o][v] = [s["share"] for s in r["shown"]]
        fixed[o, v] = raster.fixed_gain(np.array(shown[o][v]), [(parts.index(q["a"]), parts.index(q["b"]), q["separation"], q["weight"]) for q in r["apart"]], r["overall"])
    hard = defaultdict(float)
    for (o, a, b), c in confusion.items():
        hard[o, a], hard[o, b] = max(hard[o, a], c), max(hard[o, b], c)
    at = {(r["object_id"], r["view"]): np.array([r["x"], r["y"], r["z"]]) / np.linalg.norm([r["x"], r["y"], r["z"]]) for r in eyes.collect()}
    mine = defaultdict(list)
    for r in Q.l15_chosen_views(spark, small).orderBy("object_id", "rank").collect():
        mine[r["object_id"]].append((r["view"], r["gain"]))
    for o, by in shown.items():
        vs = sorted(by)
        parts = len(by[vs[0]])
        want = plain_greedy(np.array([by[v] for v in vs]), [hard[o, k] if (o, k) in hard else 1.0 for k in range(parts)], [fixed[o, v] for v in vs], np.array([at[o, v] for v in vs]), 4)
        assert [v for v, _ in mine[o]] == [vs[i] for i, _ in want]
        assert [g for _, g in mine[o]] == pytest.approx([g for _, g in want], abs=1e-5)


def test_points_are_dealt_out_before_they_grow(spark, monkeypatch):
    monkeypatch.setattr(V, "POINTS", 100)
    x = ((F.col("id") % 7) / 7).alias("x")
    points = spark.range(2000).select(F.floor(F.col("id") / 20).alias("object_id"), F.col("id").alias("point_id"), F.lit(0).alias("part"), x, F.lit(0.1).alias("y"), F.lit(0.2).alias("z"), F.lit(1.0).alias("weight"))
    views = points.select("object_id").distinct().select("object_id", F.lit(0).alias("view"), *[F.lit(v).alias(c) for c, v in zip("xyz", (0.0, 0.0, 5.0), strict=True)])
    assert V.placed(points, views, 60.0, 64).select(F.spark_partition_id()).distinct().count() > 10
