"""Queries without SQL, and operators at sizes where they once gave way, against plain definitions."""

import json
import math

import numpy as np
import pytest

from millrace.operators import points, sampling, trees
from millrace.plans import catalog


@pytest.fixture(scope="module")
def embeddings(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").toPandas().sort_values("vec_id")
    return rows.assign(embedding=rows.embedding.map(np.array))


def got(spark, small, name):
    return catalog.queries()[name](spark, small).toPandas()


def cosine(a, b):
    return float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b)))


def test_distinct_top(spark, small, embeddings):
    want = set()
    for label, rows in embeddings.groupby("label"):
        chosen = []
        for i, v in sorted(zip(rows.vec_id, rows.embedding, strict=True), key=lambda r: (-(r[0] * 37 % 101), r[0])):
            if len(chosen) < 5 and all(cosine(v.astype(float), w) <= 0.6 for _, w in chosen):
                chosen.append((i, v.astype(float)))
        want |= {(label, i, k) for k, (i, _) in enumerate(chosen, 1)}
    mine = got(spark, small, "l14_distinct_top")
    assert set(zip(mine.label, mine.vec_id, mine["rank"], strict=True)) == want


def test_greedy_views(spark, small, embeddings):
    mine = got(spark, small, "l15_greedy_views")
    for label, rows in embeddings.groupby("label"):
        seen = {i: v > 0.5 for i, v in zip(rows.vec_id, rows.embedding, strict=True)}
        at = {i: v[:3].astype(float) for i, v in zip(rows.vec_id, rows.embedding, strict=True)}
        chosen, gains = [], []
        while len(chosen) < 6:
            covered = np.any([seen[c] for c in chosen], axis=0) if chosen else np.zeros(64, bool)
            gain = {i: (seen[i] & ~covered).mean() + 0.25 * (i % 10 / 10) + 0.15 * min(1, max(0, 1 - max((cosine(at[i], at[c]) for c in chosen), default=0))) + 0.01 * seen[i].mean() for i in seen if i not in chosen}
            best = max(gain.values())
            if chosen and best < max(0.1 * gains[0], 0.05):
                break
            chosen.append(min(i for i, g in gain.items() if g > best - 1e-9))
            gains.append(best)
        one = mine[mine.label == label].sort_values("rank")
        assert one.vec_id.tolist() == chosen and one.gain.tolist() == pytest.approx(gains, abs=1e-5)


def test_principal_components(spark, small, embeddings):
    x = np.stack(embeddings.embedding.to_numpy()).astype(float)
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    mine = got(spark, small, "g23_principal").sort_values("vec_id")
    for k in range(3):
        axis = axes[k] * np.sign(axes[k][np.abs(axes[k]).argmax()])
        p = (x - x.mean(axis=0)) @ axis
        assert mine[f"c{k}"].tolist() == pytest.approx(((p - p.min()) / (p.max() - p.min() + 1e-6)).tolist(), abs=2e-4)


def test_pushed_names(spark):
    def chain(k):
        return {"nodeId": k, "name": [f"n{k}"], "children": [chain(k + 1)]} if k < 4 else {"nodeId": 4, "name": ["n1", "n4"], "children": [{"nodeId": 5, "name": "a"}, {"nodeId": 6, "name": "b", "children": [{"nodeId": 7, "name": "c"}]}]}

    nodes = trees.parse(spark.createDataFrame([("o", json.dumps(chain(0)))], "id string, tree string"), "id", "tree")
    names = {r["node_id"]: r["candidates"] for r in trees.pushed_names(nodes).collect()}
    assert names == {"0": ["n0"], "1": ["n1", "n0"], "2": ["n2", "n1", "n0"], "3": ["n3", "n2", "n1", "n0"], "4": ["n1", "n4", "n3", "n2", "n0"], "5": ["a"], "6": ["b"], "7": ["c", "b"]}


def test_farthest_points_are_each_the_farthest(spark, small, embeddings):
    mine = got(spark, small, "g3_farthest_points")
    for label, rows in embeddings.groupby("label"):
        xyz = {i: v[:3].astype(float) for i, v in zip(rows.vec_id, rows.embedding, strict=True)}
        steps = mine[mine.object_id == label].sort_values("step").point_id.tolist()
        assert steps[0] == min(xyz) and len(set(steps)) == min(16, len(xyz))
        for k in range(1, len(steps)):
            far = {i: min(float(((xyz[i] - xyz[c]) ** 2).sum()) for c in steps[:k]) for i in xyz}
            assert far[steps[k]] == pytest.approx(max(far.values()))


def test_graph_parts_are_those_of_a_walk(spark, small, embeddings):
    mine = got(spark, small, "g5_graph_parts")
    for label, rows in embeddings.groupby("label"):
        xyz = [(i, v[:3].astype(float)) for i, v in zip(rows.vec_id, rows.embedding, strict=True)]
        near = {i: set() for i, _ in xyz}
        for i, p in xyz:
            for _, j in sorted((float(((p - q) ** 2).sum()), j) for j, q in xyz if j != i)[:3]:
                near[i].add(j)
                near[j].add(i)
        part = {}
        for i in near:
            todo = [i]
            while todo:
                j = todo.pop()
                if part.setdefault(j, i) == i and j in near:
                    todo += [n for n in near[j] if n not in part]
        one = mine[mine.object_id == label]
        pairs = set(zip(one.part, (part[i] for i in one.point_id), strict=True))
        assert len(pairs) == one.part.nunique() == len(set(part.values()))


@pytest.mark.parametrize("itself", [True, False])
def test_nearest_with_ties_and_few_points(spark, monkeypatch, itself):
    rng = np.random.default_rng(1)
    rows = [(g, int(i), *map(float, rng.integers(0, 4, 3))) for g, n in ((1, 40), (2, 3), (3, 1)) for i in rng.permutation(n)]
    monkeypatch.setattr(points, "PAIRS", 100)
    df = spark.createDataFrame(rows, "g long, i long, x double, y double, z double")
    want = set()
    for g, i, *p in rows:
        near = sorted((sum((a - b) ** 2 for a, b in zip(p, q, strict=True)), j) for h, j, *q in rows if h == g and (itself or j != i))[:5]
        want |= {(g, i, j, d, k) for k, (d, j) in enumerate(near, 1)}
    assert {tuple(r) for r in points.nearest(df, "g", "i", 5, itself).select("g", "i", "neighbour", "distance2", "rank").collect()} == want


def test_ranks_with_an_outlier_and_repeats(spark):
    ids = [*range(3000), 10**15, -(10**12), 7, 7]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    assert [r["id"] for r in sampling.id_ranked(df, "id").orderBy("rank").collect()] == sorted(ids)
    down = sampling.id_ranked(df, "id", descending=True).orderBy("rank").collect()
    assert [r["id"] for r in down] == sorted(ids, reverse=True) and [r["rank"] for r in down] == list(range(1, len(ids) + 1))
    assert sampling.id_ranked(df.limit(0), "id").count() == 0


def test_tree_of_100_levels(spark):
    edges = spark.createDataFrame([("o", f"n{i}", f"n{i - 1}" if i else None, 0) for i in range(100)] + [("p", "lost", "nowhere", 0)], "object_id string, node_id string, parent_id string, ord int")
    walked = trees.placed(edges).collect()
    assert {(r["node_id"], r["depth"], len(r["path"])) for r in walked} == {(f"n{i}", i, i + 1) for i in range(100)}
    assert trees.placed(edges.limit(0)).count() == 0


def test_spread_is_the_mean_distance(spark, small, embeddings):
    mine = got(spark, small, "a21_centroid_spread").set_index("label").spread
    for label, rows in embeddings.groupby("label"):
        x = np.stack(rows.embedding.to_numpy()).astype(float)
        assert mine[label] == pytest.approx(np.linalg.norm(x - x.mean(axis=0), axis=1).mean(), abs=1e-5)
    assert not math.isnan(mine.sum())


def test_rows_without_numbers_have_no_part_in_the_components(spark):
    rng = np.random.default_rng(2)
    good = [[float(x) for x in v] for v in rng.normal(size=(30, 4)) * [4, 2, 1, 0.1] + 1]
    bad = [None, [0.0] * 4, [1.0, -1.0, 2.0, -2.0], [float("nan")] * 4, [1.0, None, 1.0, 1.0], [1.0], []]
    schema = "i long, v array<double>"
    alone, mixed = ({r["i"]: r["pca"] for r in points.principal(spark.createDataFrame(list(enumerate(rows)), schema), "v", 4).collect()} for rows in (good, good + bad))
    assert all(mixed[i] == pytest.approx(alone[i], abs=1e-6) for i in range(30))
    assert all(mixed[i] == [0.3] * 3 for i in range(30, 37))
    assert [r["pca"] for r in points.principal(spark.createDataFrame([(0, None)], schema), "v", 4).collect()] == [[0.3] * 3]


def test_defaults_fill_up(spark):
    rows = spark.createDataFrame([(1, 10, 2.0, [1.0, 0.0]), (1, 11, 1.0, [1.0, 0.1]), (2, 20, 1.0, [0.0, 1.0])], "g long, i long, score double, vector array<double>")
    got_ = points.distinct_top(rows, "g", "i", 3, defaults=[[2.0, 0.0], [0.0, 1.0], [-1.0, 0.0]]).collect()
    assert {(r["g"], r["i"], r["rank"]) for r in got_} == {(1, 10, 1), (1, -2, 2), (1, -3, 3), (2, 20, 1), (2, -1, 2), (2, -3, 3)}
