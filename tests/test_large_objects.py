"""Neighbours by blocks and parts by edges equal those of one group, also with crowded places, ties and outliers."""

import tracemalloc

import numpy as np
import pytest

from millrace.operators import graphs, neighbours
from millrace.operators import points as P


def cloud(spark, kind):
    rng = np.random.default_rng(5)
    parts = {
        "even": rng.random((400, 3)),
        "clusters": np.concatenate([rng.normal(c, s, (120, 3)) for c, s in ((0, 0.01), (5, 1), (100, 0.1))] + [[[1e4, 0, 0]]]),
        "grid": np.stack(np.meshgrid(*[np.arange(6)] * 3), -1).reshape(-1, 3).astype(float),
        "one place": np.concatenate([np.zeros((150, 3)), rng.random((60, 3))]),
        "flat": np.concatenate([rng.random((200, 1)), np.zeros((200, 2))], axis=1),
        "same": np.ones((30, 3)),
    }[kind]
    rows = [(1, i, *map(float, p)) for i, p in enumerate(parts)] + [(2, i, float(i), 0.0, 0.0) for i in range(3)] + [(3, 7, 0.0, 0.0, 0.0)]
    return spark.createDataFrame(rows, "o long, i long, x double, y double, z double")


@pytest.mark.parametrize("kind", ["even", "clusters", "grid", "one place", "flat", "same"])
def test_neighbours_by_blocks(spark, kind, monkeypatch):
    # Blocks of a few points, so that the tree of boxes has levels, and slices of a few questions.
    monkeypatch.setattr(neighbours, "ASKS", 20)
    df = cloud(spark, kind)
    itself = kind in ("even", "grid", "same")
    columns = ["o", "i", "rank", "neighbour", "distance2"]
    want = sorted(tuple(r) for r in P.nearest(df, "o", "i", 4, itself).select(columns).collect())
    rows = neighbours.in_blocks(df.withColumnsRenamed({"o": "g", "i": "index"}), 4, itself, size=10)
    assert sorted(tuple(r) for r in rows.withColumnsRenamed({"g": "o", "index": "i"}).select(columns).collect()) == want
    if kind == "flat":
        assert sorted(tuple(r) for r in P.nearest(df, "o", "i", 4, itself, 2).select(columns).collect()) == want


def test_parts_by_edges(spark):
    df = cloud(spark, "clusters")
    want, got = (sorted(tuple(r) for r in P.graph_parts(df, "o", "i", 3, large).collect()) for large in (10**9, 2))
    # A single point has no edge, and stays in the group of small objects.
    assert got == want and len({p for o, _, p in want if o == 1}) > 1


def test_components_of_chains_and_groups(spark):
    chain = [(1, i, i + 1) for i in range(100)] + [(1, 200, 201), (2, 5, 4), (2, 4, 3), (2, 9, 9), (None, 1, 2), (2, None, 3)]
    got = {(r["g"], r["node"]): r["root"] for r in graphs.components(spark.createDataFrame(chain, "g long, a long, b long"), "g", "a", "b").collect()}
    assert got == {**{(1, i): 0 for i in range(101)}, (1, 200): 200, (1, 201): 200, (2, 3): 3, (2, 4): 3, (2, 5): 3, (2, 9): 9}


def test_components_of_shuffled_paths_and_stars(spark):
    # A path in random order and one in order, a star, and random edges; rounds must not grow with the length of a path.
    rng = np.random.default_rng(2)
    order = rng.permutation(400)
    edges = [(1, int(x), int(y)) for x, y in zip(order, order[1:], strict=False)] + [(2, i, i + 1) for i in range(400)] + [(3, 999, i) for i in range(300)]
    edges += [(4, int(x), int(y)) for x, y in rng.integers(0, 300, (140, 2))] + [(4, 1, 2)] * 3
    up = {(g, n): (g, n) for g, a, b in edges for n in (a, b)}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for g, a, b in edges:
        lo, hi = sorted((find((g, a)), find((g, b))))
        up[hi] = lo
    got = graphs.components(spark.createDataFrame(edges, "o long, a long, b long"), "o", "a", "b").collect()
    assert {(r["o"], r["node"]): (r["o"], r["root"]) for r in got} == {n: find(n) for n in up} and len(got) == len(up)


def test_components_of_no_edges(spark):
    assert graphs.components(spark.createDataFrame([], "o long, a long, b long"), "o", "a", "b").collect() == []


def test_parts_of_an_object_do_not_hold_all_its_distances():
    from millrace.functions import kernels

    xyz = np.random.default_rng(3).integers(0, 9, (4000, 3)).astype(float)
    tracemalloc.start()
    got, most = P.linked(xyz, 3), tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 150e6  # the squares of all differences are 384 MB
    few = xyz[:500]
    assert (P.linked(few, 3) == kernels.graph_components(500, np.repeat(np.arange(500), 3), kernels.nearest(few, 3).ravel())).all()
    assert len(got) == 4000 and P.linked(few[:1], 3).tolist() == [0]
