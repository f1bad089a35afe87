import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import calls, groups, joins, reports, sampling, trees
from millrace.sources import io
from millrace.streaming import metrics


def test_split_sizes_are_exact_and_disjoint(spark):
    df = spark.range(101)
    got = {r["split"]: r["count"] for r in sampling.split(df, 0.9, "id", seed=3).groupBy("split").count().collect()}
    assert got == {"train": 90, "val": 11}


@pytest.mark.parametrize(("strategy", "n"), [("all", 20), ("first:3", 3), ("end:2", 2), ("end:0", 20), ("random:5", 5), ("random:10%", 2), ("random:11%", 3)])
def test_strategies(spark, strategy, n):
    assert sampling.take(spark.range(20), strategy, "id").count() == n


def test_unknown_strategy(spark):
    with pytest.raises(ValueError, match="no such sampling"):
        sampling.take(spark.range(3), "some:1", "id")


def test_sampler_drops_the_last_partial_chunk(spark):
    got = sampling.repeated_batches(spark.range(10), "id", 4, 2, 3)
    assert got.count() == 8 * 2 * 3 and got.select("id").distinct().count() == 8


def test_batches_per_step():
    assert sampling.batches_per_step(4, 8, 4, 4) == 32
    with pytest.raises(ValueError, match="cannot be divided"):
        sampling.batches_per_step(1, 3, 1, 2)


def test_ranks_of_one_row_and_none(spark):
    assert sampling.id_ranked(spark.range(0), "id").count() == 0
    assert [r["rank"] for r in sampling.id_ranked(spark.range(5, 6), "id").collect()] == [1]


def test_advantages(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("a", 1.0), ("a", 0.0), ("b", 1.0), ("b", 1.0), ("c", 5.0), (None, 2.0)], "g string, reward double")
    got = {}
    for r in groups.advantages(df, ["g"]).collect():
        got.setdefault(r["g"], []).append(round(r["advantage"], 6))
    assert sorted(got["a"]) == [-0.865875, -0.865875, 0.865875, 0.865875]
    assert got["b"] == [0, 0] and got["c"] == [0] and got[None] == [0]


def test_retry_log(spark):
    log = spark.createDataFrame([("a", "completed", 1), ("b", "failed", 1), ("c", "failed", 3), ("d", "failed", 1), ("d", "completed", 2)], "k string, status string, attempts int")
    todo = spark.createDataFrame([(x,) for x in "abcde"], "k string")
    assert sorted(r["k"] for r in joins.to_retry(todo, log, "k", 3).collect()) == ["b", "e"]
    assert sorted(r["k"] for r in joins.to_retry(todo, log, "k", 3, retry_failed=False).collect()) == ["e"]


def test_accuracy_reports(spark):
    rows = [(i < 6, i >= 2) for i in range(10)]  # 2 invalid of which both right
    df = spark.createDataFrame(rows, "right boolean, valid boolean")
    got = df.agg(*reports.accuracy_pair(F.col("right"), F.col("valid"))).first()
    assert (got["accuracy"], got["clean_accuracy"]) == (60.0, 50.0)
    none = df.filter("not valid").agg(*reports.accuracy_pair(F.col("right"), F.col("valid"))).first()
    assert (none["accuracy"], none["clean_accuracy"]) == (0.0, 0.0)


TREE = {"nodeId": 1, "name": "t", "children": [{"nodeId": 2, "name": ["x", " "], "children": [{"nodeId": 3, "maskId": 7, "name": "y", "children": [{"nodeId": 4, "maskId": 8, "name": "x"}]}]}]}


def test_trees(spark):
    raw = spark.createDataFrame([("o", json.dumps(TREE)), ("f", json.dumps([{"nodeId": 1}, {"nodeId": 2}])), ("bad", "{"), ("null", None)], "id string, tree string")
    nodes = trees.parse(raw, "id", "tree")
    assert {(r["object_id"], r["node_id"]) for r in nodes.collect()} == {("o", "1"), ("o", "2"), ("o", "3"), ("o", "4"), ("f", "virtual_root"), ("f", "1"), ("f", "2")}
    o = nodes.filter("object_id = 'o'")
    merged = trees.compressed(o).collect()
    assert len(merged) == 1 and merged[0]["names"] == ["x", "y", "t"] and merged[0]["mask_id"] == "8" and merged[0]["node_id"] == "1" and merged[0]["merged_ids"] == ["1", "2", "3", "4"]
    every = {r["node_id"]: r["masks"] for r in trees.subtree_masks(o).collect()}
    first = {r["node_id"]: r["masks"] for r in trees.subtree_masks(o, stop_at_first=True).collect()}
    assert every["1"] == ["7", "8"] and first["1"] == ["7"] and first["4"] == ["8"]
    assert {r["node_id"]: r["n_leaves"] for r in trees.leaf_counts(o).collect()} == {"1": 1, "2": 1, "3": 1, "4": 1}
    assert trees.as_text(o).first()["tree"] == "- t\n  - x\n    - y\n      - x"


def test_json_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"object_id": "a"}\n\n{bad\n{"object_id": ""}\n')
    assert [r["object_id"] for r in io.json_lines(spark, str(tmp_path / "a.jsonl"), "object_id string", strict=False, required="object_id").collect()] == ["a"]
    (tmp_path / "b.json").write_text('[{"object_id": "x"}, {"object_id": null}]')
    assert io.read_any(spark, str(tmp_path / "b.json"), "object_id string").count() == 2
    with pytest.raises(ValueError, match="unsupported"):
        io.read_any(spark, "x.txt", "a string")
    with pytest.raises(ValueError, match="2 files but 1"):
        io.paired(spark, "a.json:b.json", "a string", method="m")


def test_config_base(tmp_path):
    (tmp_path / "base.json").write_text('{"a": {"x": 1, "y": 2}, "b": 1}')
    (tmp_path / "own.json").write_text('{"_base_": "base.json", "a": {"y": 3}}')
    assert io.merged_config(str(tmp_path / "own.json")) == {"a": {"x": 1, "y": 3}, "b": 1}


def test_point_files(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(0)
    np.save(tmp_path / "a_8.npy", rng.normal(size=(8, 6)).astype("float32"))
    np.save(tmp_path / "b.npy", rng.normal(size=(20, 6)).astype("float32"))
    files = io.point_files(spark, str(tmp_path))
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "object_id string")
    got = {r["object_id"]: r["points"] for r in io.points_of(ids, files, 8).collect()}
    assert len(got["a"]) == len(got["b"]) == 8 and got["c"] is None


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "t")
    io.append_new(spark.range(3), path, "id")
    io.append_new(spark.range(5), path, "id")
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [0, 1, 2, 3, 4]


def test_stream_of_metrics(spark, small, tmp_path):
    schema = spark.read.parquet(f"{small}/events.parquet").schema
    spark.read.parquet(f"{small}/events.parquet").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = metrics.flushed(stream, "ts", "1 day", ["value"]).writeStream.outputMode("complete").format("memory").queryName("flushed").start()
    try:
        q.processAllAvailable()
        assert spark.table("flushed").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{small}/events.parquet").count()
    finally:
        q.stop()


def test_retries_pause_longer_each_time():
    pauses, seen = [], []

    def flaky(x):
        seen.append(x)
        if len(seen) < 4:
            raise OSError("busy")
        return x

    assert calls.retried(flaky, jitter=False, sleep=pauses.append)("a") == "a" and pauses == [1, 2, 4]
    seen.clear()
    with pytest.raises(OSError, match="busy"):
        calls.retried(flaky, attempts=2, sleep=lambda _: None)("a")


def test_a_call_that_fails_gives_null(spark):
    df = spark.createDataFrame([("1",), ("x",)], "a string")
    assert {r["a"]: r["reply"] for r in calls.called(df, "a", lambda x: str(int(x) + 1)).collect()} == {"1": "2", "x": None}


def test_remembered_results_go_by_use_and_by_age():
    asked = []
    f = calls.remembered(lambda x: asked.append(x) or x.upper(), 2, 3)
    assert [f(x) for x in "aabac"] == list("AABAC") and asked == ["a", "b", "c"]  # b is the one used longest ago
    assert f("a") == "A" and asked == ["a", "b", "c", "a"]  # given three times
    assert f("b") == "B" and asked[-1] == "b" and f("a") == "A" and len(asked) == 5
    assert calls.remembered(lambda x: None, 1, 9)(None) is None
    with pytest.raises(ValueError, match="at least 1"):
        calls.remembered(str, 0, 1)


def test_regions_have_all_points(spark):
    nodes = spark.createDataFrame([("o", "r", None, [0], None), ("o", "a", "r", [0, 0], "ma"), ("o", "b", "r", [0, 1], "mb")], "object_id string, node_id string, parent_id string, path array<int>, mask_id string")
    masks = F.when(F.col("id") % 2 == 0, "ma").otherwise("mb")
    points = spark.range(40_010).select(F.lit("o").alias("object_id"), masks.alias("mask_id"), F.col("id").alias("point_id"))
    count = lambda **k: {r["node_id"]: r["count"] for r in trees.regions(nodes, points, **k).groupBy("node_id").count().collect()}
    assert count() == {"r": 40_010, "a": 20_005, "b": 20_005}
    assert count(most=100) == {"r": 100, "a": 100, "b": 100}


def test_part_points_broadcast_nothing(spark):
    nodes = spark.createDataFrame([("o", "n", "m")], "object_id string, node_id string, mask_id string")
    masks = spark.createDataFrame([("o", "m", 2, 1)], "object_id string, mask_id string, mesh long, face int")
    meshes = spark.createDataFrame([("o", 1, 3), ("o", 2, 4)], "object_id string, mesh long, n_faces long")
    faces = spark.createDataFrame([("o", 7)], "object_id string, n long").select("object_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("face_id")).withColumn("point_id", F.col("face_id") * 10)
    got = trees.part_points(nodes, masks, meshes, faces)
    assert [tuple(r) for r in got.collect()] == [("o", "n", 40)]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_shards_sort_only_what_a_border_crosses(spark):
    """Contiguous parts of exact sizes, with negative ids, gaps, ties and nulls; buckets that lie in one part are not ranked."""
    for ids, world in ((list(range(-500, 20_000, 3)), 7), ([k // 40 for k in range(9000)] + [None] * 50, 4), ([5] * 100, 3), ([1, 2], 5), ([3, 1, 2], 3)):
        df = spark.createDataFrame([(i,) for i in ids], "id long").repartition(5)
        out = sampling.shards(df, world, "id")
        got = sorted(((r.shard, r.id is not None, r.id or 0) for r in out.collect()))
        ranks = sorted((i is not None, i or 0) for i in ids)
        each = len(ids) // world
        assert got == [(min(k // each, world - 1) if each else world - 1, *v) for k, v in enumerate(ranks)]
    plan = sampling.shards(spark.range(50_000), 3, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan.splitlines()[0]


def test_gathered_counts_in_tasks_of_a_stated_size(spark, monkeypatch):
    monkeypatch.setattr(joins, "COUNTED", 100)
    parts = [spark.range(0, 600), spark.range(600, 1000)]
    assert joins.gathered(parts, "id", 1000).count() == 1000
    for bad in ([parts[0], parts[0]], [parts[0]]):
        with pytest.raises(ValueError, match="600 of 1000"):
            joins.gathered(bad, "id", 1000)
