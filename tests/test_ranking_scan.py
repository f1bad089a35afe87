"""Curves of rankings of any size: ranges of a large class are many, and the result is that of one pass."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import groups


def test_a_class_with_most_rows_is_dealt_into_many_ranges(spark):
    made = random.Random(2)
    rows = [("big" if made.random() < 0.9 else made.choice(["a", "b", None]), i, made.randrange(50), made.randrange(2)) for i in range(3000)]
    df = spark.createDataFrame(rows, "kind string, id long, score long, hit int").withColumn("truths", F.lit(1700).cast("long"))
    order = [F.desc("score"), F.col("id")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        ranges = groups.dealt(df, ["kind"], order, "range").groupBy("kind", "range").count().collect()
        big = [r["count"] for r in ranges if r["kind"] == "big"]
        assert len(big) >= 3 and max(big) < 1500
        got = {r["id"]: r for r in groups.precision_recall(df, ["kind"], order, "hit", "truths").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 3000 and set(got[0].asDict()) == {"kind", "id", "score", "hit", "truths", "tp", "fp", "recall", "precision", "envelope"}
    for kind in ("big", "a", "b", None):
        mine = sorted((r for r in rows if r[0] == kind), key=lambda r: (-r[2], r[1]))
        best, tp = 0.0, sum(r[3] for r in mine)
        for n in range(len(mine), 0, -1):
            r = got[mine[n - 1][1]]
            best = max(best, tp / n)
            assert (r["tp"], r["fp"], r["recall"]) == (tp, n - tp, pytest.approx(tp / 1700))
            assert r["envelope"] == pytest.approx(best)
            tp -= mine[n - 1][3]


def test_empty_ranking(spark):
    df = spark.createDataFrame([], "kind string, id long, hit int, truths long")
    assert groups.precision_recall(df, ["kind"], [F.col("id")], "hit", "truths").count() == 0


def test_percentiles_of_crowded_values(spark):
    import numpy as np

    made = random.Random(3)
    rows = [(g, v) for g, n in (("big", 900), ("one", 1), (None, 7)) for v in [made.choice([1.0, 1.0, 5.5, made.random() * 9]) for _ in range(n)]] + [("none", None), ("big", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: (r["a"], r["b"], r["c"]) for r in groups.percentiles(df, ["g"], "v", {"a": 0.05, "b": 0.5, "c": 1.0}).collect()}
    want = {g: tuple(np.quantile([v for k, v in rows if k == g and v is not None], [0.05, 0.5, 1.0])) for g in ("big", "one", None)}
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g]) for g in want)
