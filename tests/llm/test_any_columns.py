"""Pipeline stages leave the user's columns as they are, whatever their names, with and without repeated ids."""

import pytest
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, ngram_join

NAMES = ("__id", "__s", "__most", "__text", "__n", "__of", "__node", "__gone", "id", "s", "most", "digest", "Length", "keep_id", "KEEP_ID_", "of", "node", "gone", "gone_", "norm", "h", "best", "n", "group_size", "class_id", "n_links", "first", "count")
TEXT = "one two three four five six seven eight"


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("repeated", [False, True])
@pytest.mark.parametrize("stage", [exact_dedup.drop_exact_copies, ngram_join.keep_one])
def test_columns_with_any_name_keep_their_values(spark, stage, repeated):
    pairs = [(1, TEXT), (2, f" {TEXT}"), (3, "other words that stand alone here"), (None, "x")] + ([(1, "another text of the first id"), (3, TEXT)] if repeated else [])
    plain = spark.createDataFrame(pairs, "doc_id long, text string")
    wide = plain.select("*", *[F.concat(F.lit(f"{c}: "), F.coalesce("text", F.lit(""))).alias(c) for c in NAMES])
    got = stage(wide)
    assert got.columns == wide.columns
    assert rows_of(got.select("doc_id", "text")) == rows_of(stage(plain))
    for r in got.collect():
        assert all(r[c] == f"{c}: {r['text']}" for c in NAMES)
    assert 0 < got.count() < len(pairs)


def test_repeated_labelled_ids_stay_within_the_bounds(spark, monkeypatch):
    from millrace.llm import toxicity

    # Three ids, each with a hundred rows of four texts, and one id whose texts go beyond the features.
    rows = [(i, f"{'bad' if i == 1 else 'good'} words number {k % 4} of {i}") for i in (1, 2, 3) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0), (3, 0)], "doc_id long, toxic int")
    learned = []
    monkeypatch.setattr(toxicity, "ftrl", lambda x, y: learned.append((len(x), sum(map(len, x)), y.sum())) or (x, y, 0.0))
    toxicity.train(docs, labels, rows=12)
    assert learned[-1][0] == 12 and learned[-1][2] == 4
    toxicity.train(docs, labels, rows=8)
    assert learned[-1][0] <= 9
    toxicity.train(docs, labels, rows=12, features=60)
    # Some texts of an id go, not the id: what is left is below the bound but not empty.
    assert 0 < learned[-1][1] <= 60


def test_spans_say_which_rule_found_them(spark):
    from millrace.llm import substring_dedup

    line, passage = " ".join(f"l{i}" for i in range(35)), " ".join(f"p{i}" for i in range(55))
    rows = [(1, f"{line}\nx {passage} y"), (2, f"first of two\n{line}\nlast of two"), (3, f"a b c {passage} d e f"), (4, f"g\n{line} {passage} zz\nmore words\n{line}"), (5, f"h\n{passage}\n{line}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc_id"], r["span_start"]): r["rule"] for r in substring_dedup.repeated_passages(df).collect()}
    assert {(i, rule) for (i, _), rule in got.items()} == {(2, "line"), (3, "passage"), (4, "passage"), (4, "line"), (5, "line, passage")}
    assert {r["doc_id"] for r in substring_dedup.repeated_spans(df).collect()} == {2, 4, 5}
