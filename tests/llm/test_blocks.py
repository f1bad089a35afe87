"""Blocks of test items stay within their bound, equal items are one entry, and a seed that many items share costs little."""

import itertools
import random
import time

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from millrace.llm import components, decontaminate
from millrace.llm.tokens import words


def test_blocks_hold_every_item_once_and_keep_the_bound(spark):
    rows = [(i % 300, f"item {i % 300} " * (1 + i % 7)) for i in range(1200)] + [(9, "same words here now ok") for _ in range(400)] + [(1000, "long " * 1000), (None, "x y"), (5, None)]
    items = decontaminate.distinct_items(spark.createDataFrame(rows, "item_id long, t string"), "item_id", "t")
    found = []
    for block in decontaminate.blocks(items, 2000):
        got = block.collect()
        assert got and (sum(len(r["item_text"]) for r in got) <= 2000 or len(got) == 1)
        found += [(r["item_id"], r["item_text"], r["copies"]) for r in got]
    want = {}
    for i, t in rows:
        if t is not None:
            want[i, t] = want.get((i, t), 0) + 1
    assert sorted(found, key=repr) == sorted(((i, t, n) for (i, t), n in want.items()), key=repr)
    assert [b.count() for b in decontaminate.blocks(items.limit(0), 10)] == [0]


def test_equal_items_give_their_rows_in_any_block(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "nothing of it")], "doc_id long, text string")
    tests = spark.createDataFrame([(7, "a b c d e f")] * 3 + [(8, "a b c d e f"), (9, None)], "item_id long, text string")
    for size in (1 << 20, 12, 1):
        got = decontaminate.leaks(docs, tests, block_bytes=size).groupBy("doc_id", "item_id").count().collect()
        assert sorted(tuple(r) for r in got) == [(1, 7, 6), (1, 8, 2)]
        assert decontaminate.drop_leaks(docs, tests, block_bytes=size).select("doc_id").collect()[0][0] == 2
    assert decontaminate.leaks(docs, tests.filter(F.lit(False))).count() == 0


def test_a_seed_that_many_items_share_is_not_walked_pair_by_pair():
    made = np.random.default_rng(3)
    word = lambda: f"w{made.integers(1 << 30)}"
    phrase = "which of the following is"

    def seconds(n):
        block = decontaminate.Block(list(range(n)), [f"{phrase} {' '.join(word() for _ in range(40))}" for _ in range(n)], 5)
        texts = words(pa.array([f"{' '.join(word() for _ in range(50))} {phrase} {' '.join(word() for _ in range(50))}" for _ in range(100)]))
        best = 1e9
        for _ in range(2):
            began = time.perf_counter()
            assert list(decontaminate._pairs(block, texts, 0.5)) == []
            best = min(best, time.perf_counter() - began)
        return best

    assert seconds(4000) < 1.5


def test_components_of_a_long_chain_in_random_order(spark):
    # Rounds that only pass labels to neighbours would grow with the length of the chain.
    order = random.Random(4).sample(range(1000), 600)
    edges = list(itertools.pairwise(order)) + [(2000, 2001), (2001, 2001), (None, 3)]
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {(r["node"], r["root"]) for r in got} == {(n, min(order)) for n in order} | {(2000, 2000), (2001, 2000)} and len(got) == 602
