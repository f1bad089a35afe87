"""Lookups, resumption and set operations.

Small sides are left to Spark's own size check (``autoBroadcastJoinThreshold``);
nothing here forces a broadcast of data without a bound.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def keep_last(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key by ``order``, which should be total."""
    names = df.columns
    last = F.max_by(F.struct(*names), F.struct(*order))
    return df.groupBy(*key).agg(last.alias("__last")).select(*[F.col("__last")[n].alias(n) for n in names])


def lookup(df: DataFrame, values: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """``df`` with the last of its key's values; rows without one are dropped, and ``missing`` tells which."""
    return df.join(keep_last(values, [key], order), key)


def missing(df: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose key has no value."""
    return df.join(values.select(key).distinct(), key, "left_anti")


def remaining(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows that are not done yet; a null key never is."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def to_retry(df: DataFrame, log: DataFrame, key: str, most: int, retry_failed: bool = True) -> DataFrame:
    """Rows to work on: unseen ones, and failed ones below ``most`` attempts if they are to be retried.

    ``log`` (key, status, attempts) has any number of lines for a key; one that
    completed once is done.
    """
    state = log.groupBy(F.col(key).alias("__k")).agg(F.max((F.col("status") == "completed").cast("int")).alias("__done"), F.max("attempts").alias("__tries"))
    again = (F.col("__tries") < most) if retry_failed else F.lit(False)
    return df.join(state, F.col(key) == F.col("__k"), "left").filter(F.col("__k").isNull() | ((F.col("__done") == 0) & again)).drop("__k", "__done", "__tries")


def in_all(key: str, *tables: DataFrame) -> DataFrame:
    """Keys that all tables have."""
    out = tables[0].select(key).distinct()
    for t in tables[1:]:
        out = out.join(t.select(key), key, "left_semi")
    return out


def grouped_with(objects: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Each item with its object; ``found`` is false for items whose object is missing."""
    marked = objects.withColumn("__has", F.lit(True))
    return items.join(marked, key, "left").withColumn("found", F.coalesce("__has", F.lit(False))).drop("__has")


#: Different indices that a task counts: a few hundred bytes each at most.
COUNTED = 500_000


def gathered(parts: list[DataFrame], index: str, expected: int) -> DataFrame:
    """All parts' rows by index; an error at run time unless there are ``expected`` different ones.

    Indices are dealt into parts of a stated size, as Spark puts small exchanges
    together by their compressed bytes.
    """
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    n = out.filter(F.col(index).isNotNull()).select(index).repartition(math.ceil(expected / COUNTED) or 1, index).distinct().count()
    if n != expected:
        raise ValueError(f"{n} of {expected} results are there")
    return out


def with_default(left: DataFrame, right: DataFrame, key: str, column: str, default) -> DataFrame:
    """``left`` with a column of ``right``, the default where it has none."""
    return left.join(right.select(key, column), key, "left").withColumn(column, F.coalesce(column, F.lit(default)))


def within(points: DataFrame, targets: DataFrame, radius: float, group: str) -> DataFrame:
    """Points with a target of their group nearer than ``radius``: an equi-join on grid cells of that size, then the distance."""
    cell = lambda c: F.floor(F.col(c) / radius).cast("bigint")
    steps = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    near = targets.select(F.col(group).alias("tg"), *[F.col(c).alias(f"t{c}") for c in "xyz"], *[cell(c).alias(f"c{c}") for c in "xyz"])
    for c in "xyz":
        near = near.withColumn("__s", F.explode(steps)).withColumn(f"c{c}", F.col(f"c{c}") + F.col("__s")).drop("__s")
    on = (points[group] == near["tg"]) & (cell("x") == near["cx"]) & (cell("y") == near["cy"]) & (cell("z") == near["cz"])
    distance = sum(((F.col(c) - F.col(f"t{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    return points.join(near, on & (distance < radius * radius), "left_semi")


def remapped(df: DataFrame, sample: DataFrame, group: str, index: str) -> DataFrame:
    """Rows of the sampled indices, with ``new_index`` dense from 0 in the old order."""
    dense = sample.select(group, index).distinct().withColumn("new_index", F.row_number().over(W.partitionBy(group).orderBy(index)) - 1)
    return df.join(dense, [group, index])


def subset_violations(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Keys that should be known and are not; an empty result is a pass."""
    return rows.select(key).distinct().join(known.select(key), key, "left_anti")
