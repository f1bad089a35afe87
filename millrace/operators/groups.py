"""Operators relative to a group: advantages, offsets, cumulative counts, and checks of group layout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import let
from .lineage import cut_lineage


def advantages(df: DataFrame, group: list[str], reward: str = "reward", epsilon: float = 1e-4) -> DataFrame:
    """``df`` with ``advantage``: (reward - mean) / (sample deviation + epsilon) in its group.

    Two sums for each group are joined back, so a group that holds a large share
    of the rows is reduced before the exchange.  A group of one has no
    deviation; its advantage is 0.
    """
    stats = df.groupBy(*[F.col(g).alias(f"__{g}") for g in group]).agg(F.avg(reward).alias("__mean"), F.stddev_samp(reward).alias("__std"))
    on = [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group]
    out = df.join(stats, on)
    value = F.coalesce((F.col(reward) - F.col("__mean")) / (F.col("__std") + epsilon), F.when(F.col(reward).isNotNull(), 0.0))
    return out.withColumn("advantage", value).drop("__mean", "__std", *[f"__{g}" for g in group])


def uneven_blocks(df: DataFrame, index: str, key: str, size: int) -> DataFrame:
    """Blocks of ``size`` rows by index that hold more than one key, or fewer rows: ``block``, ``keys``, ``rows``."""
    return df.groupBy(F.floor(F.col(index) / size).alias("block")).agg(F.countDistinct(key).alias("keys"), F.count(F.lit(1)).alias("rows")).filter((F.col("keys") != 1) | (F.col("rows") != size))


def running_offset(df: DataFrame, group: list[str], order: list[Column], size: str, name: str = "offset") -> DataFrame:
    """The sum of ``size`` over the rows before, 0 for the first."""
    before = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(size).over(before), F.lit(0)))


def size_rank(df: DataFrame, group: list[str], size: str, tie: str, name: str = "som_id") -> DataFrame:
    """1 for the largest of the group, and so on; ties by ``tie``."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(F.desc(size), tie)))


def cyclic(df: DataFrame, group: list[str], order: list[Column], values: list[str], name: str = "color") -> DataFrame:
    """The group's rows in turn with the values, again and again."""
    at = (F.row_number().over(W.partitionBy(*group).orderBy(*order)) - 1) % len(values)
    return df.withColumn(name, F.element_at(F.array(*map(F.lit, values)), at + 1))


def dealt(df: DataFrame, group: list[str], order: list[Column], bucket: str, size: int | None = None) -> DataFrame:
    """``df`` written out in ranges of group and order, with the number of the range in ``bucket``: ranges are of about one size, so a large group has many.

    Given ``size``, there are as many ranges as ``df``, which is counted, has that many rows.
    """
    many = () if size is None else (max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / size)),)
    return cut_lineage(df.repartitionByRange(*many, *group, *order).withColumn(bucket, F.spark_partition_id()))


def _joined(rows: DataFrame, info: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``info``, which has one row for each value of the keys, nulls included."""
    renamed = info.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    return rows.join(renamed, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]).drop(*[f"__k_{k}" for k in keys])


def running(df: DataFrame, group: list[str], order: list[Column], amount: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows of the group up to each, by a scan in two levels: sums inside ranges, after the totals of the ranges before.

    No task holds a whole group, and only one row for each range of a group is
    ordered in one place.
    """
    rows, keys = dealt(df.withColumn("__x", amount), group, order, "__b"), [*group, "__b"]
    sums = rows.groupBy(*keys).agg(F.sum("__x").alias("__n"))
    past = W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(*keys, F.coalesce(F.sum("__n").over(past), F.lit(0)).alias("__n"))
    own = rows.withColumn("__i", F.sum("__x").over(W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)))
    return _joined(own, before, keys).withColumn(name, F.col("__i") + F.col("__n")).drop("__b", "__i", "__n", "__x")


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """``df`` with the number of each row in its group, from 1 in that order; a group may be of any size."""
    return running(df, group, order, F.lit(1).cast("long"), name)


def percentiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """The exact percentiles of a value in each group, between neighbours in proportion, by name; nulls do not count.

    Values are counted first, so a value that fills a third of the table is one
    row, and counts are added up in ranges, so a group may hold most of the
    table.  A group without values has no row.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("__c"))
    upto = running(counted, group, [F.col(value)], F.col("__c"), "__upto")
    total = counted.groupBy(*group).agg(F.sum("__c").alias("__total"))
    placed = _joined(upto, total, group)
    first, ends = F.col("__upto") - F.col("__c"), {}
    for name, q in shares.items():
        at = (F.col("__total") - 1) * F.lit(float(q))
        has = lambda k: (first <= k) & (k < F.col("__upto"))
        ends |= {f"__lo_{name}": F.when(has(F.floor(at)), F.col(value)), f"__hi_{name}": F.when(has(F.ceil(at)), F.col(value)), f"__at_{name}": at - F.floor(at)}
    found = placed.groupBy(*group).agg(*[F.max(c).alias(n) for n, c in ends.items()])
    return found.select(*group, *[(F.col(f"__lo_{n}") + (F.col(f"__hi_{n}") - F.col(f"__lo_{n}")) * F.col(f"__at_{n}")).alias(n) for n in shares])


def precision_recall(df: DataFrame, group: list[str], order: list[Column], hit: str, truths: str) -> DataFrame:
    """``tp``, ``fp``, ``recall``, ``precision`` down the ranking, and ``envelope``: the best precision from here on.

    A scan in two levels: rows are dealt into ranges of the ranking, each range
    is summed up, and running counts inside a range begin with the totals of
    those before; the envelope is the best of the rest of the range and of all
    later ones.  A group that holds most rows is so spread over many tasks, and
    only one row for each range of a group is ordered in one place.
    """
    rows, keys = dealt(df, group, order, "__b"), [*group, "__b"]
    sums = rows.groupBy(*keys).agg(F.sum(hit).alias("__tp"), F.count(F.lit(1)).alias("__n"))
    past = W.partitionBy(*group).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)
    before = sums.select(*keys, *[F.coalesce(F.sum(c).over(past), F.lit(0)).alias(f"{c}0") for c in ("__tp", "__n")])
    down = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = _joined(rows.withColumns({"__i": F.row_number().over(down), "tp": F.sum(hit).over(down)}), before, keys)
    out = out.withColumn("tp", F.col("tp") + F.col("__tp0")).withColumn("fp", F.col("__i") + F.col("__n0") - F.col("tp"))
    out = cut_lineage(out.withColumns({"recall": F.try_divide(F.col("tp"), F.col(truths)), "precision": F.col("tp") / (F.col("tp") + F.col("fp"))}).drop("__tp0", "__n0"))
    later = W.partitionBy(*group).orderBy("__b").rowsBetween(1, W.unboundedFollowing)
    best = out.groupBy(*keys).agg(F.max("precision").alias("__best"))
    best = best.select(*keys, F.max("__best").over(later).alias("__later"))
    # From the end, as a frame up to the last row would be computed anew for each row.
    up = W.partitionBy(*keys).orderBy(F.desc("__i")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return _joined(out.withColumn("envelope", F.max("precision").over(up)), best, keys).withColumn("envelope", F.greatest("envelope", "__later")).drop("__b", "__i", "__later")


def min_max(df: DataFrame, group: list[str], value: str, name: str, constant: float = 0.5, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """``value`` scaled to [low, high] in its group; ``constant`` where all are equal."""
    ends = df.groupBy(*[F.col(g).alias(f"__{g}") for g in group]).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    out = df.join(ends, [F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group])
    share = (F.col(value) - F.col("__lo")) / (F.col("__hi") - F.col("__lo") + 1e-6)
    return out.withColumn(name, F.when(F.col("__hi") > F.col("__lo"), low + (high - low) * share).otherwise(constant)).drop("__lo", "__hi", *[f"__{g}" for g in group])


def mask_after(tokens: Column, end: Column) -> Column:
    """1 up to the first ``end``, 0 after it; all 1 without one."""
    return let(F.array_position(tokens, end), lambda first: F.transform(tokens, lambda _, i: F.when((first == 0) | (i < first), 1).otherwise(0)))


def attempts(log: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The log with ``attempt``: the number of the key's line."""
    return log.withColumn("attempt", F.row_number().over(W.partitionBy(key).orderBy(*order)))
