"""Samples, splits and shards in a hash order: the same rows for the same seed, in any partitioning.

Global ranks need a place for every row, and one task that numbers all rows is
no answer at scale.  ``ranked`` deals rows out by ranges of the hash key, counts
the ranges, and numbers rows inside them.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKETS = 1024
_SPAN = 1 << 32


def hash_key(c: Column, seed: int = 0) -> Column:
    """A scattered number below 2**32 for a whole number, which plain arithmetic repeats in any engine."""
    return F.pmod(F.pmod(c, F.lit(1 << 30)) * 2654435761 + seed * 40503, F.lit(_SPAN))


def ranked(df: DataFrame, order: list[Column], bucket: Column, name: str = "rank") -> DataFrame:
    """``df`` with the 1-based rank by ``order``; ``bucket`` is a number from 0 that rises with the order.

    Each bucket is numbered on its own, and the buckets before it are added from
    a table of at most BUCKETS counts.
    """
    placed = df.withColumn("__b", bucket.cast("int"))
    counts = placed.groupBy("__b").agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(F.col("__b").alias("__c"), F.coalesce(F.sum("__n").over(W.orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    numbered = placed.withColumn("__i", F.row_number().over(W.partitionBy("__b").orderBy(*order)))
    return numbered.join(F.broadcast(before), F.col("__b") == F.col("__c")).withColumn(name, F.col("__i") + F.col("__before")).drop("__b", "__c", "__i", "__before")


def hash_ranked(df: DataFrame, id_col: str, seed: int = 0, name: str = "rank") -> DataFrame:
    """The rank in hash order, ties by id."""
    key = hash_key(F.col(id_col), seed)
    return ranked(df, [key, F.col(id_col)], F.floor(key / (_SPAN // BUCKETS)), name)


def _dealt(df: DataFrame, id_col: str) -> DataFrame | None:
    """Rows with ``__at``, the bucket of a numeric id, of about as many rows each whatever the ids; None where one bucket is all there is."""
    marked = df.withColumn("__v", F.coalesce(F.col(id_col).cast("double"), F.lit(-math.inf)))
    shares = [k / BUCKETS for k in range(1, BUCKETS)]
    cuts = sorted(x for x in set(marked.approxQuantile("__v", shares, 1 / (4 * BUCKETS))) if math.isfinite(x))
    return Bucketizer(splits=[-math.inf, *cuts, math.inf], inputCol="__v", outputCol="__at").transform(marked) if cuts else None


def id_ranked(df: DataFrame, id_col: str, name: str = "rank", descending: bool = False) -> DataFrame:
    """The rank in the order of a numeric id, over buckets of about as many rows each, whatever the ids."""
    dealt = _dealt(df, id_col)
    if dealt is None:
        return ranked(df, [F.col(id_col).desc() if descending else F.col(id_col)], F.lit(0), name)
    order, bucket = (F.col(id_col).desc(), F.lit(BUCKETS) - F.col("__at")) if descending else (F.col(id_col), F.col("__at"))
    return ranked(dealt, [order], bucket, name).drop("__v", "__at")


def take(df: DataFrame, strategy: str, id_col: str, seed: int = 0) -> DataFrame:
    """Rows by a sampling strategy: ``all``, ``first:n``, ``end:n`` (0: all), ``random:n``; n may be a percentage, rounded up."""
    if strategy == "all":
        return df
    kind, _, amount = strategy.partition(":")
    if kind not in ("first", "end", "random") or not amount:
        raise ValueError(f"no such sampling strategy: {strategy}")
    n = math.ceil(int(amount[:-1]) * df.count() / 100) if amount.endswith("%") else int(amount)
    if kind == "end" and n == 0:
        return df
    rank = {"first": lambda: id_ranked(df, id_col, "__rank"), "end": lambda: id_ranked(df, id_col, "__rank", True), "random": lambda: hash_ranked(df, id_col, seed, "__rank")}[kind]()
    return rank.filter(F.col("__rank") <= n).drop("__rank")


def split(df: DataFrame, ratio: float, id_col: str, seed: int | None = 0, names: tuple[str, str] = ("train", "val"), column: str = "split") -> DataFrame:
    """Exactly floor(n*ratio) rows in the first part: in hash order, or in id order if ``seed`` is None."""
    cut = math.floor(df.count() * ratio)
    rank = id_ranked(df, id_col, "__rank") if seed is None else hash_ranked(df, id_col, seed, "__rank")
    return rank.withColumn(column, F.when(F.col("__rank") <= cut, names[0]).otherwise(names[1])).drop("__rank")


def page(df: DataFrame, start: int, most: int, id_col: str) -> DataFrame:
    """``most`` rows after the first ``start`` by id."""
    return id_ranked(df, id_col, "__rank").filter(F.col("__rank").between(start + 1, start + most)).drop("__rank")


def shards(df: DataFrame, world: int, id_col: str, column: str = "shard") -> DataFrame:
    """Contiguous parts of len//world rows by id; the last takes the rest.

    A bucket of ids that lies in one part needs no ranks; only those that a
    border crosses, one for each border at most, are sorted.
    """
    each = df.count() // world
    part = lambda rank: min((rank - 1) // each, world - 1) if each else world - 1
    dealt = _dealt(df, id_col) if each else None
    if dealt is None:
        rank = id_ranked(df, id_col, "__rank")
        return rank.withColumn(column, F.least(F.floor((F.col("__rank") - 1) / max(each, 1)), F.lit(world - 1)).cast("bigint") if each else F.lit(world - 1).cast("bigint")).drop("__rank")
    sizes = {int(at): n for at, n in dealt.groupBy("__at").count().collect()}  # BUCKETS at most
    first, before, crossed, total = [], [], [], 0
    for at in range(max(sizes) + 1):
        n = sizes.get(at, 0)
        first.append(part(total + 1))
        before.append(total)
        if n and part(total + n) != first[-1]:
            crossed.append(at)
        total += n
    of = lambda values: F.element_at(F.lit(values), F.col("__at").cast("int") + 1).cast("bigint")
    whole = dealt.filter(~F.col("__at").isin(crossed)).withColumn(column, of(first))
    rank = F.row_number().over(W.partitionBy("__at").orderBy(id_col)) + of(before)
    torn = dealt.filter(F.col("__at").isin(crossed)).withColumn(column, F.least(F.floor((rank - 1) / each), F.lit(world - 1)).cast("bigint"))
    return whole.unionByName(torn).select(*df.columns, column)


def repeated_batches(df: DataFrame, id_col: str, batch: int, each: int, repeats: int, seed: int = 0) -> DataFrame:
    """id, ``chunk``, ``round``, ``copy``: hash order in chunks of ``batch`` (a last partial one goes), each chunk ``repeats`` times, each row ``each`` times."""
    rank = hash_ranked(df.select(id_col), id_col, seed, "__rank")
    chunk = F.floor((F.col("__rank") - 1) / batch)
    full = df.count() // batch
    numbers = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    out = rank.withColumn("chunk", chunk).filter(F.col("chunk") < full).select(id_col, "chunk", numbers(repeats, "round"))
    return out.select(id_col, "chunk", "round", numbers(each, "copy"))


def repeated(df: DataFrame, id_col: str, times: int, seed: int = 0) -> DataFrame:
    """id, hash ``rank`` and ``copy``: each row ``times`` times."""
    return hash_ranked(df.select(id_col), id_col, seed).select(id_col, "rank", F.explode(F.sequence(F.lit(0), F.lit(times - 1))).alias("copy"))


def batches_per_step(per_device: int, devices: int, accumulation: int, generations: int) -> int:
    """Distinct prompts in a step: completions of a step over completions of a prompt."""
    total = per_device * devices * accumulation
    if total % generations:
        raise ValueError(f"{total} completions of a step cannot be divided by {generations} generations")
    return total // generations


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group; Spark limits groups in each task before the exchange."""
    rank = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= n).withColumnRenamed("__rank", "rank")


def random_per_group(df: DataFrame, group: list[str], id_col: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` rows of each group by hash order."""
    return top_per_group(df, group, [hash_key(F.col(id_col), seed), F.col(id_col)], n)


def fixed_length(points: DataFrame, group: str, index: str, n: int) -> DataFrame:
    """``n`` points of each group: the first by hash, or all of them again and again until there are ``n``.

    ``slot`` numbers them from 0.
    """
    size = points.groupBy(F.col(group).alias("__g")).agg(F.count(F.lit(1)).alias("__n"))
    order = W.partitionBy(group).orderBy(hash_key(F.col(index)), index)
    rank = points.withColumn("__rank", F.row_number().over(order) - 1).join(size, F.col(group) == F.col("__g")).filter(F.col("__rank") < n)
    slots = F.explode(F.sequence(F.col("__rank").cast("long"), F.lit(n - 1).cast("long"), F.least(F.col("__n"), F.lit(n)).cast("long")))
    return rank.withColumn("slot", slots).drop("__g", "__n", "__rank")
