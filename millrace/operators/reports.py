"""Aggregations behind evaluation and training reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring

#: US dollars for 1,000 prompt and completion tokens.
PRICES = {
    "gpt-3.5-turbo-0613": (0.0015, 0.002), "gpt-3.5-turbo-1106": (0.0010, 0.002), "gpt-4-0613": (0.03, 0.06),
    "gpt-4-1106-preview": (0.01, 0.03), "gpt-4-0125-preview": (0.03, 0.06), "gpt-4.1": (0.002, 0.008),
}


def counts(df: DataFrame, key: str, digits: int = 2) -> DataFrame:
    """``n`` and ``percent`` of each key."""
    by = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = by.agg(F.sum("n").alias("__total"))
    return by.crossJoin(F.broadcast(total)).withColumn("percent", F.round(100 * F.col("n") / F.col("__total"), digits)).drop("__total")


def confusions(df: DataFrame, category: str, truth: str, said: str) -> DataFrame:
    return df.groupBy(category, truth, said).agg(F.count(F.lit(1)).alias("n"))


def nested(df: DataFrame, outer: str, inner: str, item: str) -> DataFrame:
    """Each ``outer`` with its ``inner`` keys, sorted, and each one's items, sorted."""
    lists = df.groupBy(outer, inner).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return lists.groupBy(outer).agg(F.sort_array(F.collect_list(F.struct(F.col(inner).alias("key"), "items"))).alias("groups"))


def accuracy_valid(correct: Column, valid: Column) -> Column:
    """Percent correct of the valid rows; 0 without any. An aggregate."""
    return F.coalesce(100 * F.try_divide(F.sum((correct & valid).cast("int")), F.sum(valid.cast("int"))), F.lit(0.0))


def accuracy_pair(correct: Column, valid: Column) -> list[Column]:
    """Aggregates ``accuracy`` (of all rows) and ``clean_accuracy`` (of the valid ones), percent; both 0 if none is valid."""
    n_valid = F.sum(valid.cast("int"))
    share = lambda good, n: F.coalesce(F.when(n_valid > 0, 100 * F.try_divide(F.sum(good.cast("int")), n)), F.lit(0.0))
    return [share(correct, F.count(F.lit(1))).alias("accuracy"), share(correct & valid, n_valid).alias("clean_accuracy")]


def mean_score(score: Column) -> Column:
    """The mean of scores from 0 on; 0 without any. An aggregate."""
    return F.coalesce(F.avg(F.when(score >= 0, score)), F.lit(0.0))


def cost(df: DataFrame, model: str = "model") -> DataFrame:
    """Tokens and dollars by model; null dollars for a model without a price."""
    prices = df.sparkSession.createDataFrame([(k, *v) for k, v in PRICES.items()], "__model string, __prompt double, __completion double")
    sums = df.groupBy(model).agg(F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"))
    dollars = (F.col("prompt_tokens") * F.col("__prompt") + F.col("completion_tokens") * F.col("__completion")) / 1000
    return sums.join(F.broadcast(prices), F.col(model) == F.col("__model"), "left").withColumn("dollars", dollars).drop("__model", "__prompt", "__completion")


def threshold_accuracy(value: Column, over: float = 0.5) -> Column:
    """Percent of values above ``over``. An aggregate."""
    return F.avg((value > over).cast("int")) * 100


def coverage(df: DataFrame, group: list[str], share: str, truths: str, least: float) -> DataFrame:
    """Mean coverage and percent of at least ``least``, of rows with truths, by group and overall (nulls in the keys)."""
    valid = df.filter(F.col(truths) > 0)
    sets = valid.groupingSets([[F.col(g) for g in group], []], *[F.col(g) for g in group])
    return sets.agg(F.count(F.lit(1)).alias("n"), F.avg(share).alias("coverage"), (100 * F.avg((F.col(share) >= least).cast("int"))).alias("accuracy"))


def step_means(df: DataFrame, step: Column, values: list[str]) -> DataFrame:
    """Means of the values by step, as a metric buffer gives them when it is flushed."""
    return df.groupBy(step.alias("step")).agg(*[F.avg(v).alias(v) for v in values])


def group_lists(df: DataFrame, group: list[str], order: list[Column], lists: list[str], first: str) -> DataFrame:
    """Each group's values as lists in order, and the first value of ``first``."""
    rows = F.sort_array(F.collect_list(F.struct(*order, *[F.col(c).alias(f"__{c}") for c in [*lists, first]])))
    out = df.groupBy(*group).agg(rows.alias("__rows"))
    return out.select(*group, *[F.col("__rows")[f"__{c}"].alias(f"{c}s") for c in lists], F.element_at(F.col("__rows")[f"__{first}"], 1).alias(first))


def function_means(df: DataFrame, group: list[str], rewards: list[str]) -> DataFrame:
    """One row: the mean of each reward, of their sum, and of the groups' sample deviations of the sum."""
    total = sum((F.col(r) for r in rewards[1:]), F.col(rewards[0]))
    by = df.withColumn("__total", total).groupBy(*group).agg(F.count(F.lit(1)).alias("n"), *[F.sum(r).alias(r) for r in [*rewards, "__total"]], F.stddev_samp("__total").alias("__std"))
    return by.agg(*[(F.sum(r) / F.sum("n")).alias(r) for r in rewards], (F.sum("__total") / F.sum("n")).alias("reward"), F.avg(F.coalesce("__std", F.lit(0.0))).alias("reward_std"))


def batch_summary(df: DataFrame, ok: Column, seconds: str, items: str) -> DataFrame:
    good = ok.cast("bigint")
    return df.agg(F.count(F.lit(1)).alias("total"), F.coalesce(F.sum(good), F.lit(0)).alias("succeeded"), F.coalesce(F.sum(1 - good), F.lit(0)).alias("failed"), F.avg(F.when(ok, F.col(seconds))).alias("mean_seconds"), F.coalesce(F.sum(F.when(ok, F.col(items))), F.lit(0)).alias("items"))


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """group, ``dim``, ``centre``: mean vectors, one row for each dimension, from partial sums."""
    return df.select(group, F.posexplode(vector).alias("dim", "v")).groupBy(group, "dim").agg(F.avg("v").alias("centre"))


def spread(df: DataFrame, group: str, vector: str) -> DataFrame:
    """group, ``spread``: the mean distance of the rows' vectors to the centroid; a vector is moved once, whole."""
    centres = centroids(df, group, vector).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("dim", "centre"))).alias("__c"))
    squares = F.zip_with(vector, F.col("__c.centre"), lambda v, c: (v.cast("double") - c) * (v.cast("double") - c))
    distance = F.sqrt(F.aggregate(squares, F.lit(0.0), lambda total, x: total + x))
    return df.select(group, vector).join(centres, group).groupBy(group).agg(F.avg(distance).alias("spread"))


def correct_summary(both: Column, one: Column, other: Column) -> list[Column]:
    return [F.sum(c.cast("bigint")).alias(n) for c, n in ((both, "both"), (one, "first"), (other, "second"))]


def feature_means(df: DataFrame, point: str, vector: str, weight: str, size: int) -> DataFrame:
    """Each point's mean vector over the views that see it; zeros if none does."""
    seen = df.filter(F.col(weight) > 0).select(point, F.posexplode(vector).alias("dim", "v")).groupBy(point, "dim").agg(F.avg("v").alias("v"))
    rows = seen.groupBy(point).agg(F.sort_array(F.collect_list(F.struct("dim", "v"))).alias("__rows")).withColumnRenamed(point, "__p")
    return df.select(point).distinct().join(rows, F.col(point) == F.col("__p"), "left").select(point, F.coalesce(F.col("__rows.v"), F.array_repeat(F.lit(0.0), size)).alias("feature"))


def fitness(points: DataFrame, nearest: str, limit: float) -> DataFrame:
    """Share of points with a neighbour within ``limit``, and the root mean square distance of those."""
    inside = F.col(nearest) <= limit
    return points.agg(F.avg(inside.cast("int")).alias("fitness"), F.sqrt(F.avg(F.when(inside, F.col(nearest) ** 2))).alias("rmse"))


def best_example(df: DataFrame, category: str, truth: str, said: str, item: str, top: int = 3) -> DataFrame:
    """For the ``top`` categories: the commonest confusion and its first item; ties by name."""
    pairs = df.groupBy(category, truth, said).agg(F.count(F.lit(1)).alias("n"), F.min(item).alias("example"))
    best = W.partitionBy(category).orderBy(F.desc("n"), truth, said)
    sizes = df.groupBy(F.col(category).alias("__c")).agg(F.count(F.lit(1)).alias("__size")).orderBy(F.desc("__size"), "__c").limit(top)
    return pairs.withColumn("__rank", F.row_number().over(best)).filter("__rank = 1").join(F.broadcast(sizes), F.col(category) == F.col("__c")).drop("__rank", "__c", "__size")


def answer_votes(df: DataFrame, keys: list[str], answer: str) -> DataFrame:
    """The votes for each mathematical answer of a group: ``keys``, ``form``, ``votes``, ``spellings``, ``rank``.

    Answers count as one if they have one canonical form, or, where they have
    none, one plain spelling.  Rows are reduced to distinct answers before they
    are put into forms, so a common answer is parsed once and moved once a task.
    ``rank`` is 1 for the form with most votes, of equals the smallest form.  A
    null answer has the form null.
    """
    distinct = df.groupBy(*keys, F.col(answer).alias("said")).agg(F.count(F.lit(1)).alias("votes"))
    forms = distinct.groupBy(*keys, scoring.math_key(F.col("said")).alias("form")).agg(F.sum("votes").alias("votes"), F.count("said").alias("spellings"))
    return forms.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("votes"), F.asc_nulls_last("form"))))


def meteor(df: DataFrame, truth: str, said: str, synonyms: DataFrame | None = None) -> DataFrame:
    """``df`` with ``meteor``; ``synonyms`` (word, synset), words in lower case, is joined to the words that rows have.

    Rows with equal texts are scored once.  Synsets of a row's words are
    gathered beside its digest, so the table of synonyms may be of any size and
    no text is exploded more than once.  A null text has no score.
    """
    names = {"said": "__said", "truth": "__truth"}
    pairs = df.select(F.col(truth).alias("truth"), F.col(said).alias("said")).distinct().withColumn("key", F.sha2(F.to_json(F.struct("truth", "said")), 256))
    none = F.lit(None).cast("array<struct<word:string,synset:string>>")
    if synonyms is None:
        known = pairs.withColumn("synsets", none)
    else:
        words = pairs.select("key", F.explode(F.array_distinct(F.split(F.lower(F.concat_ws(" ", "truth", "said")), r"\s+"))).alias("word"))
        sets = synonyms.select("word", F.col("synset").cast("string").alias("synset")).distinct()
        found = words.join(sets, "word").groupBy("key").agg(F.collect_list(F.struct("word", "synset")).alias("synsets"))
        known = pairs.join(found, "key", "left")
    scored = known.select(F.col("truth").alias(names["truth"]), F.col("said").alias(names["said"]), scoring.meteor("truth", "said", "synsets").alias("meteor"))
    same = F.col(truth).eqNullSafe(F.col(names["truth"])) & F.col(said).eqNullSafe(F.col(names["said"]))
    return df.join(scored, same).drop(names["truth"], names["said"])
