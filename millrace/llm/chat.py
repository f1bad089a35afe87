"""Chat formatting: logged snapshots that are prefixes of longer conversations are collapsed before rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 256
LANES = ("a", "b", "c", "d")


def _lanes(*cols: Column) -> list[Column]:
    """A 128-bit hash as four numbers below 2**32, whose sums cannot overflow."""
    one, two = F.xxhash64(*cols), F.xxhash64(F.lit("second"), *cols)
    low = F.lit((1 << 32) - 1).cast("long")
    return [F.shiftrightunsigned(one, 32), one.bitwiseAND(low), F.shiftrightunsigned(two, 32), two.bitwiseAND(low)]


def prefixes(turns: DataFrame) -> DataFrame:
    """One row per turn with a conv_id: its position, the number of turns, and the rolling hash of the turns up to it.

    ``turns`` has conv_id, turn, role, text.  The hash of a prefix is the sum of
    the hashes of its (position, role, text), so it can be rolled in two levels:
    within runs of ``CHUNK`` turn numbers, and over the runs of a conversation.
    No task then needs more than one run of a very long conversation.
    """
    ranked = turns.filter("conv_id is not null").select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.floor(F.col("turn") / CHUNK), F.lit(-(1 << 62))).alias("run")
    )
    inside = W.partitionBy("conv_id", "run").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    runs_before = W.partitionBy("conv_id").orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy("conv_id")
    sizes = (
        ranked.groupBy("conv_id", "run").agg(F.count(F.lit(1)).alias("size"))
        .select(F.col("conv_id").alias("c1"), F.col("run").alias("r1"), F.coalesce(F.sum("size").over(runs_before), F.lit(0)).alias("skip"), F.sum("size").over(whole).alias("n_turns"))
    )
    placed = ranked.withColumn("inside", F.row_number().over(inside)).join(sizes, F.col("conv_id").eqNullSafe(F.col("c1")) & (F.col("run") == F.col("r1")))
    placed = placed.withColumn("position", F.col("inside") + F.col("skip"))
    hashed = placed.select("conv_id", "run", "turn", "role", "text", "position", "n_turns", *[h.alias(k) for k, h in zip(LANES, _lanes(F.col("position"), F.col("role"), F.col("text")), strict=True)])
    upto = W.partitionBy("conv_id", "run").orderBy("position").rowsBetween(W.unboundedPreceding, W.currentRow)
    rolled = hashed.select("conv_id", "run", "turn", "role", "text", "position", "n_turns", *[F.sum(k).over(upto).alias(k) for k in LANES])
    totals = (
        hashed.groupBy("conv_id", "run").agg(*[F.sum(k).alias(k) for k in LANES])
        .select(F.col("conv_id").alias("c2"), F.col("run").alias("r2"), *[F.coalesce(F.sum(k).over(runs_before.partitionBy("conv_id")), F.lit(0)).alias(f"before_{k}") for k in LANES])
    )
    return rolled.join(totals, F.col("conv_id").eqNullSafe(F.col("c2")) & (F.col("run") == F.col("r2"))).select(
        "conv_id", "turn", "role", "text", "position", "n_turns", *[(F.col(k) + F.col(f"before_{k}")).alias(k) for k in LANES]
    )


def singles(turns: DataFrame) -> DataFrame:
    """The turns without a conv_id as conversations of one turn each, in the form of ``prefixes``."""
    said = turns.filter("conv_id is null").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    one = F.lit(1).cast("long")
    return said.select("*", one.alias("position"), one.alias("n_turns"), *[h.alias(k) for k, h in zip(LANES, _lanes(one, F.col("role"), F.col("text")), strict=True)])


def collapse(rolled: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies and hash of the conversations that no longer one begins with; of equal ones the smallest id stays."""
    ends = rolled.filter(F.col("position") == F.col("n_turns"))
    distinct = ends.groupBy("n_turns", *LANES).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    shorter = rolled.filter(F.col("position") < F.col("n_turns")).groupBy(F.col("position").alias("n_turns"), *LANES).agg(F.count(F.lit(1)).alias("__seen")).drop("__seen")
    return distinct.join(shorter, ["n_turns", *LANES], "left_anti").select("conv_id", "n_turns", "n_copies", *LANES)


def format_chats(turns: DataFrame, head: str = "<|im_start|>", between: str = "\n", tail: str = "<|im_end|>\n") -> DataFrame:
    """conv_id, n_turns, n_copies and the rendered text of each maximal conversation.

    Turns are ordered by turn number (null first), then role and text; rows that
    repeat a turn number, even wholly, are turns of their own.  Null roles and
    texts count as empty.  A row without conv_id is a conversation of its own,
    of one turn.  A conversation with the same turns as another is a copy; the
    smallest id stays, a null id only if no other has them.  No rows give no
    rows.  A conversation's text is one value, so its turns meet in one task.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    rolled, alone = prefixes(turns), singles(turns)
    columns = ["conv_id", *[F.col(c).cast("long").alias(c) for c in ("position", "n_turns", *LANES)]]
    kept = collapse(rolled.select(*columns).unionByName(alone.select(*columns)))
    line = F.concat(F.lit(head), F.coalesce("role", F.lit("")), F.lit(between), F.coalesce("text", F.lit("")), F.lit(tail))
    said = turns.filter("conv_id is not null").withColumns({"line": line, "role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    several = (
        said.join(kept.filter("conv_id is not null").select(F.col("conv_id").alias("kept_id"), "n_turns", "n_copies"), F.col("conv_id") == F.col("kept_id"))
        .groupBy("conv_id", "n_turns", "n_copies")
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "line"))).alias("lines"))
        .select("conv_id", "n_turns", "n_copies", F.array_join(F.col("lines.line"), "").alias("rendered"))
    )
    lines = alone.groupBy(*LANES).agg(F.min(line).alias("rendered"))
    one = kept.filter("conv_id is null").join(lines, list(LANES)).select("conv_id", "n_turns", "n_copies", "rendered")
    return several.unionByName(one)
