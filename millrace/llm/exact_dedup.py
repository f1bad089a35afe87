"""Exact dedup: groups of equal texts by a 128-bit content hash, with a comparison of bytes inside each group."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import unused

BLANKS = " \t\n\x0b\x0c\r"


def squeezed(text: Column) -> Column:
    """The text without the characters of ``[\\x20\\x09-\\x0D]``; null becomes empty."""
    return reduce(lambda t, blank: F.replace(t, F.lit(blank), F.lit("")), BLANKS, F.coalesce(text, F.lit("")))


def _length(text: Column) -> Column:
    return F.char_length(F.coalesce(text, F.lit("")))


def _groups(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[Column], Column]) -> DataFrame:
    """One row per distinct text: ``s`` (its SHA-256), ``group_size``, and ``keep_id`` and ``most``, the id and the code points of the row that stays."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), squeezed(F.col(text_col)).alias("norm"), _length(F.col(text_col)).alias("n"))
    # One number that is larger the longer the text and then the smaller the id: a long buffer keeps the hash aggregate.
    shift = F.lit(str(1 << 65)).cast("decimal(20,0)")
    half = F.lit(str(1 << 63)).cast("decimal(20,0)")
    order = F.col("n").cast("decimal(11,0)") * shift + F.coalesce(half - F.col("doc_id").cast("decimal(20,0)"), F.lit(0))
    grouped = rows.groupBy(digest(F.col("norm")).alias("h"), "norm").agg(F.count(F.lit(1)).alias("group_size"), F.max(order.cast("decimal(38,0)")).alias("best"))
    rest = F.pmod("best", shift)
    return grouped.select(F.sha2("norm", 256).alias("s"), "group_size", F.when(rest > 0, (half - rest).cast("long")).alias("keep_id"), F.floor(F.col("best") / shift).cast("int").alias("most"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per input row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    Rows are grouped by ``digest`` of the normalised text and, inside a group,
    by its bytes, so texts whose digests collide stay apart.  The row with most
    code points in its original text stays, then the smallest id.  Only the
    first aggregation moves texts, one for each distinct text and map task; a
    copy that fills a third of the table is therefore reduced before the
    exchange, and the join back carries no text and is split by AQE when one
    key is large.

    Null text counts as empty.  A null id ranks after all others.  Rows that
    repeat an id and its text are members like others and are all marked as
    kept when that id stays.  An empty table gives an empty result; extra
    columns are ignored whatever their names.
    """
    groups = _groups(docs, id_col, text_col, digest).drop("most")
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(squeezed(F.col(text_col)), 256).alias("s"))
    return keyed.join(groups, "s").select(
        F.col("doc_id").alias(id_col), "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("s").alias("text_sha256")
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of equal texts, with all its columns: that with most code points, then the smallest id.

    Where rows repeat an id, the one that stays is told by its text as well; of
    rows that repeat both, any one stays.
    """
    stays = _groups(docs, id_col, text_col, F.md5).select("keep_id", "s", "most")
    if docs.groupBy(F.col(id_col).cast("long").alias("id")).count().filter("count > 1").isEmpty():
        # Only the right side's columns have other names, so no column of the rows is touched.
        keep = unused(docs, "keep_id")
        return docs.join(stays.select(F.col("keep_id").alias(keep)), F.col(id_col).cast("long").eqNullSafe(F.col(keep)), "left_semi")
    names = {c: unused(docs, c) for c in ("keep_id", "s", "most", "digest", "length")}
    right = stays.select(*[F.col(c).alias(names[c]) for c in ("keep_id", "s", "most")])
    told = docs.withColumns({names["digest"]: F.sha2(squeezed(F.col(text_col)), 256), names["length"]: _length(F.col(text_col))})
    same = F.col(id_col).cast("long").eqNullSafe(F.col(names["keep_id"])) & (F.col(names["digest"]) == F.col(names["s"])) & (F.col(names["length"]) == F.col(names["most"]))
    return told.join(right, same, "left_semi").dropDuplicates([names["digest"]]).drop(names["digest"], names["length"])
