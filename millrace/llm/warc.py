"""WARC: a fixity audit of replicas with Merkle trees over records and ordered offset ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage

#: Children of a node, as a power of two, and page ids in one file.
FAN_BITS = 4
PAGES_PER_FILE = 256
#: Files over which rows without an id are spread.
SPARE_FILES = 1 << 24


def record(page_id: Column, url: Column, html: Column) -> Column:
    """The page as a WARC response record."""
    body = F.coalesce(html, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def archive(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) laid out as WARC files: file, seq, record_offset, length, page_id, digest.

    A file holds PAGES_PER_FILE neighbouring ids, in the order of id, url and
    digest; a record's offset is the length of those before it.  Rows without
    an id are spread over files of their own, below 0, by a hash of their
    content.  Null url and html count as empty; repeated rows are records of
    their own.
    """
    text = record(F.col("page_id"), F.col("url"), F.col("html"))
    file = F.coalesce(F.floor(F.col("page_id") / PAGES_PER_FILE), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(SPARE_FILES)))
    rows = pages.select(file.cast("long").alias("file"), F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.octet_length(text).cast("long").alias("length"), F.sha2(text, 256).alias("digest"))
    order = W.partitionBy("file").orderBy(F.col("page_id").asc_nulls_last(), "url", "digest")
    before = F.coalesce(F.sum("length").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.select("file", (F.row_number().over(order) - 1).cast("long").alias("seq"), before.alias("record_offset"), "length", "page_id", "digest")


class Tree:
    """The levels of a replica's Merkle tree, from records up.

    A node covers an ordered range of offsets: 16 neighbouring records of a
    file, then 16 such ranges, up to the file, and above that 16 neighbouring
    files, up to one root.  Its hash is that of its children's places and hashes.
    Each level is made once, from the one below, and written out.
    """

    def __init__(self, records: DataFrame, file_levels: int, levels: int):
        leaf = records.select("file", F.col("seq").alias("node"), F.sha2(F.concat_ws(":", "record_offset", "length", "digest"), 256).alias("hash"))
        self.levels = [leaf]
        for k in range(levels):
            below = self.levels[-1]
            up = parent(k, file_levels)
            self.levels.append(cut_lineage(
                below.select(*[e.alias(c) for c, e in up.items()], F.struct("file", "node", "hash").alias("child"))
                .groupBy("file", "node").agg(F.sort_array(F.collect_list("child")).alias("children"))
                .select("file", "node", F.sha2(F.concat_ws("|", F.transform("children", lambda c: F.concat_ws(":", c["file"], c["node"], c["hash"]))), 256).alias("hash"))
            ))


def parent(level: int, file_levels: int) -> dict[str, Column]:
    """The place of the node above, for a node of that level."""
    if level < file_levels:
        return {"file": F.col("file"), "node": F.shiftright("node", FAN_BITS)}
    return {"file": F.shiftright("file", FAN_BITS), "node": F.col("node")}


def _levels(most: int) -> int:
    return max(1, -(-max(most, 1).bit_length() // FAN_BITS))


def audit(left: DataFrame, right: DataFrame) -> DataFrame:
    """Where two replicas (as ``archive`` gives them) differ: file, record_offset, length, page_id, status, left_digest, right_digest.

    Roots are compared first; at each level only the children of nodes that
    differ are joined, down to the records.  ``status`` is ``corrupt`` if both
    have a record there, ``missing`` if only the left one has, ``extra`` if only
    the right one has.  Equal replicas, and two empty ones, give no rows.
    """
    left, right = cut_lineage(left), cut_lineage(right)
    far = left.unionByName(right).agg(F.max("seq").alias("seq"), F.max("file").alias("top"), F.min("file").alias("low")).first()
    file_levels = _levels(far["seq"] or 0)
    # Shifting takes a negative file to -1 at last, so the files below 0 and the others end in two roots.
    levels = file_levels + _levels(max(abs(far["top"] or 0), abs(far["low"] or 0)))
    a, b = Tree(left, file_levels, levels).levels, Tree(right, file_levels, levels).levels
    wrong = None
    for k in range(levels, -1, -1):
        one, two = a[k], b[k]
        if wrong is not None:
            up = parent(k, file_levels)
            on = (up["file"] == F.col("pf")) & (up["node"] == F.col("pn"))
            one, two = one.join(wrong, on, "left_semi"), two.join(wrong, on, "left_semi")
        both = one.select("file", "node", F.col("hash").alias("l")).join(two.select("file", "node", F.col("hash").alias("r")), ["file", "node"], "full")
        wrong = both.filter(~F.col("l").eqNullSafe(F.col("r"))).select(F.col("file").alias("pf"), F.col("node").alias("pn"))
        if k:
            wrong = cut_lineage(wrong)
    on = (F.col("file") == F.col("pf")) & (F.col("seq") == F.col("pn"))
    sides = [side.join(wrong, on, "left_semi") for side in (left, right)]
    one, two = (side.select("file", "seq", *[F.col(c).alias(f"{c}_{n}") for c in ("record_offset", "length", "page_id", "digest")]) for n, side in zip("lr", sides, strict=True))
    status = F.when(F.col("digest_l").isNull(), "extra").when(F.col("digest_r").isNull(), "missing").otherwise("corrupt")
    return one.join(two, ["file", "seq"], "full").select(
        "file", *[F.coalesce(f"{c}_l", f"{c}_r").alias(c) for c in ("record_offset", "length", "page_id")], status.alias("status"), F.col("digest_l").alias("left_digest"), F.col("digest_r").alias("right_digest")
    )


def with_bit_rot(pages: DataFrame) -> DataFrame:
    """A replica in which the first character of about one page in a hundred, chosen by a hash of its id, has gone bad; lengths stay."""
    chosen = F.pmod("page_id", F.lit(1 << 31)) * 2654435761 % (1 << 32) % 101 == 7
    bad = chosen & (F.length("html") > 0)
    return pages.withColumn("html", F.when(bad, F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html")))
