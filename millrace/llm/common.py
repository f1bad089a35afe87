"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.lineage import cut_lineage

__all__ = ["crc_bucket", "cut_lineage", "hash_fraction", "join_counted", "kept", "several_texts", "slices", "table", "unused"]


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """The named columns of one of the driver's tables."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


def unused(df: DataFrame, name: str) -> str:
    """The name, or the next longer one that no column of ``df`` has, in whatever case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key is joined by broadcast if it has more than one row in so many.
HOT_SHARE = 1000


def join_counted(rows: DataFrame, info: DataFrame, on: list[str], count: str) -> DataFrame:
    """The inner join of ``rows`` with ``info``, which has one row a key and in ``count`` how many rows have it.

    Keys with more than one row in ``HOT_SHARE``, fewer than ``HOT_SHARE`` in
    all, are broadcast, so no task gathers the rows of a common key; the others
    are joined as usual.  Both sides are read twice and should be written out.
    """
    total = info.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * HOT_SHARE > total
    common = info.filter(hot)
    rest = rows.join(F.broadcast(common.select(*on)), on, "left_anti").join(info.filter(~hot), on)
    return rows.join(F.broadcast(common), on).unionByName(rest)


def several_texts(rows: DataFrame) -> DataFrame:
    """``of``: the ids of ``rows`` (id, text) that stand with several texts."""
    text = F.xxhash64("text")
    return cut_lineage(rows.filter("id is not null").groupBy("id").agg(F.min(text).alias("least"), F.max(text).alias("most")).filter("least <> most").select(F.col("id").alias("of")))


def hash_fraction(*cols: str) -> Column:
    """A number in [0, 1) that depends on the columns' values alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def crc_bucket(col: str, n: int) -> Column:
    """crc32 of the column as text, modulo ``n``; null ids fall into bucket -1."""
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string")), F.lit(n)), F.lit(-1))


_kept: dict = {}


def kept(key, make):
    """What ``make`` gives, once for each worker; gone as soon as a kernel runs there that does not ask for it."""
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int = 1 << 20, keep: bool = False) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into runs of whole rows with about ``most`` bytes of text each.

    A longer text makes a run of its own, so it is the only case in which a
    run exceeds the bound.  At the end, what the worker has freed goes back to
    the system: workers live on between tasks, beside the executor's heap.
    """
    import numpy as np
    import pyarrow.compute as pc

    if not keep:
        _kept.clear()
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < b.num_rows:
            done = size[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(size, done + most, "right")))
            yield b.slice(at, end - at)
            at = end
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's
    if trim:
        trim(0)
