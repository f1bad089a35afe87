"""Substring dedup: repeated passages go, the earliest occurrence stays.

Lines are hashed as units, and runs of repeated lines go.  Passages of
``PASSAGE`` words or more are also found wherever they begin and end.  Each
window of that many words picks the first of its smallest hashes of ``GRAM``
words, so equal windows pick equal hashes; neighbouring windows that pick the
same place are a run, and only runs that pick a hash that others pick as well
are compared, window by window where they differ.

A document is a text with its id.  Documents are told apart and ranked by
``rank``, the id, and ``text_key``, which is 0 where an id has one text and else
a hash of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut_lineage, several_texts, slices
from .tokens import Words, grams, mix, text_bytes, words

#: Words that a run of neighbouring repeated lines must have to be removed.
MIN_WORDS = 30
#: Words from which a repeated passage is removed wherever it begins and ends.
PASSAGE = 51
#: Words of a hash that a window picks; it has 32 of them.
GRAM = 20
#: Bytes of text that are unpacked together, about.
SLICE = 1 << 20
#: Stands for a null id, which ranks last.
LAST = (1 << 63) - 1
_KEY = "rank long, text_key long"


def ranked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """rank, text_key, text of each row."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    several = several_texts(rows)
    alone = F.lit(0).cast("long")
    if not several.isEmpty():
        rows = rows.join(several, F.col("id") == F.col("of"), "left")
        alone = F.when(F.col("of").isNull(), 0).otherwise(F.xxhash64("text"))
    return rows.select(F.coalesce("id", F.lit(LAST)).alias("rank"), F.when(F.col("id").isNull(), F.xxhash64("text")).otherwise(alone).alias("text_key"), "text")


def _both(high: np.ndarray, low: np.ndarray, bits: int = 32) -> pa.Array:
    """Two numbers as one, so that rows that are moved between tasks are short; the second has ``bits`` bits."""
    return pa.array(high.astype(np.int64) << bits | low.astype(np.int64))


def _high(both: str, bits: int = 32) -> Column:
    return F.shiftright(both, bits).cast("int")


def _low(both: str, bits: int = 32) -> Column:
    return F.col(both).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")


def _keys(b: pa.RecordBatch, at: np.ndarray) -> list[pa.Array]:
    """rank and text_key of the texts ``at``."""
    return [b.column(c).take(pa.array(at)) for c in ("rank", "text_key")]


def cut(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lines of all texts as (text, first byte, end)."""
    data, offset = text_bytes(texts)
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    ends = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offset[1:]]))
    ends = ends[ends > 0]
    starts = np.concatenate([[0], ends[:-1]])
    return np.searchsorted(offset, starts, "right") - 1, starts, ends


def _digests(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first byte, end, words, 128-bit digest of the words) of the units that have words."""
    data, _ = text_bytes(texts)
    doc, start, end = cut(texts)
    if not len(doc):
        return doc, start, end, np.zeros(0, np.int64), np.zeros((2, 0), np.int64)
    at = np.append(start, end[-1]).astype(np.int64)
    units = pa.Array.from_buffers(pa.large_string(), len(doc), [None, pa.py_buffer(at), pa.py_buffer(data)])
    w = words(units)
    count = np.diff(w.at)
    place = np.arange(len(w.hash), dtype=np.uint64) - np.repeat(w.at[:-1], count).astype(np.uint64)
    lanes = []
    for salt in (0x51ED270B7F3A, 0x9C2F6A1B33D7):
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(w.hash ^ mix(place + np.uint64(salt))))])
            lanes.append(mix(sums[w.at[1:]] - sums[w.at[:-1]]).view(np.int64))
    has = count > 0
    return doc[has], start[has], end[has], count[has], np.stack(lanes)[:, has]


def units(rows: DataFrame) -> DataFrame:
    """The lines of ``ranked`` rows that have words: number, ``place`` (first word and words), ``span`` (offsets in code points of the original text), digest, and whether the text has it for the first time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            data, offset = text_bytes(b.column("text"))
            doc, start, end, count, (d1, d2) = _digests(b.column("text"))
            points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
            began = points[offset[doc]]
            order = np.lexsort((start, d2, d1, doc))
            same = np.zeros(len(doc), bool)
            o, p = order[1:], order[:-1]
            same[o] = (doc[o] == doc[p]) & (d1[o] == d1[p]) & (d2[o] == d2[p])
            head = np.searchsorted(doc, doc, "left")
            number = np.arange(len(doc)) - head
            before = np.cumsum(count) - count
            word = before - before[head]
            yield pa.RecordBatch.from_arrays(
                [*_keys(b, doc), pa.array(number.astype(np.int32)), _both(word, count), _both(points[start] - began, points[end] - began), pa.array(d1), pa.array(d2), pa.array(~same)],
                ["rank", "text_key", "unit_no", "place", "span", "d1", "d2", "first"],
            )

    return rows.mapInArrow(run, f"{_KEY}, unit_no int, place long, span long, d1 long, d2 long, first boolean")


def repeated_spans(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per span that is to be removed: id, ``text_key``, ``span_start``, ``span_end`` (code points of the original text), ``n_words``, ``first_doc``.

    Units are lines; equal ones have the same words in lower case.  Digests are
    grouped over all documents with partial minima, so a line that a third of
    the rows hold is reduced in each task.  The earliest occurrence is that in
    the smallest id, and there the first; all others are repeats.  A run of
    neighbouring repeats with ``min_words`` words or more is a span;
    ``first_doc`` is the smallest id among the earliest occurrences of its
    lines.  With ``min_words=1`` all but the earliest occurrence of each line
    go; shorter runs stay by default, since clean texts share short lines.

    Null and empty texts have no units.  Texts that share an id are documents of
    their own, and ``text_key`` tells them apart; it is 0 where an id has one
    text.  Rows that repeat an id and its text are one document, so both stay or
    lose the same spans.  A null id ranks last, and texts without an id are
    documents of their own as well.
    """
    return _named(_unit_spans(ranked(docs, id_col, text_col), min_words), id_col)


def _named(spans: DataFrame, id_col: str, *more: Column) -> DataFrame:
    real = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return spans.select(real("rank").alias(id_col), "text_key", "span_start", "span_end", "n_words", real("first_doc").alias("first_doc"), *more)


def _unit_spans(rows: DataFrame, min_words: int) -> DataFrame:
    """The spans of ``repeated_spans``, by rank and text_key, with the number of their first word; ``first_doc`` is ``LAST`` for a null id."""
    all_units = units(rows)
    own = F.struct("rank", "text_key")
    # Written out, so that both sides of the join are dealt anew and AQE can split a common line.
    shared = cut_lineage(all_units.filter("first").groupBy("d1", "d2").agg(F.min(own).alias("earliest"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    # A unit is a repeat if another document has it first, or this one had it before.
    again = (
        all_units.join(shared, ["d1", "d2"], "left")
        .withColumn("earliest", F.coalesce("earliest", own))
        .filter((own != F.col("earliest")) | ~F.col("first"))
        .select("rank", "text_key", "unit_no", _high("place").alias("word"), _low("place").alias("words"), _high("span").alias("start"), _low("span").alias("end"), F.col("earliest.rank").alias("first_doc"))
    )
    order = W.partitionBy("rank", "text_key").orderBy("unit_no")
    # Rows that repeat an id and its text have each unit several times; its words count once.
    once = F.when(F.col("unit_no") == F.lag("unit_no").over(order), 0).otherwise(F.col("words"))
    runs = again.withColumns({"run": F.col("unit_no") - F.dense_rank().over(order), "words": once})
    return (
        runs.groupBy("rank", "text_key", "run")
        .agg(F.min("word").alias("word"), F.min("start").alias("span_start"), F.max("end").alias("span_end"), F.sum("words").alias("n_words"), F.min("first_doc").alias("first_doc"))
        .filter(F.col("n_words") >= min_words)
        .drop("run")
    )


class Windows(NamedTuple):
    doc: np.ndarray  # text of each window
    word: np.ndarray  # number of its first word in the text
    hash: np.ndarray
    start: np.ndarray  # code points of the text
    end: np.ndarray
    pick: np.ndarray  # of each run: the hash that its windows pick
    first: np.ndarray  # of each run: its first window
    n: np.ndarray  # of each run: its windows


def windows(w: Words) -> Windows | None:
    """All windows of ``PASSAGE`` words, and the runs of those that pick the same place."""
    many = np.maximum(np.diff(w.at) - PASSAGE + 1, 0)
    doc = np.repeat(np.arange(len(many)), many)
    if not len(doc):
        return None
    word = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    at = w.at[doc] + word
    gram = grams(w.hash, GRAM, 61)
    # The first of the smallest hashes among 1, 2, 4, ... from each place on.
    place, step = np.arange(len(gram)), 1
    while step < PASSAGE - GRAM + 1:
        place = np.where(gram[place[step:]] < gram[place[:-step]], place[step:], place[:-step])
        step *= 2
    place = place[at]
    new = np.ones(len(at), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1])
    first = np.flatnonzero(new)
    # Lower case has the same number of code points.
    points = np.concatenate([[0], np.cumsum((w.data & 0xC0) != 0x80)])
    began = points[w.offset[doc]]
    return Windows(doc, word, grams(w.hash, PASSAGE, 62)[at], points[w.start[at]] - began, points[w.end[at + PASSAGE - 1]] - began, gram[place[first]], first, np.diff(np.append(first, len(at))))


def _window_runs(rows: DataFrame) -> DataFrame:
    """A row for each run of windows: what they pick, a digest of them all, ``place`` (number of the first word, and windows), ``span`` (offsets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            v = windows(words(b.column("text")))
            if v is None:
                continue
            k = np.arange(len(v.doc)) - np.repeat(v.first, v.n)
            digest = mix(np.add.reduceat(mix(v.hash ^ mix(k.astype(np.uint64))), v.first))
            end = v.end[v.first + v.n - 1]
            yield pa.RecordBatch.from_arrays(
                [*_keys(b, v.doc[v.first]), pa.array(v.pick.view(np.int64)), pa.array(digest.view(np.int64)), _both(v.word[v.first], v.n, 8), _both(v.start[v.first], end)],
                ["rank", "text_key", "pick", "digest", "place", "span"],
            )

    return rows.mapInArrow(run, f"{_KEY}, pick long, digest long, place long, span long")


def _packed(rows: DataFrame) -> DataFrame:
    """rank, text_key, size, packed: the texts that can hold a window, each compressed, since the join that follows moves them all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = pa.Codec("zstd", compression_level=1)
        for b in slices(batches, "text"):
            data, offset = text_bytes(b.column("text"))
            size = np.diff(offset)
            some = np.flatnonzero(size >= 2 * PASSAGE - 1)
            packed = [codec.compress(data[offset[i] : offset[i + 1]], asbytes=True) for i in some.tolist()]
            yield pa.RecordBatch.from_arrays([*_keys(b, some), pa.array(size[some]), pa.array(packed, pa.binary())], ["rank", "text_key", "size", "packed"])

    return rows.mapInArrow(run, f"{_KEY}, size long, packed binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same with ``text``, in runs of rows with about SLICE bytes of text each."""
    codec = pa.Codec("zstd")
    for b in batches:
        ends = np.cumsum(b.column("size").to_numpy())
        at = 0
        while at < b.num_rows:
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            part = b.slice(at, end - at)
            texts = [codec.decompress(x.as_buffer(), n.as_py()).to_pybytes().decode() for x, n in zip(part.column("packed"), part.column("size"), strict=True)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in ("rank", "text_key", "wanted")], pa.array(texts, pa.large_string())], ["rank", "text_key", "wanted", "text"])
            at = end


def _single_windows(rows: DataFrame) -> DataFrame:
    """A row for each window of the runs whose first words ``wanted`` numbers; half of what it picks tells windows of equal hash apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _unpacked(batches):
            v = windows(words(b.column("text")))
            if v is None:
                continue
            wanted = b.column("wanted")
            key = np.repeat(np.arange(b.num_rows), np.diff(wanted.offsets.to_numpy())) << 32 | wanted.flatten().to_numpy().astype(np.int64)
            some = np.repeat(np.isin(v.doc[v.first] << 32 | v.word[v.first], key), v.n)
            yield pa.RecordBatch.from_arrays(
                [*_keys(b, v.doc[some]), pa.array(np.repeat(v.pick.astype(np.uint32).view(np.int32), v.n)[some]), pa.array(v.hash[some].view(np.int64)), pa.array(v.word[some].astype(np.int32)), _both(v.start[some], v.end[some])],
                ["rank", "text_key", "pick", "hash", "word", "span"],
            )

    return rows.mapInArrow(run, f"{_KEY}, pick int, hash long, word int, span long")


def _passage_spans(rows: DataFrame) -> DataFrame:
    """Stretches of windows that stand earlier, in the form of ``_unit_spans``; a window that overlaps its earliest occurrence stays."""
    runs = _window_runs(rows)
    # Written out, so that both sides of the joins are dealt anew and AQE can split a common passage.
    picks = cut_lineage(runs.groupBy("pick").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("pick"))
    shared = cut_lineage(runs.join(picks, "pick").withColumns({"word": _high("place", 8), "n": _low("place", 8)}).drop("place"))
    own = F.struct("rank", "text_key")
    earliest = F.min(F.struct("rank", "text_key", "word")).alias("first")
    kinds = cut_lineage(shared.groupBy("pick", "digest").agg(earliest))
    firsts = F.struct("first.rank", "first.text_key")
    later = (own > firsts) | ((own == firsts) & (F.col("word") >= F.col("first.word") + PASSAGE))
    columns = ["rank", "text_key", "word", "n_words", _high("span").alias("span_start"), _low("span").alias("span_end"), F.col("first.rank").alias("first_doc")]
    placed = shared.join(kinds, ["pick", "digest"])
    whole = placed.filter(later).withColumn("n_words", F.col("n") + F.lit(PASSAGE - 1).cast("long")).select(*columns)
    # Where runs of one pick differ, the earliest of each kind, and what overlaps it, is compared window by window.
    differ = cut_lineage(kinds.groupBy("pick").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("pick"))
    early = placed.filter(~later).select("pick", "rank", "text_key", "word")
    wanted = early.join(differ, "pick", "left_semi").groupBy(F.col("rank").alias("of"), F.col("text_key").alias("of_text")).agg(F.collect_set("word").alias("wanted"))
    texts = _packed(rows).join(wanted, (F.col("rank") == F.col("of")) & (F.col("text_key") == F.col("of_text"))).select("rank", "text_key", "size", "packed", "wanted")
    single = cut_lineage(_single_windows(texts))
    known = cut_lineage(single.groupBy("pick", "hash").agg(earliest, F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n"))
    parts = single.join(known, ["pick", "hash"]).filter(later).withColumn("n_words", F.lit(PASSAGE).cast("long")).select(*columns)
    return whole.unionByName(parts)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The spans of ``repeated_spans``, joined with all other passages of ``PASSAGE`` words or more that stand earlier word for word.

    The latter need not begin or end with a line.  A passage that overlaps its
    own earliest occurrence in a text stays as far as that reaches.  Spans that
    touch or overlap are one, with the smallest ``first_doc`` of its parts.
    ``rule`` says what found a span: ``line``, ``passage``, or both.
    """
    rows = ranked(docs, id_col, text_col)
    spans = _unit_spans(rows, min_words).withColumn("by", F.lit(1)).unionByName(_passage_spans(rows).withColumn("by", F.lit(2)))
    spans = spans.withColumn("after", F.col("word") + F.col("n_words"))
    order = W.partitionBy("rank", "text_key").orderBy("word", "after")
    reached = F.max("after").over(order.rowsBetween(W.unboundedPreceding, -1))
    apart = spans.withColumn("apart", F.coalesce((F.col("word") > reached).cast("int"), F.lit(1)))
    one = apart.withColumn("span", F.sum("apart").over(order.rowsBetween(W.unboundedPreceding, 0)))
    joined = one.groupBy("rank", "text_key", "span").agg(
        F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), (F.max("after") - F.min("word")).alias("n_words"), F.min("first_doc").alias("first_doc"), F.bit_or("by").alias("by")
    )
    return _named(joined, id_col, F.when(F.col("by") == 1, "line").when(F.col("by") == 2, "passage").otherwise("line, passage").alias("rule"))


def remove_repeats(docs: DataFrame, min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text", find: Callable[..., DataFrame] = repeated_passages) -> DataFrame:
    """id, the text without its repeated spans, and ``kept``: the (start, end) in the original text of what is left, in order.

    ``find=repeated_spans`` removes repeated lines only.  Each row loses the
    spans of its own text, also where ids repeat or are null; a null text gives
    an empty one.
    """
    no_spans = F.array().cast("array<struct<span_start:int,span_end:int>>")
    spans = find(docs, min_words, id_col, text_col).select(F.coalesce(id_col, F.lit(LAST)).alias("of"), F.col("text_key").alias("of_text"), "span_start", "span_end")
    spans = spans.groupBy("of", "of_text").agg(F.sort_array(F.collect_list(F.struct("span_start", "span_end"))).alias("gone"))
    rows = ranked(docs, id_col, text_col).withColumn("text", F.coalesce("text", F.lit("")))
    joined = rows.join(spans, (F.col("rank") == F.col("of")) & (F.col("text_key") == F.col("of_text")), "left").withColumn("gone", F.coalesce("gone", no_spans))
    starts = F.concat(F.array(F.lit(0)), F.col("gone.span_end"))
    ends = F.concat(F.col("gone.span_start"), F.array(F.char_length("text")))
    kept = F.filter(F.arrays_zip(starts.alias("start"), ends.alias("end")), lambda k: k["start"] < k["end"])
    parts = F.transform("kept", lambda k: F.substring(F.col("text"), k["start"] + 1, k["end"] - k["start"]))
    real = F.when(F.col("rank") != LAST, F.col("rank"))
    return joined.withColumn("kept", kept).select(real.alias(id_col), F.array_join(parts, "").alias(text_col), "kept")
