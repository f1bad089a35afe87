"""Spelling variants: words one edit apart, found in blocks of a forward and a reversed sorted dictionary."""

from __future__ import annotations

import re
import string
import zlib
from collections import Counter
from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, slices

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: Distinct words that a task counts before it passes them on.
MOST_COUNTED = 1 << 18
#: Words of a block that are compared with each other; larger blocks are subdivided.
BLOCK = 256
#: Pairs that are compared at a time, times the length of their words.
WORK = 1 << 22
#: Words longer than that are compared one by one.
LONG = 256
#: No common prefix is that long.
OPEN = (1 << 31) - 1


def word_counts(docs: DataFrame, min_length: int = 5, min_count: int = 3, faults: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``word`` and ``n``, its occurrences, for the words of all texts: maximal runs of Latin letters up to U+00FF, A-Z in lower case.

    With ``faults``, spelling faults are planted first: where that number divides
    the crc32 h of ``<id>:<word>``, the word loses its code point at h modulo its
    length.  Words shorter than ``min_length`` or rarer than ``min_count`` are
    left out.  Each task counts before rows are exchanged, up to a bound of
    distinct words.  A null text has no words, and a null id counts as empty.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for b in slices(batches, "text"):
            for doc, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                own = Counter(RUN.findall(text or ""))
                if not own:
                    continue
                crc = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in own.items():
                    word = word.lower() if word.isascii() else word.translate(_LOWER)
                    if faults and not (h := zlib.crc32(word.encode(), crc)) % faults:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                    if len(word) >= min_length:
                        total[word] += n
            if len(total) >= MOST_COUNTED:
                yield _counted(total)
                total.clear()
        yield _counted(total)

    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def _counted(total: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])


#: What tells a block: ``more`` (0: pairs of equal length, one letter is replaced; 1: one is longer by a letter), ``m`` (the shorter length),
#: how many letters are shared at the beginning and the end, what those are, and the prefix that no pair of the block may share.
PLACE = ("more", "m", "a", "b", "below")
KEY = (*PLACE, "front", "back")


def _half(row: dict[str, Column]) -> Column:
    """How many letters of what is not known to be shared one edit leaves intact at one end: half of them, or the larger half if one is added."""
    return F.floor((row["m"] - row["a"] - row["b"] + row["more"]) / 2).cast("int")


def _halved(rows: DataFrame) -> DataFrame:
    """Each row twice: in the block of those that share the first half of what is between prefix and suffix, and in that of the last half.

    A pair that shares both halves is found in the first; ``below`` keeps it out of the second.
    """
    half = _half({c: F.col(c) for c in PLACE})
    first = F.struct((F.col("a") + half).alias("a"), F.col("b"), F.col("below"))
    last = F.struct(F.col("a"), (F.col("b") + half).alias("b"), F.least(F.col("below"), F.col("a") + half).cast("int").alias("below"))
    return rows.select("word", "n", "more", "m", F.explode(F.array(first, last)).alias("to")).select("word", "n", "more", "m", "to.*")


def _keyed(rows: DataFrame) -> DataFrame:
    """With the shared ends: the beginning as it stands, which sorts forward, and the end reversed."""
    return rows.withColumns({"front": F.substring(F.col("word"), F.lit(1), F.col("a")), "back": F.substring(F.reverse("word"), F.lit(1), F.col("b"))})


def blocks(words: DataFrame, min_length: int = 5, block: int = BLOCK) -> list[DataFrame]:
    """The blocks of both dictionaries: each word once for each length of a partner and each end, with the columns of ``KEY``.

    One edit leaves half of a word intact, at its beginning or at its end, so
    two near words stand in one block of the forward dictionary (a prefix of
    half the length) or of the reversed one (a suffix).  Blocks of more than
    ``block`` words are subdivided: what is between the shared ends has one edit
    as well, so half of that is intact.  In the end at most one letter is free,
    so blocks are no larger than the alphabet.  Sizes are counted with partial
    sums, so no task holds or reads a large block.
    """
    length = F.char_length("word")
    partner = F.array(F.struct(F.lit(0).alias("more"), length.alias("m")), F.struct(F.lit(1).alias("more"), length.alias("m")), F.struct(F.lit(1).alias("more"), (length - 1).alias("m")))
    rows = words.select("word", "n", F.explode(partner).alias("p")).select("word", "n", "p.*").filter(F.col("m") >= min_length)
    todo = _halved(rows.withColumns({"a": F.lit(0), "b": F.lit(0), "below": F.lit(OPEN)}))
    out = []
    while True:
        keyed = _keyed(todo).withColumn("block", F.xxhash64(*KEY))
        open_ended = _half({c: F.col(c) for c in PLACE}) > 0
        large = cut_lineage(keyed.filter(open_ended).groupBy("block").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") > block).select("block"))
        if large.isEmpty():
            return [*out, keyed.drop("block")]
        out.append(keyed.join(large, "block", "left_anti").drop("block"))
        todo = cut_lineage(_halved(keyed.join(large, "block", "left_semi").drop("block", "front", "back")))


def near_words(words: DataFrame, min_length: int = 5, block: int = BLOCK) -> DataFrame:
    """``word``, ``n``, ``n_near`` (words that differ by exactly one inserted, deleted or replaced code point), and ``near_n`` and ``near``, the one of largest n, of equals the smallest.

    ``words`` has each word once and is read several times.
    """
    found = None
    for rows in blocks(words, min_length, block):
        scanned = rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY).select("word", "n", *KEY).mapInArrow(_scan, "word string, n_near long, near_n long, near string")
        found = scanned if found is None else found.unionByName(scanned)
    every = words.select("word", "n").unionByName(found, allowMissingColumns=True)
    best = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near"))).alias("best")
    grouped = every.groupBy("word").agg(F.max("n").alias("n"), F.coalesce(F.sum("n_near"), F.lit(0)).alias("n_near"), best)
    return grouped.select("word", "n", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.near").alias("near"))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reads blocks in order and compares the words of each; the last block of a batch waits for the next one."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        rows = pa.Table.from_batches([b] if rest is None else [rest, b]).combine_chunks()
        ends = _ends(rows)
        at = int(ends[-2]) if len(ends) > 1 else 0
        if at:
            yield _compared(rows.slice(0, at), ends[:-1])
        rest = rows.slice(at).combine_chunks().to_batches()[0]
    if rest is not None and rest.num_rows:
        rows = pa.Table.from_batches([rest])
        yield _compared(rows, _ends(rows))


def _ends(rows: pa.Table) -> np.ndarray:
    """Where blocks end."""
    new = np.zeros(rows.num_rows - 1, bool)
    for c in KEY:
        v = rows.column(c).to_numpy()
        new |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new) + 1, rows.num_rows)


def _compared(rows: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
    words, n = rows.column("word").to_numpy(), rows.column("n").to_numpy()
    more, m, below = (rows.column(c).to_numpy() for c in ("more", "m", "below"))
    sizes = np.diff(ends, prepend=0)
    partners = np.repeat(ends, sizes) - np.arange(len(words)) - 1
    left, right = [], []
    # Words of one length and kind at a time, so that letters stand in a matrix of that width.
    for kind in np.unique(np.stack([more, m]), axis=1).T.tolist():
        own = np.flatnonzero((more == kind[0]) & (m == kind[1]) & (partners > 0))
        if not len(own):
            continue
        i, width = 0, kind[1] + kind[0]
        total = np.cumsum(partners[own])
        while i < len(own):
            done = int(total[i - 1]) if i else 0
            j = max(i + 1, int(np.searchsorted(total, done + WORK // width, "right")))
            some = own[i:j]
            x = np.repeat(some, partners[some])
            y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(partners[some]) - partners[some], partners[some])
            near = _near(words, x, y, *kind, below[x])
            left.append(x[near])
            right.append(y[near])
            i = j
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (left, right))
    x, y = np.concatenate([x, y]), np.concatenate([y, x])
    rank = np.empty(len(words), np.int64)
    rank[np.argsort(words, kind="stable")] = np.arange(len(words))
    order = np.lexsort((rank[y], -n[y], x))
    x, y = x[order], y[order]
    first = np.flatnonzero(np.diff(x, prepend=-1))
    count = np.diff(np.append(first, len(x)))
    return pa.RecordBatch.from_arrays([pa.array(words[x[first]], pa.string()), pa.array(count, pa.int64()), pa.array(n[y[first]], pa.int64()), pa.array(words[y[first]], pa.string())], ["word", "n_near", "near_n", "near"])


def _near(words: np.ndarray, x: np.ndarray, y: np.ndarray, more: int, m: int, below: np.ndarray) -> np.ndarray:
    """Which of the pairs are one edit apart and share fewer letters at the beginning than ``below``."""
    if m > LONG:
        return np.array([_one_edit(words[i], words[j], more) < limit for i, j, limit in zip(x.tolist(), y.tolist(), below.tolist(), strict=True)], bool)
    low, high = min(x[0], y[0]), max(x[-1], y.max()) + 1
    letters = np.array(words[low:high].tolist(), f"U{m + 1}").view(np.uint32).reshape(-1, m + 1)
    if not more:
        differ = letters[x - low, :m] != letters[y - low, :m]
        return (differ.sum(1) == 1) & (differ.argmax(1) < below)
    longer = letters[:, m] > 0
    one = longer[x - low] != longer[y - low]
    swap = longer[x - low]
    s, t = letters[np.where(swap, y, x) - low], letters[np.where(swap, x, y) - low]
    differ = s[:, :m] != t[:, :m]
    prefix = np.where(differ.any(1), differ.argmax(1), m)
    after = (s[:, :m] != t[:, 1:]) & (np.arange(m) >= prefix[:, None])
    return one & ~after.any(1) & (prefix < below)


def _one_edit(a: str, b: str, more: int) -> int:
    """The length of the common prefix of two different words if they are one edit of that kind apart; else no limit is above it."""
    a, b = sorted((a, b), key=len)
    p = len(commonprefix([a, b]))
    return p if len(b) - len(a) == more and a[p + 1 - more :] == b[p + 1 :] else OPEN


def roots(forms: DataFrame) -> DataFrame:
    """``word`` and ``root``, where its forms lead in the end, for the rows (``word``, ``form``) of words that have a form.

    A form has at least twice its word's count, so there are no circles and
    paths are short; each round goes on by the path that the round before has found.
    """
    now = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        far = now.select(F.col("word").alias("of"), F.col("root").alias("far"))
        new = cut_lineage(now.join(far, F.col("root") == F.col("of"), "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        now = new.select("word", "root")
        if new.filter("moved").isEmpty():
            return now


def variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, faults: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of the texts with their commoner spelling: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    Two words are near if one code point inserted, deleted or replaced makes
    one the other.  A word's ``form`` is its near word of largest n (of equals
    the smallest in code-point order) if that n is at least twice its own, else
    null; ``root`` is where forms lead, the word itself if it has none.

    Null and empty texts have no words; a text that stands twice counts twice.
    An empty table gives an empty result; other columns are ignored.
    """
    words = cut_lineage(word_counts(docs, min_length, min_count, faults, id_col, text_col))
    common = F.col("near_n") >= 2 * F.col("n")
    near = cut_lineage(near_words(words, min_length).select("word", F.when(common, F.col("near")).alias("form"), "n", "n_near", F.when(common, F.col("near_n")).alias("form_n")))
    ends = roots(near.filter("form is not null"))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
