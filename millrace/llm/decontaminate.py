"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices
from .tokens import Words, grams, words

#: Shortest match, in words, that is a tile; also the size of a seed.
MIN_MATCH = 5
#: Share of a test item's words that tiles must cover.
COVERAGE = 0.5
#: Places of seeds in items that are looked at together, about; a single text may have more.
MOST_SEEDS = 1 << 20
#: Bytes of test items that one pass over the documents carries to each task; more items take more passes.
BLOCK_BYTES = 8 << 20


class Block:
    """A block of test items, indexed by the hashes of their seeds."""

    def __init__(self, ids: list[int | None], texts: list[str | None], min_match: int):
        w = words(pa.array(texts, pa.string()))
        self.ids, self.k, self.words = ids, min_match, w.hash
        self.at = w.at
        # An item of fewer words than a match has one seed, of all of them.
        self.short = {}
        seeds, owners, places = [], [], []
        for i in range(len(ids)):
            h = w.hash[w.at[i] : w.at[i + 1]]
            k = min(len(h), min_match)
            if k:
                g = grams(h, k, 17)
                if k < min_match:
                    self.short.setdefault(k, []).append(i)
                seeds.append(g)
                owners.append(np.full(len(g), i))
                places.append(np.arange(len(g)))
        join = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        seed, owner, place = join(seeds, np.uint64), join(owners, np.int64), join(places, np.int64)
        order = np.lexsort((place, owner, seed))
        self.seed, self.owner, self.place = seed[order], owner[order], place[order]
        # A bitmap on the low bits lets most words of a document pass after one look.
        self.some = np.zeros(1 << 22, bool)
        self.some[(self.seed & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def sizes(self) -> list[int]:
        return sorted({self.k, *self.short})

    def hits(self, h: np.ndarray, k: int) -> np.ndarray:
        """Positions in ``h`` at which a seed of ``k`` words stands."""
        g = grams(h, k, 17)
        near = np.flatnonzero(self.some[(g & np.uint64((1 << 22) - 1)).astype(np.int64)])
        at = np.searchsorted(self.seed, g[near])
        at[at == len(self.seed)] = 0
        return near[self.seed[at] == g[near]] if len(self.seed) else near[:0]


def tile(test: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in ``test``, place in ``doc``, length) of the tiles.

    Again and again the longest matches among words not yet marked are marked,
    earlier ones in ``test`` and then in ``doc`` first, until none has
    ``min_match`` words.  Candidates of a length are found by their Karp-Rabin
    hashes and compared word by word.
    """
    free_test, free_doc = np.ones(len(test), bool), np.ones(len(doc), bool)
    tiles: list[tuple[int, int, int]] = []
    length = min(len(test), len(doc))
    while length >= min_match:
        a = _runs(test, free_test, length)
        found = []
        if len(a[0]):
            b = _runs(doc, free_doc, length)
            order = np.argsort(b[1], kind="stable")
            lo, hi = np.searchsorted(b[1][order], a[1], "left"), np.searchsorted(b[1][order], a[1], "right")
            found = [(int(a[0][i]), b[0][order[lo[i] : hi[i]]]) for i in np.flatnonzero(hi > lo)]
        for i, places in found:
            if not free_test[i : i + length].all():
                continue
            for j in places.tolist():
                if free_doc[j : j + length].all() and np.array_equal(test[i : i + length], doc[j : j + length]):
                    free_test[i : i + length] = free_doc[j : j + length] = False
                    tiles.append((i, j, length))
                    break
        length = _next_length(test, doc, free_test, free_doc, min_match, length - 1)
    return tiles


def _runs(h: np.ndarray, free: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the runs of ``k`` free words, and their hashes."""
    taken = np.concatenate([[0], np.cumsum(~free)])
    at = np.flatnonzero(taken[k:] == taken[:-k]) if k <= len(h) else np.zeros(0, np.int64)
    return at, grams(h, k, 23)[at] if len(at) else np.zeros(0, np.uint64)


def _next_length(test: np.ndarray, doc: np.ndarray, free_test: np.ndarray, free_doc: np.ndarray, least: int, most: int) -> int:
    """The longest common run of free words of at most ``most``; 0 if it is under ``least``. Bisected: a common run holds shorter ones."""
    lo, hi = least - 1, most
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if np.isin(_runs(test, free_test, mid)[1], _runs(doc, free_doc, mid)[1]).any():
            lo = mid
        else:
            hi = mid - 1
    return lo if lo >= least else 0


def _candidates(block: Block, w: Words, k: int) -> Iterator[np.ndarray]:
    """Distinct (text, item, place in the item) of the seeds of ``k`` words that texts hold, sorted, some texts at a time.

    A seed that a text repeats is looked up once.
    """
    at = block.hits(w.hash, k)
    doc = w.doc[at]
    inside = at + k <= w.at[doc + 1]
    at, doc = at[inside], doc[inside]
    if not len(at):
        return
    g = grams(w.hash, k, 17)[at]
    lo, hi = np.searchsorted(block.seed, g, "left"), np.searchsorted(block.seed, g, "right")
    doc, lo, hi = np.unique(np.stack([doc, lo, hi], 1), axis=0).T
    n = np.cumsum(hi - lo)
    begin = 0
    while begin < len(doc):
        # Whole texts with about MOST_SEEDS entries, one text at least.
        end = int(np.searchsorted(n, (n[begin - 1] if begin else 0) + MOST_SEEDS, "right"))
        end = int(np.searchsorted(doc, doc[min(end, len(doc) - 1)], "left")) if end < len(doc) else end
        end = max(end, int(np.searchsorted(doc, doc[begin], "right")))
        size = hi[begin:end] - lo[begin:end]
        seed = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo[begin:end], size)
        # Their union bounds what tiles can cover.
        yield np.unique(np.stack([np.repeat(doc[begin:end], size), block.owner[seed], block.place[seed]], 1), axis=0)
        begin = end


def _pairs(block: Block, w: Words, coverage: float) -> Iterator[tuple[int, int, int, int, float, list[tuple[int, int, int]]]]:
    """(text, item, words covered, words of the item, coverage, tiles) of the pairs that reach the coverage."""
    for k in block.sizes():
        for key in _candidates(block, w, k):
            first = np.flatnonzero(np.concatenate([[True], np.any(key[1:, :2] != key[:-1, :2], axis=1)]))
            # What the seeds of a pair can cover at most, for all pairs at once; only those that can reach the coverage are tiled.
            gap = np.minimum(np.diff(key[:, 2], prepend=0), k)
            gap[first] = k
            bound = np.add.reduceat(gap, first)
            owner = key[first, 1]
            size = block.at[owner + 1] - block.at[owner]
            for at in np.flatnonzero((np.minimum(size, block.k) == k) & (bound >= coverage * size)):
                d, i = int(key[first[at], 0]), int(owner[at])
                size_i = int(size[at])
                test, text = block.words[block.at[i] : block.at[i + 1]], w.hash[w.at[d] : w.at[d + 1]]
                tiles = tile(test, text, k)
                covered = sum(t[2] for t in tiles)
                if covered >= coverage * size_i:
                    yield d, i, covered, size_i, covered / size_i, tiles


#: Parts by hash that a block is made of, about.
PARTS = 16


def distinct_items(tests: DataFrame, test_id: str, test_text: str) -> DataFrame:
    """item_id, item_text, copies: each test item once; null texts are left out."""
    items = tests.select(F.col(test_id).cast("long").alias("item_id"), F.col(test_text).alias("item_text")).filter("item_text is not null")
    return items.groupBy("item_id", "item_text").agg(F.count(F.lit(1)).alias("copies"))


def blocks(items: DataFrame, most: int) -> Iterator[DataFrame]:
    """Distinct items in blocks of at most ``most`` bytes of text, or one item if that is longer.

    Items are dealt into parts by a hash, the parts are measured, and a part
    goes into the block before if both fit; a part that is too large by itself
    is dealt again by another hash.
    """
    def dealt(rows: DataFrame, total: int, salt: int) -> Iterator[tuple[DataFrame, int]]:
        parts = PARTS * math.ceil(total / most)
        place = F.pmod(F.xxhash64("item_id", "item_text", F.lit(salt)), F.lit(parts))
        sizes = rows.groupBy(place.alias("part")).agg(F.sum(F.octet_length("item_text")).alias("size"), F.count(F.lit(1)).alias("n")).collect()
        held, size = [], 0
        for r in sorted(sizes, key=lambda r: r["part"]):
            if r["size"] > most and r["n"] > 1:
                yield from dealt(rows.filter(place == r["part"]), r["size"], salt + 1)
                continue
            if held and size + r["size"] > most:
                yield rows.filter(place.isin(held)), size
                held, size = [], 0
            held.append(r["part"])
            size += r["size"]
        if held:
            yield rows.filter(place.isin(held)), size

    total = items.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    if total <= most:
        yield items
    else:
        yield from (part for part, _ in dealt(items, total, 0))


def leaks(
    docs: DataFrame, tests: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, id_col: str = "doc_id", text_col: str = "text", test_id: str = "item_id", test_text: str = "text", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per document and test item of which tiles cover ``coverage`` or more: id, ``item_id``, ``covered``, ``item_words``, ``coverage``, ``spans``.

    ``spans`` lists (place in the item, place in the document, length) in words,
    so a passage whose sentences were put in another order is found as several
    tiles.  Test items are a query set: they go to the tasks in blocks of
    bounded size, with one pass over the documents for each block, and seeds of
    ``min_match`` words shared with an item choose the documents that are tiled.

    Null and empty texts of either side match nothing.  An item of fewer words
    than ``min_match`` must occur whole.  Items or documents that repeat each
    give their rows.  Extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    items = distinct_items(tests, test_id, test_text)
    sc, found = docs.sparkSession.sparkContext, None
    for part in blocks(items, block_bytes):
        got = part.orderBy("item_id", "item_text").toArrow()
        shared = sc.broadcast(tuple(got.column(c).to_pylist() for c in ("item_id", "item_text", "copies")))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            *items, copies = shared.value
            block = Block(*items, min_match)
            for b in slices(batches, "text"):
                ids = b.column("id").to_pylist()
                out = [
                    (ids[d], block.ids[i], c, n, share, [{"item_at": x, "doc_at": y, "words": z} for x, y, z in sorted(tiles)])
                    for d, i, c, n, share, tiles in _pairs(block, words(b.column("text")), coverage) for _ in range(copies[i])
                ]
                cols = list(zip(*out, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], ["id", "item_id", "covered", "item_words", "coverage", "spans"])

        more = rows.mapInArrow(search, "id long, item_id long, covered int, item_words int, coverage double, spans array<struct<item_at:int,doc_at:int,words:int>>")
        found = more if found is None else found.unionByName(more)
    return found.withColumnRenamed("id", id_col)


_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.list_(pa.struct([("item_at", pa.int32()), ("doc_at", pa.int32()), ("words", pa.int32())]))]


def drop_leaks(docs: DataFrame, tests: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, text_col: str = "text", test_id: str = "item_id", test_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that hold no test item, with all their columns; each block of items filters what the one before left."""
    sc = docs.sparkSession.sparkContext
    for part in blocks(distinct_items(tests, test_id, test_text), block_bytes):
        got = part.orderBy("item_id", "item_text").toArrow()
        shared = sc.broadcast((got.column("item_id").to_pylist(), got.column("item_text").to_pylist()))

        def keep(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            block = Block(*shared.value, min_match)
            for b in slices(batches, text_col):
                clean = np.ones(b.num_rows, bool)
                for d, *_ in _pairs(block, words(b.column(text_col)), coverage):
                    clean[d] = False
                yield b.filter(pa.array(clean))

        docs = docs.mapInArrow(keep, docs.schema)
    return docs


