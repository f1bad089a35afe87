"""N-gram Jaccard join: MinHash candidates, pruned by their posterior, verified exactly.

Texts with the same set of word n-grams form a class, and only its smallest id
goes on.  Candidates share a band of MinHash values; with 28 bands of 4 a pair
at the threshold of 0.8 is missed once in 3 million times.  Candidates are
grouped into components by the smallest id of each bucket, components are cut
into blocks of bounded size, and a tile compares the pairs of two blocks in one
task: values are compared a few at a time, and a pair goes on only while the
posterior probability that its similarity reaches the threshold is above a
tolerance.  What is left is verified on the sets themselves.  A tile gives each
text's number of links, never its pairs.  A block by itself gives an edge for
each of its texts, and two blocks only edges between their classes that differ,
so edges grow with the texts and not with their pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, join_counted, several_texts, slices, unused
from .components import components
from .tokens import mix, seeds, shingles, words

N = 5
THRESHOLD = 0.8
BANDS, ROWS = 28, 4
#: MinHash values compared at a time, and the posterior probability under which a pair is dropped.
STEP, TOLERANCE = 16, 1e-6
#: Texts and, about, n-grams in a block; a tile holds two.
BLOCK, BLOCK_GRAMS = 512, 1 << 20


def minhash(value: np.ndarray, at: np.ndarray) -> np.ndarray:
    """[text, BANDS*ROWS] MinHash values; texts without shingles get the largest value."""
    out = np.full((len(at) - 1, BANDS * ROWS), 0xFFFFFFFF, np.uint32)
    has = np.flatnonzero(np.diff(at))
    if not len(has):
        return out
    low, high = value.astype(np.uint32), (value >> np.uint64(32)).astype(np.uint32)
    s = seeds(BANDS * ROWS, 3)
    with np.errstate(over="ignore"):
        for k in range(BANDS * ROWS):
            h = (low ^ np.uint32(s[k] & np.uint64(0xFFFFFFFF))) * np.uint32((s[k] >> np.uint64(32)) | np.uint64(1))
            h ^= h >> np.uint32(15)
            h += high
            h *= np.uint32(0x2C1B3C6D)
            h ^= h >> np.uint32(12)
            out[has, k] = np.minimum.reduceat(h, at[has])
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """[text, BANDS] 64-bit keys, different in each band."""
    with np.errstate(over="ignore"):
        key = np.zeros((len(sig), BANDS), np.uint64)
        for r, c in enumerate(seeds(ROWS, 9) | np.uint64(1)):
            key += (sig[:, r::ROWS].astype(np.uint64) + np.uint64(1)) * c
        return mix(key ^ seeds(BANDS, 21)[None, :])


@lru_cache(8)
def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest of ``n`` equal values with which a pair goes on.

    With all similarities equally likely beforehand, the probability of at least
    ``threshold`` after ``m`` of ``n`` matches is that of at most ``m`` successes
    in n+1 trials.
    """
    total = 0.0
    for m in range(n + 1):
        total += comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        if total >= tolerance:
            return m
    return n


def link_pairs(sig: np.ndarray, sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float = TOLERANCE) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) whose sets have a Jaccard similarity of ``threshold`` or more."""
    size = np.array([len(s) for s in sets])
    keep = np.minimum(size[a], size[b]) >= threshold * np.maximum(size[a], size[b]) - 1e-9
    a, b = a[keep], b[keep]
    same = np.zeros(len(a), np.int64)
    for lo in range(0, sig.shape[1], STEP):
        same += (sig[a, lo : lo + STEP] == sig[b, lo : lo + STEP]).sum(axis=1)
        keep = same >= least_matches(lo + STEP, threshold, tolerance)
        a, b, same = a[keep], b[keep], same[keep]
    if not len(a):
        return a, b
    if len(a) <= 64:
        both = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(a.tolist(), b.tolist(), strict=True)])
    else:
        # All intersections at once, as products of the texts' rows over the shingles that two texts or more hold.
        used, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        owner = np.repeat(np.arange(len(used)), size[used])
        _, where, times = np.unique(np.concatenate([sets[i] for i in used]), return_inverse=True, return_counts=True)
        many = times > 1
        column = (np.cumsum(many) - 1)[where]
        owner, column = owner[many[where]], column[many[where]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        product = np.zeros((len(used), len(used)), np.float32)
        for lo in range(0, int(many.sum()), 8192):
            i, j = np.searchsorted(column, [lo, lo + 8192])
            part = np.zeros((len(used), min(8192, int(many.sum()) - lo)), np.float32)
            part[owner[i:j], column[i:j] - lo] = 1
            product += part @ part.T
        both = np.rint(product[place[: len(a)], place[len(a) :]]).astype(np.int64)
    keep = both >= threshold * (size[a] + size[b] - both) - 1e-9
    return a[keep], b[keep]


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each one's component."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _signatures(docs: DataFrame, n: int) -> DataFrame:
    """id, 128-bit digest of the set, its size, and MinHash values as bytes; texts without words are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            value, at = shingles(words(b.column("text")), n)
            sig = minhash(value, at)
            size = np.diff(at)
            lanes = []
            for salt in seeds(2, 40):
                with np.errstate(over="ignore"):
                    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(value ^ salt))])
                lanes.append(mix(sums[at[1:]] - sums[at[:-1]]).view(np.int64))
            has = np.flatnonzero(size)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(has)), pa.array(lanes[0][has]), pa.array(lanes[1][has]), pa.array(size[has].astype(np.int32)), pa.array([x.tobytes() for x in sig[has]], pa.binary())], ["id", "d1", "d2", "size", "sig"])

    return docs.mapInArrow(run, "id long, d1 long, d2 long, size int, sig binary")


def _bands(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
            ids = np.repeat(b.column("id").to_numpy(zero_copy_only=False), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(band_keys(sig).ravel().view(np.int64)), pa.array(ids)], ["key", "id"])

    return reps.select("id", "sig").mapInArrow(run, "key long, id long")


def similar(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``class_id``, ``n_links`` of each row.

    A link joins two documents whose sets of word ``n``-grams have a Jaccard
    similarity of ``threshold`` or more; ``class_id`` is the smallest id of those
    that links connect, ``n_links`` the number of a document's links, exact
    copies included.

    A text of fewer than ``n`` words has one n-gram, of all its words.  Null,
    empty and wordless texts, and rows with a null id, have no links and are
    their own class.  Rows that repeat an id are joined as one document if their
    texts are equal; else each text has its links and the id may stand in two
    classes.  Extra columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    several = several_texts(rows)
    if several.isEmpty():
        return _similar(rows, n, threshold).withColumnRenamed("id", id_col)
    found = _by_text(rows, several, n, threshold)
    return found.select(F.col("id").alias(id_col), F.col("first.id").alias("class_id"), "n_links")


def _with_node(rows: DataFrame, several: DataFrame) -> DataFrame:
    """``rows`` and ``node``: a number of each text that shares its id with others, else the id."""
    marked = rows.join(several, F.col("id") == F.col("of"), "left")
    return marked.withColumn("node", F.when(F.col("of").isNotNull(), F.xxhash64("id", "text")).otherwise(F.col("id"))).drop("of")


def _by_text(rows: DataFrame, several: DataFrame, n: int, threshold: float) -> DataFrame:
    """node, id, first (id, node), n_links of each row, if texts rather than ids are joined; ``first`` is the smallest of the class."""
    named = _with_node(rows, several)
    found = cut_lineage(_similar(named.select(F.col("node").alias("id"), "text"), n, threshold).withColumnRenamed("id", "node"))
    real = named.filter("node <> id").select(F.col("node").alias("of"), "id").distinct()
    texts = cut_lineage(found.join(real, F.col("node") == F.col("of"), "left").select("node", F.coalesce("id", "node").alias("id"), "class_id", "n_links"))
    firsts = cut_lineage(texts.groupBy(F.col("class_id").alias("of")).agg(F.min(F.struct("id", "node")).alias("first")))
    return texts.join(firsts, F.col("class_id").eqNullSafe(F.col("of"))).select("node", "id", "first", "n_links")


def _similar(rows: DataFrame, n: int, threshold: float) -> DataFrame:
    """``similar`` of rows (id, text) of which an id has one text."""
    named, nameless = rows.filter("id is not null"), rows.filter("id is null").select("id")
    base = cut_lineage(_signatures(named, n))
    members = cut_lineage(base.select("id", "d1", "d2").distinct())
    sets = cut_lineage(members.groupBy("d1", "d2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("members")))
    one = sets.select(F.col("rep").alias("id"), "d1", "d2", "members")
    reps = cut_lineage(base.join(one, ["id", "d1", "d2"]).select("id", "members", "size", "sig"))
    bands = _bands(reps)
    buckets = bands.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("other")).filter("pivot <> other").select("key", "pivot")
    stars = bands.join(buckets, "key").filter("id <> pivot").select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct()
    found = cut_lineage(_tiles(named, reps, components(stars), n, threshold))
    edges = found.filter("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    class_of = components(edges).select(F.col("node").alias("rep"), F.col("root").alias("class_id"))
    links = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    known = cut_lineage(
        sets.join(class_of, "rep", "left").join(links, "rep", "left")
        .select("d1", "d2", "members", F.coalesce("class_id", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("members") - 1).alias("n_links"))
    )
    each = join_counted(members, known, ["d1", "d2"], "members").select(F.col("id").alias("of"), "class_id", "n_links")
    # Rows without words have no line in ``each``.
    out = named.select("id").join(each, F.col("id") == F.col("of"), "left")
    out = out.select("id", F.coalesce("class_id", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.unionByName(nameless.select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def _tiles(rows: DataFrame, reps: DataFrame, near: DataFrame, n: int, threshold: float) -> DataFrame:
    """id, links, root: the documents that each text is linked with in a tile, and, where ``root`` is set, a smaller text that links connect it with."""
    placed = cut_lineage(reps.join(near, F.col("id") == F.col("node")).select("id", "root", "members", "size", "sig"))
    blocks = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("size") / BLOCK_GRAMS)).cast("int")
    sizes = cut_lineage(placed.groupBy("root").agg(F.count(F.lit(1)).alias("texts"), blocks.alias("blocks")))
    member = join_counted(placed, sizes, ["root"], "texts").select(F.col("id").alias("mid"), "root", "blocks", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"), "members", "sig")
    # The sets are made anew from the texts of candidates rather than kept for all texts.
    texts = rows.join(member, F.col("id") == F.col("mid")).select("id", "root", "blocks", "block", "members", "sig", "text")

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            value, at = shingles(words(b.column("text")), n)
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(value.view(np.int64)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("id", "root", "blocks", "block", "members", "sig")], lists], ["id", "root", "blocks", "block", "members", "sig", "grams"])

    made = texts.mapInArrow(to_sets, "id long, root long, blocks int, block int, members long, sig binary, grams array<long>")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    tiles = made.select("*", other).select("id", "root", "block", "members", "sig", "grams", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def compare(t: pa.Table) -> pa.Table:
        t = t.take(pa.array(np.unique(t.column("id").to_numpy(), return_index=True)[1]))
        ids, weight, block = (t.column(c).to_numpy() for c in ("id", "members", "block"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint32).reshape(-1, BANDS * ROWS)
        lists = t.column("grams").combine_chunks()
        value, at = lists.values.to_numpy(), lists.offsets.to_numpy()
        sets = [value[x:y] for x, y in zip(at[:-1], at[1:], strict=True)]
        # Where one block has no text here, what the other holds is compared in its own tile.
        own = t.column("i")[0].as_py() == t.column("j")[0].as_py()
        a, b = np.triu_indices(len(ids) if own or len(np.unique(block)) > 1 else 0, 1)
        a, b = link_pairs(sig, sets, a, b, threshold)
        inside = block[a] == block[b]
        root = _roots(len(ids), a[inside], b[inside])
        if own:
            tail = np.flatnonzero(root != np.arange(len(ids)))
            head = root[tail]
        else:
            a, b = a[~inside], b[~inside]
            over = _roots(len(ids), root[a], root[b])
            tail = np.flatnonzero(over != np.arange(len(ids)))
            head = over[tail]
        links = np.bincount(a, weights=weight[b], minlength=len(ids)) + np.bincount(b, weights=weight[a], minlength=len(ids))
        root = np.full(len(ids), -1)
        root[tail] = head
        has = (links > 0) | (root >= 0)
        return pa.table({"id": ids[has], "links": links[has].astype(np.int64), "root": pa.array(ids[root[has]], mask=root[has] < 0)})

    return tiles.groupBy("root", "i", "j").applyInArrow(compare, "id long, links long, root long")


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that are the smallest id of their class; rows with a null id stay.

    Where an id has several texts, each is kept or dropped for its own class.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    several = several_texts(rows)
    if several.isEmpty():
        gone = _similar(rows, n, threshold).filter(F.col("class_id") != F.col("id")).select(F.col("id").alias(unused(docs, "gone")))
        return docs.join(gone, F.col(id_col).cast("long") == F.col(gone.columns[0]), "left_anti")
    of, node, gone_name = (unused(docs, c) for c in ("of", "node", "gone"))
    gone = _by_text(rows, several, n, threshold).filter(F.col("first.node") != F.col("node")).select(F.col("node").alias(gone_name)).distinct()
    marked = docs.join(several.withColumnRenamed("of", of), F.col(id_col).cast("long") == F.col(of), "left")
    number = F.when(F.col(of).isNotNull(), F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))).otherwise(F.col(id_col).cast("long"))
    return marked.withColumn(node, number).join(gone, F.col(node) == F.col(gone_name), "left_anti").drop(of, node)
