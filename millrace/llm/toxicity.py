"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, hash_fraction, slices
from .tokens import mix, seeds, words

#: Hash space of the features.
BITS = 20
#: Labelled rows that the weights are learned from, about, and an eighth more at most; they are chosen by a hash of id and text.
ROWS = 12000
#: Features of those rows that reach the driver, at most; with more, fewer rows are learned from.
FEATURES = 1 << 25
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 0.5
#: Distances between the two words of a pair: 1 is a bigram, more a skip-gram.
GAPS = (1, 2, 3)


def _features(h: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, feature) of the words, then of the pairs at each distance."""
    shift = np.uint64(64 - BITS)
    salts = seeds(len(GAPS) + 1, 77)
    yield doc, (mix(h ^ salts[0]) >> shift).astype(np.int32)
    for k, gap in enumerate(GAPS):
        if len(h) > gap:
            with np.errstate(over="ignore"):
                pair = mix(h[:-gap] * np.uint64(3) + h[gap:] + salts[k + 1])
            same = doc[:-gap] == doc[gap:]
            yield doc[:-gap][same], (pair[same] >> shift).astype(np.int32)


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The distinct features of each text, sorted, and where each text's begin."""
    w = words(texts)
    parts = [d.astype(np.int64) << BITS | f for d, f in _features(w.hash, w.doc)]
    key = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int64)
    return (key & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(key >> BITS, np.arange(len(texts) + 1))


def ftrl(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) learned from rows of distinct features.

    Each coordinate has its own rate, from the sum of its squared gradients, and
    stays at zero until the sum of its gradients exceeds L1.  The bias has no
    penalty.
    """
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bz = bn = 0.0
    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            x = rows[i]
            zx, nx = z[x], n[x]
            root = np.sqrt(nx)
            w = np.where(np.abs(zx) > L1, -(zx - np.sign(zx) * L1) / ((BETA + root) / ALPHA + L2), 0.0)
            b = -bz / ((BETA + bn**0.5) / ALPHA)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + b, -35, 35))) - labels[i]
            z[x] = zx + g - (np.sqrt(nx + g * g) - root) / ALPHA * w
            n[x] = nx + g * g
            bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / ALPHA * b
            bn += g * g
    w = np.where(np.abs(z) > L1, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)
    at = np.flatnonzero(w)
    return at.astype(np.int32), w[at].astype(np.float32), float(-bz / ((BETA + bn**0.5) / ALPHA))


def train(docs: DataFrame, labels: DataFrame, rows: int = ROWS, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from about ``rows`` of the labelled documents, whole texts.

    ``labels`` (doc_id, toxic): rows with a null in either column teach nothing;
    a document with several labels counts as toxic if one says so.  The ids are
    chosen by a hash among all labelled ones, so those that are broadcast are
    bounded by ``rows``.  Each text of an id teaches once, however often it
    stands there.  Texts are learned from in the order of a hash of id and text
    while they are no more than an eighth over ``rows`` and have ``features``
    features in all, so what reaches the driver is bounded also when ids repeat
    and texts are very long.  Without labelled rows the weights are empty and
    the bias is 0.
    """
    usable = labels.filter("doc_id is not null and toxic is not null").select(F.col("doc_id").alias("id"), "toxic")
    total = usable.count()
    if not total:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0
    # A bound on ids holds for the broadcast: the share is of all labelled rows.
    chosen = usable.filter(hash_fraction("id") < rows / total).groupBy("id").agg((F.max("toxic") > 0).cast("double").alias("y"))
    joined = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id")).select("id", "text", "y", F.xxhash64("text").alias("t"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            value, at = text_features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("t"), b.column("y"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(value, pa.int32()))], ["id", "t", "y", "x"])

    made = cut_lineage(joined.mapInArrow(extract, "id long, t long, y double, x array<int>").withColumn("place", hash_fraction("id", "t")))
    if not made.groupBy("id", "t").count().filter("count > 1").isEmpty():
        made = cut_lineage(made.dropDuplicates(["id", "t"]))
    most = rows + rows // 8
    sizes = made.select("place", "id", "t", F.size("x").alias("n")).orderBy("place", "id", "t").limit(most + 1).toPandas()
    beyond = sizes["place"][(sizes["n"].cumsum() > features) | (sizes.index >= most)]
    if len(beyond):
        made = made.filter(F.col("place") < float(beyond.iloc[0]))
    got = made.drop("place").toArrow().sort_by([("id", "ascending"), ("t", "ascending")]).combine_chunks()
    if not got.num_rows:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0
    lists = got.column("x").combine_chunks()
    value, at = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    return ftrl([value[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], got.column("y").to_numpy())


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``score`` (0 to 1, higher: toxic is likelier) and ``predicted`` (1 from 0.5) of each row's whole text.

    Each distinct feature of a text counts once.  A null, empty or wordless text
    gets the score of the bias alone.  The weights that are broadcast are those
    that L1 left, 2**BITS at most.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, weight, bias = shared.value
        dense = np.zeros(1 << BITS, np.float32)
        dense[at] = weight
        some = dense != 0
        for b in slices(batches, "text"):
            w = words(b.column("text"))
            hits = []
            for d, f in _features(w.hash, w.doc):
                hit = some[f]
                hits.append(d[hit].astype(np.int64) << BITS | f[hit])
            key = np.unique(np.concatenate(hits))
            total = np.bincount(key >> BITS, weights=dense[key & ((1 << BITS) - 1)], minlength=b.num_rows) + bias
            p = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], ["id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, score double, predicted int").withColumnRenamed("id", id_col)
