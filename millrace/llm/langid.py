"""Language ID by prediction by partial matching: frozen byte context trees score exact code lengths.

For each language a tree of byte contexts of length 0 to ``ORDER`` holds how
often each byte followed each context.  A byte is coded by the longest context
that the tree has; a byte that never followed it costs an escape and is coded
by the next shorter one, down to a uniform choice among 256 (method C: an
escape has the weight of the number of distinct followers).  Statistics are
frozen after training, so the cost of a byte depends on the ``ORDER`` bytes
before it alone, and a text's code length is a sum over a table.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_fraction, slices
from .tokens import text_bytes

ORDER = 3
#: Labelled rows that a language's tree is learned from, about: rows are chosen by a hash of their id.
ROWS_PER_LANGUAGE = 1500
#: Bytes of the costs of languages whose tables are held at once, about; one language may need more.
BLOCK_BYTES = 192 << 20
#: Bytes of text that are scored with one block of languages before the next is built, about.
TEXT_BYTES = 16 << 20
#: A text whose best code needs more bits for a byte than this is in no learned language: the uniform code does better.
MOST_BITS = 8.0


class Learned(NamedTuple):
    languages: list[str]
    blocks: list  # of languages in order: one Model, or each block's counts, from which its Model is built where it is used


class Model(NamedTuple):
    languages: list[str]
    symbol: np.ndarray  # of each byte; all bytes never seen share the last symbol, since they are coded alike
    symbols: int
    row: np.ndarray  # by three symbols: the row of that context in ``cost``
    cost: np.ndarray  # [row, symbol, language]: bits


def _codes(data: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Each byte with the three before it as one 32-bit number; texts begin after three zero bytes."""
    x = data.astype(np.uint32)
    at = np.arange(len(x)) - np.repeat(offset[:-1], np.diff(offset))
    code = x.copy()
    for k in range(1, ORDER + 1):
        before = np.zeros(len(x), np.uint32)
        before[k:] = x[:-k] if k < len(x) else 0
        before[at < k] = 0
        code |= before << np.uint32(8 * k)
    return code


def count_contexts(labelled: DataFrame) -> DataFrame:
    """lang, code, n: how often each run of four bytes occurs in the texts of a language; counted in the tasks, then summed."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            langs = b.column("lang").dictionary_encode()
            for k, lang in enumerate(langs.dictionary.to_pylist()):
                texts = b.column("text").filter(pc.equal(langs.indices, k))
                code, n = np.unique(_codes(*text_bytes(pc.utf8_lower(texts))), return_counts=True)
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(code)), "code": code.astype(np.int64), "n": n.astype(np.int64)})

    return labelled.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def build(languages: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """The tables of a model from each language's (codes, counts)."""
    seen = np.zeros(256, bool)
    seen[0] = True
    for code, _ in counts.values():
        seen[np.unique(code & 255)] = True
    symbol = np.full(256, int(seen.sum()), np.int64)
    symbol[seen] = np.arange(int(seen.sum()))
    byte = np.append(np.flatnonzero(seen), -1)
    size = len(byte)
    width = size

    kept = np.unique(np.concatenate([code >> 8 for code, _ in counts.values()])).astype(np.int64)
    as_symbols = (symbol[kept >> 16] * width + symbol[kept >> 8 & 255]) * width + symbol[kept & 255]
    # Rows: the kept contexts, then one row for each pair of symbols, for contexts whose last three bytes are not kept.
    row = np.tile(len(kept) + np.arange(width * width), width).astype(np.int32)
    row[as_symbols] = np.arange(len(kept))
    cost = np.empty((len(kept) + width * width, width, len(languages)), np.float32)
    for j, lang in enumerate(languages):
        code, n = counts[lang]
        bits = np.full((1, width), 8.0)
        for order in range(ORDER + 1):
            # The tree's nodes of this depth, as (context, follower) with counts.
            key, inverse = np.unique(code & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            times = np.bincount(inverse, weights=n)
            context, group = np.unique(key >> 8, return_inverse=True)
            weight = np.bincount(group, weights=times) + np.bincount(group)
            escape = np.log2(weight) - np.log2(np.bincount(group))
            if order < ORDER:
                want = np.zeros(1, np.int64) if order == 0 else np.repeat(byte, width ** (order - 1)) if order == 1 else (byte[:, None] * 256 + byte[None, :]).ravel()
                if order == 2:
                    want[(byte < 0).repeat(width) | np.tile(byte < 0, width)] = -1
                shorter = np.zeros(len(want), np.int64) if order < 2 else np.tile(np.arange(width), width)
            else:
                want, shorter = kept, symbol[kept >> 8 & 255] * width + symbol[kept & 255]
            here = bits[shorter].copy()
            at = np.searchsorted(context, want)
            at[at == len(context)] = 0
            known = (context[at] == want) & (want >= 0) if len(context) else np.zeros(len(want), bool)
            here[known] += escape[at[known]][:, None]
            back = np.full(len(context), -1)
            back[at[known]] = np.flatnonzero(known)
            at_key = back[group]
            has = at_key >= 0
            here[at_key[has], symbol[key[has] & 255]] = np.log2(weight[group[has]]) - np.log2(times[has])
            if order == 2:
                cost[len(kept) :, :, j] = here
            if order == ORDER:
                cost[: len(kept), :, j] = here
            bits = here
    return Model(languages, symbol.astype(np.int32), width, row, cost)


def in_blocks(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> list[dict[str, tuple[np.ndarray, np.ndarray]]]:
    """The languages in order, as many to a block as ``BLOCK_BYTES`` holds costs of, one at least."""
    blocks: list[dict] = []
    contexts = followers = np.zeros(0, np.int64)
    for lang, (code, n) in sorted(counts.items()):
        c, f = np.union1d(contexts, code >> 8), np.union1d(followers, code & 255)
        width = len(f) + 2
        if not blocks or (len(c) + width * width) * width * 4 * (len(blocks[-1]) + 1) > BLOCK_BYTES:
            blocks.append({})
            c, f = np.unique(code >> 8), np.unique(code & 255)
        blocks[-1][lang] = (code, n)
        contexts, followers = c, f
    return blocks


def train(labelled: DataFrame, rows_per_language: int = ROWS_PER_LANGUAGE) -> Learned:
    """A model of all languages of ``labelled`` (doc_id, text, lang).

    Rows with null or empty text or null lang teach nothing.  Each language is
    learned from about ``rows_per_language`` rows, whole texts, chosen by a hash
    of the id among all its rows; this bounds what reaches the driver, which is
    the counts of byte runs.
    """
    usable = labelled.filter("text is not null and text <> '' and lang is not null")
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}
    if not sizes:
        return Learned([], [])
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, rows_per_language / v))])
    chosen = usable.filter(hash_fraction("doc_id") < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(0.0)))
    counted = count_contexts(chosen).toArrow()
    lang, code, n = (counted.column(c).to_numpy() if c != "lang" else np.array(counted.column(c).to_pylist(), object) for c in ("lang", "code", "n"))
    languages = sorted(set(lang.tolist()))
    order = np.argsort(lang, kind="stable")
    ends = np.searchsorted(lang[order], languages, "right") if languages else []
    blocks = in_blocks({x: (code[at], n[at]) for x, at in zip(languages, np.split(order, ends[:-1]), strict=True)} if languages else {})
    return Learned(languages, [build(list(b), b) for b in blocks] if len(blocks) == 1 else blocks)


def code_lengths(model: Model, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bits that each language's code needs for each text, and the number of bytes."""
    data, offset = text_bytes(pc.utf8_lower(pc.fill_null(texts, "")))
    bits = np.zeros((len(texts), len(model.languages)))
    w = model.symbols
    block = 1 << 20
    for lo in range(0, len(data), block):
        hi = min(len(data), lo + block)
        # The three bytes before a block count as context, unless another text begins.
        back = min(ORDER, lo)
        s = model.symbol[data[lo - back : hi]].astype(np.int64)
        n = hi - lo
        pad = np.full(ORDER - back, model.symbol[0])
        s = np.concatenate([pad, s])
        p1, p2, p3 = s[2 : 2 + n].copy(), s[1 : 1 + n].copy(), s[:n].copy()
        for begin in offset[(offset > lo - ORDER) & (offset < hi)]:
            for k, p in ((1, p1), (2, p2), (3, p3)):
                at = np.arange(max(lo, begin), min(hi, begin + k)) - lo
                p[at] = model.symbol[0]
        each = model.cost[model.row[(p3 * w + p2) * w + p1], s[ORDER:]]
        doc = np.searchsorted(offset, lo, "right") - 1
        cuts = offset[(offset > lo) & (offset < hi)]
        starts = np.unique(np.concatenate([[lo], cuts])) - lo
        owners = np.searchsorted(offset, starts + lo, "right") - 1
        assert owners[0] >= doc
        bits[owners] += np.add.reduceat(each, starts, axis=0, dtype=np.float64)
    return bits, np.diff(offset)


def _scored(learned: Learned, batches: Iterator[pa.RecordBatch], text: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each batch with what ``code_lengths`` gives for all languages; one block of languages is held at a time."""

    def of(held: list[pa.RecordBatch]):
        bits: list[list[np.ndarray]] = [[] for _ in held]
        for block in learned.blocks:
            model = block if isinstance(block, Model) else build(list(block), block)
            for k, b in enumerate(held):
                each, _ = code_lengths(model, b.column(text))
                bits[k].append(each)
        for b, each in zip(held, bits, strict=True):
            size = np.diff(text_bytes(pc.utf8_lower(pc.fill_null(b.column(text), "")))[1])
            yield b, np.concatenate([np.zeros((b.num_rows, 0)), *each], axis=1), size

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if len(learned.blocks) < 2 or size >= TEXT_BYTES:
            yield from of(held)
            held, size = [], 0
    yield from of(held)


def identify(docs: DataFrame, model: Learned, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``lang_pred``, ``score`` and ``bits_per_byte`` of each row's whole text.

    ``lang_pred`` is the language with the shortest code, of equals the first in
    the alphabet; ``und`` (score 0) if the text is null, empty or without a
    letter, or if nothing was learned.  ``score`` is the posterior probability
    of that language, all being equally likely beforehand.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the rows that each language is learned from

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b, bits, size in _scored(m, slices(batches, "text"), "text"):
            texts = b.column("text")
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            if m.languages:
                best = bits.argmin(axis=1)
                least = bits[np.arange(len(bits)), best]
                with np.errstate(over="ignore", under="ignore"):
                    p = 1 / np.exp2(np.minimum(least[:, None] - bits, 0)).sum(axis=1)
                rate = np.where(size > 0, least / np.maximum(size, 1), 0.0)
                names = np.array([*m.languages, "und"], object)[np.where(letters, best, len(m.languages))]
                p = np.where(letters, p, 0.0)
            else:
                names, p, rate = np.full(len(texts), "und", object), np.zeros(len(texts)), np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(names, pa.string()), pa.array(p, pa.float64()), pa.array(rate, pa.float64())], ["id", "lang_pred", "score", "bits_per_byte"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(score, "id long, lang_pred string, score double, bits_per_byte double").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Learned, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is in a learned language: not ``und``, and at most ``MOST_BITS`` bits a byte."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, bits, size in _scored(shared.value, slices(batches, text_col), text_col):
            texts = b.column(text_col)
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            least = bits.min(axis=1, initial=np.inf)
            yield b.filter(pa.array(letters & (least <= MOST_BITS * size)))

    return docs.mapInArrow(keep, docs.schema)
