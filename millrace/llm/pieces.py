"""SentencePiece encoding and decoding with a table of distinct chunks: each is segmented once, and its ids are joined back by position."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, slices

#: The marker that stands for a blank in a piece.
MARKER = "▁"
#: Rows of the table that a worker keeps, and their characters.  Chunks beyond are segmented once for each batch of texts.
MOST_CHUNKS = 1 << 19
MOST_CHARACTERS = 1 << 24
_CHUNK = re.compile(r" ( *[^ ]+| *$)")


def pieces_stay_in_chunks(path: str) -> bool:
    """Whether a model's pieces hold markers at their beginning only, and its normaliser does no more than put markers for blanks and one in front.

    A chunk is a run of markers and what follows up to the next marker.  If no
    piece goes on from another character into a marker, no merge joins two
    chunks, so that each is segmented as if it stood alone.
    """
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    n, kinds = model.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
    plain = n.add_dummy_prefix and n.escape_whitespaces and not (n.precompiled_charsmap or n.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix)
    marked = any(p.piece == MARKER and p.type == kinds.NORMAL for p in model.pieces)
    return plain and marked and all(p.type != kinds.USER_DEFINED and MARKER not in p.piece.lstrip(MARKER) for p in model.pieces)


def chunks(text: str) -> list[str]:
    """The chunks of a text, each without one marker and with blanks for the others; joined by blanks they give the text."""
    text = text.replace(MARKER, " ")
    if "  " in text or text[:1] == " " or text[-1:] == " ":
        return _CHUNK.findall(f" {text}")
    return text.split(" ") if text else []


class Segmenter:
    """Ids and decoded text of chunks, by a table that grows up to a bound."""

    def __init__(self, path: str, most_chunks: int = MOST_CHUNKS):
        from sentencepiece import SentencePieceProcessor

        self.library = SentencePieceProcessor(model_file=path)
        self.in_chunks = pieces_stay_in_chunks(path)
        self.most_chunks = most_chunks
        #: By chunk: how many ids it has, its ids in decimal, joined by commas, and what they decode to.
        self.table: dict[str, tuple[int, str, str]] = {}
        self.characters = self.segmented = self.placed = 0

    def _segment(self, new: list[str]) -> dict[str, tuple[int, str, str]]:
        # The library puts a marker in front of a chunk as it does in front of a text, but none where there is no text.
        ids = [x or [self.library.piece_to_id(MARKER)] for x in self.library.encode(new, num_threads=1)]
        decoded = self.library.decode(ids, num_threads=1)
        self.segmented += len(new)
        return {c: (len(x), ",".join(map(str, x)), c if d == c else d) for c, x, d in zip(new, ids, decoded, strict=True)}

    def rows(self, texts: list[str]) -> Iterator[list[tuple[int, str, str]]]:
        """The rows of the table for the chunks of each text, by position."""
        cut = [chunks(t) for t in texts]
        made = self._segment([c for c in dict.fromkeys(chain.from_iterable(cut)) if c not in self.table])
        more = sum(map(len, made))
        if len(self.table) + len(made) <= self.most_chunks and self.characters + more <= MOST_CHARACTERS:
            self.table |= made
            self.characters += more
            made = {}
        for parts in cut:
            self.placed += len(parts)
            yield [self.table.get(c) or made[c] for c in parts] if made else list(map(self.table.__getitem__, parts))

    def encoded(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """How many ids each text has, its ids in decimal, joined by commas, and what they decode to."""
        if not self.in_chunks:
            for t in texts:
                ids = self.library.encode(t)
                yield len(ids), ",".join(map(str, ids)), self.library.decode(ids)
            return
        for found in self.rows(texts):
            n, ids, text = zip(*found, strict=True) if found else ((), (), ())
            yield sum(n), ",".join(ids), " ".join(text)


def segmenter(path: str) -> Segmenter:
    """One for each worker, so that what a task has segmented serves the next."""
    return kept(("segmenter", path), lambda: Segmenter(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``ids`` (array<int>) of each row's whole text; null is empty and has no ids."""
    split = lambda found: [pa.array([np.fromstring(ids, np.int32, sep=",") for _, ids, _ in found], pa.list_(pa.int32()))]
    return _mapped(docs, path, id_col, text_col, "id long, ids array<int>", split)


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and ``text`` of each row's ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = segmenter(path).library
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([coder.decode(x) if x else "" for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by commas) and ``decoded_sha256`` of each row's whole text.

    Equal to what the library gives for whole texts.  A worker keeps one table
    of distinct chunks, bounded in rows and characters, and adds those of a
    batch of texts that it does not know; a chunk is so segmented and decoded
    once for each worker and not wherever it stands.  Nothing is shuffled: a
    table of all chunks of all documents would have to be joined to each
    position, which moves more than the texts.  Models whose pieces may cross
    markers, or whose normaliser changes texts, encode each text whole.

    Null is empty, and an empty text has no ids.  Rows that repeat stay rows of
    their own, an empty table gives an empty result, and other columns are
    ignored whatever their names.
    """

    def digests(found: list[tuple[int, str, str]]) -> list[pa.Array]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return [pa.array([n for n, _, _ in found], pa.int64()), pa.array([sha(ids) for _, ids, _ in found], pa.string()), pa.array([sha(text) for _, _, text in found], pa.string())]

    return _mapped(docs, path, id_col, text_col, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, schema: str, columns: Callable[[list], list[pa.Array]]) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = segmenter(path)
        for b in slices(batches, "text", keep=True):
            texts = [t or "" for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns(list(coder.encoded(texts)))], names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
