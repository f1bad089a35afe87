"""BPE encoding and decoding with content-defined chunks: chunks that texts share are encoded once."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kept, slices
from .tokens import grams, words

#: Words in a chunk, about.
CHUNK_WORDS = 32
#: Words whose rolling hash decides whether a chunk ends.
WINDOW = 4
#: Chunks and pieces that a worker remembers, and the characters of each; when it knows so many pieces, new ones are forgotten after each batch.
MOST_CHUNKS = 1 << 14
MOST_PIECES = 3 << 17
MOST_CHARACTERS = 1 << 24
#: Ends of pieces and joins that a worker remembers; beyond that it forgets all.
MOST_EDGES = 1 << 17
_PIECES = re.compile(r"\s*\S+|\s+")


#: Patterns of words in which no match goes on from another character into a blank.
BLANK_PATTERNS = (r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+",)


def ends_at_blanks(settings: dict) -> bool:
    """Whether a tokenizer's words end at blanks, whatever stands beyond: by its normalizers, its pattern and its added tokens."""
    parts = lambda x, name: [] if x is None else x[name] if x["type"] == "Sequence" else [x]
    for n in parts(settings["normalizer"], "normalizers"):
        if n["type"] not in ("NFC", "Lowercase") and not (n["type"] == "Replace" and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " "):
            return False
    words = False
    for p in parts(settings["pre_tokenizer"], "pretokenizers"):
        if p["type"] == "Split" and p["pattern"].get("Regex") in BLANK_PATTERNS and (p["behavior"], p["invert"]) == ("Removed", True):
            words = True
        elif p["type"] == "ByteLevel" and not p["add_prefix_space"]:
            words = words or p["use_regex"]  # the library's own pattern of words is such a one
        else:
            return False
    plain = all(not (t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"])) for t in settings["added_tokens"])
    return words and plain and settings["post_processor"] is None and settings["model"]["type"] == "BPE"


def _short(text: str) -> str:
    """A name for the text that is never long."""
    return text if len(text) <= 64 else hashlib.sha256(text.encode()).hexdigest()


class Encoder:
    """Encodes texts as the tokenizer does, chunk by chunk.

    A text is cut at blanks after a run of words whose rolling hash has a fixed
    pattern, so that a passage has the same chunks wherever it stands, and a
    chunk that is known is not encoded again.  A new chunk is made of pieces, a
    word with the blanks before it, which are shared in the same way.  Joins of
    chunks and of pieces are checked by encoding both sides together; where that
    is not what they give apart, the two are put together and encoded anew, again
    and again, until all joins agree.

    One check holds for all joins with the same characters: the last one before,
    the blanks, and the first one after.  That needs a tokenizer whose words end
    at blanks (``ends_at_blanks``): its pattern is matched from left to right
    without looking back, no match goes on from another character into a blank,
    and nothing before or after a blank is composed with it.  A piece begins with
    its blanks and ends before the next ones, so every piece begins a match, and
    what stands before or after it does not change its words.  With any other
    tokenizer texts are encoded whole.
    """

    def __init__(self, path: str, chunk_words: int = CHUNK_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.chunk_words = chunk_words
        self.in_chunks = ends_at_blanks(json.loads(self.tokenizer.to_str()))
        self.digits = [str(i) for i in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.encoded = self.reused = self.repaired = 0
        self._forget()

    def _forget(self) -> None:
        self.chunks: dict[str, np.ndarray] = {}
        self.pieces: dict[str, int] = {}
        self.chunk_characters = self.piece_characters = 0
        # By piece: where its ids begin in ``tokens``, how many there are, and what of it matters for a join.
        self.tokens, self.n_tokens = np.zeros(1 << 16, np.int32), 0
        self.begin, self.count, self.tail, self.head = (np.zeros(1 << 16, np.int32) for _ in range(4))
        self.edges: dict[str, int] = {}
        self.joins: dict[int, bool] = {}

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def cut(self, texts: pa.Array) -> list[list[str]]:
        """The chunks of each text; they concatenate to it."""
        w = words(texts)
        h = grams(w.hash, WINDOW, 31)
        ends = np.flatnonzero(h % np.uint64(self.chunk_words) == 0) + WINDOW - 1
        doc = w.doc[ends] if len(ends) else ends
        ends, doc = ends[(ends - w.at[doc]) >= WINDOW - 1], doc[(ends - w.at[doc]) >= WINDOW - 1]
        # Cut where a blank follows; a text that lower-casing made longer or shorter is one chunk, as its offsets are not known.
        out = []
        for i, text in enumerate(texts.to_pylist()):
            text = text or ""
            mine = w.end[ends[np.searchsorted(doc, i) : np.searchsorted(doc, i, "right")]] - w.offset[i]
            data = text.encode()
            if len(data) != w.offset[i + 1] - w.offset[i]:
                out.append([text] if text else [])
                continue
            parts, last = [], 0
            for end in mine.tolist():
                if end < len(data) and data[end] in b" \n\t" and end > last:
                    parts.append(data[last:end].decode())
                    last = end
            if last < len(data):
                parts.append(data[last:].decode())
            out.append(parts)
        return out

    def _agrees(self, left: str, right: str) -> bool:
        """Whether two neighbouring pieces are encoded together as they are apart."""
        return self._ids(left + right) == self._ids(left) + self._ids(right)

    def _learn(self, new: list[str]) -> None:
        """Encodes pieces and files them under the next numbers."""
        edges = self.edges
        for k in range(0, len(new), 1024):
            some = new[k : k + 1024]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast(some, add_special_tokens=False)]
            count = np.array([len(x) for x in ids], np.int64)
            flat = np.array([x for y in ids for x in y], np.int32)
            at = np.arange(len(self.pieces), len(self.pieces) + len(some))
            if at[-1] >= len(self.begin):
                self.begin, self.count, self.tail, self.head = (np.concatenate([x, np.zeros(len(x), np.int32)]) for x in (self.begin, self.count, self.tail, self.head))
            while self.n_tokens + len(flat) > len(self.tokens):
                self.tokens = np.concatenate([self.tokens, np.zeros(len(self.tokens), np.int32)])
            self.begin[at], self.count[at] = self.n_tokens + np.cumsum(count) - count, count
            self.tail[at] = [edges.setdefault(p[-1], len(edges)) for p in some]
            self.head[at] = [edges.setdefault(_short(p[: len(p) - len(p.lstrip()) + 1]), len(edges)) for p in some]
            self.tokens[self.n_tokens : self.n_tokens + len(flat)] = flat
            self.n_tokens += len(flat)
            self.pieces.update(zip(some, at.tolist(), strict=True))
            self.piece_characters += sum(map(len, some))
        self.encoded += len(new)

    def _repaired(self, pieces: list[str]) -> list[int]:
        """The ids where some join does not agree: such pieces are put together until all do."""
        parts, i = list(pieces), 1
        while i < len(parts):
            if self._agrees(parts[i - 1], parts[i]):
                i += 1
            else:
                parts[i - 1 : i + 1] = [parts[i - 1] + parts[i]]
                self.repaired += 1
                i = max(1, i - 1)
        return [x for p in parts for x in self._ids(p)]

    def encode(self, texts: pa.Array) -> list[list[int]]:
        """The ids of each text."""
        if not self.in_chunks:
            return [self._ids(x or "") for x in texts.to_pylist()]
        cut = self.cut(texts)
        if max(len(self.edges), len(self.joins)) > MOST_EDGES:
            self._forget()
        if len(self.chunks) >= MOST_CHUNKS or self.chunk_characters > MOST_CHARACTERS:
            self.chunks.clear()
            self.chunk_characters = 0
        known, pieces, tokens, characters = self.chunks, self.pieces, self.n_tokens, self.piece_characters
        made = {c: _PIECES.findall(c) for c in dict.fromkeys(c for parts in cut for c in parts) if c not in known}
        new = list(dict.fromkeys(p for ps in made.values() for p in ps if p not in pieces))
        self._learn(new)
        here = {c: np.array([pieces[p] for p in ps], np.int64) for c, ps in made.items()}
        self.reused += sum(map(len, cut)) - len(made)
        rows = [np.concatenate([here[c] if c in here else known[c] for c in parts]) if parts else np.zeros(0, np.int64) for parts in cut]
        size = np.array([len(r) for r in rows])
        piece = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(rows)), size)
        count = self.count[piece].astype(np.int64)
        total = int(count.sum())
        flat = self.tokens[np.arange(total) + np.repeat(self.begin[piece] - (np.cumsum(count) - count), count)].tolist()
        ends = np.cumsum(np.bincount(owner, weights=count, minlength=len(rows)).astype(np.int64)).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
        for i in self._disagreeing(piece, owner, cut):
            out[i] = self._repaired(_PIECES.findall("".join(cut[i])))
        if len(pieces) > MOST_PIECES or self.piece_characters > MOST_CHARACTERS:
            for p in new:
                del pieces[p]
            self.n_tokens, self.piece_characters = tokens, characters
        else:
            some = list(here.items())[: MOST_CHUNKS - len(known)]
            known.update(some)
            self.chunk_characters += sum(len(c) for c, _ in some)
        if len(self.tokens) > 4 * max(self.n_tokens, 1 << 16):
            self.tokens = self.tokens[: 2 * max(self.n_tokens, 1 << 15)].copy()
        return out

    def _disagreeing(self, piece: np.ndarray, owner: np.ndarray, cut: list[list[str]]) -> list[int]:
        """The texts with a join that does not agree; joins not met before are tried out."""
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        key = self.tail[piece[inside]].astype(np.int64) << 32 | self.head[piece[inside + 1]]
        distinct, first = np.unique(key, return_index=True)
        wrong = []
        for k, at in zip(distinct.tolist(), inside[first].tolist(), strict=True):
            if k not in self.joins:
                text = int(owner[at])
                place = at - int(np.searchsorted(owner, text))
                ps = _PIECES.findall("".join(cut[text]))
                self.joins[k] = self._agrees(ps[place], ps[place + 1])
            if not self.joins[k]:
                wrong.append(k)
        return sorted(set(owner[inside[np.isin(key, wrong)]].tolist())) if wrong else []

    def decode(self, ids: list[int]) -> str:
        return self.tokenizer.decode(ids, skip_special_tokens=False)


def encoder(path: str) -> Encoder:
    """One encoder for each worker, so that what a task has learned serves the next."""
    return kept(("encoder", path), lambda: Encoder(path))


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ``ids`` (array<int>) of each row's whole text; null is empty and has no ids."""
    return _mapped(docs, path, id_col, text_col, "id long, ids array<int>", lambda coder, all_ids: [pa.array(all_ids, pa.list_(pa.int32()))])


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and ``text`` of each row's ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([coder.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], ["id", "text"])

    return encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_tokens``, ``ids_sha256`` (of the decimal ids joined by one space) and ``decoded_sha256`` of each row's whole text; null is empty.

    Rows are worked on where they lie: nothing is shuffled, and what a worker
    remembers is bounded in number and characters.
    """

    def digests(coder: Encoder, all_ids: list[list[int]]) -> list[pa.Array]:
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return [
            pa.array([len(x) for x in all_ids], pa.int64()),
            pa.array([sha(" ".join(map(coder.digits.__getitem__, x))) for x in all_ids], pa.string()),
            pa.array([sha(coder.decode(x)) for x in all_ids], pa.string()),
        ]

    return _mapped(docs, path, id_col, text_col, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _mapped(docs: DataFrame, path: str, id_col: str, text_col: str, schema: str, columns) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for b in slices(batches, "text", keep=True):
            yield pa.RecordBatch.from_arrays([b.column("id"), *columns(coder, coder.encode(b.column("text")))], names)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
