"""Conversation repair, SentencePiece and spelling variants against plain definitions."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from millrace.llm import conversation_repair, pieces, queries, spelling

CLASH = ("conv", "found", "here", "digest", "row", "col", "audit", "id", "ids", "word", "n", "near", "block", "m", "a", "b")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def values(frame, *cols):
    return sorted((tuple(r[c] for c in cols) for r in frame.collect()), key=repr)


# Conversation repair

ROLE = {"u": "user", "a": "assistant"}


def next_state(state, initial):
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))


def every_repair(rows):
    """The least (cost, audit, repaired lines) over all edits, by dynamic programming over whole edit sequences; rows are (role, text, must go, truncated)."""
    best = {(0, ""): (0, "", ())}
    for i in range(len(rows) + 1):
        # Inserts: at most two in a row are ever of use before a state repeats.
        for _ in range(4):
            for state in list("sua") + [""]:
                if (i, state) in best:
                    cost, audit, out = best[i, state]
                    for x in "ua":
                        if to := next_state(state, x):
                            new = (cost + 2, audit + "I", (*out, ROLE[x] + ":"))
                            best[i, to] = min(best.get((i, to), new), new)
        if i == len(rows):
            break
        role, text, gone, cut = rows[i]
        for state in list("sua") + [""]:
            if (i, state) not in best:
                continue
            cost, audit, out = best[i, state]
            options = [(state, cost + 3, "D", out)]
            if not gone:
                if role and (to := next_state(state, role[0])):
                    options.append((to, cost + cut, "K", (*out, f"{role}:{text}")))
                options += [(to, cost + 2 + cut, "R", (*out, f"{ROLE[x]}:{text}")) for x in "ua" if (to := next_state(state, x))]
            for to, c, edit, lines in options:
                new = (c, audit + edit, lines)
                best[i + 1, to] = min(best.get((i + 1, to), new), new)
    return min(best[len(rows), s] for s in ("", "a") if (len(rows), s) in best)


def plain_repair(conversations):
    """The contract, row by row: {conv: rows (turn, role, text)} after faults to result rows."""
    out = []
    for conv, turns in conversations.items():
        turns = sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], hashlib.sha256(f"{len(t[1])}:{t[1]}{t[2]}".encode()).digest()))
        numbers = [t for t, _, _ in turns if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        faults, seen, rows = Counter(), set(), []
        for _, role, text in turns:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else ""
            faults[fault] += 1
            seen.add((role, text))
            rows.append((role, text, fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        cost, audit, lines = every_repair(rows)
        out.append((conv, gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, audit, sha("\n".join(lines))))
    return sorted(out, key=repr)


def faulty(rows):
    out = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        fill = lambda v: " " if v is None else v
        kind, role, text = zlib.crc32(f"{fill(conv)}:{fill(turn)}".encode()) % 20, fill(role), fill(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return out


REPAIR = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_conversations_equal_the_definition(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.queries()["op11_conversation_repair"](spark, small)
    assert values(got, *REPAIR) == plain_repair(faulty(rows))
    assert len({r[7] for r in values(got, *REPAIR)}) > 10


def test_odd_conversations(spark):
    made = random.Random(3)
    rows = [(c, made.choice([None, 0, 1, 2, 2, 3, 9]), made.choice([None, "", "user", "assistant", "system", "tool", "unknown"]), made.choice([None, "", " \t", "a.", "b", "a.", "c! ", "d?\n", "é。"])) for c in [None, *range(60)] for _ in range(made.randrange(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    damaged = faulty(rows)
    got = conversation_repair.repair(conversation_repair.with_faults(df), df)
    assert values(got, *REPAIR) == plain_repair(damaged)
    lines = defaultdict(list)
    for conv, turn, role, text in values(conversation_repair.repaired_turns(conversation_repair.with_faults(df)), "conv_id", "turn", "role", "text"):
        assert turn == len(lines[conv])
        lines[conv].append(f"{role}:{text}")
    assert {r[0]: r[-1] for r in values(got, *REPAIR)} == {c: sha("\n".join(lines[c])) for c in damaged}
    assert any(not v for v in damaged.values())
    assert conversation_repair.repair(conversation_repair.with_faults(df.limit(0)), df.limit(0)).count() == 0


def test_least_audit_of_all_edits_in_blocks_of_any_size():
    made = random.Random(5)
    for n in (*range(6), 6, 9, 17, 40):
        for _ in range(60 if n < 20 else 10):
            rows = [(made.choice(["user", "assistant", "assistant", "system", "tool"]), "x", made.random() < 0.2, made.random() < 0.3) for _ in range(n)]
            codes = "".join("d" if gone else (c.upper() if cut else c) for role, _, gone, cut in rows for c in [role[0] if role[0] in "sua" else "x"])
            want = every_repair([(r, t, g, c and not g) for r, t, g, c in rows])[:2]
            for block in (1, 3, 7, 256):
                assert conversation_repair.repaired(codes, block) == want, (codes, block)


def test_repairs_are_least_over_every_sequence_of_edits():
    """No search at all: every string of edits of up to six letters."""
    rows = [("user", "x", False, False), ("user", "y", False, True), ("system", "z", False, False)]

    def outcomes(edits):
        ways = [(0, 0, "")]
        for e in edits:
            new = []
            for i, cost, roles in ways:
                if e == "I":
                    new += [(i, cost + 2, roles + x) for x in "ua"]
                elif i < len(rows):
                    cut = rows[i][3]
                    new += {"D": [(i + 1, cost + 3, roles)], "K": [(i + 1, cost + cut, roles + rows[i][0][0])], "R": [(i + 1, cost + 2 + cut, roles + x) for x in "ua"]}[e]
            ways = new
        return [c for i, c, roles in ways if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles)]

    best = min((c, "".join(e)) for n in range(3, 7) for e in product("DIKR", repeat=n) for c in outcomes(e))
    assert conversation_repair.repaired("uUs") == best


def test_a_long_conversation(spark):
    made = random.Random(7)
    rows = [(1, t, made.choice(["user", "assistant"]), made.choice(["a.", f"{t}.", f"{t}"])) for t in range(5000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert values(conversation_repair.repair(df), *REPAIR) == plain_repair({1: [r[1:] for r in rows]})


# SentencePiece


@pytest.fixture(scope="module")
def path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library(path):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


ODD = ["", " ", "  ", " a", "a ", "a  b", "   a   ", "▁", "a▁b", "▁▁a ▁", "\n \n", "a\x00b", "<s> </s> <unk> <0x41>", "日本 語", "é è", "x" * 200_000, "a b " * 5000, "​  x", " " * 1000, "é 👩‍👩‍👧 �"]


def test_pieces_of_every_text_equal_the_library(spark, small, library):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    want = [(i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else "")) for i, t in docs.items() for ids in [library.encode(t)]]
    assert values(queries.queries()["op12_sentencepiece"](spark, small), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_odd_texts_and_columns(spark, path, library):
    rows = [*enumerate(ODD), (None, "a"), (0, None), (0, None), (3, " a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    want = [(i, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids) if ids else "")) for i, t in rows for ids in [library.encode(t or "")]]
    assert values(pieces.round_trip(df, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    encoded = pieces.encode(df, path)
    assert values(encoded, "doc_id", "ids") == sorted([(i, library.encode(t or "")) for i, t in rows], key=repr)
    assert values(pieces.decode(encoded, path), "doc_id", "text") == sorted([(i, (t or "").replace("▁", " ")) for i, t in rows], key=repr)
    assert pieces.round_trip(df.limit(0), path).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" ▁\nab.é"), st.characters(exclude_categories=["Cs"]))))
def test_any_text(path, library, text):
    coder = test_any_text.__dict__.setdefault("coder", pieces.Segmenter(path))
    (n, ids, decoded), want = next(coder.encoded([text])), library.encode(text)
    assert (n, ids) == (len(want), ",".join(map(str, want)))
    assert decoded == (library.decode(want) if want else "")


def test_table_of_chunks_is_bounded_and_each_is_segmented_once(path, library):
    coder = pieces.Segmenter(path, most_chunks=50)
    texts = [" ".join(f"w{(i * k) % 97}" for k in range(30)) for i in range(40)]
    for _ in range(2):
        assert [x[1] for x in coder.encoded(texts)] == [",".join(map(str, library.encode(t))) for t in texts]
    assert not coder.table and coder.segmented == 2 * len({w for t in texts for w in t.split()})
    coder = pieces.Segmenter(path)
    for _ in range(2):
        list(coder.encoded(texts))
    assert coder.segmented == len(coder.table) == len({w for t in texts for w in t.split()}) and coder.placed == 2 * 40 * 30


def test_models_whose_pieces_cross_markers_encode_whole_texts(path, library):
    coder = pieces.Segmenter(path)
    assert coder.in_chunks
    coder.in_chunks = False
    assert [x[1] for x in coder.encoded(ODD)] == [",".join(map(str, library.encode(t))) for t in ODD]
    assert not coder.table


# Spelling variants


def plain_variants(docs, faults=97):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{word}".encode())
            if faults and h % faults == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1 :]
            n[word] += 1
    return plain_near({w: c for w, c in n.items() if len(w) >= 5 and c >= 3})


def plain_near(words):
    """By deleting each letter: two words are near if a deletion of one is the other, or deletions at one place are equal."""
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w)):
            holes[w[:k], w[k + 1 :]].add(w)
            if (v := w[:k] + w[k + 1 :]) in words:
                near[w].add(v)
                near[v].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {w: best for w in words if near[w] and words[best := min(near[w], key=lambda v: (-words[v], v))] >= 2 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), c, len(near[w]), words.get(form.get(w))) for w, c in words.items()), key=repr)


VARIANTS = ("word", "form", "root", "n", "n_near", "form_n")


def test_variants_equal_the_definition(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    want = plain_variants(docs)
    assert values(queries.queries()["op13_spelling_variants"](spark, small), *VARIANTS) == want
    assert sum(r[1] is not None for r in want) > 100 and any(r[1] not in (None, r[2]) for r in want)


def test_odd_texts_have_variants(spark):
    rows = [(1, None), (2, ""), (None, "Colour colour colour COLOUR"), (3, "color color color colour"), (3, "color color color colour"), (4, "ÉTUDE étude étude étude étudé"), (5, "x" * 50_000 + " ") , (6, ("x" * 50_000 + " ") * 3 + ("x" * 49_999 + "y ") * 3), (7, "abcde abcde abcde")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for c in CLASH:
        df = df.withColumn(c, F.lit("clash"))
    for faults in (None, 2):
        assert values(spelling.variants(df, faults=faults), *VARIANTS) == plain_variants(rows, faults)
    assert spelling.variants(df.limit(0)).count() == 0
    assert spelling.variants(spark.createDataFrame([(1, "abcde abcde abcde")], "doc_id long, text string")).collect()[0]["root"] == "abcde"


def test_large_blocks_are_subdivided_until_a_letter_is_free(spark):
    made = random.Random(11)
    words = {"".join(made.choice("abc") for _ in range(made.choice([5, 6, 7, 8]))): made.randrange(3, 50) for _ in range(1500)}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    want = [(w, n_near, form) for w, form, _, _, n_near, _ in plain_near(words)]
    for block in (4, 50, 10_000):
        got = spelling.near_words(df, block=block)
        assert [(r["word"], r["n_near"], r["near"] if r["near"] and r["near_n"] >= 2 * r["n"] else None) for r in sorted(got.collect(), key=lambda r: r["word"])] == sorted(want)
    longest = max(r["size"] for d in spelling.blocks(df, block=4) for r in d.groupBy(*spelling.KEY).agg(F.count(F.lit(1)).alias("size")).collect())
    assert longest <= 4


def test_roots_follow_long_chains(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(30)] + [("a", "w7"), ("b", "c")]
    assert values(spelling.roots(spark.createDataFrame(forms, "word string, form string")), "word", "root") == sorted([(w, "c" if w == "b" else "w30") for w, _ in forms])
