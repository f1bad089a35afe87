import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import bpe, decontaminate, langid, licenses, ngram_join, substring_dedup, toxicity, tokens

TEXT = st.text(alphabet=st.sampled_from(list("aAbB zZ09.,!?-_\n\té É ñßİ— 　 中")), max_size=60)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
def test_words_are_those_of_the_pattern(texts):
    w = tokens.words(pa.array(texts, pa.string()))
    seen = {}
    for i, t in enumerate(texts):
        mine = [bytes(w.data[a:b]).decode() for a, b in zip(w.start[w.at[i] : w.at[i + 1]], w.end[w.at[i] : w.at[i + 1]], strict=True)]
        low = pa.compute.utf8_lower(pa.scalar(t or "")).as_py()
        assert mine == re.findall(tokens.WORD, low)
        for word, h in zip(mine, w.hash[w.at[i] : w.at[i + 1]].tolist(), strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_word_longer_than_the_tables():
    n = (1 << 21) + 10
    w = tokens.words(pa.array(["x" * n, "a " + "x" * n + " b"]))
    assert w.hash[0] == w.hash[2] and len(w.hash) == 4


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ", max_size=30), max_size=5))
def test_shingles_are_sets_of_word_runs(texts):
    value, at = tokens.shingles(tokens.words(pa.array(texts, pa.string())), 3)
    for i, t in enumerate(texts):
        w = t.split()
        want = {tuple(w[k : k + 3]) for k in range(max(1, len(w) - 2))} if w else set()
        assert len(value[at[i] : at[i + 1]]) == len(want)


def slow_tiles(t, d, least):
    ft, fd, out = [1] * len(t), [1] * len(d), []
    while True:
        best, found = 0, []
        for i in range(len(t)):
            for j in range(len(d)):
                k = 0
                while i + k < len(t) and j + k < len(d) and t[i + k] == d[j + k] and ft[i + k] and fd[j + k]:
                    k += 1
                if k > best:
                    best, found = k, [(i, j)]
                elif k == best and k:
                    found.append((i, j))
        if best < least:
            return out
        for i, j in found:
            if all(ft[i : i + best]) and all(fd[j : j + best]):
                ft[i : i + best] = fd[j : j + best] = [0] * best
                out.append((i, j, best))


def test_tiles():
    rng = random.Random(1)
    for _ in range(200):
        t, d = ([rng.randrange(3) for _ in range(rng.randrange(1, n))] for n in (14, 20))
        assert decontaminate.tile(np.array(t, np.uint64), np.array(d, np.uint64), 2) == slow_tiles(t, d, 2)


def test_code_lengths_follow_the_definition():
    import math
    from collections import Counter, defaultdict

    learned = {"a": ["abracadabra abba", "bab"], "b": ["hello yellow", "low"]}
    counts = {}
    for k, v in learned.items():
        c, n = np.unique(langid._codes(*tokens.text_bytes(pa.array(v))), return_counts=True)
        counts[k] = (c.astype(np.int64), n)
    model = langid.build(["a", "b"], counts)

    def bits(lang, text):
        after = [defaultdict(Counter) for _ in range(4)]
        for t in learned[lang]:
            b = b"\0\0\0" + t.encode()
            for i in range(3, len(b)):
                for o in range(4):
                    after[o][b[i - o : i]][b[i]] += 1
        total, b = 0.0, b"\0\0\0" + text.encode()
        for i in range(3, len(b)):
            for o in (3, 2, 1, 0):
                f = after[o].get(b[i - o : i])
                if not f:
                    continue
                n = sum(f.values()) + len(f)
                if b[i] in f:
                    total -= math.log2(f[b[i]] / n)
                    break
                total -= math.log2(len(f) / n)
            else:
                total += 8
        return total

    texts = ["abra", "hello low", "", "zzz é abba low bab", "yellow"]
    got, size = langid.code_lengths(model, pa.array(texts))
    assert size.tolist() == [len(t.encode()) for t in texts]
    for i, t in enumerate(texts):
        assert got[i].tolist() == pytest.approx([bits("a", t), bits("b", t)], abs=1e-3)


def test_code_lengths_across_blocks(monkeypatch):
    c, n = np.unique(langid._codes(*tokens.text_bytes(pa.array(["abcabcabd" * 3]))), return_counts=True)
    model = langid.build(["x"], {"x": (c.astype(np.int64), n)})
    texts = pa.array(["abcabd" * (1 << 18), "a", "ab" * 5])
    whole, _ = langid.code_lengths(model, texts)
    parts = [langid.code_lengths(model, texts.slice(i, 1))[0][0, 0] for i in range(3)]
    assert whole[:, 0].tolist() == pytest.approx(parts)


def test_pruning_keeps_nearly_all_pairs_at_the_threshold():
    rng = np.random.default_rng(0)
    lost = 0
    for _ in range(300):
        common = rng.integers(0, 1 << 63, 160).astype(np.uint64)
        one, two = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, 20).astype(np.uint64)])) for _ in range(2))
        sig = ngram_join.minhash(np.concatenate([one, two]), np.array([0, 180, 360]))
        a, _ = ngram_join.link_pairs(sig, [one, two], np.array([0]), np.array([1]), 0.8)
        lost += not len(a)
    assert lost == 0


def test_exact_products_equal_intersections():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 60, 40).astype(np.uint64)
    sets = [np.unique(np.concatenate([base[rng.random(40) < 0.95], rng.integers(0, 1 << 60, 3).astype(np.uint64)])) for _ in range(30)]
    at = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    sig = ngram_join.minhash(np.concatenate(sets), at)
    a, b = np.triu_indices(30, 1)
    got = set(zip(*map(np.ndarray.tolist, ngram_join.link_pairs(sig, sets, a, b, 0.8)), strict=True))
    jac = lambda i, j: len(np.intersect1d(sets[i], sets[j])) / len(np.union1d(sets[i], sets[j]))
    assert got == {(i, j) for i, j in zip(a.tolist(), b.tolist(), strict=True) if jac(i, j) >= 0.8}


def test_units_cover_the_texts():
    texts = ["A b. C d!\nE f? g", "", None, "no end", "...\n\n", "é. ñ"]
    doc, start, end = substring_dedup.cut(pa.array(texts))
    data, _ = tokens.text_bytes(pa.array(texts))
    assert [bytes(data[a:b]).decode() for a, b in zip(start, end, strict=True)] == ["A b. C d!\n", "E f? g", "no end", "...\n", "\n", "é. ñ"]
    assert doc.tolist() == [0, 0, 3, 4, 4, 5]


def test_ftrl_is_sparse_and_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.concatenate([rng.integers(1000, 100000, 50), [7] if i % 3 == 0 else [9]])).astype(np.int32) for i in range(600)]
    at, weight, bias = toxicity.ftrl(rows, np.array([float(i % 3 == 0) for i in range(600)]))
    w = dict(zip(at.tolist(), weight.tolist(), strict=True))
    assert w[7] > 0 and len(w) < 500
    assert all((sum(w.get(int(x), 0) for x in r) + bias > 0) == (i % 3 == 0) for i, r in enumerate(rows))


def test_marks_are_in_every_match():
    sets = licenses.template_sets(licenses.TEMPLATES)
    assert len(sets) > len(licenses.TEMPLATES) and all(sets[k, 0] == licenses.template_bigrams(v) for k, v in licenses.TEMPLATES.items())
    marks = licenses.marking_words(sets, 1.5)
    rng = random.Random(0)
    for grams in sets.values():
        least = -(-len(grams) * 2 // 3)
        for _ in range(50):
            some = rng.sample(grams, least)
            assert any(m in g.split() or m == g for g in some for m in marks)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoding_is_the_tokenizers(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    t, rng = Tokenizer.from_file(path), random.Random(0)
    words = ["the", "The", "cat's", "don't", "x́", "́y", "é", "İi", "中文", "12", "3.5", "<|endoftext|>", "'S", "—", "ΑΣ", "àb", "\U0001f600", "''"]
    texts = ["", None, " ", "\n\n"] + ["".join(rng.choice(words) + rng.choice([" ", "  ", "\n", "\t ", " ", "　", "", " \r\n"]) for _ in range(rng.randrange(1, 120))) for _ in range(150)]
    for chunk in (2, 32):
        coder = bpe.Encoder(path, chunk)
        for _ in range(2):
            got = coder.encode(pa.array(texts))
            assert got == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
        assert coder.reused > 0
        assert [coder.decode(x) for x in got[:20]] == [t.decode(t.encode(x or "", add_special_tokens=False).ids, skip_special_tokens=False) for x in texts[:20]]


def test_encoder_forgets_when_full(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "MOST_PIECES", 20)
    path = public_tokenizers.path("word_bpe_49k.json")
    coder, t = bpe.Encoder(path, 2), Tokenizer.from_file(path)
    for k in range(5):
        texts = [" ".join(f"w{k}x{i}" for i in range(15)), "same words here " * 9]
        assert coder.encode(pa.array(texts)) == [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert len(coder.pieces) <= 20


def test_encoder_forgets_long_words_and_edges(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "MOST_CHARACTERS", 20_000)
    monkeypatch.setattr(bpe, "MOST_EDGES", 60)
    path, rng = public_tokenizers.path("word_bpe_49k.json"), random.Random(3)
    coder, t = bpe.Encoder(path, 2), Tokenizer.from_file(path)
    for k in range(8):
        texts = ["".join(rng.choices("abcdefgh", k=30_000)), "\n" * (100 + k) + "x " * 20, " ".join(chr(0x4E00 + 50 * k + i) + "a" for i in range(50)), "same words here " * 9]
        assert coder.encode(pa.array(texts)) == [t.encode(x, add_special_tokens=False).ids for x in texts]
        assert sum(map(len, coder.pieces)) == coder.piece_characters <= 20_000 and sum(map(len, coder.chunks)) <= 40_000
        assert max(map(len, coder.edges)) <= 64 and len(coder.tokens) <= 1 << 17
    assert len(coder.edges) < 200


def test_tokenizer_of_another_kind_encodes_whole_texts(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    settings = json.load(open(public_tokenizers.path("byte_bpe_50k.json")))
    assert bpe.ends_at_blanks(settings)
    for change in ({"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, {"pre_tokenizer": None}, {"normalizer": {"type": "Strip", "strip_left": True, "strip_right": True}}):
        assert not bpe.ends_at_blanks(settings | change)
    path = str(tmp_path / "other.json")
    json.dump(settings | {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}, open(path, "w"))
    coder, t = bpe.Encoder(path, 2), Tokenizer.from_file(path)
    texts = ["one two  three " * 20, "", None, "x"]
    assert coder.encode(pa.array(texts)) == [t.encode(x or "", add_special_tokens=False).ids for x in texts]


def test_ftrl_equals_a_loop_over_coordinates():
    import math

    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 40, rng.integers(0, 9))).astype(np.int32) for _ in range(300)]
    labels = np.array([float(len(x) and x[0] < 6) for x in rows])
    z, n = {}, {}

    def weight(k):
        if abs(z.get(k, 0.0)) <= toxicity.L1:
            return 0.0
        return -(z[k] - math.copysign(toxicity.L1, z[k])) / ((toxicity.BETA + math.sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)

    bz = bn = 0.0
    for epoch in range(toxicity.EPOCHS):
        for i in np.random.default_rng(epoch).permutation(len(rows)):
            w = {int(k): weight(int(k)) for k in rows[i]}
            b = -bz / ((toxicity.BETA + math.sqrt(bn)) / toxicity.ALPHA)
            g = 1 / (1 + math.exp(-(sum(w.values()) + b))) - labels[i]
            for k, v in w.items():
                rate = (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / toxicity.ALPHA
                z[k] = z.get(k, 0.0) + g - rate * v
                n[k] = n.get(k, 0.0) + g * g
            bz += g - (math.sqrt(bn + g * g) - math.sqrt(bn)) / toxicity.ALPHA * b
            bn += g * g
    at, got, bias = toxicity.ftrl(rows, labels)
    want = {k: weight(k) for k in z if weight(k)}
    assert want and dict(zip(at.tolist(), got.tolist(), strict=True)) == pytest.approx(want, rel=1e-5)
    assert bias == pytest.approx(-bz / ((toxicity.BETA + math.sqrt(bn)) / toxicity.ALPHA))


def test_features_are_words_pairs_and_skip_pairs():
    value, at = toxicity.text_features(pa.array(["a b c d e", "a", "", None, "A b"]))
    # Of five words: themselves, and the pairs at distances 1, 2 and 3.
    assert np.diff(at).tolist() == [5 + 4 + 3 + 2, 1, 0, 0, 3]
    assert set(value[at[4] : at[5]]) <= set(value[at[0] : at[1]])


def test_seed_that_many_items_and_places_share(monkeypatch):
    hot = "one two three four five"
    items = [hot if i % 2 else f"{hot} x{i} y{i} z{i} u{i} v{i} w{i}" for i in range(10_000)]
    block = decontaminate.Block(list(range(len(items))), items, 5)
    w = tokens.words(pa.array([f"{hot} " * 2000, f"and {hot} x4 y4 z4 u4", "nothing"]))
    for most in (1 << 20, 7):
        monkeypatch.setattr(decontaminate, "MOST_SEEDS", most)
        assert all(len(key) <= max(most, 30_000) for key in decontaminate._candidates(block, w, 5))
        got = {(d, i) for d, i, *_ in decontaminate._pairs(block, w, 0.5)}
        assert got == {(d, i) for d in (0, 1) for i in range(1, 10_000, 2)} | {(1, 4)}
