"""What operators once did for a part of their input only."""

import re

import pytest

from millrace.llm import langid, ngram_join, substring_dedup, tokens, toxicity


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def repeated_words(pairs, n=substring_dedup.PASSAGE):
    """(id, start, end) of each word in a window of ``n`` words that stands earlier, in a smaller id or before it without overlap."""
    first, out = {}, set()
    for i, text in sorted(pairs):
        w = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(tokens.WORD, text)]
        for k in range(len(w) - n + 1):
            j, p = first.setdefault(tuple(x[0] for x in w[k : k + n]), (i, k))
            if j != i or k >= p + n:
                out |= {(i, a, b) for _, a, b in w[k : k + n]}
    return out


def gone_words(pairs, spans):
    out = set()
    for r in spans:
        text = dict(pairs)[r["doc_id"]][r["span_start"] : r["span_end"]]
        mine = {(r["doc_id"], r["span_start"] + m.start(), r["span_start"] + m.end()) for m in re.finditer(tokens.WORD, text)}
        assert len(mine) == r["n_words"]
        assert not out & mine
        out |= mine
    return out


def test_passages_inside_other_units(spark):
    shared = [f"w{i}" for i in range(60)]
    ended = [w + ("." if i in (20, 40) else "") for i, w in enumerate(shared)]
    pairs = [
        (1, "Before this it says " + " ".join(shared) + " and after it more"),
        (2, "quite different " + " ".join(shared) + " end"),
        (3, "Foreign start " + " ".join(ended).upper() + " foreign end."),
        (4, " ".join(shared[:50]) + " too short"),
        (5, "é x " + " ".join(shared[3:57]) + " y"),
        (6, "a b c " * 40),
        (7, " ".join(f"v{i}" for i in range(80)) + " between " + " ".join(f"v{i}" for i in range(80))),
    ]
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    spans = substring_dedup.repeated_passages(df).collect()
    assert gone_words(pairs, spans) == repeated_words(pairs)
    got = {r["doc_id"]: (r["first_doc"], r["n_words"]) for r in spans}
    assert got == {2: (1, 60), 3: (1, 60), 5: (1, 54), 6: (6, 69), 7: (7, 80)}
    left = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(df, find=substring_dedup.repeated_passages).collect()}
    assert left[2] == "quite different  end" and left[1] == pairs[0][1]


def test_no_repeated_passage_is_left(spark, docs):
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    units = gone_words(pairs, substring_dedup.repeated_spans(docs).collect())
    assert gone_words(pairs, substring_dedup.repeated_passages(docs).collect()) == units | repeated_words(pairs)


def test_links_of_an_id_with_two_texts(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(100)) for c in "ab")
    pairs = [(7, a), (7, b), (9, a + " x"), (11, b + " y"), (3, b + " z"), (7, ""), (12, "alone"), (None, a)]
    for these in (pairs, pairs[::-1]):
        df = spark.createDataFrame(these, "doc_id long, text string").coalesce(1)
        got = sorted(map(tuple, ngram_join.similar(df).collect()), key=repr)
        assert got == sorted([(7, 7, 1), (7, 3, 2), (9, 7, 1), (11, 3, 2), (3, 3, 2), (7, 7, 0), (12, 12, 0), (None, None, 0)], key=repr)
        kept = {tuple(r) for r in ngram_join.keep_one(df).collect()}
        assert kept == {(7, a), (3, b + " z"), (7, ""), (12, "alone"), (None, a)}


def test_every_labelled_language_is_learned(spark, monkeypatch):
    import random

    rng = random.Random(5)
    rows = []
    for k in range(70):
        letters = rng.sample("abcdefghijklmnopqrstuvwxyzäöüßéèñçåø", 12)
        words = ["".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(30)]
        rows += [(1000 * k + i, " ".join(rng.choices(words, k=30)), f"l{k:02}") for i in range(6 if k < 64 else 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    want = {r[0]: r[2] for r in rows}
    whole = langid.train(df)
    assert len(whole.languages) == 70
    got = {r["doc_id"]: (r["lang_pred"], round(r["bits_per_byte"], 4)) for r in langid.identify(df, whole).collect()}
    assert {i: x for i, (x, _) in got.items()} == want
    monkeypatch.setattr(langid, "BLOCK_BYTES", 20 << 20)
    parts = langid.train(df)
    assert len(parts.blocks) > 2
    again = {r["doc_id"]: (r["lang_pred"], round(r["bits_per_byte"], 4)) for r in langid.identify(df, parts).collect()}
    assert again == got and langid.keep_identified(df, parts).count() == df.count()


def test_toxicity_learns_from_12000_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "ftrl", lambda rows, labels: seen.append(len(rows)))
    ids = spark.range(20000)
    toxicity.train(ids.selectExpr("id AS doc_id", "concat('word ', id) AS text"), ids.selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic"))
    assert 11500 < seen[0] < 12500


def test_toxicity_learns_from_fewer_rows_when_they_are_long(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(toxicity, "ftrl", lambda rows, labels: seen.append([len(x) for x in rows]))
    ids = spark.range(300)
    args = ids.selectExpr("id AS doc_id", "repeat(concat('word', id, ' '), 1 + CAST(id % 2 AS INT)) AS text"), ids.selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    toxicity.train(*args)
    toxicity.train(*args, features=200)
    assert len(seen[0]) == 300 and len(seen[1]) > 90 and 190 < sum(seen[1]) <= 200
