import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm import bpe, chat, components, decontaminate, exact_dedup, langid, licenses, ngram_join, queries, substring_dedup, tokens, toxicity, warc
from millrace.llm.common import crc_bucket
from tests.compare import duck, rows

#: Nulls, empty and blank texts, ties and repeated rows, and columns whose names clash with those of results.
ODD = [(1, None), (2, ""), (3, " \n"), (4, "a b c d e f g"), (5, "a b c d e f g"), (5, "a b c d e f g"), (None, "a b c d e f g"), (6, "x" * 200_000), (7, "...!!!"), (8, "a b")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    for c in ("keep_id", "kept", "class_id", "id", "score", "norm", "h", "s", "unit", "item_id", "lang_pred", "d1", "first_doc"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="module")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


def test_queries_equal_sql(spark, small):
    con = duck(small)
    for name, sql in queries.oracle_sql().items():
        got, want = queries.queries()[name](spark, small).toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want), name


def test_odd_rows_and_empty_tables(spark, odd):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    tests = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, ""), (None, "a b")], "item_id long, text string")
    labels = spark.createDataFrame([(4, 1), (2, 0), (None, 1), (7, None), (4, 0)], "doc_id long, toxic int")
    langs = odd.withColumn("lang", F.when(F.col("doc_id") < 6, "xx"))
    for df in (odd, odd.limit(0)):
        n = df.count()
        assert exact_dedup.exact_groups(df).count() == n
        assert ngram_join.similar(df).count() == n
        assert langid.identify(df, langid.train(langs)).count() == n
        assert langid.identify(df, langid.train(langs.limit(0))).filter("lang_pred <> 'und'").count() == 0
        assert toxicity.score(df, toxicity.train(odd, labels)).filter("score between 0 and 1").count() == n
        assert toxicity.score(df, toxicity.train(odd, labels.limit(0))).filter("score = 0.5").count() == n
        assert bpe.round_trip(df, path).count() == n
        assert licenses.scan_licenses(df).count() == 0
        assert licenses.scan_licenses(df, {}).count() == 0
        assert substring_dedup.remove_repeats(df).count() == n
        leaks = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(df, tests).collect()}
        assert leaks == ({(4, 1), (5, 1), (None, 1), (4, None), (5, None), (None, None), (8, None)} if n else set())
        assert decontaminate.leaks(df, tests.limit(0)).count() == 0
        for stage in (exact_dedup.drop_exact_copies, ngram_join.keep_one, lambda d: decontaminate.drop_leaks(d, tests), lambda d: langid.keep_identified(d, langid.train(langs))):
            assert stage(df).columns == df.columns and stage(df).count() <= n


def test_exact_groups(spark, odd):
    got = {r["doc_id"]: r for r in exact_dedup.exact_groups(odd).collect()}
    assert got[3]["keep_id"] == 3 and got[1]["keep_id"] == 3 and got[2]["group_size"] == 3
    assert got[None]["keep_id"] == 4 and not got[None]["kept"] and got[5]["group_size"] == 4


def test_exact_groups_with_colliding_digests(docs):
    weak = exact_dedup.exact_groups(docs, digest=lambda c: F.substring(F.md5(c), 1, 1))
    assert rows(weak.toPandas()) == rows(exact_dedup.exact_groups(docs).toPandas())


def test_exact_groups_null_id_alone(spark):
    df = spark.createDataFrame([(None, "only"), (-(2**63) + 1, "x"), (2**63 - 1, "x")], "doc_id long, text string")
    got = {r["doc_id"]: r["keep_id"] for r in exact_dedup.exact_groups(df).collect()}
    assert got == {None: None, -(2**63) + 1: -(2**63) + 1, 2**63 - 1: -(2**63) + 1}


def test_one_row_of_each_text_stays(spark):
    pairs = [(5, "a b"), (1, "c"), (5, "c"), (5, "a b"), (5, "ab"), (None, "d"), (None, "d"), (None, "e  f"), (2, "ef"), (None, None), (4, "")]
    for these in (pairs, pairs[::-1]):
        df = spark.createDataFrame(these, "doc_id long, text string").withColumn("keep_id", F.lit("clash"))
        got = exact_dedup.drop_exact_copies(df)
        assert got.columns == df.columns
        assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr) == sorted([(5, "a b"), (1, "c"), (None, "d"), (None, "e  f"), (4, "")], key=repr)
    alone = spark.createDataFrame([(1, "x"), (2, " x"), (3, "y"), (None, "x  ")], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["text"]) for r in exact_dedup.drop_exact_copies(alone).collect()) == [(0, "x  "), (3, "y")]


def grams(text):
    w = re.findall(tokens.WORD, (text or "").lower())
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def links_of(pairs):
    sets = {i: grams(t) for i, t in pairs}
    links, root = Counter(), {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if both and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i in ids}


def test_links_equal_brute_force(spark, docs):
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.similar(docs).collect()}
    assert got == links_of([(r["doc_id"], r["text"]) for r in docs.collect()])


def one_group(n):
    base = [f"w{i}" for i in range(120)]
    for i in range(n):
        w = list(base)
        w[i % 120] = f"x{i}"
        yield i, " ".join([f"z{k}" for k in range(i % 5)] + w if i >= n // 2 else w)


def test_large_group_over_several_tiles(spark, monkeypatch):
    pairs = list(one_group(400))
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    want = links_of(pairs)
    for texts, grams in ((512, 1 << 20), (64, 1 << 20), (512, 4000)):
        monkeypatch.setattr(ngram_join, "BLOCK", texts)
        monkeypatch.setattr(ngram_join, "BLOCK_GRAMS", grams)
        assert {r["doc_id"]: (r["class_id"], r["n_links"]) for r in ngram_join.similar(df).collect()} == want


def test_edges_grow_with_the_texts_of_a_group(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "BLOCK", 16)
    seen, tiles = [], ngram_join._tiles

    def counted(*args):
        seen.append(tiles(*args).filter("root is not null").count())
        return tiles(*args)

    monkeypatch.setattr(ngram_join, "_tiles", counted)
    sizes = (128, 256)
    for n in sizes:
        ngram_join.similar(spark.createDataFrame(list(one_group(n)), "doc_id long, text string")).count()
    assert all(k <= n + (n // 16) ** 2 // 2 for k, n in zip(seen, sizes, strict=True))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {r["node"]: r["root"] for r in components.components(edges).collect()} == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}
    assert components.components(edges.limit(0)).count() == 0


def test_reordered_passage_is_a_leak(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen"
    w = item.split()
    docs = spark.createDataFrame([(1, " ".join(["noise"] * 9 + w[8:] + ["between"] * 3 + w[:8])), (2, " ".join(w[:7] + ["x"] * 9)), (3, item.upper().replace(" ", ", "))], "doc_id long, text string")
    tests = spark.createDataFrame([(9, item)], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.leaks(docs, tests).collect()}
    assert set(got) == {1, 3} and got[1]["coverage"] == 1.0 and len(got[1]["spans"]) == 2
    blocks = decontaminate.leaks(docs, tests.union(tests.selectExpr("item_id + 1", "concat(text, ' more')")), block_bytes=50)
    assert {(r["doc_id"], r["item_id"]) for r in blocks.collect()} == {(1, 9), (3, 9), (1, 10), (3, 10)}


def test_leaks_equal_brute_force(spark, small, docs):
    from .test_kernels import slow_tiles

    items = {r["item_id"]: re.findall(tokens.WORD, r["text"].lower()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}
    some = docs.filter("n_chars < 1500")
    want = set()
    for r in some.collect():
        w = re.findall(tokens.WORD, r["text"].lower())
        runs = {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
        for i, t in items.items():
            if runs & {tuple(t[k : k + 5]) for k in range(len(t) - 4)} and sum(x[2] for x in slow_tiles(t, w, 5)) >= 0.5 * len(t):
                want.add((r["doc_id"], i))
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(some, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert got == want and want


def test_language_accuracy_on_held_out_rows(spark, small, docs):
    got = queries.op4_language(spark, small).join(docs.select("doc_id", "lang"), "doc_id")
    held = got.filter("held_out")
    assert held.filter("lang = lang_pred").count() >= 0.95 * held.count()


def test_junk_is_rejected_and_prose_kept(spark, docs):
    model = langid.train(docs)
    junk = spark.createDataFrame([(1, "\x01\x02\x7f" * 50 + "q"), (2, "12 34 !"), (3, None)], "doc_id long, text string")
    assert langid.keep_identified(junk, model).count() == 0
    assert langid.keep_identified(docs, model).count() == docs.count()


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op5_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    bad, good = got[got.toxic == 1].score.to_numpy(), got[got.toxic == 0].score.to_numpy()
    assert (bad[:, None] > good[None, :]).mean() > 0.95 and (good >= 0.5).mean() < 0.01


def test_licence_equals_definition(spark):
    one = lambda k: licenses.TEMPLATES[k].replace("\n\n", " ")
    texts = [
        "Licensed under the Apache License, Version 2.0", "LICENSED under the apache license version 2", one("mit"), "x\n\n" + one("isc").replace(". ", ".\n") + "\n\ny", "All rights", "the license of nothing at all",
        "/*\n * " + licenses.TEMPLATES["mit"].replace("\n\n", "\n *\n * ") + "\n */\n\nint main() { return 0; }\n\n" + "more of this\n" * 200, "Copyright 2020 Jane Doe. All rights reserved.",
        "It is old! Licensed under the Apache License, Version 2.0. It is long and it says quite a lot about other things. Really?", "All rights reserved.\n\n" * 3000, "",
    ]
    found = licenses.scan_licenses(spark.createDataFrame([*enumerate(texts), (99, None)], "doc_id long, text string")).collect()
    got = {(r["doc_id"], r["unit"], r["unit_no"]): (r["license"], r["part"], round(r["dice"], 6)) for r in found if not r["sentence_no"]}
    assert got[0, "line", 0] == ("apache-2.0-notice", 0, 1.0) and got[1, "line", 0][0] == "apache-2.0-notice"
    assert got[2, "line", 0] == ("mit", 0, 1.0) and got[3, "paragraph", 1] == ("isc", 0, 1.0)
    assert {got[6, "line", i] for i in (1, 3)} == {("mit", 1, 1.0), ("mit", 2, 1.0)} and got[6, "line", 5][0] == "mit"
    assert [(r["unit"], r["sentence_no"], r["license"], r["dice"]) for r in found if r["doc_id"] == 7] == [("sentence", 1, "all-rights-reserved", 1.0)]
    assert {(r["unit"], r["sentence_no"], r["license"]) for r in found if r["doc_id"] == 8} == {("sentence", 1, "apache-2.0-notice")}
    assert len([1 for r in found if r["doc_id"] == 9 and r["unit"] == "line"]) == 3000 and got[9, "text", 0][0] == "all-rights-reserved"
    assert not {r["doc_id"] for r in found} & {4, 5, 10, 99}


def test_template_with_accents_matches_itself(spark):
    own = "Cette \u0153uvre est mise \u00e0 disposition sous licence g\u00e9n\u00e9rale, \u00c9DITION libre."
    got = licenses.scan_licenses(spark.createDataFrame([(1, own), (2, own.upper())], "doc_id long, text string"), {"own": own}).collect()
    assert sorted((r["doc_id"], r["license"], r["dice"]) for r in got) == [(1, "own", 1.0), (2, "own", 1.0)]


def test_bpe_round_trip_equals_the_library(spark, docs):
    import hashlib

    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    t = Tokenizer.from_file(path)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r["doc_id"]: r for r in bpe.round_trip(docs, path).collect()}
    for r in docs.collect():
        ids = t.encode(r["text"], add_special_tokens=False).ids
        assert tuple(got[r["doc_id"]]) == (r["doc_id"], len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    back = bpe.decode(bpe.encode(docs, path), path)
    assert {r["doc_id"]: sha(r["text"]) for r in back.collect()} == {k: r["decoded_sha256"] for k, r in got.items()}


def slow_spans(pairs, least):
    units, first = {}, {}
    for i, text in sorted(pairs):
        at, mine = 0, []
        for m in re.finditer(r"[^\n]*(?:\n|\Z)", text):
            w = tuple(re.findall(tokens.WORD, m[0].lower()))
            if w:
                mine.append((at, m.start(), m.end(), w))
                at += 1
        units[i] = mine
        for n, _, _, w in mine:
            first.setdefault(w, (i, n))
    out = []
    for i, mine in units.items():
        run = []
        for u in [*mine, None]:
            if u is not None and first[u[3]] != (i, u[0]):
                run.append(u)
                continue
            if sum(len(x[3]) for x in run) >= least:
                out.append((i, run[0][1], run[-1][2], sum(len(x[3]) for x in run)))
            run = []
    return sorted(out)


def test_spans_equal_brute_force(spark, docs):
    pairs = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = sorted((r["doc_id"], r["span_start"], r["span_end"], r["n_words"]) for r in substring_dedup.repeated_spans(docs).collect())
    assert got == slow_spans(pairs, substring_dedup.MIN_WORDS) and got
    texts = dict(pairs)
    gone = defaultdict(list)
    for i, a, b, _ in got:
        gone[i].append((a, b))
    for r in substring_dedup.remove_repeats(docs, find=substring_dedup.repeated_spans).collect():
        text = texts[r["doc_id"]]
        for a, b in reversed(gone[r["doc_id"]]):
            text = text[:a] + text[b:]
        assert r["text"] == text and "".join(texts[r["doc_id"]][k["start"] : k["end"]] for k in r["kept"]) == text


def test_each_row_loses_the_repeats_of_its_own_text(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(60)) for c in "pq")
    pairs = [(3, one), (7, "first " + one), (7, "quite another text " + two), (7, "quite another text " + two), (None, "end " + two), (None, "nothing of this"), (None, one), (9, "short\n" + two), (9, None), (5, "short\n\nshort")]
    texts = lambda df, **k: sorted((r["doc_id"], r["text"]) for r in substring_dedup.remove_repeats(df, **k).fillna(-1, ["doc_id"]).collect())
    for these in (pairs, pairs[::-1]):
        df = spark.createDataFrame(these, "doc_id long, text string")
        assert texts(df) == sorted([(3, one), (7, "first "), (7, "quite another text " + two), (7, "quite another text " + two), (-1, "end "), (-1, "nothing of this"), (-1, ""), (9, "short\n"), (9, ""), (5, "short\n\nshort")])
        every = dict(texts(df.filter("doc_id in (5, 9)"), min_words=1, find=substring_dedup.repeated_spans))
        assert every[5] == "short\n\n" and two in {t for _, t in texts(df.filter("doc_id in (5, 9)"), min_words=1, find=substring_dedup.repeated_spans)}


def test_chat_snapshots(spark):
    long = [("user", "a"), ("assistant", "b"), ("user", "c")]
    rows = [(c, t, r, x) for c, n in ((1, 1), (2, 2), (3, 3), (4, 3)) for t, (r, x) in enumerate(long[:n])]
    rows += [(5, 0, "user", "a"), (5, 1, "assistant", "other"), (6, None, None, None), (None, 0, "user", "a")]
    rows += [(7, t, "user", str(t)) for t in range(600)] + [(8, t, "user", str(t)) for t in range(300)]
    got = {r["conv_id"]: r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n_turns", F.lit("clash"))).collect()}
    assert set(got) == {3, 5, 6, 7} and got[3]["n_copies"] == 2 and got[7]["n_turns"] == 600
    nameless = [(None, 1, "user", "a"), (None, 9, "user", "new"), (None, None, "user", "new"), (None, 0, None, None), (9, 0, "user", "only"), (None, 4, "user", "only")]
    more = chat.format_chats(spark.createDataFrame(rows + nameless, "conv_id long, turn long, role string, text string")).collect()
    line = "<|im_start|>{}\n{}<|im_end|>\n".format
    assert {(r["conv_id"], r["n_turns"], r["n_copies"], r["rendered"]) for r in more if r["n_turns"] == 1} == {(6, 1, 2, line("", "")), (9, 1, 2, line("user", "only")), (None, 1, 2, line("user", "new"))}
    assert got[5]["rendered"] == "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nother<|im_end|>\n"
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_audit_finds_what_differs(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "y" * (i % 7)) for i in range(3000)] + [(None, None, None), (None, None, None)], "page_id long, url string, html string").withColumn("file", F.lit("clash"))
    a = warc.archive(pages)
    assert warc.audit(a, warc.archive(pages)).count() == 0
    assert warc.audit(a.limit(0), a.limit(0)).count() == 0
    assert warc.audit(warc.archive(pages.limit(0)), warc.archive(pages.limit(0))).count() == 0
    b = warc.archive(warc.with_bit_rot(pages))
    want = {r["page_id"] for r in a.join(b.select("file", "seq", F.col("digest").alias("other")), ["file", "seq"]).filter("digest <> other").collect()}
    got = warc.audit(a, b).collect()
    assert {r["page_id"] for r in got} == want and want and {r["status"] for r in got} == {"corrupt"}
    lost = warc.audit(a, a.filter("file <> 2 or seq < 250")).collect()
    assert {r["page_id"] for r in lost} == set(range(762, 768)) and {r["status"] for r in lost} == {"missing"}
    assert {r["status"] for r in warc.audit(a.filter("file > 0"), a).collect()} == {"extra"}


def test_pipeline_equals_its_stages_by_brute_force(spark, small, docs):
    import corpus_pipeline as P
    from tokenizers import Tokenizer

    kept = P.language(spark, docs, small).collect()
    assert {r["doc_id"] for r in kept} == {r["doc_id"] for r in docs.collect()}
    best = {}
    for r in kept:
        norm = re.sub(r"[\x20\x09-\x0D]", "", r["text"])
        best.setdefault(norm, []).append((-len(r["text"]), r["doc_id"], r["text"]))
    kept = [(min(g)[1], min(g)[2]) for g in best.values()]
    found = links_of(kept)
    kept = [(i, t) for i, t in kept if found[i][0] == i]
    leaks = {r["doc_id"] for r in decontaminate.leaks(docs, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    t = Tokenizer.from_file(queries.tokenizer_path())
    want = {i: len(t.encode(x, add_special_tokens=False).ids) for i, x in kept if i not in leaks}
    assert {r["doc_id"]: r["n_tokens"] for r in P.run(spark, small).collect()} == want


def test_buckets(spark):
    import zlib

    got = spark.range(50).select("id", crc_bucket("id", 5).alias("b")).collect()
    assert all(r["b"] == zlib.crc32(str(r["id"]).encode()) % 5 for r in got)
