import math
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from millrace.functions import scoring as S
from millrace.functions import text as T


def one(spark, f, content, solution="", **more):
    row = spark.createDataFrame([(content, solution, *more.values())], ", ".join(["content string", "solution string", *[f"{k} string" for k in more]]))
    return row.select(f(*[F.col(c) for c in row.columns]).alias("x")).first()["x"]


FULL = "<think>a</think>\n<answer>b</answer>"


@pytest.mark.parametrize(("f", "content", "solution", "want"), [
    (lambda c, s: T.format_full(c), FULL, "", 1.0),
    (lambda c, s: T.format_full(c), FULL + " ", "", 0.0),
    (lambda c, s: T.format_graded(c), "<answer>b</answer>", "", 0.5),
    (lambda c, s: T.format_graded(c), "b", "", 0.0),
    (S.yes_no, "<answer>maybe</answer>", "unsure", 1.0),
    (S.yes_no, "<answer>now</answer>", "no", 1.0),
    (S.all_match, "<answer>Cat.</answer>", "cat", 1.0),
    (S.numeric, "<answer>3.0</answer>", "3", 1.0),
    (S.numeric, "<answer>x</answer>", "3", None),
    (S.count_score, "<answer>5 legs</answer>", "4", 0.8),
    (S.count_score, "<answer>bone</answer>", "1", 1.0),
    (S.count_score, "<answer>many</answer>", "4", 0.0),
    (S.identity, "Table. small", "table: wood", 0.9),
    (S.identity, "", "table", 0.0),
    (lambda c, s: S.think_quality(c), "<think>" + "word " * 22 + "a. b! c?</think>", "", 1.0),
    (lambda c, s: S.think_quality(c), "no tag", "", 0.0),
    (lambda c, s: S.repetition(c), "a b c d e f a b c d e f", "", -1 / 7),
    (lambda c, s: S.repetition(c), "one two three four five", "", 0.0),
    (lambda c, s: S.cosine_length(F.lit(0)), "", "", 1.0),
    (lambda c, s: S.cosine_length(F.lit(1024)), "", "", 0.5),
    (lambda c, s: S.cosine_length(F.lit(4096), F.lit(False)), "", "", 0.0),
    (lambda c, s: S.combined(F.lit(1.0), F.lit(0.5), F.lit(0.0)), "", "", 0.7),
    (S.mcq, "<answer>The answer is B. Not A.</answer>", "<answer>B</answer>", 1.0),
    (S.mcq, "nothing", "B", 0.0),
    (S.indel_ratio, "lewenstein", "levenshtein", 1 - 3 / 21),
    (S.indel_ratio, "", "", 1.0),
    (S.math_match, "\\boxed{\\dfrac12}", "1/2", 1.0),
    (S.default_accuracy, "<answer>4</answer>", "4.0", 1.0),
    (S.detection_answer, "<answer>None</answer>", "<answer>None</answer>", 1.0),
    (S.detection_answer, "no tag", "<answer>None</answer>", 0.0),
    (S.boxes_score, "x", "y", 1.0),
    (S.boxes_score, '```json[{"bbox_2d":[0,0,10,10],"label":"a"}]```', "y", 0.0),
    (S.boxes_score, '```json[{"bbox_2d":[0,0,10,10],"label":"a"}]```', '```json[{"bbox_2d":[0,0,10,10],"label":"a"}]```', 1.0),
    (S.boxes_score, '```json[{"bbox_2d":[0,0,10,10],"label":"z"}]```', '```json[{"bbox_2d":[0,0,10,10],"label":"a"}]```', 0.0),
])
def test_scores(spark, f, content, solution, want):
    got = one(spark, f, content, solution)
    assert got is None if want is None else math.isclose(got, want, abs_tol=1e-9)


def test_boxes_overlap(spark):
    box = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    got = spark.range(1).select(
        S.iou(box(0, 0, 10, 10), box(0, 0, 10, 10)).alias("same"), S.iou(box(0, 0, 10, 10), box(9, 9, 20, 20)).alias("pixel"),
        S.iou(box(0, 0, 0, 0), box(0, 0, 0, 0)).alias("nothing"), S.weighted_detection(F.lit("x"), F.lit("y")).alias("empty"),
    ).first()
    assert (got["same"], got["pixel"], got["nothing"], got["empty"]) == (1.0, 0.0, 0.0, 1.0)


def test_missing_method_is_default_and_llm_is_null(spark):
    rows = spark.createDataFrame([("cat", "cat", None), ("cat", "cat", "llm"), ("x", "y", "all_match")], "c string, s string, m string")
    assert [r[0] for r in rows.select(S.accuracy(F.col("c"), F.col("s"), F.col("m"))).collect()] == [1.0, None, 0.0]


def test_unknown_score(spark):
    with pytest.raises(ValueError, match="no such score"):
        S.score_columns(["nope"])


@pytest.mark.parametrize(("reply", "want"), [("50#fine", (50, "fine")), ("150#x", (-1, "150#x")), ("#x", (-1, "#x")), ("no hash", (-1, "no hash"))])
def test_judged_score(spark, reply, want):
    assert tuple(one(spark, lambda c, s: T.judged_score(c), reply)) == want


@pytest.mark.parametrize(("reply", "label"), [("7#car#close", "car"), ("99#x#y", "INVALID"), ("-1#NA#unsure", "INVALID"), ("no hash", "INVALID"), ("", "INVALID")])
def test_judged_class(spark, reply, label):
    assert one(spark, lambda c, s: T.judged_class(c, 40, F.lit(5)), reply)["label"] == label


def test_clean_answer_line_ends(spark):
    assert one(spark, lambda c, s: T.clean_answer(c), "<answer>A \n\nb\nC..</answer>") == "a b c"


def test_unicode_blanks(spark):
    assert one(spark, lambda c, s: F.size(T.words(c)), "a　b c ") == 3
    assert one(spark, lambda c, s: F.size(T.words(c)), "  ") == 0


@pytest.mark.parametrize(("said", "want"), [("I think A, but C.", "C"), ("B", "B"), ("(d)", None), ("answer: d", "D"), ("The answer is B. Not A.", "B"), ("", None), ("no letter", None), ("x? y!", "Y")])
def test_choice(spark, said, want):
    assert one(spark, lambda c, s: T.choice(c), said) == want


def test_only_the_method_of_a_row_is_worked_out(spark):
    """Weighted matching fails for a box of two numbers, which a row with another method may have."""
    box = '```json[{"bbox_2d": [1, 2], "label": "a"}]```'
    df = spark.createDataFrame([(1, f"yes {box}", f"yes {box}", "yes_no"), (2, "4", "4.0", None), (3, "cat", "cut", "other")], "id int, c string, s string, m string")
    got = {r["id"]: r["a"] for r in df.select("id", S.accuracy(F.col("c"), F.col("s"), F.col("m")).alias("a")).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: pytest.approx(2 / 3)}


def test_few_rows_of_a_batch_are_values_at_once():
    texts = pa.array([f"{k} " + "x" * 5000 for k in range(4000)])
    tracemalloc.start()
    got = S.indel_ratio.func(texts, texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [1.0] * 4000 and peak < 10e6, peak
    assert S.math_form.func(pa.array(["1/2", None, "0.5", "many words here"])).to_pylist() == ["1/2", None, "1/2", None]
    assert S.same_form.func(pa.array(["so \\boxed{1/2}", None, "a b"]), pa.array(["0.5", "1", "a b"])).to_pylist()[:2] == [True, None]


def test_an_answer_is_put_into_its_form_once_for_a_worker(monkeypatch):
    asked, form = [], S.algebra.math_form
    monkeypatch.setattr(S.algebra, "math_form", lambda x: asked.append(x) or form(x))
    batch = pa.array(["\\boxed{\\frac{7}{91}}", None, "7/91", "7/91", "many words of no form", "words " * 30])
    want = ["1/13", None, "1/13", "1/13", "text manywordsofnoform", "text " + "words" * 30]
    assert [S.math_key.func(batch).to_pylist() for _ in range(3)] == [want] * 3
    assert sorted(set(asked)) == sorted(["\\frac{7}{91}", "7/91", "many words of no form", "words " * 30]) and len(asked) == 3 + 3


def test_boxes_are_parsed_once(spark):
    rows = ["", "a b", '```json[{"bbox_2d": [1, 2, 3, 4], "label": "a"}, {"bbox_2d": [1, 2, 3, 4], "label": "a"}]```', "```json[]```", "```json{bad```", None]
    got = spark.createDataFrame([(k, x) for k, x in enumerate(rows)], "id int, c string").select("id", S.repetition(F.col("c")).alias("s"))
    assert [r["s"] for r in got.orderBy("id").collect()] == [0.0, 0.0, -0.5, 0.0, 0.0, None]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("from_json") == 1
