"""Canonical forms of mathematical answers: spellings of one value agree, other values do not, and values agree with floating point."""

import cmath
import math
import random
import time

import pytest

from millrace.functions import scoring
from millrace.functions.algebra import math_form

SAME = [
    ("\\frac{1}{2}", "0.5", "1/2", ".5", "50\\%", "50%", "\\dfrac12", "2/4", "½", "\\frac{2}{4}", "2^{-1}"),
    ("2\\sqrt{3}", "\\sqrt{12}", "12^{1/2}", "\\frac{6}{\\sqrt3}", "sqrt(12)", "√{12}", "2*3^(1/2)"),
    ("(x+1)^2", "x^2+2x+1", "1+2x+x**2", "(x+1)(x+1)", "x(x+2)+1"),
    ("\\frac{1}{1+\\sqrt{2}}", "\\sqrt2-1"),
    ("\\frac{\\sqrt{2}+\\sqrt{3}}{\\sqrt{6}}", "\\frac{\\sqrt3}{3}+\\frac{\\sqrt2}{2}"),
    ("\\frac{x^2-1}{x-1}", "x+1"),
    ("\\frac{1}{x+1}+\\frac{1}{x-1}", "\\frac{2x}{x^2-1}", "\\frac{4x^2}{2x^3-2x}"),
    ("\\frac{x^2-y^2}{x-y}", "y+x"),
    ("(1, 2)", "\\left(1,\\frac{4}{2}\\right)"),
    ("[0,\\infty)", "[0, +\\infty)", "[0,∞)"),
    ("x=5", "5", "5.0", "5\\text{ cm}", "\\$5", "5^\\circ", "$5$", "5.", "x = \\frac{10}{2}"),
    ("1,000", "1000", "10^3", "1{,}000"),
    ("\\{1,2\\}", "\\{2,1\\}", "x=1 or x=2", "1, 2", "2,1", "1 \\text{ and } 2"),
    ("\\pm 3", "3,-3", "x=\\pm3"),
    ("1\\pm\\sqrt{2}", "1-\\sqrt2, 1+\\sqrt2"),
    ("(-\\infty,1)\\cup(2,3]", "(2,3]\\cup(-\\infty,1)"),
    ("1\\frac{1}{2}", "3/2", "1 1/2", "1.5"),
    ("\\frac{\\pi}{4}", "\\pi/4", "0.25\\pi", "π/4"),
    ("xy+yz", "yz+yx", "y(x+z)"),
    ("2x+3y=6", "x+\\frac{3}{2}y=3", "6=2x+3y"),
    ("x<3", "3>x", "2x<6"),
    ("-2x \\le 4", "x \\geq -2"),
    ("\\sin^2 x", "(\\sin x)^2"),
    ("3!", "6", "\\binom{4}{2}"),
    ("(1+i)(1-i)", "2"),
    ("\\frac{1}{i}", "-i"),
    ("\\sqrt{-4}", "2i"),
    ("\\sqrt[3]{-8}", "-2", "-\\sqrt[3]{8}"),
    ("-2^2", "-4"),
    ("\\log_2 8", "\\log_{2}{8}"),
    ("|{-3}|", "3"),
    ("\\frac{a}{b}", "a/b", "ab^{-1}"),
    ("\\sqrt{1+\\sqrt2}\\sqrt{1+\\sqrt2}", "1+\\sqrt{2}"),
    ("\\sqrt{2}\\sqrt[3]{2}", "2^{5/6}"),
    ("2^{2^3}", "256"),
]
NONE = ["the answer", "no", "on", "", " ", "cat", "1..2", "((", "x^", "\\text{yes}", "3 4", "\\frac{1}{0}", "(1+x)^{100000}", "9^{9^{9}}", "1,2,", "\\sqrt{x^2}", "\\frac{", "{", "!", "答案", "1 = 1", "x" * 5000]


@pytest.mark.parametrize("group", SAME, ids=lambda g: g[0])
def test_spellings_of_one_value_agree(group):
    forms = {math_form(x) for x in group}
    assert len(forms) == 1 and None not in forms, {x: math_form(x) for x in group}


def test_other_values_differ():
    forms = [math_form(g[0]) for g in SAME]
    assert len(set(forms)) == len(forms)
    for a, b in (("(1,2)", "(2,1)"), ("[1,2]", "(1,2]"), ("\\sqrt2", "1.414"), ("x<3", "x\\le3"), ("x+y", "xy"), ("B", "b"), ("-2^2", "(-2)^2"), ("x_1", "x_2"), ("12", "1,2"), ("\\frac{1}{3}", "0.333")):
        assert math_form(a) != math_form(b) and None not in (math_form(a), math_form(b))


@pytest.mark.parametrize("text", NONE)
def test_what_does_not_parse_has_no_form(text):
    assert math_form(text) is None


def test_forms_are_forms_of_themselves():
    for g in SAME[:7]:
        form = math_form(g[0])
        assert math_form(form) == form


def expression(made, depth):
    """A random expression as text and as a function of complex numbers."""
    if depth == 0 or made.random() < 0.2:
        if made.random() < 0.4:
            return "x", lambda x: x
        n = made.randrange(1, 12)
        return (str(n), lambda x: n) if made.random() < 0.7 else (f"\\sqrt{{{n}}}", lambda x: cmath.sqrt(n))
    (a, f), (b, g) = expression(made, depth - 1), expression(made, depth - 1)
    kind = made.randrange(5)
    if kind == 0:
        return f"({a}+{b})", lambda x: f(x) + g(x)
    if kind == 1:
        return f"({a}-{b})", lambda x: f(x) - g(x)
    if kind == 2:
        return f"{a} \\cdot {b}", lambda x: f(x) * g(x)
    if kind == 3:
        return f"\\frac{{{a}}}{{{b}}}", lambda x: f(x) / g(x)
    return f"({a})^{{2}}", lambda x: f(x) ** 2


def evaluated(form, x):
    names = {"sqrt": cmath.sqrt, "x": x, "i": 1j}
    return complex(eval(form.replace("^", "**"), {}, names))  # noqa: S307  (a form made here)


def test_forms_have_the_value_of_the_expression():
    made, seen = random.Random(1), 0
    for _ in range(400):
        text, f = expression(made, 3)
        try:
            want = f(1.37)
        except ZeroDivisionError:
            continue
        form = math_form(text)
        if form is None:
            continue
        seen += 1
        got = evaluated(form, 1.37)
        assert math.isclose(abs(got - want), 0, abs_tol=1e-6 * max(1, abs(want))), (text, form)
    assert seen > 300


def test_time_is_bounded():
    began = time.perf_counter()
    for text in ("(" * 1999, "(1+x)^{400}", "(a+b+c+x+y+z)^{40}", "\\frac{" * 300 + "1" + "}{2}" * 300, "1+" * 900 + "1", "\\sqrt{" * 200 + "2" + "}" * 200, "99999999999999999999!^{9}", "(a+b+c)^{20}/(x+y+z)^{20}+1/(a+x)^{9}+1/(b+y)^9"):
        math_form(text)
    assert time.perf_counter() - began < 20


def test_scores_use_the_forms(spark):
    rows = [("<answer>\\boxed{\\frac{6}{\\sqrt3}}</answer>", "2\\sqrt{3}", 1.0), ("<answer>\\boxed{x^2+2x+1}</answer>", "(x+1)^2", 1.0), ("<answer>0.3</answer>", "1/3", 0.0), ("<answer>same words</answer>", "same words", 1.0), ("<answer>on</answer>", "no", 0.0)]
    df = spark.createDataFrame(rows, "content string, solution string, want double")
    got = df.select(scoring.math_match(df.content, df.solution).alias("got"), "want", scoring.default_accuracy(df.content, df.solution).alias("default")).collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]
    assert [r["default"] for r in got[:2]] == [1.0, 1.0] and got[2]["default"] < 1
    assert [r[0] for r in df.select(scoring.math_form("solution")).collect()][4] is None
