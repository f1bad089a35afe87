"""Each repair rule, valid JSON as it is, and what is salvaged from a list that was cut off."""

import json
import random
import time

import pytest

from millrace.functions import kernels, scoring
from millrace.functions.json_repair import repair_json

RULES = [
    ("{'a': 'b'}", {"a": "b"}),
    ("{“a”: ‘b’}", {"a": "b"}),
    ("{'it's': 'what's this'}", {"it's": "what's this"}),
    ('{"a": "he said "hi" to me", "b": 2}', {"a": 'he said "hi" to me', "b": 2}),
    ('{"a": "x\ny"}', {"a": "x\ny"}),
    ('{"a": "\\q \\u00e9 \\n"}', {"a": "\\q é \n"}),
    ('{"a": "\\ud83d\\ude00"', {"a": "😀"}),
    ('{"a": "\\ud83d", b: 1}', {"a": "�", "b": 1}),
    ('{"a": 1,}', {"a": 1}),
    ('{,"a": 1,, "b": 2}', {"a": 1, "b": 2}),
    ("[1, 2, 3,]", [1, 2, 3]),
    ('["a" "b"]', ["a", "b"]),
    ("[1 2 3]", [1, 2, 3]),
    ('{"a" 1 "b": 2}', {"a": 1, "b": 2}),
    ('{"a": 1 b: 2}', {"a": 1, "b": 2}),
    ('{"a":, "b":}', {"a": None, "b": None}),
    ("{a: 1, b: two words, c-d: True}", {"a": 1, "b": "two words", "c-d": True}),
    ("{a: None, b: NaN, c: undefined, d: FALSE}", {"a": None, "b": None, "c": None, "d": False}),
    ("[.5, +7, 007, 1., -0, 1e5]", [0.5, 7, 7, 1, 0, 1e5]),
    ('{"a": 1 /* c */, // x\n "b": 2 # y\n}', {"a": 1, "b": 2}),
    ("{url: http://x.y/z, b: 1}", {"url": "http://x.y/z", "b": 1}),
    ("[1, 2, 3", [1, 2, 3]),
    ('{"a": [1, {"b": 2', {"a": [1, {"b": 2}]}),
    ('{"a": "b', {"a": "b"}),
    ('{"a": 1, "b', {"a": 1}),
    ('{"a": 1, "b"', {"a": 1}),
    ('{"a": 1, "b":', {"a": 1, "b": None}),
    ("[1, 2}}", [1, 2]),
    ('{"a": [1, 2}', {"a": [1, 2]}),
    ('[{"a": 1, {"b": 2}]', [{"a": 1}, {"b": 2}]),
    ('text ```json\n{"a": 1}\n``` {"b": 2}', {"a": 1}),
    ("[", []),
    ("{{{", {}),
    ("[[[1", [[[1]]]),
]


@pytest.mark.parametrize(("text", "value"), RULES)
def test_rules(text, value):
    got = repair_json(text)
    assert json.loads(got) == value
    assert repair_json(got) == got


def test_nothing_to_repair():
    assert repair_json("no json") is None and repair_json("") is None
    for text in ('{"a": 1, "a": 2}', " [1 ,2]\n", "3", '"x"', "null", '{"a": "{"}'):
        assert repair_json(text) == text


def value(made, depth=3):
    kind = made.randrange(7 if depth else 4)
    if kind == 0:
        return made.choice([True, False, None])
    if kind == 1:
        return made.choice([0, -3, 1.5, 10**20])
    if kind < 4:
        return "".join(made.choice("ab ,:{}[]'\"\\\né#/") for _ in range(made.randrange(6)))
    if kind == 4:
        return [value(made, depth - 1) for _ in range(made.randrange(4))]
    return {f"k{i}": value(made, depth - 1) for i in range(made.randrange(4))}


def test_valid_json_stays_and_any_cut_or_damage_gives_json():
    made = random.Random(1)
    for _ in range(400):
        text = json.dumps({"v": value(made)}, ensure_ascii=made.random() < 0.5, indent=made.choice([None, 1]))
        assert repair_json(text) == text
        cut = repair_json(text[: made.randrange(1, len(text))])
        json.loads(cut)
        assert repair_json(cut) == cut
        damaged = list(text)
        for _ in range(made.randrange(1, 5)):
            damaged[made.randrange(len(damaged))] = made.choice("{}[],:\"'a1 \\\n")
        got = repair_json("[" + "".join(damaged))
        json.loads(got)
        assert repair_json(got) == got


def test_cut_objects_keep_what_was_whole():
    items = [{"q": f"what is {i}?", "a": [i, {"b": str(i)}]} for i in range(6)]
    text = json.dumps({"qas": items})
    for end in range(9, len(text)):
        cut = text[:end]
        saved = [json.loads(x) for x in kernels.salvaged_items(cut)]
        assert json.loads(repair_json(cut))["qas"][: len(saved)] == saved


def test_time_and_depth_are_bounded():
    began = time.perf_counter()
    for text in ("[" * 100_000, '{"a": ' * 50_000, '"' * 50_000 + "{" + "'" * 50_000, "{" + "a " * 50_000, "[" + '" ' * 50_000):
        repair_json(text)
    assert time.perf_counter() - began < 20


def test_columns(spark):
    df = spark.createDataFrame([("{'a': 1", '{"a": 1}'), (None, None), ("x", None)], "t string, want string")
    assert all(r["got"] == r["want"] for r in df.select(scoring.repaired_json("t").alias("got"), "want").collect())
