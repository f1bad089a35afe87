"""Text extraction and clean-up as Column expressions.

Blanks are those of Unicode, as Python has them: Java's ``\\s`` is ASCII unless
a pattern starts with ``(?U)``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK = r"[\s\x1c-\x1f]"
#: The same as characters.
_BLANKS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: The same matches as of ``(?s)`` with ``ANSWER`` and ``FENCE``: whole runs up to a sign that may end them, not a try of the end at every character.
WHOLE_ANSWER, _WHOLE_FENCE = r"<answer>([^<]*+(?:<(?!/answer>)[^<]*+)*+)</answer>", r"```json([^`]*+(?:`(?!``)[^`]*+)*+)```"
ANSWER, THINK, FENCE = r"<answer>(.*?)</answer>", r"<think>(.*?)</think>", r"```json(.*?)```"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once for a row: inside a lambda, other columns are computed anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Without blanks at both ends."""
    return F.trim(c, F.lit(_BLANKS))


def words(c: Column) -> Column:
    """Runs of characters other than blanks; none for a blank text."""
    return F.filter(F.split(c, rf"(?U){_BLANK}+"), lambda w: w != "")


def found(c: Column, pattern: str, group: int = 1) -> Column:
    """A group of the first match; null, not empty, where nothing matches."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def last_found(c: Column, pattern: str) -> Column:
    """The first group of the last match, or null."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.lit(-1))


def last_answer(c: Column) -> Column:
    """The last answer tag's content, else the whole text; stripped."""
    return strip(F.coalesce(last_found(c, WHOLE_ANSWER), c))


def first_answer(c: Column, across_lines: bool = True) -> Column:
    """The first answer tag's content, else the whole text; stripped. Truth sides do not match across lines."""
    return strip(F.coalesce(found(c, ("(?s)" if across_lines else "") + ANSWER), c))


def last_think(c: Column) -> Column:
    """The last think tag's content, stripped; empty without one."""
    return strip(F.coalesce(last_found(c, "(?s)" + THINK), F.lit("")))


def clean_answer(c: Column) -> Column:
    """The last answer on one line, stripped, without full stops at its end, in lower case.

    A line end after a blank goes; any other becomes a space.
    """
    out = F.coalesce(last_found(c, WHOLE_ANSWER), c)
    for end in ("\n", "\r"):
        # The line end is looked for first, and what is before it then; those that stay have no blank before them.
        out = F.replace(F.regexp_replace(out, rf"(?U){end}(?<={_BLANK}{end})", ""), F.lit(end), F.lit(" "))
    return F.lower(F.regexp_replace(strip(out), r"\.+\z", ""))


def clean_part(c: Column) -> Column:
    """The last answer in lower case, stripped, blanks collapsed."""
    return F.regexp_replace(strip(F.lower(last_answer(c))), rf"(?U){_BLANK}+", " ")


#: The layouts that completions are asked for.
LAYOUT = r"<think>.*?</think>\s*<answer>.*?</answer>"
BOX_LAYOUTS = {
    "object": r"<think>.*?</think>\s*<answer>.*?\{.*\[\d+,\s*\d+,\s*\d+,\s*\d+\].*\}.*?</answer>",
    "list": r"<think>.*?</think>\s*<answer>.*?\[\d+,\s*\d+,\s*\d+,\s*\d+\].*?</answer>",
}


def _score(c: Column) -> Column:
    return c.cast("double")


def format_full(c: Column) -> Column:
    """1 if the whole text is a thought and an answer."""
    return _score(c.rlike(rf"(?sU)\A{LAYOUT}\z"))


def format_prefix(c: Column) -> Column:
    """1 if the text starts with a thought and an answer, each on one line."""
    return _score(c.rlike(rf"(?U)\A{LAYOUT}"))


def format_graded(c: Column) -> Column:
    """1 for the whole layout, 0.5 for an answer alone."""
    return F.when(c.rlike(rf"(?sU)\A{LAYOUT}\z"), 1.0).when(c.rlike("(?s)" + ANSWER), 0.5).otherwise(0.0)


def format_box(c: Column, layout: str = "object") -> Column:
    """1 if the answer holds four numbers, in an object or a list."""
    return _score(c.rlike(f"(?sU){BOX_LAYOUTS[layout]}"))


_INT4 = r"\[(\d+),\s*(\d+),\s*(\d+),\s*(\d+)\]"
_FLOAT = r"(\s*-?\d*\.?\d+\s*)"


def _box(c: Column, pattern: str) -> Column:
    parts = F.array(*[strip(F.regexp_extract(c, pattern, k)).try_cast("double") for k in range(1, 5)])
    return F.when(c.rlike(pattern), parts).otherwise(F.array(*[F.lit(0.0)] * 4))


def box_in_object(c: Column) -> Column:
    """The last four integers in a list inside an object of the first answer; zeros without."""
    inner = strip(F.coalesce(found(c, "(?s)" + ANSWER), F.lit("")))
    return _box(inner, r"(?s)\{.*\[(\d+),\s*(\d+),\s*(\d+),\s*(\d+)]\s*.*\}")


def box_in_list(c: Column) -> Column:
    """The first list of four integers of the first answer; zeros without."""
    return _box(strip(F.coalesce(found(c, "(?s)" + ANSWER), F.lit(""))), _INT4)


def box_anywhere(c: Column) -> Column:
    """The first list of four signed decimals anywhere; zeros without."""
    return _box(c, rf"\[{_FLOAT},\s*{_FLOAT},\s*{_FLOAT},\s*{_FLOAT}\]")


BOXES = "array<struct<bbox_2d:array<double>,label:string>>"


def fence(c: Column, last: bool = False) -> Column:
    """The content of the first (or last) JSON fence as it is; null without one."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(_WHOLE_FENCE), F.lit(1)), F.lit(-1 if last else 1))


def fenced_json(c: Column, last: bool = False) -> Column:
    """The content of the first (or last) JSON fence, stripped; null without one."""
    return strip(fence(c, last))


def fenced_boxes(c: Column, last: bool = False) -> Column:
    """The boxes of a JSON fence; an empty array if there are none or they do not parse."""
    return parsed_boxes(fenced_json(c, last))


def parsed_boxes(c: Column) -> Column:
    """The boxes of a JSON text; an empty array if it is null or does not parse."""
    return F.coalesce(F.from_json(c, BOXES), F.array().cast(BOXES))


def box_in_fence(c: Column) -> Column:
    """The first box of the first JSON fence; zeros without."""
    return F.coalesce(F.try_element_at(fenced_boxes(c), F.lit(1))["bbox_2d"], F.array(*[F.lit(0.0)] * 4))


def strip_fence(c: Column) -> Column:
    """Without the outer fence's first and last line."""
    t = strip(F.coalesce(c, F.lit("")))
    inner = F.regexp_replace(F.regexp_replace(t, r"\A```[^\n]*(\n|\z)", ""), r"(\A|\n)```[^\n]*\z", "")
    return F.when(t.startswith("```"), strip(inner)).otherwise(t)


def outer_braces(c: Column) -> Column:
    """From the first opening to the last closing brace; null without."""
    return found(c, r"(?s)(\{.*\})")


def fenced_parts(c: Column) -> Column:
    """The elements of a fence's ``parts``, of its list, or itself as one element; JSON texts."""
    body = F.coalesce(fenced_json(c), strip_fence(c))
    v = F.try_parse_json(body)
    kind = F.schema_of_variant(v)
    as_list = F.try_variant_get(v, "$", "array<variant>")
    parts = F.try_variant_get(v, "$.parts", "array<variant>")
    return F.transform(F.when(kind.startswith("ARRAY"), as_list).when(parts.isNotNull(), parts).when(v.isNotNull(), F.array(v)).otherwise(F.array().cast("array<variant>")), lambda x: F.to_json(x))


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"\r\n|[\n\r]"), strip), lambda x: x != "")


def name_caption(c: Column, fallback: Column, joined: str = "\n", keep_empty_name: bool = False) -> Column:
    """(name, caption) of ``Name:`` and ``Caption:`` lines, the last of each.

    Without a name the fallback holds; without a caption all lines but names do.
    """
    lines = _lines(F.coalesce(c, F.lit("")))
    named = F.filter(lines, lambda x: F.lower(x).startswith("name:"))
    captions = F.filter(lines, lambda x: F.lower(x).startswith("caption:") & ~F.lower(x).startswith("name:"))
    after = lambda x: strip(F.regexp_replace(x, r"(?s)\A[^:]*:", ""))
    name = F.coalesce(F.nullif(after(F.try_element_at(named, F.lit(-1))), F.lit("")), fallback)
    caption = F.nullif(after(F.try_element_at(captions, F.lit(-1))), F.lit(""))
    rest = strip(F.array_join(F.filter(lines, lambda x: ~F.lower(x).startswith("name:")), joined))
    return F.struct(name.alias("name"), F.coalesce(caption, rest).alias("caption"))


def sections(c: Column) -> Column:
    """Content by number of ``[Part n]`` or ``[部件 n]`` headings, as a map; the last of equal numbers holds.

    ``spark.sql.mapKeyDedupPolicy`` plays no part: later duplicates are kept by position.
    """
    heads = r"(?i)\[(?:部件|Part)\s*(\d+)\]"
    numbers = F.transform(F.regexp_extract_all(c, F.lit(heads), F.lit(1)), lambda x: x.cast("int"))
    bodies = F.slice(F.split(c, heads), 2, 1 << 30)
    last = let(F.arrays_zip(numbers.alias("n"), bodies.alias("body")), lambda pairs: F.filter(pairs, lambda x, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda y: y["n"] == x["n"])))
    return F.map_from_entries(last)


def problem_solution(c: Column) -> Column:
    """(problem, solution): the text before the first thought, and the thoughts joined in one with the last answer."""
    parts = F.split(c, "<think>")
    problem = F.regexp_replace(F.regexp_replace(strip(F.element_at(parts, 1)), r"(?U)\AQuestion:\s*", ""), r"(?U)\s*Answer:\s*\z", "")
    closed = F.filter(F.slice(parts, 2, 1 << 30), lambda p: p.contains("</think>"))
    thoughts = F.transform(closed, lambda p: strip(F.element_at(F.split(p, "</think>"), 1)))
    tail = F.element_at(F.split(F.element_at(F.split(c, "<answer>"), -1), "</answer>"), 1)
    answer = F.regexp_replace(strip(tail), r"(?U)\AAnswer:\s*", "")
    said = F.when(c.contains("<answer>"), F.concat(F.lit("\n\n<answer>"), answer, F.lit("</answer>"))).otherwise("")
    return F.struct(strip(problem).alias("problem"), F.concat(F.lit("<think>"), F.array_join(thoughts, " "), F.lit("</think>"), said).alias("solution"))


#: Words near a letter that mark it as the chosen one.
CHOICE_WORDS = ["答案", "选择", "正确", "是", "对", "answer", "correct", "choose", "select", "right", "认为", "应该", "觉得", "think", "believe", "should"]


def choice(c: Column) -> Column:
    """The letter that a text chooses; null if there is none.

    Letters without a letter before them and with punctuation or the end after
    them count.  Of several, each scores by what surrounds its first occurrence
    in the text, wherever that is; of equal scores the first found holds.
    """
    def score(t: Column, x: Column) -> Column:
        at = F.instr(t, x) - 1
        begin = F.greatest(at - 20, F.lit(0))
        context = F.substr(t, begin + 1, at + 20 - begin)
        near = sum((context.contains(w.upper()).cast("int") for w in CHOICE_WORDS), F.lit(0))
        late = F.when(at > F.length(t) * 0.7, 2).otherwise(0)
        stop = F.when((at < F.length(t) - 1) & F.lit("。.!！,，").contains(F.substr(t, at + 2, F.lit(1))), 1).otherwise(0)
        return near + late + stop

    def chosen(t: Column) -> Column:
        letters = F.array_distinct(F.regexp_extract_all(t, F.lit(r"(?<![A-Z])([A-Z])(?=[.,?!:;]|\z)"), F.lit(1)))
        return F.array_max(F.transform(letters, lambda x, i: F.struct(score(t, x).alias("score"), (-i).alias("order"), x.alias("letter"))))["letter"]

    return let(F.regexp_replace(F.upper(c), rf"(?U){_BLANK}+", " "), chosen)


def judged_truth(c: Column) -> Column:
    """(label, reason) of ``T#reason``: the first character if it is T or F in any case, else INVALID (as for an empty reply)."""
    first = F.upper(F.substring(c, 1, 1))
    return F.struct(F.when(first.isin("T", "F"), first).otherwise("INVALID").alias("label"), F.substr(c, F.lit(3)).alias("reason"))


def judged_class(c: Column, classes: int, key: Column) -> Column:
    """(result, label, reason, valid) of ``index#label#reason``; an invalid reply picks a class by a hash of ``key``."""
    said = strip(F.coalesce(found(c, r"(\d+#[^#]*#[^\n]*\z)"), c))
    parts = F.split(said, "#")
    part = lambda k: F.coalesce(F.try_element_at(parts, F.lit(k)), F.lit(""))
    number = strip(part(1)).try_cast("bigint")
    valid = F.coalesce((number >= 0) & (number < classes) & (part(2) != "NA"), F.lit(False))
    pick = F.pmod(key * 2654435761 % (1 << 32), F.lit(classes))
    return F.struct(
        F.when(valid, number).otherwise(pick).cast("bigint").alias("result"), F.when(valid, part(2)).otherwise("INVALID").alias("label"),
        F.when(valid, part(3)).otherwise(said).alias("reason"), valid.alias("valid"),
    )


def judged_score(c: Column) -> Column:
    """(score, reason) of ``score#reason``: -1 if the score is not a whole number from 0 to 100."""
    said = strip(F.coalesce(found(c, r"(\d*#[^\n]*)"), c))
    parts = F.split(said, "#")
    number = strip(F.element_at(parts, 1)).try_cast("bigint")
    valid = F.coalesce(number.between(0, 100), F.lit(False))
    return F.struct(F.when(valid, number).otherwise(-1).cast("bigint").alias("score"), F.when(valid, F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))).otherwise(said).alias("reason"))


def judged_flag(c: Column) -> Column:
    """1 if the reply, after an ``output:`` in front, starts with T."""
    t = strip(F.regexp_replace(strip(c), r"(?i)\Aoutput:", ""))
    return F.upper(F.substring(t, 1, 1)).eqNullSafe(F.lit("T")).cast("double")


#: Names of limbs on either side.
LEFT = ["左前肢", "左前腿", "左前爪", "左前臂", "左前足", "左前"]
RIGHT = ["右前肢", "右前腿", "右前爪", "右前臂", "右前足", "右前"]


def side(c: Column, left: list[str] | None = None, right: list[str] | None = None) -> Column:
    """``left`` or ``right`` by the words a name holds, left ones first; else null."""
    low = F.lower(strip(c))
    has = lambda keys: F.lit(False) if not keys else low.rlike("|".join(keys))
    return F.when(has(LEFT if left is None else left), "left").when(has(RIGHT if right is None else right), "right")


#: Number words in the order in which they are looked for.
NUMBER_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve"]


def number_word(c: Column) -> Column:
    """The first of the number words that a text holds anywhere, as a number; null without."""
    out = F.when(F.lit(False), F.lit(0))
    for n, w in enumerate(NUMBER_WORDS):
        out = out.when(F.lower(c).contains(w), n)
    return out


def parameters(c: Column) -> Column:
    """The largest size such as ``7b``, ``1.5m`` or ``8x7b`` that a name holds, as a number; -1 without."""
    pattern = F.lit(r"((\d+(\.\d+)?)(x(\d+(\.\d+)?))?)([bm])")
    low = F.lower(c)
    one, two, unit = (F.regexp_extract_all(low, pattern, F.lit(k)) for k in (2, 5, 7))
    sizes = F.transform(F.arrays_zip(one.alias("a"), two.alias("b"), unit.alias("u")), lambda x: x["a"].cast("double") * F.coalesce(x["b"].try_cast("double"), F.lit(1.0)) * F.when(x["u"] == "b", 1e9).otherwise(1e6))
    return F.coalesce(F.array_max(sizes).cast("bigint"), F.lit(-1).cast("bigint"))


def base_name(c: Column) -> Column:
    """A path's last part without its extension."""
    return F.regexp_replace(F.regexp_extract(c, r"([^/]*)\z", 1), r"(?<=.)\.[^.]*\z", "")


#: The names of eight directions, from 0 degrees, and of four heights.
DIRECTIONS = ["侧面", "斜向正面", "正面", "斜向正面", "侧面", "斜向背面", "背面", "斜向背面"]
HEIGHTS = {60: "俯视", 30: "高角度俯视", -15: "平视"}
LOWEST = "仰视"


def view_direction(azimuth: Column, elevation: Column) -> Column:
    """A view's direction in words: one of eight octants around 90 degrees, and one of four heights."""
    octant = F.floor(F.pmod(F.pmod(azimuth, F.lit(360.0)) + 22.5, F.lit(360.0)) / 45).cast("int")
    names = F.element_at(F.array(*map(F.lit, DIRECTIONS)), octant + 1)
    height = F.when(F.lit(False), F.lit(""))
    for over, name in HEIGHTS.items():
        height = height.when(elevation > over, name)
    return F.concat(names, F.lit("，"), height.otherwise(LOWEST))


def render_chat(roles: Column, texts: Column, system: str, separators: tuple[str, str], style: str = "two") -> Column:
    """A prompt from parallel arrays of roles and messages.

    ``single`` uses the first separator throughout, ``two`` takes turns, ``plain``
    puts the role and message together without a colon.  A null message leaves
    its turn open.
    """
    first, second = separators
    n = lambda i: F.lit(first) if style != "two" else F.when(i % 2 == 0, first).otherwise(second)
    colon, gap = (":", " ") if style != "plain" else ("", "")
    turns = F.transform(F.arrays_zip(roles.alias("r"), texts.alias("t")), lambda x, i: F.when(x["t"].isNull(), F.concat(x["r"], F.lit(colon))).otherwise(F.concat(x["r"], F.lit(colon + gap), x["t"], n(i))))
    return F.concat(F.lit(system + (first if style != "plain" else "")), F.array_join(turns, ""))


def mapped_roles(turns: Column) -> Column:
    """Turns (from, value) with user and assistant for roles, without a leading turn that is not a human's."""
    role = lambda x: F.when(F.lower(x["from"]).isin("human", "user"), "user").otherwise("assistant")
    starts = F.lower(F.element_at(turns, 1)["from"]).isin("human", "user")
    kept = F.when(F.size(turns) == 0, turns).when(starts, turns).otherwise(F.slice(turns, 2, 1 << 30))
    return F.transform(kept, lambda x: F.struct(role(x).alias("role"), x["value"].alias("content")))


def plain_chat(turns: Column) -> Column:
    """``role: content`` lines."""
    return F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit(": "), x["content"], F.lit("\n"))), "")


def question_text(task: Column, problem: Column, templates: dict[str, str], default: str = "{Question}") -> Column:
    """The task's template with the question put in; the default for other tasks."""
    text = F.when(F.lit(False), F.lit(""))
    for k, t in templates.items():
        text = text.when(task == k, t)
    return F.replace(text.otherwise(default), F.lit("{Question}"), problem)


def with_patches(c: Column, patches: int = 511, field: str = "<point>", start: str = "<point_start>", end: str = "<point_end>", patch: str = "<point_patch>") -> Column:
    """The text with its payload field replaced by ``patches`` patch tokens between a start and an end."""
    return F.replace(c, F.lit(field), F.lit(start + patch * patches + end))
