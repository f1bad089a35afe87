"""Text extraction and scores of completions: inventory T and R."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import reports
from .base import BOXES, COMPLETIONS, JUDGED, boxes, completions, derived, judged, query, rounded, table

C = f"WITH c AS ({COMPLETIONS}), "


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^[\s]+|[\s]+$', '', 'g')"


LAST = r"list_extract(regexp_extract_all({0}, '(?s)<answer>(.*?)</answer>', 1), -1)"


def _last(x: str) -> str:
    return _strip(f"coalesce({LAST.format(x)}, {x})")


def _first(x: str, dot: bool = True) -> str:
    return _strip(f"coalesce(list_extract(regexp_extract_all({x}, '{'(?s)' if dot else ''}<answer>(.*?)</answer>', 1), 1), {x})")


def _think(x: str) -> str:
    return _strip(f"coalesce(list_extract(regexp_extract_all({x}, '(?s)<think>(.*?)</think>', 1), -1), '')")


def _clean(x: str) -> str:
    out = f"coalesce({LAST.format(x)}, {x})"
    for end in (r"\n", r"\r"):
        out = rf"regexp_replace(regexp_replace({out}, '(\s){end}+', '\1', 'g'), '(^|\S){end}', '\1 ', 'g')"
    return rf"lower(regexp_replace({_strip(out)}, '\.+$', ''))"


def _part(x: str) -> str:
    return rf"regexp_replace({_strip('lower(' + _last(x) + ')')}, '\s+', ' ', 'g')"


def _words(x: str) -> str:
    return rf"list_filter(string_split_regex({x}, '\s+'), lambda w: w <> '')"


@query(f"WITH c AS ({COMPLETIONS}) SELECT id, {_last('content')} AS answer FROM c")
def t1_last_answer(spark, sf):
    return completions(spark, sf).select("id", T.last_answer(F.col("content")).alias("answer"))


@query(f"WITH c AS ({COMPLETIONS}) SELECT id, {_first('content')} AS answer, {_first('solution', False)} AS truth FROM c")
def t2_first_answer(spark, sf):
    return completions(spark, sf).select("id", T.first_answer(F.col("content")).alias("answer"), T.first_answer(F.col("solution"), False).alias("truth"))


@query(f"WITH c AS ({COMPLETIONS}) SELECT id, {_think('content')} AS thought FROM c")
def t3_last_think(spark, sf):
    return completions(spark, sf).select("id", T.last_think(F.col("content")).alias("thought"))


@query(f"WITH c AS ({COMPLETIONS}) SELECT id, {_clean('content')} AS cleaned FROM c")
def t4_clean_answer(spark, sf):
    return completions(spark, sf).select("id", T.clean_answer(F.col("content")).alias("cleaned"))


@query(f"WITH c AS ({COMPLETIONS}) SELECT id, {_part('content')} AS cleaned FROM c")
def t5_clean_part(spark, sf):
    return completions(spark, sf).select("id", T.clean_part(F.col("content")).alias("cleaned"))


_FULL = r"regexp_full_match(content, '(?s)<think>.*?</think>\s*<answer>.*?</answer>')"


@query(rf"""WITH c AS ({COMPLETIONS}) SELECT id, CAST({_FULL} AS DOUBLE) AS full_match,
 CAST(regexp_matches(content, '^<think>.*?</think>\s*<answer>.*?</answer>') AS DOUBLE) AS prefix_match,
 CASE WHEN {_FULL} THEN 1.0 WHEN regexp_matches(content, '(?s)<answer>.*?</answer>') THEN 0.5 ELSE 0.0 END::DOUBLE AS graded FROM c""")
def t6_t7_t8_formats(spark, sf):
    c = F.col("content")
    return completions(spark, sf).select("id", T.format_full(c).alias("full_match"), T.format_prefix(c).alias("prefix_match"), T.format_graded(c).alias("graded"))


#: Answers with boxes in the spellings that the extractors know.
BOX_TEXTS = f"""SELECT image_id * 10 + ord AS id, CASE (image_id + ord) % 5
 WHEN 0 THEN '<think>t</think> <answer>{{"bbox_2d": [' || CAST(CAST(x1 AS BIGINT) AS STRING) || ', ' || CAST(CAST(y1 AS BIGINT) AS STRING) || ', ' || CAST(CAST(x2 AS BIGINT) AS STRING) || ',' || CAST(CAST(y2 AS BIGINT) AS STRING) || '] }}</answer>'
 WHEN 1 THEN '<think>t</think><answer>[' || CAST(CAST(x1 AS BIGINT) AS STRING) || ', ' || CAST(CAST(y1 AS BIGINT) AS STRING) || ', ' || CAST(CAST(x2 AS BIGINT) AS STRING) || ', ' || CAST(CAST(y2 AS BIGINT) AS STRING) || ']</answer>'
 WHEN 2 THEN 'box: [ ' || CAST(CAST(x1 AS BIGINT) AS STRING) || '.5, -' || CAST(CAST(y1 AS BIGINT) AS STRING) || ', ' || CAST(CAST(x2 AS BIGINT) AS STRING) || ', .25 ] and [1, 2, 3, 4]'
 WHEN 3 THEN 'see ```json' || chr(10) || '[{{"bbox_2d": [' || CAST(CAST(x1 AS BIGINT) AS STRING) || ', ' || CAST(CAST(y1 AS BIGINT) AS STRING) || ', ' || CAST(CAST(x2 AS BIGINT) AS STRING) || ', ' || CAST(CAST(y2 AS BIGINT) AS STRING) || '], "label": "' || label || '"}}]' || chr(10) || '``` end'
 ELSE '<answer>none</answer>' END AS content FROM ({BOXES}) b"""


def _box_texts(spark, sf):
    return derived(spark, sf, BOX_TEXTS, "lineitem")


@query(rf"""WITH c AS ({BOX_TEXTS}) SELECT id,
 CAST(regexp_matches(content, '(?s)<think>.*?</think>\s*<answer>.*?\{{.*\[\d+,\s*\d+,\s*\d+,\s*\d+\].*\}}.*?</answer>') AS DOUBLE) AS in_object,
 CAST(regexp_matches(content, '(?s)<think>.*?</think>\s*<answer>.*?\[\d+,\s*\d+,\s*\d+,\s*\d+\].*?</answer>') AS DOUBLE) AS in_list FROM c""")
def t9_box_formats(spark, sf):
    c = F.col("content")
    return _box_texts(spark, sf).select("id", T.format_box(c).alias("in_object"), T.format_box(c, "list").alias("in_list"))


def _box_sql(text: str, pattern: str) -> str:
    parts = ", ".join(f"CAST(trim(regexp_extract({text}, '{pattern}', {k})) AS DOUBLE)" for k in range(1, 5))
    return f"CASE WHEN regexp_matches({text}, '{pattern}') THEN list_sum([{parts}]) ELSE 0 END"


_ANS = "coalesce(list_extract(regexp_extract_all(content, '(?s)<answer>(.*?)</answer>', 1), 1), '')"
_FLOAT = r"(\s*-?\d*\.?\d+\s*)"


@query(rf"""WITH c AS ({BOX_TEXTS}) SELECT id, {_box_sql(_ANS, r'(?s)\{.*\[(\d+),\s*(\d+),\s*(\d+),\s*(\d+)]\s*.*\}')} AS in_object,
 {_box_sql(_ANS, r'\[(\d+),\s*(\d+),\s*(\d+),\s*(\d+)\]')} AS in_list, {_box_sql('content', rf'\[{_FLOAT},\s*{_FLOAT},\s*{_FLOAT},\s*{_FLOAT}\]')} AS anywhere,
 {_box_sql('CASE WHEN contains(content, chr(96) || chr(96) || chr(96)) THEN content ELSE chr(32) END', r'\[(\d+),\s*(\d+),\s*(\d+),\s*(\d+)\]')} AS in_fence FROM c""")
def t10_box_extraction(spark, sf):
    c = F.col("content")
    total = lambda b: F.aggregate(b, F.lit(0.0), lambda a, x: a + x)
    return _box_texts(spark, sf).select("id", total(T.box_in_object(c)).alias("in_object"), total(T.box_in_list(c)).alias("in_list"), total(T.box_anywhere(c)).alias("anywhere"), total(T.box_in_fence(c)).alias("in_fence"))


#: Fenced and bare JSON from event properties.
FENCED = """SELECT event_id AS id, CASE event_id % 5
 WHEN 0 THEN 'a ```json' || chr(10) || props || chr(10) || '``` b ```json{"k": 1}``` c'
 WHEN 1 THEN '```' || chr(10) || '{"parts": [' || props || ', ' || props || ']}' || chr(10) || '```'
 WHEN 2 THEN ' [' || props || '] ' WHEN 3 THEN 'x ' || props || ' y {"z": 2} w' ELSE event_type END AS content FROM events"""


def _fenced(spark, sf):
    return derived(spark, sf, FENCED, "events")


@query(rf"""WITH c AS ({FENCED}) SELECT id, {_strip("list_extract(regexp_extract_all(content, '(?s)```json(.*?)```', 1), 1)")} AS first_fence,
 {_strip("list_extract(regexp_extract_all(content, '(?s)```json(.*?)```', 1), -1)")} AS last_fence FROM c""")
def t11_fenced_json(spark, sf):
    c = F.col("content")
    return _fenced(spark, sf).select("id", T.fenced_json(c).alias("first_fence"), T.fenced_json(c, last=True).alias("last_fence"))


@query(rf"""WITH c AS ({FENCED}) SELECT id, CASE WHEN starts_with({_strip('content')}, '```') THEN {_strip(rf"regexp_replace(regexp_replace({_strip('content')}, '^```[^\n]*(\n|$)', ''), '(^|\n)```[^\n]*$', '')")} ELSE {_strip('content')} END AS body,
 nullif(regexp_extract(content, '(?s)(\{{.*\}})', 1), '') AS braces FROM c""")
def t12_t13_fences_and_braces(spark, sf):
    c = F.col("content")
    return _fenced(spark, sf).select("id", T.strip_fence(c).alias("body"), T.outer_braces(c).alias("braces"))


@query(f"WITH c AS ({FENCED}) SELECT id, CASE id % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 0 END::INTEGER AS n_parts FROM c")
def t17_fenced_parts(spark, sf):
    return _fenced(spark, sf).select("id", F.size(T.fenced_parts(F.col("content"))).alias("n_parts"))


@query("""WITH b AS (SELECT event_id AS id, CASE event_id % 5 WHEN 1 THEN '{"parts": [' || props || ', ' || props || ']}' WHEN 4 THEN NULL ELSE props END AS balanced FROM events)
SELECT id, balanced, CAST(json(balanced) AS VARCHAR) AS parsed, CAST(id % 4 AS INTEGER) AS n_salvaged FROM b""")
def t14_t15_t16_json_repair(spark, sf):
    items = F.array_join(F.expr("array_repeat(coalesce(balanced, '{}'), CAST(id % 4 AS INT))"), ", ")
    c = _fenced(spark, sf).withColumn("balanced", S.balanced_json("content")).withColumn("cut", F.concat(F.lit('x {"qas" : ['), items, F.lit(', {"a": "b')))
    return c.select("id", "balanced", F.to_json(F.try_parse_json("balanced")).alias("parsed"), F.size(S.salvaged_items("cut")).alias("n_salvaged"))


NAMED = """SELECT doc_id AS id, CASE doc_id % 4
 WHEN 0 THEN 'Name: ' || source || chr(10) || ' caption:  ' || lang || ' thing' || chr(10) || 'NAME: ' || lang
 WHEN 1 THEN chr(10) || 'a chair' || chr(10) || 'name:' || chr(10) || 'with legs' WHEN 2 THEN '' ELSE 'Caption: only ' || source END AS said, source FROM documents"""


@query(r"""WITH c AS (""" + NAMED + r""") SELECT id,
 CASE id % 4 WHEN 0 THEN regexp_extract(said, 'NAME: (.*)$', 1) ELSE source END AS name,
 CASE id % 4 WHEN 0 THEN regexp_extract(said, 'caption:  ([^\n]*)', 1) WHEN 1 THEN 'a chair' || chr(10) || 'with legs' WHEN 2 THEN '' ELSE 'only ' || source END AS caption FROM c""")
def t18_name_caption(spark, sf):
    got = T.name_caption(F.col("said"), F.col("source"))
    return derived(spark, sf, NAMED, "documents").select("id", got["name"].alias("name"), got["caption"].alias("caption"))


SECTIONED = """SELECT doc_id AS id, 'intro [Part 1] one ' || lang || ' [部件 2]two ' || source || ' [part 1] again ' || CASE WHEN doc_id % 2 = 0 THEN '[PART 3]' ELSE '' END AS said FROM documents"""


@query("WITH c AS (" + SECTIONED + ") SELECT id, ' again ' AS first_part, 'two ' || regexp_extract(said, 'two ([^ ]*)', 1) || ' ' AS second_part, CASE WHEN id % 2 = 0 THEN '' END AS third_part FROM c")
def t19_sections(spark, sf):
    parts = T.sections(F.col("said"))
    return derived(spark, sf, SECTIONED, "documents").select("id", *[F.try_element_at(parts, F.lit(k)).alias(n) for k, n in ((1, "first_part"), (2, "second_part"), (3, "third_part"))])


PREPARED = """SELECT conv_id * 100 + turn AS id, 'Question: ' || text || ' Answer: ' || CASE WHEN turn % 3 = 0 THEN '' ELSE '<think> ' || text || ' </think><think>b</think> <think>open' END
 || CASE WHEN turn % 2 = 0 THEN '<answer>Answer:  ' || role || ' </answer>' ELSE '' END AS said FROM conversations"""


@query(rf"""WITH c AS ({PREPARED}), p AS (SELECT id, said, string_split(said, '<think>') AS parts FROM c)
SELECT id, {_strip(rf"regexp_replace(regexp_replace({_strip('parts[1]')}, '^Question:\s*', ''), '\s*Answer:\s*$', '')")} AS problem,
 '<think>' || array_to_string(list_transform(list_filter(parts[2:], lambda x: contains(x, '</think>')), lambda x: {_strip("string_split(x, '</think>')[1]")}), ' ') || '</think>'
 || CASE WHEN contains(said, '<answer>') THEN chr(10) || chr(10) || '<answer>' || regexp_replace({_strip("string_split(list_extract(string_split(said, '<answer>'), -1), '</answer>')[1]")}, '^Answer:\s*', '') || '</answer>' ELSE '' END AS solution FROM p""")
def t20_problem_solution(spark, sf):
    got = T.problem_solution(F.col("said"))
    return derived(spark, sf, PREPARED, "conversations").select("id", got["problem"].alias("problem"), got["solution"].alias("solution"))


@query()
def t21_r4_choice(spark, sf):
    c, s = F.col("content"), F.col("solution")
    return completions(spark, sf).select("id", T.choice(c).alias("choice"), S.mcq(c, s).alias("mcq"))


J = f"WITH j AS ({JUDGED}) "


@query(J + "SELECT object_id, CASE WHEN upper(substr(reply, 1, 1)) IN ('T', 'F') THEN upper(substr(reply, 1, 1)) ELSE 'INVALID' END AS label, substr(reply, 3) AS reason FROM j")
def t22_judged_truth(spark, sf):
    got = T.judged_truth(F.col("reply"))
    return judged(spark, sf).select("object_id", got["label"].alias("label"), got["reason"].alias("reason"))


CLASSED = J + r""", m AS (SELECT *, trim(coalesce(nullif(regexp_extract(reply, '(\d+#[^#]*#[^\n]*$)', 1), ''), reply)) AS said FROM j),
p AS (SELECT *, string_split(said, '#') AS parts FROM m), v AS (SELECT *, TRY_CAST(parts[1] AS BIGINT) AS number FROM p),
k AS (SELECT *, coalesce(number >= 0 AND number < 12 AND coalesce(parts[2], '') <> 'NA', false) AS valid FROM v),
cls AS (SELECT *, CASE WHEN valid THEN number ELSE object_id * 2654435761 % 4294967296 % 12 END AS result, CASE WHEN valid THEN coalesce(parts[2], '') ELSE 'INVALID' END AS label, CASE WHEN valid THEN coalesce(parts[3], '') ELSE said END AS reason FROM k) """


@query(CLASSED + "SELECT object_id, CAST(result AS BIGINT) AS result, label, reason, valid FROM cls")
def t23_judged_class(spark, sf):
    got = T.judged_class(F.col("reply"), 12, F.col("object_id"))
    return judged(spark, sf).select("object_id", *[got[n].alias(n) for n in ("result", "label", "reason", "valid")])


SCORED = J + r""", m AS (SELECT *, trim(CASE WHEN regexp_matches(reply, '(\d*#[^\n]*)') THEN regexp_extract(reply, '(\d*#[^\n]*)', 1) ELSE reply END) AS said FROM j),
p AS (SELECT *, string_split(said, '#') AS parts FROM m), v AS (SELECT *, coalesce(TRY_CAST(parts[1] AS BIGINT) BETWEEN 0 AND 100, false) AS valid FROM p) """


@query(SCORED + "SELECT object_id, CASE WHEN valid THEN CAST(parts[1] AS BIGINT) ELSE -1 END AS score, CASE WHEN valid THEN coalesce(parts[2], '') ELSE said END AS reason FROM v")
def t24_judged_score(spark, sf):
    got = T.judged_score(F.col("reply"))
    return judged(spark, sf).select("object_id", got["score"].alias("score"), got["reason"].alias("reason"))


@query(J + "SELECT object_id, CASE WHEN object_id % 9 = 5 THEN 1.0 ELSE 0.0 END::DOUBLE AS flag, CASE WHEN lower(truth_label) IN ('en', 'es') THEN 'left' WHEN truth_label = 'de' THEN 'right' END AS side FROM j")
def t25_t26_judge_flags(spark, sf):
    said = F.when(F.col("object_id") % 2 == 0, F.concat(F.lit(" Output: "), F.col("reply"))).otherwise(F.col("reply"))
    return judged(spark, sf).select("object_id", T.judged_flag(said).alias("flag"), T.side(F.col("truth_label"), ["en", "es"], ["de"]).alias("side"))


_NUMBER = "CASE " + " ".join(f"WHEN contains(lower(content), '{w}') THEN {n}" for n, w in enumerate(T.NUMBER_WORDS)) + " END"


@query(f"WITH c AS ({COMPLETIONS}) SELECT id, {_NUMBER}::INTEGER AS number FROM c")
def t27_number_words(spark, sf):
    return completions(spark, sf).select("id", T.number_word(F.col("content")).alias("number"))


CHATS = """WITH t AS (SELECT conv_id, list({'role': upper(role), 'text': CASE WHEN turn = 3 THEN NULL ELSE text END, 'turn': turn} ORDER BY turn) AS l FROM conversations GROUP BY conv_id) """


def _chat(spark, sf):
    said = F.when(F.col("turn") == 3, None).otherwise(F.col("text"))
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.upper("role").alias("role"), said.alias("text"), F.col("role").alias("from")))).alias("l"))
    return rows


@query(CHATS + """SELECT conv_id, 'sys###' || array_to_string(list_transform(l, lambda x, i: CASE WHEN x.text IS NULL THEN x.role || ':' ELSE x.role || ': ' || x.text || '###' END), '') AS single,
 'sys ' || array_to_string(list_transform(l, lambda x, i: CASE WHEN x.text IS NULL THEN x.role || ':' ELSE x.role || ': ' || x.text || CASE WHEN i % 2 = 1 THEN ' ' ELSE '</s>' END END), '') AS two FROM t""")
def t28_chat_templates(spark, sf):
    roles, texts = F.col("l.role"), F.col("l.text")
    return _chat(spark, sf).select("conv_id", T.render_chat(roles, texts, "sys", ("###", "###"), "single").alias("single"), T.render_chat(roles, texts, "sys", (" ", "</s>")).alias("two"))


@query("""WITH t AS (SELECT conv_id, list({'r': CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END, 't': text} ORDER BY turn) AS l, first(role ORDER BY turn) AS f FROM conversations GROUP BY conv_id),
 k AS (SELECT conv_id, CASE WHEN f = 'user' THEN l ELSE l[2:] END AS l FROM t) SELECT conv_id, array_to_string(list_transform(l, lambda x: x.r || ': ' || x.t || chr(10)), '') AS said FROM k""")
def t29_t30_role_map(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("from"), F.col("text").alias("value")))).alias("l"))
    return turns.select("conv_id", T.plain_chat(T.mapped_roles(F.col("l"))).alias("said"))


_AZ = "(vec_id * 7) % 400 - 20"
_EL = "(vec_id * 3) % 180 - 90"


@query(f"""SELECT vec_id, CASE WHEN a >= 67.5 AND a < 112.5 THEN '正面' WHEN a >= 112.5 AND a < 157.5 THEN '斜向正面' WHEN a >= 157.5 AND a < 202.5 THEN '侧面' WHEN a >= 202.5 AND a < 247.5 THEN '斜向背面'
 WHEN a >= 247.5 AND a < 292.5 THEN '背面' WHEN a >= 292.5 AND a < 337.5 THEN '斜向背面' WHEN a >= 337.5 OR a < 22.5 THEN '侧面' ELSE '斜向正面' END || '，' || CASE WHEN e > 60 THEN '俯视' WHEN e > 30 THEN '高角度俯视' WHEN e > -15 THEN '平视' ELSE '仰视' END AS direction
 FROM (SELECT vec_id, (({_AZ}) % 360 + 360) % 360 AS a, {_EL} AS e FROM embeddings)""")
def t32_view_direction(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", T.view_direction(F.expr(_AZ).cast("double"), F.expr(_EL).cast("double")).alias("direction"))


#: Objects as a model may have written them, in eight ways.
BROKEN = """
SELECT event_id AS id, props, CASE event_id % 8 WHEN 0 THEN props WHEN 1 THEN substring(props, 1, length(props) - 1) WHEN 2 THEN replace(props, '"', chr(39)) WHEN 3 THEN replace(replace(props, '"', ''), '}', ',}')
  WHEN 4 THEN concat('Here: ', props, ' done}') WHEN 5 THEN replace(props, ':', '') WHEN 6 THEN replace(props, '}', ' /* n */, "s": "it is "so" there", flag: True, rest: [1, 2')
  ELSE concat('[', props, ' ', substring(props, 1, length(props) - 1)) END AS broken
FROM events
"""


@query(f"""WITH b AS (SELECT id, CAST(json(props) AS VARCHAR) AS good FROM ({BROKEN}) AS t)
SELECT id, CASE id % 8 WHEN 6 THEN replace(good, '}}', ',"s":"it is \\"so\\" there","flag":true,"rest":[1,2]}}') WHEN 7 THEN '[' || good || ',' || good || ']' ELSE good END AS repaired FROM b""")
def t16_repaired_json(spark, sf):
    c = derived(spark, sf, BROKEN, "events")
    order = F.from_json(S.repaired_json("broken"), "struct<k:bigint,s:string,flag:boolean,rest:array<int>>")
    both = F.from_json(S.repaired_json("broken"), "array<struct<k:bigint>>")
    return c.select("id", F.when(F.col("id") % 8 == 7, F.to_json(both)).otherwise(F.to_json(order)).alias("repaired"))


@query(r"""WITH m AS (SELECT p_partkey, p_partkey % 6 AS k, CAST(p_size AS VARCHAR) AS n FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN n || '/4' WHEN 1 THEN '\sqrt' || n WHEN 2 THEN '.5' WHEN 3 THEN 'n=' || n || '\%' WHEN 5 THEN '\tfrac3{' || n || '}' END AS boxed,
 CASE k WHEN 0 THEN '\frac{' || n || '}{4}' WHEN 1 THEN '\sqrt{' || substr(n, 1, 1) || '}' || substr(n, 2) WHEN 2 THEN '\frac{1}{2}' WHEN 3 THEN n WHEN 5 THEN '\frac{3}{' || n || '}' END AS plain,
 CAST((k = 0 AND n = '3') OR (k = 5 AND n = '4') AS DOUBLE) AS equal FROM m""")
def t33_t34_r7_math(spark, sf):
    k, n = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    raw = (
        F.when(k == 0, F.concat(F.lit("x=\\boxed{\\dfrac"), n.substr(1, 1), F.lit("{7}} and \\boxed{"), n, F.lit("/4}")))
        .when(k == 1, F.concat(F.lit("\\fbox{\\sqrt"), n, F.lit("}")))
        .when(k == 2, F.lit("so $\\boxed .5$"))
        .when(k == 3, F.concat(F.lit("\\boxed{n="), n, F.lit("\\%}")))
        .when(k == 4, F.concat(n, F.lit(" \\text{ cm}")))
        .otherwise(F.concat(F.lit("\\boxed{\\tfrac3{"), n, F.lit("}}")))
    )
    got = table(spark, sf, "part").select("p_partkey", raw.alias("raw"))
    return got.select("p_partkey", S.boxed("raw").alias("boxed"), S.plain_math(S.boxed("raw")).alias("plain"), S.math_match(F.col("raw"), F.lit("\\frac{3}{4}")).alias("equal"))


#: A quotient of each line in six spellings.
ANSWERS = r"""
SELECT l_suppkey, q, n, CASE k WHEN 0 THEN concat('\boxed{\frac{', qs, '}{', ns, '}}') WHEN 1 THEN concat(qs, '/', ns) WHEN 2 THEN concat('\dfrac{', CAST(2 * q AS STRING), '}{', CAST(2 * n AS STRING), '}')
  WHEN 3 THEN concat('x = ', qs, ' \cdot ', ns, '^{-1}') WHEN 4 THEN concat('\frac{', CAST(100 * q AS STRING), '}{', ns, '}\%') ELSE concat('\sqrt{\frac{', CAST(q * q AS STRING), '}{', CAST(n * n AS STRING), '}}') END AS answer
FROM (SELECT l_suppkey, CAST(l_quantity AS INT) AS q, l_linenumber AS n, l_orderkey % 6 AS k, CAST(CAST(l_quantity AS INT) AS STRING) AS qs, CAST(l_linenumber AS STRING) AS ns FROM lineitem) AS t
"""


@query(f"""WITH a AS (SELECT l_suppkey, CASE WHEN n = gcd(q, n) THEN CAST(q // gcd(q, n) AS VARCHAR) ELSE (q // gcd(q, n)) || '/' || (n // gcd(q, n)) END AS form, answer FROM ({ANSWERS}) AS t),
v AS (SELECT l_suppkey, form, count(*) AS votes, count(DISTINCT answer) AS spellings FROM a GROUP BY l_suppkey, form)
SELECT *, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY votes DESC, form) AS INTEGER) AS rank FROM v""")
def r7_answer_votes(spark, sf):
    escaped = ANSWERS.replace("\\", "\\\\")  # Spark reads escapes in texts
    return reports.answer_votes(derived(spark, sf, escaped, "lineitem"), ["l_suppkey"], "answer")


@query(rf"WITH c AS ({COMPLETIONS}) SELECT id, CAST(len({_words('content')}) AS INTEGER) AS words, CAST(len(regexp_extract_all(content, '[.!?]')) AS INTEGER) AS marks FROM c")
def t35_counts(spark, sf):
    c = F.col("content")
    return completions(spark, sf).select("id", F.size(T.words(c)).alias("words"), F.regexp_count(c, F.lit("[.!?]")).alias("marks"))


@query("SELECT page_id, regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') AS base FROM pages")
def t36_base_names(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.base_name(F.col("url")).alias("base"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_size::BIGINT * 1000000000 WHEN 1 THEN p_size::BIGINT * 7 * 1000000000 WHEN 2 THEN p_size::BIGINT * 500000 ELSE -1 END AS parameters FROM part""")
def t37_parameters(spark, sf):
    s = F.col("p_size").cast("string")
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit("org/model-"), s, F.lit("B-1m"))).when(k == 1, F.concat(F.lit("m-"), s, F.lit("x7b"))).when(k == 2, F.concat(F.lit("m-"), (F.col("p_size") * 0.5).cast("decimal(10,1)").cast("string"), F.lit("M"))).otherwise("plain")
    return table(spark, sf, "part").select("p_partkey", T.parameters(name).alias("parameters"))


_NUMERIC = f"CASE WHEN TRY_CAST({_clean('content')} AS DOUBLE) IS NOT NULL AND TRY_CAST({_clean('solution')} AS DOUBLE) IS NOT NULL THEN CAST(TRY_CAST({_clean('content')} AS DOUBLE) = TRY_CAST({_clean('solution')} AS DOUBLE) AS DOUBLE) END"
_ALL = f"CAST({_clean('content')} = {_clean('solution')} AS DOUBLE)"
_YN = f"CAST(regexp_extract({_first('lower(content)')}, '(yes|no)', 1) = regexp_extract({_first('lower(solution)', False)}, '(yes|no)', 1) AS DOUBLE)"


@query(f"WITH c AS ({COMPLETIONS}) SELECT id, {_ALL} AS all_match, {_NUMERIC} AS numeric_match, {_YN} AS yes_no, CAST({_first('content', False)} = {_first('solution', False)} AS DOUBLE) AS base FROM c")
def r2_r3_r5_r8_matches(spark, sf):
    c, s = F.col("content"), F.col("solution")
    return completions(spark, sf).select("id", S.all_match(c, s).alias("all_match"), S.numeric(c, s).alias("numeric_match"), S.yes_no(c, s).alias("yes_no"), S.base_match(c, s).alias("base"))


@query(f"WITH c AS ({COMPLETIONS}) SELECT id, method, CASE WHEN method = 'all_match' THEN {_ALL} WHEN method = 'yes_no' THEN {_YN} END AS score FROM c")
def r1_method_dispatch(spark, sf):
    c, s = F.col("content"), F.col("solution")
    return completions(spark, sf).select("id", "method", S.accuracy(c, s, F.col("method"), ("all_match", "yes_no", "llm")).alias("score"))


@query()
def r6_r9_r10_r12_fuzzy(spark, sf):
    c, s = F.col("content"), F.col("solution")
    return completions(spark, sf).select("id", S.default_accuracy(c, s).alias("default_accuracy"), S.identity(c, s).alias("identity"), S.other_answer(c, s).alias("other"), S.indel_ratio(c, s).alias("ratio"), S.accuracy(c, s, F.col("method")).alias("accuracy"))


_NUMBER_P = _NUMBER.replace("content", "p")


@query(rf"""WITH c AS ({COMPLETIONS}), k AS (SELECT id, {_part('content')} AS p, {_part('solution')} AS g FROM c WHERE qa_type = 'part_count'),
n AS (SELECT id, TRY_CAST(regexp_extract(g, '(\d+)', 1) AS DOUBLE) AS gn, coalesce(TRY_CAST(nullif(regexp_extract(p, '(\d+)', 1), '') AS DOUBLE), {_NUMBER_P}) AS pn FROM k)
SELECT id, round(CASE WHEN pn IS NULL THEN 0.0 WHEN pn = gn THEN 1.0 ELSE greatest(0.0, 1.0 - abs(pn - gn) * 0.2) END, 6)::DOUBLE AS score FROM n""")
def r11_count(spark, sf):
    rows = completions(spark, sf).filter("qa_type = 'part_count'")
    return rows.select("id", rounded(S.count_score(F.col("content"), F.col("solution"))).alias("score"))


_W = rf"len({_words(_think('content'))})"
_M = rf"len(regexp_extract_all({_think('content')}, '[.!?]'))"
_QUALITY = f"CASE WHEN {_think('content')} = '' THEN 0.0 ELSE least(1.0, 0.5 + CASE WHEN {_W} BETWEEN 20 AND 150 THEN 0.3 WHEN {_W} BETWEEN 10 AND 19 THEN 0.2 WHEN {_W} > 150 THEN 0.1 ELSE 0 END + CASE WHEN {_M} >= 3 THEN 0.2 WHEN {_M} >= 2 THEN 0.1 ELSE 0 END) END"
_GRADED = rf"CASE WHEN {_FULL} THEN 1.0 WHEN regexp_matches(content, '(?s)<answer>.*?</answer>') THEN 0.5 ELSE 0.0 END"


@query(f"WITH c AS ({COMPLETIONS}) SELECT id, round({_QUALITY}, 6)::DOUBLE AS quality, round(0.6 * {_ALL} + 0.2 * {_GRADED} + 0.2 * {_QUALITY}, 6)::DOUBLE AS combined FROM c")
def r13_r15_thought_and_combined(spark, sf):
    c, s = F.col("content"), F.col("solution")
    return completions(spark, sf).select("id", rounded(S.think_quality(c)).alias("quality"), rounded(S.combined(S.all_match(c, s), T.format_graded(c), S.think_quality(c))).alias("combined"))


@query()
def r14_typed_accuracy(spark, sf):
    return completions(spark, sf).select("id", "qa_type", S.typed_accuracy(F.col("content"), F.col("solution"), F.col("qa_type")).alias("accuracy"))


_LW = _words("lower(text)")


@query(f"""WITH w AS (SELECT doc_id, {_LW} AS w FROM documents), g AS (SELECT doc_id, list_transform(range(1, len(w) - 4), lambda i: array_to_string(w[i:i+5], ' ')) AS g FROM w WHERE len(w) >= 6)
SELECT doc_id, coalesce(round(-(1 - len(list_distinct(g)) / len(g)), 6), 0.0)::DOUBLE AS score FROM w LEFT JOIN g USING (doc_id)""")
def r17_w12_repetition(spark, sf):
    return table(spark, sf, "documents").select("doc_id", rounded(S.repetition_text(F.col("text"))).alias("score"))


@query(f"""WITH b AS ({BOXES}) SELECT image_id, round(CASE WHEN count(*) = 0 THEN 0 ELSE -(1 - count(DISTINCT CAST(x1 AS INT) // 20 || '_' || label) / count(*)) END, 6)::DOUBLE AS score FROM b GROUP BY image_id""")
def r16_repeated_boxes(spark, sf):
    item = F.concat(F.lit('{"bbox_2d": ['), F.floor(F.col("x1") / 20), F.lit(', 1, 2, 3], "label": "'), F.col("label"), F.lit('"}'))
    rows = boxes(spark, sf).groupBy("image_id").agg(F.concat(F.lit("```json["), F.array_join(F.sort_array(F.collect_list(item)), ","), F.lit("]```")).alias("content"))
    return rows.select("image_id", rounded(S.repetition(F.col("content"))).alias("score"))


@query(f"""SELECT doc_id, round(1.0 - 0.5 * (1 - cos(n * pi() / 1024)) / 2, 6) AS published, round(CASE WHEN doc_id % 2 = 0 THEN 1.0 - 0.5 * (1 - cos(least(n, 1024) * pi() / 1024)) / 2 ELSE -0.5 + 0.5 * (1 - cos(least(n, 1024) * pi() / 1024)) / 2 END, 6) AS fixed
FROM (SELECT doc_id, len({_words('text')}) AS n FROM documents)""")
def r18_cosine_length(spark, sf):
    n = F.size(T.words(F.col("text")))
    return table(spark, sf, "documents").select("doc_id", rounded(S.cosine_length(n)).alias("published"), rounded(S.cosine_length(n, F.col("doc_id") % 2 == 0)).alias("fixed"))


def _box(prefix=""):
    return F.to_json(F.struct(F.array(*[f"{prefix}{k}" for k in ("x1", "y1", "x2", "y2")]).alias("bbox_2d"), F.col("label")))


def _answer(items, side):
    """An answer with the boxes of a side; lines of one number stand in the order of their JSON."""
    boxes = F.transform(F.sort_array(F.transform(items, lambda x: F.struct(x["ord"], x[side]))), lambda x: x[side])
    return F.concat(F.lit("<answer>```json\n["), F.array_join(boxes, ","), F.lit("]\n```</answer>"))


@query()
def r19_r20_r21_detection(spark, sf):
    items = F.collect_list(F.struct("ord", _box().alias("said"), _box("g").alias("real")))
    b = boxes(spark, sf).groupBy("image_id").agg(items.alias("items")).select("image_id", _answer(F.col("items"), "said").alias("content"), _answer(F.col("items"), "real").alias("solution"))
    return S.detection_scores(b, "content", "solution").select("image_id", *[rounded(F.col(x)).alias(x) for x in ("map", "ap50", "od_length", "weighted")])


@query("SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN '##' ELSE lang END AS said FROM documents")
def r27_empty_output(spark, sf):
    said = F.when(F.col("doc_id") % 10 == 0, "").otherwise(F.col("lang"))
    return table(spark, sf, "documents").select("doc_id", F.when(said == "", "##").otherwise(said).alias("said"))


@query()
def r24_r25_r26_a9_overlap_metrics(spark, sf):
    rows = table(spark, sf, "conversations").select(F.col("text").alias("truth"), F.expr("substring(text, 20)").alias("said"))
    got = rows.select(S.overlap_scores("truth", "said").alias("s"))
    names = ["bleu1", "bleu2", "bleu3", "bleu4", "rouge1", "rouge2", "rougeL", "meteor"]
    return got.agg(*[rounded(F.avg(f"s.{n}"), 4).alias(n) for n in names])


#: What was said beside its truth: the same words, or with as many other words as the turn's number behind them.
SAID = "SELECT conv_id, turn, text, CASE WHEN turn % 2 = 0 THEN text ELSE concat(text, repeat(' qqqq', CAST(turn AS INT))) END AS said FROM conversations"


@query(rf"""WITH m AS (SELECT conv_id, turn, len({_words('text')}) AS m, CASE WHEN turn % 2 = 0 THEN 0 ELSE turn END AS more FROM conversations)
SELECT conv_id, turn, round(CASE WHEN m = 0 THEN 0 ELSE (m / (m + more)) / (0.9 * (m / (m + more)) + 0.1) * (1 - 0.5 * (1 / m) ** 3) END, 6) AS meteor FROM m""")
def r26_meteor(spark, sf):
    got = reports.meteor(derived(spark, sf, SAID, "conversations"), "text", "said")
    return got.select("conv_id", "turn", rounded(F.col("meteor")).alias("meteor"))


LOGPS = "SELECT o_orderkey, list(l_tax ORDER BY l_linenumber) AS n, list(l_discount ORDER BY l_linenumber) AS o, list(l_tax * l_discount * 10 ORDER BY l_linenumber) AS r, list(CASE WHEN l_linenumber <= 3 THEN 1 ELSE 0 END ORDER BY l_linenumber) AS m FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey"


@query("""WITH t AS (SELECT l_orderkey, CASE WHEN l_linenumber <= 3 THEN 1 ELSE 0 END AS m, exp(l_tax - l_discount) AS c, l_tax * l_discount * 10 - l_tax AS d, l_orderkey % 5 - 2 AS a FROM lineitem)
SELECT l_orderkey, round(sum(m * (-least(c * a, least(greatest(c, 0.8), 1.2) * a) + 0.04 * (exp(d) - d - 1))) / sum(m), 6) AS loss FROM t GROUP BY l_orderkey""")
def r29_a15_clipped_objective(spark, sf):
    row = F.struct("l_linenumber", F.col("l_tax").alias("n"), F.col("l_discount").alias("o"), (F.col("l_tax") * F.col("l_discount") * 10).alias("r"), F.when(F.col("l_linenumber") <= 3, 1).otherwise(0).alias("m"))
    t = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(row)).alias("t"))
    loss = S.clipped_objective(F.col("t.n"), F.col("t.o"), F.col("t.r"), F.col("l_orderkey") % 5 - 2)
    return t.select("l_orderkey", rounded(S.masked_mean(loss, F.col("t.m"))).alias("loss"))


_IOU = """CASE WHEN greatest(x1, gx1) < least(x2, gx2) - 1 AND greatest(y1, gy1) < least(y2, gy2) - 1 THEN (least(x2, gx2) - greatest(x1, gx1)) * (least(y2, gy2) - greatest(y1, gy1)) ELSE 0 END"""


@query(f"WITH b AS ({BOXES}), i AS (SELECT *, {_IOU} AS i FROM b) SELECT image_id, ord, round(coalesce(i / nullif((x2 - x1) * (y2 - y1) + (gx2 - gx1) * (gy2 - gy1) - i, 0), 0), 6) AS iou FROM i")
def r22_g8_iou(spark, sf):
    a, g = F.array("x1", "y1", "x2", "y2"), F.array("gx1", "gy1", "gx2", "gy2")
    size = F.struct(F.lit(128.0).alias("w"), F.lit(64.0).alias("h"))
    return boxes(spark, sf).select("image_id", "ord", rounded(S.iou(S.resized(a, size, size), g)).alias("iou"))


@query("SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 4) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def r23_cosine(spark, sf):
    e = table(spark, sf, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    return e.join(after, "vec_id").select("vec_id", rounded(S.cosine(F.col("embedding"), F.col("next")), 4).alias("cosine"))


@query(f"WITH b AS ({BOXES}) SELECT image_id, round(sum(CASE WHEN x >= 5 AND x < 45 AND y < 40 THEN 1 ELSE 0 END) / count(*), 6) AS coverage FROM (SELECT image_id, least(floor(x1 / 1000 * 640), 639) AS x, least(floor(y1 / 1000 * 480), 479) AS y FROM b) GROUP BY image_id")
def r28_point_coverage(spark, sf):
    pixel = lambda c, n: F.least(F.floor(F.col(c) / 1000 * n), F.lit(n - 1))
    said = boxes(spark, sf).select("image_id", pixel("x1", 640).alias("px"), pixel("y1", 480).alias("py"))
    mask = spark.range(5, 45).select(F.col("id").alias("px")).crossJoin(spark.range(0, 40).select(F.col("id").alias("py"))).withColumn("inside", F.lit(1))
    return said.join(mask, ["px", "py"], "left").groupBy("image_id").agg(rounded(F.sum(F.coalesce("inside", F.lit(0))) / F.count(F.lit(1))).alias("coverage"))


@query(f"WITH c AS ({COMPLETIONS}) SELECT id, CAST({_FULL} AS DOUBLE) AS format, round(1.0 - 0.5 * (1 - cos(len({_words('content')}) * pi() / 1024)) / 2, 6) AS length FROM c")
def u1_u2_u3_registry(spark, sf):
    got = S.score_columns(["format", "length"], content=F.col("content"), solution=F.col("solution"), method=F.col("method"), qa_type=F.col("qa_type"))
    return completions(spark, sf).select("id", *got).withColumn("length", rounded(F.col("length")))
