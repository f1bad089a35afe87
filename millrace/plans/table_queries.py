"""Scans, filters, joins, aggregates, windows, samples and sets: inventory SC, SK, PF, J, A, W, L, S, U."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scoring as S
from ..functions import text as T
from ..operators import calls, groups, joins, reports, sampling
from ..operators.lineage import shared_folder
from ..sources import arrow_folder, io
from .base import BOXES, COMPLETIONS, JUDGED, boxes, completions, derived, judged, query, rounded, table
from .text_queries import CLASSED, SCORED

KEY = "(({0}) % 1073741824 * 2654435761) % 4294967296"


def key(c: str) -> str:
    return KEY.format(c)


# --- sources and sinks: written to a scratch folder in the formats of the domain, and read back


def _scratch(spark, name: str) -> str:
    """A folder of its own that executors share."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT conv_id AS object_id, CAST(count(*) AS BIGINT) AS turns FROM conversations GROUP BY conv_id")
def sc1_sc2_sc3_json_scans(spark, sf):
    turns = F.sort_array(F.collect_list(F.struct("turn", F.col("role").alias("from"), F.col("text").alias("value"))))
    rows = table(spark, sf, "conversations").groupBy(F.col("conv_id").cast("string").alias("object_id")).agg(F.transform(turns, lambda t: F.struct(t["from"], t["value"])).alias("conversations"))
    path = _scratch(spark, "scan")
    rows.write.mode("overwrite").json(f"{path}/a.jsonl")
    # A file with a blank line, a malformed one and one without an id, for the tolerant reader.
    spark.createDataFrame([('{"object_id": "", "conversations": []}',), ("",), ('{"object_id": "x", ',)], "value string").coalesce(1).write.mode("append").text(f"{path}/a.jsonl")
    got = io.json_lines(spark, f"{path}/a.jsonl", io.ANNOTATION, strict=False, required="object_id")
    return got.select(F.col("object_id").cast("bigint").alias("object_id"), F.size("conversations").cast("bigint").alias("turns"))


@query("""SELECT CAST(o_orderkey AS BIGINT) AS id, 'a' AS root, o_orderpriority AS said FROM orders WHERE o_orderkey IN (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 30)
 UNION ALL SELECT l_orderkey * 10 + l_linenumber, 'b', l_returnflag FROM lineitem QUALIFY row_number() OVER (ORDER BY l_orderkey * 10 + l_linenumber DESC) <= 20
 UNION ALL SELECT c_custkey, 'c', c_mktsegment FROM customer""")
def sc4_sc5_l1_s1_source_mix(spark, sf):
    tables = {
        "orders": table(spark, sf, "orders").select(F.col("o_orderkey").cast("bigint").alias("id"), F.lit("a").alias("root"), F.col("o_orderpriority").alias("said")),
        "lineitem": table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.lit("b").alias("root"), F.col("l_returnflag").alias("said")),
        "customer": table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit("c").alias("root"), F.col("c_mktsegment").alias("said")),
    }
    sources = [{"json_path": "orders", "sampling_strategy": "first:30"}, {"json_path": "lineitem", "sampling_strategy": "end:20"}, {"json_path": "customer", "sampling_strategy": "end:0"}]
    return io.mix(spark, sources, "id", "", read=lambda _, path, __: tables[path])


@query("SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY l_returnflag")
def sc6_arrow_folder(spark, sf):
    path = _scratch(spark, "arrow")
    arrow_folder.register(spark)
    table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_quantity").write.format("arrow_folder").mode("overwrite").save(path)
    got = spark.read.format("arrow_folder").option("columns", "l_returnflag,l_quantity").load(path)
    return got.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT CAST(r_regionkey AS BIGINT) AS \"index\", r_name AS name FROM region")
def sc10_categories(spark, sf):
    path = _scratch(spark, "classes")
    lines = table(spark, sf, "region").groupBy().agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("r_regionkey", "r_name"))), lambda r: r["r_name"]), "\n").alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(path)
    return io.categories(spark, path)


@query("SELECT o_orderkey FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 AND o_orderstatus = 'F'")
def sc13_j5_three_way(spark, sf):
    o = table(spark, sf, "orders")
    return joins.in_all("o_orderkey", o.filter("o_orderkey % 2 = 0"), o.filter("o_orderkey % 3 = 0"), o.filter("o_orderstatus = 'F'"))


@query("SELECT o_orderpriority AS key, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS val FROM orders GROUP BY o_orderpriority")
def sk1_sk2_sk3_sk4_sinks(spark, sf):
    path = _scratch(spark, "sink")
    rows = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderpriority").alias("key"), F.when(F.col("o_orderkey") % 5 == 0, "val").otherwise("train").alias("split"))
    io.write_splits(rows, f"{path}/splits")
    io.write_report(spark.read.parquet(f"{path}/splits"), f"{path}/report")
    io.write_csv(spark.read.json(f"{path}/report"), f"{path}/csv")
    back = spark.read.schema("key string, o_orderkey bigint, split string").option("header", True).csv(f"{path}/csv")
    return back.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("split") == "val").cast("bigint")).alias("val"))


@query("SELECT CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0")
def sk5_sk7_u8_write_once(spark, sf):
    path = _scratch(spark, "once")
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    io.append_new(o.filter("o_orderkey % 3 <> 0"), path, "o_orderkey")
    io.append_new(o.filter("o_orderkey % 2 = 0"), path, "o_orderkey")
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT 'o' || CAST(vec_id AS STRING) AS object_id, CASE WHEN vec_id % 3 = 2 THEN NULL ELSE 8 END::INTEGER AS points, CASE WHEN vec_id % 3 < 2 THEN round(embedding[1]::DOUBLE, 4) END AS x FROM embeddings""")
def sc7_sc8_sc9_point_files(spark, sf):
    """Files with the wanted number of points, whole files that are cut to it, and ids without a file."""
    e = table(spark, sf, "embeddings").withColumn("k", F.col("vec_id") % 3)
    cloud = lambda n: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.array(F.element_at("embedding", 1), F.element_at("embedding", i + 2), F.element_at("embedding", i + 3)))
    name = F.concat(F.lit("/in/o"), "vec_id", F.when(F.col("k") == 0, "_8.npy").otherwise(".npy"))
    content = F.when(F.col("k") == 0, io.npy_bytes(cloud(8))).otherwise(io.npy_bytes(cloud(20)))
    files = io.named_points(e.filter("k < 2").select(name.alias("path"), content.alias("content")))
    got = io.points_of(e.select(F.concat(F.lit("o"), "vec_id").alias("object_id")), files, 8)
    return got.select("object_id", F.when(F.col("points").isNotNull(), F.size("points")).alias("points"), F.round(F.col("points")[0][0].cast("double"), 4).alias("x"))


@query("SELECT doc_id, upper(lang) AS reply FROM documents")
def u5_u7_u8_u10_calls(spark, sf):
    return calls.called(table(spark, sf, "documents").select("doc_id", "lang"), "lang", calls.remembered(calls.retried(str.upper), 2, 50), workers=4).select("doc_id", "reply")


@query("SELECT user_id, event_type AS vote FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def u9_vote(spark, sf):
    return table(spark, sf, "events").groupBy("user_id").agg(F.mode("event_type", deterministic=True).alias("vote"))


# --- projections and filters


@query("SELECT p_partkey FROM part WHERE coalesce(CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_type END, 'ECONOMY') IN ('ECONOMY', 'PROMO')")
def pf1_membership(spark, sf):
    kind = F.when(F.col("p_size") % 5 == 0, None).otherwise(F.col("p_type"))
    return table(spark, sf, "part").filter(F.coalesce(kind, F.lit("ECONOMY")).isin("ECONOMY", "PROMO")).select("p_partkey")


@query("SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NULL OR l.quality NOT IN (0)")
def pf2_exclusion(spark, sf):
    q = F.col("quality")
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left").filter(q.isNull() | ~q.isin(0)).select("doc_id", "quality")


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 100")
def pf3_prefix(spark, sf):
    return table(spark, sf, "events").select("event_id").orderBy("event_id").limit(100)


PROBLEMS = """SELECT doc_id, lang || CASE doc_id % 4 WHEN 0 THEN ' <answer></answer>' WHEN 1 THEN ' Answer: x' ELSE ' <b>y</b>' END AS problem, CASE WHEN doc_id % 7 = 0 THEN NULL ELSE n_chars % 60 END AS side FROM documents"""


@query(f"SELECT doc_id FROM ({PROBLEMS}) WHERE NOT regexp_matches(problem, '<[^>]+></[^>]+>') AND NOT contains(problem, 'Answer:') AND side >= 28")
def pf4_quality_filter(spark, sf):
    """No empty tag pair, no answer in the question, and an image whose side is known and not too small."""
    p = F.col("problem")
    return derived(spark, sf, PROBLEMS, "documents").filter(~p.rlike("<[^>]+></[^>]+>") & ~p.contains("Answer:") & (F.col("side") >= 28)).select("doc_id")


@query("SELECT o_custkey, l_orderkey, CAST(count(*) AS BIGINT) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_orderkey HAVING count(*) >= 4 QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1")
def pf6_min_size(spark, sf):
    by = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey", "l_orderkey").agg(F.count(F.lit(1)).alias("n")).filter("n >= 4")
    return by.withColumn("kept", F.count(F.lit(1)).over(W.partitionBy("o_custkey"))).filter("kept > 1").drop("kept")


@query("WITH j AS (" + JUDGED + ") SELECT object_id, CAST(quality AS INTEGER) AS quality FROM j WHERE quality IS NOT NULL AND quality <> predicted")
def pf7_pf8_error_rows(spark, sf):
    return judged(spark, sf).filter(F.col("quality").isNotNull() & (F.col("quality") != F.col("predicted"))).select("object_id", "quality")


@query("WITH c AS (" + COMPLETIONS + """) SELECT id, 'human' AS first_from, '<point>' || chr(10) || 'Is it ' || solution || '?' AS prompt, 'partnext_' || qa_type AS conversation_type, CAST(object_id AS STRING) AS original_object_id,
 CASE WHEN solution = '' THEN '' ELSE '<answer> ' || solution || ' </answer>' END AS wrapped FROM c""")
def pf9_pf12_annotations(spark, sf):
    turn = lambda who, what: F.struct(F.lit(who).alias("from"), what.alias("value"))
    c = completions(spark, sf)
    rows = c.select(
        "id", F.array(turn("human", F.concat(F.lit("<point>\nIs it "), F.col("solution"), F.lit("?"))), turn("gpt", F.col("content"))).alias("conversations"),
        F.concat(F.lit("partnext_"), "qa_type").alias("conversation_type"), F.struct(F.col("object_id").cast("string").alias("original_object_id"), "qa_type").alias("meta"),
        F.when(F.col("solution") == "", "").otherwise(F.concat(F.lit("<answer> "), "solution", F.lit(" </answer>"))).alias("wrapped"),
    )
    return rows.select("id", F.col("conversations")[0]["from"].alias("first_from"), F.col("conversations")[0]["value"].alias("prompt"), "conversation_type", F.col("meta.original_object_id").alias("original_object_id"), "wrapped")


QA = """SELECT event_id AS id, '{"qas":[{"question":" q' || CAST(user_id AS STRING) || ' ","think":"","cot":"c","answer":"' || event_type || '","extra_key":' || props || '},{"qa_type":"t2","brief":" b "},7]}' AS doc FROM events"""


@query("WITH q AS (" + QA + """) SELECT id, 'fallback' AS qa_type, 'q' || regexp_extract(doc, '" q(\\d+) ', 1) AS question, 'c' AS think, '' AS brief, CAST(1 AS INTEGER) AS extras FROM q
 UNION ALL SELECT id, 't2', '', '', 'b', 0 FROM q""")
def pf10_qa_items(spark, sf):
    item = "struct<qa_type:string,question:string,think:string,cot:string,answer:string,brief:string>"
    q = derived(spark, sf, QA, "events")
    each = q.select("id", F.explode(F.from_json(F.get_json_object("doc", "$.qas"), "array<string>")).alias("raw")).filter(F.col("raw").startswith("{"))
    row = each.select("id", F.from_json("raw", item).alias("q"), F.map_filter(F.from_json("raw", "map<string,string>"), lambda k, _: ~k.isin("qa_type", "question", "think", "cot", "answer", "brief")).alias("extra"))
    falsy = lambda c: F.nullif(c, F.lit(""))
    said = lambda *cs: T.strip(F.coalesce(*[falsy(F.col(f"q.{c}")) for c in cs], F.lit("")))
    return row.select("id", F.coalesce(falsy(F.col("q.qa_type")), F.lit("fallback")).alias("qa_type"), said("question").alias("question"), said("think", "cot").alias("think"), said("brief").alias("brief"), F.size("extra").alias("extras"))


@query("SELECT p_partkey, CASE p_type WHEN 'PROMO' THEN 'Find ' || p_name || ' now' WHEN 'SMALL' THEN p_name || ' (think)' ELSE p_name END AS prompt FROM part")
def pf11_question_templates(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.question_text(F.col("p_type"), F.col("p_name"), {"PROMO": "Find {Question} now", "SMALL": "{Question} (think)"}).alias("prompt"))


@query("SELECT p_partkey, '/root/img/' || p_brand || '.jpg' AS first, CASE WHEN p_partkey % 2 = 0 THEN 2 ELSE 1 END::INTEGER AS images FROM part")
def pf13_image_paths(spark, sf):
    raw = F.when(F.col("p_partkey") % 2 == 0, F.to_json(F.array(F.concat("p_brand", F.lit(".jpg")), F.lit("b.jpg")))).otherwise(F.to_json(F.struct(F.concat("p_brand", F.lit(".jpg")).alias("v"))))
    v = F.parse_json(raw)
    names = F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array(F.try_variant_get(v, "$.v", "string")))
    paths = F.transform(names, lambda n: F.concat(F.lit("/root/img/"), n))
    return table(spark, sf, "part").select("p_partkey", paths[0].alias("first"), F.size(paths).alias("images"))


@query("WITH b AS (" + BOXES + """) SELECT image_id, ord, '```json' || chr(10) || '[' || chr(10) || '{"bbox_2d": [' || CAST(trunc(x1 + 0.7) AS BIGINT) || ', ' || CAST(trunc(y1) AS BIGINT) || ', ' || CAST(trunc(x2) AS BIGINT) || ', ' || CAST(trunc(-y2 - 0.5) AS BIGINT) || '], "label": "' || label || '"}' || chr(10) || ']' || chr(10) || '```' AS target FROM b""")
def pf14_box_targets(spark, sf):
    whole = [F.col(c).cast("int") if not isinstance(c, str) else F.expr(c).cast("int") for c in ("x1 + 0.7D", "y1", "x2", "-y2 - 0.5D")]
    return boxes(spark, sf).select("image_id", "ord", F.format_string('```json\n[\n{"bbox_2d": [%d, %d, %d, %d], "label": "%s"}\n]\n```', *whole, "label").alias("target"))


@query("SELECT doc_id, CAST(length(lang || ' <s>' || repeat('<p>', 7) || '</s> x') AS INTEGER) AS n FROM documents")
def pf15_patch_tokens(spark, sf):
    said = F.concat("lang", F.lit(" <point> x"))
    return table(spark, sf, "documents").select("doc_id", F.length(T.with_patches(said, 7, "<point>", "<s>", "</s>", "<p>")).alias("n"))


@query("SELECT d.doc_id, l.doc_id IS NULL AS quarantined FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def pf17_quarantine(spark, sf):
    docs, files = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select("doc_id")
    return docs.join(files, "doc_id", "left_semi").withColumn("quarantined", F.lit(False)).unionByName(joins.missing(docs, files, "doc_id").withColumn("quarantined", F.lit(True)))


# --- joins


@query("WITH v AS (SELECT l_orderkey AS o_orderkey, l_extendedprice AS truth FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_extendedprice DESC) = 1) SELECT o.o_orderkey, o_orderstatus, truth FROM orders o JOIN v USING (o_orderkey)")
def j1_s7_truth_lookup(spark, sf):
    v = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("truth"), "l_linenumber")
    return joins.lookup(table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), v, "o_orderkey", [F.col("l_linenumber"), F.col("truth")]).select("o_orderkey", "o_orderstatus", "truth")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j2_j3_s3_resume(spark, sf):
    return joins.remaining(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id")


@query("""WITH s AS (SELECT user_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS done, count(*) AS tries FROM events GROUP BY user_id)
 SELECT c_custkey AS user_id FROM customer LEFT JOIN s ON c_custkey = user_id WHERE user_id IS NULL OR (done = 0 AND tries < 12)""")
def j4_w13_retry(spark, sf):
    e = table(spark, sf, "events").select("user_id", F.when(F.col("event_type") == "purchase", "completed").otherwise("failed").alias("status"), "event_id")
    log = groups.attempts(e, "user_id", [F.col("event_id")]).withColumnRenamed("attempt", "attempts")
    return joins.to_retry(table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id")), log, "user_id", 12)


@query("SELECT o_custkey, CAST(count(*) AS BIGINT) AS n, CAST(sum(CASE WHEN c_custkey IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey GROUP BY o_custkey")
def j6_object_groups(spark, sf):
    objects = table(spark, sf, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return joins.grouped_with(objects, table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("found")).cast("bigint")).alias("missing"))


@query("SELECT o_orderkey AS image_id, o_orderstatus, c_mktsegment AS category FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def j9_j13_annotation_category(spark, sf):
    return table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select(F.col("o_orderkey").alias("image_id"), "o_orderstatus", F.col("c_mktsegment").alias("category"))


_XYWH = "coalesce(i / nullif(aw * ah + bw * bh - i, 0), 0)"


@query("WITH b AS (" + BOXES + f"""), p AS (SELECT a.image_id, a.ord AS a, b.ord AS b, greatest(0, least(a.x2, b.gx2) - greatest(a.x1, b.gx1)) * greatest(0, least(a.y2, b.gy2) - greatest(a.y1, b.gy1)) AS i,
 a.x2 - a.x1 AS aw, a.y2 - a.y1 AS ah, b.gx2 - b.gx1 AS bw, b.gy2 - b.gy1 AS bh FROM b a JOIN b b ON a.image_id = b.image_id) SELECT image_id, a, b, round({_XYWH}, 6) AS iou FROM p""")
def j10_g9_iou_matrix(spark, sf):
    from ..functions import geometry

    b = boxes(spark, sf)
    one = b.select("image_id", F.col("ord").alias("a"), "x1", "y1", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    two = b.select("image_id", F.col("ord").alias("b"), "gx1", "gy1", (F.col("gx2") - F.col("gx1")).alias("gw"), (F.col("gy2") - F.col("gy1")).alias("gh"))
    iou = geometry.iou_xywh([F.col(c) for c in ("x1", "y1", "w", "h")], [F.col(c) for c in ("gx1", "gy1", "gw", "gh")])
    return one.join(two, "image_id").select("image_id", "a", "b", rounded(iou).alias("iou"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_regionkey AS parent FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def j11_sibling_pairs(spark, sf):
    n = table(spark, sf, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").alias("parent")), n.select(F.col("n_nationkey").alias("b"), F.col("n_regionkey").alias("__p"))
    return a.join(b, (F.col("parent") == F.col("__p")) & (F.col("a") < F.col("b"))).select("a", "b", "parent")


@query("SELECT d.doc_id, coalesce(l.quality, -1)::INTEGER AS quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def j14_default(spark, sf):
    return joins.with_default(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id", "quality", -1)


@query("SELECT event_id, event_type FROM events")
def j15_w3_w4_gather(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type")
    s = sampling.shards(e, 3, "event_id")
    return joins.gathered([s.filter(F.col("shard") == k).drop("shard") for k in range(3)], "event_id", e.count())


@query("SELECT o_orderkey, CAST(least((row_number() OVER (ORDER BY o_orderkey) - 1) // (SELECT count(*) // 7 FROM orders), 6) AS BIGINT) AS shard FROM orders")
def w4_shards(spark, sf):
    return sampling.shards(table(spark, sf, "orders").select("o_orderkey"), 7, "o_orderkey")


@query("SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS BIGINT) AS new_index FROM events WHERE event_type <> 'click'")
def j16_remap(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    return joins.remapped(e, e.filter("event_type <> 'click'"), "user_id", "event_id").select("event_id", F.col("new_index").cast("bigint").alias("new_index"))


# --- aggregations


@query("SELECT event_type, CAST(count(*) AS BIGINT) AS n, round(100.0 * count(*) / (SELECT count(*) FROM events), 2) AS percent FROM events GROUP BY event_type")
def a1_a2_counts(spark, sf):
    return reports.counts(table(spark, sf, "events"), "event_type")


_J = "WITH j AS (" + JUDGED + ") "


@query(_J + "SELECT category, truth_label, predicted, CAST(count(*) AS BIGINT) AS n FROM j GROUP BY category, truth_label, predicted")
def a3_confusions(spark, sf):
    return reports.confusions(judged(spark, sf), "category", "truth_label", "predicted")


@query(_J + "SELECT truth_label, array_to_string(list(category || ':' || items ORDER BY category), ';') AS groups FROM (SELECT truth_label, category, array_to_string(list(object_id ORDER BY object_id), ',') AS items FROM j GROUP BY ALL) GROUP BY truth_label")
def a4_nested(spark, sf):
    got = reports.nested(judged(spark, sf), "truth_label", "category", "object_id")
    return got.select("truth_label", F.array_join(F.transform("groups", lambda g: F.concat(g["key"], F.lit(":"), F.array_join(g["items"].cast("array<string>"), ","))), ";").alias("groups"))


@query(CLASSED + """, s AS (SELECT model, count(*) AS n, sum((result = ground_truth)::INT) AS c, sum(valid::INT) AS v, sum((valid AND result = ground_truth)::INT) AS cv FROM cls GROUP BY model)
 SELECT model, round(coalesce(100.0 * cv / nullif(v, 0), 0), 4)::DOUBLE AS accuracy_valid, round(CASE WHEN v > 0 THEN 100.0 * c / n ELSE 0 END, 4)::DOUBLE AS accuracy, round(CASE WHEN v > 0 THEN 100.0 * cv / v ELSE 0 END, 4)::DOUBLE AS clean_accuracy FROM s""")
def a5_a6_accuracy(spark, sf):
    j = judged(spark, sf)
    got = T.judged_class(F.col("reply"), 12, F.col("object_id"))
    j = j.select("model", (got["result"] == F.col("ground_truth")).alias("right"), got["valid"].alias("valid"))
    pair = [rounded(c, 4) for c in reports.accuracy_pair(F.col("right"), F.col("valid"))]
    return j.groupBy("model").agg(rounded(reports.accuracy_valid(F.col("right"), F.col("valid")), 4).alias("accuracy_valid"), pair[0].alias("accuracy"), pair[1].alias("clean_accuracy"))


@query(SCORED + "SELECT model, round(coalesce(avg(CASE WHEN valid THEN CAST(parts[1] AS BIGINT) END), 0), 6) AS score FROM v GROUP BY model")
def a7_mean_score(spark, sf):
    return judged(spark, sf).groupBy("model").agg(rounded(reports.mean_score(T.judged_score(F.col("reply"))["score"])).alias("score"))


@query(_J + """SELECT model, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
 round(sum(prompt_tokens * CASE model WHEN 'gpt-4-0613' THEN 0.03 WHEN 'gpt-3.5-turbo-0613' THEN 0.0015 ELSE 0.002 END + completion_tokens * CASE model WHEN 'gpt-4-0613' THEN 0.06 WHEN 'gpt-3.5-turbo-0613' THEN 0.002 ELSE 0.008 END) / 1000, 6)::DOUBLE AS dollars FROM j GROUP BY model""")
def a8_cost(spark, sf):
    return reports.cost(judged(spark, sf)).withColumn("dollars", rounded(F.col("dollars")))


@query("SELECT l_returnflag, round(100.0 * avg((l_discount > 0.05)::INT), 6) AS accuracy FROM lineitem GROUP BY l_returnflag")
def a10_threshold_accuracy(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(rounded(reports.threshold_accuracy(F.col("l_discount"), 0.05)).alias("accuracy"))


@query("SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS n, round(avg(l_tax), 6) AS coverage, round(100 * avg((l_tax >= 0.04)::INT), 6) AS accuracy FROM lineitem WHERE l_quantity - 10 > 0 GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), ())")
def a11_coverage(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("truths", F.col("l_quantity") - 10)
    got = reports.coverage(rows, ["l_returnflag", "l_linestatus"], "l_tax", "truths", 0.04)
    return got.withColumns({"coverage": rounded(F.col("coverage")), "accuracy": rounded(F.col("accuracy"))})


@query("""WITH g AS (SELECT l_orderkey, count(*) AS n, sum(l_tax) AS a, sum(l_discount) AS b, stddev_samp(l_tax + l_discount) AS s FROM lineitem GROUP BY l_orderkey)
 SELECT round(sum(a) / sum(n), 9) AS l_tax, round(sum(b) / sum(n), 9) AS l_discount, round((sum(a) + sum(b)) / sum(n), 9) AS reward, round(avg(coalesce(s, 0)), 9) AS reward_std FROM g""")
def a12_w2_function_means(spark, sf):
    got = reports.function_means(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_tax", "l_discount"])
    return got.select(*[rounded(F.col(c), 9).alias(c) for c in got.columns])


@query("SELECT CAST(floor(event_id / 100) AS BIGINT) AS step, round(avg(value), 6) AS value FROM events GROUP BY 1")
def a13_metric_flush(spark, sf):
    return reports.step_means(table(spark, sf, "events"), F.floor(F.col("event_id") / 100), ["value"]).withColumn("value", rounded(F.col("value")))


@query("WITH c AS (" + COMPLETIONS + ") SELECT step, object_id, array_to_string(list(solution ORDER BY gen_idx), '|') AS solutions, CAST(count(*) AS BIGINT) AS n, first(content ORDER BY gen_idx) AS content FROM c GROUP BY step, object_id")
def a14_l13_group_lists(spark, sf):
    got = reports.group_lists(completions(spark, sf), ["step", "object_id"], ["gen_idx"], ["solution"], "content")
    return got.select("step", "object_id", F.array_join("solutions", "|").alias("solutions"), F.size("solutions").cast("bigint").alias("n"), "content").orderBy("step", "object_id")


@query("SELECT CAST(count(*) AS BIGINT) AS total, CAST(sum((event_type <> 'error')::INT) AS BIGINT) AS succeeded, CAST(sum((event_type = 'error')::INT) AS BIGINT) AS failed, round(avg(CASE WHEN event_type <> 'error' THEN value END), 6) AS mean_seconds, CAST(sum(CASE WHEN event_type <> 'error' THEN user_id % 5 ELSE 0 END) AS BIGINT) AS items FROM events")
def a16_batch_summary(spark, sf):
    e = table(spark, sf, "events").withColumn("k", F.col("user_id") % 5)
    return reports.batch_summary(e, F.col("event_type") != "error", "value", "k").withColumn("mean_seconds", rounded(F.col("mean_seconds")))


@query("""WITH l AS (SELECT label, vec_id, unnest(range(1, 65)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings), c AS (SELECT label, dim, avg(v) AS m FROM l GROUP BY label, dim),
 d AS (SELECT label, vec_id, sqrt(sum((v - m) * (v - m))) AS d FROM l JOIN c USING (label, dim) GROUP BY label, vec_id) SELECT label, round(avg(d), 6) AS spread FROM d GROUP BY label""")
def a21_centroid_spread(spark, sf):
    return reports.spread(table(spark, sf, "embeddings"), "label", "embedding").withColumn("spread", rounded(F.col("spread")))


@query("""SELECT label AS point, round(sum(m), 5) AS total, CAST(64 AS INTEGER) AS dims FROM (SELECT label, dim, avg(v) AS m FROM (SELECT label, unnest(range(1, 65)) AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings WHERE vec_id % 3 > 0) GROUP BY label, dim) GROUP BY label""")
def a20_feature_means(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").alias("point"), F.col("embedding").cast("array<double>").alias("v"), (F.col("vec_id") % 3).alias("seen"))
    got = reports.feature_means(e, "point", "v", "seen", 64)
    return got.select("point", F.round(F.aggregate("feature", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.size("feature").alias("dims"))


@query("SELECT l_returnflag, min(l_quantity) AS low, max(l_quantity) AS high, CAST(count(DISTINCT l_suppkey) AS BIGINT) AS suppliers, quantile_cont(l_extendedprice, 0.05) AS p5, quantile_cont(l_extendedprice, 0.5) AS p50, quantile_cont(l_extendedprice, 0.95) AS p95 FROM lineitem GROUP BY l_returnflag")
def a22_a23_a24_ranges(spark, sf):
    lines = table(spark, sf, "lineitem")
    got = lines.groupBy("l_returnflag").agg(F.min("l_quantity").alias("low"), F.max("l_quantity").alias("high"), F.countDistinct("l_suppkey").alias("suppliers"))
    return got.join(groups.percentiles(lines, ["l_returnflag"], "l_extendedprice", {"p5": 0.05, "p50": 0.5, "p95": 0.95}), "l_returnflag")


@query("SELECT CAST(floor(event_id / 4) AS BIGINT) AS block, CAST(count(DISTINCT event_type) AS BIGINT) AS keys, CAST(count(*) AS BIGINT) AS rows FROM events GROUP BY 1 HAVING count(DISTINCT event_type) <> 1 OR count(*) <> 4")
def a25_uneven_blocks(spark, sf):
    return groups.uneven_blocks(table(spark, sf, "events"), "event_id", "event_type", 4)


@query("SELECT CAST(sum((quality = 1 AND toxic = 0)::INT) AS BIGINT) AS \"both\", CAST(sum((quality = 1)::INT) AS BIGINT) AS first, CAST(sum((toxic = 0)::INT) AS BIGINT) AS second FROM labels")
def a26_correct_summary(spark, sf):
    q, t = F.col("quality") == 1, F.col("toxic") == 0
    return table(spark, sf, "labels").agg(*reports.correct_summary(q & t, q, t))


# --- group-relative operators


@query("""WITH g AS (SELECT user_id, event_id, value, avg(value) OVER w AS m, stddev_samp(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY user_id)) SELECT event_id, round(coalesce((value - m) / (s + 1e-4), 0), 5) AS advantage FROM g""")
def w1_advantages(spark, sf):
    return groups.advantages(table(spark, sf, "events"), ["user_id"], "value").select("event_id", rounded(F.col("advantage"), 5).alias("advantage"))


@query("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS som_id FROM orders")
def w5_size_rank(spark, sf):
    return groups.size_rank(table(spark, sf, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey").select("o_custkey", "o_orderkey", "som_id")


@query("SELECT o_orderkey, ['red', 'green', 'blue'][1 + (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 3] AS color FROM orders")
def w6_cyclic_colours(spark, sf):
    return groups.cyclic(table(spark, sf, "orders"), ["o_custkey"], [F.col("o_orderkey")], ["red", "green", "blue"]).select("o_orderkey", "color")


@query("SELECT l_orderkey, l_linenumber, coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS \"offset\" FROM lineitem")
def w7_running_offset(spark, sf):
    return groups.running_offset(table(spark, sf, "lineitem"), ["l_orderkey"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")], "l_quantity").select("l_orderkey", "l_linenumber", "offset")


@query("""WITH r AS (SELECT event_id, event_type, (value > 50)::INT AS hit, count(*) OVER (PARTITION BY event_type) AS truths, sum((value > 50)::INT) OVER w AS tp, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY event_type ORDER BY user_id DESC, event_id ROWS UNBOUNDED PRECEDING)),
 p AS (SELECT *, tp / n AS precision, row_number() OVER (PARTITION BY event_type ORDER BY n) AS k FROM r)
 SELECT event_id, round(tp / truths, 6) AS recall, round(max(precision) OVER (PARTITION BY event_type ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS envelope FROM p""")
def w8_w9_precision_recall(spark, sf):
    e = table(spark, sf, "events").select("event_id", "event_type", "user_id", (F.col("value") > 50).cast("int").alias("hit"))
    n = e.groupBy(F.col("event_type").alias("t")).agg(F.count(F.lit(1)).alias("truths"))
    got = groups.precision_recall(e.join(n, F.col("event_type") == F.col("t")), ["event_type"], [F.desc("user_id"), F.col("event_id")], "hit", "truths")
    return got.select("event_id", rounded(F.col("recall")).alias("recall"), rounded(F.col("envelope")).alias("envelope"))


@query("SELECT event_id, round(CASE WHEN max(value) OVER w > min(value) OVER w THEN (value - min(value) OVER w) / (max(value) OVER w - min(value) OVER w + 1e-6) ELSE 0.5 END, 6) AS share FROM events WINDOW w AS (PARTITION BY user_id)")
def w10_min_max(spark, sf):
    return groups.min_max(table(spark, sf, "events"), ["user_id"], "value", "share").select("event_id", rounded(F.col("share")).alias("share"))


@query("SELECT conv_id, CAST(count(*) FILTER (WHERE turn <= f) AS BIGINT) AS ones, CAST(count(*) AS BIGINT) AS n FROM (SELECT conv_id, turn, coalesce(min(turn) FILTER (WHERE role = 'assistant') OVER (PARTITION BY conv_id), 1000) AS f FROM conversations) GROUP BY conv_id")
def w11_mask_after_end(spark, sf):
    rows = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("turn", "role"))), lambda t: t["role"]).alias("t"))
    mask = groups.mask_after(F.col("t"), F.lit("assistant"))
    return rows.select("conv_id", F.aggregate(mask, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("ones"), F.size("t").cast("bigint").alias("n"))


# --- samples, splits, top-k


@query(f"SELECT event_id FROM events QUALIFY row_number() OVER (ORDER BY {key('event_id')}, event_id) <= (SELECT ceil(10 * count(*) / 100) FROM events)")
def l1_l2_l5_random_sample(spark, sf):
    return sampling.take(table(spark, sf, "events").select("event_id"), "random:10%", "event_id")


@query(f"SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {key('o_orderkey')}, o_orderkey) <= floor((SELECT count(*) FROM orders) * 0.9) THEN 'train' ELSE 'val' END AS split FROM orders")
def l3_hash_split(spark, sf):
    return sampling.split(table(spark, sf, "orders").select("o_orderkey"), 0.9, "o_orderkey", seed=0)


@query("SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY o_orderkey) <= floor((SELECT count(*) FROM orders) * 0.8) THEN 'train' ELSE 'val' END AS split FROM orders")
def l4_ordered_split(spark, sf):
    return sampling.split(table(spark, sf, "orders").select("o_orderkey"), 0.8, "o_orderkey", seed=None)


@query(f"""WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY {key('c_custkey')}, c_custkey) AS k, count(*) OVER () AS n FROM customer)
 SELECT c_custkey, CAST((k - 1) // 32 AS BIGINT) AS chunk, CAST(a.r AS INTEGER) AS round, CAST(b.r AS INTEGER) AS copy FROM r, range(3) a(r), range(2) b(r) WHERE (k - 1) // 32 < n // 32""")
def l6_l8_repeated_batches(spark, sf):
    return sampling.repeated_batches(table(spark, sf, "customer"), "c_custkey", sampling.batches_per_step(8, 4, 2, 2), each=2, repeats=3)


@query(f"SELECT s_suppkey, rank, CAST(r AS INTEGER) AS copy FROM (SELECT s_suppkey, CAST(row_number() OVER (ORDER BY {key('s_suppkey')}, s_suppkey) AS BIGINT) AS rank FROM supplier), range(4) a(r)")
def l7_repeated(spark, sf):
    return sampling.repeated(table(spark, sf, "supplier"), "s_suppkey", 4)


@query("SELECT event_id FROM events ORDER BY event_id LIMIT 70 OFFSET 30")
def l9_page(spark, sf):
    return sampling.page(table(spark, sf, "events").select("event_id"), 30, 70, "event_id")


@query(_J + "SELECT category, truth_label, predicted, n, CAST(row_number() OVER (PARTITION BY category ORDER BY n DESC, truth_label, predicted) AS INTEGER) AS rank FROM (SELECT category, truth_label, predicted, count(*) AS n FROM j GROUP BY ALL) QUALIFY rank <= 5")
def l10_top_per_group(spark, sf):
    by = reports.confusions(judged(spark, sf), "category", "truth_label", "predicted")
    return sampling.top_per_group(by, ["category"], [F.desc("n"), F.col("truth_label"), F.col("predicted")], 5)


@query(_J + """, t AS (SELECT category, count(*) AS s FROM j GROUP BY category ORDER BY s DESC, category LIMIT 3), p AS (SELECT category, truth_label, predicted, count(*) AS n, min(object_id) AS example FROM j GROUP BY ALL)
 SELECT category, truth_label, predicted, n, example FROM p WHERE category IN (SELECT category FROM t) QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, truth_label, predicted) = 1""")
def l11_best_example(spark, sf):
    return reports.best_example(judged(spark, sf), "category", "truth_label", "predicted", "object_id")


@query(f"SELECT event_id, event_type, CAST(row_number() OVER (PARTITION BY event_type ORDER BY {key('event_id')}, event_id) AS INTEGER) AS rank FROM events QUALIFY rank <= 2")
def l12_random_per_group(spark, sf):
    return sampling.random_per_group(table(spark, sf, "events").select("event_id", "event_type"), ["event_type"], "event_id", 2)


@query(f"""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY {key('o_orderkey')}, o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders)
 SELECT o_custkey, CAST(s AS BIGINT) AS slot, o_orderkey FROM r, range(12) a(s) WHERE k < 12 AND s % least(n, 12) = k""")
def l16_l17_fixed_length(spark, sf):
    return sampling.fixed_length(table(spark, sf, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 12).select("o_custkey", "slot", "o_orderkey")


# --- sets


@query("SELECT doc_id AS id, lang AS said FROM documents UNION ALL SELECT item_id, NULL FROM benchmark")
def s2_concat(spark, sf):
    a = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("said"))
    return a.unionByName(table(spark, sf, "benchmark").select(F.col("item_id").alias("id")), allowMissingColumns=True)


@query("SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def s4_s8_intersection(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("k")).join(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")), "k", "left_semi").distinct().orderBy("k")


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def s5_subset_violations(spark, sf):
    return joins.subset_violations(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("WITH l AS (SELECT page_id, list_filter(list_transform(string_split(url, '/'), lambda x: trim(x)), lambda x: x <> '') AS p FROM pages) SELECT page_id, CAST(len(list_distinct(p)) AS INTEGER) AS n, p[1] AS first FROM l")
def s6_h5_h9_unique_names(spark, sf):
    from ..operators import trees

    names = trees.unique_names(F.split("url", "/"))
    return table(spark, sf, "pages").select("page_id", F.size(names).alias("n"), trees.primary_name(F.lit(" "), F.split("url", "/")).alias("first"))


@query("SELECT o_orderkey, l_linenumber, l_quantity > 25 AS flag FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def u4_u6_row_map(spark, sf):
    def flag(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pc.greater(b.column(2), 25)], ["o_orderkey", "l_linenumber", "flag"])

    rows = table(spark, sf, "orders").join(table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", "l_quantity")
    return rows.mapInArrow(flag, "o_orderkey long, l_linenumber int, flag boolean")


def flagship(spark, sf):
    """Completions scored for layout and thought, with advantages in their group: one scan, one exchange."""
    c = completions(spark, sf).select("step", "object_id", "gen_idx", *S.score_columns(["format", "part_think"], content=F.col("content")))
    return groups.advantages(c.withColumn("reward", F.col("format") + F.col("part_think")), ["object_id"]).select("step", "object_id", "gen_idx", "format", rounded(F.col("part_think")).alias("think"), rounded(F.col("reward")).alias("reward"), rounded(F.col("advantage"), 5).alias("advantage"))


def _flagship_sql() -> str:
    from .text_queries import _FULL, _QUALITY

    return f"""WITH c AS ({COMPLETIONS}), s AS (SELECT step, object_id, gen_idx, CAST({_FULL} AS DOUBLE) AS format, {_QUALITY} AS think FROM c),
 r AS (SELECT *, format + think AS reward FROM s) SELECT step, object_id, gen_idx, format, round(think, 6)::DOUBLE AS think, round(reward, 6)::DOUBLE AS reward,
 round(coalesce((reward - avg(reward) OVER w) / (stddev_samp(reward) OVER w + 1e-4), 0), 5)::DOUBLE AS advantage FROM r WINDOW w AS (PARTITION BY object_id)"""


query(_flagship_sql())(flagship)
