"""Geometry, detection and hierarchies: inventory G, H and the rest of L, J, A, T."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import groups, joins, points as P, reports, sampling, trees, views as V
from .base import POINTS_SPARK, POINTS_SQL, TREE, boxes, derived, points, query, rounded, table

PTS = f"WITH p AS ({POINTS_SQL}) "


def _xyz(df, digits=5):
    return df.select("object_id", "point_id", *[rounded(F.col(c), digits).alias(c) for c in "xyz"])


@query(PTS + """, c AS (SELECT object_id, point_id, x - avg(x) OVER w AS x, y - avg(y) OVER w AS y, z - avg(z) OVER w AS z FROM p WINDOW w AS (PARTITION BY object_id)), r AS (SELECT *, max(sqrt(x*x + y*y + z*z)) OVER (PARTITION BY object_id) AS r FROM c)
 SELECT object_id, point_id, round(x / r, 5) AS x, round(y / r, 5) AS y, round(z / r, 5) AS z FROM r""")
def g1_normalised(spark, sf):
    return _xyz(G.normalised(points(spark, sf), "object_id"))


@query(PTS + """, t AS (SELECT object_id, point_id, x, z AS y, -y AS z FROM p), m AS (SELECT *, min(x) OVER w AS lx, max(x) OVER w AS hx, min(y) OVER w AS ly, max(y) OVER w AS hy, min(z) OVER w AS lz, max(z) OVER w AS hz FROM t WINDOW w AS (PARTITION BY object_id))
 SELECT object_id, point_id, round((x - (lx + hx) / 2) / greatest(hx - lx, hy - ly, hz - lz), 5) AS x, round((y - (ly + hy) / 2) / greatest(hx - lx, hy - ly, hz - lz), 5) AS y, round((z - (lz + hz) / 2) / greatest(hx - lx, hy - ly, hz - lz), 5) AS z FROM m""")
def g2_axis_normalised(spark, sf):
    return _xyz(G.axis_normalised(points(spark, sf), "object_id"))


#: Labels whose objects do not grow with the table: a thousand vectors' numbers each.
BLOCK = "label + 1000 * CAST(floor(vec_id / 1000) AS BIGINT)"


@query()
def g3_farthest_points(spark, sf):
    p = points(spark, sf).withColumn("object_id", F.expr(BLOCK.replace("label", "object_id").replace("vec_id", "point_id")))
    return P.farthest(p, "object_id", "point_id", 16)


@query(PTS + """SELECT a.object_id, a.point_id, b.point_id AS neighbour, CAST(row_number() OVER (PARTITION BY a.object_id, a.point_id ORDER BY (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z), b.point_id) AS INTEGER) AS rank
 FROM p a JOIN p b ON a.object_id = b.object_id QUALIFY rank <= 5""")
def g4_nearest(spark, sf):
    return P.nearest(points(spark, sf), "object_id", "point_id", 5).select("object_id", "point_id", "neighbour", "rank")


@query()
def g5_graph_parts(spark, sf):
    return P.graph_parts(points(spark, sf), "object_id", "point_id", 3)


@query()
def g6_ward_hierarchy(spark, sf):
    e = table(spark, sf, "embeddings").select(F.expr(BLOCK).alias("object_id"), F.col("vec_id").alias("point_id"), "embedding").withColumn("feature", F.col("embedding").cast("array<double>"))
    rows = e.select("object_id", "point_id", "feature", *[F.col("feature")[k].alias(c) for k, c in enumerate("xyz")])
    return P.clusters(rows, "object_id", "point_id", 4, [0.3, 0.6])


@query()
def g7_detection_metrics(spark, sf):
    b = boxes(spark, sf)
    side = lambda x1, y1, x2, y2, gt: b.select("image_id", F.col("label").alias("category"), "ord", F.col(x1).alias("x"), F.col(y1).alias("y"), (F.col(x2) - F.col(x1)).alias("w"), (F.col(y2) - F.col(y1)).alias("h"), "score", F.lit(gt).alias("is_gt"), (F.lit(gt) & (F.col("ord") == 7)).alias("crowd"))
    got = P.detection_metrics(side("x1", "y1", "x2", "y2", False).unionByName(side("gx1", "gy1", "gx2", "gy2", True)))
    return got.select("category", "area", "most", *[rounded(F.col(c), 4).alias(c) for c in ("ap", "ap50", "ap75", "ar")])


@query("SELECT p_partkey, round(CASE WHEN p_size % 3 = 0 THEN 0.3 * c + 0.7 * 1.0 ELSE 0.4 * c END, 6) AS r FROM (SELECT p_partkey, p_size, CASE WHEN p_size % 10 = 0 THEN 0.7 ELSE p_size / 50.0 END::DOUBLE AS c FROM part)")
def g10_highlight(spark, sf):
    c = F.when(F.col("p_size") % 10 == 0, None).otherwise(F.col("p_size") / 50.0)
    return table(spark, sf, "part").select("p_partkey", rounded(G.highlighted(c, F.col("p_size") % 3 == 0, F.lit(G.HIGHLIGHTS[0][0]))).alias("r"))


@query(PTS + "SELECT object_id, point_id, round(2 * x + z + 1, 5) AS x, round(-y + 0.5, 5) AS y, round(x + 3 * z - 2, 5) AS z FROM p")
def g11_transform(spark, sf):
    p = points(spark, sf)
    moved = G.transformed(F.col("x"), F.col("y"), F.col("z"), [[2, 0, 1, 1], [0, -1, 0, 0.5], [1, 0, 3, -2], [0, 0, 0, 1]])
    return _xyz(p.select("object_id", "point_id", *[c.alias(n) for c, n in zip(moved, "xyz", strict=True)]))


@query(PTS + """, f AS (SELECT *, sqrt(x*x + y*y + z*z) AS l FROM p), d AS (SELECT object_id, point_id, x, y, z, -x/l AS fx, -y/l AS fy, -z/l AS fz FROM f), r AS (SELECT *, sqrt(fx*fx + fz*fz) AS rl FROM d), q AS (SELECT *, -fz/rl AS rx, fx/rl AS rz FROM r)
 SELECT object_id, point_id, round(rx, 5) AS right_x, round(rz, 5) AS right_z, round(-rz * fy, 5) AS up_x, round(rz * fx - rx * fz, 5) AS up_y, round(fx, 5) AS forward_x, round(-(fx*x + fy*y + fz*z), 5) AS forward_offset FROM q""")
def g12_look_at(spark, sf):
    m = G.look_at([F.col(c) for c in "xyz"], [F.lit(0.0)] * 3)
    named = {"right_x": m[0], "right_z": m[2], "up_x": m[4], "up_y": m[5], "forward_x": m[8], "forward_offset": m[11]}
    return points(spark, sf).select("object_id", "point_id", *[rounded(c + 0.0, 5).alias(n) for n, c in named.items()])


PROJECT = """, v AS (SELECT object_id, point_id, 100 * x / (z + 4) + 64 AS u, 100 * y / (z + 4) + 48 AS v, abs(z + 4) AS depth, z + 4 AS c FROM p), i AS (SELECT object_id, point_id, u, v, depth FROM v WHERE c > 0 AND u >= 0 AND u < 128 AND v >= 0 AND v < 96) """


def _projected(spark, sf):
    p = points(spark, sf)
    return p.select("object_id", "point_id", G.projected(F.col("x"), F.col("y"), F.col("z") + 4, 100.0, 64.0, 48.0, 128, 96).alias("i")).filter("i is not null").select("object_id", "point_id", "i.*")


@query(PTS + PROJECT + "SELECT object_id, point_id, round(u, 4) AS u, round(v, 4) AS v, round(depth, 5) AS depth, CAST(least(greatest(floor(v / 14), 0), 6) * 9 + least(greatest(floor(u / 14), 0), 8) AS BIGINT) AS patch FROM i")
def g13_g15_projection(spark, sf):
    return _projected(spark, sf).select("object_id", "point_id", rounded(F.col("u"), 4).alias("u"), rounded(F.col("v"), 4).alias("v"), rounded(F.col("depth"), 5).alias("depth"), G.patch_index(F.col("u"), F.col("v"), 14, 9, 7).cast("bigint").alias("patch"))


@query(PTS + PROJECT + """, b AS (SELECT object_id, CAST(floor(u / 4) AS BIGINT) AS px, CAST(floor(v / 4) AS BIGINT) AS py, min(depth) AS near FROM i GROUP BY ALL), m AS (SELECT object_id, avg(near) AS mean FROM b GROUP BY object_id)
 SELECT i.object_id, point_id, near > 0 AND abs(depth - near) < 0.1 * mean AS visible FROM i JOIN b ON i.object_id = b.object_id AND floor(u / 4) = px AND floor(v / 4) = py JOIN m ON m.object_id = i.object_id""")
def g14_g29_visibility(spark, sf):
    i = _projected(spark, sf).withColumns({"px": F.floor(F.col("u") / 4), "py": F.floor(F.col("v") / 4)})
    buffer = i.groupBy("object_id", "px", "py").agg(F.min("depth").alias("near"))
    mean = buffer.groupBy("object_id").agg(F.avg("near").alias("mean"))
    return i.join(buffer, ["object_id", "px", "py"]).join(mean, "object_id").select("object_id", "point_id", G.visible(F.col("depth"), F.col("near"), F.col("mean"), 0.1).alias("visible"))


@query(PTS + PROJECT + """, b AS (SELECT object_id, CAST(floor(u / 8) AS BIGINT) AS px, CAST(floor(v / 8) AS BIGINT) AS py, min(depth) AS d FROM i GROUP BY ALL)
 SELECT a.object_id, a.px, a.py, round(a.d - b.d, 5) AS difference FROM b a JOIN b b ON a.px = b.px AND a.py = b.py AND b.object_id = a.object_id + 1 WHERE a.d > 0 AND b.d > 0""")
def g30_depth_difference(spark, sf):
    i = _projected(spark, sf)
    b = i.groupBy("object_id", F.floor(F.col("u") / 8).alias("px"), F.floor(F.col("v") / 8).alias("py")).agg(F.min("depth").alias("d"))
    other = b.select((F.col("object_id") - 1).alias("object_id"), "px", "py", F.col("d").alias("e"))
    return b.join(other, ["object_id", "px", "py"]).filter("d > 0 and e > 0").select("object_id", "px", "py", rounded(F.col("d") - F.col("e"), 5).alias("difference"))


SPHERE = """v AS (SELECT CAST(i * 8 + j AS BIGINT) AS view, sin(pi() * (i + 1) / 5) * cos(2 * pi() * j / 8) AS x, cos(pi() * (i + 1) / 5) AS y, sin(pi() * (i + 1) / 5) * sin(2 * pi() * j / 8) AS z FROM range(4) a(i), range(8) b(j) UNION ALL SELECT 32, 0, 1, 0 UNION ALL SELECT 33, 0, -1, 0)"""


@query(PTS + f", {SPHERE}, s AS (SELECT object_id, max(sqrt(x*x + y*y + z*z)) AS r FROM p GROUP BY object_id) SELECT object_id, view, round(2 * r * v.x, 5) + 0.0 AS x, round(2 * r * v.y, 5) + 0.0 AS y, round(2 * r * v.z, 5) + 0.0 AS z FROM s, v")
def g16_sphere_views(spark, sf):
    """Each object from all sides, at twice its size."""
    size = points(spark, sf).groupBy("object_id").agg(F.max(F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)).alias("r"))
    views = size.crossJoin(F.broadcast(G.sphere_views(spark, 4, 8)))
    return views.select("object_id", "view", *[(rounded(2 * F.col("r") * F.col(c), 5) + 0.0).alias(c) for c in "xyz"])


@query(PTS + ", a AS (SELECT *, sqrt(x*x + y*y + z*z) AS r FROM p) SELECT object_id, point_id, round(x, 4) + 0.0 AS x, round(y, 4) + 0.0 AS y, round(z, 4) + 0.0 AS z, round(degrees(asin(y / r)), 4) + 0.0 AS elevation FROM a")
def g17_view_angles(spark, sf):
    p = points(spark, sf)
    az, el = G.view_angles(F.col("x"), F.col("y"), F.col("z"))
    r = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    back = G.view_point(az, el, r)
    return p.select("object_id", "point_id", *[(rounded(c, 4) + 0.0).alias(n) for c, n in zip(back, "xyz", strict=True)], (rounded(el, 4) + 0.0).alias("elevation"))


CENTRES = PTS + ", c AS (SELECT object_id, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM p GROUP BY object_id) "


@query(CENTRES + """, d AS (SELECT p.object_id, point_id, sqrt((p.x-c.x)*(p.x-c.x) + (p.y-c.y)*(p.y-c.y) + (p.z-c.z)*(p.z-c.z)) AS d FROM p JOIN c USING (object_id))
 SELECT object_id, point_id, round(0.5 + 1.5 * (d - min(d) OVER w) / (max(d) OVER w - min(d) OVER w + 1e-6), 5) AS saliency FROM d WINDOW w AS (PARTITION BY object_id)""")
def g18_saliency(spark, sf):
    p = points(spark, sf)
    centre = p.groupBy("object_id").agg(*[F.avg(c).alias(f"c{c}") for c in "xyz"])
    off = p.join(centre, "object_id").withColumn("d", F.sqrt(sum(((F.col(c) - F.col(f"c{c}")) ** 2 for c in "xyz"), F.lit(0.0))))
    return groups.min_max(off, ["object_id"], "d", "saliency", 1.0, 0.5, 2.0).select("object_id", "point_id", rounded(F.col("saliency"), 5).alias("saliency"))


PAIRS = CENTRES + ", q AS (SELECT a.object_id AS a, b.object_id AS b, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d FROM c a JOIN c b ON a.object_id < b.object_id) "


def _centre_pairs(spark, sf):
    c = points(spark, sf).groupBy("object_id").agg(*[F.avg(k).alias(k) for k in "xyz"])
    a, b = c.select(F.col("object_id").alias("a"), *[F.col(k).alias(f"a{k}") for k in "xyz"]), c.select(F.col("object_id").alias("b"), *[F.col(k).alias(f"b{k}") for k in "xyz"])
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.sqrt(sum(((F.col(f"a{k}") - F.col(f"b{k}")) ** 2 for k in "xyz"), F.lit(0.0))).alias("d"), F.lit(0).alias("all"))


@query(PAIRS + "SELECT a, b, round(1 - (d - (SELECT min(d) FROM q)) / ((SELECT max(d) FROM q) - (SELECT min(d) FROM q) + 1e-6), 5) AS confusion FROM q")
def g20_pair_confusion(spark, sf):
    return groups.min_max(_centre_pairs(spark, sf), ["all"], "d", "share", 0.5).select("a", "b", rounded(1 - F.col("share"), 5).alias("confusion"))


@query(PAIRS + """, n AS (SELECT o, min(d) AS d FROM (SELECT a AS o, d FROM q UNION ALL SELECT b, d FROM q) GROUP BY o), s AS (SELECT object_id AS o, avg(sqrt((p.x-c.x)*(p.x-c.x) + (p.y-c.y)*(p.y-c.y) + (p.z-c.z)*(p.z-c.z))) AS s FROM p JOIN c USING (object_id) GROUP BY 1)
 SELECT o AS object_id, round(0.8 * (1 - (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER () + 1e-6)) + 0.2 * (s - min(s) OVER ()) / (max(s) OVER () - min(s) OVER () + 1e-6), 4) AS difficulty FROM n JOIN s USING (o)""")
def g19_part_difficulty(spark, sf):
    q = _centre_pairs(spark, sf)
    near = q.select(F.col("a").alias("object_id"), "d").unionByName(q.select(F.col("b").alias("object_id"), "d")).groupBy("object_id").agg(F.min("d").alias("d"))
    vec = points(spark, sf).select("object_id", "point_id", F.array("x", "y", "z").alias("v"))
    both = near.join(reports.spread(vec, "object_id", "v"), "object_id").withColumn("all", F.lit(0))
    scaled = groups.min_max(groups.min_max(both, ["all"], "d", "nd"), ["all"], "spread", "ns")
    return scaled.select("object_id", rounded(0.8 * (1 - F.col("nd")) + 0.2 * F.col("ns"), 4).alias("difficulty"))


@query()
def g21_g22_a27_mask_scores(spark, sf):
    px = table(spark, sf, "lineitem").select(F.floor(F.col("l_orderkey") / 50).alias("view"), (F.col("l_linenumber") % 3).alias("part"), (F.col("l_partkey") % 32).alias("row"), (F.col("l_suppkey") % 32).alias("col"))
    got = P.mask_scores(px, "view", "part", 32, 32)
    return got.select("view", rounded(F.col("connectivity")).alias("connectivity"), rounded(F.col("separation")).alias("separation"))


#: Objects that do not grow with the table, of three parts, and six places to look from.
VIEWED = "SELECT CAST(object_id * 100000 + floor(point_id / 250) AS BIGINT) AS object_id, point_id, point_id % 3 AS part, 4 * x AS x, 4 * y AS y, 4 * z AS z, 1.0 + point_id % 4 AS weight FROM ({0}) AS t"
EYES = "SELECT * FROM (VALUES (0, 0.0, 0.0, 5.0), (1, 0.0, 0.0, -5.0), (2, 5.0, 0.0, 0.0), (3, -3.0, 1.0, 4.0), (4, 1.0, -4.0, 3.0), (5, 0.0, 5.0, 0.0)) AS e(view, x, y, z)"
#: Side and focal length of the image, radius of discs.
IMAGE, FOCAL, RADIUS = 64, 60.0, 2


def _views(spark, sf):
    """The points of each object, and its views."""
    p = derived(spark, sf, VIEWED.format(POINTS_SPARK), "embeddings").withColumn("weight", F.col("weight").cast("double"))
    eyes = spark.sql(EYES).select("view", *[F.col(c).cast("double") for c in "xyz"])
    return p, p.select("object_id").distinct().crossJoin(F.broadcast(eyes))


def _visible(spark, sf):
    p, eyes = _views(spark, sf)
    return V.visible_points(V.placed(p, eyes, FOCAL, IMAGE), RADIUS, IMAGE)


@query(f"""WITH p AS ({VIEWED.format(POINTS_SQL)}), e AS (SELECT view, x::DOUBLE AS ex, y::DOUBLE AS ey, z::DOUBLE AS ez FROM ({EYES}) AS t),
f AS (SELECT *, (0 - ex) / sqrt(ex*ex + ey*ey + ez*ez) AS fx, (0 - ey) / sqrt(ex*ex + ey*ey + ez*ez) AS fy, (0 - ez) / sqrt(ex*ex + ey*ey + ez*ez) AS fz FROM e),
l AS (SELECT *, sqrt(fz*fz + fx*fx) AS rl FROM f), r AS (SELECT *, CASE WHEN rl < 1e-6 THEN 1.0 ELSE -fz / rl END AS rx, CASE WHEN rl < 1e-6 THEN 0.0 ELSE fx / rl END AS rz FROM l),
c AS (SELECT *, -rz * fy AS ux, rz * fx - rx * fz AS uy, rx * fy AS uz FROM r),
m AS (SELECT *, -(rx*ex + rz*ez) AS ro, -(ux*ex + uy*ey + uz*ez) AS uo, -(fx*ex + fy*ey + fz*ez) AS fo FROM c),
a AS (SELECT object_id, view, point_id, part, rx*x + rz*z + ro AS px, ux*x + uy*y + uz*z + uo AS py, fx*x + fy*y + fz*z + fo AS pz FROM p CROSS JOIN m),
s AS (SELECT object_id, view, point_id, part, CAST(floor({FOCAL} * px / pz + {IMAGE / 2}) AS INTEGER) AS col, CAST(floor({FOCAL} * py / pz + {IMAGE / 2}) AS INTEGER) AS row, abs(pz) AS depth FROM a
  WHERE pz > 0 AND {FOCAL} * px / pz + {IMAGE / 2} >= 0 AND {FOCAL} * px / pz + {IMAGE / 2} < {IMAGE} AND {FOCAL} * py / pz + {IMAGE / 2} >= 0 AND {FOCAL} * py / pz + {IMAGE / 2} < {IMAGE}),
d AS (SELECT y, x FROM range(-{RADIUS}, {RADIUS} + 1) t1(y), range(-{RADIUS}, {RADIUS} + 1) t2(x) WHERE y * y + x * x <= {RADIUS * RADIUS}),
n AS (SELECT object_id, view, row + y AS row, col + x AS col, min(depth) AS near FROM s, d GROUP BY ALL),
v AS (SELECT s.* FROM s JOIN n USING (object_id, view, row, col) WHERE depth - near <= 0.02 * depth),
k AS (SELECT DISTINCT object_id, view, part, row + y AS row, col + x AS col FROM v, d WHERE row + y BETWEEN 0 AND {IMAGE - 1} AND col + x BETWEEN 0 AND {IMAGE - 1})
SELECT object_id, view, part, count(*) AS pixels, CAST(sum(row) AS BIGINT) AS rows, CAST(sum(col) AS BIGINT) AS cols FROM k GROUP BY object_id, view, part""")
def g21_part_pixels(spark, sf):
    k = V.part_pixels(_visible(spark, sf), RADIUS, IMAGE)
    return k.groupBy("object_id", "view", "part").agg(F.count(F.lit(1)).alias("pixels"), F.sum("row").alias("rows"), F.sum("col").alias("cols"))


def _candidates(spark, sf):
    p, eyes = _views(spark, sf)
    return p, eyes, V.view_candidates(V.visible_points(V.placed(p, eyes, FOCAL, IMAGE), RADIUS, IMAGE), V.part_pairs(p), RADIUS, IMAGE)


@query()
def g21_g22_a27_view_scores(spark, sf):
    _, _, c = _candidates(spark, sf)
    return c.select("object_id", "view", rounded(F.col("overall")).alias("overall"), rounded(F.col("separation")).alias("separation"), rounded(F.col("connectivity")).alias("connectivity"), F.to_json("shown").alias("shown"))


@query()
def l15_chosen_views(spark, sf):
    p, eyes, c = _candidates(spark, sf)
    # Parts far from the others are easy to tell apart.
    pairs = V.part_pairs(p)
    both = pairs.select("object_id", F.col("a").alias("part"), "confusion").unionByName(pairs.select("object_id", F.col("b").alias("part"), "confusion"))
    hard = both.groupBy("object_id", "part").agg(F.max("confusion").alias("weight"))
    return V.chosen_views(c, eyes, hard, 4).withColumn("gain", rounded(F.col("gain")))


@query()
def g23_principal(spark, sf):
    got = P.principal(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "v", 64)
    return got.select("vec_id", *[rounded(F.col("pca")[k], 4).alias(f"c{k}") for k in range(3)])


_SHAPES = sorted({(i, j) for i in range(1, 13) for j in range(1, 13) if i * j <= 12}, key=lambda s: (s[0] * s[1], s))
_SHAPE_SQL = ", ".join(f"({n}, {i}, {j})" for n, (i, j) in enumerate(_SHAPES))


@query(f"""WITH s(n, i, j) AS (VALUES {_SHAPE_SQL}), p AS (SELECT p_partkey, (p_size * 37 % 900 + 100)::DOUBLE AS w, (p_size * 53 % 700 + 100)::DOUBLE AS h FROM part),
 d AS (SELECT *, abs(w / h - i / j) AS off, w * h > 0.5 * 448 * 448 * i * j AS big, min(abs(w / h - i / j)) OVER (PARTITION BY p_partkey) AS best FROM p, s),
 k AS (SELECT *, min(n) OVER (PARTITION BY p_partkey) AS first FROM d WHERE off = best)
 SELECT p_partkey, CAST(i AS INTEGER) AS across, CAST(j AS INTEGER) AS down FROM k WHERE n = first OR big QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY n DESC) = 1""")
def g24_tile_grid(spark, sf):
    w, h = (F.col("p_size") * 37 % 900 + 100).cast("double"), (F.col("p_size") * 53 % 700 + 100).cast("double")
    return table(spark, sf, "part").select("p_partkey", G.tile_grid(w, h).alias("g")).select("p_partkey", "g.*")


@query("""WITH w AS (SELECT conv_id, turn, role, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) AS n FROM conversations), t AS (SELECT conv_id, sum(n) AS n, sum(CASE WHEN role = 'assistant' THEN n ELSE 0 END) AS k FROM w GROUP BY conv_id)
 SELECT conv_id, CAST(n AS BIGINT) AS tokens, CAST(k AS BIGINT) AS trained, CAST((SELECT max(n) FROM t) AS BIGINT) AS padded FROM t""")
def g26_g27_collate(spark, sf):
    from ..functions import text as T

    words = table(spark, sf, "conversations").select("conv_id", "turn", "role", T.words(F.col("text")).alias("w"))
    ids = F.transform("w", lambda x: F.pmod(F.xxhash64(x), F.lit(32000)))
    labels = F.when(F.col("role") == "assistant", ids).otherwise(F.transform("w", lambda _: F.lit(-100).cast("bigint")))
    rows = words.withColumns({"ids": ids, "labels": labels}).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "ids", "labels"))).alias("t"))
    rows = rows.select("conv_id", F.flatten("t.ids").alias("ids"), F.flatten("t.labels").alias("labels"))
    longest = rows.agg(F.max(F.size("ids")).alias("longest"))
    pad = lambda c, v: F.concat(c, F.array_repeat(F.lit(v).cast("bigint"), F.col("longest") - F.size("ids")))
    out = rows.crossJoin(F.broadcast(longest)).select("conv_id", pad("ids", 0).alias("input_ids"), pad("labels", -100).alias("labels"), F.concat(F.transform("ids", lambda _: F.lit(1)), F.array_repeat(F.lit(0), F.col("longest") - F.size("ids"))).alias("mask"))
    return out.select("conv_id", F.aggregate("mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("tokens"), F.size(F.filter("labels", lambda x: x != -100)).cast("bigint").alias("trained"), F.size("input_ids").cast("bigint").alias("padded"))


@query(PTS + "SELECT object_id, point_id, round(y - min(y) OVER (PARTITION BY object_id), 6) AS height FROM p")
def g28_height(spark, sf):
    return points(spark, sf).select("object_id", "point_id", rounded(F.col("y") - F.min("y").over(W.partitionBy("object_id"))).alias("height"))


@query(PTS + ", r AS (SELECT object_id, point_id, sqrt(x*x + y*y + z*z) AS r FROM p), q AS (SELECT object_id, quantile_cont(r, 0.95) AS q FROM r GROUP BY object_id) SELECT r.object_id, point_id FROM r JOIN q ON r.object_id = q.object_id AND r <= q")
def g31_outlier_trim(spark, sf):
    r = points(spark, sf).select("object_id", "point_id", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("r"))
    q = r.groupBy("object_id").agg(F.percentile("r", F.lit(0.95)).alias("q"))
    return r.join(q, "object_id").filter("r <= q").select("object_id", "point_id")


@query(PTS + """, g AS (SELECT 2 + 0.25 * k AS d FROM range(30) a(k)), s AS (SELECT object_id, d, avg((abs(x) * 2 < d + z AND abs(y) * 2 < d + z)::INT) AS inside, avg(1 / (d + 3)) AS occupied FROM p, g GROUP BY ALL)
 SELECT object_id, round(d, 4)::DOUBLE AS distance, round(1 - abs(occupied - 0.15), 6) AS score FROM s WHERE inside >= 0.9 QUALIFY row_number() OVER (PARTITION BY object_id ORDER BY round(1 - abs(occupied - 0.15), 9) DESC, d) = 1""")
def g32_grid_search(spark, sf):
    grid = points(spark, sf).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("d", 2 + 0.25 * F.col("k"))
    inside = (F.abs("x") * 2 < F.col("d") + F.col("z")) & (F.abs("y") * 2 < F.col("d") + F.col("z"))
    s = grid.groupBy("object_id", "d").agg(F.avg(inside.cast("int")).alias("inside"), F.avg(1 / (F.col("d") + 3)).alias("occupied")).filter("inside >= 0.9")
    scored = s.select("object_id", F.col("d").alias("distance"), (1 - F.abs(F.col("occupied") - 0.15)).alias("score"))
    return sampling.top_per_group(scored, ["object_id"], [F.round("score", 9).desc(), F.col("distance")], 1).select("object_id", rounded(F.col("distance"), 4).alias("distance"), rounded(F.col("score")).alias("score"))


@query(PTS + "SELECT object_id, point_id, row_number() OVER (PARTITION BY object_id ORDER BY x*x + y*y + z*z, point_id) <= 10 AS inside FROM p")
def g33_nearest_crop(spark, sf):
    p = points(spark, sf)
    far = F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z")
    return p.select("object_id", "point_id", (F.row_number().over(W.partitionBy("object_id").orderBy(far, "point_id")) <= 10).alias("inside"))


@query(PTS + "SELECT DISTINCT a.object_id, a.point_id FROM p a JOIN p b ON a.object_id = b.object_id AND b.point_id % 7 = 0 AND (a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z) < 0.09")
def j17_within_radius(spark, sf):
    p = points(spark, sf)
    return joins.within(p, p.filter("point_id % 7 = 0"), 0.3, "object_id").select("object_id", "point_id")


@query(PTS + """, n AS (SELECT a.object_id, a.point_id, min(sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z))) AS d FROM p a JOIN p b ON a.object_id = b.object_id AND a.point_id <> b.point_id GROUP BY ALL)
 SELECT round(avg((d <= 0.8)::INT), 6) AS fitness, round(sqrt(avg(CASE WHEN d <= 0.8 THEN d * d END)), 6) AS rmse FROM n""")
def a28_fitness(spark, sf):
    near = P.nearest(points(spark, sf), "object_id", "point_id", 1, itself=False).select(F.sqrt("distance2").alias("d"))
    got = reports.fitness(near, "d", 0.8)
    return got.select(rounded(F.col("fitness")).alias("fitness"), rounded(F.col("rmse")).alias("rmse"))


@query()
def l14_distinct_top(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.expr(BLOCK).alias("label"), "vec_id", (F.col("vec_id") * 37 % 101).cast("double").alias("score"), F.col("embedding").alias("vector"))
    return P.distinct_top(rows, "label", "vec_id", 5)


@query()
def l15_greedy_views(spark, sf):
    e = table(spark, sf, "embeddings")
    rows = e.select(F.expr(BLOCK).alias("label"), "vec_id", F.transform("embedding", lambda x: x > 0.5).alias("seen"), F.slice("embedding", 1, 3).alias("vector"), (F.col("vec_id") % 10 / 10).alias("separation"))
    got = P.greedy_views(rows, "label", "vec_id", 6)
    return got.withColumn("gain", rounded(F.col("gain")))


# --- hierarchies: region, nation, customer


def _tree(spark, sf):
    t = derived(spark, sf, TREE, "region", "nation", "customer")
    return trees.placed(t.withColumn("name", F.array("label")))


WALK = f"""WITH RECURSIVE t AS ({TREE}), w AS (SELECT t.*, 0 AS depth, [ord] AS path, [node_id] AS line FROM t WHERE parent_id IS NULL
 UNION ALL SELECT t.*, w.depth + 1, list_append(w.path, t.ord), list_append(w.line, t.node_id) FROM t JOIN w ON t.parent_id = w.node_id) """


@query(WALK + "SELECT node_id, CAST(depth AS INTEGER) AS depth, array_to_string(path, '/') AS path, CAST(row_number() OVER (ORDER BY depth, path) AS INTEGER) AS bfs, CAST(row_number() OVER (ORDER BY path) AS INTEGER) AS dfs FROM w")
def h1_h2_h3_orders(spark, sf):
    t = trees.depth_first(trees.breadth_first(_tree(spark, sf)))
    return t.select("node_id", "depth", F.array_join(F.col("path").cast("array<string>"), "/").alias("path"), *[F.col(c).cast("int").alias(c) for c in ("bfs", "dfs")])


@query("SELECT 'o' || CAST(r_regionkey AS STRING) AS object_id, CAST(count(*) + 1 AS BIGINT) AS nodes, CAST(max(n_nationkey) AS BIGINT) AS last FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY r_regionkey")
def h1_json_trees(spark, sf):
    kids = table(spark, sf, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.sort_array(F.collect_list(F.struct(F.col("n_nationkey").alias("nodeId"), F.col("n_name").alias("name")))).alias("children"))
    raw = kids.select(F.concat(F.lit("o"), "k").alias("id"), F.to_json(F.struct(F.concat(F.lit("r"), "k").alias("nodeId"), F.array().cast("array<string>").alias("name"), "children")).alias("tree"))
    nodes = trees.parse(raw, "id", "tree")
    return nodes.groupBy("object_id").agg(F.count(F.lit(1)).alias("nodes"), F.max(F.col("node_id").try_cast("bigint")).alias("last"))


@query(WALK + """, s AS (SELECT parent_id, count(*) AS n FROM t WHERE parent_id IS NOT NULL GROUP BY parent_id), k AS (SELECT w.*, coalesce(s.n, 2) AS sib FROM w LEFT JOIN s ON s.parent_id = w.parent_id)
 SELECT node_id, array_to_string([label], '|') AS names, mask_id, CAST(1 AS INTEGER) AS merged FROM k WHERE sib > 1 AND node_id NOT IN (SELECT parent_id FROM k WHERE sib = 1)""")
def h4_compressed_chains(spark, sf):
    got = trees.compressed(_tree(spark, sf))
    return got.filter(F.size("merged_ids") == 1).select("node_id", F.array_join("names", "|").alias("names"), "mask_id", F.size("merged_ids").alias("merged"))


@query()
def h6_pushed_names(spark, sf):
    return trees.pushed_names(_tree(spark, sf)).select("node_id", F.array_join("candidates", "|").alias("candidates"))


@query(WALK + ", d AS (SELECT node_id, row_number() OVER (ORDER BY path) AS place FROM w) SELECT w.parent_id, CAST(d.place AS INTEGER) AS place, array_to_string(list(w.node_id ORDER BY w.ord, w.node_id), ',') AS children FROM w JOIN d ON d.node_id = w.parent_id GROUP BY w.parent_id, d.place")
def h7_sibling_groups(spark, sf):
    return trees.sibling_groups(_tree(spark, sf)).select("parent_id", "place", F.array_join("children", ",").alias("children"))


@query(WALK + ", bad AS (SELECT node_id FROM w WHERE depth <= 1 AND points < 2) SELECT node_id FROM w WHERE depth <= 1 AND NOT list_has_any(line, (SELECT list(node_id) FROM bad))")
def h8_expanded(spark, sf):
    return trees.expanded(_tree(spark, sf), "points", 1, 2).select("node_id")


@query(WALK + ", l AS (SELECT * FROM w WHERE node_id NOT IN (SELECT parent_id FROM t WHERE parent_id IS NOT NULL)), x AS (SELECT unnest(line) AS node_id FROM l) SELECT node_id, CAST(count(*) AS BIGINT) AS n_leaves FROM x GROUP BY node_id")
def a17_leaf_counts(spark, sf):
    return trees.leaf_counts(_tree(spark, sf)).select("node_id", "n_leaves")


@query(WALK + """, x AS (SELECT unnest(line) AS node_id, mask_id FROM w WHERE mask_id IS NOT NULL), a AS (SELECT node_id, string_agg(mask_id, ',' ORDER BY mask_id) AS masks FROM x GROUP BY node_id),
 y AS (SELECT w.node_id AS owner, unnest(w.line) AS node_id, w.mask_id, w.line FROM w WHERE mask_id IS NOT NULL), h AS (SELECT node_id FROM w WHERE mask_id IS NOT NULL),
 f AS (SELECT y.node_id, y.mask_id FROM y WHERE NOT EXISTS (SELECT 1 FROM h WHERE list_contains(y.line, h.node_id) AND h.node_id <> y.owner AND list_position(y.line, h.node_id) >= list_position(y.line, y.node_id))),
 b AS (SELECT node_id, string_agg(mask_id, ',' ORDER BY mask_id) AS masks FROM f GROUP BY node_id)
 SELECT w.node_id, coalesce(a.masks, '') AS all_masks, coalesce(b.masks, '') AS first_masks FROM w LEFT JOIN a ON a.node_id = w.node_id LEFT JOIN b ON b.node_id = w.node_id""")
def a19_subtree_masks(spark, sf):
    t = _tree(spark, sf)
    one, two = trees.subtree_masks(t), trees.subtree_masks(t, stop_at_first=True).withColumnRenamed("masks", "first")
    return one.join(two, ["object_id", "node_id"]).select("node_id", F.array_join("masks", ",").alias("all_masks"), F.array_join("first", ",").alias("first_masks"))


@query(WALK + """, y AS (SELECT w.node_id AS owner, unnest(w.line) AS node_id, w.mask_id, w.line FROM w WHERE mask_id IS NOT NULL), h AS (SELECT node_id FROM w WHERE mask_id IS NOT NULL),
 f AS (SELECT y.node_id, y.mask_id FROM y WHERE NOT EXISTS (SELECT 1 FROM h WHERE list_contains(y.line, h.node_id) AND h.node_id <> y.owner AND list_position(y.line, h.node_id) >= list_position(y.line, y.node_id))),
 p AS (SELECT 'mc' || CAST(o_custkey AS STRING) AS mask_id, o_orderkey FROM orders) SELECT node_id, CAST(count(*) AS BIGINT) AS n, CAST(min(o_orderkey) AS BIGINT) AS first FROM f JOIN p USING (mask_id) GROUP BY node_id""")
def a18_regions(spark, sf):
    pts = table(spark, sf, "orders").select(F.lit("world").alias("object_id"), F.concat(F.lit("mc"), F.col("o_custkey")).alias("mask_id"), F.col("o_orderkey").alias("point_id"))
    return trees.regions(_tree(spark, sf), pts).groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.min("point_id").alias("first"))


@query("SELECT 'n' || CAST(n_nationkey AS STRING) AS node_id, r_name AS parent_name, coalesce(string_agg(c_name, ',' ORDER BY c_custkey), '') AS child_names FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey, r_name")
def j8_parent_child_names(spark, sf):
    return trees.with_names(_tree(spark, sf)).filter(F.col("node_id").startswith("n")).select("node_id", "parent_name", F.array_join("child_names", ",").alias("child_names"))


@query("""WITH m AS (SELECT o_custkey, o_orderkey, coalesce(sum(o_orderkey % 50 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM orders)
 SELECT o_custkey AS object_id, o_orderkey AS node_id, CAST(o + 1 AS BIGINT) AS point_id FROM m WHERE o_orderkey % 3 = 0""")
def j7_part_points(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("object_id"), F.col("o_orderkey").alias("mesh"))
    meshes = o.withColumn("n_faces", F.col("mesh") % 50 + 1)
    nodes = o.filter("mesh % 3 = 0").select("object_id", F.col("mesh").alias("node_id"), F.col("mesh").cast("string").alias("mask_id"))
    masks = o.select("object_id", F.col("mesh").cast("string").alias("mask_id"), "mesh", F.lit(1).alias("face"))
    total = meshes.groupBy("object_id").agg(F.sum("n_faces").alias("n"))
    faces = total.select("object_id", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("n"))).alias("face_id")).withColumn("point_id", F.col("face_id"))
    return trees.part_points(nodes, masks, meshes, faces)


@query("""WITH k AS (SELECT c_nationkey AS parent, 1 AS l, count(DISTINCT c_custkey % 1) AS n FROM customer GROUP BY 1 UNION ALL SELECT c_nationkey, 2, count(DISTINCT c_custkey % 3) FROM customer GROUP BY 1 UNION ALL SELECT c_nationkey, 3, count(DISTINCT c_custkey % 9) FROM customer GROUP BY 1)
 SELECT CAST(parent AS BIGINT) AS parent, CAST(coalesce(min(CASE WHEN n > 1 THEN l END), max(l)) AS INTEGER) AS child_level FROM k GROUP BY parent""")
def j12_branching_level(spark, sf):
    c = table(spark, sf, "customer")
    level = lambda n, e: c.select(F.lit("o").alias("object_id"), F.lit(n).alias("level"), F.col("c_custkey").alias("point_id"), e.cast("bigint").alias("cluster_id"))
    k = F.col("c_custkey")
    labels = level(0, F.col("c_nationkey")).unionByName(level(1, k % 1)).unionByName(level(2, k % 3)).unionByName(level(3, k % 9))
    return trees.branching_level(labels, "object_id", "level", "point_id", "cluster_id", 0).select("parent", "child_level")


@query(WALK + "SELECT 'world' AS object_id, string_agg(repeat('  ', depth) || '- ' || label, chr(10) ORDER BY path) AS tree FROM w")
def t31_tree_text(spark, sf):
    return trees.as_text(_tree(spark, sf))


@query(WALK + "SELECT node_id, CAST(row_number() OVER (ORDER BY depth, path) AS INTEGER) AS rank FROM w WHERE depth > 0 AND node_id NOT IN (SELECT parent_id FROM t WHERE parent_id IS NOT NULL) QUALIFY rank <= 50")
def pf5_parts(spark, sf):
    return trees.parts(_tree(spark, sf), 50, leaves_only=True).select("node_id", "rank")


