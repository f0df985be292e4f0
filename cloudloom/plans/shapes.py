"""Queries on hulls and meshes. Meshes are generated from ranges, so that the same SQL runs on both engines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import hull as H
from ..operators import mesh as M
from .registry import cloud, query, rounded

#: Side of the generated grid mesh; vertex i has row i // N and column i % N.
N = 24
VERTS = f"verts AS (SELECT CAST(i AS BIGINT) AS idx, CAST(i % {N} AS DOUBLE) AS x, CAST(i // {N} AS DOUBLE) AS y, sin(i % {N} * 0.7) * cos(i // {N} * 0.4) AS z FROM range({N * N}) t(i))"
CELL = f"(i // {N - 1}) * {N} + i % {N - 1}"
FACES = f"faces AS (SELECT CAST(2 * i AS BIGINT) AS face_id, CAST({CELL} AS BIGINT) AS v0, CAST({CELL} + 1 AS BIGINT) AS v1, CAST({CELL} + {N} AS BIGINT) AS v2 FROM range({(N - 1) ** 2}) t(i) UNION ALL SELECT 2 * i + 1, {CELL} + 1, {CELL} + {N + 1}, {CELL} + {N} FROM range({(N - 1) ** 2}) t(i))"
MESH = f"WITH {VERTS}, {FACES} "
EDGES = "he AS (SELECT face_id, least(v0, v1) AS a, greatest(v0, v1) AS b FROM faces UNION ALL SELECT face_id, least(v1, v2), greatest(v1, v2) FROM faces UNION ALL SELECT face_id, least(v2, v0), greatest(v2, v0) FROM faces)"


def grid(spark):
    v = spark.range(N * N).select(F.col("id").alias("idx"), (F.col("id") % N).alias("c"), F.floor(F.col("id") / N).cast("long").alias("r"))
    v = v.select("idx", F.col("c").cast("double").alias("x"), F.col("r").cast("double").alias("y"), (F.sin(F.col("c") * 0.7) * F.cos(F.col("r") * 0.4)).alias("z"))
    cell = (F.floor(F.col("id") / (N - 1)) * N + F.col("id") % (N - 1)).cast("long")
    two = F.array(F.struct((F.col("id") * 2).alias("face_id"), cell.alias("v0"), (cell + 1).alias("v1"), (cell + N).alias("v2")), F.struct((F.col("id") * 2 + 1).alias("face_id"), (cell + 1).alias("v0"), (cell + N + 1).alias("v1"), (cell + N).alias("v2")))
    f = spark.range((N - 1) ** 2).select(F.explode(two).alias("f")).select("f.*")
    return v, f


# hulls
@query("H1_convex_hull_2d")
def h1(spark, sf):
    return rounded(H.convex_2d(cloud(spark, sf), ["label"], "xy"))


@query("H1_convex_hull_extremes", "SELECT label, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM cloud GROUP BY label", "cloud")
def h1b(spark, sf):
    """A hull has the extremes of its cloud."""
    h = H.convex_2d(cloud(spark, sf), ["label"], "xy")
    return h.groupBy("label").agg(*(f(a).alias(f"{n}_{a}") for a in "xy" for n, f in (("min", F.min), ("max", F.max))))


@query("H1_best_projection_hull")
def h1c(spark, sf):
    return rounded(H.convex_2d(cloud(spark, sf), ["label"]))


@query("H2_convex_hull_3d")
def h2(spark, sf):
    return rounded(H.convex_3d(cloud(spark, sf), ["label"]))


@query("H3_area_and_volume", "SELECT CAST(s AS DOUBLE) AS side, CAST(6 * s * s AS DOUBLE) AS area, CAST(s * s * s AS DOUBLE) AS volume FROM range(1, 4) t(s)")
def h3(spark, sf):
    """Hulls of cubes with inner points."""
    i = F.col("id")
    p = spark.range(3 * 125).select((F.floor(i / 125) + 1).cast("double").alias("side"), (i % 125).alias("idx"))
    p = p.select("side", "idx", *((F.floor(F.col("idx") / d) % 5 / 4 * F.col("side")).alias(a) for a, d in (("x", 25), ("y", 5), ("z", 1))))
    return rounded(H.convex_3d(p, ["side"]).groupBy("side").agg(F.first("area").alias("area"), F.first("volume").alias("volume")))


@query("H4_concave_hull")
def h4(spark, sf):
    return H.concave(cloud(spark, sf), ["label"], 0.12)


@query("H5_concave_hull_3d")
def h5(spark, sf):
    return H.concave_faces(cloud(spark, sf), ["label"], 0.2)


@query("H6_alpha_zero_is_empty", "SELECT label, 0 AS pos FROM cloud WHERE false", "cloud")
def h6(spark, sf):
    return H.concave(cloud(spark, sf), ["label"], 0.0).select("label", F.col("pos").cast("int").alias("pos"))


@query("H7_contour_perimeters")
def h7(spark, sf):
    from ..operators.cloud import perimeter

    return rounded(perimeter(H.concave(cloud(spark, sf), ["label"], 0.12), ["label", "contour"], "pos"))


@query("H8_monotone_chain")
def h8(spark, sf):
    return H.convex_2d(cloud(spark, sf), ["label"], "xz").select("label", "pos", "idx")


@query("H9_hull_check", "SELECT label, true AS convex FROM cloud GROUP BY label", "cloud")
def h9(spark, sf):
    return H.checked(cloud(spark, sf), ["label"])


@query("H11_slice_perimeter", MESH + """, b AS (SELECT CASE WHEN ex <= ey AND ex <= ez THEN 0 WHEN ey <= ez THEN 1 ELSE 2 END AS axis, mx, my, mz FROM (SELECT max(x) - min(x) AS ex, max(y) - min(y) AS ey, max(z) - min(z) AS ez, (max(x) + min(x)) / 2 AS mx, (max(y) + min(y)) / 2 AS my, (max(z) + min(z)) / 2 AS mz FROM verts)),
l AS (SELECT axis, CASE axis WHEN 0 THEN mx WHEN 1 THEN my ELSE mz END AS level FROM b),
t AS (SELECT f.face_id, axis, level, """ + ", ".join(f"p{i}.x AS x{i}, p{i}.y AS y{i}, p{i}.z AS z{i}, CASE axis WHEN 0 THEN p{i}.x WHEN 1 THEN p{i}.y ELSE p{i}.z END - level AS h{i}" for i in range(3)) + """ FROM faces f JOIN verts p0 ON p0.idx = v0 JOIN verts p1 ON p1.idx = v1 JOIN verts p2 ON p2.idx = v2, l),
c AS (""" + " UNION ALL ".join(f"SELECT face_id, axis, level, x{i} + h{i} / (h{i} - h{j}) * (x{j} - x{i}) AS x, y{i} + h{i} / (h{i} - h{j}) * (y{j} - y{i}) AS y, z{i} + h{i} / (h{i} - h{j}) * (z{j} - z{i}) AS z FROM t WHERE (h{i} >= 0) <> (h{j} >= 0)" for i, j in ((0, 1), (1, 2), (2, 0))) + """),
s AS (SELECT face_id, axis, level, sqrt(pow(max(x) - min(x), 2) + pow(max(y) - min(y), 2) + pow(max(z) - min(z), 2)) AS d FROM c GROUP BY 1, 2, 3)
SELECT CAST(axis AS BIGINT) AS axis, round(level, 6) AS level, count(*) AS n_segments, round(sum(d), 6) AS perimeter FROM s GROUP BY axis, level""")
def h11(spark, sf):
    v, f = grid(spark)
    return rounded(H.slice_perimeter(f, v))


# meshes
@query("J23_faces_with_corners", MESH + "SELECT face_id, p0.x AS x0, p1.x AS x1, p2.x AS x2, round(p0.z + p1.z + p2.z, 6) AS z FROM faces JOIN verts p0 ON p0.idx = v0 JOIN verts p1 ON p1.idx = v1 JOIN verts p2 ON p2.idx = v2")
def j23(spark, sf):
    v, f = grid(spark)
    r = H.resolved(f, v)
    return rounded(r.select("face_id", "x0", "x1", "x2", (F.col("z0") + F.col("z1") + F.col("z2")).alias("z")))


@query("J24_face_adjacency", MESH + f", {EDGES} SELECT p.face_id AS f, q.face_id AS g, a, b FROM he p JOIN he q USING (a, b) WHERE p.face_id <> q.face_id")
def j24(spark, sf):
    return M.face_adjacency(grid(spark)[1])


@query("J25_edge_lookup", MESH + f", {EDGES} SELECT a, b, count(*) AS n FROM he GROUP BY a, b")
def j25(spark, sf):
    return M.edges(grid(spark)[1])


@query("M1_geodesic_paths")
def m1(spark, sf):
    v, f = grid(spark)
    return rounded(M.shortest_paths(f, v, 0).select("idx", "dist"))


@query("M2_decal_boundary")
def m2(spark, sf):
    """The boundary between four corners: the nearest vertices, and the paths from each to the next."""
    v, f = grid(spark)
    ends = [5 * N + 5, 5 * N + 17, 17 * N + 17, 17 * N + 5]
    out = None
    for side, (a, b) in enumerate(zip(ends, ends[1:] + ends[:1], strict=True)):
        p = M.path_to(M.shortest_paths(f, v, a, b), b).withColumn("side", F.lit(side))
        out = p if out is None else out.unionByName(p)
    return out


@query("M3_seed_triangle", MESH + ", n AS (SELECT idx FROM verts ORDER BY (x - 11.2) * (x - 11.2) + (y - 11.3) * (y - 11.3) + z * z, idx LIMIT 1) SELECT min(face_id) AS face_id FROM faces, n WHERE idx IN (v0, v1, v2)")
def m3(spark, sf):
    v, f = grid(spark)
    return M.seed_faces(f, v, (11.2, 11.3, 0.0))


#: The fence of the flood fill: edges of the square between rows and columns 5 and 17.
FENCE = f"fence AS (SELECT a, b FROM (SELECT DISTINCT a, b FROM he) WHERE (a // {N} IN (5, 17) AND b // {N} = a // {N} AND a % {N} BETWEEN 5 AND 17 AND b % {N} BETWEEN 5 AND 17) OR (a % {N} IN (5, 17) AND b % {N} = a % {N} AND a // {N} BETWEEN 5 AND 17 AND b // {N} BETWEEN 5 AND 17))"


def fence(f):
    e = M.edges(f)
    r, c = lambda x: F.floor(F.col(x) / N), lambda x: F.col(x) % N
    ok = lambda u, w: u("a").isin(5, 17) & (u("b") == u("a")) & w("a").between(5, 17) & w("b").between(5, 17)
    return e.filter(ok(r, c) | ok(c, r)).select("a", "b")


@query("M4_flood_fill", MESH + f"SELECT face_id FROM (SELECT face_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM faces JOIN verts ON idx IN (v0, v1, v2) GROUP BY face_id) WHERE x0 >= 5 AND x1 <= 17 AND y0 >= 5 AND y1 <= 17")
def m4(spark, sf):
    _, f = grid(spark)
    seed = f.filter(F.col("v0") == 11 * N + 11).agg(F.min("face_id").alias("face_id"))
    return M.flood(M.face_adjacency(f, fence(f)), seed)


@query("M5_decal_area", "SELECT CAST(288 AS BIGINT) AS n_faces, CAST(169 AS BIGINT) AS n_vertices")
def m5(spark, sf):
    """Corners, boundary, seed and fill together: the faces and vertices inside the fence."""
    v, f = grid(spark)
    inside = M.flood(M.face_adjacency(f, fence(f)), M.seed_faces(f, v, (11.2, 11.3, 0.0)))
    c = M.corners(f.join(inside, "face_id", "left_semi"))
    return c.agg(F.countDistinct("face_id").alias("n_faces"), F.countDistinct("v").alias("n_vertices"))


@query("M6_renumbered_submesh", MESH + ", c AS (SELECT face_id, 0 AS corner, v0 AS v FROM faces UNION ALL SELECT face_id, 1, v1 FROM faces UNION ALL SELECT face_id, 2, v2 FROM faces), s AS (SELECT * FROM c WHERE face_id % 3 = 0), n AS (SELECT v, row_number() OVER (ORDER BY min(face_id * 3 + corner)) - 1 AS new FROM s GROUP BY v) SELECT face_id, CAST(corner AS BIGINT) AS corner, v, new FROM s JOIN n USING (v)")
def m6(spark, sf):
    _, f = grid(spark)
    return M.renumbered(f.filter("face_id % 3 = 0"))


@query("M7_harmonic_uv")
def m7(spark, sf):
    v, f = grid(spark)
    rim = v.filter(f"x in (0, {N - 1}) or y in (0, {N - 1})").select("idx", (F.col("x") / (N - 1)).alias("u"), (F.col("y") / (N - 1)).alias("v"))
    return rounded(M.harmonic_uv(f, v, rim), 5)


@query("M8_wedge_uv", MESH + f", c AS (SELECT face_id, 0 AS corner, v0 AS v FROM faces UNION ALL SELECT face_id, 1, v1 FROM faces UNION ALL SELECT face_id, 2, v2 FROM faces) SELECT face_id, corner, round(x / {N - 1}, 6) AS u, round(y / {N - 1}, 6) AS v FROM c JOIN verts ON idx = c.v")
def m8(spark, sf):
    v, f = grid(spark)
    c = M.corners(f).withColumnRenamed("v", "idx").join(v, "idx")
    return rounded(c.select("face_id", "corner", (F.col("x") / (N - 1)).alias("u"), (F.col("y") / (N - 1)).alias("v")))


def raster(spark):
    """The grid in texture space, four pixels a cell; uv runs over the whole grid."""
    v, f = grid(spark)
    t = H.resolved(f, v)
    out = ["face_id"]
    for i in range(3):
        out += [(F.col(f"x{i}") * 4).alias(f"x{i}"), (F.col(f"y{i}") * 4).alias(f"y{i}"), (F.col(f"x{i}") / (N - 1)).alias(f"u{i}"), (F.col(f"y{i}") / (N - 1)).alias(f"v{i}")]
    return M.rasterised(t.select(*out))


@query("M9_rasterise_uv", f"SELECT CAST(c AS BIGINT) AS px, CAST(r AS BIGINT) AS py, round(c / {4.0 * (N - 1)}, 6) AS u, round(r / {4.0 * (N - 1)}, 6) AS v FROM range({4 * (N - 1) + 1}) a(c), range({4 * (N - 1) + 1}) b(r)")
def m9(spark, sf):
    return rounded(raster(spark).select("px", "py", "u", "v"))


@query("M10_texture_mask", f"SELECT CAST({(4 * (N - 1) + 1) ** 2} AS BIGINT) AS n_pixels")
def m10(spark, sf):
    return raster(spark).select("px", "py").distinct().agg(F.count("*").alias("n_pixels"))


@query("M11_fix_island_gaps", "WITH p AS (SELECT CAST(i // 40 AS BIGINT) AS row, CAST(i % 40 AS BIGINT) AS col, CAST((i * 7919 % 97) AS BIGINT) AS value FROM range(1600) t(i)) SELECT a.row, a.col, max(b.value) AS value FROM p a JOIN p b ON b.row BETWEEN a.row - 1 AND a.row + 2 AND b.col BETWEEN a.col - 1 AND a.col + 2 GROUP BY 1, 2")
def m11(spark, sf):
    from ..operators.imaging import dilate

    i = F.col("id")
    p = spark.range(1600).select(F.lit(0).alias("img"), F.floor(i / 40).cast("long").alias("row"), (i % 40).alias("col"), (i * 7919 % 97).alias("value"))
    return dilate(p, "value", 4, 4).select("row", "col", "value")


@query("M12_scatter_texture", f"WITH p AS (SELECT c AS px, r AS py, least(CAST(floor(c / {4.0 * (N - 1)} * 32) AS BIGINT), 31) AS tx, least(CAST(floor(r / {4.0 * (N - 1)} * 32) AS BIGINT), 31) AS ty, (c * 3 + r * 5) % 256 AS g FROM range({4 * (N - 1) + 1}) a(c), range({4 * (N - 1) + 1}) b(r)) SELECT tx, ty, arg_max(g, py * 1000 + px) AS g FROM p GROUP BY tx, ty")
def m12(spark, sf):
    side = 4.0 * (N - 1)
    p = raster(spark).select("px", "py", (F.col("px") / side).alias("u"), (F.col("py") / side).alias("v"), ((F.col("px") * 3 + F.col("py") * 5) % 256).alias("g"))
    return M.scattered(p, 32, 32, ["g"])


@query("M13_blend_decal", f"WITH t AS (SELECT c AS px, r AS py, CAST((c * 3 + r * 5) % 256 AS DOUBLE) AS g, least(CAST(floor(c / {4.0 * (N - 1)} * 32) AS BIGINT), 31) AS tx, least(CAST(floor(r / {4.0 * (N - 1)} * 16) AS BIGINT), 15) AS ty FROM range({4 * (N - 1) + 1}) a(c), range({4 * (N - 1) + 1}) b(r)), d AS (SELECT x AS tx, y AS ty, CAST((x * 11 + y * 7) % 256 AS DOUBLE) AS dg, (x * 13 + y * 29) % 256 AS alpha FROM range(32) a(x), range(16) b(y)) SELECT px, py, round(CASE WHEN alpha > 0 THEN dg * (alpha / 255.0) + g * (1 - alpha / 255.0) ELSE g END, 6) AS g FROM t JOIN d USING (tx, ty)")
def m13(spark, sf):
    side = 4.0 * (N - 1)
    px = raster(spark).select("px", "py")
    texture = px.select("px", "py", ((F.col("px") * 3 + F.col("py") * 5) % 256).cast("double").alias("g"))
    uv = px.select("px", "py", (F.col("px") / side).alias("u"), (F.col("py") / side).alias("v"))
    i = F.col("id")
    d = spark.range(32 * 16).select((i % 32).alias("tx"), F.floor(i / 32).cast("long").alias("ty"))
    d = d.select("tx", "ty", ((F.col("tx") * 11 + F.col("ty") * 7) % 256).cast("double").alias("g"), ((F.col("tx") * 13 + F.col("ty") * 29) % 256).alias("alpha"))
    return rounded(M.blended(texture, uv, d, 32, 16, ["g"]))


@query("M14_preprocess_decal")
def m14(spark, sf):
    """Blur, resize to 24x16 and flip upside down."""
    from ..operators.imaging import gaussian, per_image, resize_array

    i = F.col("id")
    p = spark.range(48 * 32).select(F.lit(0).alias("img"), F.floor(i / 48).cast("long").alias("row"), (i % 48).alias("col"), (i * 7919 % 251).cast("double").alias("value"))
    return rounded(per_image(gaussian(p, "value", 5, 1.0), lambda a: resize_array(a, 16, 24)[::-1]), 4)


@query("M15_paint_decal")
def m15(spark, sf):
    """The whole way: fill inside the fence, harmonic uv of the square, rasterise, blend with the texture."""
    v, f = grid(spark)
    inside = M.saved(f.join(M.flood(M.face_adjacency(f, fence(f)), M.seed_faces(f, v, (11.2, 11.3, 0.0))), "face_id", "left_semi"))
    used = M.saved(v.join(M.corners(inside).select(F.col("v").alias("idx")).distinct(), "idx", "left_semi"))
    rim = used.filter("x in (5, 17) or y in (5, 17)").select("idx", ((F.col("x") - 5) / 12).alias("u"), ((F.col("y") - 5) / 12).alias("v"))
    uv = M.harmonic_uv(inside, used, rim)
    t = H.resolved(inside, used)
    for i in range(3):
        t = t.join(uv.select(F.col("idx").alias(f"v{i}"), F.col("u").alias(f"u{i}"), F.col("v").alias(f"w{i}")), f"v{i}")
    cols = ["face_id"]
    for i in range(3):
        cols += [(F.col(f"x{i}") * 4).alias(f"x{i}"), (F.col(f"y{i}") * 4).alias(f"y{i}"), F.col(f"u{i}"), F.col(f"w{i}").alias(f"v{i}")]
    px = M.rasterised(t.select(*cols))
    texture = px.select("px", "py", ((F.col("px") * 3 + F.col("py") * 5) % 256).cast("double").alias("g"))
    i = F.col("id")
    decal = spark.range(256).select((i % 16).alias("tx"), F.floor(i / 16).cast("long").alias("ty"), (i % 256).cast("double").alias("g"), F.lit(128).alias("alpha"))
    return rounded(M.blended(texture, px, decal, 16, 16, ["g"]), 3)


@query("M16_validated_inputs", "SELECT false AS mesh_missing, true AS decal_missing")
def m16(spark, sf):
    from ..operators.decal import Decal

    v, f = grid(spark)
    d = Decal(vertices=v, faces=f)
    missing = d.missing()
    return spark.createDataFrame([("mesh" in missing, "decal" in missing)], "mesh_missing boolean, decal_missing boolean")


@query("W2_uv_boundary_square", "WITH s AS (SELECT CAST(i AS BIGINT) AS pos, i // 10 AS side, (i % 10) / 10.0 AS t FROM range(40) r(i)) SELECT pos, round(CASE side WHEN 0 THEN -1 + 2 * t WHEN 1 THEN 1 WHEN 2 THEN 1 - 2 * t ELSE -1 END, 6) AS u, round(CASE side WHEN 0 THEN -1 WHEN 1 THEN -1 + 2 * t WHEN 2 THEN 1 ELSE 1 - 2 * t END, 6) AS v FROM s")
def w2b(spark, sf):
    """A closed path of four sides, spread over the square [-1, 1]^2 by arc length."""
    from ..operators.decal import square_uv

    i = F.col("id")
    side = F.floor(i / 10).cast("long")
    t = (i % 10).cast("double")
    x = F.when(side == 0, t).when(side == 1, 10.0).when(side == 2, 10 - t).otherwise(0.0)
    y = F.when(side == 0, 0.0).when(side == 1, t).when(side == 2, 10.0).otherwise(10 - t)
    p = spark.range(40).select(i.alias("pos"), side.alias("side"), x.alias("x"), y.alias("y"), F.lit(0.0).alias("z"))
    return rounded(square_uv(p).select("pos", "u", "v"))
