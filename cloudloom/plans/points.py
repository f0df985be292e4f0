"""Queries on single clouds: projections, filters, aggregates, windows, top-k, set operations, scalar functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import cloud as C
from ..operators import search, sampling
from ..types import RECORDS, common_fields, fields, record
from .registry import big, cloud, keyed, normals, query, rounded, table

LOW, HIGH = (-0.1, -0.1, -0.1), (0.1, 0.1, 0.1)


# projections
@query("P1_copy_cloud", "SELECT idx, x, y, z FROM cloud", "cloud")
def p1(spark, sf):
    return C.copy_fields(cloud(spark, sf), ["idx", *fields(record("PointXYZ"))])


@query("P2_copy_common_fields", "SELECT x, y, z, label FROM cloud", "cloud")
def p2(spark, sf):
    return C.copy_fields(cloud(spark, sf), common_fields(record("PointXYZRGBL"), cloud(spark, sf).schema))


@query("P3_gather_indices", "SELECT 2 * c.idx + k AS pos, c.idx, x, y, z, label FROM cloud c, (VALUES (0), (1)) v(k)", "cloud")
def p3(spark, sf):
    c = cloud(spark, sf)
    wanted = c.select("idx", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).select((F.col("idx") * 2 + F.col("k")).alias("pos"), "idx")
    return C.gather(c, wanted)


PAD_SQL = """
WITH g AS (SELECT CAST(r AS BIGINT) AS row, CAST(c AS BIGINT) AS col FROM range(16) a(r), range(26) b(c)),
s AS (SELECT row, col, {r} AS sr, {c} AS sc FROM g)
SELECT row, col, {v} AS value FROM s
"""


def _pad(mode, fill=None):
    def run(spark, sf):
        img = spark.range(10 * 20).select(F.floor(F.col("id") / 20).cast("long").alias("row"), F.pmod("id", F.lit(20)).cast("long").alias("col"), F.col("id").cast("double").alias("value"))
        return C.padded(img, 10, 20, 3, 3, 3, 3, mode, ["value"], fill)

    return run


_VALUE = "CAST(sr * 20 + sc AS DOUBLE)"
query("P4_pad_constant", PAD_SQL.format(r="row - 3", c="col - 3", v=f"CASE WHEN sr BETWEEN 0 AND 9 AND sc BETWEEN 0 AND 19 THEN {_VALUE} ELSE -1.0 END"))(_pad("constant", -1.0))
query("P4_pad_replicate", PAD_SQL.format(r="least(greatest(row - 3, 0), 9)", c="least(greatest(col - 3, 0), 19)", v=_VALUE))(_pad("replicate"))
query("P4_pad_reflect", PAD_SQL.format(r="CASE WHEN row < 3 THEN 2 - row WHEN row > 12 THEN 22 - row ELSE row - 3 END", c="CASE WHEN col < 3 THEN 2 - col WHEN col > 22 THEN 42 - col ELSE col - 3 END", v=_VALUE))(_pad("reflect"))
query("P4_pad_reflect_101", PAD_SQL.format(r="CASE WHEN row < 3 THEN 3 - row WHEN row > 12 THEN 21 - row ELSE row - 3 END", c="CASE WHEN col < 3 THEN 3 - col WHEN col > 22 THEN 41 - col ELSE col - 3 END", v=_VALUE))(_pad("reflect_101"))
query("P4_pad_wrap", PAD_SQL.format(r="(row + 7) % 10", c="(col + 17) % 20", v=_VALUE))(_pad("wrap"))


@query("P5_field_lists", "SELECT * FROM (VALUES ('PointXYZ', 3), ('PointNormal', 7), ('Narf36', 7), ('PointSurfel', 10)) t(record, n_fields)")
def p5(spark, sf):
    rows = [(n, len(fields(record(n)))) for n in RECORDS if n in ("PointXYZ", "PointNormal", "Narf36", "PointSurfel")]
    return spark.createDataFrame(rows, "record string, n_fields int")


@query("P6_concatenate_fields", "SELECT idx, x, y, z, label, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz FROM cloud JOIN normals USING (idx)", "cloud normals")
def p6(spark, sf):
    return rounded(C.zip_columns(cloud(spark, sf), normals(spark, sf)), 6, "nx", "ny", "nz")


@query("P7_point_at_pixel", "SELECT idx, x, y, z, label FROM cloud WHERE idx = 3 * 25 + 7", "cloud")
def p7(spark, sf):
    return C.at_pixel(cloud(spark, sf), 25, 3, 7)


@query("P8_column_view", "SELECT idx, round(v[1], 6) AS v0, round(v[2], 6) AS v1 FROM (SELECT idx, [x, z] AS v FROM cloud)", "cloud")
def p8(spark, sf):
    c = cloud(spark, sf).select("idx", C.vector(["x", "z"]).alias("v"))
    return rounded(c.select("idx", F.col("v")[0].alias("v0"), F.col("v")[1].alias("v1")))


@query("P9_weighted_representation", "SELECT idx, round(2 * x, 6) AS a, round(0.5 * y, 6) AS b, round(z, 6) AS c FROM cloud", "cloud")
def p9(spark, sf):
    c = cloud(spark, sf).select("idx", C.vector(["x", "y", "z"], [2.0, 0.5, 1.0]).alias("v"))
    return rounded(c.select("idx", *(F.col("v")[i].alias(n) for i, n in enumerate("abc"))))


@query("P10_erase_and_append", "SELECT row_number() OVER (ORDER BY y, idx) - 1 AS idx, x, y, z FROM (SELECT idx, x, y, z FROM cloud WHERE x >= 0 UNION ALL SELECT -1, 9.0, 9.0, 9.0)", "cloud")
def p10(spark, sf):
    kept = cloud(spark, sf).filter("x >= 0").select(F.col("idx").alias("old"), "x", "y", "z")
    more = spark.createDataFrame([(-1, 9.0, 9.0, 9.0)], "old long, x double, y double, z double")
    return C.reindexed(kept.unionByName(more), ["y", "old"]).select("idx", "x", "y", "z")


# filters
MESSY = "SELECT idx, CASE WHEN idx % 7 = 0 THEN CAST('NaN' AS DOUBLE) WHEN idx % 11 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE x END AS x, y, z FROM cloud"


def messy(spark, sf):
    x = F.when(F.col("idx") % 7 == 0, float("nan")).when(F.col("idx") % 11 == 0, float("inf")).otherwise(F.col("x"))
    return cloud(spark, sf).select("idx", x.alias("x"), "y", "z")


@query("F1_is_finite", "SELECT idx, NOT (idx % 7 = 0 OR idx % 11 = 0) AS finite FROM cloud", "cloud")
def f1(spark, sf):
    return messy(spark, sf).select("idx", G.finite("x", "y", "z").alias("finite"))


@query("F2_remove_nan_points", "SELECT idx, x, y, z FROM cloud WHERE idx % 7 <> 0 AND idx % 11 <> 0", "cloud")
def f2(spark, sf):
    return C.drop_non_finite(messy(spark, sf))


@query("F3_remove_nan_normals", "SELECT idx, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz FROM normals WHERE nx > 0", "normals")
def f3(spark, sf):
    n = normals(spark, sf).withColumn("nx", F.when(F.col("nx") > 0, F.col("nx")).otherwise(float("nan")))
    return rounded(C.drop_non_finite(n, ("nx", "ny", "nz")))


@query("F4_points_in_box", "SELECT idx, x, y, z FROM cloud WHERE x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.1 AND 0.1 AND z BETWEEN -0.1 AND 0.1", "cloud")
def f4(spark, sf):
    return C.in_box(cloud(spark, sf), LOW, HIGH).select("idx", "x", "y", "z")


@query("F5_box_search_large", "SELECT count(*) AS n, round(sum(y), 4) AS sy FROM big WHERE x BETWEEN 10 AND 30 AND y BETWEEN 5 AND 50 AND z BETWEEN 2 AND 8", "big")
def f5(spark, sf):
    b = C.in_box(big(spark, sf), (10.0, 5.0, 2.0), (30.0, 50.0, 8.0))
    return b.agg(F.count("*").alias("n"), F.round(F.sum("y"), 4).alias("sy"))


@query("F6_index_window", "SELECT idx, x, y, z, label, idx // 25 AS row, idx % 25 AS col FROM cloud WHERE idx // 25 BETWEEN 2 AND 9 AND idx % 25 BETWEEN 5 AND 14", "cloud")
def f6(spark, sf):
    return C.organized(cloud(spark, sf), 25).filter("row between 2 and 9 and col between 5 and 14")


@query("F7_removed_indices", "SELECT idx FROM cloud WHERE NOT (x BETWEEN -0.1 AND 0.1 AND y BETWEEN -0.1 AND 0.1 AND z BETWEEN -0.1 AND 0.1)", "cloud")
def f7(spark, sf):
    c = cloud(spark, sf)
    return C.removed(c, C.in_box(c, LOW, HIGH)).select("idx")


@query("F8_half_open_box", "SELECT idx, x >= -0.1 AND x < 0.1 AND y >= -0.1 AND y < 0.1 AND z >= -0.1 AND z < 0.1 AS inside FROM cloud", "cloud")
def f8(spark, sf):
    return cloud(spark, sf).select("idx", C.within_half_open(LOW, HIGH).alias("inside"))


@query("F11_mid_plane_slab", "WITH b AS (SELECT CASE WHEN ex <= ey AND ex <= ez THEN 0 WHEN ey <= ez THEN 1 ELSE 2 END AS axis, mx, my, mz FROM (SELECT max(x) - min(x) AS ex, max(y) - min(y) AS ey, max(z) - min(z) AS ez, (max(x) + min(x)) / 2 AS mx, (max(y) + min(y)) / 2 AS my, (max(z) + min(z)) / 2 AS mz FROM cloud)) SELECT idx FROM cloud, b WHERE abs(CASE axis WHEN 0 THEN x - mx WHEN 1 THEN y - my ELSE z - mz END) < 0.05", "cloud")
def f11(spark, sf):
    c = cloud(spark, sf)
    b = F.broadcast(C.bounds(c))  # one row
    axis = G.thinnest_axis(*(F.col("max_" + a) - F.col("min_" + a) for a in "xyz"))
    off = [F.col(a) - (F.col("max_" + a) + F.col("min_" + a)) / 2 for a in "xyz"]
    return c.join(b).filter(F.abs(F.when(axis == 0, off[0]).when(axis == 1, off[1]).otherwise(off[2])) < 0.05).select("idx")


@query("F12_voxel_straddles_plane", "SELECT kx, ky, kz FROM (SELECT DISTINCT kx, ky, kz FROM keys) WHERE kz * 0.1 - 1.6 < 0.03 AND (kz + 1) * 0.1 - 1.6 > 0.03", "keys")
def f12(spark, sf):
    from ..operators import octree

    from .registry import ORIGIN, RES

    v = octree.indexed(cloud(spark, sf), ORIGIN, RES).select("kx", "ky", "kz").distinct()
    return v.filter((F.col("kz") * RES + ORIGIN[2] < 0.03) & ((F.col("kz") + 1) * RES + ORIGIN[2] > 0.03))


@query("F13_valid_vectors", "SELECT vec_id AS idx, true AS valid FROM embeddings")
def f13(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("idx"), F.forall("embedding", lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))).alias("valid"))


@query("F14_mask_algebra", "SELECT idx, x > 0 AND y > 0 AS both, x > 0 OR y > 0 AS either, NOT (x > 0) AS inverse FROM cloud", "cloud")
def f14(spark, sf):
    a, b = F.col("x") > 0, F.col("y") > 0
    return cloud(spark, sf).select("idx", (a & b).alias("both"), (a | b).alias("either"), (~a).alias("inverse"))


@query("F15_rejected_queries", "SELECT idx FROM cloud WHERE x * x + y * y + z * z > 0.04", "cloud")
def f15(spark, sf):
    c = cloud(spark, sf)
    kept = c.filter(G.dot(G.points(), G.points()) <= 0.04)
    return c.select("idx").join(kept.select("idx"), "idx", "left_anti")


# aggregates
@query("A1_bounding_box", "SELECT min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM big", "big")
def a1(spark, sf):
    return C.bounds(big(spark, sf))


@query("A2_centroid", "SELECT count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM big", "big")
def a2(spark, sf):
    return rounded(C.centroid(big(spark, sf)))


_SUMS = ", ".join(f"round({{f}}(({p} - {{a}}) * ({q} - {{b}})), {{d}}) AS s{p}{q}" for p, q in C.PAIRS)


def _scatter_sql(f, about, digits, view):
    cols = ", ".join(f"round({f}(({p} - {about['xyz'.index(p)]}) * ({q} - {about['xyz'.index(q)]})), {digits}) AS s{p}{q}" for p, q in C.PAIRS)
    return f"SELECT count(*) AS n, {cols} FROM {view}"


@query("A3_scatter_about_point", _scatter_sql("sum", (0.1, 0.2, 0.3), 6, "cloud"), "cloud")
def a3(spark, sf):
    return rounded(C.scatter(cloud(spark, sf), (0.1, 0.2, 0.3)))


@query("A4_covariance_normalised", _scatter_sql("avg", (0.1, 0.2, 0.3), 6, "cloud"), "cloud")
def a4(spark, sf):
    return rounded(C.scatter(cloud(spark, sf), (0.1, 0.2, 0.3), normalised=True))


@query("A5_moments_about_origin", _scatter_sql("avg", (0, 0, 0), 4, "big"), "big")
def a5(spark, sf):
    return rounded(C.scatter(big(spark, sf)), 4)


@query("A6_mean_and_covariance", "SELECT count(*) AS n, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz, " + ", ".join(f"round(covar_pop({p}, {q}), 6) AS s{p}{q}" for p, q in C.PAIRS) + " FROM cloud", "cloud")
def a6(spark, sf):
    return rounded(C.covariance(cloud(spark, sf)))


@query("A7_nd_centroid", "SELECT i, round(avg(v), 6) AS mean FROM (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) GROUP BY i")
def a7(spark, sf):
    e = table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("i", "v"))
    return e.groupBy(F.col("i").cast("long").alias("i")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query("A8_typed_accumulators", "SELECT label, count(*) AS n, round(avg(x), 6) AS x, round(sum(nx) / sqrt(sum(nx) * sum(nx) + sum(ny) * sum(ny) + sum(nz) * sum(nz)), 6) AS nx, CAST(floor(avg(idx % 256)) AS BIGINT) AS red FROM cloud JOIN normals USING (idx) GROUP BY label", "cloud normals")
def a8(spark, sf):
    c = C.zip_columns(cloud(spark, sf), normals(spark, sf))
    sums = [F.sum(n) for n in ("nx", "ny", "nz")]
    return rounded(c.groupBy("label").agg(F.count("*").alias("n"), F.avg("x").alias("x"), (sums[0] / G.norm(sums)).alias("nx"), F.floor(F.avg(F.col("idx") % 256)).cast("long").alias("red")))


@query("A8_majority_label", "SELECT kx, label, n FROM (SELECT *, row_number() OVER (PARTITION BY kx ORDER BY n DESC, label) AS r FROM (SELECT kx, label, count(*) AS n FROM keys GROUP BY kx, label)) WHERE r = 1", "keys")
def a8b(spark, sf):
    from ..operators import octree

    from .registry import ORIGIN, RES

    return C.majority(octree.indexed(cloud(spark, sf), ORIGIN, RES), ["kx"], "label")


@query("A21_farthest_point", "SELECT idx, x, y, z, round(d2, 6) AS d2 FROM (SELECT *, (x - 0.1) * (x - 0.1) + (y - 0.1) * (y - 0.1) + (z - 0.1) * (z - 0.1) AS d2 FROM cloud) ORDER BY d2 DESC, idx LIMIT 1", "cloud")
def a21(spark, sf):
    return rounded(C.farthest(cloud(spark, sf), (0.1, 0.1, 0.1)), 6, "d2")


@query("A22_mean_stddev", "SELECT round(avg(l_extendedprice), 4) AS mean, round(stddev_samp(l_extendedprice), 4) AS stddev FROM lineitem")
def a22(spark, sf):
    return table(spark, sf, "lineitem").agg(F.round(F.avg("l_extendedprice"), 4).alias("mean"), F.round(F.stddev_samp("l_extendedprice"), 4).alias("stddev"))


@query("A23_histogram_range", "SELECT vec_id AS idx, list_min(embedding) AS low, list_max(embedding) AS high FROM embeddings")
def a23(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), F.array_min("embedding").alias("low"), F.array_max("embedding").alias("high"))


NGONS = "SELECT n AS poly, i AS idx, cos(2 * pi() * i / n) AS x, sin(2 * pi() * i / n) AS y, 0.0 AS z FROM (SELECT CAST(n AS BIGINT) AS n, unnest(range(n)) AS i FROM range(3, 40) t(n))"


def ngons(spark):
    p = spark.range(3, 40).select(F.col("id").alias("poly"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("id") - 1)).alias("idx"))
    a = 2 * F.pi() * F.col("idx") / F.col("poly")
    return p.select("poly", "idx", F.cos(a).alias("x"), F.sin(a).alias("y"), F.lit(0.0).alias("z"))


@query("A24_polygon_area", "SELECT CAST(n AS BIGINT) AS poly, round(n / 2.0 * sin(2 * pi() / n), 6) AS area FROM range(3, 40) t(n)")
def a24(spark, sf):
    return rounded(C.polygon_area(ngons(spark), ["poly"]))


@query("A31_brightness_multiplier", "SELECT round(2 * avg(l_quantity) / 255, 6) AS multiplier FROM lineitem")
def a31(spark, sf):
    return table(spark, sf, "lineitem").agg(F.round(2 * F.avg("l_quantity") / 255, 6).alias("multiplier"))


@query("A32_grid_average", "SELECT CAST(floor(x / 6) AS BIGINT) AS kx, CAST(floor(y / 6) AS BIGINT) AS ky, CAST(floor(z / 6) AS BIGINT) AS kz, round(avg(x) * count(*), 5) AS sum_x, round(avg(y) * count(*), 5) AS sum_y, round(avg(z) * count(*), 5) AS sum_z, count(*) AS n FROM big GROUP BY 1, 2, 3", "big")
def a32(spark, sf):
    """Averages times counts: sums of decimals have no rounding ties."""
    v = sampling.average(big(spark, sf).select("*", *G.keys((0.0, 0.0, 0.0), 6.0)))
    return rounded(v.select("kx", "ky", "kz", *((F.col(a) * F.col("n")).alias("sum_" + a) for a in "xyz"), "n"), 5)


# windows
@query("W1_weight_cdf", "SELECT idx, round(coalesce(sum(w) OVER (PARTITION BY label ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS cdf FROM (SELECT idx, label, abs(x) AS w FROM cloud)", "cloud")
def w1(spark, sf):
    w = Window.partitionBy("label").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return rounded(cloud(spark, sf).select("idx", F.coalesce(F.sum(F.abs("x")).over(w), F.lit(0.0)).alias("cdf")))


_ARC = "WITH d AS (SELECT label, idx, coalesce(sqrt((x - px) * (x - px) + (y - py) * (y - py) + (z - pz) * (z - pz)), 0) AS d FROM (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(z) OVER w AS pz FROM cloud WINDOW w AS (PARTITION BY label ORDER BY idx))), s AS (SELECT label, idx, sum(d) OVER (PARTITION BY label ORDER BY idx) AS s, sum(d) OVER (PARTITION BY label) AS total FROM d) "


@query("W2_arc_length_uv", _ARC + "SELECT label, idx, round(s / total, 6) AS u FROM s", "cloud")
def w2(spark, sf):
    a = C.arc_length(cloud(spark, sf), ["label"])
    return rounded(a.select("label", "idx", (F.col("s") / F.col("total")).alias("u")))


@query("W3_path_length", _ARC + "SELECT label, round(max(s), 6) AS length FROM s GROUP BY label", "cloud")
def w3(spark, sf):
    return rounded(C.arc_length(cloud(spark, sf), ["label"]).groupBy("label").agg(F.max("s").alias("length")))


@query("W4_contour_perimeter", "SELECT CAST(n AS BIGINT) AS poly, round(2 * n * sin(pi() / n), 6) AS perimeter FROM range(3, 40) t(n)")
def w4(spark, sf):
    return rounded(C.perimeter(ngons(spark), ["poly"]))


@query("W5_dense_numbers", "SELECT idx, sum(CASE WHEN x > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY label ORDER BY idx)::BIGINT AS no FROM cloud", "cloud")
def w5(spark, sf):
    w = Window.partitionBy("label").orderBy("idx")
    return cloud(spark, sf).select("idx", F.sum((F.col("x") > 0).cast("long")).over(w).alias("no"))


@query("W6_drop_consecutive_repeats", "SELECT user_id, event_id FROM (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS DISTINCT FROM event_type")
def w6(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, sf, "events").withColumn("p", F.lag("event_type").over(w))
    return e.filter(~F.col("p").eqNullSafe(F.col("event_type"))).select("user_id", "event_id")


@query("W7_normalised_weights", "SELECT idx, round(abs(x) / sum(abs(x)) OVER (), 9) AS w FROM cloud", "cloud")
def w7(spark, sf):
    c = cloud(spark, sf)
    total = F.broadcast(c.agg(F.sum(F.abs("x")).alias("total")))  # one row
    return c.join(total).select("idx", F.round(F.abs("x") / F.col("total"), 9).alias("w"))


@query("W8_min_max_rescale", "SELECT idx, round((x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w), 6) AS x FROM cloud WINDOW w AS (PARTITION BY label)", "cloud")
def w8(spark, sf):
    from ..operators.imaging import rescaled

    return rounded(rescaled(cloud(spark, sf), "x", ["label"]).select("idx", "x"))


@query("W9_angular_order", "SELECT label, idx, row_number() OVER (PARTITION BY label ORDER BY atan2(y - cy, x - cx) + pi() DESC, idx) AS pos FROM (SELECT *, avg(x) OVER (PARTITION BY label) AS cx, avg(y) OVER (PARTITION BY label) AS cy FROM cloud)", "cloud")
def w9(spark, sf):
    w = Window.partitionBy("label")
    c = cloud(spark, sf).withColumns({"cx": F.avg("x").over(w), "cy": F.avg("y").over(w)})
    a = F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")) + F.pi()
    return c.select("label", "idx", F.row_number().over(w.orderBy(F.desc(a), "idx")).cast("long").alias("pos"))


# top-k and sampling
@query("T1_sort_by_distance", "SELECT idx, row_number() OVER (ORDER BY round(x * x + y * y + z * z, 9), idx) AS pos FROM cloud", "cloud")
def t1(spark, sf):
    """The position of every row, by range partitions and their offsets."""
    d = cloud(spark, sf).select(F.col("idx").alias("point"), F.round(G.dot(G.points(), G.points()), 9).alias("d"))
    return C.reindexed(d, ["d", "point"]).select(F.col("point").alias("idx"), (F.col("idx") + 1).alias("pos"))


@query("T2_largest_weights", "SELECT o_orderkey AS idx, o_totalprice AS w FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
def t2(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("idx"), F.col("o_totalprice").alias("w")).orderBy(F.desc("w"), "idx").limit(50)


_WEIGHTS = "WITH pr AS (SELECT a.idx AS q, b.idx, b.x, b.y, b.z, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) AS d2 FROM cloud a, cloud b WHERE a.idx <> b.idx), m AS (SELECT q, sum(exp(-d2 / 0.01) * x) / sum(exp(-d2 / 0.01)) AS mx, sum(exp(-d2 / 0.01) * y) / sum(exp(-d2 / 0.01)) AS my, sum(exp(-d2 / 0.01) * z) / sum(exp(-d2 / 0.01)) AS mz FROM pr WHERE d2 <= 0.05 * 0.05 GROUP BY q) SELECT c.idx, round(coalesce((mx - x) * (mx - x) + (my - y) * (my - y) + (mz - z) * (mz - z), 0), 9) AS weight FROM cloud c LEFT JOIN m ON m.q = c.idx"


@query("T3_neighbour_weights", _WEIGHTS, "cloud")
def t3(spark, sf):
    c = cloud(spark, sf)
    pairs = search.within(c, c.select(F.col("idx").alias("qidx"), "x", "y", "z"), 0.05).filter("qidx <> idx")
    return rounded(sampling.neighbour_weights(c, pairs, 0.1), 9)


@query("T3_weight_sampling_k", "WITH pr AS (SELECT a.idx AS q, b.idx, b.x, b.y, b.z, (b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z) AS d2 FROM cloud a, cloud b), k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY d2, idx) AS r FROM pr), m AS (SELECT q, sum(exp(-d2 / 2.25) * x) / sum(exp(-d2 / 2.25)) AS mx, sum(exp(-d2 / 2.25) * y) / sum(exp(-d2 / 2.25)) AS my, sum(exp(-d2 / 2.25) * z) / sum(exp(-d2 / 2.25)) AS mz FROM k WHERE r <= 10 AND q <> idx GROUP BY q), w AS (SELECT c.idx, (mx - x) * (mx - x) + (my - y) * (my - y) + (mz - z) * (mz - z) AS w FROM cloud c JOIN m ON m.q = c.idx) SELECT idx, round(w, 9) AS weight FROM (SELECT *, row_number() OVER (ORDER BY w DESC, idx) AS r FROM w) WHERE r <= CAST(floor(0.4 * (SELECT count(*) FROM cloud)) AS BIGINT)", "cloud")
def t3k(spark, sf):
    return rounded(sampling.weight_sampling_k(cloud(spark, sf), 0.4, 10, 1.5).select("idx", "weight"), 9)


def draws_sql(weight: str, n: int, seed: int) -> str:
    return (
        f"WITH w AS (SELECT idx, {weight} AS weight FROM cloud), c AS (SELECT idx, coalesce(sum(weight) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM w), "
        f"d AS (SELECT i AS draw, CAST('0x' || substr(md5('{seed}:' || i), 1, 13) AS BIGINT) / 4503599627370496.0 * (SELECT sum(weight) FROM w) AS u FROM range({n}) t(i)) "
        "SELECT draw, idx FROM d ASOF JOIN c ON d.u >= c.lo"
    )


@query("T4_random_distribution", draws_sql("abs(x)", 1000, 17), "cloud")
def t4(spark, sf):
    c = cloud(spark, sf).select("idx", F.abs("x").alias("weight"))
    return sampling.random_draws(c, 1000, 17)


@query("T5_normal_distribution", draws_sql("exp(-(x * x + y * y + z * z) / 0.02)", 1000, 23), "cloud")
def t5(spark, sf):
    """Draws whose weight is a Gaussian of the distance from the mean; bins keep to their points."""
    c = cloud(spark, sf).select("idx", F.exp(-G.dot(G.points(), G.points()) / 0.02).alias("weight"))
    return sampling.random_draws(c, 1000, 23)


@query("T6_resample_gather", "SELECT -idx AS pos, idx, x, y, z, label FROM cloud", "cloud")
def t6(spark, sf):
    c = cloud(spark, sf)
    return C.gather(c, c.select((-F.col("idx")).alias("pos"), "idx"))


@query("T7_better_correspondence", "SELECT kx, min(abs(x)) AS distance, arg_min(idx, (abs(x), idx)) AS idx FROM keys GROUP BY kx", "keys")
def t7(spark, sf):
    from ..operators import octree

    from .registry import ORIGIN, RES

    k = octree.indexed(cloud(spark, sf), ORIGIN, RES)
    return k.groupBy("kx").agg(F.min(F.abs("x")).alias("distance"), F.min_by("idx", F.struct(F.abs("x"), F.col("idx"))).alias("idx"))


@query("T8_largest_polygon", "SELECT 39 AS poly, round(39 / 2.0 * sin(2 * pi() / 39), 6) AS area")
def t8(spark, sf):
    a = C.polygon_area(ngons(spark), ["poly"])
    return rounded(a.agg(F.max_by(F.struct("poly", "area"), "area").alias("m")).select(F.col("m.poly").cast("int").alias("poly"), "m.area"))


# set operations
@query("X1_union", "SELECT idx, x, y, z, label FROM cloud UNION ALL SELECT idx + 100000, -x, y, z, label FROM cloud", "cloud")
def x1(spark, sf):
    c = cloud(spark, sf)
    return c.unionAll(c.select((F.col("idx") + 100000).alias("idx"), (-F.col("x")).alias("x"), "y", "z", "label"))


@query("X2_concatenate_blobs", "SELECT idx, x, y, z FROM cloud UNION ALL SELECT idx, x, y, z FROM cloud", "cloud")
def x2(spark, sf):
    c = cloud(spark, sf).select("idx", "x", "y", "z")
    return C.concatenated(c.withColumn("_pad", F.lit(0)), c.select("z", "y", "x", "idx"))


@query("X5_append_grid", "WITH a AS (SELECT floor(x * 20) AS i, floor(y * 20) AS j, avg(z) AS v FROM cloud WHERE label < 5 GROUP BY 1, 2), b AS (SELECT floor(x * 20) AS i, floor(y * 20) AS j, avg(z) AS v FROM cloud WHERE label >= 5 GROUP BY 1, 2) SELECT CAST(coalesce(a.i, b.i) AS BIGINT) AS i, CAST(coalesce(a.j, b.j) AS BIGINT) AS j, round(coalesce((a.v + b.v) / 2, a.v, b.v), 6) AS v FROM a FULL JOIN b ON a.i = b.i AND a.j = b.j", "cloud")
def x5(spark, sf):
    grid = lambda c: c.groupBy(F.floor(F.col("x") * 20).cast("long").alias("i"), F.floor(F.col("y") * 20).cast("long").alias("j")).agg(F.avg("z").alias("v"))
    c = cloud(spark, sf)
    return rounded(C.appended_grid(grid(c.filter("label < 5")), grid(c.filter("label >= 5")), ["i", "j"], ["v"], True))


@query("X6_mask_sets", "SELECT idx FROM cloud WHERE x > 0 INTERSECT SELECT idx FROM cloud WHERE y > 0", "cloud")
def x6(spark, sf):
    c = cloud(spark, sf)
    return c.filter("x > 0").select("idx").intersect(c.filter("y > 0").select("idx"))


# scalar functions
def _pairs(spark, sf):
    return C.zip_columns(cloud(spark, sf), normals(spark, sf))


P_, N_ = "x * nx + y * ny + z * nz", "sqrt(x * x + y * y + z * z) * sqrt(nx * nx + ny * ny + nz * nz)"


@query("C1_squared_distance", "SELECT idx, round((x - nx) * (x - nx) + (y - ny) * (y - ny) + (z - nz) * (z - nz), 6) AS d2 FROM cloud JOIN normals USING (idx)", "cloud normals")
def c1(spark, sf):
    return rounded(_pairs(spark, sf).select("idx", G.sq_dist(G.points(), G.points("n")).alias("d2")))


@query("C2_angle", f"SELECT idx, round(degrees(acos(least(greatest(({P_}) / ({N_}), -1), 1))), 6) AS angle FROM cloud JOIN normals USING (idx)", "cloud normals")
def c2(spark, sf):
    return rounded(_pairs(spark, sf).select("idx", G.angle(G.points(), G.points("n"), True).alias("angle")))


@query("C3_circumradius", "SELECT idx, round(a * b * c / (4 * sqrt(s * (s - a) * (s - b) * (s - c))), 5) AS r FROM (SELECT *, (a + b + c) / 2 AS s FROM (SELECT idx, 3 + x AS a, 4 + y AS b, 5 + z AS c FROM cloud))", "cloud")
def c3(spark, sf):
    return rounded(cloud(spark, sf).select("idx", G.circumradius(3 + F.col("x"), 4 + F.col("y"), 5 + F.col("z")).alias("r")), 5)


@query("C6_voxel_side_and_diameter", "SELECT CAST(d AS BIGINT) AS level, round(pow(0.1 * pow(2, 5 - d), 2), 6) AS side_sq, round(3 * pow(0.1 * pow(2, 5 - d), 2), 6) AS diameter_sq FROM range(6) t(d)")
def c6(spark, sf):
    side = F.pow(F.lit(2.0), 5 - F.col("id")) * 0.1
    return rounded(spark.range(6).select(F.col("id").alias("level"), (side * side).alias("side_sq"), (3 * side * side).alias("diameter_sq")))


M = G.euler_matrix(1.0, -2.0, 0.5, 0.3, -0.2, 0.7)


def _mul(v, row, t=True):
    return " + ".join(f"{a} * ({c!r})" for a, c in zip(v, row, strict=False)) + (f" + ({row[3]!r})" if t else "")


@query("C8_transform_with_normals", "SELECT idx, " + ", ".join(f"round({_mul('xyz', M[i])}, 6) AS {a}, round({_mul(('nx', 'ny', 'nz'), M[i], False)}, 6) AS n{a}" for i, a in enumerate("xyz")) + " FROM cloud JOIN normals USING (idx)", "cloud normals")
def c8(spark, sf):
    p, n = G.affine(G.points(), M), G.rotate(G.points("n"), M)
    return rounded(_pairs(spark, sf).select("idx", *(v.alias(a) for a, v in zip("xyz", p, strict=True)), *(v.alias("n" + a) for a, v in zip("xyz", n, strict=True))))


@query("C9_demean", "SELECT idx, round(x - (SELECT avg(x) FROM cloud), 6) AS x, round(y - (SELECT avg(y) FROM cloud), 6) AS y, round(z - (SELECT avg(z) FROM cloud), 6) AS z FROM cloud", "cloud")
def c9(spark, sf):
    c = cloud(spark, sf)
    return rounded(c.join(F.broadcast(C.centroid(c))).select("idx", *((F.col(a) - F.col("c" + a)).alias(a) for a in "xyz")))  # one row


@query("C10_principal_transformation")
def c10(spark, sf):
    return rounded(C.principal_axes(cloud(spark, sf), ["label"]))


@query("C11_eigenvalue_invariants", "SELECT label, round(sxx + syy + szz, 6) AS trace, round(sxx * (syy * szz - syz * syz) - sxy * (sxy * szz - syz * sxz) + sxz * (sxy * syz - syy * sxz), 9) AS det FROM (SELECT label, " + ", ".join(f"covar_pop({p}, {q}) AS s{p}{q}" for p, q in C.PAIRS) + " FROM cloud GROUP BY label)", "cloud")
def c11(spark, sf):
    """Sum and product of the eigenvalues, which are the trace and determinant of the covariance."""
    a = C.principal_axes(cloud(spark, sf), ["label"])
    return a.select("label", F.round(F.col("l0") + F.col("l1") + F.col("l2"), 6).alias("trace"), F.round(F.col("l0") * F.col("l1") * F.col("l2"), 9).alias("det"))


@query("C11_roots_2d", "SELECT label, round((a + d) / 2 - sqrt((a - d) * (a - d) / 4 + b * b), 6) AS low, round((a + d) / 2 + sqrt((a - d) * (a - d) / 4 + b * b), 6) AS high FROM (SELECT label, covar_pop(x, x) AS a, covar_pop(x, y) AS b, covar_pop(y, y) AS d FROM cloud GROUP BY label)", "cloud")
def c11b(spark, sf):
    c = C.covariance(cloud(spark, sf), ["label"])
    low, high = G.symmetric_roots2(F.col("sxx"), F.col("sxy"), F.col("syy"))
    return rounded(c.select("label", low.alias("low"), high.alias("high")))


@query("C12_inverse_identity", "SELECT idx, i, j, CAST(CASE WHEN i = j THEN 1 ELSE 0 END AS DOUBLE) AS v FROM cloud, (VALUES (0), (1), (2)) a(i), (VALUES (0), (1), (2)) b(j)", "cloud")
def c12(spark, sf):
    """A matrix of each point times its inverse."""
    x, y, z = G.points()
    m = [[2 + x, y, z], [y, 3 + z, x], [z, x, 4 + y]]
    inv, _ = G.inverse3(m)
    cells = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), (m[i][0] * inv[0][j] + m[i][1] * inv[1][j] + m[i][2] * inv[2][j]).alias("v")) for i in range(3) for j in range(3)))
    return rounded(cloud(spark, sf).select("idx", F.explode(cells).alias("c")).select("idx", "c.*"))


@query("C12_determinant", "SELECT idx, round((2 + x) * (3 + z) - y * y, 6) AS d2, round((2 + x) * ((3 + z) * (4 + y) - x * x) - y * (y * (4 + y) - x * z) + z * (y * x - (3 + z) * z), 6) AS d3 FROM cloud", "cloud")
def c12b(spark, sf):
    x, y, z = G.points()
    _, d2 = G.inverse2(2 + x, y, y, 3 + z)
    _, d3 = G.inverse3([[2 + x, y, z], [y, 3 + z, x], [z, x, 4 + y]])
    return rounded(cloud(spark, sf).select("idx", d2.alias("d2"), d3.alias("d3")))


@query("C13_euler_round_trip", "SELECT 0.3::DOUBLE AS roll, -0.2::DOUBLE AS pitch, 0.7::DOUBLE AS yaw")
def c13(spark, sf):
    r, p, y = (round(v, 6) for v in G.euler_angles(M))
    return spark.createDataFrame([(r, p, y)], "roll double, pitch double, yaw double")


@query("C17_point_in_polygon", "SELECT idx, abs(x) + abs(y) < 0.15 AS inside FROM cloud", "cloud")
def c17(spark, sf):
    """Crossing number against the square with corners (+-0.15, 0), (0, +-0.15)."""
    corners = [(0.15, 0.0), (0.0, 0.15), (-0.15, 0.0), (0.0, -0.15)]
    crossings = F.lit(0)
    for (ax, ay), (bx, by) in zip(corners, corners[1:] + corners[:1], strict=True):
        y = F.col("y")
        hit = ((F.lit(ay) > y) != (F.lit(by) > y)) & (F.col("x") < (y - ay) * (bx - ax) / (by - ay) + ax)
        crossings = crossings + hit.cast("int")
    return cloud(spark, sf).select("idx", (crossings % 2 == 1).alias("inside"))


@query("C18_cross_2d", "SELECT idx, round(x * ny - y * nx, 6) AS c FROM cloud JOIN normals USING (idx)", "cloud normals")
def c18(spark, sf):
    return rounded(_pairs(spark, sf).select("idx", G.cross2(F.col("x"), F.col("y"), F.col("nx"), F.col("ny")).alias("c")))


@query("C19_segment_plane", "SELECT idx, CASE WHEN z * nz < 0 THEN round(x + z / (z - nz) * (nx - x), 6) END AS px FROM cloud JOIN normals USING (idx)", "cloud normals")
def c19(spark, sf):
    crosses, at = G.plane_crossing(G.points(), G.points("n"), 2, F.lit(0.0))
    return rounded(_pairs(spark, sf).select("idx", F.when(crosses, at[0]).alias("px")))


@query("C20_triangle_plane", "SELECT idx, (CASE WHEN (z >= 0) <> (nz >= 0) THEN 1 ELSE 0 END) + (CASE WHEN (nz >= 0) <> (x >= 0) THEN 1 ELSE 0 END) + (CASE WHEN (x >= 0) <> (z >= 0) THEN 1 ELSE 0 END) AS crossings FROM cloud JOIN normals USING (idx)", "cloud normals")
def c20(spark, sf):
    """Sides of a triangle with corner heights z, nz and x that cross the plane 0: two or none."""
    h = [F.col("z"), F.col("nz"), F.col("x")]
    n = sum((((h[i] >= 0) != (h[(i + 1) % 3] >= 0)).cast("int") for i in range(3)), F.lit(0))
    return _pairs(spark, sf).select("idx", n.alias("crossings"))


@query("C21_barycentric", "SELECT idx, round(1 - x - y, 6) AS a, round(x, 6) AS b, round(y, 6) AS c, least(1 - x - y, x, y) >= -0.01 AS inside FROM cloud", "cloud")
def c21(spark, sf):
    one, zero = F.lit(1.0), F.lit(0.0)
    b = G.barycentric(F.col("x"), F.col("y"), [(zero, zero), (one, zero), (zero, one)])
    return rounded(cloud(spark, sf).select("idx", *(v.alias(n) for n, v in zip("abc", b, strict=True)), (F.least(*b) >= -0.01).alias("inside")))


@query("C22_bounding_rectangle", "SELECT idx, floor(least(x, nx) * 100)::BIGINT AS x0, floor(least(y, ny) * 100)::BIGINT AS y0, ceil(greatest(x, nx) * 100)::BIGINT AS x1, ceil(greatest(y, ny) * 100)::BIGINT AS y1 FROM cloud JOIN normals USING (idx)", "cloud normals")
def c22(spark, sf):
    low = lambda a: F.floor(F.least(F.col(a), F.col("n" + a)) * 100).cast("long")
    high = lambda a: F.ceil(F.greatest(F.col(a), F.col("n" + a)) * 100).cast("long")
    return _pairs(spark, sf).select("idx", low("x").alias("x0"), low("y").alias("y0"), high("x").alias("x1"), high("y").alias("y1"))


@query("C23_alpha_blend", "SELECT idx, round((idx % 256) * (a / 255.0) + (idx % 100) * (1 - a / 255.0), 6) AS v FROM (SELECT idx, (idx * 7) % 256 AS a FROM cloud)", "cloud")
def c23(spark, sf):
    i = F.col("idx")
    return rounded(cloud(spark, sf).select("idx", G.blend(i % 256, i % 100, (i * 7) % 256).alias("v")))


@query("C24_polar_cells", "SELECT idx, a * 36 + b AS c00, a * 36 + (b + 1) % 36 AS c01, (a + 1) * 36 + b AS c10, (a + 1) * 36 + (b + 1) % 36 AS c11, b + 1 >= 36 AS wrapped FROM (SELECT idx, CAST(floor((z + 1) / 0.05) AS BIGINT) AS a, CAST(floor((idx % 360) / 10.0) AS BIGINT) AS b FROM cloud)", "cloud")
def c24(spark, sf):
    cells = G.polar_cells(F.col("z"), (F.col("idx") % 360).cast("double"), (-1.0, 0.0), (0.05, 10.0), (40, 36))
    return cloud(spark, sf).select("idx", *(c.alias(n) for n, c in zip(("c00", "c01", "c10", "c11", "wrapped"), cells, strict=True)))


@query("C25_rgb_pack", "SELECT idx, (idx % 256) * 65536 + (idx * 3 % 256) * 256 + (idx * 5 % 256) AS rgb, idx % 256 AS r, idx * 3 % 256 AS g, idx * 5 % 256 AS b FROM cloud", "cloud")
def c25(spark, sf):
    i = F.col("idx")
    p = cloud(spark, sf).select("idx", G.pack_rgb(i % 256, i * 3 % 256, i * 5 % 256).alias("rgb"))
    return p.select("idx", "rgb", *(c.alias(n) for n, c in zip("rgb", G.unpack_rgb(F.col("rgb")), strict=True)))


@query("C26_ratio_difference", "SELECT idx, round(abs((2 + x) - (2 + y)) / (2 + x), 6) AS d FROM cloud", "cloud")
def c26(spark, sf):
    bg, img = 2 + F.col("x"), 2 + F.col("y")
    return rounded(cloud(spark, sf).select("idx", (F.abs(bg - img) / bg).alias("d")))


@query("C27_gamma_and_mixed", "SELECT idx, round(pow(exp(x), 0.2), 6) AS g, round(abs(x) * (1 - abs(y)), 6) AS mixed FROM cloud", "cloud")
def c27(spark, sf):
    return rounded(cloud(spark, sf).select("idx", F.pow(F.exp("x"), F.lit(0.2)).alias("g"), (F.abs("x") * (1 - F.abs("y"))).alias("mixed")))


@query("C28_grey_world", "SELECT idx, round(least(r * grey / mr, 255.0), 6) AS r, round(least(g * grey / mg, 255.0), 6) AS g, round(least(b * grey / mb, 255.0), 6) AS b FROM (SELECT *, (mr + mg + mb) / 3 AS grey FROM (SELECT *, avg(r) OVER () AS mr, avg(g) OVER () AS mg, avg(b) OVER () AS mb FROM (SELECT idx, CAST(idx % 256 AS DOUBLE) AS r, CAST(idx * 3 % 200 AS DOUBLE) AS g, CAST(idx * 5 % 90 AS DOUBLE) AS b FROM cloud)))", "cloud")
def c28(spark, sf):
    i = F.col("idx")
    p = cloud(spark, sf).select("idx", (i % 256).cast("double").alias("r"), (i * 3 % 200).cast("double").alias("g"), (i * 5 % 90).cast("double").alias("b"))
    m = F.broadcast(p.agg(*(F.avg(c).alias("m" + c) for c in "rgb")))  # one row
    grey = (F.col("mr") + F.col("mg") + F.col("mb")) / 3
    return rounded(p.join(m).select("idx", *(G.grey_world(F.col(c), F.col("m" + c), grey).alias(c) for c in "rgb")))


@query("C30_input_dimension", "SELECT label, 3 AS dims FROM cloud GROUP BY label", "cloud")
def c30(spark, sf):
    a = C.principal_axes(cloud(spark, sf), ["label"])
    return a.select("label", F.when(F.col("l0") < 0.001 * F.col("l2"), 2).otherwise(3).alias("dims"))


@query("C31_thinnest_axis", "SELECT label, CAST(CASE WHEN ex <= ey AND ex <= ez THEN 0 WHEN ey <= ez THEN 1 ELSE 2 END AS BIGINT) AS axis FROM (SELECT label, max(x) - min(x) AS ex, max(y) - min(y) AS ey, max(z) - min(z) AS ez FROM cloud GROUP BY label)", "cloud")
def c31(spark, sf):
    e = cloud(spark, sf).groupBy("label").agg(*((F.max(a) - F.min(a)).alias("e" + a) for a in "xyz"))
    return e.select("label", G.thinnest_axis(F.col("ex"), F.col("ey"), F.col("ez")).alias("axis"))


@query("C32_in_plane_distance", "SELECT idx, round((x - nx) * (x - nx) + (z - nz) * (z - nz), 6) AS d2 FROM cloud JOIN normals USING (idx)", "cloud normals")
def c32(spark, sf):
    return rounded(_pairs(spark, sf).select("idx", G.sq_dist([F.col("x"), F.col("z")], [F.col("nx"), F.col("nz")]).alias("d2")))


@query("C33_ray_plane", "SELECT idx, CASE WHEN nz <> 0 THEN round((1 - z) / nz, 5) END AS t FROM cloud JOIN normals USING (idx)", "cloud normals")
def c33(spark, sf):
    zero, one = F.lit(0.0), F.lit(1.0)
    return rounded(_pairs(spark, sf).select("idx", G.ray_plane(G.points(), G.points("n"), [zero, zero, one], [zero, zero, one]).alias("t")), 5)


@query("C14_similarity_alignment")
def c14(spark, sf):
    """The rigid motion and scale that carry the cloud onto its transformed copy; the moments are one aggregation, the 3x3 problem is solved on the driver."""
    import numpy as np

    c = cloud(spark, sf)
    q = G.affine([2.0 * p for p in G.points()], M)
    pair = c.select("x", "y", "z", *(v.alias("q" + a) for a, v in zip("xyz", q, strict=True)))
    cov = [F.covar_pop(a, "q" + b).alias(f"s{a}{b}") for a in "xyz" for b in "xyz"]
    r = pair.agg(*(F.avg(a).alias("m" + a) for a in "xyz"), *(F.avg("q" + a).alias("mq" + a) for a in "xyz"), *cov, (F.var_pop("x") + F.var_pop("y") + F.var_pop("z")).alias("var")).first()
    s = np.array([[r[f"s{a}{b}"] for a in "xyz"] for b in "xyz"])
    u, d, vt = np.linalg.svd(s)
    fix = np.diag([1, 1, np.sign(np.linalg.det(u) * np.linalg.det(vt))])
    rot, scale = u @ fix @ vt, float((d * np.diag(fix)).sum() / r["var"])
    t = np.array([r["mq" + a] for a in "xyz"]) - scale * rot @ np.array([r["m" + a] for a in "xyz"])
    rows = [(i, *(round(float(v), 6) for v in rot[i]), round(float(t[i]), 6), round(scale, 6)) for i in range(3)]
    return spark.createDataFrame(rows, "row int, r0 double, r1 double, r2 double, t double, scale double")


@query("C15_transform_line_and_plane")
def c15(spark, sf):
    """Each point with its normal as a line and as a plane (n, d), moved by a rigid motion; the moved point still lies on both."""
    p = _pairs(spark, sf)
    q, n = G.affine(G.points(), M), G.rotate(G.points("n"), M)
    return rounded(p.select("idx", *(v.alias("o" + a) for a, v in zip("xyz", q, strict=True)), *(v.alias("d" + a) for a, v in zip("xyz", n, strict=True)), (-G.dot(n, q)).alias("plane_d")))


@query("C16_projection_matrix")
def c16(spark, sf):
    """The 3x4 projection of an organized cloud, from its pixel and point moments (one aggregation; the 12x12 problem on the driver)."""
    import numpy as np

    c = cloud(spark, sf).select(F.array("x", "y", (F.col("z") + 3), F.lit(1.0)).alias("p"))
    u, v = (500 * F.col("p")[0] + 320 * F.col("p")[2]) / F.col("p")[2], (500 * F.col("p")[1] + 240 * F.col("p")[2]) / F.col("p")[2]
    names = [(i, j) for i in range(4) for j in range(i, 4)]
    w = {"1": F.lit(1.0), "u": u, "v": v, "q": u * u + v * v}
    r = c.agg(*(F.sum(F.col("p")[i] * F.col("p")[j] * e).alias(f"{k}{i}{j}") for k, e in w.items() for i, j in names)).first()
    m = {k: np.array([[r[f"{k}{min(i, j)}{max(i, j)}"] for j in range(4)] for i in range(4)]) for k in w}
    zero = np.zeros((4, 4))
    a = np.block([[m["1"], zero, -m["u"]], [zero, m["1"], -m["v"]], [-m["u"], -m["v"], m["q"]]])
    p = np.linalg.eigh(a)[1][:, 0].reshape(3, 4)
    p = p / p[2, 2]
    return spark.createDataFrame([(i, *(round(float(x), 4) + 0.0 for x in p[i])) for i in range(3)], "row int, p0 double, p1 double, p2 double, p3 double")
