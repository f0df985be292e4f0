"""Neighbour-search queries: every row whose id is divisible by 50 is a query, against all rows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import cloud as C
from ..operators import octree as O
from ..operators import search as S
from .registry import DEPTH, ORIGIN, RES, big, cloud, keyed, normals, query, rounded, table


def asked(c):
    return c.filter(F.col("idx") % 50 == 0).select(F.col("idx").alias("qidx"), "x", "y", "z")


_D2 = "(p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z)"
PAIRS = f"pr AS (SELECT q.idx AS qidx, p.idx, {_D2} AS d2 FROM {{v}} p, {{v}} q WHERE q.idx % 50 = 0), rk AS (SELECT *, row_number() OVER (PARTITION BY qidx ORDER BY d2, idx) AS rank, row_number() OVER (PARTITION BY qidx ORDER BY idx) AS pos FROM pr) "


def knn_sql(v, k, cols="qidx, idx, round(d2, 9) AS d2, rank"):
    return f"WITH {PAIRS.format(v=v)} SELECT {cols} FROM rk WHERE rank <= {k}"


def radius_sql(v, r2, extra="", cols="qidx, idx, round(d2, 9) AS d2"):
    return f"WITH {PAIRS.format(v=v)} SELECT {cols} FROM rk WHERE d2 <= {r2} {extra}"


@query("J1_knn_brute", knn_sql("cloud", 20), "cloud")
def j1(spark, sf):
    c = cloud(spark, sf)
    return rounded(S.nearest(c, asked(c), 20), 9)


@query("J2_radius_first_in_index_order", f"WITH {PAIRS.format(v='cloud')}, r AS (SELECT *, row_number() OVER (PARTITION BY qidx ORDER BY idx) AS n FROM pr WHERE d2 <= 0.15 * 0.15) SELECT qidx, idx, round(d2, 9) AS d2 FROM r WHERE n <= 10", "cloud")
def j2(spark, sf):
    c = cloud(spark, sf)
    return rounded(S.within(c, asked(c), 0.15, max_nn=10), 9)


@query("J3_octree_knn_large", knn_sql("keyed", 10), "keyed")
def j3(spark, sf):
    c = keyed(spark, sf)
    return rounded(S.nearest(c, asked(c), 10), 9)


@query("J4_octree_radius_large", radius_sql("keyed", "5.0 * 5.0"), "keyed")
def j4(spark, sf):
    c = keyed(spark, sf)
    return rounded(S.within(c, asked(c), 5.0), 9)


@query("J5_approximate_nearest", "SELECT qidx, idx, round(d2, 9) AS d2 FROM (SELECT *, row_number() OVER (PARTITION BY qidx ORDER BY d2, idx) AS r FROM (SELECT q.idx AS qidx, p.idx, (p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z) AS d2 FROM keys p JOIN keys q USING (kx, ky, kz) WHERE q.idx % 50 = 0)) WHERE r = 1", "keys")
def j5(spark, sf):
    c = O.indexed(cloud(spark, sf), ORIGIN, RES)
    q = O.indexed(asked(cloud(spark, sf)), ORIGIN, RES)
    return rounded(S.approximate(c, q), 9)


@query("J6_voxel_search", "SELECT q.idx AS qidx, p.idx FROM keys p JOIN keys q USING (kx, ky, kz) WHERE q.idx % 50 = 0", "keys")
def j6(spark, sf):
    return S.same_voxel(O.indexed(cloud(spark, sf), ORIGIN, RES), O.indexed(asked(cloud(spark, sf)), ORIGIN, RES))


@query("J7_radius_sorted", f"WITH {PAIRS.format(v='cloud')}, r AS (SELECT *, row_number() OVER (PARTITION BY qidx ORDER BY d2, idx) AS place FROM pr WHERE d2 <= 0.12 * 0.12) SELECT qidx, idx, place FROM r", "cloud")
def j7(spark, sf):
    c = cloud(spark, sf)
    r = S.within(c, asked(c), 0.12)
    return r.select("qidx", "idx", F.row_number().over(Window.partitionBy("qidx").orderBy("d2", "idx")).cast("long").alias("place"))


@query("J8_kdtree_knn_clamped", knn_sql("cloud", 1000000, "qidx, count(*) AS n, round(max(d2), 9) AS worst") + " GROUP BY qidx", "cloud")
def j8(spark, sf):
    """k beyond the cloud's size is clamped to it."""
    c = cloud(spark, sf)
    return S.nearest(c, asked(c), min(1_000_000, c.count())).groupBy("qidx").agg(F.count("*").alias("n"), F.round(F.max("d2"), 9).alias("worst"))


@query("J9_kdtree_radius", radius_sql("cloud", "0.0144"), "cloud")
def j9(spark, sf):
    c = cloud(spark, sf)
    return rounded(S.within(c, asked(c), 0.12), 9)


@query("J9_kdtree_radius_squared", radius_sql("cloud", "0.02"), "cloud")
def j9b(spark, sf):
    """The radius is taken as a squared distance."""
    c = cloud(spark, sf)
    return rounded(S.within(c, asked(c), 0.02, squared=True), 9)


@query("J10_exact_for_any_epsilon", knn_sql("cloud", 5, "qidx, idx, rank"), "cloud")
def j10(spark, sf):
    """Approximate settings are accepted and answered exactly."""
    c = cloud(spark, sf)
    return S.nearest(c, asked(c), 5).select("qidx", "idx", "rank")


@query("J11_hashed_radius")
def j11(spark, sf):
    c = cloud(spark, sf)
    return rounded(S.hashed_neighbours(c, asked(c), 0.12), 9)


@query("J12_organized_knn", knn_sql("cloud", 8, "qidx // 25 AS qrow, qidx % 25 AS qcol, idx // 25 AS row, idx % 25 AS col, rank"), "cloud")
def j12(spark, sf):
    c = cloud(spark, sf)
    n = S.nearest(c, asked(c), 8)
    px = lambda i: (F.floor(F.col(i) / 25).cast("long"), (F.col(i) % 25))
    return n.select(*(v.alias(a) for a, v in zip(("qrow", "qcol"), px("qidx"), strict=True)), *(v.alias(a) for a, v in zip(("row", "col"), px("idx"), strict=True)), "rank")


@query("J13_organized_radius", f"SELECT q.idx AS qidx, p.idx, round({_D2}, 9) AS d2 FROM cloud p, cloud q WHERE q.idx % 50 = 0 AND abs(p.idx // 25 - q.idx // 25) <= 6 AND abs(p.idx % 25 - q.idx % 25) <= 6 AND {_D2} <= 0.3 * 0.3", "cloud")
def j13(spark, sf):
    c = C.organized(cloud(spark, sf), 25)
    q = c.filter(F.col("idx") % 50 == 0).withColumnRenamed("idx", "qidx")
    return rounded(S.projected_window(c, q, 25, 6, 0.3), 9)


@query("J14_search_by_index_list", knn_sql("cloud", 3, "qidx, string_agg(idx, ',' ORDER BY rank) AS found") + " GROUP BY qidx", "cloud")
def j14(spark, sf):
    c = cloud(spark, sf)
    n = S.nearest(c, asked(c), 3)
    found = F.transform(F.sort_array(F.collect_list(F.struct("rank", "idx"))), lambda s: s["idx"].cast("string"))
    return n.groupBy("qidx").agg(F.concat_ws(",", found).alias("found"))


@query("J15_kdtree_adapter", radius_sql("cloud", "0.01", cols="qidx, count(*) AS n") + " GROUP BY qidx", "cloud")
def j15(spark, sf):
    c = cloud(spark, sf)
    return S.within(c, asked(c), 0.1).groupBy("qidx").agg(F.count("*").alias("n"))


@query("J16_knn_join_for_cloud", knn_sql("keyed", 5, "qidx, rank, idx, round(d2, 9) AS d2"), "keyed")
def j16(spark, sf):
    c = keyed(spark, sf)
    return rounded(S.nearest_join(c, asked(c), 5), 9)


@query("J17_knn_for_point", "SELECT idx, round(x * x + y * y + z * z, 9) AS d2 FROM cloud ORDER BY x * x + y * y + z * z, idx LIMIT 20", "cloud")
def j17(spark, sf):
    c = cloud(spark, sf)
    origin = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "qidx long, x double, y double, z double")
    return rounded(S.nearest(c, origin, 20).select("idx", "d2"), 9)


@query("J18_radius_for_cloud", f"WITH {PAIRS.format(v='cloud')}, r AS (SELECT *, row_number() OVER (PARTITION BY qidx ORDER BY d2, idx) AS n FROM pr WHERE d2 <= 0.2 * 0.2) SELECT qidx, idx, round(d2, 9) AS d2 FROM r WHERE n <= 20", "cloud")
def j18(spark, sf):
    c = cloud(spark, sf)
    return rounded(S.within(c, asked(c), 0.2, max_nn=20, first_by="d2"), 9)


@query("J19_voxel_search_count", "SELECT q.idx AS qidx, count(*) AS n FROM keys p JOIN keys q USING (kx, ky, kz) WHERE q.idx % 50 = 0 GROUP BY q.idx", "keys")
def j19(spark, sf):
    return S.same_voxel(O.indexed(cloud(spark, sf), ORIGIN, RES), O.indexed(asked(cloud(spark, sf)), ORIGIN, RES)).groupBy("qidx").agg(F.count("*").alias("n"))


RAYS = "rays AS (SELECT c.idx AS qidx, -2.0 AS ox, c.y AS oy, c.z AS oz, 1.0 AS dx, nx * 0.1 + 0.011 AS dy, ny * 0.1 + 0.013 AS dz FROM cloud c JOIN normals USING (idx) WHERE c.idx % 50 = 0)"
_SLAB = "greatest(" + ", ".join(f"least((k{a} * 0.1 - 1.6 - o{a}) / d{a}, ((k{a} + 1) * 0.1 - 1.6 - o{a}) / d{a})" for a in "xyz") + ") AS t, least(" + ", ".join(f"greatest((k{a} * 0.1 - 1.6 - o{a}) / d{a}, ((k{a} + 1) * 0.1 - 1.6 - o{a}) / d{a})" for a in "xyz") + ") AS t_out"


def rays(spark, sf):
    c = C.zip_columns(cloud(spark, sf), normals(spark, sf)).filter(F.col("idx") % 50 == 0)
    return c.select(F.col("idx").alias("qidx"), F.lit(-2.0).alias("ox"), F.col("y").alias("oy"), F.col("z").alias("oz"), F.lit(1.0).alias("dx"), (F.col("nx") * 0.1 + 0.011).alias("dy"), (F.col("ny") * 0.1 + 0.013).alias("dz"))


@query("J20_ray_voxels", f"WITH {RAYS}, h AS (SELECT qidx, kx, ky, kz, {_SLAB} FROM (SELECT DISTINCT kx, ky, kz FROM keys), rays) SELECT qidx, kx, ky, kz, round(t, 6) AS t FROM h WHERE t < t_out AND t_out > 0", "keys normals")
def j20(spark, sf):
    v = O.indexed(cloud(spark, sf), ORIGIN, RES).select(*O.KEYS).distinct()
    return rounded(O.ray_voxels(v, rays(spark, sf), ORIGIN, RES))


@query("J20_ray_voxel_indices", f"WITH {RAYS}, h AS (SELECT qidx, idx, {_SLAB} FROM keys, rays) SELECT qidx, idx FROM h WHERE t < t_out AND t_out > 0", "keys normals")
def j20b(spark, sf):
    k = O.indexed(cloud(spark, sf), ORIGIN, RES)
    v = O.ray_voxels(k.select(*O.KEYS).distinct(), rays(spark, sf), ORIGIN, RES)
    return v.join(k.select("idx", *O.KEYS), O.KEYS).select("qidx", "idx")


_STEPS = "WITH s AS (SELECT c.idx AS qidx, x, y, z, nx, ny, nz, greatest(floor(sqrt((nx - x) * (nx - x) + (ny - y) * (ny - y) + (nz - z) * (nz - z)) / (0.1 * 0.5)), 1) AS n FROM cloud c JOIN normals USING (idx) WHERE c.idx % 50 = 0), e AS (SELECT *, unnest(range(CAST(n AS BIGINT) + 1)) AS step FROM s), k AS (SELECT qidx, step, CAST(floor((x + (nx - x) * (step / n) + 1.6) / 0.1) AS BIGINT) AS kx, CAST(floor((y + (ny - y) * (step / n) + 1.6) / 0.1) AS BIGINT) AS ky, CAST(floor((z + (nz - z) * (step / n) + 1.6) / 0.1) AS BIGINT) AS kz FROM e), l AS (SELECT *, lag(kx) OVER w AS px, lag(ky) OVER w AS py, lag(kz) OVER w AS pz FROM k WINDOW w AS (PARTITION BY qidx ORDER BY step)) SELECT qidx, step, kx, ky, kz FROM l WHERE px IS NULL OR px <> kx OR py <> ky OR pz <> kz"


@query("J21_segment_voxels", _STEPS, "cloud normals")
def j21(spark, sf):
    c = C.zip_columns(cloud(spark, sf), normals(spark, sf)).filter(F.col("idx") % 50 == 0)
    seg = c.select(F.col("idx").alias("qidx"), *(F.col(a).alias("a" + a) for a in "xyz"), *(F.col("n" + a).alias("b" + a) for a in "xyz"))
    return O.segment_voxels(seg, ORIGIN, RES, 0.5)


@query("J22_points_with_normals", "SELECT idx, x, y, z, round(nx, 6) AS nx FROM cloud JOIN normals USING (idx)", "cloud normals")
def j22(spark, sf):
    return rounded(C.zip_columns(cloud(spark, sf), normals(spark, sf)).select("idx", "x", "y", "z", "nx"), 6, "nx")


@query("J26_closest_within_distance", f"WITH {PAIRS.format(v='cloud')}, n AS (SELECT qidx, idx, d2, row_number() OVER (PARTITION BY qidx ORDER BY d2, idx) AS r FROM pr WHERE qidx <> idx) SELECT qidx, CASE WHEN d2 <= 0.05 * 0.05 THEN idx END AS idx FROM n WHERE r = 1", "cloud")
def j26(spark, sf):
    c = cloud(spark, sf)
    n = S.nearest(c, asked(c), 2).filter("qidx <> idx").groupBy("qidx").agg(F.min_by(F.struct("idx", "d2"), "rank").alias("m"))
    return n.select("qidx", F.when(F.col("m.d2") <= 0.05 * 0.05, F.col("m.idx")).alias("idx"))


@query("J28_label_lookup", "SELECT n_name AS name, r_name AS label FROM nation JOIN region ON n_regionkey = r_regionkey")
def j28(spark, sf):
    n, r = table(spark, sf, "nation"), table(spark, sf, "region")
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.col("n_name").alias("name"), F.col("r_name").alias("label"))


@query("J29_hull_to_original", "SELECT label, idx FROM (SELECT label, idx, row_number() OVER (PARTITION BY label ORDER BY x, y, idx) AS r FROM cloud) WHERE r = 1", "cloud")
def j29(spark, sf):
    """The first hull vertex of each cloud, found again among the original points."""
    from ..operators.hull import convex_2d

    c = cloud(spark, sf)
    h = convex_2d(c, ["label"], "xy").filter("pos = 0").select(F.col("label").alias("qidx"), "x", "y", "z")
    return S.nearest(c, h, 1).select(F.col("qidx").alias("label"), "idx")


@query("P9_custom_representation_knn", "WITH e AS (SELECT vec_id AS idx, embedding AS v FROM embeddings), d AS (SELECT q.idx AS qidx, p.idx, " + " + ".join(f"(CAST(p.v[{i}] AS DOUBLE) - q.v[{i}]) * (CAST(p.v[{i}] AS DOUBLE) - q.v[{i}])" for i in range(1, 65)) + " AS d2 FROM e p, e q WHERE q.idx % 50 = 0) SELECT qidx, idx, rank FROM (SELECT *, row_number() OVER (PARTITION BY qidx ORDER BY d2, idx) AS rank FROM d) WHERE rank <= 5")
def p9b(spark, sf):
    """Nearest neighbours in a feature space: all 64 dimensions."""
    dims = [f"v{i}" for i in range(64)]
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), *(F.get("embedding", F.lit(i)).cast("double").alias(d) for i, d in enumerate(dims)))
    q = e.filter(F.col("idx") % 50 == 0).withColumnRenamed("idx", "qidx")
    return S.nearest(e, q, 5, dims).select("qidx", "idx", "rank")
