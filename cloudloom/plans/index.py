"""Queries on the octree and kd-tree: keys, levels, occupancy, samplers, serialisation, change detection, state."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import cloud as C
from ..operators import octree as O
from ..operators import sampling as S
from .registry import DEPTH, ORIGIN, RES, big, cloud, keyed, normals, query, rounded, table


def indexed(spark, sf):
    return O.indexed(cloud(spark, sf), ORIGIN, RES)


def with_normals(spark, sf):
    return O.indexed(C.zip_columns(cloud(spark, sf), normals(spark, sf)), ORIGIN, RES)


#: SQL pieces: the distance to the voxel centre, and the nodes of all levels.
D2C = "(x - ((kx + 0.5) * 0.1 - 1.6)) * (x - ((kx + 0.5) * 0.1 - 1.6)) + (y - ((ky + 0.5) * 0.1 - 1.6)) * (y - ((ky + 0.5) * 0.1 - 1.6)) + (z - ((kz + 0.5) * 0.1 - 1.6)) * (z - ((kz + 0.5) * 0.1 - 1.6))"
NODES = "nodes AS (SELECT DISTINCT l AS level, kx >> CAST(5 - l AS INT) AS kx, ky >> CAST(5 - l AS INT) AS ky, kz >> CAST(5 - l AS INT) AS kz FROM keys, range(6) t(l))"
MASKS = NODES + ", masks AS (SELECT level - 1 AS level, kx >> 1 AS kx, ky >> 1 AS ky, kz >> 1 AS kz, bit_or(CAST(1 AS BIGINT) << CAST((kx & 1) * 4 + (ky & 1) * 2 + (kz & 1) AS INT)) AS mask FROM nodes WHERE level > 0 GROUP BY 1, 2, 3, 4)"
MORTON = " + ".join(f"(((kx >> {i}) & 1) << {3 * i + 2}) + (((ky >> {i}) & 1) << {3 * i + 1}) + (((kz >> {i}) & 1) << {3 * i})" for i in range(5))


@query("O1_index_points", "SELECT idx, kx, ky, kz FROM keys", "keys")
def o1(spark, sf):
    return indexed(spark, sf).select("idx", *O.KEYS)


@query("O2_append_points", "SELECT kx, ky, kz, count(*) AS n FROM (SELECT kx, ky, kz FROM keys UNION ALL SELECT kx + 1, ky, kz FROM keys) GROUP BY 1, 2, 3", "keys")
def o2(spark, sf):
    k = indexed(spark, sf).select(*O.KEYS)
    return O.voxels(k.union(k.select(F.col("kx") + 1, "ky", "kz")))


@query("O3_define_box", "SELECT round(min(x), 6) AS min_x, round(max(x) + 2.220446049250313e-16 * 512, 6) AS max_x, round(min(y), 6) AS min_y, round(max(y) + 2.220446049250313e-16 * 512, 6) AS max_y FROM big", "big")
def o3(spark, sf):
    b = C.bounds(big(spark, sf))
    eps = 2.220446049250313e-16 * 512
    return rounded(b.select("min_x", (F.col("max_x") + eps).alias("max_x"), "min_y", (F.col("max_y") + eps).alias("max_y")))


@query("O4_key_depth", "SELECT CAST(least(32, greatest(1, ceil(log2(greatest(2, ceil(greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)) / 0.1)))))) AS INT) AS depth FROM cloud", "cloud")
def o4(spark, sf):
    r = C.bounds(cloud(spark, sf)).first()
    return spark.createDataFrame([(O.key_depth([r["min_" + a] for a in "xyz"], [r["max_" + a] for a in "xyz"], RES),)], "depth int")


@query("O5_box_from_first_point", "SELECT idx, CAST(floor((x - (fx - 0.05)) / 0.1) AS BIGINT) AS kx, CAST(floor((y - (fy - 0.05)) / 0.1) AS BIGINT) AS ky, CAST(floor((z - (fz - 0.05)) / 0.1) AS BIGINT) AS kz FROM cloud, (SELECT arg_min(x, idx) AS fx, arg_min(y, idx) AS fy, arg_min(z, idx) AS fz FROM cloud)", "cloud")
def o5(spark, sf):
    return O.indexed_from_first(cloud(spark, sf), RES).select("idx", *O.KEYS)


@query("O6_bounding_box", "SELECT round(min(x) - (3.2 - (max(x) - min(x))) / 2, 6) AS lo, round(min(x) - (3.2 - (max(x) - min(x))) / 2 + 3.2, 6) AS hi FROM cloud", "cloud")
def o6(spark, sf):
    b = C.bounds(cloud(spark, sf))
    lo = F.col("min_x") - (RES * (1 << DEPTH) - (F.col("max_x") - F.col("min_x"))) / 2
    return rounded(b.select(lo.alias("lo"), (lo + RES * (1 << DEPTH)).alias("hi")))


DYN = "lv AS (SELECT k.*, l AS level, count(*) OVER (PARTITION BY l, kx >> CAST(5 - l AS INT), ky >> CAST(5 - l AS INT), kz >> CAST(5 - l AS INT)) AS held FROM keys k, range(6) t(l)), dyn AS (SELECT idx, any_value(kx) AS kx, any_value(ky) AS ky, any_value(kz) AS kz, any_value(x) AS x, any_value(y) AS y, any_value(z) AS z, CAST(coalesce(min(level) FILTER (held <= {n}), 5) AS BIGINT) AS leaf_depth FROM lv GROUP BY idx)"


@query("O7_dynamic_depth", "WITH " + DYN.format(n=10) + " SELECT idx, leaf_depth FROM dyn", "keys")
def o7(spark, sf):
    return O.dynamic_leaves(indexed(spark, sf), DEPTH, 10).select("idx", "leaf_depth")


@query("O8_split_by_normals", "WITH kn AS (SELECT * FROM keys JOIN normals USING (idx)), " + DYN.format(n=10) + ", nl AS (SELECT k.idx, l AS level, d.leaf_depth AS base, count(*) OVER w AS held, sum(nx) OVER w AS sx, sum(ny) OVER w AS sy, sum(nz) OVER w AS sz FROM kn k JOIN dyn d USING (idx), range(6) t(l) WINDOW w AS (PARTITION BY l, k.kx >> CAST(5 - l AS INT), k.ky >> CAST(5 - l AS INT), k.kz >> CAST(5 - l AS INT))) SELECT idx, CAST(coalesce(min(level) FILTER (level >= base AND (held <= 1 OR sqrt(sx * sx + sy * sy + sz * sz) / held >= 0.8)), 5) AS BIGINT) AS leaf_depth FROM nl GROUP BY idx", "keys normals")
def o8(spark, sf):
    return O.normal_leaves(with_normals(spark, sf), DEPTH, 10, 0.8).select("idx", "leaf_depth")


@query("O9_create_and_remove_leaves", "SELECT DISTINCT kx, ky, kz FROM keys WHERE kx % 2 = 0 UNION SELECT 31, 31, 31", "keys")
def o9(spark, sf):
    k = indexed(spark, sf).select(*O.KEYS).distinct()
    gone = k.filter("kx % 2 <> 0")
    more = spark.createDataFrame([(31, 31, 31)], "kx long, ky long, kz long")
    return O.without_voxel(k, gone).union(more).distinct()


@query("O11_keys_at_depth", "SELECT DISTINCT kx >> 2 AS kx, ky >> 2 AS ky, kz >> 2 AS kz FROM keys", "keys")
def o11(spark, sf):
    return O.at_level(indexed(spark, sf), DEPTH, 3)


@query("O11_keys_to_max_depth", f"WITH {NODES} SELECT * FROM nodes WHERE level <= 4", "keys")
def o11b(spark, sf):
    return O.up_to_level(indexed(spark, sf), DEPTH, DEPTH).filter("level <= 4")


@query("O12_depth_first_order", f"WITH {NODES}, o AS (SELECT level, kx, ky, kz, ({MORTON}) << CAST(3 * (5 - level) AS INT) AS code FROM nodes) SELECT level, kx, ky, kz, code * 6 + level AS dfs FROM o", "keys")
def o12(spark, sf):
    n = O.up_to_level(indexed(spark, sf), DEPTH, DEPTH)
    n = n.withColumn("code", G.morton(*(F.col(k) for k in O.KEYS), DEPTH))
    return O.depth_first(n, DEPTH).drop("code")


@query("O12_breadth_first_order", f"WITH {NODES} SELECT level, {MORTON} AS code, kx, ky, kz FROM nodes", "keys")
def o12b(spark, sf):
    n = O.up_to_level(indexed(spark, sf), DEPTH, DEPTH)
    return n.select("level", G.morton(*(F.col(k) for k in O.KEYS), DEPTH).alias("code"), *O.KEYS)


@query("O15_kd_leaves")
def o15(spark, sf):
    return O.kd_boxes(O.kd_leaves(cloud(spark, sf), 30))


@query("O15_kd_statistics")
def o15b(spark, sf):
    b = O.kd_boxes(O.kd_leaves(cloud(spark, sf), 30))
    return b.agg(F.count("*").alias("leaf_count"), (F.count("*") - 1).alias("branch_count"), F.max("depth").alias("max_depth"))


@query("C4_octree_keys_large", "SELECT CAST(floor(x / 5) AS BIGINT) AS kx, CAST(floor(y / 5) AS BIGINT) AS ky, CAST(floor(z / 5) AS BIGINT) AS kz, count(*) AS n FROM big GROUP BY 1, 2, 3", "big")
def c4(spark, sf):
    return O.voxels(O.indexed(big(spark, sf), (0.0, 0.0, 0.0), 5.0))


@query("C5_voxel_centres_and_bounds", "SELECT DISTINCT kx, ky, kz, CAST(round((kx + 0.5) * 0.1 - 1.6, 6) AS DOUBLE) AS cx, CAST(round(kx * 0.1 - 1.6, 6) AS DOUBLE) AS lo_x, CAST(round((kx + 1) * 0.1 - 1.6, 6) AS DOUBLE) AS hi_x FROM keys", "keys")
def c5(spark, sf):
    v = O.centres(indexed(spark, sf).select(*O.KEYS).distinct(), ORIGIN, RES)
    return rounded(v.select(*O.KEYS, "cx", (F.col("kx") * RES + ORIGIN[0]).alias("lo_x"), ((F.col("kx") + 1) * RES + ORIGIN[0]).alias("hi_x")))


@query("C7_key_algebra", "SELECT DISTINCT kx, ky, kz, (kx >> 1) AS parent_x, (kx & 1) * 4 + (ky & 1) * 2 + (kz & 1) AS child, kx * 2 + 1 AS pushed FROM keys", "keys")
def c7(spark, sf):
    k = [F.col(c) for c in O.KEYS]
    return indexed(spark, sf).select(*O.KEYS).distinct().select(*O.KEYS, F.shiftright("kx", 1).alias("parent_x"), G.child_index(*k, 0).alias("child"), (F.col("kx") * 2 + 1).alias("pushed"))


@query("F9_voxel_occupied", "SELECT idx, EXISTS (SELECT 1 FROM keys k WHERE k.kx = floor((-c.x + 1.6) / 0.1) AND k.ky = floor((c.y + 1.6) / 0.1) AND k.kz = floor((c.z + 1.6) / 0.1)) AS occupied FROM cloud c", "keys")
def f9(spark, sf):
    mirrored = O.indexed(cloud(spark, sf).withColumn("x", -F.col("x")), ORIGIN, RES)
    held = indexed(spark, sf).select(*O.KEYS).distinct().withColumn("occupied", F.lit(True))
    return mirrored.join(held, O.KEYS, "left").select("idx", F.coalesce("occupied", F.lit(False)).alias("occupied"))


@query("F10_exist_leaf", "SELECT DISTINCT kx, ky, kz FROM keys WHERE (kx + 1, ky, kz) IN (SELECT (kx, ky, kz) FROM keys)", "keys")
def f10(spark, sf):
    k = indexed(spark, sf).select(*O.KEYS).distinct()
    nxt = k.select((F.col("kx") - 1).alias("kx"), "ky", "kz")
    return k.join(nxt, O.KEYS, "left_semi")


# samplers
@query("A9_uniform_sampling", "SELECT idx, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY floor(x / 0.1), floor(y / 0.1), floor(z / 0.1) ORDER BY (x - (floor(x / 0.1) + 0.5) * 0.1) * (x - (floor(x / 0.1) + 0.5) * 0.1) + (y - (floor(y / 0.1) + 0.5) * 0.1) * (y - (floor(y / 0.1) + 0.5) * 0.1) + (z - (floor(z / 0.1) + 0.5) * 0.1) * (z - (floor(z / 0.1) + 0.5) * 0.1), idx) AS r FROM cloud) WHERE r = 1", "cloud")
def a9(spark, sf):
    return S.uniform(cloud(spark, sf), 0.1)


@query("A9_uniform_sampling_legacy", "SELECT idx, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY floor(x / 0.1), floor(y / 0.1), floor(z / 0.1) ORDER BY (x - floor(x / 0.1)) * (x - floor(x / 0.1)) + (y - floor(y / 0.1)) * (y - floor(y / 0.1)) + (z - floor(z / 0.1)) * (z - floor(z / 0.1)), idx) AS r FROM cloud) WHERE r = 1", "cloud")
def a9b(spark, sf):
    return S.uniform(cloud(spark, sf), 0.1, "legacy")


@query("A10_closest_to_centre", f"SELECT idx, x, y, z FROM (SELECT *, row_number() OVER (PARTITION BY kx, ky, kz ORDER BY {D2C}, idx) AS r FROM keys) WHERE r = 1", "keys")
def a10(spark, sf):
    return S.closest_to_centre(indexed(spark, sf), ORIGIN, RES)


@query("A11_voxel_average", "SELECT kx, ky, kz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM keys GROUP BY kx, ky, kz", "keys")
def a11(spark, sf):
    return rounded(S.average(indexed(spark, sf)))


@query("A11_voxel_average_large", "SELECT CAST(floor(x / 2) AS BIGINT) AS kx, CAST(floor(y / 2) AS BIGINT) AS ky, CAST(floor(z / 2) AS BIGINT) AS kz, round(avg(x) * count(*), 5) AS sum_x, round(avg(y) * count(*), 5) AS sum_y, round(avg(z) * count(*), 5) AS sum_z, count(*) AS n FROM big GROUP BY 1, 2, 3", "big")
def a11b(spark, sf):
    """Averages times counts: sums of decimals have no rounding ties."""
    v = S.average(O.indexed(big(spark, sf), (0.0, 0.0, 0.0), 2.0))
    return rounded(v.select(*O.KEYS, *((F.col(a) * F.col("n")).alias("sum_" + a) for a in "xyz"), "n"), 5)


@query("A12_height_interpolation", "WITH kn AS (SELECT * FROM keys JOIN normals USING (idx)), m AS (SELECT kx, ky, kz, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, abs(avg(nx)) AS ax, abs(avg(ny)) AS ay, abs(avg(nz)) AS az, count(*) AS n FROM kn GROUP BY 1, 2, 3), a AS (SELECT *, CASE WHEN ax >= ay AND ax >= az THEN 0 WHEN ay >= az THEN 1 ELSE 2 END AS axis FROM m), d AS (SELECT a.*, k.x, k.y, k.z, CASE axis WHEN 0 THEN (y - my) * (y - my) + (z - mz) * (z - mz) WHEN 1 THEN (x - mx) * (x - mx) + (z - mz) * (z - mz) ELSE (x - mx) * (x - mx) + (y - my) * (y - my) END AS pd FROM kn k JOIN a USING (kx, ky, kz)), w AS (SELECT *, CASE WHEN pd = 0 THEN 1 ELSE 1 / pd END AS w, CASE axis WHEN 0 THEN x WHEN 1 THEN y ELSE z END AS h FROM d) SELECT kx, ky, kz, round(CASE WHEN any_value(axis) = 0 THEN sum(w * h) / sum(w) ELSE any_value(mx) END, 5) AS x, round(CASE WHEN any_value(axis) = 1 THEN sum(w * h) / sum(w) ELSE any_value(my) END, 5) AS y, round(CASE WHEN any_value(axis) = 2 THEN sum(w * h) / sum(w) ELSE any_value(mz) END, 5) AS z, any_value(n) AS n FROM w GROUP BY kx, ky, kz", "keys normals")
def a12(spark, sf):
    return rounded(S.height_interpolated(with_normals(spark, sf)), 5)


@query("A13_adaptive_average", "WITH " + DYN.format(n=10) + " SELECT leaf_depth, kx >> CAST(5 - leaf_depth AS INT) AS lkx, ky >> CAST(5 - leaf_depth AS INT) AS lky, kz >> CAST(5 - leaf_depth AS INT) AS lkz, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, count(*) AS n FROM dyn GROUP BY 1, 2, 3, 4", "keys")
def a13(spark, sf):
    dyn, by = S.by_dynamic_leaves(indexed(spark, sf), DEPTH, 10)
    return rounded(S.average(dyn, by))


@query("A13_adaptive_height")
def a13b(spark, sf):
    dyn, by = S.by_dynamic_leaves(with_normals(spark, sf), DEPTH, 10)
    return rounded(S.height_interpolated(dyn, by))


@query("A14_normal_threshold_sampling")
def a14(spark, sf):
    from ..operators.leaf_surface import resampled

    return resampled(with_normals(spark, sf), ORIGIN, RES, DEPTH, 20, 0.8, 0.04, 0.1)


@query("A15_voxel_density", "SELECT c.idx, count(k.idx) AS density FROM cloud c LEFT JOIN keys k ON k.kx = floor((-c.x + 1.6) / 0.1) AND k.ky = floor((c.y + 1.6) / 0.1) AND k.kz = floor((c.z + 1.6) / 0.1) GROUP BY c.idx", "keys")
def a15(spark, sf):
    at = O.indexed(cloud(spark, sf).withColumn("x", -F.col("x")), ORIGIN, RES)
    return at.join(O.voxels(indexed(spark, sf)), O.KEYS, "left").select("idx", F.coalesce("n", F.lit(0)).alias("density"))


@query("A16_voxel_centroids", "SELECT kx, ky, kz, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy, round(avg(z), 6) AS cz FROM keys GROUP BY 1, 2, 3", "keys")
def a16(spark, sf):
    return rounded(O.voxels(indexed(spark, sf), *(F.avg(a).alias("c" + a) for a in "xyz")))


@query("A17_occupied_voxels", "SELECT DISTINCT kx, ky, kz FROM keys", "keys")
def a17(spark, sf):
    return indexed(spark, sf).select(*O.KEYS).distinct()


@query("A18_voxel_payloads", "SELECT kx, ky, kz, max(idx) AS last_idx, string_agg(idx, ',' ORDER BY idx) AS all_idx FROM keys GROUP BY 1, 2, 3", "keys")
def a18(spark, sf):
    return O.voxels(indexed(spark, sf), F.max("idx").alias("last_idx"), F.concat_ws(",", F.sort_array(F.collect_list("idx")).cast("array<string>")).alias("all_idx"))


@query("A19_occupied_centres", "SELECT DISTINCT CAST(round((kx + 0.5) * 0.1 - 1.6, 6) AS DOUBLE) AS cx, CAST(round((ky + 0.5) * 0.1 - 1.6, 6) AS DOUBLE) AS cy, CAST(round((kz + 0.5) * 0.1 - 1.6, 6) AS DOUBLE) AS cz FROM keys", "keys")
def a19(spark, sf):
    v = O.centres(indexed(spark, sf).select(*O.KEYS).distinct(), ORIGIN, RES)
    return rounded(v.select("cx", "cy", "cz"))


@query("A20_tree_statistics", f"WITH {NODES} SELECT count(*) FILTER (level = 5) AS leaf_count, count(*) FILTER (level < 5) AS branch_count, CAST(5 AS BIGINT) AS tree_depth FROM nodes", "keys")
def a20(spark, sf):
    return O.statistics(indexed(spark, sf), DEPTH)


@query("A25_leaf_normal_threshold", "SELECT kx, ky, kz, round(sqrt(avg(nx) * avg(nx) + avg(ny) * avg(ny) + avg(nz) * avg(nz)), 6) AS mean_dot, round(greatest(max(x) - min(x), max(y) - min(y), max(z) - min(z)), 6) AS extent FROM keys JOIN normals USING (idx) GROUP BY 1, 2, 3", "keys normals")
def a25(spark, sf):
    n = [F.avg("n" + a) for a in "xyz"]
    return rounded(O.voxels(with_normals(spark, sf), G.norm(n).alias("mean_dot"), F.greatest(*(F.max(a) - F.min(a) for a in "xyz")).alias("extent")))


@query("A26_average_plane", "SELECT kx, ky, kz, round(cx, 6) AS cx, round(mx, 6) AS mx, min_x, max_x, CAST(CASE WHEN abs(mx) >= abs(my) AND abs(mx) >= abs(mz) THEN 0 WHEN abs(my) >= abs(mz) THEN 1 ELSE 2 END AS BIGINT) AS axis FROM (SELECT kx, ky, kz, avg(x) AS cx, avg(nx) AS mx, avg(ny) AS my, avg(nz) AS mz, min(x) AS min_x, max(x) AS max_x FROM keys JOIN normals USING (idx) GROUP BY 1, 2, 3)", "keys normals")
def a26(spark, sf):
    v = O.voxels(with_normals(spark, sf), F.avg("x").alias("cx"), *(F.avg("n" + a).alias("m" + a) for a in "xyz"), F.min("x").alias("min_x"), F.max("x").alias("max_x"))
    ax, ay, az = (F.abs(F.col("m" + a)) for a in "xyz")
    axis = F.when((ax >= ay) & (ax >= az), 0).when(ay >= az, 1).otherwise(2).cast("long")
    return rounded(v.select(*O.KEYS, "cx", "mx", "min_x", "max_x", axis.alias("axis")), 6, "cx", "mx")


@query("A27_slice_voxel_centroid", "SELECT kx, ky, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM keys WHERE kz * 0.1 - 1.6 < 0.03 AND (kz + 1) * 0.1 - 1.6 > 0.03 GROUP BY 1, 2", "keys")
def a27(spark, sf):
    k = indexed(spark, sf).filter((F.col("kz") * RES + ORIGIN[2] < 0.03) & ((F.col("kz") + 1) * RES + ORIGIN[2] > 0.03))
    return rounded(k.groupBy("kx", "ky").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy")))


# serialisation and change
@query("S23_serialise_tree", f"WITH {MASKS} SELECT level, kx, ky, kz, mask, (({MORTON}) << CAST(3 * (5 - level) AS INT)) * 6 + level AS dfs FROM masks", "keys")
def s23(spark, sf):
    return O.depth_first(O.child_masks(indexed(spark, sf), DEPTH), DEPTH).drop("code")


@query("S23_deserialise_tree", "SELECT DISTINCT kx, ky, kz FROM keys", "keys")
def s23b(spark, sf):
    return O.expanded(O.child_masks(indexed(spark, sf), DEPTH), DEPTH)


def _half(spark, sf, older):
    k = indexed(spark, sf)
    return k.filter("label < 5") if older else k.filter("label >= 5")


def _masks_of(view, name):
    return MASKS.replace("nodes", f"nodes_{name}").replace("masks AS", f"masks_{name} AS").replace("FROM keys,", f"FROM {view},")


XOR_SQL = f"WITH old AS (SELECT * FROM keys WHERE label < 5), new AS (SELECT * FROM keys WHERE label >= 5), {_masks_of('old', 'a')}, {_masks_of('new', 'b')} SELECT coalesce(a.level, b.level) AS level, coalesce(a.kx, b.kx) AS kx, coalesce(a.ky, b.ky) AS ky, coalesce(a.kz, b.kz) AS kz, xor(coalesce(a.mask, 0), coalesce(b.mask, 0)) AS mask FROM masks_a a FULL JOIN masks_b b ON a.level = b.level AND a.kx = b.kx AND a.ky = b.ky AND a.kz = b.kz"


@query("S24_xor_delta", XOR_SQL, "keys")
def s24(spark, sf):
    return O.xor_masks(O.child_masks(_half(spark, sf, True), DEPTH), O.child_masks(_half(spark, sf, False), DEPTH))


@query("ST3_xor_round_trip", f"WITH new AS (SELECT * FROM keys WHERE label >= 5), {_masks_of('new', 'b')} SELECT level, kx, ky, kz, mask FROM masks_b", "keys")
def st3(spark, sf):
    """The delta applied to the old masks gives the new ones."""
    old, new = O.child_masks(_half(spark, sf, True), DEPTH), O.child_masks(_half(spark, sf, False), DEPTH)
    return O.xor_masks(old, O.xor_masks(old, new)).filter("mask <> 0")


CHANGE = "WITH k AS (SELECT idx, ts, CAST(floor(x / 20) AS BIGINT) AS kx, CAST(floor(y / 5) AS BIGINT) AS ky, CAST(floor(z / 24) AS BIGINT) AS kz FROM keyed), old AS (SELECT * FROM k WHERE ts < TIMESTAMP '2024-01-16'), new AS (SELECT * FROM k WHERE ts >= TIMESTAMP '2024-01-16') "


def snapshots(spark, sf):
    k = keyed(spark, sf).select("idx", "ts", G.voxel(F.col("x"), F.lit(0.0), F.lit(20.0)).alias("kx"), G.voxel(F.col("y"), F.lit(0.0), F.lit(5.0)).alias("ky"), G.voxel(F.col("z"), F.lit(0.0), F.lit(24.0)).alias("kz"))
    cut = F.lit("2024-01-16").cast("timestamp")
    return k.filter(F.col("ts") < cut), k.filter(F.col("ts") >= cut)


@query("X3_new_voxel_points", CHANGE + "SELECT idx FROM new n WHERE NOT EXISTS (SELECT 1 FROM old o WHERE (o.kx, o.ky, o.kz) = (n.kx, n.ky, n.kz))", "keyed")
def x3(spark, sf):
    old, new = snapshots(spark, sf)
    return O.new_voxel_points(old, new).select("idx")


@query("ST2_new_voxels_with_minimum", CHANGE + ", c AS (SELECT *, count(*) OVER (PARTITION BY kx, ky, kz) AS n FROM new) SELECT idx FROM c WHERE n > 1 AND NOT EXISTS (SELECT 1 FROM old o WHERE (o.kx, o.ky, o.kz) = (c.kx, c.ky, c.kz))", "keyed")
def st2(spark, sf):
    old, new = snapshots(spark, sf)
    return O.new_voxel_points(old, new, 1).select("idx")


@query("ST1_switch_buffers", CHANGE + "SELECT 'previous' AS buffer, count(*) AS n FROM new", "keyed")
def st1(spark, sf):
    """After a switch the new keys are the previous generation and the current one is empty."""
    from ..streaming.state import switch_buffers

    _, new = snapshots(spark, sf)
    current, previous = switch_buffers(new, snapshots(spark, sf)[0])
    both = previous.select(F.lit("previous").alias("buffer")).union(current.select(F.lit("current")))
    return both.groupBy("buffer").agg(F.count("*").alias("n"))


@query("X4_delete_voxel", "SELECT idx FROM keys WHERE (kx, ky, kz) NOT IN (SELECT (kx, ky, kz) FROM keys WHERE idx = 50)", "keys")
def x4(spark, sf):
    k = indexed(spark, sf)
    return O.without_voxel(k, k.filter("idx = 50")).select("idx")


@query("ST5_incremental_insert", "SELECT CAST(floor(x / 20) AS BIGINT) AS kx, CAST(floor(y / 5) AS BIGINT) AS ky, CAST(floor(z / 24) AS BIGINT) AS kz, count(*) AS n FROM keyed GROUP BY 1, 2, 3", "keyed")
def st5(spark, sf):
    """Voxel counts after a stream has inserted all points in order of files; the sink keeps each voxel's last state."""
    from ..sources.scratch import scratch
    from ..streaming.state import voxel_counts

    k = keyed(spark, sf).select(F.col("x") / 20, F.col("y") / 5, F.col("z") / 24).toDF("x", "y", "z")
    path = scratch(spark, "stream")
    k.repartition(4).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(k.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/in")
    counts = voxel_counts(stream, (0.0, 0.0, 0.0), 1.0)
    sink = counts.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda df, epoch: df.withColumn("epoch", F.lit(epoch)).write.mode("append").parquet(f"{path}/out"))
    sink.start().awaitTermination()
    out = spark.read.parquet(f"{path}/out")
    return out.groupBy("kx", "ky", "kz").agg(F.max("n").alias("n"))


@query("ST4_background_stream")
def st4(spark, sf):
    """Each user's value as a pixel, events as frames: running mean, variance and foreground flag."""
    from ..sources.scratch import scratch
    from ..streaming.state import background

    e = table(spark, sf, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 16).alias("row"), (F.col("user_id") % 8).alias("col"), "value")
    path = scratch(spark, "background")
    e.repartitionByRange(3, "seq").write.parquet(f"{path}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    q = background(stream, None).writeStream.outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(lambda df, epoch: df.write.mode("append").parquet(f"{path}/out"))
    q.start().awaitTermination()
    return spark.read.parquet(f"{path}/out").groupBy("row", "col").agg(F.count("*").alias("n"), F.sum(F.col("fg").cast("long")).alias("n_fg"))
