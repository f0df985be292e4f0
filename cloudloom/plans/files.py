"""Queries on sources and sinks: each writes what it reads, in the session's shared folder."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import cloud as C
from ..sources import binary as B
from ..sources import text as X
from ..sources.scratch import scratch
from . import shapes
from .registry import cloud, normals, query, rounded, table


def obj_cloud(spark, sf):
    path = scratch(spark, "obj")
    X.write_obj(path, cloud(spark, sf))
    return path


def place(df):
    """Vertices of a multi-part sink, numbered over its files in order of their names."""
    from pyspark.sql import Window

    n = df.groupBy("file").agg(F.count("*").alias("n"))
    off = n.withColumn("off", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    return df.join(off, "file").withColumn("idx", F.col("idx") + F.col("off")).drop("file", "off")


@query("S1_obj_read", "SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, x, y, z FROM cloud", "cloud")
def s1(spark, sf):
    return place(X.read_vertices(X.tagged(spark, obj_cloud(spark, sf)))).select("idx", "x", "y", "z")


@query("S2_obj_faces", shapes.MESH + "SELECT face_id, v0, v1, v2 FROM faces")
def s2(spark, sf):
    v, f = shapes.grid(spark)
    path = scratch(spark, "faces")
    X.write_obj(path, v, f)
    faces = X.read_faces(X.tagged(spark, path)).withColumnRenamed("face_id", "idx")
    return X.triangles(place(faces).withColumnRenamed("idx", "face_id"))


@query("S2_face_corner_forms", "SELECT * FROM (VALUES (0, 1, 2, 3), (1, 4, -1, -1), (2, 5, -1, 6), (3, 7, 8, -1)) t(corner, v, vt, vn)")
def s2b(spark, sf):
    p = spark.range(1).select(F.split(F.lit("1/2/3 4 5//6 7/8"), " ").alias("parts"))
    c = p.select(F.posexplode(X.face_corners(F.col("parts"))).alias("corner", "c"))
    return c.select("corner", *(F.col(f"c.{k}").cast("int").alias(k) for k in ("v", "vt", "vn")))


@query("S3_texture_tuples", "SELECT idx, round(x, 6) AS u, round(y, 6) AS v FROM cloud WHERE idx >= 0", "cloud")
def s3(spark, sf):
    """vt lines keep their data."""
    path = scratch(spark, "vt")
    c = cloud(spark, sf)
    X.write_lines(c.select("idx", X.obj_line("vt", ["x", "y"]).alias("line")), path, ["idx"])
    t = place(X.records(X.tagged(spark, path), "vt", ["u", "v"]))
    low = F.broadcast(c.agg(F.min("idx").alias("lo")))  # one row
    return rounded(t.join(low).select((F.col("idx") + F.col("lo")).alias("idx"), "u", "v"))


@query("S4_first_vertex_is_origin", "SELECT CAST(1 AS BIGINT) AS n_origin, count(*) - 1 AS n_rest FROM cloud", "cloud")
def s4(spark, sf):
    path = scratch(spark, "one")
    c = cloud(spark, sf)
    c.select("idx", X.obj_line("v", ["x", "y", "z"]).alias("line")).coalesce(1).sortWithinPartitions("idx").select("line").write.text(path)
    first, rest = X.split_origin(X.read_vertices(X.tagged(spark, path)))
    both = first.select(F.lit(1).alias("o")).union(rest.select(F.lit(0)))
    return both.agg(F.sum("o").alias("n_origin"), F.sum(1 - F.col("o")).alias("n_rest"))


@query("S5_obj_lines", "SELECT count(*) AS n FROM cloud", "cloud")
def s5(spark, sf):
    return spark.read.text(obj_cloud(spark, sf)).filter("startswith(value, 'v ')").agg(F.count("*").alias("n"))


@query("S6_cloud_with_normals", "SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, x, y, z, round(nx, 6) AS nx, round(ny, 6) AS ny, round(nz, 6) AS nz, 1.0::DOUBLE AS curvature FROM cloud JOIN normals USING (idx)", "cloud normals")
def s6(spark, sf):
    path = scratch(spark, "vn")
    j = C.zip_columns(cloud(spark, sf), normals(spark, sf))
    two = F.array(F.struct(F.lit(0).alias("k"), X.obj_line("v", ["x", "y", "z"]).alias("line")), F.struct(F.lit(1).alias("k"), X.obj_line("vn", ["nx", "ny", "nz"]).alias("line")))
    # points and normals meet by file and ordinal, so a point and its normal go to one file
    X.write_lines(j.select("idx", F.explode(two).alias("s")).select("idx", "s.k", "s.line"), path, ["idx", "k"], ["idx"])
    return rounded(place(X.read_cloud_with_normals(X.tagged(spark, path))), 6, "nx", "ny", "nz").select("idx", "x", "y", "z", "nx", "ny", "nz", "curvature")


@query("S7_coloured_points", "SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, round(idx % 256 / 255.0, 6) AS r FROM cloud", "cloud")
def s7(spark, sf):
    path = scratch(spark, "rgb")
    i = F.col("idx")
    X.write_obj(path, cloud(spark, sf).select("*", (i % 256).alias("r"), (i * 3 % 256).alias("g"), (i * 5 % 256).alias("b")), colours=True)
    return rounded(place(X.records(X.tagged(spark, path), "v", ["x", "y", "z", "r"])).select("idx", "r"))


@query("S8_depth_map", "SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, x AS c0, y AS c1, z AS c2, CAST(label AS DOUBLE) AS c3, 0.5::DOUBLE AS c4, 0.25::DOUBLE AS c5 FROM cloud", "cloud")
def s8(spark, sf):
    path = scratch(spark, "dd")
    c = cloud(spark, sf).withColumns({"s": F.lit(0.5), "t": F.lit(0.25)})
    X.write_lines(c.select("idx", X.obj_line("dd", ["x", "y", "z", "label", "s", "t"]).alias("line")), path, ["idx"])
    return place(X.read_one_table(spark, path, "dd", 6)).select("idx", *(f"c{i}" for i in range(6)))


@query("S9_vertex_slice_map", "SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, x AS c0, y AS c1, z AS c2, x AS c3, y AS c4, z AS c5 FROM cloud", "cloud")
def s9(spark, sf):
    path = scratch(spark, "vsm")
    X.write_lines(cloud(spark, sf).select("idx", X.obj_line("vsm", ["x", "y", "z", "x", "y", "z"]).alias("line")), path, ["idx"])
    return place(X.read_one_table(spark, path, "vsm", 6)).select("idx", *(f"c{i}" for i in range(6)))


@query("S10_from_and_to_array", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 1.0::DOUBLE, 2.0::DOUBLE, 3.0::DOUBLE), (1, 4.0, 5.0, 6.0)) t(idx, x, y, z)")
def s10(spark, sf):
    from ..sources.arrays import from_array, to_array

    return from_array(spark, to_array(from_array(spark, np.array([[1, 2, 3], [4, 5, 6]], dtype=np.float32))))


@query("S11_normals_from_array", "SELECT * FROM (VALUES (CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE, 1.0::DOUBLE, 0.5::DOUBLE)) t(idx, nx, ny, nz, curvature)")
def s11(spark, sf):
    from ..sources.arrays import from_array

    return from_array(spark, np.array([[0, 0, 1, 0.5]], dtype=np.float32), ("nx", "ny", "nz", "curvature"))


PCD_HEAD = ["# .PCD v0.7", "VERSION 0.7", "FIELDS x y z", "SIZE 8 8 8", "TYPE F F F", "DATA ascii"]


@query("S13_pcd_by_suffix", "SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, x, y, z FROM cloud", "cloud")
def s13(spark, sf):
    path = scratch(spark, "pcd")
    head = spark.createDataFrame([(i - len(PCD_HEAD), line) for i, line in enumerate(PCD_HEAD)], "idx long, line string")
    body = cloud(spark, sf).select("idx", F.concat_ws(" ", *(F.col(a).cast("string") for a in "xyz")).alias("line"))
    head.union(body).coalesce(1).sortWithinPartitions("idx").select("line").write.text(f"{path}/cloud.pcd")
    return X.read_ascii_cloud(spark, f"{path}/cloud.pcd")


PLY_HEAD = ["ply", "format ascii 1.0", "element vertex 0", "property double x", "property double y", "property double z", "end_header"]


@query("S22_ply_read", "SELECT row_number() OVER (ORDER BY idx) - 1 AS idx, x, y, z FROM cloud", "cloud")
def s22(spark, sf):
    path = scratch(spark, "ply")
    head = spark.createDataFrame([(i - len(PLY_HEAD), line) for i, line in enumerate(PLY_HEAD)], "idx long, line string")
    body = cloud(spark, sf).select("idx", F.concat_ws(" ", *(F.col(a).cast("string") for a in "xyz")).alias("line"))
    head.union(body).coalesce(1).sortWithinPartitions("idx").select("line").write.text(f"{path}/cloud.ply")
    return X.read_ascii_cloud(spark, f"{path}/cloud.ply")


LAYOUT = [("x", 0, 8, 1), ("y", 8, 8, 1), ("z", 16, 8, 1), ("label", 28, 5, 1)]


@query("S14_blob_round_trip", "SELECT idx, x, y, z, CAST(label AS INT) AS label FROM cloud", "cloud")
def s14(spark, sf):
    return B.from_blobs(B.to_blobs(cloud(spark, sf), LAYOUT, 32), LAYOUT, 32)


@query("S14_blob_missing_field", "SELECT idx, z FROM cloud", "cloud")
def s14b(spark, sf):
    """Fields that the blob lacks are left out."""
    return B.from_blobs(B.to_blobs(cloud(spark, sf), LAYOUT, 32), LAYOUT, 32, ["z", "intensity"])


@query("C29_swapped_bytes", "SELECT idx, x, CAST(label AS INT) AS label FROM cloud", "cloud")
def c29(spark, sf):
    """Every scalar's bytes reversed, twice."""
    once = B.from_blobs(B.to_blobs(cloud(spark, sf), LAYOUT, 32), LAYOUT, 32, swap=True)
    return B.from_blobs(B.to_blobs(once, LAYOUT, 32), LAYOUT, 32, ["x", "label"], swap=True)


@query("S15_cloud_to_image", "SELECT idx // 25 AS row, idx % 25 AS col, (idx * 65793 % 16777216) >> 16 & 255 AS r, (idx * 65793 % 16777216) >> 8 & 255 AS g, (idx * 65793 % 16777216) & 255 AS b FROM cloud", "cloud")
def s15(spark, sf):
    from ..functions.geometry import unpack_rgb

    c = C.organized(cloud(spark, sf), 25).withColumn("rgb", F.col("idx") * 65793 % 16777216)
    return c.select("row", "col", *(v.alias(n) for n, v in zip("rgb", unpack_rgb(F.col("rgb")), strict=True)))


@query("S16_matrix_view", "SELECT idx AS i, CAST(j AS BIGINT) AS j, CASE j WHEN 0 THEN x WHEN 1 THEN y ELSE z END AS v FROM cloud, range(3) t(j)", "cloud")
def s16(spark, sf):
    return B.matrix_cells(cloud(spark, sf), ["x", "y", "z"])


@query("S16_matrix_back", "SELECT idx, x, y, z FROM cloud", "cloud")
def s16b(spark, sf):
    return B.from_cells(B.matrix_cells(cloud(spark, sf), ["x", "y", "z"]), ["x", "y", "z"])


@query("S17_matrix_file", "SELECT idx AS i, CAST(j AS BIGINT) AS j, CASE j WHEN 0 THEN x WHEN 1 THEN y ELSE z END AS v FROM cloud, range(3) t(j)", "cloud")
def s17(spark, sf):
    path = scratch(spark, "matrix")
    B.save_matrix(B.matrix_cells(cloud(spark, sf), ["x", "y", "z"]), path)
    return B.load_matrix(spark, path)


def _write_images(spark, name, channels):
    """PNG files written by tasks through Spark's binary rows, so that no local path is needed."""
    path = scratch(spark, name)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(hadoop(path))
    for k in range(2):
        a = (np.arange(12 * 16 * channels).reshape(12, 16, channels) * (k + 3) % 256).astype(np.uint8)
        out = fs.create(hadoop(f"{path}/img{k}.png"))
        out.write(bytearray(B.encode_png(a)))
        out.close()
    return path


@query("S18_image_folder", "SELECT 'img' || k || '.png' AS name, CAST(i // 16 AS BIGINT) AS row, CAST(i % 16 AS BIGINT) AS col, CAST((i * 3) * (k + 3) % 256 AS BIGINT) AS c0, CAST((i * 3 + 2) * (k + 3) % 256 AS BIGINT) AS c2 FROM range(192) t(i), range(2) u(k)")
def s18(spark, sf):
    p = B.read_images(spark, _write_images(spark, "images", 3))
    return p.select(F.substring_index("path", "/", -1).alias("name"), "row", "col", "c0", "c2")


@query("S21_decal_inputs", "SELECT CAST(k AS BIGINT) AS corner, CAST(3 * k AS DOUBLE) AS x, CAST(3 * k + 1 AS DOUBLE) AS y, CAST(3 * k + 2 AS DOUBLE) AS z, CAST(384 AS BIGINT) AS n_decal FROM range(4) t(k)")
def s21(spark, sf):
    path = scratch(spark, "corners")
    spark.createDataFrame([(" ".join(map(str, range(12))),)], "value string").coalesce(1).write.text(path)
    decal = B.decal_channels(B.read_images(spark, _write_images(spark, "decal", 4)))
    n = F.broadcast(decal.agg(F.count("*").alias("n_decal")))  # one row
    return X.read_corner_points(spark, f"{path}/*.txt").join(n)


@query("S19_label_mapping", "SELECT r_name AS label, string_agg(n_name, ',' ORDER BY n_name) AS paths FROM (SELECT replace(n_name, ' ', '_') AS n_name, replace(r_name, ' ', '_') AS r_name FROM nation JOIN region ON n_regionkey = r_regionkey) GROUP BY r_name")
def s19(spark, sf):
    path = scratch(spark, "mapping")
    n = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    n.select(F.concat_ws("   ", F.translate("n_name", " ", "_"), F.translate("r_name", " ", "_"))).write.text(path)
    return X.read_mapping(spark, path).groupBy("label").agg(F.concat_ws(",", F.sort_array(F.collect_list("path"))).alias("paths"))


@query("S20_label_sink", "SELECT n_name AS path, CAST(n_regionkey AS VARCHAR) AS label FROM nation")
def s20(spark, sf):
    path = scratch(spark, "labels")
    X.write_labels(table(spark, sf, "nation").select(F.col("n_name").alias("path"), F.col("n_regionkey").alias("label")), path)
    return spark.read.schema("path string, label string").csv(path, sep="\t")


# extension points
@query("U1_custom_representation", "SELECT idx, round(x * 2 + y, 6) AS f FROM cloud", "cloud")
def u1(spark, sf):
    @F.pandas_udf(T.DoubleType())
    def feature(x: pd.Series, y: pd.Series) -> pd.Series:
        return x * 2 + y

    return rounded(cloud(spark, sf).select("idx", feature("x", "y").alias("f")))


@query("U2_custom_leaf_state", "SELECT kx, ky, kz, max(x) - min(x) AS spread FROM keys GROUP BY 1, 2, 3", "keys")
def u2(spark, sf):
    from ..operators import octree as O
    from .registry import ORIGIN, RES

    @F.pandas_udf(T.DoubleType())
    def spread(x: pd.Series) -> float:
        return float(x.max() - x.min())

    return O.indexed(cloud(spark, sf), ORIGIN, RES).groupBy(*O.KEYS).agg(spread("x").alias("spread"))


@query("U3_accumulators_by_field", "SELECT label, round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z), 6) AS z, CAST(max(idx) AS BIGINT) AS idx FROM cloud GROUP BY label", "cloud")
def u3(spark, sf):
    from ..functions.accumulators import accumulate

    return rounded(accumulate(cloud(spark, sf), ["label"], {"idx": F.max}))


@query("U5_custom_filter", "SELECT idx FROM cloud WHERE x > y", "cloud")
def u5(spark, sf):
    return cloud(spark, sf).transform(lambda df: df.filter("x > y")).select("idx")


@query("U6_custom_reconstruction", "SELECT label, count(*) AS n FROM cloud GROUP BY label", "cloud")
def u6(spark, sf):
    def faces(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"label": [g["label"].iloc[0]], "n": [len(g)]})

    return cloud(spark, sf).groupBy("label").applyInPandas(faces, "label long, n long")


@query("U7_index_strategy", "SELECT idx FROM cloud WHERE x * x + y * y + z * z <= 0.01", "cloud")
def u7(spark, sf):
    from ..operators import search

    strategies = {"grid": search.within}
    q = spark.createDataFrame([(0, 0.0, 0.0, 0.0)], "qidx long, x double, y double, z double")
    return strategies["grid"](cloud(spark, sf), q, 0.1).select("idx")
