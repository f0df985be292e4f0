"""Text formats as tables of tagged lines: OBJ meshes, polar depth maps, vertex-slice maps, ASCII PCD and PLY, label maps.

Every reader is a distributed line scan. A line's ordinal among the lines of its tag is the count in earlier splits plus its
rank in its own split, so files of any size are read in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Record tags and their number of values.
OBJ_TAGS = {"v": 3, "vt": 2, "vn": 3, "vdot": 3}
DEPTH_TAGS = {"dd": 6, "bb": 6, "mm": 6, "tg": 9}
SLICE_TAGS = {"vsm": 6, "vsl": 6}


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start (of the split), seq (within it), line."""
    t = spark.read.text(path)
    return t.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("seq"), F.trim(F.col("value")).alias("line"))


def tagged(spark: SparkSession, path: str) -> DataFrame:
    """file, tag, idx (ordinal of the line among those of its tag, from 0), parts (the values as text)."""
    t = lines(spark, path).filter("line <> '' and not startswith(line, '#')")
    p = F.split("line", r"\s+")
    t = t.select("file", "start", "seq", p[0].alias("tag"), F.slice(p, 2, 1_000_000).alias("parts"))
    w = Window.partitionBy("file", "tag").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = t.groupBy("file", "tag", "start").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("file", "tag", "start").orderBy("seq")) - 1
    return t.withColumn("rank", rank).join(before, ["file", "tag", "start"]).select("file", "tag", (F.col("before") + F.col("rank")).cast("long").alias("idx"), "parts")


def number(parts: Column, i: int) -> Column:
    return F.get(parts, F.lit(i)).cast("double")


def records(t: DataFrame, tag: str, names: Sequence[str]) -> DataFrame:
    return t.filter(F.col("tag") == tag).select("file", "idx", *(number(F.col("parts"), i).alias(n) for i, n in enumerate(names)))


def read_vertices(t: DataFrame) -> DataFrame:
    return records(t, "v", ["x", "y", "z"])


def split_origin(vertices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first vertex of each file (the origin), and the others, counted from 0 again."""
    return vertices.filter("idx = 0"), vertices.filter("idx > 0").withColumn("idx", F.col("idx") - 1)


def face_corners(parts: Column) -> Column:
    """v, vt, vn (1-based, -1 where missing) of the corners of a face line; signs are dropped."""

    def corner(p: Column) -> Column:
        q = F.split(p, "/")
        at = lambda i: F.coalesce(F.abs(F.get(q, F.lit(i)).try_cast("long")), F.lit(-1).cast("long"))
        return F.struct(at(0).alias("v"), at(1).alias("vt"), at(2).alias("vn"))

    return F.transform(parts, corner)


def read_faces(t: DataFrame) -> DataFrame:
    return t.filter("tag = 'f'").select("file", F.col("idx").alias("face_id"), face_corners(F.col("parts")).alias("corners"))


def triangles(faces: DataFrame) -> DataFrame:
    """face_id, v0, v1, v2 counted from 0; faces of another size are left out."""
    return faces.filter(F.size("corners") == 3).select("face_id", *(F.expr(f"corners[{i}].v - 1").alias(f"v{i}") for i in range(3)))


def read_cloud_with_normals(t: DataFrame) -> DataFrame:
    """Points and unit normals by ordinal, curvature 1."""
    n = records(t, "vn", ["a", "b", "c"])
    length = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b") + F.col("c") * F.col("c"))
    n = n.select("file", "idx", *((F.col(c) / length).alias(m) for c, m in (("a", "nx"), ("b", "ny"), ("c", "nz"))), F.lit(1.0).alias("curvature"))
    return read_vertices(t).join(n, ["file", "idx"])


def write_lines(df: DataFrame, path: str, order: Sequence[str], whole: Sequence[str] = ()) -> None:
    """df.line as text in order: range partitions become files whose names sort alike. Lines equal in `whole`, the first columns of order, share a file."""
    df.repartitionByRange(*(whole or order)).sortWithinPartitions(*order).select("line").write.text(path)


def obj_line(tag: str, cols: Sequence[str], digits: int = 17) -> Column:
    return F.concat_ws(" ", F.lit(tag), *(F.col(c).cast("string") for c in cols))


def write_obj(path: str, vertices: DataFrame, faces: DataFrame | None = None, colours: bool = False) -> None:
    """v lines (with r, g, b scaled by 1/255 if asked), then f lines, 1-based."""
    cols = ["x", "y", "z"]
    if colours:
        vertices = vertices.withColumns({c: F.col(c) / 255.0 for c in ("r", "g", "b")})
        cols += ["r", "g", "b"]
    out = vertices.select(F.lit(0).alias("kind"), F.col("idx").alias("no"), obj_line("v", cols).alias("line"))
    if faces is not None:
        f = faces.select(F.lit(1).alias("kind"), F.col("face_id").alias("no"), F.concat_ws(" ", F.lit("f"), *((F.col(f"v{i}") + 1).cast("string") for i in range(3))).alias("line"))
        out = out.union(f)
    write_lines(out, path, ["kind", "no"])


def read_one_table(spark: SparkSession, path: str, tag: str, n: int) -> DataFrame:
    return records(tagged(spark, path), tag, [f"c{i}" for i in range(n)])


def read_ascii_cloud(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """idx and the fields of ASCII PCD or PLY files, by suffix unless named. Headers are short and read first."""
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind not in ("pcd", "ply"):
        raise ValueError(f"unknown cloud format: {kind}")
    t = lines(spark, path)
    if kind == "pcd":
        head = t.filter("startswith(line, 'FIELDS ')").first()
        if head is None:
            raise ValueError("no FIELDS line")
        names = head["line"].split()[1:]
        body = t.filter(r"line rlike '^[-+.0-9nN]'")
    else:
        names = [r["line"].split()[-1] for r in t.filter("line rlike '^property (float|double|int|uchar|uint|short|ushort|char|float32|float64)'").orderBy("start", "seq").collect()]
        body = t.filter(r"line rlike '^[-+.0-9nN]'")
    p = F.split("line", r"\s+")
    body = body.filter(F.size(p) >= len(names))
    w = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = body.groupBy("file", "start").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).drop("n")
    rank = F.row_number().over(Window.partitionBy("file", "start").orderBy("seq")) - 1
    body = body.withColumn("rank", rank).join(before, ["file", "start"])
    return body.select((F.col("before") + F.col("rank")).cast("long").alias("idx"), *(number(p, i).alias(n) for i, n in enumerate(names)))


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """path, label of white-space separated lines."""
    p = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(p[0].alias("path"), p[1].alias("label"))


def write_labels(df: DataFrame, path: str, sep: str = "\t") -> None:
    df.select("path", "label").write.csv(path, sep=sep)


def read_corner_points(spark: SparkSession, path: str) -> DataFrame:
    """corner, x, y, z: the twelve numbers of a decal's corners."""
    t = spark.read.text(path, wholetext=True).select(F.filter(F.split(F.trim("value"), r"\s+"), lambda x: x != "").alias("v"))
    c = t.select("v", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("corner"))
    return c.select(F.col("corner").cast("long").alias("corner"), *(F.get("v", F.col("corner") * 3 + i).cast("double").alias(a) for i, a in enumerate("xyz")))
