"""Every query with SQL gives the same rows in both engines; the others give rows."""

import glob
import os

import duckdb
import pytest

from cloudloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def text(v):
    return "null" if v is None else repr(v + 0.0) if isinstance(v, float) else str(v)


def table(rows, names):
    order = sorted(names)
    return sorted(tuple(text(r[names.index(n)]) for n in order) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_rows_as_sql(spark, con, name):
    df = catalog.QUERIES[name](spark, SF)
    rel = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert table([tuple(r) for r in df.collect()], df.columns) == table(rel.fetchall(), list(rel.columns))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_gives_rows(spark, name):
    assert catalog.QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())


def test_sort_keeps_every_row(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    pos = [r["pos"] for r in catalog.QUERIES["T1_sort_by_distance"](spark, SF).collect()]
    assert n > 100 and sorted(pos) == list(range(1, n + 1))


def test_embeddings_are_compared_in_all_dimensions(spark, tmp_path):
    """Rows that differ in the last dimension only are not alike."""
    rows = [(i, [0.0] * 63 + [float(i % 11 * 100 + i // 11 / 100)], 0) for i in range(110)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES["P9_custom_representation_knn"](spark, str(tmp_path)).filter("qidx = 50 and rank = 2").collect()
    assert got[0]["idx"] in (39, 61)
    assert len(catalog.QUERIES["I21_pose_clusters"](spark, str(tmp_path)).collect()) == 11


def test_points_and_normals_share_a_file(spark, tmp_path):
    """Files begin between two points, not between a point and its normal."""
    rows = [(i, [float(i + j) for j in range(1, 7)], 0) for i in range(333)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small tables go to several files, too
    try:
        got = sorted(catalog.QUERIES["S6_cloud_with_normals"](spark, str(tmp_path)).collect(), key=lambda r: r["idx"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [(r["idx"], r["x"]) for r in got] == [(i, i + 1.0) for i in range(333)]
    n = [(i + 4) / ((i + 4) ** 2 + (i + 5) ** 2 + (i + 6) ** 2) ** 0.5 for i in range(333)]
    assert all(abs(r["nx"] - n[r["idx"]]) < 1e-6 for r in got)
