"""Registration of queries with their SQL, and the fixtures both engines share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The box and resolution of the octree queries: 32 voxels a side from (-1.6, -1.6, -1.6).
ORIGIN, RES, DEPTH = (-1.6, -1.6, -1.6), 0.1, 5

#: Fixture tables in SQL: the small cloud with normals, keyed large clouds, and the voxel keys of the small cloud.
FIXTURES = {
    "cloud": "SELECT vec_id AS idx, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, CAST(label AS BIGINT) AS label FROM embeddings",
    "normals": "SELECT idx, a / n AS nx, b / n AS ny, c / n AS nz FROM (SELECT idx, a, b, c, sqrt(a * a + b * b + c * c) AS n FROM (SELECT vec_id AS idx, CAST(embedding[4] AS DOUBLE) AS a, CAST(embedding[5] AS DOUBLE) AS b, CAST(embedding[6] AS DOUBLE) AS c FROM embeddings))",
    "big": "SELECT l_quantity AS x, l_extendedprice / 1000 AS y, l_discount * 100 AS z FROM lineitem",
    "keyed": "SELECT event_id AS idx, CAST(user_id AS DOUBLE) AS x, value AS y, CAST(epoch_us(ts) / 3600000000 AS DOUBLE) AS z, ts FROM events",
    "keys": "SELECT *, CAST(floor((x + 1.6) / 0.1) AS BIGINT) AS kx, CAST(floor((y + 1.6) / 0.1) AS BIGINT) AS ky, CAST(floor((z + 1.6) / 0.1) AS BIGINT) AS kz FROM cloud",
}
_NEEDS = {"keys": ["cloud"]}


def with_fixtures(sql: str, *names: str) -> str:
    order: list[str] = []
    for n in names:
        for m in [*_NEEDS.get(n, []), n]:
            if m not in order:
                order.append(m)
    ctes = ", ".join(f"{n} AS ({FIXTURES[n]})" for n in order)
    sql = sql.strip()
    if sql.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {ctes}, {sql[len('WITH RECURSIVE') :].lstrip()}"
    if sql.upper().startswith("WITH "):
        return f"WITH {ctes}, {sql[5:]}"
    return f"WITH {ctes} {sql}"


def query(name: str, sql: str | None = None, fixtures: str = "") -> Callable:
    """Register a query (spark, sf_dir) -> DataFrame and, where SQL can express it, its SQL over the driver's views."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        assert name not in QUERIES, name
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = with_fixtures(sql, *fixtures.split()) if fixtures else sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("idx"), *(F.get("embedding", F.lit(i)).cast("double").alias(a) for i, a in enumerate("xyz")), F.col("label").cast("long").alias("label"))


def normals(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = [F.get("embedding", F.lit(i)).cast("double") for i in (3, 4, 5)]
    n = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("idx"), *((c / n).alias(a) for c, a in zip(v, ("nx", "ny", "nz"), strict=True)))


def big(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"), (F.col("l_discount") * 100).alias("z"))


def keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = (F.unix_micros(F.col("ts").cast("timestamp")) / 3600000000).cast("double")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("idx"), F.col("user_id").cast("double").alias("x"), F.col("value").alias("y"), hours.alias("z"), "ts")


def rounded(df: DataFrame, digits: int = 6, *names: str) -> DataFrame:
    """Doubles rounded for comparison; -0.0 becomes 0.0."""
    chosen = set(names) or {n for n, t in df.dtypes if t == "double"}
    return df.select(*((F.round(F.col(n), digits) + 0.0).alias(n) if n in chosen else F.col(n) for n in df.columns))
