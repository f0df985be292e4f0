"""Cloud operators: selections, projections, statistics, set operations. Every function is a lazy DataFrame transformation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G


# projections
def copy_fields(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The columns that df and the target type have in common, in the target's order."""
    have = set(df.columns)
    return df.select(*(n for n in names if n in have))


def gather(df: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of df by a list of (pos, idx): duplicates stay, pos keeps the order."""
    return wanted.join(df, "idx").select("pos", *df.columns)


def at_pixel(df: DataFrame, width: int, row: int, col: int) -> DataFrame:
    return df.filter(F.col("idx") == row * width + col)


def organized(df: DataFrame, width: int) -> DataFrame:
    return df.withColumns({"row": F.floor(F.col("idx") / width).cast("long"), "col": F.pmod("idx", F.lit(width)).cast("long")})


def border_index(p: Column, n: int, mode: str) -> Column:
    """The source index of position p on an axis of n cells; null where a constant border is asked for."""
    if mode == "constant":
        return F.when((p >= 0) & (p < n), p)
    if mode == "replicate":
        return F.least(F.greatest(p, F.lit(0)), F.lit(n - 1))
    if mode == "wrap":
        return F.pmod(p, F.lit(n))
    if mode == "reflect":
        q = F.pmod(p, F.lit(2 * n))
        return F.when(q < n, q).otherwise(2 * n - 1 - q)
    if mode == "reflect_101":
        q = F.pmod(p, F.lit(max(1, 2 * n - 2)))
        return F.when(q < n, q).otherwise(2 * n - 2 - q)
    raise ValueError(mode)


def padded(df: DataFrame, rows: int, cols: int, top: int, bottom: int, left: int, right: int, mode: str, values: Sequence[str], fill: float | None = None) -> DataFrame:
    """An organized table (row, col, values) with a border; row and col count from 0 again."""
    grid = df.sparkSession.range((rows + top + bottom) * (cols + left + right)).select(
        F.floor(F.col("id") / (cols + left + right)).cast("long").alias("row"), F.pmod("id", F.lit(cols + left + right)).cast("long").alias("col")
    )
    grid = grid.withColumns({"src_row": border_index(F.col("row") - top, rows, mode), "src_col": border_index(F.col("col") - left, cols, mode)})
    src = df.select(F.col("row").alias("src_row"), F.col("col").alias("src_col"), *values)
    out = grid.join(src, ["src_row", "src_col"], "left").select("row", "col", *values)
    return out.fillna(fill, subset=list(values)) if fill is not None else out


def zip_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Columns of two clouds side by side by idx; their keys must agree."""
    extra = [c for c in b.columns if c not in set(a.columns)]
    return a.join(b.select("idx", *extra), "idx")


def vector(cols: Sequence[str], weights: Sequence[float] | None = None) -> Column:
    v = F.array(*(F.col(c).cast("double") for c in cols))
    return F.zip_with(v, F.array(*map(F.lit, map(float, weights))), lambda a, b: a * b) if weights else v


def reindexed(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """idx counted from 0 in the given order. The offsets of range partitions are added, so no task sees all rows."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id())
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"))
    offsets = sizes.withColumn("__off", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    rank = F.row_number().over(Window.partitionBy("__part").orderBy(*order)) - 1
    return ranged.withColumn("__rank", rank).join(offsets, "__part").withColumn("idx", (F.col("__off") + F.col("__rank")).cast("long")).drop("__part", "__rank", "__off")


# filters
def drop_non_finite(df: DataFrame, cols: Sequence[str] = G.AXES) -> DataFrame:
    return df.filter(G.finite(*cols))


def in_box(df: DataFrame, low: Sequence[float], high: Sequence[float]) -> DataFrame:
    """Inclusive on both ends; non-finite points fail."""
    cond = G.finite(*G.AXES)
    for a, lo, hi in zip(G.AXES, low, high, strict=True):
        cond = cond & F.col(a).between(lo, hi)
    return df.filter(cond)


def within_half_open(low: Sequence[float], high: Sequence[float]) -> Column:
    out = F.lit(True)
    for a, lo, hi in zip(G.AXES, low, high, strict=True):
        out = out & (F.col(a) >= lo) & (F.col(a) < hi)
    return out


def removed(df: DataFrame, kept: DataFrame) -> DataFrame:
    return df.join(kept.select("idx"), "idx", "left_anti")


# aggregations
def bounds(df: DataFrame) -> DataFrame:
    return drop_non_finite(df).agg(*(f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in G.AXES))


def centroid(df: DataFrame, cols: Sequence[str] = G.AXES) -> DataFrame:
    return drop_non_finite(df, cols).agg(F.count("*").alias("n"), *(F.avg(c).alias("c" + c) for c in cols))


PAIRS = (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z"))


def scatter(df: DataFrame, about: Sequence[float] | None = None, normalised: bool = False) -> DataFrame:
    """Second moments: about a point (sums, or means if normalised), or about the origin (means) if none is given."""
    df = drop_non_finite(df)
    aggs = []
    for p, q in PAIRS:
        a, b = (F.col(p), F.col(q)) if about is None else (F.col(p) - about["xyz".index(p)], F.col(q) - about["xyz".index(q)])
        f = F.avg if normalised or about is None else F.sum
        aggs.append(f(a * b).alias(f"s{p}{q}"))
    return df.agg(F.count("*").alias("n"), *aggs)


def covariance(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Centroid and normalised covariance in one pass."""
    return drop_non_finite(df).groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(a).alias("c" + a) for a in G.AXES), *(F.covar_pop(p, q).alias(f"s{p}{q}") for p, q in PAIRS))


def majority(df: DataFrame, by: Sequence[str], label: str) -> DataFrame:
    """The most frequent label of each group, the smallest on ties."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    return counts.groupBy(*by).agg(F.min_by(label, F.struct(-F.col("n"), F.col(label))).alias(label), F.max("n").alias("n"))


def farthest(df: DataFrame, pivot: Sequence[float]) -> DataFrame:
    """The finite point farthest from the pivot, first on ties."""
    d = G.sq_dist(G.points(), [F.lit(float(p)) for p in pivot])
    return drop_non_finite(df).agg(F.min_by(F.struct("idx", *G.AXES, d.alias("d2")), F.struct(-d, F.col("idx"))).alias("p")).select("p.*")


def principal_axes(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Eigenvalues l0 <= l1 <= l2 of each group's covariance and the unit eigenvectors of the least and the greatest."""
    c = covariance(df, by)
    m = [[F.col("s" + "".join(sorted(p + q))) for q in "xyz"] for p in "xyz"]
    roots = G.symmetric_roots(m)
    c = c.withColumns({f"l{i}": r for i, r in enumerate(roots)})
    out = c
    for i in (0, 2):
        out = out.withColumns({f"e{i}{a}": e for a, e in zip("xyz", G.eigenvector(m, F.col(f"l{i}")), strict=True)})
    return out


# windows and polygons
def arc_length(df: DataFrame, by: Sequence[str], order: str = "idx") -> DataFrame:
    """Running length s of each path and its whole length."""
    w = Window.partitionBy(*by).orderBy(order)
    step = F.sqrt(G.sq_dist(G.points(), [F.lag(a).over(w) for a in G.AXES]))
    df = df.withColumn("s", F.coalesce(step, F.lit(0.0)))
    df = df.withColumn("s", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("total", F.max("s").over(Window.partitionBy(*by)))


def perimeter(df: DataFrame, by: Sequence[str], order: str = "idx") -> DataFrame:
    """Length of each closed contour."""
    w = Window.partitionBy(*by).orderBy(order)
    nxt = [F.coalesce(F.lead(a).over(w), F.first(a).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) for a in G.AXES]
    return df.withColumn("d", F.sqrt(G.sq_dist(G.points(), nxt))).groupBy(*by).agg(F.sum("d").alias("perimeter"))


def polygon_area(df: DataFrame, by: Sequence[str], order: str = "idx") -> DataFrame:
    """Half the length of the summed cross products of consecutive corners."""
    w = Window.partitionBy(*by).orderBy(order)
    nxt = [F.coalesce(F.lead(a).over(w), F.first(a).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))) for a in G.AXES]
    c = G.cross(G.points(), nxt)
    s = df.withColumns({f"c{i}": v for i, v in enumerate(c)}).groupBy(*by).agg(*(F.sum(f"c{i}").alias(f"c{i}") for i in range(3)))
    return s.select(*by, (F.sqrt(F.col("c0") * F.col("c0") + F.col("c1") * F.col("c1") + F.col("c2") * F.col("c2")) / 2).alias("area"))


# set operations
def concatenated(a: DataFrame, b: DataFrame) -> DataFrame:
    """Bag union by name; both must have the same fields up to padding."""
    keep = [c for c in a.columns if not c.startswith("_")]
    if set(keep) != {c for c in b.columns if not c.startswith("_")}:
        raise ValueError("the clouds have different fields")
    return a.select(*keep).unionByName(b.select(*keep))


def appended_grid(a: DataFrame, b: DataFrame, key: Sequence[str], values: Sequence[str], average: bool) -> DataFrame:
    """Grid rows of a, and of b where a has none; cells of both are averaged if asked."""
    x, y = a.alias("a"), b.alias("b")
    out = [F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in key]
    for v in values:
        p, q = F.col(f"a.{v}"), F.col(f"b.{v}")
        both = (p + q) / 2 if average else p
        out.append(F.coalesce(both, p, q).alias(v))
    cond = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in key]
    for c in cond[1:]:
        cond[0] = cond[0] & c
    return x.join(y, cond[0], "full").select(*out)
