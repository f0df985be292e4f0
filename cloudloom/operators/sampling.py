"""Resampling: one point per voxel by several rules, weights from neighbourhoods, top shares, random draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from . import mesh, octree, search

KEYS = octree.KEYS


def uniform(points: DataFrame, leaf: float, mode: str = "center") -> DataFrame:
    """One point per cell of floor(p / leaf): the nearest to the cell's centre, or (legacy) to the cell index taken as a point; least idx on ties."""
    p = points.filter(G.finite(*G.AXES)).select("*", *G.keys((0.0, 0.0, 0.0), leaf))
    to = [F.col(k).cast("double") if mode == "legacy" else (F.col(k) + 0.5) * leaf for k in KEYS]
    d2 = G.sq_dist(G.points(), to)
    return p.groupBy(*KEYS).agg(F.min_by(F.struct("idx", *G.AXES), F.struct(d2, F.col("idx"))).alias("p")).select("p.*")


def closest_to_centre(keyed: DataFrame, origin: Sequence[float], size: float, by: Sequence[str] = KEYS) -> DataFrame:
    d2 = G.sq_dist(G.points(), [G.centre(F.col("k" + a), o, size) for a, o in zip(G.AXES, origin, strict=True)])
    return keyed.groupBy(*by).agg(F.min_by(F.struct("idx", *G.AXES), F.struct(d2, F.col("idx"))).alias("p")).select("p.*")


def average(keyed: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    return keyed.groupBy(*by).agg(*(F.avg(a).alias(a) for a in G.AXES), F.count("*").alias("n"))


def height_interpolated(keyed: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """One point per voxel: the mean in the base plane, and along the base axis (of greatest absolute mean normal) the height of the points
    weighted by inverse squared distance from the mean in that plane (weight 1 at distance 0)."""
    mean = keyed.groupBy(*by).agg(*(F.avg(a).alias("m" + a) for a in G.AXES), *(F.avg("n" + a).alias("mn" + a) for a in G.AXES), F.count("*").alias("n"))
    ax, ay, az = (F.abs(F.col("mn" + a)) for a in G.AXES)
    mean = mean.withColumn("axis", F.when((ax >= ay) & (ax >= az), 0).when(ay >= az, 1).otherwise(2))
    j = keyed.select(*by, *G.AXES).join(mean, list(by))
    pick = lambda cols: F.when(F.col("axis") == 0, cols[0]).when(F.col("axis") == 1, cols[1]).otherwise(cols[2])
    d = [F.col(a) - F.col("m" + a) for a in G.AXES]
    sq = [x * x for x in d]
    plane = pick([sq[1] + sq[2], sq[0] + sq[2], sq[0] + sq[1]])
    weight = F.when(plane == 0, 1.0).otherwise(1 / plane)
    out = j.select(*by, "axis", "n", *("m" + a for a in G.AXES), weight.alias("w"), (weight * pick(G.points())).alias("wh"))
    out = out.groupBy(*by).agg(F.first("axis").alias("axis"), F.first("n").alias("n"), *(F.first("m" + a).alias("m" + a) for a in G.AXES), (F.sum("wh") / F.sum("w")).alias("h"))
    return out.select(*by, *(F.when(F.col("axis") == i, F.col("h")).otherwise(F.col("m" + a)).alias(a) for i, a in enumerate(G.AXES)), "n")


def by_dynamic_leaves(keyed: DataFrame, depth: int, most: int) -> tuple[DataFrame, list[str]]:
    """Points with the keys of their adaptive leaves (at most `most` points, never below 6), and those columns."""
    dyn = octree.dynamic_leaves(keyed, depth, max(6, most))
    return dyn.select("*", *octree.leaf_keys(dyn, depth)), ["leaf_depth", *("l" + k for k in KEYS)]


def neighbour_weights(points: DataFrame, pairs: DataFrame, sigma: float) -> DataFrame:
    """idx, weight: squared length of (Gaussian-weighted neighbour mean - point). pairs: qidx, idx, d2 without the point itself. No neighbours: 0."""
    p = points.select("idx", *G.AXES)
    g = pairs.join(p, "idx").withColumn("g", F.exp(-F.col("d2") / (sigma * sigma)))
    mean = g.groupBy("qidx").agg(*((F.sum(F.col("g") * F.col(a)) / F.sum("g")).alias("m" + a) for a in G.AXES)).withColumnRenamed("qidx", "idx")
    w = G.sq_dist([F.col("m" + a) for a in G.AXES], G.points())
    return p.join(mean, "idx", "left").select("idx", F.coalesce(F.when(~F.isnan(w), w), F.lit(0.0)).alias("weight"))


def weighted_top(points: DataFrame, weights: DataFrame, percent: float) -> DataFrame:
    """The trunc(percent * n) points of greatest weight, least idx on ties."""
    n = int(percent * points.count())
    return points.join(weights, "idx").orderBy(F.desc("weight"), "idx").limit(n)


def weight_sampling_radius(points: DataFrame, percent: float = 0.5, radius: float = 5.0, sigma: float = 1.5) -> DataFrame:
    queries = points.select(F.col("idx").alias("qidx"), *G.AXES)
    return weighted_top(points, neighbour_weights(points, search.within(points, queries, radius).filter("qidx <> idx"), sigma), percent)


def weight_sampling_k(points: DataFrame, percent: float, k: int, sigma: float) -> DataFrame:
    queries = points.select(F.col("idx").alias("qidx"), *G.AXES)
    return weighted_top(points, neighbour_weights(points, search.nearest_join(points, queries, k).filter("qidx <> idx"), sigma), percent)


def random_draws(weighted: DataFrame, n: int, seed: int) -> DataFrame:
    """n draws with replacement by weight: uniform numbers (from the md5 of seed and draw), each meeting the cumulative range that it falls into.

    Cumulative sums are those of range partitions plus offsets, so no task sees all points. Ranges are joined by cells of the total weight over the number of
    points, not by a nested loop. weighted: idx, weight. No weight at all gives no draws.
    """
    ranged = mesh.saved(weighted.select("idx", F.col("weight").cast("double").alias("weight")).repartitionByRange("idx").withColumn("part", F.spark_partition_id()))
    sums = ranged.groupBy("part").agg(F.sum("weight").alias("held"), F.count("*").alias("rows"))
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a partition
    parts = mesh.saved(sums.withColumn("off", F.coalesce(F.sum("held").over(w), F.lit(0.0))))
    total, cells = parts.agg(F.max(F.col("off") + F.col("held")), F.sum("rows")).first()
    if not total:
        return weighted.sparkSession.createDataFrame([], "draw long, idx long")
    p = Window.partitionBy("part").orderBy("idx")
    before = F.coalesce(F.sum("weight").over(p.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    cdf = ranged.join(F.broadcast(parts), "part").withColumn("lo", F.col("off") + before)  # parts: one row a partition
    cdf = cdf.withColumn("hi", F.coalesce(F.lead("lo").over(p), F.col("off") + F.col("held")))
    cell = lambda c: F.floor(c / F.lit(total) * cells).cast("long")
    cdf = cdf.select("idx", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi")))).alias("cell"))
    uniform = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string"))), 1, 13), 16, 10).cast("double") / float(1 << 52)
    draws = weighted.sparkSession.range(n).select(F.col("id").alias("draw"), (uniform * total).alias("u")).withColumn("cell", cell(F.col("u")))
    return draws.join(cdf, "cell").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select("draw", "idx")
