"""The octree as integer key columns: voxels, levels, occupancy, dynamic depth, serialisation and change detection."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from .mesh import saved

KEYS = ["kx", "ky", "kz"]

#: Rays that are broadcast at once, about.
RAY_BLOCK = 20_000


def key_depth(low: Sequence[float], high: Sequence[float], size: float) -> int:
    """Levels that the box needs: at least one (two voxels a side), at most 32."""
    widest = max((h - lo) / size for lo, h in zip(low, high, strict=True))
    return min(32, max(1, math.ceil(math.log2(max(2, math.ceil(widest))))))


def cube(low: Sequence[float], high: Sequence[float], size: float) -> tuple[list[float], list[float], int]:
    """The box centred in the cube of its depth."""
    depth = key_depth(low, high, size)
    side = size * (1 << depth)
    mins = [lo - (side - (h - lo)) / 2 for lo, h in zip(low, high, strict=True)]
    return mins, [m + side for m in mins], depth


def indexed(points: DataFrame, origin: Sequence[float], size: float) -> DataFrame:
    """Finite points with their leaf keys."""
    return points.filter(G.finite(*G.AXES)).select("*", *G.keys(origin, size))


def indexed_from_first(points: DataFrame, size: float) -> DataFrame:
    """Keys of a tree whose box starts half a voxel below the first point (least idx), as it does without a given box."""
    first = points.filter(G.finite(*G.AXES)).agg(F.min_by(F.struct(*G.AXES), "idx").alias("o"))
    p = points.filter(G.finite(*G.AXES)).join(F.broadcast(first))  # one row
    return p.select(*points.columns, *(G.voxel(F.col(a), F.col(f"o.{a}") - size / 2, F.lit(size)).alias("k" + a) for a in G.AXES))


def voxels(keyed: DataFrame, *aggs: Column) -> DataFrame:
    return keyed.groupBy(*KEYS).agg(*(aggs or (F.count("*").alias("n"),)))


def at_level(keyed: DataFrame, depth: int, level: int) -> DataFrame:
    """Distinct node keys at a level."""
    return keyed.select(*(G.key_at_depth(F.col(k), depth, level).alias(k) for k in KEYS)).distinct()


def up_to_level(keyed: DataFrame, depth: int, level: int) -> DataFrame:
    """Distinct (level, key) of all nodes down to a level: each level from the one below, so the data are read once."""
    rows = keyed.select(*KEYS).distinct().select(F.explode(F.sequence(F.lit(0), F.lit(level))).alias("level"), *KEYS)
    return rows.select(F.col("level").cast("long").alias("level"), *(F.expr(f"shiftright({k}, {depth} - level)").alias(k) for k in KEYS)).distinct()


def statistics(keyed: DataFrame, depth: int) -> DataFrame:
    """Leaf count, branch count and depth."""
    nodes = up_to_level(keyed, depth, depth)
    return nodes.agg(F.sum((F.col("level") == depth).cast("long")).alias("leaf_count"), F.sum((F.col("level") < depth).cast("long")).alias("branch_count"), F.lit(depth).cast("long").alias("tree_depth"))


def centres(vox: DataFrame, origin: Sequence[float], size: float) -> DataFrame:
    return vox.select("*", *(G.centre(F.col("k" + a), o, size).alias("c" + a) for a, o in zip(G.AXES, origin, strict=True)))


def dynamic_leaves(keyed: DataFrame, depth: int, most: int) -> DataFrame:
    """keyed with `leaf_depth`: the first level at which a point's node holds at most `most` points, the full depth else.

    Counts of all levels come from the voxel counts, not from the points.
    """
    vox = voxels(keyed)
    levels = vox.select(*KEYS, "n", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    node = [F.expr(f"shiftright({k}, {depth} - level)").alias("n" + k) for k in KEYS]
    levels = levels.select(*KEYS, "n", "level", *node)
    sums = levels.groupBy("level", "nkx", "nky", "nkz").agg(F.sum("n").alias("held"))
    fits = levels.join(sums, ["level", "nkx", "nky", "nkz"]).filter(F.col("held") <= most)
    leaf = fits.groupBy(*KEYS).agg(F.min("level").alias("leaf_depth"))
    return keyed.join(leaf, KEYS, "left").withColumn("leaf_depth", F.coalesce("leaf_depth", F.lit(depth)).cast("long"))


def leaf_keys(dyn: DataFrame, depth: int) -> list[Column]:
    return [F.expr(f"shiftright({k}, {depth} - cast(leaf_depth as int))").alias("l" + k) for k in KEYS]


def normal_leaves(keyed: DataFrame, depth: int, most: int, threshold: float) -> DataFrame:
    """Dynamic leaves that are split further while the mean normal's length is below the threshold and more than one point is held.

    keyed: points with nx, ny, nz. The mean dot product of unit normals with their normalised mean is the length of the mean.
    """
    dyn = dynamic_leaves(keyed, depth, most).withColumnRenamed("leaf_depth", "base")
    vox = dyn.groupBy(*KEYS).agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("nx", "ny", "nz")), F.first("base").alias("base"))
    levels = vox.select("*", F.explode(F.sequence(F.col("base").cast("int"), F.lit(depth))).alias("level"))
    levels = levels.select("*", *(F.expr(f"shiftright({k}, {depth} - level)").alias("n" + k) for k in KEYS))
    sums = levels.groupBy("level", "nkx", "nky", "nkz").agg(F.sum("n").alias("held"), *(F.sum(c).alias("s" + c) for c in ("nx", "ny", "nz")))
    length = F.sqrt(F.col("snx") * F.col("snx") + F.col("sny") * F.col("sny") + F.col("snz") * F.col("snz")) / F.col("held")
    good = sums.filter((length >= threshold) | (F.col("held") <= 1)).select("level", "nkx", "nky", "nkz")
    leaf = levels.join(good, ["level", "nkx", "nky", "nkz"]).groupBy(*KEYS).agg(F.min("level").alias("leaf_depth"))
    return dyn.join(leaf, KEYS, "left").withColumn("leaf_depth", F.coalesce("leaf_depth", F.lit(depth)).cast("long")).drop("base")


def child_masks(keyed: DataFrame, depth: int) -> DataFrame:
    """level, node key, Morton code, and the 8-bit mask of occupied children of every branch node, i.e. the serialised tree in pieces."""
    nodes = up_to_level(keyed, depth, depth).filter("level > 0")
    parent = nodes.select((F.col("level") - 1).alias("level"), *(F.shiftright(k, 1).alias("p" + k) for k in KEYS), F.pow(F.lit(2), G.child_index(*(F.col(k) for k in KEYS), 0)).cast("long").alias("bit"))
    masks = parent.groupBy("level", "pkx", "pky", "pkz").agg(F.bit_or("bit").alias("mask"))
    return masks.select("level", *(F.col("p" + k).alias(k) for k in KEYS), G.morton(F.col("pkx"), F.col("pky"), F.col("pkz"), depth).alias("code"), "mask")


def depth_first(masks: DataFrame, depth: int) -> DataFrame:
    """masks with `dfs`: a key by which parents stand before their children, and children in order."""
    code = F.expr(f"shiftleft(code, 3 * ({depth} - cast(level as int)))")
    return masks.withColumn("dfs", code * (depth + 1) + F.col("level"))


def expanded(masks: DataFrame, depth: int) -> DataFrame:
    """The leaf keys that a table of child masks describes."""
    last = masks.filter(F.col("level") == depth - 1)
    child = F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: F.col("mask").bitwiseAND(F.pow(F.lit(2), i).cast("long")) != 0)).alias("c")
    rows = last.select(*KEYS, child)
    return rows.select(*((F.col(k) * 2 + F.shiftright("c", 2 - i).bitwiseAND(1)).alias(k) for i, k in enumerate(KEYS)))


def xor_masks(old: DataFrame, new: DataFrame) -> DataFrame:
    """level, key, mask: the child masks of two trees XORed; nodes that one lacks count as 0."""
    on = ["level", *KEYS]
    both = old.select(*on, F.col("mask").alias("a")).join(new.select(*on, F.col("mask").alias("b")), on, "full")
    return both.select(*on, F.coalesce("a", F.lit(0)).bitwiseXOR(F.coalesce("b", F.lit(0))).cast("long").alias("mask"))


def new_voxel_points(old: DataFrame, new: DataFrame, least: int = 0) -> DataFrame:
    """Points of `new` in voxels that `old` lacks, of voxels with more than `least` points."""
    fresh = voxels(new).filter(F.col("n") > least).join(old.select(*KEYS).distinct(), KEYS, "left_anti")
    return new.join(fresh.select(*KEYS), KEYS, "left_semi")


def without_voxel(keyed: DataFrame, at: DataFrame) -> DataFrame:
    return keyed.join(at.select(*KEYS).distinct(), KEYS, "left_anti")


def kd_leaves(points: DataFrame, most: int) -> DataFrame:
    """points with `node` (1 is the root, children 2n and 2n+1) and `depth`: split at the median of the widest axis until a node holds at most `most`.

    Own definition; each level is one aggregation of the open nodes, and the medians (one row a node) are joined back.
    """
    cur = points.withColumns({"node": F.lit(1).cast("long"), "depth": F.lit(0).cast("long")})
    while True:
        stats = cur.groupBy("node").agg(F.count("*").alias("n"), *(F.struct((F.max(a) - F.min(a)).alias("e"), F.percentile(a, F.lit(0.5)).alias("m")).alias("w" + a) for a in G.AXES))
        stats = stats.filter(F.col("n") > most)
        axis = F.when((F.col("wx.e") >= F.col("wy.e")) & (F.col("wx.e") >= F.col("wz.e")), "x").when(F.col("wy.e") >= F.col("wz.e"), "y").otherwise("z")
        cuts = stats.select("node", axis.alias("axis"), F.when(axis == "x", F.col("wx.m")).when(axis == "y", F.col("wy.m")).otherwise(F.col("wz.m")).alias("cut"), F.greatest("wx.e", "wy.e", "wz.e").alias("extent")).filter("extent > 0")
        if not cuts.limit(1).count():
            return cur
        v = F.when(F.col("axis") == "x", F.col("x")).when(F.col("axis") == "y", F.col("y")).otherwise(F.col("z"))
        cur = cur.join(cuts, "node", "left").select(
            *(c for c in cur.columns if c not in ("node", "depth")), F.when(F.col("cut").isNull(), F.col("node")).otherwise(F.col("node") * 2 + (v >= F.col("cut")).cast("long")).alias("node"), (F.col("depth") + F.col("cut").isNotNull().cast("long")).alias("depth")
        )
        cur = saved(cur)  # or every round would work out all before it


def kd_boxes(leaves: DataFrame) -> DataFrame:
    return leaves.groupBy("node", "depth").agg(F.count("*").alias("n"), *(f(a).alias(f"{m}_{a}") for m, f in (("min", F.min), ("max", F.max)) for a in G.AXES))


def ray_voxels(vox: DataFrame, rays: DataFrame, origin: Sequence[float], size: float) -> DataFrame:
    """Occupied voxels that each ray (qidx, ox, oy, oz, dx, dy, dz; few) meets, with the entry parameter t.

    Slab test of every voxel against the rays, broadcast in blocks of about RAY_BLOCK: a stated query set against all rows.
    """
    blocks = -(-rays.count() // RAY_BLOCK)
    r = None
    for i in range(max(1, blocks)):
        part = vox.join(F.broadcast(rays.filter(F.pmod(F.xxhash64("qidx"), F.lit(max(1, blocks))) == i)))
        r = part if r is None else r.unionByName(part)
    near, far = [], []
    for a, o in zip(G.AXES, origin, strict=True):
        lo = (F.col("k" + a) * size + o - F.col("o" + a)) / F.col("d" + a)
        hi = ((F.col("k" + a) + 1) * size + o - F.col("o" + a)) / F.col("d" + a)
        near.append(F.least(lo, hi))
        far.append(F.greatest(lo, hi))
    r = r.withColumns({"t": F.greatest(*near), "t_out": F.least(*far)})
    return r.filter((F.col("t") < F.col("t_out")) & (F.col("t_out") > 0)).select("qidx", *KEYS, "t")


def segment_voxels(segments: DataFrame, origin: Sequence[float], size: float, precision: float) -> DataFrame:
    """qidx, step, key: voxels along segments (qidx, ax..az, bx..bz) sampled every size * precision, consecutive repeats dropped, the end voxel added."""
    length = F.sqrt(G.sq_dist([F.col("b" + a) for a in G.AXES], [F.col("a" + a) for a in G.AXES]))
    n = F.greatest(F.floor(length / (size * precision)), F.lit(1)).cast("long")
    s = segments.withColumn("n", n).withColumn("step", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    t = F.col("step") / F.col("n")
    key = [G.voxel(F.col("a" + a) + (F.col("b" + a) - F.col("a" + a)) * t, F.lit(o), F.lit(size)).alias("k" + a) for a, o in zip(G.AXES, origin, strict=True)]
    s = s.select("qidx", "step", *key)
    w = Window.partitionBy("qidx").orderBy("step")
    same = F.lag("step").over(w).isNotNull()
    for k in KEYS:
        same = same & (F.lag(k).over(w) == F.col(k))
    return s.withColumn("same", same).filter(~F.col("same")).drop("same")
