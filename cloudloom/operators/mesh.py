"""Triangle meshes as tables: adjacency, paths, flood fill, parametrisation, rasterising, decal blending.

Fixpoints are frontier loops: each round joins the last round's new rows with the edges and writes its state to the shared
checkpoint folder, so lineage stays short and lost executors cost one round.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..sources.scratch import scratch


def saved(df: DataFrame) -> DataFrame:
    """df written to the session's shared folder and read back."""
    path = scratch(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def corners(faces: DataFrame) -> DataFrame:
    return faces.select("face_id", F.posexplode(F.array("v0", "v1", "v2")).alias("corner", "v"))


def half_edges(faces: DataFrame) -> DataFrame:
    """face_id, a, b: the three directed edges of each face."""
    e = F.explode(F.array(*(F.struct(F.col(f"v{i}").alias("a"), F.col(f"v{(i + 1) % 3}").alias("b")) for i in range(3))))
    return faces.select("face_id", e.alias("e")).select("face_id", "e.a", "e.b")


def edges(faces: DataFrame) -> DataFrame:
    """a < b, n: undirected edges and the faces that share them."""
    h = half_edges(faces).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return h.groupBy("a", "b").agg(F.count("*").alias("n"))


def face_adjacency(faces: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """f, g, a, b: faces that share an edge, both ways; edges of `without` (a < b) don't count."""
    h = half_edges(faces).select("face_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    if without is not None:
        h = h.join(without.select("a", "b"), ["a", "b"], "left_anti")
    return h.withColumnRenamed("face_id", "f").join(h.withColumnRenamed("face_id", "g"), ["a", "b"]).filter("f <> g").select("f", "g", "a", "b")


def edge_lengths(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    e = edges(faces)
    for v in ("a", "b"):
        e = e.join(vertices.select(F.col("idx").alias(v), *(F.col(x).alias(x + v) for x in G.AXES)), v)
    return e.select("a", "b", F.sqrt(G.sq_dist([F.col(x + "a") for x in G.AXES], [F.col(x + "b") for x in G.AXES])).alias("len"))


def shortest_paths(faces: DataFrame, vertices: DataFrame, source: int, target: int | None = None, max_rounds: int = 10_000) -> DataFrame:
    """idx, dist, prev: shortest edge paths from a vertex to all (or until the target can't improve), by rounds of relaxation of the improved vertices."""
    e = edge_lengths(faces, vertices)
    e = saved(e.union(e.select(F.col("b"), F.col("a"), "len")))
    spark = faces.sparkSession
    state = spark.createDataFrame([(source, 0.0, None)], "idx long, dist double, prev long")
    front = state
    for _ in range(max_rounds):
        step = front.select(F.col("idx").alias("a"), "dist").join(e, "a").select(F.col("b").alias("idx"), (F.col("dist") + F.col("len")).alias("dist"), F.col("a").alias("prev"))
        step = step.groupBy("idx").agg(F.min(F.struct("dist", "prev")).alias("s")).select("idx", "s.dist", "s.prev")
        if target is not None:
            bound = state.filter(F.col("idx") == target).select("dist").first()
            if bound:
                step = step.filter(F.col("dist") < bound[0])
        better = saved(step.alias("n").join(state.alias("o"), "idx", "left").filter("o.dist is null or n.dist < o.dist").select("idx", "n.dist", "n.prev"))
        if not better.limit(1).count():
            break
        state = saved(state.join(better, "idx", "left_anti").unionByName(better))
        front = better
    else:
        raise RuntimeError(f"paths still improve after {max_rounds} rounds")
    return state


def path_to(paths: DataFrame, target: int) -> DataFrame:
    """pos, idx of the path to target without the target itself, from the source on.

    Found by pointer jumping: round k knows every vertex's ancestor 2**k steps up and doubles the known part of the path, so a path takes the logarithm of its length in rounds.
    """
    jump = saved(paths.filter("prev is not null").select("idx", F.col("prev").alias("up")))
    path = paths.filter(F.col("idx") == target).select("idx", F.lit(0).cast("long").alias("hops"))
    k = 0
    while True:
        more = path.join(jump, "idx").select(F.col("up").alias("idx"), (F.col("hops") + (1 << k)).alias("hops"))
        longer = saved(path.unionByName(more))
        if not longer.filter(F.col("hops") >= (1 << k)).limit(1).count():
            break
        path, k = longer, k + 1
        jump = saved(jump.alias("a").join(jump.alias("b"), F.col("a.up") == F.col("b.idx")).select("a.idx", "b.up"))
    n = path.agg(F.max("hops")).first()[0] or 0
    return path.filter("hops > 0").select((F.lit(n) - F.col("hops")).cast("long").alias("pos"), "idx")


def flood(adjacency: DataFrame, seed: DataFrame, max_rounds: int = 100_000) -> DataFrame:
    """face_id reached from the seed faces over adjacency (f, g)."""
    adjacency = saved(adjacency.select("f", "g").distinct())
    reached = front = saved(seed.select("face_id").distinct())
    for _ in range(max_rounds):
        nxt = front.join(adjacency, F.col("face_id") == F.col("f")).select(F.col("g").alias("face_id")).distinct()
        front = saved(nxt.join(reached, "face_id", "left_anti"))
        if not front.limit(1).count():
            return reached
        reached = saved(reached.union(front))
    raise RuntimeError(f"the flood still spreads after {max_rounds} rounds")


def seed_faces(faces: DataFrame, vertices: DataFrame, at: Sequence[float]) -> DataFrame:
    """The least face that touches the vertex nearest to a point."""
    d2 = G.sq_dist(G.points(), [F.lit(float(c)) for c in at])
    near = vertices.agg(F.min_by("idx", F.struct(d2, F.col("idx"))).alias("v"))
    return corners(faces).join(F.broadcast(near), "v").agg(F.min("face_id").alias("face_id"))


def renumbered(faces: DataFrame) -> DataFrame:
    """face_id, corner, v, new: vertices numbered densely in order of first use, by range partitions and their offsets."""
    from .cloud import reindexed

    c = corners(faces)
    first = c.groupBy("v").agg(F.min(F.struct("face_id", "corner")).alias("first")).select("v", "first.*")
    new = reindexed(first, ["face_id", "corner"]).withColumnRenamed("idx", "new")
    return c.join(new.select("v", "new"), "v").select("face_id", F.col("corner").cast("long").alias("corner"), "v", "new")


def harmonic_uv(faces: DataFrame, vertices: DataFrame, boundary: DataFrame) -> DataFrame:
    """idx, u, v: cotangent-weighted harmonic map with given boundary (idx, u, v); one mesh, one task, conjugate gradients on the sparse system."""
    rows = faces.select(F.lit(0).alias("kind"), "v0", "v1", "v2", *(F.lit(0.0).alias(c) for c in "xyz"))
    rows = rows.union(vertices.select(F.lit(1), "idx", F.lit(0), F.lit(0), *G.AXES)).union(boundary.select(F.lit(2), "idx", F.lit(0), F.lit(0), "u", "v", F.lit(0.0)))

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        f = g[g.kind == 0][["v0", "v1", "v2"]].to_numpy()
        vert, fixed = g[g.kind == 1], g[g.kind == 2]
        ids = vert["v0"].to_numpy()
        at = {v: i for i, v in enumerate(ids.tolist())}
        p = vert[["x", "y", "z"]].to_numpy()
        t = np.vectorize(at.get)(f)
        i_, j_, w_ = [], [], []
        for a, b, c in ((0, 1, 2), (1, 2, 0), (2, 0, 1)):
            u, v = p[t[:, a]] - p[t[:, c]], p[t[:, b]] - p[t[:, c]]
            cot = (u * v).sum(1) / np.maximum(np.linalg.norm(np.cross(u, v), axis=1), 1e-12) / 2
            i_ += [t[:, a], t[:, b]]
            j_ += [t[:, b], t[:, a]]
            w_ += [cot, cot]
        i, j, w = np.concatenate(i_), np.concatenate(j_), np.maximum(np.concatenate(w_), 1e-9)
        n = len(ids)
        uv = np.zeros((n, 2))
        held = np.zeros(n, dtype=bool)
        for k, u, v in fixed[["v0", "x", "y"]].itertuples(index=False):
            uv[at[int(k)]], held[at[int(k)]] = (u, v), True
        diag = np.bincount(i, w, n)

        def times(x: np.ndarray) -> np.ndarray:
            y = diag[:, None] * x - np.stack([np.bincount(i, w * x[j, k], n) for k in range(2)], 1)
            y[held] = 0
            return y

        x = np.where(held[:, None], uv, 0)
        r = -times(x)
        d, rs = r.copy(), (r * r).sum(0)
        for _ in range(4 * n):
            if rs.max() < 1e-24:
                break
            q = times(d)
            a = rs / np.maximum((d * q).sum(0), 1e-300)
            x, r = x + a * d, r - a * q
            new = (r * r).sum(0)
            d, rs = r + new / np.maximum(rs, 1e-300) * d, new
        return pd.DataFrame({"idx": ids, "u": x[:, 0], "v": x[:, 1]})

    return rows.groupBy().applyInPandas(solve, "idx long, u double, v double")


def rasterised(tri: DataFrame, eps: float = 0.01) -> DataFrame:
    """px, py, u, v, face_id: pixels of triangles (face_id, x0 y0 u0 v0 .. x2 y2 u2 v2) with interpolated, clamped uv; the greatest face_id wins."""
    xs, ys = [F.col(f"x{i}") for i in range(3)], [F.col(f"y{i}") for i in range(3)]
    lo = lambda c: F.floor(F.least(*c)).cast("long")
    hi = lambda c: F.ceil(F.greatest(*c)).cast("long")
    p = tri.withColumn("px", F.explode(F.sequence(lo(xs), hi(xs)))).withColumn("py", F.explode(F.sequence(lo(ys), hi(ys))))
    b = G.barycentric(F.col("px").cast("double"), F.col("py").cast("double"), list(zip(xs, ys, strict=True)))
    p = p.withColumns({"b0": b[0], "b1": b[1], "b2": b[2]}).filter(F.least("b0", "b1", "b2") >= -eps)
    at = lambda c: F.least(F.greatest(sum((F.col(f"b{i}") * F.col(f"{c}{i}") for i in range(1, 3)), F.col("b0") * F.col(f"{c}0")), F.lit(0.0)), F.lit(1.0))
    p = p.select("px", "py", "face_id", at("u").alias("u"), at("v").alias("v"))
    return p.groupBy("px", "py").agg(F.max_by(F.struct("u", "v", "face_id"), "face_id").alias("m")).select("px", "py", "m.*")


def scattered(pixels: DataFrame, width: int, height: int, values: Sequence[str]) -> DataFrame:
    """Texture colours put at their uv cell of a width x height image; the last (by py, px) wins."""
    tx, ty = F.least(F.floor(F.col("u") * width), F.lit(width - 1)).cast("long"), F.least(F.floor(F.col("v") * height), F.lit(height - 1)).cast("long")
    return pixels.groupBy(tx.alias("tx"), ty.alias("ty")).agg(F.max_by(F.struct(*values), F.struct("py", "px")).alias("m")).select("tx", "ty", "m.*")


def blended(texture: DataFrame, uv: DataFrame, decal: DataFrame, width: int, height: int, channels: Sequence[str]) -> DataFrame:
    """texture (px, py, channels) with the decal (tx, ty, channels, alpha) laid over where uv maps a pixel and alpha > 0; x by columns, y by rows."""
    tx, ty = F.least(F.floor(F.col("u") * width), F.lit(width - 1)).cast("long"), F.least(F.floor(F.col("v") * height), F.lit(height - 1)).cast("long")
    m = texture.join(uv.select("px", "py", tx.alias("tx"), ty.alias("ty")), ["px", "py"], "left")
    m = m.join(decal.select("tx", "ty", "alpha", *(F.col(c).alias("d_" + c) for c in channels)), ["tx", "ty"], "left")
    return m.select("px", "py", *(F.when(F.col("alpha") > 0, G.blend(F.col("d_" + c), F.col(c), F.col("alpha"))).otherwise(F.col(c)).alias(c) for c in channels))
