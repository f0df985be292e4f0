"""Resampling of leaves that are split by normals: a lattice in each leaf's hull, lifted to the local surface."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import octree
from .hull import PLANES, chain_2d


def inside_convex(q: np.ndarray, hull: np.ndarray) -> np.ndarray:
    """Which of (n, 2) lie in a counter-clockwise convex polygon."""
    nxt = np.roll(hull, -1, 0)
    d = nxt - hull
    side = d[None, :, 0] * (q[:, None, 1] - hull[None, :, 1]) - d[None, :, 1] * (q[:, None, 0] - hull[None, :, 0])
    return (side >= -1e-12).all(1)


def resampled(keyed: DataFrame, origin: Sequence[float], size: float, depth: int, most: int, threshold: float, step: float, radius: float) -> DataFrame:
    """x, y, z and leaf of lattice points. keyed: points with normals and keys.

    In each leaf of three points or more: a lattice of `step` inside the hull of its points in the base plane; each lattice
    point's height above the mean plane is averaged from leaf points within `radius` by inverse distance, and kept if it is between 0 and the leaf's height. One leaf a task group.
    """
    dyn = octree.normal_leaves(keyed, depth, most, threshold)
    rows = dyn.select("x", "y", "z", "nx", "ny", "nz", "leaf_depth", *octree.leaf_keys(dyn, depth))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({c: pd.Series(dtype=t) for c, t in zip(("leaf_depth", "lkx", "lky", "lkz", "x", "y", "z"), ["int64"] * 4 + ["float64"] * 3, strict=True)})
        if len(g) < 3:
            return empty
        g = g.sort_values(["x", "y", "z"])
        p, n = g[["x", "y", "z"]].to_numpy(), g[["nx", "ny", "nz"]].to_numpy()
        mean, normal = p.mean(0), n.mean(0)
        axis = int(np.abs(normal).argmax())
        if normal[axis] == 0:
            return empty
        u = list(PLANES[{0: "yz", 1: "xz", 2: "xy"}[axis]])
        hull = p[:, u][chain_2d(p[:, u])]
        if len(hull) < 3:
            return empty
        lo, hi = hull.min(0), hull.max(0)
        gx, gy = np.meshgrid(np.arange(lo[0] + step / 2, hi[0], step), np.arange(lo[1] + step / 2, hi[1], step), indexing="ij")
        q = np.stack((gx.ravel(), gy.ravel()), 1)
        q = q[inside_convex(q, hull)] if len(q) else q
        if not len(q):
            return empty
        # the lattice is lifted to the mean plane along the base axis
        base = mean[axis] - ((q - mean[u]) @ normal[u]) / normal[axis]
        d = np.sqrt(((q[:, None] - p[None][:, :, u]) ** 2).sum(2))
        w = np.where(d <= radius, 1 / np.maximum(d, 1e-9), 0)
        off = p[:, axis] - (mean[axis] - ((p[:, u] - mean[u]) @ normal[u]) / normal[axis])
        h = (w * off[None]).sum(1) / np.maximum(w.sum(1), 1e-300)
        side = size * (1 << (depth - int(g["leaf_depth"].iloc[0])))
        ok = (w.sum(1) > 0) & (np.abs(h) <= side)
        out = np.zeros((int(ok.sum()), 3))
        out[:, u], out[:, axis] = q[ok], (base + h)[ok]
        return pd.DataFrame({**{c: g[c].iloc[0] for c in ("leaf_depth", "lkx", "lky", "lkz")}, **{a: out[:, i] for i, a in enumerate("xyz")}}, index=range(len(out))) if len(out) else empty

    return rows.groupBy("leaf_depth", "lkx", "lky", "lkz").applyInPandas(run, "leaf_depth long, lkx long, lky long, lkz long, x double, y double, z double")
