"""Convex and concave hulls, one group (cloud) per task, and the slice perimeter of a mesh.

Hulls of a large cloud are taken in two steps: each Arrow batch is reduced to its own hull's points, which hold the hull of the whole, then
the groups' few remaining points meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

PLANES = {"xy": (0, 1), "yz": (1, 2), "xz": (0, 2)}


# kernels
def chain_2d(p: np.ndarray) -> np.ndarray:
    """Indices of the convex hull of (n, 2), counter-clockwise from the least point, without collinear points."""
    order = np.lexsort((p[:, 1], p[:, 0]))
    keep = np.ones(len(order), dtype=bool)
    keep[1:] = (p[order[1:]] != p[order[:-1]]).any(1)
    order = order[keep]
    if len(order) < 3:
        return order

    def half(seq: np.ndarray) -> list[int]:
        out: list[int] = []
        for i in seq:
            while len(out) > 1:
                a, b = p[out[-2]], p[out[-1]]
                if (b[0] - a[0]) * (p[i][1] - a[1]) - (b[1] - a[1]) * (p[i][0] - a[0]) > 0:
                    break
                out.pop()
            out.append(int(i))
        return out

    lower, upper = half(order), half(order[::-1])
    return np.array(lower[:-1] + upper[:-1])


def hull_3d(p: np.ndarray, eps: float = 1e-10) -> np.ndarray:
    """Triangles (m, 3), outward, of the convex hull of (n, 3); empty if the points are coplanar. Incremental, farthest point first."""
    n = len(p)
    scale = np.abs(p).max() if n else 0
    tol = eps * max(scale, 1e-300)
    none = np.zeros((0, 3), dtype=np.int64)
    if n < 4:
        return none
    a = int(p[:, 0].argmin())
    b = int(((p - p[a]) ** 2).sum(1).argmax())
    if ((p[b] - p[a]) ** 2).sum() <= tol * tol:
        return none
    c = int((np.cross(p - p[a], p[b] - p[a]) ** 2).sum(1).argmax())
    normal = np.cross(p[b] - p[a], p[c] - p[a])
    length = np.linalg.norm(normal)
    if length <= tol * tol:
        return none
    h = (p - p[a]) @ (normal / length)
    d = int(np.abs(h).argmax())
    if abs(h[d]) <= tol:
        return none
    inside = p[[a, b, c, d]].mean(0)
    faces: dict[int, tuple[int, int, int]] = {}
    planes: dict[int, tuple[np.ndarray, float]] = {}
    outside: dict[int, np.ndarray] = {}
    edges: dict[tuple[int, int], int] = {}
    count = 0

    def add(i: int, j: int, k: int, rest: np.ndarray) -> None:
        nonlocal count
        nrm = np.cross(p[j] - p[i], p[k] - p[i])
        nrm = nrm / (np.linalg.norm(nrm) or 1.0)
        if nrm @ (inside - p[i]) > 0:
            i, j, k, nrm = i, k, j, -nrm
        faces[count], planes[count] = (i, j, k), (nrm, float(nrm @ p[i]))
        above = rest[(p[rest] @ nrm - planes[count][1]) > tol] if len(rest) else rest
        outside[count] = above
        for e in ((i, j), (j, k), (k, i)):
            edges[e] = count
        count += 1

    rest = np.setdiff1d(np.arange(n), [a, b, c, d])
    for t in ((a, b, c), (a, b, d), (a, c, d), (b, c, d)):
        add(*t, rest)
    todo = [f for f in faces if len(outside[f])]
    while todo:
        f = todo.pop()
        if f not in faces or not len(outside[f]):
            continue
        nrm, off = planes[f]
        far = int(outside[f][(p[outside[f]] @ nrm).argmax()])
        seen, stack = {f}, [f]
        horizon: list[tuple[int, int]] = []
        while stack:
            g = stack.pop()
            i, j, k = faces[g]
            for u, v in ((i, j), (j, k), (k, i)):
                m = edges[(v, u)]
                if m in seen:
                    continue
                if p[far] @ planes[m][0] - planes[m][1] > tol:
                    seen.add(m)
                    stack.append(m)
        for g in seen:
            i, j, k = faces[g]
            horizon += [(u, v) for u, v in ((i, j), (j, k), (k, i)) if edges[(v, u)] not in seen]
        loose = np.unique(np.concatenate([outside[g] for g in seen]))
        loose = loose[loose != far]
        for g in seen:
            i, j, k = faces.pop(g)
            planes.pop(g)
            outside.pop(g)
            for e in ((i, j), (j, k), (k, i)):
                if edges.get(e) == g:
                    del edges[e]
        first = count
        for u, v in horizon:
            add(u, v, far, loose)
        todo += [x for x in range(first, count) if x in faces and len(outside[x])]
    return np.array(list(faces.values()), dtype=np.int64)


def area_volume(p: np.ndarray, tri: np.ndarray) -> tuple[float, float]:
    a, b, c = p[tri[:, 0]], p[tri[:, 1]], p[tri[:, 2]]
    cr = np.cross(b - a, c - a)
    return float(np.linalg.norm(cr, axis=1).sum() / 2), float((a * np.cross(b, c)).sum() / 6)


def delaunay(p: np.ndarray, seed: int = 3) -> np.ndarray:
    """Delaunay triangles of (n, 2) by insertion into a covering triangle; the points are jittered a little against degenerate cases."""
    n = len(p)
    span = np.ptp(p, axis=0).max() if n else 0
    if n < 3 or span == 0:
        return np.zeros((0, 3), dtype=np.int64)
    q = (p - p.mean(0)) / span + np.random.default_rng(seed).uniform(-1e-9, 1e-9, p.shape)
    q = np.concatenate((q, np.array([[-50.0, -30.0], [50.0, -30.0], [0.0, 60.0]])))
    tri = np.array([[n, n + 1, n + 2]])

    def circles(t: np.ndarray) -> np.ndarray:
        a, b, c = q[t[:, 0]], q[t[:, 1]], q[t[:, 2]]
        d = 2 * (a[:, 0] * (b[:, 1] - c[:, 1]) + b[:, 0] * (c[:, 1] - a[:, 1]) + c[:, 0] * (a[:, 1] - b[:, 1]))
        sa, sb, sc = (a**2).sum(1), (b**2).sum(1), (c**2).sum(1)
        ux = (sa * (b[:, 1] - c[:, 1]) + sb * (c[:, 1] - a[:, 1]) + sc * (a[:, 1] - b[:, 1])) / d
        uy = (sa * (c[:, 0] - b[:, 0]) + sb * (a[:, 0] - c[:, 0]) + sc * (b[:, 0] - a[:, 0])) / d
        return np.stack((ux, uy, (ux - a[:, 0]) ** 2 + (uy - a[:, 1]) ** 2), 1)

    cir = circles(tri)
    for i in np.lexsort((q[:n, 1], q[:n, 0])):
        bad = (cir[:, 0] - q[i, 0]) ** 2 + (cir[:, 1] - q[i, 1]) ** 2 < cir[:, 2]
        gone = tri[bad]
        e = np.concatenate((gone[:, [0, 1]], gone[:, [1, 2]], gone[:, [2, 0]]))
        _, first, times = np.unique(np.sort(e, 1), axis=0, return_index=True, return_counts=True)
        rim = e[first[times == 1]]
        new = np.concatenate((rim, np.full((len(rim), 1), i)), 1)
        tri = np.concatenate((tri[~bad], new))
        cir = np.concatenate((cir[~bad], circles(new)))
    return tri[(tri < n).all(1)]


def best_plane(p: np.ndarray) -> np.ndarray:
    """Rows: the axes of the points' principal plane and its normal."""
    c = np.cov((p - p.mean(0)).T, bias=True)
    w, v = np.linalg.eigh(c)
    return v[:, [2, 1, 0]].T


def dimension(p: np.ndarray, ratio: float = 1e-3) -> int:
    """2 if the least eigenvalue is below `ratio` of the greatest, else 3."""
    w = np.linalg.eigvalsh(np.cov((p - p.mean(0)).T, bias=True))
    return 2 if w[0] < ratio * max(w[2], 1e-300) else 3


def contours(tri: np.ndarray) -> list[list[int]]:
    """Boundary edges (of one triangle only) chained into closed contours of three points at least."""
    e = np.concatenate((tri[:, [0, 1]], tri[:, [1, 2]], tri[:, [2, 0]]))
    _, first, times = np.unique(np.sort(e, 1), axis=0, return_index=True, return_counts=True)
    follow: dict[int, list[int]] = {}
    for a, b in e[first[times == 1]].tolist():
        follow.setdefault(a, []).append(b)
        follow.setdefault(b, []).append(a)
    out = []
    while follow:
        start = min(follow)
        path, cur = [start], start
        while follow.get(cur):
            nxt = follow[cur].pop()
            if not follow[cur]:
                del follow[cur]
            follow[nxt].remove(cur)
            if not follow[nxt]:
                del follow[nxt]
            if nxt == start:
                break
            path.append(nxt)
            cur = nxt
        if len(path) >= 3:
            out.append(path)
    return out


def concave_2d(p: np.ndarray, alpha: float) -> tuple[np.ndarray, list[list[int]]]:
    """Triangles of the alpha shape and its contours (indices); empty for alpha <= 0."""
    if alpha <= 0 or len(p) < 3:
        return np.zeros((0, 3), dtype=np.int64), []
    flat = (p - p.mean(0)) @ best_plane(p)[:2].T if p.shape[1] == 3 else p
    tri = delaunay(flat)
    a, b, c = (flat[tri[:, i]] for i in range(3))
    x, y, z = np.linalg.norm(b - c, axis=1), np.linalg.norm(a - c, axis=1), np.linalg.norm(a - b, axis=1)
    area = np.abs((b[:, 0] - a[:, 0]) * (c[:, 1] - a[:, 1]) - (b[:, 1] - a[:, 1]) * (c[:, 0] - a[:, 0])) / 2
    keep = tri[x * y * z <= 4 * alpha * area]
    return keep, contours(keep)


def tetrahedra(p: np.ndarray, seed: int = 3) -> np.ndarray:
    """Delaunay tetrahedra of (n, 3) by insertion, as delaunay()."""
    n = len(p)
    span = np.ptp(p, axis=0).max() if n else 0
    if n < 4 or span == 0:
        return np.zeros((0, 4), dtype=np.int64)
    q = (p - p.mean(0)) / span + np.random.default_rng(seed).uniform(-1e-9, 1e-9, p.shape)
    q = np.concatenate((q, np.array([[-60.0, -40, -40], [60, -40, -40], [0, 70, -40], [0, 0, 80]])))
    tet = np.array([[n, n + 1, n + 2, n + 3]])

    def spheres(t: np.ndarray) -> np.ndarray:
        a = q[t[:, 0]]
        m = 2 * (q[t[:, 1:]] - a[:, None])
        rhs = (q[t[:, 1:]] ** 2).sum(2) - (a**2).sum(1)[:, None]
        c = np.linalg.solve(m, rhs[..., None])[..., 0]
        return np.concatenate((c, ((c - a) ** 2).sum(1)[:, None]), 1)

    sph = spheres(tet)
    for i in range(n):
        bad = ((sph[:, :3] - q[i]) ** 2).sum(1) < sph[:, 3]
        f = np.concatenate([tet[bad][:, s] for s in ([0, 1, 2], [0, 1, 3], [0, 2, 3], [1, 2, 3])])
        _, first, times = np.unique(np.sort(f, 1), axis=0, return_index=True, return_counts=True)
        rim = f[first[times == 1]]
        new = np.concatenate((rim, np.full((len(rim), 1), i)), 1)
        tet = np.concatenate((tet[~bad], new))
        sph = np.concatenate((sph[~bad], spheres(new)))
    return tet[(tet < n).all(1)]


def concave_3d(p: np.ndarray, alpha: float) -> np.ndarray:
    """Faces of exactly one of the tetrahedra whose circumsphere has a radius of at most alpha."""
    if alpha <= 0:
        return np.zeros((0, 3), dtype=np.int64)
    tet = tetrahedra(p)
    a = p[tet[:, 0]]
    m, rhs = 2 * (p[tet[:, 1:]] - a[:, None]), (p[tet[:, 1:]] ** 2).sum(2) - (a**2).sum(1)[:, None]
    edge = np.sqrt((m**2).sum(2).max(1)) / 2
    ok = np.abs(np.linalg.det(m)) > 1e-9 * np.maximum(edge, 1e-300) ** 3
    c = np.linalg.solve(m[ok], rhs[ok][..., None])[..., 0]
    # flat ones hold no volume; they stay if they are small, else the faces behind them would count as surface
    keep = np.concatenate((tet[ok][((c - a[ok]) ** 2).sum(1) <= alpha * alpha], tet[~ok][edge[~ok] <= 2 * alpha]))
    f = np.concatenate([keep[:, s] for s in ([0, 1, 2], [0, 1, 3], [0, 2, 3], [1, 2, 3])]) if len(keep) else np.zeros((0, 3), dtype=np.int64)
    if not len(f):
        return f
    _, first, times = np.unique(np.sort(f, 1), axis=0, return_index=True, return_counts=True)
    return f[first[times == 1]]


# DataFrame operators; clouds: by-columns, idx, x, y, z
def _pre_reduced(points: DataFrame, by: Sequence[str], kernel) -> DataFrame:
    """Each Arrow batch keeps only points that can be on the hull."""
    cols = [*by, "idx", *G.AXES]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, g in b.groupby(list(by), dropna=False) if by else [(None, b)]:
                yield g.iloc[np.unique(kernel(g[["x", "y", "z"]].to_numpy()))] if len(g) > 20 else g

    df = points.filter(G.finite(*G.AXES)).select(*cols)
    return df.mapInPandas(run, df.schema)


def projection(normal: np.ndarray) -> str:
    """The coordinate plane whose axis the normal is within 10 degrees of, else that of the largest component."""
    return {0: "yz", 1: "xz", 2: "xy"}[int(np.abs(normal).argmax())]


def convex_2d(points: DataFrame, by: Sequence[str], plane: str | None = None) -> DataFrame:
    """by, pos, idx, x, y, z, area, perimeter: hull points counter-clockwise in the plane (the best coordinate plane by default)."""
    schema = ", ".join([*(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in by), "pos long, idx long, x double, y double, z double, area double, perimeter double"])

    def hull(g: pd.DataFrame) -> pd.DataFrame:
        p = g[["x", "y", "z"]].to_numpy()
        u = PLANES[plane or (projection(best_plane(p)[2]) if len(p) > 2 else "xy")]
        h = chain_2d(p[:, u])
        q = p[h][:, u]
        nxt = np.roll(q, -1, 0)
        out = g.iloc[h][[*by, "idx", "x", "y", "z"]].copy()
        out.insert(len(by), "pos", np.arange(len(h)))
        out["area"] = abs((q[:, 0] * nxt[:, 1] - q[:, 1] * nxt[:, 0]).sum()) / 2
        out["perimeter"] = np.linalg.norm(nxt - q, axis=1).sum()
        return out

    if plane:
        points = _pre_reduced(points, by, lambda p: chain_2d(p[:, PLANES[plane]]))
    else:
        points = points.filter(G.finite(*G.AXES))
    return points.groupBy(*by).applyInPandas(hull, schema)


def convex_3d(points: DataFrame, by: Sequence[str]) -> DataFrame:
    """by, face_id, v0, v1, v2 (idx), area, volume of the whole hull; no rows where a cloud is coplanar."""
    schema = ", ".join([*(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in by), "face_id long, v0 long, v1 long, v2 long, area double, volume double"])

    def hull(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        p = g[["x", "y", "z"]].to_numpy()
        tri = hull_3d(p)
        area, volume = area_volume(p, tri)
        ids = g["idx"].to_numpy()
        out = pd.DataFrame({c: [g[c].iloc[0]] * len(tri) for c in by})
        for i in range(3):
            out[f"v{i}"] = ids[tri[:, i]] if len(tri) else np.zeros(0, dtype=np.int64)
        out.insert(len(by), "face_id", np.arange(len(tri)))
        return out.assign(area=area, volume=volume)

    def kernel(p: np.ndarray) -> np.ndarray:
        tri = hull_3d(p)
        return tri if len(tri) else np.arange(len(p))

    return _pre_reduced(points, by, kernel).groupBy(*by).applyInPandas(hull, schema)


def checked(points: DataFrame, by: Sequence[str], tol: float = 1e-9) -> DataFrame:
    """by, convex: whether no point of a cloud lies outside a face of its hull."""
    schema = ", ".join([*(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in by), "convex boolean"])

    def check(g: pd.DataFrame) -> pd.DataFrame:
        p = g[["x", "y", "z"]].to_numpy()
        t = hull_3d(p)
        n = np.cross(p[t[:, 1]] - p[t[:, 0]], p[t[:, 2]] - p[t[:, 0]])
        off = (n * p[t[:, 0]]).sum(1)
        ok = all((p[lo : lo + 1000] @ n.T - off < tol).all() for lo in range(0, len(p), 1000))
        return pd.DataFrame({**{c: [g[c].iloc[0]] for c in by}, "convex": [bool(ok)]})

    return points.filter(G.finite(*G.AXES)).groupBy(*by).applyInPandas(check, schema)


def concave(points: DataFrame, by: Sequence[str], alpha: float) -> DataFrame:
    """by, contour, pos, idx, x, y, z: contours of the planar alpha shape of each cloud."""
    schema = ", ".join([*(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in by), "contour long, pos long, idx long, x double, y double, z double"])

    def shape(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        _, paths = concave_2d(g[["x", "y", "z"]].to_numpy(), alpha)
        parts = []
        for k, path in enumerate(paths):
            part = g.iloc[path][[*by, "idx", "x", "y", "z"]].copy()
            part.insert(len(by), "contour", k)
            part.insert(len(by) + 1, "pos", np.arange(len(path)))
            parts.append(part)
        return pd.concat(parts) if parts else pd.DataFrame(columns=[*by, "contour", "pos", "idx", "x", "y", "z"]).astype({c: t for c, t in zip(["contour", "pos", "idx", "x", "y", "z"], ["int64"] * 3 + ["float64"] * 3, strict=True)})

    return points.filter(G.finite(*G.AXES)).groupBy(*by).applyInPandas(shape, schema)


def concave_faces(points: DataFrame, by: Sequence[str], alpha: float) -> DataFrame:
    """by, face_id, v0, v1, v2 (idx): the surface of the solid alpha shape of each cloud."""
    schema = ", ".join([*(f"`{c}` {points.schema[c].dataType.simpleString()}" for c in by), "face_id long, v0 long, v1 long, v2 long"])

    def shape(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        f = concave_3d(g[["x", "y", "z"]].to_numpy(), alpha)
        out = pd.DataFrame({c: [g[c].iloc[0]] * len(f) for c in by})
        ids = g["idx"].to_numpy()
        out["face_id"] = np.arange(len(f))
        for i in range(3):
            out[f"v{i}"] = ids[f[:, i]] if len(f) else np.zeros(0, dtype=np.int64)
        return out

    return points.filter(G.finite(*G.AXES)).groupBy(*by).applyInPandas(shape, schema)


def resolved(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """faces (face_id, v0, v1, v2) with the corners' coordinates x0 .. z2."""
    out = faces
    for i in range(3):
        out = out.join(vertices.select(F.col("idx").alias(f"v{i}"), *(F.col(a).alias(f"{a}{i}") for a in G.AXES)), f"v{i}")
    return out


def slice_perimeter(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """axis, level, n_segments, perimeter: the mesh cut at the middle of its thinnest axis."""
    b = vertices.agg(*(F.min(a).alias("lo" + a) for a in G.AXES), *(F.max(a).alias("hi" + a) for a in G.AXES))
    axis = G.thinnest_axis(*(F.col("hi" + a) - F.col("lo" + a) for a in G.AXES))
    b = b.select(axis.alias("axis"), *((F.col("lo" + a) + F.col("hi" + a)).alias("m" + a) for a in G.AXES))
    b = b.select("axis", (F.when(F.col("axis") == 0, F.col("mx")).when(F.col("axis") == 1, F.col("my")).otherwise(F.col("mz")) / 2).alias("level"))
    t = resolved(faces, vertices).join(F.broadcast(b))  # one row
    corner = [[F.col(f"{a}{i}") for a in G.AXES] for i in range(3)]
    h = [F.when(F.col("axis") == 0, c[0]).when(F.col("axis") == 1, c[1]).otherwise(c[2]) - F.col("level") for c in corner]
    t = t.withColumns({f"h{i}": x for i, x in enumerate(h)})
    cuts = []
    for i, j in ((0, 1), (1, 2), (2, 0)):
        hi, hj = F.col(f"h{i}"), F.col(f"h{j}")
        # half-open: a corner on the plane belongs to the upper side
        crosses = (hi >= 0) != (hj >= 0)
        s = hi / (hi - hj)
        cuts.append(F.when(crosses, F.array(*(p + s * (q - p) for p, q in zip(corner[i], corner[j], strict=True)))))
    t = t.select("axis", "level", F.array_compact(F.array(*cuts)).alias("c")).filter(F.size("c") == 2)
    e = [F.col("c")[0][k] - F.col("c")[1][k] for k in range(3)]
    seg = t.select("axis", "level", F.sqrt(e[0] * e[0] + e[1] * e[1] + e[2] * e[2]).alias("d"))
    return seg.groupBy("axis", "level").agg(F.count("*").alias("n_segments"), F.sum("d").alias("perimeter"))
