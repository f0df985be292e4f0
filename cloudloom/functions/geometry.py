"""Column expressions: distances, angles, octree keys, transforms and small closed forms."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def finite(*cols: Column | str) -> Column:
    """True where every value is neither null, NaN nor infinite."""
    out = F.lit(True)
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return out


def sq_dist(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = None
    for p, q in zip(a, b, strict=True):
        d = p - q
        out = d * d if out is None else out + d * d
    return out


def points(prefix: str = "") -> list[Column]:
    return [F.col(prefix + a) for a in AXES]


def dot(a: Sequence[Column], b: Sequence[Column]) -> Column:
    out = a[0] * b[0]
    for p, q in zip(a[1:], b[1:], strict=True):
        out = out + p * q
    return out


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def norm(a: Sequence[Column]) -> Column:
    return F.sqrt(dot(a, a))


def angle(a: Sequence[Column], b: Sequence[Column], degrees: bool = False) -> Column:
    """The angle between two vectors, its cosine clamped to [-1, 1]."""
    c = dot(a, b) / (norm(a) * norm(b))
    out = F.acos(F.least(F.greatest(c, F.lit(-1.0)), F.lit(1.0)))
    return F.degrees(out) if degrees else out


def circumradius(a: Column, b: Column, c: Column) -> Column:
    """Radius of the circle through the corners of a triangle with sides a, b, c (Heron)."""
    s = (a + b + c) / 2
    return a * b * c / (4 * F.sqrt(s * (s - a) * (s - b) * (s - c)))


def cross2(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return ax * by - ay * bx


def voxel(c: Column, origin: float | Column, size: float | Column) -> Column:
    return F.floor((c - origin) / size).cast("long")


def keys(origin: Sequence[float], size: float) -> list[Column]:
    return [voxel(F.col(a), F.lit(float(o)), F.lit(float(size))).alias("k" + a) for a, o in zip(AXES, origin, strict=True)]


def key_at_depth(k: Column, depth: int, at: int) -> Column:
    """The ancestor of a leaf key of a tree of `depth` levels, at level `at`."""
    return F.shiftright(k, depth - at)


def morton(kx: Column, ky: Column, kz: Column, bits: int) -> Column:
    """Bits of the three keys interleaved, x highest."""
    out = F.lit(0).cast("long")
    for i in range(bits):
        for k, s in ((kx, 2), (ky, 1), (kz, 0)):
            out = out + F.shiftleft(F.shiftright(k.cast("long"), i).bitwiseAND(1), 3 * i + s)
    return out


def child_index(kx: Column, ky: Column, kz: Column, shift: int) -> Column:
    bit = lambda k: F.shiftright(k, shift).bitwiseAND(1)
    return bit(kx) * 4 + bit(ky) * 2 + bit(kz)


def centre(k: Column, origin: float, size: float) -> Column:
    return (k + 0.5) * size + origin


def affine(p: Sequence[Column], m: Sequence[Sequence[float]]) -> list[Column]:
    """p times the upper three rows of a 4x4 (or 3x4) matrix."""
    return [p[0] * r[0] + p[1] * r[1] + p[2] * r[2] + r[3] for r in m[:3]]


def rotate(p: Sequence[Column], m: Sequence[Sequence[float]]) -> list[Column]:
    return [p[0] * r[0] + p[1] * r[1] + p[2] * r[2] for r in m[:3]]


def euler_matrix(tx: float, ty: float, tz: float, roll: float, pitch: float, yaw: float) -> list[list[float]]:
    """Translation and rotation about x, then y, then z."""
    a, b, c, d, e, f = math.cos(yaw), math.sin(yaw), math.cos(pitch), math.sin(pitch), math.cos(roll), math.sin(roll)
    return [[a * c, a * d * f - b * e, b * f + a * d * e, tx], [b * c, a * e + b * d * f, b * d * e - a * f, ty], [-d, c * f, c * e, tz], [0.0, 0.0, 0.0, 1.0]]


def euler_angles(m: Sequence[Sequence[float]]) -> tuple[float, float, float]:
    return math.atan2(m[2][1], m[2][2]), math.asin(-m[2][0]), math.atan2(m[1][0], m[0][0])


def quaternion_matrix(t: Sequence[float], w: float, x: float, y: float, z: float) -> list[list[float]]:
    n = w * w + x * x + y * y + z * z
    s = 2 / n
    return [
        [1 - s * (y * y + z * z), s * (x * y - w * z), s * (x * z + w * y), t[0]],
        [s * (x * y + w * z), 1 - s * (x * x + z * z), s * (y * z - w * x), t[1]],
        [s * (x * z - w * y), s * (y * z + w * x), 1 - s * (x * x + y * y), t[2]],
        [0.0, 0.0, 0.0, 1.0],
    ]


def inverse3(m: Sequence[Sequence[Column]]) -> tuple[list[list[Column]], Column]:
    """Adjugate over determinant of a 3x3 of columns, and the determinant."""
    cof = [[m[(j + 1) % 3][(i + 1) % 3] * m[(j + 2) % 3][(i + 2) % 3] - m[(j + 1) % 3][(i + 2) % 3] * m[(j + 2) % 3][(i + 1) % 3] for j in range(3)] for i in range(3)]
    det = m[0][0] * cof[0][0] + m[0][1] * cof[1][0] + m[0][2] * cof[2][0]
    return [[c / det for c in r] for r in cof], det


def inverse2(a: Column, b: Column, c: Column, d: Column) -> tuple[list[Column], Column]:
    det = a * d - b * c
    return [d / det, -b / det, -c / det, a / det], det


def symmetric_roots(a: Sequence[Sequence[Column]]) -> list[Column]:
    """Eigenvalues of a symmetric 3x3 of columns, ascending, by the trigonometric form of the cubic."""
    q = (a[0][0] + a[1][1] + a[2][2]) / 3
    off = a[0][1] * a[0][1] + a[0][2] * a[0][2] + a[1][2] * a[1][2]
    p2 = (a[0][0] - q) * (a[0][0] - q) + (a[1][1] - q) * (a[1][1] - q) + (a[2][2] - q) * (a[2][2] - q) + 2 * off
    p = F.sqrt(p2 / 6)
    b = [[(a[i][j] - (q if i == j else 0)) / p for j in range(3)] for i in range(3)]
    det = b[0][0] * (b[1][1] * b[2][2] - b[1][2] * b[2][1]) - b[0][1] * (b[1][0] * b[2][2] - b[1][2] * b[2][0]) + b[0][2] * (b[1][0] * b[2][1] - b[1][1] * b[2][0])
    phi = F.acos(F.least(F.greatest(det / 2, F.lit(-1.0)), F.lit(1.0))) / 3
    high = q + 2 * p * F.cos(phi)
    low = q + 2 * p * F.cos(phi + 2 * math.pi / 3)
    same = p2 == 0
    return [F.when(same, q).otherwise(low), F.when(same, q).otherwise(3 * q - high - low), F.when(same, q).otherwise(high)]


def eigenvector(a: Sequence[Sequence[Column]], value: Column) -> list[Column]:
    """A unit vector of the null space of a - value * I: the longest cross product of its rows."""
    m = [[a[i][j] - (value if i == j else 0) for j in range(3)] for i in range(3)]
    c = [cross(m[0], m[1]), cross(m[0], m[2]), cross(m[1], m[2])]
    n = [dot(v, v) for v in c]
    out = []
    for i in range(3):
        pick = F.when((n[0] >= n[1]) & (n[0] >= n[2]), c[0][i] / F.sqrt(n[0])).when(n[1] >= n[2], c[1][i] / F.sqrt(n[1])).otherwise(c[2][i] / F.sqrt(n[2]))
        out.append(pick)
    return out


def symmetric_roots2(a: Column, b: Column, d: Column) -> list[Column]:
    """Eigenvalues of [[a, b], [b, d]], ascending."""
    mid, half = (a + d) / 2, F.sqrt((a - d) * (a - d) / 4 + b * b)
    return [mid - half, mid + half]


def plane_crossing(a: Sequence[Column], b: Sequence[Column], axis: int, level: Column) -> tuple[Column, list[Column]]:
    """Whether segment ab crosses the plane axis=level, and where."""
    da, db = a[axis] - level, b[axis] - level
    t = da / (da - db)
    return (da * db < 0), [p + t * (q - p) for p, q in zip(a, b, strict=True)]


def ray_plane(o: Sequence[Column], d: Sequence[Column], p: Sequence[Column], n: Sequence[Column]) -> Column:
    """Ray parameter where o + t d meets the plane through p with normal n; null if parallel."""
    denominator = dot(n, d)
    return F.when(denominator != 0, dot(n, [x - y for x, y in zip(p, o, strict=True)]) / denominator)


def barycentric(px: Column, py: Column, t: Sequence[Sequence[Column]]) -> list[Column]:
    (x1, y1), (x2, y2), (x3, y3) = t
    det = (y2 - y3) * (x1 - x3) + (x3 - x2) * (y1 - y3)
    a = ((y2 - y3) * (px - x3) + (x3 - x2) * (py - y3)) / det
    b = ((y3 - y1) * (px - x3) + (x1 - x3) * (py - y3)) / det
    return [a, b, 1 - a - b]


def thinnest_axis(ex: Column, ey: Column, ez: Column) -> Column:
    """0, 1 or 2: the axis of least extent, first on ties."""
    return F.when((ex <= ey) & (ex <= ez), 0).when(ey <= ez, 1).otherwise(2).cast("long")


def pack_rgb(r: Column, g: Column, b: Column) -> Column:
    return F.shiftleft(r.cast("long"), 16).bitwiseOR(F.shiftleft(g.cast("long"), 8)).bitwiseOR(b.cast("long"))


def unpack_rgb(c: Column) -> list[Column]:
    return [F.shiftright(c, s).bitwiseAND(255) for s in (16, 8, 0)]


def blend(top: Column, bottom: Column, alpha: Column) -> Column:
    """bottom under top with alpha in 0..255."""
    return top * (alpha / 255.0) + bottom * (1 - alpha / 255.0)


def polar_cells(i: Column, j: Column, mins: tuple[float, float], steps: tuple[float, float], n: tuple[int, int]) -> list[Column]:
    """The four grid corners around (i, j) as linear indices (row-major), the angular index j wrapping, and whether it wrapped."""
    a = F.floor((i - mins[0]) / steps[0]).cast("long")
    b = F.floor((j - mins[1]) / steps[1]).cast("long")
    wrap = F.pmod(b + 1, F.lit(n[1]))
    b0 = F.pmod(b, F.lit(n[1]))
    return [a * n[1] + b0, a * n[1] + wrap, (a + 1) * n[1] + b0, (a + 1) * n[1] + wrap, (b + 1 >= n[1])]


def grey_world(v: Column, mean: Column, grey: Column) -> Column:
    """Colour constancy: a channel scaled so that its mean becomes grey, clipped to 255."""
    return F.least(v * grey / mean, F.lit(255.0))
