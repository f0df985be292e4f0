"""Images as pixel tables (img, row, col, values): neighbourhood filters as windows, masks, segments, scores.

A window over a line of pixels holds one line of one image, so tasks stay small however many images there are.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _axis(df: DataFrame, by: Sequence[str], axis: str, before: int, after: int):
    other = "col" if axis == "row" else "row"
    return Window.partitionBy(*by, other).orderBy(axis).rowsBetween(-before, after)


def morph(df: DataFrame, value: str, rows: int, cols: int, kind: str, by: Sequence[str] = ("img",)) -> DataFrame:
    """Dilation ('max') or erosion ('min') by a rows x cols rectangle anchored at its centre; outside pixels don't count. Two one-dimensional windows."""
    f = F.max if kind == "max" else F.min
    for axis, n in (("col", cols), ("row", rows)):
        before, after = (n // 2, n - 1 - n // 2) if kind == "min" else (n - 1 - n // 2, n // 2)
        df = df.withColumn(value, f(value).over(_axis(df, by, axis, before, after)))
    return df


def dilate(df: DataFrame, value: str, rows: int, cols: int, by: Sequence[str] = ("img",)) -> DataFrame:
    return morph(df, value, rows, cols, "max", by)


def erode(df: DataFrame, value: str, rows: int, cols: int, by: Sequence[str] = ("img",)) -> DataFrame:
    return morph(df, value, rows, cols, "min", by)


def opened(df: DataFrame, value: str, rows: int, cols: int, by: Sequence[str] = ("img",)) -> DataFrame:
    return dilate(erode(df, value, rows, cols, by), value, rows, cols, by)


def closed(df: DataFrame, value: str, rows: int, cols: int, by: Sequence[str] = ("img",)) -> DataFrame:
    return erode(dilate(df, value, rows, cols, by), value, rows, cols, by)


def stencil(df: DataFrame, value: str, weights: Sequence[Sequence[float]], by: Sequence[str] = ("img",)) -> Column:
    """Weighted sum of the neighbourhood by offsets; needs the columns of with_neighbours()."""
    h, w = len(weights) // 2, len(weights[0]) // 2
    out = F.lit(0.0)
    for i, line in enumerate(weights):
        for j, k in enumerate(line):
            if k:
                out = out + F.col(f"{value}_{i - h}_{j - w}") * float(k)
    return out


def with_neighbours(df: DataFrame, value: str, reach: int = 1, by: Sequence[str] = ("img",)) -> DataFrame:
    """Columns value_i_j of the neighbours at row + i, col + j; the border repeats itself."""
    across, down = Window.partitionBy(*by, "row").orderBy("col"), Window.partitionBy(*by, "col").orderBy("row")

    def shifted(c: str, w, d: int, edge: str) -> Column:
        if d == 0:
            return F.col(c)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return F.coalesce(F.lead(c, d).over(w) if d > 0 else F.lag(c, -d).over(w), F.last(c).over(whole) if d > 0 else F.first(c).over(whole))

    df = df.withColumns({f"__{i + reach}": shifted(value, down, i, "row") for i in range(-reach, reach + 1)})
    return df.withColumns({f"{value}_{i}_{j}": shifted(f"__{i + reach}", across, j, "col") for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)}).drop(*(f"__{i}" for i in range(2 * reach + 1)))


#: The customary 3x3 and 2x2 edge stencils.
SOBEL_X = ((-1, 0, 1), (-2, 0, 2), (-1, 0, 1))
SOBEL_Y = ((-1, -2, -1), (0, 0, 0), (1, 2, 1))


def sobel(df: DataFrame, value: str, by: Sequence[str] = ("img",)) -> DataFrame:
    n = with_neighbours(df, value, 1, by)
    gx, gy = stencil(n, value, SOBEL_X), stencil(n, value, SOBEL_Y)
    return n.select(*df.columns, F.sqrt(gx * gx + gy * gy).alias("sobel"))


def roberts(df: DataFrame, value: str, by: Sequence[str] = ("img",)) -> DataFrame:
    n = with_neighbours(df, value, 1, by)
    a, b = F.col(f"{value}_0_0") - F.col(f"{value}_1_1"), F.col(f"{value}_0_1") - F.col(f"{value}_1_0")
    return n.select(*df.columns, F.sqrt(a * a + b * b).alias("roberts"))


def gaussian(df: DataFrame, value: str, size: int, sigma: float, by: Sequence[str] = ("img",)) -> DataFrame:
    """Separable Gaussian blur; weights of pixels outside the image are left out."""
    k = [math.exp(-((i - size // 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    for axis in ("col", "row"):
        w = Window.partitionBy(*by, "col" if axis == "row" else "row").orderBy(axis)
        total, weight = F.lit(0.0), F.lit(0.0)
        for i, g in enumerate(k):
            d = i - size // 2
            v = F.col(value) if d == 0 else F.lead(value, d).over(w) if d > 0 else F.lag(value, -d).over(w)
            total, weight = total + F.coalesce(v * g, F.lit(0.0)), weight + F.when(v.isNotNull(), g).otherwise(0.0)
        df = df.withColumn(value, total / weight)
    return df


def median_blur(df: DataFrame, value: str, reach: int = 1, by: Sequence[str] = ("img",)) -> DataFrame:
    n = with_neighbours(df, value, reach, by)
    side = 2 * reach + 1
    cells = F.sort_array(F.array(*(F.col(f"{value}_{i}_{j}") for i in range(-reach, reach + 1) for j in range(-reach, reach + 1))))
    return n.select(*(c for c in df.columns if c != value), cells[side * side // 2].alias(value))


def trimap(df: DataFrame, prob: str, bg: tuple[float, float, float, float], rows: int, cols: int, fg_threshold: float, open_: int = 5, grow: int = 20, shrink: int = 10, by: Sequence[str] = ("img",)) -> DataFrame:
    """is_bg, is_fg, is_mid: background is where the grown mask of prob > 0 ends or within the margins bg (shares of left, top, right, bottom); foreground the shrunken mask above the threshold. Background wins."""
    d = df.withColumn("__m", (F.col(prob) > 0).cast("int")).withColumn("__f", (F.col(prob) > fg_threshold).cast("int"))
    d = closed(dilate(opened(d, "__m", open_, open_, by), "__m", grow, grow, by), "__m", open_, open_, by)
    d = erode(closed(d, "__f", open_, open_, by), "__f", shrink, shrink, by)
    left, top, right, bottom = bg
    rim = (F.col("col") < left * cols) | (F.col("row") < top * rows) | (F.col("col") >= (1 - right) * cols) | (F.col("row") >= (1 - bottom) * rows)
    is_bg = (F.col("__m") == 0) | rim
    is_fg = (F.col("__f") == 1) & ~is_bg
    return d.select(*df.columns, is_bg.alias("is_bg"), is_fg.alias("is_fg"), (~is_bg & ~is_fg).alias("is_mid"))


def rescaled(df: DataFrame, value: str, by: Sequence[str] = ("img",), low: float = 0.0, high: float = 1.0) -> DataFrame:
    w = Window.partitionBy(*by)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(value, F.when(hi > lo, (F.col(value) - lo) / (hi - lo) * (high - low) + low).otherwise(F.lit(low)))


def segment_votes(df: DataFrame, by: Sequence[str] = ("img", "seg")) -> DataFrame:
    """n, n_bg, n_fg and the class of each segment: BG where background pixels are most (asked first), FG where foreground pixels are, MID else."""
    g = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("is_bg").cast("long")).alias("n_bg"), F.sum(F.col("is_fg").cast("long")).alias("n_fg"))
    return g.withColumn("kind", F.when(F.col("n_bg") * 2 > F.col("n"), "BG").when(F.col("n_fg") * 2 > F.col("n"), "FG").otherwise("MID"))


def region_graph(df: DataFrame, by: Sequence[str] = ("img",), edge: str | None = None) -> DataFrame:
    """a < b: 8-connected segment pairs, n touching pixel pairs and (with `edge`) their mean edge strength. Neighbours come from windows, not joins."""
    down, across = Window.partitionBy(*by, "col").orderBy("row"), Window.partitionBy(*by, "row").orderBy("col")
    v = F.struct("seg", F.col(edge).alias("e")) if edge else F.struct("seg", F.lit(0.0).alias("e"))
    d = df.withColumn("__v", v).withColumn("__s", F.lead("__v").over(down))
    d = d.withColumns({"__e": F.lead("__v").over(across), "__se": F.lead("__s").over(across), "__sw": F.lag("__s").over(across)})
    p = d.select(*by, "__v", F.explode(F.array("__s", "__e", "__se", "__sw")).alias("o")).filter("o is not null and o.seg <> __v.seg")
    g = p.groupBy(*by, F.least("__v.seg", "o.seg").alias("a"), F.greatest("__v.seg", "o.seg").alias("b"))
    return g.agg(F.count("*").alias("n"), F.avg((F.col("__v.e") + F.col("o.e")) / 2).alias("weight"))


def mean_silhouette(df: DataFrame, by: Sequence[str] = ("label",)) -> DataFrame:
    """The pixel-wise mean of the masks of each label, times 255, truncated."""
    return df.groupBy(*by, "row", "col").agg(F.floor(F.avg("value") * 255).cast("long").alias("value"))


def connected(df: DataFrame, by: Sequence[str] = ("img",)) -> DataFrame:
    """Foreground pixels (img, row, col) with `comp`, the least pixel number of their 8-connected component.

    Runs of a row are found by windows, touching runs of neighbouring rows are joined, and the runs' links are resolved by alternating star rounds.
    """
    from .mesh import saved

    w = Window.partitionBy(*by, "row").orderBy("col")
    p = df.withColumn("__g", F.col("col") - F.row_number().over(w))
    runs = p.groupBy(*by, "row", "__g").agg(F.min("col").alias("c0"), F.max("col").alias("c1"))
    runs = saved(runs.withColumn("run", F.struct(*by, "row", "c0")))
    a, b = runs.select(F.col("run").alias("ra"), *by, "row", "c0", "c1"), runs.select(F.col("run").alias("rb"), *by, (F.col("row") + 1).alias("row"), F.col("c0").alias("d0"), F.col("c1").alias("d1"))
    links = saved(a.join(b, [*by, "row"]).filter("c0 <= d1 + 1 and d0 <= c1 + 1").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct())
    e = links
    while True:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("m", "a").alias("m"))
        large = saved(both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        new = saved(large.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").filter("a <> b").distinct())
        done = not new.join(e, ["a", "b"], "left_anti").limit(1).count() and not e.join(new, ["a", "b"], "left_anti").limit(1).count()
        e = new
        if done:
            break
    roots = e.select(F.col("a").alias("run"), F.col("b").alias("root"))
    named = runs.join(roots, "run", "left").select(*by, "row", "__g", F.coalesce("root", "run").alias("comp"))
    return p.join(named, [*by, "row", "__g"]).drop("__g")


def without_small(df: DataFrame, least: int, by: Sequence[str] = ("img",)) -> DataFrame:
    """Pixels of components of at least `least` pixels."""
    c = connected(df, by)
    big = c.groupBy("comp").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return c.join(big.select("comp"), "comp", "left_semi")


def largest_component(df: DataFrame, by: Sequence[str] = ("img",)) -> DataFrame:
    c = connected(df, by)
    n = c.groupBy(*by, "comp").agg(F.count("*").alias("n"))
    best = n.groupBy(*by).agg(F.min_by("comp", F.struct(-F.col("n"), F.col("comp"))).alias("comp"))
    return c.join(best.select("comp"), "comp", "left_semi")


def background_model(frames: DataFrame, by: Sequence[str] = ("row", "col")) -> DataFrame:
    """mean and var of each pixel over the training frames."""
    return frames.groupBy(*by).agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"))


def foreground(frame: DataFrame, model: DataFrame, threshold: float = 6.0, floor: float = 1.0) -> DataFrame:
    """Pixels with fg: squared distance from the mean above threshold variances."""
    d = F.col("value") - F.col("mean")
    return frame.join(model, ["row", "col"]).withColumn("fg", d * d > threshold * F.greatest("var", F.lit(floor)))


def ssim(a: DataFrame, b: DataFrame, reach: int = 3, span: float = 255.0, by: Sequence[str] = ("img",)) -> DataFrame:
    """Structural similarity of two images at each pixel, by box windows."""
    j = a.join(b.withColumnRenamed("value", "other"), [*by, "row", "col"])
    cols = {"x": F.col("value").cast("double"), "y": F.col("other").cast("double")}
    j = j.select(*by, "row", "col", *(c.alias(n) for n, c in cols.items()))
    j = j.withColumns({"xx": F.col("x") * F.col("x"), "yy": F.col("y") * F.col("y"), "xy": F.col("x") * F.col("y"), "n": F.lit(1.0)})
    for axis in ("col", "row"):
        j = j.withColumns({c: F.sum(c).over(_axis(j, by, axis, reach, reach)) for c in ("x", "y", "xx", "yy", "xy", "n")})
    n = F.col("n")
    mx, my = F.col("x") / n, F.col("y") / n
    vx, vy, cov = F.col("xx") / n - mx * mx, F.col("yy") / n - my * my, F.col("xy") / n - mx * my
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    return j.select(*by, "row", "col", ((2 * mx * my + c1) * (2 * cov + c2) / ((mx * mx + my * my + c1) * (vx + vy + c2))).alias("ssim"))


def per_image(df: DataFrame, f: Callable[[np.ndarray], np.ndarray], value: str = "value", by: Sequence[str] = ("img",), out: str = "double") -> DataFrame:
    """f over each image as a dense array; one image a task. For filters that are not windows."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        h, w = int(g["row"].max()) + 1, int(g["col"].max()) + 1
        a = np.zeros((h, w))
        a[g["row"].to_numpy(), g["col"].to_numpy()] = g[value].to_numpy(dtype=float)
        b = np.asarray(f(a))
        r, c = np.indices(b.shape)
        res = pd.DataFrame({k: [g[k].iloc[0]] * b.size for k in by})
        res["row"], res["col"], res[value] = r.ravel(), c.ravel(), b.ravel()
        return res

    schema = ", ".join([*(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in by), f"row long, col long, {value} {out}"])
    return df.select(*by, "row", "col", value).groupBy(*by).applyInPandas(run, schema)


def resize_array(a: np.ndarray, rows: int, cols: int) -> np.ndarray:
    """Cubic convolution resize (a = -0.5), edges repeated."""

    def kernel(t: np.ndarray) -> np.ndarray:
        t = np.abs(t)
        return np.where(t <= 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0))

    def one(x: np.ndarray, n: int) -> np.ndarray:
        at = (np.arange(n) + 0.5) * len(x) / n - 0.5
        base = np.floor(at).astype(int)
        w = np.stack([kernel(at - (base + k)) for k in (-1, 0, 1, 2)], 1)
        idx = np.clip(base[:, None] + np.array([-1, 0, 1, 2]), 0, len(x) - 1)
        return np.einsum("nk,nk...->n...", w / w.sum(1, keepdims=True), x[idx])

    return one(one(a, rows).T, cols).T


def canny_array(a: np.ndarray, low: float, high: float) -> np.ndarray:
    """Edges: gradient maxima across the edge, kept by two thresholds and connection."""
    p = np.pad(a, 1, mode="edge")
    gx = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    gy = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    mag = np.hypot(gx, gy)
    sector = np.round(np.arctan2(gy, gx) / (np.pi / 4)).astype(int) % 4
    q = np.pad(mag, 1)
    step = [(0, 1), (1, 1), (1, 0), (1, -1)]
    ahead = np.choose(sector, [q[1 + i : q.shape[0] - 1 + i or None, 1 + j : q.shape[1] - 1 + j or None][: mag.shape[0], : mag.shape[1]] for i, j in step])
    behind = np.choose(sector, [q[1 - i : q.shape[0] - 1 - i, 1 - j : q.shape[1] - 1 - j or None][: mag.shape[0], : mag.shape[1]] for i, j in step])
    peak = (mag >= ahead) & (mag >= behind)
    weak, strong = peak & (mag > low), peak & (mag > high)
    while True:
        g = np.pad(strong, 1)
        near = np.zeros_like(strong)
        for i in range(3):
            for j in range(3):
                near |= g[i : i + mag.shape[0], j : j + mag.shape[1]]
        new = weak & near | strong
        if (new == strong).all():
            return new
        strong = new


def clahe_array(a: np.ndarray, clip: float = 2.0, tiles: int = 8) -> np.ndarray:
    """Contrast-limited equalisation of 0..255 by tiles, mappings interpolated between tile centres."""
    h, w = a.shape
    v = np.clip(a, 0, 255).astype(int)
    th, tw = max(1, math.ceil(h / tiles)), max(1, math.ceil(w / tiles))
    ny, nx = math.ceil(h / th), math.ceil(w / tw)
    maps = np.zeros((ny, nx, 256))
    for y in range(ny):
        for x in range(nx):
            t = v[y * th : (y + 1) * th, x * tw : (x + 1) * tw]
            hist = np.bincount(t.ravel(), minlength=256).astype(float)
            limit = max(1.0, clip * t.size / 256)
            extra = np.maximum(hist - limit, 0).sum()
            maps[y, x] = np.cumsum(np.minimum(hist, limit) + extra / 256) * 255 / t.size
    fy, fx = (np.arange(h) + 0.5) / th - 0.5, (np.arange(w) + 0.5) / tw - 0.5
    y0, x0 = np.clip(np.floor(fy).astype(int), 0, ny - 1), np.clip(np.floor(fx).astype(int), 0, nx - 1)
    y1, x1 = np.minimum(y0 + 1, ny - 1), np.minimum(x0 + 1, nx - 1)
    ay, ax = np.clip(fy - y0, 0, 1)[:, None], np.clip(fx - x0, 0, 1)[None]
    g = lambda y, x: maps[y[:, None], x[None], v]
    return (1 - ay) * ((1 - ax) * g(y0, x0) + ax * g(y0, x1)) + ay * ((1 - ax) * g(y1, x0) + ax * g(y1, x1))


def simplified(p: np.ndarray, eps: float) -> np.ndarray:
    """Indices that Douglas-Peucker keeps of a polyline."""
    keep, stack = {0, len(p) - 1}, [(0, len(p) - 1)]
    while stack:
        a, b = stack.pop()
        if b - a < 2:
            continue
        d = p[b] - p[a]
        n = np.linalg.norm(d)
        off = p[a + 1 : b] - p[a]
        dist = np.abs(d[0] * off[:, 1] - d[1] * off[:, 0]) / n if n else np.linalg.norm(off, axis=1)
        i = int(dist.argmax())
        if dist[i] > eps:
            keep.add(a + 1 + i)
            stack += [(a, a + 1 + i), (a + 1 + i, b)]
    return np.array(sorted(keep))


def smoothed_contour(df: DataFrame, by: Sequence[str], size: int, sigma: float) -> DataFrame:
    """Points of each contour averaged with Gaussian weights along it; ends use what there is."""
    w = Window.partitionBy(*by).orderBy("pos")
    out = {}
    for c in ("x", "y"):
        total, weight = F.lit(0.0), F.lit(0.0)
        for d in range(-(size // 2), size // 2 + 1):
            g = math.exp(-d * d / (2 * sigma * sigma))
            v = F.col(c) if d == 0 else F.lead(c, d).over(w) if d > 0 else F.lag(c, -d).over(w)
            total, weight = total + F.coalesce(v * g, F.lit(0.0)), weight + F.when(v.isNotNull(), g).otherwise(0.0)
        out[c] = total / weight
    return df.select(*by, "pos", *(v.alias(c) for c, v in out.items()))
