"""Models over pixels and features: Gaussian mixtures, superpixels, graph cuts, dense CRF, pose clusters, HOG classifiers.

Kernels take one image (or one segment) as arrays and run grouped, one image a task; clustering of all rows uses pyspark.ml.
Kernel machines over many rows are solved by conjugate gradients; the kernel matrix is worked out block by block and never held.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch

#: Rows up to which a kernel matrix is solved in one task; beyond, its products are dealt over the cluster.
DIRECT_ROWS = 4000
#: Rows of a task's part of a kernel matrix, at most, and of the blocks in which it is worked out.
GROUP_ROWS, BLOCK_ROWS = 16_384, 1024


# Gaussian mixtures
def _log_gauss(x: np.ndarray, mean: np.ndarray, cov: np.ndarray) -> np.ndarray:
    d = x.shape[1]
    chol = np.linalg.cholesky(cov)
    z = np.linalg.solve(chol, (x - mean).T)
    return -0.5 * (d * np.log(2 * np.pi) + (z * z).sum(0)) - np.log(np.diag(chol)).sum()


class Mixture:
    """Expectation maximisation with spherical, diagonal, tied or full covariances."""

    def __init__(self, k: int, kind: str = "full", seed: int = 0, steps: int = 60, floor: float = 1e-6):
        self.k, self.kind, self.seed, self.steps, self.floor = k, kind, seed, steps, floor

    def fit(self, x: np.ndarray) -> Mixture:
        rng = np.random.default_rng(self.seed)
        n, d = x.shape
        k = self.k = min(self.k, n)
        at = [int(rng.integers(n))]
        for _ in range(k - 1):
            far = ((x[:, None] - x[at][None]) ** 2).sum(2).min(1)
            at.append(int(rng.choice(n, p=far / far.sum())) if far.sum() > 0 else int(rng.integers(n)))
        self.means = x[at].astype(float)
        base = np.cov(x.T, bias=True).reshape(d, d) + np.eye(d) * self.floor if n > 1 else np.eye(d)
        self.covs, self.weights = np.repeat(base[None], k, 0), np.full(k, 1 / k)
        last = -np.inf
        for _ in range(self.steps):
            ll = self.joint(x)
            top = np.logaddexp.reduce(ll, 1)
            r = np.exp(ll - top[:, None])
            nk = r.sum(0) + 1e-12
            self.weights, self.means = nk / n, (r.T @ x) / nk[:, None]
            for j in range(k):
                e = x - self.means[j]
                c = (r[:, j, None] * e).T @ e / nk[j]
                if self.kind == "diag":
                    c = np.diag(np.diag(c))
                elif self.kind == "spherical":
                    c = np.eye(d) * np.trace(c) / d
                self.covs[j] = c + np.eye(d) * self.floor
            if self.kind == "tied":
                self.covs[:] = (self.covs * self.weights[:, None, None]).sum(0)
            if top.sum() - last < 1e-6 * abs(top.sum()):
                break
            last = top.sum()
        return self

    def joint(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.log(self.weights[j] + 1e-300) + _log_gauss(x, self.means[j], self.covs[j]) for j in range(self.k)], 1)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        return np.logaddexp.reduce(self.joint(x), 1)

    def bic(self, x: np.ndarray) -> float:
        d = x.shape[1]
        cov = {"full": self.k * d * (d + 1) / 2, "tied": d * (d + 1) / 2, "diag": self.k * d, "spherical": self.k}[self.kind]
        return float(-2 * self.log_density(x).sum() + (self.k * d + self.k - 1 + cov) * np.log(len(x)))


def best_mixture(x: np.ndarray, ks: Sequence[int] = (1, 2, 3, 4, 5), kinds: Sequence[str] = ("spherical", "tied", "diag", "full"), seed: int = 0) -> Mixture:
    """The model of least BIC."""
    models = [Mixture(k, kind, seed).fit(x) for kind in kinds for k in ks if k <= len(x)]
    return min(models, key=lambda m: m.bic(x))


def mixture_table(df: DataFrame, by: Sequence[str], features: Sequence[str], ks: Sequence[int], kinds: Sequence[str]) -> DataFrame:
    """by, kind, k, bic of every model of each group, and whether it is the group's best."""
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by), "kind string, k long, bic double, best boolean"])

    def run(g: pd.DataFrame) -> pd.DataFrame:
        x = g.sort_values(list(features))[list(features)].to_numpy(dtype=float)
        rows = [(kind, k, Mixture(k, kind).fit(x).bic(x)) for kind in kinds for k in ks if k <= len(x)]
        out = pd.DataFrame(rows, columns=["kind", "k", "bic"])
        out["best"] = out.index == (out["bic"].idxmin() if len(out) else -1)
        for c in reversed(by):
            out.insert(0, c, g[c].iloc[0])
        return out

    return df.groupBy(*by).applyInPandas(run, schema)


def spark_mixture(df: DataFrame, features: Sequence[str], k: int, seed: int = 3) -> DataFrame:
    """df with `component` by pyspark.ml's full-covariance mixture over all rows."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=list(features), outputCol="__v").transform(df)
    return GaussianMixture(featuresCol="__v", predictionCol="component", k=k, seed=seed).fit(v).transform(v).drop("__v", "probability")


# superpixels
def slic(img: np.ndarray, segments: int, compactness: float = 10.0, rounds: int = 8) -> np.ndarray:
    """Superpixels: k-means over colour and place, each centre searching its own neighbourhood. img: (h, w, channels)."""
    h, w = img.shape[:2]
    step = max(1, int(np.sqrt(h * w / max(1, segments))))
    ys, xs = np.meshgrid(np.arange(step // 2, h, step), np.arange(step // 2, w, step), indexing="ij")
    c = np.concatenate((img[ys.ravel(), xs.ravel()], np.stack((ys.ravel(), xs.ravel()), 1)), 1).astype(float)
    yy, xx = np.indices((h, w))
    label = np.zeros((h, w), dtype=np.int64)
    for _ in range(rounds):
        dist = np.full((h, w), np.inf)
        for i, k in enumerate(c):
            y0, y1, x0, x1 = max(0, int(k[-2]) - 2 * step), min(h, int(k[-2]) + 2 * step + 1), max(0, int(k[-1]) - 2 * step), min(w, int(k[-1]) + 2 * step + 1)
            d = ((img[y0:y1, x0:x1] - k[:-2]) ** 2).sum(2) + (compactness / step) ** 2 * ((yy[y0:y1, x0:x1] - k[-2]) ** 2 + (xx[y0:y1, x0:x1] - k[-1]) ** 2)
            near = d < dist[y0:y1, x0:x1]
            dist[y0:y1, x0:x1][near] = d[near]
            label[y0:y1, x0:x1][near] = i
        n = np.bincount(label.ravel(), minlength=len(c)).astype(float)
        sums = [np.bincount(label.ravel(), v.ravel().astype(float), len(c)) for v in (*np.moveaxis(img, 2, 0), yy, xx)]
        c = np.where(n[:, None] > 0, np.stack(sums, 1) / np.maximum(n, 1)[:, None], c)
    _, label = np.unique(label, return_inverse=True)
    return label.reshape(h, w)


def felzenszwalb(img: np.ndarray, scale: float = 100.0, least: int = 20) -> np.ndarray:
    """Graph segmentation: edges by rising difference join regions whose inner difference allows it; small regions are joined at last."""
    h, w = img.shape[:2]
    at = np.arange(h * w).reshape(h, w)
    flat = img.reshape(h * w, -1).astype(float)
    pairs = np.concatenate([np.stack((a.ravel(), b.ravel()), 1) for a, b in ((at[:, :-1], at[:, 1:]), (at[:-1], at[1:]), (at[:-1, :-1], at[1:, 1:]), (at[1:, :-1], at[:-1, 1:]))])
    weight = np.sqrt(((flat[pairs[:, 0]] - flat[pairs[:, 1]]) ** 2).sum(1))
    up, size, inner = list(range(h * w)), [1] * (h * w), [0.0] * (h * w)

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    order = np.argsort(weight, kind="stable")
    for limit in (False, True):
        for e in order:
            a, b = root(int(pairs[e, 0])), root(int(pairs[e, 1]))
            if a == b:
                continue
            if (min(size[a], size[b]) < least) if limit else weight[e] <= min(inner[a] + scale / size[a], inner[b] + scale / size[b]):
                up[b] = a
                size[a] += size[b]
                inner[a] = max(inner[a], inner[b], float(weight[e]))
    _, label = np.unique([root(i) for i in range(h * w)], return_inverse=True)
    return label.reshape(h, w)


def mean_shift(img: np.ndarray, space: int = 4, colour: float = 20.0, rounds: int = 5) -> np.ndarray:
    """Each pixel's colour moved to the mean of near, similar pixels, a few times."""
    out = img.astype(float)
    for _ in range(rounds):
        total, weight = np.zeros_like(out), np.zeros(out.shape[:2])
        p = np.pad(out, ((space, space), (space, space), (0, 0)), mode="edge")
        for i in range(2 * space + 1):
            for j in range(2 * space + 1):
                q = p[i : i + out.shape[0], j : j + out.shape[1]]
                near = ((q - out) ** 2).sum(2) <= colour * colour
                total += q * near[..., None]
                weight += near
        out = total / weight[..., None]
    return out


# cuts
def max_flow_cut(n: int, source: np.ndarray, sink: np.ndarray, edges: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Nodes on the source side of a least cut (shortest augmenting paths by levels). edges: (m, 2), undirected."""
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, cap = [], []

    def arc(a: int, b: int, c: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        cap.append(c)
        head[b].append(len(to))
        to.append(a)
        cap.append(back)

    s, t = n, n + 1
    for i in range(n):
        common = min(source[i], sink[i])
        if source[i] > common:
            arc(s, i, float(source[i] - common), 0.0)
        if sink[i] > common:
            arc(i, t, float(sink[i] - common), 0.0)
    for (a, b), w in zip(edges.tolist(), weight.tolist(), strict=True):
        arc(a, b, w, w)
    eps = 1e-12
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if cap[e] > eps and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return np.array([level[i] >= 0 for i in range(n)])
        nxt = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                f = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= f
                    cap[e ^ 1] += f
                path, u = [], s
                continue
            while nxt[u] < len(head[u]):
                e = head[u][nxt[u]]
                if cap[e] > eps and level[to[e]] == level[u] + 1:
                    break
                nxt[u] += 1
            if nxt[u] < len(head[u]):
                path.append(head[u][nxt[u]])
                u = to[path[-1]]
            elif u == s:
                break
            else:
                level[u] = -1
                u = to[path.pop() ^ 1]


def superpixel_cut(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """img, seg, fg: the least cut of each image's segments. nodes: img, seg, fg_score, bg_score; edges: img, a, b, weight."""

    def run(key: tuple, n: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        n = n.sort_values("seg")
        at = {s: i for i, s in enumerate(n["seg"].tolist())}
        e = e.sort_values(["a", "b"])
        pairs = np.array([(at[a], at[b]) for a, b in zip(e["a"], e["b"], strict=True)], dtype=np.int64).reshape(-1, 2)
        fg = max_flow_cut(len(n), n["fg_score"].to_numpy(), n["bg_score"].to_numpy(), pairs, e["weight"].to_numpy(dtype=float))
        return pd.DataFrame({"img": n["img"].to_numpy(), "seg": n["seg"].to_numpy(), "fg": fg})

    return nodes.groupBy("img").cogroup(edges.groupBy("img")).applyInPandas(run, "img long, seg long, fg boolean")


def grabcut(img: np.ndarray, trimap: np.ndarray, rounds: int = 3, k: int = 3, gamma: float = 50.0) -> np.ndarray:
    """Foreground mask: mixtures of both sides and a pixel cut in turn. trimap: 0 background, 1 foreground, 2 likely foreground."""
    h, w = img.shape[:2]
    flat = img.reshape(h * w, -1).astype(float)
    at = np.arange(h * w).reshape(h, w)
    pairs = np.concatenate([np.stack((a.ravel(), b.ravel()), 1) for a, b in ((at[:, :-1], at[:, 1:]), (at[:-1], at[1:]))])
    diff = ((flat[pairs[:, 0]] - flat[pairs[:, 1]]) ** 2).sum(1)
    weight = gamma * np.exp(-diff / max(2 * diff.mean(), 1e-9))
    fg = trimap.ravel() > 0
    for _ in range(rounds):
        if fg.all() or not fg.any():
            break
        f, b = (Mixture(min(k, int(m.sum())), "full", floor=1e-2).fit(flat[m]).log_density(flat) for m in (fg, ~fg))
        low = np.minimum(f, b)
        s, t = f - low, b - low
        s[trimap.ravel() == 1], t[trimap.ravel() == 1] = 1e6, 0
        s[trimap.ravel() == 0], t[trimap.ravel() == 0] = 0, 1e6
        new = max_flow_cut(h * w, s, t, pairs, weight)
        if (new == fg).all():
            break
        fg = new
    return fg.reshape(h, w)


def block_grabcut(img: np.ndarray, trimap: np.ndarray, rows: int = 5, cols: int = 2) -> np.ndarray:
    """grabcut() in each of rows x cols blocks."""
    out = np.zeros(img.shape[:2], dtype=bool)
    for ys in np.array_split(np.arange(img.shape[0]), rows):
        for xs in np.array_split(np.arange(img.shape[1]), cols):
            cut = np.ix_(ys, xs)
            out[cut] = grabcut(img[cut], trimap[cut])
    return out


def dense_crf(img: np.ndarray, prob: np.ndarray, rounds: int = 5, place: float = 3.0, colour: float = 13.0, wide: float = 80.0, w1: float = 3.0, w2: float = 10.0, chunk: int = 1 << 21) -> np.ndarray:
    """Mean-field steps with a Gaussian and a bilateral kernel over all pairs of pixels, normalised symmetrically. prob: (h, w, labels).

    As in the usual implementation a pixel counts as its own neighbour. Time grows with the square of the pixels; `chunk` pairs are held at once.
    """
    h, w, labels = prob.shape
    n = h * w
    unary = -np.log(np.clip(prob, 1e-9, 1)).reshape(n, labels)
    rows, cols = (np.exp(-((np.arange(m)[:, None] - np.arange(m)) ** 2) / (2 * place * place)) for m in (h, w))
    at = np.indices((h, w)).reshape(2, n).T / wide
    f = np.concatenate((at, img.reshape(n, -1) / colour), 1)
    f = f - f.mean(0)
    sq = (f * f).sum(1)
    step = max(1, chunk // n)

    def gaussian(q: np.ndarray) -> np.ndarray:
        return np.einsum("ab,bcl,dc->adl", rows, q.reshape(h, w, -1), cols, optimize=True).reshape(n, -1)

    def bilateral(q: np.ndarray) -> np.ndarray:
        parts = (np.exp(-np.maximum(sq[i : i + step, None] + sq - 2 * f[i : i + step] @ f.T, 0) / 2) @ q for i in range(0, n, step))
        return np.concatenate(list(parts))

    kernels = [(k, weight, 1 / np.sqrt(k(np.ones((n, 1))))) for k, weight in ((gaussian, w1), (bilateral, w2))]
    q = np.exp(-unary)
    q /= q.sum(1, keepdims=True)
    for _ in range(rounds):
        e = sum(weight * norm * k(norm * q) for k, weight, norm in kernels) - unary
        q = np.exp(e - e.max(1, keepdims=True))
        q /= q.sum(1, keepdims=True)
    return q.reshape(h, w, labels)


def hog(img: np.ndarray, cell: int = 8, bins: int = 9) -> np.ndarray:
    """Orientation histograms of cells, normalised by 2x2 blocks."""
    a = img.astype(float)
    gy, gx = np.gradient(a)
    mag, ang = np.hypot(gx, gy), np.mod(np.arctan2(gy, gx), np.pi)
    h, w = (a.shape[0] // cell) * cell, (a.shape[1] // cell) * cell
    b = np.minimum((ang / np.pi * bins).astype(int), bins - 1)[:h, :w]
    cy, cx = np.indices((h, w)) // cell
    ny, nx = h // cell, w // cell
    hist = np.bincount(((cy * nx + cx) * bins + b).ravel(), mag[:h, :w].ravel(), ny * nx * bins).reshape(ny, nx, bins)
    blocks = np.concatenate([hist[i : ny - 1 + i, j : nx - 1 + j] for i in (0, 1) for j in (0, 1)], 2) if ny > 1 and nx > 1 else hist
    return (blocks / np.sqrt((blocks**2).sum(2, keepdims=True) + 1e-6)).ravel()


class KernelMachine:
    """Least-squares machine with an RBF kernel, one against the rest."""

    def __init__(self, gamma: float, ridge: float):
        self.gamma, self.ridge = gamma, ridge

    def kernel(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.exp(-self.gamma * np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None] - 2 * a @ b.T, 0))

    def fit(self, x: np.ndarray, y: np.ndarray) -> KernelMachine:
        self.x, self.classes = x, np.unique(y)
        t = np.where(y[:, None] == self.classes[None], 1.0, -1.0)
        self.a = np.linalg.solve(self.kernel(x, x) + self.ridge * np.eye(len(x)), t)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.classes[(self.kernel(x, self.x) @ self.a).argmax(1)]


def cross_validated(df: DataFrame, features: str, label: str, gammas: Sequence[float], ridges: Sequence[float], folds: int = 5, direct: int = DIRECT_ROWS) -> DataFrame:
    """gamma, ridge, accuracy: each setting is a task over a table of at most `direct` rows; larger ones are solved over the cluster."""
    spark = df.sparkSession
    rows = df.select(F.col("idx"), F.col(features).alias("f"), F.col(label).alias("y"))
    n = rows.count()
    if n > direct:
        return _cross_validated_blocks(rows, n, gammas, ridges, folds)
    grid = spark.createDataFrame([(float(g), float(r)) for g in gammas for r in ridges], "gamma double, ridge double")
    rows = rows.join(F.broadcast(grid))

    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        x, y = np.stack(g["f"].to_numpy()).astype(float), g["y"].to_numpy()
        fold = np.arange(len(g)) % folds
        good = sum((KernelMachine(g["gamma"].iloc[0], g["ridge"].iloc[0]).fit(x[fold != k], y[fold != k]).predict(x[fold == k]) == y[fold == k]).sum() for k in range(folds) if (fold == k).any())
        return pd.DataFrame({"gamma": [g["gamma"].iloc[0]], "ridge": [g["ridge"].iloc[0]], "accuracy": [good / len(g)]})

    return rows.groupBy("gamma", "ridge").applyInPandas(run, "gamma double, ridge double, accuracy double")


def _matrix(col: pa.Array) -> np.ndarray:
    """Binary values of equal size as the rows of a matrix of doubles."""
    at = np.frombuffer(col.buffers()[1], dtype=np.int32)[col.offset : col.offset + len(col) + 1]
    return np.frombuffer(col.buffers()[2], dtype=np.float64, count=int(at[-1] - at[0]) // 8, offset=int(at[0])).reshape(len(col), -1)


def _binary(a: np.ndarray) -> pa.Array:
    a = np.ascontiguousarray(a, dtype=np.float64)
    at = np.arange(len(a) + 1, dtype=np.int32) * np.int32(a.shape[1] * 8)
    return pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(at), pa.py_buffer(a)])


def _stored(df: DataFrame) -> DataFrame:
    """df as files in the shared folder."""
    path = scratch(df.sparkSession, "kernel")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def _deleted(df: DataFrame) -> None:
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    df.sparkSession._jvm.System.gc()  # lets Spark drop the shuffle files of finished rounds


def _kernel_product(rows: DataFrame, vector: str, gamma: float, group: int, groups: int, finish: Callable[[dict, np.ndarray], dict], schema: str) -> DataFrame:
    """finish(columns of a group's rows, their rows of the kernel matrix times `vector`) of every group. rows: pos, f and binary columns; every group's task reads f and vector of all rows once."""
    names = rows.columns
    own = rows.select(*names, F.lit(0).alias("kind"), F.floor(F.col("pos") / group).cast("int").alias("g"))
    each = rows.select(*(F.col(c) if c in ("f", vector) else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names), F.lit(1).alias("kind"), F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("g"))
    dealt = own.union(each).repartitionById(groups, "g").sortWithinPartitions("kind").drop("g")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        mine: dict[str, np.ndarray] = {}
        for b in batches:
            n = int((b.column(len(names)).to_numpy() == 0).sum())
            if n:
                kept.append(b.slice(0, n))
            if n == b.num_rows:
                continue
            if not mine:
                mine = {c: np.concatenate([_matrix(k.column(i)) if pa.types.is_binary(k.column(i).type) else k.column(i).to_numpy() for k in kept]) for i, c in enumerate(names)}
                kept = []
                x, sq = mine["f"], (mine["f"] ** 2).sum(1)
                out = np.zeros((len(x), mine[vector].shape[1]))
            other, v = (_matrix(b.column(names.index(c)).slice(n)) for c in ("f", vector))
            other_sq = (other**2).sum(1)
            for j in range(0, len(other), BLOCK_ROWS):
                to = slice(j, j + BLOCK_ROWS)
                for i in range(0, len(x), BLOCK_ROWS):
                    at = slice(i, i + BLOCK_ROWS)
                    k = x[at] @ other[to].T
                    k *= -2
                    k += sq[at, None]
                    k += other_sq[to]
                    np.maximum(k, 0, out=k)
                    k *= -gamma
                    np.exp(k, out=k)
                    out[at] += k @ v[to]
        if mine:
            done = finish(mine, out)
            for i in range(0, len(out), BLOCK_ROWS):
                cols = [x[i : i + BLOCK_ROWS] for x in done.values()]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())) if isinstance(x, list) else _binary(x) if x.ndim == 2 else pa.array(x) for x in cols], names=list(done))

    return dealt.mapInArrow(run, schema)


def _cross_validated_blocks(rows: DataFrame, n: int, gammas: Sequence[float], ridges: Sequence[float], folds: int, tolerance: float = 1e-9, rounds: int = 2000) -> DataFrame:
    """As cross_validated, for any number of rows: the systems of all ridges, folds and classes are solved together, by conjugate gradients with one sum a round.

    A system's vectors are 0 in the rows of its fold. rows: idx, f, y.
    """
    spark = rows.sparkSession
    counts = rows.groupBy("y").agg(F.count("*").alias("n")).collect()  # one row a class
    classes = sorted(r["y"] for r in counts)
    group = min(GROUP_ROWS, max(BLOCK_ROWS, -(-n // spark.sparkContext.defaultParallelism)))
    groups = -(-n // group)
    class_of = F.array_position(F.array(*map(F.lit, classes)), F.col("y")) - 1
    # positions by idx: ranges are stored before their rows are counted, so that both see the same ranges
    ranged = _stored(rows.withColumn("y", class_of.cast("int")).repartitionByRange("idx").withColumn("part", F.spark_partition_id()))
    sizes = sorted((r["part"], r["n"]) for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a range
    offsets = spark.createDataFrame([(p, sum(m for q, m in sizes if q < p)) for p, _ in sizes], "part int, off long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy("idx")) - 1
    placed = _stored(ranged.withColumn("rank", rank).join(F.broadcast(offsets), "part").select((F.col("rank") + F.col("off")).alias("pos"), "f", "y"))
    _deleted(ranged)
    in_fold = {(r["k"], r["y"]): r["n"] for r in placed.groupBy((F.col("pos") % folds).alias("k"), "y").agg(F.count("*").alias("n")).collect()}
    total = {c: sum(in_fold.get((k, c), 0) for k in range(folds)) for c in range(len(classes))}
    known = np.array([[total[c] > in_fold.get((k, c), 0) for c in total] for k in range(folds)])  # classes that the training rows of a fold lack are not predicted
    ridge, fold, cls = (a.ravel() for a in np.meshgrid(np.array(ridges, dtype=float), np.arange(folds), np.arange(len(classes)), indexing="ij"))
    width = len(ridge)

    def targets(pos: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.where(pos[:, None] % folds != fold, np.where(y[:, None] == cls, 1.0, -1.0), 0.0)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, BLOCK_ROWS):
                pos, f, y = b.slice(i, BLOCK_ROWS).columns
                t = targets(pos.to_numpy(), y.to_numpy())
                zero = _binary(np.zeros_like(t))
                yield pa.RecordBatch.from_arrays([pos, y, _binary(f.flatten().to_numpy().reshape(len(pos), -1)), zero, _binary(t), zero, zero], names=["pos", "y", "f", "a", "r", "p", "s"])

    state_schema = "pos long, y int, f binary, a binary, r binary, p binary, s binary"
    first = placed.select("pos", F.col("f").cast("array<double>").alias("f"), "y").mapInArrow(start, state_schema)

    def step(alpha: np.ndarray, beta: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(0, b.num_rows, BLOCK_ROWS):
                    c = b.slice(i, BLOCK_ROWS)
                    a, r, p, s, w = (_matrix(c.column(j)) for j in range(3, 8))
                    p, s = r + beta * p, w + beta * s
                    yield pa.RecordBatch.from_arrays([*c.columns[:3], *map(_binary, (a + alpha * p, r - alpha * s, p, s))], names=["pos", "y", "f", "a", "r", "p", "s"])

        return run

    def times(mine: dict, kr: np.ndarray) -> dict:
        r = mine["r"]
        w = np.where(mine["pos"][:, None] % folds != fold, kr, 0.0) + ridge * r
        sums = [*(r * r).sum(0).tolist(), *(r * w).sum(0).tolist()]
        return mine | {"w": w, "sums": [sums, *[None] * (len(r) - 1)]}

    def judged(mine: dict, ka: np.ndarray) -> dict:
        own = mine["pos"] % folds
        hits = []
        for q in range(len(ridges)):
            scores = ka.reshape(len(ka), len(ridges), folds, -1)[np.arange(len(ka)), q, own]
            hits.append(float((np.where(known[own], scores, -np.inf).argmax(1) == mine["y"]).sum()))
        left = targets(mine["pos"], mine["y"]) - np.where(mine["pos"][:, None] % folds != fold, ka, 0.0) - ridge * mine["a"]
        return {"sums": [[*hits, *(left * left).sum(0).tolist()]]}

    out = []
    for gamma in map(float, gammas):
        state, size, old, t = first, None, None, None
        for _ in range(rounds):
            last, t = t, _stored(_kernel_product(state, "r", gamma, group, groups, times, state_schema + ", w binary, sums array<double>"))
            if last is not None:
                _deleted(last)
            got = np.sum([r["sums"] for r in t.filter("sums is not null").select("sums").collect()], axis=0)  # one row a group
            rr, rw = got[:width], got[width:]
            size = rr if size is None else size
            open_ = rr > tolerance**2 * size
            if not open_.any():
                break
            beta, bottom = np.zeros(width), rw
            if old is not None:
                beta = np.divide(rr, old[0], out=beta, where=open_)
                bottom = rw - np.divide(beta * rr, old[1], out=np.zeros(width), where=open_)
            alpha = np.divide(rr, bottom, out=np.zeros(width), where=open_)
            old = (rr, alpha)
            state = t.mapInArrow(step(alpha, beta), state_schema)
        else:
            raise RuntimeError(f"conjugate gradients did not settle in {rounds} rounds")
        sums = np.sum([r["sums"] for r in _kernel_product(t.drop("w", "sums"), "a", gamma, group, groups, judged, "sums array<double>").collect()], axis=0)
        if (sums[len(ridges) :] > (1e3 * tolerance) ** 2 * size).any():
            raise RuntimeError("conjugate gradients lost their precision")
        _deleted(t)
        out += [(gamma, float(r), float(h / n)) for r, h in zip(ridges, sums, strict=False)]
    _deleted(placed)
    return spark.createDataFrame(out, "gamma double, ridge double, accuracy double")


def clustered(df: DataFrame, features: Sequence[str], k: int, seed: int = 5) -> tuple[DataFrame, float]:
    """df with `cluster` by k-means++, and its silhouette score."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.feature import VectorAssembler

    v = VectorAssembler(inputCols=list(features), outputCol="__v").transform(df)
    out = KMeans(featuresCol="__v", predictionCol="cluster", k=k, seed=seed).fit(v).transform(v)
    score = ClusteringEvaluator(featuresCol="__v", predictionCol="cluster").evaluate(out)
    return out.drop("__v"), score
