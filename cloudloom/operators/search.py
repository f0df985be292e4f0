"""Neighbour search as joins: a query cloud against a reference cloud.

k nearest: a query set of at most QUERY_BLOCK goes to every partition of the reference cloud, which is read once; each
batch keeps its k nearest per query in numpy, and the few survivors are ranked. Nothing but k rows per query and batch is shuffled. Larger
query sets go by rounds of grid joins (in other than three dimensions: by blocks).
Radius: both sides are dealt by grid cell of the radius, queries to their 27 neighbour cells, and the equi-join's pairs are filtered by distance.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G

#: Queries that are held in memory at once, and distances computed at once.
QUERY_BLOCK, PAIR_BLOCK = 20_000, 2_000_000


def _top(q: np.ndarray, ids: np.ndarray, p: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query number, id and squared distance of the k nearest points of a batch, by distance then id."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    step = max(1, PAIR_BLOCK // max(1, len(p)))
    for lo in range(0, len(q), step):
        d2 = np.zeros((min(step, len(q) - lo), len(p)))
        for j in range(p.shape[1]):
            d = p[None, :, j] - q[lo : lo + step, None, j]
            d2 += d * d
        m = min(k, len(p))
        bound = np.partition(d2, m - 1, axis=1)[:, m - 1 : m]
        row, col = np.nonzero(d2 <= bound)  # ties at the k-th distance stay; they are cut by id
        order = np.lexsort((ids[col], d2[row, col], row))
        row, col = row[order], col[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[rank < k], col[rank < k]
        out.append((row + lo, ids[col], d2[row, col]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest(points: DataFrame, queries: DataFrame, k: int, dims: Sequence[str] = G.AXES) -> DataFrame:
    """qidx, idx, d2, rank (from 1): the k nearest finite points of each query. points: idx and dims; queries: qidx and dims. k < 1 gives no rows."""
    schema = "qidx long, idx long, d2 double"
    spark = points.sparkSession
    if k >= 1 and list(dims) == list(G.AXES) and queries.limit(QUERY_BLOCK + 1).count() > QUERY_BLOCK:
        return nearest_join(points, queries, k)
    if k < 1:
        return spark.createDataFrame([], schema + ", rank long")
    ref = points.filter(G.finite(*dims)).select(F.col("idx").cast("long").alias("idx"), *dims)
    block_rows = queries.filter(G.finite(*dims)).select(F.col("qidx").cast("long").alias("qidx"), *dims)
    found = None
    iterator = block_rows.toLocalIterator()
    while block := [r for _, r in zip(range(QUERY_BLOCK), iterator, strict=False)]:
        held = spark.sparkContext.broadcast((np.array([r["qidx"] for r in block], dtype=np.int64), np.array([[r[d] for d in dims] for r in block], dtype=np.float64)))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            qid, q = held.value
            for b in batches:
                if b.num_rows:
                    p = np.stack([b.column(1 + j).to_numpy() for j in range(len(dims))], 1)
                    row, idx, d2 = _top(q, b.column(0).to_numpy(), p, k)
                    yield pa.RecordBatch.from_arrays([pa.array(qid[row]), pa.array(idx), pa.array(d2)], names=["qidx", "idx", "d2"])

        part = ref.mapInArrow(run, schema)
        found = part if found is None else found.union(part)
    if found is None:
        return spark.createDataFrame([], schema + ", rank long")
    w = Window.partitionBy("qidx").orderBy("d2", "idx")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)


def _cell_size(points: DataFrame, k: int) -> float:
    """The side of grid cells that hold about k points, seen from a point: halved from that of even density until crowded places agree."""
    r = points.agg(F.count("*").alias("n"), *((F.max(a) - F.min(a)).alias(a) for a in G.AXES)).first()
    sides = sorted((r[a] or 0.0) for a in G.AXES)
    if not r["n"] or not sides[-1]:
        return 1.0
    solid = [s for s in sides if s > 1e-6 * sides[-1]]
    size = float(np.prod(solid) * k / r["n"]) ** (1 / len(solid))
    while size > 1e-6 * sides[-1]:
        per_cell = points.groupBy(*(F.floor(F.col(a) / size) for a in G.AXES)).agg(F.count("*").alias("n"))
        seen = per_cell.agg(F.sum(F.col("n") * F.col("n")) / F.sum("n")).first()[0]
        if seen <= 4 * k:
            break
        size /= 2
    return size


def nearest_join(points: DataFrame, queries: DataFrame, k: int, max_rounds: int = 60) -> DataFrame:
    """nearest() for query sets as large as the cloud: rounds of grid equi-joins.

    A query that finds k points within one cell side has its k nearest, for all of them lie in the 27 cells around it; the others
    try again with cells twice as large, up to the whole cloud. Crowded places are settled in the first rounds, with small cells.
    """
    from .mesh import saved

    ref = points.filter(G.finite(*G.AXES)).select(F.col("idx").cast("long").alias("idx"), *G.AXES)
    open_ = queries.filter(G.finite(*G.AXES)).select(F.col("qidx").cast("long").alias("qidx"), *G.AXES)
    size = _cell_size(ref, k)
    r = ref.agg(*(F.min(a).alias("lo" + a) for a in G.AXES), *(F.max(a).alias("hi" + a) for a in G.AXES)).first()
    q = open_.agg(*(F.min(a).alias("lo" + a) for a in G.AXES), *(F.max(a).alias("hi" + a) for a in G.AXES)).first()
    if k < 1 or r["lox"] is None or q["lox"] is None:
        return nearest(points, queries, 0)
    across = sum((max(r["hi" + a], q["hi" + a]) - min(r["lo" + a], q["lo" + a])) ** 2 for a in G.AXES) ** 0.5
    w = Window.partitionBy("qidx").orderBy("d2", "idx")
    found = None
    for _ in range(max_rounds):
        last = size >= across
        top = within(ref, open_, size).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= k)
        top = saved(top.withColumn("n", F.max("rank").over(Window.partitionBy("qidx"))))
        settled = top if last else top.filter(F.col("n") == k)
        part = settled.select("qidx", "idx", "d2", "rank")
        found = part if found is None else found.unionByName(part)
        if last:
            break
        open_ = saved(open_.join(settled.select("qidx").distinct(), "qidx", "left_anti"))
        if not open_.limit(1).count():
            break
        size *= 2
    else:
        raise RuntimeError(f"queries are still open after {max_rounds} rounds")
    return found


def within(points: DataFrame, queries: DataFrame, radius: float, max_nn: int = 0, squared: bool = False, first_by: str = "idx") -> DataFrame:
    """qidx, idx, d2: points within the radius of each query, inclusive. max_nn > 0 keeps the first by `first_by` ('idx' or 'd2').

    squared: `radius` is a squared distance already.
    """
    r = radius**0.5 if squared else radius
    r2 = radius if squared else radius * radius
    cell = lambda a: F.floor(F.col(a) / F.lit(r)).cast("long")
    p = points.filter(G.finite(*G.AXES)).select("idx", *G.AXES, *(cell(a).alias("c" + a) for a in G.AXES))
    q = queries.filter(G.finite(*G.AXES)).select("qidx", *(F.col(a).alias("q" + a) for a in G.AXES), *(cell(a).alias("q_c" + a) for a in G.AXES))
    for a in G.AXES:
        q = q.withColumn("c" + a, F.explode(F.array(*(F.col("q_c" + a) + o for o in (-1, 0, 1)))))
    pairs = p.join(q, ["cx", "cy", "cz"]).withColumn("d2", G.sq_dist(G.points(), G.points("q"))).filter(F.col("d2") <= r2).select("qidx", "idx", "d2")
    if max_nn > 0:
        order = ["d2", "idx"] if first_by == "d2" else ["idx"]
        pairs = pairs.withColumn("__r", F.row_number().over(Window.partitionBy("qidx").orderBy(*order))).filter(F.col("__r") <= max_nn).drop("__r")
    return pairs


def same_voxel(keyed: DataFrame, queries: DataFrame) -> DataFrame:
    """qidx, idx of all points in the query's voxel. Both sides carry kx, ky, kz."""
    return keyed.select("idx", "kx", "ky", "kz").join(queries.select("qidx", "kx", "ky", "kz"), ["kx", "ky", "kz"]).select("qidx", "idx")


def approximate(keyed: DataFrame, queries: DataFrame) -> DataFrame:
    """qidx, idx, d2: the nearest point of the query's own voxel (least idx on ties); queries in an empty voxel get the nearest point of the cloud."""
    q = queries.select("qidx", *(F.col(a).alias("q" + a) for a in G.AXES), "kx", "ky", "kz")
    pairs = keyed.join(q, ["kx", "ky", "kz"]).withColumn("d2", G.sq_dist(G.points(), G.points("q")))
    found = pairs.groupBy("qidx").agg(F.min_by(F.struct("idx", "d2"), F.struct("d2", "idx")).alias("m")).select("qidx", "m.*")
    rest = queries.join(keyed.select("kx", "ky", "kz").distinct(), ["kx", "ky", "kz"], "left_anti")
    return found.unionByName(nearest(keyed, rest, 1).drop("rank"))


def hashed_neighbours(points: DataFrame, queries: DataFrame, radius: float, tables: int = 4, seed: int = 7) -> DataFrame:
    """qidx, idx, d2 by random-projection hashing: approximate radius search, filtered exactly."""
    from pyspark.ml.feature import BucketedRandomProjectionLSH, VectorAssembler

    make = VectorAssembler(inputCols=list(G.AXES), outputCol="v")
    p, q = make.transform(points.select("idx", *G.AXES)), make.transform(queries.select("qidx", *G.AXES))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=2 * radius, numHashTables=tables, seed=seed).fit(p)
    near = model.approxSimilarityJoin(p, q, radius, distCol="d")
    return near.select(F.col("datasetB.qidx").alias("qidx"), F.col("datasetA.idx").alias("idx"), (F.col("d") * F.col("d")).alias("d2"))


def projected_window(points: DataFrame, queries: DataFrame, width: int, reach: int, radius: float) -> DataFrame:
    """Radius search on an organized cloud: pixel boxes of `reach` first, then the distance. points: idx, row, col, x, y, z.

    Boxes become equalities by cells of `reach` pixels, so no nested loop is needed.
    """
    p = points.select("idx", "row", "col", *G.AXES, F.floor(F.col("row") / (reach + 1)).alias("br"), F.floor(F.col("col") / (reach + 1)).alias("bc"))
    q = queries.select("qidx", F.col("row").alias("qrow"), F.col("col").alias("qcol"), *(F.col(a).alias("q" + a) for a in G.AXES))
    for name, src in (("br", "qrow"), ("bc", "qcol")):
        q = q.withColumn(name, F.explode(F.array(*(F.floor(F.col(src) / (reach + 1)) + o for o in (-1, 0, 1)))))
    pairs = p.join(q, ["br", "bc"]).filter((F.abs(F.col("row") - F.col("qrow")) <= reach) & (F.abs(F.col("col") - F.col("qcol")) <= reach))
    return pairs.withColumn("d2", G.sq_dist(G.points(), G.points("q"))).filter(F.col("d2") <= radius * radius).select("qidx", "idx", "d2")
