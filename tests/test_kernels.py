"""Invariants and closed forms of the kernels that SQL can't express."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cloudloom.functions import geometry as G
from cloudloom.operators import hull as H
from cloudloom.operators import imaging as I
from cloudloom.operators import learning as L
from cloudloom.operators import octree as O
from cloudloom.operators import search
from cloudloom.sources import arrays, binary
from cloudloom.types import RECORDS, fields, record

points_2d = st.lists(st.tuples(st.integers(-20, 20), st.integers(-20, 20)), min_size=3, max_size=40)


@settings(max_examples=60, deadline=None)
@given(points_2d)
def test_chain_holds_all_points(pts):
    p = np.array(pts, dtype=float)
    h = p[H.chain_2d(p)]
    if len(h) >= 3:
        nxt = np.roll(h, -1, 0)
        for q in p:
            assert (((nxt - h)[:, 0] * (q - h)[:, 1] - (nxt - h)[:, 1] * (q - h)[:, 0]) >= -1e-9).all()


@pytest.mark.parametrize("seed", range(5))
def test_hull_3d_is_convex_and_closed(seed):
    p = np.random.default_rng(seed).normal(size=(200, 3))
    t = H.hull_3d(p)
    e = {}
    for a, b, c in t.tolist():
        for u, v in ((a, b), (b, c), (c, a)):
            e[(u, v)] = e.get((u, v), 0) + 1
    assert all(n == 1 and (v, u) in e for (u, v), n in e.items())
    n = np.cross(p[t[:, 1]] - p[t[:, 0]], p[t[:, 2]] - p[t[:, 0]])
    assert ((p @ n.T) - (n * p[t[:, 0]]).sum(1) < 1e-8).all()
    assert len(set(t.ravel().tolist())) - len(e) // 2 + len(t) == 2


def test_degenerate_hulls():
    line = np.array([[i, i, i] for i in range(5)], dtype=float)
    assert len(H.hull_3d(line)) == 0 and len(H.hull_3d(np.zeros((3, 3)))) == 0
    assert len(H.chain_2d(np.array([[0.0, 0], [1, 1], [2, 2]]))) == 2
    assert H.dimension(np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [1, 1, 0.0]])) == 2


def test_tetrahedron_volume():
    p = np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], dtype=float)
    area, volume = H.area_volume(p, H.hull_3d(p))
    assert math.isclose(volume, 1 / 6) and math.isclose(area, 1.5 + math.sqrt(3) / 2)


def test_wide_alpha_gives_the_convex_hull():
    p = np.random.default_rng(1).uniform(size=(60, 2))
    _, paths = H.concave_2d(p, 1e6)
    assert len(paths) == 1 and set(H.chain_2d(p)) <= set(paths[0])
    assert H.concave_2d(p, 0)[1] == []


def test_delaunay_circles_are_empty():
    p = np.random.default_rng(2).uniform(size=(40, 2))
    for t in H.delaunay(p):
        a, b, c = p[t]
        m = np.linalg.solve(2 * np.array([b - a, c - a]), [(b @ b) - (a @ a), (c @ c) - (a @ a)])
        r = np.linalg.norm(m - a)
        assert (np.linalg.norm(p - m, axis=1) >= r - 1e-6).all()


def test_solid_alpha_shape_of_a_cube():
    g = np.stack(np.meshgrid(*[np.arange(4.0)] * 3), -1).reshape(-1, 3)
    f = H.concave_3d(g, 1.0)
    a = np.linalg.norm(np.cross(g[f[:, 1]] - g[f[:, 0]], g[f[:, 2]] - g[f[:, 0]]), axis=1).sum() / 2
    assert 50 < a < 60


def brute_cut(n, s, t, edges, w):
    best = None
    for mask in range(1 << n):
        side = [(mask >> i) & 1 for i in range(n)]
        cost = sum(t[i] if side[i] else s[i] for i in range(n)) + sum(x for (a, b), x in zip(edges, w, strict=True) if side[a] != side[b])
        best = cost if best is None else min(best, cost)
    return best


@pytest.mark.parametrize("seed", range(6))
def test_cut_is_least(seed):
    rng = np.random.default_rng(seed)
    n = 7
    s, t = rng.integers(0, 10, n).astype(float), rng.integers(0, 10, n).astype(float)
    edges = np.array([(i, j) for i in range(n) for j in range(i) if rng.random() < 0.5]).reshape(-1, 2)
    w = rng.integers(1, 6, len(edges)).astype(float)
    fg = L.max_flow_cut(n, s, t, edges, w)
    cost = sum(t[i] if fg[i] else s[i] for i in range(n)) + sum(x for (a, b), x in zip(edges.tolist(), w, strict=True) if fg[a] != fg[b])
    assert cost == brute_cut(n, s, t, edges.tolist(), w)


def test_mixture_finds_two_groups():
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(0, 1, (200, 2)), rng.normal(10, 1, (200, 2))))
    assert L.best_mixture(x, (1, 2, 3), ("spherical", "full")).k == 2


def test_grabcut_and_crf_recover_a_square():
    img = np.zeros((20, 20, 1))
    img[5:15, 5:15] = 200
    img += np.random.default_rng(0).normal(0, 5, img.shape)
    tri = np.full((20, 20), 2)
    tri[:2], tri[-2:], tri[:, :2], tri[:, -2:] = 0, 0, 0, 0
    tri[9:11, 9:11] = 1
    assert L.grabcut(img, tri)[6:14, 6:14].all() and L.grabcut(img, tri).sum() <= 110
    p = np.where(img[..., 0] > 100, 0.7, 0.3)
    assert (L.dense_crf(img, np.stack((p, 1 - p), 2))[..., 0] > 0.5)[7:13, 7:13].all()


def test_crf_is_fully_connected():
    rng = np.random.default_rng(1)
    img, p = rng.integers(0, 40, (6, 30, 1)).astype(float), rng.uniform(0.2, 0.8, (6, 30))
    prob = np.stack((p, 1 - p), 2)
    at = np.indices((6, 30)).reshape(2, -1).T.astype(float)
    d2, c2 = ((at[:, None] - at) ** 2).sum(2), (img.reshape(-1, 1) - img.reshape(1, -1)) ** 2
    total = 0
    for weight, k in ((3, np.exp(-d2 / 18)), (10, np.exp(-d2 / (2 * 80**2) - c2 / (2 * 13**2)))):
        total = total + weight * k / np.sqrt(k.sum(0)[:, None] * k.sum(0))
    q = prob.reshape(-1, 2)
    for _ in range(5):
        q = prob.reshape(-1, 2) * np.exp(total @ q)
        q /= q.sum(1, keepdims=True)
    assert np.allclose(L.dense_crf(img, prob, chunk=1000).reshape(-1, 2), q, atol=1e-9)
    # two pixels of one colour, far from each other, pull on each other
    img = np.arange(40.0).reshape(1, 40, 1) * 100
    img[0, 39] = 0
    prob = np.full((1, 40, 2), 0.5)
    prob[0, 39] = 0.99, 0.01
    assert L.dense_crf(img, prob)[0, 0, 0] > 0.9


def test_superpixels_cover_the_image():
    img = np.random.default_rng(0).uniform(0, 255, (24, 24, 1))
    s = L.slic(img, 16)
    assert s.shape == (24, 24) and 4 <= len(np.unique(s)) <= 36
    assert L.felzenszwalb(np.repeat([[0.0] * 12 + [200.0] * 12], 24, 0)[..., None]).max() == 1


def test_kernel_machine_separates():
    rng = np.random.default_rng(0)
    x = np.concatenate((rng.normal(0, 1, (40, 2)), rng.normal(6, 1, (40, 2))))
    y = np.repeat([0, 1], 40)
    assert (L.KernelMachine(0.1, 0.1).fit(x, y).predict(x) == y).mean() > 0.95


def test_png_round_trip():
    for c in (1, 3, 4):
        a = np.random.default_rng(c).integers(0, 256, (7, 9, c)).astype(np.uint8)
        assert (binary.decode_png(binary.encode_png(a)) == a).all()
    with pytest.raises(ValueError):
        binary.decode_png(b"no picture")


def test_resize_keeps_constant_images():
    assert np.allclose(I.resize_array(np.full((8, 9), 5.0), 13, 4), 5)
    assert I.canny_array(np.repeat([[0.0] * 8 + [255.0] * 8], 16, 0), 50, 100).any(0).sum() <= 3


def test_polyline_keeps_its_ends():
    p = np.array([[0, 0], [1, 0.01], [2, 0], [3, 5], [4, 0.0]])
    assert H is not None and list(I.simplified(p, 0.5)) == [0, 2, 3, 4]


def test_euler_and_quaternion_matrices():
    m = np.array(G.euler_matrix(0, 0, 0, 0.1, -0.2, 0.3))
    assert np.allclose(m[:3, :3] @ m[:3, :3].T, np.eye(3)) and np.allclose(G.euler_angles(m), (0.1, -0.2, 0.3))
    q = np.array(G.quaternion_matrix((1, 2, 3), math.cos(0.5), 0, 0, math.sin(0.5)))
    assert np.allclose(q, G.euler_matrix(1, 2, 3, 0, 0, 1.0))


def test_key_depth():
    assert O.key_depth((0, 0, 0), (1, 1, 1), 1) == 1 and O.key_depth((0, 0, 0), (10, 1, 1), 1) == 4
    lo, hi, d = O.cube((0, 0, 0), (10, 4, 4), 1)
    assert d == 4 and all(math.isclose(h - x, 16) for x, h in zip(lo, hi, strict=True))


def test_records():
    assert len(RECORDS) >= 45 and [f.name for f in record("PointNormal")][:3] == ["x", "y", "z"] and fields(record("Label")) == ["label"]


def degenerate(spark):
    nan, inf = float("nan"), float("inf")
    return spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, nan, 0.0, 0.0), (2, inf, 1.0, 1.0), (3, None, 1.0, 1.0), (4, 0.0, 0.0, 0.0), (5, 1.0, 1.0, 1.0)], "idx long, x double, y double, z double")


def test_grid_join_equals_nested_loop(spark):
    rng = np.random.default_rng(0)
    df = arrays.from_array(spark, rng.uniform(-3, 3, (300, 3)))
    q = df.withColumnRenamed("idx", "qidx")
    got = {(r.qidx, r.idx) for r in search.within(df, q, 0.7).collect()}
    p = arrays.to_array(df)
    d2 = ((p[:, None] - p[None]) ** 2).sum(2)
    assert got == set(zip(*map(np.ndarray.tolist, np.nonzero(d2 <= 0.49)), strict=True))


def test_search_edges(spark):
    df = degenerate(spark)
    q = df.withColumnRenamed("idx", "qidx")
    got = search.nearest(df, q, 2).orderBy("qidx", "rank").collect()
    assert [(r.qidx, r.idx) for r in got] == [(0, 0), (0, 4), (4, 0), (4, 4), (5, 5), (5, 0)]
    assert search.nearest(df, q, 0).count() == 0 and search.nearest(df.filter("false"), q, 3).count() == 0
    assert search.nearest(df, q.filter("false"), 3).count() == 0


def test_nearest_join_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    p = np.concatenate((rng.normal(0, 0.01, (150, 3)), rng.uniform(-5, 5, (100, 3)), np.zeros((5, 3)), [[50.0, 50, 50]]))
    df = arrays.from_array(spark, p)
    q = df.withColumnRenamed("idx", "qidx")
    key = lambda rows: sorted((r.qidx, r["rank"], r.idx) for r in rows)
    assert key(search.nearest_join(df, q, 4).collect()) == key(search.nearest(df, q, 4).collect())
    assert search.nearest_join(df, q.filter("false"), 4).count() == 0
    few = df.filter("idx < 3")
    assert search.nearest_join(few, q, 4).count() == 3 * q.count()


def test_query_blocks(spark, monkeypatch):
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    df = arrays.from_array(spark, np.random.default_rng(1).normal(size=(40, 3)))
    got = search.nearest(df, df.withColumnRenamed("idx", "qidx"), 1).collect()
    assert sorted((r.qidx, r.idx) for r in got) == [(i, i) for i in range(40)]


def test_dynamic_leaves_hold_at_most(spark):
    df = arrays.from_array(spark, np.random.default_rng(2).uniform(0, 1, (500, 3)))
    dyn = O.dynamic_leaves(O.indexed(df, (0.0, 0.0, 0.0), 1 / 32), 5, 9)
    n = dyn.groupBy("leaf_depth", *O.leaf_keys(dyn, 5)).count().filter("count > 9 and leaf_depth < 5").count()
    assert n == 0 and dyn.count() == 500


def test_no_change_between_equal_snapshots(spark):
    k = O.indexed(arrays.from_array(spark, np.random.default_rng(3).uniform(0, 1, (50, 3))), (0.0, 0.0, 0.0), 0.1)
    assert O.new_voxel_points(k, k).count() == 0
    m = O.child_masks(k, 4)
    assert O.xor_masks(m, m).filter("mask <> 0").count() == 0


def test_kd_leaves_hold_at_most(spark):
    df = arrays.from_array(spark, np.random.default_rng(4).uniform(0, 1, (200, 3)))
    b = O.kd_boxes(O.kd_leaves(df, 30)).collect()
    assert sum(r.n for r in b) == 200 and max(r.n for r in b) <= 30


def test_array_errors(spark):
    with pytest.raises(TypeError):
        arrays.from_array(spark, np.zeros((3, 2)))
    assert arrays.from_array(spark, 3).count() == 3 and arrays.from_array(spark, [[1, 2, 3]]).count() == 1


def test_unknown_format(spark):
    from cloudloom.sources.text import read_ascii_cloud

    with pytest.raises(ValueError):
        read_ascii_cloud(spark, "cloud.xyz")


def test_streaming_first_points(spark, tmp_path):
    from pyspark.sql import functions as F

    from cloudloom.streaming.state import new_voxels

    df = arrays.from_array(spark, np.random.default_rng(5).uniform(0, 1, (100, 3))).withColumn("ts", F.timestamp_seconds("idx"))
    df.repartitionByRange(4, "idx").write.parquet(f"file://{tmp_path}/in")
    s = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    q = new_voxels(s, (0.0, 0.0, 0.0), 0.25, "ts", "1 hour").writeStream.format("memory").queryName("fresh").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    want = O.indexed(df, (0.0, 0.0, 0.0), 0.25).select(*O.KEYS).distinct().count()
    assert spark.table("fresh").count() == want


def test_paths_are_walked_back(spark):
    """The path of a tree, found by doubling, is that of following `prev`; the target itself and unreachable targets give nothing."""
    from cloudloom.operators import mesh

    up = {0: None, **{i: (i - 1) // 2 if i % 3 else i - 1 for i in range(1, 60)}}
    paths = spark.createDataFrame([(i, float(i), p) for i, p in up.items()], "idx long, dist double, prev long")
    for target in (0, 1, 7, 59):
        want, cur = [], up[target]
        while cur is not None:
            want.append(cur)
            cur = up[cur]
        assert [r.idx for r in mesh.path_to(paths, target).orderBy("pos").collect()] == want[::-1]
    assert mesh.path_to(paths, 1000).collect() == []


def test_rounds_that_run_out_are_errors(spark):
    from cloudloom.operators import mesh

    chain = spark.createDataFrame([(i, i + 1) for i in range(9)], "f long, g long")
    with pytest.raises(RuntimeError):
        mesh.flood(chain, spark.createDataFrame([(0,)], "face_id long"), max_rounds=2)


def test_queries_in_empty_voxels_are_answered(spark):
    from cloudloom.operators import octree, search

    pts = spark.createDataFrame([(i, float(i), 0.0, 0.0) for i in range(5)], "idx long, x double, y double, z double")
    q = spark.createDataFrame([(0, 3.2, 0.1, 0.0), (1, 3.2, 9.0, 0.0)], "qidx long, x double, y double, z double")
    got = search.approximate(octree.indexed(pts, (-16.0,) * 3, 1.0), octree.indexed(q, (-16.0,) * 3, 1.0)).collect()
    assert {r.qidx: r.idx for r in got} == {0: 3, 1: 3}


def test_kernel_machines_by_blocks_agree_with_direct_ones(spark):
    """Several groups and blocks, copies, and a class of one row, which its own fold does not know."""
    rng = np.random.default_rng(4)
    y = rng.integers(0, 3, 1300)
    x = rng.normal(size=(1300, 12)) + y[:, None] * 0.4
    x[50:60] = x[0]
    y[7] = 9
    df = spark.createDataFrame([(int(3 * i), a.tolist(), int(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "idx long, f array<double>, y long")
    got, want = (sorted(map(tuple, L.cross_validated(df, "f", "y", [0.2], [1.0, 2.0], direct=d).collect())) for d in (100, 4000))
    assert got == want and len(got) == 2 and want[0][2] > 0.5
