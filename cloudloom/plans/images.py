"""Imaging queries. Images are arithmetic patterns over ranges, so that the same SQL runs on both engines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import imaging as I
from ..operators import learning as L
from .registry import cloud, query, rounded, table

H, W, IMGS = 48, 64, 3
PIX = f"pix AS (SELECT CAST(i // {H * W} AS BIGINT) AS img, CAST(i % {H * W} // {W} AS BIGINT) AS row, CAST(i % {W} AS BIGINT) AS col, CAST((i * 7919 + i // {W} * 131) % 256 AS DOUBLE) AS value FROM range({IMGS * H * W}) t(i))"
#: A disc of foreground, with its own radius in each image, and its probability.
DISC = "disc AS (SELECT img, row, col, value, (row - 24) * (row - 24) + (col - 32) * (col - 32) AS d FROM pix), prob AS (SELECT img, row, col, value, d, CASE WHEN d < 100 + 60 * img THEN 0.99 WHEN d < 300 + 60 * img THEN 0.5 ELSE 0.0 END AS p FROM disc)"
SEG = "seg AS (SELECT *, (row // 8) * 8 + col // 8 AS seg FROM prob)"


def pix(spark):
    i = F.col("id")
    n = H * W
    return spark.range(IMGS * n).select(F.floor(i / n).cast("long").alias("img"), F.floor(i % n / W).cast("long").alias("row"), (i % W).alias("col"), ((i * 7919 + F.floor(i / W) * 131) % 256).cast("double").alias("value"))


def prob(spark):
    d = (F.col("row") - 24) * (F.col("row") - 24) + (F.col("col") - 32) * (F.col("col") - 32)
    p = pix(spark).withColumn("d", d)
    return p.withColumn("p", F.when(F.col("d") < 100 + 60 * F.col("img"), 0.99).when(F.col("d") < 300 + 60 * F.col("img"), 0.5).otherwise(0.0))


def seg(spark):
    return prob(spark).withColumn("seg", (F.floor(F.col("row") / 8) * 8 + F.floor(F.col("col") / 8)).cast("long"))


def box_sql(f, a0, a1, src="pix"):
    return f"WITH {PIX} SELECT a.img, a.row, a.col, {f}(b.value) AS value FROM {src} a JOIN {src} b ON a.img = b.img AND b.row - a.row BETWEEN {a0} AND {a1} AND b.col - a.col BETWEEN {a0} AND {a1} GROUP BY 1, 2, 3"


@query("I1_dilate", box_sql("max", -1, 1))
def i1(spark, sf):
    return I.dilate(pix(spark), "value", 3, 3)


@query("I1_erode", box_sql("min", -2, 2))
def i1b(spark, sf):
    return I.erode(pix(spark), "value", 5, 5)


@query("I1_open", f"WITH {PIX}, e AS (SELECT a.img, a.row, a.col, min(b.value) AS value FROM pix a JOIN pix b ON a.img = b.img AND b.row - a.row BETWEEN -1 AND 1 AND b.col - a.col BETWEEN -1 AND 1 GROUP BY 1, 2, 3) SELECT a.img, a.row, a.col, max(b.value) AS value FROM e a JOIN e b ON a.img = b.img AND b.row - a.row BETWEEN -1 AND 1 AND b.col - a.col BETWEEN -1 AND 1 GROUP BY 1, 2, 3")
def i1c(spark, sf):
    return I.opened(pix(spark), "value", 3, 3)


@query("I1_close", f"WITH {PIX}, e AS (SELECT a.img, a.row, a.col, max(b.value) AS value FROM pix a JOIN pix b ON a.img = b.img AND b.row - a.row BETWEEN -1 AND 1 AND b.col - a.col BETWEEN -1 AND 1 GROUP BY 1, 2, 3) SELECT a.img, a.row, a.col, min(b.value) AS value FROM e a JOIN e b ON a.img = b.img AND b.row - a.row BETWEEN -1 AND 1 AND b.col - a.col BETWEEN -1 AND 1 GROUP BY 1, 2, 3")
def i1d(spark, sf):
    return I.closed(pix(spark), "value", 3, 3)


@query("I2_gaussian_blur", f"WITH {PIX}, g AS (SELECT a.img, a.row, a.col, sum(b.value * exp(-((b.row - a.row) * (b.row - a.row) + (b.col - a.col) * (b.col - a.col)) / 2.0)) / sum(exp(-((b.row - a.row) * (b.row - a.row) + (b.col - a.col) * (b.col - a.col)) / 2.0)) AS value FROM pix a JOIN pix b ON a.img = b.img AND b.row - a.row BETWEEN -2 AND 2 AND b.col - a.col BETWEEN -2 AND 2 GROUP BY 1, 2, 3) SELECT img, row, col, round(value, 4) AS value FROM g")
def i2(spark, sf):
    return rounded(I.gaussian(pix(spark), "value", 5, 1.0), 4)


@query("I2_median_blur", f"WITH {PIX}, o AS (SELECT a.img, a.row, a.col, b.value FROM pix a, (VALUES (-1), (0), (1)) r(i), (VALUES (-1), (0), (1)) c(j) JOIN pix b ON b.img = a.img AND b.row = least(greatest(a.row + i, 0), {H - 1}) AND b.col = least(greatest(a.col + j, 0), {W - 1})) SELECT img, row, col, median(value) AS value FROM o GROUP BY 1, 2, 3")
def i2b(spark, sf):
    return I.median_blur(pix(spark), "value").select("img", "row", "col", "value")


@query("I2_resize")
def i2c(spark, sf):
    return rounded(I.per_image(pix(spark), lambda a: I.resize_array(a, 72, 80)), 4)


_N = f"WITH {PIX}, n AS (SELECT a.img, a.row, a.col, a.value, i, j, b.value AS o FROM pix a, (VALUES (-1), (0), (1)) r(i), (VALUES (-1), (0), (1)) c(j) JOIN pix b ON b.img = a.img AND b.row = least(greatest(a.row + i, 0), {H - 1}) AND b.col = least(greatest(a.col + j, 0), {W - 1}))"


@query("I3_sobel", _N + ", s AS (SELECT img, row, col, sum(o * j * (2 - abs(i))) AS gx, sum(o * i * (2 - abs(j))) AS gy FROM n GROUP BY 1, 2, 3) SELECT img, row, col, round(sqrt(gx * gx + gy * gy), 4) AS sobel FROM s")
def i3(spark, sf):
    return rounded(I.sobel(pix(spark), "value").select("img", "row", "col", "sobel"), 4)


@query("I3_roberts", _N + ", s AS (SELECT img, row, col, any_value(value) AS v, sum(o) FILTER (i = 1 AND j = 1) AS d, sum(o) FILTER (i = 0 AND j = 1) AS e, sum(o) FILTER (i = 1 AND j = 0) AS f FROM n GROUP BY 1, 2, 3) SELECT img, row, col, round(sqrt((v - d) * (v - d) + (e - f) * (e - f)), 4) AS roberts FROM s")
def i3b(spark, sf):
    return rounded(I.roberts(pix(spark), "value").select("img", "row", "col", "roberts"), 4)


@query("I3_canny")
def i3c(spark, sf):
    return I.per_image(prob(spark).select("img", "row", "col", (F.col("p") * 255).alias("value")), lambda a: I.canny_array(a, 100, 200).astype(int), out="long").filter("value > 0")


@query("I3_clahe")
def i3d(spark, sf):
    return rounded(I.per_image(pix(spark), I.clahe_array), 3)


@query("I4_edge_blend", f"WITH {PIX} SELECT img, row, col, round(0.4 * value + 0.3 * (255 - value) + 0.3 * (value / 2), 6) AS edge FROM pix")
def i4(spark, sf):
    v = F.col("value")
    return rounded(pix(spark).select("img", "row", "col", (0.4 * v + 0.3 * (255 - v) + 0.3 * (v / 2)).alias("edge")))


@query("I5_trimap_partition", f"SELECT CAST({IMGS * H * W} AS BIGINT) AS n, CAST(0 AS BIGINT) AS n_wrong")
def i5(spark, sf):
    """Each pixel has exactly one class, and foreground lies inside the likely region."""
    t = I.trimap(prob(spark), "p", (0.1, 0.1, 0.1, 0.1), H, W, 0.98, 3, 4, 3)
    wrong = (F.col("is_bg").cast("int") + F.col("is_fg").cast("int") + F.col("is_mid").cast("int") != 1) | (F.col("is_fg") & (F.col("p") <= 0.98))
    return t.agg(F.count("*").alias("n"), F.sum(wrong.cast("long")).alias("n_wrong"))


@query("I5_trimap")
def i5b(spark, sf):
    return I.trimap(prob(spark), "p", (0.1, 0.1, 0.1, 0.1), H, W, 0.98, 3, 4, 3).select("img", "row", "col", "is_bg", "is_fg", "is_mid")


@query("I6_normalised_silhouette", f"WITH {PIX} SELECT img, row, col, round(value / max(value) OVER (PARTITION BY img), 6) AS value FROM pix")
def i6(spark, sf):
    return rounded(pix(spark).select("img", "row", "col", (F.col("value") / F.max("value").over(Window.partitionBy("img"))).alias("value")))


@query("I7_gmm_bic_table")
def i7(spark, sf):
    return rounded(L.mixture_table(cloud(spark, sf), ["label"], ["x", "y"], [1, 2, 3], ["spherical", "tied", "diag", "full"]), 3)


@query("I7_gmm_components")
def i7b(spark, sf):
    return L.spark_mixture(cloud(spark, sf), ["x", "y", "z"], 3).groupBy("component").agg(F.count("*").alias("n"))


def _image(g: pd.DataFrame, *cols: str) -> np.ndarray:
    h, w = int(g["row"].max()) + 1, int(g["col"].max()) + 1
    a = np.zeros((h, w, len(cols)))
    for k, c in enumerate(cols):
        a[g["row"].to_numpy(), g["col"].to_numpy(), k] = g[c].to_numpy(dtype=float)
    return a


def _by_image(df, f, cols, schema):
    """f over each image's channels; gives a dense array, one row a pixel."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        out = np.asarray(f(_image(g, *cols)))
        r, c = np.indices(out.shape[:2])
        return pd.DataFrame({"img": g["img"].iloc[0], "row": r.ravel(), "col": c.ravel(), "value": out.reshape(out.shape[0], out.shape[1], -1)[..., 0].ravel()})

    return df.groupBy("img").applyInPandas(run, schema)


LONG, DOUBLE, BOOL = (f"img long, row long, col long, value {t}" for t in ("long", "double", "boolean"))


@query("I8_local_background_probability")
def i8(spark, sf):
    """Segments that touch background ones are scored by a mixture of those neighbours' pixels."""
    s = seg(spark)
    votes = I.segment_votes(s.withColumns({"is_bg": F.col("p") == 0, "is_fg": F.col("p") > 0.9}))
    graph = I.region_graph(s)
    both = graph.select("img", "a", "b").union(graph.select("img", "b", "a"))
    border = both.join(votes.filter("kind = 'BG'").select("img", F.col("seg").alias("b")), ["img", "b"]).join(votes.filter("kind <> 'BG'").select("img", F.col("seg").alias("a")), ["img", "a"])
    near = border.join(s.select("img", F.col("seg").alias("b"), F.col("value")), ["img", "b"]).select("img", F.col("a").alias("seg"), F.lit(1).alias("ref"), F.lit(-1).cast("long").alias("row"), F.lit(-1).cast("long").alias("col"), "value")
    own = s.join(border.select("img", F.col("a").alias("seg")).distinct(), ["img", "seg"]).select("img", "seg", F.lit(0).alias("ref"), "row", "col", "value")

    def run(g: pd.DataFrame) -> pd.DataFrame:
        ref, mine = g[g.ref == 1], g[g.ref == 0]
        m = L.Mixture(3, floor=1.0).fit(np.sort(ref["value"].to_numpy())[:, None])
        return pd.DataFrame({"img": mine["img"], "row": mine["row"], "col": mine["col"], "value": np.exp(m.log_density(mine["value"].to_numpy()[:, None]))})

    return rounded(near.union(own).groupBy("img", "seg").applyInPandas(run, DOUBLE), 6)


@query("I9_probability_images")
def i9(spark, sf):
    """Likelihood of the foreground mixture against the background one, gamma 0.2."""

    def f(a):
        v, p = a[..., :1].reshape(-1, 1), a[..., 1].ravel()
        fg, bg = (L.Mixture(5, floor=1.0).fit(v[m]).log_density(v) for m in (p > 0.9, p == 0))
        return (np.exp(fg) / (np.exp(fg) + np.exp(bg)) ** 1).reshape(a.shape[:2]) ** 0.2

    return rounded(_by_image(prob(spark), f, ["value", "p"], DOUBLE), 5)


@query("I10_slic_superpixels")
def i10(spark, sf):
    return _by_image(pix(spark), lambda a: L.slic(a, 48), ["value"], LONG)


@query("I10_felzenszwalb")
def i10b(spark, sf):
    return _by_image(prob(spark).withColumn("p", F.col("p") * 255), lambda a: L.felzenszwalb(a, 50.0), ["p"], LONG)


@query("I10_mean_shift")
def i10c(spark, sf):
    return rounded(_by_image(pix(spark), lambda a: L.mean_shift(a, 2, 40.0, 3), ["value"], DOUBLE), 4)


@query("I11_superpixel_cut")
def i11(spark, sf):
    s = seg(spark)
    nodes = s.groupBy("img", "seg").agg(F.avg("p").alias("fg_score"), F.avg(1 - F.col("p")).alias("bg_score"))
    edges = I.region_graph(s.withColumn("e", F.lit(0.1)), edge="e").select("img", "a", "b", "weight")
    return L.superpixel_cut(nodes, edges)


def _trimap(a):
    return np.where(a[..., 1] > 0.9, 1, np.where(a[..., 1] > 0, 2, 0))


@query("I12_grabcut")
def i12(spark, sf):
    p = prob(spark).withColumn("value", F.col("p") * 150 + F.col("value") / 8)
    return _by_image(p, lambda a: L.grabcut(a[..., :1], _trimap(a)), ["value", "p"], BOOL).filter("value")


@query("I12_block_grabcut")
def i12b(spark, sf):
    p = prob(spark).withColumn("value", F.col("p") * 150 + F.col("value") / 8)
    return _by_image(p, lambda a: L.block_grabcut(a[..., :1], _trimap(a)), ["value", "p"], BOOL).filter("value")


@query("I14_background_model", f"WITH {PIX}, m AS (SELECT row, col, avg(value) AS mean, var_pop(value) AS var FROM pix GROUP BY 1, 2) SELECT pix.row, pix.col, (value - mean) * (value - mean) > 1.5 * greatest(var, 1) AS fg FROM pix JOIN m ON pix.row = m.row AND pix.col = m.col WHERE img = 0")
def i14(spark, sf):
    p = pix(spark)
    return I.foreground(p.filter("img = 0"), I.background_model(p), 1.5).select("row", "col", "fg")


@query("I15_foreground_mask")
def i15(spark, sf):
    """Threshold, close, open, largest component."""
    p = prob(spark).select("img", "row", "col", ((F.col("p") * 255) > 200).cast("int").alias("value"))
    return I.largest_component(I.opened(I.closed(p, "value", 3, 3), "value", 3, 3).filter("value = 1")).select("img", "row", "col")


@query("T8_largest_contour", f"WITH {PIX}, {DISC} SELECT img, count(*) AS n FROM prob WHERE p > 0.9 GROUP BY img")
def t8b(spark, sf):
    p = prob(spark).filter("p > 0.9").select("img", "row", "col")
    specks = spark.range(IMGS).select(F.col("id").alias("img"), F.lit(0).cast("long").alias("row"), F.lit(0).cast("long").alias("col"))
    return I.largest_component(p.union(specks)).groupBy("img").agg(F.count("*").alias("n"))


@query("I16_ssim_difference", f"WITH {PIX}, a AS (SELECT * FROM pix WHERE img = 0), b AS (SELECT row, col, value FROM pix WHERE img = 1), j AS (SELECT a.row, a.col, a.value AS x, b.value AS y FROM a JOIN b USING (row, col)), s AS (SELECT p.row, p.col, avg(q.x) AS mx, avg(q.y) AS my, avg(q.x * q.x) AS xx, avg(q.y * q.y) AS yy, avg(q.x * q.y) AS xy FROM j p JOIN j q ON q.row - p.row BETWEEN -3 AND 3 AND q.col - p.col BETWEEN -3 AND 3 GROUP BY 1, 2) SELECT row, col, round((2 * mx * my + 6.5025) * (2 * (xy - mx * my) + 58.5225) / ((mx * mx + my * my + 6.5025) * (xx - mx * mx + yy - my * my + 58.5225)), 5) AS ssim FROM s")
def i16(spark, sf):
    p = pix(spark)
    a = p.filter("img = 0")
    b = p.filter("img = 1").withColumn("img", F.lit(0).cast("long"))
    return rounded(I.ssim(a, b).select("row", "col", "ssim"), 5)


@query("I17_remove_light_tubes", f"WITH {PIX} SELECT img, row, col, CASE WHEN value > 190 THEN 150.0 ELSE value END AS value FROM pix")
def i17(spark, sf):
    return pix(spark).withColumn("value", F.when(F.col("value") > 190, 150.0).otherwise(F.col("value")))


@query("I18_smoothed_contour", "WITH c AS (SELECT CAST(i // 60 AS BIGINT) AS contour, CAST(i % 60 AS BIGINT) AS pos, 10 * cos(i % 60 * 0.1) + i % 7 AS x, 10 * sin(i % 60 * 0.1) + i % 5 AS y FROM range(180) t(i)), s AS (SELECT a.contour, a.pos, sum(b.x * exp(-(b.pos - a.pos) * (b.pos - a.pos) / 4.5)) / sum(exp(-(b.pos - a.pos) * (b.pos - a.pos) / 4.5)) AS x, sum(b.y * exp(-(b.pos - a.pos) * (b.pos - a.pos) / 4.5)) / sum(exp(-(b.pos - a.pos) * (b.pos - a.pos) / 4.5)) AS y FROM c a JOIN c b ON a.contour = b.contour AND b.pos - a.pos BETWEEN -3 AND 3 GROUP BY 1, 2) SELECT contour, pos, round(x, 5) AS x, round(y, 5) AS y FROM s")
def i18(spark, sf):
    return rounded(I.smoothed_contour(contours(spark), ["contour"], 7, 1.5), 5)


def contours(spark):
    i = F.col("id")
    return spark.range(180).select(F.floor(i / 60).cast("long").alias("contour"), (i % 60).alias("pos"), (10 * F.cos(i % 60 * 0.1) + i % 7).alias("x"), (10 * F.sin(i % 60 * 0.1) + i % 5).alias("y"))


@query("I18_simplified_polygon")
def i18b(spark, sf):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pos")
        return g.iloc[I.simplified(g[["x", "y"]].to_numpy(), 3.0)]

    return rounded(contours(spark).groupBy("contour").applyInPandas(run, "contour long, pos long, x double, y double"))


@query("I19_without_small_objects", f"WITH {PIX}, {DISC} SELECT img, row, col FROM prob WHERE p > 0")
def i19(spark, sf):
    p = prob(spark).filter("p > 0").select("img", "row", "col")
    specks = spark.range(IMGS).select(F.col("id").alias("img"), F.lit(1).cast("long").alias("row"), F.lit(1).cast("long").alias("col"))
    return I.without_small(p.union(specks), 100).select("img", "row", "col")


@query("I20_dense_crf")
def i20(spark, sf):
    return rounded(_by_image(prob(spark), lambda a: L.dense_crf(a[..., :1], np.stack((np.clip(a[..., 1], 0.05, 0.95), 1 - np.clip(a[..., 1], 0.05, 0.95)), 2)), ["value", "p"], DOUBLE), 5)


@query("I21_pose_clusters")
def i21(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), *(F.get("embedding", F.lit(i)).cast("double").alias(f"v{i}") for i in range(64)))
    out, score = L.clustered(e, [f"v{i}" for i in range(64)], 11)
    return out.groupBy("cluster").agg(F.count("*").alias("n"), F.lit(round(score, 6)).alias("silhouette"))


@query("T9_best_cluster_count")
def t9(spark, sf):
    """The k of greatest silhouette."""
    e = cloud(spark, sf)
    rows = [(k, round(L.clustered(e, ["x", "y", "z"], k)[1], 6)) for k in (2, 3, 4)]
    df = spark.createDataFrame(rows, "k int, silhouette double")
    return df.withColumn("best", F.col("silhouette") == F.max("silhouette").over(Window.partitionBy()))


@query("I22_hog_features")
def i22(spark, sf):
    def run(g: pd.DataFrame) -> pd.DataFrame:
        f = L.hog(_image(g, "value")[..., 0])
        return pd.DataFrame({"img": g["img"].iloc[0], "i": np.arange(len(f)), "v": f})

    return rounded(pix(spark).groupBy("img").applyInPandas(run, "img long, i long, v double"), 5)


@query("I22_cross_validated_classifier")
def i22b(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("idx"), F.col("embedding").cast("array<double>").alias("f"), F.col("label").cast("long").alias("label"))
    return rounded(L.cross_validated(e, "f", "label", [0.1, 1.0], [0.1, 1.0]))


@query("I23_binary_silhouette", f"WITH {PIX} SELECT img, row, col, CAST(CASE WHEN value > 0 THEN 255 ELSE 0 END AS BIGINT) AS value FROM pix")
def i23(spark, sf):
    return pix(spark).withColumn("value", F.when(F.col("value") > 0, 255).otherwise(0).cast("long"))


@query("I25_sequence_foreground", f"WITH {PIX}, m AS (SELECT row, col, avg(value) AS mean, var_pop(value) AS var FROM pix GROUP BY 1, 2) SELECT img, count(*) FILTER ((value - mean) * (value - mean) > 1.2 * greatest(var, 1)) AS n_fg FROM pix JOIN m ON pix.row = m.row AND pix.col = m.col GROUP BY img")
def i25(spark, sf):
    p = pix(spark)
    return I.foreground(p, I.background_model(p), 1.2).groupBy("img").agg(F.sum(F.col("fg").cast("long")).alias("n_fg"))


@query("A28_segment_votes", f"WITH {PIX}, {DISC}, {SEG} SELECT img, seg, count(*) AS n, count(*) FILTER (p = 0) AS n_bg, count(*) FILTER (p > 0.9) AS n_fg, CASE WHEN count(*) FILTER (p = 0) * 2 > count(*) THEN 'BG' WHEN count(*) FILTER (p > 0.9) * 2 > count(*) THEN 'FG' ELSE 'MID' END AS kind FROM seg GROUP BY 1, 2")
def a28(spark, sf):
    return I.segment_votes(seg(spark).withColumns({"is_bg": F.col("p") == 0, "is_fg": F.col("p") > 0.9}))


@query("A29_segment_scores", f"WITH {PIX}, {DISC}, {SEG}, s AS (SELECT img, seg, avg(p) AS v FROM seg GROUP BY 1, 2) SELECT img, seg, round((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w), 6) AS v FROM s WINDOW w AS (PARTITION BY img)")
def a29(spark, sf):
    return rounded(I.rescaled(seg(spark).groupBy("img", "seg").agg(F.avg("p").alias("v")), "v"))


@query("A30_average_silhouette", f"WITH {PIX} SELECT row, col, CAST(floor(avg(CASE WHEN value > 127 THEN 1 ELSE 0 END) * 255) AS BIGINT) AS value, CAST(0 AS BIGINT) AS label FROM pix GROUP BY 1, 2")
def a30(spark, sf):
    p = pix(spark).withColumns({"value": (F.col("value") > 127).cast("int"), "label": F.lit(0).cast("long")})
    return I.mean_silhouette(p)


@query("J27_superpixel_adjacency", f"WITH {PIX}, {DISC}, {SEG} SELECT a.img, least(a.seg, b.seg) AS a, greatest(a.seg, b.seg) AS b, count(*) AS n, round(avg((a.value + b.value) / 2), 5) AS weight FROM seg a JOIN seg b ON a.img = b.img AND ((b.row = a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1) OR (b.row = a.row AND b.col = a.col + 1)) WHERE a.seg <> b.seg GROUP BY 1, 2, 3")
def j27(spark, sf):
    return rounded(I.region_graph(seg(spark), edge="value"), 5)
