"""Language identification by a byte convolutional network, trained in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, max pooling keeps each filter's
strongest answer and softmax gives the languages. All windows of a text count, by their bytes. For prediction the
embedding and filters are folded into tables over byte pairs, so a window costs a few gathers per byte. Texts stream
through one Arrow map; nothing is shuffled and the model (some MB, whatever the input) is broadcast.

The network is fitted on a bounded sample of labelled rows: SAMPLE_PER_LANG rows of each language (fewer of each, but of every one, where
languages times that exceed SAMPLE_ROWS) with the lowest md5 of doc_id, then text; WINDOWS_PER_DOC windows each. Null texts and texts
without a letter are `und` with score 0. A table without labels predicts `und` for all, an empty one gives no rows. Of languages with equal
probability the first by name is taken. Repeated rows get equal answers. Very long texts are read whole, in pieces of bounded size. Extra columns
are carried by `identify`; its own lang_pred and score replace columns of these names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import in_chunks, table

#: Bounds of the training sample: rows of a language, rows in all, windows of a row.
SAMPLE_PER_LANG, SAMPLE_ROWS, WINDOWS_PER_DOC = 500, 200_000, 4
WINDOW = 256
WIDTHS, FILTERS, EMBED = (2, 3, 4), 8, 8
STEPS, BATCH, RATE = 500, 96, 0.01

_LETTER = re.compile(r"[^\W\d_]")


class ByteConvNet:
    """Embedding, convolutions of WIDTHS bytes with FILTERS filters each, max pooling, softmax."""

    def __init__(self, langs: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.langs = langs
        self.p = {"embed": rng.normal(0, 0.5, (256, EMBED)), "out": rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))), "bias": np.zeros(len(langs))}
        for w in WIDTHS:
            self.p[f"f{w}"] = rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS))
            self.p[f"b{w}"] = np.zeros(FILTERS)

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        e = self.p["embed"][x]
        n, length, _ = e.shape
        pooled, at = [], {}
        for w in WIDTHS:
            cols = np.lib.stride_tricks.sliding_window_view(e, w, axis=1).transpose(0, 1, 3, 2).reshape(n, length - w + 1, w * EMBED)
            a = cols @ self.p[f"f{w}"] + self.p[f"b{w}"]
            at[w] = a.argmax(1)
            pooled.append(np.maximum(a.max(1), 0))
        h = np.concatenate(pooled, 1)
        z = h @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True), {"e": e, "h": h, "at": at}

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        prob, c = self.forward(x)
        n = len(x)
        loss = -np.log(prob[np.arange(n), y] + 1e-12).mean()
        dz = prob.copy()
        dz[np.arange(n), y] -= 1
        dz /= n
        g = {"out": c["h"].T @ dz, "bias": dz.sum(0), "embed": np.zeros_like(self.p["embed"])}
        dh = (dz @ self.p["out"].T) * (c["h"] > 0)
        for i, w in enumerate(WIDTHS):
            d = dh[:, i * FILTERS : (i + 1) * FILTERS]
            taps = c["at"][w][:, :, None] + np.arange(w)  # n, filters, w: only the strongest place learns
            seen = c["e"][np.arange(n)[:, None, None], taps].reshape(n, FILTERS, w * EMBED)
            g[f"f{w}"] = np.einsum("nf,nfk->kf", d, seen)
            g[f"b{w}"] = d.sum(0)
            back = (d[:, :, None] * self.p[f"f{w}"].T[None]).reshape(n, FILTERS, w, EMBED)
            np.add.at(g["embed"], x[np.arange(n)[:, None, None], taps], back)
        return loss, g

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 11) -> ByteConvNet:
        """Adam on batches that hold each language equally often."""
        rng = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(a) for k, a in self.p.items()} for _ in range(2))
        by_lang = [np.flatnonzero(y == k) for k in range(len(self.langs))]
        for t in range(1, steps + 1):
            pick = np.array([rng.choice(by_lang[k]) for k in rng.integers(0, len(self.langs), BATCH)])
            _, g = self.gradients(x[pick], y[pick])
            rate = RATE * min(1, 2 * (1 - t / (steps + 1)))
            for k, d in g.items():
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.01 * (d * d - v[k])
                self.p[k] -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)
        return self

    def folded(self) -> dict:
        """Tables for prediction: what a filter gets from each byte pair (and last single byte) of its span."""
        e, out = self.p["embed"], {"langs": self.langs, "out": self.p["out"].astype(np.float32), "bias": self.p["bias"].astype(np.float32)}
        for w in WIDTHS:
            taps = self.p[f"f{w}"].reshape(w, EMBED, FILTERS)
            single = [(e @ taps[j]).astype(np.float32) for j in range(w)]
            out[w] = [(single[j][:, None] + single[j + 1][None]).reshape(1 << 16, FILTERS) if j + 1 < w else single[j] for j in range(0, w, 2)]
            out[w][0] = out[w][0] + self.p[f"b{w}"].astype(np.float32)
        return out


def cut(raw: bytes) -> np.ndarray:
    """The text in windows of WINDOW bytes, the last padded with spaces."""
    return np.frombuffer(raw + b" " * (-len(raw) % WINDOW), dtype=np.uint8).reshape(-1, WINDOW)


def window_probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    pairs = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
    pooled = []
    for w in WIDTHS:
        span = x.shape[1] - w + 1
        a = np.take(model[w][0], pairs[:, :span], axis=0)
        for j, t in enumerate(model[w][1:], 1):
            a += np.take(t, (pairs if len(t) > 256 else x)[:, 2 * j : 2 * j + span], axis=0)
        pooled.append(np.maximum(a.max(1), 0))
    z = np.concatenate(pooled, 1) @ model["out"] + model["bias"]
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def predict(model: dict | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    langs, scores = ["und"] * len(texts), [0.0] * len(texts)
    work = [(i, t.encode("utf-8", "surrogatepass")) for i, t in enumerate(texts) if model and t and _LETTER.search(t)]
    lo = 0
    while lo < len(work):
        hi, size = lo, 0
        while hi < len(work) and (hi == lo or size + len(work[hi][1]) <= 1 << 18):
            size += len(work[hi][1])
            hi += 1
        parts = [cut(raw) for _, raw in work[lo:hi]]
        # a very long text is still taken in pieces of bounded size
        x = np.concatenate(parts)
        prob = np.concatenate([window_probabilities(model, x[k : k + 1024]) for k in range(0, len(x), 1024)])
        first = 0
        for (i, raw), part in zip(work[lo:hi], parts, strict=True):
            weight = np.full(len(part), float(WINDOW))
            weight[-1] = len(raw) - WINDOW * (len(part) - 1)
            mean = (prob[first : first + len(part)] * weight[:, None]).sum(0) / weight.sum()
            best = int(mean.argmax())
            langs[i], scores[i] = model["langs"][best], float(min(1.0, mean[best]))
            first += len(part)
        lo = hi
    return langs, scores


def train(labelled: DataFrame) -> dict | None:
    """Fit on the bounded sample of labelled (doc_id, text, lang) and return the folded tables; None without labels."""
    rows = labelled.filter("text is not null and lang is not null").filter(F.col("text").rlike(r"\p{L}"))
    by_lang = rows.groupBy("lang").agg(F.count("*").alias("n"))
    n_langs = by_lang.count()
    if not n_langs:
        return None
    each = max(1, min(SAMPLE_PER_LANG, SAMPLE_ROWS // n_langs))
    # twice the wanted share by a hash of doc_id, then each language's lowest hashes: bounded whatever the table's size
    h = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    cut_chars = WINDOW * WINDOWS_PER_DOC
    offset = (h * F.greatest(F.length("text") - cut_chars, F.lit(0)) + 1).cast("int")
    share = by_lang.select("lang", (2 * each / F.col("n")).alias("share"))
    sample = rows.select("lang", h.alias("h"), F.substring(F.col("text"), offset, F.lit(cut_chars)).alias("text")).join(F.broadcast(share) if n_langs <= SAMPLE_ROWS else share, "lang").filter("h <= share")
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    got = sample.withColumn("nth", first).filter(F.col("nth") <= each).select("lang", "h", "text").orderBy("lang", "h", "text").collect()
    langs = sorted({r["lang"] for r in got})
    x, y = [], []
    for r in got:
        if _LETTER.search(r["text"]):
            part = cut(r["text"].encode())[:WINDOWS_PER_DOC]
            x.append(part)
            y += [langs.index(r["lang"])] * len(part)
    langs_seen = sorted(set(y))
    if not langs_seen:
        return None
    remap = {k: i for i, k in enumerate(langs_seen)}
    net = ByteConvNet([langs[k] for k in langs_seen])
    return net.fit(np.concatenate(x), np.array([remap[k] for k in y])).folded()


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """docs with lang_pred and score; only text is read for the prediction."""
    model = docs.sparkSession.sparkContext.broadcast(train(labelled))
    given = [c for c in docs.columns if c not in ("text", "lang_pred", "score")]
    docs = docs.select(*given, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = pc.fill_null(pc.binary_length(b.column("text")), 0).to_pylist()
            for lo, hi in in_chunks(sizes):
                part = b.slice(lo, hi - lo)
                langs, scores = predict(model.value, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*given, "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), "lang_pred string", "score double"])
    return docs.mapInArrow(run, schema)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    labelled = docs.filter(~held_out)
    return identify(docs.select("doc_id", held_out.alias("held_out"), "text"), labelled).select("doc_id", "held_out", "lang_pred", "score")
