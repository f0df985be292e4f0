"""Suffix-array dedup with longest-previous-factor arrays.

A byte string of MIN_BYTES bytes that starts in more than one place is a repeat. Suffixes are sorted by their first
MIN_BYTES bytes; in that order the nearest suffixes that begin earlier in the corpus (previous and next smaller positions)
give the longest previous factor of every suffix, and those that begin later the longest next factor. A factor of
MIN_BYTES marks a repeat; without an earlier one it is the first, which stays if the first is to be kept.

The suffix array of the corpus is built in pieces that need not know each other. The least hash among the ANCHOR-byte strings of a
MIN_BYTES-byte string is its anchor: equal strings have equal anchors, so suffixes are dealt by anchor, neighbours
with one anchor as one stretch of text. Only stretches whose anchor occurs at least twice can hold a repeat; the others are
dropped after counting anchors, before any text moves. Equal stretches are merged with partial sums. An anchor with more
distinct stretches than HOT_STRETCHES is not gathered: its suffixes are grouped one by one over the cluster.

Null and empty texts have no bytes. Rows equal in doc_id and text are separate places and are both cut. Matches never
cross documents. Very long texts are worked on whole, alone in their chunk. Of equal hashes in a string the leftmost is the anchor. An empty
table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, in_chunks, prefix_sums, small, span_hashes, staged, table, text_hash
from .decontaminate import NULL_ID

MIN_BYTES = 200
ANCHOR = 50
#: Distinct stretches of one anchor that a task sorts; beyond, suffixes are grouped over the cluster.
HOT_STRETCHES = 20_000
#: Suffixes sorted at once.
SORT_ROWS = 60_000
#: Text bytes whose anchors are found at once: some 150 bytes of arrays each.
PIECE_BYTES = 1 << 20
#: Anchors are ordered by the other bits of their hashes; these hold the place in a chunk, which is below 2**31.
ORDER_BITS = 32

_U = np.uint64


def keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), text_hash(text).alias("th"), text.cast("binary").alias("raw"))


def stretches(texts: list[bytes], length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """text index, first and last suffix start (in the text), anchor offset and anchor hash of every stretch of suffixes."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    base = np.concatenate(([0], np.cumsum(sizes)))
    n_keys = len(data) - anchor + 1
    sums = prefix_sums(data)
    at = np.arange(n_keys, dtype=np.int64)
    full = span_hashes(sums, at, at + anchor)
    bits = _U(ORDER_BITS)  # the same in every chunk, or equal strings could get different anchors
    low = (full & ~((_U(1) << bits) - _U(1))) | at.astype(_U)  # ties fall to the leftmost
    width, done = length - anchor + 1, 1
    while done < width:  # running minimum over `width` keys by doubling
        step = min(done, width - done)
        low = np.minimum(low[: len(low) - step], low[step:])
        done += step
    best = (low & ((_U(1) << bits) - _U(1))).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(best)]
    inside = np.arange(len(best)) + length <= base[owner + 1]
    start = np.flatnonzero(inside)
    best, owner = best[start], owner[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (best[1:] != best[:-1]) | (owner[1:] != owner[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    own = owner[first]
    return own, start[first] - base[own], start[last] - base[own], best[first] - base[own], full[best[first]].view(np.int64)


def long_enough(batch: pa.RecordBatch, at: int, length: int) -> Iterator[tuple[list[int], list[bytes]]]:
    """Row numbers and texts of at least `length` bytes, in chunks of bounded size."""
    raw = batch.column(at)
    sizes = pc.binary_length(raw).to_pylist()
    rows = [i for i, x in enumerate(sizes) if x >= length]
    for lo, hi in in_chunks([sizes[i] for i in rows], PIECE_BYTES):
        yield rows[lo:hi], [raw[i].as_py() for i in rows[lo:hi]]


def anchors(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """h, did, th, n: how often each anchor serves each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            for ids, texts in long_enough(b, 2, length):
                own, _, _, _, h = stretches(texts, length, anchor)
                order = np.lexsort((h, own))
                own, h = own[order], h[order]
                new = np.ones(len(h), dtype=bool)
                new[1:] = (own[1:] != own[:-1]) | (h[1:] != h[:-1])
                first = np.flatnonzero(new)
                row = np.asarray(ids)[own[first]]
                n = np.diff(np.append(first, len(h)))
                yield pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(did[row]), pa.array(th[row]), pa.array(n.astype(np.int32))], names=["h", "did", "th", "n"])

    return rows.select("did", "th", "raw").mapInArrow(run, "h long, did long, th long, n int")


def live_stretches(rows: DataFrame, length: int, anchor: int) -> DataFrame:
    """h, at (anchor offset in the stretch), body, did, th, start: the stretches whose anchor is in `often`. rows: did, th, raw, often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            often = b.column(3)
            for ids, texts in long_enough(b, 2, length):
                own, lo, hi, at, h = stretches(texts, length, anchor)
                bounds = np.searchsorted(own, np.arange(len(texts) + 1))
                keep = np.concatenate([np.isin(h[x:y], often[i].values.to_numpy()) for x, y, i in zip(bounds, bounds[1:], ids, strict=False)])
                own, lo, hi, at, h = (x[keep] for x in (own, lo, hi, at, h))
                row = np.asarray(ids)[own]
                body = [texts[o][x : y + length] for o, x, y in zip(own.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array((at - lo).astype(np.int32)), pa.array(body, pa.binary()), pa.array(did[row]), pa.array(th[row]), pa.array(lo)], names=["h", "at", "body", "did", "th", "start"]
                )

    return rows.select("did", "th", "raw", "often").mapInArrow(run, "h long, at int, body binary, did long, th long, start long")


def nearest(pos: np.ndarray, lcp: np.ndarray, smaller: bool, before: bool) -> np.ndarray:
    """For every place of the suffix order: the common prefix with the nearest suffix before (or after) it whose position is smaller (or greater).

    lcp[i] belongs to places i-1 and i. Candidates that don't qualify hand over to their own candidate until all are settled.
    """
    if not before:
        return nearest(pos[::-1], np.append(0, lcp[:0:-1]), smaller, True)[::-1]
    n = len(pos)
    to, common = np.arange(-1, n - 1), lcp.copy()
    key = pos if smaller else -pos
    open_ = np.flatnonzero((to >= 0) & (common > 0))
    while len(open_):
        t = to[open_]
        bad = (t >= 0) & (common[open_] > 0)
        open_, t = open_[bad], t[bad]
        wrong = key[t] >= key[open_]
        open_, t = open_[wrong], t[wrong]
        step_to, step_common = to[t].copy(), common[t].copy()
        common[open_] = np.minimum(common[open_], step_common)
        to[open_] = step_to
    return np.where(to >= 0, common, 0)


def factor_lengths(windows: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factor of every suffix, bounded by the window. windows: (n, length) bytes; first, last: positions of its earliest and latest copy."""
    n, length = windows.shape
    order = np.argsort(np.ascontiguousarray(windows).view(f"S{length}").ravel(), kind="stable")
    w = windows[order]
    differs = w[1:] != w[:-1]
    lcp = np.concatenate(([0], np.where(differs.any(1), differs.argmax(1), length))).astype(np.int64)
    out = []
    for pos, smaller in ((first[order], True), (last[order], False)):
        f = np.maximum(nearest(pos, lcp, smaller, True), nearest(pos, lcp, smaller, False))
        back = np.empty(n, dtype=np.int64)
        back[order] = f
        out.append(back)
    return out[0], out[1]


def runs(mask: np.ndarray) -> list[list[int]]:
    """[from, to) of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return edge.reshape(-1, 2).tolist()


def sorted_group(group: list[tuple], length: int) -> Iterator[tuple[list[list[int]], list[list[int]]]]:
    """For every stretch (at, body, n, first, last) of a few anchors: runs of suffixes that repeat, and of those of them that are the first."""
    counts = [len(g[1]) - length + 1 for g in group]
    where = np.repeat(np.arange(len(group)), counts)
    inner = np.arange(len(where)) - np.repeat(np.cumsum([0, *counts[:-1]]), counts)
    data = np.frombuffer(b"".join(g[1] for g in group), dtype=np.uint8)
    base = np.cumsum([0, *(len(g[1]) for g in group[:-1])])
    view = np.lib.stride_tricks.sliding_window_view(data, length)
    rank = {p: i for i, p in enumerate(sorted({p for g in group for p in (g[3], g[4])}))}
    first, last = (np.array([rank[g[k]] for g in group], dtype=np.int64)[where] for k in (3, 4))
    # suffixes of equal text stand equally far from the anchor, so each distance can be sorted on its own
    distance = np.array([g[0] for g in group])[where] - inner
    previous, following = np.zeros(len(where), dtype=np.int64), np.zeros(len(where), dtype=np.int64)
    by = np.argsort(distance, kind="stable")
    cuts = np.flatnonzero(np.diff(distance[by])) + 1
    edges = [0, *cuts.tolist(), len(by)]
    for lo, hi in in_chunks(np.diff(edges).tolist(), SORT_ROWS):
        part = by[edges[lo] : edges[hi]]
        previous[part], following[part] = factor_lengths(view[base[where[part]] + inner[part]], first[part], last[part])
    bounds = np.cumsum([0, *counts])
    for g, x, y in zip(group, bounds, bounds[1:], strict=False):
        earlier = previous[x:y] >= length
        again = np.ones(y - x, dtype=bool) if g[2] > 1 else earlier | (following[x:y] >= length)
        yield runs(again), runs(again & ~earlier)


def repeats(merged: DataFrame, length: int) -> DataFrame:
    """h, body_hash, again, own: judged stretches. merged: h, at, body, body_hash, n, first, last (structs did, th, start), one row a distinct stretch, in order of h."""
    kind = pa.list_(pa.list_(pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[tuple] = []

        def flush() -> pa.RecordBatch:
            judged = list(sorted_group(pending, length))
            out = pa.RecordBatch.from_arrays(
                [pa.array([g[5] for g in pending], pa.int64()), pa.array([g[6] for g in pending], pa.int64()), pa.array([j[0] for j in judged], kind), pa.array([j[1] for j in judged], kind)],
                names=["h", "body_hash", "again", "own"],
            )
            pending.clear()
            return out

        size, h_last = 0, None
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(7)]
            for h, at, body, body_hash, n, first, last in zip(*cols, strict=True):
                if h != h_last and size > SORT_ROWS:
                    yield flush()
                    size = 0
                pending.append((at, body, n, tuple(first.values()), tuple(last.values()), h, body_hash))
                size += len(body) - length + 1
                h_last = h
        if pending:
            yield flush()

    return merged.select("h", "at", "body", "body_hash", "n", "first", "last").mapInArrow(run, "h long, body_hash long, again array<array<int>>, own array<array<int>>")


def hot_repeats(merged: DataFrame, length: int) -> DataFrame:
    """As repeats(), for anchors with too many stretches for a task: every suffix is a row, grouped by its bytes."""
    inner = F.explode(F.sequence(F.lit(0), F.octet_length("body") - length)).alias("i")
    each = merged.select("h", "body_hash", "n", "first", inner, F.col("body"))
    each = each.select("h", "body_hash", "n", "i", F.struct(F.col("first.did").alias("did"), F.col("first.th").alias("th"), (F.col("first.start") + F.col("i")).alias("start")).alias("pos"), F.expr(f"substring(body, i + 1, {length})").alias("bytes"))
    classes = each.groupBy("bytes").agg(F.sum("n").alias("total"), F.min("pos").alias("least")).filter("total > 1")
    hit = each.join(classes, "bytes").select("h", "body_hash", "i", (F.col("pos") == F.col("least")).alias("own"))
    span = F.array(F.col("i"), F.col("i") + 1)
    return hit.groupBy("h", "body_hash").agg(F.collect_list(span).alias("again"), F.collect_list(F.when(F.col("own"), span)).alias("own"))


def repeat_spans(docs: DataFrame, length: int = MIN_BYTES, anchor: int = ANCHOR, keep_first: bool = False, hot: int = HOT_STRETCHES) -> DataFrame:
    """did, th, spans: the byte spans [from, to) of each document (key did, th) that repeats cover; spans may overlap.

    keep_first leaves out suffixes that no earlier place of the corpus (in order of doc_id, text hash, byte) has.
    """
    rows = keyed(docs)
    a = staged(anchors(rows, length, anchor), "suffix-anchors")
    often = a.groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")
    served = staged(a.select("h", "did", "th").join(often, "h", "left_semi").groupBy("did", "th").agg(F.collect_set("h").alias("often")), "suffix-served")
    discard(a)
    live = staged(live_stretches(rows.join(served, ["did", "th"]), length, anchor).withColumn("body_hash", F.xxhash64("body")), "suffix-stretches")
    discard(served)
    place = F.struct("did", "th", "start")
    merged = staged(live.groupBy("h", "at", "body", "body_hash").agg(F.count("*").alias("n"), F.min(place).alias("first"), F.max(place).alias("last")), "suffix-merged")
    hot_anchors = small(staged(merged.groupBy("h").agg(F.count("*").alias("k")).filter(F.col("k") > hot).select("h"), "suffix-hot"))
    cold = merged.join(hot_anchors, "h", "left_anti").repartition("h").sortWithinPartitions("h")
    judged = repeats(cold, length).unionByName(hot_repeats(merged.join(hot_anchors, "h", "left_semi"), length))
    judged = staged(judged.filter(F.size("again") > 0), "suffix-judged")
    hits = live.select("h", "body_hash", "did", "th", "start").join(judged, ["h", "body_hash"])
    if keep_first:
        # of equal stretches the first place keeps the suffixes that are the first of their kind
        firsts = merged.select("h", "body_hash", F.col("first").alias("f"))
        hits = hits.join(firsts, ["h", "body_hash"]).withColumn("keep", F.when(place == F.col("f"), F.col("own")).otherwise(F.array().cast("array<array<int>>")))
        inner = F.flatten(F.transform("again", lambda r: F.sequence(r[0], r[1] - 1)))
        kept = F.flatten(F.transform("keep", lambda r: F.sequence(r[0], r[1] - 1)))
        each = F.transform(F.array_except(inner, kept), lambda i: F.struct((F.col("start") + i).alias("lo"), (F.col("start") + i + length).alias("hi")))
    else:
        each = F.transform("again", lambda r: F.struct((F.col("start") + r[0]).alias("lo"), (F.col("start") + r[1] - 1 + length).alias("hi")))
    spans = staged(hits.select("did", "th", each.alias("s")).groupBy("did", "th").agg(F.flatten(F.collect_list("s")).alias("spans")), "suffix-spans")
    discard(live, merged, judged)
    return spans


def cut_out(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of raw, the bytes removed and the maximal removed runs."""
    left, at, removed, n = [], 0, 0, 0
    for lo, hi in sorted(spans):
        if lo > at or not n:
            left.append(raw[at:lo])
            n += 1
            removed += hi - lo
            at = hi
        elif hi > at:
            removed += hi - at
            at = hi
    left.append(raw[at:])
    return b"".join(left), removed, n


def without_repeats(docs: DataFrame, length: int = MIN_BYTES, anchor: int = ANCHOR, keep_first: bool = False, hot: int = HOT_STRETCHES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes left) of every document."""
    spans = repeat_spans(docs, length, anchor, keep_first, hot)
    rows = keyed(docs).join(spans, ["did", "th"], "left").select("doc_id", "raw", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raws, out = b.column(1).to_pylist(), []
            for raw, spans in zip(raws, b.column(2).to_pylist(), strict=True):
                out.append(cut_out(raw, [(s["lo"], s["hi"]) for s in spans]) if spans else (raw, 0, 0))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(r) for r in raws], pa.int64()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64()), pa.array([o[0] for o in out], pa.binary())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(texts: list[bytes], length: int) -> list[tuple[int, int, str]]:
    """n_removed, n_spans and kept_sha256 of every text, by a table of all strings (for tests)."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in texts:
        left, removed, n = cut_out(t, [(i, i + length) for i in range(len(t) - length + 1) if seen[t[i : i + length]] > 1])
        out.append((removed, n, hashlib.sha256(left).hexdigest()))
    return out


OP1_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS g FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
t AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM s) WHERE n > 1),
m AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS fresh FROM t),
k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m),
r AS (SELECT doc_id, run, min(i) AS lo, max(i) + 200 AS hi FROM k GROUP BY doc_id, run),
g AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS free FROM r),
x AS (SELECT d.doc_id, count(*) AS n_spans, sum(hi - lo) AS n_removed, string_agg(substr(h, 2 * free + 1, 2 * (lo - free)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS kept
      FROM g JOIN d USING (doc_id) GROUP BY d.doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM d LEFT JOIN x USING (doc_id)
"""
