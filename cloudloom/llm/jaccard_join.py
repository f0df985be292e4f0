"""N-gram Jaccard join by chosen paths.

Texts are sets of five-word shingles; texts with equal sets are one class. Each set is embedded into TOKENS minhash tokens, of which
two sets share a part equal to their Jaccard similarity. At a tree node every set chooses its tokens by a hash of node and
token, BRANCH of them on average, and goes to a child node for each: similar sets choose shared tokens
together. Sets first meet after PATH choices, so that one shared passage seldom joins two texts. Nodes of few sets are searched by brute force over the tokens; larger ones are split again. A
run misses a pair at the threshold with a known probability, so runs repeat until the target recall.

Candidate links join classes into groups by spanning links only, whose sets are then compared exactly: by one task where the group is
small, else by one task for each pair of its blocks. No pair leaves a task: it returns each class's count of links and spanning links.

Words are runs without ASCII white space, A-Z lower-cased. A text of fewer than five words, but not none, is one shingle. Null
and empty texts, and texts of white space, are linked to nothing. Rows equal in doc_id and text count as two documents. Very long texts
are hashed whole, alone in their chunk. Ties between equal sets go to the least doc_id, then text hash. An empty table gives no rows. Columns of any
name are ignored by the query; `one_of_each` carries them in a struct, so none can clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_chunks, mixed, small, staged, table, text_hash, word_hashes
from .components import components
from .decontaminate import NULL_ID

SHINGLE_WORDS = 5
THRESHOLD = 0.8
RECALL = 0.9999
TOKENS, BRANCH = 128, 2.0
#: Tokens chosen before sets meet at a node.
PATH = 2
#: Sets of a node up to which it is searched, and levels after which it is searched whatever its size.
LEAF, DEPTH = 4000, 6
#: Sets of a first node above which its members are linked to a pivot first.
PIVOTED = 200
#: Sets that one task compares.
BLOCK = 800
#: A pair is a candidate if its share of equal tokens is at most this many standard errors below the threshold.
MARGIN = 4.5

_U = np.uint64
_SEEDS = mixed(np.arange(1, TOKENS + 1, dtype=_U) * _U(0x9E3779B97F4A7C15)) | _U(1)


def runs_for(recall: float, threshold: float = THRESHOLD) -> int:
    """Runs until a pair at the threshold is found with probability `recall`.

    A pair shares BRANCH * threshold chosen tokens at each node on average (Poisson); it is lost in a run with the extinction probability of
    that branching process at most, whatever the depth.
    """
    lost = 0.0
    for _ in range(200):
        lost = math.exp(-BRANCH * threshold * (1 - lost))
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def shingles(texts: list[bytes], words: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, sorted within each, and their bounds (n+1)."""
    h, bounds = word_hashes(texts)
    count = np.diff(bounds)
    n = np.where(count >= words, count - words + 1, (count > 0).astype(np.int64))
    own = np.repeat(np.arange(len(texts)), n)
    first = np.concatenate(([0], np.cumsum(n)))
    at = np.arange(first[-1]) - first[own] + bounds[own] if len(own) else np.zeros(0, dtype=np.int64)
    value = np.zeros(len(at), dtype=_U)
    padded = np.concatenate((h, np.zeros(words, dtype=_U)))
    for j in range(words):
        there = j < count[own]
        value = value * _U(0x100000001B3) + np.where(there, padded[at + j], _U(j + 1))
    value = mixed(value)
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    new = np.ones(len(value), dtype=bool)
    new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
    value, own = value[new], own[new]
    return value, np.searchsorted(own, np.arange(len(texts) + 1))


def shingles_in_pieces(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """shingles() of any number of texts; the bytes that are worked on at once are bounded."""
    values, bounds = [np.zeros(0, dtype=_U)], [np.zeros(1, dtype=np.int64)]
    for lo, hi in in_chunks([len(t) for t in texts]):
        v, b = shingles(texts[lo:hi])
        values.append(v)
        bounds.append(b[1:] + bounds[-1][-1])
    return np.concatenate(values), np.concatenate(bounds)


def key_of_row(docs: DataFrame) -> tuple[Column, Column]:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), text_hash(F.coalesce(F.col("text"), F.lit("")))


def choose(node: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """row and child of every chosen token. node: (n,), tokens: (n, TOKENS) hashes that hold value and position."""
    child = mixed(tokens ^ mixed(node)[:, None])
    row, col = np.nonzero(child < _U(int(BRANCH / TOKENS * 2.0**64)))
    return row, mixed(child[row, col])


def short_tokens(short: np.ndarray) -> np.ndarray:
    """Token hashes from the one-byte form of the minhashes."""
    return mixed((short.astype(_U) << _U(8)) + np.arange(short.shape[1], dtype=_U))


def embedded(docs: DataFrame, runs: int) -> DataFrame:
    """did, th, k1, k2 (the set's fingerprint), n_sh, short (a byte of each minhash), nodes (those after PATH choices, of all runs) of every document with words."""
    roots = mixed(np.arange(1, runs + 1, dtype=_U) * _U(0xD1342543DE82EF95))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            did, th, raw = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_pylist()
            for lo, hi in in_chunks([len(r) for r in raw]):
                value, bounds = shingles(raw[lo:hi])
                size = np.diff(bounds)
                full = np.flatnonzero(size)
                if not len(full):
                    continue
                start = bounds[full]
                k1 = np.add.reduceat(mixed(value), start)
                k2 = np.add.reduceat(mixed(value ^ _U(0xA0761D6478BD642F)), start)
                least = np.empty((len(full), TOKENS), dtype=_U)
                for t in range(TOKENS):
                    least[:, t] = np.minimum.reduceat(value * _SEEDS[t], start)
                short = (least >> _U(40)).astype(np.uint8)
                tokens = mixed(least + np.arange(TOKENS, dtype=_U))
                nodes = [[] for _ in full]
                for root in roots:
                    row, node = np.arange(len(full)), np.full(len(full), root)
                    for _ in range(PATH):
                        at, node = choose(node, tokens[row])
                        row = row[at]
                    for r, c in zip(row.tolist(), node.view(np.int64).tolist(), strict=True):
                        nodes[r].append(c)
                at = lo + full
                yield pa.RecordBatch.from_arrays(
                    [pa.array(did[at]), pa.array(th[at]), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(size[full].astype(np.int32)),
                     pa.array([s.tobytes() for s in short], pa.binary()), pa.array(nodes, pa.list_(pa.int64()))],
                    names=["did", "th", "k1", "k2", "n_sh", "short", "nodes"],
                )

    did, th = key_of_row(docs)
    rows = docs.select(did.alias("did"), th.alias("th"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    return rows.mapInArrow(run, "did long, th long, k1 long, k2 long, n_sh int, short binary, nodes array<long>")


def split(nodes: DataFrame) -> DataFrame:
    """node, cid, comp, short of the children. nodes: node, cid, comp, short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            short = b.column(3).to_pylist()
            cid, comp = b.column(1).to_numpy(), b.column(2).to_numpy()
            node = b.column(0).to_numpy().view(_U)
            for lo in range(0, len(short), 2000):
                part = np.frombuffer(b"".join(short[lo : lo + 2000]), dtype=np.uint8).reshape(-1, TOKENS)
                row, child = choose(node[lo : lo + 2000], short_tokens(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(child.view(np.int64)), pa.array(cid[lo : lo + 2000][row]), pa.array(comp[lo : lo + 2000][row]), pa.array([short[lo + r] for r in row.tolist()], pa.binary())],
                    names=["node", "cid", "comp", "short"],
                )

    return nodes.select("node", "cid", "comp", "short").mapInArrow(run, "node long, cid long, comp long, short binary")


def least_equal(threshold: float) -> int:
    """Equal tokens from which a pair is a candidate."""
    return math.ceil(TOKENS * (threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / TOKENS)))


class Forest:
    """Union-find; links() spans what was united."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def unite(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)

    def links(self) -> list[tuple[int, int]]:
        return [(i, r) for i in range(len(self.up)) if (r := self.root(i)) != i]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each group in turn; the first column is the group, rows come in order of it."""
    rows: list[tuple] = []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if rows and r[0] != rows[-1][0]:
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def search(leaves: DataFrame, threshold: float) -> DataFrame:
    """a, b: links between candidates of each leaf that join what no component or earlier link joins. leaves: node, cid, comp, short; in order of node."""
    least = least_equal(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for rows in grouped(batches):
            x = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8).reshape(-1, TOKENS)
            _, comp = np.unique(np.array([r[2] for r in rows], dtype=np.int64), return_inverse=True)
            forest = Forest(int(comp.max()) + 1)
            for i in range(len(rows) - 1):
                other = i + 1 + np.flatnonzero(comp[i + 1 :] != comp[i])
                for j in other[(x[other] == x[i]).sum(1) >= least].tolist():
                    if forest.root(int(comp[i])) != forest.root(int(comp[j])):
                        forest.unite(int(comp[i]), int(comp[j]))
                        a.append(rows[i][1])
                        b.append(rows[j][1])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return leaves.select("node", "cid", "comp", "short").mapInArrow(run, "a long, b long")


def block_pairs(rows: DataFrame, key: str, count: str, block: int) -> DataFrame:
    """rows with task and half: groups of more than `block` rows are dealt into blocks, and each two blocks (and each alone) make a task."""
    n = F.ceil(F.col(count) / block).cast("int")
    mine = F.pmod(F.xxhash64("cid"), n).cast("int")
    rows = rows.withColumn("blocks", n).withColumn("mine", mine)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    return rows.withColumn("half", (F.col("mine") > F.col("other")).cast("int")).withColumn("task", F.when(F.col("blocks") == 1, F.col(key)).otherwise(F.xxhash64(key, lo, hi))).drop("blocks", "mine", "other")


def at_nodes(level: DataFrame, nodes: DataFrame) -> DataFrame:
    """level with the columns of nodes (node, n and more; staged), joined by node. Nodes of many rows are few and go to every task if they are small enough, so that no task gets all rows of one."""
    hot = small(nodes.filter(F.col("n") > PIVOTED))
    return level.join(hot, "node").unionByName(level.join(nodes.filter(F.col("n") <= PIVOTED), "node"))


def to_pivots(members: DataFrame, threshold: float) -> DataFrame:
    """a, b: links of members to the pivots of their nodes, where they are candidates. members: cid, short, pivot, pivot_short."""
    least = least_equal(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), dtype=np.uint8).reshape(-1, TOKENS) for i in (1, 3))
            keep = pa.array((x == y).sum(1) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(2).filter(keep)], names=["a", "b"])

    return members.select("cid", "short", "pivot", "pivot_short").mapInArrow(run, "a long, b long")


def candidate_links(classes: DataFrame, threshold: float) -> DataFrame:
    """a, b: links that join all candidate classes. classes: cid, short, nodes (staged).

    Members of large nodes are first linked to the node's least member, its pivot. Each class then carries the component that this puts it in: a node, or
    child of a node, whose members are all in one component is done. So a large group of near copies is not carried from level to level.
    """
    short = classes.select("cid", "short")
    level = classes.select(F.explode("nodes").alias("node"), "cid")
    crowds = staged(level.groupBy("node").agg(F.count("*").alias("n"), F.min("cid").alias("pivot")).filter(F.col("n") > PIVOTED), "path-crowds")
    members = at_nodes(level, crowds).filter("cid <> pivot").select("cid", "pivot").distinct()
    members = members.join(short, "cid").join(small(staged(short.join(crowds.select(F.col("pivot").alias("cid")).distinct(), "cid", "left_semi"), "path-pivots")).toDF("pivot", "pivot_short"), "pivot")
    found = staged(to_pivots(members, threshold).distinct(), "path-pivot-links")
    roots = staged(components(found), "path-components").select(F.col("node").alias("cid"), "root")
    # staged, as the first level is read three times
    known = staged(classes.select("cid", "nodes").join(roots, "cid", "left").select("cid", "nodes", F.coalesce("root", "cid").alias("comp")), "path-known")
    level = known.select(F.explode("nodes").alias("node"), "cid", "comp")
    for depth in range(DEPTH + 1):
        open_ = staged(level.groupBy("node").agg(F.count("*").alias("n"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo < hi").select("node", "n"), "path-open")
        level = at_nodes(level, open_)
        if depth == 0:
            level = level.join(short, "cid")
        level = staged(level.select("node", "n", "cid", "comp", "short"), "path-level")
        leaves = level.filter(F.col("n") <= LEAF) if depth < DEPTH else level
        dealt = block_pairs(leaves, "node", "n", LEAF).select(F.col("task").alias("node"), "cid", "comp", "short")
        found = found.union(staged(search(dealt.repartition("node").sortWithinPartitions("node"), threshold), "path-links"))
        big = level.filter(F.col("n") > LEAF)
        if depth == DEPTH or not big.limit(1).count():
            return found
        level = split(big)
    return found


def compared(rows: DataFrame, threshold: float) -> DataFrame:
    """cid, n_links (documents in linked classes), to (null, or a class that it is linked with): exact comparison in tasks. rows: task, half, cid, copies, raw; in order of task.

    A task of two blocks compares across them, and within a block only if it is alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped(batches):
            split_task = len({r[1] for r in group}) > 1
            value, bounds = shingles_in_pieces([r[4] for r in group])
            size = np.diff(bounds)
            own = np.repeat(np.arange(len(group)), size)
            order = np.argsort(value, kind="stable")
            v, d = value[order], own[order]
            _, back, times = np.unique(v, return_inverse=True, return_counts=True)
            shared = times[back] > 1
            back, d = back[shared], d[shared]
            _, back = np.unique(back, return_inverse=True)
            common = np.zeros((len(group), len(group)), dtype=np.float32)
            width = 2048
            cuts = np.searchsorted(back, np.arange(0, (back[-1] + 1 if len(back) else 0) + width, width))
            for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                if y > x:
                    m = np.zeros((len(group), width), dtype=np.float32)
                    m[d[x:y], back[x:y] - k * width] = 1
                    common += m @ m.T
            linked = common >= threshold * (size[:, None] + size[None] - common) - 1e-4
            np.fill_diagonal(linked, False)
            half = np.array([r[1] for r in group])
            if split_task:
                linked &= half[:, None] != half[None]
            copies = np.array([r[3] for r in group], dtype=np.int64)
            cids = [r[2] for r in group]
            forest = Forest(len(group))
            for i in range(len(group)):
                for j in np.flatnonzero(linked[i, :i]).tolist():
                    forest.unite(i, j)
            n = (linked * copies[None]).sum(1)
            to = [None] * len(group)
            for i, r in forest.links():
                to[i] = cids[r]
            yield pa.RecordBatch.from_arrays([pa.array(cids, pa.int64()), pa.array(n, pa.int64()), pa.array(to, pa.int64())], names=["cid", "n_links", "to"])

    return rows.select("task", "half", "cid", "copies", "raw").mapInArrow(run, "cid long, n_links long, to long")


def joined(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """did, th, copy_id, n_links, class_id for each distinct (did, th) of documents with words.

    copy_id: the class of equal shingle sets; n_links: documents, other than the row, at the threshold or above; class_id: the least copy_id
    that is reached over links.
    """
    e = staged(embedded(docs, runs_for(recall, threshold)), "jaccard-embedded")
    classes = e.groupBy("k1", "k2").agg(F.count("*").alias("copies"), F.min(F.struct("did", "th", "short", "nodes")).alias("r"))
    classes = staged(classes.select(F.monotonically_increasing_id().alias("cid"), "k1", "k2", "copies", F.col("r.did").alias("did"), F.col("r.th").alias("th"), F.col("r.short").alias("short"), F.col("r.nodes").alias("nodes")), "jaccard-classes")
    groups = staged(components(candidate_links(classes, threshold)), "jaccard-candidates")
    sizes = groups.groupBy("root").agg(F.count("*").alias("n"))
    members = groups.join(sizes, "root").join(classes.select(F.col("cid").alias("node"), "copies", "did", "th"), "node").withColumnRenamed("node", "cid")
    did, th = key_of_row(docs)
    texts = docs.select(did.alias("did"), th.alias("th"), F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("raw"))
    # a class's representative may be there in several equal rows: its text is taken once
    with_text = members.join(texts, ["did", "th"])
    with_text = with_text.groupBy("cid").agg(F.first("root").alias("root"), F.first("n").alias("n"), F.first("copies").alias("copies"), F.first("raw").alias("raw"))
    tasks = block_pairs(with_text, "root", "n", BLOCK).repartition("task").sortWithinPartitions("task")
    exact = staged(compared(tasks, threshold), "jaccard-exact")
    counts = exact.groupBy("cid").agg(F.sum("n_links").alias("n_links"))
    real = components(exact.filter("to is not null").select(F.col("cid").alias("a"), F.col("to").alias("b")))
    # the least (doc_id, text hash) names a class of copies and a group
    # only compared classes have counts or groups: the two are joined before the far larger table of classes
    found = counts.join(real.withColumnRenamed("node", "cid"), "cid", "left")
    info = classes.select("cid", "k1", "k2", "copies", F.struct("did", "th").alias("name")).join(found, "cid", "left")
    info = staged(info.withColumn("root", F.coalesce("root", "cid")), "jaccard-classes-linked")
    least = info.groupBy("root").agg(F.min("name").alias("group_name"))
    info = info.join(least, "root").select("k1", "k2", F.col("name.did").alias("copy_id"), (F.coalesce("n_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("group_name.did").alias("class_id"), F.col("group_name.th").alias("class_th"))
    return e.select("did", "th", "k1", "k2").distinct().join(info, ["k1", "k2"]).drop("k1", "k2")


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without near-duplicates of an earlier one: of each group the least doc_id (then text hash) stays, once. Columns unchanged.

    Of rows equal in doc_id and text one stays, that with the least other columns (as JSON); only these rows are shuffled.
    """
    did, th = key_of_row(docs)
    groups = staged(joined(docs, threshold), "jaccard-groups")
    # the columns travel as a struct, so that no name can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), did.alias("did"), th.alias("th"))
    gone = groups.filter("did <> class_id or th <> class_th").select("did", "th")
    stays = rows.join(gone, ["did", "th"], "left_anti")
    twice = docs.select(did.alias("did"), th.alias("th")).join(groups.select("did", "th"), ["did", "th"], "left_semi").groupBy("did", "th").agg(F.count("*").alias("n")).filter("n > 1").select("did", "th")
    twice = small(staged(twice, "jaccard-twice"))
    single = stays.join(twice, ["did", "th"], "left_anti").select("row")
    one = stays.join(twice, ["did", "th"], "left_semi").groupBy("did", "th").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
    return single.union(one).select("row.*")


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    did, th = key_of_row(docs)
    got = joined(docs)
    rows = docs.select("doc_id", did.alias("did"), th.alias("th"))
    doc_id = F.col("doc_id").cast("long")
    return rows.join(got, ["did", "th"], "left").select(doc_id.alias("doc_id"), F.coalesce("class_id", doc_id).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("copy_id", doc_id).alias("copy_id"))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(w[i:i + 4]) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b, c = na.n AND c = nb.n AS copy FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 5 * c >= 4 * (na.n + nb.n - c)),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id)
SELECT d.doc_id, (SELECT min(root) FROM r WHERE r.doc_id = d.doc_id) AS class_id, (SELECT count(*) FROM l WHERE a = d.doc_id) AS n_links,
       least(d.doc_id, (SELECT min(b) FROM l WHERE a = d.doc_id AND copy)) AS copy_id
FROM documents d
"""
