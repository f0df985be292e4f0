"""K-d tree sharding.

The whole table is one node that must hold n shards; a node of k > 1 shards is split along its widest metadata
dimension at the weighted quantile of its bytes (the median where k is even) until every leaf holds one shard's bytes. The quantile is found
by distributed histograms: bytes by node and bin, then only the bin where the half ends is refined. The driver sees
nodes times bins, never rows.

The dimensions (bytes, lines, digest) are functions of the text, so equal texts fall on one side of a cut. Where a cut falls inside a group of copies it
moves to the group's nearer edge, if that moves at most GROUP_TOLERANCE of the bytes that the smaller side is to have; else the next widest dimension is
tried. So a group of up to twice that share of a shard stays in one shard whatever the data, and a larger one unless it lies across the quantile in
every dimension; then it is split by a hash of the row, as the law (bytes) asks.

Null texts have size 1, one line and digest 0. Repeated rows are separate rows; ties of all dimensions are copies or share a digest, and are treated as
copies. A very long text is one row, so its shard exceeds the others by as much. An empty table gives no rows. Extra columns are
carried only if named.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import small, staged, table

#: Bits of a dimension, and bits that one histogram resolves.
DIM_BITS, STEP_BITS = 32, 8
#: Share of a shard's bytes by which a split may miss its quantile before the boundary bin is refined further.
TOLERANCE = 0.002
#: Share of the smaller side's bytes by which a cut may move to keep a group of copies whole.
GROUP_TOLERANCE = 0.01
DIMENSIONS = ["size", "n_lines", "text_crc32"]


def described(docs: DataFrame, carry: list[str] | None = None) -> DataFrame:
    """doc_id, size, n_lines, text_crc32, part and rid (row number unique in the table) of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    keep = [F.col(c) for c in carry or []]
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("rid"), *keep,
    )


class Node:
    def __init__(self, shards: int, first: int):
        self.shards, self.first = shards, first
        self.cut: tuple[int, tuple[int, ...]] | None = None  # dimension, key below which rows go left
        self.left: Node | None = None
        self.right: Node | None = None


def keys_of(dims: list[str], d: int) -> list[Column]:
    """The refinement order along dimension d: its value, then the other dimensions, then a hash of the row."""
    order = [dims[d], *(x for i, x in enumerate(dims) if i != d)]
    return [F.least(F.col(x), F.lit((1 << DIM_BITS) - 1)) for x in order] + [F.xxhash64("rid").bitwiseAND((1 << DIM_BITS) - 1)]


def below(keys: list[Column], cut: tuple[int, ...]) -> Column:
    """keys < cut, compared as tuples; a shorter cut stands for its smallest extension."""
    out = F.lit(False)
    for k, c in reversed(list(zip(keys, cut, strict=False))):
        out = (k < c) | ((k == c) & out)
    return out


def leaf_index(node: Node, dims: list[str]) -> Column:
    """The first shard of the node that a row is in."""
    if node.cut is None:
        return F.lit(node.first)
    d, cut = node.cut
    return F.when(below(keys_of(dims, d), cut), leaf_index(node.left, dims)).otherwise(leaf_index(node.right, dims))


def split_all(rows: DataFrame, dims: list[str], root: Node, open_nodes: list[Node], spans: dict[str, int], tolerance: float) -> None:
    """Give each open node its cut. One histogram job a round serves all of them."""
    at = leaf_index(root, dims)
    stats = {r["node"]: r for r in rows.groupBy(at.alias("node")).agg(F.sum("size").alias("bytes"), *(f(x).alias(f"{n}_{x}") for x in dims for n, f in (("lo", F.min), ("hi", F.max)))).collect()}
    todo: dict[int, dict] = {}
    for n in open_nodes:
        r = stats.get(n.first)
        total = r["bytes"] if r else 0
        widest = sorted(range(len(dims)), key=lambda i: ((r[f"lo_{dims[i]}"] - r[f"hi_{dims[i]}"]) / max(1, spans[dims[i]]) if r else 0, i))
        want = total * (n.shards // 2) / n.shards
        todo[n.first] = {"node": n, "dim": widest[0], "next": widest[1:], "half": want, "want": want, "slack": tolerance * total / n.shards, "done": (), "value": 0, "bits": 0}
    steps = DIM_BITS // STEP_BITS
    while todo:
        prefix, bucket = F.lit(False), F.lit(None).cast("long")
        for first, s in todo.items():
            keys = keys_of(dims, s["dim"])
            level = len(s["done"])
            same = at == first
            for k, c in zip(keys, s["done"], strict=False):
                same &= k == c
            if s["bits"]:
                same &= F.shiftright(keys[level], DIM_BITS - s["bits"]) == s["value"]
            prefix |= same
            bucket = F.when(same, F.shiftright(keys[level], DIM_BITS - s["bits"] - STEP_BITS)).otherwise(bucket)
        found: dict[int, list] = {first: [] for first in todo}
        ends = [f(x).alias(f"{n}_{x}") for x in dims for n, f in (("lo", F.min), ("hi", F.max))]
        for r in rows.filter(prefix).groupBy(at.alias("node"), bucket.alias("bucket")).agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), *ends).collect():
            one = tuple(min(r[f"lo_{x}"], (1 << DIM_BITS) - 1) for x in dims) if all(r[f"lo_{x}"] == r[f"hi_{x}"] for x in dims) else None
            found[r["node"]].append((r["bucket"], r["bytes"], one, r["n"]))
        for first, s in list(todo.items()):
            upto, edge = 0, None
            for b, size, one, n_rows in sorted(found[first], key=lambda x: x[0]):
                if upto + size > s["want"]:
                    edge = (b, size, one, n_rows)
                    break
                upto += size
            level, bits = len(s["done"]), s["bits"] + STEP_BITS
            if edge is None:  # an empty node
                n = s["node"]
                cut, over = (*s["done"], (s["value"] + 1) << (DIM_BITS - s["bits"])) if s["bits"] else (*s["done"], 1 << DIM_BITS), True
            else:
                b, size, one, n_rows = edge
                left = s["want"] - upto
                last = level == len(dims) and bits == steps * STEP_BITS
                moved = min(left, size - left)
                over = last or moved <= s["slack"]
                after = size - left < left
                cut = (*s["done"], (b + after) << (DIM_BITS - bits))
                if one and not over and level < len(dims):  # what is left is one group of copies, or one row
                    order = (one[s["dim"]], *(x for i, x in enumerate(one) if i != s["dim"]))
                    if n_rows == 1 or moved <= GROUP_TOLERANCE * s["half"]:
                        over, cut = True, (*order[:-1], order[-1] + after)
                    elif s["next"]:
                        s.update(dim=s["next"][0], next=s["next"][1:], want=s["half"], done=(), value=0, bits=0)
                        continue
                    else:
                        s.update(want=left, done=order, value=0, bits=0)
                        continue
                s["want"] = left
            if over:
                n = s["node"]
                n.cut = (s["dim"], cut)
                n.left, n.right = Node(n.shards // 2, n.first), Node(n.shards - n.shards // 2, n.first + n.shards // 2)
                del todo[first]
            elif bits == DIM_BITS:
                s["done"], s["value"], s["bits"] = (*s["done"], b), 0, 0
            else:
                s["value"], s["bits"] = b, bits


def grow(rows: DataFrame, shards: int, dims: list[str], tolerance: float = TOLERANCE) -> Node:
    """The tree over rows (size and the dimensions, integers from 0 to 2**32 - 1)."""
    root = Node(shards, 0)
    r = rows.agg(*(f(x).alias(f"{n}_{x}") for x in dims for n, f in (("lo", F.min), ("hi", F.max)))).first()
    spans = {x: (r[f"hi_{x}"] or 0) - (r[f"lo_{x}"] or 0) for x in dims}
    level = [root]
    while open_nodes := [n for n in level if n.shards > 1]:
        split_all(rows, dims, root, open_nodes, spans, tolerance)
        level = [x for n in open_nodes for x in (n.left, n.right)]
    return root


def with_shards(rows: DataFrame, shards: int) -> DataFrame:
    """rows (staged, from described()) with shard and slot; slots count from 0 without gaps in every shard.

    A slot is the rows of the shard in earlier parts plus the rank within the part, so no task holds a whole shard.
    """
    dims = DIMENSIONS
    placed = rows.withColumn("shard", leaf_index(grow(rows, shards, dims), dims).cast("int"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = small(staged(counts.select("shard", "part", before.alias("before")), "shard-offsets"))
    rank = F.row_number().over(Window.partitionBy("shard", "part").orderBy("rid")) - 1
    return placed.withColumn("rank", rank).join(offsets, ["shard", "part"]).withColumn("slot", (F.col("before") + F.col("rank")).cast("long")).drop("rank", "before")


def op6_kd_shards(spark: SparkSession, sf_dir: str, shards: int = 16) -> DataFrame:
    rows = staged(described(table(spark, sf_dir, "documents")), "shard-rows")
    return with_shards(rows, shards).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
