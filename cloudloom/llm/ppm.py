"""Language-model scoring by prediction by partial matching over bytes.

The context trie holds how often each byte follows each context of up to ORDER bytes. A byte seen in the longest context
is coded there; else an escape is coded and the next shorter context is asked, without the bytes that longer contexts have
already ruled out (symbol exclusion). The escape estimate is that of method C: as many escapes as distinct bytes seen. A text is
coded with an end mark, byte 0, after ORDER such bytes; a byte 0 in a text is the same symbol.

`Trie` is the plain form; it scores with a pretrained trie or adapts while it reads.

No count is dropped, so trie and words grow with the corpus and stay in tables: documents are dealt into blocks, each
block's distinct words are joined with their counts and its distinct contexts with their coded lengths, and block, words and contexts
meet again. Blocks follow a hash of doc_id and text. What a byte costs depends on it and the ORDER bytes before it alone, so it is worked out once
for each of these that the corpus has: from its context where training has it, else by joins with ever shorter contexts. The
words and contexts of a block travel packed, in parts (buckets) by a hash; the number of buckets grows with the blocks.

Null texts are empty: their words are the end token alone and their score is that of the end mark. Repeated rows get equal scores. Very long texts
are learnt and scored whole, alone in their piece; a block is at least one text. An empty table gives no rows. Columns other than doc_id and text are
ignored, whatever their names. Without training documents every token is unseen and each byte has probability 1/256.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, in_chunks, small, staged, table, word_hashes

ORDER = 5
#: Text bytes of a block, and of the pieces in which counts are taken.
BLOCK_BYTES, PIECE_BYTES = 12 << 20, 1 << 19
#: Keys that are merged at once.
MERGE_KEYS = 1 << 18
#: Parts by which the packed words or contexts of all blocks meet: at least so many, one for so many blocks, and at most so many.
MIN_BUCKETS, BUCKET_BLOCKS, MAX_BUCKETS = 64, 4, 4096
#: What is packed.
WORDS, CONTEXTS = 0, 1
#: The end token's place in the table of word hashes.
END = 0

_U = np.uint64
_LOG10 = math.log(10)


class Trie:
    """Context -> byte -> count, in dictionaries."""

    def __init__(self, order: int = ORDER):
        self.order = order
        self.counts: dict[bytes, dict[int, int]] = {}

    def add(self, history: bytes, symbol: int, n: int = 1) -> None:
        for k in range(self.order + 1):
            node = self.counts.setdefault(history[len(history) - k :], {})
            node[symbol] = node.get(symbol, 0) + n

    def log10(self, history: bytes, symbol: int) -> float:
        excluded: dict[int, int] | set = {}
        total = 0.0
        for k in range(self.order, -1, -1):
            node = self.counts.get(history[len(history) - k :])
            if node is None:
                continue
            n = sum(c for s, c in node.items() if s not in excluded)
            new = sum(1 for s in node if s not in excluded)
            if not new:
                continue
            if symbol in node:
                return total + math.log10(node[symbol] / (n + new))
            total += math.log10(new / (n + new))
            excluded = node
        return total - math.log10(256 - len(excluded))

    def score(self, text: bytes, adapt: bool = False) -> float:
        """log10 of the probability of the text and its end; with adapt, the trie learns as it reads."""
        data = bytes(self.order) + text + b"\0"
        total = 0.0
        for i in range(self.order, len(data)):
            history = data[i - self.order : i]
            total += self.log10(history, data[i])
            if adapt:
                self.add(history, data[i])
        return total

    def learn(self, text: bytes) -> Trie:
        data = bytes(self.order) + text + b"\0"
        for i in range(self.order, len(data)):
            self.add(data[i - self.order : i], data[i])
        return self


def joined(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts with ORDER zeros before and the end mark after each; the places of coded bytes; the first of them per text (n+1)."""
    pad = bytes(order)
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t, b"\0")), dtype=np.uint8)
    sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    first = np.concatenate(([0], np.cumsum(sizes)))
    at = np.arange(first[-1]) + np.repeat((np.arange(len(texts)) + 1) * order, sizes)
    return data, at, first


def grams(data: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """The `order` bytes before each place and the byte there, packed into an integer."""
    d = data.astype(_U)
    key = d.copy()
    for k in range(1, order + 1):
        key[k:] |= d[:-k] << _U(8 * k)
    return key[at]


def gram_counts(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    data, at, _ = joined(texts, order)
    return np.unique(grams(data, at, order), return_counts=True)


def merged_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of all parts, sorted, and the sums of their counts. Large parts, whose keys must be sorted, are merged range by range, so that little is held besides parts and result."""
    total, longest = sum(len(p[0]) for p in parts), max(parts, key=lambda p: len(p[0]))[0]
    if total > MERGE_KEYS:
        cuts = longest[:: max(1, len(longest) * MERGE_KEYS // total)][1:]
        bounds = [[0, *np.searchsorted(keys, cuts).tolist(), len(keys)] for keys, _ in parts]
        some = [_merged([(keys[at[i] : at[i + 1]], n[at[i] : at[i + 1]]) for (keys, n), at in zip(parts, bounds, strict=True)]) for i in range(len(cuts) + 1)]
        return np.concatenate([x[0] for x in some]), np.concatenate([x[1] for x in some])
    return _merged(parts)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


class HashTable:
    """Unsigned 64-bit keys (not all ones) to rows of values, with open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())
        self.shift, self.mask = _U(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, ~_U(0))
        self.rows = np.zeros(1 << bits, dtype=np.int32)
        self.values = values
        left, slot = np.arange(len(keys)), self.slots(keys)
        while len(left):
            free = self.keys[slot] == ~_U(0)
            self.rows[slot[free]] = left[free]  # the last writer of a slot has it
            won = free & (self.rows[slot] == left)
            self.keys[slot[won]] = keys[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1."""
        slot = self.slots(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.rows[slot], -1)
        open_ = np.flatnonzero((there != keys) & (there != ~_U(0)))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & self.mask
            there = self.keys[slot]
            hit = there == keys[open_]
            out[open_[hit]] = self.rows[slot[hit]]
            on = ~hit & (there != ~_U(0))
            open_, slot = open_[on], slot[on]
        return out


def blocked(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """block, doc_id, held_out, raw of every document, and the number of blocks."""
    size = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, math.ceil(size / block_bytes))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")
    return docs.select(block.alias("block"), F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), raw.alias("raw")), n


def buckets_for(blocks: int) -> int:
    """A power of two."""
    return min(MAX_BUCKETS, max(MIN_BUCKETS, 1 << (blocks // BUCKET_BLOCKS).bit_length()))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The part of each hash: its first bits."""
    return (hashes >> _U(64 - buckets.bit_length() + 1)).astype(np.int32)


def context_hashes(keys: np.ndarray) -> np.ndarray:
    return (keys >> _U(8)) * _U(0x9E3779B97F4A7C15)


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted keys and their counts (of one block, so below 2**32) in few bytes."""
    steps = np.diff(keys, prepend=_U(0)).view(np.uint8).reshape(-1, 8)
    return zlib.compress(steps.T.tobytes() + counts.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(12, n)
    keys = np.cumsum(np.ascontiguousarray(planes[:8].T).view(_U).ravel(), dtype=_U)
    return keys, np.ascontiguousarray(planes[8:].T).view(np.uint32).ravel().astype(np.int64)


def learnt(rows: DataFrame, order: int, buckets: int) -> DataFrame:
    """kind, block, bucket, n, packed: the n words or contexts (with the byte that follows) of a block and bucket and their training counts."""

    def parts(kind: int, block: int, counted: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        key, n = merged_counts(counted)
        counted.clear()
        of = bucket_of(key if kind == WORDS else context_hashes(key), buckets).astype(np.int16)
        sort = np.argsort(of, kind="stable")
        of = of[sort]
        cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
        spans = [(x, y) for x, y in zip(cuts, cuts[1:], strict=False) if y > x]
        k = len(spans)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(k, kind, dtype=np.int8)), pa.array(np.full(k, block, dtype=np.int32)), pa.array([int(of[x]) for x, _ in spans], pa.int32()),
             pa.array([y - x for x, y in spans], pa.int64()), pa.array([pack(key[sort[x:y]], n[sort[x:y]]) for x, y in spans], pa.binary())],
            names=["kind", "block", "bucket", "n", "packed"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: list[tuple[np.ndarray, np.ndarray]] = []
        contexts: list[tuple[np.ndarray, np.ndarray]] = []
        block = None
        for b in batches:
            of, held, raw = b.column(0).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), b.column(3)
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if y == x:
                    continue
                if words and of[x] != block:
                    yield parts(WORDS, block, words)
                    yield parts(CONTEXTS, block, contexts)
                    words, contexts = [], []
                block = int(of[x])
                sizes = [len(raw[i].as_buffer()) for i in range(x, y)]
                for lo, hi in in_chunks(sizes, PIECE_BYTES):
                    texts = [raw[x + i].as_py() for i in range(lo, hi)]
                    learns = ~held[x + lo : x + hi]
                    hashes, bounds = word_hashes(texts)
                    train = np.repeat(learns, np.diff(bounds)).astype(np.int64)
                    order_ = np.argsort(hashes)
                    words.append(merged_counts([(hashes[order_], train[order_])]))
                    words.append((np.array([END], dtype=_U), np.array([int(learns.sum())])))
                    for use in (True, False):  # what held-out texts alone have counts 0
                        if some := [t for t, l in zip(texts, learns, strict=True) if l == use]:
                            keys, n = gram_counts(some, order)
                            contexts.append((keys, n * int(use)))
                if len(words) > 16:
                    words = [merged_counts(words)]
                if len(contexts) > 1 and sum(len(c[0]) for c in contexts[1:]) > max(1_000_000, len(contexts[0][0])):
                    contexts = [merged_counts(contexts)]
        if words:
            yield parts(WORDS, block, words)
            yield parts(CONTEXTS, block, contexts)

    return rows.mapInArrow(run, "kind byte, block int, bucket int, n long, packed binary")


def summed(packed: DataFrame) -> DataFrame:
    """bucket, key, n: the training counts over all blocks; 0 where only held-out documents have the key. packed: bucket, n, packed."""

    def run(part: pa.Table) -> pa.Table:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for data, n in zip(part.column("packed"), part.column("n").to_pylist(), strict=True):
            parts.append(unpack(data.as_py(), n))
            if len(parts) > 1 and sum(len(p[0]) for p in parts[1:]) > max(1_000_000, len(parts[0][0])):
                parts = [merged_counts(parts)]
        keys, n = merged_counts(parts)
        return pa.table({"bucket": pa.array(np.full(len(keys), part.column("bucket")[0].as_py(), dtype=np.int32)), "key": pa.array(keys.view(np.int64)), "n": pa.array(n)})

    return packed.groupBy("bucket").applyInArrow(run, "bucket int, key long, n long")


def _suffix(k: int) -> Column:
    """The key within contexts of k bytes."""
    return F.col("key").bitwiseAND((1 << (8 * (k + 1))) - 1)


def coded_lengths(contexts: DataFrame, order: int = ORDER) -> DataFrame:
    """bucket, key, v: log10 of the probability of each key's byte after its context (staged). contexts: bucket, key, n (staged); n is 0 for what training does not have."""
    seen = contexts.filter("n > 0")
    same = Window.partitionBy("bucket", F.shiftright("key", 8))
    given = seen.select("bucket", "key", F.log10(F.col("n") / (F.sum("n").over(same) + F.count("*").over(same))).alias("v"))
    levels = [seen.select("key", "n")]
    for k in range(order - 1, -1, -1):
        levels.insert(0, staged(levels[0].groupBy(_suffix(k).alias("key")).agg(F.sum("n").alias("n")), "ppm-level"))
    # of each context: the sum and number of its counts, and what exclusion takes from the next shorter context
    nodes = []
    for k, x in enumerate(levels):
        if k:
            below = small(levels[k - 1]).select(F.col("key").alias("sub"), F.col("n").alias("below"))
            x = x.withColumn("sub", _suffix(k - 1)).join(below, "sub")
        else:
            x = x.withColumn("below", F.lit(0))
        sums = [F.sum("n").cast("double").alias("total"), F.count("*").cast("double").alias("kinds"), F.sum("below").cast("double").alias("ruled_out")]
        nodes.append(staged(x.groupBy(F.shiftright("key", 8).alias("context")).agg(*sums), "ppm-nodes"))
    zero = F.lit(0.0)
    open_ = contexts.filter("n = 0").select("bucket", "key", zero.alias("v"), zero.alias("gone"), zero.alias("gone_kinds"), F.lit(False).alias("done"))
    for k in range(order, -1, -1):
        open_ = open_.withColumn("context", F.shiftright(_suffix(k), 8)).join(small(nodes[k]), "context", "left")
        if k < order:
            entry = small(levels[k]).select(F.col("key").alias("sub"), F.col("n").cast("double").alias("m"))
            open_ = open_.withColumn("sub", _suffix(k)).join(entry, "sub", "left")
        else:
            open_ = open_.withColumn("m", F.lit(None).cast("double"))
        new = F.col("kinds") - F.col("gone_kinds")
        bottom = F.col("total") - F.col("gone") + new
        asks = ~F.col("done") & F.coalesce(new > 0, F.lit(False))
        found = asks & F.col("m").isNotNull()
        step = F.when(found, F.log10(F.try_divide("m", bottom))).when(asks, F.log10(F.try_divide(new, bottom))).otherwise(0.0)
        # what the next shorter context must leave out: all that this one has seen
        open_ = open_.select(
            "bucket", "key", (F.col("v") + step).alias("v"), F.coalesce("ruled_out", "gone").alias("gone"), F.coalesce("kinds", "gone_kinds").alias("gone_kinds"), (F.col("done") | found).alias("done")
        )
    rest = F.when(F.col("done"), 0.0).otherwise(F.log10(F.greatest(256 - F.col("gone_kinds"), F.lit(1.0))))
    out = staged(given.unionByName(open_.select("bucket", "key", (F.col("v") - rest).alias("v"))), "ppm-lengths")
    discard(*levels[:-1], *nodes)
    return out


def looked_up(packed: DataFrame, values: DataFrame) -> DataFrame:
    """kind, block, n, packed, v: the values, as compressed doubles, of the keys of each block and bucket. packed: kind, block, bucket, n, packed; values: bucket, key, v."""

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        keys, v = right.column("key").to_numpy().view(_U), right.column("v").to_numpy()
        sort = np.argsort(keys)
        keys, v = keys[sort], v[sort]
        got = [zlib.compress(v[np.searchsorted(keys, unpack(d.as_py(), n)[0])].view(np.uint8).reshape(-1, 8).T.tobytes(), 1) for d, n in zip(left.column("packed"), left.column("n").to_pylist(), strict=True)]
        return pa.table({"kind": left.column("kind"), "block": left.column("block"), "n": left.column("n"), "packed": left.column("packed"), "v": pa.array(got, pa.binary())})

    return packed.groupBy("bucket").cogroup(values.groupBy("bucket")).applyInArrow(run, "kind byte, block int, n long, packed binary, v binary")


def together(parts: pa.Table, kind: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and values of all parts of a kind."""
    keys, values = [np.zeros(0, dtype=_U)], [np.zeros(0)]
    for i in np.flatnonzero(parts.column("kind").to_numpy() == kind).tolist():
        n = parts.column("n")[i].as_py()
        keys.append(unpack(parts.column("packed")[i].as_py(), n)[0])
        planes = np.frombuffer(zlib.decompress(parts.column("v")[i].as_py()), dtype=np.uint8).reshape(8, n)
        values.append(np.ascontiguousarray(planes.T).view(np.float64).ravel())
    return np.concatenate(keys), np.concatenate(values)


def scored(docs: DataFrame, order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    rows, blocks = blocked(docs, block_bytes)
    by_block = rows.repartition(max(blocks // 2, min(blocks, 12)), "block").sortWithinPartitions("block")
    got = staged(learnt(by_block, order, buckets_for(blocks)), "ppm-learnt")
    packed = {kind: got.filter(F.col("kind") == kind) for kind in (WORDS, CONTEXTS)}
    words = staged(summed(packed[WORDS]), "ppm-words")
    total, distinct = words.agg(F.sum("n"), F.count(F.when(F.col("n") > 0, 1))).first()
    total, distinct = total or 0, distinct or 0
    contexts = staged(summed(packed[CONTEXTS]), "ppm-contexts")
    lengths = coded_lengths(contexts, order)
    discard(contexts)
    own = looked_up(packed[WORDS], words.select("bucket", "key", F.col("n").cast("double").alias("v"))).unionByName(looked_up(packed[CONTEXTS], lengths))
    unseen, bottom = 0.5 / (total + 0.5 * (distinct + 1)), total + 0.5 * (distinct + 1)

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        hashes, counts = together(right, WORDS)
        sort = np.argsort(hashes)
        hashes, counts = hashes[sort], counts[sort]
        lengths = HashTable(*together(right, CONTEXTS))
        logs = np.log10((counts + 0.5) / bottom)

        def look(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.searchsorted(hashes, words)
            known = counts[at] > 0
            return np.where(known, logs[at], math.log10(unseen)), known

        end, end_known = (x[0] for x in look(np.array([END], dtype=_U)))
        raw = left.column("raw").to_pylist()
        n_tokens, n_known, base, score = [], [], [], []
        for lo, hi in in_chunks([len(r) for r in raw], PIECE_BYTES):
            texts = raw[lo:hi]
            words, bounds = word_hashes(texts)
            uniq, back = np.unique(words, return_inverse=True)
            value, known = look(uniq)
            sums = np.concatenate(([0.0], np.cumsum(value[back])))
            hits = np.concatenate(([0], np.cumsum(known[back])))
            n_tokens += (np.diff(bounds) + 1).tolist()
            n_known += (np.diff(hits[bounds]) + int(end_known)).tolist()
            base += (np.diff(sums[bounds]) + end).tolist()
            data, at, first = joined(texts, order)
            score += np.add.reduceat(lengths.values[lengths.find(grams(data, at, order))], first[:-1]).tolist()
        return pa.table({
            "doc_id": left.column("doc_id"), "held_out": left.column("held_out"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
            "train_tokens": pa.array([total] * len(raw), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(score, pa.float64()),
        })

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return rows.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(run, schema)


def op9_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"))
