"""Mixing sources to target weights by hash-threshold histograms.

Sizes are summed by source and hash bucket; the bucket in which a source's budget ends is the only one that is refined,
twelve hash bits at a time, until one hash is left. The thresholds then select documents with a plain filter: nothing is
sorted, and a larger budget always takes a superset. Partial sums make a hot source cost one row per bucket and task.

Null texts have size 0, a null source is a source of its own (last in order), rows that share a doc_id stand or fall
together, an empty table gives no rows, and extra columns are ignored by the query and carried by `mix`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_WORD, small, staged, table

#: No document is taken more often than this.
MAX_REPEATS = 3
#: Hash bits in all, and bits that one histogram resolves.
HASH_BITS, STEP_BITS = 60, 12


def doc_hash() -> F.Column:
    """60 bits of the md5 of doc_id as text."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and hash of every document."""
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(SPACE_WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), doc_hash().alias("h"))


def targets(sizes: DataFrame, repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target: shares by the weights 1, 2, 3, repeating; what a full source can't hold is reshared.

    The share `level` per unit of weight is a fixed point: total size not bound by full sources over the weight of the others.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by_source = staged(sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", ((rank - 1) % 3 + 1).cast("double")), "mix-sources")
    level, full = 0.0, -1
    while True:
        over = F.col("source_size") * repeats <= level * F.col("weight")
        n, left, weight = by_source.agg(F.sum(over.cast("int")), F.sum("source_size") - F.coalesce(F.sum(F.when(over, F.col("source_size") * repeats)), F.lit(0)), F.sum(F.when(~over, F.col("weight")))).first()
        if n is None or n == full or not weight:
            break
        full, level = n, left / weight
    return by_source.select("source", "source_size", F.least((F.col("source_size") * repeats).cast("double"), level * F.col("weight")).alias("target"))


def thresholds(sizes: DataFrame, budgets: DataFrame) -> DataFrame:
    """source, h_end: documents with h < h_end fill the source's budget up to the nearest whole hash.

    sizes: source, size, h; budgets: source, budget.
    """
    state = budgets.select("source", F.col("budget"), F.lit(0).cast("long").alias("prefix"))
    rest = sizes
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        s = small(staged(state, "mix-state"))
        inside = rest.alias("r").join(s.alias("s"), F.expr(f"r.source <=> s.source and shiftright(r.h, {shift + STEP_BITS}) = s.prefix")).select("r.source", "r.size", "r.h", "s.budget")
        if shift < HASH_BITS - STEP_BITS:
            inside = staged(inside, "mix-inside")
            rest = inside.drop("budget")
        bucket = F.shiftright("h", shift)
        hist = inside.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"), F.first("budget").alias("budget"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        w = Window.partitionBy("source").orderBy("bucket")
        ranked = hist.withColumn("upto", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(F.col("upto") > F.col("budget"))
        edge = ranked.groupBy("source").agg(F.min_by(F.struct("bucket", "size", "upto", "budget", "lo", "hi"), "bucket").alias("e")).select("source", "e.*")
        edge = staged(edge, "mix-edge")
        state = edge.select("source", (F.col("budget") - F.col("upto") + F.col("size")).alias("budget"), F.col("bucket").alias("prefix"), "size", "lo", "hi")
        if shift == 0 or not edge.filter("lo < hi").limit(1).count():
            break
        state = state.select("source", "budget", "prefix")
    # the last bucket holds one hash: it is in if that comes nearer to the budget
    return state.select("source", F.when(F.col("size") - F.col("budget") < F.col("budget"), F.col("lo") + 1).otherwise(F.col("lo")).alias("h_end"))


def plan(sizes: DataFrame, repeats: int = MAX_REPEATS) -> DataFrame:
    """source, source_size, target, rounds (times that every document is taken), h_end (those below once more)."""
    t = staged(targets(sizes, repeats), "mix-targets")
    rounds = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(repeats))).otherwise(0).cast("long")
    t = t.withColumn("rounds", rounds)
    ends = thresholds(sizes, t.filter(F.col("rounds") < repeats).select("source", (F.col("target") - F.col("rounds") * F.col("source_size")).alias("budget")))
    return t.alias("t").join(ends.alias("e"), F.expr("t.source <=> e.source"), "left").select("t.*", F.coalesce(F.col("e.h_end"), F.lit(0).cast("long")).alias("h_end"))


def times(sizes: DataFrame, planned: DataFrame) -> DataFrame:
    """sizes with source_size, target and times, how often each document is taken."""
    p = small(staged(planned, "mix-plan")).alias("p")
    again = F.when((F.col("p.rounds") < MAX_REPEATS) & (F.col("d.h") < F.col("p.h_end")), 1).otherwise(0)
    return sizes.alias("d").join(p, F.expr("d.source <=> p.source")).select("d.*", "p.source_size", "p.target", (F.col("p.rounds") + again).alias("times"))


def mix(docs: DataFrame) -> DataFrame:
    """The documents of the mix: each as often as it is taken, columns unchanged."""
    sizes = staged(measured(docs), "mix-sizes")
    p = small(staged(plan(sizes), "mix-plan")).alias("p")
    rows = docs.select(F.struct(*docs.columns).alias("row"), doc_hash().alias("h"), F.col("source").cast("string").alias("source")).alias("d")
    again = F.when((F.col("p.rounds") < MAX_REPEATS) & (F.col("d.h") < F.col("p.h_end")), 1).otherwise(0)
    taken = rows.join(p, F.expr("d.source <=> p.source")).select("d.row", (F.col("p.rounds") + again).cast("int").alias("n"))
    return taken.filter("n > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("n")))).select("row.*")


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = staged(measured(table(spark, sf_dir, "documents")), "mix-sizes")
    return times(sizes, plan(sizes)).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken"))


OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS weight
  FROM d GROUP BY source),
r AS (
  SELECT *, 3 * source_size / weight AS ratio,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / weight ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_before,
         sum(weight) OVER (ORDER BY 3 * source_size / weight ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weight_left,
         sum(source_size) OVER () AS total
  FROM s),
l AS (SELECT arg_min((total - full_before) / weight_left, ratio) AS level FROM r WHERE (total - full_before) / weight_left <= ratio),
t AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), level * weight) AS target FROM s, l),
b AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS rounds FROM t),
c AS (
  SELECT d.doc_id, d.size, b.source_size, b.target, b.rounds, b.target - b.rounds * b.source_size AS budget,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(d.size) OVER (PARTITION BY d.source, d.h) AS tied
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (rounds + CASE WHEN rounds < 3 AND (upto <= budget OR (upto - tied <= budget AND upto - budget < budget - (upto - tied))) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
