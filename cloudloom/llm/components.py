"""Connected components of links in a distributed table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def components(links: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for every node of links (a, b: long).

    Alternating large and small stars: each round hangs every node's larger neighbours below its least one, then every
    node's smaller neighbours below the least of them, until nothing changes; a few rounds do for groups of any shape.
    """
    e = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = staged(e, "cc-links")
    rows = e.count()
    while rows:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        large = staged(large, "cc-large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m")), F.struct(F.col("b").alias("a"), F.col("m")))).alias("x")).select(F.col("x.a").alias("a"), F.col("x.m").alias("b"))
        new = staged(small.filter("a <> b").distinct(), "cc-small")
        # both are free of repeats: of equal size, one holds the other only if they are equal
        before, rows = rows, new.count()
        same = rows == before and not e.join(new, ["a", "b"], "left_anti").limit(1).count()
        e = new
        if same:
            break
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).union(e.select(F.col("b"), F.col("b")).distinct())
