"""Line dedup by content-defined chunks of lines.

A rolling hash over the hashes of two neighbouring lines starts a chunk at the first of them where its first hex digit is
small, so chunk edges move with the text when lines are put in or taken out. The head of a chunk, its first line and the next, is
looked up among all heads. Occurrences of a head are compared byte by byte with its first one (by doc_id, then text hash, then
line), and the equal lines around it are counted: on to the start of the next chunk, and back through the chunk before. Of at least
two equal lines with words the later copies are removed. So a passage that repeats is found whole if one of its lines, but
the last, starts a chunk: one line in two does.

A line is removed only if an equal one stands earlier, so one of each stays. Where a head's first occurrence goes on
differently, what only later occurrences share after it is left to the next chunk.

Counting goes by hash with partial sums; lines move only where the hash of a head repeats. A head that a third of all rows
hold costs one comparison row for each task, and its occurrences are joined, never gathered.

Null and empty texts are one empty line, one chunk, never removed. Rows equal in doc_id and text stand or fall together:
they count as one document. Very long texts are cut whole. An empty table gives no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, small, staged, table, text_hash
from .decontaminate import NULL_ID

#: First hex digits of the rolling hash that start a chunk: one line in two on average.
STARTS = ("0", "1", "2", "3", "4", "5", "6", "7")
#: Lines with words that a repeated passage has at least.
MIN_LINES = 2
HAS_WORD = r"[^\x20\x09-\x0D]"


def with_chunks(df: DataFrame) -> DataFrame:
    """df (text) with lines and starts, the 0-based first lines of the chunks."""
    df = held(df, lines=F.split("text", "\n", -1))
    df = held(df, hashes=F.transform("lines", lambda x: F.md5(x)))
    rolling = lambda i: F.md5(F.concat(F.get("hashes", i), F.get("hashes", i + 1)))
    again = lambda i: (F.get("hashes", i) == F.get("hashes", i + 1)) & F.get("lines", i).rlike(HAS_WORD)
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | F.substring(rolling(i), 1, 1).isin(*STARTS) | again(i))
    return held(df, starts=starts).drop("hashes")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, did, th, text of every row; a null text is empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), text_hash(text).alias("th"), text.alias("text"))


def heads(docs: DataFrame) -> DataFrame:
    """did, th, start (line), ch (hash of the head), before (lines of the chunk before), after (lines from start to the next chunk's first, at least two)."""
    d = with_chunks(keyed(docs)).filter(F.size("lines") > 1).select("did", "th", "lines", "starts", F.posexplode("starts").alias("chunk", "start"))
    since = F.when(F.col("chunk") > 0, F.get("starts", F.col("chunk") - 1)).otherwise(0)
    until = F.coalesce(F.get("starts", F.col("chunk") + 1), F.size("lines") - 1)
    before, after = F.slice("lines", since + 1, F.col("start") - since), F.slice("lines", F.col("start") + 1, until - F.col("start") + 1)
    return d.select("did", "th", "start", F.xxhash64(F.get("lines", F.col("start")), F.get("lines", F.col("start") + 1)).alias("ch"), before.alias("before"), after.alias("after"))


def equal_lines(a: Column, b: Column) -> Column:
    """How many lines a and b begin with alike; of the longer one, the rest differs from nothing."""
    return F.coalesce(F.nullif(F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False), F.lit(0)) - 1, F.size(a)).cast("int")


def removed_lines(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """did, th, gone (the 0-based lines that repeat earlier ones)."""
    h = heads(docs)
    often = staged(h.groupBy("ch").agg(F.count("*").alias("n")).filter("n > 1").select("ch"), "often-heads")
    again = staged(h.join(small(often), "ch", "left_semi"), "again-heads")
    first = again.groupBy("ch", F.slice("after", 1, 2).alias("head")).agg(F.min(F.struct("did", "th", "start", "before", "after")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = small(staged(first.select("ch", "head", "first"), "first-heads"))  # a head of a third of all rows is not one task's
    pairs = again.join(first, "ch").filter((F.slice("after", 1, 2) == F.col("head")) & (F.struct("did", "th", "start") != F.struct("first.did", "first.th", "first.start")))
    pairs = held(pairs, on=equal_lines(F.col("after"), F.col("first.after")), back=equal_lines(F.reverse("before"), F.reverse("first.before")))
    with_words = lambda c: F.size(F.filter(c, lambda x: x.rlike(HAS_WORD)))
    n = with_words(F.slice("after", F.lit(1), F.col("on"))) + with_words(F.slice(F.reverse("before"), F.lit(1), F.col("back")))
    lines = F.explode(F.sequence(F.col("start") - F.col("back"), F.col("start") + F.col("on") - 1)).alias("line")
    return pairs.filter(n >= min_lines).select("did", "th", lines).groupBy("did", "th").agg(F.collect_set("line").alias("gone"))


def kept(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, n_lines, n_chunks, n_removed_lines and kept_text of every document."""
    gone = staged(removed_lines(docs, min_lines), "removed-lines")
    d = with_chunks(keyed(docs)).join(small(gone), ["did", "th"], "left")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), "gone"), lambda i: F.get("lines", i))
    return d.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.size("starts").cast("long").alias("n_chunks"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed_lines"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.concat_ws("\n", left)).alias("kept_text"),
    )


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = kept(table(spark, sf_dir, "documents"))
    return k.select("doc_id", "n_lines", "n_chunks", "n_removed_lines", F.sha2("kept_text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, i, line, md5(line) AS h FROM (
    SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
b AS (
  SELECT *, lead(line) OVER w AS line2, i = 1 OR coalesce(substr(md5(h || lead(h) OVER w), 1, 1) < '8' OR (h = lead(h) OVER w AND regexp_matches(line, '[^\x20\x09-\x0D]')), false) AS starts
  FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, list(line ORDER BY i) AS lines FROM l GROUP BY doc_id),
s AS (SELECT doc_id, i, line, line2, lag(i) OVER w AS since, lead(i) OVER w AS until FROM b WHERE starts WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
g AS (
  SELECT doc_id, i, line, line2, CASE WHEN since IS NULL THEN [] ELSE list_reverse(lines[since:i - 1]) END AS before, lines[i:coalesce(until, len(lines))] AS after
  FROM s JOIN t USING (doc_id) WHERE line2 IS NOT NULL),
m AS (SELECT *, row_number() OVER p AS r, first_value(before) OVER p AS fb, first_value(after) OVER p AS fa FROM g WINDOW p AS (PARTITION BY line, line2 ORDER BY doc_id, i)),
x AS (
  SELECT doc_id, i, before, after, len(list_filter(range(1, least(len(after), len(fa)) + 1), lambda k: after[1:k] = fa[1:k])) AS fwd,
         len(list_filter(range(1, least(len(before), len(fb)) + 1), lambda k: before[1:k] = fb[1:k])) AS bwd
  FROM m WHERE r > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i - bwd, i + fwd)) AS i FROM x
  WHERE len(list_filter(list_concat(after[1:fwd], CASE WHEN bwd = 0 THEN [] ELSE before[1:bwd] END), lambda y: regexp_matches(y, '[^\x20\x09-\x0D]'))) >= 2)
SELECT b.doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (starts)::BIGINT AS n_chunks, count(gone.i)::BIGINT AS n_removed_lines,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY b.i) FILTER (gone.i IS NULL), '')) AS kept_sha256
FROM b LEFT JOIN gone ON gone.doc_id = b.doc_id AND gone.i = b.i GROUP BY b.doc_id
"""
