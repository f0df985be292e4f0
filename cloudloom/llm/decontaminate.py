"""Benchmark decontamination over a distributed positional inverted index.

1. Every benchmark item is cut into windows of consecutive words; equal windows are kept once.
2. The training frequency of every window term is counted over all documents.
3. The positions of each window's two rarest terms are stored as postings (term, document, position); postings of
   a lead (rarest) term also keep the words around it.
4. Lead positions minus the lead's offset give window starts, and the words around the lead are compared with the whole
   window. The second list, adjusted by its own offset, is asked last; it removes nothing that this comparison has left.

Common words are never posted unless a window consists of nothing rarer, and no pair of documents is formed, so the
work is linear in the text. A third of all rows holding one passage adds its matches only.

Null and empty texts have no words; they get no hits. Items without words have no windows. Repeated documents are each
reported, repeated items count once per item_id, a null item_id is named 'null'. Empty tables work on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import item_word_count, item_words, small, staged, table, text_hash

WINDOW_WORDS = 8
#: Items from which a document counts as contaminated.
MIN_ITEMS = 2
NULL_ID = -(1 << 63)


def tokens(docs: DataFrame) -> DataFrame:
    """did, th (a row's key: doc_id and text hash) and words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), text_hash(text).alias("th"), item_words(text).alias("words"))


def windows(items: DataFrame, size: int = WINDOW_WORDS) -> tuple[DataFrame, DataFrame]:
    """(win, terms): the distinct windows; (win, item_id): the items that have them."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), F.filter(item_words(F.col("text")), lambda w: w != "").alias("words")).filter(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    w = staged(w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("terms")), "windows")
    distinct = staged(w.select("terms").distinct().withColumn("win", F.monotonically_increasing_id()), "distinct-windows")
    return distinct, w.join(distinct, "terms").select("win", "item_id").distinct()


def known(tokens: DataFrame, terms: DataFrame) -> DataFrame:
    """tokens (token and more) that are one of the terms (term and more). The join is by hash, which is much cheaper than by text; the texts are compared after it."""
    t = small(staged(terms.withColumn("term_hash", F.xxhash64("term")), "hashed-terms"))
    return tokens.join(t, F.xxhash64("token") == F.col("term_hash")).filter(F.startswith("token", "term") & F.startswith("term", "token")).drop("term_hash")


def term_counts(toks: DataFrame, terms: DataFrame) -> DataFrame:
    """term, n: how often each of the terms stands in the training text."""
    return known(toks.select(F.explode("words").alias("token")), terms).groupBy("term").agg(F.count("*").alias("n"))


def ranked_terms(wins: DataFrame, counts: DataFrame) -> DataFrame:
    """win, terms, lead, lead_at, second, second_at: offsets of the two rarest terms; windows with an absent term are gone."""
    each = wins.select("win", "terms", F.posexplode("terms").alias("at", "term")).join(counts, "term", "left")
    order = F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term", "at")))
    return (
        each.groupBy("win").agg(F.first("terms").alias("terms"), order.alias("o"))
        .filter("o[0].n > 0")
        .select("win", "terms", F.expr("o[0].term").alias("lead"), F.expr("o[0].at").alias("lead_at"), F.expr("o[least(1, size(o) - 1)].term").alias("second"), F.expr("o[least(1, size(o) - 1)].at").alias("second_at"))
    )


def postings(toks: DataFrame, chosen: DataFrame, reach: int = WINDOW_WORDS - 1) -> DataFrame:
    """term, did, th, at (0-based), base, around: the index. chosen: term, is_lead. Leads keep words [base, at + reach]."""
    p = known(toks.select("did", "th", "words", F.posexplode("words").alias("at", "token")), chosen)
    base = F.greatest(F.col("at") - reach, F.lit(0))
    return p.select("term", "did", "th", "at", base.alias("base"), F.when(F.col("is_lead"), F.slice("words", base + 1, F.col("at") - base + reach + 1)).alias("around"))


def candidates(index: DataFrame, wins: DataFrame) -> DataFrame:
    """did, th, win, start, terms, base, around: a window start for every posting of a window's lead term."""
    lead = index.filter("around is not null").join(small(wins), F.col("term") == F.col("lead"))
    return lead.select("did", "th", "win", (F.col("at") - F.col("lead_at")).alias("start"), "terms", "base", "around", "second", "second_at")


def phrase_matches(index: DataFrame, wins: DataFrame) -> DataFrame:
    """did, th, win, start, n: the exact occurrences of windows of n words."""
    c = candidates(index, wins).filter("start >= base").withColumn("second_pos", F.col("start") + F.col("second_at"))
    # the remaining terms are read from the posting's neighbourhood before the second list is asked for
    c = c.filter(F.slice("around", F.col("start") - F.col("base") + 1, F.size("terms")) == F.col("terms"))
    second = index.select(F.col("term").alias("second"), "did", "th", F.col("at").alias("second_pos"))
    return c.join(second, ["second", "did", "th", "second_pos"], "left_semi").select("did", "th", "win", "start", F.size("terms").alias("n")).distinct()


def proximity_matches(index: DataFrame, wins: DataFrame) -> DataFrame:
    """did, th, win: documents that hold all terms of a window, in any order, within the reach of its lead term."""
    c = candidates(index, wins)
    return c.filter(F.size(F.array_except("terms", "around")) == 0).select("did", "th", "win").distinct()


def build(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The stored index, the windows that can occur with their two rarest terms, and the windows' items."""
    toks = tokens(docs)
    wins, owners = windows(items, size)
    terms = staged(wins.select(F.explode("terms").alias("term")).distinct(), "window-terms")
    ranked = staged(ranked_terms(wins, staged(term_counts(toks, terms), "term-counts")), "ranked-windows")
    chosen = ranked.select(F.col("lead").alias("term"), F.lit(1).alias("l")).union(ranked.select("second", F.lit(0)))
    chosen = staged(chosen.groupBy("term").agg((F.max("l") == 1).alias("is_lead")), "chosen-terms")
    return staged(postings(toks, chosen, size - 1), "postings"), ranked, owners


def covered(spans: Column) -> Column:
    """Words covered by (start, n) spans, sorted by start."""
    step = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("total")),
        lambda acc, x: F.struct(F.greatest(acc["end"], x["start"] + x["n"]).alias("end"), (acc["total"] + F.greatest(x["start"] + x["n"] - F.greatest(acc["end"], x["start"]), F.lit(0))).alias("total")),
    )
    return step["total"]


def found(docs: DataFrame, items: DataFrame, size: int = WINDOW_WORDS) -> DataFrame:
    """did, th, n_hit, n_items, n_near, ids: one row for each document key with a match."""
    index, wins, owners = build(docs, items, size)
    owners = small(staged(owners, "window-owners"))
    exact = staged(phrase_matches(index, wins), "phrase-matches")
    hits = exact.select("did", "th", "start", "n").distinct().groupBy("did", "th").agg(covered(F.sort_array(F.collect_list(F.struct("start", "n")))).cast("long").alias("n_hit"))
    by_item = exact.select("did", "th", "win").distinct().join(owners, "win").groupBy("did", "th").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    near = proximity_matches(index, wins).join(owners, "win").groupBy("did", "th").agg(F.countDistinct("item_id").alias("n_near"))
    return hits.join(by_item, ["did", "th"], "full").join(near, ["did", "th"], "full")


def keyed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs as a struct, so that no name can clash), did, th."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("did"), text_hash(text).alias("th"))


def decontaminate(docs: DataFrame, items: DataFrame, min_items: int = MIN_ITEMS) -> DataFrame:
    """The documents with fewer than min_items benchmark items; columns unchanged."""
    bad = staged(found(docs, items).filter(F.size("ids") >= min_items).select("did", "th"), "contaminated")
    return keyed(docs).join(small(bad), ["did", "th"], "left_anti").select("row.*")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hits = staged(found(docs, table(spark, sf_dir, "benchmark")), "decontaminated")
    rows = keyed(docs).select("row.doc_id", "did", "th", item_word_count(F.col("row.text")).cast("long").alias("n_words"))
    zero = F.lit(0).cast("long")
    n_items = F.coalesce(F.size("ids"), F.lit(0)).cast("long")
    ids = F.concat_ws(",", F.coalesce("ids", F.array().cast("array<string>")))
    return rows.join(hits, ["did", "th"], "left").select(
        F.col("doc_id").cast("long").alias("doc_id"), "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.greatest(n_items, zero).alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (n_items >= MIN_ITEMS).alias("contaminated"), F.coalesce("n_near", zero).alias("n_near"),
    )


OP2_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT item_id, w[i:i + 7] AS terms FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS i FROM iw WHERE len(w) > 0)),
uwin AS (SELECT terms, terms[1] AS t1, terms[len(terms)] AS tl, len(terms) AS n FROM (SELECT DISTINCT terms FROM win)),
tok AS (SELECT doc_id, w, unnest(w) AS term, unnest(range(1, len(w) + 1)) AS pos FROM dw),
hit AS (SELECT t.doc_id, t.pos, u.terms, u.n FROM tok t JOIN uwin u ON t.term = u.t1 AND t.w[t.pos + u.n - 1] = u.tl AND t.w[t.pos:t.pos + u.n - 1] = u.terms),
cov AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(id, ',' ORDER BY id)) AS sha
        FROM (SELECT DISTINCT h.doc_id, CAST(win.item_id AS VARCHAR) AS id FROM hit h JOIN win ON win.terms = h.terms) GROUP BY doc_id),
lead AS (
  SELECT DISTINCT t.doc_id, x.terms FROM (
    SELECT terms, arg_min(term, (n, term, pos)) AS lead FROM (
      SELECT e.terms, e.term, e.pos, c.n FROM (SELECT terms, unnest(terms) AS term, unnest(range(1, len(terms) + 1)) AS pos FROM uwin) e
      LEFT JOIN (SELECT term, count(*) AS n FROM tok GROUP BY term) c ON c.term = e.term)
    GROUP BY terms HAVING count(*) = count(n)) x
  JOIN tok t ON t.term = x.lead AND len(list_filter(x.terms, lambda y: NOT list_contains(t.w[greatest(t.pos - 7, 1):t.pos + 7], y))) = 0),
near AS (SELECT l.doc_id, count(DISTINCT win.item_id) AS n_near FROM lead l JOIN win ON win.terms = l.terms GROUP BY l.doc_id)
SELECT dw.doc_id, CAST(len(dw.w) AS BIGINT) AS n_words, CAST(coalesce(cov.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(its.n_items, 0) AS BIGINT) AS n_items,
       coalesce(its.sha, sha256('')) AS items_sha256, coalesce(its.n_items, 0) >= 2 AS contaminated, CAST(coalesce(near.n_near, 0) AS BIGINT) AS n_near
FROM dw LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN near USING (doc_id)
"""
