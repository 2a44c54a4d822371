"""Chunks of documents and their nearness to a benchmark item that is the document's query."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import retrieval as rt
from tidemark.plans.catalog import register
from tidemark.sources.tables import table

_Q = "q AS (SELECT doc_id AS doc, b.text FROM documents JOIN benchmark b ON b.item_id = doc_id % 40)"
_LAST = "(CASE WHEN strpos(reverse({s}), ' .') > 0 THEN length({s}) - strpos(reverse({s}), ' .') WHEN strpos(reverse({s}), ' ') > 0 THEN length({s}) - strpos(reverse({s}), ' ') + 1 END)"
_SEG = f"substr(t, s + {rt.SIZE // 2} + 1, {rt.SIZE - rt.SIZE // 2})"
_CHUNKS = f"""
flat AS (SELECT doc_id AS doc, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS t FROM documents),
walk(doc, k, s, e, n) AS (
  SELECT doc, -1, 0::BIGINT, NULL::BIGINT, length(t)::BIGINT FROM flat WHERE t <> ''
  UNION ALL
  SELECT doc, k + 1, e2, NULL, n FROM (
    SELECT w.doc, w.k, w.n, CASE WHEN w.k = -1 THEN 0 WHEN w.s + {rt.SIZE} >= w.n THEN NULL ELSE greatest(cut - {rt.OVERLAP}, w.s + 1) END AS e2
    FROM (SELECT walk.*, s + coalesce({rt.SIZE // 2} + {_LAST.format(s=_SEG)}, {rt.SIZE}) AS cut FROM walk JOIN flat USING (doc)) w) WHERE e2 IS NOT NULL AND e2 < n),
piece AS MATERIALIZED (SELECT doc, k::BIGINT AS pos, trim(substr(t, s + 1, CASE WHEN s + {rt.SIZE} >= n THEN n - s ELSE coalesce({rt.SIZE // 2} + {_LAST.format(s=_SEG)}, {rt.SIZE}) END)) AS text FROM walk JOIN flat USING (doc) WHERE k >= 0)"""
_TERMS = """
part AS (SELECT doc, pos, text FROM piece UNION ALL SELECT doc, -1, text FROM q),
words AS (SELECT doc, pos, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS w FROM part),
tf AS (SELECT doc, pos, term, count(*) AS tf FROM (SELECT doc, pos, unnest(list_concat(w, list_transform(range(len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2]))) AS term FROM words) GROUP BY 1, 2, 3),
n AS (SELECT doc, count(*) AS n FROM part GROUP BY doc), df AS (SELECT doc, term, count(*) AS df FROM tf GROUP BY 1, 2),
wt AS (SELECT doc, pos, term, tf * (ln((1 + n) / (1 + df)::DOUBLE) + 1) AS w FROM tf JOIN n USING (doc) JOIN df USING (doc, term)),
nm AS (SELECT doc, pos, sqrt(sum(w * w)) AS norm FROM wt GROUP BY 1, 2),
dot AS (SELECT c.doc, c.pos, sum(c.w * q.w) AS dot FROM wt c JOIN wt q ON c.doc = q.doc AND c.term = q.term AND q.pos = -1 WHERE c.pos >= 0 GROUP BY 1, 2),
sc AS (SELECT piece.doc, piece.pos, coalesce(dot / (c.norm * q.norm), 0) AS score FROM piece LEFT JOIN dot USING (doc, pos) LEFT JOIN nm c ON c.doc = piece.doc AND c.pos = piece.pos LEFT JOIN nm q ON q.doc = piece.doc AND q.pos = -1)"""


def pieces(spark, d):
    t = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), F.posexplode(rt.chunks(F.col("text"))).alias("pos", "text"))
    return t.withColumn("pos", F.col("pos").cast("long"))


def asked(spark, d):
    """(doc, text, query): each document with its benchmark item, null where there is none. Remainders name 79 items at most: these travel."""
    items = table(spark, d, "benchmark").where("item_id BETWEEN -39 AND 39").select("item_id", F.col("text").alias("query"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text", (F.col("doc_id") % 40).alias("item_id"))
    return docs.join(F.broadcast(items), "item_id", "left").select("doc", "text", "query")


def scored(spark, d):
    """(doc, pieces, score): arrays of the pieces of each document and of their scores."""
    cut = asked(spark, d).select("doc", rt.chunks(F.col("text")).alias("pieces"), "query")
    return cut.select("doc", "pieces", rt.scores(F.col("pieces"), F.col("query")).alias("score"))


@register("str_29_chunks", f"WITH RECURSIVE {_CHUNKS} SELECT doc, pos, text FROM piece")
def str_29(spark, d):
    return pieces(spark, d)


@register("str_31_chunk_scores", f"WITH RECURSIVE {_CHUNKS}, {_Q}, {_TERMS} SELECT doc, pos, round(score, 9) AS score FROM sc")
def str_31(spark, d):
    rounded = F.transform("score", lambda x: F.round(x, 9))  # exploding the scores as they are would filter by their number first, and score twice
    return scored(spark, d).select("doc", F.posexplode(rounded).alias("pos", "score")).withColumn("pos", F.col("pos").cast("long"))


@register("srt_09_top_chunks", f"""
WITH RECURSIVE {_CHUNKS}, {_Q}, {_TERMS} SELECT doc, pos, text, rank FROM (SELECT doc, pos, text, row_number() OVER (PARTITION BY doc ORDER BY round(score, 12) DESC, pos) AS rank FROM sc JOIN piece USING (doc, pos)) WHERE rank <= {rt.TOP}""")
def srt_09(spark, d):
    best = scored(spark, d).select("doc", F.posexplode(rt.best_first(F.col("pieces"), F.col("score"))).alias("k", "best"))
    return best.select("doc", "best.pos", "best.text", (F.col("k") + 1).alias("rank"))


@register("str_33_content_changed", f"""
WITH RECURSIVE v AS (SELECT doc_id AS doc, text AS a, CASE doc_id % 3 WHEN 0 THEN text WHEN 1 THEN regexp_replace(text, '^\\S+', 'Other') ELSE (SELECT text FROM benchmark WHERE item_id = doc_id % 40) END AS b FROM documents),
piece AS (SELECT doc, 0 AS pos, b AS text FROM v), q AS (SELECT doc, a AS text FROM v), {_TERMS}
SELECT v.doc, coalesce(a, '') = '' OR coalesce(b, '') = '' OR (a <> b AND score < {rt.SAME}) AS changed FROM v JOIN sc USING (doc)""")
def str_33(spark, d):
    """A third of the documents stays as it is, a third gets another first word, a third becomes another text."""
    docs = asked(spark, d)
    b = F.when(F.col("doc") % 3 == 0, F.col("text")).when(F.col("doc") % 3 == 1, F.regexp_replace("text", r"^\S+", "Other")).otherwise(F.col("query"))
    return rt.content_changed(docs.select("doc", F.col("text").alias("a"), b.alias("b")))
