"""Wave statistics from states of chunks, and fingerprints of exports.

Line items are wave samples: supplier and line number are the cell, quantity the height, price the period,
discount the direction; each return flag is a chunk of its own. Documents are exported by language.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from tidemark.operators import histograms as hg
from tidemark.plans.catalog import register
from tidemark.sources import snapshots
from tidemark.sources.tables import table

_KEYS = ["i", "j"]


def samples(spark, d, *more):
    """Chunk and cell of each sample; returned items of few pieces have no height."""
    li = table(spark, d, "lineitem")
    hs = F.when((F.col("l_returnflag") == "R") & (F.col("l_quantity") < 5), None).otherwise(F.col("l_quantity") / 4)
    return li.select((F.col("l_suppkey") % 10).alias("i"), F.col("l_linenumber").alias("j"), hs.alias("hs"), (F.col("l_extendedprice") / 5000).alias("period"), (F.col("l_discount") * 3000).alias("direction"), F.col("l_returnflag").alias("chunk"), *more)


def _sql_percentile(bins: str, q: float, width: float) -> str:
    return f"""(SELECT i, j, arg_min((bin + greatest(0, least(1, ({q} * total - (upto - n)) / n))) * {width}, bin) AS v FROM (
      SELECT i, j, bin, n, sum(n) OVER (PARTITION BY i, j ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY i, j) AS total FROM (SELECT i, j, {bins} AS bin, count(*) AS n FROM s GROUP BY 1, 2, 3)) WHERE upto >= {q} * total GROUP BY i, j)"""


_HEIGHTS, _PERIODS = (f"least(greatest(floor({c} / {w}::DOUBLE), 0), {n - 1})" for c, w, n in (("hs", hg.HEIGHT_BIN, hg.HEIGHT_BINS), ("period", hg.PERIOD_BIN, hg.PERIOD_BINS)))


@register("agg_46_wave_state", f"""
WITH s AS (SELECT l_suppkey % 10 AS i, l_linenumber AS j, l_quantity / 4 AS hs, l_extendedprice / 5000 AS period, l_discount * 3000 AS direction FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_quantity < 5))
SELECT i, j, count(*) AS n, count(*) >= {hg.MIN_SAMPLES} AS sea, CASE WHEN count(*) >= {hg.MIN_SAMPLES} THEN round(any_value(a.v), 6) END AS hs_p50, CASE WHEN count(*) >= {hg.MIN_SAMPLES} THEN round(greatest(any_value(a.v), any_value(b.v)), 6) END AS hs_p90,
  CASE WHEN count(*) >= {hg.MIN_SAMPLES} THEN round(any_value(c.v), 6) END AS period, CASE WHEN count(*) >= {hg.MIN_SAMPLES} THEN round((degrees(atan2(sum(sin(radians(direction))), sum(cos(radians(direction))))) + 360) % 360, 3) END AS direction
FROM s LEFT JOIN {_sql_percentile(_HEIGHTS, 0.5, hg.HEIGHT_BIN)} a USING (i, j) LEFT JOIN {_sql_percentile(_HEIGHTS, 0.9, hg.HEIGHT_BIN)} b USING (i, j) LEFT JOIN {_sql_percentile(_PERIODS, 0.5, hg.PERIOD_BIN)} c USING (i, j) GROUP BY i, j""")
def agg_46(spark, d):
    """Three chunks become three states, which add up to what one pass over all samples gives."""
    s = samples(spark, d)
    states = [hg.wave_state(s.where(F.col("chunk") == c), _KEYS) for c in ("A", "N", "R")] + [hg.wave_state(s.where("chunk NOT IN ('A', 'N', 'R')"), _KEYS)]
    found = hg.wave_statistics(hg.merged(reduce(lambda a, b: a.unionByName(b), states), _KEYS), _KEYS)
    return found.select("i", "j", "n", "sea", *[F.round(c, 6).alias(c) for c in ("hs_p50", "hs_p90", "period")], F.round("direction", 3).alias("direction"))


_JSON = "to_json({'doc_id': doc_id, 'lang': lang, 'n_chars': n_chars, 'text_sha256': sha256(text)})"
_PARTS = ", ".join(f"coalesce(sum(('0x' || substr(h, {8 * k + 1}, 8))::BIGINT), 0)::HUGEINT::VARCHAR" for k in range(8))
_MARKS = f"SELECT lang, count(*) AS n, substr(sha256(concat_ws(':', count(*)::VARCHAR, {_PARTS})), 1, 12) AS mark FROM (SELECT lang, sha256({_JSON}) AS h FROM documents) GROUP BY lang"


def _marks(spark, d):
    docs = table(spark, d, "documents").withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    return snapshots.fingerprint(docs, ["lang"], ["doc_id", "lang", "n_chars", "text_sha256"])


@register("snk_17_fingerprint", f"SELECT lang, n AS count, mark AS fingerprint FROM ({_MARKS})")
def snk_17(spark, d):
    return _marks(spark, d)


@register("snk_18_export_version", f"SELECT coalesce(lang, 'none') AS dataset, n AS count, mark AS content_sha256, '2026-01-01.' || mark AS version FROM ({_MARKS})")
def snk_18(spark, d):
    return _marks(spark, d).select(F.coalesce("lang", F.lit("none")).alias("dataset"), "count", F.col("fingerprint").alias("content_sha256"), snapshots.version(F.lit("2026-01-01"), F.col("fingerprint")).alias("version"))
