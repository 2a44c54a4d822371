"""Exact deduplication by skew-safe combining.

Digests are counted first. A text whose digest occurs once equals no other and does not move; a filter of
fixed size finds the others, and a few more that do no harm. These meet in three steps:

1. Local: each map task keeps one row per (digest, salt, text) of its own rows (partial aggregation).
2. Salted: rows meet by (digest, salt, text); a hot text is spread over `n_salts` groups.
3. Global: the at most `n_salts` salt winners of a digest meet and the largest id of equal texts wins.

Grouping keys hold the whole text at every stage, so two texts are equal only if all their bytes are;
the digest only decides where rows meet. Decisions go back to the documents by (digest, salt), so no
hot key exists on the way back either. Digests shared by different texts are resolved by text.

Defined results: null text counts as empty, and empty texts equal each other; null ids lose to any
id; rows that repeat the winning id are the same document and are all marked kept; an empty table
gives an empty result; columns other than the id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, read_table, text_or_empty
from tidemark.llm.key_filter import key_filter, may_be_in

N_SALTS = 32


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_salts: int = N_SALTS,
    digest: Callable[[Column], Column] = _sha256,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    if not 1 <= n_salts <= 62:
        raise ValueError("n_salts must lie between 1 and 62")
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    base = base.select("doc_id", "text", digest(F.col("text")).alias("digest"), F.pmod(F.xxhash64("doc_id"), F.lit(n_salts)).cast("int").alias("salt"))

    repeated = materialize(base.groupBy(F.xxhash64("digest").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "exact-repeated")
    maybe = may_be_in(key_filter(repeated), F.xxhash64("digest"))
    alone, base = base.where(~maybe), base.where(maybe)
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), _sha256(F.col("text")).alias("text_sha256"))

    winners = base.groupBy("digest", "salt", "text").agg(F.max("doc_id").alias("best"), F.count(F.lit(1)).alias("n"))
    met = (
        winners.repartition("digest")
        .groupBy("digest", "text")
        .agg(F.max("best").alias("keep_id"), F.sum("n").alias("group_size"), F.expr("bit_or(shiftleft(1L, salt))").alias("salts"))
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("contents"), F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.expr("bit_or(salts)").alias("salts"))
    )
    met = materialize(met, "exact-winners")
    by_salt = met.where("contents = 1").select("digest", "keep_id", "group_size", F.explode(F.filter(F.sequence(F.lit(0), F.lit(n_salts - 1)), lambda k: F.getbit(F.col("salts"), k) == 1)).alias("salt"))
    members = base.select("doc_id", "digest", "salt", _sha256(F.col("text")).alias("text_sha256"))
    found = members.join(by_salt, ["digest", "salt"]).select("doc_id", "keep_id", "group_size", "text_sha256")

    clashes = met.where("contents > 1").select("digest")
    if not clashes.isEmpty():
        some = base.join(clashes, "digest", "left_semi")
        exact = some.groupBy("digest", "text", "salt").agg(F.max("doc_id").alias("best"), F.count(F.lit(1)).alias("n")).groupBy("digest", "text").agg(F.max("best").alias("keep_id"), F.sum("n").alias("group_size"))
        found = found.unionByName(some.join(exact, ["digest", "text"]).select("doc_id", "keep_id", "group_size", _sha256(F.col("text")).alias("text_sha256")))
    return found.unionByName(alone).select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


ORACLE = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""
