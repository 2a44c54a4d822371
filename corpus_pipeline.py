"""Corpus pipeline: toxicity, quality rules, exact dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before it kept, and returns
them with the columns of documents; the last one returns pieces of packed sequences. The first two
stages judge each row where it lies. The others find the rows to drop by id and text together, so rows
that share an id but not the text are judged apart.

Defined results: rows with a null id are judged like others, but are linked with no near copy; null
and empty texts fail the quality rules, as do texts of under 10 words; rows that repeat an id and its text are one document; very long texts are
judged whole; without labels nothing is toxic; an empty table gives an empty result; extra columns
pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, read_table, text_or_empty
from tidemark.llm.exact_dedup import exact_dedup
from tidemark.llm.key_filter import key_filter, may_be_in
from tidemark.llm.minhash import near_duplicates
from tidemark.llm.packing import pack_documents
from tidemark.llm.quality_rules import quality_rules
from tidemark.llm.toxicity import train, without_toxic

#: Words per shingle and percent of similarity of near duplicates.
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80


def _without(docs: DataFrame, dropped: DataFrame, text_key: Column) -> DataFrame:
    """Documents but those in dropped(doc_id, key), which names rows by id (null included) and text.

    Only documents that a filter of fixed size cannot rule out meet dropped in a join; the others do not move.
    """
    gone = materialize(dropped.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")).distinct(), "dropped")
    named = may_be_in(key_filter(gone.select(F.xxhash64("_id", "_key"))), F.xxhash64(F.col("doc_id"), text_key))
    met = docs.where(named).join(gone.hint("merge"), F.col("doc_id").eqNullSafe(F.col("_id")) & (text_key == F.col("_key")), "left_anti")
    return docs.where(~named).unionByName(met)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the sentence model does not reject. It learns from all labels of the documents at hand."""
    return without_toxic(docs, train(docs, read_table(spark, sf_dir, "labels"), F.lit(True)))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers."""
    return quality_rules(docs, whole_rows=True)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    dropped = exact_dedup(docs).where("NOT kept").select("doc_id", F.col("text_sha256").alias("key"))
    return _without(docs, dropped, F.sha2(text_or_empty().cast("binary"), 256))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    dropped = near_duplicates(docs, n=SHINGLE_WORDS, percent=SIMILARITY_PERCENT, with_hash=True).where("NOT kept").select("doc_id", F.col("text_hash").alias("key"))
    return _without(docs, dropped, F.xxhash64("text"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences."""
    return pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_low_quality), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("packing", pack)]

#: The model of the first stage is not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage{k}")
    return docs
