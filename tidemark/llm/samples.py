"""Bounded, repeatable samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import small_enough

#: Labels that a classifier may tell apart; more are refused, for the model has weights for each.
MAX_LABELS = 10_000
_DRAWS = 1 << 53


def _counts(known: DataFrame) -> dict:
    rows = known.groupBy("label").count().orderBy("label").limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} different labels")
    return {r["label"]: r["count"] for r in rows}


def _drawn(counts: dict, per_class: int) -> Column:
    """Whether a hash of doc_id falls below the share of its label that gives about per_class rows."""
    shares = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_class / n))])
    return F.pmod(F.xxhash64("doc_id"), F.lit(_DRAWS)) < F.try_element_at(shares, F.col("label")) * _DRAWS


def labelled_sample(docs: DataFrame, labels: DataFrame, label_col: str, usable: Column, per_class: int) -> tuple[DataFrame, dict]:
    """(doc_id, text, label) with about per_class rows of each label, and the count of each label.

    Rows are drawn by a hash of the id below the share that gives the bound, so the sample repeats and
    no sort or window sees all rows. The drawn ids, a few times per_class, are broadcast once counted.
    Null labels and ids are left out; a document labelled twice takes its largest label.
    """
    known = labels.select("doc_id", F.col(label_col).alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL").groupBy("doc_id").agg(F.max("label").alias("label")).where(usable)
    counts = _counts(known)
    if not counts:
        return docs.select("doc_id", "text", F.lit(None).cast("int").alias("label")).limit(0), counts
    drawn = known.where(_drawn(counts, per_class))
    few = small_enough(drawn, 2 * per_class * len(counts) + 1000)
    return docs.select("doc_id", "text").join(F.broadcast(drawn) if few else drawn, "doc_id"), counts


def labelled_rows(docs: DataFrame, label_col: str, usable: Column, per_class: int) -> tuple[DataFrame, dict]:
    """As labelled_sample, for labels that lie in the rows of docs themselves: a filter, without a join. Repeated rows count as often."""
    known = docs.select("doc_id", "text", F.col(label_col).alias("label")).where("doc_id IS NOT NULL AND label IS NOT NULL").where(usable)
    counts = _counts(known)
    return (known.where(_drawn(counts, per_class)) if counts else known.limit(0)), counts
