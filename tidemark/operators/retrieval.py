"""Chunks of texts, and how near they are to a query by TF-IDF.

Each text is a collection of its own: its chunks and its query make the document frequencies. So a text is
scored where it lies, as one row with its chunks in an array: no word travels. Words are found by Spark, counting
them is a per-row helper in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType, StringType

#: Characters of a chunk and of its overlap, chunks kept, weight of list-like chunks, sameness of two versions.
SIZE, OVERLAP, TOP, LIST_WEIGHT, SAME = 500, 60, 8, 1.4, 0.95
TOKEN = r"[\p{L}\p{N}_]{2,}"


def chunks(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Pieces of about size characters with single spaces, cut after a sentence or a word in their second half.

    Each starts overlap characters before the last one's end; the piece that reaches the text's end is the
    last. A null or blank text has none.
    """
    if size < 2 or overlap < 0:
        raise ValueError("size must be 2 or more, overlap 0 or more")

    @pandas_udf(ArrayType(StringType()))
    def cut(texts):
        import re

        import pandas as pd

        def pieces(t: str) -> list[str]:
            t = re.sub(r"\s+", " ", t or "").strip()
            out, start = [], 0
            while start < len(t):
                end = min(start + size, len(t))
                if end < len(t):
                    at = next((p for p in (t.rfind(mark, start + size // 2, end) for mark in (". ", " ")) if p > start), -1)
                    end = at + 1 if at > start else end
                out.append(t[start:end].strip())
                if end == len(t):
                    break
                start = max(end - overlap, start + 1)
            return [p for p in out if p]

        return pd.Series([pieces(t) for t in texts], dtype=object)

    return cut(text)


def _words(text: Column) -> Column:
    """Words of two characters or more in lower case, with single spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN})")), " ")


def scores(pieces: Column, query: Column) -> Column:
    """Cosines of a text's pieces (an array) with its query, by words and pairs of neighbouring words.

    idf is ln((1 + n) / (1 + df)) + 1 over the n pieces and the query. Pieces or queries without a term score
    0, as do pieces without a query.
    """

    @pandas_udf(ArrayType(DoubleType()))
    def cosines(texts, queries):
        from collections import Counter
        from math import fsum, log, sqrt

        import pandas as pd

        def counted(t: str) -> Counter:
            w = t.split()
            found = Counter(w)
            found.update(zip(w, w[1:]))
            return found

        def row(each, q: str) -> list[float]:
            asked = counted(q)
            if not asked:
                return [0.0] * len(each)
            held = [counted(t) for t in each]
            df = Counter(asked.keys())
            for tf in held:
                df.update(tf.keys())
            by_df = [log((2 + len(held)) / (1 + c)) + 1 if c else 0.0 for c in range(len(held) + 2)]
            q_weight = {t: k * by_df[df[t]] for t, k in asked.items()}
            q_norm = sqrt(fsum(w * w for w in q_weight.values()))
            out = []
            for tf in held:
                norm = sqrt(fsum((k * by_df[df[t]]) ** 2 for t, k in tf.items()))
                dot = fsum(tf[t] * by_df[df[t]] * w for t, w in q_weight.items() if t in tf)
                out.append(dot / (norm * q_norm) if norm else 0.0)
            return out

        return pd.Series([None if each is None else row(each, q) for each, q in zip(texts, queries)], dtype=object)

    return cosines(F.transform(pieces, _words), _words(query))


def chunk_scores(pieces: DataFrame, queries: DataFrame) -> DataFrame:
    """(doc, pos, score) of pieces (doc, pos, text) and their texts' queries (doc, text), see scores."""
    held = pieces.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "text"))).alias("p"))
    asked = queries.select(F.col("doc"), F.col("text").alias("q"))
    each = held.join(asked, "doc", "left").select("doc", "p.pos", scores(F.col("p.text"), F.col("q")).alias("score"))
    return each.select("doc", F.explode(F.arrays_zip("pos", "score")).alias("z")).select("doc", "z.pos", "z.score")


def best_first(pieces: Column, score: Column, k: int = TOP) -> Column:
    """The k best of a text's pieces as an array of (pos, text), ties to the earlier."""
    order = F.sort_array(F.transform(score, lambda s, at: F.struct(F.round(s, 12).alias("s"), (-at).alias("at"))), asc=False)
    return F.transform(F.slice(order, 1, k), lambda x: F.struct((-x["at"]).cast("long").alias("pos"), F.get(pieces, -x["at"]).alias("text")))


def top_chunks(pieces: DataFrame, scores: DataFrame, k: int = TOP) -> DataFrame:
    """The k best pieces of each text (ties to the earlier), with rank; pos keeps their order in the text."""
    best = Window.partitionBy("doc").orderBy(F.desc(F.round("score", 12)), "pos")
    return pieces.join(scores, ["doc", "pos"]).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _empty() -> Column:
    return (F.coalesce("a", F.lit("")) == "") | (F.coalesce("b", F.lit("")) == "")


def _similarity() -> Column:
    other = ~_empty() & (F.col("a") != F.col("b"))
    score = F.get(scores(F.when(other, F.array("b")), F.when(other, F.col("a"))), F.lit(0))
    return F.when(_empty(), 0.0).when(F.col("a") == F.col("b"), 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def pair_similarity(pairs: DataFrame) -> DataFrame:
    """(doc, similarity) of pairs (doc, a, b) of texts: 1 if equal, 0 if one is empty."""
    return pairs.select("doc", _similarity().alias("similarity"))


def content_changed(pairs: DataFrame, same: float = SAME) -> DataFrame:
    """(doc, changed): whether two versions (a, b) differ by more than a touch; a missing version counts as changed."""
    found = pairs.select("doc", _empty().alias("empty"), _similarity().alias("similarity"))
    return found.select("doc", (F.col("empty") | (F.col("similarity") < same)).alias("changed"))
