"""Quality rules by robust multivariate outliers, with DataFrame functions only.

Every text gives a vector of transformed statistics. For each language and source a minimum-
covariance-determinant (MCD) estimate of centre and scatter is found by concentration steps: order
rows by Mahalanobis distance, keep the closest fraction H, estimate again. The start is the
coordinate-wise median with interquartile scales, so no random subsets are needed. A document whose
squared distance exceeds CUTOFF is rejected.

Every estimate is a sum per cell of counts, values and products, and the order statistic is read
from a histogram of log-distances; both combine on the map side, so a source with a third of all
rows costs no more than any other. Languages and sources with under MIN_CELL usable rows are
judged by all usable rows of their language, or by all rows where these are under MIN_CELL too; with
under MIN_FIT rows in all there is no estimate and only the base rules speak. There are STEPS
concentration steps from one start, without a test of convergence. Scatter gets a floor per statistic, for statistics that are constant in most texts.

Defined results: null and empty texts have no words and fail the base rules; null lang and source
are languages and sources of their own; an empty table gives an empty result; repeated rows are
judged alike; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.llm.common import SPACES, materialize, native_words, read_table, small_enough, text_or_empty

SYMBOLS = "#*$%&|<>"
WINDOW = 5
H = 0.75
STEPS = 3
MIN_CELL, MIN_FIT = 200, 30
CUTOFF = 30.0
BINS_PER_UNIT = 64
#: Largest number of cells that is broadcast; more are joined by shuffle.
MAX_BROADCAST_CELLS = 20_000
#: Statistic and floor of its standard deviation.
FLOORS = {"x_length": 0.25, "x_symbols": 0.35, "x_upper": 0.35, "x_marks": 0.25, "x_repeat": 0.4}


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series."""
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(a * math.log(x) - x - math.lgamma(a))


def consistency(p: int, h: float) -> float:
    """Factor that makes the scatter of the closest fraction h consistent for normal data in p dimensions."""
    low, high = 0.0, 10.0 * p + 10
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_p(p / 2, mid / 2) < h else (low, mid)
    return h / _gamma_p(p / 2 + 1, low / 2)


def _without(text: Column, chars: str) -> Column:
    return F.translate(text, chars, "")


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, extra columns, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper, n_marks."""
    t = docs.select(F.col(id_col).alias("doc_id"), *extra, text_or_empty(text_col).alias("_text"))
    solid = F.filter(F.split("_text", "\n"), lambda line: _without(line, SPACES) != "")
    a = t.select(
        "doc_id",
        *extra,
        F.transform(native_words(F.col("_text")), lambda w: F.xxhash64(w)).alias("_w"),
        F.char_length(_without(F.col("_text"), SPACES)).cast("long").alias("word_chars"),
        (F.char_length("_text") - F.char_length(_without(F.col("_text"), SYMBOLS))).cast("long").alias("n_symbols"),
        solid.alias("_lines"),
        (F.octet_length("_text") - F.octet_length(F.regexp_replace("_text", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
        (F.char_length("_text") - F.char_length(_without(F.col("_text"), ".,;:!?\"'()[]{}-_/\\+=@~^`"))).cast("long").alias("n_marks"),
    )
    kept = [*extra, "word_chars", "n_symbols", "n_upper", "n_marks"]
    b = a.select(
        "doc_id",
        *kept,
        F.size("_w").cast("long").alias("n_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(
            F.size("_w") >= WINDOW,
            F.sort_array(F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.struct(F.xxhash64(*[F.get("_w", i + k) for k in range(WINDOW)]).alias("h"), i.alias("i")))),
        ).alias("_s"),
    )
    kept += ["n_words", "n_lines", "n_dup_lines"]
    same = lambda x, k: F.coalesce(F.get("_s", k)["h"] == x["h"], F.lit(False))
    c = b.select("doc_id", *kept, F.sort_array(F.transform(F.filter("_s", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])).alias("_p"))
    covered = F.aggregate(F.transform("_p", lambda x, i: F.least(F.lit(WINDOW), x - F.coalesce(F.get("_p", i - 1), F.lit(-WINDOW)))), F.lit(0).cast("long"), lambda s, x: s + x)
    # the gaps count words up to each window's start; the last window adds the rest of its own length
    return c.select("doc_id", *kept, F.when(F.size("_p") > 0, covered - F.least(F.lit(WINDOW), F.get("_p", F.lit(0)) + WINDOW) + WINDOW).otherwise(0).cast("long").alias("n_repeat_words"))


def _vector() -> dict[str, Column]:
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "x_length": F.log(chars / words),
        "x_symbols": F.log1p(20.0 * F.col("n_symbols") / words),
        "x_upper": F.log1p(20.0 * F.col("n_upper") / chars),
        "x_marks": F.log1p(20.0 * F.col("n_marks") / chars),
        "x_repeat": F.log1p(5.0 * (F.col("n_repeat_words") / words + F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))),
    }


def _distance(df: DataFrame) -> DataFrame:
    """Adds d2 from the columns x_*, m_* (centre) and l_* (Cholesky factor), by forward substitution."""
    names = list(FLOORS)
    for i, x in enumerate(names):
        rest = F.col(x) - F.col(f"m_{i}")
        for j in range(i):
            rest = rest - F.col(f"l_{i}_{j}") * F.col(f"y_{j}")
        df = df.withColumn(f"y_{i}", rest / F.col(f"l_{i}_{i}"))
    total = sum((F.col(f"y_{i}") * F.col(f"y_{i}") for i in range(1, len(names))), F.col("y_0") * F.col("y_0"))
    return df.withColumn("d2", total)


def _bin() -> Column:
    return F.floor(F.log(F.col("d2") + 1e-6) * BINS_PER_UNIT).cast("int")


def _cholesky(moments: DataFrame, factor: float) -> DataFrame:
    """cell, m_i and l_i_j from the columns n, s_i and s_i_j."""
    names, floors = list(FLOORS), list(FLOORS.values())
    p = len(names)
    m = moments.select("cell", *[(F.col(f"s_{i}") / F.col("n")).alias(f"m_{i}") for i in range(p)], *[(F.col(f"s_{i}_{j}") / F.col("n")).alias(f"e_{i}_{j}") for i in range(p) for j in range(i + 1)])
    m = m.select("cell", *[f"m_{i}" for i in range(p)], *[(factor * (F.col(f"e_{i}_{j}") - F.col(f"m_{i}") * F.col(f"m_{j}")) + (floors[i] ** 2 if i == j else 0.0)).alias(f"c_{i}_{j}") for i in range(p) for j in range(i + 1)])
    for j in range(p):
        diag = F.col(f"c_{j}_{j}")
        for k in range(j):
            diag = diag - F.col(f"l_{j}_{k}") * F.col(f"l_{j}_{k}")
        m = m.withColumn(f"l_{j}_{j}", F.sqrt(F.greatest(diag, F.lit(floors[j] ** 2))))
        for i in range(j + 1, p):
            low = F.col(f"c_{i}_{j}")
            for k in range(j):
                low = low - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            m = m.withColumn(f"l_{i}_{j}", low / F.col(f"l_{j}_{j}"))
    return m.select("cell", *[f"m_{i}" for i in range(p)], *[f"l_{i}_{j}" for i in range(p) for j in range(i + 1)])


def mcd_fit(rows: DataFrame, steps: int = STEPS, h: float = H) -> DataFrame:
    """Centre and Cholesky factor of the MCD scatter for each cell: rows has cell and the statistics of FLOORS."""
    names, p = list(FLOORS), len(FLOORS)
    few = None

    def meet(params: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(params) if few else params, "cell")

    quartiles = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *[F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), 1000).alias(f"q_{i}") for i, x in enumerate(names)]).where(f"n >= {MIN_FIT}")
    start = quartiles.select(
        "cell",
        *[F.get(f"q_{i}", F.lit(1)).alias(f"m_{i}") for i in range(p)],
        *[(F.greatest((F.get(f"q_{i}", F.lit(2)) - F.get(f"q_{i}", F.lit(0))) / 1.349, F.lit(list(FLOORS.values())[i])) if i == j else F.lit(0.0)).alias(f"l_{i}_{j}") for i in range(p) for j in range(i + 1)],
    )
    params = materialize(start, "mcd-start")
    few = small_enough(params, MAX_BROADCAST_CELLS)
    factor = consistency(p, h)
    for step in range(steps):
        far = _distance(meet(params)).withColumn("bin", _bin())
        counts = far.groupBy("cell", "bin").agg(F.count(F.lit(1)).alias("n"))
        ranked = counts.select("cell", "bin", F.expr("sum(n) OVER (PARTITION BY cell ORDER BY bin)").alias("upto"), F.expr("sum(n) OVER (PARTITION BY cell)").alias("all"))
        most = ranked.where(F.col("upto") >= h * F.col("all")).groupBy("cell").agg(F.min("bin").alias("most"))
        near = _distance(meet(materialize(params.join(most, "cell"), f"mcd-edge{step}"))).where(_bin() <= F.col("most"))
        sums = near.groupBy("cell").agg(
            F.count(F.lit(1)).alias("n"), *[F.sum(x).alias(f"s_{i}") for i, x in enumerate(names)], *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s_{i}_{j}") for i in range(p) for j in range(i + 1)]
        )
        params = materialize(_cholesky(sums, factor), f"mcd-step{step}")
    return params


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cutoff: float = CUTOFF, whole_rows: bool = False) -> DataFrame:
    """doc_id, n_words, the base statistics, base_failed, distance2 (null where there is no estimate), kept.

    whole_rows: the rows of docs that are kept instead, with all their columns; they travel beside the statistics, so no join fetches them.
    """
    row = F.struct(*[F.col(c) for c in docs.columns]) if whole_rows else F.lit(0)
    named = docs.select(id_col, text_col, F.coalesce(F.col(lang_col), F.lit("")).alias("_lang"), F.coalesce(F.col(source_col), F.lit("")).alias("_source"), row.alias("_row"))
    stats = text_statistics(named, id_col, text_col, extra=("_lang", "_source", "_row"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    stats = materialize(stats.withColumn("base_failed", failed).withColumns(_vector()), "text-stats")

    usable = stats.where(~F.col("base_failed"))
    groups = usable.groupBy("_lang", "_source").agg(F.count(F.lit(1)).alias("n"))
    own, lang = F.to_json(F.struct("_lang", "_source")), F.to_json(F.struct("_lang"))
    in_lang = F.expr("sum(n) OVER (PARTITION BY _lang)")
    judge = materialize(groups.select("_lang", "_source", F.when(F.col("n") >= MIN_CELL, own).when(in_lang >= MIN_CELL, lang).otherwise("{}").alias("cell")), "judging-cells")
    # a row is in the estimate of its own cell, and in the wider ones that judge any small group
    by_lang = F.max(F.col("cell") == lang).over(Window.partitionBy("_lang"))
    by_all = judge.agg(F.coalesce(F.bool_or(F.col("cell") == "{}"), F.lit(False)).alias("by_all"))
    fits = F.array_distinct(F.array_compact(F.array("cell", F.when(F.col("by_lang"), lang), F.when(F.col("by_all"), F.lit("{}")))))
    cells = materialize(judge.withColumn("by_lang", by_lang).crossJoin(F.broadcast(by_all)).select("_lang", "_source", "cell", fits.alias("fits")), "cells")  # by_all is one row
    few = small_enough(cells, MAX_BROADCAST_CELLS)
    celled = stats.join(F.broadcast(cells) if few else cells, ["_lang", "_source"], "left")
    params = mcd_fit(celled.where(~F.col("base_failed")).select(F.explode("fits").alias("cell"), *FLOORS))
    judged = _distance(celled.join(F.broadcast(params) if few else params, "cell", "left"))
    kept = ~F.col("base_failed") & ~F.coalesce(F.col("d2") > cutoff, F.lit(False))
    if whole_rows:
        return judged.where(kept).select("_row.*")
    return judged.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        F.when(~F.col("base_failed"), F.col("d2")).alias("distance2"),
        kept.alias("kept"),
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(read_table(spark, sf_dir, "documents"))
