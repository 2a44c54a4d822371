"""Resampling documents towards a target distribution by hashed word n-grams.

Position table: every document's words are exploded with their positions, and a window over each
document's positions puts the following words beside each word with lead(). Words joined by a space
for each order are hashed to buckets. Grouping counts the buckets of the corpus (s, S) and of the
target (t, T); a bucket's gain floor(1000 * ln((t+1) * (S+B) / ((s+1) * (T+B)))) is joined back to each
position, and a document's weight is the floored mean of its features' gains. Weights plus Gumbel noise,
made from the id, order the documents that are long enough; the best share of them is drawn.

Scale: texts move once, to be dealt out by row, and words are numbered where they then lie, so the window
needs no further exchange. The buckets of all positions are written (one short number per order) since
counting and weighing read them; both combine before they shuffle. The gains are broadcast: as many
rows as buckets, a parameter. Ranks come from ranges with offsets, not from one task.

Defined results: a null text, or one without words, has no features, weight 0; rows are documents, so
repeated rows and repeated or null ids each keep their own row (a null id is drawn as the text `null`);
ties of the score go to the smaller id (null first); a text of one word has no pair; very long texts are
read whole, their positions are sorted with spilling; an empty corpus gives an empty result, an empty
target leaves gains of T = 0; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, ranked, read_table, text_or_empty

WORD_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORDERS, BUCKETS, MIN_WORDS, PERCENT, SEED = 2, 10_000, 20, 25, 7


def _bucket(feature: Column, buckets: int) -> Column:
    return (F.crc32(feature.cast("binary")) % buckets).cast("int")


def positions(docs: DataFrame, orders: int, buckets: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word, or one with nulls for a text without any: row, doc_id, b1, ..., b<orders>.

    b<k> is the bucket of the k words from here on, null where fewer follow.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).repartition("row")
    words = F.filter(F.split(F.translate("text", UPPER, LOWER), WORD_GAPS), lambda w: w != "")
    table = rows.select("row", "doc_id", F.posexplode_outer(words).alias("pos", "word"))
    w = Window.partitionBy("row").orderBy("pos")
    table = table.select("row", "doc_id", "word", *[F.lead("word", k).over(w).alias(f"next{k}") for k in range(1, orders)])
    feature, out = F.col("word"), []
    for k in range(1, orders + 1):
        out.append(_bucket(feature, buckets).alias(f"b{k}"))
        feature = F.concat(feature, F.lit(" "), F.col(f"next{k}")) if k < orders else feature
    return table.select("row", "doc_id", *out)


def bucket_counts(table: DataFrame, orders: int) -> DataFrame:
    """(bucket, n) over all features of a position table."""
    parts = [table.groupBy(F.col(f"b{k}").alias("bucket")).agg(F.count(F.lit(1)).alias("n")) for k in range(1, orders + 1)]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return every.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket, from (bucket, n) of both sides."""
    both = corpus.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    for side, counts in (("s", corpus), ("t", target)):
        both = both.join(counts.select("bucket", F.col("n").alias(side)), "bucket", "left")
    both = materialize(both.fillna(0, ["s", "t"]), "bucket-counts")
    all_s, all_t = both.agg(F.sum("s"), F.sum("t")).first()
    d = lambda c: F.col(c).cast("double")
    ratio = (d("t") + 1) * float(all_s + buckets) / ((d("s") + 1) * float(all_t + buckets))
    return both.select("bucket", F.floor(1000 * F.ln(ratio)).cast("long").alias("gain"))


def document_weights(table: DataFrame, gains: DataFrame, orders: int) -> DataFrame:
    """row, doc_id, n_words, n_features, weight of each document of a position table."""
    found = table
    for k in range(1, orders + 1):
        found = found.join(F.broadcast(gains.select(F.col("bucket").alias(f"b{k}"), F.col("gain").alias(f"g{k}"))), f"b{k}", "left")
    total, n = F.lit(0), F.lit(0)
    for k in range(1, orders + 1):
        total, n = total + F.coalesce(f"g{k}", F.lit(0)), n + F.col(f"b{k}").isNotNull().cast("int")
    found = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.count("b1").alias("n_words"), F.sum(n).alias("n_features"), F.sum(total).alias("total"))
    floored = F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(0)
    return found.select("row", "doc_id", "n_words", "n_features", floored.cast("long").alias("weight"))


def gumbel(id_col: str, seed: int) -> Column:
    """floor(1000 * Gumbel noise) of an id, from the first 32 bits of sha256("<seed>:<id>")."""
    shown = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(shown, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0))).cast("long")


def importance_resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
    orders: int = ORDERS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """One row per document: row, doc_id, n_words, n_features, weight, score, rank (null where not drawn)."""
    table = materialize(positions(docs, orders, buckets, id_col, text_col), "positions")
    aims = positions(target.select(F.lit(0).alias("_id"), F.col(target_text).alias("_text")), orders, buckets, "_id", "_text")
    gains = bucket_gains(bucket_counts(table, orders), bucket_counts(aims, orders), buckets)
    weights = materialize(document_weights(table, gains, orders).withColumn("score", F.col("weight") + gumbel("doc_id", seed)), "weights")
    able = weights.where(F.col("n_words") >= min_words)
    drawn = percent * able.count() // 100
    ranks = ranked(able.select("row", "score", "doc_id"), [F.desc("score"), F.asc("doc_id"), F.asc("row")], "resampled").where(F.col("rank") <= drawn)
    return weights.join(ranks.select("row", F.col("rank").cast("long").alias("rank")), "row", "left")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance_resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


#: crc32 of the UTF-8 bytes of a text, bit by bit from its polynomial.
CRC_MACROS = """
crc_table AS (
  SELECT list(list_reduce([n::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t FROM range(256) x(n)),
"""


def crc_of(text: str) -> str:
    """SQL of the crc32 of a text; crc_table must be in scope as c."""
    codes = f"list_transform(range(strlen({text})), lambda i: ('0x' || substr(hex(encode({text})), (2 * i + 1)::BIGINT, 2))::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda a, b: xor(c.t[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)"


ORACLE = f"""
WITH {CRC_MACROS}
d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_GAPS}'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD_GAPS}'), lambda w: w <> '') AS w FROM benchmark),
df AS (SELECT r, unnest(list_concat(w, list_transform(range(len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2]))) AS f FROM d),
bf AS (SELECT unnest(list_concat(w, list_transform(range(len(w) - 1), lambda i: w[i + 1] || ' ' || w[i + 2]))) AS f FROM b),
k AS (SELECT f, {crc_of('f')} % {BUCKETS} AS bucket FROM (SELECT DISTINCT f FROM (SELECT f FROM df UNION ALL SELECT f FROM bf)) CROSS JOIN crc_table c),
s AS (SELECT bucket, count(*) AS s FROM df JOIN k USING (f) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bf JOIN k USING (f) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + {BUCKETS}) / ((s::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + {BUCKETS}))))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket)),
w AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS total FROM df JOIN k USING (f) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT d.r, d.doc_id, len(d.w) AS words, coalesce(n, 0)::BIGINT AS n_features, CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END::BIGINT AS weight FROM d LEFT JOIN w ON d.r = w.r),
y AS (SELECT *, (weight + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296))))::BIGINT AS score FROM x),
z AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank FROM y WHERE words >= {MIN_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= {PERCENT} * (SELECT count(*) FROM z) // 100 THEN rank END AS rank FROM y LEFT JOIN z ON y.r = z.r
"""
