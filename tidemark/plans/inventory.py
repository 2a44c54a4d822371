"""Queries of the operator inventory over the synthetic tables, each with its oracle.

Roles: events is a run's event log (user_id = run), nation and region are zones, customer and supplier
are ports with coordinates made from their keys, pages are collected pages, lineitem holds grid
observations, orders are legs of tracks, part is a tag catalogue, conversations a journal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions import geo, text
from tidemark.operators import aggregates as agg
from tidemark.operators import matching as match
from tidemark.plans.catalog import register
from tidemark.sources.tables import table

LAT, LON = "((({k}*7919) % 18000)/100.0-90.0)", "((({k}*104729) % 36000)/100.0-180.0)"
_HALF = "pow(sin(radians({b}-({a}))/2),2)+cos(radians({a}))*cos(radians({b}))*pow(sin(radians({d}-({c}))/2),2)"
HAV = f"(2*{{r}}*asin(sqrt(CASE WHEN {_HALF} > 1 THEN 1.0 ELSE {_HALF} END)))"  # least() would turn null into half the globe


def _hav(a: str, c: str, b: str, d: str, r: float = geo.EARTH_KM) -> str:
    """Oracle distance of (a, c) and (b, d), each (lat, lon)."""
    return HAV.format(a=a, b=b, c=c, d=d, r=r)


def _points(df: DataFrame, key: str) -> DataFrame:
    return df.withColumns({"lat": geo.synthetic_lat(F.col(key)), "lon": geo.synthetic_lon(F.col(key))})


# ---- filters -------------------------------------------------------------------------------------


@register("flt_01_array_contains", "SELECT event_id FROM events WHERE list_contains(string_split(event_type, '_'), 'view') OR event_type = 'click'")
def flt_01(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    return e.where(F.array_contains(F.split("event_type", "_"), "view") | (F.col("event_type") == "click")).select("event_id")


@register("flt_02_default_scope", "SELECT coalesce(lang, 'projects') AS dataset, count(*) AS n FROM documents WHERE coalesce(lang, 'projects') IN ('en', 'projects') GROUP BY 1")
def flt_02(spark, d):
    x = F.coalesce("lang", F.lit("projects"))
    return table(spark, d, "documents").where(x.isin("en", "projects")).groupBy(x.alias("dataset")).agg(F.count(F.lit(1)).alias("n"))


@register("flt_03_substring", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ar')")
def flt_03(spark, d):
    return table(spark, d, "part").where(F.contains(F.lower("p_name"), F.lit("ar"))).select("p_partkey", "p_name")


@register("flt_04_visible", "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)")
def flt_04(spark, d):
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").where("quality = 1"), "doc_id", "left_semi")


@register("flt_13_bbox", f"SELECT c_custkey FROM customer WHERE {LAT.format(k='c_custkey')} BETWEEN -20 AND 30 AND {LON.format(k='c_custkey')} BETWEEN -60 AND 45")
def flt_13(spark, d):
    return _points(table(spark, d, "customer"), "c_custkey").where(F.col("lat").between(-20, 30) & F.col("lon").between(-60, 45)).select("c_custkey")


@register("flt_14_bbox_wrap", f"SELECT c_custkey FROM customer WHERE {LAT.format(k='c_custkey')} BETWEEN -20 AND 30 AND ({LON.format(k='c_custkey')} >= 170 OR {LON.format(k='c_custkey')} <= -160)")
def flt_14(spark, d):
    return _points(table(spark, d, "customer"), "c_custkey").where(F.col("lat").between(-20, 30) & ((F.col("lon") >= 170) | (F.col("lon") <= -160))).select("c_custkey")


@register("flt_18_url_reason", "SELECT page_id, CASE WHEN regexp_matches(lower(url), '\\.(png|jpg|gif)$') THEN 'image' WHEN regexp_matches(lower(url), '\\.pdf$') THEN 'pdf' WHEN contains(url, '?') THEN 'query' ELSE 'kept' END AS reason FROM pages")
def flt_18(spark, d):
    u = F.lower("url")
    reason = F.when(u.rlike(r"\.(png|jpg|gif)$"), "image").when(u.rlike(r"\.pdf$"), "pdf").when(F.contains(F.col("url"), F.lit("?")), "query").otherwise("kept")
    return table(spark, d, "pages").select("page_id", reason.alias("reason"))


@register("flt_21_host_whitelist", "SELECT page_id FROM pages WHERE list_has_any([regexp_extract(url, '\\.([a-z]+)(?:[:/?#]|$)', 1)], ['org', 'com'])")
def flt_21(spark, d):
    return table(spark, d, "pages").where(F.arrays_overlap(F.array(F.regexp_extract("url", r"\.([a-z]+)(?:[:/?#]|$)", 1)), F.array(F.lit("org"), F.lit("com")))).select("page_id")


@register("flt_28_usable_text", "SELECT doc_id FROM documents WHERE length(text) >= 200 AND NOT regexp_matches(lower(text), 'captcha|access denied')")
def flt_28(spark, d):
    return table(spark, d, "documents").where((F.length("text") >= 200) & ~F.lower("text").rlike("captcha|access denied")).select("doc_id")


@register("flt_34_stale", "SELECT o_orderkey FROM orders WHERE date_diff('day', o_orderdate::DATE, DATE '1998-12-31') > 365")
def flt_34(spark, d):
    return table(spark, d, "orders").where(F.datediff(F.lit("1998-12-31").cast("date"), F.to_date("o_orderdate")) > 365).select("o_orderkey")


@register("flt_38_present", "SELECT count(*) FILTER (text IS NOT NULL AND text <> '') AS with_text, count(*) FILTER (lang IS NULL OR lang = '') AS without_lang FROM documents")
def flt_38(spark, d):
    return table(spark, d, "documents").agg(F.count_if(F.col("text").isNotNull() & (F.col("text") != "")).alias("with_text"), F.count_if(F.col("lang").isNull() | (F.col("lang") == "")).alias("without_lang"))


@register("flt_41_month_and_strength", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE month(l_shipdate) = 9 AND l_quantity >= 34")
def flt_41(spark, d):
    return table(spark, d, "lineitem").where((F.month("l_shipdate") == 9) & (F.col("l_quantity") >= 34)).select("l_orderkey", "l_linenumber")


# ---- joins ---------------------------------------------------------------------------------------

_C = f"(SELECT c_custkey AS id, {LAT.format(k='c_custkey')} AS lat, {LON.format(k='c_custkey')} AS lon FROM customer)"
_S = f"(SELECT s_suppkey AS rid, {LAT.format(k='s_suppkey')} AS rlat, {LON.format(k='s_suppkey')} AS rlon FROM supplier)"


@register("jon_02_nearest_within", f"""
SELECT id, rid, round(km, 6) AS km FROM (
  SELECT id, rid, km, row_number() OVER (PARTITION BY id ORDER BY round(km, 9), rid) AS k
  FROM (SELECT id, rid, {_hav('lat', 'lon', 'rlat', 'rlon')} AS km FROM {_C} a CROSS JOIN {_S} b) WHERE km <= 300 + 1e-6) WHERE k = 1""")
def jon_02(spark, d):
    c = _points(table(spark, d, "customer"), "c_custkey").select(F.col("c_custkey").alias("id"), "lat", "lon")
    s = _points(table(spark, d, "supplier"), "s_suppkey").select(F.col("s_suppkey").alias("rid"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    return match.nearest_within(c, s, 300.0)


@register("jon_04_baseline_diff", f"""
WITH b AS (SELECT c_custkey AS key, c_name AS name, {LAT.format(k='c_custkey')} AS lat, {LON.format(k='c_custkey')} AS lon FROM customer WHERE c_custkey % 5 <> 0),
c AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 11 = 0 THEN c_name || ' new' ELSE c_name END AS name,
 {LAT.format(k='c_custkey')} + CASE WHEN c_custkey % 13 = 0 THEN 0.5 ELSE 0 END AS lat, {LON.format(k='c_custkey')} AS lon FROM customer WHERE c_custkey % 7 <> 0)
SELECT coalesce(b.key, c.key) AS key, CASE WHEN b.key IS NULL THEN 'added' WHEN c.key IS NULL THEN 'removed' WHEN {_hav('b.lat', 'b.lon', 'c.lat', 'c.lon')} > 1 THEN 'moved' WHEN b.name <> c.name THEN 'renamed' ELSE 'unchanged' END AS state
FROM b FULL JOIN c ON b.key = c.key""")
def jon_04(spark, d):
    p = _points(table(spark, d, "customer"), "c_custkey").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), "lat", "lon")
    later = p.where("key % 7 <> 0").withColumns({"name": F.when(F.col("key") % 11 == 0, F.concat("name", F.lit(" new"))).otherwise(F.col("name")), "lat": F.col("lat") + F.when(F.col("key") % 13 == 0, 0.5).otherwise(0.0)})
    return match.baseline_diff(p.where("key % 5 <> 0"), later)


@register("jon_exact_listing_counts", """
WITH run AS (SELECT DISTINCT c_nationkey AS zone, c_mktsegment AS name FROM customer WHERE c_acctbal > 5000), listing AS (SELECT DISTINCT c_nationkey AS zone, c_mktsegment AS name FROM customer WHERE c_custkey % 3 = 0)
SELECT coalesce(r.zone, l.zone) AS zone, count(*) FILTER (r.zone IS NOT NULL AND l.zone IS NOT NULL) AS matched, count(*) FILTER (l.zone IS NULL) AS run_only, count(*) FILTER (r.zone IS NULL) AS listing_only
FROM run r FULL JOIN listing l ON r.zone = l.zone AND r.name = l.name GROUP BY 1""")
def jon_exact_listing_counts(spark, d):
    c = table(spark, d, "customer")
    side = lambda where, flag: c.where(where).select(F.col("c_nationkey").alias("zone"), F.col("c_mktsegment").alias("name")).distinct().withColumn(flag, F.lit(True))
    met = side("c_acctbal > 5000", "r").join(side("c_custkey % 3 = 0", "l"), ["zone", "name"], "full_outer")
    return met.groupBy("zone").agg(F.count_if(F.col("r").isNotNull() & F.col("l").isNotNull()).alias("matched"), F.count_if(F.col("l").isNull()).alias("run_only"), F.count_if(F.col("r").isNull()).alias("listing_only"))


@register("jon_08_known_or_added", "SELECT p.page_id, CASE WHEN k.page_id IS NULL THEN 'added' ELSE 'known' END AS state FROM pages p LEFT JOIN (SELECT page_id FROM pages WHERE page_id % 4 <> 0) k ON p.page_id = k.page_id")
def jon_08(spark, d):
    p = table(spark, d, "pages")
    return p.select("page_id").join(p.where("page_id % 4 <> 0").select("page_id", F.lit(True).alias("old")), "page_id", "left").select("page_id", F.when(F.col("old").isNull(), "added").otherwise("known").alias("state"))


@register("jon_28_top3_places", f"""
SELECT n, id, round(nm, 4) AS nm, k FROM (SELECT n.n_nationkey AS n, c.id, nm, row_number() OVER (PARTITION BY n.n_nationkey ORDER BY round(nm, 6), c.id) AS k FROM
 (SELECT n_nationkey FROM nation) n JOIN {_C} c ON true JOIN LATERAL (SELECT {_hav(LAT.format(k='n.n_nationkey'), LON.format(k='n.n_nationkey'), 'c.lat', 'c.lon', geo.EARTH_NM)} AS nm) x ON true WHERE nm <= 600) WHERE k <= 3""")
def jon_28(spark, d):
    n = _points(table(spark, d, "nation"), "n_nationkey").select(F.col("n_nationkey").alias("n"), F.col("lat").alias("nlat"), F.col("lon").alias("nlon"))
    c = _points(table(spark, d, "customer"), "c_custkey").select(F.col("c_custkey").alias("id"), "lat", "lon")
    nm = geo.haversine_nm(F.col("nlat"), F.col("nlon"), F.col("lat"), F.col("lon"))
    met = c.join(F.broadcast(n), nm <= 600).withColumn("nm", nm)  # nation is a fixed table of 25 rows
    w = Window.partitionBy("n").orderBy(F.round("nm", 6), "id")
    return met.withColumn("k", F.row_number().over(w)).where("k <= 3").select("n", "id", F.round("nm", 4).alias("nm"), "k")


@register("jon_31_substring_lookup", "SELECT r_name, n_name FROM region JOIN nation ON contains(upper(r_name), substr(upper(n_name), 1, 2)) OR contains(upper(n_name), upper(r_name))")
def jon_31(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    a, b = F.upper("r_name"), F.upper("n_name")
    return n.join(F.broadcast(r), F.contains(a, F.substring(b, 1, 2)) | F.contains(b, a)).select("r_name", "n_name")  # region is a fixed table of 5 rows


@register("jon_best_by_suffix", """
SELECT name, arg_max(src, (ok, score)) AS src, max(score) AS best FROM (
 SELECT upper(substr(c_name, -4)) AS name, 'v1' AS src, (c_acctbal > 0)::INT AS ok, c_acctbal AS score FROM customer UNION ALL
 SELECT upper(substr(s_name, -4)), 'run', (s_acctbal > 0)::INT, s_acctbal FROM supplier) GROUP BY name""")
def jon_best_by_suffix(spark, d):
    """Best of two tables by the last four characters of a name, which many names share; JON-39 is jon_39_union_ports."""
    side = lambda t, p, src: table(spark, d, t).select(F.upper(F.substring(f"{p}_name", -4, 4)).alias("name"), F.lit(src).alias("src"), (F.col(f"{p}_acctbal") > 0).cast("int").alias("ok"), F.col(f"{p}_acctbal").alias("score"))
    return side("customer", "c", "v1").unionByName(side("supplier", "s", "run")).groupBy("name").agg(F.max_by("src", F.struct("ok", "score")).alias("src"), F.max("score").alias("best"))


@register("jon_44_similar_vectors", """
SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine
FROM embeddings a JOIN embeddings b ON a.label = b.label AND (a.vec_id < b.vec_id OR (a.vec_id > b.vec_id AND b.vec_id % 100 <> 0)) WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= 0.5 AND a.vec_id % 100 = 0""")
def jon_44(spark, d):
    """Stated query set (ids divisible by 100) against all vectors of the same label; a pair of two queries comes once."""
    v = table(spark, d, "embeddings")
    a, b = (v.select(F.col("vec_id").alias(x), "label", F.col("embedding").alias(f"e{x}")) for x in "ab")
    return a.where("a % 100 = 0").join(b, "label").where("a < b OR (a > b AND b % 100 <> 0)").withColumn("cosine", match.cosine(F.col("ea"), F.col("eb"))).where("cosine >= 0.5").select("a", "b", F.round("cosine", 5).alias("cosine"))


@register("jon_47_as_of", """
SELECT q.event_id AS id, r.value AS value FROM (SELECT event_id, user_id, ts FROM events WHERE event_id % 3 = 0) q
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_id % 3 <> 0 AND value IS NOT NULL GROUP BY 1, 2) r ON q.user_id = r.user_id AND q.ts >= r.ts""")
def jon_47(spark, d):
    e = table(spark, d, "events")
    right = e.where("event_id % 3 <> 0 AND value IS NOT NULL").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return match.as_of(e.where("event_id % 3 = 0").select("user_id", "ts", F.col("event_id").alias("id")), right, "user_id", "ts", "value")


# ---- aggregates ----------------------------------------------------------------------------------


@register("agg_01_zero_filled", "SELECT n_nationkey AS zone, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 8000 GROUP BY 1")
def agg_01(spark, d):
    counts = table(spark, d, "supplier").where("s_acctbal > 8000").groupBy(F.col("s_nationkey").alias("zone")).agg(F.count(F.lit(1)).alias("n"))
    return agg.zero_filled(counts, table(spark, d, "nation").select(F.col("n_nationkey").alias("zone")), "zone", "n")


@register("agg_02_count_and_latest", "SELECT o_custkey, count(*) AS n, max(o_orderdate) AS latest FROM orders GROUP BY 1")
def agg_02(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderdate").alias("latest"))


@register("agg_03_array_counts", "SELECT w, count(*) AS n FROM (SELECT unnest(string_split(p_type, ' ')) AS w FROM part) GROUP BY 1")
def agg_03(spark, d):
    return table(spark, d, "part").select(F.explode(F.split("p_type", " ")).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@register("agg_04_success_rate", "SELECT o_orderpriority, count(*) AS total, round(100.0 * avg((o_orderstatus IN ('F', 'P'))::INT), 1) AS rate FROM orders GROUP BY 1")
def agg_04(spark, d):
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("total"), F.round(100.0 * F.avg(F.col("o_orderstatus").isin("F", "P").cast("int")), 1).alias("rate"))


@register("agg_06_conditional_counts", "SELECT count(*) AS n, count(*) FILTER (lang = 'en') AS en, count(*) FILTER (source = 'src0') AS hot, count(*) FILTER (n_chars > 5000) AS long FROM documents")
def agg_06(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("lang") == "en").alias("en"), F.count_if(F.col("source") == "src0").alias("hot"), F.count_if(F.col("n_chars") > 5000).alias("long"))


@register("agg_10_run_report", """
SELECT user_id, count(*) AS events, count(*) FILTER (event_type = 'purchase') AS purchases, count(DISTINCT event_type) AS kinds, arg_max(event_type, event_id) AS last_type, max(event_id) AS last_id,
 round(sum(value), 2) AS total FROM events GROUP BY 1""")
def agg_10(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "purchase").alias("purchases"), F.count_distinct("event_type").alias("kinds"), F.max_by("event_type", "event_id").alias("last_type"), F.max("event_id").alias("last_id"), F.round(F.sum("value"), 2).alias("total")
    )


@register("agg_11_upper_quantiles", """
SELECT event_type, count(value) AS n, round(avg(value), 4) AS mean, list_sort(list(value))[count(value)//2+1] AS median, list_sort(list(value))[greatest(0, floor(count(value)*0.9)::BIGINT-1)+1] AS p90, max(value) AS max
FROM events WHERE value IS NOT NULL GROUP BY 1""")
def agg_11(spark, d):
    return agg.upper_quantiles(table(spark, d, "events"), ["event_type"], "value")


@register("agg_12_top_n", "SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 12")
def agg_12(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id").limit(12)


@register("agg_label_full_outer", """
SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, d.lang, l.quality, l.toxic FROM (SELECT doc_id, lang FROM documents WHERE doc_id % 2 = 0) d FULL JOIN labels l ON d.doc_id = l.doc_id""")
def agg_label_full_outer(spark, d):
    """Even documents and all labels; AGG-15 is agg_15_review_report."""
    return table(spark, d, "documents").where("doc_id % 2 = 0").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality", "toxic"), "doc_id", "full_outer")


@register("agg_19_tag_families", "SELECT p_brand, count(*) AS n, list_sort(list(DISTINCT string_split(p_type, ' ')[1])) AS families FROM part GROUP BY 1")
def agg_19(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.get(F.split("p_type", " "), F.lit(0)))).alias("families"))


@register("agg_20_fill_rate", "SELECT 'lang' AS field, round(avg((lang IS NOT NULL AND lang <> '')::INT), 4) AS rate FROM documents UNION ALL SELECT 'source', round(avg((source IS NOT NULL AND source <> '')::INT), 4) FROM documents UNION ALL SELECT 'text', round(avg((text IS NOT NULL AND text <> '')::INT), 4) FROM documents")
def agg_20(spark, d):
    rates = table(spark, d, "documents").agg(*[F.round(F.avg((F.col(c).isNotNull() & (F.col(c) != "")).cast("int")), 4).alias(c) for c in ("lang", "source", "text")])
    return rates.select(F.expr("stack(3, 'lang', lang, 'source', source, 'text', text) AS (field, rate)"))


@register("agg_23_hubs", "SELECT l_partkey AS hub, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) >= 20")
def agg_23(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("hub")).agg(F.count_distinct("l_suppkey").alias("n")).where("n >= 20")


@register("agg_30_set_jaccard", """
WITH s AS (SELECT user_id, list(DISTINCT event_type) AS t FROM events GROUP BY 1)
SELECT a.user_id AS a, b.user_id AS b, round(len(list_intersect(a.t, b.t)) * 1.0 / len(list_distinct(list_concat(a.t, b.t))), 4) AS jaccard FROM s a JOIN s b ON b.user_id = a.user_id + 1""")
def agg_30(spark, d):
    s = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("t"))
    a, b = s.select(F.col("user_id").alias("a"), F.col("t").alias("ta")), s.select(F.col("user_id").alias("b"), F.col("t").alias("tb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(text.token_jaccard(F.col("ta"), F.col("tb")), 4).alias("jaccard"))


@register("agg_32_wilson", """
WITH g AS (SELECT c_mktsegment AS domain, count(*) AS n, count(*) FILTER (c_acctbal > 0) AS good FROM customer GROUP BY 1)
SELECT domain, n, round((good*1.0/n + 3.8416/(2*n) - 1.96*sqrt(((good*1.0/n)*(1-good*1.0/n) + 3.8416/(4*n))/n))/(1+3.8416/n), 6) AS wilson FROM g""")
def agg_32(spark, d):
    g = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("good"))
    return g.select("domain", "n", F.round(agg.wilson_lower(F.col("good"), F.col("n")), 6).alias("wilson"))


@register("agg_37_best_group", "SELECT c_nationkey, arg_max(c_custkey, (c_acctbal, c_custkey)) AS best FROM customer GROUP BY 1")
def agg_37(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("best"))


@register("agg_44_circular_mean", """
SELECT l_suppkey AS cell, month(l_shipdate) AS month, count(*) AS n, round(sum(sin(radians(l_linenumber*45.0))), 4) + 0.0 AS s, round(sum(cos(radians(l_linenumber*45.0))), 4) + 0.0 AS c FROM lineitem GROUP BY 1, 2""")
def agg_44(spark, d):
    a = F.radians(F.col("l_linenumber") * 45.0)
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), F.month("l_shipdate").alias("month")).agg(F.count(F.lit(1)).alias("n"), (F.round(F.sum(F.sin(a)), 4) + 0.0).alias("s"), (F.round(F.sum(F.cos(a)), 4) + 0.0).alias("c"))


@register("agg_45_histogram_percentile", """
WITH b AS (SELECT l_suppkey AS cell, floor(l_quantity/5)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2),
u AS (SELECT *, sum(n) OVER (PARTITION BY cell)::BIGINT AS total, sum(n) OVER (PARTITION BY cell ORDER BY bin)::BIGINT AS upto FROM b)
SELECT cell, total AS n, round((bin + (0.9*total - (upto - n))/n)*5, 4) AS value FROM u WHERE upto >= 0.9*total QUALIFY row_number() OVER (PARTITION BY cell ORDER BY bin) = 1""")
def agg_45(spark, d):
    return agg.histogram_percentile(table(spark, d, "lineitem").withColumnRenamed("l_suppkey", "cell"), ["cell"], "l_quantity", 0.9, 5.0)


@register("agg_47_wind_rose", """
SELECT l_suppkey AS cell, (floor(((l_linenumber*50.0 + 22.5) % 360)/45))::INT AS sector, count(*) AS n, round(avg(l_quantity), 4) AS speed, count(*) FILTER (l_quantity <= 3) AS calm, count(*) FILTER (l_quantity >= 34) AS gale FROM lineitem GROUP BY 1, 2""")
def agg_47(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("cell"), geo.sector(F.col("l_linenumber") * 50.0).alias("sector")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("l_quantity"), 4).alias("speed"), F.count_if(F.col("l_quantity") <= 3).alias("calm"), F.count_if(F.col("l_quantity") >= 34).alias("gale")
    )


@register("agg_49_density_noise", f"SELECT a.rid AS id FROM {_S} a WHERE NOT EXISTS (SELECT 1 FROM {_S} b WHERE a.rid <> b.rid AND {_hav('a.rlat', 'a.rlon', 'b.rlat', 'b.rlon')} <= 500 + 1e-6)")
def agg_49(spark, d):
    """Points without a neighbour in 500 km: density noise for groups of two."""
    p = _points(table(spark, d, "supplier"), "s_suppkey").select(F.col("s_suppkey").alias("id"), "lat", "lon")
    near = match.neighbours(p, p.select(F.col("id").alias("rid"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon")), 500.0).where("id <> rid")
    return p.select("id").join(near, "id", "left_anti")


# ---- windows and sequences -----------------------------------------------------------------------


@register("win_01_last_per_key", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def win_01(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("event_id", "event_type")).alias("x")).select("user_id", "x.event_id", "x.event_type")


@register("win_02_islands", """
WITH m AS (SELECT user_id, event_id, event_type, (event_type IS DISTINCT FROM lag(event_type) OVER w OR row_number() OVER w = 1)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT user_id, event_type, sum(new) OVER (PARTITION BY user_id ORDER BY e.ts, e.event_id)::BIGINT AS island FROM m JOIN events e USING (event_id, user_id, event_type))
SELECT user_id, island, any_value(event_type) AS event_type, count(*) AS n FROM i GROUP BY 1, 2""")
def win_02(spark, d):
    return match.islands(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], "event_type")


@register("win_03_cumulative", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS cum FROM orders")
def win_03(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, 0)
    return table(spark, d, "orders").select("o_orderkey", F.round(F.sum("o_totalprice").over(w), 2).alias("cum"))


_O = f"(SELECT o_custkey, o_orderdate, o_orderkey, {LAT.format(k='o_orderkey')} AS lat, {LON.format(k='o_orderkey')} AS lon FROM orders)"


@register("win_06_track_length", f"""
WITH l AS (SELECT o_custkey, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon FROM {_O} WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))
SELECT o_custkey, count(*) AS points, round(sum(coalesce({_hav('plat', 'plon', 'lat', 'lon', geo.EARTH_NM)}, 0)), 3) AS nm FROM l GROUP BY 1""")
def win_06(spark, d):
    t = match.track_lengths(_points(table(spark, d, "orders"), "o_orderkey"), "o_custkey", ["o_orderdate", "o_orderkey"])
    return t.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("points"), F.round(F.sum("leg_nm"), 3).alias("nm"))


@register("win_07_antimeridian_jumps", f"""
SELECT o_custkey, count(*) FILTER (abs(lon - plon) > 180) AS jumps FROM (SELECT o_custkey, lon, lag(lon) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS plon FROM {_O}) GROUP BY 1""")
def win_07(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    t = _points(table(spark, d, "orders"), "o_orderkey").withColumn("jump", F.abs(F.col("lon") - F.lag("lon").over(w)) > 180)
    return t.groupBy("o_custkey").agg(F.count_if("jump").alias("jumps"))


@register("win_11_best_per_group", "SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) <= 2")
def win_11(spark, d):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_linenumber")
    return table(spark, d, "lineitem").withColumn("k", F.row_number().over(w)).where("k <= 2").select("l_orderkey", "l_linenumber")


@register("win_13_unique_labels", "SELECT n_nationkey, n_name || CASE WHEN count(*) OVER (PARTITION BY n_regionkey) > 4 THEN ' (' || n_regionkey || ')' ELSE '' END AS label FROM nation")
def win_13(spark, d):
    many = F.count(F.lit(1)).over(Window.partitionBy("n_regionkey")) > 4
    return table(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.when(many, F.concat(F.lit(" ("), F.col("n_regionkey"), F.lit(")"))).otherwise("")).alias("label"))


@register("win_14_streak", """
WITH m AS (SELECT user_id, event_id, event_type, sum((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM events)
SELECT event_id, (row_number() OVER (PARTITION BY user_id, g ORDER BY event_id) - (g > 0)::INT)::BIGINT AS streak FROM m""")
def win_14(spark, d):
    """Events since the last success."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = table(spark, d, "events").withColumn("g", F.sum((F.col("event_type") == "purchase").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return e.select("event_id", (F.row_number().over(Window.partitionBy("user_id", "g").orderBy("event_id")) - (F.col("g") > 0).cast("int")).cast("long").alias("streak"))


# ---- order, pages, sets --------------------------------------------------------------------------


@register("srt_01_page", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' ORDER BY lower(c_name), c_custkey LIMIT 25 OFFSET 50")
def srt_01(spark, d):
    return table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").orderBy(F.lower("c_name"), "c_custkey").offset(50).limit(25).select("c_custkey", "c_name")


@register("srt_05_keyset", "SELECT event_id FROM events WHERE event_id > 200 ORDER BY event_id LIMIT 100")
def srt_05(spark, d):
    return table(spark, d, "events").where("event_id > 200").orderBy("event_id").limit(100).select("event_id")


@register("srt_06_tail", "SELECT conv_id, turn FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 2")
def srt_06(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return table(spark, d, "conversations").withColumn("k", F.row_number().over(w)).where("k <= 2").select("conv_id", "turn")


@register("srt_08_latest", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def srt_08(spark, d):
    return table(spark, d, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id", "ts")


@register("set_01_union_distinct", "SELECT c_nationkey AS zone FROM customer UNION SELECT s_nationkey FROM supplier")
def set_01(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("zone")).union(table(spark, d, "supplier").select("s_nationkey")).distinct()


@register("set_02_only_left", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_02(spark, d):
    return table(spark, d, "customer").select("c_custkey").subtract(table(spark, d, "orders").select("o_custkey"))


@register("set_03_both", "SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 49 INTERSECT SELECT s_suppkey FROM supplier WHERE s_acctbal > 0")
def set_03(spark, d):
    return table(spark, d, "lineitem").where("l_quantity > 49").select(F.col("l_suppkey").alias("k")).intersect(table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey"))


# ---- text and URLs -------------------------------------------------------------------------------

_FOLD = f"translate(lower({{c}}), '{text.ACCENTED}', '{text.PLAIN}')"


@register("str_title_key", f"SELECT doc_id, substr(regexp_replace({_FOLD.format(c='substr(text, 1, 60)')}, '[^a-z0-9]', '', 'g'), 1, 40) AS name FROM documents")
def str_title_key(spark, d):
    """Key of a title, which is the first 60 characters of a document; whole texts are in str_01_name_key."""
    return table(spark, d, "documents").select("doc_id", text.normalize_name(F.substring("text", 1, 60)).alias("name"))


@register("str_01_name_key", f"SELECT doc_id, substr(regexp_replace({_FOLD.format(c='text')}, '[^a-z0-9]', '', 'g'), 1, 40) AS name FROM documents")
def str_01(spark, d):
    return table(spark, d, "documents").select("doc_id", text.normalize_name(F.col("text")).alias("name"))


@register("str_02_spaced_name", f"SELECT doc_id, substr(trim(regexp_replace({_FOLD.format(c='text')}, '[^a-z0-9]+', ' ', 'g')), 1, 25) AS name FROM documents")
def str_02(spark, d):
    """Names of whole texts."""
    return table(spark, d, "documents").select("doc_id", text.spaced_name(F.col("text")).alias("name"))


@register("str_host_path", "SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '') || regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS key FROM pages")
def str_14(spark, d):
    return table(spark, d, "pages").select("page_id", text.url_key(F.col("url")).alias("key"))


@register("str_17_pages_per_host", "SELECT regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '') AS host, count(*) AS n FROM pages GROUP BY 1")
def str_17(spark, d):
    return table(spark, d, "pages").groupBy(text.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@register("str_20_extract_urls", "SELECT page_id, len(regexp_extract_all(html, 'https?://[^\\s\"''<>]+')) AS n FROM pages")
def str_20(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(F.regexp_extract_all("html", F.lit("https?://[^\\s\"'<>]+"), F.lit(0))).cast("long").alias("n"))


@register("str_next_item_jaccard", "SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.t, b.t))*1.0/len(list_distinct(list_concat(a.t, b.t))), 5) AS jaccard FROM (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(" + _FOLD.format(c="text") + ", '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM benchmark) a JOIN (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(" + _FOLD.format(c="text") + ", '[^a-z0-9]+'), lambda x: x <> '')) AS t FROM benchmark) b ON b.item_id = a.item_id + 1")
def str_next_item_jaccard(spark, d):
    t = table(spark, d, "benchmark").select("item_id", text.tokens(F.col("text")).alias("t"))
    a, b = t.select(F.col("item_id").alias("a"), F.col("t").alias("ta")), t.select(F.col("item_id").alias("b"), F.col("t").alias("tb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", F.round(text.token_jaccard(F.col("ta"), F.col("tb")), 5).alias("jaccard"))


@register("str_38_keyword_category", "SELECT p_partkey, CASE WHEN regexp_matches(p_type, 'BRASS|STEEL') THEN 'metal' WHEN contains(p_type, 'COPPER') THEN 'copper' WHEN p_type IS NULL OR p_type = '' THEN 'none' ELSE 'other' END AS category FROM part")
def str_38(spark, d):
    c = F.when(F.col("p_type").rlike("BRASS|STEEL"), "metal").when(F.contains(F.col("p_type"), F.lit("COPPER")), "copper").when(F.col("p_type").isNull() | (F.col("p_type") == ""), "none").otherwise("other")
    return table(spark, d, "part").select("p_partkey", c.alias("category"))


# ---- geometry and dates --------------------------------------------------------------------------


@register("geo_01_haversine", f"SELECT a.id, round({_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}, 4) AS km FROM {_C} a JOIN {_C} b ON b.id = a.id + 1")
def geo_01(spark, d):
    c = _points(table(spark, d, "customer"), "c_custkey").select(F.col("c_custkey").alias("id"), "lat", "lon")
    n = c.select((F.col("id") - 1).alias("id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    return c.join(n, "id").select("id", F.round(geo.haversine_km(F.col("lat"), F.col("lon"), F.col("lat2"), F.col("lon2")), 4).alias("km"))


@register("geo_05_bearing", f"SELECT id, round((degrees(atan2(sin(radians(10-lon))*cos(radians(45)), cos(radians(lat))*sin(radians(45))-sin(radians(lat))*cos(radians(45))*cos(radians(10-lon)))) + 360.0) % 360.0, 4) AS bearing FROM {_C}")
def geo_05(spark, d):
    return _points(table(spark, d, "customer"), "c_custkey").select(F.col("c_custkey").alias("id"), F.round(geo.bearing(F.col("lat"), F.col("lon"), F.lit(45.0), F.lit(10.0)), 4).alias("bearing"))


@register("geo_09_lon_gap", f"SELECT id, round(least(abs(lon - 179.5), 360 - abs(lon - 179.5)), 4) AS gap FROM {_C}")
def geo_09(spark, d):
    return _points(table(spark, d, "customer"), "c_custkey").select(F.col("c_custkey").alias("id"), F.round(geo.lon_gap(F.col("lon"), F.lit(179.5)), 4).alias("gap"))


@register("geo_30_sector", "SELECT l_orderkey, l_linenumber, floor(((l_linenumber*37.0 + 22.5) % 360)/45)::INT AS sector FROM lineitem")
def geo_30(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", geo.sector(F.col("l_linenumber") * 37.0).alias("sector"))


@register("geo_53_cosine", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 5) AS cosine FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def geo_53(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2")), "vec_id").select("vec_id", F.round(match.cosine(F.col("embedding"), F.col("e2")), 5).alias("cosine"))


@register("dat_02_iso", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS iso FROM orders")
def dat_02(spark, d):
    return table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@register("dat_05_last_cycle", "SELECT event_id, (floor(hour(ts)/6)*6)::INT AS cycle FROM events")
def dat_05(spark, d):
    return table(spark, d, "events").select("event_id", (F.floor(F.hour("ts") / 6) * 6).cast("int").alias("cycle"))


@register("arr_03_split_categories", "SELECT p_partkey, string_split(lower(p_type), ' ') AS parts FROM part")
def arr_03(spark, d):
    return table(spark, d, "part").select("p_partkey", F.split(F.lower("p_type"), " ").alias("parts"))


@register("arr_09_confidence_scale", "SELECT event_id, round(CASE WHEN value <= 1 THEN value*100 ELSE value END, 4) AS confidence FROM events")
def arr_09(spark, d):
    return table(spark, d, "events").select("event_id", F.round(F.when(F.col("value") <= 1, F.col("value") * 100).otherwise(F.col("value")), 4).alias("confidence"))


@register("arr_11_rule_resolution", "SELECT p.p_partkey, coalesce(o.size, f.size, p.p_size) AS value FROM part p LEFT JOIN (SELECT p_partkey, p_size + 1000 AS size FROM part WHERE p_partkey % 10 = 0) o ON o.p_partkey = p.p_partkey LEFT JOIN (SELECT p_brand, min(p_size) AS size FROM part WHERE p_brand LIKE '%1' GROUP BY 1) f ON f.p_brand = p.p_brand")
def arr_11(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_size")
    over = p.where("p_partkey % 10 = 0").select("p_partkey", (F.col("p_size") + 1000).alias("o"))
    profile = p.where("p_brand LIKE '%1'").groupBy("p_brand").agg(F.min("p_size").alias("f"))
    return p.join(over, "p_partkey", "left").join(profile, "p_brand", "left").select("p_partkey", F.coalesce("o", "f", "p_size").alias("value"))


# ---- beyond the inventory ------------------------------------------------------------------------


@register("ext_01_rollup", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def ext_01(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@register("ext_02_tumbling", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def ext_02(spark, d):
    from tidemark.streaming.events import windowed_counts

    return windowed_counts(table(spark, d, "events")).withColumn("start", F.col("start").cast("timestamp_ntz"))
