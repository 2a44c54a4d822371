"""More queries of the inventory: projections, upserts, reports, sequences, geometry and text."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions import geo, text
from tidemark.plans.catalog import register
from tidemark.plans.inventory import LAT, LON, _C, _FOLD, _hav, _points
from tidemark.sources import sinks
from tidemark.sources.tables import table


@register("prj_01_feature_columns", f"SELECT c_custkey, 'Feature' AS type, round({LON.format(k='c_custkey')}, 4) AS lon, round({LAT.format(k='c_custkey')}, 4) AS lat, c_mktsegment AS kind FROM customer")
def prj_01(spark, d):
    f = _points(table(spark, d, "customer"), "c_custkey").select("c_custkey", sinks.feature(F.col("lon"), F.col("lat"), F.struct(F.col("c_mktsegment").alias("kind"))).alias("f"))
    at = F.col("f.geometry.coordinates")
    return f.select("c_custkey", "f.type", F.round(F.get(at, F.lit(0)), 4).alias("lon"), F.round(F.get(at, F.lit(1)), 4).alias("lat"), "f.properties.kind")


@register("snk_upsert_overwrite", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, c_acctbal + 1, c_mktsegment FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0")
def snk_upsert_overwrite(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return sinks.upsert(c.where("c_custkey % 2 = 0"), c.where("c_custkey % 3 = 0").withColumn("c_acctbal", F.col("c_acctbal") + 1), "c_custkey", ("c_mktsegment",))


@register("flt_nin_and_ne", "SELECT count(*) FILTER (lang IS NOT NULL AND lang <> '') AS present, count(*) FILTER (lang IS DISTINCT FROM 'en') AS not_en, count(*) FILTER (NOT coalesce(n_chars >= 1000, false)) AS short FROM documents")
def flt_nin(spark, d):
    return table(spark, d, "documents").agg(F.count_if(F.col("lang").isNotNull() & (F.col("lang") != "")).alias("present"), F.count_if(~F.col("lang").eqNullSafe("en")).alias("not_en"), F.count_if(~F.coalesce(F.col("n_chars") >= 1000, F.lit(False))).alias("short"))


@register("flt_25_image_or_pdf", "SELECT regexp_matches(lower(url), '\\.(png|jpe?g|gif|webp)(\\?|$)') AS image, regexp_matches(lower(url), '\\.pdf(\\?|$)') AS pdf, count(*) AS n FROM pages GROUP BY 1, 2")
def flt_25(spark, d):
    u = F.lower("url")
    return table(spark, d, "pages").groupBy(u.rlike(r"\.(png|jpe?g|gif|webp)(\?|$)").alias("image"), u.rlike(r"\.pdf(\?|$)").alias("pdf")).agg(F.count(F.lit(1)).alias("n"))


@register("jon_16_flag_from_match", "SELECT c_custkey, c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT') AS urgent FROM customer")
def jon_16(spark, d):
    hit = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("hit", F.lit(True))
    return table(spark, d, "customer").select("c_custkey").join(hit, "c_custkey", "left").select("c_custkey", F.coalesce("hit", F.lit(False)).alias("urgent"))


@register("jon_29_worst_zone", f"""
SELECT c.id, coalesce(max(z.score), 0) AS score FROM {_C} c LEFT JOIN (VALUES (-10.0, 10.0, -60.0, 20.0, 3), (0.0, 40.0, 0.0, 90.0, 5), (-40.0, -5.0, 100.0, 180.0, 2)) z(s, n, w, e, score)
 ON c.lat BETWEEN z.s AND z.n AND c.lon BETWEEN z.w AND z.e GROUP BY c.id""")
def jon_29(spark, d):
    zones = spark.createDataFrame([(-10.0, 10.0, -60.0, 20.0, 3), (0.0, 40.0, 0.0, 90.0, 5), (-40.0, -5.0, 100.0, 180.0, 2)], "s double, n double, w double, e double, score int")
    c = _points(table(spark, d, "customer"), "c_custkey").select(F.col("c_custkey").alias("id"), "lat", "lon")
    met = c.join(F.broadcast(zones), F.col("lat").between(F.col("s"), F.col("n")) & F.col("lon").between(F.col("w"), F.col("e")), "left")  # three fixed zones
    return met.groupBy("id").agg(F.coalesce(F.max("score"), F.lit(0)).alias("score"))


@register("jon_48_interpolate", """
SELECT event_id, round(CASE WHEN nxt IS NULL OR nts = ts THEN value ELSE value + (nxt - value) * 0.5 END, 4) AS mid FROM (
 SELECT event_id, ts, value, lead(value) OVER w AS nxt, lead(ts) OVER w AS nts FROM events WHERE value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def jon_48(spark, d):
    """Value halfway to the next sample of the same track."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").where("value IS NOT NULL").withColumns({"nxt": F.lead("value").over(w), "nts": F.lead("ts").over(w)})
    return e.select("event_id", F.round(F.when(F.col("nxt").isNull() | (F.col("nts") == F.col("ts")), F.col("value")).otherwise(F.col("value") + (F.col("nxt") - F.col("value")) * 0.5), 4).alias("mid"))


_PORT = "substr(regexp_replace(" + _FOLD.format(c="regexp_replace({c}, '^.*#', '')") + ", '[^a-z0-9]', '', 'g'), 1, 40)"


@register("jon_39_union_ports", f"""
WITH ports AS (SELECT {_PORT.format(c="c_name")} AS name, 'v1' AS src, c_custkey AS key, coalesce(c_acctbal > 0, false) AS ok, c_custkey IS NOT NULL AS geo, coalesce(c_acctbal, 0) AS score FROM customer UNION ALL
 SELECT {_PORT.format(c="s_name")}, 'run', s_suppkey, coalesce(s_acctbal > 0, false), s_suppkey IS NOT NULL, coalesce(s_acctbal, 0) FROM supplier),
best AS (SELECT name, src, key, score FROM ports WHERE name <> '' QUALIFY row_number() OVER (PARTITION BY name ORDER BY ok DESC, geo DESC, score DESC, src DESC, key NULLS LAST) = 1),
seeds AS (SELECT printf('%09d', p_partkey) AS name, min(p_partkey) AS key, max(p_retailprice) AS score FROM part WHERE p_partkey IS NOT NULL GROUP BY 1)
SELECT * FROM best UNION ALL SELECT name, 'seed', key, score FROM seeds WHERE NOT EXISTS (FROM best WHERE best.name = seeds.name)""")
def jon_39(spark, d):
    """Best port of each name (characters after '#') of v1 and run; equal ones go to v1, then to the smaller key. Seeds fill gaps only."""

    def side(t, p, key, src):
        lat, lon = geo.synthetic_lat(F.col(key)), geo.synthetic_lon(F.col(key))
        ranks = [F.coalesce(F.col(f"{p}_acctbal") > 0, F.lit(False)).alias("ok"), (lat.isNotNull() & lon.isNotNull()).alias("geo"), F.coalesce(f"{p}_acctbal", F.lit(0.0)).alias("score"), F.lit(src).alias("src"), (-F.col(key)).alias("minus_key")]
        return table(spark, d, t).select(text.normalize_name(F.regexp_replace(f"{p}_name", "^.*#", "")).alias("name"), F.struct(*ranks).alias("rank")).where("name <> ''")

    ports = side("customer", "c", "c_custkey", "v1").unionByName(side("supplier", "s", "s_suppkey", "run"))
    best = ports.groupBy("name").agg(F.max("rank").alias("rank")).select("name", "rank.src", (-F.col("rank.minus_key")).alias("key"), "rank.score")
    seeds = table(spark, d, "part").where("p_partkey IS NOT NULL").groupBy(F.format_string("%09d", "p_partkey").alias("name")).agg(F.min("p_partkey").alias("key"), F.max("p_retailprice").alias("score"))
    return best.unionByName(seeds.join(best, "name", "left_anti").select("name", F.lit("seed").alias("src"), "key", "score"))


@register("agg_07_pivot", "SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'BUILDING') AS building, count(*) FILTER (c_mktsegment = 'MACHINERY') AS machinery FROM customer GROUP BY 1")
def agg_07(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").pivot("c_mktsegment", ["BUILDING", "MACHINERY"]).agg(F.count(F.lit(1))).select("c_nationkey", F.coalesce("BUILDING", F.lit(0)).alias("building"), F.coalesce("MACHINERY", F.lit(0)).alias("machinery"))


_KINDS = ("eez", "project", "marina", "capitainerie", "amp")
_KIND = f"{list(_KINDS)}[id % 5 + 1]"
_STRIP = " \t\r\n"


@register("agg_15_review_report", f"""
WITH said AS (SELECT id, turn, comment FROM (SELECT conv_id AS id, turn, trim(text, '{_STRIP}') AS comment FROM conversations) WHERE id IS NOT NULL AND comment <> ''
 QUALIFY row_number() OVER (PARTITION BY id ORDER BY turn DESC NULLS LAST, comment DESC) = 1),
choice AS (SELECT doc_id AS id, max(quality) AS quality, max(toxic) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1 HAVING count(quality) + count(toxic) > 0),
gold AS (SELECT doc_id AS id, max(lang) AS lang, coalesce(bool_or(n_chars >= 1000), false) AS gold FROM documents WHERE doc_id IS NOT NULL GROUP BY 1),
item AS (SELECT kind, id, comment, turn, quality, toxic, lang, coalesce(gold, false) AS gold FROM (SELECT {_KIND} AS kind, * FROM said) FULL JOIN (SELECT {_KIND} AS kind, * FROM choice) USING (kind, id) FULL JOIN (SELECT {_KIND} AS kind, * FROM gold) USING (kind, id)),
url AS (SELECT kind, id, unnest(list_distinct(list_transform(regexp_extract_all(comment, '(?i)https?://[^\\s,;|<>"'']+'), lambda x: rtrim(x, ').,;]')))) AS target FROM item),
action AS (SELECT kind, id, 'suggested_urls' AS action, target FROM url UNION ALL SELECT kind, id, 'td_kept', target FROM url
 UNION ALL SELECT kind, id, CASE quality WHEN 1 THEN 'td_kept' ELSE 'td_dropped' END, 'quality' FROM item WHERE quality IS NOT NULL UNION ALL SELECT kind, id, CASE toxic WHEN 1 THEN 'td_dropped' ELSE 'td_kept' END, 'toxic' FROM item WHERE toxic IS NOT NULL)
SELECT 'item' AS section, kind, id, comment, turn, quality, toxic, lang, gold, NULL AS action, NULL AS target, NULL AS fiches, NULL AS comments, NULL AS golds FROM item
UNION ALL BY NAME SELECT 'action' AS section, * FROM action
UNION ALL BY NAME SELECT 'summary' AS section, kind, count(*) AS fiches, count(comment) AS comments, count(*) FILTER (gold) AS golds FROM item GROUP BY kind""")
def agg_15(spark, d):
    """Review report as rows of three sections: items per (kind, id) from all rows of three tables, actions, summary per kind.

    Comments are turns of conversations (the last one that is not blank counts), choices are labels, gold marks are
    documents of 1,000 characters or more; the kind is made from the id. URLs of a comment are told apart as written.
    """
    kind = F.get(F.array(*map(F.lit, _KINDS)), (F.col("id") % 5).cast("int"))
    keyed = lambda t, key: table(spark, d, t).withColumn("id", F.col(key)).where("id IS NOT NULL").withColumn("kind", kind).groupBy("kind", "id")
    said = table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.struct("turn", F.trim("text", F.lit(_STRIP)).alias("comment")).alias("said"))
    said = said.where("id IS NOT NULL AND said.comment <> ''").withColumn("kind", kind).groupBy("kind", "id").agg(F.max("said").alias("said")).select("kind", "id", "said.comment", "said.turn")
    choice = keyed("labels", "doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic")).where("quality IS NOT NULL OR toxic IS NOT NULL")
    gold = keyed("documents", "doc_id").agg(F.max("lang").alias("lang"), F.bool_or(F.col("n_chars") >= 1000).alias("gold"))
    item = said.join(choice, ["kind", "id"], "full_outer").join(gold, ["kind", "id"], "full_outer").withColumn("gold", F.coalesce("gold", F.lit(False)))

    urls = F.array_distinct(F.transform(F.regexp_extract_all("comment", F.lit("(?i)https?://[^\\s,;|<>\"']+"), F.lit(0)), lambda u: F.rtrim(u, F.lit(").,;]"))))
    one = lambda action, target: F.struct(F.lit(action).alias("action"), target.alias("target"))
    of_urls = F.coalesce(F.flatten(F.transform(urls, lambda u: F.array(one("suggested_urls", u), one("td_kept", u)))), F.array().cast("array<struct<action:string,target:string>>"))
    chosen = lambda c, yes, no: F.when(F.col(c) == 1, one(yes, F.lit(c))).when(F.col(c).isNotNull(), one(no, F.lit(c)))
    of_choices = F.filter(F.array(chosen("quality", "td_kept", "td_dropped"), chosen("toxic", "td_dropped", "td_kept")), lambda x: x.isNotNull())
    action = item.select("kind", "id", F.explode(F.concat(of_urls, of_choices)).alias("a")).select("kind", "id", "a.action", "a.target")
    summary = item.groupBy("kind").agg(F.count(F.lit(1)).alias("fiches"), F.count("comment").alias("comments"), F.count_if("gold").alias("golds"))

    section = lambda name, df: df.withColumn("section", F.lit(name))
    every = section("item", item).unionByName(section("action", action), True).unionByName(section("summary", summary), True)
    return every.select("section", "kind", "id", "comment", "turn", "quality", "toxic", "lang", "gold", "action", "target", "fiches", "comments", "golds")


@register("agg_lang_scores", "SELECT lang, round(sum((CASE WHEN quality = 1 THEN 0.15 ELSE -0.20 END)::DOUBLE), 4) AS score, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def agg_lang_scores(spark, d):
    j = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id")
    return j.groupBy("lang").agg(F.round(F.sum(F.when(F.col("quality") == 1, 0.15).otherwise(-0.20)), 4).alias("score"), F.count(F.lit(1)).alias("n"))


@register("agg_34_dedup_stats", "SELECT count(*) AS before, count(DISTINCT text) AS after, count(*) - count(DISTINCT text) AS removed FROM documents")
def agg_34(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("before"), F.count_distinct("text").alias("after")).withColumn("removed", F.col("before") - F.col("after"))


@register("agg_36_all_ok", "SELECT o_custkey, bool_and(o_orderstatus <> 'O') AS settled, bool_or(o_totalprice > 300000) AS large FROM orders GROUP BY 1")
def agg_36(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.bool_and(F.col("o_orderstatus") != "O").alias("settled"), F.bool_or(F.col("o_totalprice") > 300000).alias("large"))


@register("agg_40_last_position", f"SELECT o_custkey, max(o_orderkey) AS o_orderkey, round(arg_max({LAT.format(k='o_orderkey')}, o_orderkey), 4) AS lat FROM orders GROUP BY 1")
def agg_40(spark, d):
    return _points(table(spark, d, "orders"), "o_orderkey").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.round(F.max_by("lat", "o_orderkey"), 4).alias("lat"))


@register("agg_41_reasons", "SELECT user_id, list_sort(list(DISTINCT event_type)) AS reasons, count(DISTINCT event_type) AS n FROM events WHERE value > 50 GROUP BY 1")
def agg_41(spark, d):
    return table(spark, d, "events").where("value > 50").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("reasons"), F.count_distinct("event_type").alias("n"))


@register("win_09_every_nth", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER w AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)) WHERE (k - 1) % 3 = 0 OR k = n")
def win_09(spark, d):
    w = Window.partitionBy("o_custkey")
    t = table(spark, d, "orders").withColumns({"k": F.row_number().over(w.orderBy("o_orderdate", "o_orderkey")), "n": F.count(F.lit(1)).over(w)})
    return t.where("(k - 1) % 3 = 0 OR k = n").select("o_orderkey")


@register("win_16_farthest_per_sector", f"""
SELECT sector, id FROM (SELECT id, floor(((degrees(atan2(lat, lon)) + 360) % 360)/5)::INT AS sector, {_hav('0.0', '0.0', 'lat', 'lon')} AS km FROM {_C})
QUALIFY row_number() OVER (PARTITION BY sector ORDER BY round(km, 6) DESC, id) = 1""")
def win_16(spark, d):
    c = _points(table(spark, d, "customer"), "c_custkey")
    s = F.floor(F.pmod(F.degrees(F.atan2("lat", "lon")) + 360, F.lit(360.0)) / 5).cast("int")
    far = F.max_by("c_custkey", F.struct(F.round(geo.haversine_km(F.lit(0.0), F.lit(0.0), F.col("lat"), F.col("lon")), 6), -F.col("c_custkey")))
    return c.groupBy(s.alias("sector")).agg(far.alias("id"))


@register("srt_14_shortest_path", "SELECT host, arg_min(url, (len(string_split(url, '/')), url)) AS url FROM (SELECT url, regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '') AS host FROM pages) GROUP BY 1")
def srt_14(spark, d):
    return table(spark, d, "pages").groupBy(text.host(F.col("url")).alias("host")).agg(F.min_by("url", F.struct(F.size(F.split("url", "/")), "url")).alias("url"))


@register("str_07_name_overlap", f"SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey AND contains({_FOLD.format(c='a.n_name')}, substr({_FOLD.format(c='b.n_name')}, 1, 2))")
def str_07(spark, d):
    n = table(spark, d, "nation")
    a, b = (n.select(F.col("n_nationkey").alias(f"k{x}"), "n_regionkey", F.col("n_name").alias(x)) for x in "ab")
    return a.join(b, "n_regionkey").where((F.col("ka") < F.col("kb")) & F.contains(text.fold(F.col("a")), F.substring(text.fold(F.col("b")), 1, 2))).select("a", "b")


@register("str_23_path_tokens", "SELECT page_id, len(list_filter(string_split(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')) AS depth FROM pages")
def str_23(spark, d):
    return table(spark, d, "pages").select("page_id", F.size(F.filter(F.split(text.path(F.col("url")), "/"), lambda x: x != "")).cast("long").alias("depth"))


@register("str_51_rules_hash", "SELECT p_partkey, sha256(p_brand || '|' || p_type || '|' || p_size) AS hash FROM part")
def str_51(spark, d):
    return table(spark, d, "part").select("p_partkey", F.sha2(F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")).cast("binary"), 256).alias("hash"))


@register("geo_06_wind_angle", "SELECT l_orderkey, l_linenumber, CASE WHEN (l_quantity*7.0 - l_linenumber*45.0 + 720) % 360 > 180 THEN 360 - (l_quantity*7.0 - l_linenumber*45.0 + 720) % 360 ELSE (l_quantity*7.0 - l_linenumber*45.0 + 720) % 360 END AS angle FROM lineitem")
def geo_06(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", geo.wind_angle(F.col("l_linenumber") * 45.0, F.col("l_quantity") * 7.0).alias("angle"))


@register("geo_12_quad_split", f"SELECT n.n_nationkey AS k, q.i AS i, round({LAT.format(k='n.n_nationkey')} + q.dy, 4) AS south, round({LON.format(k='n.n_nationkey')} + q.dx, 4) AS west FROM nation n CROSS JOIN (VALUES (0, 0.0, 0.0), (1, 0.0, 1.0), (2, 1.0, 0.0), (3, 1.0, 1.0)) q(i, dy, dx)")
def geo_12(spark, d):
    n = _points(table(spark, d, "nation"), "n_nationkey")
    quads = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(y).alias("y"), F.lit(x).alias("x")) for i, (y, x) in enumerate([(0.0, 0.0), (0.0, 1.0), (1.0, 0.0), (1.0, 1.0)])])
    return n.select("n_nationkey", "lat", "lon", F.explode(quads).alias("q")).select(F.col("n_nationkey").alias("k"), "q.i", F.round(F.col("lat") + F.col("q.y"), 4).alias("south"), F.round(F.col("lon") + F.col("q.x"), 4).alias("west"))


@register("geo_28_wind_uv", "SELECT l_orderkey, l_linenumber, round(sqrt(pow(l_quantity - 25, 2) + pow(l_linenumber - 3.5, 2)) * 1.94384, 4) AS kn, round((degrees(atan2(-(l_quantity - 25), -(l_linenumber - 3.5))) + 360) % 360, 4) AS dir FROM lineitem")
def geo_28(spark, d):
    kn, direction = geo.wind_from_uv(F.col("l_quantity") - 25, F.col("l_linenumber") - 3.5)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(kn, 4).alias("kn"), F.round(direction, 4).alias("dir"))


@register("geo_50_verdict", "SELECT c_custkey, CASE WHEN c_acctbal > 8000 THEN 'confirmed' WHEN c_acctbal > 4000 AND c_mktsegment = 'BUILDING' THEN 'probable' WHEN c_acctbal IS NULL THEN 'name_only' ELSE 'unverified' END AS verdict FROM customer")
def geo_50(spark, d):
    b = F.col("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.when(b > 8000, "confirmed").when((b > 4000) & (F.col("c_mktsegment") == "BUILDING"), "probable").when(b.isNull(), "name_only").otherwise("unverified").alias("verdict"))


@register("geo_54_risk_composite", "SELECT l_orderkey, l_linenumber, round(CASE WHEN greatest(l_discount*10, l_tax*10) >= 0.88 THEN greatest(l_discount*10, l_tax*10) ELSE 0.6*l_discount*10 + 0.4*l_tax*10 END, 4) AS risk FROM lineitem")
def geo_54(spark, d):
    a, b = F.col("l_discount") * 10, F.col("l_tax") * 10
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.when(F.greatest(a, b) >= 0.88, F.greatest(a, b)).otherwise(0.6 * F.col("l_discount") * 10 + 0.4 * F.col("l_tax") * 10), 4).alias("risk"))


@register("dat_04_month_range", "SELECT o_orderkey, date_trunc('month', o_orderdate)::DATE AS first, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE AS after FROM orders")
def dat_04(spark, d):
    first = F.trunc("o_orderdate", "month")
    return table(spark, d, "orders").select("o_orderkey", first.alias("first"), F.add_months(first, 1).alias("after"))


@register("arr_04_any_in_set", "SELECT p_partkey FROM part WHERE list_has_any(string_split(p_type, ' '), ['STEEL', 'SMALL', 'PROMO'])")
def arr_04(spark, d):
    return table(spark, d, "part").where(F.arrays_overlap(F.split("p_type", " "), F.array(*map(F.lit, ("STEEL", "SMALL", "PROMO"))))).select("p_partkey")


@register("arr_08_yes_no", "SELECT o_orderkey, CASE WHEN lower(o_orderstatus) IN ('f', 'p') THEN true WHEN lower(o_orderstatus) = 'o' THEN false END AS done FROM orders")
def arr_08(spark, d):
    s = F.lower("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", F.when(s.isin("f", "p"), True).when(s == "o", False).alias("done"))


@register("arr_json_field", "SELECT event_id, len(json_keys(props)) AS n_keys FROM events WHERE props IS NOT NULL AND props <> ''")
def arr_json(spark, d):
    return table(spark, d, "events").where("props IS NOT NULL AND props <> ''").select("event_id", F.size(F.json_object_keys("props")).cast("long").alias("n_keys"))


@register("agg_stale_users", "SELECT user_id, max(ts) AS last, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 7 DAY AS stale FROM events GROUP BY 1")
def agg_stale_users(spark, d):
    e = table(spark, d, "events").select("user_id", "ts")
    newest = e.agg(F.max("ts").alias("newest"))
    return e.groupBy("user_id").agg(F.max("ts").alias("last")).join(F.broadcast(newest), F.lit(True)).select("user_id", "last", (F.col("last") < F.col("newest") - F.expr("INTERVAL 7 DAY")).alias("stale"))  # one row


@register("ext_03_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def ext_03(spark, d):
    return table(spark, d, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@register("ext_04_session_windows", """
WITH m AS (SELECT user_id, ts, event_id, (lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 6 HOUR)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def ext_04(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


