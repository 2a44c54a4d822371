"""Queries of the inventory that follow the rules of single survey rows: URLs, verdicts, sets, counters, geometry.

Roles as in inventory; labels hold a reviewer's verdicts (quality: keep, toxic: drop), documents are
seeds and pages the sources that were collected for them.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions import geo, text
from tidemark.plans.catalog import register
from tidemark.plans.inventory import LAT, LON, _hav, _points
from tidemark.sources.tables import table

# ---- URLs and text -------------------------------------------------------------------------------

_SCHEME = "CASE WHEN regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) ELSE 'https' END"
_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]*)', 1)), '^www\\.', '')"
_PATH = "regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '')"
_PORT = "regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#:]*:(\\d+)', 1)"
_QUERY = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"
_NORMAL = f"{_SCHEME} || '://' || {_HOST} || CASE WHEN {_PORT} IN ('', '80', '443') THEN '' ELSE ':' || {_PORT} END || {_PATH} || CASE WHEN {_QUERY} = '' THEN '' ELSE '?' || {_QUERY} END"
_HIT = f"{_SCHEME} || '://' || {_HOST} || CASE WHEN {_PATH} = '' THEN '/' ELSE {_PATH} END"


#: Each page's URL as it is, without its scheme, and with user and port.
_WRITTEN = """(SELECT page_id, v AS variant, CASE v WHEN 0 THEN url WHEN 1 THEN regexp_replace(url, '^[a-z]+://', '') ELSE regexp_replace(url, '^([a-z]+)://([^/?#]*)', '\\1://me:pw@\\2:8080') END AS url
  FROM pages, (VALUES (0), (1), (2)) t(v))"""
_W_AUTH = "regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1)"
_W_HOST = f"regexp_replace(lower(regexp_extract({_W_AUTH}, '^(?:.*@)?([^:]*)', 1)), '^www\\.', '')"
_W_PATH = "CASE variant WHEN 1 THEN rtrim(regexp_extract(url, '^[^?#]*'), '/') ELSE regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/+$', '') END"
_W_SCHEME = "CASE variant WHEN 1 THEN 'https' ELSE regexp_extract(url, '^[a-z]+') END"


def _urls_as_written(spark, d):
    url = F.col("url")
    variants = F.array(url, F.regexp_replace(url, "^[a-z]+://", ""), F.regexp_replace(url, "^([a-z]+)://([^/?#]*)", "$1://me:pw@$2:8080"))
    return table(spark, d, "pages").select("page_id", F.posexplode(variants).alias("variant", "url"))


@register("str_14_normalize_url", f"""SELECT page_id, variant, {_W_SCHEME} || '://' || {_W_HOST} || CASE variant WHEN 2 THEN ':8080' ELSE '' END || CASE variant WHEN 1 THEN '/' ELSE '' END || {_W_PATH}
  || CASE WHEN {_QUERY} = '' THEN '' ELSE '?' || {_QUERY} END AS key FROM {_WRITTEN}""")
def str_14(spark, d):
    return _urls_as_written(spark, d).select("page_id", "variant", text.normalized_url(F.col("url")).alias("key"))


@register("str_15_hit_key", f"SELECT page_id, variant, {_W_SCHEME} || '://' || {_W_HOST} || CASE WHEN {_W_PATH} = '' THEN '/' ELSE {_W_PATH} END AS key FROM {_WRITTEN}")
def str_15(spark, d):
    return _urls_as_written(spark, d).select("page_id", "variant", text.hit_key(F.col("url")).alias("key"))


@register("str_16_listed_key", f"""SELECT page_id, variant, CASE variant WHEN 1 THEN 'https://' || regexp_replace(lower(split_part({_W_PATH}, '/', 1)), '^www\\.', '') || substr({_W_PATH}, 1 + length(split_part({_W_PATH}, '/', 1)))
  ELSE {_W_SCHEME} || '://' || regexp_replace(lower({_W_AUTH}), '^www\\.', '') || {_W_PATH} END AS key FROM {_WRITTEN}""")
def str_16(spark, d):
    return _urls_as_written(spark, d).select("page_id", "variant", text.listed_key(F.col("url")).alias("key"))


@register("str_21_url_equivalence", f"SELECT page_id, {_NORMAL} = {_NORMAL.replace('url', 'other')} AS same FROM (SELECT page_id, url, regexp_replace(regexp_replace(url, '#.*$', ''), '^http:', 'HTTP:') || '#here' AS other FROM pages)")
def str_21(spark, d):
    """A URL and its variant with another fragment and spelling of the scheme are one."""
    other = F.concat(F.regexp_replace(F.regexp_replace("url", "#.*$", ""), "^http:", "HTTP:"), F.lit("#here"))
    return table(spark, d, "pages").select("page_id", (text.normalized_url(F.col("url")) == text.normalized_url(other)).alias("same"))


@register("set_02_distinct_hits", f"SELECT key, min(page_id * 3 + variant) AS hit FROM (SELECT page_id, variant, {_W_SCHEME} || '://' || {_W_HOST} || CASE WHEN {_W_PATH} = '' THEN '/' ELSE {_W_PATH} END AS key FROM {_WRITTEN}) GROUP BY key")
def set_02_hits(spark, d):
    """First hit of each URL key; hits come in order of page_id and variant."""
    return _urls_as_written(spark, d).groupBy(text.hit_key(F.col("url")).alias("key")).agg(F.min(F.col("page_id") * 3 + F.col("variant")).alias("hit"))


@register("flt_26_pdf_path", f"SELECT page_id, {_PATH} ILIKE '%.pdf' AS pdf FROM pages")
def flt_26(spark, d):
    return table(spark, d, "pages").select("page_id", F.lower(text.path(F.col("url"))).rlike(r"\.pdf/*$").alias("pdf"))


@register("flt_23_host_in_domains", f"SELECT page_id, (h = 'org' OR h LIKE '%.org' OR h = 'therwh.example.com' OR h LIKE '%.therwh.example.com') AS matches FROM (SELECT page_id, {_HOST} AS h FROM pages)")
def flt_23(spark, d):
    """Host is one of the domains, lies below one, or has a bare top-level domain that is wanted."""
    h, wanted = text.host(F.col("url")), ["org", "therwh.example.com"]
    hit = F.exists(F.array(*map(F.lit, wanted)), lambda w: (h == w) | h.endswith(F.concat(F.lit("."), w)))
    return table(spark, d, "pages").select("page_id", hit.alias("matches"))


@register("flt_22_domain_filters", f"SELECT page_id FROM (SELECT page_id, {_HOST} AS h FROM pages) WHERE (h LIKE '%.example.com' OR h LIKE '%.example.org') AND NOT h LIKE 'm.%' AND NOT h LIKE 'blog.%'")
def flt_22(spark, d):
    h = text.host(F.col("url"))
    return table(spark, d, "pages").where(h.rlike(r"\.example\.(com|org)$") & ~h.rlike(r"^(m|blog)\.")).select("page_id")


#: What makes a chunk look like a list of ports.
LIST_PATTERN = r"port of entry|ports of entry|puertos habilitados|puerto de entrada|ports? d['’ ]?entr[eé]e|portos de entrada|designated port|harbour|harbor|capitan[ií]a|latitud|longitud|gazette|decreto|décret|customs|douane|aduana|\b1[.)]\s+\w+|\b\d+\.\-\s+\w+"
_LIST_SQL = LIST_PATTERN.replace("'", "''")


@register("str_30_list_like_score", f"SELECT doc_id, round(least(1.0, len(regexp_extract_all(coalesce(text, ''), '(?i){_LIST_SQL}')) * 0.18 + least(len(regexp_extract_all(coalesce(text, ''), '\\d+\\.\\d+')), 6) * 0.06), 4)::DOUBLE AS score FROM documents")
def str_30(spark, d):
    return table(spark, d, "documents").select("doc_id", F.round(text.list_like_score(F.coalesce("text", F.lit("")), LIST_PATTERN), 4).alias("score"))


@register("str_09_compound_parts", "SELECT c_custkey, list_filter(string_split_regex(raw, '(?i)\\s*/\\s*|\\s*&\\s*|\\s+and\\s+'), lambda x: x <> '' AND x <> raw) AS parts FROM (SELECT c_custkey, c_mktsegment || ' / ' || c_name || ' and ' || c_mktsegment || ' Quay' AS raw FROM customer)")
def str_09(spark, d):
    """Parts of compound names A / B, A & B, A and B."""
    raw = F.concat("c_mktsegment", F.lit(" / "), "c_name", F.lit(" and "), "c_mktsegment", F.lit(" Quay"))
    return table(spark, d, "customer").select("c_custkey", F.filter(F.split(raw, r"(?i)\s*/\s*|\s*&\s*|\s+and\s+"), lambda x: (x != "") & (x != raw)).alias("parts"))


@register("str_05_alias_name", "SELECT c_custkey, CASE WHEN starts_with(lower(n), 'port of ') THEN substr(n, 9) WHEN starts_with(lower(n), 'haven ') THEN substr(n, 7) ELSE n END AS alias FROM (SELECT c_custkey, trim(regexp_replace(CASE c_custkey % 3 WHEN 0 THEN 'Port of ' WHEN 1 THEN 'Haven ' ELSE '' END || c_name || ' (' || c_mktsegment || ')', '\\s*\\([^)]*\\)\\s*', ' ', 'g')) AS n FROM customer)")
def str_05(spark, d):
    """Name without parentheses and without a prefix that says port."""
    k = F.col("c_custkey") % 3
    full = F.concat(F.when(k == 0, F.lit("Port of ")).when(k == 1, F.lit("Haven ")).otherwise(F.lit("")), F.col("c_name"), F.lit(" ("), F.col("c_mktsegment"), F.lit(")"))
    bare = F.trim(F.regexp_replace(full, r"\s*\([^)]*\)\s*", " "))
    return table(spark, d, "customer").select("c_custkey", F.regexp_replace(bare, r"(?i)^(porto de |port of |port de |pkk porti i |puerto de |haven )(?=.)", "").alias("alias"))


@register("str_49_wkt_pairs", f"SELECT c_custkey, 2 AS pairs, round({LON.format(k='c_custkey')}, 2) AS first_lon, round({LAT.format(k='c_custkey')}, 2) AS first_lat FROM customer")
def str_49(spark, d):
    """Pairs of a WKT line within range; the line's second point has no valid latitude."""
    c = _points(table(spark, d, "customer"), "c_custkey")
    number = lambda x: F.format_string("%.2f", x)
    wkt = F.concat(F.lit("LINESTRING ("), number(F.col("lon")), F.lit(" "), number(F.col("lat")), F.lit(", 10.00 95.50, "), number(-F.col("lon")), F.lit(" "), number(F.col("lat")), F.lit(")"))
    pair = lambda x: F.struct(F.substring_index(x, " ", 1).cast("double").alias("lon"), F.substring_index(x, " ", -1).cast("double").alias("lat"))
    found = F.filter(F.transform(F.regexp_extract_all(wkt, F.lit(r"(-?\d+(?:\.\d+)?\s+-?\d+(?:\.\d+)?)"), F.lit(0)), pair), lambda p: (F.abs(p["lon"]) <= 180) & (F.abs(p["lat"]) <= 90))
    return c.select("c_custkey", found.alias("p")).select("c_custkey", F.size("p").alias("pairs"), F.round(F.get("p", F.lit(0))["lon"], 2).alias("first_lon"), F.round(F.get("p", F.lit(0))["lat"], 2).alias("first_lat"))


@register("str_50_float_of_path", "SELECT s_suppkey, CAST(1900000 + s_suppkey AS VARCHAR) AS wmo, 'aoml' AS dac, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_suppkey % 500 AS INTEGER) END AS cycle FROM supplier")
def str_50(spark, d):
    k = F.col("s_suppkey")
    at = F.concat(F.lit("aoml/"), (k + 1900000).cast("string"), F.lit("/profiles/R"), k.cast("string"), F.when(k % 2 == 0, F.format_string("_%03dD.nc", k % 500)).otherwise(F.lit(".txt")))
    parts = F.split("at", "/")
    cycle = F.regexp_extract("at", r"(?i)_(\d+)D?\.nc$", 1)
    return table(spark, d, "supplier").select("s_suppkey", at.alias("at")).select("s_suppkey", F.when(F.get(parts, F.lit(1)).rlike(r"^\d+$"), F.get(parts, F.lit(1))).alias("wmo"), F.get(parts, F.lit(0)).alias("dac"), F.when(cycle != "", cycle.cast("int")).alias("cycle"))


# ---- filters -------------------------------------------------------------------------------------


@register("flt_10_productive_zone", "SELECT n_nationkey, coalesce(n, 0) > 0 AND (n_nationkey % 2 = 0 OR coalesce(official, false)) AS productive FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n, bool_or(lower(trim(c_mktsegment)) = 'machinery') AS official FROM customer GROUP BY 1) ON c_nationkey = n_nationkey")
def flt_10(spark, d):
    """At least one port, and official sources by flag or by the kind of any source."""
    ports = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count(F.lit(1)).alias("n"), F.collect_set("c_mktsegment").alias("kinds"))
    met = table(spark, d, "nation").join(ports, "n_nationkey", "left")
    official = (F.col("n_nationkey") % 2 == 0) | F.exists(F.coalesce("kinds", F.array().cast("array<string>")), lambda k: F.lower(F.trim(k)) == "machinery")
    return met.select("n_nationkey", ((F.coalesce("n", F.lit(0)) > 0) & official).alias("productive"))


@register("flt_16_parse_bbox", "SELECT c_custkey, w < e AND e - w <= 180 AS valid FROM (SELECT c_custkey, (c_custkey % 300) - 150 AS w, (c_custkey % 300) - 150 + (c_custkey % 7) * 40 - 20 AS e FROM customer)")
def flt_16(spark, d):
    """Whether minx,miny,maxx,maxy has four numbers in order and is not too large."""
    w = F.col("c_custkey") % 300 - 150
    raw = F.concat_ws(" , ", w.cast("string"), F.lit("-10"), (w + F.col("c_custkey") % 7 * 40 - 20).cast("string"), F.lit("20"))
    p = F.transform(F.split(raw, ","), lambda x: F.trim(x).try_cast("double"))
    at = lambda k: F.get("p", F.lit(k))
    ok = (F.size("p") == 4) & (at(0) < at(2)) & (at(1) < at(3)) & (at(2) - at(0) <= 180) & (at(3) - at(1) <= 90)
    return table(spark, d, "customer").select("c_custkey", p.alias("p")).select("c_custkey", F.coalesce(ok, F.lit(False)).alias("valid"))


#: Fixed value: words that mark an official site.
OFFICIAL = r"gov|gouv|gob|douane|customs|aduana|zoll|immigration|border|maritime|port.?authority|coast.?guard|admin"


@register("flt_24_foreign_government", f"""
SELECT page_id, v AS variant, regexp_matches(h, '(?i){OFFICIAL}') AND ((length(s) = 2 AND s <> 'fr') OR s = 'gov') AS is_foreign
FROM (SELECT page_id, v, h, lower(split_part(h, '.', -1)) AS s FROM (
  SELECT page_id, v, CASE v WHEN 0 THEN host WHEN 1 THEN 'customs.' || split_part(host, '.', 1) || '.gov' WHEN 2 THEN 'douane.' || split_part(host, '.', 1) || '.fr' ELSE split_part(host, '.', 1) || '.gov.ph' END AS h
  FROM (SELECT page_id, {_HOST} AS host FROM pages), (VALUES (0), (1), (2), (3)) t(v)))""")
def flt_24(spark, d):
    """State sites of a country other than France: each page's host, and its first label under domains of three states."""
    host = text.host(F.col("url"))
    label = F.substring_index(host, ".", 1)
    domains = F.array(host, F.concat(F.lit("customs."), label, F.lit(".gov")), F.concat(F.lit("douane."), label, F.lit(".fr")), F.concat(label, F.lit(".gov.ph")))
    each = table(spark, d, "pages").select("page_id", F.posexplode(domains).alias("variant", "domain"))
    suffix = F.lower(F.substring_index("domain", ".", -1))
    foreign = ((F.length(suffix) == 2) & ~suffix.isin("fr")) | ((suffix == "gov") & ~F.array_contains(F.array(F.lit("fr")), "us"))
    return each.select("page_id", "variant", (F.col("domain").rlike(f"(?i){OFFICIAL}") & foreign).alias("is_foreign"))


@register("flt_35_stale_zone", "SELECT event_id, date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-03-01 00:00:00') > 30 * 86400 AS stale FROM events")
def flt_35(spark, d):
    return table(spark, d, "events").select("event_id", (F.unix_timestamp(F.lit("2024-03-01 00:00:00").cast("timestamp")) - F.unix_timestamp("ts") > 30 * 86400).alias("stale"))


@register("flt_36_fresh_tile", "SELECT event_id, epoch(TIMESTAMP '2024-03-01 00:00:00') - epoch(ts) < 14 * 86400 AS fresh FROM events")
def flt_36(spark, d):
    age = (F.unix_micros(F.lit("2024-03-01 00:00:00").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 1e6
    return table(spark, d, "events").select("event_id", (age < 14 * 86400).alias("fresh"))


@register("flt_15_bbox_overlap", f"SELECT c_custkey, (lo <= 20 AND lo + 5 >= -60 AND la <= 50 AND la + 5 >= 10) OR (lo <= -130 AND lo + 5 >= -170) AS hit FROM (SELECT c_custkey, {LON.format(k='c_custkey')} AS lo, {LAT.format(k='c_custkey')} AS la FROM customer)")
def flt_15(spark, d):
    """Whether a 5 degree box overlaps one of two fixed boxes (west, south, east, north)."""
    c = _points(table(spark, d, "customer"), "c_custkey")
    meets = lambda w, s, e, n: (F.col("lon") <= e) & (F.col("lon") + 5 >= w) & (F.col("lat") <= n) & (F.col("lat") + 5 >= s)
    return c.select("c_custkey", (meets(-60, 10, 20, 50) | meets(-170, -90, -130, 90)).alias("hit"))


# ---- counters, verdicts and reports --------------------------------------------------------------


@register("agg_05_status_summary", "SELECT o_orderstatus AS status, count(*) AS zones, round(sum(o_totalprice), 2) AS ports FROM orders GROUP BY 1")
def agg_05(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count(F.lit(1)).alias("zones"), F.round(F.sum("o_totalprice"), 2).alias("ports"))


@register("agg_08_science_counts", "SELECT count(*) AS total, count(*) FILTER (source IS NOT NULL) AS sourced, count(DISTINCT lang) AS kinds, count(*) FILTER (lang = 'en') AS english, count(*) FILTER (coalesce(text, '') <> '') AS located FROM documents")
def agg_08(spark, d):
    return table(spark, d, "documents").agg(F.count(F.lit(1)).alias("total"), F.count("source").alias("sourced"), F.count_distinct("lang").alias("kinds"), F.count_if(F.col("lang") == "en").alias("english"), F.count_if(F.coalesce("text", F.lit("")) != "").alias("located"))


@register("agg_09_coverage", "SELECT round(100.0 * count(*) FILTER (c_acctbal > 0) / count(*), 1) AS pct FROM customer")
def agg_09(spark, d):
    return table(spark, d, "customer").agg(F.round(100.0 * F.count_if(F.col("c_acctbal") > 0) / F.count(F.lit(1)), 1).alias("pct"))


@register("agg_13_percent", "SELECT c_mktsegment, printf('%.1f %%', 100.0 * count(*) FILTER (c_acctbal > 5000) / count(*)) AS share FROM customer GROUP BY 1")
def agg_13(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.format_string("%.1f %%", 100.0 * F.count_if(F.col("c_acctbal") > 5000) / F.count(F.lit(1))).alias("share"))


@register("agg_14_verdicts_and_steps", "SELECT 'verdict' AS what, o_orderstatus AS name, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'step', o_orderpriority, count(*) FROM orders GROUP BY 2")
def agg_14(spark, d):
    o = table(spark, d, "orders")
    count = lambda what, c: o.groupBy(F.lit(what).alias("what"), F.col(c).alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return count("verdict", "o_orderstatus").unionByName(count("step", "o_orderpriority"))


@register("agg_16_compare_verdicts", """
WITH h AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'keep' ELSE 'drop' END AS human FROM labels), p AS (SELECT doc_id, CASE WHEN n_chars >= 1000 THEN 'keep' ELSE 'drop' END AS prop FROM documents WHERE doc_id % 3 <> 0)
SELECT doc_id, human, coalesce(prop, 'omit') AS proposer, CASE WHEN human = prop THEN 'agreed' WHEN human = 'keep' OR prop = 'keep' THEN 'error' END AS outcome FROM h LEFT JOIN p USING (doc_id)""")
def agg_16(spark, d):
    """A reviewer's verdicts against proposed ones; omitted proposals count only against a keep."""
    h = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "keep").otherwise("drop").alias("human"))
    p = table(spark, d, "documents").where("doc_id % 3 <> 0").select("doc_id", F.when(F.col("n_chars") >= 1000, "keep").otherwise("drop").alias("prop"))
    outcome = F.when(F.col("human") == F.col("prop"), "agreed").when((F.col("human") == "keep") | (F.col("prop") == "keep"), "error")
    return h.join(p, "doc_id", "left").select("doc_id", "human", F.coalesce("prop", F.lit("omit")).alias("proposer"), outcome.alias("outcome"))


_TOKENS = "list_distinct(list_filter(string_split(translate(lower({p}), '.-_', '///'), '/'), lambda t: length(t) >= 4 AND NOT t IN ('html', 'index', 'http', 'https', 'page', 'pages', 'file', 'files', 'public', 'upload', 'uploads', 'content', 'node', 'sites', 'default', 'home', 'accueil', 'docx', 'aspx') AND NOT regexp_matches(t, '^\\d+$')))"
_TOKEN_PATH = "'/ports-of-entry/' || regexp_extract(url, '^[a-z]+://([^/]*)', 1) || '/decree.pdf'"


def _path_tokens(pages):
    skip = ["html", "index", "http", "https", "page", "pages", "file", "files", "public", "upload", "uploads", "content", "node", "sites", "default", "home", "accueil", "docx", "aspx"]
    at = F.lower(F.concat(F.lit("/ports-of-entry/"), F.regexp_extract("url", "^[a-z]+://([^/]*)", 1), F.lit("/decree.pdf")))
    keep = lambda t: (F.length(t) >= 4) & ~t.isin(skip) & ~t.rlike(r"^\d+$")
    return pages.select("page_id", F.explode(F.array_distinct(F.filter(F.split(F.translate(at, ".-_", "///"), "/"), keep))).alias("token"))


@register("agg_17_token_scores", f"SELECT token, round(sum(CASE WHEN page_id % 2 = 0 THEN 0.15 ELSE -0.2 END), 4)::DOUBLE AS score FROM (SELECT page_id, unnest({_TOKENS.format(p=_TOKEN_PATH)}) AS token FROM pages) GROUP BY token")
def agg_17_tokens(spark, d):
    """Score of each path token: 0.15 for a kept URL, -0.2 for a dropped one."""
    t = _path_tokens(table(spark, d, "pages"))
    return t.groupBy("token").agg(F.round(F.sum(F.when(F.col("page_id") % 2 == 0, 0.15).otherwise(-0.2)), 4).alias("score"))


@register("agg_18_code_hints", f"""
WITH t AS (SELECT token, count(*) FILTER (page_id % 3 = 0) AS k, count(*) FILTER (page_id % 3 <> 0) AS x FROM (SELECT page_id, unnest({_TOKENS.format(p=_TOKEN_PATH)}) AS token FROM pages) GROUP BY token)
SELECT token, CASE WHEN x > k THEN 'drop' ELSE 'keep' END AS human, greatest(k, x) AS n FROM t WHERE greatest(k, x) >= 2 AND k <> x""")
def agg_18(spark, d):
    """Tokens that at least two pages hold, most of them kept or most of them dropped."""
    t = _path_tokens(table(spark, d, "pages")).groupBy("token").agg(F.count_if(F.col("page_id") % 3 == 0).alias("k"), F.count_if(F.col("page_id") % 3 != 0).alias("x"))
    return t.where("greatest(k, x) >= 2 AND k <> x").select("token", F.when(F.col("x") > F.col("k"), "drop").otherwise("keep").alias("human"), F.greatest("k", "x").alias("n"))


@register("geo_50_seed_verdict", """
SELECT c_custkey, CASE WHEN l AND e AND g THEN 'confirmed' WHEN l AND e THEN 'probable' WHEN l THEN 'name_only' WHEN e AND g AND (osm >= 0.5 OR n >= 2) THEN 'probable' ELSE 'unverified' END AS verdict
FROM (SELECT c_custkey, c_custkey % 2 = 0 AS l, c_custkey % 3 < 2 AS e, c_custkey % 5 < 3 AS g, CASE WHEN c_custkey % 7 < 5 THEN (c_custkey % 10) / 10.0 ELSE -1 END AS osm, c_custkey % 4 AS n FROM customer)""")
def geo_50_seed(spark, d):
    """Verdict of a seed from listing, extraction, coordinates, confidence and number of extracted sources."""
    k = F.col("c_custkey")
    listed, extracted, located = k % 2 == 0, k % 3 < 2, k % 5 < 3
    sure = F.coalesce(F.when(k % 7 < 5, k % 10 / 10.0) >= 0.5, F.lit(False)) | (k % 4 >= 2)
    verdict = F.when(listed, F.when(~extracted, "name_only").when(located, "confirmed").otherwise("probable")).when(extracted & located & sure, "probable").otherwise("unverified")
    return table(spark, d, "customer").select("c_custkey", verdict.alias("verdict"))


@register("agg_26_verdict_buckets", "SELECT v AS verdict, count(c_custkey) AS n FROM (VALUES ('confirmed'), ('probable'), ('unverified'), ('name_only')) t(v) LEFT JOIN (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'confirmed' WHEN c_custkey % 3 = 0 THEN 'probable' ELSE 'unverified' END AS w FROM customer) ON v = w GROUP BY v")
def agg_26(spark, d):
    """Counts of the fixed verdicts, zero where there are none."""
    k = F.col("c_custkey")
    found = table(spark, d, "customer").groupBy(F.when(k % 2 == 0, "confirmed").when(k % 3 == 0, "probable").otherwise("unverified").alias("verdict")).agg(F.count(F.lit(1)).alias("n"))
    fixed = spark.createDataFrame([(v,) for v in ("confirmed", "probable", "unverified", "name_only")], "verdict string")
    return fixed.join(found, "verdict", "left").select("verdict", F.coalesce("n", F.lit(0)).alias("n"))


@register("agg_28_zone_confidence", "SELECT c_nationkey, CAST(round_even(avg(c_acctbal) FILTER (c_acctbal >= 0), 0) AS BIGINT) AS confidence FROM customer GROUP BY 1")
def agg_28(spark, d):
    return table(spark, d, "customer").groupBy("c_nationkey").agg(F.bround(F.avg(F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal"))), 0).cast("long").alias("confidence"))


@register("agg_30_search_agreement", f"""
WITH p AS (SELECT page_id % 50 AS zone, CASE WHEN page_id % 3 = 0 THEN 'both' WHEN page_id % 3 = 1 THEN 'a' ELSE 'b' END AS engine, {_NORMAL} AS u, {_HOST} AS h FROM pages),
s AS (SELECT zone, list_distinct(list(u) FILTER (engine <> 'b')) AS ua, list_distinct(list(u) FILTER (engine <> 'a')) AS ub, list_distinct(list(h) FILTER (engine <> 'b')) AS ha, list_distinct(list(h) FILTER (engine <> 'a')) AS hb FROM p GROUP BY zone),
j AS (SELECT zone, coalesce(len(ua), 0) AS n_a, coalesce(len(ub), 0) AS n_b, len(list_intersect(coalesce(ua, []), coalesce(ub, []))) AS iu, len(list_distinct(list_concat(coalesce(ua, []), coalesce(ub, [])))) AS uu, len(list_intersect(coalesce(ha, []), coalesce(hb, []))) AS ih, len(list_distinct(list_concat(coalesce(ha, []), coalesce(hb, [])))) AS uh FROM s)
SELECT zone, n_a, n_b, round(CASE WHEN uu = 0 THEN 1.0 ELSE iu / uu END, 3) AS jaccard_urls, round(CASE WHEN uh = 0 THEN 1.0 ELSE ih / uh END, 3) AS jaccard_domains, n_a >= 3 AND n_b >= 3 AND round(CASE WHEN uh = 0 THEN 1.0 ELSE ih / uh END, 3) < 0.3 AS discordant FROM j""")
def agg_30_agreement(spark, d):
    """Agreement of two engines per zone by URL and by domain; small result sets are never discordant."""
    k = F.col("page_id") % 3
    p = table(spark, d, "pages").select((F.col("page_id") % 50).alias("zone"), (k != 2).alias("in_a"), (k != 1).alias("in_b"), text.normalized_url(F.col("url")).alias("u"), text.host(F.col("url")).alias("h"))
    count = lambda key, names: p.groupBy("zone", key).agg(F.bool_or("in_a").alias("a"), F.bool_or("in_b").alias("b")).groupBy("zone").agg(F.count_if("a").alias(f"{names}a"), F.count_if("b").alias(f"{names}b"), F.count_if(F.col("a") & F.col("b")).alias(f"{names}i"), F.count(F.lit(1)).alias(f"{names}u"))
    met = count("u", "u").join(count("h", "h"), "zone")
    domains = F.round(F.when(F.col("hu") == 0, 1.0).otherwise(F.col("hi") / F.col("hu")), 3)
    return met.select("zone", F.col("ua").alias("n_a"), F.col("ub").alias("n_b"), F.round(F.when(F.col("uu") == 0, 1.0).otherwise(F.col("ui") / F.col("uu")), 3).alias("jaccard_urls"), domains.alias("jaccard_domains"), ((F.col("ua") >= 3) & (F.col("ub") >= 3) & (domains < 0.3)).alias("discordant"))


@register("agg_33_domain_order", f"SELECT h AS domain, n, reliability, rank() OVER (ORDER BY reliability DESC, n DESC, h) AS place FROM (SELECT {_HOST} AS h, count(*) AS n, round(count(*) FILTER (length(html) > 1000) / count(*), 4) AS reliability FROM pages GROUP BY 1 HAVING count(*) >= 2)")
def agg_33(spark, d):
    """Domains by reliability, then volume, then name, with their places."""
    g = table(spark, d, "pages").groupBy(text.host(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("n"), F.round(F.count_if(F.length("html") > 1000) / F.count(F.lit(1)), 4).alias("reliability")).where("n >= 2")
    return g.withColumn("place", F.rank().over(Window.orderBy(F.desc("reliability"), F.desc("n"), "domain")))


@register("agg_35_engine_difference", "SELECT user_id AS leg, round(median(abs(a - b)), 4) AS median_gap FROM (SELECT user_id, date_trunc('hour', ts) AS t, sum(value) FILTER (event_type = 'click') AS a, sum(value) FILTER (event_type <> 'click') AS b FROM events GROUP BY 1, 2) WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def agg_35(spark, d):
    """Median absolute difference of two engines over the samples that both have."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("leg"), F.date_trunc("hour", "ts").alias("t")).agg(F.sum(F.when(F.col("event_type") == "click", F.col("value"))).alias("a"), F.sum(F.when(F.col("event_type") != "click", F.col("value"))).alias("b"))
    return e.where("a IS NOT NULL AND b IS NOT NULL").groupBy("leg").agg(F.round(F.median(F.abs(F.col("a") - F.col("b"))), 4).alias("median_gap"))


@register("agg_38_recommended_run", "SELECT user_id AS run, count(DISTINCT event_type) AS zones, max(ts) AS latest FROM events GROUP BY 1 ORDER BY zones DESC, latest DESC, run LIMIT 1")
def agg_38(spark, d):
    """The run with most zones, then the latest."""
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg(F.count_distinct("event_type").alias("zones"), F.max("ts").alias("latest"))
    return g.orderBy(F.desc("zones"), F.desc("latest"), "run").limit(1)


@register("agg_42_by_source", "SELECT source, count(*) AS n FROM documents GROUP BY 1")
def agg_42(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@register("agg_43_latest_per_key", "SELECT event_type, props, max(ts) AS latest FROM events GROUP BY 1, 2")
def agg_43(spark, d):
    return table(spark, d, "events").groupBy("event_type", "props").agg(F.max("ts").alias("latest"))


@register("agg_44_mean_direction", "SELECT l_returnflag, round((degrees(atan2(sum(sin(radians(l_partkey % 360))), sum(cos(radians(l_partkey % 360))))) + 360) % 360, 3) AS direction FROM lineitem GROUP BY 1")
def agg_44_mean(spark, d):
    a = F.radians(F.col("l_partkey") % 360)
    return table(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.pmod(F.degrees(F.atan2(F.sum(F.sin(a)), F.sum(F.cos(a)))) + 360.0, F.lit(360.0)), 3).alias("direction"))


@register("snk_01_fill_missing", "SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END, ''), nullif(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END, ''), CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END) AS name, CASE WHEN c_custkey % 2 = 0 THEN ['a'] ELSE ['b'] END AS tags FROM customer")
def snk_01_fill(spark, d):
    """Merge of two rows that fills only what is null, empty text or an empty array."""
    c, k = table(spark, d, "customer"), F.col("c_custkey")
    old = c.select("c_custkey", F.when(k % 3 == 0, F.lit("")).when(k % 5 == 0, F.lit(None)).otherwise(F.col("c_mktsegment")).alias("name"), F.when(k % 2 == 0, F.array(F.lit("a"))).otherwise(F.array().cast("array<string>")).alias("tags"))
    new = c.select("c_custkey", F.when(k % 4 == 0, F.lit("")).otherwise(F.col("c_name")).alias("new_name"), F.array(F.lit("b")).alias("new_tags"))
    met = old.join(new, "c_custkey", "left")
    fill = lambda cur, inc: F.coalesce(F.nullif(cur, F.lit("")), F.nullif(inc, F.lit("")), cur)
    return met.select("c_custkey", fill(F.col("name"), F.col("new_name")).alias("name"), F.when(F.coalesce(F.size("tags"), F.lit(0)) > 0, F.col("tags")).otherwise(F.col("new_tags")).alias("tags"))


@register("set_04_merge_sources", "SELECT o_custkey, list_sort(list_distinct(list(o_orderstatus) FILTER (o_orderstatus <> 'P'))) AS sources FROM orders WHERE o_orderstatus <> '' GROUP BY 1 HAVING count(*) FILTER (o_orderstatus <> 'P') > 0")
def set_04(spark, d):
    """Union of source labels without the composite one."""
    g = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.array_except(F.collect_set("o_orderstatus"), F.array(F.lit("P"), F.lit("")))).alias("sources"))
    return g.where(F.size("sources") > 0)


@register("set_08_paid_urls", f"SELECT u AS url, count(*) AS n, list_sort(list_distinct(list(page_id % 10))) AS zones FROM (SELECT page_id, {_NORMAL} AS u FROM pages) GROUP BY u")
def set_08(spark, d):
    """Distinct URLs with their number of uses and the zones that use them (ten at most)."""
    return table(spark, d, "pages").groupBy(text.normalized_url(F.col("url")).alias("url")).agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set(F.col("page_id") % 10)).alias("zones"))


@register("set_09_to_do", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def set_09(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@register("srt_03_stable_first", "SELECT n_nationkey, row_number() OVER (ORDER BY CASE n_nationkey WHEN 7 THEN 0 WHEN 3 THEN 1 WHEN 12 THEN 2 ELSE 3 END, lower(n_name), n_nationkey) AS place FROM nation")
def srt_03(spark, d):
    """Zones of a fixed list first, in its order, then by name."""
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", F.row_number().over(Window.orderBy(F.when(k == 7, 0).when(k == 3, 1).when(k == 12, 2).otherwise(3), F.lower("n_name"), "n_nationkey")).alias("place"))


@register("srt_07_events_page", "SELECT event_id, ts FROM events WHERE event_type = 'error' ORDER BY event_id OFFSET 20 LIMIT 50")
def srt_07(spark, d):
    return table(spark, d, "events").where("event_type = 'error'").orderBy("event_id").offset(20).limit(50).select("event_id", "ts")


@register("srt_17_reports_page", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey OFFSET 10 LIMIT 25")
def srt_17(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").offset(10).limit(25).select("o_orderkey", "o_orderdate")


@register("win_12_one_per_domain", f"SELECT page_id, h AS domain FROM (SELECT page_id, {_HOST} AS h, row_number() OVER (PARTITION BY {_HOST} ORDER BY {_PATH} ILIKE '%/en/%' DESC, page_id) AS r FROM pages) WHERE r = 1")
def win_12(spark, d):
    """One page of each domain, list pages first."""
    listed = text.path(F.col("url")).rlike("(?i)/en/")
    best = F.min(F.struct((~listed).alias("rest"), "page_id"))
    return table(spark, d, "pages").groupBy(text.host(F.col("url")).alias("domain")).agg(best.alias("b")).select("b.page_id", "domain")


@register("stm_02_resume_seq", "SELECT user_id AS run, max(event_id) + 1 AS next_seq FROM events GROUP BY 1")
def stm_02(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("run")).agg((F.max("event_id") + 1).alias("next_seq"))


@register("stm_04_counters", "SELECT user_id AS run, event_type AS key, count(*) AS n FROM events GROUP BY 1, 2")
def stm_04(spark, d):
    return table(spark, d, "events").groupBy(F.col("user_id").alias("run"), F.col("event_type").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@register("stm_06_cache_ttl", "SELECT event_id, date_diff('second', date_trunc('second', ts), TIMESTAMP '2024-06-01 00:00:00') < CASE WHEN event_type = 'error' THEN 14 ELSE 180 END * 86400 AS alive FROM events")
def stm_06(spark, d):
    """Hits of a cache live 180 days, misses 14."""
    age = F.unix_timestamp(F.lit("2024-06-01 00:00:00").cast("timestamp")) - F.unix_timestamp("ts")
    return table(spark, d, "events").select("event_id", (age < F.when(F.col("event_type") == "error", 14).otherwise(180) * 86400).alias("alive"))


# ---- geometry and dates --------------------------------------------------------------------------

_UV = "SELECT l_orderkey, l_linenumber, l_quantity - 25 AS u, (l_partkey % 50) - 25.5 AS v FROM lineitem"


@register("geo_29_current", f"SELECT l_orderkey, l_linenumber, round(sqrt(u * u + v * v) * {geo.KNOTS}, 4) AS knots, round((degrees(atan2(u, v)) + 360) % 360, 3) AS toward FROM ({_UV})")
def geo_29(spark, d):
    knots, toward = geo.current_to_uv(F.col("l_quantity") - 25, F.col("l_partkey") % 50 - 25.5)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(knots, 4).alias("knots"), F.round(toward, 3).alias("toward"))


@register("geo_08_unwrap", f"SELECT c_custkey, round(CASE WHEN x - 170 > 180 THEN x - 360 WHEN x - 170 < -180 THEN x + 360 ELSE x END, 4) AS lon FROM (SELECT c_custkey, {LON.format(k='c_custkey')} AS x FROM customer)")
def geo_08(spark, d):
    return _points(table(spark, d, "customer"), "c_custkey").select("c_custkey", F.round(geo.unwrap_lon(F.lit(170.0), F.col("lon")), 4).alias("lon"))


@register("geo_42_blend", "SELECT s_suppkey, round((a + ((b - a + 540) % 360 - 180) * 0.25 + 360) % 360, 4) AS direction FROM (SELECT s_suppkey, CAST(s_suppkey * 37 % 360 AS DOUBLE) AS a, CAST(s_suppkey * 101 % 360 AS DOUBLE) AS b FROM supplier)")
def geo_42(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", F.round(geo.blend_direction((k * 37 % 360).cast("double"), (k * 101 % 360).cast("double"), F.lit(0.25)), 4).alias("direction"))


@register("geo_11_mercator", "SELECT c_custkey, round(atan(exp(y / 20037508.34 * pi())) * 360 / pi() - 90, 5) AS lat, round(x / 20037508.34 * 180, 5) AS lon FROM (SELECT c_custkey, (c_custkey % 4000 - 2000) * 10000.0 AS x, (c_custkey * 7 % 3000 - 1500) * 10000.0 AS y FROM customer)")
def geo_11(spark, d):
    k = F.col("c_custkey")
    lat, lon = geo.mercator_to_wgs84((k % 4000 - 2000) * 10000.0, (k * 7 % 3000 - 1500) * 10000.0)
    return table(spark, d, "customer").select("c_custkey", F.round(lat, 5).alias("lat"), F.round(lon, 5).alias("lon"))


@register("geo_16_segment_distance", f"SELECT c_custkey, round((SELECT min({_hav('la', 'lo', '10 + k / 8.0 * -30', '((-20 + k / 8.0 * 60 + 180) % 360) - 180', geo.EARTH_NM)}) FROM range(0, 9) t(k)), 3) AS nm FROM (SELECT c_custkey, {LAT.format(k='c_custkey')} AS la, {LON.format(k='c_custkey')} AS lo FROM customer)")
def geo_16(spark, d):
    """Distance to the segment from (10, -20) to (-20, 40)."""
    at = [F.lit(x) for x in (10.0, -20.0, -20.0, 40.0)]
    return _points(table(spark, d, "customer"), "c_custkey").select("c_custkey", F.round(geo.segment_nm(F.col("lat"), F.col("lon"), *at), 3).alias("nm"))


@register("geo_45_gale", f"SELECT c_custkey, CASE WHEN la < -40 THEN CASE WHEN m IN (6, 7, 8) THEN 0.55 ELSE 0.40 END WHEN la >= -40 AND la < -30 THEN 0.25 WHEN la >= 40 AND la <= 60 THEN CASE WHEN m IN (11, 12, 1, 2, 3) THEN 0.35 ELSE 0.10 END WHEN la >= 5 AND la <= 25 THEN 0.05 ELSE 0.12 END::DOUBLE AS p FROM (SELECT c_custkey, {LAT.format(k='c_custkey')} AS la, c_custkey % 12 + 1 AS m FROM customer)")
def geo_45(spark, d):
    return _points(table(spark, d, "customer"), "c_custkey").select("c_custkey", geo.gale_probability(F.col("lat"), F.col("c_custkey") % 12 + 1).cast("double").alias("p"))


_RING = "[[lo, la], [lo + w, la], [lo + w, la + w], [lo, la + 2 * w], [lo, la]]"


@register("geo_20_ring_area", f"SELECT c_custkey, round(w * w * 1.5, 4)::DOUBLE AS area FROM (SELECT c_custkey, c_custkey % 9 + 1.0 AS w FROM customer)")
def geo_20(spark, d):
    """Shoelace area of a ring of five points: a square with a triangle on one side."""
    c = _points(table(spark, d, "customer"), "c_custkey").withColumn("w", F.col("c_custkey") % 9 + 1.0)
    x, y, w = F.col("lon"), F.col("lat"), F.col("w")
    ring = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (x + w, y), (x + w, y + w), (x, y + 2 * w), (x, y))])
    cross = F.aggregate(F.sequence(F.lit(0), F.size("ring") - 2), F.lit(0.0), lambda s, i: s + F.get("ring", i)["x"] * F.get("ring", i + 1)["y"] - F.get("ring", i + 1)["x"] * F.get("ring", i)["y"])
    return c.select("c_custkey", ring.alias("ring")).select("c_custkey", F.round(F.abs(cross) / 2, 4).alias("area"))


@register("geo_24_bbox_centre", "SELECT c_custkey, CASE WHEN m > 180 THEN m - 360 WHEN m < -180 THEN m + 360 ELSE m END AS lon FROM (SELECT c_custkey, (c_custkey % 360 - 180 + c_custkey % 360 - 180 + c_custkey % 90) / 2.0 AS m FROM customer)")
def geo_24(spark, d):
    w = F.col("c_custkey") % 360 - 180
    m = (w + w + F.col("c_custkey") % 90) / 2.0
    return table(spark, d, "customer").select("c_custkey", F.when(m > 180, m - 360).when(m < -180, m + 360).otherwise(m).alias("lon"))


@register("dat_01_parse_iso", "SELECT event_id, epoch_us(ts) // 1000000 AS seconds FROM events")
def dat_01(spark, d):
    """Seconds of an ISO text with a Z, read as UTC."""
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, d, "events").select("event_id", F.unix_timestamp(F.to_timestamp(iso, "yyyy-MM-dd'T'HH:mm:ssX")).alias("seconds"))


@register("dat_03_parse_month", "SELECT c_custkey, CASE WHEN c_custkey % 15 BETWEEN 1 AND 12 THEN CAST(c_custkey % 15 AS INTEGER) END AS month FROM customer")
def dat_03(spark, d):
    """Month 1 to 12 of a text, null where it is none."""
    m = F.when(F.col("c_custkey") % 15 == 14, F.lit("x")).otherwise((F.col("c_custkey") % 15).cast("string")).try_cast("int")
    return table(spark, d, "customer").select("c_custkey", F.when(m.between(1, 12), m).alias("month"))


@register("dat_06_next_download", "SELECT event_id, epoch_us(time_bucket(INTERVAL 6 hours, ts - INTERVAL 4 hours, TIMESTAMP '2000-01-01 00:00:00') + INTERVAL 10 hours) // 1000000 AS ready FROM events")
def dat_06(spark, d):
    """Next instant at which a forecast cycle of 00, 06, 12 or 18 h is ready, 4 h after its start."""
    t = F.unix_timestamp("ts")
    return table(spark, d, "events").select("event_id", (F.floor((t - 4 * 3600) / (6 * 3600)) * 6 * 3600 + 10 * 3600).cast("long").alias("ready"))


@register("arr_02_kept_tags", "SELECT p_partkey, list_sort(list_filter([CASE WHEN p_size > 20 THEN 'name' END, 'phone', CASE WHEN p_size % 2 = 0 THEN 'website' END], lambda x: x IS NOT NULL)) AS keys FROM part")
def arr_02(spark, d):
    """Keys of a tag map that are wanted and have a value."""
    tags = F.create_map(F.lit("name"), F.when(F.col("p_size") > 20, "x"), F.lit("phone"), F.lit("1"), F.lit("website"), F.when(F.col("p_size") % 2 == 0, "w"), F.lit("colour"), F.lit("red"))
    kept = F.map_filter(tags, lambda k, v: k.isin("name", "phone", "website") & v.isNotNull())
    return table(spark, d, "part").select("p_partkey", F.array_sort(F.map_keys(kept)).alias("keys"))


@register("arr_13_number_in_text", "SELECT doc_id, regexp_matches(coalesce(text, ''), '(^|[^0-9.])' || (doc_id % 10) || '([^0-9.]|$)') AS found FROM documents")
def arr_13(spark, d):
    """Whether a number stands in a text on its own."""
    pattern = F.concat(F.lit("(^|[^0-9.])"), (F.col("doc_id") % 10).cast("string"), F.lit("([^0-9.]|$)"))
    return table(spark, d, "documents").select("doc_id", F.regexp_like(F.coalesce("text", F.lit("")), pattern).alias("found"))


# ---- geometry and text of single rows --------------------------------------------------------------

_NEXT = "(c_custkey + 1)"


@register(
    "geo_03_haversine_metres",
    f"SELECT c_custkey, round({_hav(LAT.format(k='c_custkey'), LON.format(k='c_custkey'), LAT.format(k=_NEXT), LON.format(k=_NEXT), geo.EARTH_METRES)} / {geo.NM_METRES}, 6) AS nm FROM customer",
)
def geo_03(spark, d):
    """Distance of each port to the next key's point, by the radius in metres."""
    k = F.col("c_custkey")
    return _points(table(spark, d, "customer"), "c_custkey").select("c_custkey", F.round(geo.haversine_metres(F.col("lat"), F.col("lon"), geo.synthetic_lat(k + 1), geo.synthetic_lon(k + 1)) / geo.NM_METRES, 6).alias("nm"))


@register(
    "geo_21_ring_centroid",
    f"SELECT c_custkey, round({LON.format(k='c_custkey')} + CASE WHEN w = 0 THEN 0 ELSE 4 * w / 9 END, 6)::DOUBLE AS lon, round({LAT.format(k='c_custkey')} + CASE WHEN w = 0 THEN 0 ELSE 7 * w / 9 END, 6)::DOUBLE AS lat FROM (SELECT c_custkey, (c_custkey % 9)::DOUBLE AS w FROM customer)",
)
def geo_21(spark, d):
    """Centroid of a ring of five points; rings without area (width 0) give their first point. The oracle has it in closed form."""
    c = _points(table(spark, d, "customer"), "c_custkey").withColumn("w", (F.col("c_custkey") % 9).cast("double"))
    x, y, w = F.col("lon"), F.col("lat"), F.col("w")
    ring = F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x, y), (x + w, y), (x + w, y + w), (x, y + 2 * w), (x, y))])
    at = geo.ring_centroid(F.col("ring"))
    return c.select("c_custkey", ring.alias("ring")).select("c_custkey", at.alias("at")).select("c_custkey", F.round("at.x", 6).alias("lon"), F.round("at.y", 6).alias("lat"))


_BOX = f"SELECT c_custkey % 500 AS box, {LON.format(k='c_custkey')} AS lon, {LAT.format(k='c_custkey')} AS lat FROM customer"
_BOXES = f"SELECT box, min(lon) AS w, max(lon) AS e, min(lat) AS s, max(lat) AS n, min(CASE WHEN lon < 0 THEN lon + 360 ELSE lon END) AS w2, max(CASE WHEN lon < 0 THEN lon + 360 ELSE lon END) AS e2 FROM ({_BOX}) GROUP BY box"
_SHIFT = f"SELECT *, e - w > 180 AND e2 - w2 > 1e-6 AND e2 - w2 < e - w AS wraps, CASE WHEN w2 > 180 THEN w2 - 360 ELSE w2 END AS w3, CASE WHEN e2 > 180 THEN e2 - 360 ELSE e2 END AS e3 FROM ({_BOXES})"


@register("geo_23_bbox_of_pairs", f"SELECT box, round(CASE WHEN wraps THEN w3 ELSE w END, 6) AS west, round(s, 6) AS south, round(CASE WHEN NOT wraps THEN e WHEN e3 < w3 THEN e3 + 360 ELSE e3 END, 6) AS east, round(n, 6) AS north FROM ({_SHIFT})")
def geo_23(spark, d):
    """Bounding box of each group of points, over the antimeridian where that is narrower: minima and maxima combine before the shuffle."""
    found = geo.bbox_of_points(_points(table(spark, d, "customer"), "c_custkey").withColumn("box", F.col("c_custkey") % 500), "box")
    return found.select("box", *[F.round(c, 6).alias(c) for c in ("west", "south", "east", "north")])


#: Words of a navigation rule.
NAVIGATION_WORDS = r"vhf|canal|channel|interdiction|no[\s-]?anchor|mouill|port d['’]entr|tirant|draft|draught|harbour.?master"
_EDGE = r"[^\p{L}\p{N}_]"
_RULE = rf"(?i)(^|{_EDGE})({NAVIGATION_WORDS})({_EDGE}|$)"
_RULE_SQL = _RULE.replace("'", "''")


@register("str_28_navigation_rule", f"SELECT doc_id, regexp_matches(CASE WHEN doc_id % 7 = 0 THEN concat_ws(' ', text, 'VHF channel 12') ELSE coalesce(text, '') END, '{_RULE_SQL}') AS rule FROM documents")
def str_28(spark, d):
    """Whether a text states a navigation rule; every seventh text gets such a sentence, for the tables may hold none."""
    said = F.when(F.col("doc_id") % 7 == 0, F.concat_ws(" ", "text", F.lit("VHF channel 12"))).otherwise(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", said.rlike(_RULE).alias("rule"))
