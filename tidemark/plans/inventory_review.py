"""Queries of single survey rows: review predicates, cluster choices, coordinates, and document updates.

Roles as in inventory; labels hold overrides, customers and suppliers are harbours with coordinates
made from their keys, the lines of an order are a cluster of reports of one port.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions import geo, text
from tidemark.plans.catalog import register
from tidemark.plans.inventory import LAT, LON, _hav, _points
from tidemark.sources.tables import dms, table

# ---- predicates ----------------------------------------------------------------------------------


@register("flt_05_override_on", "SELECT d.doc_id, coalesce(quality = 1, false) AS gold FROM documents d LEFT JOIN labels USING (doc_id)")
def flt_05(spark, d):
    """Whether an override is on; without one it is off."""
    gold = F.coalesce(F.col("quality") == 1, F.lit(False))
    return table(spark, d, "documents").select("doc_id").join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").select("doc_id", gold.alias("gold"))


_VALID = f"{LAT.format(k='c_custkey')} BETWEEN -80 AND 80"


def _located():
    return F.col("lat").between(-80, 80)


@register("flt_07_marina_queue", f"SELECT c_custkey FROM customer WHERE (lower(trim(CASE c_custkey % 4 WHEN 0 THEN ' OSM ' WHEN 1 THEN 'OpenStreetMap' ELSE c_mktsegment END)) IN ('openstreetmap', 'osm') OR c_custkey % 9 = 0) AND {_VALID}")
def flt_07(spark, d):
    """Harbours that a map names, by source or by id, and that have coordinates (here: within 80 degrees)."""
    k = F.col("c_custkey")
    source = F.when(k % 4 == 0, " OSM ").when(k % 4 == 1, "OpenStreetMap").otherwise(F.col("c_mktsegment"))
    named = F.lower(F.trim(source)).isin("openstreetmap", "osm") | (k % 9 == 0)
    return _points(table(spark, d, "customer"), "c_custkey").where(named & _located()).select("c_custkey")


@register("flt_08_office_queue", f"SELECT c_custkey FROM customer WHERE (c_custkey % 3 = 0 OR c_custkey % 5 = 0 OR c_custkey % 7 = 0 OR CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END <> '') AND {_VALID}")
def flt_08(spark, d):
    """Offices with any of three ids or a name, and coordinates."""
    k = F.col("c_custkey")
    ids = [F.when(k % n == 0, k.cast("string")) for n in (3, 5, 7)] + [F.when(k % 2 == 0, F.col("c_name")).otherwise("")]
    return _points(table(spark, d, "customer"), "c_custkey").where((F.concat_ws("", *ids) != "") & _located()).select("c_custkey")


@register("flt_09_area_queue", "SELECT page_id FROM pages WHERE contains(url, 'utm_source') OR contains(url, '/en/') OR contains(html, '<a href=\"/A')")
def flt_09(spark, d):
    """Areas with something to judge: a manager's page, a page for visitors, or candidates for one."""
    manager, visit = F.col("url").contains("utm_source"), F.col("url").contains("/en/")
    return table(spark, d, "pages").where(manager | visit | F.col("html").contains('<a href="/A')).select("page_id")


#: Labels of runs that are tests.
TEST_LABEL = r"(?i)^(canary|smoke|seed-enrich|test|debug)([-_].*)?$"
_LABELS = ["canary-1", "Smoke", "testing", "debug_x", "world", "seed-enrich", " test-b ", "pretest"]


@register("flt_11_test_run", f"SELECT o_orderkey, lower(trim(o_orderpriority)) = '1-urgent' OR regexp_matches(trim(['{chr(39).join(_LABELS).replace(chr(39), chr(39) + ', ' + chr(39))}'][o_orderkey % 8 + 1]), '{TEST_LABEL}') AS test FROM orders")
def flt_11(spark, d):
    """Runs made for a purpose (here: the most urgent) or with a label that marks a test."""
    label = F.get(F.array(*map(F.lit, _LABELS)), (F.col("o_orderkey") % len(_LABELS)).cast("int"))
    test = (F.lower(F.trim("o_orderpriority")) == "1-urgent") | F.trim(label).rlike(TEST_LABEL)
    return table(spark, d, "orders").select("o_orderkey", test.alias("test"))


@register("flt_33_page_vote", "SELECT event_id, CASE WHEN event_type = 'error' THEN false WHEN s = '' THEN true ELSE coalesce(TRY_CAST(s AS DOUBLE) >= 20, false) END AS votes FROM (SELECT event_id, event_type, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 5 = 1 THEN 'high' ELSE CAST(value AS VARCHAR) END AS s FROM events)")
def flt_33(spark, d):
    """Published pages vote from a least score on; without a score they do, with an unreadable one not."""
    k = F.col("event_id") % 5
    score = F.when(k == 0, "").when(k == 1, "high").otherwise(F.col("value").cast("string"))
    votes = F.when(F.col("event_type") == "error", False).when(score == "", True).otherwise(F.coalesce(score.try_cast("double") >= 20, F.lit(False)))
    return table(spark, d, "events").select("event_id", votes.alias("votes"))


@register("flt_39_panel", "SELECT p_partkey FROM part WHERE contains(lower(p_name), '12') OR contains(lower(CAST(p_partkey AS VARCHAR)), '12')")
def flt_39(spark, d):
    """Rows whose name or id holds what was typed."""
    return table(spark, d, "part").where(F.lower("p_name").contains("12") | F.col("p_partkey").cast("string").contains("12")).select("p_partkey")


@register("flt_40_science_panel", "SELECT p_partkey FROM part WHERE p_brand = (SELECT min(p_brand) FROM part) AND (contains(lower(p_name), 'a') OR contains(lower(p_type), 'a'))")
def flt_40(spark, d):
    """Rows of one source of which any text column holds what was typed."""
    part = table(spark, d, "part")
    source = F.broadcast(part.agg(F.min("p_brand").alias("p_brand")))  # one row
    found = F.exists(F.array("p_name", "p_type"), lambda x: F.lower(x).contains("a"))
    return part.join(source, "p_brand").where(found).select("p_partkey")


#: Names of places without inhabitants.
UNINHABITED = r"(?i)bouvet|heard|mcdonald|clipperton|crozet|kerguelen|amsterdam|saint.?paul|south georgia|sandwich|peter i|baker|howland|jarvis|johnston|kingman|palmyra|wake|navassa|ashmore|cartier|coral sea|macquarie|prince edward isl|tromelin|europa|glorioso|glorieuses|juan de nova|bassas da india|chagos|midway|paracel|spratly|scarborough|matthew|hunter|abu musa|tunb|enenkio"
_ZONE_NAMES, _ZONE_TYPES = ["Bouvet", "Saint-Paul", "Peru", "Coral Sea", "Chile"], ["200NM", "Overlapping claim", "Joint regime"]


@register("agg_29_unclos", f"""SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN NULL WHEN {LAT.format(k='c_custkey')} < -60 THEN 'antarctic' WHEN contains(lower(t), 'overlapping') THEN 'overlapping_claim' WHEN contains(lower(t), 'joint') THEN 'joint_regime' WHEN regexp_matches(n, '{UNINHABITED}') THEN 'uninhabited' ELSE 'sovereign_entry' END AS code
FROM (SELECT c_custkey, {_ZONE_NAMES!r}[c_custkey % 5 + 1] AS n, {_ZONE_TYPES!r}[c_custkey % 3 + 1] AS t FROM customer)""")
def agg_29(spark, d):
    """Legal class of zones without ports, first match; null for zones with ports."""
    k, pick = F.col("c_custkey"), lambda x: F.get(F.array(*map(F.lit, x)), (F.col("c_custkey") % len(x)).cast("int"))
    kind, name = F.lower(pick(_ZONE_TYPES)), pick(_ZONE_NAMES)
    code = F.when(F.col("lat") < -60, "antarctic").when(kind.contains("overlapping"), "overlapping_claim").when(kind.contains("joint"), "joint_regime").when(name.rlike(UNINHABITED), "uninhabited").otherwise("sovereign_entry")
    return _points(table(spark, d, "customer"), "c_custkey").select("c_custkey", F.when(k % 4 != 0, code).alias("code"))


# ---- choices -------------------------------------------------------------------------------------

_MEMBERS = "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 4 = 0 THEN 'v1' ELSE 'run' || (l_suppkey % 4) END AS origin, l_returnflag = 'A' AS noise, CASE WHEN l_suppkey % 4 = 0 THEN 0 WHEN l_partkey % 2 = 0 AND l_linestatus = 'F' THEN 1 WHEN l_partkey % 2 = 0 THEN 2 ELSE 3 END AS rank, l_partkey % 10 AS url FROM lineitem"


@register("agg_39_cluster_choice", f"SELECT l_orderkey, CAST(min(CASE WHEN NOT noise THEN rank * 1000 + l_linenumber END) % 1000 AS INTEGER) AS chosen, count(DISTINCT origin) >= 2 AS multi_run, CASE WHEN count(CASE WHEN origin = 'v1' AND NOT noise THEN 1 END) > 0 THEN 'v1' ELSE min(origin) END AS kept_from, count(DISTINCT url) AS urls FROM ({_MEMBERS}) GROUP BY l_orderkey HAVING count(CASE WHEN NOT noise THEN 1 END) > 0")
def agg_39(spark, d):
    """One report for each cluster: the first release, else a validated one with a place, else one with a place, else the first.

    Noise is never chosen, and clusters of noise alone are dropped; origins and URLs of all members count.
    """
    first, placed = F.col("l_suppkey") % 4 == 0, F.col("l_partkey") % 2 == 0
    origin = F.when(first, "v1").otherwise(F.concat(F.lit("run"), (F.col("l_suppkey") % 4).cast("string")))
    rank = F.when(first, 0).when(placed & (F.col("l_linestatus") == "F"), 1).when(placed, 2).otherwise(3)
    clean = F.col("l_returnflag") != "A"
    best = F.min(F.when(clean, F.struct(rank.alias("rank"), "l_linenumber")))
    origins = F.size(F.collect_set(origin))  # four at most
    grouped = table(spark, d, "lineitem").groupBy("l_orderkey").agg(
        best.alias("best"), (origins >= 2).alias("multi_run"), F.when(F.max(first & clean), "v1").otherwise(F.min(origin)).alias("kept_from"), F.size(F.collect_set(F.col("l_partkey") % 10)).cast("long").alias("urls")
    )
    return grouped.where("best IS NOT NULL").select("l_orderkey", F.col("best.l_linenumber").alias("chosen"), "multi_run", "kept_from", "urls")


_LEGS = f"SELECT o_custkey, lat, lon, lag(lat) OVER w AS plat, lag(lon) OVER w AS plon, row_number() OVER w AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM (SELECT o_custkey, o_orderkey, o_orderdate, {LAT.format(k='o_orderkey')} AS lat, {LON.format(k='o_orderkey')} AS lon FROM orders) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)"


@register("agg_54_route_metrics", f"""WITH l AS ({_LEGS}), s AS (SELECT o_custkey, count(*) AS points, sum(coalesce({_hav('plat', 'plon', 'lat', 'lon', geo.EARTH_NM)}, 0)) AS nm, count(CASE WHEN abs(lon - plon) > 180 THEN 1 END) AS jumps, max(CASE WHEN k = 1 THEN lat END) AS a, max(CASE WHEN k = 1 THEN lon END) AS b, max(CASE WHEN k = n THEN lat END) AS x, max(CASE WHEN k = n THEN lon END) AS y FROM l GROUP BY o_custkey)
SELECT o_custkey, points, round(nm, 2) AS nm, round(direct, 2) AS direct, CASE WHEN direct > 0.001 THEN round(nm / direct, 3) END AS ratio, jumps FROM (SELECT *, {_hav('a', 'b', 'x', 'y', geo.EARTH_NM)} AS direct FROM s)""")
def agg_54(spark, d):
    """Length, direct distance, their ratio and antimeridian jumps of each track (no land or lane mask is given)."""
    order = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = _points(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), "o_orderkey")
    at = F.struct("o_orderdate", "o_orderkey")
    legs = p.withColumns({"plat": F.lag("lat").over(order), "plon": F.lag("lon").over(order)})
    here = F.struct("lat", "lon")
    s = legs.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("points"), F.sum(F.coalesce(geo.haversine_nm(F.col("plat"), F.col("plon"), F.col("lat"), F.col("lon")), F.lit(0.0))).alias("nm"),
        F.count_if(F.abs(F.col("lon") - F.col("plon")) > 180).alias("jumps"), F.min_by(here, at).alias("a"), F.max_by(here, at).alias("z"),
    )
    s = s.withColumn("direct", geo.haversine_nm(F.col("a.lat"), F.col("a.lon"), F.col("z.lat"), F.col("z.lon")))
    ratio = F.when(F.col("direct") > 0.001, F.round(F.col("nm") / F.col("direct"), 3))
    return s.select("o_custkey", "points", F.round("nm", 2).alias("nm"), F.round("direct", 2).alias("direct"), ratio.alias("ratio"), "jumps")


# ---- coordinates ---------------------------------------------------------------------------------


@register("geo_04_destination", f"""WITH p AS (SELECT c_custkey, radians({LAT.format(k='c_custkey')}) AS p, radians({LON.format(k='c_custkey')}) AS l, radians(c_custkey * 31 % 360) AS b, (c_custkey % 900 + 1) / {geo.EARTH_KM} AS t FROM customer), q AS (SELECT *, asin(sin(p) * cos(t) + cos(p) * sin(t) * cos(b)) AS r FROM p)
SELECT c_custkey, round(degrees(r), 4) AS lat, round((degrees(l + atan2(sin(b) * sin(t) * cos(p), cos(t) - sin(p) * sin(r))) + 900) % 360 - 180, 3) AS lon FROM q WHERE abs(p) < 1.5""")
def geo_04(spark, d):
    p = _points(table(spark, d, "customer"), "c_custkey").where(F.abs(F.radians("lat")) < 1.5)
    lat, lon = geo.destination(F.col("lat"), F.col("lon"), (F.col("c_custkey") * 31 % 360).cast("double"), (F.col("c_custkey") % 900 + 1).cast("double"))
    return p.select("c_custkey", F.round(lat, 4).alias("lat"), F.round(lon, 3).alias("lon"))


@register("geo_07_wrapped_lon", "SELECT c_custkey, ((c_custkey * 13 % 1440 - 720) / 2.0 + 900) % 360 - 180 AS lon FROM customer")
def geo_07(spark, d):
    return table(spark, d, "customer").select("c_custkey", geo.wrap_lon((F.col("c_custkey") * 13 % 1440 - 720) / 2.0).alias("lon"))


_CELLS = "CAST(floor((lat + 90) / 180 * 32768) AS BIGINT) AS y, CAST(floor((lon + 180) / 360 * 32768) AS BIGINT) AS x"


def _hash_sql() -> str:
    """Base-32 letters from the interleaved bits of the whole numbers x and y of 15 bits."""
    bit = lambda p: f"((x >> {14 - p // 2}) & 1)" if p % 2 == 0 else f"((y >> {14 - p // 2}) & 1)"
    letters = [" + ".join(f"{bit(5 * c + b)} * {16 >> b}" for b in range(5)) for c in range(6)]
    return " || ".join(f"substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST({x} AS INTEGER) + 1, 1)" for x in letters)


_PLACED = f"SELECT *, {_CELLS} FROM (SELECT c_custkey, c_name, {LAT.format(k='c_custkey')} AS lat, {LON.format(k='c_custkey')} AS lon FROM customer)"


@register("geo_10_geohash", f"SELECT c_custkey, {_hash_sql()} AS hash FROM ({_PLACED})")
def geo_10(spark, d):
    return _points(table(spark, d, "customer"), "c_custkey").select("c_custkey", geo.geohash(F.col("lat"), F.col("lon")).alias("hash"))


@register("str_03_dedup_key", f"SELECT c_custkey, trim(regexp_replace(lower(c_name), '[^a-z0-9]+', ' ', 'g')) || '@' || {_hash_sql()} AS key FROM ({_PLACED})")
def str_03(spark, d):
    key = F.concat_ws("@", text.spaced_name(F.col("c_name")), geo.geohash(F.col("lat"), F.col("lon")))
    return _points(table(spark, d, "customer"), "c_custkey").select("c_custkey", key.alias("key"))


@register("geo_25_coordinates", "SELECT c_custkey, round(CASE c_custkey % 3 WHEN 0 THEN c_custkey % 90 + 0.25 WHEN 1 THEN -(c_custkey % 90 + (c_custkey % 60) / 60.0 + (c_custkey % 50) / 3600.0) END, 6) AS degrees FROM customer")
def geo_25(spark, d):
    """Decimal text, degrees with minutes and seconds, and text that is neither (null)."""
    k = F.col("c_custkey")
    raw = F.when(k % 3 == 0, F.concat((k % 90).cast("string"), F.lit(".25"))).when(k % 3 == 1, F.format_string("%d°%d'%d\"S", k % 90, k % 60, k % 50)).otherwise("unknown")
    return table(spark, d, "customer").select("c_custkey", F.round(dms(raw), 6).alias("degrees"))


# ---- document operators --------------------------------------------------------------------------


@register("doc_geo_intersects", f"SELECT c_custkey FROM (SELECT c_custkey, {LAT.format(k='c_custkey')} AS lat, {LON.format(k='c_custkey')} AS lon FROM customer) WHERE lon <= 40 AND lon + 3 >= -20 AND lat <= 35 AND lat + 2 >= 10")
def doc_geo_intersects(spark, d):
    """Boxes of 3 by 2 degrees that touch the asked box."""
    touches = (F.col("lon") <= 40) & (F.col("lon") + 3 >= -20) & (F.col("lat") <= 35) & (F.col("lat") + 2 >= 10)
    return _points(table(spark, d, "customer"), "c_custkey").where(touches).select("c_custkey")


@register("doc_element_exists", "SELECT conv_id FROM conversations GROUP BY conv_id HAVING count(CASE WHEN role = 'assistant' AND text IS NOT NULL THEN 1 END) > 0")
def doc_element_exists(spark, d):
    """Conversations with a turn that has an answer."""
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.bool_or((F.col("role") == "assistant") & F.col("text").isNotNull()).alias("any")).where("any").select("conv_id")


@register("doc_type", "SELECT event_id, json_type(props, '$.k') IN ('UBIGINT', 'BIGINT', 'DOUBLE') AS number, json_valid(props) AS document FROM events WHERE props IS NOT NULL")
def doc_type(spark, d):
    """Whether a field of a document is a number, and whether the text is a document at all."""
    value = F.try_variant_get(F.try_parse_json("props"), "$.k", "double")
    return table(spark, d, "events").where("props IS NOT NULL").select("event_id", value.isNotNull().alias("number"), F.try_parse_json("props").isNotNull().alias("document"))


@register("doc_add_to_set", "SELECT DISTINCT user_id, event_type AS tag FROM events UNION SELECT DISTINCT user_id, unnest(['seen', 'click']) FROM events")
def doc_add_to_set(spark, d):
    """Tags of each run with two more, each once."""
    held = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("tags"))  # as many as there are types
    return held.select("user_id", F.explode(F.array_union("tags", F.array(F.lit("seen"), F.lit("click")))).alias("tag"))


@register("doc_find_and_update", "SELECT event_id, user_id, CASE WHEN k = 1 THEN 'claimed' ELSE event_type END AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events WHERE event_type = 'click') UNION ALL SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'click'")
def doc_find_and_update(spark, d):
    """The oldest waiting event of each run is claimed; all others stay."""
    e = table(spark, d, "events").where("event_type IS NOT NULL")
    oldest = e.where("event_type = 'click'").groupBy("user_id").agg(F.min(F.struct("ts", "event_id")).alias("x")).select("user_id", F.col("x.event_id").alias("claimed"))
    state = F.when(F.col("event_id") == F.col("claimed"), "claimed").otherwise(F.col("event_type"))
    return e.join(oldest, "user_id", "left").select("event_id", "user_id", state.alias("state"))


@register("doc_replace_delete_insert", "SELECT c_custkey AS id, CASE WHEN s_suppkey IS NULL THEN c_name ELSE s_name END AS name FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey WHERE c_custkey % 10 <> 3 UNION ALL SELECT s_suppkey + 10000000, s_name FROM supplier")
def doc_replace_delete_insert(spark, d):
    """Customers with a supplier's row in place of theirs, some deleted, and new rows added."""
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("new"), F.lit(True).alias("has"))
    kept = table(spark, d, "customer").where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    replaced = kept.join(supplier, "id", "left").select("id", F.when(F.col("has"), F.col("new")).otherwise(F.col("name")).alias("name"))
    return replaced.unionByName(supplier.select((F.col("id") + 10_000_000).alias("id"), F.col("new").alias("name")))
