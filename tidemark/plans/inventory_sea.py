"""Queries of single survey rows: polar tables, climate samples, tracks, tiles, orders of lists, merged buckets.

Roles as in inventory; orders of a customer are the points of a track, lineitem holds samples, part
names ports, pages are collected pages.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions import geo, sailing, text
from tidemark.plans.catalog import register
from tidemark.plans.inventory import LAT, LON, _points
from tidemark.sources.tables import table

# ---- polar tables --------------------------------------------------------------------------------

#: A polar table as data of these queries; the functions take any.
POLAR = sailing.Polar((30.0, 52.0, 90.0, 135.0, 180.0), (6.0, 10.0, 16.0, 25.0), ((3.1, 4.7, 5.9, 6.1), (4.3, 6.1, 7.3, 7.6), (4.9, 6.8, 8.3, 9.4), (3.7, 5.9, 8.1, 10.7), (2.3, 4.1, 6.3, 8.2)))


def _polar_sql(source: str, keep: str) -> str:
    """Speeds by joining the samples (a, w, keep) with the cells of the table; cell i of an axis reaches from step i to the next."""
    axis = lambda steps: ", ".join(f"({i}, {a}, {b})" for i, (a, b) in enumerate(zip(steps, steps[1:])))
    cells = ", ".join(f"({i}, {j}, {v})" for i, r in enumerate(POLAR.speeds) for j, v in enumerate(r))
    a0, w0, a1, w1 = POLAR.angles[0], POLAR.winds[0], POLAR.angles[-1], POLAR.winds[-1]
    return f"""WITH s AS ({source}), t AS (SELECT *, least(greatest(least(abs(a), 180), {a0}), {a1}) AS ca, least(greatest(w, {w0}), {w1}) AS cw FROM s),
    pa(i, alo, ahi) AS (VALUES {axis(POLAR.angles)}), pw(j, wlo, whi) AS (VALUES {axis(POLAR.winds)}), c(i, j, v) AS (VALUES {cells}),
    m AS (SELECT *, (ca - alo) / (ahi - alo) AS fa, (cw - wlo) / (whi - wlo) AS fw FROM t JOIN pa ON ca >= alo AND (ca < ahi OR (ahi = {a1} AND ca = ahi)) JOIN pw ON cw >= wlo AND (cw < whi OR (whi = {w1} AND cw = whi)))
    SELECT {keep}, a, w, CASE WHEN w <= 0 OR a = 0 THEN 0 ELSE round((p.v * (1 - fa) * (1 - fw) + q.v * fa * (1 - fw) + r.v * (1 - fa) * fw + u.v * fa * fw) * least(abs(a) / {a0}, 1.0) + 1e-9, 3) END AS speed
    FROM m JOIN c p ON p.i = m.i AND p.j = m.j JOIN c q ON q.i = m.i + 1 AND q.j = m.j JOIN c r ON r.i = m.i AND r.j = m.j + 1 JOIN c u ON u.i = m.i + 1 AND u.j = m.j + 1"""


_SAMPLES = "SELECT l_orderkey, l_linenumber, CAST(l_partkey * 7 % 361 - 180 AS DOUBLE) AS a, l_quantity * 0.7 - 2 AS w FROM lineitem"


def _angle_wind():
    return (F.col("l_partkey") * 7 % 361 - 180).cast("double"), F.col("l_quantity") * 0.7 - 2


@register("geo_36_polar_speed", f"SELECT l_orderkey, l_linenumber, speed FROM ({_polar_sql(_SAMPLES, 'l_orderkey, l_linenumber')})")
def geo_36(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", sailing.polar_speed(POLAR, *_angle_wind()).alias("speed"))


@register("geo_38_made_good", f"SELECT l_orderkey, l_linenumber, round(speed * cos(radians(a)), 2) AS vmg FROM ({_polar_sql(_SAMPLES, 'l_orderkey, l_linenumber')})")
def geo_38(spark, d):
    vmg = sailing.made_good(sailing.polar_speed(POLAR, *_angle_wind()), _angle_wind()[0])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(vmg, 2).alias("vmg"))


def _winds_sql(first: int, last: int) -> str:
    return f"SELECT CAST(x AS DOUBLE) AS a, w, 0 AS z FROM (SELECT DISTINCT CAST(p_size AS DOUBLE) * 0.6 AS w FROM part), range({first}, {last + 1}) r(x)"


def _optimum(spark, d, first: int, last: int, toward):
    """Angle of the best speed made good for each wind speed, the smallest of equals; angles are a fixed range."""
    winds = table(spark, d, "part").select((F.col("p_size") * 0.6).alias("w")).distinct()
    tried = winds.select("w", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("twa"))
    speed = sailing.polar_speed(POLAR, F.col("twa").cast("double"), F.col("w"))
    best = F.max(F.struct(sailing.made_good(speed, toward(F.col("twa"))).alias("vmg"), (-F.col("twa")).alias("back"), speed.alias("speed"))).alias("b")
    return tried.groupBy("w").agg(best).select(F.round("w", 1).alias("wind"), (-F.col("b.back")).alias("twa"), F.round(F.col("b.speed") + 1e-9, 2).alias("speed"), F.round("b.vmg", 2).alias("vmg"))


def _optimum_sql(first: int, last: int, angle: str) -> str:
    ranked = f"SELECT *, row_number() OVER (PARTITION BY w ORDER BY speed * cos(radians({angle})) DESC, a) AS k FROM ({_polar_sql(_winds_sql(first, last), 'z')})"
    return f"SELECT round(w, 1) AS wind, CAST(a AS INTEGER) AS twa, round(speed + 1e-9, 2) AS speed, round(speed * cos(radians({angle})), 2) AS vmg FROM ({ranked}) WHERE k = 1"


@register("geo_39_best_upwind", _optimum_sql(25, 79, "a"))
def geo_39(spark, d):
    return _optimum(spark, d, 25, 79, lambda a: a)


@register("geo_40_best_downwind", _optimum_sql(100, 179, "180 - a"))
def geo_40(spark, d):
    return _optimum(spark, d, 100, 179, lambda a: 180 - a)


@register("geo_41_polar_grid", f"SELECT CAST(a AS INTEGER) AS twa, CAST(w AS INTEGER) AS tws, speed FROM ({_polar_sql('SELECT CAST(x AS DOUBLE) AS a, CAST(y AS DOUBLE) AS w, 0 AS z FROM range(0, 181) p(x), range(0, 61) q(y)', 'z')})")
def geo_41(spark, d):
    """Speeds at every whole angle and wind speed: 181 by 61 rows, whatever the data."""
    grid = spark.range(181).select(F.col("id").cast("int").alias("twa"), F.explode(F.sequence(F.lit(0), F.lit(60))).alias("tws"))
    return grid.select("twa", "tws", sailing.polar_speed(POLAR, F.col("twa").cast("double"), F.col("tws").cast("double")).alias("speed"))


# ---- climate samples -----------------------------------------------------------------------------

_FADE = "SELECT l_orderkey, l_linenumber, l_partkey % 300 AS h, CASE WHEN l_suppkey % 5 > 0 THEN l_quantity END AS f, CAST(l_suppkey * 37 % 360 AS DOUBLE) AS fd, l_discount * 100 + 4 AS c, CAST(l_suppkey * 101 % 360 AS DOUBLE) AS cd, least(greatest((l_partkey % 300 - 168) / 72.0, 0.0), 1.0) AS s FROM lineitem"
_TURN = "(fd + ((cd - fd + 540) % 360 - 180) * s + 360) % 360"


@register("geo_43_blended_wind", f"SELECT l_orderkey, l_linenumber, round(CASE WHEN f IS NULL OR h > 240 THEN c ELSE f * (1 - s) + c * s END, 4) AS knots, round(CASE WHEN f IS NULL OR h > 240 THEN cd WHEN h < 168 THEN fd ELSE {_TURN} END, 4) AS direction, CASE WHEN f IS NULL OR h > 240 OR s >= 1 THEN 'climatology' ELSE 'forecast' END AS kind FROM ({_FADE})")
def geo_43(spark, d):
    """Forecast, faded into climatology from day 7 to day 10; climatology alone where there is no forecast."""
    hours, s = F.col("l_partkey") % 300, sailing.blend_share(F.col("l_partkey") % 300)
    f, fd = F.when(F.col("l_suppkey") % 5 > 0, F.col("l_quantity")), (F.col("l_suppkey") * 37 % 360).cast("double")
    c, cd = F.col("l_discount") * 100 + 4, (F.col("l_suppkey") * 101 % 360).cast("double")
    alone = f.isNull() | (hours > sailing.BLEND_END_HOURS)
    direction = F.when(alone, cd).when(hours < sailing.FORECAST_HOURS, fd).otherwise(geo.blend_direction(fd, cd, s))
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(F.when(alone, c).otherwise(f * (1 - s) + c * s), 4).alias("knots"), F.round(direction, 4).alias("direction"), F.when(alone | (s >= 1), "climatology").otherwise("forecast").alias("kind")
    )


@register("geo_34_wave_hazard", "SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag <> 'N' AND l_suppkey % 4 > 0 THEN l_quantity / 10 > 2.5 END AS hazard FROM lineitem")
def geo_34(spark, d):
    p90 = F.when(F.col("l_suppkey") % 4 > 0, F.col("l_quantity") / 10)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", sailing.wave_hazard(p90, F.col("l_returnflag") != "N").alias("hazard"))


_CURRENT = f"SELECT l_orderkey, l_linenumber, sqrt(u * u + v * v) * {geo.KNOTS} AS kn, (degrees(atan2(u, v)) + 360) % 360 AS toward FROM (SELECT *, (l_partkey % 41 - 20.5) / 100 AS u, (l_quantity - 25.5) / 100 AS v FROM lineitem WHERE l_suppkey % 7 > 0)"


@register("geo_35_current_sample", f"SELECT l_orderkey, l_linenumber, CASE WHEN kn < 0.15 THEN 0 ELSE round(kn, 2) END AS knots, round(toward, 1) AS toward, kn < 0.15 AS below FROM ({_CURRENT})")
def geo_35(spark, d):
    """Current of sea cells; below the least speed it counts as 0 and keeps its direction."""
    knots, toward = geo.current_to_uv((F.col("l_partkey") % 41 - 20.5) / 100, (F.col("l_quantity") - 25.5) / 100)
    below = knots < sailing.CURRENT_MIN_KNOTS
    sea = table(spark, d, "lineitem").where("l_suppkey % 7 > 0")
    return sea.select("l_orderkey", "l_linenumber", F.when(below, 0.0).otherwise(F.round(knots, 2)).alias("knots"), F.round(toward, 1).alias("toward"), below.alias("below"))


_CELL_SQL = "SELECT CAST(floor({lat} / 2 + 0.5) AS BIGINT) AS i, CAST(floor({lon} / 2 + 0.5) AS BIGINT) % 180 AS j"


@register("geo_31_nearest_cell", f"""WITH cells AS ({_CELL_SQL.format(lat=LAT.format(k='s_suppkey'), lon=f"({LON.format(k='s_suppkey')} + 360)")}, round(avg(s_acctbal), 2) AS speed FROM supplier GROUP BY 1, 2),
 p AS (SELECT c_custkey, {LAT.format(k='c_custkey')} AS lat, {LON.format(k='c_custkey')} + 360 AS lon FROM customer),
 q AS (SELECT *, CAST(floor(lat / 2 + 0.5) AS BIGINT) AS i, CAST(floor(lon / 2 + 0.5) AS BIGINT) % 180 AS j, abs(lat - 2 * floor(lat / 2 + 0.5)) <= 0.75 AND abs(lon - 2 * floor(lon / 2 + 0.5)) <= 0.75 AS near FROM p)
 SELECT c_custkey, CASE WHEN near THEN speed END AS speed FROM q LEFT JOIN cells USING (i, j)""")
def geo_31(spark, d):
    """Value of the nearest cell of a grid of 2 degrees, if its centre is within 0.75 degrees on both axes."""
    i, j = F.floor(F.col("lat") / 2 + 0.5), F.floor((F.col("lon") + 360) / 2 + 0.5)
    near = (F.abs(F.col("lat") - 2 * i) <= 0.75) & (F.abs(F.col("lon") + 360 - 2 * j) <= 0.75)
    cells = _points(table(spark, d, "supplier"), "s_suppkey").groupBy(i.alias("i"), (j % 180).alias("j")).agg(F.round(F.avg("s_acctbal"), 2).alias("speed"))
    asked = _points(table(spark, d, "customer"), "c_custkey").select("c_custkey", i.alias("i"), (j % 180).alias("j"), near.alias("near"))
    return asked.join(cells, ["i", "j"], "left").select("c_custkey", F.when(F.col("near"), F.col("speed")).alias("speed"))


@register("flt_42_storm_days", "SELECT o_orderkey FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CASE WHEN o_orderkey % 9 > 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 20 AS INTEGER) END AS e FROM orders) WHERE CASE WHEN e IS NULL THEN month(s) = 9 ELSE s <= make_date(year(s), 9, 15) + 21 AND e >= make_date(year(s), 9, 15) - 21 END")
def flt_42(spark, d):
    """Storms that touch the 21 days around 15 September of their year; storms without an end count by month."""
    start = F.to_date("o_orderdate")
    end = F.when(F.col("o_orderkey") % 9 > 0, F.date_add(start, (F.col("o_orderkey") % 20).cast("int")))
    return table(spark, d, "orders").where(sailing.in_day_range(start, end, F.array(F.month(start)), 9, 15, 21)).select("o_orderkey")


# ---- places and tracks ---------------------------------------------------------------------------

_DIGEST = "(" + " + ".join(f"(strpos('0123456789abcdef', substr(md5(title), {k + 1}, 1)) - 1) * {pow(16, 31 - k, 4096000)}" for k in range(32)) + ") % 4096000"


@register("geo_27_ocean_fallback", f"SELECT p_partkey, round(south + (h // 1024) % 1000 / 1000.0 * (north - south), 4) AS lat, round(west + h % 1000 / 1000.0 * (east - west), 4) AS lon FROM (SELECT p_partkey, {_DIGEST} AS h FROM (SELECT p_partkey, p_name AS title FROM part)) JOIN (VALUES {', '.join(str((k, *r)) for k, r in enumerate(sailing.OCEAN_REGIONS))}) b(k, west, east, south, north) ON k = h % 4")
def geo_27(spark, d):
    lat, lon = sailing.ocean_fallback(F.col("p_name"))
    return table(spark, d, "part").select("p_partkey", F.round(lat, 4).alias("lat"), F.round(lon, 4).alias("lon"))


@register("geo_13_world_tiles", "SELECT r_regionkey, x AS west, y AS south, least(x + 8, r_regionkey * 30 - 20) AS east, least(y + 8, 31) AS north FROM (SELECT r_regionkey, r_regionkey * 30 - 60 + 8 * i AS x, -33 + 8 * j AS y FROM region, range(0, 5) p(i), range(0, 8) q(j)) WHERE x < r_regionkey * 30 - 20 AND y < 31")
def geo_13(spark, d):
    """Tiles of at most 8 degrees that fill a box per region; those at its north and east edge are smaller."""
    step = 8
    box = table(spark, d, "region").select("r_regionkey", (F.col("r_regionkey") * 30 - 60).alias("w"), F.lit(-33).alias("s"), (F.col("r_regionkey") * 30 - 20).alias("e"), F.lit(31).alias("n"))
    tiles = box.withColumn("south", F.explode(F.sequence("s", F.col("n") - 1, F.lit(step)))).withColumn("west", F.explode(F.sequence("w", F.col("e") - 1, F.lit(step))))
    return tiles.select("r_regionkey", "west", "south", F.least(F.col("west") + step, "e").alias("east"), F.least(F.col("south") + step, "n").alias("north"))


_TRACK = f"SELECT o_custkey, o_orderkey, o_orderdate, {LON.format(k='o_orderkey')} AS lon FROM orders"


@register("win_08_split_antimeridian", f"WITH p AS (SELECT *, CASE WHEN abs(lon - lag(lon) OVER w) > 180 THEN 1 ELSE 0 END AS jump FROM ({_TRACK}) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)), q AS (SELECT *, sum(jump) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS part FROM p) SELECT o_custkey, CAST(part AS BIGINT) AS part, count(*) AS points, min(lon) AS west, max(lon) AS east FROM q GROUP BY o_custkey, part HAVING count(*) >= 2")
def win_08(spark, d):
    """Parts of tracks between jumps over the antimeridian; parts of one point are left out."""
    track = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    p = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", geo.synthetic_lon(F.col("o_orderkey")).alias("lon"))
    jump = F.coalesce((F.abs(F.col("lon") - F.lag("lon").over(track)) > 180).cast("long"), F.lit(0))
    q = p.withColumn("jump", jump).withColumn("part", F.sum("jump").over(track))
    return q.groupBy("o_custkey", "part").agg(F.count(F.lit(1)).alias("points"), F.min("lon").alias("west"), F.max("lon").alias("east")).where("points >= 2")


@register("win_10_subsample", "WITH p AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders) SELECT o_custkey, o_orderkey FROM p WHERE n <= 5 OR k IN (round_even(0 * (n - 1) / 4.0, 0), round_even(1 * (n - 1) / 4.0, 0), round_even(2 * (n - 1) / 4.0, 0), round_even(3 * (n - 1) / 4.0, 0), n - 1)")
def win_10(spark, d):
    """At most 5 points of a track, evenly spread, its first and last among them; halves go to the even place."""
    most = 5
    track = Window.partitionBy("o_custkey")
    k, n = F.row_number().over(track.orderBy("o_orderdate", "o_orderkey")) - 1, F.count(F.lit(1)).over(track)
    p = table(spark, d, "orders").select("o_custkey", "o_orderkey", k.alias("k"), n.alias("n"))
    wanted = [F.bround(F.lit(i) * (F.col("n") - 1) / (most - 1), 0) for i in range(most)]
    return p.where((F.col("n") <= most) | F.array_contains(F.array(*wanted), F.col("k").cast("double"))).select("o_custkey", "o_orderkey")


# ---- pages, names, lists -------------------------------------------------------------------------

#: First path segments that only choose a language or region.
LANGUAGE_SEGMENTS = ["en", "fr", "de", "es", "it", "pt", "nl", "int", "uk", "us", "eu"]
_IN = ", ".join(f"'{x}'" for x in LANGUAGE_SEGMENTS)
_SEGMENTS = "list_filter(string_split(regexp_extract(u, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> '')"


@register("flt_31_homepage", f"SELECT page_id, u AS url, trim(u) = '' OR len(s) = 0 OR (len(s) = 1 AND lower(s[1]) IN ({_IN})) AS home FROM (SELECT page_id, u, {_SEGMENTS} AS s FROM (SELECT page_id, url AS u FROM pages UNION ALL SELECT page_id, regexp_replace(url, '/[^/]*$', '') FROM pages))")
def flt_31(spark, d):
    """Whether a page, and the folder it lies in, is the root of its site."""
    pages = table(spark, d, "pages").select("page_id", "url")
    both = pages.unionByName(pages.withColumn("url", F.regexp_replace("url", "/[^/]*$", "")))
    s = F.filter(F.split(text.path(F.col("url")), "/"), lambda x: x != "")
    home = (F.trim("url") == "") | (F.size(s) == 0) | ((F.size(s) == 1) & F.lower(F.get(s, 0)).isin(LANGUAGE_SEGMENTS))
    return both.select("page_id", "url", home.alias("home"))


#: Note, whole names, beginnings and passages that mark a fragment of a legal text.
LEGAL_NOTE = "tournure légale"
LEGAL_NAMES = ["etat", "peche", "escale", "arrival", "embarkation", "destino", "outremer", "interet", "hydrocarbures", "croisiere", "rilevanza"]
LEGAL_HEAD = r"(?i)^(etat|pêche|peche|escale|arrival|embarkation|destino|outre-mer|outre mer|interet|intérêt|hydrocarbures|croisiere|croisière|described|consists of|areas|rilevanza)\b"
LEGAL_INSIDE = r"(?i)(consists of| described$| areas$|embarkation|rilevanza|intérêt national|interet national|connection channel)"
_NAMED = "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'Escale ' || p_name WHEN 1 THEN p_name || ' areas' WHEN 2 THEN left(p_name, 3) WHEN 3 THEN 'Outre-Mer' ELSE p_name END AS name, CASE WHEN p_partkey % 11 = 0 THEN 'une tournure légale' END AS note FROM part"
_NORM = "left(regexp_replace(lower(name), '[^a-z0-9]', '', 'g'), 40)"


@register("flt_12_legal_fragment", f"SELECT p_partkey, (contains(coalesce(note, ''), '{LEGAL_NOTE}') OR {_NORM} IN ({', '.join(repr(x) for x in LEGAL_NAMES)}) OR regexp_matches(trim(name), '{LEGAL_HEAD}') OR regexp_matches(trim(name), '{LEGAL_INSIDE}') OR length({_NORM}) < 4) AS fragment FROM ({_NAMED})")
def flt_12(spark, d):
    """Names that are pieces of legal prose. Part names hold none, so some get such words, as in the oracle."""
    k, p = F.col("p_partkey") % 6, F.col("p_name")
    name = F.when(k == 0, F.concat(F.lit("Escale "), p)).when(k == 1, F.concat(p, F.lit(" areas"))).when(k == 2, F.substring(p, 1, 3)).when(k == 3, "Outre-Mer").otherwise(p)
    note = F.coalesce(F.when(F.col("p_partkey") % 11 == 0, "une tournure légale"), F.lit(""))
    norm, shown = text.normalize_name(name), F.trim(name)
    bad = note.contains(LEGAL_NOTE) | norm.isin(LEGAL_NAMES) | shown.rlike(LEGAL_HEAD) | shown.rlike(LEGAL_INSIDE) | (F.length(norm) < 4)
    return table(spark, d, "part").select("p_partkey", bad.alias("fragment"))


@register("srt_02_clamped_page", "SELECT p_partkey, greatest(0, p_partkey - 50) AS skip, greatest(1, least(CASE WHEN p_size % 10 = 0 THEN 500 ELSE p_size * 60 - 120 END, 2000)) AS size FROM part")
def srt_02(spark, d):
    """Offset of at least 0 and page size of 1 to 2000; without a size 500."""
    size = F.when(F.col("p_size") % 10 == 0, 0).otherwise(F.col("p_size") * 60 - 120)
    size = F.when(F.col("p_size") % 10 == 0, 500).otherwise(size)
    return table(spark, d, "part").select("p_partkey", F.greatest(F.lit(0), F.col("p_partkey") - 50).alias("skip"), F.greatest(F.lit(1), F.least(size, F.lit(2000))).alias("size"))


@register("srt_04_zone_order", "SELECT n_nationkey, CAST(row_number() OVER (PARTITION BY lower(trim(r_name)) ORDER BY CASE WHEN n_nationkey % 7 = 3 THEN 0 ELSE 1 END, lower(trim(n_name)), n_nationkey) AS INTEGER) AS place FROM nation JOIN region ON n_regionkey = r_regionkey")
def srt_04(spark, d):
    """Zones of a sovereign (here a region): its mainland first, then by label."""
    zones = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    order = Window.partitionBy(F.lower(F.trim("r_name"))).orderBy(F.when(F.col("n_nationkey") % 7 == 3, 0).otherwise(1), F.lower(F.trim("n_name")), "n_nationkey")
    return zones.select("n_nationkey", F.row_number().over(order).alias("place"))


@register("agg_25_source_counts", "SELECT key, count(*) AS n FROM (SELECT unnest([lang, source, CASE WHEN n_chars > 500 THEN 'long' END]) AS key FROM documents) WHERE key IS NOT NULL AND key <> '' GROUP BY key")
def agg_25(spark, d):
    """How many rows name each source; a row names several."""
    named = F.array("lang", "source", F.when(F.col("n_chars") > 500, "long"))
    return table(spark, d, "documents").select(F.explode(named).alias("key")).where("key IS NOT NULL AND key <> ''").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@register("set_05_merged_buckets", "SELECT DISTINCT user_id, event_type AS bucket, event_id % 17 AS item FROM events")
def set_05(spark, d):
    """Two maps of bucket to set per run, of even and odd events, merged bucket by bucket."""
    e = table(spark, d, "events").select("user_id", (F.col("event_id") % 2).alias("side"), "event_type", (F.col("event_id") % 17).alias("item"))
    sets = e.groupBy("user_id", "side", "event_type").agg(F.collect_set("item").alias("items"))  # at most 17 items
    maps = sets.groupBy("user_id").pivot("side", [0, 1]).agg(F.map_from_entries(F.collect_list(F.struct("event_type", "items"))))
    empty = F.create_map().cast("map<string,array<bigint>>")
    none = F.array().cast("array<bigint>")
    both = F.map_zip_with(F.coalesce("0", empty), F.coalesce("1", empty), lambda k, a, b: F.array_union(F.coalesce(a, none), F.coalesce(b, none)))
    return maps.select("user_id", F.explode(both).alias("bucket", "items")).select("user_id", "bucket", F.explode("items").alias("item"))
