"""Climate atlases written as monthly grids, read back, sampled at places and thinned.

Line items are samples: the month is that of shipping, supplier and part choose the cell, quantity and line
number are wind and current, and the wave as in `inventory_state`. Orders are the places asked about.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import climate
from tidemark.operators import histograms as hg
from tidemark.plans.catalog import register
from tidemark.plans.inventory_state import _HEIGHTS, samples as wave_samples
from tidemark.sources import grids
from tidemark.sources.scratch import shared_folder
from tidemark.sources.tables import table

#: First value, step and number of values of the axes.
LATS, LONS = (-75.0, 1.5, 101), (-180.0, 1.5, 240)
WIND = "sector_pct array<double>, sector_spd array<double>, calm_pct double, gale_pct double, u_mean double, v_mean double, sample_count bigint, sea_mask boolean"


def _axis(first: float, step: float, n: int) -> list[float]:
    return [first + step * k for k in range(n)]


def _samples(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    return li.select(F.month("l_shipdate").alias("month"), (F.col("l_suppkey") % 20 * 5).cast("int").alias("i"), (F.col("l_partkey") % 6 * 40).cast("int").alias("j"), (F.col("l_quantity") - 25).cast("double").alias("u"), (F.col("l_linenumber") * 2 - 7).cast("double").alias("v"))


def _written(cells: DataFrame, kind: str, lats=LATS, lons=LONS) -> str:
    folder = f"{shared_folder(cells.sparkSession)}/grids-{uuid.uuid4().hex}"
    grids.write_grids(cells, folder, kind, _axis(*lats), _axis(*lons))
    return folder


def wind(spark: SparkSession, d: str, fields: str = WIND, **options) -> DataFrame:
    folder = _written(climate.wind_cells(_samples(spark, d), ["month", "i", "j"]), "wind")
    return grids.read_grids(spark, folder, "wind", fields, **options)


def current(spark: SparkSession, d: str) -> DataFrame:
    """Mean currents; cells of every seventh place are land."""
    means = _samples(spark, d).groupBy("month", "i", "j").agg(F.avg(F.col("u") / 100).alias("uo"), F.avg(F.col("v") / 100).alias("vo"))
    folder = _written(means.withColumn("sea_mask", (F.col("i") + F.col("j")) % 7 != 0), "current")
    return grids.read_grids(spark, folder, "current", "uo double, vo double, sea_mask boolean")


def places(spark: SparkSession, d: str) -> DataFrame:
    """A place and month per order, up to 0.9 degrees from the centre of a cell that has samples."""
    o = table(spark, d, "orders")
    lat = LATS[0] + LATS[1] * (F.col("o_custkey") % 20 * 5) + (F.col("o_orderkey") % 19 - 9) / 10
    lon = LONS[0] + LONS[1] * (F.col("o_custkey") % 6 * 40) + (F.col("o_orderkey") % 17 - 8) / 10
    return o.select("o_orderkey", F.month("o_orderdate").alias("month"), lat.alias("lat"), lon.alias("lon"))


_S = "s AS (SELECT month(l_shipdate) AS month, l_suppkey % 20 * 5 AS i, l_partkey % 6 * 40 AS j, (l_quantity - 25)::DOUBLE AS u, (l_linenumber * 2 - 7)::DOUBLE AS v FROM lineitem)"
_KN, _FROM = "sqrt({u} * {u} + {v} * {v}) * 1.94384", "((degrees(atan2(-({u}), -({v}))) + 360) % 360)"
_CELLS = f"""{_S}, k AS (SELECT *, {_KN.format(u='u', v='v')} AS kn, floor(({_FROM.format(u='u', v='v')} + 22.5) % 360 / 45) AS sec FROM s),
c AS (SELECT month, i, j, count(*) AS n, avg(u) AS u_mean, avg(v) AS v_mean, count(*) FILTER (kn <= 3) * 100.0::DOUBLE / count(*) AS calm_pct, count(*) FILTER (kn >= 34) * 100.0::DOUBLE / count(*) AS gale_pct FROM k GROUP BY ALL),
r AS (SELECT month, i, j, sec, count(*) * 100.0::DOUBLE / any_value(n) AS pct, avg(kn) AS spd FROM k JOIN c USING (month, i, j) GROUP BY month, i, j, sec HAVING count(*) * 100.0::DOUBLE / any_value(n) >= 2.5),
sea AS (SELECT * FROM c WHERE n > 20 AND EXISTS (SELECT 1 FROM r WHERE r.month = c.month AND r.i = c.i AND r.j = c.j)),
shown AS (SELECT month, i, j, n, {LATS[0]}::DOUBLE + {LATS[1]}::DOUBLE * i AS lat, {LONS[0]}::DOUBLE + {LONS[1]}::DOUBLE * j AS lon, calm_pct, gale_pct, u_mean, v_mean, sectors, (top).k AS from_deg, (top).s AS knots FROM sea JOIN (
  SELECT month, i, j, count(*) AS sectors, first(top ORDER BY top.p DESC, top.s DESC, top.k) AS top
  FROM (SELECT *, {{'p': round(pct, 1), 's': round(spd, 1), 'k': CAST(45 * sec AS INTEGER)}} AS top FROM r) GROUP BY month, i, j) USING (month, i, j))"""
_X = "(lon + 540) % 360 - 180"
_NEAREST = "greatest(0, least({n} - 1, ceil(({x} - ({a})) / {s} - 0.5)))::INTEGER"


def _at() -> str:
    """Oracle rows of places with the indices of their nearest cell, null where it is too far away."""
    i, j = _NEAREST.format(x="lat", a=LATS[0], s=LATS[1], n=LATS[2]), _NEAREST.format(x="x", a=LONS[0], s=LONS[1], n=LONS[2])
    return f"""(SELECT o_orderkey, month, CASE WHEN abs({LATS[0]}::DOUBLE + {LATS[1]}::DOUBLE * i - lat) <= 0.75 AND abs(({LONS[0]}::DOUBLE + {LONS[1]}::DOUBLE * j - x + 540) % 360 - 180) <= 0.75 THEN i END AS i, j FROM (
  SELECT *, {i} AS i, {j} AS j FROM (SELECT *, {_X} AS x FROM (SELECT o_orderkey, month(o_orderdate) AS month, {LATS[0]}::DOUBLE + {LATS[1]}::DOUBLE * (o_custkey % 20 * 5) + (o_orderkey % 19 - 9) / 10 AS lat, {LONS[0]}::DOUBLE + {LONS[1]}::DOUBLE * (o_custkey % 6 * 40) + (o_orderkey % 17 - 8) / 10 AS lon FROM orders))))"""


@register("src_20_wind_grid", f"WITH {_CELLS} SELECT month, i, j, {LATS[0]}::DOUBLE + {LATS[1]}::DOUBLE * i AS lat, {LONS[0]}::DOUBLE + {LONS[1]}::DOUBLE * j AS lon, n AS sample_count, n > 20 AS sea_mask, round(u_mean, 6) AS u_mean, round(v_mean, 6) AS v_mean, round(calm_pct, 6) AS calm_pct FROM c")
def src_20(spark, d):
    """All months; of the fields, the shares and speeds of sectors are not asked for and not read. Cells with samples."""
    g = wind(spark, d, "calm_pct double, u_mean double, v_mean double, sample_count bigint, sea_mask boolean")
    return g.where("sample_count > 0").select("month", "i", "j", "lat", "lon", "sample_count", "sea_mask", *[F.round(c, 6).alias(c) for c in ("u_mean", "v_mean", "calm_pct")])


@register("src_21_wave_grid", f"""WITH s AS (SELECT month(l_shipdate) AS month, l_suppkey % 10 AS i, l_linenumber AS j, l_quantity / 4 AS hs FROM lineitem WHERE NOT (l_returnflag = 'R' AND l_quantity < 5)), b AS (
  SELECT month, i, j, bin, n, sum(n) OVER (PARTITION BY month, i, j ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY month, i, j) AS total FROM (SELECT month, i, j, {_HEIGHTS} AS bin, count(*) AS n FROM s GROUP BY ALL)),
 p50 AS (SELECT month, i, j, any_value(total) AS n, arg_min((bin + greatest(0, least(1, (0.5 * total - (upto - n)) / n))) * {hg.HEIGHT_BIN}, bin) AS p50 FROM b WHERE upto >= 0.5 * total GROUP BY ALL),
 p90 AS (SELECT month, i, j, arg_min((bin + greatest(0, least(1, (0.9 * total - (upto - n)) / n))) * {hg.HEIGHT_BIN}, bin) AS p90 FROM b WHERE upto >= 0.9 * total GROUP BY ALL)
SELECT month, i::INTEGER AS i, j, -45::DOUBLE + 10 * i AS lat, 5::DOUBLE * j AS lon, round(p50, 6) AS hs_p50, round(greatest(p50, p90), 6) AS hs_p90 FROM p50 JOIN p90 USING (month, i, j) WHERE n >= {hg.MIN_SAMPLES}""")
def src_21(spark, d):
    """Height percentiles of sea cells, all months."""
    s = wave_samples(spark, d, F.month("l_shipdate").alias("month"))
    keys = ["month", "i", "j"]
    found = hg.wave_statistics(hg.wave_state(s, keys), keys).select("month", F.col("i").cast("int").alias("i"), F.col("j").cast("int").alias("j"), "hs_p50", "hs_p90", F.col("sea").alias("sea_mask"))
    lats, lons = (-45.0, 10.0, 10), (0.0, 5.0, 8)
    g = grids.read_grids(spark, _written(found, "wave", lats, lons), "wave", "hs_p50 double, hs_p90 double, sea_mask boolean")
    return g.where("sea_mask").select("month", "i", "j", "lat", "lon", F.round("hs_p50", 6).alias("hs_p50"), F.round("hs_p90", 6).alias("hs_p90"))


_FLOW = f"{_S}, f AS (SELECT month, i, j, avg(u / 100) AS uo, avg(v / 100) AS vo FROM s WHERE (i + j) % 7 <> 0 GROUP BY ALL)"


@register("src_22_current_grid", f"WITH {_FLOW} SELECT month, i, j, round(uo, 6) AS uo, round(vo, 6) AS vo FROM f WHERE {LATS[0]}::DOUBLE + {LATS[1]}::DOUBLE * i BETWEEN -30 AND 40 AND month IN (1, 2, 7)")
def src_22(spark, d):
    """Sea cells of three months and a band of latitudes: other files and blocks are not read."""
    means = _samples(spark, d).groupBy("month", "i", "j").agg(F.avg(F.col("u") / 100).alias("uo"), F.avg(F.col("v") / 100).alias("vo"))
    folder = _written(means.withColumn("sea_mask", (F.col("i") + F.col("j")) % 7 != 0), "current")
    g = grids.read_grids(spark, folder, "current", "uo double, vo double, sea_mask boolean", months="1,2,7", lat_min=-30, lat_max=40, rows=8)
    return g.where("sea_mask").select("month", "i", "j", F.round("uo", 6).alias("uo"), F.round("vo", 6).alias("vo"))


@register("geo_32_wind_roses", f"WITH {_CELLS} SELECT month, i, j, sectors, from_deg, knots, round({_KN.format(u='u_mean', v='v_mean')}, 1) AS mean_knots, round({_FROM.format(u='u_mean', v='v_mean')}, 1) AS mean_from_deg, round(calm_pct, 1) AS calm_pct, round(gale_pct, 1) AS gale_pct FROM shown")
def geo_32(spark, d):
    g = climate.winds(wind(spark, d).where(climate.has_wind()))
    return g.select("month", "i", "j", F.size("directions_from").cast("long").alias("sectors"), "from_deg", "knots", "mean_knots", "mean_from_deg", "calm_pct", "gale_pct")


@register("geo_31_wind_at_places", f"WITH {_CELLS} SELECT o_orderkey, knots, from_deg, n AS sample_count FROM {_at()} LEFT JOIN shown USING (month, i, j)")
def geo_31(spark, d):
    """Most likely wind of every order's place; null on land, off the grid and where a cell has too few samples."""
    found = grids.sample(places(spark, d), climate.winds(wind(spark, d).where(climate.has_wind())), LATS, LONS, F.lit(True))
    return found.select("o_orderkey", "knots", "from_deg", "sample_count")


@register("geo_35_current_at_places", f"WITH {_FLOW} SELECT o_orderkey, CASE WHEN kn < 0.15 THEN 0 ELSE round(kn, 2) END AS knots, round(toward, 1) AS toward_deg, kn < 0.15 AS below FROM {_at()} LEFT JOIN (SELECT month, i, j, {_KN.format(u='uo', v='vo')} AS kn, (degrees(atan2(uo, vo)) + 360) % 360 AS toward FROM f) USING (month, i, j)")
def geo_35(spark, d):
    found = grids.sample(places(spark, d), climate.currents(current(spark, d).where("uo IS NOT NULL AND vo IS NOT NULL")), LATS, LONS, F.col("sea_mask"))
    return found.select("o_orderkey", "knots", "toward_deg", "below")


@register("add_129_thinned_winds", f"WITH {_CELLS} SELECT month, lat, lon, knots, from_deg, n AS sample_count FROM shown WHERE i % 3 = 0 AND j % 3 = 0")
def add_129(spark, d):
    """Every third row and column of the grid of 1.5 degrees (4.0 degrees asked for)."""
    g = climate.winds(climate.thinned(wind(spark, d), LATS[1], 4.0).where(climate.has_wind()))
    return g.select("month", F.round("lat", 4).alias("lat"), F.round("lon", 4).alias("lon"), "knots", "from_deg", "sample_count")
