"""Audits of places: offsets from a zone's middle, noise, isolation scores.

Customers are ports: the nation is the zone, the balance and the key scatter a port around the zone's
centre, the balance gives the distance to the nearest known place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.operators import anomalies, spread
from tidemark.plans.catalog import register
from tidemark.plans.inventory import LAT, LON, _hav
from tidemark.sources.tables import table


def ports(spark: SparkSession, d: str) -> DataFrame:
    """id, zone, lat, lon, far_km."""
    c, n = table(spark, d, "customer"), F.col("c_nationkey") + 11
    return c.select(
        F.col("c_custkey").alias("id"),
        F.col("c_nationkey").alias("zone"),
        (geo.synthetic_lat(n) * 0.6 + F.col("c_acctbal") / 1000.0).alias("lat"),
        (geo.synthetic_lon(n) * 0.9 + F.col("c_custkey") % 97 / 8.0).alias("lon"),
        (F.abs("c_acctbal") / 50.0).alias("far_km"),
    )


_PORTS = f"""p AS MATERIALIZED (SELECT c_custkey AS id, c_nationkey AS zone, {LAT.format(k='(c_nationkey + 11)')} * 0.6::DOUBLE + c_acctbal / 1000.0::DOUBLE AS lat,
  {LON.format(k='(c_nationkey + 11)')} * 0.9::DOUBLE + c_custkey % 97 / 8.0::DOUBLE AS lon FROM customer)"""


@register("agg_49_noise_150_km", f"""
WITH {_PORTS}, n AS (SELECT zone, count(*) AS n FROM p GROUP BY zone),
near AS (SELECT DISTINCT a.id FROM p a JOIN p b ON a.zone = b.zone AND a.id <> b.id WHERE {_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')} <= {anomalies.NOISE_KM})
SELECT id, n >= {anomalies.NOISE_GROUP} AND id NOT IN (SELECT id FROM near) AS noise FROM p JOIN n USING (zone)""")
def agg_49(spark, d):
    return anomalies.lonely(ports(spark, d))


@register("agg_48_zone_offsets", f"""
WITH {_PORTS}, m AS (SELECT zone, list_sort(list(lat))[count(*) // 2 + 1] AS mlat, list_sort(list(lon))[count(*) // 2 + 1] AS mlon FROM p GROUP BY zone)
SELECT id, round({_hav('lat', 'lon', 'mlat', 'lon')}, 6) AS dx, round({_hav('lat', 'lon', 'lat', 'mlon')}, 6) AS dy FROM p JOIN m USING (zone)""")
def agg_48_offsets(spark, d):
    return anomalies.zone_offsets(ports(spark, d)).select("id", F.round("dx", 6).alias("dx"), F.round("dy", 6).alias("dy"))


@register("agg_48_spatial_anomalies")
def agg_48(spark, d):
    """No oracle: trees are grown at random; tests walk the trees plainly."""
    return anomalies.spatial_anomalies(ports(spark, d))


@register("agg_50_isolation_scores")
def agg_50(spark, d):
    """Scores of parts by size and price; no oracle, as above."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("price"))
    forest, seen = anomalies.grow_forest(p, "id", ["size", "price"])
    return p.select("id", F.round(anomalies.isolation_score(forest, seen, ["size", "price"]), 6).alias("score"))


@register("agg_51_group_diameter", f"""
WITH {_PORTS}, m AS (SELECT a.zone, max({_hav('a.lat', 'a.lon', 'b.lat', 'b.lon')}) AS km FROM p a JOIN p b ON a.zone = b.zone AND a.id <= b.id GROUP BY a.zone)
SELECT zone, (SELECT count(*) FROM p WHERE p.zone = m.zone) AS n, round(km, 4) AS km FROM m""")
def agg_51(spark, d):
    return spread.diameters(ports(spark, d).withColumnRenamed("zone", "group")).select(F.col("group").alias("zone"), "n", F.round("km", 4).alias("km"))
