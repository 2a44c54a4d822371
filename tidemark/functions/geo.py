"""Distances, bearings, sectors and grids as Column expressions (JVM only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean Earth radius in km and in nautical miles, knots per m/s.
EARTH_KM, EARTH_NM, KNOTS = 6371.0, 3440.065, 1.94384
#: Mean Earth radius and nautical mile in metres.
EARTH_METRES, NM_METRES = 6371008.8, 1852.0


def _angle(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    dlat, dlon = F.radians(lat2 - lat1) / 2, F.radians(lon2 - lon1) / 2
    a = F.sin(dlat) * F.sin(dlat) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.sin(dlon) * F.sin(dlon)
    return 2 * F.asin(F.sqrt(F.when((a > 1) & ~F.isnan(a), 1.0).otherwise(a)))  # null stays null


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return EARTH_KM * _angle(lat1, lon1, lat2, lon2)


def haversine_nm(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return EARTH_NM * _angle(lat1, lon1, lat2, lon2)


def haversine_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return EARTH_METRES * _angle(lat1, lon1, lat2, lon2)


def wrap_lon(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def lon_gap(a: Column, b: Column) -> Column:
    """Difference of two longitudes on the circle."""
    d = F.abs(a - b)
    return F.least(d, 360.0 - d)


def bearing(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lon2 - lon1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))) + 360.0, F.lit(360.0))


def destination(lat: Column, lon: Column, bearing_deg: Column, km: Column) -> tuple[Column, Column]:
    """Latitude and wrapped longitude reached from a point."""
    p, b, d = F.radians(lat), F.radians(bearing_deg), km / EARTH_KM
    p2 = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    l2 = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(p2))
    return F.degrees(p2), wrap_lon(F.degrees(l2))


def wind_angle(heading: Column, wind_from: Column) -> Column:
    raw = F.pmod(wind_from - heading + 360.0, F.lit(360.0))
    return F.when(raw > 180, 360.0 - raw).otherwise(raw)


def sector(direction: Column, n: int = 8) -> Column:
    """Index of the rose sector that a direction falls in."""
    width = 360.0 / n
    return F.floor(F.pmod(direction + width / 2, F.lit(360.0)) / width).cast("int")


def wind_from_uv(u: Column, v: Column) -> tuple[Column, Column]:
    """Speed in knots and direction the wind comes from."""
    return F.hypot(u, v) * KNOTS, F.pmod(F.degrees(F.atan2(-u, -v)) + 360.0, F.lit(360.0))


def current_to_uv(u: Column, v: Column) -> tuple[Column, Column]:
    """Speed in knots and direction a current sets toward."""
    return F.hypot(u, v) * KNOTS, F.pmod(F.degrees(F.atan2(u, v)) + 360.0, F.lit(360.0))


def unwrap_lon(previous: Column, lon: Column) -> Column:
    """Longitude made continuous with the one before; one that lies half a turn off, on either side, stays."""
    gap = lon - previous
    return F.when(gap < -180, lon + 360.0 * F.ceil((-180.0 - gap) / 360.0)).otherwise(lon - 360.0 * F.greatest(F.ceil((gap - 180.0) / 360.0), F.lit(0)))


def blend_direction(a: Column, b: Column, share: Column) -> Column:
    """Direction between a (share 0) and b (share 1) along the shorter arc."""
    gap = F.pmod(b - a + 540.0, F.lit(360.0)) - 180.0
    return F.pmod(a + gap * share + 360.0, F.lit(360.0))


def mercator_to_wgs84(x: Column, y: Column) -> tuple[Column, Column]:
    """Latitude and longitude of Web Mercator metres."""
    half = 20037508.34
    return F.degrees(F.atan(F.exp(y / half * F.pi()))) * 2 - 90.0, x / half * 180.0


def segment_nm(lat: Column, lon: Column, lat1: Column, lon1: Column, lat2: Column, lon2: Column, steps: int = 8) -> Column:
    """Least distance to points laid evenly along a segment, its ends included."""
    span = wrap_lon(lon2 - lon1)
    along = [haversine_nm(lat, lon, lat1 + (k / steps) * (lat2 - lat1), wrap_lon(lon1 + (k / steps) * span)) for k in range(1, steps)]
    return F.least(haversine_nm(lat, lon, lat1, lon1), haversine_nm(lat, lon, lat2, lon2), *along)


def ring_centroid(ring: Column) -> Column:
    """Area centroid of a closed ring of structs (x, y); its first point where it has under 3 points or no area."""
    first = F.get(ring, F.lit(0))
    zero = F.struct(F.lit(0.0).alias("area"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))

    def add(s: Column, i: Column) -> Column:
        p, q = F.get(ring, i), F.get(ring, i + 1)
        cross = p["x"] * q["y"] - q["x"] * p["y"]
        return F.struct((s["area"] + cross).alias("area"), (s["x"] + (p["x"] + q["x"]) * cross).alias("x"), (s["y"] + (p["y"] + q["y"]) * cross).alias("y"))

    def end(s: Column) -> Column:
        return F.when((F.size(ring) < 3) | (F.abs(s["area"]) < 1e-12), first).otherwise(F.struct((s["x"] / (3 * s["area"])).alias("x"), (s["y"] / (3 * s["area"])).alias("y")))

    return F.aggregate(F.sequence(F.lit(0), F.greatest(F.size(ring) - 2, F.lit(0))), zero, add, end)


def bbox_of_points(points: DataFrame, key: str) -> DataFrame:
    """(key, west, south, east, north) of points (key, lat, lon) on the globe; east may pass 180 over the antimeridian."""
    held = points.where(F.col("lon").between(-180, 180) & F.col("lat").between(-90, 90)).withColumn("turned", F.pmod("lon", F.lit(360.0)))
    ends = [f("lon").alias(a) for f, a in ((F.min, "w"), (F.max, "e"))] + [f("turned").alias(a) for f, a in ((F.min, "w2"), (F.max, "e2"))]
    box = held.groupBy(key).agg(*ends, F.min("lat").alias("south"), F.max("lat").alias("north"))
    w, e, w2, e2 = (F.col(c) for c in ("w", "e", "w2", "e2"))
    wraps = (e - w > 180) & (e2 - w2 > 1e-6) & (e2 - w2 < e - w)
    west = F.when(w2 > 180, w2 - 360).otherwise(w2)
    east = F.when(e2 > 180, e2 - 360).otherwise(e2)
    return box.select(key, F.when(wraps, west).otherwise(w).alias("west"), "south", F.when(~wraps, e).when(east < west, east + 360).otherwise(east).alias("east"), "north")


def gale_probability(lat: Column, month: Column) -> Column:
    """Gale probability by latitude band and month."""
    return (
        F.when(lat < -40, F.when(month.isin(6, 7, 8), 0.55).otherwise(0.40))
        .when(lat < -30, 0.25)
        .when(lat.between(40, 60), F.when(month.isin(11, 12, 1, 2, 3), 0.35).otherwise(0.10))
        .when(lat.between(5, 25), 0.05)
        .otherwise(0.12)
    )


def synthetic_lat(key: Column) -> Column:
    """Latitude of a key in tables without coordinates."""
    return (key.cast("long") * 7919 % 18000) / 100.0 - 90.0


def synthetic_lon(key: Column) -> Column:
    return (key.cast("long") * 104729 % 36000) / 100.0 - 180.0


def geohash(lat: Column, lon: Column, precision: int = 6) -> Column:
    """Base-32 geohash, by halving intervals over a sequence."""
    start = F.struct(F.lit(-90.0).alias("s"), F.lit(90.0).alias("n"), F.lit(-180.0).alias("w"), F.lit(180.0).alias("e"), F.lit(0).alias("v"), F.lit("").alias("h"))

    def step(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        mid = F.when(even, (acc["w"] + acc["e"]) / 2).otherwise((acc["s"] + acc["n"]) / 2)
        high = F.when(even, lon >= mid).otherwise(lat >= mid)
        v = acc["v"] * 2 + F.when(high, 1).otherwise(0)
        full = i % 5 == 4
        return F.struct(
            F.when(~even & high, mid).otherwise(acc["s"]).alias("s"),
            F.when(~even & ~high, mid).otherwise(acc["n"]).alias("n"),
            F.when(even & high, mid).otherwise(acc["w"]).alias("w"),
            F.when(even & ~high, mid).otherwise(acc["e"]).alias("e"),
            F.when(full, 0).otherwise(v).alias("v"),
            F.when(full, F.concat(acc["h"], F.substring(F.lit("0123456789bcdefghjkmnpqrstuvwxyz"), v + 1, F.lit(1)))).otherwise(acc["h"]).alias("h"),
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(5 * precision - 1)), start, step)["h"]
