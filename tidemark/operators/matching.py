"""Joins by nearness, by last value, by key with a versioned baseline; islands in sequences."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions import geo


def neighbours(left: DataFrame, right: DataFrame, radius_km: float, same: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> DataFrame:
    """All pairs within radius_km, inclusive, whose columns same are equal.

    left: id, lat, lon. right: rid, rlat, rlon. more: further columns of either side that are kept. Points meet by latitude bands as high as the radius and
    by longitude cells whose width suits the band, so each point has 9 cells to look in, near the poles
    too, where a cell spans the circle; no cross join is made. Returns id, rid, km, same and more.
    """
    deg = radius_km / 111.19
    steps = max(1, math.ceil(180 / deg))

    def band(lat: Column) -> Column:
        return F.floor((lat + 90.0) / deg).cast("long")

    def columns(b: Column) -> Column:
        """Number of longitude cells in a band: the widest one that any of its latitudes, or its neighbours', needs."""
        edge = F.least(F.greatest(F.abs((b - 1) * deg - 90.0), F.abs((b + 2) * deg - 90.0)), F.lit(90.0))
        return F.greatest(F.floor(360.0 * F.cos(F.radians(edge)) / (deg * 1.05)), F.lit(1)).cast("long")

    cells = right.withColumn("b", band(F.col("rlat"))).withColumn("c", F.floor((geo.wrap_lon(F.col("rlon")) + 180.0) / 360.0 * columns(F.col("b"))).cast("long"))
    offsets = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    look = left.withColumn("b", F.explode(F.transform(offsets, lambda k: band(F.col("lat")) + k))).where((F.col("b") >= 0) & (F.col("b") <= steps))
    n = columns(F.col("b"))
    own = F.floor((geo.wrap_lon(F.col("lon")) + 180.0) / 360.0 * n)
    look = look.withColumn("c", F.explode(F.array_distinct(F.transform(offsets, lambda k: F.pmod(own + k, n).cast("long")))))
    at = (int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), *same, "b", "c")  # so many tasks whatever the size: a few bytes make many pairs
    met = look.repartition(*at).join(cells.repartition(*at).hint("merge"), [*same, "b", "c"]).withColumn("km", geo.haversine_km(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon")))
    return met.where(F.col("km") <= radius_km + 1e-6).select("id", "rid", "km", *same, *more)


def nearest_within(left: DataFrame, right: DataFrame, radius_km: float) -> DataFrame:
    """Nearest right point of each left point within radius_km, inclusive; ties go to the smaller right id. Returns id, rid, km."""
    met = neighbours(left, right, radius_km)
    return met.groupBy("id").agg(F.min(F.struct(F.round("km", 9).alias("k"), "rid", "km")).alias("m")).select("id", "m.rid", F.round("m.km", 6).alias("km"))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Last right value at or before each left row's time: one union and one window, no range join."""
    both = left.select(key, time, F.col("id"), F.lit(1).alias("side"), F.lit(None).cast(dict(right.dtypes)[value]).alias(value)).unionByName(right.select(key, time, F.lit(None).cast(dict(left.dtypes)["id"]).alias("id"), F.lit(0).alias("side"), value))
    w = Window.partitionBy(key).orderBy(time, "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("found", F.last(value, ignorenulls=True).over(w)).where("side = 1").select("id", F.col("found").alias(value))


def baseline_diff(baseline: DataFrame, candidate: DataFrame, moved_km: float = 1.0) -> DataFrame:
    """State of each key between two versions: added, removed, moved, renamed or unchanged. Columns: key, name, lat, lon."""
    b, c = (df.select("key", *[F.col(x).alias(f"{side}_{x}") for x in ("name", "lat", "lon")]) for side, df in (("b", baseline), ("c", candidate)))
    km = geo.haversine_km(F.col("b_lat"), F.col("b_lon"), F.col("c_lat"), F.col("c_lon"))
    state = F.when(F.col("b_name").isNull(), "added").when(F.col("c_name").isNull(), "removed").when(km > moved_km, "moved").when(F.col("b_name") != F.col("c_name"), "renamed").otherwise("unchanged")
    return b.join(c, "key", "full_outer").select("key", state.alias("state"))


def islands(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal consecutive values: keys, island (from 1), value, n."""
    w = Window.partitionBy(*keys).orderBy(*order)
    new = F.coalesce(~F.col(value).eqNullSafe(F.lag(value).over(w)) | (F.row_number().over(w) == 1), F.lit(True))
    marked = df.withColumn("_new", new.cast("int")).withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "island").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"))


def track_lengths(df: DataFrame, track: str, order: list[str]) -> DataFrame:
    """Adds leg_nm and cum_nm along each track of points (lat, lon)."""
    w = Window.partitionBy(track).orderBy(*order)
    leg = F.coalesce(geo.haversine_nm(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon")), F.lit(0.0))
    return df.withColumn("leg_nm", leg).withColumn("cum_nm", F.sum("leg_nm").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays of numbers."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
