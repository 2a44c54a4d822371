"""Spatial anomalies: isolation forest over offsets from a zone's middle, and points without a neighbour.

The forest is grown on a bounded sample, POOL rows at most, the first in the order of a hash of their ids;
each tree takes up to TREE_ROWS of these. Every row is scored: its way through each tree is looked up in
arrays of nodes, for a batch of rows at once. The trees are a model of bounded size (TREES times twice
TREE_ROWS nodes) and travel with the function.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from tidemark.functions import geo
from tidemark.sources.scratch import written

#: Trees, rows of a tree, share of anomalies; noise radius and least group; far and clear cases.
TREES, TREE_ROWS, SHARE = 200, 256, 0.05
NOISE_KM, NOISE_GROUP, FAR_KM, CLEAR_SCORE = 150.0, 3, 100.0, 0.15
#: Rows that trees are drawn from, at most.
POOL = 51_200


def expected_path(n: int) -> float:
    """Mean length of an unsuccessful search in a binary tree of n rows."""
    if n < 2:
        return 0.0
    return 2 * sum(1 / k for k in range(1, n)) - 2 * (n - 1) / n


def grow(rows: list[tuple], rng: random.Random) -> dict[str, list]:
    """One tree as arrays: feature (-1 at a leaf), cut, left, right, and path: the length of a way that ends there."""
    tree: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "path")}
    limit = math.ceil(math.log2(max(len(rows), 2)))

    def node(part: list[tuple], depth: int) -> int:
        at = len(tree["feature"])
        for k, v in (("feature", -1), ("cut", 0.0), ("left", at), ("right", at), ("path", depth + expected_path(len(part)))):
            tree[k].append(v)
        open_features = [f for f in range(len(part[0])) if min(r[f] for r in part) < max(r[f] for r in part)] if part and depth < limit else []
        if open_features:
            f = rng.choice(open_features)
            cut = rng.uniform(min(r[f] for r in part), max(r[f] for r in part))
            low, high = [r for r in part if r[f] <= cut], [r for r in part if r[f] > cut]
            if low and high:
                tree["feature"][at], tree["cut"][at] = f, cut
                tree["left"][at] = node(low, depth + 1)
                tree["right"][at] = node(high, depth + 1)
        return at

    node(rows, 0)
    return tree


def grow_forest(df: DataFrame, id_col: str, features: list[str], trees: int = TREES, seed: int = 42) -> tuple[list[dict], int]:
    """Trees and how many rows each has seen. Rows with a null or NaN feature are not drawn."""
    usable = df.where(" AND ".join(f"{c} IS NOT NULL AND NOT isnan({c})" for c in features))
    pool = usable.orderBy(F.xxhash64(F.col(id_col)), F.col(id_col), *features).select(*features).limit(POOL).collect()
    rows, rng = [tuple(map(float, r)) for r in pool], random.Random(seed)
    n = min(TREE_ROWS, len(rows))
    return [grow(rng.sample(rows, n), rng) for _ in range(trees if n else 0)], n


def isolation_score(forest: list[dict], seen: int, features: list[str]) -> Column:
    """2 to the power of minus the mean way over the expected one: near 1 for what is soon alone; null without a forest or a feature."""
    if not forest:
        return F.lit(None).cast("double")
    expected, width = max(expected_path(seen), 1e-9), len(features)

    @pandas_udf(DoubleType())
    def score(*columns):
        import numpy as np
        import pandas as pd

        x = np.column_stack([c.to_numpy(dtype="float64", na_value=np.nan) for c in columns]) if len(columns[0]) else np.zeros((0, width))
        total, every = np.zeros(len(x)), np.arange(len(x))
        for t in forest:
            feature, cut, left, right, path = (np.asarray(t[k]) for k in ("feature", "cut", "left", "right", "path"))
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[at]
                going = f >= 0
                if not going.any():
                    break
                low = x[every, np.where(going, f, 0)] <= cut[at]
                at = np.where(going, np.where(low, left[at], right[at]), at)
            total += path[at]
        out = np.power(2.0, -total / len(forest) / expected)
        out[np.isnan(x).any(axis=1)] = np.nan
        return pd.Series(out).where(~np.isnan(out), None)

    return score(*[F.col(c).cast("double") for c in features])


def lonely(points: DataFrame, within_km: float = NOISE_KM, least_group: int = NOISE_GROUP) -> DataFrame:
    """(id, noise) of points (id, zone, lat, lon): whether no other of the zone is within_km.

    Points meet in cubes on the sphere. Two in one cube are near each other whatever else; only a point
    alone in its cube looks around, so what is compared grows with the points, not with pairs. Zones of
    fewer than least_group points have no noise. Points without coordinates are left out.
    """
    chord = 2 * math.sin(min(within_km / geo.EARTH_KM, math.pi) / 2)
    side = chord / math.sqrt(3) * (1 - 1e-9)
    zone = F.coalesce(F.concat(F.lit("="), F.col("zone").cast("string")), F.lit("")).alias("zone")
    lat, lon = F.radians("lat"), F.radians("lon")
    p = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("id", zone, (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))
    p = written(p.select("*", *[F.floor(F.col(c) / side).cast("long").alias(f"c{c}") for c in "xyz"]), "cubes")
    cubes = p.groupBy("zone", "cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("one"))
    zones_ = p.groupBy("zone").agg(F.count(F.lit(1)).alias("all"))
    single = p.join(cubes.where("n = 1").select("zone", "cx", "cy", "cz"), ["zone", "cx", "cy", "cz"]).join(zones_.where(F.col("all") >= least_group).select("zone"), "zone", "left_semi")
    around = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip("ijk", (i, j, k))]) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3)])
    look = single.select("id", "zone", "x", "y", "z", "cx", "cy", "cz", F.explode(around).alias("o"))
    look = look.select("id", "zone", "x", "y", "z", *[(F.col(f"c{c}") + F.col(f"o.{o}")).alias(f"c{c}") for c, o in zip("xyz", "ijk")])
    others = p.select("zone", "cx", "cy", "cz", F.col("id").alias("oid"), *[F.col(c).alias(f"o{c}") for c in "xyz"])
    gap = sum(((F.col(c) - F.col(f"o{c}")) * (F.col(c) - F.col(f"o{c}")) for c in "xyz"), F.lit(0.0))
    near = look.join(others.hint("merge"), ["zone", "cx", "cy", "cz"]).where((F.col("id") != F.col("oid")) & (gap <= chord * chord)).select("id").distinct()
    alone = single.select("id").join(near, "id", "left_anti").withColumn("noise", F.lit(True))
    return p.select("id").join(alone, "id", "left").select("id", F.coalesce("noise", F.lit(False)).alias("noise"))


def zone_offsets(points: DataFrame) -> DataFrame:
    """points (id, zone, lat, lon, far_km) with dx and dy: kilometres from the zone's upper median latitude and longitude."""
    w = Window.partitionBy("zone")
    middle = points.select("zone", "lat", "lon").withColumns({"n": F.count(F.lit(1)).over(w), "a": F.row_number().over(w.orderBy("lat")) - 1, "b": F.row_number().over(w.orderBy("lon")) - 1})
    half = F.floor(F.col("n") / 2)
    middle = middle.groupBy("zone").agg(F.max(F.when(F.col("a") == half, F.col("lat"))).alias("mlat"), F.max(F.when(F.col("b") == half, F.col("lon"))).alias("mlon"))
    met = points.join(middle.withColumnRenamed("zone", "_zone"), F.col("zone").eqNullSafe(F.col("_zone")))
    lat, lon = F.col("lat"), F.col("lon")
    return met.withColumns({"dx": geo.haversine_km(lat, lon, F.col("mlat"), lon), "dy": geo.haversine_km(lat, lon, lat, F.col("mlon"))}).drop("_zone", "mlat", "mlon")


def cut_of_share(scores: DataFrame, share: float) -> float | None:
    """The score that a share of rows reaches or exceeds, interpolated, scores taken to six digits: at most 10^6 counts."""
    counts = scores.where("score IS NOT NULL").groupBy(F.round("score", 6).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.percentile("s", 1 - share, F.col("n"))).first()[0]


def spatial_anomalies(points: DataFrame, share: float = SHARE, trees: int = TREES, seed: int = 42) -> DataFrame:
    """id, score, isolated, noise, anomaly of points (id, zone, lat, lon, far_km: kilometres to the nearest known place).

    score: how far the row lies beyond the cut of the share, negative if beyond, as a forest's decision.
    An isolated row is an anomaly if it is noise too, far away, or clearly beyond the cut. A null far_km is 0.
    """
    usable = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).withColumn("far_km", F.coalesce("far_km", F.lit(0.0)))
    rows = written(zone_offsets(usable), "offsets")
    features = ["dx", "dy", "far_km"]
    forest, seen = grow_forest(rows, "id", features, trees, seed)
    scored = written(rows.select("id", "far_km", isolation_score(forest, seen, features).alias("score")), "scores")
    cut = cut_of_share(scored, share)
    met = scored.join(lonely(rows), "id").withColumn("decision", F.lit(cut).cast("double") - F.round("score", 6))
    isolated = F.col("decision") < 0
    return met.select("id", F.round("decision", 4).alias("score"), isolated.alias("isolated"), "noise", (isolated & (F.col("noise") | (F.col("far_km") > FAR_KM) | (F.abs("decision") > CLEAR_SCORE))).alias("anomaly"))
