"""How far apart the members of a group lie, without comparing all of them.

Members lie on the sphere in cubes, each with the box of its members and one of them as its witness. For a
pair of cubes the boxes' farthest corners bound the distance of any two members from above, two witnesses
give one from below. Pairs of cubes that cannot reach the best distance of their group so far are dropped,
the others are cut into smaller cubes, until both bounds meet. Work follows the cubes near the group's ends,
not its members' pairs; no group is gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geo
from tidemark.sources.scratch import written

#: Side of the first cubes on the unit sphere, how many times smaller the next are, and the gap of bounds that is left.
FIRST, FINER, GAP = 0.5, 4, 1e-9
_AXES = "xyz"


def _cubes(points: DataFrame, side: float) -> DataFrame:
    """(group, cx, cy, cz, box): cubes with their members' box and one member."""
    at = [F.floor(F.col(c) / side).cast("long").alias(f"c{c}") for c in _AXES]
    box = [f(c).alias(f"{n}{c}") for c in _AXES for n, f in (("lo", F.min), ("hi", F.max))]
    cubes = points.select("group", *_AXES, *at).groupBy("group", *[f"c{c}" for c in _AXES]).agg(*box, F.min(F.struct(*_AXES)).alias("m"))
    return cubes.select("group", *[f"c{c}" for c in _AXES], F.struct(*[F.col(f"{n}{c}") for c in _AXES for n in ("lo", "hi")], "m").alias("box"))


def _square(parts: list[Column]) -> Column:
    return sum((p * p for p in parts[1:]), parts[0] * parts[0])


def _bounded(pairs: DataFrame) -> DataFrame:
    """pairs of boxes a and b with the squares of the bounds of their members' distances, and without those that fall short."""
    far = [F.greatest(F.abs(F.col(f"a.hi{c}") - F.col(f"b.lo{c}")), F.abs(F.col(f"b.hi{c}") - F.col(f"a.lo{c}"))) for c in _AXES]
    near = [F.col(f"a.m.{c}") - F.col(f"b.m.{c}") for c in _AXES]
    both = written(pairs.withColumns({"most": F.least(_square(far), F.lit(4.0)), "least": _square(near)}), "cube-pairs")
    best = both.groupBy("group").agg(F.max("least").alias("best"))
    return both.join(best, "group").where(F.col("most") >= F.col("best"))


def diameters(points: DataFrame) -> DataFrame:
    """(group, n, km) of points (group, lat, lon): how many there are, and the great-circle distance of the two farthest.

    Points without coordinates are left out; a group of one place, repeated or not, has 0 km. A null group
    is a group. The distance is that of two members, within a millimetre or so of the greatest.
    """
    key = F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit(""))
    lat, lon = F.radians("lat"), F.radians("lon")
    usable = points.where(F.col("lat").isNotNull() & F.col("lon").isNotNull() & ~F.isnan("lat") & ~F.isnan("lon"))
    sizes = written(usable.groupBy(F.col("group").alias("shown"), key.alias("group")).agg(F.count(F.lit(1)).alias("n")), "group-sizes")
    places = usable.select(key.alias("group"), (F.cos(lat) * F.cos(lon)).alias("x"), (F.cos(lat) * F.sin(lon)).alias("y"), F.sin(lat).alias("z"))
    places = written(places.distinct(), "places")

    side, ids = FIRST, [f"c{c}" for c in _AXES]
    cubes = written(_cubes(places, side), "cubes")
    a, b = cubes.select("group", F.struct(*ids).alias("i"), F.col("box").alias("a")), cubes.select("group", F.struct(*ids).alias("j"), F.col("box").alias("b"))
    pairs = _bounded(a.join(b.hint("merge"), "group").where(F.col("i") <= F.col("j")))  # a sphere has some hundred first cubes
    while not pairs.where(F.sqrt("most") - F.sqrt("best") > GAP).isEmpty():
        cut = pairs.select("group", "i", "j", "best")
        wanted = cut.select("group", F.explode(F.array("i", "j")).alias("k")).distinct().select("group", *[F.col(f"k.{c}").alias(c) for c in ids])
        inside = places.withColumns({f"c{c}": F.floor(F.col(c) / side).cast("long") for c in _AXES}).join(wanted, ["group", *ids], "left_semi").drop(*ids)
        side /= FINER
        small = _cubes(inside, side).withColumn("parent", F.struct(*[F.floor(F.col(c) / FINER).cast("long").alias(c) for c in ids]))
        small = written(small, "cubes")
        left = small.select("group", F.col("parent").alias("i"), F.struct(*ids).alias("ni"), F.col("box").alias("a"))
        right = small.select("group", F.col("parent").alias("j"), F.struct(*ids).alias("nj"), F.col("box").alias("b"))
        met = cut.select("group", "i", "j").join(left.hint("merge"), ["group", "i"]).join(right.hint("merge"), ["group", "j"])
        pairs = _bounded(met.where((F.col("i") != F.col("j")) | (F.col("ni") <= F.col("nj"))).select("group", F.col("ni").alias("i"), F.col("nj").alias("j"), "a", "b"))
    chord = pairs.groupBy("group").agg(F.max("best").alias("best"))
    km = 2 * geo.EARTH_KM * F.asin(F.least(F.sqrt("best") / 2, F.lit(1.0)))
    return sizes.join(chord, "group").select(F.col("shown").alias("group"), "n", km.alias("km"))
