"""Diameters of groups against all pairs."""

import math
import random

from tidemark.operators import spread


def km(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0 * math.asin(min(1.0, math.sqrt(h)))


def test_diameters_are_those_of_all_pairs(spark):
    r = random.Random(3)
    groups = {
        1: [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(60)],
        2: [(10 + r.gauss(0, 0.01), 179.99 + r.gauss(0, 0.02)) for _ in range(80)],
        3: [(45 + 0.3 * math.sin(k), 7 + 0.3 * math.cos(k)) for k in range(50)],  # a ring: many pairs are almost the farthest
        4: [(1.0, 2.0)] * 5,
        5: [(1.0, 2.0)],
        6: [(0.0, 0.0), (0.0, 180.0)],
        7: [(89.9, k * 60.0) for k in range(6)],
        None: [(1.0, 1.0), (1.00001, 1.0)],
    }
    rows = [(g, *p) for g, ps in groups.items() for p in ps] + [(1, None, 3.0), (8, None, None), (2, float("nan"), 1.0)]
    got = {x.group: (x.n, x.km) for x in spread.diameters(spark.createDataFrame(rows, "group int, lat double, lon double")).collect()}
    assert got.keys() == groups.keys()
    for g, ps in groups.items():
        assert got[g][0] == len(ps) and abs(got[g][1] - max(km(a, b) for a in ps for b in ps)) < 1e-4, g


def test_a_group_of_many_members(spark):
    from pyspark.sql import functions as F

    n = 200_000
    df = spark.range(n).select(F.lit(1).alias("group"), (F.rand(1) * 4 + 40).alias("lat"), (F.rand(2) * 5 + 3).alias("lon")).union(spark.createDataFrame([(1, 39.0, 2.0), (1, 45.0, 9.0)], "group int, lat double, lon double"))
    (x,) = spread.diameters(df).collect()
    assert x.n == n + 2 and abs(x.km - km((39.0, 2.0), (45.0, 9.0))) < 1e-4


def test_no_points(spark):
    assert spread.diameters(spark.createDataFrame([], "group int, lat double, lon double")).count() == 0
