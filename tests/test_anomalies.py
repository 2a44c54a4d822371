"""Isolation forest and noise against plain loops."""

import math
import random

from pyspark.sql import functions as F

from tidemark.operators import anomalies as an


def walk(tree, row):
    at = 0
    while tree["feature"][at] >= 0:
        at = tree["left"][at] if row[tree["feature"][at]] <= tree["cut"][at] else tree["right"][at]
    return tree["path"][at]


def km(a, b):
    p, q, d = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    return 6371.0 * math.acos(max(-1, min(1, math.sin(p) * math.sin(q) + math.cos(p) * math.cos(q) * math.cos(d))))


def test_scores_are_those_of_a_plain_walk_and_outliers_come_first(spark):
    r = random.Random(3)
    rows = [(k, r.gauss(0, 1), r.gauss(0, 1)) for k in range(1500)] + [(2000, 9.0, -9.0), (2001, -12.0, 11.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    forest, seen = an.grow_forest(df, "id", ["a", "b"], trees=60)
    assert seen == 256 and len(forest) == 60 and max(len(t["feature"]) for t in forest) < 512
    got = dict(df.select("id", an.isolation_score(forest, seen, ["a", "b"])).collect())
    for i, *x in rows:
        assert abs(got[i] - 2 ** (-sum(walk(t, x) for t in forest) / 60 / an.expected_path(256))) < 1e-12
    assert set(sorted(got, key=got.get)[-5:]) >= {2000, 2001}
    again, _ = an.grow_forest(df.repartition(7), "id", ["a", "b"], trees=60)
    assert again == forest  # whatever the partitions


def test_paths():
    assert an.expected_path(0) == an.expected_path(1) == 0 and an.expected_path(2) == 1.0
    tree = an.grow([(1.0,)] * 20, random.Random(1))
    assert tree["feature"] == [-1] and tree["path"] == [an.expected_path(20)]  # equal rows can't be split


def test_missing_features_and_tables(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, float("nan"))], "id int, a double")
    forest, seen = an.grow_forest(df, "id", ["a"], trees=3)
    got = dict(df.select("id", an.isolation_score(forest, seen, ["a"])).collect())
    assert seen == 1 and got[1] is not None and got[2] is None and got[3] is None
    empty = an.grow_forest(df.limit(0), "id", ["a"])
    assert empty == ([], 0) and df.select(an.isolation_score(*empty, ["a"]).alias("s")).where("s IS NOT NULL").count() == 0
    assert an.spatial_anomalies(spark.createDataFrame([], "id int, zone int, lat double, lon double, far_km double")).count() == 0


def test_noise(spark):
    r = random.Random(5)
    rows = [(k, r.choice([1, 2, None]), r.uniform(-90, 90), r.choice([r.uniform(-180, 180), 179.9, -179.9])) for k in range(200)] + [(300, 7, 10.0, 10.0), (301, 7, 50.0, 50.0), (302, 8, 10.0, 10.0), (303, 8, 10.0, 10.0), (304, 8, 60.0, 10.0), (305, 8, None, 1.0), (306, 1, 90.0, 0.0), (307, 1, 89.9, 180.0)]
    df = spark.createDataFrame(rows, "id int, zone int, lat double, lon double")
    for eps in (150.0, 1200.0):
        got = dict(map(tuple, an.lonely(df, eps).collect()))
        here = [x for x in rows if x[2] is not None]
        size = {z: sum(x[1] == z for x in here) for z in {x[1] for x in here}}
        assert got == {x[0]: size[x[1]] >= 3 and not any(y[1] == x[1] and y[0] != x[0] and km(x[2:], y[2:]) <= eps for y in here) for x in here}


def test_planted_anomalies(spark):
    r = random.Random(8)
    rows = [(z * 100 + k, z, 10.0 * z + r.gauss(0, 0.1), 5.0 * z + r.gauss(0, 0.1), 3.0) for z in range(5) for k in range(80)] + [(9001, 2, 60.0, 100.0, 900.0), (9002, 3, -50.0, -120.0, 2.0)]
    df = spark.createDataFrame(rows, "id int, zone int, lat double, lon double, far_km double")
    got = an.spatial_anomalies(df, trees=50).collect()
    assert {x.id for x in got if x.anomaly} >= {9001, 9002} and len([x for x in got if x.isolated]) <= 0.05 * len(rows) + 1
    assert len(got) == len(rows) and {x.id for x in got if x.noise} == {9001, 9002}


def test_upper_median_offsets(spark):
    df = spark.createDataFrame([(1, None, 0.0, 5.0, 1.0), (2, None, 1.0, 7.0, 1.0), (3, 4, 2.0, 2.0, None)], "id int, zone int, lat double, lon double, far_km double")
    got = {x.id: (round(x.dx, 3), round(x.dy, 3)) for x in an.zone_offsets(df).collect()}
    one = 6371.0 * math.pi / 180
    assert got == {1: (round(one, 3), round(2 * one, 3)), 2: (0.0, 0.0), 3: (0.0, 0.0)}
