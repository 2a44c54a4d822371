import json
import math
import random

from pyspark.sql import functions as F

from tidemark.functions import geo, text
from tidemark.operators import matching as match
from tidemark.sources import sinks, tables
from tidemark.streaming import events as stream


def km(a, b, c, d):
    p, q, x = math.radians(a), math.radians(c), math.radians(d - b)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(x / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def test_neighbours_against_brute_force(spark):
    """Poles and the antimeridian included."""
    r = random.Random(0)
    place = lambda: (r.choice([r.uniform(-90, 90), r.uniform(85, 90), r.uniform(-90, -88)]), r.choice([r.uniform(-180, 180), r.uniform(178, 180), r.uniform(-180, -178)]))
    left, right = [(i, *place()) for i in range(150)], [(i, *place()) for i in range(150)] + [(900, 90.0, 0.0), (901, -90.0, 10.0)]
    for radius in (5.0, 300.0, 2500.0):
        got = {(x["id"], x["rid"]) for x in match.neighbours(spark.createDataFrame(left, "id long, lat double, lon double"), spark.createDataFrame(right, "rid long, rlat double, rlon double"), radius).collect()}
        assert got == {(i, j) for i, a, b in left for j, c, d in right if km(a, b, c, d) <= radius + 1e-6}


def test_geohash(spark):
    got = spark.createDataFrame([(57.64911, 10.40744), (-25.382708, -49.265506)], "lat double, lon double").select(geo.geohash(F.col("lat"), F.col("lon"), 7).alias("h")).collect()
    assert [x["h"] for x in got] == ["u4pruyd", "6gkzwgj"]


def test_destination_and_back(spark):
    df = spark.createDataFrame([(10.0, 179.5, 90.0, 200.0), (-45.0, 3.0, 200.0, 50.0)], "lat double, lon double, b double, km double")
    la, lo = geo.destination(F.col("lat"), F.col("lon"), F.col("b"), F.col("km"))
    for x in df.withColumns({"la": la, "lo": lo}).collect():
        assert abs(km(x["lat"], x["lon"], x["la"], x["lo"]) - x["km"]) < 1e-6 and -180 <= x["lo"] < 180


def test_dms(spark):
    got = spark.createDataFrame([("36°50'00\"N",), ("-12.5",), ("012 30 00 W",), ("?",), (None,)], "c string").select(tables.dms(F.col("c")).alias("v")).collect()
    assert [x["v"] if x["v"] is None else round(x["v"], 4) for x in got] == [36.8333, -12.5, -12.5, None, None]


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, name string, made int")
    new = spark.createDataFrame([(2, "B", 9), (3, "c", 9)], "k int, name string, made int")
    assert sorted(map(tuple, sinks.upsert(old, new, "k", ("made",)).collect())) == [(1, "a", 1), (2, "B", 2), (3, "c", 9)]


def test_features_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.5, 2.5, "x")], "lon double, lat double, name string").select(sinks.feature(F.col("lon"), F.col("lat"), F.struct("name")).alias("feature"))
    sinks.write_features(df, str(tmp_path / "out"))
    (line,) = [x for p in (tmp_path / "out").glob("part-*") for x in p.read_text().splitlines()]
    (tmp_path / "one.json").write_text(json.dumps({"type": "FeatureCollection", "features": [json.loads(line)]}))
    assert [tuple(r) for r in tables.geojson_points(spark, str(tmp_path / "one.json")).select("properties.name", "lon", "lat").collect()] == [("x", 1.5, 2.5)]


def test_stream_equals_batch(spark, tmp_path):
    batch = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    live = stream.event_stream(spark, str(tmp_path / "in"), 1)
    for name, df, mode in (("last", stream.last_event(live), "complete"), ("windows", stream.windowed_counts(live, late="20000 days"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
    key = lambda rows: sorted(repr(tuple(r)) for r in rows)
    assert key(spark.table("last").collect()) == key(stream.last_event(batch).collect())
    assert key(spark.table("windows").collect()) == key(stream.windowed_counts(batch.withColumn("ts", F.col("ts").cast("timestamp"))).collect())


def test_bbox_crosses_the_antimeridian(spark):
    from tidemark.functions import geo

    points = [("fiji", -17.0, 177.0), ("fiji", -18.0, -179.0), ("fiji", None, 5.0), ("world", 0.0, -180.0), ("world", 1.0, 180.0), ("near", 46.0, -1.5), ("near", 47.0, 2.0)]
    rows = geo.bbox_of_points(spark.createDataFrame(points, "box string, lat double, lon double"), "box").collect()
    got = {r["box"]: (r["west"], r["south"], r["east"], r["north"]) for r in rows}
    assert got == {"fiji": (177.0, -18.0, 181.0, -17.0), "world": (-180.0, 0.0, 180.0, 1.0), "near": (-1.5, 46.0, 2.0, 47.0)}


def test_ring_centroid_of_degenerate_rings(spark):
    from tidemark.functions import geo

    rings = [(1, [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0), (0.0, 0.0)]), (2, [(5.0, 6.0), (7.0, 8.0)]), (3, [(1.0, 1.0), (2.0, 2.0), (3.0, 3.0), (1.0, 1.0)]), (4, [])]
    df = spark.createDataFrame(rings, "id int, ring array<struct<x double, y double>>")
    got = {r["id"]: r["c"] and tuple(r["c"]) for r in df.selectExpr("id", "ring").select("id", geo.ring_centroid(df.ring).alias("c")).collect()}
    assert got == {1: (2.0, 1.0), 2: (5.0, 6.0), 3: (1.0, 1.0), 4: None}


def test_navigation_rule_words(spark):
    import re

    from tidemark.plans.inventory_rows import _RULE, NAVIGATION_WORDS

    texts = ["VHF 16", "un canal étroit", "canalisation", "no-anchor zone", "tirant d'eau", "étirant", "port d’entr", "harbour master", "restaurant, vue mer", "", "predraft", "draft."]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(df.t.rlike(_RULE)).collect()]
    assert got == [bool(re.search(rf"\b({NAVIGATION_WORDS})\b", t, re.I)) for t in texts]


def test_urls_without_scheme_and_with_user(spark):
    rows = ["example.com/list", "other.org/x/", "https://www.A.org:8080/p/?q=1#f", "http://user:pw@host.org/a", "//b.org/c", " n/a ", "host:8080/y", "www.d.org"]
    df = spark.createDataFrame([(k, u) for k, u in enumerate(rows)], "k int, u string")
    u = F.col("u")
    got = {r.k: r for r in df.select("k", text.hit_key(u).alias("hit"), text.normalized_url(u).alias("norm"), text.listed_key(u).alias("listed"), text.host(u).alias("host")).collect()}
    assert [got[k].hit for k in range(5)] == ["https://example.com/list", "https://other.org/x", "https://a.org/p", "http://host.org/a", "https://b.org/c"]
    assert [got[k].norm for k in range(5)] == ["https:///example.com/list", "https:///other.org/x", "https://a.org:8080/p?q=1", "http://host.org/a", "https://b.org/c"]
    assert [got[k].listed for k in range(8)] == ["https://example.com/list", "https://other.org/x", "https://a.org:8080/p", "http://user:pw@host.org/a", None, None, "https://host:8080/y", "https://d.org"]
    assert got[3].host == "host.org"


def test_unwrapping_keeps_half_a_turn(spark):
    def turned(previous, lon):
        while lon - previous > 180:
            lon -= 360
        while lon - previous < -180:
            lon += 360
        return lon

    pairs = [(p, x) for p in (-530.0, -180.0, -10.0, 0.0, 170.0, 180.0, 550.0) for x in (-180.0, -179.5, -10.0, 0.0, 10.0, 170.0, 179.5, 180.0)]
    got = spark.createDataFrame(pairs, "p double, x double").select("p", "x", geo.unwrap_lon(F.col("p"), F.col("x")).alias("u")).collect()
    assert len(got) == len(pairs) and all(r["u"] == turned(r["p"], r["x"]) for r in got)
