"""Importance resampling against plain Python, and its defined cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm import resampling as rs

SCHEMA = "doc_id long, text string"


def features(text, orders):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(rs.UPPER, rs.LOWER)))
    return w, [" ".join(w[i : i + k]) for k in range(1, orders + 1) for i in range(len(w) - k + 1)]


def plain(rows, target, orders=2, buckets=10_000, min_words=20, percent=25, seed=7):
    """Sorted (doc_id, n_features, weight, score, rank)."""
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    got = [(i, *features(t, orders)) for i, t in rows]
    s, t = Counter(bucket(f) for _, _, fs in got for f in fs), Counter(bucket(f) for x in target for f in features(x, orders)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = []
    for i, w, fs in got:
        weight = sum(gain[bucket(f)] for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(w), len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((x for x in out if x[1] >= min_words), key=lambda x: (-x[4], -1 if x[0] is None else x[0]))
    rank = {id(x): k + 1 for k, x in enumerate(able[: percent * len(able) // 100])}
    return sorted(((i, n, w, sc, rank.get(id(x))) for x in out for i, _, n, w, sc in [x]), key=repr)


def run(spark, rows, target, **more):
    docs, aims = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(x,) for x in target], "text string")
    return sorted((tuple(r) for r in rs.importance_resample(docs, aims, **more).select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


def texts(n, seed):
    r = random.Random(seed)
    return [" ".join(r.choice(["Alpha", "beta,", "x1", "été", "日本", "γ-ray", "end."]) for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_random_texts_and_orders(spark):
    rows = list(enumerate(texts(40, 1)))
    for orders, buckets in ((1, 7), (2, 10_000), (3, 50)):
        assert run(spark, rows, texts(5, 2), orders=orders, buckets=buckets) == plain(rows, texts(5, 2), orders, buckets)


def test_nulls_empty_long_and_repeated_rows(spark):
    """Repeated rows keep their own positions; their scores tie, and either may have the last rank."""
    same = " ".join(["one two three"] * 10)
    rows = [(1, None), (2, ""), (3, "-- 12.5 !"), (4, "word"), (None, same), (5, same), (5, same), (6, "long text " * 30_000), (7, same)]
    for percent in (25, 50, 100, 0):
        assert run(spark, rows, ["one two", None, ""], percent=percent) == plain(rows, ["one two", None, ""], percent=percent)


def test_empty_tables_and_clashing_columns(spark):
    assert run(spark, [], ["a b"]) == []
    rows = list(enumerate(texts(9, 4)))
    assert run(spark, rows, []) == plain(rows, [])
    clash = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in ("row", "pos", "word", "b1", "bucket", "rank", "score", "weight")})
    got = rs.importance_resample(clash, spark.createDataFrame([("a b", 1)], "text string, row int")).select("doc_id", "n_features", "weight", "score", "rank")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain(rows, ["a b"])


def test_ranks_over_many_parts(spark):
    rows = [(k, "a b c d e f g h i j k l m n o p q r s t u " + "z" * (k % 3)) for k in range(500)]
    assert run(spark, rows, ["z zz"], percent=90) == plain(rows, ["z zz"], percent=90)


def test_query(spark):
    t = lambda name, *cols: [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").select(*cols).collect()]
    want = plain(t("documents", "doc_id", "text"), [x for (x,) in t("benchmark", "text")])
    assert sorted((tuple(r) for r in rs.op12_resampling(spark, "/root/testdata/sf0.001").collect()), key=repr) == want
