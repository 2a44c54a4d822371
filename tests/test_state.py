"""Histogram states in chunks, fingerprints and snapshots."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import histograms as hg
from tidemark.sources import snapshots

SAMPLE = "i int, j int, hs double, period double, direction double"


def waves(n, cells, seed):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(cells):
        for j in range(cells):
            for h in rng.gamma(2.0, 1.2, n):
                out.append((i, j, float("nan") if (i, j) == (2, 2) else float(h), float(h) * 3 + 4, 220.0))
    return out


def test_two_chunks_are_one_pass_and_a_repeated_chunk_counts_once(spark, tmp_path):
    rows = waves(80, 3, 42) + [(0, 0, None, 1.0, 1.0), (0, 0, 3.0, None, None), (0, 0, 500.0, float("inf"), float("nan")), (5, 5, 1.0, 2.0, 3.0)]
    random.Random(1).shuffle(rows)
    one = hg.wave_statistics(hg.wave_state(spark.createDataFrame(rows, SAMPLE), ["i", "j"]), ["i", "j"], 10)
    kept = hg.WaveHistograms(f"file://{tmp_path}/waves", ["i", "j"])
    for name, part in (("a", rows[:300]), ("b", rows[300:]), ("a", rows[:300])):
        kept.add(spark.createDataFrame(part, SAMPLE), name)
    shown = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert shown(hg.wave_statistics(kept.state(spark), ["i", "j"], 10)) == shown(one)
    assert shown(hg.wave_statistics(kept.fold(spark).state(spark), ["i", "j"], 10)) == shown(one)
    got = {(r.i, r.j): r for r in one.collect()}
    assert (2, 2) not in got and not got[5, 5].sea and got[5, 5].hs_p50 is None and got[5, 5].n == 1
    for (i, j), r in got.items():
        if r.sea:
            own = [min(x[2], 19.99) for x in rows if x[:2] == (i, j) and x[2] is not None]
            assert r.hs_p90 >= r.hs_p50 > 0 and abs(r.hs_p50 - np.percentile(own, 50)) < 0.2 and abs(r.hs_p90 - np.percentile(own, 90)) < 0.3
            assert 219 < r.direction < 221 and abs(r.period - (3 * r.hs_p50 + 4)) < 0.4


def test_percentile_inside_a_bin(spark):
    rows = [(0, 0, 0.01 * 5 * k + 0.001, 1.0, 90.0) for k in range(200)]
    (r,) = hg.wave_statistics(hg.wave_state(spark.createDataFrame(rows, SAMPLE), ["i", "j"]), ["i", "j"]).collect()
    assert (round(r.hs_p50, 9), round(r.hs_p90, 9), r.n) == (5.0, 9.0, 200) and math.isclose(r.direction, 90)


def test_fingerprint_of_rows_in_any_order(spark):
    rows = [(k, f"t{k % 7}", None if k % 5 else 1.5, [k]) for k in range(200)]
    df = spark.createDataFrame(rows, "b int, a string, c double, d array<int>")
    mark = lambda x: x.first()["fingerprint"]
    one = mark(snapshots.fingerprint(df))
    assert len(one) == 12 == len(one.strip()) and one == mark(snapshots.fingerprint(df.orderBy(F.desc("b")).repartition(7))) == mark(snapshots.fingerprint(df.select("d", "c", "b", "a")))
    assert one != mark(snapshots.fingerprint(df.where("b > 0"))) and one != mark(snapshots.fingerprint(df.union(df))) and one != mark(snapshots.fingerprint(df.withColumn("a", F.upper("a"))))
    assert snapshots.fingerprint(df.limit(0)).first()["count"] == 0
    assert snapshots.fingerprint(df, ["a"], ["b", "c"]).count() == 7


def test_a_snapshot_is_written_once_and_checked(spark, tmp_path):
    a, b = spark.range(10).withColumn("x", F.lit("y")), spark.createDataFrame([], "k int")
    base = f"file://{tmp_path}/exports"
    manifest = snapshots.write_snapshot({"ports": a, "none": b}, base, "2026-01-02")
    assert manifest == snapshots.read_manifest(spark, base, "2026-01-02") and manifest["files"]["ports"]["count"] == 10
    assert manifest["files"]["ports"]["version"] == "2026-01-02." + snapshots.fingerprint(a).first()["fingerprint"]
    assert snapshots.verify_snapshot(spark, base, "2026-01-02") == {"ports": True, "none": True}
    with pytest.raises(FileExistsError):
        snapshots.write_snapshot({"ports": a}, base, "2026-01-02")
    snapshots.write_snapshot({"ports": a}, base, "2026-01-03")
    assert sorted(p.name for p in (tmp_path / "exports").iterdir()) == ["2026-01-02", "2026-01-03"]
    spark.range(3).withColumn("x", F.lit("z")).write.mode("append").parquet(f"{base}/2026-01-03/ports")
    assert snapshots.verify_snapshot(spark, base, "2026-01-03") == {"ports": False}
    with pytest.raises(ValueError):
        snapshots.write_snapshot({}, base, "2026-01-04")
