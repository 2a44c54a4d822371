"""Grid files against numpy, samples and roses against plain loops."""

import io
import math
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import climate
from tidemark.sources import grids

LATS, LONS = [-10.0 + 2 * k for k in range(11)], [-180.0 + 1.5 * k for k in range(240)]


def save(folder, kind, month, **fields):
    np.savez_compressed(folder / f"{kind}-{month:02d}.npz", **fields)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("grids")
    rng = np.random.default_rng(5)
    for month in (1, 3, 12):
        u = rng.normal(size=(11, 240)).astype("float32")
        u[2, 7] = np.nan
        more = {"extra": np.ones((11, 240), "int32")} if month == 12 else {}
        save(at, "wind", month, lats=np.array(LATS), lons=np.array(LONS), u=u, pct=rng.random((11, 240, 8)), sea=rng.random((11, 240)) > 0.5, stat=np.array(["rose"]), **more)
    save(at, "wave", 1, lats=np.array(LATS), lons=np.array(LONS), u=np.zeros((11, 240)))
    (at / "wind-1.npz").write_bytes(b"other")
    return at


def test_all_months_equal_numpy(spark, folder):
    df = grids.read_grids(spark, str(folder), "wind", "u double, sea boolean, pct array<double>, extra bigint", rows=4)
    assert df.rdd.getNumPartitions() == 9  # three blocks of each month
    rows = df.collect()
    assert len(rows) == 3 * 11 * 240
    files = {m: np.load(folder / f"wind-{m:02d}.npz") for m in (1, 3, 12)}
    for r in rows:
        f = files[r.month]
        assert (r.lat, r.lon) == (LATS[r.i], LONS[r.j]) and r.sea == f["sea"][r.i, r.j] and r.pct == f["pct"][r.i, r.j].tolist()
        assert r.u is None if (r.i, r.j) == (2, 7) else r.u == float(f["u"][r.i, r.j])
        assert r.extra == (1 if r.month == 12 else None)


def test_schema_comes_from_headers(spark, folder):
    df = grids.read_grids(spark, str(folder), "wind")
    assert df.columns == ["month", "i", "j", "lat", "lon", "pct", "sea", "u"]
    assert dict(df.dtypes)["pct"] == "array<double>" and dict(df.dtypes)["sea"] == "boolean"


def test_only_asked_blocks_and_members_are_read(spark, folder):
    df = grids.read_grids(spark, f"file://{folder}", "wind", "u double", months="3,4", lat_min=-3, lat_max=3, rows=2)
    assert df.rdd.getNumPartitions() == 2  # rows 4-5 and 6-7 of one month
    assert {(r.month, r.lat) for r in df.select("month", "lat").distinct().collect()} == {(3, x) for x in (-2.0, 0.0, 2.0)}
    source = grids.NpzGrids({"path": str(folder), "kind": "wind", "months": "3"})
    asked, real = [], zipfile.ZipFile.open
    try:
        zipfile.ZipFile.open = lambda self, name, *a, **k: asked.append(name) or real(self, name, *a, **k)
        reader = source.reader(df.schema)
        list(reader.read(reader.partitions()[0]))
    finally:
        zipfile.ZipFile.open = real
    assert set(asked) == {"lats.npy", "lons.npy", "u.npy"}


def test_missing_months_folders_and_bad_files(spark, folder, tmp_path):
    assert grids.read_grids(spark, str(folder), "wind", "u double", months="2").count() == 0
    assert grids.read_grids(spark, str(tmp_path / "none"), "wind", "u double").count() == 0
    save(tmp_path, "odd", 1, lats=np.array([0.0]), lons=np.array([0.0]), u=np.array([[object()]]))
    with pytest.raises(Exception, match="objects"):
        grids.read_grids(spark, str(tmp_path), "odd", "u double").collect()


def test_rows_of_a_member(tmp_path):
    a = np.arange(60, dtype="int16").reshape(10, 3, 2)
    data = io.BytesIO()
    np.savez_compressed(data, a=a, f=np.asfortranarray(np.ones((3, 3)) * [1, 2, 3]))
    with zipfile.ZipFile(data) as z:
        assert (grids._rows(z, "a", 4, 7) == a[4:7]).all()
        with pytest.raises(ValueError, match="by rows"):
            grids._rows(z, "f", 0, 1)


def test_written_and_read_back(spark, tmp_path):
    rows = [(m, i, j, float(m * i), i * j, (i + j) % 2 == 0, [float(i), float(j)]) for m in (1, 2) for i in range(0, 11, 2) for j in range(0, 240, 7)]
    cells = spark.createDataFrame(rows, "month int, i int, j int, v double, n bigint, sea boolean, pair array<double>").repartition(5)
    lacking = spark.createDataFrame([(2, 1, 1, None, None, None, None)], cells.schema)
    for _ in range(2):  # a repeated job gives the same files
        assert grids.write_grids(cells.unionByName(lacking), str(tmp_path), "w", LATS, LONS) == [1, 2]
    assert sorted(x.name for x in tmp_path.iterdir()) == ["w-01.npz", "w-02.npz"]
    got = grids.read_grids(spark, str(tmp_path), "w", "v double, n bigint, sea boolean, pair array<double>")
    assert got.count() == 2 * 11 * 240
    full = got.where("v IS NOT NULL").select(cells.columns)
    assert sorted(map(tuple, full.collect())) == sorted((*r[:6], r[6]) for r in rows)
    hole = got.where("month = 2 AND i = 1 AND j = 1").first()
    assert (hole.v, hole.n, hole.sea) == (None, 0, False) and hole.pair == [None, None]
    assert grids.write_grids(cells.limit(0), str(tmp_path), "none", LATS, LONS) == []


def test_sampling_equals_a_loop(spark, folder):
    rng = random.Random(3)
    asked = [(k, rng.choice([1, 2, 3, None]), rng.uniform(-14, 14), rng.uniform(-400, 400)) for k in range(400)]
    asked += [(400, 1, -9.0, 0.75), (401, 1, -10.0, -180.0), (402, 1, -10.0, 180.0), (403, 1, -10.0, 179.5), (404, 1, None, 0.0), (405, 1, 0.0, None)]
    points = spark.createDataFrame(asked, "id int, month int, lat double, lon double")
    g = grids.read_grids(spark, str(folder), "wind", "u double, sea boolean")
    got = {r.id: r.u for r in grids.sample(points, g, (-10.0, 2.0, 11), (-180.0, 1.5, 240), F.col("sea")).collect()}
    files = {m: np.load(folder / f"wind-{m:02d}.npz") for m in (1, 3)}
    wrap = lambda x: (x + 180) % 360 - 180
    for k, month, lat, lon in asked:
        want = None
        if month in files and lat is not None and lon is not None:
            i, j = int(abs(np.array(LATS) - lat).argmin()), int(abs(np.array(LONS) - wrap(lon)).argmin())
            if abs(LATS[i] - lat) <= 0.75 and abs(wrap(LONS[j] - wrap(lon))) <= 0.75 and files[month]["sea"][i, j] and not np.isnan(files[month]["u"][i, j]):
                want = float(files[month]["u"][i, j])
        assert got[k] == want, (k, month, lat, lon)
    assert len(got) == len(asked)


def test_roses_equal_a_loop(spark):
    rng = random.Random(8)
    samples = [(c, rng.gauss(0, 8), rng.gauss(3, 8)) for c in range(6) for _ in range(10 * c)] + [(1, None, 1.0), (2, float("nan"), 1.0), (6, float("inf"), 0.0)]
    cells = climate.wind_cells(spark.createDataFrame(samples, "c int, u double, v double"), ["c"]).collect()
    assert {r.c for r in cells} == {1, 2, 3, 4, 5}
    for r in cells:
        mine = [(u, v) for c, u, v in samples if c == r.c and u is not None and math.isfinite(u)]
        kn = [math.hypot(u, v) * 1.94384 for u, v in mine]
        sec = [int(((math.degrees(math.atan2(-u, -v)) + 360) % 360 + 22.5) % 360 // 45) for u, v in mine]
        share = [100 * sec.count(k) / len(mine) for k in range(8)]
        assert (r.sample_count, r.sea_mask) == (len(mine), len(mine) > 20)
        assert r.sector_pct == pytest.approx([0 if p < 2.5 else p for p in share])
        assert r.sector_spd == pytest.approx([sum(s for s, x in zip(kn, sec) if x == k) / max(1, sec.count(k)) for k in range(8)])
        assert r.calm_pct == pytest.approx(100 * sum(s <= 3 for s in kn) / len(kn)) and r.gale_pct == pytest.approx(100 * sum(s >= 34 for s in kn) / len(kn))


def test_most_likely_wind_is_not_the_mean(spark):
    spec = "pct array<double>, spd array<double>, u_mean double, v_mean double, calm_pct double, gale_pct double, sample_count bigint, sea_mask boolean"
    pct, spd = [0.0, 60.0, 2.4, 0.0, 0.0, 35.0, 2.6, 0.0], [0.0, 16.0, 5.0, 0.0, 0.0, 30.0, 9.0, 0.0]
    rows = [(pct, spd, 1.0, 2.0, 1.0, 0.0, 40, True), ([50.0, 50.0] + [0.0] * 6, [7.0, 8.0] + [0.0] * 6, 0.0, -3.0, 0.0, 0.0, 40, None), ([50.0, 50.0] + [0.0] * 6, [7.0, 7.0] + [0.0] * 6, 0.0, -3.0, 0.0, 0.0, None, True),
            ([0.0] * 8, spd, 1.0, 1.0, 0.0, 0.0, 40, True), (pct, spd, None, 1.0, 0.0, 0.0, 40, True), (pct, spd, 1.0, 1.0, 0.0, 0.0, 0, True), (pct, spd, 1.0, 1.0, 0.0, 0.0, 40, False), (None, None, 1.0, 1.0, 0.0, 0.0, 40, True)]
    cells = spark.createDataFrame(rows, spec).withColumnsRenamed({"pct": "sector_pct", "spd": "sector_spd"}).coalesce(1)
    got = climate.winds(cells.where(climate.has_wind())).collect()
    assert [(r.from_deg, r.knots) for r in got] == [(45, 16.0), (45, 8.0), (0, 7.0)]
    assert [x.dir_deg for x in got[0].directions_from] == [45, 225, 270] and got[0].mean_from_deg == 206.6 and got[0].mean_knots == 4.3


def test_slow_currents_and_thinned_grids(spark):
    c = climate.currents(spark.createDataFrame([(0.0, 0.05), (1.0, 0.0), (None, 1.0)], "uo double, vo double")).collect()
    assert [(r.knots, r.toward_deg, r.below) for r in c] == [(0.0, 0.0, True), (1.94, 90.0, False), (None, None, None)]
    g = spark.range(9 * 9).select((F.col("id") / 9).cast("int").alias("i"), (F.col("id") % 9).cast("int").alias("j"))
    for cell, spacing, step in ((0.5, 1.0, 2), (0.1, 1.0, 4), (1.5, 4.0, 3), (1.5, 99.0, 3), (1.0, 0.1, 1)):
        assert climate.thinned(g, cell, spacing).count() == len(range(0, 9, step)) ** 2
