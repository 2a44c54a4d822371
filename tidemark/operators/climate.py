"""What grid cells of a climate atlas say of a place: roses, waves, currents, thinned grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import geo

#: Degrees per sector of a rose, least share of a sector that is shown, least knots of a current.
SECTOR_DEG, MIN_SECTOR_PCT, CURRENT_MIN_KN = 45, 2.5, 0.15
#: Bounds of the spacing of a thinned grid, and the least cell size it is measured by.
SPACING, LEAST_CELL = (0.5, 4.0), 0.25
#: Knots up to which wind is calm and from which it is a gale, samples that a sea cell exceeds.
CALM_KN, GALE_KN, SEA_SAMPLES = 3, 34, 20
SECTORS = 8


def wind_cells(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Cells (keys) of a rose atlas from samples (keys, u, v in m/s); samples that are null or not finite do not count.

    sector_pct, sector_spd (mean knots), calm_pct, gale_pct, u_mean, v_mean, sample_count, sea_mask. Sums combine before the shuffle.
    """
    knots, source = geo.wind_from_uv(F.col("u"), F.col("v"))
    finite = knots.isNotNull() & ~F.isnan(knots) & (knots != float("inf"))
    s = samples.where(finite).select(*keys, "u", "v", knots.alias("kn"), geo.sector(source, SECTORS).alias("sec"))
    tally = lambda cond: F.count(F.when(cond, 1))
    sums = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), tally(F.col("kn") <= CALM_KN).alias("calm"), tally(F.col("kn") >= GALE_KN).alias("gale"), F.avg("u").alias("u_mean"), F.avg("v").alias("v_mean"),
        F.array(*[tally(F.col("sec") == k) for k in range(SECTORS)]).alias("sec_n"), F.array(*[F.coalesce(F.sum(F.when(F.col("sec") == k, F.col("kn"))), F.lit(0.0)) for k in range(SECTORS)]).alias("sec_kn"),
    )
    share = lambda c: c * 100.0 / F.col("n")
    pct = F.transform("sec_n", lambda c: F.when(share(c) < MIN_SECTOR_PCT, 0.0).otherwise(share(c)))
    spd = F.zip_with("sec_kn", "sec_n", lambda total, c: F.when(c > 0, total / c).otherwise(0.0))
    return sums.select(*keys, pct.alias("sector_pct"), spd.alias("sector_spd"), share(F.col("calm")).alias("calm_pct"), share(F.col("gale")).alias("gale_pct"), "u_mean", "v_mean", F.col("n").alias("sample_count"), (F.col("n") > SEA_SAMPLES).alias("sea_mask"))


def has_wind() -> Column:
    """Whether a rose cell is to be used: sea with samples (an unknown count or mask does not rule it out), with a mean and a sector."""
    n = F.col("sample_count")
    counted = F.coalesce(n > 0, F.lit(True)) & F.coalesce("sea_mask", F.lit(True))
    filled = F.coalesce(F.exists("sector_pct", lambda p: p > 0), F.lit(False)) | F.coalesce(n > 0, F.lit(False))
    return counted & F.col("u_mean").isNotNull() & F.col("v_mean").isNotNull() & filled


def rose(sector_pct: Column, sector_spd: Column) -> Column:
    """Sectors of MIN_SECTOR_PCT or more as an array of (dir_deg, pct, speed_knots), rounded, in order of direction."""
    each = F.zip_with(sector_pct, sector_spd, lambda p, s: F.struct(p.alias("p"), s.alias("s")))
    named = F.transform(each, lambda x, k: F.struct((k * SECTOR_DEG).alias("dir_deg"), x["p"].alias("pct"), x["s"].alias("speed_knots")))
    kept = F.filter(named, lambda x: x["pct"] >= MIN_SECTOR_PCT)
    return F.transform(kept, lambda x: F.struct(x["dir_deg"].alias("dir_deg"), F.round(x["pct"], 1).alias("pct"), F.round(x["speed_knots"], 1).alias("speed_knots")))


def most_likely(directions: Column) -> Column:
    """(dir_deg, speed_knots) of the sector with the greatest share, then the greatest speed, then the first; null without any."""
    ranked = F.transform(directions, lambda x: F.struct(x["pct"].alias("p"), x["speed_knots"].alias("s"), (-x["dir_deg"]).alias("d")))
    top = F.array_max(ranked)
    return F.when(top.isNotNull(), F.struct((-top["d"]).alias("dir_deg"), top["s"].alias("speed_knots")))


def winds(cells: DataFrame) -> DataFrame:
    """Cells (sector_pct, sector_spd, calm_pct, gale_pct, u_mean, v_mean, ...) with what is shown of them.

    Adds directions_from, knots and from_deg (most likely), mean_knots and mean_from_deg (of the mean vector).
    Cells without a sector worth showing are left out.
    """
    knots, source = geo.wind_from_uv(F.col("u_mean"), F.col("v_mean"))
    shown = cells.withColumn("directions_from", rose(F.col("sector_pct"), F.col("sector_spd"))).where(F.size("directions_from") > 0)
    top = most_likely(F.col("directions_from"))
    return shown.withColumns({"knots": top["speed_knots"], "from_deg": top["dir_deg"], "mean_knots": F.round(knots, 1), "mean_from_deg": F.round(source, 1), "calm_pct": F.round("calm_pct", 1), "gale_pct": F.round("gale_pct", 1)})


def currents(cells: DataFrame) -> DataFrame:
    """Cells (uo, vo, ...) with knots, toward_deg and below; too slow a current has 0 knots and keeps its direction."""
    knots, toward = geo.current_to_uv(F.col("uo"), F.col("vo"))
    below = knots < CURRENT_MIN_KN
    return cells.withColumns({"knots": F.when(below, 0.0).otherwise(F.round(knots, 2)), "toward_deg": F.round(toward, 1), "below": below})


def thinned(grid: DataFrame, cell_deg: float, spacing_deg: float) -> DataFrame:
    """Every n-th row and column of a grid, so that cells lie about spacing_deg apart."""
    spacing = max(SPACING[0], min(SPACING[1], spacing_deg))
    step = max(1, round(spacing / max(LEAST_CELL, cell_deg)))
    return grid.where((F.col("i") % step == 0) & (F.col("j") % step == 0))
