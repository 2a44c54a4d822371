"""Histogram statistics of waves per grid cell, as a state that chunks of samples are added to.

The state is a long table: (cell keys, kind, bin, n, s, c). Kinds: `hs` and `per` count samples by bin, `dir`
sums sines and cosines. A chunk becomes such rows with partial counts before any shuffle; states add up by
summing, in whatever order and between runs. No sample is read twice, none is kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Width and number of bins of heights and periods, samples that make a cell sea.
HEIGHT_BIN, HEIGHT_BINS, PERIOD_BIN, PERIOD_BINS, MIN_SAMPLES = 0.05, 400, 0.1, 200, 20


def _finite(c: str):
    return F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def _bin(c: str, width: float, bins: int):
    return F.least(F.greatest(F.floor(F.col(c) / width), F.lit(0)), F.lit(bins - 1)).cast("int")


def wave_state(samples: DataFrame, keys: list[str]) -> DataFrame:
    """State of samples (keys, hs, period, direction), doubles. Only samples with a finite height count; outer bins take what lies beyond."""
    d = F.radians("direction")
    row = lambda kind, bin_, s=F.lit(0.0), c=F.lit(0.0): F.struct(F.lit(kind).alias("kind"), bin_.alias("bin"), s.alias("s"), c.alias("c"))
    parts = F.array(
        row("hs", _bin("hs", HEIGHT_BIN, HEIGHT_BINS)),
        F.when(_finite("period"), row("per", _bin("period", PERIOD_BIN, PERIOD_BINS))),
        F.when(_finite("direction"), row("dir", F.lit(0), F.sin(d), F.cos(d))),
    )
    each = samples.where(_finite("hs")).select(*keys, F.explode(F.array_compact(parts)).alias("p")).select(*keys, "p.*")
    return each.groupBy(*keys, "kind", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("s").alias("s"), F.sum("c").alias("c"))


def merged(states: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of several states as one state."""
    return states.groupBy(*keys, "kind", "bin").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("c").alias("c"))


def _percentile(state: DataFrame, keys: list[str], kind: str, q: float, width: float, name: str) -> DataFrame:
    """Value below which a share q lies, evenly spread inside the bin that reaches it."""
    w = Window.partitionBy(*keys)
    upto = state.where(F.col("kind") == kind).select(*keys, "bin", "n").withColumns({"upto": F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), "goal": F.sum("n").over(w) * F.lit(q)})
    frac = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.col("goal") - (F.col("upto") - F.col("n"))) / F.col("n")))
    return upto.where(F.col("upto") >= F.col("goal")).groupBy(*keys).agg(F.min_by((F.col("bin") + frac) * width, "bin").alias(name))


def wave_statistics(state: DataFrame, keys: list[str], min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Per cell: n, sea, hs_p50, hs_p90 (never below the median), period (median) and direction (circular mean); null on land."""
    found = state.groupBy(*keys).agg(F.sum(F.when(F.col("kind") == "hs", F.col("n")).otherwise(0)).alias("n"), F.sum("s").alias("s"), F.sum("c").alias("c"), F.max(F.col("kind") == "dir").alias("any"))
    for kind, q, width, name in (("hs", 0.5, HEIGHT_BIN, "p50"), ("hs", 0.9, HEIGHT_BIN, "p90"), ("per", 0.5, PERIOD_BIN, "per")):
        found = found.join(_percentile(state, keys, kind, q, width, name), keys, "left")
    sea = F.col("n") >= min_samples
    mean = F.pmod(F.degrees(F.atan2("s", "c")) + 360.0, F.lit(360.0))
    shown = {"hs_p50": F.col("p50"), "hs_p90": F.greatest("p50", "p90"), "period": F.col("per"), "direction": F.when(F.col("any"), mean)}
    return found.select(*keys, "n", sea.alias("sea"), *[F.when(sea, v).alias(k) for k, v in shown.items()])


class WaveHistograms:
    """A state in a folder: every chunk adds a part; fold puts the parts together. Parts are never changed."""

    def __init__(self, folder: str, keys: list[str]):
        self.folder, self.keys = folder.rstrip("/"), keys

    def add(self, samples: DataFrame, chunk: str) -> None:
        """Adds a chunk under its name; adding the same chunk again replaces it, so a job can be repeated."""
        wave_state(samples, self.keys).write.mode("overwrite").parquet(f"{self.folder}/chunk={chunk}")

    def state(self, spark) -> DataFrame:
        return merged(spark.read.parquet(self.folder).drop("chunk"), self.keys)

    def fold(self, spark) -> WaveHistograms:
        """All parts as one, in a folder of its own beside this one."""
        out = WaveHistograms(f"{self.folder}-{uuid.uuid4().hex[:8]}", self.keys)
        self.state(spark).write.parquet(f"{out.folder}/chunk=all")
        return out
