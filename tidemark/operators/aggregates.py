"""Grouped statistics: exact upper median, histogram percentiles, circular means, roses, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def upper_quantiles(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, upper median v[n // 2], p90 v[max(0, int(0.9 n) - 1)] and max per group.

    Ranks come from a window sorted by Spark rather than from a collected list, so a hot group spills
    instead of filling one row.
    """
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).select(*keys, value).withColumns({"_n": F.count(F.lit(1)).over(w), "_r": F.row_number().over(w.orderBy(value)) - 1})
    return ranked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg(value), 4).alias("mean"),
        F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2), F.col(value))).alias("median"),
        F.max(F.when(F.col("_r") == F.greatest(F.lit(0), F.floor(F.col("_n") * 0.9) - 1), F.col(value))).alias("p90"),
        F.max(value).alias("max"),
    )


def histogram_percentile(df: DataFrame, keys: list[str], value: str, q: float, width: float) -> DataFrame:
    """Percentile from bins with interpolation inside the bin; counts combine before the shuffle."""
    bins = df.groupBy(*keys, F.floor(F.col(value) / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys)
    upto = bins.withColumns({"total": F.sum("n").over(w), "upto": F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))})
    hit = upto.where(F.col("upto") >= q * F.col("total")).withColumn("k", F.row_number().over(w.orderBy("bin"))).where("k = 1")
    inside = (q * F.col("total") - (F.col("upto") - F.col("n"))) / F.col("n")
    return hit.select(*keys, F.col("total").alias("n"), F.round((F.col("bin") + inside) * width, 4).alias("value"))


def circular_mean(direction: Column) -> Column:
    """Mean direction in degrees: an aggregate."""
    return F.pmod(F.degrees(F.atan2(F.sum(F.sin(F.radians(direction))), F.sum(F.cos(F.radians(direction))))) + 360.0, F.lit(360.0))


def wilson_lower(good: Column, total: Column, z: float = 1.96) -> Column:
    """Lower bound of the Wilson interval of a share."""
    p = good / total
    return (p + z * z / (2 * total) - z * F.sqrt((p * (1 - p) + z * z / (4 * total)) / total)) / (1 + z * z / total)


def zero_filled(counts: DataFrame, dimension: DataFrame, key: str, value: str) -> DataFrame:
    """Counts for every member of a dimension, 0 where there are none."""
    return dimension.select(key).distinct().join(counts, key, "left").select(key, F.coalesce(value, F.lit(0)).cast("long").alias(value))
