"""Writers: snapshots, upserts and GeoJSON features, all of them distributed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, key: str, only_on_insert: tuple[str, ...] = ()) -> DataFrame:
    """Rows of old with the values of new where new has the key; columns of only_on_insert change for new keys alone."""
    n = new.select(F.col(key), *[F.col(c).alias(f"_new_{c}") for c in new.columns if c != key], F.lit(True).alias("_hit"))
    o = old.select("*", F.lit(True).alias("_had"))
    pick = lambda c: F.col(c) if f"_new_{c}" not in n.columns else F.when(F.col("_hit") & ~(F.lit(c in only_on_insert) & F.coalesce("_had", F.lit(False))), F.col(f"_new_{c}")).otherwise(F.col(c))
    return o.join(n, key, "full_outer").select(*[F.col(c) if c == key else pick(c).alias(c) for c in old.columns])


def feature(lon: Column, lat: Column, properties: Column) -> Column:
    """GeoJSON point feature as a struct."""
    return F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), properties.alias("properties"))


def write_features(df: DataFrame, path: str) -> None:
    """Newline-delimited features; files stay apart, as one collection would need one task."""
    df.select(F.to_json("feature").alias("value")).write.mode("overwrite").text(path)


def write_snapshot(df: DataFrame, path: str, run_col: str = "run_id") -> None:
    """Overwrites only the runs that df holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run_col).parquet(path)
