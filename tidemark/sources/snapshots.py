"""Content fingerprints and dated snapshots that are never written twice."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "MANIFEST.json"
_LIMBS = 8


def canonical_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A row as JSON with its keys in order, nulls included."""
    return F.to_json(F.struct(*[F.col(c) for c in sorted(columns or df.columns)]), {"ignoreNullFields": "false"})


def fingerprint(df: DataFrame, by: list[str] | None = None, columns: list[str] | None = None, digits: int = 12) -> DataFrame:
    """by, count and fingerprint of the rows as a multiset.

    The digests of the rows' canonical JSON are added up, in eight parts of 32 bits, and the sums with the
    count hashed: any order and any partitioning give the same value, and sums combine before the shuffle.
    An ordered digest of one text would have to pass through a single task.
    """
    by = by or []
    rows = df.select(*by, F.sha2(canonical_json(df, columns).cast("binary"), 256).alias("d"))
    parts = [F.conv(F.substring("d", 8 * k + 1, 8), 16, 10).cast("decimal(20,0)").alias(f"p{k}") for k in range(_LIMBS)]
    sums = rows.select(*by, *parts).groupBy(*by).agg(F.count(F.lit(1)).alias("count"), *[F.coalesce(F.sum(f"p{k}"), F.lit(0)).cast("decimal(38,0)").alias(f"p{k}") for k in range(_LIMBS)])
    shown = F.concat_ws(":", F.col("count").cast("string"), *[F.col(f"p{k}").cast("string") for k in range(_LIMBS)])
    return sums.select(*by, "count", F.substring(F.sha2(shown.cast("binary"), 256), 1, digits).alias("fingerprint"))


def version(date: Column, mark: Column) -> Column:
    """Version of an export: date and fingerprint."""
    return F.concat(date, F.lit("."), mark)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def write_snapshot(datasets: dict[str, DataFrame], base: str, date: str) -> dict:
    """Writes base/date/<name> for each dataset and a manifest; an existing date is refused.

    Everything is written beside the target first and renamed at the end, so a date is either complete or
    absent, and of two writers one fails. Returns the manifest.
    """
    if not datasets or any("/" in n or n == MANIFEST for n in (*datasets, date)) or not date:
        raise ValueError("a snapshot needs a date and datasets with plain names")
    spark = next(iter(datasets.values())).sparkSession
    target, draft = f"{base.rstrip('/')}/{date}", f"{base.rstrip('/')}/_draft-{uuid.uuid4().hex}"
    fs, at = _fs(spark, target)
    if fs.exists(at):
        raise FileExistsError(date)
    manifest = {"date": date, "immutable": True, "files": {}}
    for name, df in sorted(datasets.items()):
        df.write.parquet(f"{draft}/{name}")
        found = fingerprint(spark.read.schema(df.schema).parquet(f"{draft}/{name}")).first()
        manifest["files"][name] = {"dataset": name, "version": f"{date}.{found['fingerprint']}", "content_sha256": found["fingerprint"], "count": found["count"]}
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{draft}/{MANIFEST}")
    from_ = spark._jvm.org.apache.hadoop.fs.Path(draft)
    if fs.exists(at) or not fs.rename(from_, at):
        fs.delete(from_, True)
        raise FileExistsError(date)
    return manifest


def read_manifest(spark: SparkSession, base: str, date: str) -> dict:
    return json.loads(spark.read.text(f"{base.rstrip('/')}/{date}/{MANIFEST}").first()[0])


def verify_snapshot(spark: SparkSession, base: str, date: str) -> dict[str, bool]:
    """Whether each dataset of a snapshot still has the count and fingerprint of its manifest."""
    out = {}
    for name, m in read_manifest(spark, base, date)["files"].items():
        found = fingerprint(spark.read.parquet(f"{base.rstrip('/')}/{date}/{name}")).first()
        out[name] = (found["count"], found["fingerprint"]) == (m["count"], m["content_sha256"])
    return out
