"""Shared helpers: intermediate tables, hold-out splits, word definitions and broadcast bounds."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

#: ASCII white space; every other character belongs to a word.
SPACES = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

_own_dir: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session.

    Only where the setting is absent and Spark runs in this process (local runs and tests) is a folder
    of this machine used; on a cluster that is refused.
    """
    global _own_dir
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if _own_dir is None:
        _own_dir = tempfile.mkdtemp(prefix="tidemark-")
    return f"file://{_own_dir}"


def materialize(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Writes df as a table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a table that this package has written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def ranked(rows: DataFrame, order: list[Column], name: str, group: str | None = None) -> DataFrame:
    """Adds rank, from 1, in the given order, within each value of group (not null) where one is named.

    Rows are dealt by range of group and order and written; a rank is the row's number in its part and
    group, and the rows of that group in earlier parts. No task holds more than one part.
    """
    keys = [group] if group else []
    placed = materialize(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), name)
    counts = placed.groupBy("_part", *keys).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("_before", before).drop("_n")
    inside = placed.withColumn("_k", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*order)))
    return inside.join(starts, ["_part", *keys]).withColumn("rank", F.col("_k") + F.col("_before")).drop("_part", "_k", "_before")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id written as text, modulo modulus; null ids count as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def text_or_empty(text_col: str = "text") -> Column:
    return F.coalesce(F.col(text_col), F.lit(""))


def native_words(text: Column) -> Column:
    """Array of the words of a text, by JVM functions only."""
    return F.filter(F.split(text, SPACE_CLASS + "+"), lambda w: w != "")


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether df has at most so many rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


#: Rows of one key that may meet in a task before the key is salted, and keys that are salted at most.
SALT_ROWS, MAX_SALTED = 256, 1 << 16


def salted_join(rows: DataFrame, side: DataFrame, key: str, spread: str, how: str = "inner", counted: DataFrame | None = None) -> DataFrame:
    """rows joined with side by key, the hottest keys spread over salts by the column spread.

    A key with more than SALT_ROWS rows gets one salt per so many rows, and its row of side a copy per
    salt. Of these the MAX_SALTED with most rows are listed and broadcast; any other key then has less
    than one in MAX_SALTED of all rows. counted: a table with the same keys that is cheaper to count.
    """
    counts = (rows if counted is None else counted).where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    found = counts.where(F.col("_n") > SALT_ROWS).orderBy(F.desc("_n")).limit(MAX_SALTED).collect()
    if not found:
        return rows.join(side.hint("merge"), key, how)  # both sides grow with the input
    spark, kind = rows.sparkSession, rows.schema[key].dataType.simpleString()
    hot = F.broadcast(spark.createDataFrame([(r[0], -(-r[1] // SALT_ROWS)) for r in found], f"{key} {kind}, _parts long"))
    parts = F.coalesce("_parts", F.lit(1))
    left = rows.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), parts)).drop("_parts")
    right = side.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1))).drop("_parts")
    return left.join(right.hint("merge"), [key, "_salt"], how).drop("_salt")


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the Python workers of the session, once: they may not have it on their path."""
    import os
    import zipfile

    import tidemark

    context = spark.sparkContext
    if getattr(context, "_tidemark_sent", False):
        return
    top = os.path.dirname(os.path.abspath(tidemark.__file__))
    if os.path.isdir(top):
        target = os.path.join(tempfile.mkdtemp(prefix="tidemark-code-"), "tidemark.zip")
        with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
            for folder, _, names in os.walk(top):
                for name in sorted(n for n in names if n.endswith(".py")):
                    at = os.path.join(folder, name)
                    z.write(at, os.path.relpath(at, os.path.dirname(top)))
        context.addPyFile(target)
    context._tidemark_sent = True
