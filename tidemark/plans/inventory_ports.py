"""A port index made of suppliers, written as CSV files and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.plans.catalog import register
from tidemark.sources import port_index
from tidemark.sources.scratch import shared_folder
from tidemark.sources.tables import table


@register("src_07_port_index", """
WITH p AS (SELECT CASE WHEN k % 13 > 0 THEN (k % (SELECT greatest(1, max(s_suppkey) * 3 // 4) FROM supplier))::VARCHAR ELSE '' END AS index, 'Pört, "' || k || '"' AS name,
  CASE k % 4 WHEN 3 THEN -(k % 80 + k % 60 / 60.0::DOUBLE) WHEN 2 THEN k % 90 + k % 50 / 60.0::DOUBLE + 30 / 3600.0::DOUBLE ELSE k % 900 / 10.0::DOUBLE - 45 END AS lat, k % 1790 / 10.0::DOUBLE AS lon,
  CASE WHEN k % 3 = 0 THEN 'Cargo' ELSE 'Unknown' END AS harbor_use, CASE WHEN k % 5 = 0 THEN 'Other ' || k END AS alt, CASE WHEN k % 2 = 0 THEN 'XX' || k END AS unlocode, k
  FROM (SELECT s_suppkey AS k FROM supplier) WHERE k % 11 > 0 AND k % 17 > 0)
SELECT index, arg_min(name, k) AS name, round(arg_min(lat, k), 6) AS lat, round(arg_min(lon, k), 6) AS lon, arg_min(harbor_use, k) AS harbor_use, first(alt ORDER BY k) AS alt, first(unlocode ORDER BY k) AS unlocode FROM p GROUP BY index, CASE WHEN index = '' THEN k END""")
def src_07(spark, d):
    """Indices repeat beyond three quarters of the suppliers; of a repeated one the first in the files stays."""
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    s = s.crossJoin(F.broadcast(s.agg(F.greatest(F.lit(1), F.floor(F.max(k) * 3 / 4)).alias("m"))))  # one row
    name = F.when(k % 11 > 0, F.concat(F.lit('Pört, "'), k.cast("string"), F.lit('"')))
    text = lambda c: c.cast("string")
    lat = F.when(k % 4 == 3, F.concat(text(k % 80), F.lit("°"), text(k % 60), F.lit("'S"))).when(k % 4 == 2, F.concat(F.lit("N "), text(k % 90), F.lit("°"), text(k % 50), F.lit("'30''"))).otherwise(text(k % 900 / 10 - 45))
    raw = s.select(
        k, F.when(k % 13 > 0, F.concat(text(k % F.col("m")), F.lit(".0"))).alias("World Port Index Number"), name.alias("Main Port Name"), F.when(k % 5 == 0, F.concat(F.lit("Other "), text(k))).otherwise(F.upper(name)).alias("Alternate Port Name"),
        F.when(k % 17 > 0, lat).otherwise("none").alias("Latitude"), text(k % 1790 / 10).alias("LONGITUDE"), F.when(k % 3 == 0, "Cargo").alias("Harbor Use"), F.when(k % 2 == 0, F.concat(F.lit("XX"), text(k))).alias("UN/LOCODE"),
    )
    folder = f"{shared_folder(spark)}/ports-{uuid.uuid4().hex}"
    raw.repartitionByRange(k).sortWithinPartitions(k).drop("s_suppkey").write.option("header", True).option("escape", '"').csv(folder)
    return port_index.read_port_index(spark, folder).select("index", "name", "lat", "lon", "harbor_use", "alt", "unlocode")
