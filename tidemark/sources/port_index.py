"""Port index in CSV files whose headers vary: usable rows as records, each index once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import normalize_name

#: Names that a field goes by, in order of preference.
ALIASES = {
    "index": ("World Port Index Number", "WPI Number", "wpinumber", "INDEX_NO", "index"),
    "name": ("Main Port Name", "main_port_", "PORT_NAME", "name"),
    "alt": ("Alternate Port Name", "alternate_", "alt"),
    "lat": ("Latitude", "LATITUDE", "Y", "lat"),
    "lon": ("Longitude", "LONGITUDE", "X", "lon"),
    "harbor_use": ("Harbor Use", "harbor_use", "harborUse"),
    "country": ("Country Code", "countryCode", "COUNTRY", "country"),
    "unlocode": ("UN/LOCODE", "unlocode", "UNLOCODE"),
}
#: Longest names and codes.
NAME_CHARS, CODE_CHARS = 200, 12
#: Fixed value: how degrees, minutes and seconds are written.
_NUMBER = r"\d+(?:\.\d+)?"
_PARTS = rf"(?i)([NSEW])?\s*({_NUMBER})[°\s]\s*(?:({_NUMBER})\s*['′]?\s*)?(?:({_NUMBER})\s*[\"″]?\s*)?([NSEW])?"


def degrees(raw: Column) -> Column:
    """Degrees from a decimal of at most 180, or from degrees, minutes and seconds with a hemisphere before or after; else null."""
    text = F.replace(F.trim(raw), F.lit("''"), F.lit('"'))
    plain = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text.try_cast("double"))
    tight = F.regexp_replace(text, r"\s", "")
    shown = F.when(tight.rlike(_PARTS), tight).otherwise(text)
    part = lambda k: F.coalesce(F.regexp_extract(shown, _PARTS, k).try_cast("double"), F.lit(0.0))
    after = F.upper(F.regexp_extract(shown, _PARTS, 5))
    side = F.when(after != "", after).otherwise(F.upper(F.regexp_extract(shown, _PARTS, 1)))
    value = part(2) + part(3) / 60 + part(4) / 3600
    value = F.when(side.isin("S", "W"), -value).otherwise(value)
    return F.when(F.abs(plain) <= 180, plain).when(shown.rlike(_PARTS) & (F.abs(value) <= 180), value)


def index_key(raw: Column) -> Column:
    """An index without the fraction that spreadsheets add: "100.0" is "100"; other texts stay."""
    text = F.trim(raw)
    return F.when(text.rlike(r"^[+-]?\d+(\.0*)?$"), F.regexp_replace(F.regexp_replace(text, r"\..*$", ""), r"^(?:\+|(-))?0*(?=\d)", "$1")).otherwise(text)


def _field(raw: DataFrame, field: str) -> Column:
    """The first of a field's columns that says something; "" if none does. Exact names go before those that differ in case."""
    found = []
    for name in ALIASES[field]:
        same = [c for c in raw.columns if c == name] or [c for c in raw.columns if c.strip().lower() == name.lower()]
        found += [F.trim(F.col(f"`{c}`").cast("string")) for c in same]
    said = [F.when(~F.lower(c).isin("", "none", "nan"), c) for c in found]
    return F.coalesce(*said, F.lit(""))


def records(raw: DataFrame, *keep: str) -> DataFrame:
    """Usable rows as index, name, lat, lon, country, harbor_use, alt, unlocode, and the columns to keep.

    Rows without a name or with coordinates that are absent, unreadable or off the globe are left out. alt is null
    if it is the name again, unlocode if there is none; an unnamed use is Unknown.
    """
    f = raw.select(*keep, *[_field(raw, k).alias(k) for k in ALIASES])
    lat, lon = degrees(F.col("lat")), degrees(F.col("lon"))
    other = (F.col("alt") != "") & (F.lower("alt") != F.lower("name"))
    use = F.when(F.col("harbor_use") == "", "Unknown").otherwise(F.col("harbor_use"))
    f = f.withColumns({"lat": lat, "lon": lon}).where((F.col("name") != "") & F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180))
    return f.select(
        *keep, index_key(F.col("index")).alias("index"), F.substring("name", 1, NAME_CHARS).alias("name"), F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "country",
        use.alias("harbor_use"), F.when(other, F.substring("alt", 1, NAME_CHARS)).alias("alt"), F.when(F.col("unlocode") != "", F.substring("unlocode", 1, CODE_CHARS)).alias("unlocode"),
    )


def read_port_index(spark: SparkSession, path: str) -> DataFrame:
    """Records of CSV files with a header, of each index (or place and name, without one) the first, by file and position.

    Texts are UTF-8, or Latin-1 where they are not valid UTF-8, which is decided per value: files are read as
    bytes that Latin-1 keeps as they are. Quoted values may hold commas, not line ends, so large files are split.
    """
    raw = spark.read.option("header", True).option("encoding", "ISO-8859-1").option("escape", '"').csv(path)
    utf = lambda c: F.encode(c, "ISO-8859-1").cast("string")
    named = {c: c.encode("latin-1", "replace").decode("utf-8-sig", "replace") for c in raw.columns}
    text = raw.select(*[F.when(F.is_valid_utf8(utf(F.col(f"`{c}`"))), utf(F.col(f"`{c}`"))).otherwise(F.col(f"`{c}`")).alias(n) for c, n in named.items()], F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id()).alias("_at"))
    rec = records(text, "_at")
    place = F.concat_ws(":", F.col("lat").cast("string"), F.col("lon").cast("string"), normalize_name(F.col("name"), NAME_CHARS))
    key = F.when(F.col("index") != "", F.col("index")).otherwise(place)
    rec = rec.withColumn("_key", key)
    return rec.groupBy("_key").agg(F.min_by(F.struct(*[c for c in rec.columns if not c.startswith("_")]), "_at").alias("r")).select("r.*")
