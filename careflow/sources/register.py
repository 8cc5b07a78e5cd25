"""Facility register ingest.

``register_load`` turns a raw register (every column a string, headers in
whatever spelling the publisher used) into the 21-column typed register.
Header resolution happens at plan time over ``df.columns``; everything else
is a single projection, so the load is one narrow stage over the input files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careflow.functions import lexicon as L
from careflow.functions.text import normalize_identifier

REGISTER_SCHEMA = T.StructType(
    [
        T.StructField("index", T.StringType()),
        T.StructField("facility_name", T.StringType()),
        T.StructField("source_facility_type", T.StringType()),
        T.StructField("odhf_facility_type", T.StringType()),
        T.StructField("provider", T.StringType()),
        T.StructField("unit", T.StringType()),
        T.StructField("street_no", T.StringType()),
        T.StructField("street_name", T.StringType()),
        T.StructField("postal_code", T.StringType()),
        T.StructField("city", T.StringType()),
        T.StructField("province", T.StringType()),
        T.StructField("source_format_str_address", T.StringType()),
        T.StructField("csdname", T.StringType()),
        T.StructField("csduid", T.DoubleType()),
        T.StructField("pruid", T.IntegerType()),
        T.StructField("latitude", T.DoubleType()),
        T.StructField("longitude", T.DoubleType()),
        T.StructField("full_address", T.StringType()),
        T.StructField("facility_id_normalized", T.StringType()),
        T.StructField("is_quebec", T.BooleanType()),
        T.StructField("ingested_at", T.TimestampNTZType()),
    ]
)


def resolve_aliases(columns: list[str], aliases: dict[str, list[str]] = L.REGISTER_ALIASES) -> dict[str, str | None]:
    """A2: target -> source header. Case-insensitive; the first alias in the list that exists wins.

    When two headers differ only in case, the later one is the one found.
    """
    lowered: dict[str, str] = {}
    for name in columns:
        lowered[name.lower()] = name
    out: dict[str, str | None] = {}
    for target, names in aliases.items():
        out[target] = next((lowered[a.lower()] for a in names if a.lower() in lowered), None)
    return out


def lenient_double(c: Column) -> Column:
    """A5: '' or unparsable -> NULL."""
    return F.nullif(c, F.lit("")).try_cast("double")


def lenient_int(c: Column) -> Column:
    """A5: integer through a float, truncated ('3.9' -> 3)."""
    return lenient_double(c).try_cast("int")


def full_address(*parts: Column) -> Column:
    """B1: non-empty parts joined by ', ', then leading/trailing ',' and ' ' stripped."""
    joined = F.concat_ws(", ", *[F.nullif(p, F.lit("")) for p in parts])
    return F.regexp_replace(joined, r"^[, ]+|[, ]+$", "")


def is_quebec(province: Column) -> Column:
    """B2: upper(trim(province)) in the Quebec spellings."""
    return F.upper(F.trim(province)).isin(*L.QUEBEC_PROVINCE_NAMES)


def register_load(raw: DataFrame, ingested_at: str | Column, aliases: dict[str, list[str]] = L.REGISTER_ALIASES) -> DataFrame:
    """A1: raw string register -> typed register (REGISTER_SCHEMA column order)."""
    src = resolve_aliases(raw.columns, aliases)

    def text(target: str) -> Column:
        name = src.get(target)
        return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit("")) if name else F.lit("")

    ts = ingested_at if isinstance(ingested_at, Column) else F.to_timestamp_ntz(F.lit(ingested_at))
    street_no, street_name, city, postal = text("street_no"), text("street_name"), text("city"), text("postal_code")
    name = text("facility_name")
    return raw.select(
        text("index").alias("index"),
        name.alias("facility_name"),
        text("source_facility_type").alias("source_facility_type"),
        text("odhf_facility_type").alias("odhf_facility_type"),
        text("provider").alias("provider"),
        text("unit").alias("unit"),
        street_no.alias("street_no"),
        street_name.alias("street_name"),
        postal.alias("postal_code"),
        city.alias("city"),
        text("province").alias("province"),
        text("source_format_str_address").alias("source_format_str_address"),
        text("csdname").alias("csdname"),
        lenient_double(text("csduid")).alias("csduid"),
        lenient_int(text("pruid")).alias("pruid"),
        lenient_double(text("latitude")).alias("latitude"),
        lenient_double(text("longitude")).alias("longitude"),
        full_address(street_no, street_name, city, postal).alias("full_address"),
        normalize_identifier(F.concat_ws(" ", name, city, postal)).alias("facility_id_normalized"),
        is_quebec(text("province")).alias("is_quebec"),
        ts.alias("ingested_at"),
    )


def read_register_csv(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV files with a header row, every column read as a string (no inference)."""
    return spark.read.option("header", True).option("encoding", encoding).option("inferSchema", False).csv(path)


# Bytes 0x80-0x9F of windows-1252 by rule; the five bytes without a letter there stay control characters.
_C1 = "".join(map(chr, range(0x80, 0xA0)))
_CP1252 = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(0x80, 0xA0))


def decode_fallback(content: Column) -> Column:
    """A3: bytes -> text: UTF-8 (BOM stripped) when the bytes are valid UTF-8, else windows-1252.

    Spark 4 accepts the name windows-1252 only with a legacy setting; it is ISO-8859-1 but for bytes 0x80-0x9F,
    which a ``translate`` maps after decoding."""
    utf8 = F.regexp_replace(F.decode(content, "UTF-8"), "^\ufeff", "")
    return F.when(F.is_valid_utf8(content.cast("string")), utf8).otherwise(F.translate(F.decode(content, "ISO-8859-1"), _C1, _CP1252))


def optional_table(spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
    """The table when it exists, else an empty frame of the same schema."""
    if spark.catalog.tableExists(name):
        return spark.table(name)
    return spark.createDataFrame([], schema)


def require_nonempty(df: DataFrame, what: str) -> DataFrame:
    """Refuse to publish an empty load (checks for one row only)."""
    if df.isEmpty():
        raise ValueError(f"refusing to publish an empty {what}")
    return df


def load_counts(df: DataFrame, ts_col: str) -> DataFrame:
    """Row count and snapshot time of a load, one aggregate row."""
    return df.agg(F.count(F.lit(1)).alias("rows_loaded"), F.max(ts_col).alias("snapshot_at"))
