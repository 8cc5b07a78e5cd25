"""Sinks and archive sources.

* ``overwrite_table`` (A13) replaces a table with a frame of an explicit schema.
* ``append_snapshot`` (A14) appends a load partitioned by its snapshot date,
  so readers of one day prune every other day's files.
* ``append_rows`` (A17) appends a whole batch (intakes, queue rows, contacts)
  in one write instead of one INSERT per row.
* ``archive_records`` (A4 + A3) reads zip archives with ``binaryFile`` and
  expands the first CSV member of each on the executors (``mapInPandas``):
  bytes are decoded as UTF-8 with BOM, else windows-1252, else Latin-1, and
  each record becomes a header->value map with lower-cased headers (a later
  header that differs only in case wins). ``register_from_records`` then
  resolves the register aliases per column with ``coalesce`` over the map,
  which picks the first alias that is present.
"""

from __future__ import annotations

import csv
import io
import zipfile
from itertools import batched

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careflow.functions import lexicon as L

ARCHIVE_RECORD_SCHEMA = T.StructType(
    [
        T.StructField("archive_path", T.StringType()),
        T.StructField("member", T.StringType()),
        T.StructField("row_num", T.LongType()),
        T.StructField("record", T.MapType(T.StringType(), T.StringType())),
    ]
)
FALLBACK_ENCODINGS = ("utf-8-sig", "cp1252", "latin-1")


def overwrite_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Full replace (data and schema). Never point ``path`` at a table the frame itself reads."""
    df.write.mode("overwrite").format(fmt).save(path)


def append_snapshot(df: DataFrame, path: str, ts_col: str = "scraped_at", fmt: str = "parquet") -> None:
    """Append a load, partitioned by the snapshot date of ``ts_col``."""
    df.withColumn("snapshot_date", F.to_date(F.col(ts_col))).write.mode("append").partitionBy("snapshot_date").format(fmt).save(path)


def append_rows(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Append a whole batch of rows in one write."""
    df.write.mode("append").format(fmt).save(path)


def _decode(raw: bytes) -> str:
    for enc in FALLBACK_ENCODINGS:
        try:
            return raw.decode(enc)
        except UnicodeDecodeError:
            continue
    raise ValueError("undecodable CSV")


def _records(batches):
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            with zipfile.ZipFile(io.BytesIO(content)) as zf:
                member = next((n for n in zf.namelist() if n.lower().endswith(".csv")), None)
                if member is None:
                    continue
                reader = csv.reader(io.StringIO(_decode(zf.read(member))))
                header = next(reader, [])
                for i, values in enumerate(v for v in reader if v):  # a blank line is no record
                    yield path, member, i, {h.lower(): v for h, v in zip(header, values)}


def _expand(batches):
    for rows in batched(_records(batches), 4096):  # a frame at a time, however many records the archives hold
        yield pd.DataFrame(list(rows), columns=ARCHIVE_RECORD_SCHEMA.fieldNames())


def archive_records(spark: SparkSession, path_glob: str) -> DataFrame:
    """A4 + A3: one row per CSV record of the first CSV member of every zip archive matched by ``path_glob``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path_glob).select("path", "content")
    return files.mapInPandas(_expand, ARCHIVE_RECORD_SCHEMA)


def _field(record: Column, aliases: list[str]) -> Column:
    return F.coalesce(*[F.try_element_at(record, F.lit(a.lower())) for a in aliases], F.lit(""))


def register_from_records(records: DataFrame, ingested_at: str, aliases: dict[str, list[str]] = L.REGISTER_ALIASES) -> DataFrame:
    """A1 over archive records: resolve every register column from the header->value map, then the typed load."""
    from careflow.sources.register import register_load

    rec = F.col("record")
    raw = records.select(*[_field(rec, names).alias(target) for target, names in aliases.items()])
    return register_load(raw, ingested_at, {t: [t] for t in aliases})
