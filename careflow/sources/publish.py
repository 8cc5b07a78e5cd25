"""Guarded loads: counted inside their one write, refused when empty, harmless when repeated.

* ``publish`` (A13 + A20 + A21) writes a frame beside its table, counts it by an ``Observation`` on the same write (the
  frame is computed once), and only then puts it in the table's place; an empty or failed load leaves the old table.
* ``append_load`` (A14, A17 + A21) appends under a load id, partitioned by snapshot date: repeating a load replaces its
  own partitions and adds no row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


class EmptyLoad(ValueError):
    """A load without a row, which is not published."""


def folder(spark: SparkSession, path: str):
    """A path and its file system, whatever kind it is."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def _counted(df: DataFrame, ts_col: str | None) -> tuple[DataFrame, Observation]:
    seen = Observation(f"load-{uuid.uuid4().hex[:12]}")
    newest = F.max(F.col(ts_col)) if ts_col else F.lit(None).cast("timestamp")
    return df.observe(seen, F.count(F.lit(1)).alias("rows_loaded"), newest.alias("snapshot_at")), seen


def publish(df: DataFrame, path: str, what: str = "table", ts_col: str | None = None, fmt: str = "parquet") -> dict:
    """Replace the table at ``path``; returns rows_loaded and snapshot_at. The frame may read the old table."""
    spark = df.sparkSession
    path = path.rstrip("/")
    beside, old = f"{path}.loading-{uuid.uuid4().hex[:12]}", f"{path}.old-{uuid.uuid4().hex[:12]}"
    counted, seen = _counted(df, ts_col)
    (new_at, fs), (at, _), (old_at, _) = (folder(spark, p) for p in (beside, path, old))
    try:
        counted.write.format(fmt).save(beside)
        if not seen.get["rows_loaded"]:
            raise EmptyLoad(f"refusing to publish an empty {what}")
        if fs.exists(at):
            fs.rename(at, old_at)
        if not fs.rename(new_at, at):
            fs.rename(old_at, at)
            raise OSError(f"could not put {beside} in the place of {path}")
        fs.delete(old_at, True)
    finally:
        fs.delete(new_at, True)  # nothing is there after the rename
    return dict(seen.get)


def append_load(df: DataFrame, path: str, load_id: str, ts_col: str = "scraped_at", fmt: str = "parquet") -> dict:
    """Append a load, partitioned by the snapshot date of ``ts_col`` and the load's id; returns rows_loaded and
    snapshot_at. The same load again replaces what it wrote."""
    counted, seen = _counted(df, ts_col)
    dated = counted.withColumns({"snapshot_date": F.to_date(F.col(ts_col)), "load_id": F.lit(load_id)})
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("load_id", "snapshot_date").format(fmt).save(path)
    return dict(seen.get)
