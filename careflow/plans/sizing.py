"""Size checks for broadcast decisions.

A side is broadcast only when Catalyst's plan-time size estimate (no job is
run) is under a bound; beyond it the hint is withheld and Spark's planner
(with AQE's runtime statistics) picks a shuffle-based strategy instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow.session import ensure_checkpoint_dir

MAX_BROADCAST_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    try:
        size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        return int(str(size))  # a Python int through py4j, or a JVM BigInt
    except Exception:  # estimate unavailable (e.g. remote session)
        return None


def broadcast_if_small(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES) -> DataFrame:
    size = estimated_bytes(df)
    if size is not None and size <= max_bytes:
        return F.broadcast(df)
    return df


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin rows over at least the session's parallelism before CPU-heavy row work.

    Text scoring costs hundreds of passes over every string, far more than
    moving the string once, so when the input arrives in fewer partitions
    than there are cores (a few large files, one row group each) the rows are
    spread first. When the scan is already split finer (the normal case for a
    large table) the plan is returned unchanged: no extra shuffle.
    """
    want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    try:
        have = df.rdd.getNumPartitions() if not df.isStreaming else want
    except Exception:
        return df
    if have >= want:
        return df
    return df.repartition(want)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back: computed once, its size known."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/staged/{label}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
