"""Shared helpers: table access, staging in the shared folder, task-side text iteration."""

from __future__ import annotations

import contextlib
import ctypes
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.session import ensure_checkpoint_dir

#: Words as the contracts define them: runs of anything but blank and the five control blanks.
WORD_BLANKS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*cols) if cols else df


#: Rows of an Arrow batch while an intermediate result is written: the JVM and the Python worker hold a batch of whole
#: texts each, and the worker two of them while the next one comes.
STAGED_BATCH_ROWS = 2048


@contextlib.contextmanager
def _small_batches(spark: SparkSession):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), STAGED_BATCH_ROWS) if int(before) > 0 else STAGED_BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back, so that a lost executor
    never costs more than the stage at hand and later steps read instead of recompute."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"
    with _small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def split_words(text: str | None) -> list[str]:
    """Words by ``WORD_PATTERN``; null gives none. (``str.split()`` would also cut at non-ASCII blanks.)"""
    if not text:
        return []
    for c in WORD_BLANKS[1:]:
        if c in text:
            text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def give_back() -> None:
    """Return this Python worker's freed memory to the system: workers live on, idle, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches, a bounded slice at a time so that Python objects of a batch never pile up."""
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            yield from zip(*(part.column(n).to_pylist() for n in names))
    give_back()


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of ``size`` rows."""
    buf: list[tuple] = []
    for row in rows:
        buf.append(row)
        if len(buf) >= size:
            yield _batch(buf, schema)
            buf = []
    if buf:
        yield _batch(buf, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.record_batch([pa.array(c, type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def row_key(*cols: str):
    """64-bit identity of a row's content, for tables in which doc_id may repeat."""
    return F.xxhash64(*cols)
