"""Keyed result tables of streams: sorted runs of changed rows, appended and merged, never rewritten as a whole.

A table is a folder of runs. A run ``<first>-<last>`` holds the newest row of each key that micro-batches first to last
changed. A micro-batch appends one run of its own rows. Then, as long as the run before the last is at most twice as
large, both are merged into one: runs grow by size from the last to the first, there are about as many as the logarithm
of the table's size, and a row is written again as often at most. So what a batch writes follows its own size.

A run counts once its _SUCCESS marker is there, so a torn write is invisible. A replayed batch finds its number covered
by a run and leaves the table as it is. Runs that a merge has replaced are deleted at the next append, after readers
that began before the merge had that long to finish.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.sources.publish import folder

MERGE_RATIO = 2


def _all_runs(spark: SparkSession, root: str) -> list[tuple[int, int]]:
    at, fs = folder(spark, root)
    if not fs.exists(at):
        return []
    done = [s.getPath() for s in fs.listStatus(at) if s.isDirectory() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(tuple(map(int, p.getName().split("-"))) for p in done if "-" in p.getName())


def runs(spark: SparkSession, root: str) -> list[tuple[int, int]]:
    """The runs that make up the table, oldest first: those that no other run covers."""
    found = _all_runs(spark, root)
    return [r for r in found if not any(o != r and o[0] <= r[0] and r[1] <= o[1] for o in found)]


def _path(root: str, run: tuple[int, int]) -> str:
    return f"{root}/{run[0]:09d}-{run[1]:09d}"


def _rows(spark: SparkSession, root: str, some: list[tuple[int, int]], keys: list[str]) -> DataFrame:
    """The newest row of every key in these runs. NULL keys are keys like others."""
    parts = [spark.read.parquet(_path(root, r)).withColumn("_run", F.lit(i)) for i, r in enumerate(some)]
    if len(parts) == 1:
        return parts[0].drop("_run")
    cols = parts[0].drop("_run").columns
    newest = F.max_by(F.struct(*[c for c in cols if c not in keys]), "_run").alias("_newest")
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(newest).select(*keys, "_newest.*").select(*cols)


def read_keyed(spark: SparkSession, root: str, keys: list[str]) -> DataFrame | None:
    """The table's rows (None when nothing was written yet)."""
    some = runs(spark, root)
    return _rows(spark, root, some, keys) if some else None


def append_changes(batch: DataFrame, batch_id: int, root: str, keys: list[str]) -> None:
    """Append a micro-batch (unique keys; its columns are the table's) and merge runs that have become alike in size."""
    spark = batch.sparkSession
    number = batch_id + 1  # 0 is the seed
    stale = set(_all_runs(spark, root)) - set(runs(spark, root))
    if any(first <= number <= last for first, last in runs(spark, root)):
        return
    for run in stale:
        at, fs = folder(spark, _path(root, run))
        fs.delete(at, True)
    batch.write.mode("overwrite").parquet(_path(root, (number, number)))
    while len(some := runs(spark, root)) > 1:
        older, newer = some[-2:]
        sizes = [spark.read.parquet(_path(root, r)).count() for r in (older, newer)]
        if sizes[0] > MERGE_RATIO * sizes[1]:
            break
        _rows(spark, root, [older, newer], keys).write.mode("overwrite").parquet(_path(root, (older[0], newer[1])))


def seed_keyed(df: DataFrame, root: str, keys: list[str]) -> None:
    """Write the initial rows of a table, unless it has rows already (a restart)."""
    if not runs(df.sparkSession, root):
        append_changes(df, -1, root, keys)
