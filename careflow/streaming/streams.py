"""Structured Streaming forms of the refresh, latest-status, queue-depth and dedup operators.

Each stream reads the same tables as its batch twin as a file stream (a table
is one Parquet file or a folder of part files) and applies the same
projection. Results of aggregates go to a keyed table (``keyed_tables``) to
which a micro-batch appends its changed rows alone. Stream state (aggregates,
per-key rows and timers) lives in Spark's RocksDB state store under the
query's checkpoint folder. Every run takes its folder as a parameter: run
again with the same folder, a stream goes on from the last committed batch,
and a replayed batch writes the same rows again.

* S2 latest: streaming ``max_by`` per (name, address) in update mode; a late
  snapshot only replaces a stored one when its (scraped_at, scrape_id) is
  newer, because the state keeps the maximum.
* S3 depth: streaming count/avg per facility over active queue rows; by
  event-time window, with the state of closed windows dropped.
* S4 dedup: the earliest row per (name, address) by event time, sent when the
  watermark has passed it (``transformWithState`` with event-time timers).
* S1 refresh: page stream -> parse -> per micro-batch (one crawl) first
  record per site -> append gold/silver/bronze, match and upsert matches.
* J9 score stream: stateless scored triage of arriving intake texts.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from careflow.functions import triage_scored as TS
from careflow.operators import match as MT
from careflow.operators import views as V
from careflow.plans import domain as D
from careflow.session import ensure_checkpoint_dir
from careflow.sources import er_pages as ER
from careflow.streaming.keyed_tables import append_changes, read_keyed, seed_keyed

LIVE_KEY = ["facility_name_raw", "address_raw"]


def table_stream(spark: SparkSession, sf_dir: str, name: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """File stream over ``<sf_dir>/<name>.parquet``, one file or a folder of part files; schema taken from the table."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    r = spark.readStream.schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(f"{sf_dir}/{name}[.]parquet")  # as a pattern, a single file is accepted too


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for one stream run under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextlib.contextmanager
def _state_store(spark: SparkSession, provider: str = ROCKSDB):
    """State on the executors' disks, uploaded to the checkpoint folder as changes: not bounded by their memory."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, provider)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _run(query_writer, checkpoint: str):
    with _state_store(SparkSession.active()):
        q = query_writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    return q


# --------------------------------------------------------------------------- S2
def latest_stream(live: DataFrame) -> DataFrame:
    """Newest snapshot per (name, address) as a streaming aggregate (update mode)."""
    rest = [c for c in live.columns if c not in LIVE_KEY]
    best = F.max_by(F.struct(*rest), F.struct("scraped_at", "scrape_id"))
    return live.groupBy(*LIVE_KEY).agg(best.alias("_r")).select(*LIVE_KEY, "_r.*")


def run_latest(spark: SparkSession, sf_dir: str, root: str | None = None, files: int | None = None) -> DataFrame:
    root = root or work_dir(spark, "latest")
    agg = latest_stream(D.live_status_from(table_stream(spark, sf_dir, "events", files)))
    w = agg.writeStream.outputMode("update").foreachBatch(lambda df, bid: append_changes(df, bid, root + "/table", LIVE_KEY))
    _run(w, root + "/checkpoint")
    return read_keyed(spark, root + "/table", LIVE_KEY)


# --------------------------------------------------------------------------- S3
def depth_stream(queue: DataFrame) -> DataFrame:
    """S3: active-queue count and average delay per facility, as a streaming aggregate."""
    return V.queue_depth(queue)


def run_depth(spark: SparkSession, sf_dir: str, root: str | None = None, files: int | None = None) -> DataFrame:
    root = root or work_dir(spark, "depth")
    agg = depth_stream(D.virtual_queue_from(table_stream(spark, sf_dir, "orders", files)))
    w = agg.writeStream.outputMode("update").foreachBatch(lambda df, bid: append_changes(df, bid, root + "/table", ["facility_id"]))
    _run(w, root + "/checkpoint")
    return read_keyed(spark, root + "/table", ["facility_id"])


# --------------------------------------------------------------------------- S4
class EarliestRow(StatefulProcessor):
    """Per key: the row with the smallest (scraped_at, scrape_id), sent once no earlier one can come.

    State: the smallest row so far, until an event-time timer at its time fires (the watermark has passed it); then
    the time alone, which marks the key as sent, and with ``forget_ms`` not even that after this long."""

    def __init__(self, schema: StructType, forget_ms: int | None = None):
        self.schema, self.forget_ms = schema, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.best = handle.getValueState("best", self.schema)
        self.sent = handle.getValueState("sent", "at timestamp")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        first = min((tuple(r[c] for c in self.schema.names) for r in rows if not r["_beat"]), key=self._rank, default=None)
        if first is not None and not self.sent.exists():
            kept = tuple(self.best.get()) if self.best.exists() else None
            if kept is None or self._rank(first) < self._rank(kept):
                if kept is not None:
                    self.handle.deleteTimer(self._timer(kept))
                self.best.update(first)
                self.handle.registerTimer(self._timer(first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if not self.best.exists():
            self.sent.clear()
            return
        row = tuple(self.best.get())
        self.best.clear()
        self.sent.update((row[self.schema.names.index("scraped_at")],))
        if self.forget_ms is not None:
            self.handle.registerTimer(self._timer(row) + self.forget_ms)
        yield Row(**dict(zip(self.schema.names, row)))

    def close(self) -> None:
        pass

    def _rank(self, row: tuple) -> tuple[float, str]:
        names = self.schema.names  # times come with a zone from the state, in local time from the input
        return row[names.index("scraped_at")].timestamp(), row[names.index("scrape_id")] or ""

    def _timer(self, row: tuple) -> int:
        return int(self._rank(row)[0] * 1000) + 1


def dedup_stream(live: DataFrame, beats: DataFrame, delay: str, forget_ms: int | None = None) -> DataFrame:
    """The earliest row per (name, address). Rows may come out of order by ``delay``; later ones are dropped.
    ``beats`` (scraped_at) are punctuation: no earlier row will come. They drive the watermark when no rows do."""
    schema = live.schema
    marks = beats.select(*(F.col("scraped_at") if f.name == "scraped_at" else F.lit("" if f.name in LIVE_KEY else None).cast(f.dataType).alias(f.name) for f in schema), F.lit(True).alias("_beat"))
    both = live.withColumn("_beat", F.lit(False)).unionByName(marks).withWatermark("scraped_at", delay)
    return both.groupBy(*LIVE_KEY).transformWithState(EarliestRow(schema, forget_ms), schema, "Append", "eventTime")


def punctuate(spark: SparkSession, root: str, at: dt.datetime) -> None:
    """Say that no row earlier than ``at`` will come to the stream in this folder; its next run sends what is due."""
    spark.createDataFrame([(at,)], "scraped_at timestamp").coalesce(1).write.mode("append").parquet(f"{root}/beats")


def run_dedup(spark: SparkSession, sf_dir: str, root: str | None = None, files: int | None = None, delay: str = "1 hour", upto: dt.datetime | None = None) -> DataFrame:
    """Earliest rows of the sites, as far as the watermark has come; with ``upto`` the crawls up to then are closed."""
    root = root or work_dir(spark, "dedup")
    live = D.live_status_from(table_stream(spark, sf_dir, "events", files)).withColumn("scraped_at", F.col("scraped_at").cast("timestamp"))
    punctuate(spark, root, dt.datetime(1970, 1, 2))

    def run():
        beats = spark.readStream.schema("scraped_at timestamp").parquet(f"{root}/beats")
        _run(dedup_stream(live, beats, delay).writeStream.outputMode("append").format("parquet").option("path", root + "/table"), root + "/checkpoint")

    run()
    if upto is not None:
        punctuate(spark, root, upto)
        run()
    return spark.read.schema(live.schema).parquet(root + "/table")


# --------------------------------------------------------------------------- S1
def refresh_batch(batch: DataFrame, batch_id: int, root: str, register: DataFrame, overrides: DataFrame, scraped_at: str) -> None:
    """One crawl: first record per site, append the three layers, match, override and upsert the matches."""
    spark = batch.sparkSession
    records = ER.with_scrape(ER.first_per_site(ER.parse_blocks(batch)), scraped_at)
    part = f"batch_id={batch_id:09d}"
    for name, rows in (("gold", ER.gold_rows(records)), ("silver", ER.silver_rows(records)), ("bronze", ER.bronze_rows(records))):
        rows.write.mode("overwrite").parquet(f"{root}/{name}/{part}")  # a replayed batch writes its folder again
    gold = spark.read.parquet(f"{root}/gold/{part}")  # reread the written layer: cuts lineage
    new = MT.apply_overrides(MT.fuzzy_match(gold, register), overrides)
    append_changes(new, batch_id, f"{root}/matches", MT.MATCH_KEY)


def run_refresh(spark: SparkSession, sf_dir: str, root: str | None = None, files: int | None = None) -> str:
    """Stream the pages table through the refresh; returns the folder holding gold/silver/bronze/matches."""
    root = root or work_dir(spark, "refresh")
    register = D.facility_master(spark, sf_dir).withColumn("register_order", F.col("index").cast("long"))
    seed_keyed(D.facility_match(spark, sf_dir), f"{root}/matches", MT.MATCH_KEY)
    overrides = D.manual_overrides(spark, sf_dir)
    blocks = ER.html_blocks(D.er_pages_from(table_stream(spark, sf_dir, "pages", files)))
    w = blocks.writeStream.foreachBatch(lambda df, bid: refresh_batch(df, bid, root, register, overrides, D.ER_SCRAPED_AT))
    _run(w, root + "/checkpoint")
    return root


# --------------------------------------------------------------------------- J9
def score_stream(intakes: DataFrame) -> DataFrame:
    """One decision row per arriving intake text (stateless)."""
    return TS.triage_scored(intakes, "raw_text", "age_group", None).select("intake_session_id", *TS.DECISION_COLUMNS)


def run_scores(spark: SparkSession, sf_dir: str, root: str | None = None, files: int | None = None) -> DataFrame:
    root = root or work_dir(spark, "scores")
    s = score_stream(D.intake_texts_from(table_stream(spark, sf_dir, "documents", files)))
    _run(s.writeStream.outputMode("append").format("parquet").option("path", root + "/table"), root + "/checkpoint")
    return spark.read.parquet(root + "/table")


# --------------------------------------------------------------------------- S3, event-time windows
DEPTH_WINDOW = "1 hour"
DEPTH_LATENESS = "2 hours"


def windowed_depth(queue: DataFrame, window: str = DEPTH_WINDOW, lateness: str | None = None) -> DataFrame:
    """Active-queue rows and average call delay per facility and event-time window of ``created_at``.

    Batch and streaming share this definition; a stream passes ``lateness`` so
    the state of closed windows is dropped once the watermark passes them.
    """
    q = V.active_queue(queue).withColumn("created_at", F.col("created_at").cast("timestamp"))
    if lateness:
        q = q.withWatermark("created_at", lateness)
    delay = F.timestamp_diff("MINUTE", F.col("created_at"), F.coalesce(F.col("estimated_call_time").cast("timestamp"), F.col("created_at")))
    g = q.groupBy("facility_id", F.window("created_at", window).alias("w")).agg(
        F.count(F.lit(1)).alias("active_queue_count"), F.avg(delay).alias("avg_queue_delay_minutes"))
    return g.select("facility_id", F.col("w.start").alias("window_start"), "active_queue_count", "avg_queue_delay_minutes")


def run_windowed_depth(spark: SparkSession, sf_dir: str, root: str | None = None, files: int | None = None, lateness: str | None = None) -> DataFrame:
    """A backfill whose files come in any order runs without a lateness bound; a live stream passes DEPTH_LATENESS."""
    root = root or work_dir(spark, "depth-windows")
    agg = windowed_depth(D.virtual_queue_from(table_stream(spark, sf_dir, "orders", files)), lateness=lateness)
    w = agg.writeStream.outputMode("update").foreachBatch(
        lambda df, bid: append_changes(df, bid, root + "/table", ["facility_id", "window_start"]))
    _run(w, root + "/checkpoint")
    return read_keyed(spark, root + "/table", ["facility_id", "window_start"])
