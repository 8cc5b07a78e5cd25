"""Registered queries run as Structured Streaming jobs (availableNow) over the same tables; oracles are the batch twins' SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from careflow.operators import match as MT
from careflow.plans.catalog import SQL_TRIAGE_SCORED, register, view_sql
from careflow.plans.catalog_ingest import _GOLD, _er_sql, match_refresh_sql
from careflow.plans.oracle_domain import with_ctes
from careflow.sources import er_pages as ER
from careflow.streaming import streams as ST

#: Time by which all crawls of the tables are closed.
CLOSED = dt.datetime(2100, 1, 1)


@register("latest_stream", view_sql("SELECT * FROM latest"))
def q_latest_stream(spark, sf):
    """Newest snapshot per site kept by a streaming aggregate and merged into a keyed table."""
    return ST.run_latest(spark, sf)


@register("queue_depth_stream", view_sql("SELECT * FROM depth"))
def q_queue_depth_stream(spark, sf):
    """S3: streaming queue depth per facility, merged into a keyed table."""
    return ST.run_depth(spark, sf)


@register("dedup_stream", with_ctes("""
  SELECT * EXCLUDE (_rn) FROM (SELECT *, row_number() OVER (PARTITION BY facility_name_raw, address_raw ORDER BY scraped_at, scrape_id) AS _rn FROM live) _l WHERE _rn = 1"""))
def q_dedup_stream(spark, sf):
    """The earliest whole row of every site, sent by event-time timers; the crawls are closed at the end."""
    got = ST.run_dedup(spark, sf, upto=CLOSED)
    return got.withColumn("scraped_at", F.col("scraped_at").cast("timestamp_ntz"))


@register("refresh_stream_gold", _er_sql(f"SELECT {_GOLD} FROM rec"))
def q_refresh_stream_gold(spark, sf):
    """The page stream through parse, first-per-site and the gold layer (one micro-batch = one crawl)."""
    root = ST.run_refresh(spark, sf)
    return spark.read.parquet(f"{root}/gold").select(*ER.GOLD_COLUMNS)


@register("refresh_stream_matches", match_refresh_sql())
def q_refresh_stream_matches(spark, sf):
    """The match table after the streamed refresh (stored matches, fuzzy matches of new sites, overrides)."""
    root = ST.run_refresh(spark, sf)
    return ST.read_keyed(spark, f"{root}/matches", MT.MATCH_KEY)


@register("score_stream", with_ctes(SQL_TRIAGE_SCORED))
def q_score_stream(spark, sf):
    """Scored decisions for a stream of intake texts."""
    return ST.run_scores(spark, sf)


_SQL_DEPTH_WINDOWS = with_ctes("""
  SELECT facility_id, date_trunc('hour', created_at) AS window_start, count(*) AS active_queue_count,
    avg(date_sub('minute', created_at, coalesce(estimated_call_time, created_at))) AS avg_queue_delay_minutes
  FROM vq WHERE queue_status IN ('reserved', 'confirmed', 'called') GROUP BY facility_id, date_trunc('hour', created_at)""")


@register("queue_depth_windows", _SQL_DEPTH_WINDOWS)
def q_queue_depth_windows(spark, sf):
    """S3 batch twin: active queue per facility and hourly event-time window."""
    from careflow.plans import domain as D

    return ST.windowed_depth(D.virtual_queue(spark, sf))


@register("queue_depth_windows_stream", _SQL_DEPTH_WINDOWS)
def q_queue_depth_windows_stream(spark, sf):
    """S3: the same windows from a watermarked stream (update mode, appended to a keyed table); one micro-batch reads
    the whole table, so no row comes behind the watermark."""
    return ST.run_windowed_depth(spark, sf, lateness=ST.DEPTH_LATENESS)
