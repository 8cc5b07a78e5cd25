"""Virtual-queue operators.

``assign_positions`` is the batch form of "next position = max active
position + 1": every new reservation of a facility gets base + its rank
among that facility's new reservations, in one set-based pass (this also
removes the read-then-insert race of one-at-a-time reservation).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from careflow.functions import lexicon as L
from careflow.functions.text import haversine_km, make_id
from careflow.operators.views import active_queue
from careflow.plans.sizing import broadcast_if_small, staged


def next_position(queue: DataFrame) -> DataFrame:
    """D3: per facility, COALESCE(MAX(active queue_position), 0) + 1 (facilities with active rows)."""
    return active_queue(queue).groupBy("facility_id").agg(
        (F.coalesce(F.max("queue_position"), F.lit(0)) + 1).alias("next_position")
    )


def call_time(window_start: Column, position: Column) -> Column:
    """Window start + 12 minutes x position."""
    return F.timestamp_add("MINUTE", (position * L.MINUTES_PER_POSITION).cast("int"), window_start)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with their partition and their number (from 1) among the partition's rows of the same facility."""
    part, last, many = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        facility = batch.column("facility_id")
        code = facility.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
        number = np.arange(1, len(code) + 1) - np.repeat(starts, np.diff(starts, append=len(code)))
        first, end = facility[0].as_py(), facility[-1].as_py()
        if many and first == last:
            number[: starts[1] if len(starts) > 1 else len(code)] += many
        last, many = end, int(number[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(code), part, np.int32)), pa.array(number.astype(np.int64))], names=[*batch.schema.names, "_part", "_rn"])


def assign_positions(requests: DataFrame, queue: DataFrame) -> DataFrame:
    """E5: position = base (D3, else 1) + dense rank within the facility by (created_at, request_id) - 1.

    Distributed prefix sum: the requests are dealt by range of (facility, time, id) and numbered inside their
    partition as they stream by; the written rows' counts per facility and partition, summed up in partition order,
    give each partition its offset. A hot facility is cut into as many partitions as its share of the rows, whatever
    its times are: one hour, or no time at all, may hold all of them. Requests without a creation time are numbered
    last in their facility, requests without a facility among themselves.
    """
    spark = requests.sparkSession
    cols = ["request_id", "facility_id", "created_at", "arrival_window_start", "arrival_window_end"]
    order = [F.col("facility_id").asc_nulls_first(), F.col("created_at").asc_nulls_last(), F.col("request_id").asc()]
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = requests.select(*cols).repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = StructType([*dealt.schema.fields, StructField("_part", IntegerType()), StructField("_rn", LongType())])
    numbered = staged(dealt.mapInArrow(_numbered, schema), "positions")
    counts = numbered.groupBy("facility_id", "_part").agg(F.max("_rn").alias("_n"))
    before = Window.partitionBy("facility_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    offsets = counts.select(F.col("facility_id").alias("_fid"), F.col("_part").alias("_opart"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    base = next_position(queue).withColumnRenamed("facility_id", "_bid")
    bases = offsets.join(base, F.col("_fid") == F.col("_bid"), "left").select("_fid", "_opart", (F.coalesce("next_position", F.lit(1)) + F.col("_offset") - 1).alias("_before"))
    j = numbered.join(broadcast_if_small(bases), F.col("facility_id").eqNullSafe(F.col("_fid")) & (F.col("_part") == F.col("_opart")))
    return j.select(*cols, (F.col("_before") + F.col("_rn")).cast("int").alias("queue_position")).withColumn(
        "estimated_call_time", call_time(F.col("arrival_window_start"), F.col("queue_position")))


def remaining_minutes(call: Column, now: Column) -> Column:
    """max(0, floor((call - now) / 60 s))."""
    secs = F.timestamp_diff("SECOND", now, call)
    return F.greatest(F.lit(0), F.floor(secs / 60).cast("int"))


def leave_now(distance_km: Column, remaining: Column) -> Column:
    """Distance known and remaining <= max(15, int(2 x km))."""
    limit = F.greatest(F.lit(L.LEAVE_NOW_MIN_MINUTES), (distance_km * 2).cast("int"))
    return F.coalesce(distance_km.isNotNull() & (remaining <= limit), F.lit(False))


def track_queue(queue: DataFrame, master: DataFrame, now: Column) -> DataFrame:
    """C4 + H39 + H40 + H9: queue INNER register, distance from the patient, minutes left, leave-now flag.

    ``queue`` carries user_latitude / user_longitude per row (NULL when unknown).
    """
    fm = master.select(F.col("facility_id_normalized").alias("_fid"), "facility_name", "city", "latitude", "longitude")
    j = queue.join(fm, queue.facility_id == fm._fid, "inner")
    dist = haversine_km(F.col("user_latitude"), F.col("user_longitude"), F.col("latitude"), F.col("longitude"))
    rem = remaining_minutes(F.col("estimated_call_time"), now)
    return j.select(
        "queue_id", "queue_position", "estimated_call_time", "queue_status", "arrival_window_start", "arrival_window_end",
        "facility_name", "city", "latitude", "longitude",
        dist.alias("distance_km"), rem.alias("remaining_minutes"), leave_now(dist, rem).alias("leave_now_recommendation"),
    )


def default_window_ui(t: Column) -> tuple[Column, Column]:
    """H42 (browser): minutes rounded up to a multiple of 15 (seconds dropped), end = start + 45 min."""
    start = F.timestamp_add(
        "MINUTE", (F.ceil(F.minute(t) / L.UI_WINDOW_ROUND_MINUTES) * L.UI_WINDOW_ROUND_MINUTES).cast("int"), F.date_trunc("hour", t)
    )
    return start, F.timestamp_add("MINUTE", F.lit(L.UI_WINDOW_LENGTH_MINUTES), start)


def default_window_legacy(t: Column) -> tuple[Column, Column]:
    """H42 (legacy): start = now + 15 min, end = start + 45 min."""
    start = F.timestamp_add("MINUTE", F.lit(L.LEGACY_WINDOW_OFFSET_MINUTES), t)
    return start, F.timestamp_add("MINUTE", F.lit(L.UI_WINDOW_LENGTH_MINUTES), start)


def contact_rows(queue: DataFrame, key: str | Column) -> DataFrame:
    """One encrypted contact row per reservation with a contact and a notification preference.

    AES-GCM (random IV) via the built-in ``aes_encrypt``; expires 2 days after creation.
    ``queue`` carries contact_value and channel_type columns.
    """
    k = key if isinstance(key, Column) else F.lit(key)
    pref = F.coalesce(F.col("notification_preference"), F.lit(""))
    keep = F.col("contact_value").isNotNull() & (F.col("contact_value") != "") & ~pref.isin(*L.NO_CONTACT_PREFERENCES)
    return queue.filter(keep).select(
        make_id("contact", F.col("queue_id")).alias("contact_id"),
        "queue_id",
        F.coalesce(F.col("channel_type"), F.col("notification_preference")).alias("channel_type"),
        F.base64(F.aes_encrypt(F.col("contact_value"), k, F.lit("GCM"))).alias("encrypted_contact_value"),
        F.timestamp_add("DAY", F.lit(L.CONTACT_RETENTION_DAYS), F.col("created_at")).alias("expires_at"),
    )


def decrypt_contact(df: DataFrame, key: str | Column) -> DataFrame:
    k = key if isinstance(key, Column) else F.lit(key)
    return df.withColumn(
        "contact_value", F.aes_decrypt(F.unbase64(F.col("encrypted_contact_value")), k, F.lit("GCM")).cast("string")
    )
