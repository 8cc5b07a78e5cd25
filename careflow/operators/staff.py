"""Staff analytics over the secured dashboard."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from careflow.functions import lexicon as L

STAFF_QUESTIONS = [
    "How many arrivals in the next 2 hours?",
    "What is the low-acuity mix?",
    "Where is congestion highest?",
]


def busiest_sites(dashboard: DataFrame) -> DataFrame:
    """F2 + B9: dashboard rows by queue count DESC, occupancy DESC, with the CTAS 4+5 mix."""
    keys = ["user_name"] if "user_name" in dashboard.columns else []
    return dashboard.select(
        *keys, "facility_id", "facility_name", "incoming_queue_count", "arrivals_next_2h", "avg_live_wait_minutes",
        (F.col("ctas_4_count") + F.col("ctas_5_count")).alias("low_acuity_mix"),
        "avg_stretcher_occupancy_pct",
    ).orderBy(
        *keys, F.col("incoming_queue_count").desc(), F.col("avg_stretcher_occupancy_pct").desc_nulls_last(),
        F.col("facility_id"),
    )


def staff_totals(dashboard: DataFrame) -> DataFrame:
    """Per user: arrivals in the next 2 h, CTAS 4+5 count, total queue."""
    return dashboard.groupBy("user_name").agg(
        F.sum(F.coalesce(F.col("arrivals_next_2h"), F.lit(0))).alias("total_next_2h"),
        F.sum(F.coalesce(F.col("ctas_4_count"), F.lit(0)) + F.coalesce(F.col("ctas_5_count"), F.lit(0))).alias("total_ctas_4_5"),
        F.sum(F.coalesce(F.col("incoming_queue_count"), F.lit(0))).alias("total_queue"),
    )


def top_facility(dashboard: DataFrame) -> DataFrame:
    """Per user, the facility with most queued arrivals; ties: higher occupancy, then facility id.

    row_number() = 1 gets a partial per-task group limit before the shuffle.
    """
    w = Window.partitionBy("user_name").orderBy(
        F.col("incoming_queue_count").desc(), F.col("avg_stretcher_occupancy_pct").desc_nulls_last(), F.col("facility_id")
    )
    return (
        dashboard.withColumn("_rn", F.row_number().over(w))
        .filter("_rn = 1")
        .select(
            "user_name",
            F.col("facility_id").alias("top_facility_id"),
            F.col("facility_name").alias("top_facility_name"),
            F.col("city").alias("top_city"),
            F.col("incoming_queue_count").alias("top_queue_count"),
            F.col("avg_live_wait_minutes").alias("top_avg_live_wait_minutes"),
        )
    )


def staff_answer(dashboard: DataFrame, users: DataFrame, questions: list[str] = STAFF_QUESTIONS) -> DataFrame:
    """Answer each (user, question) from that user's totals and top facility.

    ``users`` (user_name) lists everyone in scope; users without dashboard rows
    get the fixed no-data sentence.
    """
    # totals and top facility from one pass over the dashboard: sums over a user's rows beside their order
    user = Window.partitionBy("user_name")
    top = user.orderBy(F.col("incoming_queue_count").desc(), F.col("avg_stretcher_occupancy_pct").desc_nulls_last(), F.col("facility_id"))
    low = F.coalesce(F.col("ctas_4_count"), F.lit(0)) + F.coalesce(F.col("ctas_5_count"), F.lit(0))
    per_user = dashboard.select(
        "user_name", F.col("facility_id").alias("top_facility_id"), F.col("facility_name").alias("top_facility_name"), F.col("city").alias("top_city"),
        F.col("incoming_queue_count").alias("top_queue_count"), F.col("avg_live_wait_minutes").alias("top_avg_live_wait_minutes"),
        F.sum(F.coalesce(F.col("arrivals_next_2h"), F.lit(0))).over(user).alias("total_next_2h"), F.sum(low).over(user).alias("total_ctas_4_5"),
        F.row_number().over(top).alias("_rn"),
    ).filter("_rn = 1").drop("_rn")
    base = users.select(F.lower(F.col("user_name")).alias("user_name")).distinct()
    j = base.join(per_user, "user_name", "left").withColumn(
        "question", F.explode(F.array(*[F.lit(x) for x in questions]))
    )
    q = F.lower(F.col("question"))
    name = F.coalesce(F.col("top_facility_name"), F.lit("None"))
    next2 = F.format_string(
        L.STAFF_NEXT2H.replace("{total}", "%d").replace("{name}", "%s").replace("{count}", "%d"),
        F.col("total_next_2h"), name, F.col("top_queue_count"),
    )
    low = F.format_string(L.STAFF_LOW_ACUITY.replace("{total}", "%d"), F.col("total_ctas_4_5"))
    wait = F.bround(F.coalesce(F.col("top_avg_live_wait_minutes"), F.lit(0.0)), 1).cast("string")
    cong = F.format_string(
        L.STAFF_CONGESTION.replace("{name}", "%s").replace("{city}", "%s").replace("{wait}", "%s"),
        name, F.coalesce(F.col("top_city"), F.lit("None")), wait,
    )
    low_cond = None
    for k in L.STAFF_LOW_ACUITY_KEYS:
        c = q.contains(k)
        low_cond = c if low_cond is None else (low_cond | c)
    answer = (
        F.when(F.col("top_facility_id").isNull(), F.lit(L.STAFF_NO_DATA))
        .when(q.contains(L.STAFF_NEXT2H_KEY), next2)
        .when(low_cond, low)
        .otherwise(cong)
    )
    return j.select("user_name", "question", answer.alias("answer"))
