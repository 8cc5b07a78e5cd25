"""Live-status and queue views.

Each view is a DataFrame -> DataFrame function; composing them gives one
logical plan that Catalyst flattens (column pruning through the nested views,
predicate pushdown to the scans).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careflow.functions import lexicon as L

LIVE_COLUMNS = [
    "scrape_id",
    "facility_name_raw",
    "address_raw",
    "region",
    "wait_time_non_priority_minutes",
    "people_waiting",
    "total_people_er",
    "stretcher_occupancy_pct",
    "avg_wait_room_minutes_prev_day",
    "avg_stretcher_wait_minutes_prev_day",
    "source_url",
    "scraped_at",
]
SITE_KEY = ["facility_name_raw", "address_raw"]


def live_latest(live: DataFrame, method: str = "window") -> DataFrame:
    """The newest snapshot per (name, address): order by scraped_at DESC, scrape_id DESC.

    ``window``: row_number() = 1; Catalyst adds a partial WindowGroupLimit
    before the shuffle, so each map task forwards at most one row per site and
    a hot site cannot pile up in one task.
    ``max_by``: one aggregate with a struct ordering key (partial aggregation).
    """
    if method == "window":
        w = Window.partitionBy(*SITE_KEY).orderBy(F.col("scraped_at").desc_nulls_last(), F.col("scrape_id").desc_nulls_last())
        return live.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(*LIVE_COLUMNS)
    if method == "max_by":
        rest = [c for c in LIVE_COLUMNS if c not in SITE_KEY]
        best = F.max_by(F.struct(*rest), F.struct(F.col("scraped_at"), F.col("scrape_id"))).alias("_b")
        return live.groupBy(*SITE_KEY).agg(best).select(*SITE_KEY, "_b.*").select(*LIVE_COLUMNS)
    raise ValueError(f"unknown method {method!r}")


def active_queue(queue: DataFrame) -> DataFrame:
    """Rows still waiting (reserved, confirmed, called)."""
    return queue.filter(F.col("queue_status").isin(*L.ACTIVE_QUEUE_STATUSES))


def queue_depth(queue: DataFrame) -> DataFrame:
    """Active rows per facility and their mean minutes from creation to call."""
    delay = F.timestamp_diff("MINUTE", F.col("created_at"), F.coalesce(F.col("estimated_call_time"), F.col("created_at")))
    return active_queue(queue).groupBy("facility_id").agg(
        F.count(F.lit(1)).alias("active_queue_count"),
        F.avg(delay).alias("avg_queue_delay_minutes"),
    )


def facility_live_joined(master: DataFrame, match: DataFrame, latest: DataFrame, depth: DataFrame) -> DataFrame:
    """Register LEFT match LEFT latest LEFT depth; queue depth NULL -> 0.

    One register row fans out into several when several live sites match it
    (faithful). The match->latest join is done first (both keyed by site),
    then both facility-keyed joins share one partitioning of the register.
    """
    m = match.select(
        F.col("matched_facility_id").alias("_mid"),
        F.col("facility_name_raw").alias("_mn"),
        F.col("address_raw").alias("_ma"),
    )
    live = latest.select(*LIVE_COLUMNS[1:])
    site = m.join(live, (m._mn == live.facility_name_raw) & (m._ma == live.address_raw), "left").drop("_mn", "_ma")
    fm = master.select(
        "facility_id_normalized", "facility_name", "odhf_facility_type", "city", "province", "is_quebec",
        "full_address", "latitude", "longitude",
    )
    d = depth.select(F.col("facility_id").alias("_did"), "active_queue_count", "avg_queue_delay_minutes")
    j = fm.join(site, fm.facility_id_normalized == site._mid, "left").join(d, F.col("facility_id_normalized") == d._did, "left")
    return j.select(
        "facility_id_normalized", "facility_name", "odhf_facility_type", "city", "province", "is_quebec",
        "full_address", "latitude", "longitude",
        *LIVE_COLUMNS[1:],
        F.coalesce(F.col("active_queue_count"), F.lit(0)).alias("virtual_queue_depth"),
        F.coalesce(F.col("avg_queue_delay_minutes"), F.lit(0.0)).alias("avg_queue_delay_minutes"),
    )


def in_region_or_unknown(df: DataFrame) -> DataFrame:
    """is_quebec IS NULL OR is_quebec (three-valued)."""
    return df.filter(F.coalesce(F.col("is_quebec"), F.lit(True)))


SECURE_COLUMNS = [
    "queue_id", "intake_session_id", "facility_id", "arrival_window_start", "arrival_window_end", "queue_position",
    "estimated_call_time", "notification_preference", "queue_status", "created_at",
    "language", "patient_age_group", "primary_symptom", "symptom_category", "emergency_stop",
    "provisional_ctas_level", "provisional_ctas_label", "recommended_facility_type", "recommended_urgency_band",
    "wait_time_non_priority_minutes", "people_waiting", "total_people_er", "stretcher_occupancy_pct",
    "avg_wait_room_minutes_prev_day", "avg_stretcher_wait_minutes_prev_day",
    "facility_name", "city", "odhf_facility_type",
]


def scope_for(scope: DataFrame, user: str | Column | None) -> DataFrame:
    """Scope rows of one user (case-insensitive) or, with user=None, of every user."""
    s = scope.select(F.col("user_name"), F.col("facility_id_normalized").alias("_sid"))
    if user is None:
        return s.select(F.lower(F.col("user_name")).alias("user_name"), "_sid").distinct()
    u = user if isinstance(user, Column) else F.lit(user)
    return s.filter(F.lower(F.col("user_name")) == F.lower(u)).select("_sid").distinct()


def staff_queue_secure(
    queue: DataFrame,
    intakes: DataFrame,
    master: DataFrame,
    live_joined: DataFrame,
    scope: DataFrame,
    user: str | None = None,
) -> DataFrame:
    """Queue x intake x register LEFT live view, restricted by the scope table.

    user given: EXISTS (semi join) on that user's facilities, as the view does.
    user None: one result per scope user (column user_name), the batch form.
    """
    i = intakes.select(
        F.col("intake_session_id").alias("_iid"), "language", "patient_age_group", "primary_symptom", "symptom_category",
        "emergency_stop", "provisional_ctas_level", "provisional_ctas_label", "recommended_facility_type",
        "recommended_urgency_band",
    )
    fm = master.select(F.col("facility_id_normalized").alias("_fid"), "facility_name", "city", "odhf_facility_type")
    lv = live_joined.select(
        F.col("facility_id_normalized").alias("_lid"), "wait_time_non_priority_minutes", "people_waiting", "total_people_er",
        "stretcher_occupancy_pct", "avg_wait_room_minutes_prev_day", "avg_stretcher_wait_minutes_prev_day",
    )
    q = queue
    if user is not None:
        allowed = scope_for(scope, user)
        q = q.join(allowed, q.facility_id == allowed._sid, "left_semi")
    j = q.join(fm, q.facility_id == fm._fid, "inner").join(lv, F.col("_fid") == lv._lid, "left")
    j = j.join(i, j.intake_session_id == i._iid, "inner")
    cols = list(SECURE_COLUMNS)
    if user is None:
        s = scope_for(scope, None)
        j = j.join(s, j.facility_id == s._sid, "inner")
        cols = ["user_name"] + cols
    return j.select(*cols)


def staff_dashboard(queue: DataFrame, intakes: DataFrame, master: DataFrame, live_joined: DataFrame, scope: DataFrame, now: dt.datetime | Column) -> DataFrame:
    """Per user and facility: queue count, arrivals up to now+2h, mean wait/occupancy, CTAS mix over the secured rows.

    The secured view pairs every queue row of a facility with each of its register, live and scope rows. Here each
    side is grouped by facility first and the counts are multiplied, so no fact row is ever repeated: a facility's
    queue rows each meet all its live rows, so counts are products and the means are those of the live rows alone.
    The arrival window has no lower bound and no status filter (faithful).
    """
    now_c = now if isinstance(now, Column) else F.lit(now)
    horizon = F.timestamp_add("HOUR", F.lit(L.DASHBOARD_ARRIVAL_HORIZON_HOURS), now_c)
    lvl = F.col("provisional_ctas_level")
    counts = ["incoming_queue_count", "arrivals_next_2h", *(f"ctas_{k}_count" for k in range(1, 6))]
    i = intakes.select(F.col("intake_session_id").alias("_iid"), "provisional_ctas_level")
    q = queue.select("facility_id", "intake_session_id", "arrival_window_start").join(i, F.col("intake_session_id") == i._iid).groupBy("facility_id").agg(
        F.count(F.lit(1)).alias("incoming_queue_count"),
        F.sum(F.when(F.col("arrival_window_start") <= horizon, 1).otherwise(0)).alias("arrivals_next_2h"),
        *[F.sum(F.when(lvl == k, 1).otherwise(0)).alias(f"ctas_{k}_count") for k in range(1, 6)],
    )
    live = live_joined.groupBy(F.col("facility_id_normalized").alias("_lid")).agg(
        F.count(F.lit(1)).alias("_rows"),
        F.avg("wait_time_non_priority_minutes").alias("avg_live_wait_minutes"),
        F.avg("stretcher_occupancy_pct").alias("avg_stretcher_occupancy_pct"),
    )
    fm = master.groupBy(F.col("facility_id_normalized").alias("_fid"), "facility_name", "city", "odhf_facility_type").agg(F.count(F.lit(1)).alias("_copies"))
    s = scope_for(scope, None)
    j = fm.join(q, F.col("_fid") == q.facility_id).join(live, F.col("_fid") == live._lid, "left").join(s, F.col("_fid") == s._sid)
    times = F.col("_copies") * F.coalesce(F.col("_rows"), F.lit(1))
    return j.select(
        "user_name", "facility_id", "facility_name", "city", "odhf_facility_type", *[(F.col(c) * times).alias(c) for c in counts],
        "avg_live_wait_minutes", "avg_stretcher_occupancy_pct",
    )


def facility_detail(secure: DataFrame, facility_id: str) -> DataFrame:
    """Secured queue rows of one facility, by window start then position."""
    return secure.filter(F.col("facility_id") == facility_id).orderBy("arrival_window_start", "queue_position")


def register_views(spark, live, queue, master, match, intakes, scope, now) -> None:
    """Publish the five views as temporary views."""
    latest = live_latest(live)
    depth = queue_depth(queue)
    joined = facility_live_joined(master, match, latest, depth)
    secure = staff_queue_secure(queue, intakes, master, joined, scope)
    latest.createOrReplaceTempView("vw_qc_er_live_latest")
    depth.createOrReplaceTempView("vw_virtual_queue_depth")
    joined.createOrReplaceTempView("vw_facility_live_joined")
    secure.createOrReplaceTempView("vw_staff_queue_secure")
    staff_dashboard(queue, intakes, master, joined, scope, now).createOrReplaceTempView("vw_staff_dashboard_secure")
