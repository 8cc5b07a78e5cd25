"""Registered queries: one per operator family, each (spark, sf_dir) -> DataFrame.

Each query reads the driver tables in ``sf_dir`` (through the derivations in
``careflow.plans.domain``) and runs over whole tables. ``ORACLE`` holds the
independent DuckDB SQL for the same result, with identical column names.
"""

from __future__ import annotations

import secrets

from pyspark.sql import functions as F

from careflow.functions import lexicon as L
from careflow.functions import triage_main as TM
from careflow.functions import triage_scored as TS
from careflow.operators import queue as QU
from careflow.operators import rank as RK
from careflow.operators import staff as ST
from careflow.operators import views as V
from careflow.plans import domain as D
from careflow.plans import oracle_text as OT
from careflow.plans.oracle_domain import with_ctes
from careflow.plans.registry import ORACLE, QUERIES, register  # noqa: F401

NOW = "1998-06-01 00:00:00"  # the "current time" parameter of time-relative views


def now_col():
    return F.to_timestamp_ntz(F.lit(NOW))


# --------------------------------------------------------------------------- shared pieces
def _latest(spark, sf):
    return V.live_latest(D.live_status(spark, sf))


def _depth(spark, sf):
    return V.queue_depth(D.virtual_queue(spark, sf))


def _joined(spark, sf):
    return V.facility_live_joined(D.facility_master(spark, sf), D.facility_match(spark, sf), _latest(spark, sf), _depth(spark, sf))


def _secure(spark, sf):
    return V.staff_queue_secure(
        D.virtual_queue(spark, sf), D.intake_sessions(spark, sf), D.facility_master(spark, sf), _joined(spark, sf),
        D.staff_scope(spark, sf),
    )


def _dashboard(spark, sf):
    return V.staff_dashboard(
        D.virtual_queue(spark, sf), D.intake_sessions(spark, sf), D.facility_master(spark, sf), _joined(spark, sf),
        D.staff_scope(spark, sf), now_col(),
    )


SQL_LATEST = """
  SELECT scrape_id, facility_name_raw, address_raw, region, wait_time_non_priority_minutes, people_waiting, total_people_er,
    stretcher_occupancy_pct, avg_wait_room_minutes_prev_day, avg_stretcher_wait_minutes_prev_day, source_url, scraped_at
  FROM (SELECT *, row_number() OVER (PARTITION BY facility_name_raw, address_raw
                                     ORDER BY scraped_at DESC NULLS LAST, scrape_id DESC NULLS LAST) AS rn FROM live) _r
  WHERE rn = 1"""
SQL_DEPTH = """
  SELECT facility_id, count(*) AS active_queue_count,
    avg(date_sub('minute', created_at, coalesce(estimated_call_time, created_at))) AS avg_queue_delay_minutes
  FROM vq WHERE queue_status IN ('reserved', 'confirmed', 'called') GROUP BY facility_id"""
SQL_JOINED = """
  SELECT fm.facility_id_normalized, fm.facility_name, fm.odhf_facility_type, fm.city, fm.province, fm.is_quebec,
    fm.full_address, fm.latitude, fm.longitude, lv.facility_name_raw, lv.address_raw, lv.region,
    lv.wait_time_non_priority_minutes, lv.people_waiting, lv.total_people_er, lv.stretcher_occupancy_pct,
    lv.avg_wait_room_minutes_prev_day, lv.avg_stretcher_wait_minutes_prev_day, lv.source_url, lv.scraped_at,
    coalesce(d.active_queue_count, 0) AS virtual_queue_depth, coalesce(d.avg_queue_delay_minutes, 0) AS avg_queue_delay_minutes
  FROM fm LEFT JOIN fmatch m ON fm.facility_id_normalized = m.matched_facility_id
  LEFT JOIN latest lv ON lv.facility_name_raw = m.facility_name_raw AND lv.address_raw = m.address_raw
  LEFT JOIN depth d ON fm.facility_id_normalized = d.facility_id"""
SQL_SECURE = """
  SELECT sc.user_name, q.queue_id, q.intake_session_id, q.facility_id, q.arrival_window_start, q.arrival_window_end, q.queue_position,
    q.estimated_call_time, q.notification_preference, q.queue_status, q.created_at,
    i.language, i.patient_age_group, i.primary_symptom, i.symptom_category, i.emergency_stop, i.provisional_ctas_level,
    i.provisional_ctas_label, i.recommended_facility_type, i.recommended_urgency_band,
    lj.wait_time_non_priority_minutes, lj.people_waiting, lj.total_people_er, lj.stretcher_occupancy_pct,
    lj.avg_wait_room_minutes_prev_day, lj.avg_stretcher_wait_minutes_prev_day, fm.facility_name, fm.city, fm.odhf_facility_type
  FROM vq q JOIN intake i ON q.intake_session_id = i.intake_session_id
  JOIN fm ON q.facility_id = fm.facility_id_normalized
  LEFT JOIN joined lj ON fm.facility_id_normalized = lj.facility_id_normalized
  JOIN (SELECT DISTINCT lower(user_name) AS user_name, facility_id_normalized FROM scope) sc
    ON sc.facility_id_normalized = fm.facility_id_normalized"""
SQL_DASH = f"""
  SELECT user_name, facility_id, facility_name, city, odhf_facility_type, count(*) AS incoming_queue_count,
    sum(CASE WHEN arrival_window_start <= TIMESTAMP '{NOW}' + INTERVAL {L.DASHBOARD_ARRIVAL_HORIZON_HOURS} HOUR THEN 1 ELSE 0 END) AS arrivals_next_2h,
    avg(wait_time_non_priority_minutes) AS avg_live_wait_minutes, avg(stretcher_occupancy_pct) AS avg_stretcher_occupancy_pct,
    {", ".join(f"sum(CASE WHEN provisional_ctas_level = {k} THEN 1 ELSE 0 END) AS ctas_{k}_count" for k in range(1, 6))}
  FROM secure GROUP BY user_name, facility_id, facility_name, city, odhf_facility_type"""
VIEW_CTES = (
    ("latest", SQL_LATEST),
    ("depth", SQL_DEPTH),
    ("joined", SQL_JOINED),
    ("secure", SQL_SECURE),
    ("dash", SQL_DASH),
)


def view_sql(body: str) -> str:
    return with_ctes(body, *VIEW_CTES)


# --------------------------------------------------------------------------- views
@register("latest_status", view_sql("SELECT * FROM latest"))
def q_latest_status(spark, sf):
    """E1."""
    return _latest(spark, sf)


@register("latest_status_maxby", view_sql("SELECT * FROM latest"))
def q_latest_status_maxby(spark, sf):
    """E1, aggregate form: max_by over a (scraped_at, scrape_id) key instead of row_number() = 1."""
    return V.live_latest(D.live_status(spark, sf), method="max_by")


@register("queue_depth", view_sql("SELECT * FROM depth"))
def q_queue_depth(spark, sf):
    """D1 + B3."""
    return _depth(spark, sf)


@register("facility_live_joined", view_sql("SELECT * FROM joined"))
def q_facility_live_joined(spark, sf):
    """C1."""
    return _joined(spark, sf)


@register(
    "longest_waits",
    view_sql(f"""
  SELECT facility_id_normalized, facility_name, city, wait_time_non_priority_minutes, people_waiting, stretcher_occupancy_pct,
    virtual_queue_depth, scraped_at
  FROM joined ORDER BY wait_time_non_priority_minutes DESC NULLS LAST, facility_id_normalized, scraped_at DESC NULLS LAST
  LIMIT {L.LONGEST_WAITS_LIMIT}"""),
)
def q_longest_waits(spark, sf):
    """top 20 current waits (a top-k report), with explicit tie keys."""
    return (
        _joined(spark, sf)
        .select("facility_id_normalized", "facility_name", "city", "wait_time_non_priority_minutes", "people_waiting",
                "stretcher_occupancy_pct", "virtual_queue_depth", "scraped_at")
        .orderBy(F.col("wait_time_non_priority_minutes").desc_nulls_last(), "facility_id_normalized",
                 F.col("scraped_at").desc_nulls_last())
        .limit(L.LONGEST_WAITS_LIMIT)
    )


@register("staff_queue_secure", view_sql("SELECT * FROM secure"))
def q_staff_queue_secure(spark, sf):
    """C2 + C3, one result per scope user."""
    return _secure(spark, sf)


@register("staff_dashboard", view_sql("SELECT * FROM dash"))
def q_staff_dashboard(spark, sf):
    """D2."""
    return _dashboard(spark, sf)


@register(
    "busiest_sites",
    view_sql("""
  SELECT user_name, facility_id, facility_name, incoming_queue_count, arrivals_next_2h, avg_live_wait_minutes,
    ctas_4_count + ctas_5_count AS low_acuity_mix, avg_stretcher_occupancy_pct
  FROM dash ORDER BY user_name, incoming_queue_count DESC, avg_stretcher_occupancy_pct DESC NULLS LAST, facility_id"""),
)
def q_busiest_sites(spark, sf):
    """F2 + B9."""
    return ST.busiest_sites(_dashboard(spark, sf))


@register(
    "staff_totals",
    view_sql("""
  SELECT user_name, sum(coalesce(arrivals_next_2h, 0)) AS total_next_2h,
    sum(coalesce(ctas_4_count, 0) + coalesce(ctas_5_count, 0)) AS total_ctas_4_5,
    sum(coalesce(incoming_queue_count, 0)) AS total_queue
  FROM dash GROUP BY user_name"""),
)
def q_staff_totals(spark, sf):
    """D4."""
    return ST.staff_totals(_dashboard(spark, sf))


SQL_TOP = """
  SELECT user_name, facility_id AS top_facility_id, facility_name AS top_facility_name, city AS top_city,
    incoming_queue_count AS top_queue_count, avg_live_wait_minutes AS top_avg_live_wait_minutes
  FROM (SELECT *, row_number() OVER (PARTITION BY user_name ORDER BY incoming_queue_count DESC,
          avg_stretcher_occupancy_pct DESC NULLS LAST, facility_id) AS rn FROM dash) _t WHERE rn = 1"""


@register("top_facility", view_sql(SQL_TOP))
def q_top_facility(spark, sf):
    """D5."""
    return ST.top_facility(_dashboard(spark, sf))


def _staff_answer_sql() -> str:
    qs = ", ".join(f"({OT.q(x)})" for x in ST.STAFF_QUESTIONS)
    low = " OR ".join(f"contains(lower(question), {OT.q(k)})" for k in L.STAFF_LOW_ACUITY_KEYS)
    next2 = L.STAFF_NEXT2H.replace("{total}", "%d").replace("{name}", "%s").replace("{count}", "%d")
    cong = L.STAFF_CONGESTION.replace("{name}", "%s").replace("{city}", "%s").replace("{wait}", "%s")
    return view_sql(f"""
  SELECT u.user_name, qq.question,
    CASE WHEN p.top_facility_id IS NULL THEN {OT.q(L.STAFF_NO_DATA)}
      WHEN contains(lower(qq.question), {OT.q(L.STAFF_NEXT2H_KEY)})
        THEN printf({OT.q(next2)}, p.total_next_2h, coalesce(p.top_facility_name, 'None'), p.top_queue_count)
      WHEN {low} THEN printf({OT.q(L.STAFF_LOW_ACUITY.replace("{total}", "%d"))}, p.total_ctas_4_5)
      ELSE printf({OT.q(cong)}, coalesce(p.top_facility_name, 'None'), coalesce(p.top_city, 'None'),
                  CAST(round_even(coalesce(p.top_avg_live_wait_minutes, 0.0), 1) AS VARCHAR)) END AS answer
  FROM (SELECT DISTINCT lower(user_name) AS user_name FROM scope) u
  LEFT JOIN (SELECT t.*, x.top_facility_id, x.top_facility_name, x.top_city, x.top_queue_count, x.top_avg_live_wait_minutes
             FROM (SELECT user_name, sum(coalesce(arrivals_next_2h, 0)) AS total_next_2h,
                     sum(coalesce(ctas_4_count, 0) + coalesce(ctas_5_count, 0)) AS total_ctas_4_5 FROM dash GROUP BY user_name) t
             JOIN ({SQL_TOP}) x ON t.user_name = x.user_name) p ON u.user_name = p.user_name
  CROSS JOIN (VALUES {qs}) qq(question)""")


@register("staff_answer", _staff_answer_sql())
def q_staff_answer(spark, sf):
    """D6, every scope user x three questions."""
    return ST.staff_answer(_dashboard(spark, sf), D.staff_scope(spark, sf))


# --------------------------------------------------------------------------- triage
TRIAGE_MAIN_COLS = ["intake_session_id"] + TM.ASSESSMENT_COLUMNS
TRIAGE_SCORED_COLS = ["intake_session_id"] + TS.DECISION_COLUMNS


def _triage_main(spark, sf):
    return TM.triage_main(D.intake_texts(spark, sf), "raw_text", "age_group").select(*TRIAGE_MAIN_COLS)


def _triage_scored(spark, sf):
    return TS.triage_scored(D.intake_texts(spark, sf), "raw_text", "age_group", None).select(*TRIAGE_SCORED_COLS)


SQL_TRIAGE_MAIN = OT.triage_main("intake_text", "intake_session_id", "raw_text", "age_group")
SQL_TRIAGE_SCORED = OT.triage_scored("intake_text", "intake_session_id", "raw_text", "age_group", None)


@register("triage_main", with_ctes(SQL_TRIAGE_MAIN))
def q_triage_main(spark, sf):
    """H33 (with H10, H13, H15, H17, H19, H23, H25, H31, H7, H1) over every document."""
    return _triage_main(spark, sf)


@register("triage_scored", with_ctes(SQL_TRIAGE_SCORED))
def q_triage_scored(spark, sf):
    """H34 (with H2, H8, H11, H12, H14, H16, H18, H20-H30, H32, H46) over every document."""
    return _triage_scored(spark, sf)


@register(
    "case_distribution",
    with_ctes(f"""
  SELECT provisional_ctas_level, risk_band, count(*) AS n_cases FROM ({SQL_TRIAGE_SCORED}) _d
  GROUP BY provisional_ctas_level, risk_band"""),
)
def q_case_distribution(spark, sf):
    """Case counts by level and band."""
    return _triage_scored(spark, sf).groupBy("provisional_ctas_level", "risk_band").agg(F.count(F.lit(1)).alias("n_cases"))


# --------------------------------------------------------------------------- ranking
def _sql_haversine(lat1, lon1, lat2, lon2):
    a = (f"pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * "
         f"pow(sin(radians({lon2} - {lon1}) / 2), 2)")
    return f"round({L.EARTH_RADIUS_KM} * 2 * atan2(sqrt({a}), sqrt(1 - ({a}))), 2)"


def _sql_norm(v, lo, hi):
    return f"(CASE WHEN {v} IS NULL THEN 1.0 WHEN {hi} = {lo} THEN 0.0 ELSE (CAST({v} AS DOUBLE) - {lo}) / ({hi} - {lo}) END)"


_AMB = " OR ".join(f"contains(lower(coalesce(odhf_facility_type, '')), {OT.q(m)})" for m in L.AMBULATORY_MARKERS)
_PEN = f"""CAST(CASE WHEN provisional_ctas_level <= 2 AND ({_AMB}) THEN {L.FIT_PENALTY_EMERGENT_AMBULATORY}
  WHEN provisional_ctas_level = 3 AND ({_AMB}) THEN {L.FIT_PENALTY_URGENT_AMBULATORY}
  WHEN provisional_ctas_level IN (4, 5) AND NOT ({_AMB}) THEN {L.FIT_PENALTY_LOW_HOSPITAL} ELSE 0.0 END AS DOUBLE)"""
_W = L.RANK_WEIGHTS
SQL_PAIRS = f"""
  cand AS (SELECT facility_id_normalized, facility_name_raw, address_raw, facility_name, city, odhf_facility_type, latitude, longitude,
             wait_time_non_priority_minutes, stretcher_occupancy_pct, people_waiting, virtual_queue_depth, total_people_er,
             avg_wait_room_minutes_prev_day, avg_stretcher_wait_minutes_prev_day
           FROM joined WHERE is_quebec IS NULL OR is_quebec = TRUE),
  stats AS (SELECT {", ".join(f"min(coalesce(CAST({c} AS DOUBLE), 0.0)) AS _{m}_lo, max(coalesce(CAST({c} AS DOUBLE), 0.0)) AS _{m}_hi" for m, c in RK.METRICS.items())} FROM cand),
  rkeys AS (SELECT DISTINCT provisional_ctas_level, user_latitude, user_longitude FROM origins),
  p1 AS (SELECT k.*, c.*, s.*, coalesce({_sql_haversine('k.user_latitude', 'k.user_longitude', 'c.latitude', 'c.longitude')}, 0.0) AS distance_km
         FROM rkeys k CROSS JOIN cand c CROSS JOIN stats s),
  p2 AS (SELECT *, min(distance_km) OVER w AS _dist_lo, max(distance_km) OVER w AS _dist_hi FROM p1
         WINDOW w AS (PARTITION BY provisional_ctas_level, user_latitude, user_longitude)),
  pairs AS (SELECT *, {_PEN} AS fit_penalty, round_even(
      CAST({_W[0]} AS DOUBLE) * {_sql_norm('wait_time_non_priority_minutes', '_wait_lo', '_wait_hi')}
    + CAST({_W[1]} AS DOUBLE) * {_sql_norm('distance_km', '_dist_lo', '_dist_hi')}
    + CAST({_W[2]} AS DOUBLE) * {_sql_norm('stretcher_occupancy_pct', '_occupancy_lo', '_occupancy_hi')}
    + CAST({_W[3]} AS DOUBLE) * {_sql_norm('people_waiting', '_waiting_lo', '_waiting_hi')}
    + CAST({_W[4]} AS DOUBLE) * {_sql_norm('virtual_queue_depth', '_depth_lo', '_depth_hi')}
    + CAST({_W[5]} AS DOUBLE) * {_PEN}, 4) AS score FROM p2)"""


def _rank_sql(body: str) -> str:
    full = view_sql("SELECT 1")
    head = full[: full.rindex("SELECT 1")]
    return head.rstrip() + ",\n" + SQL_PAIRS.strip() + "\n" + body


SQL_RECOMMEND = f"""
  SELECT o.intake_session_id, t.* FROM origins o JOIN (
    SELECT provisional_ctas_level, user_latitude, user_longitude, rank_position, facility_id_normalized, facility_name_raw, address_raw,
      facility_name, city, odhf_facility_type, wait_time_non_priority_minutes, people_waiting, stretcher_occupancy_pct, virtual_queue_depth,
      total_people_er, avg_wait_room_minutes_prev_day, avg_stretcher_wait_minutes_prev_day, latitude, longitude, distance_km, score, fit_penalty,
      coalesce(wait_time_non_priority_minutes, 0) + CAST(trunc(distance_km * 2) AS INTEGER) + CAST(trunc(coalesce(virtual_queue_depth, 0) * 10) AS INTEGER) AS estimated_total_time_minutes,
      CASE WHEN fit_penalty <= {L.TYPE_FIT_THRESHOLD} THEN 'high' ELSE 'caution' END AS fit_for_ctas
    FROM (SELECT *, row_number() OVER (PARTITION BY provisional_ctas_level, user_latitude, user_longitude
                   ORDER BY score, facility_id_normalized NULLS FIRST, facility_name_raw NULLS FIRST, address_raw NULLS FIRST) AS rank_position
          FROM (SELECT * REPLACE (worst.s AS score, worst.p AS fit_penalty, worst.d AS distance_km)
                FROM (SELECT *, max({{'p': fit_penalty, 's': score, 'd': distance_km}}) OVER (
                        PARTITION BY provisional_ctas_level, user_latitude, user_longitude, facility_id_normalized) AS worst FROM pairs) _c) _w
          WHERE NOT (provisional_ctas_level <= 3 AND contains(lower(coalesce(odhf_facility_type, '')), {OT.q(L.ACUITY_FILTER_MARKER)}))) _r
    WHERE rank_position <= {L.RECOMMENDATIONS_PER_INTAKE}) t
  ON o.provisional_ctas_level IS NOT DISTINCT FROM t.provisional_ctas_level
 AND o.user_latitude IS NOT DISTINCT FROM t.user_latitude AND o.user_longitude IS NOT DISTINCT FROM t.user_longitude"""
# one request: level 3 at the centre of the derived locations
RANK_REQUEST = (3, 45.5, -73.5)
SQL_RANK_ORDER = """
  SELECT row_number() OVER (ORDER BY fit_penalty, score, facility_id_normalized NULLS FIRST, facility_name_raw NULLS FIRST, address_raw NULLS FIRST) AS rank_position,
    facility_id_normalized, facility_name_raw, address_raw, distance_km, score, fit_penalty, odhf_facility_type AS facility_type
  FROM pairs"""


@register("recommendations", _rank_sql(SQL_RECOMMEND))
def q_recommendations(spark, sf):
    """C7 + D8 + E2 + H36-H38 + C8 + B5 + B10 + E4: top 12 facilities for every intake."""
    return RK.recommend(D.intake_origins(spark, sf), _joined(spark, sf))


_ORIGINS_ONE = "rkeys AS (SELECT CAST({} AS INTEGER) AS provisional_ctas_level, CAST({} AS DOUBLE) AS user_latitude, CAST({} AS DOUBLE) AS user_longitude)".format(*RANK_REQUEST)


@register("rank_order", _rank_sql(SQL_RANK_ORDER).replace("rkeys AS (SELECT DISTINCT provisional_ctas_level, user_latitude, user_longitude FROM origins)", _ORIGINS_ONE))
def q_rank_order(spark, sf):
    """The whole (fit_penalty, score) order of the candidates for one request."""
    return RK.rank_order(RANK_REQUEST, _joined(spark, sf))


# --------------------------------------------------------------------------- queue
@register(
    "next_position",
    with_ctes("""
  SELECT facility_id, coalesce(max(queue_position), 0) + 1 AS next_position FROM vq
  WHERE queue_status IN ('reserved', 'confirmed', 'called') GROUP BY facility_id"""),
)
def q_next_position(spark, sf):
    """D3."""
    return QU.next_position(D.virtual_queue(spark, sf))


@register(
    "queue_positions",
    with_ctes(f"""
  SELECT request_id, facility_id, created_at, arrival_window_start, arrival_window_end, queue_position,
    arrival_window_start + to_minutes(CAST(queue_position * {L.MINUTES_PER_POSITION} AS BIGINT)) AS estimated_call_time
  FROM (SELECT r.*, CAST(coalesce(b.next_position, 1) + row_number() OVER (PARTITION BY r.facility_id ORDER BY r.created_at, r.request_id) - 1 AS INTEGER) AS queue_position
        FROM requests r LEFT JOIN (SELECT facility_id, coalesce(max(queue_position), 0) + 1 AS next_position FROM vq
                                   WHERE queue_status IN ('reserved', 'confirmed', 'called') GROUP BY facility_id) b
        ON r.facility_id = b.facility_id) _p"""),
)
def q_queue_positions(spark, sf):
    """E5 + H41 over every lineitem-derived reservation request."""
    return QU.assign_positions(D.reservation_requests(spark, sf), D.virtual_queue(spark, sf))


@register(
    "queue_tracking",
    with_ctes(f"""
  SELECT q.queue_id, q.queue_position, q.estimated_call_time, q.queue_status, q.arrival_window_start, q.arrival_window_end,
    fm.facility_name, fm.city, fm.latitude, fm.longitude, d.distance_km, d.remaining_minutes,
    coalesce(d.distance_km IS NOT NULL AND d.remaining_minutes <= greatest({L.LEAVE_NOW_MIN_MINUTES}, CAST(trunc(d.distance_km * 2) AS INTEGER)), false) AS leave_now_recommendation
  FROM vq q JOIN patients p ON q.queue_id = p.queue_id JOIN fm ON q.facility_id = fm.facility_id_normalized
  CROSS JOIN LATERAL (SELECT {_sql_haversine('p.user_latitude', 'p.user_longitude', 'fm.latitude', 'fm.longitude')} AS distance_km,
      greatest(0, CAST(floor(date_sub('second', TIMESTAMP '{NOW}', q.estimated_call_time) / 60.0) AS INTEGER)) AS remaining_minutes) d"""),
)
def q_queue_tracking(spark, sf):
    """C4 + H39 + H40 + H9 for every reservation."""
    return QU.track_queue(D.queue_with_patients(spark, sf), D.facility_master(spark, sf), now_col())


@register(
    "reservation_windows",
    with_ctes(f"""
  SELECT request_id, created_at, ui_start, ui_start + INTERVAL {L.UI_WINDOW_LENGTH_MINUTES} MINUTE AS ui_end,
    legacy_start, legacy_start + INTERVAL {L.UI_WINDOW_LENGTH_MINUTES} MINUTE AS legacy_end
  FROM (SELECT request_id, created_at,
          date_trunc('hour', created_at) + to_minutes(CAST(ceil(minute(created_at) / {L.UI_WINDOW_ROUND_MINUTES}.0) * {L.UI_WINDOW_ROUND_MINUTES} AS BIGINT)) AS ui_start,
          created_at + INTERVAL {L.LEGACY_WINDOW_OFFSET_MINUTES} MINUTE AS legacy_start
        FROM requests) _w"""),
)
def q_reservation_windows(spark, sf):
    """Default arrival windows (browser and legacy rules) for every request time."""
    r = D.reservation_requests(spark, sf)
    ui_s, ui_e = QU.default_window_ui(F.col("created_at"))
    lg_s, lg_e = QU.default_window_legacy(F.col("created_at"))
    return r.select("request_id", "created_at", ui_s.alias("ui_start"), ui_e.alias("ui_end"), lg_s.alias("legacy_start"), lg_e.alias("legacy_end"))


def contact_key(spark) -> str:
    """The session's key (`spark.careflow.contactKey`, 32 characters), else one made for this run."""
    return spark.conf.get("spark.careflow.contactKey", None) or secrets.token_hex(16)


_CONTACTS = f"""
  FROM vq q JOIN patients p ON q.queue_id = p.queue_id
  WHERE p.contact_value IS NOT NULL AND p.contact_value <> ''
    AND coalesce(q.notification_preference, '') NOT IN ({", ".join(OT.q(x) for x in L.NO_CONTACT_PREFERENCES)})"""
_CONTACT_COLUMNS = f"""'contact_' || substr(sha256(q.queue_id), 1, 16) AS contact_id, q.queue_id,
    coalesce(p.channel_type, q.notification_preference) AS channel_type,
    q.created_at + INTERVAL {L.CONTACT_RETENTION_DAYS} DAY AS expires_at"""


@register("contact_rows", with_ctes(f"SELECT * EXCLUDE n, CAST(n + 2 * ((n - 1) // 76) AS INTEGER) AS encrypted_length FROM (SELECT {_CONTACT_COLUMNS}, CAST(4 * ceil((28 + strlen(p.contact_value)) / 3.0) AS INTEGER) AS n {_CONTACTS}) _e"))
def q_contact_rows(spark, sf):
    """Encrypted contact rows; the cipher text has a random IV, so its length (base64 in lines of 76) stands for it here."""
    enc = QU.contact_rows(D.queue_with_patients(spark, sf), contact_key(spark))
    return enc.select("contact_id", "queue_id", "channel_type", "expires_at", F.length("encrypted_contact_value").alias("encrypted_length"))


@register("contact_roundtrip", with_ctes(f"SELECT {_CONTACT_COLUMNS}, p.contact_value {_CONTACTS}"))
def q_contact_roundtrip(spark, sf):
    """Every encrypted contact row decrypted again."""
    key = contact_key(spark)
    enc = QU.contact_rows(D.queue_with_patients(spark, sf), key)
    return QU.decrypt_contact(enc, key).select("contact_id", "queue_id", "channel_type", "contact_value", "expires_at")


FLAGSHIP = "recommendations"


# further query families register themselves on import
from careflow.plans import catalog_rules  # noqa: E402,F401
from careflow.plans import catalog_text  # noqa: E402,F401
from careflow.plans import catalog_ingest  # noqa: E402,F401
from careflow.plans import catalog_more  # noqa: E402,F401
from careflow.plans import catalog_streams  # noqa: E402,F401
