"""SQL (DuckDB dialect) twins of the domain derivations in ``careflow.plans.domain``."""

from __future__ import annotations

from careflow.functions import lexicon as L
from careflow.plans import domain as D
from careflow.plans.oracle_text import q


def _list(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def _site_name(u: str) -> str:
    return f"('Supplier#' || lpad(CAST({u} AS VARCHAR), 9, '0'))"


def _site_address(u: str) -> str:
    return f"(CAST(100 + {u} % 900 AS VARCHAR) || ', NATION_' || CAST({u} % 25 AS VARCHAR))"


def _minutes(ts: str, m: str) -> str:
    return f"({ts} + to_minutes(CAST({m} AS BIGINT)))"


QUEBEC = ", ".join(q(x) for x in L.QUEBEC_PROVINCE_NAMES)
T0 = f"TIMESTAMP '{D.INGESTED_AT}'"

CTES = {
    "fm": f"""
  SELECT CAST(s.s_suppkey AS VARCHAR) AS "index", s.s_name AS facility_name,
    CASE s.s_suppkey % 3 WHEN 0 THEN 'Hospitals' WHEN 1 THEN 'Ambulatory health care services' END AS source_facility_type,
    CASE s.s_suppkey % 3 WHEN 0 THEN 'Hospitals' WHEN 1 THEN 'Ambulatory health care services' END AS odhf_facility_type,
    'Provider ' || CAST(s.s_nationkey AS VARCHAR) AS provider, '' AS unit,
    CAST(100 + s.s_suppkey % 900 AS VARCHAR) AS street_no, 'Rue ' || r.r_name AS street_name,
    'H' || CAST(s.s_nationkey % 10 AS VARCHAR) || 'X' AS postal_code, n.n_name AS city,
    CASE r.r_regionkey % 3 WHEN 0 THEN 'QC' WHEN 1 THEN 'Ontario' END AS province,
    concat_ws(', ', CAST(100 + s.s_suppkey % 900 AS VARCHAR), 'Rue ' || r.r_name, n.n_name, 'H' || CAST(s.s_nationkey % 10 AS VARCHAR) || 'X') AS source_format_str_address,
    n.n_name AS csdname, CAST(s.s_nationkey * 1000 + r.r_regionkey AS DOUBLE) AS csduid,
    CAST(24 + r.r_regionkey AS INTEGER) AS pruid,
    CAST(45.0 AS DOUBLE) + CAST((s.s_suppkey * 37) % 100 AS DOUBLE) / CAST(100.0 AS DOUBLE) AS latitude,
    CAST(-73.0 AS DOUBLE) - CAST((s.s_suppkey * 53) % 100 AS DOUBLE) / CAST(100.0 AS DOUBLE) AS longitude,
    concat_ws(', ', CAST(100 + s.s_suppkey % 900 AS VARCHAR), 'Rue ' || r.r_name, n.n_name, 'H' || CAST(s.s_nationkey % 10 AS VARCHAR) || 'X') AS full_address,
    'fac_' || CAST(s.s_suppkey AS VARCHAR) AS facility_id_normalized,
    CASE WHEN r.r_regionkey % 3 = 2 THEN NULL
         ELSE upper(trim(CASE r.r_regionkey % 3 WHEN 0 THEN 'QC' WHEN 1 THEN 'Ontario' END)) IN ({QUEBEC}) END AS is_quebec,
    {T0} AS ingested_at
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "live": f"""
  SELECT 'scr_' || lpad(CAST(event_id AS VARCHAR), 10, '0') AS scrape_id,
    {_site_name('user_id')} AS facility_name_raw, {_site_address('user_id')} AS address_raw,
    'Region ' || CAST(user_id % 5 AS VARCHAR) AS region,
    CASE WHEN event_type = 'error' THEN NULL ELSE CAST(trunc(value) AS INTEGER) END AS wait_time_non_priority_minutes,
    CASE WHEN event_type = 'signup' THEN NULL ELSE CAST(trunc(value / 10) AS INTEGER) END AS people_waiting,
    CAST(trunc(value / 4) AS INTEGER) AS total_people_er,
    CAST(floor(value * 3) % 130 AS DOUBLE) AS stretcher_occupancy_pct,
    CAST(trunc(value * 2) AS INTEGER) AS avg_wait_room_minutes_prev_day,
    CASE WHEN event_type = 'view' THEN NULL ELSE CAST(event_id % 600 AS INTEGER) END AS avg_stretcher_wait_minutes_prev_day,
    '{L.SITE_PREFIX}/en/er?page=' || CAST(event_id % 4 + 1 AS VARCHAR) AS source_url,
    ts AS scraped_at
  FROM events""",
    "fmatch": f"""
  SELECT {_site_name('user_id')} AS facility_name_raw, {_site_address('user_id')} AS address_raw,
    'fac_' || CAST(user_id // 2 AS VARCHAR) AS matched_facility_id, {_site_name('user_id // 2')} AS matched_facility_name,
    CASE WHEN user_id % 2 = 0 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS match_confidence,
    CASE WHEN user_id % 2 = 0 THEN 'exactish' ELSE 'fuzzy' END AS match_method,
    false AS manually_validated, {T0} AS matched_at
  FROM (SELECT DISTINCT user_id FROM events) _u""",
    "overrides": f"""
  SELECT {_site_name('user_id')} AS facility_name_raw, {_site_address('user_id')} AS address_raw,
    'fac_' || CAST(user_id + ver + 1 AS VARCHAR) AS matched_facility_id, {_site_name('user_id + ver + 1')} AS matched_facility_name,
    'review v' || CAST(ver AS VARCHAR) AS reason, 'ops' AS updated_by, {T0} + to_days(CAST(ver AS INTEGER)) AS updated_at
  FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 3 = 0) _u CROSS JOIN (VALUES (0), (1)) _v(ver)""",
    "vq": f"""
  SELECT 'q_' || CAST(o_orderkey AS VARCHAR) AS queue_id,
    'doc_' || CAST(o_orderkey // {D.QUEUE_INTAKE_RATIO} AS VARCHAR) AS intake_session_id,
    'fac_' || CAST(o_custkey // {D.QUEUE_FACILITY_RATIO} AS VARCHAR) AS facility_id,
    {_minutes('o_orderdate', '(o_orderkey % 96) * 15')} AS arrival_window_start,
    {_minutes(_minutes('o_orderdate', '(o_orderkey % 96) * 15'), '45')} AS arrival_window_end,
    CAST(o_orderkey % 20 + 1 AS INTEGER) AS queue_position,
    CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {_minutes(_minutes('o_orderdate', '(o_orderkey % 96) * 15'), 'o_orderkey % 120')} END AS estimated_call_time,
    CASE o_orderkey % 3 WHEN 0 THEN 'sms' WHEN 1 THEN 'email' ELSE 'none' END AS notification_preference,
    CASE WHEN o_orderstatus = 'O' THEN 'reserved' WHEN o_orderstatus = 'P' AND o_orderkey % 5 = 0 THEN 'called'
         WHEN o_orderstatus = 'P' THEN 'confirmed' ELSE 'completed' END AS queue_status,
    o_orderdate AS created_at
  FROM orders""",
    "patients": """
  SELECT 'q_' || CAST(o_orderkey AS VARCHAR) AS queue_id,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(45.0 AS DOUBLE) + CAST((o_orderkey * 7) % 100 AS DOUBLE) / CAST(100.0 AS DOUBLE) END AS user_latitude,
    CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(-73.0 AS DOUBLE) - CAST((o_orderkey * 11) % 100 AS DOUBLE) / CAST(100.0 AS DOUBLE) END AS user_longitude,
    CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE lower(replace(c_name, '#', '.')) || '@example.org' END AS contact_value,
    CASE WHEN o_orderkey % 2 = 0 THEN 'email' END AS channel_type
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "requests": f"""
  SELECT 'r_' || CAST(l_orderkey AS VARCHAR) || '_' || CAST(l_linenumber AS VARCHAR) AS request_id,
    'fac_' || CAST(l_suppkey AS VARCHAR) AS facility_id,
    {_minutes('l_shipdate', 'l_linenumber * 7 + l_partkey % 60')} AS created_at,
    {_minutes(_minutes('l_shipdate', 'l_linenumber * 7 + l_partkey % 60'), '15')} AS arrival_window_start,
    {_minutes(_minutes(_minutes('l_shipdate', 'l_linenumber * 7 + l_partkey % 60'), '15'), '45')} AS arrival_window_end
  FROM lineitem""",
    "intake": f"""
  SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS intake_session_id,
    {_minutes(T0, 'doc_id')} AS created_at,
    CASE WHEN lang = 'fr' THEN 'fr' ELSE 'en' END AS language,
    {_list(D.AGE_GROUPS)}[doc_id % 4 + 1] AS patient_age_group,
    {_list([s[1].lower() for s in L.SCENARIOS])}[doc_id % {len(L.SCENARIOS)} + 1] AS primary_symptom,
    {_list(D.STORED_CATEGORIES)}[doc_id % 7 + 1] AS symptom_category,
    CAST(n_chars % 72 AS DOUBLE) AS duration_hours,
    (doc_id % 5 + 1) <= 2 AS emergency_stop,
    CAST(doc_id % 5 + 1 AS INTEGER) AS provisional_ctas_level,
    {_list([L.CTAS_LABELS[k] for k in range(1, 6)])}[doc_id % 5 + 1] AS provisional_ctas_label,
    CASE WHEN doc_id % 5 + 1 <= 3 THEN 'hospital' ELSE 'ambulatory' END AS recommended_facility_type,
    CASE WHEN doc_id % 5 + 1 <= 2 THEN 'emergency' WHEN doc_id % 5 + 1 = 3 THEN 'same_day' ELSE 'low_acuity' END AS recommended_urgency_band,
    (doc_id % 5 + 1) >= 4 AS queue_eligible
  FROM documents""",
    "intake_text": f"""
  SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS intake_session_id,
    CASE WHEN lang = 'fr' THEN {_list([s[2] for s in L.SCENARIOS])}[doc_id % {len(L.SCENARIOS)} + 1]
         ELSE {_list([s[1] for s in L.SCENARIOS])}[doc_id % {len(L.SCENARIOS)} + 1] END || '. ' || text AS raw_text,
    {_list(D.AGE_GROUPS)}[doc_id % 4 + 1] AS age_group
  FROM documents""",
    "origins": """
  SELECT 'doc_' || CAST(doc_id AS VARCHAR) AS intake_session_id, CAST(doc_id % 5 + 1 AS INTEGER) AS provisional_ctas_level,
    CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(45.0 AS DOUBLE) + CAST((doc_id * 13) % 100 AS DOUBLE) / CAST(100.0 AS DOUBLE) END AS user_latitude,
    CASE WHEN doc_id % 11 = 0 THEN NULL ELSE CAST(-73.0 AS DOUBLE) - CAST((doc_id * 29) % 100 AS DOUBLE) / CAST(100.0 AS DOUBLE) END AS user_longitude
  FROM documents""",
    "scope": f"""
  SELECT 'staff_' || CAST(s.s_nationkey % 5 AS VARCHAR) AS user_name, 'fac_' || CAST(s.s_suppkey AS VARCHAR) AS facility_id_normalized,
    'charge_nurse' AS role_name, n.n_name AS region_scope, {T0} AS created_at
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
  UNION ALL
  SELECT 'LEAD_' || CAST(n.n_regionkey AS VARCHAR), 'fac_' || CAST(s.s_suppkey AS VARCHAR), 'lead', n.n_name, {T0}
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey""",
}


def with_ctes(body: str, *extra: tuple[str, str]) -> str:
    parts = [f"{name} AS ({sql}\n)" for name, sql in list(CTES.items()) + list(extra)]
    return "WITH " + ",\n".join(parts) + "\n" + body
