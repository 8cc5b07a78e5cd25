"""Registered queries: register load, reference-table rules and keywords, SQL functions, load counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from careflow.functions import lexicon as L
from careflow.operators import rules as RU
from careflow.plans import domain as D
from careflow.plans import oracle_text as OT
from careflow.plans.catalog import SQL_TRIAGE_MAIN, SQL_TRIAGE_SCORED, _triage_main, _triage_scored, register
from careflow.plans.oracle_domain import QUEBEC, T0, with_ctes
from careflow.sources import reference as REF
from careflow.sources import register as RG


def _values(rows, names, alias: str) -> str:
    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return "true" if v else "false"
        if isinstance(v, (int, float)):
            return str(v)
        return OT.q(v)

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) {alias}({', '.join(names)})"


# --------------------------------------------------------------------------- register
_FTYPE = "CASE s.s_suppkey % 3 WHEN 0 THEN 'Hospitals' WHEN 1 THEN 'Ambulatory health care services' ELSE '' END"
_PROV = "CASE r.r_regionkey % 3 WHEN 0 THEN 'QC' WHEN 1 THEN 'Ontario' ELSE '' END"
_POSTAL = "'H' || CAST(s.s_nationkey % 10 AS VARCHAR) || 'X'"
_STREET_NO = "CAST(100 + s.s_suppkey % 900 AS VARCHAR)"
SQL_REGISTER = f"""
  SELECT CAST(s.s_suppkey AS VARCHAR) AS "index", s.s_name AS facility_name, {_FTYPE} AS source_facility_type,
    {_FTYPE} AS odhf_facility_type, 'Provider ' || CAST(s.s_nationkey AS VARCHAR) AS provider, '' AS unit,
    {_STREET_NO} AS street_no, 'Rue ' || r.r_name AS street_name, {_POSTAL} AS postal_code, n.n_name AS city,
    {_PROV} AS province, '' AS source_format_str_address, n.n_name AS csdname,
    CASE WHEN s.s_suppkey % 10 = 0 THEN NULL ELSE CAST(s.s_nationkey * 1000 + r.r_regionkey AS DOUBLE) END AS csduid,
    CAST(24 + r.r_regionkey AS INTEGER) AS pruid,
    CAST(45.0 AS DOUBLE) + CAST((s.s_suppkey * 37) % 100 AS DOUBLE) / CAST(100.0 AS DOUBLE) AS latitude,
    CAST(-73.0 AS DOUBLE) - CAST((s.s_suppkey * 53) % 100 AS DOUBLE) / CAST(100.0 AS DOUBLE) AS longitude,
    concat_ws(', ', {_STREET_NO}, 'Rue ' || r.r_name, n.n_name, {_POSTAL}) AS full_address,
    replace({OT.norm_main("s.s_name || ' ' || n.n_name || ' ' || " + _POSTAL)}, ' ', '_') AS facility_id_normalized,
    upper(trim({_PROV})) IN ({QUEBEC}) AS is_quebec, {T0} AS ingested_at
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""
BROWSE_COLUMNS = ["index", "facility_name", "source_facility_type", "odhf_facility_type", "provider", "unit",
                  "street_no", "street_name", "postal_code", "city"]


def _register(spark, sf):
    return RG.register_load(D.register_raw(spark, sf), D.INGESTED_AT)


@register("register_load", "WITH reg AS (" + SQL_REGISTER + ") SELECT * FROM reg")
def q_register_load(spark, sf):
    """A1 + A2 + A5 + B1 + B2 + H3: raw register strings (publisher header spellings) -> typed register."""
    return _register(spark, sf)


@register("facility_browse", "WITH reg AS (" + SQL_REGISTER + ") SELECT " + ", ".join(f'"{c}"' for c in BROWSE_COLUMNS) + " FROM reg")
def q_facility_browse(spark, sf):
    """The ten register columns of the facility browser, whole table."""
    return _register(spark, sf).select(*BROWSE_COLUMNS)


@register("live_load_counts", with_ctes("SELECT count(*) AS rows_loaded, max(scraped_at) AS snapshot_at FROM live"))
def q_live_load_counts(spark, sf):
    """Row count and snapshot time of the live-status load."""
    return RG.load_counts(D.live_status(spark, sf), "scraped_at")


# --------------------------------------------------------------------------- rules
_MAIN_RULE_COLS = ["ctas_level", "ctas_label", "routing_policy", "escalation_message", "queue_eligible", "facility_type_guidance"]
_SCORED_RULE_COLS = ["ctas_level", "ctas_label", "base_score", "routing_policy", "escalation_message"]


@register(
    "triage_main_rules",
    with_ctes(f"""
  SELECT t.intake_session_id, t.provisional_ctas_level, r.ctas_label AS rule_label, r.routing_policy, r.escalation_message,
    r.queue_eligible AS rule_queue_eligible, r.facility_type_guidance
  FROM ({SQL_TRIAGE_MAIN}) t LEFT JOIN {_values(L.MAIN_RULES_ROWS, _MAIN_RULE_COLS, 'r')} ON t.provisional_ctas_level = r.ctas_level"""),
)
def q_triage_main_rules(spark, sf):
    """C9 (main rules table) over every document's main triage."""
    t = _triage_main(spark, sf).select("intake_session_id", "provisional_ctas_level")
    out = RU.attach_rules(t, REF.main_rules(spark))
    return out.select(
        "intake_session_id", "provisional_ctas_level", F.col("ctas_label").alias("rule_label"), "routing_policy",
        "escalation_message", F.col("queue_eligible").alias("rule_queue_eligible"), "facility_type_guidance",
    )


@register(
    "triage_scored_rules",
    with_ctes(f"""
  SELECT t.intake_session_id, t.provisional_ctas_level, t.risk_score, r.ctas_label AS rule_label, r.base_score,
    r.routing_policy, r.escalation_message
  FROM ({SQL_TRIAGE_SCORED}) t LEFT JOIN {_values(L.SCORED_RULES_ROWS, _SCORED_RULE_COLS, 'r')} ON t.provisional_ctas_level = r.ctas_level"""),
)
def q_triage_scored_rules(spark, sf):
    """C9 (scored rules table) over every document's scored triage."""
    t = _triage_scored(spark, sf).select("intake_session_id", "provisional_ctas_level", "risk_score")
    out = RU.attach_rules(t, REF.scored_rules(spark))
    return out.select(
        "intake_session_id", "provisional_ctas_level", "risk_score", F.col("ctas_label").alias("rule_label"),
        "base_score", "routing_policy", "escalation_message",
    )


# --------------------------------------------------------------------------- keywords
_KW_MAIN = _values(L.MAIN_KEYWORD_ROWS, ["keyword", "language", "flag_label", "severity_weight", "note"], "k")
_KW_SCORED = _values(REF.scored_keyword_rows(), ["keyword_id", "phrase", "normalized_phrase", "severity_class", "active_flag"], "k")


@register(
    "keyword_flags_main",
    with_ctes(f"""
  SELECT i.intake_session_id,
    coalesce(list_sort(list_distinct(list(k.flag_label) FILTER (WHERE k.keyword IS NOT NULL))), []) AS keyword_flags,
    CAST(coalesce(sum(k.severity_weight), 0) AS INTEGER) AS keyword_weight,
    CAST(count(k.keyword) AS INTEGER) AS keyword_hits
  FROM intake_text i LEFT JOIN {_KW_MAIN} ON contains({OT.norm_main('i.raw_text')}, k.keyword)
  GROUP BY i.intake_session_id"""),
)
def q_keyword_flags_main(spark, sf):
    """C10 (main keyword table) over every whole document."""
    t = D.intake_texts(spark, sf)
    return RU.keyword_flags_main(t, REF.main_keywords(spark)).select(
        "intake_session_id", "keyword_flags", "keyword_weight", "keyword_hits")


@register(
    "keyword_flags_scored",
    with_ctes(f"""
  SELECT i.intake_session_id,
    coalesce(list_sort(list(k.keyword_id) FILTER (WHERE k.keyword_id IS NOT NULL)), []) AS matched_keyword_ids,
    CAST(count(*) FILTER (WHERE k.severity_class = 'strong_emergency') AS INTEGER) AS strong_emergency_hits,
    CAST(count(*) FILTER (WHERE k.severity_class = 'serious_concern') AS INTEGER) AS serious_concern_hits,
    CAST(count(*) FILTER (WHERE k.severity_class = 'mild_concern') AS INTEGER) AS mild_concern_hits
  FROM intake_text i LEFT JOIN {_KW_SCORED} ON k.active_flag AND contains({OT.norm_scored('i.raw_text')}, k.normalized_phrase)
  GROUP BY i.intake_session_id"""),
)
def q_keyword_flags_scored(spark, sf):
    """C10 (scored keyword table) over every whole document."""
    t = D.intake_texts(spark, sf)
    return RU.keyword_flags_scored(t, REF.scored_keywords(spark)).select(
        "intake_session_id", "matched_keyword_ids", "strong_emergency_hits", "serious_concern_hits", "mild_concern_hits")


# --------------------------------------------------------------------------- SQL functions
_BAND_SQL = "CASE " + " ".join(f"WHEN risk_score >= {t} THEN {OT.q(b)}" for t, b in L.RISK_BANDS) + f" ELSE {OT.q(L.RISK_BAND_DEFAULT)} END"


@register(
    "sql_functions",
    with_ctes(f"""
  SELECT intake_session_id, provisional_ctas_level, risk_score,
    {OT.ctas_label('provisional_ctas_level')} AS ctas_label_sql, {_BAND_SQL} AS risk_band_sql
  FROM ({SQL_TRIAGE_SCORED}) t"""),
)
def q_sql_functions(spark, sf):
    """U1 + U2: the two SQL scalar functions applied in Spark SQL to every scored intake."""
    RU.register_sql_functions(spark)
    _triage_scored(spark, sf).createOrReplaceTempView("careflow_scored_intakes")
    return spark.sql("""
      SELECT intake_session_id, provisional_ctas_level, risk_score,
        ctas_label_from_level(provisional_ctas_level) AS ctas_label_sql, risk_band_from_score(risk_score) AS risk_band_sql
      FROM careflow_scored_intakes""")

