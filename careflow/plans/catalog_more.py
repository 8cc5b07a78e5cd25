"""Registered queries: lookups, detail and top-k reports, published views, vocabulary."""

from __future__ import annotations

import contextlib
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from careflow.functions import lexicon as L
from careflow.functions import triage_scored as TS
from careflow.functions.text import compact_text, normalize_scored
from careflow.operators import views as V
from careflow.plans import domain as D
from careflow.plans import oracle_text as OT
from careflow.plans.catalog import (
    SQL_RECOMMEND,
    SQL_TRIAGE_SCORED,
    _dashboard,
    _rank_sql,
    _secure,
    now_col,
    q_recommendations,
    register,
    view_sql,
)
from careflow.plans.catalog_text import SQL_DECISIONS, _decisions
from careflow.plans.oracle_domain import with_ctes
from careflow.session import ensure_checkpoint_dir
from careflow.sources import publish as PB

DETAIL_FACILITY = "fac_1"
# the secured view repeats a queue row once per matched live row, so the live columns complete the order
DETAIL_ORDER = ["arrival_window_start", "queue_position", "queue_id", "wait_time_non_priority_minutes", "people_waiting",
                "total_people_er", "stretcher_occupancy_pct", "avg_wait_room_minutes_prev_day", "avg_stretcher_wait_minutes_prev_day"]
DETAIL_TOP = 5
RECS_SHOWN = 6


@register("facility_detail", view_sql(f"SELECT * FROM secure WHERE facility_id = {OT.q(DETAIL_FACILITY)}"))
def q_facility_detail(spark, sf):
    """Secured queue rows of one facility (every scope user), by window start then position."""
    return V.facility_detail(_secure(spark, sf), DETAIL_FACILITY)


@register(
    "facility_detail_top5",
    view_sql(f"""
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY user_name, facility_id ORDER BY {", ".join(c + " NULLS FIRST" for c in DETAIL_ORDER)}) AS rn
    FROM secure) _t WHERE rn <= {DETAIL_TOP}"""),
)
def q_facility_detail_top5(spark, sf):
    """the first five secured queue rows of every (user, facility), by window start, position, id.

    Rank-limited window: Catalyst plans a partial group limit before the
    shuffle, so a facility holding a large share of the queue is cut to five
    rows per partition map-side.
    """
    w = Window.partitionBy("user_name", "facility_id").orderBy(*[F.col(c).asc_nulls_first() for c in DETAIL_ORDER])
    s = _secure(spark, sf)
    return s.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= DETAIL_TOP).drop("_rn")


@register("recommendations_top6", _rank_sql(f"SELECT * FROM ({SQL_RECOMMEND}) _r WHERE rank_position <= {RECS_SHOWN}"))
def q_recommendations_top6(spark, sf):
    """the first six recommendations shown per intake."""
    return q_recommendations(spark, sf).filter(F.col("rank_position") <= RECS_SHOWN)


@register(
    "recent_intakes",
    with_ctes(f"SELECT * FROM intake ORDER BY created_at DESC, intake_session_id LIMIT {L.RECENT_CASES_LIMIT}"),
)
def q_recent_intakes(spark, sf):
    """the 12 most recent stored intakes (a top-k report; id breaks ties)."""
    return D.intake_sessions(spark, sf).orderBy(F.col("created_at").desc(), "intake_session_id").limit(L.RECENT_CASES_LIMIT)


@register(
    "queue_chart",
    view_sql("SELECT user_name, facility_name, incoming_queue_count FROM dash ORDER BY user_name, incoming_queue_count DESC, facility_name"),
)
def q_queue_chart(spark, sf):
    """queue size per facility for each user's chart, largest first."""
    return _dashboard(spark, sf).select("user_name", "facility_name", "incoming_queue_count").orderBy(
        "user_name", F.col("incoming_queue_count").desc(), "facility_name")


SQL_LOOKUP = f"""
  SELECT r.intake_session_id,
    CASE WHEN i.intake_session_id IS NOT NULL THEN 'live' WHEN c.conv_id IS NOT NULL THEN 'simulated' ELSE 'missing' END AS found_in,
    coalesce(i.provisional_ctas_level, c.provisional_ctas_level) AS provisional_ctas_level,
    coalesce(i.recommended_facility_type, c.recommended_facility_type) AS recommended_facility_type,
    coalesce(i.queue_eligible, c.queue_eligible) AS queue_eligible
  FROM (SELECT DISTINCT intake_session_id FROM vq) r
  LEFT JOIN intake i ON r.intake_session_id = i.intake_session_id
  LEFT JOIN ({SQL_DECISIONS}) c ON r.intake_session_id = 'doc_' || CAST(c.conv_id AS VARCHAR)"""


@register("intake_lookup", with_ctes(SQL_LOOKUP))
def q_intake_lookup(spark, sf):
    """B6 + B7: every intake id the queue references, from the stored table, else the scored conversations, else reported missing."""
    req = D.virtual_queue(spark, sf).select("intake_session_id").distinct()
    cols = ["provisional_ctas_level", "recommended_facility_type", "queue_eligible"]
    live = D.intake_sessions(spark, sf).select("intake_session_id", F.struct(*cols).alias("_live"))
    sim = _decisions(spark, sf).select(
        F.concat(F.lit("doc_"), F.col("conv_id").cast("string")).alias("intake_session_id"), F.struct(*cols).alias("_sim"))
    j = req.join(live, "intake_session_id", "left").join(sim, "intake_session_id", "left")
    rec = F.coalesce(F.col("_live"), F.col("_sim"))
    return j.select(
        "intake_session_id",
        F.when(F.col("_live").isNotNull(), F.lit("live")).when(F.col("_sim").isNotNull(), F.lit("simulated"))
        .otherwise(F.lit("missing")).alias("found_in"),
        *[rec[c].alias(c) for c in cols],
    )


@register(
    "document_vocabulary",
    with_ctes(f"""
  SELECT intake_session_id, list_sort(list_distinct(list_filter(string_split({OT.norm_scored('raw_text')}, ' '), lambda t: t <> ''))) AS terms
  FROM intake_text"""),
)
def q_document_vocabulary(spark, sf):
    """G1: sorted distinct non-empty terms of every whole normalized document."""
    t = D.intake_texts(spark, sf)
    terms = F.array_sort(F.array_distinct(F.filter(F.split(normalize_scored(F.col("raw_text")), " "), lambda x: x != "")))
    return t.select("intake_session_id", terms.alias("terms"))


@register("published_views", view_sql("SELECT user_name, facility_id, incoming_queue_count FROM dash"))
def q_published_views(spark, sf):
    """The five views published as temporary views, then queried by name in Spark SQL."""
    V.register_views(spark, D.live_status(spark, sf), D.virtual_queue(spark, sf), D.facility_master(spark, sf),
                     D.facility_match(spark, sf), D.intake_sessions(spark, sf), D.staff_scope(spark, sf), now_col())
    return spark.sql("SELECT user_name, facility_id, incoming_queue_count FROM vw_staff_dashboard_secure")


# --------------------------------------------------------------------------- H35, H43
@register("partial_views", with_ctes(f"""
  SELECT intake_session_id, emergency_flags, provisional_ctas_level, provisional_ctas_label, risk_score, risk_band, queue_eligible,
    recommended_facility_type, recommended_urgency_band FROM ({SQL_TRIAGE_SCORED}) _t"""))
def q_partial_views(spark, sf):
    """The flags, level, risk and policy views of every intake, one after the other."""
    d = D.intake_texts(spark, sf)
    cols = d.columns
    out = TS.policy_view(TS.risk_view(TS.level_view(TS.flags_view(d))))
    return out.select("intake_session_id", *[c for c in out.columns if c not in cols])


@register("compact_texts", """
  SELECT doc_id, nullif(trim(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' '), '') AS compact FROM documents""")
def q_compact_texts(spark, sf):
    """Every document's text with runs of blanks collapsed."""
    return D.table(spark, sf, "documents").select("doc_id", compact_text("text").alias("compact"))


# --------------------------------------------------------------------------- A13, A14, A17, A20, A21
def _fresh(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


@register("published_live", with_ctes("SELECT * FROM live WHERE scraped_at = (SELECT max(scraped_at) FROM live) OR wait_time_non_priority_minutes > 60"))
def q_published_live(spark, sf):
    """A13 + A20: the live table published, then replaced by a selection of itself, then left alone by an empty load."""
    path = _fresh(spark, "published")
    PB.publish(D.live_status(spark, sf), path, "live table", "scraped_at")
    old = spark.read.parquet(path)
    newest = old.agg(F.max("scraped_at")).first()[0]
    PB.publish(old.filter((F.col("scraped_at") == F.lit(newest)) | (F.col("wait_time_non_priority_minutes") > 60)), path, "live table", "scraped_at")
    with contextlib.suppress(PB.EmptyLoad):
        PB.publish(spark.read.parquet(path).filter("false"), path, "live table", "scraped_at")
    return spark.read.parquet(path)


@register("snapshot_loads", with_ctes("""
  SELECT CAST(scraped_at AS DATE) AS snapshot_date, CASE WHEN hash_even THEN 'even' ELSE 'odd' END AS load_id, count(*) AS rows_loaded, max(scraped_at) AS snapshot_at
  FROM (SELECT *, extract(hour FROM scraped_at) % 2 = 0 AS hash_even FROM live) _l GROUP BY ALL"""))
def q_snapshot_loads(spark, sf):
    """A14 + A17 + A21: two loads appended by snapshot date, one of them twice; rows and newest snapshot of each day and load."""
    path, live = _fresh(spark, "snapshots"), D.live_status(spark, sf)
    even = F.hour("scraped_at") % 2 == 0
    for load, rows in (("even", live.filter(even)), ("odd", live.filter(~even)), ("even", live.filter(even))):
        PB.append_load(rows, path, load)
    return spark.read.parquet(path).groupBy("snapshot_date", "load_id").agg(F.count("*").alias("rows_loaded"), F.max("scraped_at").alias("snapshot_at"))
