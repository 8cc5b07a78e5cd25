"""Domain tables derived from the driver's test tables.

The care-access tables (facility register, live emergency-room status,
matches, virtual queue, stored intakes, staff scope) do not exist in the test
data, so they are derived deterministically, by arithmetic both Spark and the
SQL oracle repeat exactly (``careflow.plans.oracle_domain`` holds the SQL twins):

* facility_master  <- supplier x nation x region (one facility per supplier)
* live status      <- events (one scrape row per event; site = user_id)
* facility match   <- distinct live sites (two sites per facility: fan-out)
* virtual_queue    <- orders (facility = o_custkey div 15)
* new reservations <- lineitem (the large-volume variant)
* intake sessions  <- documents (stored columns by arithmetic; raw text for triage)
* staff scope      <- facility_master (one nurse group per nation, one lead per region)

Every derivation is a narrow projection of one scan (plus joins to the
fixed-size nation/region tables), so the derived data grows with the input.
Timestamps stay TIMESTAMP_NTZ, as read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.functions import lexicon as L
from careflow.plans.sizing import broadcast_if_small, spread

AGE_GROUPS = ["adult", "child", "older_adult", "infant"]
STORED_CATEGORIES = ["infection", "injury", "respiratory", "cardiac", "neurological", "digestive", "immune"]
QUEUE_FACILITY_RATIO = 15  # customers per facility == suppliers ratio in TPC-H (150k : 10k)
QUEUE_INTAKE_RATIO = 15  # orders per document (1.5M : 100k)
INGESTED_AT = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _s(c: Column) -> Column:
    return c.cast("string")


def _minutes(ts: Column, minutes: Column) -> Column:
    return F.timestamp_add("MINUTE", minutes.cast("int"), ts)


# ---------------------------------------------------------------- register
def facility_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facility register, 21 columns. nation (25 rows) and region (5 rows) are fixed-size."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    j = s.join(broadcast_if_small(n), s.s_nationkey == n.n_nationkey).join(broadcast_if_small(r), F.col("n_regionkey") == F.col("r_regionkey"))
    k = F.col("s_suppkey")
    ftype = F.when(k % 3 == 0, F.lit("Hospitals")).when(k % 3 == 1, F.lit("Ambulatory health care services"))
    province = F.when(F.col("r_regionkey") % 3 == 0, F.lit("QC")).when(F.col("r_regionkey") % 3 == 1, F.lit("Ontario"))
    street_no = _s(F.lit(100) + k % 900)
    street_name = F.concat(F.lit("Rue "), F.col("r_name"))
    postal = F.concat(F.lit("H"), _s(F.col("s_nationkey") % 10), F.lit("X"))
    city = F.col("n_name")
    full_address = F.concat_ws(", ", street_no, street_name, city, postal)
    return j.select(
        _s(k).alias("index"),
        F.col("s_name").alias("facility_name"),
        ftype.alias("source_facility_type"),
        ftype.alias("odhf_facility_type"),
        F.concat(F.lit("Provider "), _s(F.col("s_nationkey"))).alias("provider"),
        F.lit("").alias("unit"),
        street_no.alias("street_no"),
        street_name.alias("street_name"),
        postal.alias("postal_code"),
        city.alias("city"),
        province.alias("province"),
        full_address.alias("source_format_str_address"),
        city.alias("csdname"),
        (F.col("s_nationkey") * 1000 + F.col("r_regionkey")).cast("double").alias("csduid"),
        (F.lit(24) + F.col("r_regionkey")).cast("int").alias("pruid"),
        (F.lit(45.0) + ((k * 37) % 100).cast("double") / F.lit(100.0)).alias("latitude"),
        (F.lit(-73.0) - ((k * 53) % 100).cast("double") / F.lit(100.0)).alias("longitude"),
        full_address.alias("full_address"),
        F.concat(F.lit("fac_"), _s(k)).alias("facility_id_normalized"),
        F.when(province.isNull(), F.lit(None).cast("boolean"))
        .otherwise(F.upper(F.trim(province)).isin(*L.QUEBEC_PROVINCE_NAMES))
        .alias("is_quebec"),
        F.to_timestamp_ntz(F.lit(INGESTED_AT)).alias("ingested_at"),
    )


# ---------------------------------------------------------------- live status
def site_name(user_id: Column) -> Column:
    return F.concat(F.lit("Supplier#"), F.lpad(_s(user_id), 9, "0"))


def site_address(user_id: Column) -> Column:
    return F.concat(_s(F.lit(100) + user_id % 900), F.lit(", NATION_"), _s(user_id % 25))


def live_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold live-status snapshots (12 columns), one per event."""
    return live_status_from(table(spark, sf_dir, "events"))


def live_status_from(e: DataFrame) -> DataFrame:
    """The live-status projection of an events frame (batch or streaming)."""
    v = F.col("value")
    et = F.col("event_type")
    return e.select(
        F.concat(F.lit("scr_"), F.lpad(_s(F.col("event_id")), 10, "0")).alias("scrape_id"),
        site_name(F.col("user_id")).alias("facility_name_raw"),
        site_address(F.col("user_id")).alias("address_raw"),
        F.concat(F.lit("Region "), _s(F.col("user_id") % 5)).alias("region"),
        F.when(et == "error", F.lit(None)).otherwise(v.cast("int")).cast("int").alias("wait_time_non_priority_minutes"),
        F.when(et == "signup", F.lit(None)).otherwise((v / 10).cast("int")).cast("int").alias("people_waiting"),
        (v / 4).cast("int").alias("total_people_er"),
        (F.floor(v * 3) % 130).cast("double").alias("stretcher_occupancy_pct"),
        (v * 2).cast("int").alias("avg_wait_room_minutes_prev_day"),
        F.when(et == "view", F.lit(None)).otherwise(F.col("event_id") % 600).cast("int").alias("avg_stretcher_wait_minutes_prev_day"),
        F.concat(F.lit(L.SITE_PREFIX + "/en/er?page="), _s(F.col("event_id") % 4 + 1)).alias("source_url"),
        F.col("ts").alias("scraped_at"),
    )


def facility_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match table keyed by (facility_name_raw, address_raw); two live sites per facility."""
    u = table(spark, sf_dir, "events").select("user_id").distinct()
    uid = F.col("user_id")
    fac = F.floor(uid / 2)
    return u.select(
        site_name(uid).alias("facility_name_raw"),
        site_address(uid).alias("address_raw"),
        F.concat(F.lit("fac_"), _s(fac)).alias("matched_facility_id"),
        site_name(fac).alias("matched_facility_name"),
        F.when(uid % 2 == 0, F.lit(1.0)).otherwise(F.lit(0.9)).alias("match_confidence"),
        F.when(uid % 2 == 0, F.lit("exactish")).otherwise(F.lit("fuzzy")).alias("match_method"),
        F.lit(False).alias("manually_validated"),
        F.to_timestamp_ntz(F.lit(INGESTED_AT)).alias("matched_at"),
    )


def manual_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Override rows for every third live site, each with two versions (the later one must win)."""
    u = table(spark, sf_dir, "events").select("user_id").distinct().filter(F.col("user_id") % 3 == 0)
    uid = F.col("user_id")
    versions = u.select("user_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ver"))
    target = uid + F.col("ver") + 1
    return versions.select(
        site_name(uid).alias("facility_name_raw"),
        site_address(uid).alias("address_raw"),
        F.concat(F.lit("fac_"), _s(target)).alias("matched_facility_id"),
        site_name(target).alias("matched_facility_name"),
        F.concat(F.lit("review v"), _s(F.col("ver"))).alias("reason"),
        F.lit("ops").alias("updated_by"),
        F.timestamp_add("DAY", F.col("ver").cast("int"), F.to_timestamp_ntz(F.lit(INGESTED_AT))).alias("updated_at"),
    )


# ---------------------------------------------------------------- queue
def virtual_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return virtual_queue_from(table(spark, sf_dir, "orders"))


def virtual_queue_from(o: DataFrame) -> DataFrame:
    """The virtual-queue projection of an orders frame (batch or streaming)."""
    return o.select(*_queue_columns())


def _queue_columns() -> list[Column]:
    k = F.col("o_orderkey")
    start = _minutes(F.col("o_orderdate"), (k % 96) * 15)
    status = (
        F.when(F.col("o_orderstatus") == "O", F.lit("reserved"))
        .when((F.col("o_orderstatus") == "P") & (k % 5 == 0), F.lit("called"))
        .when(F.col("o_orderstatus") == "P", F.lit("confirmed"))
        .otherwise(F.lit("completed"))
    )
    return [
        F.concat(F.lit("q_"), _s(k)).alias("queue_id"),
        F.concat(F.lit("doc_"), _s(F.floor(k / QUEUE_INTAKE_RATIO))).alias("intake_session_id"),
        F.concat(F.lit("fac_"), _s(F.floor(F.col("o_custkey") / QUEUE_FACILITY_RATIO))).alias("facility_id"),
        start.alias("arrival_window_start"),
        _minutes(start, F.lit(45)).alias("arrival_window_end"),
        (k % 20 + 1).cast("int").alias("queue_position"),
        F.when(k % 7 == 0, F.lit(None)).otherwise(_minutes(start, k % 120)).alias("estimated_call_time"),
        F.when(k % 3 == 0, F.lit("sms")).when(k % 3 == 1, F.lit("email")).otherwise(F.lit("none")).alias("notification_preference"),
        status.alias("queue_status"),
        F.col("o_orderdate").alias("created_at"),
    ]


def queue_with_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The virtual queue with, per reservation, the patient's location (NULL every 13th) and contact details from the
    customer row: one scan of the orders."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k = F.col("o_orderkey")
    return o.join(c, o.o_custkey == c.c_custkey, "left").select(
        *_queue_columns(),
        F.when(k % 13 == 0, F.lit(None)).otherwise(F.lit(45.0) + ((k * 7) % 100).cast("double") / F.lit(100.0)).alias("user_latitude"),
        F.when(k % 13 == 0, F.lit(None)).otherwise(F.lit(-73.0) - ((k * 11) % 100).cast("double") / F.lit(100.0)).alias("user_longitude"),
        F.when(k % 4 == 0, F.lit(None)).otherwise(F.concat(F.lower(F.regexp_replace(F.col("c_name"), "#", ".")), F.lit("@example.org"))).alias("contact_value"),
        F.when(k % 2 == 0, F.lit("email")).alias("channel_type"),
    )


def reservation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New queue reservations (the large-volume variant): one per lineitem."""
    li = table(spark, sf_dir, "lineitem")
    created = _minutes(F.col("l_shipdate"), F.col("l_linenumber") * 7 + F.col("l_partkey") % 60)
    start = _minutes(created, F.lit(15))
    return li.select(
        F.concat(F.lit("r_"), _s(F.col("l_orderkey")), F.lit("_"), _s(F.col("l_linenumber"))).alias("request_id"),
        F.concat(F.lit("fac_"), _s(F.col("l_suppkey"))).alias("facility_id"),
        created.alias("created_at"),
        start.alias("arrival_window_start"),
        _minutes(start, F.lit(45)).alias("arrival_window_end"),
    )


# ---------------------------------------------------------------- intakes
def intake_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored intake rows (assessment columns by arithmetic, for the queue views)."""
    d = table(spark, sf_dir, "documents")
    did = F.col("doc_id")
    level = (did % 5 + 1).cast("int")
    labels = F.create_map(*[x for k, v in L.CTAS_LABELS.items() for x in (F.lit(k), F.lit(v))])
    return d.select(
        F.concat(F.lit("doc_"), _s(did)).alias("intake_session_id"),
        _minutes(F.to_timestamp_ntz(F.lit(INGESTED_AT)), did).alias("created_at"),
        F.when(F.col("lang") == "fr", F.lit("fr")).otherwise(F.lit("en")).alias("language"),
        F.element_at(F.array(*[F.lit(a) for a in AGE_GROUPS]), (did % 4 + 1).cast("int")).alias("patient_age_group"),
        F.element_at(F.array(*[F.lit(s[1].lower()) for s in L.SCENARIOS]), (did % len(L.SCENARIOS) + 1).cast("int")).alias("primary_symptom"),
        F.element_at(F.array(*[F.lit(c) for c in STORED_CATEGORIES]), (did % 7 + 1).cast("int")).alias("symptom_category"),
        (F.col("n_chars") % 72).cast("double").alias("duration_hours"),
        (level <= 2).alias("emergency_stop"),
        level.alias("provisional_ctas_level"),
        F.element_at(labels, level).alias("provisional_ctas_label"),
        F.when(level <= 3, F.lit("hospital")).otherwise(F.lit("ambulatory")).alias("recommended_facility_type"),
        F.when(level <= 2, F.lit("emergency")).when(level == 3, F.lit("same_day")).otherwise(F.lit("low_acuity")).alias("recommended_urgency_band"),
        (level >= 4).alias("queue_eligible"),
    )


def intake_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free-text intakes for triage: a scenario sentence (doc_id mod 26) then the whole document."""
    return intake_texts_from(table(spark, sf_dir, "documents"))


def intake_texts_from(d: DataFrame) -> DataFrame:
    """The intake-text projection of a documents frame (batch or streaming)."""
    did = F.col("doc_id")
    pos = (did % len(L.SCENARIOS) + 1).cast("int")
    en = F.element_at(F.array(*[F.lit(s[1]) for s in L.SCENARIOS]), pos)
    fr = F.element_at(F.array(*[F.lit(s[2]) for s in L.SCENARIOS]), pos)
    out = d.select(
        F.concat(F.lit("doc_"), _s(did)).alias("intake_session_id"),
        F.concat(F.when(F.col("lang") == "fr", fr).otherwise(en), F.lit(". "), F.col("text")).alias("raw_text"),
        F.element_at(F.array(*[F.lit(a) for a in AGE_GROUPS]), (did % 4 + 1).cast("int")).alias("age_group"),
    )
    return spread(out)


def intake_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intake level plus patient location (two decimals; NULL for every 11th intake)."""
    d = table(spark, sf_dir, "documents")
    did = F.col("doc_id")
    lat = F.lit(45.0) + ((did * 13) % 100).cast("double") / F.lit(100.0)
    lon = F.lit(-73.0) - ((did * 29) % 100).cast("double") / F.lit(100.0)
    nul = did % 11 == 0
    return d.select(
        F.concat(F.lit("doc_"), _s(did)).alias("intake_session_id"),
        (did % 5 + 1).cast("int").alias("provisional_ctas_level"),
        F.when(nul, F.lit(None)).otherwise(lat).alias("user_latitude"),
        F.when(nul, F.lit(None)).otherwise(lon).alias("user_longitude"),
    )


# ---------------------------------------------------------------- staff scope
def staff_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row-security map: one nurse group per nation (mod 5) and one lead per region."""
    s = table(spark, sf_dir, "supplier")
    n = table(spark, sf_dir, "nation")
    j = s.join(broadcast_if_small(n), s.s_nationkey == n.n_nationkey)
    fid = F.concat(F.lit("fac_"), _s(F.col("s_suppkey"))).alias("facility_id_normalized")
    created = F.to_timestamp_ntz(F.lit(INGESTED_AT)).alias("created_at")
    nurses = j.select(
        F.concat(F.lit("staff_"), _s(F.col("s_nationkey") % 5)).alias("user_name"),
        fid, F.lit("charge_nurse").alias("role_name"), F.col("n_name").alias("region_scope"), created,
    )
    leads = j.select(
        F.concat(F.lit("LEAD_"), _s(F.col("n_regionkey"))).alias("user_name"),
        fid, F.lit("lead").alias("role_name"), F.col("n_name").alias("region_scope"), created,
    )
    return nurses.unionByName(leads)


def register_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The register as raw CSV-like strings with source header spellings (input of A1)."""
    fm = facility_master(spark, sf_dir)
    as_text = lambda c: F.coalesce(_s(F.col(c)), F.lit(""))
    return fm.select(
        as_text("index").alias("ID"),
        as_text("facility_name").alias("Facility Name"),
        as_text("source_facility_type").alias("facility_type"),
        as_text("odhf_facility_type").alias("ODHF Facility Type"),
        as_text("provider").alias("Provider"),
        as_text("street_no").alias("Street Number"),
        as_text("street_name").alias("street_name"),
        as_text("postal_code").alias("Postal Code"),
        as_text("city").alias("City"),
        as_text("province").alias("Province"),
        as_text("csdname").alias("CSDname"),
        F.concat(as_text("csduid"), F.when(F.col("index").cast("int") % 10 == 0, F.lit("x")).otherwise(F.lit(""))).alias("CSDuid"),
        as_text("pruid").alias("PRuid"),
        as_text("latitude").alias("lat"),
        as_text("longitude").alias("lng"),
    )


__all__ = [
    "facility_master", "live_status", "facility_match", "manual_overrides", "virtual_queue",
    "queue_with_patients", "reservation_requests", "intake_sessions", "intake_texts", "intake_origins", "staff_scope",
    "register_raw", "table",
]


# ---------------------------------------------------------------- emergency-room pages
ER_SCRAPED_AT = "2024-01-01 06:00:00"
ER_MAX_BLOCKS = 3


def _li(text: Column) -> Column:
    return F.concat(F.lit('<li class="hopital-item">'), text, F.lit("</li>"))


def _hhmm(minutes: Column, pad_hours: bool) -> Column:
    h = _s(F.floor(minutes / 60))
    return F.concat(F.lpad(h, 2, "0") if pad_hours else h, F.lit(":"), F.lpad(_s(minutes % 60), 2, "0"))


def _er_block(p: Column, j: Column) -> Column:
    """One hospital block of page p, position j (see the SQL twin in oracle_domain)."""
    site = F.floor(p / 2) * 3 + j
    name = F.concat(F.when(site % 6 == 0, F.lit("CHU Sainte-Justine &amp; ")).otherwise(F.lit("Hôpital ")), site_name(site))
    labels = L.METRIC_LABELS
    wait = _hhmm((p * 7 + j * 13) % 600, True)
    waiting = F.when((p + j) % 9 == 0, F.lit("n/a")).otherwise(_s((p + j) % 40))
    total = F.when(j == 2, F.concat(F.lit("1,"), F.lpad(_s((p * 3 + j) % 90), 3, "0"))).otherwise(_s((p * 3 + j) % 90))
    occ = F.concat(_s((p * 11 + j) % 150), F.when(j == 3, F.lit(",5 %")).otherwise(F.lit(" %")))
    room = _hhmm((p + 5 * j) % 500, False)
    stretcher = _s((p * 17 + j) % 2000)
    total_label = F.when(j == 1, F.lit(f"<strong>{labels['total_people_er']}</strong>")).otherwise(F.lit(labels["total_people_er"]))
    items = F.concat(
        _li(F.concat(F.lit(labels["wait_time_non_priority_minutes"] + " : "), wait)),
        _li(F.concat(F.lit(labels["people_waiting"] + " : "), waiting)),
        _li(F.concat(total_label, F.lit(" : "), total)),
        _li(F.concat(F.lit(labels["stretcher_occupancy_pct"] + " : "), occ)),
        F.when(site % 5 == 0, _li(F.lit(labels["stretcher_occupancy_pct"] + " : 12 %"))).otherwise(F.lit("")),
        F.when(site % 7 == 0, _li(F.lit("Data unavailable"))).otherwise(F.lit("")),
        _li(F.concat(F.lit(labels["avg_wait_room_minutes_prev_day"] + " : "), room)),
        _li(F.concat(F.lit(labels["avg_stretcher_wait_minutes_prev_day"] + " : "), stretcher)),
    )
    address = F.when(site % 11 == 0, F.lit("")).otherwise(
        F.concat(F.lit('<div class="adresse">'), site_address(site), F.lit("<br>Région "), _s(site % 5), F.lit("</div>"))
    )
    return F.concat(
        F.lit('<div class="hospital_element"><ul><li class="title"><span class="font-weight-bold">'), name,
        F.lit("</span></li>"), items, F.lit("</ul>"), address, F.lit("</div>"),
    )


def _er_anchors(p: Column) -> Column:
    n = F.transform(F.sequence(F.lit(1), F.lit(3)), lambda k: F.when(k <= p % 3 + 1, F.concat(
        F.lit('<a data-page="'), _s(k), F.lit('" href="/en/er?page='), _s(k), F.lit('">'), _s(k), F.lit("</a>"))).otherwise(F.lit("")))
    extra = F.concat(
        F.when(p % 4 == 0, F.lit(f'<a href="{L.SITE_PREFIX}/en/er?page=9" data-page="9">9</a>')).otherwise(F.lit("")),
        F.when(p % 5 == 0, F.lit('<a data-page="0" href="">0</a>')).otherwise(F.lit("")),
    )
    return F.concat(F.lit("<nav>"), F.array_join(n, ""), extra, F.lit("</nav>"))


def er_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Emergency-room status pages: each driver page with 0-3 hospital blocks and pagination links before ``</body>``.

    Consecutive pages share sites (page p lists sites 3*floor(p/2)+1..), so the
    first-page-wins deduplication has work to do; every 11th site has no address.
    """
    return er_pages_from(table(spark, sf_dir, "pages"))


def er_pages_from(pg: DataFrame) -> DataFrame:
    """The emergency-room page derivation of a pages frame (batch or streaming)."""
    p = F.col("page_id")
    blocks = F.transform(F.sequence(F.lit(1), F.lit(ER_MAX_BLOCKS)), lambda j: F.when(j <= p % 4, _er_block(p, j)).otherwise(F.lit("")))
    page, end = F.col("html"), "</body>"
    tail = F.when(page.contains(end), F.substring_index(page, end, -1))  # what follows the last one stays
    head = F.coalesce(F.substr(page, F.lit(1), F.length(page) - F.length(tail) - len(end)), page)
    html = F.concat(head, F.array_join(blocks, ""), _er_anchors(p), F.lit(end), F.coalesce(tail, F.lit("</html>")))
    return spread(pg.select("page_id", "url", html.alias("html")))
