"""The literal cases the reference's own suites pin (triage, ranking), plus small unit checks."""

import pytest
from pyspark.sql import functions as F

from careflow.functions import triage_main as TM
from careflow.functions import triage_scored as TS
from careflow.functions.text import parse_duration_to_hours_main, parse_duration_to_minutes, parse_metric_int, normalize_main
from careflow.operators import rank as RK


def _main(spark, text, age):
    df = spark.createDataFrame([("i1", text, age)], "intake_session_id string, raw_text string, age_group string")
    return TM.triage_main(df, "raw_text", "age_group").collect()[0].asDict()


def _scored(spark, text, age, hours):
    df = spark.createDataFrame([(text, age, hours)], "raw_text string, age_group string, d int")
    return TS.triage_scored(df, "raw_text", "age_group", "d").collect()[0].asDict()


def test_main_emergency_stop(spark):
    r = _main(spark, "Chest pain with shortness of breath and severe sweating", "adult")
    assert r["emergency_stop"] is True and r["provisional_ctas_level"] <= 2


def test_main_low_acuity(spark):
    r = _main(spark, "Mild ankle sprain after walking, minor swelling for 4 hours", "adult")
    assert r["provisional_ctas_level"] >= 4


def test_scored_cases(spark):
    r = _scored(spark, "Infant fever with poor feeding for 6 hours", "infant", 6)
    assert r["emergency_stop"] and "high-risk infant symptoms" in r["emergency_flags"]
    r = _scored(spark, "Loss of consciousness with blue lips", "adult", 1)
    assert r["provisional_ctas_level"] == 1 and r["emergency_stop"]
    r = _scored(spark, "Chest pain and pressure for two hours", "older_adult", 2)
    assert r["provisional_ctas_level"] in (1, 2) and not r["queue_eligible"]
    r = _scored(spark, "Severe abdominal pain getting worse since yesterday", "adult", 28)
    assert r["provisional_ctas_level"] == 3 and r["recommended_facility_type"] == "hospital" and not r["queue_eligible"]
    r = _scored(spark, "Minor cut on hand with light bleeding, stable for 2 hours", "adult", 2)
    assert r["provisional_ctas_level"] in (4, 5) and r["queue_eligible"]
    assert _scored(spark, "Twisted ankle with swelling after a fall", "adult", 4)["language"] == "en"
    assert _scored(spark, "Mal de gorge et fievre depuis un jour", "child", 24)["language"] == "fr"


def _no_more():
    return {c: F.lit(None).cast("int") for c in RK.SHOWN}


def test_worst_copy_gives_score_penalty_and_distance(spark):
    """Two copies of facility d, a hospital and a clinic: at level 3 the clinic copy is the worst, for both rows."""
    cols = ("facility_id_normalized string, facility_name_raw string, address_raw string, facility_name string, city string, "
            "odhf_facility_type string, latitude double, longitude double, wait_time_non_priority_minutes int, "
            "stretcher_occupancy_pct double, people_waiting int, virtual_queue_depth int, is_quebec boolean")
    live = spark.createDataFrame([
        ("d", "D1", "x", "D", "Montreal", "hospital", 45.0, -73.0, 60, 50.0, 5, 1, True),
        ("d", "D2", "y", "D", "Montreal", "clinic", 46.0, -73.0, 60, 50.0, 5, 1, True),
        ("e", "E", "z", "E", "Montreal", "hospital", 45.0, -73.0, 90, 80.0, 9, 4, True),
    ], cols).withColumns(_no_more())
    req = spark.createDataFrame([("i1", 3, 45.0, -73.0)], "intake_session_id string, provisional_ctas_level int, user_latitude double, user_longitude double")
    alone = {r["facility_name_raw"]: r for r in RK.rank_order((3, 45.0, -73.0), live).collect()}
    got = RK.recommend(req, live).collect()
    d = [r for r in got if r["facility_id_normalized"] == "d"]
    assert len(d) == 2 and {r["fit_for_ctas"] for r in d} == {"caution"}
    assert {(r["fit_penalty"], r["score"], r["distance_km"]) for r in d} == {(alone["D2"]["fit_penalty"], alone["D2"]["score"], alone["D2"]["distance_km"])}
    assert alone["D1"]["fit_penalty"] == 0.0 and alone["D2"]["distance_km"] > 100


@pytest.mark.parametrize("query", ["recommendations", "fuzzy_match", "match_refresh"])
def test_nothing_is_paired_out(spark, query):
    """Requests and candidates, sites and register rows meet by equi-joins alone."""
    import __spark_entry__ as E
    from conftest import SF_SMALL

    plan = E.queries()[query](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Join" in plan and not any(x in plan for x in ("BroadcastNestedLoopJoin", "CartesianProduct"))


def test_ranking_prefers_hospital_at_level_3(spark):
    cols = ("facility_id_normalized string, facility_name_raw string, address_raw string, facility_name string, city string, "
            "odhf_facility_type string, latitude double, longitude double, wait_time_non_priority_minutes int, "
            "stretcher_occupancy_pct double, people_waiting int, virtual_queue_depth int, is_quebec boolean")
    live = spark.createDataFrame([
        ("hospital", "H", "h", "Hospital", "Montreal", "hospital", 45.5, -73.5, 120, 95.0, 15, 8, True),
        ("ambulatory", "C", "c", "Clinic", "Montreal", "ambulatory", 45.52, -73.52, 25, 5.0, 2, 1, True),
    ], cols)
    first = RK.rank_order((3, 45.51, -73.51), live.withColumns(_no_more())).orderBy("rank_position").first()
    assert first["facility_id_normalized"] == "hospital"


def test_text_parsers(spark):
    df = spark.createDataFrame([("05:30", "1,234", "2 hours today", "Hôpital Œuvre-Saint")], "a string, b string, c string, d string")
    r = df.select(parse_duration_to_minutes(F.col("a")).alias("a"), parse_metric_int(F.col("b")).alias("b"),
                  parse_duration_to_hours_main(normalize_main(F.col("c"))).alias("c"), normalize_main(F.col("d")).alias("d")).first()
    assert r["a"] == 330 and r["b"] == 1 and r["c"] == 48.0 and r["d"] == "hopital oeuvre saint"


def test_transliteration(spark):
    df = spark.createDataFrame([("Ødegård Łódź Straße Þór Æsir đ",)], "t string")
    assert df.select(normalize_main(F.col("t")).alias("n")).first()["n"] == "odegard lodz strasse thor aesir d"
