"""Risk score (H26-H29) and queue policy (H30, H32): literal branch cases, including branches no triage input reaches.

Covers: stop and level 1 force 100; the level-2 floor of 85; half-even rounding
(4.5 -> 4, 14.5 -> 14, 29.5 -> 30, 9.5 -> 10); each duration arm (worsening
beats the 72-hour arm); unknown age groups; every band incl. "high"; every
queue-policy arm incl. moderate at level 5.
"""

import pytest
from pyspark.sql import functions as F

from careflow.functions import triage_scored as TS

# level, red-flag component, age group, severity, duration hours, stop -> score, band
RISK_CASES = [
    (3, 0, 'adult', [], 0, True, 100, 'critical'),
    (1, 0, 'adult', [], 0, False, 100, 'critical'),
    (2, 0, 'adult', [], 0, False, 85, 'critical'),
    (2, 100, 'infant', ['severe pain'], 80, False, 85, 'critical'),
    (3, 100, 'infant', ['severe pain'], 80, False, 63, 'high'),
    (3, 50, 'infant', ['severe pain'], 80, False, 48, 'moderate'),
    (4, 100, 'infant', ['severe pain'], 80, False, 49, 'moderate'),
    (5, 0, 'adult', [], 0, False, 4, 'low'),
    (4, 0, 'child', [], 8, False, 14, 'low'),
    (3, 0, 'adult', ['worsening'], 30, False, 30, 'moderate'),
    (3, 0, 'adult', ['worsening'], 24, False, 29, 'moderate'),
    (4, 0, 'adult', ['moderate pain'], 12, False, 15, 'low'),
    (4, 0, 'adult', ['moderate pain'], 23, False, 15, 'low'),
    (4, 0, 'adult', [], 72, False, 14, 'low'),
    (4, 0, 'adult', ['worsening'], 72, False, 16, 'low'),
    (4, 0, 'adult', ['impaired function'], 24, False, 17, 'low'),
    (5, 15, 'other', [], 0, False, 10, 'low'),
    (5, 15, 'older_adult', ['moderate pain', 'worsening'], 100, False, 13, 'low'),
    (4, 50, 'unknown', [], 6, False, 29, 'moderate'),
    (5, 100, 'older_adult', ['severe pain'], 72, False, 40, 'moderate'),
]
# level, band, stop, category -> queue_eligible, facility type, urgency band
POLICY_CASES = [
    (3, 'low', True, 'injury', False, 'hospital', 'emergency'),
    (1, 'critical', False, 'cardiac', False, 'hospital', 'emergency'),
    (3, 'low', False, 'injury', False, 'hospital', 'same_day'),
    (4, 'critical', False, 'injury', False, 'hospital', 'emergency'),
    (4, 'high', False, 'injury', False, 'hospital', 'same_day'),
    (4, 'moderate', False, 'injury', False, 'hospital', 'same_day'),
    (5, 'moderate', False, 'injury', True, 'ambulatory', 'low_acuity'),
    (5, 'moderate', False, 'cardiac', False, 'hospital', 'same_day'),
    (4, 'low', False, 'injury', True, 'ambulatory', 'same_day'),
    (4, 'low', False, 'respiratory', True, 'hospital', 'same_day'),
    (5, 'low', False, 'digestive', True, 'ambulatory', 'low_acuity'),
    (5, 'low', False, 'neurological', True, 'hospital', 'low_acuity'),
]


def test_risk_score_cases(spark):
    df = spark.createDataFrame([c[:6] for c in RISK_CASES], "lvl int, rfc int, age string, sev array<string>, h int, stop boolean")
    sc = TS.risk_score(F.col("lvl"), F.col("rfc"), F.col("age"), F.col("sev"), F.col("h"), F.col("stop"))
    got = [(r["s"], r["b"]) for r in df.select(sc.alias("s")).select("s", TS.risk_band(F.col("s")).alias("b")).collect()]
    assert got == [c[6:] for c in RISK_CASES]


@pytest.mark.parametrize("score,band", [(0, "low"), (24, "low"), (25, "moderate"), (49, "moderate"), (50, "high"), (74, "high"), (75, "critical"), (100, "critical")])
def test_band_edges(spark, score, band):
    assert spark.range(1).select(TS.risk_band(F.lit(score)).alias("b")).first()["b"] == band


def test_queue_policy_cases(spark):
    df = spark.createDataFrame([c[:4] for c in POLICY_CASES], "lvl int, band string, stop boolean, cat string")
    p = TS.queue_policy(F.col("lvl"), F.col("band"), F.col("stop"), F.col("cat"))
    got = [(r["p"]["queue_eligible"], r["p"]["facility_type"], r["p"]["urgency_band"]) for r in df.select(p.alias("p")).collect()]
    assert got == [c[4:] for c in POLICY_CASES]
