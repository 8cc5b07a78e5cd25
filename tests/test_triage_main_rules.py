"""Main rule engine (H7, H10, H13, H15, H17, H19, H23, H31, H33): literal expected assessments.

The sentences exercise every level rule and the substring traps of the rules
("rash" inside "crash", "cut" inside "acute", "je" inside "injection", "day"
inside "today", "3.5" normalized to "3 5").
"""

import pytest

from careflow.functions import lexicon as L
from careflow.functions import triage_main as TM

# text, age, language, category, duration_hours, severity, flags, level, stop, queue_eligible, facility, urgency
CASES = [
    ('Loss of consciousness after a fall', 'adult', 'en', 'general', 0.0, [], ['loss_of_consciousness'], 1, True, False, 'hospital', 'emergency'),
    ('Chest pain radiating to the arm', 'older_adult', 'en', 'general', 0.0, ['pain'], ['chest_pain'], 2, True, False, 'hospital', 'emergency'),
    ('Severe headache since this morning', 'adult', 'en', 'neurological', 0.0, ['severe'], [], 3, False, False, 'hospital', 'same_day'),
    ('Fever and rash', 'child', 'en', 'respiratory', 0.0, [], [], 3, False, False, 'hospital', 'same_day'),
    ('Fever and rash', 'adult', 'en', 'respiratory', 0.0, [], [], 3, False, False, 'hospital', 'same_day'),
    ('Persistent cough for 2 weeks', 'adult', 'en', 'respiratory', 336.0, [], [], 3, False, False, 'hospital', 'same_day'),
    ('Vomiting since yesterday', 'adult', 'en', 'gastrointestinal', 0.0, [], [], 4, False, True, 'ambulatory', 'low_acuity'),
    ('Twisted ankle, mild swelling, 30 min ago', 'adult', 'en', 'musculoskeletal', 0.5, ['mild'], [], 4, False, True, 'ambulatory', 'low_acuity'),
    ('Small cut on the finger', '', 'en', 'dermatology', 0.0, [], [], 4, False, True, 'ambulatory', 'low_acuity'),
    ('I feel anxious and panic at night', None, 'en', 'mental_health', 0.0, [], [], 3, False, False, 'hospital', 'same_day'),
    ('Nothing specific, just tired', 'adult', 'en', 'general', 0.0, [], [], 4, False, True, 'ambulatory', 'low_acuity'),
    ('', 'adult', 'unknown', 'general', 0.0, [], [], 5, False, True, 'ambulatory', 'low_acuity'),
    ('Bonjour, douleur au dos depuis 3 jours', 'adult', 'fr', 'general', 72.0, ['pain'], [], 4, False, True, 'ambulatory', 'low_acuity'),
    ('I had an injection yesterday', 'adult', 'fr', 'general', 0.0, [], [], 4, False, True, 'ambulatory', 'low_acuity'),
    ('2 hours today of acute pain', 'adult', 'en', 'dermatology', 48.0, ['pain'], [], 4, False, True, 'ambulatory', 'low_acuity'),
    ('Pain for 3.5 hours', 'adult', 'en', 'general', 3.0, ['pain'], [], 4, False, True, 'ambulatory', 'low_acuity'),
    ('Car crash, unable to move', 'adult', 'en', 'dermatology', 0.0, ['unable'], ['major_trauma'], 1, True, False, 'hospital', 'emergency'),
    ('Throat swelling after peanuts', 'child', 'en', 'general', 0.0, [], ['anaphylaxis_signs'], 1, True, False, 'hospital', 'emergency'),
    ('Worst migraine ever, cannot see', 'adult', 'en', 'neurological', 0.0, ['cannot', 'worst'], [], 3, False, False, 'hospital', 'same_day'),
    ('Slight dizziness when standing', 'older_adult', 'en', 'neurological', 0.0, ['slight'], [], 3, False, False, 'hospital', 'same_day'),
    ('Infant fever and poor feeding', 'infant', 'en', 'respiratory', 0.0, [], ['high_risk_infant_symptoms'], 2, True, False, 'hospital', 'emergency'),
    ('Eczema flare with itching for 1 day', 'child', 'en', 'dermatology', 24.0, [], [], 4, False, True, 'ambulatory', 'low_acuity'),
]


@pytest.fixture(scope="module")
def assessed(spark):
    rows = [(str(i), c[0], c[1]) for i, c in enumerate(CASES)]
    df = spark.createDataFrame(rows, "intake_session_id string, raw_text string, age_group string")
    return {r["intake_session_id"]: r.asDict() for r in TM.triage_main(df, "raw_text", "age_group").collect()}


@pytest.mark.parametrize("i", range(len(CASES)))
def test_main_engine_case(assessed, i):
    text, age, lang, cat, hours, sev, flags, level, stop, eligible, facility, urgency = CASES[i]
    got = assessed[str(i)]
    assert (got["language"], got["symptom_category"], got["duration_hours"], got["severity_indicators"], got["emergency_flags"]) == (
        lang, cat, hours, sev, flags)
    assert (got["provisional_ctas_level"], got["emergency_stop"], got["queue_eligible"]) == (level, stop, eligible)
    assert (got["recommended_facility_type"], got["recommended_urgency_band"]) == (facility, urgency)
    assert got["provisional_ctas_label"] == L.CTAS_LABELS[level]
    assert got["patient_age_group"] == (age or "unknown")
