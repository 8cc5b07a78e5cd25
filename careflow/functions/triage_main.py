"""Main rule-based triage.

``triage_main(df, text_col, age_col)`` appends the 14 assessment columns to a
DataFrame of intakes. The normalized text is computed once as its own column
and every rule is derived from it, so the optimized plan keeps one regex pass
per row however many keywords are checked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.functions import lexicon as L
from careflow.functions.text import (
    any_contains,
    labels_present,
    normalize_main,
    parse_duration_to_hours_main,
)

ASSESSMENT_COLUMNS = [
    "language",
    "patient_age_group",
    "primary_symptom",
    "symptom_category",
    "duration_hours",
    "severity_indicators",
    "emergency_flags",
    "emergency_stop",
    "provisional_ctas_level",
    "provisional_ctas_label",
    "recommended_facility_type",
    "recommended_urgency_band",
    "queue_eligible",
    "reasoning_summary",
]


def detect_language(norm: Column) -> Column:
    """Any French marker substring -> fr; non-empty -> en; else unknown."""
    return (
        F.when(any_contains(norm, L.MAIN_FRENCH_MARKERS), F.lit("fr"))
        .when(norm != "", F.lit("en"))
        .otherwise(F.lit("unknown"))
    )


def categorize(norm: Column) -> Column:
    """First category (in fixed order) with any keyword, else general."""
    out = None
    for cat, words in L.MAIN_CATEGORIES.items():
        cond = any_contains(norm, words)
        out = F.when(cond, F.lit(cat)) if out is None else out.when(cond, F.lit(cat))
    return out.otherwise(F.lit(L.MAIN_DEFAULT_CATEGORY))


def primary_symptom(norm: Column) -> Column:
    """First 80 characters of normalized text; '' -> unknown."""
    return F.when(norm == "", F.lit("unknown")).otherwise(F.substring(norm, 1, L.MAIN_PRIMARY_MAX_CHARS))


def severity_indicators(norm: Column) -> Column:
    """Matched severity terms plus 'pain' for pain/douleur; sorted, unique."""
    terms = {t: [t] for t in L.MAIN_SEVERITY_TERMS}
    terms.setdefault("pain", [])
    terms["pain"] = terms["pain"] + L.MAIN_PAIN_WORDS
    return labels_present(norm, terms)


def red_flags(norm: Column) -> Column:
    """Labels of red-flag groups with any keyword; sorted."""
    return labels_present(norm, L.MAIN_RED_FLAG_GROUPS)


def conservative_ctas(norm: Column, flags: Column, severity: Column, age: Column, category: Column) -> Column:
    """Flags -> 1 or 2; severe markers 3; young with fever/rash 3; category map; else 4/5."""
    has_l1 = F.arrays_overlap(flags, F.array(*[F.lit(x) for x in L.MAIN_LEVEL1_FLAGS]))
    has_sev = F.arrays_overlap(severity, F.array(*[F.lit(x) for x in L.MAIN_LEVEL3_SEVERITY]))
    young = age.isin(*L.MAIN_YOUNG_AGE_GROUPS) & any_contains(norm, L.MAIN_YOUNG_LEVEL3_WORDS)
    return (
        F.when(F.size(flags) > 0, F.when(has_l1, F.lit(1)).otherwise(F.lit(2)))
        .when(has_sev, F.lit(3))
        .when(young, F.lit(3))
        .when(category.isin(*L.MAIN_LEVEL3_CATEGORIES), F.lit(3))
        .when(category.isin(*L.MAIN_LEVEL4_CATEGORIES), F.lit(4))
        .when(norm != "", F.lit(4))
        .otherwise(F.lit(5))
    )


def ctas_label(level: Column) -> Column:
    """Level -> label, unknown level -> Non-Urgent."""
    out = None
    for lvl, label in L.CTAS_LABELS.items():
        out = F.when(level == lvl, F.lit(label)) if out is None else out.when(level == lvl, F.lit(label))
    return out.otherwise(F.lit(L.CTAS_LABELS[5]))


def facility_type_main(level: Column) -> Column:
    """<= 3 hospital, else ambulatory."""
    return F.when(level <= 3, F.lit("hospital")).when(level >= 4, F.lit("ambulatory")).otherwise(F.lit("unknown"))


def urgency_band_main(level: Column) -> Column:
    """<= 2 emergency, 3 same_day, 4-5 low_acuity."""
    return (
        F.when(level <= 2, F.lit("emergency"))
        .when(level == 3, F.lit("same_day"))
        .when(level.isin(4, 5), F.lit("low_acuity"))
        .otherwise(F.lit("unknown"))
    )


def triage_main(df: DataFrame, text_col: str = "raw_text", age_col: str | None = "age_group") -> DataFrame:
    """Append the 14 main-assessment columns (input columns are kept)."""
    age = F.coalesce(F.nullif(F.col(age_col), F.lit("")), F.lit("unknown")) if age_col else F.lit("unknown")
    out = df.withColumn("_norm", normalize_main(F.col(text_col)))
    norm = F.col("_norm")
    out = out.withColumns(
        {
            "language": detect_language(norm),
            "patient_age_group": age,
            "primary_symptom": primary_symptom(norm),
            "symptom_category": categorize(norm),
            "duration_hours": parse_duration_to_hours_main(norm),
            "severity_indicators": severity_indicators(norm),
            "emergency_flags": red_flags(norm),
        }
    )
    level = conservative_ctas(
        norm, F.col("emergency_flags"), F.col("severity_indicators"), F.col("patient_age_group"), F.col("symptom_category")
    )
    out = out.withColumn("provisional_ctas_level", level)
    lvl = F.col("provisional_ctas_level")
    stop = (F.size("emergency_flags") > 0) | (lvl <= 2)
    out = out.withColumns(
        {
            "emergency_stop": stop,
            "provisional_ctas_label": ctas_label(lvl),
            "recommended_facility_type": facility_type_main(lvl),
            "recommended_urgency_band": urgency_band_main(lvl),
            "queue_eligible": ~stop & (lvl >= 4),
            "reasoning_summary": F.when(stop, F.lit(L.MAIN_STOP_SUMMARY)).otherwise(
                F.format_string(L.MAIN_LEVEL_SUMMARY.replace("{level}", "%d"), lvl)
            ),
        }
    )
    return out.drop("_norm")
