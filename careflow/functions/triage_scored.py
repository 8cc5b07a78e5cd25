"""Scored triage: flags, CTAS level, risk score and band, queue policy.

``triage_scored(df, text_col, age_col, duration_col)`` appends the 16
decision columns. All rules are column expressions over one normalized-text
column; there is no Python in the row path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careflow.functions import lexicon as L
from careflow.functions.text import (
    any_contains,
    count_present,
    labels_present,
    literal_normalize_scored,
    normalize_scored,
    parse_duration_hours_scored,
)
from careflow.functions.triage_main import ctas_label

DECISION_COLUMNS = list(L.EXPECTED_KEYS)


def _lits(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def detect_language(norm: Column) -> Column:
    """Count hint substrings per language; fr only when strictly more.

    One comparison of (count, rank, language), so that every hint is looked for once; no hint at all beats counts of 0."""
    counted = [(count_present(norm, L.SCORED_LANGUAGE_HINTS_FR), 0, "fr"), (count_present(norm, L.SCORED_LANGUAGE_HINTS_EN), 1, "en"), (F.lit(0), 2, "unknown")]
    return F.greatest(*(F.struct(n.alias("n"), F.lit(o).alias("o"), F.lit(c).alias("c")) for n, o, c in counted))["c"]


def coerce_age_group(age: Column) -> Column:
    """Alias lookup on the normalized age text; missing -> unknown."""
    pairs = []
    for k, v in L.SCORED_AGE_GROUP_ALIASES.items():
        pairs += [F.lit(k), F.lit(v)]
    aliases = F.create_map(*pairs)
    looked = F.try_element_at(aliases, normalize_scored(age))
    return F.when(F.coalesce(age, F.lit("")) == "", F.lit("unknown")).otherwise(F.coalesce(looked, F.lit("unknown")))


def severity_indicators(norm: Column) -> Column:
    """Severity labels with any phrase present; sorted."""
    return labels_present(norm, {k: [literal_normalize_scored(p) for p in v] for k, v in L.SCORED_SEVERITY_PATTERNS.items()})


def symptom_category(norm: Column) -> Column:
    """Category with most keyword hits; earlier category wins ties; none -> other.

    The default is a category of 0 hits that wins ties, so that the best is asked for one field alone: with two, every
    keyword was looked for twice."""
    cats = list(L.SCORED_CATEGORY_KEYWORDS)
    counted = [(count_present(norm, L.SCORED_CATEGORY_KEYWORDS[c]), -i, c) for i, c in enumerate(cats)] + [(F.lit(0), 1, L.SCORED_DEFAULT_CATEGORY)]
    return F.greatest(*(F.struct(n.alias("n"), F.lit(o).alias("o"), F.lit(c).alias("c")) for n, o, c in counted))["c"]


def primary_symptom(norm: Column) -> Column:
    """First listed phrase contained (original spelling), else first 4 tokens, else fixed text."""
    out = None
    for phrase in L.SCORED_PRIMARY_SYMPTOM_PATTERNS:
        cond = norm.contains(literal_normalize_scored(phrase))
        out = F.when(cond, F.lit(phrase)) if out is None else out.when(cond, F.lit(phrase))
    tokens = F.array_join(F.slice(F.split(norm, " "), 1, L.SCORED_PRIMARY_TOKENS), " ")
    return out.when(norm == "", F.lit(L.SCORED_PRIMARY_FALLBACK)).otherwise(tokens)


def emergency_flags(norm: Column, age: Column) -> Column:
    """Flag labels with any phrase, plus the infant rule; sorted, unique."""
    groups = {k: [literal_normalize_scored(p) for p in v] for k, v in L.SCORED_EMERGENCY_FLAGS.items()}
    items = []
    for label in sorted(groups):
        cond = any_contains(norm, groups[label])
        if label == L.SCORED_INFANT_FLAG:
            cond = cond | ((age == "infant") & any_contains(norm, L.SCORED_INFANT_FLAG_WORDS))
        items.append(F.when(cond, F.lit(label)))
    return F.array_compact(F.array(*items))


def red_flag_component(norm: Column, flags: Column) -> Column:
    """>= 2 flags 100; 1 flag 50; serious marker 50; mild marker 15; else 0."""
    n = F.size(flags)
    return (
        F.when(n >= 2, F.lit(100))
        .when(n >= 1, F.lit(50))
        .when(any_contains(norm, L.SCORED_SERIOUS_MARKERS), F.lit(50))
        .when(any_contains(norm, L.SCORED_MILD_MARKERS), F.lit(15))
        .otherwise(F.lit(0))
    )


def is_resuscitation(flags: Column) -> Column:
    """H22."""
    return F.arrays_overlap(flags, _lits(L.SCORED_RESUSCITATION_FLAGS))


def is_emergent(flags: Column) -> Column:
    """H22."""
    return F.arrays_overlap(flags, _lits(L.SCORED_EMERGENT_FLAGS))


def provisional_ctas(category: Column, age: Column, flags: Column, severity: Column, duration: Column) -> Column:
    """Resuscitation 1; emergent 2; then the level-3/4/5 rules in order."""
    has = lambda label: F.array_contains(severity, label)
    return (
        F.when(is_resuscitation(flags), F.lit(1))
        .when(is_emergent(flags), F.lit(2))
        .when((age == "infant") & category.isin(*L.SCORED_INFANT_LEVEL3_CATEGORIES), F.lit(3))
        .when(category.isin(*L.SCORED_HOSPITAL_CATEGORIES), F.lit(3))
        .when(has("severe pain") | has("impaired function"), F.lit(3))
        .when(has("worsening") & (duration >= 24), F.lit(3))
        .when(
            category.isin(*L.SCORED_LOW_CATEGORIES),
            F.when(has("moderate pain") | (duration >= 24), F.lit(4)).otherwise(F.lit(5)),
        )
        .otherwise(F.lit(4))
    )


def severity_component(severity: Column) -> Column:
    """30 / 20 / 10 / 0."""
    has = lambda label: F.array_contains(severity, label)
    return (
        F.when(has("severe pain") | has("impaired function"), F.lit(30))
        .when(has("worsening"), F.lit(20))
        .when(has("moderate pain"), F.lit(10))
        .otherwise(F.lit(0))
    )


def duration_component(duration: Column, severity: Column) -> Column:
    """< 12 -> 0; < 24 -> 5; > 24 and worsening -> 10; >= 72 -> 15; else 5."""
    return (
        F.when(duration < 12, F.lit(0))
        .when(duration < 24, F.lit(5))
        .when((duration > 24) & F.array_contains(severity, "worsening"), F.lit(10))
        .when(duration >= 72, F.lit(15))
        .otherwise(F.lit(5))
    )


def _lookup(mapping: dict, key: Column, default=None) -> Column:
    out = None
    for k, v in mapping.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out.otherwise(F.lit(default))


def risk_score(level: Column, rfc: Column, age: Column, severity: Column, duration: Column, stop: Column) -> Column:
    """Stop or level 1 -> 100; weighted sum rounded half-even; level 2 floor 85; clamp 0-100."""
    w = L.RISK_WEIGHTS
    raw = (
        F.lit(w[0]) * _lookup(L.CTAS_COMPONENT, level)
        + F.lit(w[1]) * rfc
        + F.lit(w[2]) * _lookup(L.VULNERABILITY_COMPONENT, age, L.VULNERABILITY_DEFAULT)
        + F.lit(w[3]) * severity_component(severity)
        + F.lit(w[4]) * duration_component(duration, severity)
    )
    computed = F.bround(raw, 0).cast("int")
    computed = F.when(level == 2, F.greatest(computed, F.lit(L.LEVEL2_RISK_FLOOR))).otherwise(computed)
    computed = F.greatest(F.lit(0), F.least(F.lit(100), computed))
    return F.when(stop | (level == 1), F.lit(100)).otherwise(computed)


def risk_band(score: Column) -> Column:
    """>= 75 critical, >= 50 high, >= 25 moderate, else low."""
    out = None
    for threshold, band in L.RISK_BANDS:
        out = F.when(score >= threshold, F.lit(band)) if out is None else out.when(score >= threshold, F.lit(band))
    return out.otherwise(F.lit(L.RISK_BAND_DEFAULT))


def default_facility_type(level: Column, category: Column) -> Column:
    """<= 3 hospital; cardiac/neurological/respiratory hospital; else ambulatory."""
    return (
        F.when(level <= 3, F.lit("hospital"))
        .when(category.isin(*L.SCORED_HOSPITAL_CATEGORIES), F.lit("hospital"))
        .otherwise(F.lit("ambulatory"))
    )


def default_urgency_band(level: Column) -> Column:
    """<= 2 emergency; 3 and 4 same_day; 5 low_acuity."""
    return (
        F.when(level <= 2, F.lit("emergency"))
        .when(level == 3, F.lit("same_day"))
        .when(level == 4, F.lit("same_day"))
        .when(level == 5, F.lit("low_acuity"))
        .otherwise(F.lit("unknown"))
    )


def queue_policy(level: Column, band: Column, stop: Column, category: Column) -> Column:
    """struct(queue_eligible, facility_type, urgency_band)."""

    def s(elig, ftype, urg):
        return F.struct(
            (elig if isinstance(elig, Column) else F.lit(elig)).alias("queue_eligible"),
            (ftype if isinstance(ftype, Column) else F.lit(ftype)).alias("facility_type"),
            (urg if isinstance(urg, Column) else F.lit(urg)).alias("urgency_band"),
        )

    amb = (level == 5) & ~category.isin(*L.SCORED_HOSPITAL_CATEGORIES)
    return (
        F.when(stop, s(False, "hospital", "emergency"))
        .when(level <= 3, s(False, "hospital", default_urgency_band(level)))
        .when(band == "critical", s(False, "hospital", "emergency"))
        .when(band == "high", s(False, "hospital", "same_day"))
        .when(
            band == "moderate",
            s(amb, F.when(amb, F.lit("ambulatory")).otherwise(F.lit("hospital")),
              F.when(amb, F.lit("low_acuity")).otherwise(F.lit("same_day"))),
        )
        .otherwise(s(True, default_facility_type(level, category), default_urgency_band(level)))
    )


def reasoning_summary(primary: Column, level: Column, label: Column, flags: Column, band: Column) -> Column:
    """Four sentences joined by a space; the middle one depends on flags and band."""
    middle = (
        F.when(F.size(flags) > 0, F.format_string(L.REASON_FLAGS.replace("{flags}", "%s"), F.array_join(flags, ", ")))
        .when(band.isin("high", "moderate"), F.format_string(L.REASON_RISK.replace("{band}", "%s"), band))
        .otherwise(F.lit(L.REASON_NONE))
    )
    return F.concat_ws(
        " ",
        F.format_string(L.REASON_PRIMARY.replace("{primary}", "%s"), primary),
        F.format_string(L.REASON_LEVEL.replace("{level}", "%d").replace("{label}", "%s"), level, label),
        middle,
        F.lit(L.DISCLAIMER),
    )


def triage_scored(
    df: DataFrame,
    text_col: str = "raw_text",
    age_col: str | None = "age_group",
    duration_col: str | None = None,
) -> DataFrame:
    """Append the 16 decision columns; critical forces a stop, a stop forces hospital/emergency/100."""
    age_in = F.col(age_col) if age_col else F.lit(None).cast("string")
    explicit = F.col(duration_col) if duration_col else None
    out = df.withColumn("_norm", normalize_scored(F.col(text_col)))
    norm = F.col("_norm")
    out = out.withColumns(
        {
            "language": detect_language(norm),
            "patient_age_group": coerce_age_group(age_in),
            "duration_hours": parse_duration_hours_scored(norm, explicit),
            "primary_symptom": primary_symptom(norm),
            "symptom_category": symptom_category(norm),
            "severity_indicators": severity_indicators(norm),
        }
    )
    out = out.withColumn("emergency_flags", emergency_flags(norm, F.col("patient_age_group")))
    out = out.withColumn(
        "provisional_ctas_level",
        provisional_ctas(
            F.col("symptom_category"), F.col("patient_age_group"), F.col("emergency_flags"),
            F.col("severity_indicators"), F.col("duration_hours"),
        ),
    )
    lvl = F.col("provisional_ctas_level")
    out = out.withColumns(
        {
            "provisional_ctas_label": ctas_label(lvl),
            "_stop0": (F.size("emergency_flags") > 0) | lvl.isin(1, 2),
            "_rfc": red_flag_component(norm, F.col("emergency_flags")),
        }
    )
    out = out.withColumn(
        "_score0",
        risk_score(lvl, F.col("_rfc"), F.col("patient_age_group"), F.col("severity_indicators"),
                   F.col("duration_hours"), F.col("_stop0")),
    )
    # a critical band forces a stop; a stop forces score 100 / critical
    out = out.withColumn("emergency_stop", F.col("_stop0") | (risk_band(F.col("_score0")) == "critical"))
    stop = F.col("emergency_stop")
    out = out.withColumns(
        {
            "risk_score": F.when(stop, F.lit(100)).otherwise(F.col("_score0")),
            "risk_band": F.when(stop, F.lit("critical")).otherwise(risk_band(F.col("_score0"))),
        }
    )
    out = out.withColumn("_policy", queue_policy(lvl, F.col("risk_band"), stop, F.col("symptom_category")))
    out = out.withColumns(
        {
            "recommended_facility_type": F.col("_policy.facility_type"),
            "recommended_urgency_band": F.col("_policy.urgency_band"),
            "queue_eligible": F.col("_policy.queue_eligible"),
        }
    )
    out = out.withColumn(
        "reasoning_summary",
        reasoning_summary(F.col("primary_symptom"), lvl, F.col("provisional_ctas_label"),
                          F.col("emergency_flags"), F.col("risk_band")),
    )
    return out.drop("_norm", "_stop0", "_rfc", "_score0", "_policy")


def flags_view(df: DataFrame, text_col: str = "raw_text", age_col: str | None = "age_group") -> DataFrame:
    """H35 partial view: emergency flags only."""
    age_in = F.col(age_col) if age_col else F.lit(None).cast("string")
    norm = normalize_scored(F.col(text_col))
    return df.withColumn("emergency_flags", emergency_flags(norm, coerce_age_group(age_in)))


def validate_decisions(df: DataFrame, payload: list[str] | None = None) -> DataFrame:
    """One array of violation strings per row (empty when the payload is valid). ``payload`` names the columns
    that are the payload (by default those of the contract); others among them are extras."""
    payload = [c for c in df.columns if c in L.EXPECTED_KEYS] if payload is None else payload
    df = df.withColumns({c: F.lit(None).cast("string") for c in L.EXPECTED_KEYS if c not in df.columns})
    known = df.columns
    has = lambda key, bad, kind: F.when(bad, F.lit(f"{kind}:{key}")) if key in payload else F.lit(None).cast("string")
    checks = [has(key, ~F.coalesce(F.col(key).isin(*allowed), F.lit(False)), "enum") for key, allowed in L.OUTPUT_ENUMS.items()]
    checks.append(has("provisional_ctas_level", ~F.coalesce(F.col("provisional_ctas_level").isin(1, 2, 3, 4, 5), F.lit(False)), "enum"))
    checks.append(has("duration_hours", ~F.coalesce(F.col("duration_hours") >= 0, F.lit(False)), "range"))
    checks.append(has("risk_score", ~F.coalesce(F.col("risk_score").between(0, 100), F.lit(False)), "range"))
    shape = [f"missing:{k}" for k in L.EXPECTED_KEYS if k not in payload] + [f"extra:{k}" for k in payload if k not in L.EXPECTED_KEYS]
    fixed = _lits(shape) if shape else F.array().cast("array<string>")
    return df.withColumn("violations", F.concat(fixed, F.array_compact(F.array(*checks)))).select(*[c for c in known if c in payload or c not in L.EXPECTED_KEYS], "violations")


def level_view(df: DataFrame, text_col: str = "raw_text", age_col: str | None = "age_group", duration_col: str | None = None) -> DataFrame:
    """H35 partial view: provisional level and label."""
    return triage_scored(df, text_col, age_col, duration_col).select(*df.columns, "provisional_ctas_level", "provisional_ctas_label")


def risk_view(df: DataFrame, text_col: str = "raw_text", age_col: str | None = "age_group", duration_col: str | None = None) -> DataFrame:
    """H35 partial view: risk score and band."""
    return triage_scored(df, text_col, age_col, duration_col).select(*df.columns, "risk_score", "risk_band")


def policy_view(df: DataFrame, text_col: str = "raw_text", age_col: str | None = "age_group", duration_col: str | None = None) -> DataFrame:
    """H35 partial view: queue policy triple."""
    return triage_scored(df, text_col, age_col, duration_col).select(
        *df.columns, "queue_eligible", "recommended_facility_type", "recommended_urgency_band")
