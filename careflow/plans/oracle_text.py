"""SQL (DuckDB dialect) twins of the text functions and both triage engines.

Used only by the independent SQL oracle. Generated from the same fixed
values in ``careflow.functions.lexicon``; the logic is written out in SQL.
"""

from __future__ import annotations

from careflow.functions import lexicon as L
from careflow.functions.text import literal_normalize_scored

WS = r"[ \t\n\x0B\f\r]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_SEVERAL = "MAP {" + ", ".join(f"{q(a)}: {q(b)}" for a, b in L.FOLD_SEVERAL.items()) + "}"
_ONE, _BASE = "".join(L.FOLD), "".join(L.FOLD.values())


def _folded(x: str) -> str:
    spelled = f"array_to_string(list_transform(string_split({x}, ''), lambda c: coalesce({_SEVERAL}[c], c)), '')"
    c = f"(CASE WHEN regexp_matches({x}, {q('[' + ''.join(L.FOLD_SEVERAL) + ']')}) THEN {spelled} ELSE {x} END)"
    return f"lower(translate({c}, {q(_ONE)}, {q(_BASE)}))"


def norm_main(x: str) -> str:
    s = _folded(f"regexp_replace(coalesce({x}, ''), '{L.MARKS}', '', 'g')")
    for src, dst in L.TRANSLIT_EXTRA:
        s = f"replace({s}, {q(src)}, {q(dst)})"
    return f"trim(regexp_replace({s}, '[^a-z0-9]+', ' ', 'g'))"


def norm_scored(x: str) -> str:
    s = f"regexp_replace({_folded(f"coalesce({x}, '')")}, '[^\\x00-\\x7F]', '', 'g')"
    s = f"regexp_replace({s}, '[^a-z0-9 \\t\\n\\x0B\\f\\r]', ' ', 'g')"
    return f"trim(regexp_replace({s}, '{WS}+', ' ', 'g'))"


def any_contains(norm: str, words) -> str:
    return "(" + " OR ".join(f"contains({norm}, {q(w)})" for w in words) + ")"


def count_present(norm: str, words) -> str:
    return "(" + " + ".join(f"CAST(contains({norm}, {q(w)}) AS INTEGER)" for w in words) + ")"


def labels_present(norm: str, groups: dict) -> str:
    items = ", ".join(f"CASE WHEN {any_contains(norm, groups[k])} THEN {q(k)} END" for k in sorted(groups))
    return f"list_filter([{items}], lambda x: x IS NOT NULL)"


def lits(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def ctas_label(level: str) -> str:
    arms = " ".join(f"WHEN {level} = {k} THEN {q(v)}" for k, v in L.CTAS_LABELS.items())
    return f"(CASE {arms} ELSE {q(L.CTAS_LABELS[5])} END)"


def triage_main(src: str, id_col: str, text_col: str, age_col: str) -> str:
    """SELECT id + 14 assessment columns from ``src`` (a subquery or table)."""
    n = "norm"
    sev_groups = {t: [t] for t in L.MAIN_SEVERITY_TERMS}
    sev_groups["pain"] = sev_groups.get("pain", []) + L.MAIN_PAIN_WORDS
    cat = "CASE " + " ".join(
        f"WHEN {any_contains(n, words)} THEN {q(c)}" for c, words in L.MAIN_CATEGORIES.items()
    ) + f" ELSE {q(L.MAIN_DEFAULT_CATEGORY)} END"
    num = f"TRY_CAST(nullif(regexp_extract({n}, '(\\d+)', 1), '') AS DOUBLE)"
    dur_arms = []
    for words, mult in L.MAIN_DURATION_UNITS:
        val = f"round({num} / 60.0, 2)" if mult is None else f"round({num} * {mult}, 2)"
        dur_arms.append(f"WHEN {any_contains(n, words)} THEN {val}")
    dur = f"CASE WHEN {num} IS NULL THEN 0.0 " + " ".join(dur_arms) + " ELSE 0.0 END"
    s1 = f"""
      SELECT {id_col} AS _id, {n},
        coalesce(nullif({age_col}, ''), 'unknown') AS patient_age_group
      FROM (SELECT *, {norm_main(text_col)} AS {n} FROM {src}) _t0"""
    s2 = f"""
      SELECT *,
        CASE WHEN {any_contains(n, L.MAIN_FRENCH_MARKERS)} THEN 'fr' WHEN {n} <> '' THEN 'en' ELSE 'unknown' END AS language,
        CASE WHEN {n} = '' THEN 'unknown' ELSE substring({n}, 1, {L.MAIN_PRIMARY_MAX_CHARS}) END AS primary_symptom,
        {cat} AS symptom_category,
        CAST({dur} AS DOUBLE) AS duration_hours,
        {labels_present(n, sev_groups)} AS severity_indicators,
        {labels_present(n, L.MAIN_RED_FLAG_GROUPS)} AS emergency_flags
      FROM ({s1}) _t1"""
    level = f"""CASE
        WHEN len(emergency_flags) > 0 THEN CASE WHEN list_has_any(emergency_flags, {lits(L.MAIN_LEVEL1_FLAGS)}) THEN 1 ELSE 2 END
        WHEN list_has_any(severity_indicators, {lits(L.MAIN_LEVEL3_SEVERITY)}) THEN 3
        WHEN patient_age_group IN ({", ".join(q(a) for a in L.MAIN_YOUNG_AGE_GROUPS)}) AND {any_contains(n, L.MAIN_YOUNG_LEVEL3_WORDS)} THEN 3
        WHEN symptom_category IN ({", ".join(q(c) for c in L.MAIN_LEVEL3_CATEGORIES)}) THEN 3
        WHEN symptom_category IN ({", ".join(q(c) for c in L.MAIN_LEVEL4_CATEGORIES)}) THEN 4
        WHEN {n} <> '' THEN 4 ELSE 5 END"""
    s3 = f"SELECT *, CAST({level} AS INTEGER) AS provisional_ctas_level FROM ({s2}) _t2"
    lv = "provisional_ctas_level"
    stop = f"(len(emergency_flags) > 0 OR {lv} <= 2)"
    return f"""
      SELECT _id AS {id_col}, language, patient_age_group, primary_symptom, symptom_category, duration_hours,
        severity_indicators, emergency_flags, {stop} AS emergency_stop, {lv},
        {ctas_label(lv)} AS provisional_ctas_label,
        CASE WHEN {lv} <= 3 THEN 'hospital' WHEN {lv} >= 4 THEN 'ambulatory' ELSE 'unknown' END AS recommended_facility_type,
        CASE WHEN {lv} <= 2 THEN 'emergency' WHEN {lv} = 3 THEN 'same_day' WHEN {lv} IN (4, 5) THEN 'low_acuity' ELSE 'unknown' END AS recommended_urgency_band,
        (NOT {stop} AND {lv} >= 4) AS queue_eligible,
        CASE WHEN {stop} THEN {q(L.MAIN_STOP_SUMMARY)}
             ELSE printf({q(L.MAIN_LEVEL_SUMMARY.replace("{level}", "%d"))}, {lv}) END AS reasoning_summary
      FROM ({s3}) _t3"""


def _lookup(mapping: dict, key: str, default) -> str:
    arms = " ".join(f"WHEN {key} = {q(k) if isinstance(k, str) else k} THEN {v}" for k, v in mapping.items())
    return f"(CASE {arms} ELSE {default} END)"


def triage_scored(src: str, id_col: str, text_col: str, age_col: str | None, dur_col: str | None) -> str:
    """SELECT id + 16 decision columns from ``src``."""
    n = "norm"
    age_in = age_col or "CAST(NULL AS VARCHAR)"
    alias_arms = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in L.SCORED_AGE_GROUP_ALIASES.items())
    age = (
        f"CASE WHEN coalesce({age_in}, '') = '' THEN 'unknown' "
        f"ELSE coalesce(CASE {norm_scored(age_in)} {alias_arms} END, 'unknown') END"
    )
    fr = count_present(n, L.SCORED_LANGUAGE_HINTS_FR)
    en = count_present(n, L.SCORED_LANGUAGE_HINTS_EN)
    lang = f"CASE WHEN {n} = '' THEN 'unknown' WHEN {fr} = 0 AND {en} = 0 THEN 'unknown' WHEN {fr} > {en} THEN 'fr' ELSE 'en' END"
    dur_arms = []
    for pattern, mult in L.SCORED_DURATION_PATTERNS:
        num = f"TRY_CAST(nullif(regexp_extract({n}, {q(pattern)}, 1), '') AS INTEGER)"
        dur_arms.append(f"WHEN {num} IS NOT NULL THEN {num} * {mult}")
    for words, hours in L.SCORED_DURATION_PHRASES:
        dur_arms.append(f"WHEN {any_contains(n, words)} THEN {hours}")
    parsed = "CASE " + " ".join(dur_arms) + " ELSE 0 END"
    dur = parsed if dur_col is None else f"CASE WHEN {dur_col} IS NOT NULL THEN greatest(0, CAST({dur_col} AS INTEGER)) ELSE {parsed} END"
    prim_arms = " ".join(
        f"WHEN contains({n}, {q(literal_normalize_scored(p))}) THEN {q(p)}" for p in L.SCORED_PRIMARY_SYMPTOM_PATTERNS
    )
    prim = (
        f"CASE {prim_arms} WHEN {n} = '' THEN {q(L.SCORED_PRIMARY_FALLBACK)} "
        f"ELSE array_to_string(list_slice(string_split({n}, ' '), 1, {L.SCORED_PRIMARY_TOKENS}), ' ') END"
    )
    cats = list(L.SCORED_CATEGORY_KEYWORDS)
    cat_counts = ", ".join(f"{count_present(n, L.SCORED_CATEGORY_KEYWORDS[c])} AS _c{i}" for i, c in enumerate(cats))
    cat_arms = []
    for i, c in enumerate(cats):
        conds = [f"_c{i} > 0"] + [f"_c{i} > _c{j}" for j in range(i)] + [f"_c{i} >= _c{k}" for k in range(i + 1, len(cats))]
        cat_arms.append(f"WHEN {' AND '.join(conds)} THEN {q(c)}")
    cat = "CASE " + " ".join(cat_arms) + f" ELSE {q(L.SCORED_DEFAULT_CATEGORY)} END"
    sev_groups = {k: [literal_normalize_scored(p) for p in v] for k, v in L.SCORED_SEVERITY_PATTERNS.items()}
    flag_groups = {k: [literal_normalize_scored(p) for p in v] for k, v in L.SCORED_EMERGENCY_FLAGS.items()}
    flag_items = []
    for label in sorted(flag_groups):
        cond = any_contains(n, flag_groups[label])
        if label == L.SCORED_INFANT_FLAG:
            cond = f"({cond} OR (patient_age_group = 'infant' AND {any_contains(n, L.SCORED_INFANT_FLAG_WORDS)}))"
        flag_items.append(f"CASE WHEN {cond} THEN {q(label)} END")
    flags = f"list_filter([{', '.join(flag_items)}], lambda x: x IS NOT NULL)"

    s1 = f"""
      SELECT {id_col} AS _id, {n}, {age} AS patient_age_group, {lang} AS language, CAST({dur} AS INTEGER) AS duration_hours,
        {prim} AS primary_symptom, {labels_present(n, sev_groups)} AS severity_indicators, {cat_counts}
      FROM (SELECT *, {norm_scored(text_col)} AS {n} FROM {src}) _s0"""
    s2 = f"SELECT *, {cat} AS symptom_category, {flags} AS emergency_flags FROM ({s1}) _s1"
    has = lambda label: f"list_contains(severity_indicators, {q(label)})"
    level = f"""CASE
        WHEN list_has_any(emergency_flags, {lits(L.SCORED_RESUSCITATION_FLAGS)}) THEN 1
        WHEN list_has_any(emergency_flags, {lits(L.SCORED_EMERGENT_FLAGS)}) THEN 2
        WHEN patient_age_group = 'infant' AND symptom_category IN ({", ".join(q(c) for c in L.SCORED_INFANT_LEVEL3_CATEGORIES)}) THEN 3
        WHEN symptom_category IN ({", ".join(q(c) for c in L.SCORED_HOSPITAL_CATEGORIES)}) THEN 3
        WHEN {has("severe pain")} OR {has("impaired function")} THEN 3
        WHEN {has("worsening")} AND duration_hours >= 24 THEN 3
        WHEN symptom_category IN ({", ".join(q(c) for c in L.SCORED_LOW_CATEGORIES)})
          THEN CASE WHEN {has("moderate pain")} OR duration_hours >= 24 THEN 4 ELSE 5 END
        ELSE 4 END"""
    rfc = f"""CASE WHEN len(emergency_flags) >= 2 THEN 100 WHEN len(emergency_flags) >= 1 THEN 50
        WHEN {any_contains(n, L.SCORED_SERIOUS_MARKERS)} THEN 50 WHEN {any_contains(n, L.SCORED_MILD_MARKERS)} THEN 15 ELSE 0 END"""
    s3 = f"SELECT *, CAST({level} AS INTEGER) AS provisional_ctas_level, {rfc} AS _rfc FROM ({s2}) _s2"
    lv = "provisional_ctas_level"
    sevc = f"""(CASE WHEN {has("severe pain")} OR {has("impaired function")} THEN 30 WHEN {has("worsening")} THEN 20
        WHEN {has("moderate pain")} THEN 10 ELSE 0 END)"""
    durc = f"""(CASE WHEN duration_hours < 12 THEN 0 WHEN duration_hours < 24 THEN 5
        WHEN duration_hours > 24 AND {has("worsening")} THEN 10 WHEN duration_hours >= 72 THEN 15 ELSE 5 END)"""
    w = L.RISK_WEIGHTS
    raw = (
        f"CAST({w[0]} AS DOUBLE) * {_lookup(L.CTAS_COMPONENT, lv, 'NULL')} + CAST({w[1]} AS DOUBLE) * _rfc"
        f" + CAST({w[2]} AS DOUBLE) * {_lookup(L.VULNERABILITY_COMPONENT, 'patient_age_group', L.VULNERABILITY_DEFAULT)}"
        f" + CAST({w[3]} AS DOUBLE) * {sevc} + CAST({w[4]} AS DOUBLE) * {durc}"
    )
    computed = f"CAST(round_even(CAST({raw} AS DOUBLE), 0) AS INTEGER)"
    computed = f"(CASE WHEN {lv} = 2 THEN greatest({computed}, {L.LEVEL2_RISK_FLOOR}) ELSE {computed} END)"
    computed = f"greatest(0, least(100, {computed}))"
    stop0 = f"(len(emergency_flags) > 0 OR {lv} IN (1, 2))"
    s4 = f"SELECT *, {stop0} AS _stop0, CASE WHEN {stop0} OR {lv} = 1 THEN 100 ELSE {computed} END AS _score0 FROM ({s3}) _s3"
    band = lambda x: "CASE " + " ".join(f"WHEN {x} >= {t} THEN {q(b)}" for t, b in L.RISK_BANDS) + f" ELSE {q(L.RISK_BAND_DEFAULT)} END"
    s5 = f"SELECT *, (_stop0 OR {band('_score0')} = 'critical') AS emergency_stop FROM ({s4}) _s4"
    s6 = f"""SELECT *, CASE WHEN emergency_stop THEN 100 ELSE _score0 END AS risk_score,
        CASE WHEN emergency_stop THEN 'critical' ELSE {band('_score0')} END AS risk_band FROM ({s5}) _s5"""
    hosp = ", ".join(q(c) for c in L.SCORED_HOSPITAL_CATEGORIES)
    dub = f"(CASE WHEN {lv} <= 2 THEN 'emergency' WHEN {lv} = 3 THEN 'same_day' WHEN {lv} = 4 THEN 'same_day' WHEN {lv} = 5 THEN 'low_acuity' ELSE 'unknown' END)"
    dft = f"(CASE WHEN {lv} <= 3 THEN 'hospital' WHEN symptom_category IN ({hosp}) THEN 'hospital' ELSE 'ambulatory' END)"
    amb = f"({lv} = 5 AND symptom_category NOT IN ({hosp}))"
    elig = f"""CASE WHEN emergency_stop THEN false WHEN {lv} <= 3 THEN false WHEN risk_band IN ('critical', 'high') THEN false
        WHEN risk_band = 'moderate' THEN {amb} ELSE true END"""
    ftype = f"""CASE WHEN emergency_stop OR {lv} <= 3 OR risk_band IN ('critical', 'high') THEN 'hospital'
        WHEN risk_band = 'moderate' THEN CASE WHEN {amb} THEN 'ambulatory' ELSE 'hospital' END ELSE {dft} END"""
    urg = f"""CASE WHEN emergency_stop THEN 'emergency' WHEN {lv} <= 3 THEN {dub} WHEN risk_band = 'critical' THEN 'emergency'
        WHEN risk_band = 'high' THEN 'same_day' WHEN risk_band = 'moderate' THEN CASE WHEN {amb} THEN 'low_acuity' ELSE 'same_day' END
        ELSE {dub} END"""
    label = ctas_label(lv)
    middle = f"""CASE WHEN len(emergency_flags) > 0 THEN printf({q(L.REASON_FLAGS.replace("{flags}", "%s"))}, array_to_string(emergency_flags, ', '))
        WHEN risk_band IN ('high', 'moderate') THEN printf({q(L.REASON_RISK.replace("{band}", "%s"))}, risk_band)
        ELSE {q(L.REASON_NONE)} END"""
    reason = (
        f"concat_ws(' ', printf({q(L.REASON_PRIMARY.replace('{primary}', '%s'))}, primary_symptom), "
        f"printf({q(L.REASON_LEVEL.replace('{level}', '%d').replace('{label}', '%s'))}, {lv}, {label}), "
        f"{middle}, {q(L.DISCLAIMER)})"
    )
    return f"""
      SELECT _id AS {id_col}, language, patient_age_group, primary_symptom, symptom_category, duration_hours,
        severity_indicators, emergency_flags, emergency_stop, {lv}, {label} AS provisional_ctas_label,
        {ftype} AS recommended_facility_type, {urg} AS recommended_urgency_band, {elig} AS queue_eligible,
        risk_score, risk_band, {reason} AS reasoning_summary
      FROM ({s6}) _s6"""
