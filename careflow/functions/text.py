"""Scalar text, number, time and geo functions as Spark Column expressions.

Every function maps Column(s) to a Column built only from JVM-side built-in
functions, so it stays inside whole-stage codegen. Matching is by substring
(not by word) everywhere, like the rules being reproduced.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from careflow.functions import lexicon as L

# Java regex classes. ASCII whitespace is spelled out so that every engine
# (Java, RE2, Python) agrees on it.
WS = r"[ \t\n\x0B\f\r]"
NON_ALNUM = r"[^a-z0-9]+"
NUMBER = r"(-?\d+(?:\.\d+)?)"
HH_MM = r"^\s*(\d{1,2}):(\d{2})\s*$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: The characters that stand for several, as one literal of the SQL language (a call for each entry takes a second).
_SEVERAL = "map(" + ", ".join("'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'" for pair in L.FOLD_SEVERAL.items() for x in pair) + ")"


def _folded(c: Column, more: dict[str, str], rest) -> Column:
    """Lower-case ASCII parts: characters that stand for one ASCII character in one translate pass, which leaves most
    texts ASCII alone; what is left of the others goes through ``rest`` (told by their length in bytes)."""
    one = L.FOLD | more
    t = F.translate(c, "".join(one), "".join(one.values()))
    return F.lower(F.when(F.length(t) == F.octet_length(t), t).otherwise(rest(t)))


def _expanded(c: Column) -> Column:
    """Characters that stand for several ones, replaced one by one in texts that hold any."""
    several = F.expr(_SEVERAL)
    return F.when(
        F.translate(c, "".join(L.FOLD_SEVERAL), "") != c,  # one lookup a letter; a regular expression's class of this size is searched one by one
        F.array_join(F.transform(F.regexp_extract_all(c, F.lit("(?s)(.)"), 1), lambda ch: F.coalesce(F.try_element_at(several, ch), ch)), ""),
    ).otherwise(c)


def normalize_main(c) -> Column:
    """H1: transliterate, lower, runs of non [a-z0-9] -> one space, trim; NULL -> ''."""
    single = {a: b for a, b in L.TRANSLIT_EXTRA if len(b) == 1}
    upper = {a.upper(): b for a, b in single.items()}

    def rest(t: Column) -> Column:
        t = F.lower(_expanded(F.regexp_replace(t, L.MARKS, "")))
        for src, dst in L.TRANSLIT_EXTRA:
            if len(dst) > 1:  # one-to-two letters: a replace pass each
                t = F.replace(t, F.lit(src), F.lit(dst))
        return t

    return F.trim(F.regexp_replace(_folded(F.coalesce(_col(c), F.lit("")), single | upper, rest), NON_ALNUM, " "))


def normalize_scored(c) -> Column:
    """H2: NFKD fold, drop other non-ASCII, lower, [^a-z0-9\\s] -> space, collapse."""
    s = _folded(F.coalesce(_col(c), F.lit("")), {}, lambda t: F.regexp_replace(_expanded(t), r"[^\x00-\x7F]", ""))
    # with only ASCII left, "each non-alnum -> space, then collapse whitespace
    # runs" is the same as "each run of non-alnum -> one space": one pass
    return F.trim(F.regexp_replace(s, NON_ALNUM, " "))


def normalize_identifier(c) -> Column:
    """H3: H1 with '_' between tokens."""
    return F.regexp_replace(normalize_main(c), " ", "_")


def literal_normalize_main(value: str) -> str:
    """Plan-time twin of H1 for literal phrases (ASCII-only inputs)."""
    return re.sub(r"[^a-z0-9]+", " ", value.lower()).strip()


def literal_normalize_scored(value: str) -> str:
    """Plan-time twin of H2 for literal phrases (ASCII-only inputs)."""
    s = re.sub(r"[^a-z0-9\s]", " ", value.lower())
    return re.sub(r"\s+", " ", s).strip()


def _first_number(c) -> Column:
    return F.nullif(F.regexp_extract(F.replace(_col(c), F.lit(","), F.lit(".")), NUMBER, 1), F.lit(""))


def parse_metric_int(c) -> Column:
    """H4: ',' -> '.', first signed decimal number, truncated to int; none -> NULL."""
    return _first_number(c).try_cast("double").try_cast("int")


def parse_metric_pct(c) -> Column:
    """H5: H4 as double ("87.5 %" -> 87.0)."""
    return parse_metric_int(c).cast("double")


def parse_duration_to_minutes(c) -> Column:
    """H6: whole string h?h:mm -> minutes, else H4."""
    c = _col(c)
    hh = F.regexp_extract(c, HH_MM, 1).try_cast("int")
    mm = F.regexp_extract(c, HH_MM, 2).try_cast("int")
    return F.when(c.rlike(HH_MM), hh * 60 + mm).otherwise(parse_metric_int(c))


def parse_duration_to_hours_main(norm: Column) -> Column:
    """H7 over H1-normalized text: unit substrings in fixed order, first number anywhere."""
    num = F.nullif(F.regexp_extract(norm, r"(\d+)", 1), F.lit("")).try_cast("double")
    out = None
    for words, mult in L.MAIN_DURATION_UNITS:
        cond = _any_contains(norm, words)
        val = F.round(num / 60.0, 2) if mult is None else F.round(num * mult, 2)
        out = F.when(cond, val) if out is None else out.when(cond, val)
    return F.when(num.isNull(), F.lit(0.0)).otherwise(out.otherwise(F.lit(0.0)))


def parse_duration_hours_scored(norm: Column, explicit: Column | None = None) -> Column:
    """H8 over H2-normalized text: explicit value (floored at 0) first, then regexes, then phrases."""
    out = None
    for pattern, mult in L.SCORED_DURATION_PATTERNS:
        num = F.nullif(F.regexp_extract(norm, pattern, 1), F.lit("")).try_cast("int")
        cond = num.isNotNull()
        out = F.when(cond, num * mult) if out is None else out.when(cond, num * mult)
    for words, hours in L.SCORED_DURATION_PHRASES:
        out = out.when(_any_contains(norm, words), F.lit(hours))
    parsed = out.otherwise(F.lit(0))
    if explicit is None:
        return parsed
    return F.when(explicit.isNotNull(), F.greatest(F.lit(0), explicit.cast("int"))).otherwise(parsed)


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """H9: great-circle distance (atan2 form), R = 6371, rounded to 2; any NULL -> NULL."""
    lat1, lon1, lat2, lon2 = (_col(x).cast("double") for x in (lat1, lon1, lat2, lon2))
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    dphi, dlmb = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(phi1) * F.cos(phi2) * F.pow(F.sin(dlmb / 2), 2)
    return F.round(F.lit(L.EARTH_RADIUS_KM) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a)), 2)


def compact_text(c) -> Column:
    """Collapse whitespace runs, trim; empty -> NULL."""
    return F.nullif(F.trim(F.regexp_replace(_col(c), r"\s+", " ")), F.lit(""))


def make_id(prefix: str, *key_cols) -> Column:
    """Deterministic id: prefix + '_' + 16 hex chars of sha2 over the key columns."""
    key = F.concat_ws("\u0001", *[_col(k).cast("string") for k in key_cols])
    return F.concat(F.lit(prefix + "_"), F.substring(F.sha2(key, 256), 1, 16))


def _any_contains(norm: Column, words) -> Column:
    cond = None
    for w in words:
        term = norm.contains(w)
        cond = term if cond is None else (cond | term)
    return cond if cond is not None else F.lit(False)


any_contains = _any_contains


def labels_present(norm: Column, label_terms: dict[str, list[str]]) -> Column:
    """Sorted array of labels whose any term occurs in norm (sorted by construction)."""
    items = [F.when(_any_contains(norm, label_terms[label]), F.lit(label)) for label in sorted(label_terms)]
    return F.array_compact(F.array(*items)) if items else F.array().cast("array<string>")


def count_present(norm: Column, words) -> Column:
    """Number of words that occur in norm."""
    total = F.lit(0)
    for w in words:
        total = total + norm.contains(w).cast("int")
    return total
