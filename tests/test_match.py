"""C5 fuzzy matching against a brute-force scorer, C6 overrides and A15 upsert semantics."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from careflow.operators import match as MT
from careflow.plans import domain as D
from conftest import SF_SMALL


def _norm(s):
    return re.sub(r"[^a-z0-9]+", " ", (s or "").lower()).strip()


def _lcs_dp(a, b):
    prev = [0] * (len(b) + 1)
    for ca in a:
        cur = [0]
        for j, cb in enumerate(b):
            cur.append(prev[j] + 1 if ca == cb else max(prev[j + 1], cur[j]))
        prev = cur
    return prev[-1]


def _tsr(s1, s2):
    a, b = set(s1.split()), set(s2.split())
    if not a or not b:
        return 0.0
    inter = a & b
    dab, dba = a - b, b - a
    if inter and (not dab or not dba):
        return 100.0
    ja, jb = " ".join(sorted(dab)), " ".join(sorted(dba))
    s = len(" ".join(sorted(inter)))
    sa, sb = s + (s != 0) + len(ja), s + (s != 0) + len(jb)
    dist = len(ja) + len(jb) - 2 * _lcs_dp(ja, jb)
    lensum = sa + sb
    res = 100 - 100 * dist / lensum if lensum else 100.0
    if s == 0:
        return res
    r_a = 100 - 100 * ((s != 0) + len(ja)) / (s + sa)
    r_b = 100 - 100 * ((s != 0) + len(jb)) / (s + sb)
    return max(res, r_a, r_b)


def _brute(live_keys, register):
    out = {}
    for name, addr in live_keys:
        best, best_row = -1.0, None
        for r in register:
            score = 0.55 * _tsr(_norm(name), _norm(r["facility_name"])) + 0.30 * _tsr(_norm(addr), _norm(r["full_address"]))
            score += 0.15 * (100 if r["city"] and _norm(r["city"]) in _norm(addr) else 0)
            if score > best:
                best, best_row = score, r
        out[(name, addr)] = (best_row["facility_id_normalized"], round(best / 100.0, 4), "exactish" if best >= 95 else "fuzzy")
    return out


def test_lcs_bit_parallel_matches_dp():
    words = ["", "a", "abc", "acb", "hopital st luc", "saint luc hospital", "000000123", "000000456", "kenya h3x rue"]
    for x in words:
        for y in words:
            assert MT._lcs_one(x, y) == _lcs_dp(x, y), (x, y)


def test_fuzzy_match_equals_brute_force(spark):
    live = D.live_status(spark, SF_SMALL)
    reg = D.facility_master(spark, SF_SMALL).withColumn("register_order", F.col("index").cast("long"))
    got = {(r["facility_name_raw"], r["address_raw"]): (r["matched_facility_id"], r["match_confidence"], r["match_method"])
           for r in MT.fuzzy_match(live, reg).collect()}
    keys = [(r[0], r[1]) for r in live.select("facility_name_raw", "address_raw").distinct().collect()]
    register = sorted((r.asDict() for r in reg.collect()), key=lambda r: r["register_order"])
    assert got == _brute(keys, register)


def test_reference_matching_case(spark):
    live = spark.createDataFrame(
        [("Centre hospitalier de l'Université de Montréal", "1000 rue Saint-Denis, Montréal, H2X 0A9", dt.datetime(2024, 1, 1))],
        "facility_name_raw string, address_raw string, scraped_at timestamp_ntz")
    reg = spark.createDataFrame(
        [("chum", "Centre hospitalier de l'Université de Montréal", "1000 rue Saint-Denis, Montréal, H2X 0A9", "Montréal", 0),
         ("stmary", "Centre hospitalier de St.Mary", "3830 avenue Lacombe, Montréal, H3T 1M5", "Montréal", 1)],
        "facility_id_normalized string, facility_name string, full_address string, city string, register_order int")
    r = MT.fuzzy_match(live, reg).collect()[0]
    assert r["matched_facility_id"] == "chum" and r["match_confidence"] > 0.9 and r["match_method"] == "exactish"


def test_no_candidates_gives_no_match(spark):
    live = spark.createDataFrame([("A", "B", dt.datetime(2024, 1, 1))], "facility_name_raw string, address_raw string, scraped_at timestamp_ntz")
    reg = spark.createDataFrame([], "facility_id_normalized string, facility_name string, full_address string, city string, register_order int")
    r = MT.fuzzy_match(live, reg).collect()[0]
    assert r["match_method"] == "no_match" and r["match_confidence"] == 0.0 and r["matched_facility_id"] is None


def test_upsert_semantics(spark):
    schema = "facility_name_raw string, address_raw string, matched_facility_id string, matched_facility_name string, " \
             "match_confidence double, match_method string, manually_validated boolean, matched_at timestamp_ntz"
    t0 = dt.datetime(2024, 1, 1)
    target = spark.createDataFrame([("a", "x", "f1", "F1", 0.5, "fuzzy", False, t0), (None, "x", "f0", "F0", 0.1, "fuzzy", False, t0),
                                    ("b", "y", "f2", "F2", 0.7, "fuzzy", False, t0)], schema)
    source = spark.createDataFrame([("a", "x", "f9", "F9", 1.0, "manual_override", True, t0), ("c", "z", "f3", "F3", 0.8, "fuzzy", False, t0),
                                    (None, "x", "f8", "F8", 0.2, "fuzzy", False, t0)], schema)
    rows = {(r[0], r[1], r[2]) for r in MT.upsert(target, source).collect()}
    assert rows == {("a", "x", "f9"), (None, "x", "f0"), ("b", "y", "f2"), ("c", "z", "f3"), (None, "x", "f8")}
    dup = source.unionByName(source.limit(1))
    with pytest.raises(Exception):
        MT.upsert(target, dup).collect()
