"""Ranking by branch and bound against all pairs of requests and candidates."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from careflow.operators import rank as RK
from careflow.operators import rank_tree as RT

LIVE = ("facility_id_normalized string, facility_name_raw string, address_raw string, facility_name string, city string, odhf_facility_type string, latitude double, "
        "longitude double, wait_time_non_priority_minutes int, stretcher_occupancy_pct double, people_waiting int, virtual_queue_depth long, total_people_er int, "
        "avg_wait_room_minutes_prev_day int, avg_stretcher_wait_minutes_prev_day int, is_quebec boolean")  # fmt: skip
REQ = "intake_session_id string, provisional_ctas_level int, user_latitude double, user_longitude double"


def some(rnd, x, share=0.1):
    return None if rnd.random() < share else x


def candidates(spark, rnd, n, facilities, spread):
    rows = []
    for i in range(n):
        f = some(rnd, f"f{rnd.randrange(facilities)}", 0.05)
        rows.append((f, f"n{i}", some(rnd, f"a{i % 7}"), f"N{i}", "C", some(rnd, rnd.choice(["Hospitals", "Ambulatory health care services", "Clinic X", "CLSC"])),
                     some(rnd, 45 + spread * rnd.random()), some(rnd, -73 + spread * rnd.random()), some(rnd, rnd.choice([0, 30, 30, 500])), some(rnd, rnd.choice([50.0, 87.0, 120.0])),
                     some(rnd, rnd.randrange(40)), rnd.randrange(9), 5, 6, 7, True))
    return spark.createDataFrame(rows, LIVE)


def requests(spark, rnd, n, spread):
    rows = [(f"i{i}", some(rnd, rnd.randrange(1, 7)), some(rnd, 45 + spread * rnd.random()), some(rnd, -73 + spread * rnd.random())) for i in range(n)]
    return spark.createDataFrame(rows + [("twin", *rows[0][1:])], REQ)


def every_pair(req, live):
    """All pairs scored, with the domain of all of them."""
    cand = RK._candidates(live)
    pairs = RK._keys(req).join(F.broadcast(cand), how="cross")
    w = Window.partitionBy("_key")
    far = RK._distance("latitude", "longitude")
    return RK._scored(pairs.withColumns({"_dist_lo": F.min(far).over(w), "_dist_hi": F.max(far).over(w)}))


@pytest.mark.parametrize("seed,n,facilities,spread,leaf,key_block,block", [
    (1, 400, 150, 3.0, 4, 20, 60), (2, 60, 8, 0.5, 2, 65_536, 32_768), (3, 300, 300, 0.0001, 8, 65_536, 32_768), (4, 5, 3, 60.0, 32, 65_536, 2),
])
def test_first_rows_equal_all_pairs(spark, monkeypatch, seed, n, facilities, spread, leaf, key_block, block):
    monkeypatch.setattr(RT, "LEAF", leaf)
    monkeypatch.setattr(RT, "KEY_BLOCK", key_block)
    monkeypatch.setattr(RT, "CANDIDATE_BLOCK", block)
    rnd = random.Random(seed)
    live, req = candidates(spark, rnd, n, facilities, spread), requests(spark, rnd, 60, spread)
    rows = lambda df: sorted(map(repr, (tuple(r) for r in df.collect())))
    got = rows(RK.recommend(req, live))
    with monkeypatch.context() as m:
        m.setattr(RK, "contending_pairs", lambda a, b, k: every_pair(a, b))
        want = rows(RK.recommend(req, live))
    assert got == want and len(want) > 60


def test_few_pairs_are_scored(spark):
    rnd = random.Random(7)
    live, req = candidates(spark, rnd, 4000, 4000, 6.0), requests(spark, rnd, 100, 6.0).filter("user_latitude IS NOT NULL AND user_longitude IS NOT NULL AND provisional_ctas_level IS NOT NULL")
    keys = req.count() - 1
    scored = RK.contending_pairs(req, live, 12).count()
    assert 12 <= scored / keys < 80  # of 4000


def test_bounds_hold_every_row():
    rnd = np.random.default_rng(3)
    lat, lon = rnd.uniform(-90, 90, 500), rnd.uniform(-180, 180, 500)
    center = (float(lat.mean()), float(lon.mean()))
    radius = RT.haversine(*center, lat, lon).max()
    for q in zip(rnd.uniform(-90, 90, 200), rnd.uniform(-180, 180, 200)):
        to = RT.haversine(*q, lat, lon)
        mid = float(RT.haversine(*q, np.array([center[0]]), np.array([center[1]]))[0])
        assert mid - radius - 1e-6 <= to.min() and to.max() <= mid + radius + 1e-6
    assert RT.haversine(45.0, -73.0, np.array([math.nan]), np.array([1.0]))[0] == 0


def test_no_candidates_and_no_requests(spark):
    rnd = random.Random(1)
    live, req = candidates(spark, rnd, 5, 3, 1.0), requests(spark, rnd, 5, 1.0)
    assert RK.recommend(req.limit(0), live).count() == 0
    assert RK.recommend(req, live.limit(0)).count() == 0
