"""Facility ranking and recommendations for whole batches of intakes.

Plan shape (see README, "Scale"):
* the ranking of a facility depends on an intake only through its request
  key (CTAS level, patient latitude, longitude), so intakes are first reduced
  to their distinct request keys;
* the in-region candidate rows (the facility register with its live state) are
  computed once, staged and counted; the intake-independent min/max domains
  (D8) are one aggregate over them;
* a spatial tree (``rank_tree``) gives each key the nearest and farthest
  candidate, which its distance domain needs, and then the few rows that can
  be among its first twelve: keys and candidates are never paired out;
* those rows are scored exactly; per key a window takes the worst-copy values
  (C8) and the top 12 (E4), and the result is joined back to every intake by
  an equi-join on the request key.

The order of all candidates for one request (E6) scores every row, as it
returns every row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careflow.functions import lexicon as L
from careflow.functions.text import haversine_km
from careflow.operators import rank_tree as RT
from careflow.operators.views import in_region_or_unknown
from careflow.plans.sizing import broadcast_if_small, staged

REQUEST_KEY = ["provisional_ctas_level", "user_latitude", "user_longitude"]
ROW_KEY = ["facility_id_normalized", "facility_name_raw", "address_raw"]
METRICS = {  # output name -> candidate column
    "wait": "wait_time_non_priority_minutes",
    "occupancy": "stretcher_occupancy_pct",
    "waiting": "people_waiting",
    "depth": "virtual_queue_depth",
}
#: Further columns of a recommendation.
SHOWN = ["total_people_er", "avg_wait_room_minutes_prev_day", "avg_stretcher_wait_minutes_prev_day"]


def fit_penalty(level: Column, facility_type: Column) -> Column:
    """ambulatory = type contains ambul or clinic."""
    t = F.lower(F.coalesce(facility_type, F.lit("")))
    amb = None
    for m in L.AMBULATORY_MARKERS:
        amb = t.contains(m) if amb is None else (amb | t.contains(m))
    return (
        F.when((level <= 2) & amb, F.lit(L.FIT_PENALTY_EMERGENT_AMBULATORY))
        .when((level == 3) & amb, F.lit(L.FIT_PENALTY_URGENT_AMBULATORY))
        .when(level.isin(4, 5) & ~amb, F.lit(L.FIT_PENALTY_LOW_HOSPITAL))
        .otherwise(F.lit(0.0))
    )


def minmax_normalize(value: Column, lo: Column, hi: Column) -> Column:
    """NULL -> 1.0 (worst); max = min -> 0.0; else (v - min) / (max - min)."""
    return (
        F.when(value.isNull(), F.lit(1.0))
        .when(hi == lo, F.lit(0.0))
        .otherwise((value.cast("double") - lo) / (hi - lo))
    )


def domain_min_max(candidates: DataFrame) -> DataFrame:
    """One row of min/max per metric over all candidates (NULL counted as 0)."""
    aggs = []
    for name, col in METRICS.items():
        v = F.coalesce(F.col(col).cast("double"), F.lit(0.0))
        aggs += [F.min(v).alias(f"_{name}_lo"), F.max(v).alias(f"_{name}_hi")]
    return candidates.agg(*aggs)


def _candidates(live_joined: DataFrame) -> DataFrame:
    """In-region candidate rows with an id each and the min/max domains of the metrics (staged)."""
    cols = ROW_KEY + ["facility_name", "city", "odhf_facility_type", "latitude", "longitude"] + list(METRICS.values()) + SHOWN
    rows = staged(in_region_or_unknown(live_joined).select(*cols, F.monotonically_increasing_id().alias("_cid")), "rank-candidates")
    stats = domain_min_max(rows).first().asDict()  # one row
    return rows.withColumns({k: F.lit(v).cast("double") for k, v in stats.items()})


def _keys(requests: DataFrame) -> DataFrame:
    """Distinct request keys; one text column stands for the key (windows normalize doubles)."""
    one = F.concat_ws("|", *[F.coalesce((F.col(c) + 0).cast("string"), F.lit("-")) for c in REQUEST_KEY])
    return requests.select(*REQUEST_KEY).distinct().withColumn("_key", one)


def _static(level: Column) -> Column:
    """The score but for its distance part, which is second in order of the sum."""
    n = lambda m: minmax_normalize(F.col(METRICS[m]), F.col(f"_{m}_lo"), F.col(f"_{m}_hi"))
    wts = L.RANK_WEIGHTS
    return F.lit(wts[0]) * n("wait") + F.lit(wts[2]) * n("occupancy") + F.lit(wts[3]) * n("waiting") + F.lit(wts[4]) * n("depth") + F.lit(wts[5]) * fit_penalty(level, F.col("odhf_facility_type"))


def _slim(candidates: DataFrame) -> DataFrame:
    """What the tree needs of a candidate row."""
    levels = [F.lit(v).cast("int") for v in RT.LEVEL_CLASSES]
    return staged(candidates.select(
        F.col("_cid").alias("cid"), F.xxhash64(F.coalesce(F.concat(F.lit("f"), "facility_id_normalized"), F.lit("-"))).alias("unit"),
        F.col("latitude").cast("double").alias("latitude"), F.col("longitude").cast("double").alias("longitude"), _marked().alias("marked"),
        *(_static(v).alias(f"static{i}") for i, v in enumerate(levels)), *(fit_penalty(v, F.col("odhf_facility_type")).alias(f"pen{i}") for i, v in enumerate(levels)),
    ), "rank-tree")


def _marked() -> Column:
    return F.lower(F.coalesce(F.col("odhf_facility_type"), F.lit(""))).contains(L.ACUITY_FILTER_MARKER)


def _distance(lat: str, lon: str) -> Column:
    return F.coalesce(haversine_km(F.col("user_latitude"), F.col("user_longitude"), F.col(lat), F.col(lon)), F.lit(0.0))


def _scored(pairs: DataFrame) -> DataFrame:
    """Pairs of a request key (with its distance domain) and a candidate row with distance, penalty and score."""
    pairs = pairs.withColumn("distance_km", _distance("latitude", "longitude"))
    n = lambda m: minmax_normalize(F.col(METRICS[m]), F.col(f"_{m}_lo"), F.col(f"_{m}_hi"))
    pen = fit_penalty(F.col("provisional_ctas_level"), F.col("odhf_facility_type"))
    wts = L.RANK_WEIGHTS
    raw = (
        F.lit(wts[0]) * n("wait")
        + F.lit(wts[1]) * minmax_normalize(F.col("distance_km"), F.col("_dist_lo"), F.col("_dist_hi"))
        + F.lit(wts[2]) * n("occupancy")
        + F.lit(wts[3]) * n("waiting")
        + F.lit(wts[4]) * n("depth")
        + F.lit(wts[5]) * pen
    )
    return pairs.withColumns({"fit_penalty": pen, "score": F.bround(raw, 4)})


def rank_order(request: tuple[int, float | None, float | None], live_joined: DataFrame) -> DataFrame:
    """All candidates for one request (level, latitude, longitude), ordered by (fit_penalty, score)."""
    cand = _candidates(live_joined)
    own = dict(zip(REQUEST_KEY, zip(request, ("int", "double", "double"))))
    rows = cand.withColumns({c: F.lit(v).cast(t) for c, (v, t) in own.items()})
    lo, hi = rows.agg(F.min(_distance("latitude", "longitude")), F.max(_distance("latitude", "longitude"))).first()
    rows = _scored(rows.withColumns({"_dist_lo": F.lit(lo).cast("double"), "_dist_hi": F.lit(hi).cast("double")}))
    w = Window.orderBy("fit_penalty", "score", *[F.col(c).asc_nulls_first() for c in ROW_KEY])
    return rows.withColumn("rank_position", F.row_number().over(w)).select(
        "rank_position", *ROW_KEY, "distance_km", "score", "fit_penalty", F.col("odhf_facility_type").alias("facility_type"))


def contending_pairs(requests: DataFrame, live_joined: DataFrame, k: int) -> DataFrame:
    """Scored pairs of every distinct request key and the candidate rows that can be among its first k: all rows of
    every facility that has one there, and few others."""
    cand = _candidates(live_joined)
    slim, keys = _slim(cand), staged(_keys(requests), "rank-keys")
    ends = RT.extremes(keys, slim).join(keys, "_key")
    domain = ends.groupBy("_key").agg(F.min(_distance("lat", "lon")).alias("_dist_lo"), F.max(_distance("lat", "lon")).alias("_dist_hi"))
    keys = staged(keys.join(domain, "_key"), "rank-keys")
    found = RT.contenders(keys, slim, k)
    return _scored(found.join(broadcast_if_small(cand), "_cid").join(keys, "_key"))


def recommend(requests: DataFrame, live_joined: DataFrame, k: int = L.RECOMMENDATIONS_PER_INTAKE) -> DataFrame:
    """Per intake: worst-copy rank values (C8), acuity filter (B5), enrichment (H38, B10), top k by score."""
    pairs = contending_pairs(requests, live_joined, k)
    lvl = F.col("provisional_ctas_level")
    # Several candidate rows of one facility take the score, penalty and distance of its worst-ranked copy
    copies = Window.partitionBy("_key", "facility_id_normalized")
    pairs = pairs.withColumn("_worst", F.max(F.struct("fit_penalty", "score", "distance_km")).over(copies))
    pairs = pairs.withColumns({c: F.col(f"_worst.{c}") for c in ("fit_penalty", "score", "distance_km")})
    # Runs after scoring, so dropped rows still shaped the min/max domains
    pairs = pairs.filter(~((lvl <= 3) & _marked()))
    total = (
        F.coalesce(F.col("wait_time_non_priority_minutes"), F.lit(0))
        + (F.col("distance_km") * 2).cast("int")
        + (F.coalesce(F.col("virtual_queue_depth"), F.lit(0)) * 10).cast("int")
    )
    pairs = pairs.withColumns(
        {
            "estimated_total_time_minutes": total,
            "fit_for_ctas": F.when(F.col("fit_penalty") <= L.TYPE_FIT_THRESHOLD, F.lit("high")).otherwise(F.lit("caution")),
        }
    )
    w = Window.partitionBy("_key").orderBy("score", *[F.col(c).asc_nulls_first() for c in ROW_KEY])
    top = pairs.withColumn("rank_position", F.row_number().over(w)).filter(F.col("rank_position") <= k)
    out = top.select(
        *REQUEST_KEY, "rank_position", *ROW_KEY, "facility_name", "city", "odhf_facility_type",
        "wait_time_non_priority_minutes", "people_waiting", "stretcher_occupancy_pct", "virtual_queue_depth",
        *SHOWN, "latitude", "longitude",
        "distance_km", "score", "fit_penalty", "estimated_total_time_minutes", "fit_for_ctas",
    )
    return _attach(requests, out)


def _attach(requests: DataFrame, per_key: DataFrame) -> DataFrame:
    """Equi-join the per-request-key result back to every intake (null-safe on the key)."""
    r = requests.select("intake_session_id", *[F.col(c).alias(f"_r_{c}") for c in REQUEST_KEY])
    cond = None
    for c in REQUEST_KEY:
        e = r[f"_r_{c}"].eqNullSafe(per_key[c])
        cond = e if cond is None else (cond & e)
    j = r.join(per_key, cond, "inner")
    return j.drop(*[f"_r_{c}" for c in REQUEST_KEY])
