"""Simulated intake cases (scenarios x age groups x languages x {stable, worsening})."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from careflow.functions import lexicon as L
from careflow.functions.triage_scored import triage_scored

SCENARIO_SCHEMA = T.StructType(
    [
        T.StructField("scenario_ord", T.IntegerType(), False),
        T.StructField("scenario_id", T.StringType(), False),
        T.StructField("text_en", T.StringType(), False),
        T.StructField("text_fr", T.StringType(), False),
        T.StructField("age_groups", T.ArrayType(T.StringType()), False),
        T.StructField("baseline_duration_hours", T.IntegerType(), False),
        T.StructField("worsening_duration_hours", T.IntegerType(), False),
    ]
)


def scenarios(spark: SparkSession) -> DataFrame:
    rows = [(i, sid, en, fr, list(ages), b, w) for i, (sid, en, fr, ages, b, w) in enumerate(L.SCENARIOS)]
    return spark.createDataFrame(rows, SCENARIO_SCHEMA)


def generate_cases(spark: SparkSession) -> DataFrame:
    """Cases with ids sim-NNNN in nested-loop order, scored by the scored triage."""
    sc = scenarios(spark)
    suffix = F.create_map(
        *[x for (lang, worse), s in L.SCENARIO_SUFFIX.items() for x in (F.lit(f"{lang}|{worse}"), F.lit(s))]
    )
    cases = (
        sc.select("*", F.posexplode("age_groups").alias("age_pos", "age_group"))
        .select("*", F.posexplode(F.array(F.lit("en"), F.lit("fr"))).alias("lang_pos", "lang"))
        .select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("worsening"))
    )
    n_total = sum(len(s[3]) * 4 for s in L.SCENARIOS)
    # id = running position in (scenario, age, language, worsening) order; the
    # offset of each scenario is a closed-form prefix sum, so no global sort.
    offsets = []
    acc = 0
    for s in L.SCENARIOS:
        offsets.append(acc)
        acc += len(s[3]) * 4
    assert acc == n_total
    offset = F.element_at(F.array(*[F.lit(o) for o in offsets]), F.col("scenario_ord") + 1)
    pos = offset + F.col("age_pos") * 4 + F.col("lang_pos") * 2 + F.col("worsening").cast("int") + 1
    cases = cases.select(
        F.format_string("sim-%04d", pos).alias("intake_session_id"),
        F.to_timestamp(F.lit(L.SIMULATED_CREATED_AT)).alias("created_at"),
        F.concat(
            F.when(F.col("lang") == "en", F.col("text_en")).otherwise(F.col("text_fr")),
            F.element_at(suffix, F.concat_ws("|", F.col("lang"), F.when(F.col("worsening"), "True").otherwise("False"))),
        ).alias("raw_symptom_text"),
        F.col("age_group"),
        F.when(F.col("worsening"), F.col("worsening_duration_hours")).otherwise(F.col("baseline_duration_hours")).alias("explicit_duration"),
    )
    out = triage_scored(cases, "raw_symptom_text", "age_group", "explicit_duration")
    return out.select("intake_session_id", "created_at", "language", "patient_age_group", "raw_symptom_text", *[
        c for c in L.EXPECTED_KEYS if c not in ("language", "patient_age_group")
    ])
