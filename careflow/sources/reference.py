"""Reference tables (A16): CTAS rules and emergency keywords for both rule engines.

Built from the fixed values in ``careflow.functions.lexicon`` with explicit
schemas. They are a few dozen rows each and never grow with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from careflow.functions import lexicon as L

MAIN_RULES_SCHEMA = T.StructType(
    [
        T.StructField("ctas_level", T.IntegerType(), False),
        T.StructField("ctas_label", T.StringType()),
        T.StructField("routing_policy", T.StringType()),
        T.StructField("escalation_message", T.StringType()),
        T.StructField("queue_eligible", T.BooleanType()),
        T.StructField("facility_type_guidance", T.StringType()),
    ]
)
MAIN_KEYWORDS_SCHEMA = T.StructType(
    [
        T.StructField("keyword", T.StringType(), False),
        T.StructField("language", T.StringType()),
        T.StructField("flag_label", T.StringType()),
        T.StructField("severity_weight", T.IntegerType()),
        T.StructField("note", T.StringType()),
    ]
)
SCORED_RULES_SCHEMA = T.StructType(
    [
        T.StructField("ctas_level", T.IntegerType(), False),
        T.StructField("ctas_label", T.StringType()),
        T.StructField("base_score", T.IntegerType()),
        T.StructField("routing_policy", T.StringType()),
        T.StructField("escalation_message", T.StringType()),
    ]
)
SCORED_KEYWORDS_SCHEMA = T.StructType(
    [
        T.StructField("keyword_id", T.StringType(), False),
        T.StructField("phrase", T.StringType()),
        T.StructField("normalized_phrase", T.StringType()),
        T.StructField("severity_class", T.StringType()),
        T.StructField("active_flag", T.BooleanType()),
    ]
)


def main_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(L.MAIN_RULES_ROWS, MAIN_RULES_SCHEMA)


def main_keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(L.MAIN_KEYWORD_ROWS, MAIN_KEYWORDS_SCHEMA)


def scored_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(L.SCORED_RULES_ROWS, SCORED_RULES_SCHEMA)


def scored_keyword_rows() -> list[tuple]:
    return [(f"ek_{i:03d}", p, p, cls, True) for i, (p, cls) in enumerate(L.SCORED_KEYWORD_ROWS, start=1)]


def scored_keywords(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(scored_keyword_rows(), SCORED_KEYWORDS_SCHEMA)
