"""Language and category of the scored triage: ties and empty texts, and every hint and keyword is looked for once."""

import re

from pyspark.sql import functions as F

from careflow.functions import lexicon as L
from careflow.functions import triage_scored as TS

TEXTS = ["", "nothing here", "douleur avec gorge", "pain with fever", "douleur and pain", "douleur avec pain", "cough and heart", "heart and fever and throat", "rash", "naus"]


def _expected(text):
    fr, en = (sum(w in text for w in hints) for hints in (L.SCORED_LANGUAGE_HINTS_FR, L.SCORED_LANGUAGE_HINTS_EN))
    counts = {c: sum(w in text for w in words) for c, words in L.SCORED_CATEGORY_KEYWORDS.items()}
    best = max(counts, key=counts.get)  # the first of equal ones
    return "unknown" if fr == en == 0 else "fr" if fr > en else "en", best if counts[best] else L.SCORED_DEFAULT_CATEGORY


def test_language_and_category(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = df.select("t", TS.detect_language(F.col("t")), TS.symptom_category(F.col("t"))).collect()
    assert {r[0]: (r[1], r[2]) for r in got} == {t: _expected(t) for t in TEXTS}


def test_every_word_is_looked_for_once(spark):
    df = spark.range(1).selectExpr("id").select(F.col("id").cast("string").alias("t"))
    for column, words in (
        (TS.detect_language, [*L.SCORED_LANGUAGE_HINTS_FR, *L.SCORED_LANGUAGE_HINTS_EN]),
        (TS.symptom_category, [w for some in L.SCORED_CATEGORY_KEYWORDS.values() for w in some]),
    ):
        plan = df.select(column(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall(r"Contains\(", plan)) == len(words)
