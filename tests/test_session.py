"""The package on executors, the shared folder, and the output contract."""

import json
import subprocess
import sys

import pytest
from conftest import ROOT, SF_SMALL
from pyspark.sql import functions as F

from careflow import session
from careflow.functions import lexicon as L
from careflow.functions import triage_scored as TS
from careflow.operators import transcripts as TR


def test_python_steps_run_from_another_folder(tmp_path):
    code = f"""
import sys
sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__ as e
assert e.queries()["er_blocks"](spark, {SF_SMALL!r}).count() == 67
"""
    env = {k: v for k, v in __import__("os").environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stderr[-2000:]


def test_a_cluster_without_a_shared_folder_is_refused():
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())


VALID = {
    "language": "en", "patient_age_group": "adult", "primary_symptom": "cough", "symptom_category": "respiratory", "duration_hours": 3, "severity_indicators": [],
    "emergency_flags": [], "emergency_stop": False, "provisional_ctas_level": 4, "provisional_ctas_label": "Less Urgent", "recommended_facility_type": "ambulatory",
    "recommended_urgency_band": "low_acuity", "queue_eligible": True, "risk_score": 20, "risk_band": "low", "reasoning_summary": "x",
}


def test_payload_contract(spark):
    cases = [
        (VALID, []),
        ({k: v for k, v in VALID.items() if k not in ("language", "risk_score")}, ["missing:language", "missing:risk_score"]),
        (VALID | {"note": 1, "also": 2}, ["extra:also", "extra:note"]),
        (VALID | {k: "odd" for k in L.OUTPUT_ENUMS}, sorted(f"enum:{k}" for k in L.OUTPUT_ENUMS)),
        (VALID | {"provisional_ctas_level": 6, "duration_hours": -1, "risk_score": 101}, ["enum:provisional_ctas_level", "range:duration_hours", "range:risk_score"]),
        (VALID | {"duration_hours": 1.5, "risk_score": None, "language": None}, ["enum:language", "range:duration_hours", "range:risk_score"]),
    ]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, (p, _) in enumerate(cases)], "i int, p string")
    got = [r["v"] for r in df.select("i", TR.validate_payload(F.col("p")).alias("v")).orderBy("i").collect()]
    assert got == [v for _, v in cases]


def test_decision_columns_contract(spark):
    df = TS.triage_scored(spark.createDataFrame([("Twisted ankle",)], "raw_text string"), "raw_text", None, None)
    keys = list(L.EXPECTED_KEYS)
    bad = df.withColumns({"risk_score": F.lit(101), "language": F.lit("xx"), "note": F.lit(1)}).drop("risk_band")
    row = TS.validate_decisions(bad, [*(k for k in keys if k != "risk_band"), "note"]).first()
    assert row["violations"] == ["missing:risk_band", "extra:note", "enum:language", "range:risk_score"] and "risk_band" not in row.asDict()
    assert TS.validate_decisions(df).first()["violations"] == []


def test_own_age_and_duration_come_first(spark):
    turns = spark.createDataFrame([(1, 0, "user", "fever and poor feeding for 2 hours"), (2, 0, "user", "fever and poor feeding for 2 hours")], "conv_id long, turn long, role string, text string")
    own = spark.createDataFrame([(1, "infant", 30)], "conv_id long, patient_age_group string, duration_hours int")
    got = {r["conv_id"]: r for r in TR.score_conversations(turns, own).collect()}
    assert (got[1]["patient_age_group"], got[1]["duration_hours"], got[1]["emergency_stop"]) == ("infant", 30, True)
    assert (got[2]["patient_age_group"], got[2]["duration_hours"]) == ("unknown", 2)
