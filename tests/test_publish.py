"""Guarded loads and the split of replies by verdict: one pass, old tables kept, repeats harmless."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from careflow.operators import transcripts as TR
from careflow.sources import publish as PB

T = dt.datetime(2024, 1, 1)
LIVE = "id string, wait int, scraped_at timestamp_ntz"


def live(spark, n, day=1):
    return spark.createDataFrame([(f"s{i}", i, dt.datetime(2024, 1, day, i % 24)) for i in range(n)], LIVE)


def scans(spark, name, tmp_path, df):
    """How often the source is read: counted by an accumulator in the rows' own computation."""
    acc = spark.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            acc.add(b.num_rows)
            yield b

    return df.mapInArrow(rows, df.schema), acc


def test_publish_counts_in_one_pass_and_replaces(spark, tmp_path):
    path = str(tmp_path / "t")
    df, seen = scans(spark, "live", tmp_path, live(spark, 30))
    assert PB.publish(df, path, ts_col="scraped_at") == {"rows_loaded": 30, "snapshot_at": dt.datetime(2024, 1, 1, 23)}
    assert seen.value == 30
    assert PB.publish(spark.read.parquet(path).filter("wait < 7"), path)["rows_loaded"] == 7  # reads what it replaces
    assert spark.read.parquet(path).count() == 7


def test_empty_or_failed_load_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "t")
    PB.publish(live(spark, 5), path)
    with pytest.raises(PB.EmptyLoad, match="empty register"):
        PB.publish(live(spark, 5).filter("false"), path, "register")
    with pytest.raises(Exception, match="broken"):
        PB.publish(live(spark, 5).withColumn("wait", F.raise_error(F.lit("broken")).cast("int")), path)
    assert spark.read.parquet(path).count() == 5
    assert [p.name for p in tmp_path.iterdir()] == ["t"]  # nothing is left beside it


def test_a_repeated_load_adds_no_row(spark, tmp_path):
    path = str(tmp_path / "t")
    both = live(spark, 40).unionByName(live(spark, 10, day=2))
    for _ in range(2):
        assert PB.append_load(both, path, "l1")["rows_loaded"] == 50
    PB.append_load(live(spark, 3), path, "l2")
    assert PB.append_load(live(spark, 3).filter("false"), path, "l3")["rows_loaded"] == 0
    got = {(str(r["snapshot_date"]), r["load_id"]): r["count"] for r in spark.read.parquet(path).groupBy("snapshot_date", "load_id").count().collect()}
    assert got == {("2024-01-01", "l1"): 40, ("2024-01-02", "l1"): 10, ("2024-01-01", "l2"): 3}


def test_replies_are_split_in_one_pass(spark, tmp_path):
    good = ('{"language": "en"}', "Sure: {\"language\": \"xx\"} done", "no object", None, "")
    df, seen = scans(spark, "replies", tmp_path, spark.createDataFrame(list(enumerate(good)), "conv_id long, reply string"))
    counts = TR.write_by_verdict(TR.judge_replies(df), str(tmp_path / "v"))
    assert counts == {"good": 0, "bad": 2, "unreadable": 3} and seen.value == 5
    back = spark.read.parquet(str(tmp_path / "v"))
    rejects = {r["conv_id"]: r["violations"] for r in back.filter("verdict = 'bad'").collect()}
    assert "enum:language" in rejects[1] and "enum:language" not in rejects[0] and "missing:risk_band" in rejects[0]
    assert "PartitionFilters: [isnotnull(verdict" in back.filter("verdict = 'bad'")._jdf.queryExecution().toString()
