"""Register ingest from archives and CSV, decoding, sinks, guards and small helpers."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from careflow.functions import triage_scored as TS
from careflow.functions.text import compact_text, make_id
from careflow.sources import register as RG
from careflow.sources import tables as TB

HEADER = ["ID", "Facility Name", "ODHF Facility Type", "Street Number", "Street Name", "City", "Province", "Postal Code", "lat", "LNG", "PRuid"]
ROWS = [["1", "Hôpital Général", "Hospitals", "10", "Rue Sainte-Anne", "Montréal", " qc ", "H2X 1A1", "45.5", "-73.6", "24.7"],
        ["2", "Clinique Ouest", "Ambulatory health care services", "", "", "Laval", "Ontario", "", "bad", "", ""]]


def _zip(path, text, encoding):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr("readme.txt", "not the data")
        zf.writestr("register.csv", text.encode(encoding))
    path.write_bytes(buf.getvalue())


def _csv_text():
    out = io.StringIO()
    import csv

    w = csv.writer(out)
    w.writerow(HEADER)
    w.writerows(ROWS)
    return out.getvalue()


@pytest.mark.parametrize("encoding", ["utf-8-sig", "cp1252"])
def test_archive_register_load(spark, tmp_path, encoding):
    _zip(tmp_path / "a.zip", _csv_text(), encoding)
    recs = TB.archive_records(spark, str(tmp_path))
    reg = {r["index"]: r.asDict() for r in TB.register_from_records(recs, "2024-01-01 00:00:00").collect()}
    a, b = reg["1"], reg["2"]
    assert a["facility_name"] == "Hôpital Général" and a["city"] == "Montréal"
    assert a["full_address"] == "10, Rue Sainte-Anne, Montréal, H2X 1A1"
    assert a["facility_id_normalized"] == "hopital_general_montreal_h2x_1a1"
    assert a["is_quebec"] is True and a["latitude"] == 45.5 and a["longitude"] == -73.6 and a["pruid"] == 24
    assert b["full_address"] == "Laval" and b["is_quebec"] is False and b["latitude"] is None and b["pruid"] is None
    assert b["unit"] == "" and b["source_format_str_address"] == ""


def test_register_csv_reader_and_aliases(spark, tmp_path):
    p = tmp_path / "reg.csv"
    p.write_text(_csv_text(), encoding="utf-8")
    raw = RG.read_register_csv(spark, str(p))
    assert RG.resolve_aliases(raw.columns)["longitude"] == "LNG"
    out = RG.register_load(raw, "2024-01-01 00:00:00").collect()
    assert {r["index"] for r in out} == {"1", "2"}


def test_decode_fallback(spark):
    df = spark.createDataFrame([(b"\xef\xbb\xbfMontr\xc3\xa9al",), (b"Montr\xe9al",)], "b binary")
    got = [r[0] for r in df.select(RG.decode_fallback(F.col("b"))).collect()]
    assert got == ["Montréal", "Montréal"]


def test_sinks_and_guards(spark, tmp_path):
    t = dt.datetime(2024, 1, 1, 6)
    df = spark.createDataFrame([("a", t), ("b", t + dt.timedelta(days=1))], "k string, scraped_at timestamp_ntz")
    TB.append_snapshot(df, str(tmp_path / "gold"))
    TB.append_snapshot(df, str(tmp_path / "gold"))
    back = spark.read.parquet(str(tmp_path / "gold"))
    assert back.count() == 4 and back.filter(F.col("snapshot_date") == dt.date(2024, 1, 1)).count() == 2
    TB.overwrite_table(df, str(tmp_path / "m"))
    TB.overwrite_table(df.limit(1), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1
    TB.append_rows(df, str(tmp_path / "q"))
    assert spark.read.parquet(str(tmp_path / "q")).count() == 2
    with pytest.raises(ValueError):
        RG.require_nonempty(df.limit(0), "scrape")
    assert RG.optional_table(spark, "no_such_table_xyz", df.schema).count() == 0


def test_partial_views_and_helpers(spark):
    df = spark.createDataFrame([("Chest pain and pressure for two hours", "adult")], "raw_text string, age_group string")
    assert TS.level_view(df).columns[-2:] == ["provisional_ctas_level", "provisional_ctas_label"]
    assert TS.risk_view(df).first()["risk_band"] == "critical"
    assert TS.policy_view(df).first()["queue_eligible"] is False
    assert "emergency_flags" in TS.flags_view(df).columns
    r = spark.createDataFrame([("  a \t b  ", "   ")], "x string, y string").select(
        compact_text(F.col("x")).alias("x"), compact_text(F.col("y")).alias("y"), make_id("intake", F.col("x")).alias("id")).first()
    assert r["x"] == "a b" and r["y"] is None and r["id"].startswith("intake_") and len(r["id"]) == len("intake_") + 16
