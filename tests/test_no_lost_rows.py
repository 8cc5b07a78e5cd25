"""Cases in which rows were easy to lose: NULL keys, open and nested blocks, text behind </body>, blank lines."""

import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from careflow.operators import match as MT
from careflow.operators import queue as QU
from careflow.plans import domain as D
from careflow.sources import er_pages as ER
from careflow.sources import register as RG
from careflow.sources import tables as TB


def test_requests_without_time_or_facility_are_numbered(spark):
    t = dt.datetime
    req = spark.createDataFrame(
        [("r1", "f", t(2024, 1, 1, 9)), ("r2", "f", None), ("r3", None, t(2024, 1, 1, 8)), ("r4", "f", t(2024, 1, 2)), ("r5", None, None), ("r6", "f", None)],
        "request_id string, facility_id string, created_at timestamp_ntz",
    ).withColumns({"arrival_window_start": F.col("created_at"), "arrival_window_end": F.col("created_at")})
    queue = spark.createDataFrame([("f", "reserved", 4)], "facility_id string, queue_status string, queue_position int")
    got = {r["request_id"]: r["queue_position"] for r in QU.assign_positions(req, queue).collect()}
    assert got == {"r1": 5, "r4": 6, "r2": 7, "r6": 8, "r3": 1, "r5": 2}


BLOCK = ('<div class="hospital_element"><ul><li class="title"><span class="font-weight-bold">{n}</span></li>'
         '<li class="hopital-item">People waiting : {k}</li></ul><div class="adresse">{n} street<br>Région 1</div>')


def blocks(spark, html):
    rows = ER.html_blocks(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")).collect()
    return [(r["facility_name_raw"], r["address_lines"][0], r["metric_items"], r["raw_html_fragment"]) for r in rows]


def test_a_block_still_open_at_the_end_is_kept(spark):
    html = "<body>" + BLOCK.format(n="A", k=1) + "</div><p>" + BLOCK.format(n="B", k=2)
    got = blocks(spark, html)
    assert [g[:3] for g in got] == [("A", "A street", ["People waiting : 1"]), ("B", "B street", ["People waiting : 2"])]
    assert got[0][3] == BLOCK.format(n="A", k=1) + "</div>" and got[1][3] == BLOCK.format(n="B", k=2)


def test_a_block_inside_a_block_is_one_of_its_own(spark):
    inner = BLOCK.format(n="B", k=2) + "</div>"
    got = blocks(spark, BLOCK.format(n="A", k=1) + inner + "</div>" + BLOCK.format(n="C", k=3) + "</div>")
    assert [(n, items) for n, _, items, _ in got] == [("A", ["People waiting : 1", "People waiting : 2"]), ("B", ["People waiting : 2"]), ("C", ["People waiting : 3"])]
    assert got[1][3] == inner and got[0][3].endswith(inner + "</div>")


def test_text_behind_the_body_stays(spark):
    pages = spark.createDataFrame([(1, "u", "<body>a</body>b</body>tail</html>"), (2, "v", "no body")], "page_id long, url string, html string")
    got = {r["page_id"]: r["html"] for r in D.er_pages_from(pages).collect()}
    assert got[1].startswith("<body>a</body>b<div") and got[1].endswith("</body>tail</html>")
    assert got[2].startswith("no body<div") and got[2].endswith("</body></html>")


def test_blank_lines_of_an_archive_are_no_records(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("register.csv", "Facility Name,City\n\nA,Québec\n\n,\nB,Laval\n\n".encode("cp1252"))
    (tmp_path / "a.zip").write_bytes(buf.getvalue())
    rows = TB.archive_records(spark, str(tmp_path)).orderBy("row_num").collect()
    assert [(r["row_num"], r["record"]) for r in rows] == [
        (0, {"facility name": "A", "city": "Québec"}), (1, {"facility name": "", "city": ""}), (2, {"facility name": "B", "city": "Laval"})]


def test_windows_1252_bytes(spark):
    text = "Hôpital “œuvre” – 5 €"
    df = spark.createDataFrame([(bytearray(text.encode("cp1252")),), (bytearray(("﻿" + text).encode()),)], "b binary")
    assert [r[0] for r in df.select(RG.decode_fallback(F.col("b"))).collect()] == [text, text]


def test_two_crawls_of_a_page_make_two_ids(spark):
    rec = spark.createDataFrame([("u", 1, 0), ("u", 2, 0)], "source_url string, page_id long, block_pos int")
    a, b = (ER.with_scrape(rec, t) for t in ("2024-01-01 06:00:00", "2024-01-01 07:00:00"))
    assert a.union(b).select("scrape_id").distinct().count() == 4


def test_upsert_evaluates_its_source_once(spark):
    t = spark.createDataFrame([("a", "x", 1), ("b", "y", 2), (None, "z", 3)], "facility_name_raw string, address_raw string, v int")
    s = spark.createDataFrame([("b", "y", 20), ("c", "w", 30), (None, "z", 40), (None, "z", 41)], "facility_name_raw string, address_raw string, v int")
    got = MT.upsert(t, s)
    assert sorted(map(repr, (tuple(r) for r in got.collect()))) == sorted(map(repr, [("a", "x", 1), ("b", "y", 20), ("c", "w", 30), (None, "z", 3), (None, "z", 40), (None, "z", 41)]))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 2
