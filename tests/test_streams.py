"""Streaming twins across several micro-batches: late rows, restarts, replays, tables of part files."""

import datetime as dt

import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

import __spark_entry__ as E
from careflow.plans import domain as D
from careflow.streaming import keyed_tables as KT
from careflow.streaming import streams as ST

LIVE_SCHEMA = "scrape_id string, facility_name_raw string, address_raw string, wait_time_non_priority_minutes int, scraped_at timestamp_ntz"


def _write(spark, rows, path):
    spark.createDataFrame(rows, LIVE_SCHEMA).coalesce(1).write.mode("overwrite").parquet(path)


def test_latest_stream_keeps_newest_across_batches(spark, tmp_path):
    src = str(tmp_path / "src")
    t = dt.datetime
    _write(spark, [("s1", "A", "x", 10, t(2024, 1, 1, 12)), ("s2", "B", "y", 20, t(2024, 1, 1, 9))], src + "/f1")
    _write(spark, [("s3", "A", "x", 99, t(2024, 1, 1, 8)),   # late and older: must not replace s1
                   ("s4", "B", "y", 25, t(2024, 1, 1, 10)),  # newer: replaces s2
                   ("s5", "C", "z", 5, t(2024, 1, 1, 7))], src + "/f2")
    root = str(tmp_path / "out")
    stream = spark.readStream.schema(LIVE_SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(src)
    agg = ST.latest_stream(stream)
    w = agg.writeStream.outputMode("update").foreachBatch(lambda df, bid: KT.append_changes(df, bid, root + "/table", ST.LIVE_KEY))
    ST._run(w, root + "/ck")
    got = {r["facility_name_raw"]: (r["scrape_id"], r["wait_time_non_priority_minutes"]) for r in KT.read_keyed(spark, root + "/table", ST.LIVE_KEY).collect()}
    assert got == {"A": ("s1", 10), "B": ("s4", 25), "C": ("s5", 5)}


def _bytes(path):
    return sum(p.stat().st_size for p in path.rglob("part-*.parquet"))


def test_a_batch_writes_its_own_rows_alone(spark, tmp_path):
    root, t = str(tmp_path / "t"), dt.datetime(2024, 1, 1)
    many = spark.createDataFrame([(f"s{i}", f"site {i}", "x", i, t) for i in range(5000)] + [("n", None, "x", 1, t)], LIVE_SCHEMA).coalesce(1)
    KT.seed_keyed(many, root, ST.LIVE_KEY)
    KT.seed_keyed(many.limit(1), root, ST.LIVE_KEY)  # a restart: there are rows already
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("part-*.parquet")}
    size = _bytes(tmp_path / "t")
    want = {r["facility_name_raw"]: r["scrape_id"] for r in many.collect()}
    written = 0
    for b in range(20):
        rows = [(f"b{b}-{i}", f"site {(b * 37 + i * 101) % 5005}", "x", i, t) for i in range(40)] + ([("late n", None, "x", 2, t)] if b == 7 else [])
        before = {p for p in (tmp_path / "t").rglob("part-*.parquet")}
        KT.append_changes(spark.createDataFrame(rows, LIVE_SCHEMA).coalesce(1), b, root, ST.LIVE_KEY)
        written += sum(p.stat().st_size for p in set((tmp_path / "t").rglob("part-*.parquet")) - before)
        KT.append_changes(spark.createDataFrame(rows[:1], LIVE_SCHEMA), b, root, ST.LIVE_KEY)  # replayed: covered by a run
        want |= {r[1]: r[0] for r in rows}
        assert len(KT.runs(spark, root)) <= 7
    got = [(r["facility_name_raw"], r["scrape_id"]) for r in KT.read_keyed(spark, root, ST.LIVE_KEY).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert all(p.exists() and p.stat().st_mtime_ns == m for p, m in files.items())  # 20 batches touched 16 % of the keys
    assert written < 2 * size  # 20 rewritten tables would be 20 times the size


def test_a_torn_run_is_invisible(spark, tmp_path):
    root, t = str(tmp_path / "t"), dt.datetime(2024, 1, 1)
    KT.append_changes(spark.createDataFrame([("s1", "A", "x", 1, t)], LIVE_SCHEMA), 0, root, ST.LIVE_KEY)
    KT.append_changes(spark.createDataFrame([(f"s{i}", f"B{i}", "x", 1, t) for i in range(9)], LIVE_SCHEMA), 1, root, ST.LIVE_KEY)
    for marker in (tmp_path / "t").rglob("_SUCCESS"):
        if marker.parent.name == "000000001-000000002":
            marker.unlink()
    assert KT.runs(spark, root) == [(1, 1), (2, 2)] and KT.read_keyed(spark, root, ST.LIVE_KEY).count() == 10


QUEUE_SCHEMA = "facility_id string, queue_status string, created_at timestamp_ntz, estimated_call_time timestamp_ntz"


def test_windowed_depth_drops_rows_behind_watermark(spark, tmp_path):
    src, root = str(tmp_path / "q"), str(tmp_path / "out")
    t = dt.datetime

    def run():
        stream = spark.readStream.schema(QUEUE_SCHEMA).option("recursiveFileLookup", True).parquet(src)
        w = ST.windowed_depth(stream, lateness="2 hours").writeStream.outputMode("update").foreachBatch(
            lambda df, bid: KT.append_changes(df, bid, root + "/table", ["facility_id", "window_start"]))
        ST._run(w, root + "/ck")

    spark.createDataFrame([("f1", "reserved", t(2024, 1, 1, 10, 5), None), ("f1", "called", t(2024, 1, 1, 14, 0), t(2024, 1, 1, 14, 30))],
                          QUEUE_SCHEMA).coalesce(1).write.parquet(src + "/b1")
    run()  # watermark is now 14:00 - 2 h = 12:00
    spark.createDataFrame([("f1", "reserved", t(2024, 1, 1, 9, 30), None),    # window ends 10:00, behind the watermark: dropped
                           ("f1", "confirmed", t(2024, 1, 1, 13, 10), None),  # inside it: counted
                           ("f1", "completed", t(2024, 1, 1, 14, 20), None)], # not active
                          QUEUE_SCHEMA).coalesce(1).write.parquet(src + "/b2")
    run()  # resumes from the checkpoint: only the new file is read
    got = {(r["window_start"].hour, r["active_queue_count"], r["avg_queue_delay_minutes"])
           for r in KT.read_keyed(spark, root + "/table", ["facility_id", "window_start"]).collect()}
    assert got == {(10, 1, 0.0), (13, 1, 0.0), (14, 1, 30.0)}


@pytest.fixture(scope="module")
def parts_dir(spark, tmp_path_factory):
    """The smallest tables, the streamed ones as folders of three part files in mixed order."""
    out = str(tmp_path_factory.mktemp("parts"))
    for name in ("events", "orders", "pages", "documents", "supplier", "nation", "region"):
        df = spark.read.parquet(f"{SF_SMALL}/{name}.parquet")
        n = 3 if name in ("events", "orders", "pages", "documents") else 1
        (df.repartition(n, F.rand(1)) if n > 1 else df.coalesce(1)).write.parquet(f"{out}/{name}.parquet")
    return out


def _rows(df):
    cols = sorted(df.columns)
    return sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))


@pytest.mark.parametrize("stream,batch", [
    (ST.run_latest, "latest_status"), (ST.run_depth, "queue_depth"), (ST.run_windowed_depth, "queue_depth_windows"), (ST.run_scores, "triage_scored"),
])
def test_streams_over_part_files_equal_batch(spark, parts_dir, stream, batch):
    want = E.queries()[batch](spark, parts_dir)
    got = stream(spark, parts_dir, files=1)  # parts in mixed order, one a micro-batch
    assert _rows(got.select(*want.columns)) == _rows(want) and want.count() > 5


def _earliest(live):
    best = {}
    for r in live.collect():
        k = tuple(r[c] for c in ST.LIVE_KEY)
        if k not in best or (r["scraped_at"], r["scrape_id"]) < (best[k]["scraped_at"], best[k]["scrape_id"]):
            best[k] = r
    return sorted(map(repr, (tuple(r[c] for c in sorted(live.columns)) for r in best.values())))


CLOSED = dt.datetime(2100, 1, 1)


def test_dedup_stream_sends_the_earliest_whole_rows(spark, parts_dir):
    live = D.live_status(spark, parts_dir).withColumn("scraped_at", F.col("scraped_at").cast("timestamp"))
    got = ST.run_dedup(spark, parts_dir, files=1, delay="3650 days", upto=CLOSED)  # shuffled parts, one a micro-batch
    assert _rows(got) == _earliest(live)


def test_dedup_state_across_late_replayed_and_later_rows(spark, tmp_path):
    """Three runs in one folder: what is due is sent once, late rows are dropped, the state shrinks to a mark a site."""
    src, root, t = tmp_path / "src", str(tmp_path / "run"), dt.datetime
    schema = LIVE_SCHEMA.replace("timestamp_ntz", "timestamp")
    live = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1)

    def step(name, rows, upto=None):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(src / name))
        if upto:
            ST.punctuate(spark, root, upto)
        ST.punctuate(spark, root, t(1970, 1, 2))
        beats = spark.readStream.schema("scraped_at timestamp").parquet(f"{root}/beats")
        ST._run(ST.dedup_stream(live.parquet(str(src)), beats, "2 hours").writeStream.format("parquet").option("path", root + "/table"), root + "/checkpoint")
        return sorted((r["facility_name_raw"], r["scrape_id"], r["wait_time_non_priority_minutes"]) for r in spark.read.schema(schema).parquet(root + "/table").collect())

    a = [("s2", "A", "x", 12, t(2024, 1, 1, 10)), ("s1", "A", "x", None, t(2024, 1, 1, 9, 30)), ("s3", "B", "y", 5, t(2024, 1, 1, 12))]
    assert step("f1", a) == [("A", "s1", None)]  # the watermark is 10:00, past A's earliest row
    b = [("s0", "A", "x", 1, t(2024, 1, 1, 8)),  # behind the watermark: dropped
         ("s9", "B", "y", 9, t(2024, 1, 1, 11)),  # earlier than what is kept of B
         ("s5", "A", "x", 7, t(2024, 1, 1, 12, 30))]  # A was sent
    assert step("f2", b) == [("A", "s1", None)]
    assert step("f3", [("s7", "C", "z", 3, t(2024, 1, 1, 13, 30))], upto=t(2024, 1, 1, 15)) == [("A", "s1", None), ("B", "s9", 9)]
    assert step("f4", [("s7", "C", "z", 4, t(2024, 1, 1, 13, 45))], upto=CLOSED)[2:] == [("C", "s7", 3)]
    state = spark.read.format("statestore").option("path", root + "/checkpoint").option("stateVarName", "best").load()
    assert state.count() == 0
    sent = spark.read.format("statestore").option("path", root + "/checkpoint").option("stateVarName", "sent").load()
    assert sorted(r["key"][0] for r in sent.collect()) == ["A", "B", "C"]


def test_dedup_forgets_a_site_after_a_while(spark, tmp_path):
    src, root, t = tmp_path / "src", str(tmp_path / "run"), dt.datetime
    schema = LIVE_SCHEMA.replace("timestamp_ntz", "timestamp")
    for i, day in enumerate((1, 2, 20, 21, 25)):
        spark.createDataFrame([(f"s{day}", "A", "x", day, t(2024, 1, day))], schema).coalesce(1).write.parquet(str(src / f"f{i}"))
        ST.punctuate(spark, root, t(1970, 1, 2))
        live = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(src))
        beats = spark.readStream.schema("scraped_at timestamp").parquet(f"{root}/beats")
        stream = ST.dedup_stream(live, beats, "1 hour", forget_ms=7 * 86_400_000)
        ST._run(stream.writeStream.format("parquet").option("path", root + "/table"), root + "/checkpoint")
    assert sorted(r["scrape_id"] for r in spark.read.parquet(root + "/table").collect()) == ["s1", "s21"]


def test_a_stream_goes_on_in_its_folder(spark, parts_dir, tmp_path):
    """Run, add a part, run again with the same folder: only the new part is read, and the result is the batch's."""
    import shutil

    src, root = str(tmp_path / "src"), str(tmp_path / "run")
    shutil.copytree(f"{parts_dir}/events.parquet", f"{src}/events.parquet")
    parts = sorted((tmp_path / "src" / "events.parquet").glob("part-*.parquet"))
    held = parts[-1].rename(tmp_path / "held.parquet")
    ST.run_latest(spark, src, root=root, files=1)
    held.rename(parts[-1])
    got = ST.run_latest(spark, src, root=root, files=1)
    want = E.queries()["latest_status"](spark, src)
    assert _rows(got.select(*want.columns)) == _rows(want)
    batches = len(list((tmp_path / "run" / "checkpoint" / "commits").glob("[0-9]*")))
    assert batches == len(parts)


def test_refresh_over_part_files_keeps_every_site(spark, parts_dir):
    root = ST.run_refresh(spark, parts_dir, files=1)
    gold = spark.read.parquet(f"{root}/gold")
    assert gold.filter("batch_id >= 0").select("batch_id").distinct().count() == 3
    want = E.queries()["er_pages_gold"](spark, parts_dir)
    assert gold.select(*ST.LIVE_KEY).distinct().count() == want.count()
    matches = KT.read_keyed(spark, f"{root}/matches", ST.LIVE_KEY)
    assert matches.select(*ST.LIVE_KEY).distinct().count() == matches.count()
