"""E5 numbering against a plain sort, and how evenly a hot facility's rows are dealt."""

import datetime as dt
import random
from collections import defaultdict

import pytest

from careflow.operators import queue as QU

REQ = "request_id string, facility_id string, created_at timestamp_ntz, arrival_window_start timestamp_ntz, arrival_window_end timestamp_ntz"
QUEUE = "facility_id string, queue_status string, queue_position int"
T = dt.datetime(2024, 1, 1)


def plain(rows, base):
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append(r)
    out = {}
    for f, mine in by.items():
        for i, r in enumerate(sorted(mine, key=lambda r: (r[2] is None, r[2] or T, r[0]))):
            p = base.get(f, 1) + i
            out[r[0]] = (p, r[3] + dt.timedelta(minutes=12 * p))
    return out


@pytest.mark.parametrize("hot_time", [T, None])
def test_a_hot_facility_is_dealt_evenly(spark, monkeypatch, hot_time):
    rnd = random.Random(2)
    rows = []
    for i in range(20_000):
        hot = i % 10 != 0
        f = "hot" if hot else rnd.choice(["a", "b", None, "z"])
        at = hot_time if hot and hot_time is None else T + dt.timedelta(minutes=rnd.randrange(60) if hot else rnd.randrange(9000))
        rows.append((f"r{i:06d}", f, at if rnd.random() > 0.01 else None, T, T + dt.timedelta(hours=1)))
    queue = spark.createDataFrame([("hot", "reserved", 40), ("hot", "completed", 90), ("a", "called", 3)], QUEUE)
    kept = {}
    stage = QU.staged
    monkeypatch.setattr(QU, "staged", lambda df, label: kept.setdefault(label, stage(df, label)))
    got = {r["request_id"]: (r["queue_position"], r["estimated_call_time"]) for r in QU.assign_positions(spark.createDataFrame(rows, REQ), queue).collect()}
    assert got == plain(rows, {"hot": 41, "a": 4})
    sizes = sorted(r["count"] for r in kept["positions"].groupBy("_part").count().collect())
    assert len(sizes) >= 8 and sizes[-1] < 2 * sizes[len(sizes) // 2]


def test_batches_of_a_partition_go_on_counting():
    import pyarrow as pa

    class Task:
        def partitionId(self):
            return 3

    batches = [pa.RecordBatch.from_pydict({"facility_id": pa.array(x, pa.string())}) for x in (["a", "a"], ["a"], [], ["a", "b", "b"], ["b", None, None], [None])]
    old = QU.TaskContext.get
    QU.TaskContext.get = staticmethod(lambda: Task())
    try:
        out = [b.to_pydict() for b in QU._numbered(iter(batches))]
    finally:
        QU.TaskContext.get = old
    assert [n for b in out for n in b["_rn"]] == [1, 2, 3, 4, 1, 2, 3, 1, 2, 3] and {p for b in out for p in b["_part"]} == {3}
