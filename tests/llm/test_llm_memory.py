"""What Python workers hold of texts: the counters of the sketch once, small blocks of text, small batches while staging."""

import tracemalloc
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from careflow.llm import hashing as H
from careflow.llm.common import STAGED_BATCH_ROWS, staged


def _peak(run) -> float:
    run()  # for modules that are loaded at first use
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / (8 << H.SKETCH_BITS)  # in arrays of all counters
    finally:
        tracemalloc.stop()


def test_sketch_holds_its_counters_once(monkeypatch):
    class Docs:
        def mapInArrow(self, count, ddl):
            self.count = count
            raise StopIteration

    docs, keys = Docs(), np.arange(300_000, dtype=np.uint64) << np.uint64(40)
    try:
        H.count_sketch(docs, lambda batches: (k for k in np.split(keys, 100)))
    except StopIteration:
        pass
    monkeypatch.setattr(H, "TaskContext", types.SimpleNamespace(get=lambda: types.SimpleNamespace(partitionId=lambda: 3)))
    found = []
    assert _peak(lambda: found.clear() or found.extend((b["shard"][0].as_py(), b["task"][0].as_py(), int(np.frombuffer(b["counts"][0].as_py(), np.int64).sum())) for b in docs.count(iter(())))) < 2
    assert [f[0] for f in found] == list(range(64)) and {f[1] for f in found} == {0} and sum(f[2] for f in found) == len(keys)


def test_hashing_holds_a_small_block():
    texts = pa.record_batch([pa.array(range(2000)), pa.array(["ab cde f " * 200] * 2000)], names=["doc", "text"])
    assert _peak(lambda: sum(len(w) for _, w in H.hashed_rows(iter([texts]), "doc"))) < 2.5


def test_staging_reads_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    sizes = lambda batches: (pa.record_batch([pa.array([b.num_rows])], names=["n"]) for b in batches)
    rows = staged(spark.range(0, 9000, 1, 2).mapInArrow(sizes, "n long"), "sizes").agg(F.max("n"), F.sum("n")).first()
    assert tuple(rows) == (STAGED_BATCH_ROWS, 9000) and spark.conf.get(key) == before
