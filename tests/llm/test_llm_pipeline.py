"""The pipeline against its stages in plain Python, and the library without this subpackage."""

import os
import random
import shutil
import subprocess
import sys
import zlib

import corpus_pipeline
import numpy as np
import pytest
from conftest import ROOT
from llm_cases import components, documents, removed, words
from pyspark.sql import functions as F

from careflow.llm import langid, packing

VOICES = {"xx": ["bala", "mora", "tesi", "luna", "pero", "sina"], "yy": ["grunk", "ptah", "klem", "vrost", "dwelk", "brund"]}


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    rnd = random.Random(5)
    prose = lambda v, n: [rnd.choice(VOICES[v]) + str(rnd.choice("aeiou")) * rnd.randint(0, 2) for _ in range(n)]
    item, passage = prose("xx", 20), prose("yy", 60)
    rows = []
    for i in range(40):
        v = rnd.choice(list(VOICES))
        text = prose(v, rnd.randint(20, 120))
        if i % 7 == 0:
            text[5:5] = passage
        if i % 11 == 0:
            text[9:9] = item
        rows.append((i, " ".join(text), v))
        if i % 5 == 0:
            copy = list(text)
            copy[-1] = "changed"
            rows.append((100 + i, " ".join(copy), v))
    rows += [(300, None, None), (301, "", "xx"), (302, "12 34", "xx"), (303, " ".join(passage), "yy"), (304, " ".join(passage), "yy"), (305, "a short one", None), (0, rows[0][1], "xx")]
    path = str(tmp_path_factory.mktemp("sf"))
    documents(spark, rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(item)), (2, "not to be found in any of these documents at all")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, " ".join(item)


def test_pipeline_equals_plain_python(spark, fixture):
    path, rows, item = fixture
    docs = spark.read.parquet(f"{path}/documents.parquet")
    model = langid.train(docs)
    judged = langid.predict(docs, model).collect()
    rejected = {r["doc_id"] for r in judged if r["lang_pred"] == "und" or r["score"] < corpus_pipeline.MIN_LANGUAGE_SCORE}
    assert rejected == {300, 301, 302}
    left = {i: t for i, t, _ in rows if i not in rejected}
    comp = components(list(left.items()))
    left = {i: t for i, t in left.items() if comp[i] == i}
    gone = removed(list(left.items()), 50)
    left = {i: " ".join(w for w, g in zip(words(t), cut) if not g) for (i, t), cut in zip(list(left.items()), gone)}
    left = {i: t for i, t in left.items() if t}
    windows = lambda t: {tuple(w[a : a + 8]) for w in [words(t)] for a in range(len(w) - 7)}
    need = windows(item)
    left = {i: t for i, t in left.items() if len(windows(t) & need) < 0.5 * len(need)}
    enc = packing._encoder(packing.public_tokenizers.path("word_bpe_49k.json"))
    want = []
    for i, t in left.items():
        ids = np.frombuffer(enc.ids([t])[0] + bytes(4), "<u4")
        want += [(i, a // 2048, len(p := ids[a : a + 2048]), zlib.crc32(p.tobytes())) for a in range(0, len(ids), 2048)]
    got = corpus_pipeline.run(spark, path)
    assert sorted((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in got.collect()) == sorted(want)
    assert 0 < len(left) < len({i for i, *_ in rows}) - 12


def test_stages_keep_the_columns_and_clean_documents(spark, fixture):
    path, *_ = fixture
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).schema.names == docs.columns
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, path).count() == 0


CLASHING = ["score", "lang_pred", "_row", "_k", "_id", "_text", "_doc", "_gone", "row", "doc", "_carry_0", "item", "kept_sha256", "n_words", "n_removed"]


def test_further_columns_keep_their_values_whatever_their_names(spark, fixture):
    """Columns that are called like those which stages use inside pass with their values, whole texts and all."""
    path, *_ = fixture
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    named = docs.select("*", *(F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string")).alias(c) for c in CLASHING))
    long = docs.limit(1).select(F.lit(10**6).cast("long").alias("doc_id"), F.repeat(F.lit("bala mora tiko "), 60_000).alias("text"), "lang", "source", F.lit(1).cast("long").alias("n_chars"))
    named = named.unionByName(long.select("*", *(F.lit(f"{c}-1000000").alias(c) for c in CLASHING)))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, named, path)
        assert out.columns == named.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}-{r['doc_id']}" for r in rows for c in CLASHING if r["doc_id"] is not None)


def test_rows_without_id_pass_dedup(spark, fixture):
    path, *_ = fixture
    text = " ".join(f"w{i}" for i in range(80))
    docs = documents(spark, [(None, text), (4, text), (4, text)])
    for stage in (corpus_pipeline.near_duplicates, corpus_pipeline.substring_dedup_stage):
        kept = [(r["doc_id"], r["text"]) for r in stage(spark, docs, path).collect()]
        assert kept.count((None, text)) == 1 and kept.count((4, text)) == (1 if stage is corpus_pipeline.near_duplicates else 2)


def test_the_rest_imports_without_this_subpackage(tmp_path):
    for name in ("careflow", "__spark_entry__.py"):
        src = os.path.join(ROOT, name)
        (shutil.copytree if os.path.isdir(src) else shutil.copy)(src, tmp_path / name, **({"ignore": shutil.ignore_patterns("llm", "__pycache__")} if os.path.isdir(src) else {}))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q), q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_all_queries_are_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "n-gram Jaccard join", "substring dedup", "benchmark decontamination", "best-fit packing"]


def test_language_stage_keeps_documents_without_a_model(spark):
    rows = [(1, "bala mora"), (2, None), (3, "12 34 !!"), (4, "日本")]
    assert sorted(r["doc_id"] for r in corpus_pipeline.language_id(spark, documents(spark, rows), "").collect()) == [1, 4]


def test_many_languages_reject_no_short_document(spark):
    rows = [(100 + 12 * i + j, f"{a}{b}{a} {b}{a}{a}{i}", a + b) for i in range(9) for j, (a, b) in enumerate(zip("abcdefghijkl", "mnopqrstuvwx"))]
    short = [(i, t) for i, t in enumerate(["y", "z yz", "zz", "ö"])]
    kept = {r["doc_id"] for r in corpus_pipeline.language_id(spark, documents(spark, rows + short), "").collect()}
    assert kept == {r[0] for r in rows + short}


def test_language_decides_what_is_packed_together(spark, fixture):
    """The predicted language, not the given one, goes on: unlabelled rows get one, and no sequence mixes two."""
    path, rows, _ = fixture
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {r["doc_id"]: r["lang"] for r in corpus_pipeline.language_id(spark, docs, path).collect()}
    assert kept[305] in VOICES and set(kept.values()) == set(VOICES)
    out = corpus_pipeline.run(spark, path).collect()
    by_sequence: dict[int, set] = {}
    for r in out:
        by_sequence.setdefault(r["sequence_id"], set()).add(kept[r["doc_id"]])
    assert {frozenset(s) for s in by_sequence.values()} == {frozenset([v]) for v in VOICES}
    assert all(r["lang"] == kept[r["doc_id"]] for r in out)


def test_groups_are_packed_apart_and_gapless(spark):
    rows = [(i, 0, 0, 1 + i * 37 % 90, i, [None, "", "a", "b"][i % 4]) for i in range(200)]
    parts = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long, lang string")
    sequences: dict[int, list] = {}
    for r in packing.pack(parts, 100, group_col="lang").collect():
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"], r["lang"]))
    assert sum(map(len, sequences.values())) == 200
    for some in sequences.values():
        assert len({lang for *_, lang in some}) == 1 and sum(n for _, n, _ in some) <= 100
        assert all(at == sum(n for _, n, _ in sorted(some)[:k]) for k, (at, *_) in enumerate(sorted(some)))
