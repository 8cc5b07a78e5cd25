"""Operator 2: held-out accuracy, the kernel against sets, and odd rows."""

import random

import numpy as np
from conftest import SF_CHECK
from llm_cases import documents

from careflow.llm import langid

VOICES = {"xx": ["bala", "mora", "tesi"], "yy": ["grunk", "ptah", "klem"], "zz": ["ööli", "üvä", "äni"]}


def corpus(n=150, seed=3):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(VOICES[v]) for _ in range(rnd.randint(1, 12))), v) for i in range(n) for v in [rnd.choice(list(VOICES))]]


def grams(text, n=3):
    s = " " + langid._NO_LETTERS.sub(" ", text.lower()).strip() + " "
    return {s[i : i + k] for k in range(1, n + 1) for i in range(len(s) - k + 1)}


def test_kernel_is_the_cosine_of_ngram_sets():
    rows = corpus()
    texts = [t for _, t, _ in rows]
    model = langid.fit(texts, [v for *_, v in rows], landmarks=20)
    want = [[len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b))) for b in texts[:20]] for a in texts[:40]]
    assert np.allclose(model.kernel(texts[:40]), want, atol=1e-5)


def test_held_out_accuracy(spark):
    rows = langid.op2_language_id(spark, SF_CHECK).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_CHECK}/documents.parquet").select("doc_id", "lang").collect()}
    judged = [r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"] and truth[r["doc_id"]]]
    assert len(rows) == len(truth) and len(judged) > 250 and np.mean(judged) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_odd_rows_and_inputs_never_read(spark):
    rows = corpus()
    model = langid.fit([t for _, t, _ in rows], [v for *_, v in rows])
    odd = [(1, None), (2, ""), (3, "12 34 !!"), (4, "bala mora", "yy"), (4, "bala mora", None), (None, "klem ptah " * 5000), (6, "日本 bala mora tesi")]
    got = langid.predict(documents(spark, odd), model, carry=("source", "n_chars")).collect()
    pred = [(r["doc_id"], r["lang_pred"]) for r in got]
    assert pred == [(1, "und"), (2, "und"), (3, "und"), (4, "xx"), (4, "xx"), (None, "yy"), (6, "xx")]
    assert got[0]["score"] == 0.0 and got[3]["score"] == got[4]["score"] and got[5]["n_chars"] == 50000
    assert langid.predict(documents(spark, []), model).count() == 0


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "bala"), (2, None)])
    assert langid.train(docs) is None
    assert [r["lang_pred"] for r in langid.predict(docs, None).collect()] == ["und", "und"]


def test_sample_is_bounded_and_stratified(spark):
    rows = [(i, "bala mora", "xx") for i in range(300)] + [(1000 + i, "klem ptah", "yy") for i in range(7)] + [(2000, "b" * 30_000, "zz"), (2001, "1 2", "zz"), (2002, None, "zz")]
    texts, langs = langid.training_sample(documents(spark, rows), rows=40)
    assert len(texts) == 40 and langs.count("yy") == 7 and "zz" not in langs and langs[:2] in (["xx", "yy"], ["yy", "xx"])


def test_large_alphabets_keep_the_order(monkeypatch):
    rows = [(f"{chr(0x4E00 + 7 * i)}{chr(0x4E01 + 7 * i)} bala mora{chr(0x4E02 + 7 * i)}", "xx" if i % 2 else "yy") for i in range(200)]
    texts = [t for t, _ in rows]
    model = langid.fit(texts, [v for _, v in rows], landmarks=150)
    want = [[len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b))) for b in texts[:150]] for a in texts[:40]]
    assert model.n == 3 and model.column is None and np.allclose(model.kernel(texts[:40]), want, atol=1e-5)
    small = corpus()
    before = langid.fit([t for _, t, _ in small], [v for *_, v in small]).decide([t for _, t, _ in small])
    monkeypatch.setattr(langid, "MAX_CODES", 0)
    after = langid.fit([t for _, t, _ in small], [v for *_, v in small]).decide([t for _, t, _ in small])
    assert before[0] == after[0] and np.allclose(before[1], after[1], atol=1e-5)


def test_each_language_has_a_landmark():
    rows = [("bala mora", "xx"), ("mora tesi", "xx"), ("bala tesi", "xx"), ("λογος και", "zz"), ("και λογος", "zz")]
    model = langid.fit([t for t, _ in rows], [v for _, v in rows], landmarks=2)
    assert model.landmarks.shape[1] == 3 and model.decide(["λογος", "tesi"])[0] == ["zz", "xx"]
