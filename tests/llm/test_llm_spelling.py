"""Operator 13 against comparison of all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from llm_cases import documents

from careflow.llm import spelling_variants as sv


def near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_words(rows, length=6, least=5):
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= length and n >= least}


def plain_variants(words):
    out = {}
    for w, n in words.items():
        others = [(-m, o) for o, m in words.items() if near(w, o)]
        best = min(others, default=None)
        form = best[1] if best and -best[0] >= 5 * n else None
        out[w] = [w, form, None, n, len(others), words[form] if form else None]
    for w in out:
        root = w
        while out[root][1]:
            root = out[root][1]
        out[w][2] = root
    return {tuple(r) for r in out.values()}


def frame(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n long")


def misspelt(rnd, letters, size, longest=9):
    words = {}
    while len(words) < size:
        w = "".join(rnd.choice(letters) for _ in range(rnd.randrange(6, longest)))
        for _ in range(rnd.randrange(4)):
            words.setdefault(w, rnd.choice([5, 6, 30, 31, 200, 1500, 9000]))
            i = rnd.randrange(len(w))
            w = rnd.choice([w[:i] + w[i + 1 :], w[:i] + rnd.choice(letters) + w[i:], w[:i] + rnd.choice(letters) + w[i + 1 :]])
    return words


@pytest.mark.parametrize("letters,subtree,leaf", [("abm", 20_000, 6), ("abcdeéÉ", 20, 2), ("aehilnorstßÿ", 5, 1), ("al", 3, 6)])
def test_variants_equal_all_pairs(spark, monkeypatch, letters, subtree, leaf):
    monkeypatch.setattr(sv, "SUBTREE", subtree)
    monkeypatch.setattr(sv, "LEAF", leaf)
    words = misspelt(random.Random(len(letters)), letters, 500)
    assert {tuple(r) for r in sv.variants(frame(spark, words)).collect()} == plain_variants(words)


def test_every_pair_is_found_once(spark, monkeypatch):
    monkeypatch.setattr(sv, "SUBTREE", 10)
    words = misspelt(random.Random(8), "abcmno", 300)
    got = [tuple(r) for r in sv.near_words(frame(spark, words)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(a, b, words[b]) for a in words for b in words if near(a, b)}


def test_words_of_texts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sv, "COUNTED", 50)
    monkeypatch.setattr(sv, "BLOCK", 64)
    rnd = random.Random(4)
    vocabulary = ["Straße", "strasse", "Élève", "élèves", "general", "Generel", "GENERALS", "cafés", "abcdefĀghijkl", "x×y÷zuvw", "short", "worldwide"]
    rows = [(i, rnd.choice([" ", "1", "-", "\n", "_"]).join(rnd.choice(vocabulary) for _ in range(40))) for i in range(120)]
    rows += [(None, "general general"), (7, rows[7][1]), (500, None), (501, ""), (502, "q" * 1000 + " " + "longest" * 300)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    want = plain_words(rows)
    assert {r["word"]: r["n"] for r in sv.count_words(documents(spark, rows)).collect()} == want
    got = sv.op13_spelling_variants(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {tuple(r) for r in got.collect()} == plain_variants(want)
    assert any(r[1] for r in plain_variants(want))


def test_chains_ties_and_empty(spark):
    chain = {"a" * (6 + i): 5 * 6**i for i in range(12)}
    got = {r["word"]: r for r in sv.variants(frame(spark, chain)).collect()}
    assert all(r["root"] == "a" * 17 for r in got.values()) and got["a" * 17]["form"] is None
    tied = {"planed": 100, "planes": 100, "planet": 100, "plane": 0, "planex": 20, "planez": 21}
    tied.pop("plane")
    got = {r["word"]: r for r in sv.variants(frame(spark, tied)).collect()}
    assert (got["planex"]["form"], got["planex"]["n_near"]) == ("planed", 4) and got["planez"]["form"] is None
    assert sv.variants(frame(spark, {"x": 1}).filter("n > 1")).count() == 0
    long = {"ab" * 5000: 50, "ab" * 5000 + "a": 5, "ba" * 5000: 7}
    assert {tuple(r) for r in sv.variants(frame(spark, long)).collect()} == plain_variants(long)
