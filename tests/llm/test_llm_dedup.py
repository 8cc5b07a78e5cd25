"""Operators 3 and 8 against brute force over all pairs and windows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from llm_cases import components, documents, removed, shingle_set, words

from careflow.llm import components as cc
from careflow.llm import hashing, jaccard_join, substring_dedup


def shared_passages(seed):
    rnd = random.Random(seed)
    w = lambda n: [rnd.choice("ab cd ef gh ij kl mn op qr st".split()) for _ in range(n)]
    passages = [w(rnd.randint(4, 18)) for _ in range(5)]
    rows = []
    for i in rnd.sample(range(1000), 60):
        text = []
        for _ in range(rnd.randint(0, 4)):
            text += w(rnd.randint(0, 7)) + (rnd.choice(passages) if rnd.random() < 0.6 else [])
        rows.append((i, "\n ".join(text)))
    return rows + [(rows[0][0], rows[0][1]), (2000, None), (2001, ""), (2002, rows[5][1]), (2003, rows[5][1]), (None, rows[6][1]), (2004, " ".join(w(3000)))]


@pytest.mark.parametrize("seed,hot", [(1, False), (2, False), (3, True)])
def test_spans_equal_brute_force(spark, monkeypatch, seed, hot):
    if hot:  # every anchor takes the salted way
        monkeypatch.setattr(substring_dedup, "hot_counters", lambda s: s > 0)
    rows = shared_passages(seed)
    got = substring_dedup.dedup(documents(spark, rows), span=6, k=2, carry=("source", "doc", "h")).collect()
    want = []
    for (i, t), gone in zip(rows, removed(rows, 6)):
        left = [w for w, g in zip(words(t), gone) if not g]
        want.append((i, len(gone), sum(gone), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    assert sorted(map(repr, (tuple(r)[:4] for r in got))) == sorted(map(repr, want)) and sum(w[2] for w in want) > 100
    whole = {(i, hashlib.sha256(" ".join(words(t)).encode()).hexdigest()): t for i, t in rows}
    for r in got:
        assert hashlib.sha256(" ".join(words(r["text"])).encode()).hexdigest() == r["kept_sha256"] and r["h"] == 7
        assert r["n_removed"] or r["text"] == whole[r["doc_id"], r["kept_sha256"]]


def test_spans_of_an_empty_table(spark):
    assert substring_dedup.dedup(documents(spark, [])).count() == 0


def test_cut_keeps_the_blanks_of_what_stays():
    assert substring_dedup._cut("a  b\nc d\te", ["a", "b", "c", "d", "e"], np.array([0, 1, 1, 0, 0], bool)) == "a d\te"


def near_copies(seed):
    rnd = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    common = [rnd.choice(vocabulary) for _ in range(9)]
    rows = []
    for _ in range(25):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 6, 12, 40, 80]))] + (common if rnd.random() < 0.5 else [])
        for _ in range(rnd.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 25))):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            if rnd.random() < 0.2:
                copy += copy[: rnd.randint(0, 5)]
            rows.append(" ".join(copy).upper() if rnd.random() < 0.1 else "\t".join(copy))
    ids = rnd.sample(range(5000), len(rows))
    return list(zip(ids, rows)) + [(6000, None), (6001, " \n"), (6002, rows[0]), (6003, "one two"), (6004, "One TWO"), (6005, "two one")]


@pytest.mark.parametrize("seed,hot", [(1, False), (2, False), (3, True)])
def test_components_equal_brute_force(spark, monkeypatch, seed, hot):
    if hot:  # shingles of two documents count as frequent already
        monkeypatch.setattr(jaccard_join, "FREQUENT", (2, 4))
    rows = near_copies(seed)
    got = jaccard_join.components(documents(spark, rows)).collect()
    want = components(rows)
    assert {r["doc"]: r["component_id"] for r in got} == want and len(set(want.values())) < len(want) - 20
    assert {r["doc"]: r["n"] for r in got} == {i: len(shingle_set(t)) for i, t in rows}


def test_rows_without_id_and_repeated_rows(spark):
    text = "a b c d e f g h"
    got = jaccard_join.components(documents(spark, [(5, text), (5, text), (3, text), (None, text), (9, None)])).collect()
    assert sorted(map(repr, ((r["doc"], r["component_id"]) for r in got))) == sorted(map(repr, [(5, 3), (5, 3), (3, 3), (None, None), (9, 9)]))
    assert jaccard_join.components(documents(spark, [])).count() == 0


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(0)
    for _ in range(200):
        common = rng.integers(0, 1 << 63, rng.integers(1, 300), dtype=np.uint64)
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, rng.integers(0, 200), dtype=np.uint64)])) for _ in range(2))
        apart = jaccard_join.bits_apart(jaccard_join.parity_bits(a), jaccard_join.parity_bits(b))
        assert apart <= np.setxor1d(a, b).size and apart == jaccard_join.bits_apart(jaccard_join.parity_bits(b), jaccard_join.parity_bits(a))


def test_a_chain_of_links_is_one_component(spark):
    """Ends share too little, but each neighbour links: nothing but the second round connects other leaders."""
    seq = ["x%d" % i for i in range(140)]
    rows = [(900 - k, " ".join(seq[5 * k : 5 * k + 60])) for k in range(12)]
    assert {r["doc"]: r["component_id"] for r in jaccard_join.components(documents(spark, rows)).collect()} == components(rows)


def test_prefixes_are_long_enough():
    for n in range(1, 400):
        for m in range(-(-3 * n // 4), 4 * n // 3 + 1):
            need = -(-3 * (n + m) // 7)
            assert jaccard_join.prefix_length(n) >= n - need + 1


def test_star_steps_find_long_paths(spark):
    n = 60
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (103, 101), (7, 7)], "u long, v long")
    got = {r["u"]: r["v"] for r in cc.roots(links).collect()}
    assert got == {**{i: 0 for i in range(1, n + 1)}, 101: 100, 103: 100}


def test_span_hashes_do_not_depend_on_place():
    w = hashing.word_hashes("a b c d e a b c x a b")
    s = hashing.Spans(w)
    at = lambda i, n: int(s.hash(np.array([i]), n)[0])
    assert at(0, 3) == at(5, 3) != at(1, 3) and at(0, 2) == at(9, 2) and hashing.rolling(w, 3)[0] == hashing.rolling(w, 3)[5]


@pytest.mark.parametrize("block", [1 << 20, 16])
def test_word_hashes_follow_the_words(monkeypatch, block):
    """Rows of a batch, long texts in blocks, nulls, slices: equal words hash alike and others do not."""
    import pyarrow as pa

    monkeypatch.setattr(hashing, "BLOCK_BYTES", block)
    texts = ["a b c", "", None, "  a\tb\n", "é É a\x1fb ab", "x" * 50 + " a " + "y" * 40, "A b C \u00a0z", "b", " ", "c a"] * 3
    batch = pa.record_batch([pa.array(texts), pa.array(range(len(texts)))], names=["text", "i"])
    for part in (batch, batch.slice(3, 20)):
        seen = {}
        for i, w in hashing.hashed_rows(iter([part]), "i"):
            mine = words(texts[i])
            assert len(w) == len(mine)
            for x, y in zip(mine, w.tolist()):
                assert seen.setdefault(x, y) == y
        assert len(set(seen.values())) == len(seen) == 12
    folded = dict(zip("A a B b É é".split(), hashing.word_hashes("A a B b É é", fold=True).tolist()))
    assert folded["A"] == folded["a"] != folded["B"] == folded["b"] and folded["É"] != folded["é"]


def passage_documents(n):
    """n documents of 200 words of their own around one passage of 60 words."""
    rnd = random.Random(9)
    own = lambda i: [f"w{i}x{rnd.randrange(10**6)}" for _ in range(100)]
    passage = [f"p{k}" for k in range(60)]
    return [(i, " ".join(own(i) + passage + own(i))) for i in range(n)], passage


def test_shingles_of_a_shared_passage_are_frequent(spark):
    rows, passage = passage_documents(40)
    docs = documents(spark, [*rows, (90, None), (91, "p1 p2")]).select(F.col("doc_id").alias("doc"), "text", F.xxhash64("text").alias("row"))
    got = {r["k"]: r["n"] for r in jaccard_join.frequent_shingles(docs, 5).collect()}
    assert got == dict.fromkeys(jaccard_join.shingles(" ".join(passage)).view(np.int64).tolist(), 40)


def test_a_shared_passage_makes_no_long_lists(spark, monkeypatch):
    kept = {}
    stage = jaccard_join.staged
    monkeypatch.setattr(jaccard_join, "staged", lambda df, label: kept.setdefault(label, stage(df, label)) if label in ("postings", "open") else stage(df, label))
    rows, _ = passage_documents(120)
    found = {r["doc"]: r["component_id"] for r in jaccard_join.components(documents(spark, rows)).collect()}
    assert found == {i: i for i, _ in rows}
    assert kept["postings"].count() == 0 and kept["open"].count() == 0


def test_key_mask_holds_every_key(spark):
    mask = hashing.key_mask(spark.range(1, 2000).select((F.col("id") * 7919 - 9_000_000).alias("k")))
    keys = np.arange(1, 2000) * 7919 - 9_000_000
    assert hashing.in_mask(mask, keys).all() and hashing.in_mask(mask, keys + 1).mean() < 0.01
    assert len(mask) == 1 << 17 and len(hashing.key_mask(spark.range(200_000).select(F.col("id").alias("k")))) == 1 << 19
    assert not hashing.key_mask(spark.range(0).select(F.col("id").alias("k"))).any()


def test_sketch_counts_bound_every_key(spark):
    docs = documents(spark, [(i, "a b c" if i % 3 else "q%d r s" % i) for i in range(90)]).repartition(7)

    def keys(batches):
        for b in batches:
            for t in b.column("text").to_pylist():
                yield hashing.word_hashes(t)

    sketch = hashing.count_sketch(docs.select("text"), keys)
    at = hashing.counter_of(hashing.word_hashes("a r"))
    assert sketch.sum() == 270 and sketch[at[0]] >= 60 and sketch[at[1]] >= 30


def test_only_listed_texts_are_shuffled(spark):
    """Texts without a repeated window are judged where they are read: a mask leaves few others to the joins."""
    docs = spark.range(2000).select(F.when(F.col("id") > 0, F.col("id")).alias("doc"), (F.col("id") * 7).alias("row"), F.lit("a b").alias("text"))
    listed = docs.filter("doc % 100 = 0")
    kept = {r["doc"] for r in substring_dedup.listed_texts(docs, substring_dedup._text_mask(listed)).collect()}
    assert kept >= {r["doc"] for r in listed.collect()} and len(kept) < 40
