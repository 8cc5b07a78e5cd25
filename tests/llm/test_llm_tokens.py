"""Operators 9 and 10 against the public libraries."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import documents
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from careflow.llm import packing, token_counts

MODEL, WORDS = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "  a  b ", "a\nb\n\n c", "▁▁x ▁", "</s> <s><unk> <0x0A>", "é e\u0301 ²Ⅷ ½", "日本語 テスト 🎉🎉", "\x00\x1f\x7f", "a" * 700, "the " * 300, "don't it's. a..b ,., x_.", "İ. Σας ΑΣ. ß ẞ", "<|endoftext|> <|ENDOFTEXT|>."]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def test_counts_at_every_prefix_equal_the_library(library):
    c = token_counts.counter(MODEL)
    for text in [*ODD[:9], "Hello, world! Ünïcode  and\nlines 12345", "aaaaaaaaaaabbbbbbbb  ababab"]:
        assert c.prefix_counts(text) == [len(library.encode(text[:i])) for i in range(len(text) + 1)], text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abcdehinorst  \n▁,.é"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_random_texts_count_like_the_library(text):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert token_counts.counter(MODEL).total(text) == len(lib.encode(text))


def test_full_tables_change_no_count(library, monkeypatch):
    monkeypatch.setattr(token_counts, "CACHE_ENTRIES", 3)
    c = token_counts.PrefixCounter(MODEL)
    for text in ODD:
        assert c.total(text) == len(library.encode(text))


def test_count_query_and_limits(spark, library):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(100, None), (101, "a b c d e f"), (101, "a b c d e f"), (None, "x")]
    got = token_counts.token_counts(documents(spark, rows), MODEL, 5).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "")), n > 5) for i, t in rows]
    assert sorted(map(repr, [tuple(r)[:4] for r in got])) == sorted(map(repr, want))
    for r in got:
        t = dict(rows)[r["doc_id"]] or ""
        fits = [i for i in range(len(t) + 1) if i <= 800 and len(library.encode(t[:i])) <= 5]
        assert r["fits_chars"] == (len(t) if r["n_tokens"] <= 5 else max(fits))
    assert token_counts.token_counts(documents(spark, []), MODEL, 5).count() == 0


def test_prefix_table_answers_budgets(spark, library):
    rows = [(1, "Hello there, general reader of books"), (2, ""), (3, None)]
    t = token_counts.prefix_table(documents(spark, rows), MODEL)
    got = t.select("doc_id", token_counts.count_at(9).alias("n"), token_counts.truncated(4).alias("cut")).collect()
    by = {r["doc_id"]: r for r in got}
    assert by[1]["n"] == len(library.encode("Hello the")) and len(library.encode(by[1]["cut"])) <= 4
    assert len(library.encode(rows[0][1][: len(by[1]["cut"]) + 1])) > 4
    assert by[2]["n"] == 0 and by[2]["cut"] == ""


def test_word_ids_equal_the_library(monkeypatch):
    lib = Tokenizer.from_file(WORDS)
    for entries in (packing.CACHE_ENTRIES, 4):
        monkeypatch.setattr(packing, "CACHE_ENTRIES", entries)
        enc = packing.WordEncoder(WORDS)
        for text in [*ODD, "Word. WORD, word word,", " ".join(ODD)]:
            assert enc.ids([text])[0] == np.array(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abZ .,'\n\té\u0301İ<|_1"), st.characters(exclude_categories=["Cs"])), max_size=40))
def test_random_word_ids_equal_the_library(text):
    enc = packing._encoder(WORDS)
    assert enc.ids([text])[0] == np.array(enc.encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in rooms if r >= n]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - n)
        else:
            rooms.append(capacity - n)
    return len(rooms)


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_best_fit_by_falling_length(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice([rnd.randint(1, 40), 7, 40]) for _ in range(rnd.randint(0, 400))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    rows, fill = packing.plan(histogram, 40), {}
    for n in histogram:
        mine = sorted(r[1:3] for r in rows if r[0] == n)
        assert [a for a, _ in mine] == [sum(c for _, c in mine[:i]) for i in range(len(mine))] and sum(c for _, c in mine) == histogram[n]
    for n, _, many, seq, per, at in rows:  # plan rows come in order, so each starts where the sequence is filled to
        for k in range(many):
            assert fill.get(seq + k // per, 0) == at + k % per * n
            fill[seq + k // per] = at + (k % per + 1) * n
    assert max(fill.values(), default=0) <= 40 and len(fill) == best_fit(lengths, 40)


def test_packing_round_trip(spark):
    lib = Tokenizer.from_file(WORDS)
    rnd = random.Random(1)
    rows = [(i, " ".join(rnd.choice(["alpha", "beta.", "Gamma,", "δ", "42"]) for _ in range(rnd.randint(0, 30)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, "word " * 500), (203, "same"), (203, "same"), (None, "no id")] + [(300 + i, "a b c") for i in range(60)]
    got = packing.pack_documents(documents(spark, rows), 16).collect()
    want = []
    for i, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, a // 16, a, len(p := ids[a : a + 16]), zlib.crc32(p.tobytes())) for a in range(0, len(ids), 16)]
    assert sorted(map(repr, ((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got))) == sorted(map(repr, want))
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 16
    assert len(by) == best_fit([w[3] for w in want], 16)
    assert packing.pack_documents(documents(spark, []), 16).count() == 0


def test_packing_by_shuffled_slots(spark, monkeypatch):
    monkeypatch.setattr(packing, "BROADCAST_PLAN_ROWS", 0)
    got = packing.pack_documents(documents(spark, [(i, "a b c d"[: i % 8]) for i in range(50)]), 8)
    assert got.count() == got.select("sequence_id", "offset").distinct().count() == 50
    assert got.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 8


def test_letters_that_composing_takes_apart_get_the_library_ids():
    lib, enc = Tokenizer.from_file(WORDS), packing.WordEncoder(WORDS)
    words = [c + m for c in ("হয়", "কक़", "ਲ਼", "שׁ", "aפֿ", "é", "각") for m in (".", ",", "")]
    for text in [*words, " ".join(words)]:
        assert enc.ids([text])[0] == np.array(lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text
