"""C10 with a large keyword table: the q-gram index against one test a keyword."""

import random

from careflow.operators import rules as RU

MAIN = "keyword string, language string, flag_label string, severity_weight int"
SCORED = "keyword_id string, normalized_phrase string, severity_class string, active_flag boolean"


def texts(spark, rnd, n, words):
    rows = [(f"i{i}", " ".join(rnd.choice(words) for _ in range(rnd.randrange(12))) if i % 17 else None) for i in range(n)]
    return spark.createDataFrame(rows + [("long", "ab " * 3000 + "chest pain")], "intake_session_id string, raw_text string")


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_index_equals_one_test_a_keyword(spark, monkeypatch):
    rnd = random.Random(3)
    words = ["chest", "pain", "hest pa", "fièvre", "ab", "abc", "abcd", "x", "", "a", "toux", "bleeding", "bleed"]
    phrases = [*words, "chest pain", "pain chest", "fievre toux", "ab ab", "b a", " ", None, "never there", "x", "abc abcd"]
    main = spark.createDataFrame([(p, "en", rnd.choice(["f1", "f2", None]), rnd.choice([1, 2, 5])) for p in phrases], MAIN)
    scored = spark.createDataFrame([(f"k{i}", p, rnd.choice(["strong_emergency", "serious_concern", "mild_concern"]), i % 5 != 0) for i, p in enumerate(phrases)], SCORED)
    t = texts(spark, rnd, 120, words)
    want = rows(RU.keyword_flags_main(t, main)), rows(RU.keyword_flags_scored(t, scored))
    monkeypatch.setattr(RU, "MAX_KEYWORDS", 3)
    got = RU.keyword_flags_main(t, main), RU.keyword_flags_scored(t, scored)
    assert (rows(got[0]), rows(got[1])) == want and len(want[0]) == 121


def test_a_hundred_thousand_phrases(spark):
    rnd = random.Random(5)
    syllables = ["ka", "lo", "mi", "ten", "ru", "sho", "vex", "pi", "dan", "ur"]
    word = lambda: "".join(rnd.choice(syllables) for _ in range(rnd.randrange(2, 5)))
    phrases = list({f"{word()} {word()}" for _ in range(130_000)})[:100_000]
    keywords = spark.createDataFrame([(p, "en", p[:2], 1) for p in phrases], MAIN)
    some = [" ".join(rnd.choice(phrases) if rnd.random() < 0.2 else word() for _ in range(8)) for _ in range(60)]
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(some)], "intake_session_id string, raw_text string")
    got = {r["intake_session_id"]: r["keyword_hits"] for r in RU.keyword_flags_main(df, keywords).collect()}
    assert got == {str(i): sum(p in t for p in phrases) for i, t in enumerate(some)} and max(got.values()) > 1
