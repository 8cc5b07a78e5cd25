"""Operators 1 and 6: literal cases."""

import pytest
from llm_cases import documents

from careflow.llm import decontaminate, license_scan

QUESTION = "If Alice has 12 red apples and gives Bob 5 apples each day, how many apples does Alice keep after 3 days?"


def leaks(spark, rows, items=((1, QUESTION),), **kw):
    bench = spark.createDataFrame([(i, t, 7) for i, t in items], "item_id long, text string, h long")
    found = decontaminate.leaks(documents(spark, rows), bench, **kw).collect()
    return sorted((r["doc"], r["item"]) for r in found)


def test_other_numbers_and_names_still_leak(spark):
    twin = "If Carol has 40 red apples and gives Dave 7 apples each day, how many apples does Carol keep after 9 days?"
    assert leaks(spark, [(10, "Intro words here. " + twin + " And more."), (11, "  " + QUESTION.upper().replace(" ", "\n")), (12, "Nothing of that kind is in here, not one of the eight word windows.")]) == [(10, 1)]
    assert leaks(spark, [(11, QUESTION.replace(" ", "\n\t"))]) == [(11, 1)]


def test_slots_must_be_consistent(spark):
    item = "the train takes 12 hours to go and then another 12 hours to come back home again"
    same = "the train takes 30 hours to go and then another 30 hours to come back home again"
    torn = "the train takes 30 hours to go and then another 31 hours to come back home again"
    assert leaks(spark, [(1, same), (2, torn)], [(5, item)]) == [(1, 5)]


def test_units_are_typed(spark):
    item = "a pipe of 12 km length was laid along the river by the town"
    assert leaks(spark, [(1, item.replace("12 km", "7 miles")), (2, item.replace("12 km", "7 red"))], [(5, item)], min_share=0.9) == [(1, 5)]


def test_lists_of_numbers_are_no_template(spark):
    assert leaks(spark, [(1, "1 2 3 4 5 6 7 8 9 10")], [(5, "11 12 13 14 15 16 17 18 19 20")]) == []


def test_odd_rows(spark):
    rows = [(None, QUESTION), (2, None), (3, ""), (4, "short"), (5, QUESTION), (5, QUESTION), (6, "filler word " * 6000 + QUESTION)]
    bench = spark.createDataFrame([(9, QUESTION, 1), (3, QUESTION, 2), (4, None, 3), (5, "too short", 4)], "item_id long, text string, doc long")
    got = [(r["doc"], r["item"], r["n_matched"] <= r["n_windows"]) for r in decontaminate.leaks(documents(spark, rows), bench).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(None, 3, True), (5, 3, True), (6, 3, True)]))
    assert decontaminate.leaks(documents(spark, []), bench).count() == 0
    assert decontaminate.leaks(documents(spark, rows), bench.limit(0)).count() == 0


@pytest.mark.parametrize("literals", [0, 20_000])
def test_shuffled_windows_give_the_same(spark, monkeypatch, literals):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    monkeypatch.setattr(decontaminate, "LITERAL_WINDOWS", literals)
    assert leaks(spark, [(1, "so " + QUESTION)]) == [(1, 1)]


def scan(spark, rows):
    notices = spark.createDataFrame(license_scan.NOTICES, "license string, text string")
    return {(r["doc"], r["license"]): r for r in license_scan.scan(documents(spark, rows), notices).collect()}


def test_notices_are_found_in_any_place(spark):
    filler = " ".join("word%d" % i for i in range(300))
    rows = [(i, filler[: 7 * i] + " " + text.upper().replace(" ", "\n") + " " + filler) for i, (_, text) in enumerate(license_scan.NOTICES)]
    rows += [(100 + i, text) for i, (_, text) in enumerate(license_scan.NOTICES)] + [(200, filler), (201, "released under the license of")]
    got = scan(spark, rows)
    inside = {"MIT-text": "MIT-grant", "ISC-text": "ISC-grant", "BSD-3-Clause-text": "BSD-clause"}  # whole texts hold their first notice
    want = {(at + i, m) for at in (0, 100) for i, (n, _) in enumerate(license_scan.NOTICES) for m in (n, inside.get(n)) if m}
    assert set(got) == want
    names = [n for n, _ in license_scan.NOTICES]
    assert all(r["containment"] == 1.0 for (doc, n), r in got.items() if names[doc % 100] == n)


def test_license_odd_rows(spark):
    line = "Released under the MIT License."
    got = scan(spark, [(1, None), (2, ""), (3, "MIT"), (None, line), (5, line), (5, line), (6, "a " * 20000 + line + " b" * 300)])
    assert set(got) == {(None, "MIT"), (5, "MIT"), (6, "MIT")} and 19990 <= got[6, "MIT"]["first_word"] <= 20000
    assert not scan(spark, [])


def test_templates_of_any_length_are_found(spark):
    text = lambda k, n: " ".join(f"w{k}x{i * i % 997}y{i % 89}" for i in range(n))
    templates = spark.createDataFrame([("short", "all rights go"), ("T400", text(1, 400)), ("T3000", text(2, 3000)), ("torn", text(3, 500))], "license string, text string")
    torn = " ".join(w if i % 40 else "q" for i, w in enumerate(text(3, 500).split()))
    rows = [(1, text(1, 400)), (2, "a " * 7001 + text(2, 3000) + " b" * 500), (3, torn), (4, text(1, 300)), (5, text(2, 1500) + " z " + text(1, 400))]
    got = {(r["doc"], r["license"]): (r["first_word"], r["containment"]) for r in license_scan.scan(documents(spark, rows), templates).collect()}
    assert set(got) == {(1, "T400"), (2, "T3000"), (3, "torn"), (5, "T400")}
    assert got[1, "T400"] == (0, 1.0) and got[2, "T3000"][1] == 1.0 and 5000 <= got[2, "T3000"][0] <= 7001 and got[3, "torn"][1] < 0.95


def test_many_templates_are_scanned_for_in_passes(spark, monkeypatch):
    monkeypatch.setattr(license_scan, "MAX_TEMPLATES", 5)
    templates = [(f"L{i}", f"the terms of license number n{i} apply here") for i in range(23)]
    rows = [(i, f"see {text} now") for i, (_, text) in enumerate(templates)]
    got = license_scan.scan(documents(spark, rows), spark.createDataFrame(templates, "license string, text string"))
    best = {}
    for r in got.filter("containment = 1").collect():
        best.setdefault(r["doc"], []).append(r["license"])
    assert best == {i: [f"L{i}"] for i in range(23)}


def test_close_wording_counts_by_containment(spark):
    grant = dict(license_scan.NOTICES)["MIT-grant"]
    near = grant.replace("a copy", "one copy")
    far = " ".join(w for i, w in enumerate(grant.split()) if i % 3)
    got = scan(spark, [(1, near), (2, far)])
    assert set(got) == {(1, "MIT-grant")} and 0.85 <= got[1, "MIT-grant"]["containment"] < 1


def test_items_without_a_usable_template_are_found_as_they_stand(spark):
    items = [(1, "Who wrote Hamlet?"), (2, "11 12 13 14 15 16 17 18 19 20"), (3, "12 + 30 = 42"), (4, " ... "), (5, "What is the capital of France?")]
    rows = [(10, "Intro. 11 12 13 14 15 16 17 18 19 20, end"), (11, "Question Who wrote Hamlet? Nobody"), (12, "so 12 + 30 = 42."), (13, "1 + 2 = 3 or 21 22 23 24 25 26 27 28 29 30"), (14, "What is the capital of Spain?")]
    assert leaks(spark, rows, items) == [(10, 2), (11, 1), (12, 3), (14, 5)]


def test_windows_without_a_usable_template_count(spark):
    item = "add up 1 2 3 4 5 6 7 8 9 10 11 12 and say what the sum of them is"
    other = "add up 21 22 23 24 25 26 27 28 29 30 31 32 and say what the sum of them is"
    assert leaks(spark, [(1, item), (2, other)], [(5, item)]) == [(1, 5)]


def test_a_long_quote_of_a_longer_item_is_a_leak(spark):
    words = ["w" + "abcdefghij"[i // 10] + "abcdefghij"[i % 10] for i in range(59)]
    rows = [(1, "so " + " ".join(words[20:45]) + " and on"), (2, "so " + " ".join(words[20:32])), (3, " x ".join(" ".join(words[a : a + 9]) for a in range(0, 59, 9)))]
    assert leaks(spark, rows, [(5, " ".join(words))]) == [(1, 5)]


def test_one_torn_value_does_not_hide_a_long_copy(spark):
    words = ["w" + "abcdefghij"[i // 10] + "abcdefghij"[i % 10] for i in range(59)]
    item = " ".join([*words[:3], "12", *words[3:40], "12", *words[40:]])
    assert leaks(spark, [(1, item[::-1].replace("21", "31", 1)[::-1])], [(5, item)]) == [(1, 5)]


def test_a_small_benchmark_is_one_file(spark, monkeypatch):
    """The staged windows follow the benchmark's size, whatever the number of shuffle partitions."""
    files = {}
    stage = decontaminate.staged

    def counted(df, label):
        out = stage(df, label)
        files[label] = len(out.inputFiles())
        return out

    monkeypatch.setattr(decontaminate, "staged", counted)
    items = spark.createDataFrame([(i, " ".join(f"{w}{i}" for w in "pa re mi fo su la ti do".split() * 2)) for i in range(30)], "item_id long, text string")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "13"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        found = decontaminate.leaks(items.withColumnRenamed("item_id", "doc_id"), items).select("doc", "item").collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert files["benchmark"] == 1 and {(i, i) for i in range(30)} <= {tuple(r) for r in found}
