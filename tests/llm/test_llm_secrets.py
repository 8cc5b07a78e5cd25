"""Operator 12: the fixed patterns against plain regular expressions, the novelty measure against written-out texts."""

import hashlib
import random
import re

import pytest
from llm_cases import documents

from careflow.llm import secret_scan as ss

PATTERNS = {
    "assign": r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}


def plain_base(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or "", re.I | re.A if kind == "assign" else 0):
            if (kind == "assign" and len(m[2]) >= 12) or (kind == "access" and len(m[0]) >= 18) or (kind == "hex" and len(m[0]) >= 16):
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return [s for *_, s in sorted(out)]


def listed(df):
    return {r["doc_id"]: r for r in df.collect()}


def query(spark, tmp_path, rows):
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    return ss.op12_secret_scan(spark, str(tmp_path))


def test_base_spans_equal_plain_patterns(spark, tmp_path):
    rnd = random.Random(3)
    parts = ["password", "PassWd", "secret", "ToKen", "api_key", "APIKEY", "paſsword", "toKen", "=", ":", " ", "  ", "'", '"', "\t", "AKIA", "AKIA" * 3, "ABCDEF0123456789",
             "0123456789abcdef", "deadbeef", "short", "longer-value_1.2/3+4=", "é\U0001f600", "\n", "x" * 11, "x" * 12, "A" * 14, "A" * 13]
    rows = [(i, "".join(rnd.choice(parts) for _ in range(rnd.randrange(30)))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, "password=" + "a" * 500_000), (1003, "token " * 100_000), (1004, "token: secret: abcdefghijklmnop")]
    got = listed(query(spark, tmp_path, rows))
    for i, text in rows:
        base = plain_base(text)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest(), text
        assert [s for s in got[i]["spans"].split(",") if s and not s.startswith("novel")] == base
        assert tuple(got[i][f"n_{k}"] for k in PATTERNS) == tuple(sum(s.startswith(k) for s in base) for k in PATTERNS)
    assert got[1004]["n_assign"] == 0  # the failing match has used up the second name


def code(rnd, n, letters="ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"):
    return "".join(rnd.choice(letters) for _ in range(n))


PROSE = ("The service reads its configuration from the environment and writes a short report about every request that it has handled. "
         "Operators should rotate credentials often, keep the documentation current and never paste private values into a ticket. ")  # fmt: skip
WORDS = ("def load_configuration(environment):\n    connection_settings = read_settings(environment)\n    return open_database_connection(connection_settings)\n")


@pytest.fixture(scope="module")
def around():
    return PROSE + WORDS


def test_random_strings_in_sensitive_context_are_found_and_names_are_not(spark, tmp_path, around):
    rnd = random.Random(11)
    lines = ["the password is {} for now", "Authorization, Bearer {}", "secret key -> {} (rotate it)", "<pwd>{}</pwd>", "private key {}"]
    secrets = [(i, around + lines[i % len(lines)].format(code(rnd, 20 + i % 25)) + "\n" + around) for i in range(100)]
    names = ["load_configuration_settings", "open_database_connection", "documentation/current/report", "configuration-environment", "read_settings_environment"]
    clean = [(200 + i, around + lines[i % len(lines)].format(names[(i // 5) % 5]) + "\n" + around) for i in range(25)]
    far = [(300, around + "the password is in the usual place that everybody knows about, behind the door: " + code(rnd, 30)), (301, around + code(rnd, 30)), (302, "the password is\n" + code(rnd, 30))]
    got = listed(query(spark, tmp_path, secrets + clean + far))
    hits = sum(got[i]["n_novel"] for i, _ in secrets)
    assert hits >= 95, hits
    assert sum(got[i]["n_novel"] for i, _ in clean) == 0
    assert all(got[i]["n_novel"] == 0 for i, _ in far)


def test_spans_point_at_the_string_and_stated_twice_stays_new(spark, around):
    key = "q7ZpL0xVn3TfRk8WbY2cGh"
    text = "é\U0001f600 " + around + f"password is {key}, again {key}.\n"
    spans = ss.scan(documents(spark, [(1, text)])).first()["spans"]
    found = [(s["kind"], text[s["start"] : s["end"]].rstrip(".")) for s in spans]
    assert found == [("novel", key), ("novel", key)] and all(s["bits"] >= ss.NOVEL_BITS for s in spans)


def test_base_spans_are_not_reported_again(spark, around):
    text = around + "secret = 0123456789abcdef0123 and password: Zx81-mQpL0xVn3TfRk8W\n"
    kinds = [s["kind"] for s in ss.scan(documents(spark, [(1, text)])).first()["spans"]]
    assert kinds == ["assign", "hex", "assign"]


def test_a_copied_secret_stays_new(spark, around):
    key = "q7ZpL0xVn3TfRk8WbY2cGh"
    rows = [(i, around + f"the password is {key} today") for i in range(300)]
    got = ss.scan(documents(spark, rows)).collect()
    assert all([s["kind"] for s in r["spans"]] == ["novel"] for r in got)
    assert not any(set(w) & set("0123456789") for w in ss.dictionary(documents(spark, rows)))


def test_trained_dictionary_and_small_ones():
    words = [f"{a}{b}{c}" for a in ("con", "fig", "ter", "lo") for b in ("ura", "tio", "ni", "ta", "mel") for c in "abcdefghijklmnopqrstuvwxyz"]
    assert len(words) < ss.LEAST_TRAINED and ss.trained(words) == " ".join(reversed(words)).encode()
    many = [w + x for w in words for x in ("or", "um", "ex")]
    assert len(many) >= ss.LEAST_TRAINED and ss.trained(many) == ss.trained(many) != b""
    ss.Novelty(ss.trained(many)).bits("abc " * 50, 0, 20)
    ss.Novelty(b"").bits("abc", 0, 3)


def test_edges(spark):
    assert ss.scan(documents(spark, [])).count() == 0
    rows = [(None, "password=abcdefghijkl"), (5, "password=abcdefghijkl"), (5, "password=abcdefghijkl"), (6, None)]
    got = sorted((str(r["id"]), len(r["spans"])) for r in ss.scan(documents(spark, rows)).collect())
    assert got == [("5", 1), ("5", 1), ("6", 0), ("None", 1)]
    inside = ss.scan(documents(spark, [(1, "token" * 20_000 + " " + "secret word " * 20_000)])).first()["spans"]  # linear in the text
    assert len(inside) <= 1
