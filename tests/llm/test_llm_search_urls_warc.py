"""Operators 4, 5 and 7."""

import gzip
import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import SF_SMALL
from pyspark.sql import functions as F

from careflow.llm import topk_search, url_filter, warc_derivatives

VECTORS = "vec_id long, embedding array<float>, label int, v long, norm double, bucket int"


def brute(rows, k, scale):
    usable = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v, *_ in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)): (i, v) for i, v in usable if i is not None and i % 100 == 0}.values():
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in usable if len(w) == len(v) and i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["unit", "lengths", "one direction", "ties"])
def test_search_equals_brute_force(spark, monkeypatch, kind):
    monkeypatch.setattr(topk_search, "SEEDS", 12)
    monkeypatch.setattr(topk_search, "CHUNK", 40)
    monkeypatch.setattr(topk_search, "BLOCK", 3)
    rng = np.random.default_rng(len(kind))
    x = rng.normal(size=(600, 6))
    if kind == "unit":
        x /= np.linalg.norm(x, axis=1)[:, None]
    if kind == "lengths":
        x *= np.exp(rng.normal(size=(600, 1)) * 2)
    if kind == "one direction":
        x = np.abs(x) * 0.05 + np.array([5, 0, 0, 0, 0, 0])
    if kind == "ties":
        x[100:400] = x[0]
    rows = [(int(i), [float(y) for y in v], 0, 7, 7.0, 7) for i, v in enumerate(x)]
    rows += [(5000, None, 0, 7, 7.0, 7), (5100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, 7, 7.0, 7), (5200, [float("nan")] * 6, 0, 7, 7.0, 7), (5300, [float("inf")] * 6, 0, 7, 7.0, 7)]
    rows += [(5400, [], 0, 7, 7.0, 7), (5500, [1.0, 2.0], 0, 7, 7.0, 7), (5501, [0.5, 0.5], 0, 7, 7.0, 7), (5600, [0.0] * 6, 0, 7, 7.0, 7)]
    df = spark.createDataFrame(rows, VECTORS)
    got = topk_search.search(df, F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)), 5, 1024)
    assert sorted(map(tuple, got.collect())) == brute(rows, 5, 1024)


def test_candidates_never_lose_a_vector():
    rng = np.random.default_rng(0)
    for scale in (0.1, 1.0, 3.0):
        v = rng.normal(size=(300, 5)) + scale
        norms = np.linalg.norm(v, axis=1)
        for q in rng.normal(size=(20, 5)) + scale:
            scores = v @ q
            for bound in np.quantile(scores, [0.5, 0.9, 0.99, 1.0]):
                some = topk_search._candidates(q, float(np.linalg.norm(q)), float(bound), norms, v / norms[:, None])
                assert some is None or set(np.flatnonzero(scores >= bound)) <= set(some)


def test_search_of_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.25])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk_search.search(df, F.col("vec_id") == 0, 10, 1024).collect()] == [(0, 1, 1, 1024 * 512 + 2048 * 256)]
    assert topk_search.search(df.limit(0), F.col("vec_id") == 0, 10, 1024).count() == 0


def test_large_components_stay_exact(spark):
    df = spark.createDataFrame([(0, [2.0**40 + 1, 1.0]), (1, [2.0**21, 3.0]), (2, [2.0**21, 4.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk_search.search(df, F.col("vec_id") == 0, 2, 1).collect()] == [(0, 1, 2, (2**40 + 1) * 2**21 + 4), (0, 2, 1, (2**40 + 1) * 2**21 + 3)]


URLS = [
    ("http://A.Example.NET/en/1?x=1", "a.example.net", "/en/1", "example.net/en/", "allow"), ("https://net/", "net", "/", "net/", "block"), ("ftp://x.net", "x.net", "", None, None),
    ("http://xnet/en/", "xnet", "/en/", None, None), ("http://example.com/de/9#f", "example.com", "/de/9", "example.com/de/", "block"), ("http://b.org/fr/x", "b.org", "/fr/x", "org/fr/", "allow"),
    (None, "", "", None, None), ("no scheme/here", "", "", None, None), ("x://É.Net/Fr?a://b.org/fr/", "É.net", "/Fr", "net/", "block"), ("http://", "", "", None, None),
]


def test_hosts_paths_and_rules(spark):
    df = spark.createDataFrame([(i, u, None, "x", "x") for i, (u, *_) in enumerate(URLS)] * 2, "page_id long, url string, html string, host string, rule string")
    got = url_filter.judged(df).collect()
    assert len(got) == 2 * len(URLS)
    for r in got:
        _, host, path, rule, verdict = URLS[r["page_id"]]
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule) and (verdict is None or r["verdict"] == verdict) and r["verdict"] in ("allow", "block")
    assert url_filter.judged(df.limit(0)).count() == 0


def test_segmentation_is_the_most_probable_split():
    counts = Counter({"free": 40, "bets": 9, "fre": 1, "ebets": 2, "be": 30, "ts": 3, "a": 50})
    total = sum(counts.values())

    def score(words):
        return sum(math.log(counts[w] / total) if counts[w] else -math.log(total) - len(w) * math.log(10) for w in words)

    for label in ("freebets", "abets", "xfreez", "tsbea", "q", "freebetsfree"):
        spans = {(a, b): counts[label[a:b]] for a, b in itertools.combinations(range(len(label) + 1), 2) if counts[label[a:b]]}
        splits = [[label[a:b] for a, b in zip((0, *c), (*c, len(label)))] for n in range(len(label)) for c in itertools.combinations(range(1, len(label)), n)]
        assert math.isclose(score(url_filter.viterbi(label, spans, total)), max(map(score, splits)))
    assert url_filter.viterbi("abc", {}, 0) == ["abc"]


def test_verdicts_equal_plain_naive_bayes(spark):
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet")
    rows = pages.collect()
    counts = Counter(w for r in rows for w in re.findall("[a-z]+", re.sub("<[^>]*>", " ", r["html"]).lower()) if len(w) <= 24)
    total, memo = sum(counts.values()), {}

    def tokens(host, path):
        for label in re.findall("[a-z]+", host):
            if label not in memo:
                memo[label] = url_filter.viterbi(label, {(a, b): counts[label[a:b]] for a, b in itertools.combinations(range(len(label) + 1), 2) if counts[label[a:b]]}, total)
            yield from ("h:" + w for w in memo[label])
        yield from ("p:" + ("0" if w[0].isdigit() else w) for w in re.findall(r"[^\W\d_]+|[0-9]+", path.lower()))

    got = url_filter.judged(pages).collect()
    seen, classes = {"block": Counter(), "allow": Counter()}, Counter()
    for r in got:
        if r["rule"]:
            seen[r["verdict"]].update(tokens(r["host"], r["path"]))
            classes[r["verdict"]] += 1
    vocabulary, size = set(seen["block"]) | set(seen["allow"]), {k: sum(v.values()) for k, v in seen.items()}
    for r in got:
        if not r["rule"]:
            odds = math.log((classes["block"] + 1) / (classes["allow"] + 1))
            for w in tokens(r["host"], r["path"]):
                odds += math.log((seen["block"][w] + 1) / (size["block"] + len(vocabulary) + 1)) - math.log((seen["allow"][w] + 1) / (size["allow"] + len(vocabulary) + 1))
            assert math.isclose(odds, r["odds"], abs_tol=1e-6) and r["verdict"] == ("block" if odds > 0 else "allow")


HTML = "<html><head><title>A &amp; B</title><style>p{}</style><script>var t='</p>';</script></head><body><!-- no --><p>One&nbsp; <b>two</b></p><div>3 &lt; 4</div><script>open"


def responses(spark, rows):
    return spark.createDataFrame([(*r, "x", "x") for r in rows], "record_id string, target_uri string, warc_date string, http string, payload string, block string, text string")


def test_derivatives_are_linked(spark, tmp_path):
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nX-Y: z\r\n\r\n"
    rows = [("<urn:uuid:1>", "http://a/", "2024-01-01T00:00:00Z", http, HTML), ("<urn:uuid:2>", None, None, None, None), (None, "http://b/", "2024", http, HTML), ("<urn:uuid:1>", "http://a/", "2024-01-01T00:00:00Z", http, HTML)]
    df = warc_derivatives.derivatives(responses(spark, rows))
    got = df.collect()
    assert sorted((r["refers_to"], r["warc_type"]) for r in got) == sorted([("<urn:uuid:1>", t) for t in ("metadata", "conversion")] * 2 + [("<urn:uuid:2>", t) for t in ("metadata", "conversion")])
    by = {(r["refers_to"], r["warc_type"]): r for r in got}
    conv, meta = by["<urn:uuid:1>", "conversion"], by["<urn:uuid:1>", "metadata"]
    assert conv["block"] == "A & B\nOne two\n3 < 4" and by["<urn:uuid:2>", "conversion"]["block"] == ""
    fields = dict(x.split(": ", 1) for x in meta["block"].strip().split("\r\n"))
    assert fields["conversion-record-id"] == conv["record_id"] and fields["conversion-block-digest"] == conv["block_digest"] == "sha256:" + hashlib.sha256(conv["block"].encode()).hexdigest()
    assert fields["title"] == "A & B" and fields["source-http-status"] == "HTTP/1.1 200 OK" and fields["source-http-X-Y"] == "z"
    assert fields["source-payload-digest"] == "sha256:" + hashlib.sha256(HTML.encode()).hexdigest()
    assert "WARC-Target-URI" not in by["<urn:uuid:2>", "metadata"]["header"] and "WARC-Refers-To: <urn:uuid:1>\r\n" in conv["header"]
    assert warc_derivatives.derivatives(responses(spark, [])).count() == 0

    warc_derivatives.write_warc(df, str(tmp_path / "out"))
    data = b"".join(gzip.decompress(p.read_bytes()) for p in sorted((tmp_path / "out").glob("part-*.gz")))
    records = []
    while data:
        head, data = data.split(b"\r\n\r\n", 1)
        lines = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        body, data = data[: int(lines["Content-Length"])], data[int(lines["Content-Length"]) :]
        assert data[:4] == b"\r\n\r\n" and lines["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(body).hexdigest()
        data = data[4:]
        records.append(lines["WARC-Record-ID"])
    assert sorted(records) == sorted(r["record_id"] for r in got)


REFERENCES = {
    "caf&eacute; &#233; &#x2019; &copy; &middot;": "café é \u2019 © ·",
    "&amp;lt; &amp;#233; &amp;&amp;": "&lt; &#233; &&",
    "&bogus; &nbsp &lt a&b; & && &; &#; &#x; &#xZ;": "&bogus; &nbsp &lt a&b; & && &; &#; &#x; &#xZ;",
    "&#0; &#xD800; &#1114112; &#9999999; &#128; &#x80; &#129;.": "\ufffd \ufffd \ufffd \ufffd € € \x81.",
    "&lt;b&gt; &quot;x&quot; &apos;y&apos; &#39; &bsol;&dollar;1": "<b> \"x\" 'y' ' \\$1",
    "&#x1F600;&#128512; &Afr; &NotEqualTilde; &CounterClockwiseContourIntegral;": "\U0001f600\U0001f600 \U0001d504 \u2242\u0338 \u2233",
    "a&NewLine;b&Tab;c&nbsp;&#160;&#xa0;d": "a\nb c d",
    "&copy;": "©", "": "",
}


def test_character_references_are_resolved(spark):
    df = spark.createDataFrame([(t,) for t in REFERENCES], "t string")
    assert {r[0]: r[1] for r in df.select("t", warc_derivatives.plain_text(F.col("t"))).collect()} == REFERENCES
    assert len(warc_derivatives.ENTITIES) > 2000


def test_long_pages_and_clashing_columns(spark):
    html = "<p>caf&eacute; &amp; more</p>" * 100_000
    pages = spark.createDataFrame([(7, "http://a/", html, "r", "h", "p", "d")], "page_id long, url string, html string, record_id string, http string, payload string, warc_date string")
    found = warc_derivatives.derivatives(warc_derivatives.page_responses(pages)).filter("warc_type = 'conversion'").first()
    assert found["block"] == "\n".join(["café & more"] * 100_000) and found["target_uri"] == "http://a/" and found["refers_to"].startswith("<urn:uuid:")


def test_bound_beyond_two_to_the_53_keeps_the_kth(spark):
    rows = [(0, [2.0**30, 1.0]), (1, [2.0**23, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk_search.search(df, F.col("vec_id") == 0, 1, 1).collect()] == [(0, 1, 1, 2**53 + 3)]
