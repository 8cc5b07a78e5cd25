"""URL filter: fixed rules, and for the rest naive Bayes over words of the host and the path (operator 7).

1. Rules (host, path prefix) fit a host and its subdomains; the longest that fits decides.
2. Host names are mostly words run together. Each label of a host (the parts between its dots, cut at anything but
   a-z) is split by a unigram Viterbi pass: the words of all pages and their counts are the model. The model is not
   broadcast: the substrings of the distinct labels are joined with the words, and each label is solved from its own
   matches.
3. Host words and path words are scored by multinomial naive Bayes (add-one smoothing), learned from the rows that
   the rules decide; it judges the others. Counts and scores are joins and sums over distinct hosts and paths, so a
   host that a third of all pages share is segmented and scored once.

Defined results: a null url or one without `://` has empty host and path, fits no rule and has no word; without a
word (or without a learned class) the class prior decides, and equal odds allow; repeated rows are judged alike;
an empty table gives no rows; other columns are neither read nor changed.
"""

from __future__ import annotations

import math
import string

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.llm.common import batches_of, rows_of, staged, table

RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
#: Longest word that segmentation looks for.
LONGEST = 24


def parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; empty strings without `://`."""
    pattern = r"(?s)://([^/?#]*)([^?#]*)"
    host = F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit(""))


def ruled(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule (host and path as one string) and its verdict, or null."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):  # a later one overrides
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def word_counts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """(word, n) over the text of all pages: runs of a-z up to LONGEST letters."""
    text = F.lower(F.regexp_replace(F.col(html_col), r"<[^>]*>", " "))
    words = pages.select(F.explode(F.regexp_extract_all(text, F.lit(r"[a-z]+"), 0)).alias("word"))
    return words.filter(F.length("word") <= LONGEST).groupBy("word").agg(F.count("*").alias("n"))


def viterbi(label: str, counts: dict[tuple[int, int], int], total: int) -> list[str]:
    """Most probable split. A word of the model has probability n / total, any other span of length L
    1 / (total * 10^L). Of equal splits, the one with fewer words and then the longer last word."""
    log_total = math.log(max(total, 1))
    best: list[tuple[float, int, int]] = [(0.0, 0, 0)]
    for end in range(1, len(label) + 1):
        options = []
        for start in range(max(0, end - LONGEST), end):
            n = counts.get((start, end))
            p = math.log(n) - log_total if n else -log_total - (end - start) * math.log(10)
            score, words, _ = best[start]
            options.append((score + p, words - 1, start))  # words: minus their number
        best.append(max(options, key=lambda o: (round(o[0], 9), o[1], -o[2])))
    out, end = [], len(label)
    while end:
        start = best[end][2]
        out.append(label[start:end])
        end = start
    return out[::-1]


def segmented(labels: DataFrame, words: DataFrame) -> DataFrame:
    """(label, words) for distinct labels of a-z, by the word model (word, n)."""
    total = words.agg(F.sum("n")).first()[0] or 0
    spans = labels.select("label", F.explode(F.sequence(F.lit(1), F.length("label"))).alias("at")).select(
        "label", "at", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("label") - F.col("at") + 1))).alias("len")
    )
    spans = spans.withColumn("word", F.substring(F.col("label"), F.col("at"), F.col("len")))
    hits = spans.join(words, "word").groupBy("label").agg(F.collect_list(F.struct("at", "len", "n")).alias("hits"))  # at most LONGEST for each letter
    schema = pa.schema([("label", pa.string()), ("words", pa.list_(pa.string()))])

    def solve(batches):
        yield from batches_of(((label, viterbi(label, {(h["at"] - 1, h["at"] - 1 + h["len"]): h["n"] for h in hits or ()}, total)) for label, hits in rows_of(batches, "label", "hits")), schema)

    return labels.join(hits, "label", "left").mapInArrow(solve, "label string, words array<string>")


def host_words(hosts: DataFrame, words: DataFrame) -> DataFrame:
    """(host, word) with repeats: the words of every distinct host."""
    labels = hosts.select("host", F.explode(F.regexp_extract_all("host", F.lit(r"[a-z]+"), 0)).alias("label"))
    solved = segmented(labels.select("label").distinct(), words)
    return labels.join(solved, "label").select("host", F.explode("words").alias("word"))


def path_words(paths: DataFrame) -> DataFrame:
    """(path, word) with repeats: runs of letters, and `0` for each run of digits."""
    found = F.regexp_extract_all(F.lower("path"), F.lit(r"\p{L}+|[0-9]+"), 0)
    return paths.select("path", F.explode(F.transform(found, lambda w: F.when(w.rlike("^[0-9]"), F.lit("0")).otherwise(w))).alias("word"))


def judged(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: id, host, path, rule, verdict, odds (log odds of block; null where a rule decides)."""
    host, path = parts(F.col(url_col))
    split = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    split = split.withColumns({"rule": rule, "decided": verdict})

    words = staged(word_counts(pages, html_col), "words")  # read twice
    of_host = staged(host_words(split.select("host").distinct(), words), "hostwords")
    of_path = path_words(split.select("path").distinct())
    per_class = split.filter("rule IS NOT NULL")
    seen_hosts = per_class.groupBy("host", "decided").count().join(of_host, "host").groupBy("word", "decided").agg(F.sum("count").alias("n"))
    seen_paths = per_class.groupBy("path", "decided").count().join(of_path, "path").groupBy("word", "decided").agg(F.sum("count").alias("n"))
    counts = (
        seen_hosts.select(F.concat(F.lit("h:"), "word").alias("word"), "decided", "n").unionByName(seen_paths.select(F.concat(F.lit("p:"), "word").alias("word"), "decided", "n"))
        .groupBy("word").agg(*(F.sum(F.when(F.col("decided") == v, F.col("n")).otherwise(0)).alias(v) for v in ("block", "allow")))
    )
    counts = staged(counts, "wordcounts")
    vocabulary, block, allow = counts.agg(F.count("*"), F.coalesce(F.sum("block"), F.lit(0)), F.coalesce(F.sum("allow"), F.lit(0))).first()
    rows = {r["decided"]: r["count"] for r in per_class.groupBy("decided").count().collect()}  # two rows
    prior = math.log((rows.get("block", 0) + 1) / (rows.get("allow", 0) + 1))
    base = math.log((allow + vocabulary + 1) / (block + vocabulary + 1))
    weights = counts.select("word", (F.log(F.col("block") + 1) - F.log(F.col("allow") + 1) + base).alias("w"))

    def scores(words: DataFrame, key: str, mark: str) -> DataFrame:
        marked = words.groupBy(key, F.concat(F.lit(mark), "word").alias("word")).count()
        weighed = marked.join(weights, "word", "left").withColumn("w", F.coalesce("w", F.lit(base)) * F.col("count"))
        return weighed.groupBy(key).agg(F.sum(F.round("w", 9)).alias(f"{key}_score"))

    scored = split.join(scores(of_host, "host", "h:"), "host", "left").join(scores(of_path, "path", "p:"), "path", "left")
    odds = F.lit(prior) + F.coalesce("host_score", F.lit(0.0)) + F.coalesce("path_score", F.lit(0.0))
    scored = scored.withColumn("odds", F.when(F.col("rule").isNull(), odds))
    method = F.when(F.col("odds") > 0, "block").otherwise("allow")
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("decided", method).alias("verdict"), "odds")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages", "page_id", "url", "html"))
