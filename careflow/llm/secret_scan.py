"""Secret scan: three fixed patterns, and the novelty of strings in sensitive context (operator 12).

1. Fixed patterns report assignments to sensitive names, access keys and long hexadecimal runs.
2. The words that identifiers are made of (runs of lower-case ASCII letters) are counted over all documents; the most
   frequent ones, a bounded number, become a zstandard dictionary. A secret cannot get into it, however often its
   document is copied: a random string has no long runs of lower-case letters.
3. Every string of CANDIDATE letters that begins within REACH letters behind a sensitive word, on its line and outside
   the spans of the fixed patterns, is a candidate. Its marginal bytes are those that it adds to the compressed text
   around it, with the dictionary: what names, code and prose nearby already say costs little. Copies of the candidate
   in its surroundings are taken out first, so that a secret that is stated twice stays new. Candidates of NOVEL_BITS
   bits a letter or more are reported.

Each document is judged in one pass of one task; nothing but the dictionary's counts is shuffled.

Defined results: a null or empty text has no spans; rows without id and repeated rows are judged each on its own;
texts are read whole; an empty table gives no rows; of spans with one start the kinds follow in the order of KINDS;
words with equal counts enter the dictionary in order of the alphabet; other columns are neither read nor changed.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.llm.common import batches_of, rows_of, staged, table

KINDS = ("assign", "access", "hex", "novel")
BASE_KINDS = KINDS[:3]
# The contract's patterns; letters in either case means ASCII letters.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
LEAST_ASSIGNED = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"  # 18 letters or more; a shorter run holds no longer one
HEX = r"[0-9a-f]{16,}"
#: Words that make what follows sensitive; all words of ASSIGN are among them, and each holds one of the parts, which
#: are looked for first.
SENSITIVE_PARTS = ("passw", "passphrase", "passcode", "pwd", "secret", "token", "key", "credential", "bearer", "authorization")
SENSITIVE = r"pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private|encryption|signing|account)[\x20_-]?key|credential|bearer|authorization"
LEAST_CANDIDATE = 12
CANDIDATE = rf"[A-Za-z0-9+/_.~$!@#%^&*-]{{{LEAST_CANDIDATE},}}={{0,2}}"
#: Marks that end a sentence or an emphasis rather than a candidate.
MARKS = ".!~*-"
#: Letters between a sensitive word and its candidate, and letters of text on either side to measure it against.
REACH, AROUND = 48, 512
#: Marginal bits a letter from which a string is new. Measured behind "the password is" in given texts: words of the
#: texts and names made of English words 2 to 6 with rare outliers to 7, random strings of mixed letters and digits 7 to 11.
NOVEL_BITS = 6.5
#: Words of the dictionary, the least length of one, the least number to train with, its size in bytes, and distinct
#: words that a task counts before it sends sums on.
DICTIONARY_WORDS, WORD_LENGTH, LEAST_TRAINED, DICTIONARY_BYTES, COUNTED = 4096, 4, 1024, 32_768, 200_000
#: A word of the dictionary is at least one in so many of all words.
RAREST = 1 << 16


def base_spans(text: str, assign: re.Pattern, access: re.Pattern, hexadecimal: re.Pattern, sensitive: bool = True) -> list[tuple[int, int, int, float | None]]:
    """(start, kind, end, None) by the fixed patterns."""
    spans = [(m.start(), 0, m.end(), None) for m in assign.finditer(text) if len(m[2]) >= LEAST_ASSIGNED] if sensitive else []
    spans += [(m.start(), 1, m.end(), None) for m in access.finditer(text)]
    spans += [(m.start(), 2, m.end(), None) for m in hexadecimal.finditer(text)]
    return sorted(spans)


def trained(words: list[str]) -> bytes:
    """A zstandard dictionary of the words: with enough of them one with letter statistics, which make a few letters'
    cost steady, else the words as they are."""
    if len(words) < LEAST_TRAINED:
        return " ".join(reversed(words)).encode()
    lines = [" ".join(words[i :: len(words) // 16]).encode() for i in range(len(words) // 16)]
    return zstandard.train_dictionary(DICTIONARY_BYTES, lines).as_bytes()


class Novelty:
    """Marginal bits of a string beside its surroundings, by zstandard with a dictionary."""

    def __init__(self, primer: bytes):
        primed = zstandard.ZstdCompressionDict(primer) if primer else None
        self.packer = zstandard.ZstdCompressor(level=9, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)

    def bits(self, text: str, start: int, end: int) -> float:
        string = text[start:end]
        around = (text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]).replace(string, "")
        size = lambda x: len(self.packer.compress(x.encode()))
        return 8 * (size(f"{around} {string}") - size(around)) / len(string)


def candidates(text: str, words: list[re.Match], candidate: re.Pattern, taken: list[tuple]) -> Iterator[tuple[int, int]]:
    """Strings that begin behind one of the sensitive words, on its line, and meet no span of taken (sorted)."""
    ends = sorted(end for _, _, end, _ in taken)
    starts = sorted(start for start, *_ in taken)
    at = 0
    for word in words:
        limit = word.end() + REACH
        line = text.find("\n", word.end(), limit)
        limit = line if line >= 0 else limit
        at = max(at, word.end())
        while at < limit and (begun := candidate.search(text, at, limit + LEAST_CANDIDATE - 1)):
            start, end = candidate.match(text, begun.start()).span()  # it may reach beyond the limit
            at = end
            end = start + len(text[start:end].rstrip(MARKS))
            if end - start < LEAST_CANDIDATE:
                continue
            # spans that end behind its start, less those that start at its end or behind, are spans that meet it
            if len(ends) - bisect_left(ends, start + 1) <= len(starts) - bisect_left(starts, end):
                yield start, end


def dictionary(docs: DataFrame) -> list[str]:
    """The most frequent words of all texts (column text), the most frequent first."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches):
        word, counts = re.compile(f"[a-z]{{{WORD_LENGTH},}}"), Counter()
        for (text,) in rows_of(batches, "text"):
            counts.update(word.findall(text or ""))
            if len(counts) >= COUNTED:
                yield from batches_of(iter(counts.items()), schema, 1 << 16)
                counts.clear()
        yield from batches_of(iter(counts.items()), schema, 1 << 16)

    sums = staged(docs.select("text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    total = sums.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    frequent = sums.filter(F.col("n") * RAREST >= total).collect()  # RAREST rows at most, as their counts add up to the total
    return [r["word"] for r in sorted(frequent, key=lambda r: (-r["n"], r["word"]))[:DICTIONARY_WORDS]]


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, spans (array of kind, start, end, bits), by start; places count code points, the end is exclusive,
    bits a letter are given for the kind ``novel``."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    primer = trained(dictionary(docs))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("bits", pa.float64())])
    schema = pa.schema([("id", pa.int64()), ("spans", pa.list_(span))])

    def find(batches):
        assign, sensitive = (re.compile(p, re.I | re.A) for p in (ASSIGN, SENSITIVE))
        access, hexadecimal, candidate = (re.compile(p) for p in (ACCESS, HEX, CANDIDATE))
        novelty = Novelty(primer)

        def rows():
            for i, text in rows_of(batches, "id", "text"):
                text = text or ""
                folded = text.lower()
                near = list(sensitive.finditer(text)) if any(part in folded for part in SENSITIVE_PARTS) else []
                spans = base_spans(text, assign, access, hexadecimal, bool(near))
                new = []
                for start, end in candidates(text, near, candidate, spans):
                    if (bits := novelty.bits(text, start, end)) >= NOVEL_BITS:
                        new.append((start, 3, end, bits))
                yield i, [{"kind": KINDS[k], "start": a, "end": b, "bits": bits} for a, k, b, bits in sorted(spans + new)]

        yield from batches_of(rows(), schema)

    return docs.withColumn("id", F.col("id").cast("long")).mapInArrow(find, "id long, spans array<struct<kind string, start long, end long, bits double>>")


def op12_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents", "doc_id", "text"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select(
        F.col("id").alias("doc_id"), *(of(k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), of("novel").alias("n_novel"),
    )
