"""Token counts by prefix dynamic programming over a score-merged piece vocabulary (operator 9).

A byte-pair encoding is fixed by its adjacent pairs: a sequence of pieces is the encoding of its text exactly
when each piece encodes to itself and each adjacent pair encodes to that pair. So the last piece of the encoding
of every prefix follows from the last pieces of shorter prefixes, and with it the exact token count at every
prefix::

    count[i] = count[i - |t|] + 1     t: the one piece ending at i that is compatible with the last piece at i - |t|

No piece of the vocabulary has a word mark after another character, so a text falls apart at word marks (and at
line feeds, which have no piece) and counts add up over those chunks. Chunks repeat, so each worker keeps the
counts of chunks it has seen in a bounded table; a miss runs the dynamic program, never the library's encoder.

Defined results: null text counts as empty (0 tokens, 0 bytes); an empty text has 0 tokens; repeated rows are
counted one by one; other columns of the input are neither read nor touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.llm.common import batches_of, rows_of, table

MARK = "▁"
#: Entries a worker keeps at most in each of its tables; a full table is emptied, which changes no result.
CACHE_ENTRIES = 1_500_000
_RUNS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class PrefixCounter:
    """Exact token counts at every prefix of a text, for one piece model."""

    def __init__(self, model: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        skip = lambda i: sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)
        self.score = {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size()) if not skip(i)}
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.score):
            raise ValueError("a piece crosses a word mark or a line feed; counts would not add up over chunks")
        self.longest = max(map(len, self.score))
        self.pairs: dict[tuple[str, str], bool] = {}
        self.totals: dict[str, int] = {}

    def merge(self, text: str) -> list[str]:
        """Pieces of a short string by repeated merging, best score first and leftmost among equals."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = max(((score.get(a + b, -1e30), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best == -1e30:
                break
            parts[-at : 2 - at] = ["".join(parts[-at : 2 - at])]
        return parts

    def fits(self, a: str, b: str) -> bool:
        """Whether pieces ``a`` (empty: none) and ``b`` stay apart when the text ``ab`` is encoded."""
        if (known := self.pairs.get((a, b))) is None:
            if len(self.pairs) >= CACHE_ENTRIES:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merge(a + b) == ([a, b] if a else [b])
        return known

    def chunk_counts(self, s: str) -> list[int]:
        """Token counts of the prefixes of one chunk, from length 0 on."""
        score, pairs, longest = self.score, self.pairs, self.longest
        count, last = [0], [""]
        for i in range(1, len(s) + 1):
            for j in range(i - longest if i > longest else 0, i):
                if (t := s[j:i]) in score:
                    a = last[j]
                    ok = pairs.get((a, t))
                    if self.fits(a, t) if ok is None else ok:
                        count.append(count[j] + 1)
                        last.append(t)
                        break
            else:  # no piece: one token for each byte, and nothing merges with it
                count.append(count[-1] + len(s[i - 1].encode()))
                last.append("")
        return count

    def chunks(self, text: str) -> list[str]:
        s = MARK + text.replace(" ", MARK)
        if MARK + MARK in s:
            return _RUNS.findall(s)
        if "\n" in s:
            s = s.replace("\n", " \n ")
        return [c for c in s.replace(MARK, " " + MARK).split(" ") if c]

    def _total(self, chunk: str) -> int:
        if (n := self.totals.get(chunk)) is None:
            if len(self.totals) >= CACHE_ENTRIES:
                self.totals.clear()
            n = self.chunk_counts(chunk)[-1]
            if len(chunk) <= 64:
                self.totals[chunk] = n
        return n

    def total(self, text: str | None) -> int:
        return sum(map(self._total, self.chunks(text))) if text else 0

    def prefix_counts(self, text: str | None) -> list[int]:
        """Token count of ``text[:i]`` for every i from 0 to its length."""
        out, base = [0], 0
        if not text:
            return out
        for c in self.chunks(text):
            counts = self.chunk_counts(c)
            out += [base + n for n in counts[1:]]
            base = out[-1]
        return [0, *out[2:]]  # the first mark is the one that the model puts before the text

    def fitting_prefix(self, text: str | None, budget: int) -> int:
        """Length in characters of the longest prefix of at most ``budget`` tokens."""
        if not text:
            return 0
        chunks = self.chunks(text)
        ends = list(accumulate(map(self._total, chunks)))
        if ends[-1] <= budget:
            return len(text)
        at = chars = base = 0
        while ends[at] < budget:  # a further chunk takes one token at least
            base, chars, at = ends[at], chars + len(chunks[at]), at + 1
        inside = max((j for j, n in enumerate(self.chunk_counts(chunks[at])) if base + n <= budget), default=0)
        return max(0, chars + inside - 1)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(model: str) -> PrefixCounter:
    """The worker's counter for a model; its tables live as long as the worker process."""
    if model not in _COUNTERS:
        _COUNTERS[model] = PrefixCounter(model)
    return _COUNTERS[model]


def token_counts(docs: DataFrame, model: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, bytes, exact tokens, whether over ``limit``, and the longest prefix (characters) within it."""
    schema = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("fits_chars", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(model)

        def one(i, text):
            n = c.total(text)
            return i, len(text.encode()) if text else 0, n, (len(text) if text else 0) if n <= limit else c.fitting_prefix(text, limit)

        yield from batches_of((one(*r) for r in rows_of(batches, "id", "text")), schema)

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        count, "id long, n_bytes long, n_tokens long, fits_chars long"
    )
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fits_chars")


def prefix_table(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id and the stored counts, ``counts[i]`` for the first i characters. Any later question about
    truncation or budgets is an array lookup, see :func:`count_at` and :func:`truncated`."""
    schema = pa.schema([("id", pa.int64()), ("text", pa.string()), ("counts", pa.list_(pa.int32()))])

    def run(batches):
        c = counter(model)
        yield from batches_of(((i, t, c.prefix_counts(t)) for i, t in rows_of(batches, "id", "text")), schema, 64)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(
        run, "id long, text string, counts array<int>"
    ).withColumnsRenamed({"id": id_col, "text": text_col})


def count_at(chars) -> F.Column:
    """Tokens of the first ``chars`` characters, from a prefix table."""
    return F.get("counts", F.least(F.lit(chars), F.size("counts") - 1))


def truncated(budget: int, text_col: str = "text") -> F.Column:
    """The longest prefix of at most ``budget`` tokens, from a prefix table."""
    last = F.array_max(F.transform("counts", lambda n, i: F.when(n <= budget, i)))
    return F.substring(F.col(text_col), F.lit(1), last)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents", "doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), 4096)
