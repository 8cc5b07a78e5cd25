"""Best-fit packing planned over a length histogram (operator 10).

1. Tasks encode whole documents and cut them into pieces of at most ``capacity`` tokens.
2. The histogram of piece lengths has at most ``capacity`` rows whatever the corpus; best fit in order of falling
   length runs over those counts: equal pieces go to equally filled sequences as one plan row.
3. Pieces are numbered within their length (per bucket, plus the count of earlier buckets, so that a length which
   holds a third of all pieces is numbered by many tasks) and take their planned slot by a join on length and rank.

The plan depends on counts alone: its size is bounded by the capacity, not by the number of documents.

Defined results: a null or empty text is its end id alone (one piece of length 1); repeated rows are packed each
on its own; an empty table gives no rows; equal lengths are placed in order of bucket, id, piece.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careflow.llm.common import batches_of, rows_of, staged, table

#: Words that a task keeps at most, as they stand and without marks; a full table is emptied, which changes no result.
CACHE_ENTRIES = 600_000
#: Characters of text that are encoded at once (a longer text on its own).
BLOCK_CHARS = 1 << 20
#: Plan rows up to which the plan is broadcast (under 4 MB); beyond it the slots are joined by shuffle.
BROADCAST_PLAN_ROWS = 65_536


def _letters(stem: str) -> bool:
    """Whether a stem is letters alone, also to the tokenizer: composing (NFC) and folding may each turn a letter into
    a letter and an accent, and an accent is one pre-token with a mark behind it."""
    if not stem.isalpha():
        return False
    composed = unicodedata.normalize("NFC", stem)
    return composed.isalpha() and composed.lower().isalpha()


class WordEncoder:
    """Little-endian 32-bit ids of a text, word by word: this tokenizer drops white space, and neither its
    normalizer nor its pieces reach over it. A word of letters with a full stop or comma behind it is those letters
    and that mark (letters and marks are never one pre-token), so words that differ in that alone, or in the case of
    A-Z, are encoded once."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.encoder = Tokenizer.from_file(path)
        self.words: dict[str, bytes] = {"": b""}
        self.stems: dict[str, bytes] = {}
        self.ends_word = np.zeros(self.encoder.get_vocab_size(), bool)
        self.ends_word[[i for piece, i in self.encoder.get_vocab().items() if piece.endswith("</w>")]] = True
        self.marks = dict(zip(".,", self._encode([".", ","]).values()))

    def _encode(self, words: list[str]) -> dict[str, bytes]:
        found = self.encoder.encode_batch_fast(words, add_special_tokens=False)
        return {w: struct.pack(f"<{len(e.ids)}I", *e.ids) for w, e in zip(words, found)}

    def _encode_letters(self, stems: list[str]) -> dict[str, bytes]:
        """As one text: a run of letters is one pre-token, and its last id alone ends a word."""
        ids = np.array(self.encoder.encode(" ".join(stems), add_special_tokens=False).ids, "<u4")
        ends = 4 * (np.flatnonzero(self.ends_word[ids]) + 1)
        if len(ends) != len(stems):
            return self._encode(stems)
        raw, ends = ids.tobytes(), ends.tolist()
        return {s: raw[a:b] for s, a, b in zip(stems, [0, *ends], ends)}

    def _learn(self, new: set[str]) -> None:
        if len(self.stems) >= CACHE_ENTRIES:
            self.stems.clear()
        stems, odd = self.stems, []
        by_mark: dict[str, list[str]] = {"": [], **{m: [] for m in self.marks}}
        for w in new:
            by_mark.get(w[-1], by_mark[""]).append(w)
        for mark, some in by_mark.items():
            cut = [w[:-1] for w in some] if mark else some
            known = [s.lower() if s.isascii() and s.isalpha() else s if _letters(s) else None for s in cut]
            for few in batched(set(known).difference(stems, (None,)), 4096):
                stems.update(self._encode_letters(list(few)))
            end = self.marks.get(mark, b"")
            self.words.update({w: stems[s] + end for w, s in zip(some, known) if s is not None})
            odd += [w for w, s in zip(some, known) if s is None]
        if odd:
            self.words.update(self._encode(odd))

    def forget(self) -> None:
        self.words, self.stems = {"": b""}, {}

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; words that are new to all of them are learned at once."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        if len(self.words) >= CACHE_ENTRIES:
            self.words = {"": b""}
        if new := set().union(*split).difference(self.words):
            self._learn(new)
        of = self.words.__getitem__
        return [b"".join(map(of, words)) for words in split]


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _blocks(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows (id, text and more) in blocks of some million characters; null texts are empty."""
    some, held = [], 0
    for i, text, *more in rows:
        some.append((i, text or "", *more))
        held += len(text or "")
        if held >= BLOCK_CHARS or len(some) == 512:
            yield some
            some, held = [], 0
    if some:
        yield some


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", group_col: str | None = None) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, and group_col if given."""
    schema = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), *([(group_col, pa.string())] if group_col else [])])
    more = ("more",) if group_col else ()
    end = end_id.to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer)

        def rows():
            for some in _blocks(rows_of(batches, "id", "text", *more)):
                for (i, _, *group), found in zip(some, enc.ids([row[1] for row in some])):
                    ids = memoryview(found + end)
                    for n, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        yield i, n, at // 4, len(part) // 4, zlib.crc32(part), *group

        try:
            yield from batches_of(rows(), schema)
        finally:
            enc.forget()  # the worker lives on for other stages

    wanted = [F.col(group_col).cast("string").alias(c) for c in more]
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *wanted).mapInArrow(
        cut, "id long, piece int, start long, length long, ids_crc32 long" + "".join(f", {group_col} string" for _ in more)
    ).withColumnRenamed("id", id_col)


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit by falling length over counts. Rows: (length, first rank, ranks, first sequence, pieces a sequence,
    offset). Ranks first..first+ranks-1 fill consecutive sequences from ``offset`` on."""
    free: dict[int, list[tuple[int, int]]] = {}  # room left -> runs of sequences (first, how many)
    out, opened = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        rooms = sorted((r for r in free if r >= length), reverse=True)
        while left:
            if rooms:
                room = rooms[-1]
                first, many = free[room].pop()
                if not free[room]:
                    del free[room]
                    rooms.pop()
            else:
                room, first, many = capacity, opened, -(-left // (capacity // length))
                opened += many
            per = room // length
            used = min(many, -(-left // per))
            taken = min(left, used * per)
            out.append((length, rank, taken, first, per, capacity - room))
            full, rest = divmod(taken, per)
            for at, n, room_left in ((first, full, room - per * length), (first + full, int(rest > 0), room - rest * length), (first + used, many - used, room)):
                if n and room_left:
                    free.setdefault(room_left, []).append((at, n))
            rank, left = rank + taken, left - taken
    return out


def group_plans(histograms: dict, capacity: int) -> list[tuple]:
    """The plan of each group's histogram behind that of the group before; rows: group and a plan's row."""
    out, opened = [], 0
    for group in sorted(histograms, key=lambda g: (g is not None, g)):
        rows = plan(histograms[group], capacity)
        out += [(group, length, rank, taken, opened + first, per, at) for length, rank, taken, first, per, at in rows]
        opened += max(first - (-taken // per) for _, _, taken, first, per, _ in rows)
    return out


def pack(parts: DataFrame, capacity: int, id_col: str = "doc_id", group_col: str | None = None) -> DataFrame:
    """Add sequence_id and offset to a table of pieces (staged, as it is read three times). With group_col, a sequence
    holds pieces of one of its values (null is one of them) and that column stays."""
    spark = parts.sparkSession
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    parts = staged(parts.withColumn("_bucket", F.pmod(F.xxhash64(id_col, "piece"), F.lit(buckets))), "pieces")
    by = [group_col] if group_col else []
    counts = parts.groupBy(*by, "length", "_bucket").count()
    histograms: dict = {}
    for r in parts.groupBy(*by, "length").agg(F.count("*").alias("n")).collect():  # at most `capacity` rows a group
        histograms.setdefault(r[group_col] if group_col else None, {})[r["length"]] = r["n"]
    rows = group_plans(histograms, capacity)
    slots = spark.createDataFrame(rows or [(None, 0, 0, 0, 0, 1, 0)], "_group string, length long, _first long, _ranks long, _seq long, _per long, _at long")
    if len(rows) <= BROADCAST_PLAN_ROWS:
        slots = F.broadcast(slots)
    before = counts.withColumn(
        "_before", F.coalesce(F.sum("count").over(Window.partitionBy(*by, "length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ).drop("count").select(*(F.col(c).alias("_of") for c in by), F.col("length").alias("_len"), F.col("_bucket").alias("_in"), "_before")
    group = F.col(group_col) if group_col else F.lit(None).cast("string")
    ranked = (
        parts.withColumn("_n", F.row_number().over(Window.partitionBy(*by, "length", "_bucket").orderBy(id_col, "piece", "ids_crc32")) - 1)
        .join(before, (F.col("length") == F.col("_len")) & (F.col("_bucket") == F.col("_in")) & (group.eqNullSafe(F.col("_of")) if by else F.lit(True)))
        .withColumn("_rank", F.col("_before") + F.col("_n"))
    )
    same = (ranked["length"] == slots["length"]) & (group.eqNullSafe(F.col("_group")) if by else F.lit(True))
    placed = ranked.join(slots, same & F.col("_rank").between(F.col("_first"), F.col("_first") + F.col("_ranks") - 1))
    return placed.select(
        id_col, "piece", "start", ranked["length"], "ids_crc32",
        (F.col("_seq") + F.floor((F.col("_rank") - F.col("_first")) / F.col("_per"))).cast("long").alias("sequence_id"),
        (F.col("_at") + F.pmod(F.col("_rank") - F.col("_first"), F.col("_per")) * ranked["length"]).cast("long").alias("offset"),
        *by,
    )


CAPACITY = 2048


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, group_col: str | None = None) -> DataFrame:
    return pack(pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity, group_col=group_col), capacity, group_col=group_col)


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"))
