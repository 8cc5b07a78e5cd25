"""Language identification with a string kernel (operator 2).

A text is the set of its character n-grams, n = 1..N (blended spectrum, presence only), and the kernel of two texts
is the cosine of those sets. A bounded, stratified sample of labelled rows is split into Nystroem landmarks and
ridge rows: with K the landmarks' kernel matrix, a text maps to ``k(x) K^(-1/2)`` and one ridge regression per
language (one against the rest, targets 0/1) is solved in that space. Scoring is two matrix products per block of
texts: presence (texts x n-grams) by landmarks, then kernel values by weights.

n-grams are taken over a small alphabet: the letters that occur in the landmarks, one symbol for any other letter,
one for a run of anything that is no letter. Texts are taken whole, folded to lower case.

Defined results: `und` with score 0 if the text is null or has no letter, or if nothing can be learned (an empty
table or no labelled row); ties go to the language first in alphabetical order; repeated rows get equal results;
lang, source and id of a row to be judged are never read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careflow.llm.common import table

UND = "und"
#: The classifier's bounds: labelled rows in all, landmarks among them, and characters of a labelled row.
SAMPLE_ROWS, LANDMARKS, SAMPLE_CHARS = 1200, 96, 20_000
#: Languages that are learned at most, the most frequent first.
MAX_LANGUAGES = 200
NGRAM, RIDGE = 3, 1e-2
#: n-gram codes up to which a table of all of them is kept in memory; beyond it codes are looked up in the landmarks' own.
MAX_CODES = 1 << 26
_NO_LETTERS = re.compile(r"[\W\d_]+")


def _codes(text: str, alphabet: np.ndarray, width: int, n: int) -> list[np.ndarray]:
    """n-gram codes of a text for 1..n, each order in its own range. Symbol 0 is a gap, 1 an unknown letter."""
    folded = _NO_LETTERS.sub(" ", text.lower())
    points = np.frombuffer(f" {folded.strip()} ".encode("utf-32-le", "replace"), np.uint32)
    s = alphabet[np.minimum(points, len(alphabet) - 1)].astype(np.int64)
    out, code, base = [s], s, width
    for k in range(2, n + 1):
        if len(s) < k:
            break
        code = code[:-1] * width + s[k - 1 :]
        out.append(code + base)
        base += width**k
    return out


@dataclass
class KernelModel:
    languages: list[str]
    alphabet: np.ndarray  # code point -> symbol; last entry: any code point beyond
    width: int
    n: int
    grams: np.ndarray  # sorted n-gram codes of the landmark matrix
    column: np.ndarray | None  # n-gram code -> column of the landmark matrix, or -1; None if there are too many codes for a table
    landmarks: np.ndarray  # n-grams x landmarks, presence over root of set size
    weights: np.ndarray  # landmarks x languages
    bias: np.ndarray

    def kernel(self, texts: list[str]) -> np.ndarray:
        """Kernel values, texts x landmarks."""
        x = np.zeros((len(texts), self.landmarks.shape[0]), np.float32)
        seen = np.zeros(0 if self.column is None else len(self.column), np.int32)
        for i, text in enumerate(texts):
            codes = np.concatenate(_codes(text, self.alphabet, self.width, self.n))
            if self.column is None:
                distinct = np.unique(codes)
                at = np.minimum(np.searchsorted(self.grams, distinct), len(self.grams) - 1)
                x[i, at[self.grams[at] == distinct]] = 1 / np.sqrt(len(distinct))
                continue
            order = np.arange(1, len(codes) + 1, dtype=np.int32)
            seen[codes] = order  # the last writer of a code stands for it: no sort, no reset
            distinct = codes[seen[codes] == order]
            at = self.column[distinct]
            x[i, at[at >= 0]] = 1 / np.sqrt(len(distinct))
        return x @ self.landmarks

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        values = self.kernel(texts) @ self.weights + self.bias
        best = values.argmax(axis=1)
        return [self.languages[b] for b in best], np.clip(values[np.arange(len(texts)), best], 0, 1).astype(float)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def fit(texts: list[str], langs: list[str], n: int = NGRAM, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel | None:
    """Fit on a bounded sample that is already in driver memory, in the order given (landmarks come first; the first
    text of each language is one)."""
    keep = [i for i, t in enumerate(texts) if has_letter(t)]
    texts, langs = [texts[i] for i in keep], [langs[i] for i in keep]
    if not texts:
        return None
    languages = sorted(set(langs))
    others = sorted({lang: i for i, lang in reversed(list(enumerate(langs)))}.values())
    marks = [*texts[:landmarks], *(texts[i] for i in others if i >= landmarks)]
    letters = sorted({c for t in marks for c in _NO_LETTERS.sub("", t.lower()) if ord(c) < 0x10000})
    alphabet = np.ones(0x10001, np.int32)
    alphabet[32] = 0
    for k, c in enumerate(letters):
        alphabet[ord(c)] = k + 2
    width = len(letters) + 2
    size = sum(width**k for k in range(1, n + 1))
    sets = [np.unique(np.concatenate(_codes(t, alphabet, width, n))) for t in marks]
    grams = np.unique(np.concatenate(sets))
    column = None
    if size <= MAX_CODES:
        column = np.full(size, -1, np.int32)
        column[grams] = np.arange(len(grams))
    matrix = np.zeros((len(grams), len(marks)), np.float32)
    for j, g in enumerate(sets):
        matrix[np.searchsorted(grams, g), j] = 1 / np.sqrt(len(g))
    model = KernelModel(languages, alphabet, width, n, grams, column, matrix, np.zeros((len(marks), len(languages)), np.float32), np.zeros(len(languages), np.float32))
    values, vectors = np.linalg.eigh((matrix.T @ matrix).astype(float))
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T  # K^(-1/2)
    z = np.concatenate([model.kernel(texts[a : a + 256]) for a in range(0, len(texts), 256)]).astype(float) @ root
    y = (np.array(langs)[:, None] == np.array(languages)[None, :]).astype(float)
    mean_z, mean_y = z.mean(axis=0), y.mean(axis=0)
    beta = np.linalg.solve((z - mean_z).T @ (z - mean_z) + ridge * np.eye(z.shape[1]), (z - mean_z).T @ (y - mean_y))
    model.weights, model.bias = (root @ beta).astype(np.float32), (mean_y - mean_z @ beta).astype(np.float32)
    return model


def training_sample(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[str]]:
    """At most ``rows`` labelled rows of at most ``chars`` characters, the same number of each language as far as it
    goes, chosen by a hash of the id; the first of each language come first. Only ids are ranked and shuffled, and of
    a frequent language only those with hashes so small that twice ``rows`` of them are expected."""
    usable = labelled.filter(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}") & (F.length(text_col) <= chars))
    counts = usable.groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(MAX_LANGUAGES).collect()
    if not counts:
        return [], []
    share = F.element_at(F.create_map(*(F.lit(x) for r in counts for x in (r[0], 2.0 * rows / r["count"]))), F.col("_lang"))
    ids = usable.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.xxhash64(F.lit("langid"), id_col).alias("_h"))
    ids = ids.filter(F.pmod("_h", F.lit(1 << 40)) / float(1 << 40) < share)
    top = ids.withColumn("_n", F.row_number().over(Window.partitionBy("_lang").orderBy("_h", "_id"))).filter(F.col("_n") <= rows)
    chosen = top.orderBy("_n", "_h", "_lang").limit(rows).select("_id", "_lang", "_n", "_h")
    got = (
        usable.join(F.broadcast(chosen), (F.col(id_col) == F.col("_id")) & (F.col(lang_col) == F.col("_lang")))
        .select("_n", "_h", "_lang", text_col).orderBy("_n", "_h", "_lang").limit(rows).collect()
    )
    return [r[3] for r in got], [r[2] for r in got]


def predict(docs: DataFrame, model: KernelModel | None, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: id, lang_pred, score. ``carry`` passes further columns through (Arrow types as they are)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # bounded by the sample's bounds
    kept = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"), *carry)
    out_ddl = "_id long, lang_pred string, score double"
    schema = pa.schema([("_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
    extra = kept.select(*carry).schema if carry else None

    def blocks(batches: Iterator[pa.RecordBatch], size: int = 128):
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                yield batch.slice(at, size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in blocks(batches):
            texts = part.column("_text").to_pylist()
            known = [i for i, t in enumerate(texts) if m is not None and has_letter(t)]
            lang, score = [UND] * len(texts), np.zeros(len(texts))
            if known:
                best, values = m.decide([texts[i] for i in known])
                score[known] = values
                for i, b in zip(known, best):
                    lang[i] = b
            yield pa.record_batch([part.column("_id").cast(pa.int64()), pa.array(lang), pa.array(score), *(part.column(c) for c in carry)], names=[*schema.names, *carry])

    ddl = out_ddl if extra is None else out_ddl + ", " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in extra)
    return kept.mapInArrow(run, ddl).withColumnRenamed("_id", id_col)


def held_out(id_col: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame) -> KernelModel | None:
    """The production model: learned from rows outside the held-out third."""
    return fit(*training_sample(docs.filter(~held_out())))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    return predict(docs, train(docs)).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
