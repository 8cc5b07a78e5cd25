"""Corpus pipeline: documents through language ID, near-duplicate grouping, substring dedup, decontamination and
packing. Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's result as
Parquet in the shared folder and reads it again as the next stage's documents. All stages but the last return the
columns of their input.

Defined results: documents without text or without a letter go in the first stage; rows without doc_id pass the
second and third stage unchanged; repeated rows (same id, same text) become one in the second stage; of equal or
linked texts the smallest doc_id stays; very long texts are read whole; an empty table gives no rows; columns other than
doc_id, text, lang and n_chars pass every stage under names of their own, whatever they are called."""

from __future__ import annotations

import functools
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.llm import decontaminate, jaccard_join, langid, packing, substring_dedup
from careflow.llm.common import row_key, staged, table
from careflow.llm.hashing import in_mask, key_mask

#: Below this value no language claims the text; such documents go, with those that have no letter. A text's values
#: sum to one over the languages, so with more than EVEN_SHARE / MIN_LANGUAGE_SCORE of them the cut falls with their number.
MIN_LANGUAGE_SCORE, EVEN_SHARE = 0.2, 0.8


def min_score(model: langid.KernelModel) -> float:
    """At most EVEN_SHARE of an even share: more languages alone take no document under it."""
    return min(MIN_LANGUAGE_SCORE, EVEN_SHARE / len(model.languages))


#: Columns of documents that stages read or set.
READ = ("doc_id", "text", "lang", "n_chars")
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def carrying(stage: Stage) -> Stage:
    """A stage that sees all further columns under reserved names, so that none meets a name which it uses inside."""

    @functools.wraps(stage)
    def run_apart(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        names = {c: c if c in READ else f"_carry_{i}" for i, c in enumerate(docs.columns)}
        out = stage(spark, docs.select(*(docs[f"`{c}`"].alias(n) for c, n in names.items())), sf_dir)
        return out.select(*(F.col(n).alias(c) for c, n in names.items()))

    return run_apart


@carrying
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in a language that the model knows and set lang to that language: packing goes by it. The model
    learns from the labelled rows of its input; if it can learn from none, all documents with a letter stay as they are."""
    cols = docs.columns
    model = langid.train(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    judged = langid.predict(docs, model, carry=tuple(c for c in cols if c != "doc_id"))
    return judged.filter((F.col("lang_pred") != langid.UND) & (F.col("score") >= min_score(model))).select(*(F.col("lang_pred").alias(c) if c == "lang" else c for c in cols))


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose id and text hash are in gone (doc, row)."""
    keyed = docs.withColumn("_row", row_key("text"))
    listed = gone.select(F.col("doc").alias("_doc"), F.col("row").alias("_gone")).distinct()
    return keyed.join(listed, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_row") == F.col("_gone")), "left_anti")


@carrying
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents, the one with the smallest doc_id stays; of repeated rows, one.

    Most rows are neither linked to a smaller id nor repeated, and a fixed-size mask over the others proves it for
    nearly all of them: these pass without a shuffle, and only the rest is joined with the exact lists."""
    found = staged(jaccard_join.components(docs), "components")
    later = found.filter(F.col("doc") != F.col("component_id"))
    repeated = found.groupBy("doc", "row").count().filter("count > 1")
    listed = later.select("doc", "row").unionByName(repeated.select("doc", "row"))
    mask = spark.sparkContext.broadcast(key_mask(listed.select(F.xxhash64("doc", "row").alias("k"))))
    keyed = docs.withColumn("_row", row_key("text")).withColumn("_k", F.xxhash64("doc_id", "_row"))

    def part(wanted: bool) -> DataFrame:
        def pick(batches):
            for batch in batches:
                yield batch.filter(pa.array(in_mask(mask.value, batch.column("_k").to_numpy(zero_copy_only=False)) == wanted))

        return keyed.mapInArrow(pick, keyed.schema).select(*docs.columns)

    rest = _without(part(True), later).dropDuplicates(["doc_id", "_row"])
    return part(False).unionByName(rest.select(*docs.columns))


@carrying
def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated spans go from all documents but the first; a document of which nothing is left goes."""
    cols = docs.columns
    cut = substring_dedup.dedup(docs, carry=tuple(c for c in cols if c not in ("doc_id", "text")))
    left = cut.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    return left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*cols)


@carrying
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    found = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))
    return _without(docs, found).select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that are left, in sequences of at most 2048 tokens that hold one language each."""
    return packing.pack_documents(docs, group_col="lang")


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", substring_dedup_stage),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", best_fit_packing),
]

#: The language model and the tokenizer have no SQL form; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
