"""Table-driven rules (C9, C10) and the two SQL scalar functions.

C9 attaches the rules row of each CTAS level by an equi-join with the rules
table (reference data; broadcast if its estimated size is under the bound).

C10 flags each text with the keywords it contains. A small keyword table is
read on the driver and becomes one substring test per keyword over the text's
normalized column, which is computed once: the text stream is never shuffled
and no pair rows are produced. A larger one is an index: each phrase is posted
under its rarest q-gram, the distinct q-grams of a text join the postings, and
only the phrases that this brings to a text are looked for in it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.functions import lexicon as L
from careflow.functions.text import normalize_main, normalize_scored
from careflow.plans.sizing import broadcast_if_small, staged


#: Keyword rows up to which a table is built into the plan, one substring test each; beyond it phrases are indexed.
MAX_KEYWORDS = 5_000
#: Letters of the grams under which phrases are posted; shorter phrases are grams themselves.
GRAM = 4


def attach_rules(df: DataFrame, rules: DataFrame, level_col: str = "provisional_ctas_level") -> DataFrame:
    """Left join the rules row of each level (levels outside 1-5 keep NULL rule columns)."""
    r = rules.withColumnRenamed("ctas_level", "_rule_level")
    return df.join(broadcast_if_small(r), F.col(level_col) == F.col("_rule_level"), "left").drop("_rule_level")


def _few(keywords: DataFrame) -> list | None:
    """The rows of a keyword table, if they are few enough to be built into a plan."""
    rows = keywords.limit(MAX_KEYWORDS + 1).collect()
    return rows if len(rows) <= MAX_KEYWORDS else None


def _grams(text: Column, size: int) -> Column:
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - (size - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda i: F.substring(text, i, F.lit(size))))


def with_hits(df: DataFrame, norm: Column, keywords: DataFrame, phrase: str) -> DataFrame:
    """df with ``_hits``: an array of the keyword rows whose phrase the normalized text contains (empty if none).

    Of a phrase's grams the one that the fewest phrases share is its rarest. A text holds a phrase only if it holds
    that gram, so no phrase is missed; the phrases that a gram brings to a text are verified in the text."""
    row = F.struct(*keywords.columns)
    everywhere = [r.asDict() for r in keywords.filter(F.col(phrase) == "").collect()]  # the empty phrase's own rows
    sized = keywords.filter(F.col(phrase) != "").select(row.alias("k"), F.least(F.length(phrase), F.lit(GRAM)).alias("size"))
    pieces = reduce(lambda c, n: c.when(F.col("size") == n, _grams(F.col(f"k.{phrase}"), n)), range(2, GRAM + 1), F.when(F.col("size") == 1, _grams(F.col(f"k.{phrase}"), 1)))
    spread = sized.withColumn("gram", F.explode(pieces))
    shared = spread.groupBy("gram").agg(F.count("*").alias("many"))
    posted = staged(spread.join(shared, "gram").groupBy("k").agg(F.min_by("gram", F.struct("many", "gram")).alias("gram")), "phrases")
    sizes = sorted(r[0] for r in posted.select(F.length("gram")).distinct().collect())  # GRAM at most

    texts = staged(df.withColumns({"_id": F.monotonically_increasing_id(), "_norm": norm}), "texts")
    found = texts.select("_id", F.explode(F.concat(*(_grams(F.col("_norm"), n) for n in sizes)) if sizes else F.array().cast("array<string>")).alias("gram"))
    brought = found.join(posted, "gram").groupBy("_id").agg(F.collect_list("k").alias("_k"))
    held = F.filter(F.coalesce("_k", F.array().cast(brought.schema["_k"].dataType)), lambda k: F.col("_norm").contains(k[phrase]))
    always = F.array(*(F.struct(*(F.lit(r[c]).alias(c) for c in keywords.columns)) for r in everywhere)) if everywhere else F.array()
    return texts.join(brought, "_id", "left").withColumn("_hits", F.concat(held, always.cast(brought.schema["_k"].dataType))).drop("_k", "_id", "_norm")


def _sum(columns: list[Column]) -> Column:
    total = F.lit(0)
    for c in columns:
        total = total + c
    return total


def keyword_flags_main(df: DataFrame, keywords: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """C10 (main table): flags = sorted distinct flag labels of contained keywords; weight = sum of their weights."""
    keywords = keywords.filter(F.col("keyword").isNotNull()).select("keyword", "flag_label", "severity_weight")
    if (rows := _few(keywords)) is None:
        out = with_hits(df, normalize_main(F.col(text_col)), keywords, "keyword")
        weight = F.aggregate("_hits", F.lit(0).cast("long"), lambda total, k: total + F.coalesce(k["severity_weight"], F.lit(0)))
        labels = F.array_sort(F.array_distinct(F.array_compact(F.transform("_hits", lambda k: k["flag_label"]))))
        return out.withColumns({"keyword_flags": labels, "keyword_weight": weight.cast("int"), "keyword_hits": F.size("_hits")}).drop("_hits")
    hits = [F.col("_norm").contains(k["keyword"]) for k in rows]
    flags = [F.when(h, F.lit(k["flag_label"])) for h, k in zip(hits, rows)]
    return df.withColumn("_norm", normalize_main(F.col(text_col))).withColumns(
        {
            "keyword_flags": F.array_sort(F.array_distinct(F.array_compact(F.array(*flags)))) if rows else F.array().cast("array<string>"),
            "keyword_weight": _sum([F.when(h, F.lit(k["severity_weight"])).otherwise(0) for h, k in zip(hits, rows)]),
            "keyword_hits": _sum([h.cast("int") for h in hits]),
        }
    ).drop("_norm")


def keyword_flags_scored(df: DataFrame, keywords: DataFrame, text_col: str = "raw_text") -> DataFrame:
    """C10 (scored table): active phrases contained in the H2-normalized text, by severity class."""
    keywords = keywords.filter(F.col("active_flag") & F.col("normalized_phrase").isNotNull()).select("keyword_id", "normalized_phrase", "severity_class")
    if (rows := _few(keywords)) is None:
        out = with_hits(df, normalize_scored(F.col(text_col)), keywords, "normalized_phrase")
        count = lambda c: F.size(F.filter("_hits", lambda k: k["severity_class"] == c))
        ids = F.array_sort(F.array_compact(F.transform("_hits", lambda k: k["keyword_id"])))
        return out.withColumns({"matched_keyword_ids": ids, **{f"{c}_hits": count(c) for c in ("strong_emergency", "serious_concern", "mild_concern")}}).drop("_hits")
    hits = [F.col("_norm").contains(k["normalized_phrase"]) for k in rows]
    ids = [F.when(h, F.lit(k["keyword_id"])) for h, k in zip(hits, rows)]
    of = lambda c: _sum([h.cast("int") for h, k in zip(hits, rows) if k["severity_class"] == c])
    return df.withColumn("_norm", normalize_scored(F.col(text_col))).withColumns(
        {
            "matched_keyword_ids": F.array_sort(F.array_compact(F.array(*ids))) if rows else F.array().cast("array<string>"),
            "strong_emergency_hits": of("strong_emergency"),
            "serious_concern_hits": of("serious_concern"),
            "mild_concern_hits": of("mild_concern"),
        }
    ).drop("_norm")


def _case(arms: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, v in arms) + f" ELSE '{default}' END"


def register_sql_functions(spark: SparkSession) -> None:
    """Session SQL functions with the reference's names and bodies."""
    label = _case([(f"ctas_level = {k}", v) for k, v in L.CTAS_LABELS.items()], L.CTAS_LABELS[5])
    band = _case([(f"risk_score >= {t}", b) for t, b in L.RISK_BANDS], L.RISK_BAND_DEFAULT)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION ctas_label_from_level(ctas_level INT) RETURNS STRING RETURN {label}")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION risk_band_from_score(risk_score INT) RETURNS STRING RETURN {band}")
