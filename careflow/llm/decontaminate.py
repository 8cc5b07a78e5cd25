"""Benchmark decontamination by template windows (operator 1, DataFrame functions only).

Texts become templates: numbers, names (capitalised words inside a sentence) and units behind a number turn into
typed placeholders, case and punctuation go. Every ``width``-word window of every document is joined by hash with
the benchmark's windows, so a question with other numbers or names still meets its item. Matches lie on alignments
(document place minus item place). In an alignment each value of the item must stand for one value of the document:
if the item says 12 twice and the document says 30 and 31, the windows that hold the 12 are dropped. A document leaks
an item if the windows that are left are ``min_share`` of the item's windows or more, or if ``min_run`` of them follow
one another in one alignment (a long quote of a longer item).

A template window needs a plain word for each placeholder, otherwise it would fit any list of numbers: a benchmark
window without them joins by its own words instead (case and punctuation aside, no placeholders). An item under
``width`` words is one window of its whole length and joins both ways. Benchmark items with equal text are one item
(the smallest id).

Defined results: null texts and items without a word have no window and give no row, nor do documents shorter than
every window;
repeated document rows give one row for each doc_id and item; rows without id are judged like others; empty tables
give no rows; other columns are neither read nor changed.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careflow.llm.common import row_key, staged, table

WIDTH, MIN_SHARE = 8, 0.5
#: Consecutive windows of one alignment that are a leak whatever their share: a quote of 13 words.
MIN_RUN = 6
#: Placeholders are private-use characters, so that no text holds them: one for each type.
NAME, NUMBER, UNIT = "\ue001", "\ue002", "\ue003"
UNITS = (
    "km|kilometers?|kilometres?|m|meters?|metres?|cm|mm|mi|miles?|ft|feet|foot|in|inch|inches|yards?|kg|kilograms?|g|grams?|mg|lbs?|pounds?|oz|ounces?|tons?|"
    "l|liters?|litres?|ml|gallons?|h|hours?|min|minutes?|s|seconds?|days?|weeks?|months?|years?|dollars?|euros?|cents?|usd|eur|percent|degrees?"
)
BLANKS = r"[\x20\x09-\x0D\x{E001}-\x{E003}]+"
MARKS = NAME + NUMBER + UNIT
PUNCTUATION = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'’‘“”«»„…–—¿¡"
#: Benchmark windows up to which they are broadcast (about 200 bytes each), and distinct ones up to which documents'
#: windows are looked up in a set of literals before they become rows. Beyond either, the same join does the work.
BROADCAST_WINDOWS, LITERAL_WINDOWS = 200_000, 20_000
#: Benchmark items whose windows make up one file: their number follows the benchmark, not the shuffle's partitions.
FILE_ITEMS = 10_000
_NAME = rf"([^.!?:\x20] )\p{{Lu}}\p{{L}}+"
_NUMBER = r"[0-9]+(?:[.,:/][0-9]+)*"
_UNIT = rf"({NUMBER} ?)(?:{UNITS})([^\p{{L}}]|$)"


def flat(text: Column) -> Column:
    """The text with every run of blanks (and placeholder characters of its own) as one space."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def template(line: Column) -> Column:
    """Canonical form of a flat text, word for word (a word may become empty)."""
    for _ in range(2):  # of neighbouring names, the first pass takes every other one
        line = F.regexp_replace(line, _NAME, f"$1{NAME}")
    line = F.regexp_replace(F.lower(line), _NUMBER, NUMBER)
    return F.translate(F.regexp_replace(line, _UNIT, f"$1{UNIT}$2"), PUNCTUATION, "")


def windows(texts: DataFrame, width: int, with_win: bool = False, only: list[int] | None = None) -> DataFrame:
    """Per window: the columns but text, pos, h (hash of its canonical words), raw (the words as they are, if any is a
    placeholder) and, if asked for, win (the canonical words). texts: any columns and text. ``only``: hashes of the
    windows that are wanted."""
    keys = [c for c in texts.columns if c != "text"]
    lines = texts.filter(F.col("text").isNotNull()).select(*keys, flat(F.col("text")).alias("line"))
    canonical = lines.select(*keys, "line", template(F.col("line")).alias("t"))
    words = canonical.select(*keys, F.split("line", " ").alias("rw"), F.split("t", " ").alias("cw"), F.col("t").rlike(f"[{MARKS}]").alias("marked"))
    hashed = words.select(*keys, "rw", "cw", "marked", F.transform("cw", lambda w: F.xxhash64(w)).alias("wh"))
    # what a lambda reads is used elsewhere too, so that the optimizer keeps it as a column and does not compute it once
    # a window; there is no filter on sizes, since it would be pushed down with a second copy of the whole template
    starts = F.when(F.size("wh") >= width, F.sequence(F.lit(1), F.size("wh") - (width - 1)))
    h = lambda i: F.xxhash64(F.slice("wh", i, width))
    if only is not None:
        starts = F.filter(starts, lambda i: h(i).isin(only))
    win = lambda i: F.array_join(F.slice("cw", i, F.least(F.size("cw"), F.lit(width))), " ")
    raw = lambda i: F.when(F.col("marked") & win(i).rlike(f"[{MARKS}]"), F.array_join(F.slice("rw", i, F.least(F.size("rw"), F.lit(width))), " "))
    one = lambda i: F.struct(i.alias("pos"), h(i).alias("h"), raw(i).alias("raw"), *([win(i).alias("win")] if with_win else []))
    return hashed.select(*keys, F.explode(F.transform(starts, one)).alias("w")).select(*keys, "w.*")


def exact_windows(texts: DataFrame, width: int, only: list[int] | None = None) -> DataFrame:
    """As windows, without placeholders: the columns but text, pos, h (hash of the words in lower case, without
    punctuation), raw (null)."""
    keys = [c for c in texts.columns if c != "text"]
    clean = texts.filter(F.col("text").isNotNull()).select(*keys, _words(flat(F.col("text"))).alias("cw"))
    hashed = clean.select(*keys, "cw", F.transform("cw", lambda w: F.xxhash64(w)).alias("wh"))
    starts = F.when(F.size("wh") >= width, F.sequence(F.lit(1), F.size("wh") - (width - 1)))
    h = lambda i: F.xxhash64(F.slice("wh", i, width))
    if only is not None:
        starts = F.filter(starts, lambda i: h(i).isin(only))
    one = lambda i: F.struct(i.alias("pos"), h(i).alias("h"), F.lit(None).cast("string").alias("raw"))
    return hashed.select(*keys, F.explode(F.transform(starts, one)).alias("w")).select(*keys, "w.*")


def benchmark_windows(items: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(width, exact, h, item, ipos, iwin, iraw, n_windows) for the windows of distinct item texts; iwin and iraw are
    null if the window joins by its own words (exact)."""
    texts = items.filter(F.col(text_col).isNotNull()).groupBy(F.col(text_col).alias("text")).agg(F.min(id_col).alias("item"))
    texts = texts.withColumn("n", F.size(F.split(flat(F.col("text")), " ")))
    short = sorted(r["n"] for r in texts.filter(F.col("n") < width).select("n").distinct().collect())  # under `width` rows
    each = windows(texts.filter(F.col("n") >= width).drop("n"), width, with_win=True).withColumn("width", F.lit(width))
    for n in short:
        each = each.unionByName(windows(texts.filter(F.col("n") == n).drop("n"), n, with_win=True).withColumn("width", F.lit(n)))
    marks = F.length("win") - F.length(F.translate("win", MARKS, ""))
    each = each.withColumns({"marks": marks, "plain": F.size(F.filter(F.split("win", " "), lambda w: w.rlike(r"^[^\x{E001}-\x{E003}]+$")))})
    each = each.filter((F.col("width") == width) | (F.col("plain") + F.col("marks") > 0)).withColumn("usable", F.col("plain") >= F.col("marks"))
    place = ["item", F.col("pos").alias("ipos")]
    by_template = each.filter("usable").select("width", F.lit(False).alias("exact"), "h", *place, F.col("win").alias("iwin"), F.col("raw").alias("iraw"))
    own = F.xxhash64(F.transform(_words(F.coalesce("raw", "win")), lambda w: F.xxhash64(w)))  # without placeholders, win is the words
    none = F.lit(None).cast("string")
    by_words = each.filter(~F.col("usable") | (F.col("width") < width)).select("width", F.lit(True).alias("exact"), own.alias("h"), *place, none.alias("iwin"), none.alias("iraw"))
    return by_template.unionByName(by_words).join(each.groupBy("item").agg(F.countDistinct("pos").alias("n_windows")), "item")


def _words(line: Column) -> Column:
    """Words of a flat text, lower-cased and without punctuation."""
    return F.split(F.translate(F.lower(line), PUNCTUATION, ""), " ")


def _values(raw: str, win: str) -> Column:
    """Words of a window with their canonical form, lower-cased and without punctuation, where it is a placeholder."""
    return _words(F.col(raw)), F.split(F.col(win), " ")


def leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, min_share: float = MIN_SHARE, id_col: str = "doc_id", text_col: str = "text", min_run: int = MIN_RUN) -> DataFrame:
    """(doc, row, item, n_windows, n_matched) of leaking documents; row is the hash of the document's text."""
    bench = staged(benchmark_windows(items, width).coalesce(max(1, math.ceil(items.count() / FILE_ITEMS))), "benchmark")
    hashes = bench.select("exact", "width", "h").distinct().limit(LITERAL_WINDOWS + 1).collect()
    literal = len(hashes) <= LITERAL_WINDOWS
    kinds = [(r["exact"], r["width"]) for r in bench.select("exact", "width").distinct().orderBy("exact", "width").collect()]  # at most two for each width
    small = bench.count() <= BROADCAST_WINDOWS
    texts = docs.select(F.col(id_col).alias("doc"), row_key(text_col).alias("row"), F.col(text_col).alias("text"))
    met = None
    for exact, n in kinds or [(False, width)]:
        only = [r["h"] for r in hashes if (r["exact"], r["width"]) == (exact, n)] if literal else None
        wanted = bench.filter((F.col("exact") == exact) & (F.col("width") == n)).drop("exact", "width")
        joined = (exact_windows if exact else windows)(texts, n, only=only).join(F.broadcast(wanted) if small else wanted, "h")
        met = joined if met is None else met.unionByName(joined)
    met = met.withColumn("diag", F.col("pos") - F.col("ipos"))
    met = staged(met.select("doc", "row", "item", "diag", "ipos", "iwin", "raw", "iraw", "n_windows"), "matches")

    (dv, iw), (iv, _) = _values("raw", "iwin"), _values("iraw", "iwin")
    where = ["doc", "row", "item", "diag"]
    pairs = met.filter("raw IS NOT NULL").select(*where, "ipos", F.explode(F.arrays_zip(dv.alias("d"), iv.alias("i"), iw.alias("t"))).alias("s"))
    slots = pairs.filter(F.col("s.t").rlike(r"[\x{E001}-\x{E003}]")).select(*where, "ipos", F.col("s.i").alias("value"), F.col("s.d").alias("said"))
    torn = slots.groupBy(*where, "value").agg(F.min("said").alias("a"), F.max("said").alias("b")).filter("a != b")
    torn = torn.select(*(F.col(c).alias(f"_{c}") for c in (*where, "value")))

    def same(cols: list[str]) -> Column:
        return reduce(Column.__and__, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cols))

    dropped = slots.join(torn, same([*where, "value"]), "left_semi").select(*(F.col(c).alias(f"_{c}") for c in (*where, "ipos"))).distinct()
    left = met.join(dropped, same([*where, "ipos"]), "left_anti").select(*where, "ipos", "n_windows").distinct()
    along = Window.partitionBy(*where).orderBy("ipos")
    left = left.withColumn("run", F.coalesce(F.lag("ipos", min_run - 1).over(along) == F.col("ipos") - (min_run - 1), F.lit(False)))
    found = left.groupBy("doc", "row", "item", "n_windows").agg(F.countDistinct("ipos").alias("n_matched"), F.max("run").alias("run"))
    return found.filter((F.col("n_matched") >= F.lit(min_share) * F.col("n_windows")) | F.col("run")).drop("run")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "n_windows").agg(F.max("n_matched").alias("n_matched"))


def _sql_windows(name: str, source: str, key: str) -> str:
    q = lambda s: s.replace("'", "''")
    line = f"trim(regexp_replace(text, '{BLANKS}', ' ', 'g'))"
    return f"""
{name}_line AS (SELECT {key} AS id, {line} AS line FROM {source}),
{name}_named AS (SELECT id, line, regexp_replace(regexp_replace(line, '{_NAME}', '\\1{NAME}', 'g'), '{_NAME}', '\\1{NAME}', 'g') AS t FROM {name}_line),
{name}_words AS (SELECT id, string_split(line, ' ') AS rw, string_split(translate(regexp_replace(regexp_replace(lower(t), '{_NUMBER}', '{NUMBER}', 'g'),
  '{_UNIT}', '\\1{UNIT}\\2', 'g'), '{q(PUNCTUATION)}', ''), ' ') AS cw FROM {name}_named),
{name}_each AS (SELECT id, rw, cw, unnest(range(1, len(cw) - {WIDTH - 2})) AS i FROM {name}_words WHERE len(cw) >= {WIDTH}),
{name}_win AS (SELECT id, i AS pos, array_to_string(cw[i:i+{WIDTH - 1}], ' ') AS win, cw[i:i+{WIDTH - 1}] AS cs, rw[i:i+{WIDTH - 1}] AS rs FROM {name}_each)"""


ORACLE_SQL = f"""
WITH items AS (SELECT min(item_id) AS item_id, text FROM benchmark WHERE text IS NOT NULL GROUP BY text),
{_sql_windows("b", "items", "item_id")},
{_sql_windows("d", "documents", "doc_id")},
usable AS (SELECT id AS item, pos AS ipos, win, cs, rs FROM b_win
  WHERE len(list_filter(cs, lambda w: regexp_matches(w, '^[^{NAME}{NUMBER}{UNIT}]+$'))) >= length(win) - length(translate(win, '{MARKS}', ''))),
sized AS (SELECT item, count(*) AS n_windows FROM usable GROUP BY item),
met AS (SELECT d.id AS doc, u.item, d.pos - u.ipos AS diag, u.ipos, u.cs, d.rs AS ds, u.rs AS bs FROM d_win d JOIN usable u USING (win)),
slots AS (SELECT doc, item, diag, unnest(cs) AS t, unnest(ds) AS dv, unnest(bs) AS bv FROM met),
clean AS (SELECT doc, item, diag, translate(lower(dv), '{PUNCTUATION.replace("'", "''")}', '') AS dv, translate(lower(bv), '{PUNCTUATION.replace("'", "''")}', '') AS bv
  FROM slots WHERE regexp_matches(t, '[{NAME}{NUMBER}{UNIT}]')),
torn AS (SELECT DISTINCT doc, item, diag FROM (SELECT doc, item, diag, bv FROM clean GROUP BY ALL HAVING min(dv) != max(dv)))
SELECT doc AS doc_id, item AS item_id, n_windows, count(DISTINCT ipos) AS n_matched
FROM met ANTI JOIN torn USING (doc, item, diag) JOIN sized USING (item)
GROUP BY doc, item, n_windows HAVING count(DISTINCT ipos) >= {MIN_SHARE} * n_windows
"""
