"""Removal of repeated word spans on a compacted De Bruijn graph of token k-mers (operator 3).

Every window of ``span`` words (50) is an edge of a De Bruijn graph over a corpus. The edges of a text that share
their smallest ``k``-word hash (the minimizer, of 41 in a window) are consecutive: they are one nonbranching path
inside that text, kept as a single record (anchor hash, hash of the path's words, document, first window, windows).
Equal windows have equal minimizers, so all copies of an edge meet under its anchor:

1. a fixed-size sketch over all anchors tells hot ones; records under an anchor that occurs once are dropped in the
   one shuffle of all records (hot anchors are salted there, and kept);
2. equal paths (same anchor, same words) compact to one class with its smallest document. An anchor with one class
   is not branching: its copies' edges all share that class's smallest document;
3. a branching anchor has several classes, which share some edges: the first copy of each class is looked up by its
   source coordinates, its edges are hashed one by one, and a join by edge gives each class the smallest document of
   each of its edges;
4. each text takes back the edges whose smallest document is smaller than its own, and drops the words they cover.

Texts are shuffled only where a mask over the listed ones says so (steps 3 and 4); all others are judged where they lie.

No group of copies is expanded into pairs, and every window of every text takes part.

Defined results: a null text has no words; texts under ``span`` words have no window; rows with the same doc_id do
not make each other's windows repeated, and each is judged by its own text; rows without doc_id are returned whole
and make no other text repeated; an empty table gives no rows; other columns are neither read nor changed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careflow.llm.common import row_key, split_words, staged, table
from careflow.llm.hashing import Columns, Spans, by_mask, count_sketch, counter_of, hashed_rows, hot_counters, key_mask, mix, rolling

SPAN, K = 50, 10
SALTS = 64


def _paths(w: np.ndarray, span: int, k: int):
    """The paths of a text's word hashes: anchor hash, hash of the path's words, first window, number of windows."""
    grams = rolling(w, k)
    at = np.lib.stride_tricks.sliding_window_view(grams, span - k + 1).argmin(axis=1)
    anchor = np.arange(len(at)) + at
    lo = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    many = np.diff(np.concatenate([lo, [len(at)]]))
    anchor = anchor[lo]
    inner = Spans(w).hash(lo, many + (span - 1))
    return grams[anchor], mix(inner ^ (many * 256 + (anchor - lo)).astype(np.uint64)), lo, many


def _each(batches: Iterator[pa.RecordBatch], span: int, k: int):
    for doc, row, w in hashed_rows(batches, "doc", "row"):
        if len(w) >= span:
            yield doc, row, *_paths(w, span, k)


def path_records(docs: DataFrame, span: int, k: int) -> DataFrame:
    """(h, c, doc, row, lo, many) for every path under an anchor that may occur again. docs: doc, row, text."""
    docs = docs.filter(F.col("doc").isNotNull())

    def keys(batches):
        for _, _, h, *_ in _each(batches, span, k):
            yield h

    hot = docs.sparkSession.sparkContext.broadcast(np.packbits(hot_counters(count_sketch(docs, keys))))  # 128 KB, fixed
    schema = pa.schema([(n, t) for n, t in zip(("h", "salt", "c", "doc", "row", "lo", "many"), (pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int32()))])

    def emit(batches):
        is_hot, out = np.unpackbits(hot.value).astype(bool), Columns(schema)
        for doc, row, h, c, lo, many in _each(batches, span, k):
            salt = np.where(is_hot[counter_of(h)], 1 + (row % SALTS), 0)
            if out.add(h, salt, c, np.full(len(h), doc), np.full(len(h), row), lo, many):
                yield out.take()
        if out.rows:
            yield out.take()

    found = docs.mapInArrow(emit, "h long, salt int, c long, doc long, row long, lo int, many int")
    near = Window.partitionBy("h", "salt").orderBy("doc")
    again = found.withColumn("_same", F.coalesce(F.lag("doc").over(near), F.lead("doc").over(near)).isNotNull())
    return staged(again.filter((F.col("salt") > 0) | F.col("_same")).drop("_same", "salt"), "paths")


def _text_mask(keys: DataFrame):
    """A broadcast mask over the texts named by doc and row."""
    return keys.sparkSession.sparkContext.broadcast(key_mask(keys.select(F.xxhash64("doc", "row").alias("k"))))


def listed_texts(docs: DataFrame, mask) -> DataFrame:
    """docs (doc, row and more) without most rows that are not in the mask, so that a join need not shuffle their texts."""
    keyed = docs.withColumn("_k", F.xxhash64("doc", "row"))
    return keyed.mapInArrow(lambda batches: by_mask(batches, mask.value, True), keyed.schema).drop("_k")


def branching_edges(docs: DataFrame, firsts: DataFrame, span: int) -> DataFrame:
    """(h, c, first, at, e): the edges of branching classes, read at the source coordinates of their first copies."""
    asked = firsts.groupBy("doc", "row").agg(F.collect_list(F.struct("h", "c", "lo", "many")).alias("paths"))  # bounded by the text's own length
    found = listed_texts(docs, _text_mask(firsts)).join(asked.hint("shuffle_hash"), ["doc", "row"])
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("first", pa.int64()), ("at", pa.int32()), ("e", pa.int64())])

    def edges(batches):
        out = Columns(schema)
        for doc, paths, w in hashed_rows(batches, "doc", "paths"):
            spans = Spans(w)
            h, c, lo, many = (np.array([p[x] for p in paths], np.int64) for x in ("h", "c", "lo", "many"))
            at = np.concatenate([np.arange(m) for m in many])
            if out.add(np.repeat(h, many), np.repeat(c, many), np.full(len(at), doc), at, spans.hash(np.repeat(lo, many) + at, span)):
                yield out.take()
        if out.rows:
            yield out.take()

    return found.select("doc", "text", "paths").mapInArrow(edges, "h long, c long, first long, at int, e long")


def repeated_windows(docs: DataFrame, span: int = SPAN, k: int = K) -> DataFrame:
    """Per text with a repeated window: doc, row, and its runs of windows (lo, many, or the indices ``hits``)."""
    paths = path_records(docs, span, k)
    classes = paths.groupBy("h", "c").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
    anchors = classes.groupBy("h").agg(F.count("*").alias("classes"), F.min("first").alias("f"), F.max("last").alias("l")).filter("f < l")
    known = staged(classes.join(anchors.select("h", (F.col("classes") > 1).alias("branching")), "h"), "classes")

    whole = paths.join(known.filter(~F.col("branching")).select("h", "c", "first"), ["h", "c"]).filter("first < doc")
    split = paths.join(known.filter("branching").select("h", "c", "first"), ["h", "c"])
    edges = staged(branching_edges(docs, split.filter("first = doc"), span), "edges")
    least = edges.groupBy("h", "e").agg(F.min("first").alias("least"), F.count("*").alias("n"))
    # an edge that one class alone has is repeated among that class's own copies at most: its least is the class's first
    of_class = edges.join(least.filter("n > 1"), ["h", "e"], "left").groupBy("h", "c").agg(
        F.collect_list(F.struct("at", F.coalesce("least", "first").alias("least"))).alias("edges")  # at most span - k + 1
    )
    of_class = staged(of_class, "class_edges")  # so that the join below shuffles both sides and a hot class can be split
    hits = split.join(of_class, ["h", "c"]).withColumn("hits", F.expr("transform(filter(edges, x -> x.least < doc), x -> x.at)")).filter(F.size("hits") > 0)
    run = lambda df, hits: df.select("doc", "row", F.struct("lo", "many", hits.cast("array<int>").alias("hits")).alias("run"))
    return run(whole, F.lit(None)).unionByName(run(hits, F.col("hits"))).groupBy("doc", "row").agg(F.collect_list("run").alias("runs"))


def _covered(n: int, runs, span: int) -> np.ndarray:
    """Which of n words a repeated window covers."""
    edge = np.zeros(n + 1, np.int64)
    for r in runs or ():
        starts = [r["lo"] + x for x in r["hits"]] if r["hits"] is not None else range(r["lo"], r["lo"] + r["many"])
        for s in starts:
            edge[s] += 1
            edge[s + span] -= 1
    return np.cumsum(edge[:n]) > 0


def _cut(text: str, words: list[str], gone: np.ndarray) -> str:
    """The text without the covered words and the blanks behind them; what stays keeps its own blanks."""
    out, at = [], 0
    for word, drop in zip(words, gone):
        start = text.index(word, at)
        if not drop:
            out.append(text[at:start] + word if out else word)
        at = start + len(word)
    return "".join(out)


def dedup(docs: DataFrame, span: int = SPAN, k: int = K, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), with_text: bool = True) -> DataFrame:
    """Per row: id, n_words, n_removed, kept_sha256, the text that is left (if asked for), and ``carry``'s columns."""
    keyed = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), row_key(text_col).alias("row"))
    full = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), row_key(text_col).alias("row"), *(F.col(c).alias(f"_carry_{i}") for i, c in enumerate(carry)))
    found = staged(repeated_windows(keyed, span, k), "runs")
    mask = _text_mask(found)
    # most texts have no repeated window: these are judged where they are read, only the others meet their runs by shuffle
    joined = listed_texts(full, mask).join(found.hint("shuffle_hash"), ["doc", "row"], "left").drop("row")
    kept = [f"_carry_{i}" for i in range(len(carry))]

    def judge(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part, rows = batch.slice(at, 512), []
                for text, runs in zip(part.column("text").to_pylist(), part.column("runs").to_pylist() if "runs" in part.schema.names else repeat(None)):
                    words = split_words(text)
                    gone = _covered(len(words), runs, span) if runs else None
                    left = [w for w, g in zip(words, gone) if not g] if runs else words
                    rows.append((len(words), len(words) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest(), (_cut(text, words, gone) if runs else text) if with_text else None))
                cols = list(zip(*rows))
                yield pa.record_batch(
                    [part.column("doc"), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.string()), *(part.column(c) for c in kept)],
                    names=["doc", "n_words", "n_removed", "kept_sha256", "text", *kept],
                )

    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in full.select(*kept).schema) if kept else ""
    ddl = "doc long, n_words long, n_removed long, kept_sha256 string, text string" + (", " + types if types else "")
    whole = full.withColumn("_k", F.xxhash64("doc", "row")).mapInArrow(lambda batches: judge(by_mask(batches, mask.value, False)), ddl)
    out = whole.unionByName(joined.mapInArrow(judge, ddl))
    cols = [F.col("doc").alias(id_col), "n_words", "n_removed", "kept_sha256"] + ([F.col("text").alias(text_col)] if with_text else [])
    return out.select(*cols, *(F.col(f"_carry_{i}").alias(c) for i, c in enumerate(carry)))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents", "doc_id", "text"), with_text=False)


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
h AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) AS i FROM (
  SELECT doc_id, list_transform(range(1, len(ws) - 48), lambda i: md5(array_to_string(ws[i:i+49], ' '))) AS hs FROM w WHERE len(ws) >= 50)),
m AS (SELECT h, min(doc_id) AS f FROM h GROUP BY h),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM h JOIN m USING (h) CROSS JOIN (SELECT unnest(range(0, 50)) AS o) WHERE f < doc_id),
each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
kept AS (SELECT e.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
