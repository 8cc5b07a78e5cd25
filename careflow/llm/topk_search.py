"""Exact top-k inner products by norm buckets (operator 4).

Vectors are grouped by length into buckets (each a tenth longer than the last), and large buckets into chunks by a
hash of the id. Every query first scores a bounded set of the longest vectors; its k-th best score there is a lower
bound of what its result needs. Then, for each bucket:

* bucket: if |q| times the bucket's largest length is below the bound, the query never meets the bucket;
* length pruning, where the local threshold (bound / |q| / largest length, a cosine) is low: only the vectors of the
  chunk that are long enough by themselves;
* coordinate pruning, where it is high: only the vectors whose direction lies, in the query's largest coordinates,
  inside the range that a cosine of at least the threshold leaves;
* what is left is verified by exact products, and each chunk returns k rows for each query at most.

Queries and vectors meet in blocks (queries in blocks of about BLOCK, chunks of about CHUNK vectors). Components are
whole numbers, so products are exact (floats up to 2^53, beyond it Python integers).

Defined results: vectors that are null or hold null or non-finite components take no part; a vector is compared with
vectors of as many components; every row is a candidate (repeated rows each), but none with the query's own id; a
repeated query row is one query; ties go to the smaller id; fewer than k candidates give all; empty tables no rows;
a score beyond 64 bits is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careflow.llm.common import staged, table

SEEDS, BLOCK, CHUNK = 1024, 2048, 8192
#: Local cosine threshold from which coordinates are used, and the number of coordinates.
COORDINATE_FROM, FOCUS = 0.4, 3
_RATIO = 1.1


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of every component; null if the vector or a component is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def _products(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Exact whole-number products, queries x vectors."""
    if not q.size or not v.size:
        return np.zeros((len(q), len(v)), np.int64)
    if float(np.abs(q).max()) * float(np.abs(v).max()) * q.shape[1] < 2.0**53:
        return (q.astype(float) @ v.astype(float).T).astype(np.int64)
    return q.astype(object) @ v.astype(object).T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best by (score falling, id rising)."""
    if scores.dtype == object:  # beyond 2^53: Python integers
        return np.array(sorted(range(len(scores)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    some = np.arange(len(scores))
    if len(scores) > k:
        some = some[scores >= np.partition(scores, len(scores) - k)[len(scores) - k]]
    return some[np.lexsort((ids[some], -scores[some]))[:k]]


def _bound(score: int) -> float:
    """A score as a float that is not above it (beyond 2^53 a float may round up)."""
    return float(score) if abs(score) <= 1 << 53 else float(np.nextafter(float(score), -np.inf))


def _candidates(q: np.ndarray, q_norm: float, bound: float, norms: np.ndarray, unit: np.ndarray) -> np.ndarray | None:
    """Vectors of a chunk that may reach the bound, or None for all."""
    longest = norms.max()
    local = bound / (q_norm * longest) if q_norm * longest > 0 else -1.0
    if local <= 0:
        return None
    if local > 1 + 1e-9:
        return np.empty(0, np.int64)
    keep = norms * q_norm >= bound * (1 - 1e-9)
    if local >= COORDINATE_FROM:
        qu, t = q / q_norm, local * (1 - 1e-9)
        for f in np.argsort(-np.abs(qu))[:FOCUS]:
            room = np.sqrt(max(0.0, (1 - t * t) * (1 - qu[f] * qu[f]))) + 1e-9
            x = unit[:, f]
            # cosine >= t: the component lies within t * qu[f] +- room, or beyond it towards qu[f]
            low, high = qu[f] * t - room, qu[f] * t + room
            keep &= (x >= low) if qu[f] >= t else (x <= high) if qu[f] <= -t else (x >= low) & (x <= high)
    return np.flatnonzero(keep)


def _search(k: int):
    """Function for one block of queries and one chunk of vectors."""
    schema = pa.schema([("query_id", pa.int64()), ("qkey", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if vectors.num_rows and queries.num_rows:
            dim = vectors["dim"][0].as_py()
            v, ids, norms = _matrix(vectors["v"], dim), vectors["vec_id"].to_numpy(), vectors["norm"].to_numpy()
            unit = v / np.where(norms > 0, norms, 1)[:, None]
            q, qid, qkey = _matrix(queries["v"], dim), queries["query_id"].to_numpy(), queries["qkey"].to_numpy()
            q_norm, bound = queries["norm"].to_numpy(), queries["bound"].to_numpy()
            for a in range(0, len(q), 256):
                some = [_candidates(q[i], q_norm[i], bound[i], norms, unit) for i in range(a, min(a + 256, len(q)))]
                dense = [i for i, c in enumerate(some) if c is None or 4 * len(c) > len(v)]
                full = dict(zip(dense, _products(q[a:][dense], v))) if dense else {}
                for i, c in enumerate(some):
                    scores, cand = (full[i], ids) if i in full else (_products(q[a + i][None], v[c])[0], ids[c])
                    other = np.flatnonzero((cand != qid[a + i]) & (scores >= bound[a + i]))
                    best = other[_best(scores[other], cand[other], k)]
                    out += [(int(qid[a + i]), int(qkey[a + i]), int(cand[b]), int(scores[b])) for b in best]
        return pa.table([pa.array(c, t.type) for c, t in zip(zip(*out), schema)] if out else [pa.array([], t.type) for t in schema], schema=schema)

    return run


def search(vectors: DataFrame, queries: Column, k: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``queries`` selects, its k best among all rows."""
    spark = vectors.sparkSession
    usable = vectors.select(F.col(id_col).cast("long").alias("vec_id"), whole(F.col(vector_col), scale).alias("v"), queries.alias("asked")).filter("v IS NOT NULL")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    usable = usable.withColumns({"dim": F.size("v"), "norm": norm}).filter("dim > 0")
    bucket = F.when(F.col("norm") > 0, F.floor(F.log("norm") / F.log(F.lit(_RATIO)))).otherwise(-(1 << 20)).cast("int")
    usable = staged(usable.withColumn("bucket", bucket), "vectors")

    # one row for each dimension and bucket: lengths of doubles span about 15,000 buckets, in practice a few dozen
    sizes = usable.groupBy("dim", "bucket").agg(F.count("*").alias("n"), F.max("norm").alias("longest")).collect()
    plan = [(r["dim"], r["bucket"], -(-r["n"] // CHUNK), r["longest"]) for r in sizes]
    seeds = [(r["dim"], r["vec_id"], np.array(r["v"], np.int64)) for r in usable.orderBy(F.desc("norm"), "vec_id").limit(SEEDS).collect()]
    asked = usable.filter("asked").withColumn("qkey", F.xxhash64("v")).select("vec_id", "qkey", "v", "dim", "norm").dropDuplicates(["vec_id", "qkey"])
    blocks = max(1, -(-usable.filter("asked").count() // BLOCK))
    shared = spark.sparkContext.broadcast((plan, seeds))
    schema = pa.schema([("query_id", pa.int64()), ("qkey", pa.int64()), ("v", pa.list_(pa.int64())), ("dim", pa.int32()), ("norm", pa.float64()), ("bound", pa.float64()), ("bucket", pa.int32()), ("chunk", pa.int32())])

    def aim(batches):
        """Each query with its bound, once for every chunk of the buckets that it can't skip."""
        all_buckets, all_seeds = shared.value
        by_dim = {d: (np.array([i for e, i, _ in all_seeds if e == d]), np.stack([v for e, _, v in all_seeds if e == d])) for d in {e for e, _, _ in all_seeds}}
        for batch in batches:
            rows = []
            for qid, qkey, v, dim, norm in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "qkey", "v", "dim", "norm"))):
                bound = -np.inf
                if dim in by_dim:
                    ids, matrix = by_dim[dim]
                    scores = np.sort(_products(np.array([v], np.int64), matrix)[0][ids != qid])
                    bound = _bound(scores[-k]) if len(scores) >= k else -np.inf
                for d, b, chunks, longest in all_buckets:
                    if d == dim and norm * longest >= bound * (1 - 1e-9 if bound > 0 else 1):
                        rows += [(qid, qkey, v, dim, norm, bound, b, c) for c in range(chunks)]
            for at in range(0, len(rows), 4096):
                yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows[at : at + 4096]), schema)], schema=schema)

    aimed = asked.mapInArrow(aim, "query_id long, qkey long, v array<long>, dim int, norm double, bound double, bucket int, chunk int")
    aimed = aimed.withColumn("block", F.pmod(F.xxhash64("query_id", "qkey"), F.lit(blocks)).cast("int"))
    chunks = F.coalesce(F.element_at(F.create_map(*(x for d, b, c, _ in plan for x in (F.lit(f"{d}:{b}"), F.lit(c)))) if plan else F.create_map(F.lit(""), F.lit(1)), F.concat_ws(":", "dim", "bucket")), F.lit(1))
    chunked = usable.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), chunks).cast("int"))
    if blocks > 1:
        chunked = chunked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    else:
        chunked = chunked.withColumn("block", F.lit(0))
    keys = ["dim", "bucket", "chunk", "block"]
    met = chunked.select(*keys, "vec_id", "v", "norm").groupBy(*keys).cogroup(aimed.groupBy(*keys)).applyInArrow(_search(k), "query_id long, qkey long, vec_id long, score long")
    order = Window.partitionBy("query_id", "qkey").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)), 10, 1024)


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON len(q.e) = len(c.e) AND q.vec_id != c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""
