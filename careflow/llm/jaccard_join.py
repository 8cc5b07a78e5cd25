"""Jaccard join of word-shingle sets by grouped prefixes (operator 8).

A document's set holds its distinct ``width``-word shingles; two documents link when 100 * intersection is at least
75 * union. With all shingles in one global order, two linked sets share a shingle within their prefixes of
``n - ceil(3 (n + ceil(3n/4)) / 7) + 1`` shingles. The order puts frequent shingles last, so that passages
which many documents share stay out of most prefixes. They are found in two passes over all texts: shingles in one part
of the hash range are counted exactly, and then all shingles around those that are frequent. They are kept in masks of
bounded size. Any order gives the same links; this one keeps the lists short.

1. documents with equal sets are one class; classes with equal prefix and size are one group, and only groups post
   their prefix shingles. Shingles that one group alone posts go in one shuffle (hot ones are salted there);
2. filter group pairs: the groups under a shingle, in bands of similar size, pair with the band's first group, if
   the sizes and the places of the shared shingle allow enough in common, and each keeps the two such groups it
   shares most with; inside a group, classes pair with its first;
3. expand and verify: pairs of classes whose parity bits leave room for a link (one bit for each shingle, an exact
   bound on how many members differ) get their whole texts and are compared set by set; links make components;
4. what is left: under shingles (and in groups) that still hold several components, classes of different components
   pair, under the same filters, and are verified likewise. Pairs inside a component need no check: they change no
   component. So no link between different components is lost, and a large group of copies is never paired out.

Texts are taken whole, A-Z folded to lower case. Defined results: null or blank texts have an empty set and stay
alone; fewer words than ``width`` make one shingle of the whole sequence; rows without doc_id stay alone and get no
component id; repeated rows share a class; an empty table gives no rows; other columns are neither read nor changed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from careflow.llm.common import batches_of, row_key, rows_of, staged, table
from careflow.llm.components import roots
from careflow.llm.hashing import Columns, hashed_rows, in_mask, key_mask, mix, rolling, sequence_hash, word_hashes

WIDTH = 5
SALTS = 64
#: Documents from which a shingle goes behind all rarer ones in the global order: frequent, and very frequent.
FREQUENT = (8, 256)
#: Of the shingles one in 2^this is counted first, and the others within so many places of a frequent one after that.
#: Of a passage that is frequent, one in 5,000 of its shingles has no counted one within those places.
COUNTED_BITS, AROUND = 3, 64


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return _shingles(word_hashes(text, fold=True), width)


def _shingles(w: np.ndarray, width: int) -> np.ndarray:
    if len(w) < width:
        return mix(rolling(w, len(w)) + np.uint64(len(w))) if len(w) else w
    h = np.sort(rolling(w, width))
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


def prefix_length(n: int) -> int:
    least_partner = -(-3 * n // 4)
    return n + 1 - -(-3 * (n + least_partner) // 7)


def _levels(s: np.ndarray, masks: list[np.ndarray]) -> np.ndarray:
    """How frequent each shingle is: the number of masks that hold it."""
    return sum(in_mask(m, s).astype(np.int64) for m in masks)


def _prefix(s: np.ndarray, masks: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The prefix of a set in the global order (level, hash), and the levels."""
    level = _levels(s, masks)
    first = np.lexsort((s, level))[: prefix_length(len(s))]
    return s[first], level[first]


def _group(prefix: np.ndarray, level: np.ndarray, n: int) -> int:
    """Identity of a prefix and a size: 56 bits of hash behind a rank, so that the smallest group under a shingle is
    the one whose prefix holds most frequent shingles. In a large group of near copies that is the least edited one,
    which links with more of the others than any chosen at random."""
    rank = 127 - round(254 * float((level > 0).mean()))
    return rank << 56 | _one(prefix, n) & ((1 << 56) - 1)


def _sets(batches: Iterator[pa.RecordBatch], width: int):
    for doc, row, w in hashed_rows(batches, "doc", "row", fold=True):
        yield doc, row, _shingles(w, width)


def _one(x: np.ndarray, n: int) -> int:
    """One signed 64-bit hash of an ordered run of hashes and a size."""
    return int(mix(sequence_hash(x)[None] + np.uint64(n)).view(np.int64)[0]) if n else 0


def frequent_shingles(docs: DataFrame, width: int) -> DataFrame:
    """(k, n): shingles of FREQUENT[0] documents or more, as far as the two passes find them, with their number."""
    schema = pa.schema([("k", pa.int64())])

    def counted(pick) -> DataFrame:
        def keys(batches):
            out = Columns(schema)
            for _, _, w in hashed_rows(batches, "doc", "row", fold=True):
                h = rolling(w, width)
                if len(some := np.unique(h[pick(h)])) and out.add(some):
                    yield out.take()
            if out.rows:
                yield out.take()

        found = docs.mapInArrow(keys, "k long").groupBy("k").agg(F.count("*").alias("n"))
        return staged(found.filter(F.col("n") >= FREQUENT[0]), "frequent")

    first = lambda h: h >> np.uint64(64 - COUNTED_BITS) == 0
    mask = docs.sparkSession.sparkContext.broadcast(key_mask(counted(first).select("k")))

    def near(h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(first(h) & in_mask(mask.value, h))
        edges = np.zeros(len(h) + 1, np.int32)
        np.add.at(edges, np.maximum(at - AROUND, 0), 1)
        np.add.at(edges, np.minimum(at + AROUND + 1, len(h)), -1)
        return np.cumsum(edges[:-1]) > 0

    return counted(near)


def parity_bits(s: np.ndarray) -> bytes:
    """Parity of the number of hashes in each of 2^k >= n equal parts of the hash range. Sets differ in at least as
    many members as their bits differ, since a member of one set alone turns one bit."""
    k = max(6, int(len(s) - 1).bit_length())
    return np.packbits(np.bincount((s >> np.uint64(64 - k)).astype(np.int64), minlength=1 << k) & 1).tobytes()


def bits_apart(a: bytes, b: bytes) -> int:
    """Differing bits; of two lengths, the longer's neighbours are added up to the shorter's."""
    x, y = (np.unpackbits(np.frombuffer(z, np.uint8)) for z in (a, b))
    if len(x) < len(y):
        x, y = y, x
    if len(x) > len(y):
        x = x.reshape(len(y), -1).sum(axis=1) & 1
    return int((x != y).sum())


def signatures(docs: DataFrame, width: int, order) -> DataFrame:
    """(doc, row, c, g, n, bits): class by the whole set, group by prefix and size, parity bits."""
    schema = pa.schema([*((n, pa.int64()) for n in ("doc", "row", "c", "g", "n")), ("bits", pa.binary())])

    def sign(batches):
        masks = order.value
        one = lambda s: (_one(s, len(s)), _group(*_prefix(s, masks), len(s)), len(s), parity_bits(s)) if len(s) else (0, 0, 0, None)
        yield from batches_of(((doc, row, *one(s)) for doc, row, s in _sets(batches, width)), schema)

    return docs.mapInArrow(sign, "doc long, row long, c long, g long, n long, bits binary")


def postings(docs: DataFrame, width: int, order) -> DataFrame:
    """(t, g, n, p): prefix shingles that several groups post, with the group's size and the shingle's place.

    A posting travels as three longs: key, group, and hot flag, size and place in one. The key is the shingle; that
    of a frequent one is salted by the group, so that its postings spread over SALTS tasks; others have few."""
    schema = pa.schema([("k", pa.int64()), ("g", pa.int64()), ("at", pa.int64())])
    salts = mix(np.arange(SALTS, dtype=np.uint64))

    def post(batches):
        out, done = Columns(schema), set()
        for _, _, s in _sets(batches, width):
            if len(s):
                prefix, level = _prefix(s, order.value)
                if (g := _group(prefix, level, len(s))) in done:
                    continue
                done.add(g)
                is_hot = level > 0
                at = is_hot.astype(np.int64) << 62 | len(s) << 31 | np.arange(len(prefix))
                if out.add(np.where(is_hot, prefix ^ salts[g % SALTS], prefix), np.full(len(prefix), g), at):
                    yield out.take()
        if out.rows:
            yield out.take()

    found = docs.filter(F.col("doc").isNotNull()).mapInArrow(post, "k long, g long, at long")
    under = Window.partitionBy("k").orderBy("g")
    seen = found.withColumns({"prev": F.lag("g").over(under), "next": F.lead("g").over(under)})
    # a cold list is whole here; equal rows of one group follow each other, so a list of one group has no unequal neighbours
    hot = F.shiftright("at", 62) == 1
    kept = seen.filter(hot | (F.col("prev") != F.col("g")) | (F.col("next") != F.col("g")))
    unsalted = F.array(*(F.lit(x) for x in salts.view(np.int64).tolist()))[F.pmod("g", F.lit(SALTS)).cast("int")]
    bits = F.lit((1 << 31) - 1).cast("long")
    return staged(
        kept.select(
            F.when(hot, F.col("k").bitwiseXOR(unsalted)).otherwise(F.col("k")).alias("t"), "g",
            F.shiftright("at", 31).bitwiseAND(bits).cast("int").alias("n"), F.col("at").bitwiseAND(bits).cast("int").alias("p"),
        ),
        "postings",
    )


def _enough(n1: str, p1: str, n2: str, p2: str) -> F.Column:
    """Whether sets of these sizes, whose first shared shingle is at these places, may reach the threshold."""
    a, b = F.col(n1), F.col(n2)
    rest = F.least(a - F.col(p1), b - F.col(p2))
    return (4 * F.least(a, b) >= 3 * F.greatest(a, b)) & (7 * rest >= 3 * (a + b))


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (x, y) whose parity bits leave room for a link: sets that link differ in (n1 + n2) / 7 members at most."""
    side = lambda v: classes.select(F.col("c").alias(v), F.col("n").alias(f"n{v}"), F.col("bits").alias(f"b{v}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "nx", "ny", "bx", "by")
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def prune(batches):
        yield from batches_of(((x, y) for x, y, nx, ny, bx, by in rows_of(batches, "x", "y", "nx", "ny", "bx", "by") if 7 * bits_apart(bx, by) <= nx + ny), schema)

    return both.mapInArrow(prune, "x long, y long")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """Links among pairs (x, y) of classes: pairs that their bits do not rule out, by their whole sets."""
    pairs = staged(_possible(pairs, classes), "pairs")
    asked = pairs.select(F.col("x").alias("c")).unionByName(pairs.select(F.col("y").alias("c"))).distinct()
    texts = staged(_packed_texts(docs, staged(classes.join(asked, "c").select("c", F.col("first").alias("doc"), "row"), "wanted")), "texts")
    with_x = pairs.join(texts.select(F.col("c").alias("x"), F.col("z").alias("zx")), "x")
    both = with_x.join(texts.select(F.col("c").alias("y"), F.col("z").alias("zy")), "y")
    schema = pa.schema([("u", pa.int64()), ("v", pa.int64())])

    def compare(batches):
        last, sy, unpack = None, None, zstandard.ZstdDecompressor()

        def rows():
            nonlocal last, sy
            for x, y, zx, zy in rows_of(batches, "x", "y", "zx", "zy"):
                if y != last:
                    last, sy = y, shingles(unpack.decompress(zy), width)
                sx = shingles(unpack.decompress(zx), width)
                both = np.intersect1d(sx, sy, assume_unique=True).size
                if 100 * both >= 75 * (sx.size + sy.size - both):
                    yield x, y

        yield from batches_of(rows(), schema)

    return both.select("x", "y", "zx", "zy").mapInArrow(compare, "u long, v long")


def _packed_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(c, z): the compressed texts of wanted classes (c, doc, row). Rows that a fixed-size mask proves unwanted are
    left out before the shuffle."""
    mask = docs.sparkSession.sparkContext.broadcast(key_mask(wanted.select(F.xxhash64("doc", "row").alias("k"))))
    schema = pa.schema([("doc", pa.int64()), ("row", pa.int64()), ("z", pa.binary())])

    def pack(batches):
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            some = batch.filter(pa.array(in_mask(mask.value, batch.column("k").to_numpy(zero_copy_only=False))))
            yield from batches_of(((d, r, packer.compress((t or "").encode())) for d, r, t in rows_of([some], "doc", "row", "text")), schema, 512)

    packed = docs.filter(F.col("doc").isNotNull()).withColumn("k", F.xxhash64("doc", "row")).mapInArrow(pack, "doc long, row long, z binary")
    return packed.join(wanted.hint("shuffle_hash"), ["doc", "row"]).dropDuplicates(["doc", "row"]).select("c", "z")


def _labelled(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes with comp: the root class of their component."""
    return classes.join(links.select(F.col("u").alias("c"), F.col("v").alias("_root")), "c", "left").withColumn("comp", F.coalesce("_root", "c")).drop("_root")


def components(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc, row (hash of the text), n (set size), component_id."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"), row_key(text_col).alias("row"))
    frequent = frequent_shingles(docs, width)
    order = spark.sparkContext.broadcast([key_mask(frequent.filter(F.col("n") >= n).select("k")) for n in FREQUENT])  # of bounded size
    signed = staged(signatures(docs, width, order), "signatures")
    classes = staged(signed.filter("n > 0 AND doc IS NOT NULL").groupBy("c", "g", "n", "bits").agg(F.min("doc").alias("first"), F.min_by("row", "doc").alias("row")), "classes")
    groups = classes.groupBy("g").agg(F.min("c").alias("lead"), F.count("*").alias("many"))
    posted = postings(docs, width, order).withColumn("band", F.floor(F.log("n") / F.log(F.lit(4 / 3))))

    leaders = posted.groupBy("t", "band").agg(F.min("g").alias("g2"), F.max("g").alias("_last"), F.min_by("n", "g").alias("n2"), F.min_by("p", "g").alias("p2"))
    near = posted.join(leaders.filter("g2 < _last"), ["t", "band"]).filter(F.col("g") != F.col("g2")).filter(_enough("n", "p", "n2", "p2"))
    # this round only has to connect groups cheaply: of its leaders, a group takes the two it shares most shingles with
    best = Window.partitionBy("g").orderBy(F.desc("count"), "g2")
    near = near.groupBy("g", "g2").count().withColumn("_rn", F.row_number().over(best)).filter("_rn <= 2")
    by_lead = near.select("g", "g2").join(groups.select("g", F.col("lead").alias("x")), "g").join(groups.select(F.col("g").alias("g2"), F.col("lead").alias("y")), "g2")
    inside = classes.join(groups.filter("many > 1").select("g", F.col("lead").alias("y")), "g").select(F.col("c").alias("x"), "y").filter("x != y")
    first_links = staged(_verified(by_lead.select("x", "y").unionByName(inside).distinct(), classes, docs, width), "found")

    known = staged(_labelled(classes.drop("bits"), roots(first_links)), "labels")
    spread = known.groupBy("g").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    mixed = posted.join(spread, "g").groupBy("t").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).filter("lo < hi").select("t")
    open_rows = staged(posted.join(mixed, "t").select("t", "g", "p").join(known.select("g", "c", "n", "comp"), "g"), "open")
    a = open_rows.select("t", *(F.col(x).alias(x + "1") for x in ("c", "n", "p", "comp")))
    b = open_rows.select("t", *(F.col(x).alias(x + "2") for x in ("c", "n", "p", "comp")))
    across = a.join(b, (a["t"] == b["t"]) & (F.col("comp1") < F.col("comp2")) & _enough("n1", "p1", "n2", "p2"))
    torn = known.join(spread.filter("lo < hi").select("g"), "g", "left_semi").select("g", "c", "comp")
    within = torn.join(torn.select("g", F.col("c").alias("c2"), F.col("comp").alias("comp2")), "g").filter("comp < comp2")
    pairs = across.select(F.col("c1").alias("x"), F.col("c2").alias("y")).unionByName(within.select(F.col("c").alias("x"), F.col("c2").alias("y"))).distinct()
    links = first_links.unionByName(_verified(pairs, classes, docs, width))

    final = _labelled(classes.drop("bits"), roots(links))
    ids = final.join(final.groupBy("comp").agg(F.min("first").alias("component_id")), "comp").select("c", "component_id")
    of_class = signed.join(ids, "c", "left")
    alone = F.col("doc").isNull() | (F.col("n") == 0)
    return of_class.select("doc", "row", "n", F.when(alone, F.col("doc")).otherwise(F.col("component_id")).alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = components(table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))
  WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS ss FROM w),
e AS (SELECT doc_id, len(ss) AS n, unnest(ss) AS s FROM s),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.s = b.s AND a.doc_id < b.doc_id AND 4 * least(a.n, b.n) >= 3 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
d AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, d.y FROM r JOIN d ON r.b = d.x)
SELECT s.doc_id, len(ss)::BIGINT AS n_shingles, (SELECT min(b) FROM r WHERE r.a = s.doc_id) AS component_id FROM s
"""
