"""Grouping of spelling variants over a trie of letter-group counts (operator 13).

1. Tasks count the words of whole texts and send on sums, never single occurrences.
2. The trie has a word's length at its first level and then, level by level, how many of its letters fall in each of
   GROUPS letter groups. Words that differ by one edit differ, over all levels, by at most one letter more (surplus)
   and one less (deficit). The upper levels are dealt out: a word lies under its own upper counts and is sent, as a
   query, to the upper counts that it can reach with that budget, along with what is left of it. How many levels are
   upper follows from a count of the words under every node, so that what a task holds at once stays small at any size.
3. Under each upper node a task builds the lower levels and searches them depth first, spending the rest of the
   budget; words at the leaves are verified letter by letter. Each pair is found from one side: the longer word looks
   for shorter ones; of equal lengths, the one with the larger upper counts, then the larger word, looks.
4. A word's form is its near word of largest count; roots follow the forms by doubling steps.

Defined results: a null text has no words; a null id counts as an empty one; texts are read whole, long ones in blocks
that end between words; repeated rows count each on its own; an empty table gives no rows; of near words with equal
counts the first in code-point order is the form; other columns are neither read nor changed.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.llm.common import batches_of, rows_of, staged, table

LETTER = "A-Za-zÀ-ÿ"
LEAST_LENGTH, LEAST_COUNT, FORM_RATIO = 6, 5, 5
#: A run loses a letter where its hash is a multiple of this.
DAMAGE = 199
#: Words that a task counts before it sends their sums on, and letters of a text that are split at once.
COUNTED, BLOCK = 200_000, 1 << 20
#: Letter groups: the remainder of the code point. Neighbouring levels thus hold one frequent letter each.
GROUPS = 12
#: Words under one upper node, and under one leaf, at which the trie goes a level deeper.
SUBTREE, LEAF = 20_000, 6


def _runs(text: str, runs: re.Pattern, other: re.Pattern) -> Iterator[list[str]]:
    at = 0
    while at < len(text):
        end = len(text)
        if end - at > BLOCK and (gap := other.search(text, at + BLOCK)):
            end = gap.start()
        yield runs.findall(text, at, end)
        at = end


def damaged(run: bytes, seed: int) -> bytes:
    """The run (lower-cased, UTF-8) without the letter that its hash names, if it names one."""
    h = zlib.crc32(run, seed)
    if h % DAMAGE:
        return run
    word = run.decode()
    at = h % len(word)
    return (word[:at] + word[at + 1 :]).encode()


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n): the words of all texts, after the damage, of at least that many letters and occurrences."""
    schema = pa.schema([("word", pa.string()), ("n", pa.int64())])

    def count(batches):
        runs, other = re.compile(f"[{LETTER}]{{{least_length},}}"), re.compile(f"[^{LETTER}]")
        counts: dict[bytes, int] = {}

        def sums():
            for at in range(0, len(counts), 1 << 16):
                words, many = (list(x)[at : at + (1 << 16)] for x in (counts, counts.values()))
                yield pa.record_batch([pa.array(words, pa.binary()).cast(pa.string()), pa.array(many, pa.int64())], schema=schema)

        for i, text in rows_of(batches, "id", "text"):
            seed = zlib.crc32(f"{'' if i is None else i}:".encode())
            for found in _runs(text or "", runs, other):
                for run, many in Counter(found).items():
                    word = damaged(run.encode().lower(), seed)  # bytes: A-Z alone become lower case
                    counts[word] = counts.get(word, 0) + many
            if len(counts) >= COUNTED:
                yield from sums()
                counts.clear()
        yield from sums()

    parts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(count, "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter((F.length("word") >= least_length) & (F.col("n") >= least_count))


def vector(word: str) -> list[int]:
    """The counts of a word along the trie: its length, then its letters by group."""
    counts = [len(word)] + [0] * GROUPS
    for c in word:
        counts[1 + ord(c) % GROUPS] += 1
    return counts


def upper_levels(words: DataFrame) -> int:
    """The least number of upper levels under which no node holds over SUBTREE words (all of them, if none does)."""
    columns = [f"c{i}" for i in range(GROUPS + 1)]
    schema = pa.schema([(c, pa.int32()) for c in columns])

    def count(batches):
        yield from batches_of((tuple(vector(word)) for (word,) in rows_of(batches, "word")), schema, 16_384)

    counted = words.select("word").mapInArrow(count, ", ".join(f"{c} int" for c in columns))
    nodes = counted.rollup(*columns).agg(F.count("*").alias("n"), F.grouping_id().alias("id"))
    largest = {r["id"]: r["n"] for r in nodes.groupBy("id").agg(F.max("n").alias("n")).collect()}  # a row a level
    for levels in range(1, GROUPS + 2):
        if largest.get((1 << (GROUPS + 1 - levels)) - 1, 0) <= SUBTREE:
            return levels
    return GROUPS + 1


def reach(upper: list[int]) -> Iterator[tuple[tuple[int, ...], int, int]]:
    """(upper counts, surplus, deficit): the nodes that hold words which a word with these upper counts looks for, and
    what is left of its budget there. The first count is the length."""
    length, own = upper[0], tuple(upper[1:])
    step = lambda *moves: tuple(c + sum(by for at, by in moves if at == i) for i, c in enumerate(own))
    yield (length - 1, *own), 1, 0
    for i in range(len(own)):
        if own[i]:
            yield (length - 1, *step((i, -1))), 0, 0
    yield (length, *own), 1, 1
    for i in range(len(own)):
        if own[i]:
            yield (length, *step((i, -1))), 0, 1
            for j in range(i + 1, len(own)):  # smaller counts than its own: the surplus comes first
                yield (length, *step((i, -1), (j, 1))), 0, 0


def build(words: list[tuple[list[int], str, int]], level: int):
    """The trie under a node: counts of the next level to nodes, or a leaf's list of words."""
    if len(words) <= LEAF or level > GROUPS:
        return [(w, n) for _, w, n in words]
    kids: dict[int, list] = {}
    for x in words:
        kids.setdefault(x[0][level], []).append(x)
    return {c: build(some, level + 1) for c, some in kids.items()}


def leaves(node, counts: list[int], level: int, surplus: int, deficit: int) -> Iterator[list]:
    """Depth first: the leaves that a word of these counts reaches with one letter more and one less at most."""
    todo = [(node, level, surplus, deficit)]
    while todo:
        node, level, surplus, deficit = todo.pop()
        while isinstance(node, dict):
            c = counts[level]
            level += 1
            if surplus and c - 1 in node:
                todo.append((node[c - 1], level, surplus - 1, deficit))
            if deficit and c + 1 in node:
                todo.append((node[c + 1], level, surplus, deficit - 1))
            node = node.get(c)
        if node:
            yield node


def replaced(a: str, b: str) -> bool:
    """Whether two words of one length differ in exactly one letter."""
    for i, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return a[i + 1 :] == b[i + 1 :]
    return False


def _found(query: str, shorter: bool, before: bool, node, counts: list[int], level: int, surplus: int, deficit: int) -> Iterator[tuple[str, int]]:
    holes = {query[:i] + query[i + 1 :] for i in range(len(query))} if shorter else None
    for leaf in leaves(node, counts, level, surplus, deficit):
        for word, n in leaf:
            if (word in holes) if shorter else ((word < query or not before) and replaced(word, query)):
                yield word, n


def near_words(words: DataFrame) -> DataFrame:
    """(word, other, other_n): every pair of near words, once from either side."""
    spark = words.sparkSession
    levels = upper_levels(words)
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    posted = pa.schema([("node", pa.string()), ("kind", pa.int32()), ("word", pa.string()), ("n", pa.int64())])
    pairs = pa.schema([("word", pa.string()), ("other", pa.string()), ("other_n", pa.int64())])
    name = lambda upper: ",".join(map(str, upper))

    def post(batches):
        def rows():
            for word, n in rows_of(batches, "word", "n"):
                upper = vector(word)[:levels]
                yield name(upper), 0, word, n
                for node, surplus, deficit in reach(upper):
                    yield name(node), 1 + 2 * surplus + deficit, word, n

        yield from batches_of(rows(), posted, 16_384)

    def search(batches):
        def rows():
            at, entries, trie = None, [], None
            for node, kind, word, n in rows_of(batches, "node", "kind", "word", "n"):
                if node != at:
                    at, entries, trie = node, [], None
                counts = vector(word)
                if kind == 0:
                    entries.append((counts, word, n))
                elif entries:
                    if trie is None:
                        trie = build(entries, levels)
                    surplus, deficit = divmod(kind - 1, 2)
                    shorter = not node.startswith(f"{len(word)},") and node != str(len(word))
                    for other, m in _found(word, shorter, kind == 4, trie, counts, levels, surplus, deficit):
                        yield word, other, m
                        yield other, word, n

        yield from batches_of(rows(), pairs, 16_384)

    asked = words.mapInArrow(post, "node string, kind int, word string, n long")
    return asked.repartition(parts, "node").sortWithinPartitions("node", "kind").mapInArrow(search, "word string, other string, other_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for every word with a form. Counts grow FORM_RATIO-fold along the forms, so a path is short and free
    of circles; each step doubles what a word has behind it."""
    at = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        beyond = at.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        at = staged(at.join(beyond, "root", "left").select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("moved")), "roots")
        moved = at.filter("moved").limit(1).count()
        at = at.drop("moved")
        if not moved:
            return at


def variants(words: DataFrame) -> DataFrame:
    """Per word of a table (word, n) with distinct words: word, form, root, n, n_near, form_n."""
    words = staged(words.select("word", "n"), "words")
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other"))).alias("best"))
    known = words.join(near, "word", "left")
    is_form = -F.col("best.less") >= FORM_RATIO * F.col("n")
    known = staged(known.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("best.other")).alias("form"), F.when(is_form, -F.col("best.less")).alias("form_n")), "forms")
    rooted = known.join(_roots(known.filter("form IS NOT NULL")), "word", "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(count_words(table(spark, sf_dir, "documents", "doc_id", "text")))


ORACLE_SQL = r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(256), lambda b: list_reduce([b, 0, 1, 2, 3, 4, 5, 6, 7], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))) AS t),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{C0}-\x{FF}]{6,}')) AS w FROM documents),
k AS (SELECT coalesce(doc_id::VARCHAR, '') || ':' || w AS key, w, count(*) AS c FROM r GROUP BY ALL),
h AS (SELECT w, c, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(key, ''), lambda ch: CASE WHEN unicode(ch) < 128 THEN [unicode(ch)::BIGINT] ELSE [195::BIGINT, unicode(ch)::BIGINT - 64] END)),
  lambda h, b: xor(h >> 8, t[1 + (xor(h, b) & 255)])), 4294967295) AS h FROM k, tab),
d AS (SELECT CASE WHEN h % 199 = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, c FROM h),
v AS (SELECT word, sum(c)::BIGINT AS n FROM d WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
o AS (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS hole FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM v)),
s AS (SELECT DISTINCT o.word AS x, v.word AS y FROM o JOIN v ON o.hole = v.word),
p AS (SELECT x, y FROM s UNION SELECT y, x FROM s UNION SELECT a.word, b.word FROM o a JOIN o b ON a.hole = b.hole AND a.i = b.i AND a.word <> b.word),
q AS (SELECT x, y, v.n, count(*) OVER (PARTITION BY x) AS n_near, row_number() OVER (PARTITION BY x ORDER BY v.n DESC, y) AS k FROM p JOIN v ON v.word = y),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN q.n >= 5 * v.n THEN y END AS form, CASE WHEN q.n >= 5 * v.n THEN q.n END AS form_n FROM v LEFT JOIN q ON v.word = x AND k = 1),
c AS (SELECT word, word AS at, 0 AS depth FROM f UNION ALL SELECT c.word, f.form, depth + 1 FROM c JOIN f ON c.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, arg_max(c.at, c.depth) AS root, f.n, f.n_near, f.form_n FROM f JOIN c ON c.word = f.word GROUP BY f.word, f.form, f.n, f.n_near, f.form_n
"""
