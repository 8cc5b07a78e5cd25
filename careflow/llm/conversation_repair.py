"""Repair of conversation structure over a suffix-shared automaton of role and fault signatures (operator 11).

1. Every turn becomes one letter: whether its role starts with s, u, a or otherwise, and its first fault (blank,
   duplicate, truncated, none). Duplicates are told by the turn at which a role and text first occur in the
   conversation (a pre-aggregated minimum). Range partitions over (conversation, turn) cut a long conversation into
   parts for many tasks; a part leaves them as its letters alone.
2. The conversations' signatures are dealt by range of the reversed signature. In that order signatures with a common
   end follow each other, and the nodes of the automaton, one for each distinct suffix, lie on a stack: a node is
   computed once, when its suffix is first met, for all conversations that end in it (again only where a range
   border cuts through it). A node holds, for each state of the role grammar ``(s?(ua)+)?``, the cost to go and the
   first letter of the best audit suffix, whose rest is the next node's. Costs count from the node's lowest, so
   nodes with the same costs in all states share one table entry.
3. The audit, which is read off the nodes, goes ahead of its conversation's turns in one sorted stream, and each turn
   is kept, reroled or deleted as it passes.

A conversation's signature and audit are one cell of a letter a turn, as the result asks; its digest is a running
SHA-256, which one task has to feed in order, but no step holds a conversation's texts.

Defined results: a null role or text is one blank; null ids are one conversation; turns are taken in order of turn
(nulls first), equal turns in order of the SHA-256 of role and text; repeated rows are duplicates of the first; an
empty table gives no rows; other columns are neither read nor changed.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from careflow.llm.common import WORD_BLANKS, batches_of, rows_of, staged, table

ROLES = "sua"  # any other initial is the fourth role
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
#: A turn's letter stands at 4 * role + fault.
LETTERS = "abcdefghijklmnop"

#: Costs of the edits, and what an undeleted truncated turn adds.
REROLE, DELETE, INSERT, TRUNCATED_COST = 1, 2, 5, 5
#: States of the grammar by the last initial: nothing yet, s, u, a.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: The state that a reroled or inserted turn leads to, and its role.
FORCED = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: keeps[state]: the states that a kept turn may lead to.
KEEPS = ((SYSTEM, USER), (USER,), (ASSISTANT,), (USER,))
END = "."


class Nodes:
    """Nodes of the automaton: costs to go by grammar state (from the lowest on) and the first letters of the best audits."""

    def __init__(self):
        self.values = [((0, 2 * INSERT, INSERT, 0), END + "II" + END)]
        self.known = {self.values[0]: 0}
        self.steps: dict[tuple[str, int], int] = {}

    def before(self, letter: str, after: int) -> int:
        """The node of a suffix: a turn's letter ahead of the suffix of node ``after``."""
        if (letter, after) not in self.steps:
            value = self._value(letter, self.values[after][0])
            self.steps[letter, after] = self.known.setdefault(value, len(self.values))
            if len(self.values) < len(self.known):
                self.values.append(value)
        return self.steps[letter, after]

    @staticmethod
    def _value(letter: str, after: tuple) -> tuple:
        role, fault = divmod(LETTERS.index(letter), 4)
        extra = TRUNCATED_COST if fault == TRUNCATED else 0
        options = []  # by state: (cost, edit) of the edits that use the turn up
        for state in range(4):
            some = [(DELETE + after[state], "D")]
            if fault in (FINE, TRUNCATED):
                some.append((REROLE + extra + after[FORCED[state]], "R"))
                if role + 1 in KEEPS[state]:
                    some.append((extra + after[role + 1], "K"))
            options.append(min(some))
        least = [cost for cost, _ in options]
        least[USER], least[ASSISTANT] = min(least[USER], INSERT + least[ASSISTANT]), min(least[ASSISTANT], INSERT + least[USER])
        best = [min(o, (INSERT + least[FORCED[state]], "I")) for state, o in enumerate(options)]
        low = min(best)[0]
        return tuple(cost - low for cost, _ in best), "".join(edit for _, edit in best)


def suffix_audits(signatures: Iterator[str]) -> Iterator[tuple[int, str]]:
    """(cost, audit) of each signature; they come reversed and sorted, so that common ends are computed once."""
    nodes, path, last, found = Nodes(), array("L", [0]), None, (0, "")
    for ends in signatures:
        if ends != last:
            shared = 0
            if last is not None:
                while shared < min(len(ends), len(last)) and ends[shared] == last[shared]:
                    shared += 1
            del path[shared + 1 :]
            for letter in ends[shared:]:
                path.append(nodes.before(letter, path[-1]))
            last, found = ends, _read(nodes, path, ends)
        yield found


def _read(nodes: Nodes, path: array, ends: str) -> tuple[int, str]:
    depth, state, cost, audit = len(ends), NOTHING, 0, []
    while (edit := nodes.values[path[depth]][1][state]) != END:
        audit.append(edit)
        if edit == "I":
            cost, state = cost + INSERT, FORCED[state]
            continue
        depth -= 1
        role, fault = divmod(LETTERS.index(ends[depth]), 4)
        if edit == "D":
            cost += DELETE
            continue
        cost += (REROLE if edit == "R" else 0) + (TRUNCATED_COST if fault == TRUNCATED else 0)
        state = FORCED[state] if edit == "R" else role + 1
    return cost, "".join(audit)


def _count(signature: str) -> tuple[int, int, int, int]:
    """blank, duplicate, truncated turns, and neighbours whose initials the grammar does not know."""
    of = lambda fault: sum(signature.count(LETTERS[4 * r + fault]) for r in range(4))
    roles = signature.translate({ord(c): (ROLES + "o")[i // 4] for i, c in enumerate(LETTERS)})
    legal = sum(roles.count(pair) for pair in ("su", "ua", "au"))
    return of(BLANK), of(DUPLICATE), of(TRUNCATED), max(len(roles) - 1, 0) - legal


def _turns(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    blank_if_null = lambda c: F.coalesce(F.col(c), F.lit(" "))
    turns = rows.select(F.col(id_col).cast("long").alias("id"), F.col(turn_col).cast("long").alias("turn"), blank_if_null(role_col).alias("role"), blank_if_null(text_col).alias("text"))
    same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    return turns.withColumns({"has": F.col("turn").isNotNull(), "same": same})


ORDER = ["id", "has", "turn", "same"]


def _letters(turns: DataFrame) -> DataFrame:
    """Distinct turns, each with its letters: its own, and a duplicate's for every further copy."""
    body = F.rtrim("text", F.lit(WORD_BLANKS))
    initial = F.substring("role", 1, 1)
    role = F.coalesce(*(F.when(initial == c, i) for i, c in enumerate(ROLES)), F.lit(len(ROLES)))
    fault = F.when(body == "", BLANK).when(body.endswith(".") | body.endswith("!") | body.endswith("?"), FINE).otherwise(TRUNCATED)
    some = turns.select(*ORDER, role.alias("role"), fault.alias("fault")).groupBy(*ORDER, "role", "fault").agg(F.count("*").cast("int").alias("copies"))
    some = staged(some, "turns")
    first = some.groupBy(F.col("id").alias("_id"), F.col("same").alias("_same")).agg(F.min(F.struct("has", "turn")).alias("first"), F.count("*").alias("places")).filter("places > 1")
    both = some.join(first, F.col("id").eqNullSafe(F.col("_id")) & (F.col("same") == F.col("_same")), "left")
    later = F.col("first").isNotNull() & ~(F.col("has").eqNullSafe(F.col("first.has")) & F.col("turn").eqNullSafe(F.col("first.turn")))
    letter = lambda fault: F.substring(F.lit(LETTERS), 4 * F.col("role") + fault + 1, F.lit(1))
    again = letter(F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE))
    return both.select(*ORDER, F.concat(F.when(later, again).otherwise(letter(F.col("fault"))), F.repeat(again, F.col("copies") - 1)).alias("letters"))


def _parts(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def signatures(turns: DataFrame) -> DataFrame:
    """(id, signature, gaps) of every conversation."""
    names = ("lo", "hi", "turns", "last")
    schema = pa.schema([("id", pa.int64()), ("has", pa.bool_()), ("turn", pa.int64()), ("same", pa.binary()), ("letters", pa.string()), *((n, pa.int64()) for n in names)])

    def join_letters(batches):
        def parts():
            conv, head, letters = None, None, []
            lo = last = None
            many = 0
            for i, has, turn, same, some in rows_of(batches, *ORDER, "letters"):
                if head is None or i != conv:
                    if head is not None:
                        yield conv, *head, "".join(letters), lo, last, many, last
                    conv, head, letters, lo, last, many = i, (has, turn, same), [], None, None, 0
                letters.append(some)
                if turn is not None and turn != last:
                    lo, last, many = (turn if lo is None else lo), turn, many + 1
            if head is not None:
                yield conv, *head, "".join(letters), lo, last, many, last

        yield from batches_of(parts(), schema, 256)

    letters = staged(_letters(turns), "letters").repartitionByRange(_parts(turns.sparkSession), *ORDER).sortWithinPartitions(*ORDER)
    parts = letters.mapInArrow(join_letters, "id long, has boolean, turn long, same binary, letters string, lo long, hi long, turns long, last long")
    whole = parts.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("has", "turn", "same", "letters", "turns", "last"))).alias("p"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("turns").alias("turns"))
    cut = F.expr("size(filter(p, (x, i) -> i > 0 AND x.turn = p[i - 1].last))")  # turns that lie on both sides of a range border
    return whole.select("id", F.array_join(F.transform("p", lambda x: x["letters"]), "").alias("signature"), F.coalesce(F.col("hi") - F.col("lo") + 1 - F.col("turns") + cut, F.lit(0)).cast("long").alias("gaps"))


FOUND = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audits(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
    return _audits(_turns(rows, id_col, turn_col, role_col, text_col))


def _audits(turns: DataFrame) -> DataFrame:
    schema = pa.schema([("id", pa.int64()), *((n, pa.int64()) for n in FOUND), ("audit", pa.string())])

    def judge(batches):
        ids = []

        def reversed_signatures():
            for i, gaps, ends in rows_of(batches, "id", "gaps", "ends"):
                ids.append((i, gaps))
                yield ends

        def rows():
            last, counts = None, None
            for (cost, audit), ends in _beside(suffix_audits, reversed_signatures()):
                if ends != last:
                    last, counts = ends, _count(ends[::-1])
                yield *ids.pop(), *counts, cost, audit

        yield from batches_of(rows(), schema, 1024)

    found = staged(signatures(turns).withColumn("ends", F.reverse("signature")).drop("signature"), "signatures")
    ordered = found.repartitionByRange(_parts(turns.sparkSession), "ends", "id").sortWithinPartitions("ends", "id")
    return staged(ordered.mapInArrow(judge, "id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"), "audits")


def _beside(function, items: Iterator):
    """Results of a lazy one-to-one function over items, each beside its item."""
    seen = []

    def watched():
        for x in items:
            seen.append(x)
            yield x

    for out in function(watched()):
        yield out, seen.pop()


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, found, None) ahead of each conversation, then (id, found, (edit, role, text)) for each turn of the repaired one."""
    conv, found, audit, at, state = None, None, "", 0, NOTHING

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, FORCED[state]
            yield conv, found, ("I", NAMES[state], "")

    for i, head, role, text in rows_of(batches, "id", "found", "role", "text"):
        if head is not None:
            yield from inserted()
            conv, found, audit, at, state = i, head, head["audit"], 0, NOTHING
            yield conv, found, None
            continue
        yield from inserted()
        edit, at = audit[at], at + 1
        if edit == "R":
            state = FORCED[state]
            yield conv, found, (edit, NAMES[state], text)
        elif edit == "K":
            state = ROLES.index(role[0]) + 1
            yield conv, found, (edit, role, text)
    yield from inserted()


def _stream(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's audit and then its turns in order, one conversation after the other."""
    heads = plans.select("id", F.struct(*FOUND, "audit").alias("found"), F.lit(False).alias("is_turn"), F.lit(None).cast("boolean").alias("has"), *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("same", "binary"), ("role", "string"), ("text", "string"))))
    body = turns.select("id", F.lit(None).cast(heads.schema["found"].dataType).alias("found"), F.lit(True).alias("is_turn"), "has", "turn", "same", "role", "text")
    both = heads.unionByName(body).repartition(_parts(turns.sparkSession), "id").sortWithinPartitions("id", "is_turn", "has", "turn", "same")
    return both.select("id", "found", "role", "text")


def repaired(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The repaired conversations: id, position (from 0), edit (K, R or I), role, text."""
    schema = pa.schema([("id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def edit(batches):
        def out():
            at = 0
            for conv, _, line in _edited(batches):
                if line is None:
                    at = 0
                else:
                    yield conv, at, *line
                    at += 1

        yield from batches_of(out(), schema, 512)

    turns = _turns(rows, id_col, turn_col, role_col, text_col)
    return _stream(turns, _audits(turns)).mapInArrow(edit, "id long, position long, edit string, role string, text string")


def digests(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Per conversation: the columns of ``audits`` and repaired_sha256, the digest of its repaired ``role:text`` lines."""
    schema = pa.schema([("id", pa.int64()), *((n, pa.int64()) for n in FOUND), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def digest(batches):
        def out():
            row, sha, first = None, None, True
            for conv, found, line in _edited(batches):
                if line is None:
                    if row is not None:
                        yield *row, sha.hexdigest()
                    row, sha, first = (conv, *(found[n] for n in FOUND), found["audit"]), hashlib.sha256(), True
                    continue
                _, role, text = line
                sha.update(f"{'' if first else chr(10)}{role}:{text}".encode())
                first = False
            if row is not None:
                yield *row, sha.hexdigest()

        yield from batches_of(out(), schema, 1024)

    turns = _turns(rows, id_col, turn_col, role_col, text_col)
    return _stream(turns, _audits(turns)).mapInArrow(digest, "id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text after the damage that the hash of conversation and turn decides."""
    blank_if_null = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(blank_if_null("conv_id"), F.lit(":"), blank_if_null("turn"))) % 20
    rows = conversations.select("conv_id", "turn", blank_if_null("role").alias("role"), blank_if_null("text").alias("text"), hit.alias("hit")).filter("hit != 0")
    copies = F.explode(F.when(F.col("hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    found = digests(damage(given))
    every = given.select("conv_id").distinct().join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    empty = F.lit(hashlib.sha256().hexdigest())
    return every.select("conv_id", *(F.coalesce(n, F.lit(0)).alias(n) for n in FOUND), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"))


ORACLE_SQL = r"""
WITH RECURSIVE h AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(list_reduce([4294967295::BIGINT] ||
  list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT),
  lambda h, b: list_reduce([xor(h, b), 0, 1, 2, 3, 4, 5, 6, 7], lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 20 AS hit FROM conversations),
d AS (SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN hit = 3 THEN [0, 1] ELSE [0] END) AS copy FROM h WHERE hit <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body FROM d),
f AS (SELECT *, CASE WHEN body = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN NOT regexp_matches(body, '[.!?]$') THEN 'truncated' ELSE '' END AS fault,
  role[1] AS r, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY i) AS q FROM n),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
  count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (i > 1 AND (q || r) NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS m FROM f GROUP BY conv_id),
-- costs and audits to go from each turn, in the states nothing, s, u, a; backwards from the end
e AS (SELECT conv_id, m AS i, {'c': 0, 'a': ''} AS n0, {'c': 10, 'a': 'II'} AS n1, {'c': 5, 'a': 'I'} AS n2, {'c': 0, 'a': ''} AS n3 FROM s
  UNION ALL
  SELECT conv_id, i - 1, list_min([b0, {'c': 5 + k2.c, 'a': 'I' || k2.a}]), list_min([b1, {'c': 5 + k2.c, 'a': 'I' || k2.a}]), k2, k3 FROM (
    SELECT *, list_min([b2, {'c': 5 + b3.c, 'a': 'I' || b3.a}]) AS k2, list_min([b3, {'c': 5 + b2.c, 'a': 'I' || b2.a}]) AS k3 FROM (
      SELECT conv_id, i, list_min([{'c': 2 + n0.c, 'a': 'D' || n0.a}, {'c': x + 1 + n2.c, 'a': 'R' || n2.a}, {'c': x + CASE r WHEN 's' THEN n1.c WHEN 'u' THEN n2.c ELSE 1000000 END, 'a': 'K' || CASE r WHEN 's' THEN n1.a ELSE n2.a END}]) AS b0,
        list_min([{'c': 2 + n1.c, 'a': 'D' || n1.a}, {'c': x + 1 + n2.c, 'a': 'R' || n2.a}, {'c': x + CASE r WHEN 'u' THEN n2.c ELSE 1000000 END, 'a': 'K' || n2.a}]) AS b1,
        list_min([{'c': 2 + n2.c, 'a': 'D' || n2.a}, {'c': x + 1 + n3.c, 'a': 'R' || n3.a}, {'c': x + CASE r WHEN 'a' THEN n3.c ELSE 1000000 END, 'a': 'K' || n3.a}]) AS b2,
        list_min([{'c': 2 + n3.c, 'a': 'D' || n3.a}, {'c': x + 1 + n2.c, 'a': 'R' || n2.a}, {'c': x + CASE r WHEN 'u' THEN n2.c ELSE 1000000 END, 'a': 'K' || n2.a}]) AS b3
      FROM (SELECT e.*, f.r, CASE f.fault WHEN 'blank' THEN 1000000 WHEN 'duplicate' THEN 1000000 WHEN 'truncated' THEN 5 ELSE 0 END AS x FROM e JOIN f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i)))),
-- the audit read forwards: each edit with its turn and the state behind it
w AS (SELECT conv_id, n0.c AS cost, n0.a AS audit FROM e WHERE i = 0),
t AS (SELECT conv_id, audit, 0 AS p, 0::BIGINT AS i, 0 AS state, NULL::VARCHAR AS line FROM w
  UNION ALL
  SELECT conv_id, audit, p + 1, j, CASE edit WHEN 'D' THEN state WHEN 'K' THEN position(role[1] IN 'sua') ELSE forced END,
    CASE edit WHEN 'D' THEN NULL WHEN 'K' THEN role || ':' || text ELSE CASE forced WHEN 2 THEN 'user:' ELSE 'assistant:' END || CASE edit WHEN 'R' THEN text ELSE '' END END
  FROM (SELECT t.conv_id, audit, p, state, CASE state WHEN 2 THEN 3 ELSE 2 END AS forced, audit[p + 1] AS edit, t.i + CASE WHEN audit[p + 1] = 'I' THEN 0 ELSE 1 END AS j, f.role, f.text
    FROM t LEFT JOIN f ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.i = t.i + 1 WHERE p < length(audit)))
SELECT c.conv_id, coalesce(s.gaps, 0) AS gaps, coalesce(s.blank, 0) AS blank, coalesce(s.duplicate, 0) AS duplicate, coalesce(s.truncated, 0) AS truncated, coalesce(s.illegal, 0) AS illegal,
  coalesce(w.cost, 0)::BIGINT AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(l.lines, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN (SELECT conv_id, string_agg(line, chr(10) ORDER BY p) AS lines FROM t WHERE line IS NOT NULL GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM c.conv_id
"""
