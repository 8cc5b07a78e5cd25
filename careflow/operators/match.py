"""Entity resolution of live sites to the facility register (C5, E3), overrides (C6) and the match upsert.

C5 scores a live site against register rows with
``0.55 * name + 0.30 * address + 0.15 * city`` where name and address are
token-set ratios (0-100) of main-normalized text, and keeps the best register
row per site (strictly greater wins, so ties go to the earliest register row).

Plan: the sites are the *distinct* (name, address) keys of the live table - one
row per emergency room, however many snapshots were scraped. Sites and register
are normalized once, staged and counted, and cut into blocks; every block of
sites meets every block of register rows in one cell of a grid (an equi-join of
block numbers, each cell of bounded size), and a cell sends on one row for each
of its sites at most. No pair ever becomes a row, and neither side is broadcast
or limited in size.

Inside a cell the register rows, sorted by city and name, are the leaves of a tree of fixed fan-out. A node knows
the most of each letter, the shortest and the longest length, the cities and, by an inverted index, the tokens of its
rows: with a site's own they bound the score of every row below. A site starts with the rows that share its rarest
tokens and the leaf of the highest bound, and then goes down only where a bound reaches its best score so far. A row
that is left has exact bounds of its own (shared tokens, and as long a common subsequence as the letters allow), and
only rows whose bound still reaches the best score get the exact longest common subsequence (bit-parallel). So no row
is passed over that could win, and a site's work follows the rows near its best one, not the register; where all
register rows are alike to a site, its work is the cell.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from careflow.functions import lexicon as L
from careflow.functions.text import normalize_main
from careflow.plans.sizing import broadcast_if_small, staged

MATCH_KEY = ["facility_name_raw", "address_raw"]


def _lcs_one(a: str, b: str) -> int:
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for i, ch in enumerate(a):
        masks[ch] = masks.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v = full
    for ch in b:
        u = v & masks.get(ch, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - bin(v).count("1")


def tokens(norm: Column) -> Column:
    """Distinct whitespace tokens of a normalized string (computed once per row, before any pairing)."""
    return F.array_distinct(F.filter(F.split(norm, " "), lambda t: t != ""))


#: Rows of either side of a cell, and rows of a node of the tree over its register rows, from the leaves up.
SITE_BLOCK, REGISTER_BLOCK, NODES = 8192, 393_216, (16, 256, 4096)
FAN = 16
#: Tokens in more than one row of this many are kept as a flag a row, others as lists; pairs of leftovers kept; slack of bounds.
COMMON, KEPT_PAIRS, SLACK = 32, 1 << 17, 1e-6
#: Letters of normalized text.
_LETTER = np.full(128, -1)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = range(36)


class _Tokens:
    """A column of token lists: the tokens' codes, and for each row the number of tokens, of letters, and of each letter."""

    def __init__(self, column: pa.ChunkedArray):
        many = pc.list_value_length(column).to_numpy()
        coded = pa.chunked_array(pc.list_flatten(column).chunks, pa.string()).combine_chunks().dictionary_encode()
        self.vocabulary, self.codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        self.at, self.of = np.concatenate([[0], np.cumsum(many)]), np.repeat(np.arange(len(many), dtype=np.int32), many)
        sizes = np.array([len(t) for t in self.vocabulary], np.int64)
        kinds = _LETTER[np.frombuffer("".join(self.vocabulary).encode(), np.uint8)]
        each = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * 36 + kinds, minlength=36 * len(sizes)).reshape(-1, 36)
        letters = [np.bincount(self.of, each[self.codes, c], len(many)) for c in range(36)]
        top = max((x.max(initial=0) for x in letters), default=0)
        self.letters = np.stack(letters, axis=1).astype(np.min_scalar_type(int(top)))
        self.number, self.total = many.astype(float), np.bincount(self.of, sizes[self.codes], len(many))
        self.length = self.total + self.number - 1

    def row(self, j: int) -> list[str]:
        return [self.vocabulary[c] for c in self.codes[self.at[j] : self.at[j + 1]].tolist()]


class _Field(_Tokens):
    """One field of a cell's register rows, with what the nodes of the tree know of it."""

    def __init__(self, column: pa.ChunkedArray):
        super().__init__(column)
        self.code = {t: i for i, t in enumerate(self.vocabulary)}
        order = np.argsort(self.codes, kind="stable")
        self.rows_of = self.of[order]
        self.starts = np.searchsorted(self.codes[order], np.arange(len(self.vocabulary) + 1))
        cuts = [np.arange(0, len(self.number), size) for size in NODES]
        self.most = [np.maximum.reduceat(self.letters, at, axis=0) for at in cuts]
        self.shortest = [np.maximum(np.minimum.reduceat(self.length, at), 1) for at in cuts]
        self.longest = [np.maximum(np.maximum.reduceat(self.length, at), 1) for at in cuts]
        self.flags: dict[tuple[int, int], np.ndarray] = {}
        self.mark = np.zeros(len(self.number), bool)
        self.known: dict[tuple[str, str], int] = {}

    def holders(self, code: int) -> np.ndarray:
        return self.rows_of[self.starts[code] : self.starts[code + 1]]

    def shared(self, codes: list[tuple[int, int]], level: int | None, js: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of some rows (or nodes of a level): how many of a site's tokens (code, letters) they hold, and these tokens' letters."""
        number, total = np.zeros(len(js)), np.zeros(len(js))
        for code, letters in codes:
            rows = self.holders(code)
            if len(rows) * COMMON > len(self.number):
                key = (-1 if level is None else level, code)
                if key not in self.flags:
                    flags = np.zeros(len(self.number) if level is None else len(self.most[level]), bool)
                    flags[rows if level is None else rows // NODES[level]] = True
                    self.flags[key] = flags
                held = self.flags[key][js]
            else:
                at = rows if level is None else rows // NODES[level]
                self.mark[at] = True
                held = self.mark[js]
                self.mark[at] = False
            number += held
            total += held * float(letters)
        return number, total


class _Side:
    """One field of a site beside the same field of the cell's register rows."""

    def __init__(self, field: _Field, sites: _Tokens, i: int):
        self.field, self.tokens = field, set(sites.row(i))
        self.codes = [(field.code[t], len(t)) for t in sorted(self.tokens) if t in field.code]
        self.number, self.total, self.length = sites.number[i], sites.total[i], sites.length[i]
        self.kinds = np.flatnonzero(sites.letters[i])
        self.counts = sites.letters[i, self.kinds]

    def _bag(self, letters: np.ndarray, js: np.ndarray) -> np.ndarray:
        return np.minimum(letters[js[:, None], self.kinds], self.counts).sum(axis=1, dtype=np.int64)

    def below(self, level: int, js: np.ndarray) -> np.ndarray:
        """Highest possible token-set ratio of any row of these nodes.

        Shared text and common subsequence together are no longer than the common letters and the site's blanks, and
        than either side; shared text alone is no longer than the site's tokens that the node holds."""
        if not self.number:
            return np.zeros(len(js))
        f, length = self.field, self.length
        common = np.minimum(self._bag(f.most[level], js) + self.number - 1, length)
        shortest = f.shortest[level][js]
        other = np.clip(common, shortest, f.longest[level][js])
        number, total = f.shared(self.codes, level, js)
        same = total + np.maximum(number - 1, 0)
        of_same = 200.0 * np.maximum(same / (same + length), same / (same + np.maximum(np.maximum(shortest, same), 1)))
        return np.maximum(200.0 * np.minimum(common, other) / (length + other), of_same)

    def rows(self, js: np.ndarray):
        """What this side and some rows share, and their highest possible token-set ratio."""
        f = self.field
        number, total = f.shared(self.codes, None, js)
        nb = f.number[js]
        blanks = np.maximum(np.minimum(self.number, nb) - number - 1, 0)
        sides = self.number, self.total, nb, f.total[js], number, total
        return sides, _ratio(*sides, self._bag(f.letters, js) - total + blanks)

    def exact(self, sides: tuple, at: np.ndarray, js: np.ndarray) -> np.ndarray:
        """Token-set ratios of rows js, which are at these places of sides."""
        f, lcs = self.field, []
        if len(f.known) > KEPT_PAIRS:
            f.known.clear()
        for j in js.tolist():
            other = set(f.row(j))
            pair = " ".join(sorted(self.tokens - other)), " ".join(sorted(other - self.tokens))
            if pair not in f.known:
                f.known[pair] = _lcs_one(*pair)
            lcs.append(f.known[pair])
        na, ta, nb, tb, number, total = sides
        return _ratio(na, ta, nb[at], tb[at], number[at], total[at], np.array(lcs, float))


def _ratio(na, ta, nb, tb, shared, shared_letters, lcs):
    """Token-set ratio (0-100, public rapidfuzz definition) of rows with na and nb tokens of ta and tb letters, of which
    they share some, and a length of the leftovers' common subsequence, up to theirs; the ratio grows with that length."""
    s = shared_letters + np.maximum(shared - 1, 0)
    la, lb = (t - shared_letters + np.maximum(n - shared - 1, 0) for n, t in ((na, ta), (nb, tb)))
    sep = np.where(s > 0, 1.0, 0.0)
    sa, sb = s + sep + la, s + sep + lb
    indel = la + lb - 2 * np.minimum(lcs, np.minimum(la, lb))
    base = 100.0 - 100.0 * indel / np.maximum(sa + sb, 1)
    r_a = 100.0 - 100.0 * (sep + la) / np.maximum(s + sa, 1)
    r_b = 100.0 - 100.0 * (sep + lb) / np.maximum(s + sb, 1)
    with_shared = np.where((la == 0) | (lb == 0), 100.0, np.maximum(np.maximum(base, r_a), r_b))
    return np.where((na == 0) | (nb == 0), 0.0, np.where(s > 0, with_shared, base))


def _sum(name, address, city):
    return L.MATCH_WEIGHTS[0] * name + L.MATCH_WEIGHTS[1] * address + L.MATCH_WEIGHTS[2] * city


class _Register:
    """The register rows of a cell, sorted by city and name, under a tree."""

    def __init__(self, rows: pa.Table):
        name, address = (pc.binary_join(rows.column(c), " ") for c in ("rnt", "rat"))
        by = pa.table({"rc": rows.column("rc"), "name": name, "address": address})
        rows = rows.take(pc.sort_indices(by, sort_keys=[(c, "ascending") for c in by.column_names]))
        self.table, self.n = rows, rows.num_rows
        self.name, self.address = _Field(rows.column("rnt")), _Field(rows.column("rat"))
        ties = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("ord", "rid", "rname")], null_placement="at_end")
        self.rank = np.empty(self.n, np.int64)
        self.rank[ties.to_numpy()] = np.arange(self.n)
        coded = rows.column("rc").combine_chunks().dictionary_encode()
        self.cities = coded.dictionary.to_pylist()
        city = pc.fill_null(coded.indices, len(self.cities)).to_numpy()  # sorted, those without at the end
        self.nodes = [math.ceil(self.n / size) for size in NODES]
        cuts = [np.arange(0, self.n, size) for size in (1, *NODES)]  # cities of rows, then of the nodes of each level
        self.first, self.last = ([f.reduceat(city, at) for at in cuts] for f in (np.minimum, np.maximum))
        self.of_address: tuple[str, np.ndarray] | None = None

    def _held(self, address: str) -> np.ndarray:
        """How many of the cities up to each an address holds; sites come by address, so the last one is kept."""
        if self.of_address is None or self.of_address[0] != address:
            self.of_address = address, np.cumsum([0, *(c in address for c in self.cities), 0])
        return self.of_address[1]

    def best(self, sides: tuple[_Side, _Side], address: str) -> tuple[float, int]:
        """Score and number of the site's best row, the first of equal ones."""
        cities, best = self._held(address), None
        name, place = sides

        def held(level: int | None, js: np.ndarray) -> np.ndarray:
            at = 0 if level is None else level + 1
            return np.where(cities[self.last[at][js] + 1] > cities[self.first[at][js]], 100.0, 0.0)

        def judge(js: np.ndarray) -> None:
            nonlocal best
            city = held(None, js)
            (of_name, n_hi), (of_place, a_hi) = name.rows(js), place.rows(js)
            top = _sum(n_hi, a_hi, city)
            possible = np.arange(len(js)) if best is None else np.flatnonzero(top >= best[0] - SLACK)
            possible = possible[np.lexsort((self.rank[js[possible]], -top[possible]))]
            done, many = 0, 4
            while done < len(possible) and (best is None or top[possible[done]] >= best[0] - SLACK):
                at = possible[done : done + many]
                done, many = done + many, 2 * many
                by_name = name.exact(of_name, at, js[at])
                if best is not None:
                    near = _sum(by_name, a_hi[at], city[at]) >= best[0] - SLACK
                    at, by_name = at[near], by_name[near]
                if len(at):
                    scores = _sum(by_name, place.exact(of_place, at, js[at]), city[at])
                    k = np.lexsort((self.rank[js[at]], -scores))[0]
                    if best is None or (scores[k], -self.rank[js[at[k]]]) > (best[0], -self.rank[best[1]]):
                        best = float(scores[k]), int(js[at[k]])

        def bound(level: int, js: np.ndarray) -> np.ndarray:
            return _sum(name.below(level, js), place.below(level, js), held(level, js))

        def under(level: int, js: np.ndarray) -> np.ndarray:
            """The nodes (or at last rows) below some nodes."""
            js = (js[:, None] * FAN + np.arange(FAN)).ravel()
            return js[js < (self.nodes[level - 1] if level else self.n)]

        for side in sides:
            if side.codes:
                judge(min((side.field.holders(c) for c, _ in side.codes), key=len)[:NODES[0]])
        nodes = np.arange(self.nodes[-1])
        for level in (2, 1):
            high = bound(level, nodes)
            if level == 2:
                at = nodes[[high.argmax()]]
                for lower in (1, 0):
                    at = under(lower + 1, at)
                    at = at[[bound(lower, at).argmax()]]
                judge(under(0, at))
            nodes = under(level, nodes[high >= best[0] - SLACK])
        high = bound(0, nodes) if len(nodes) else np.zeros(0)
        order = np.argsort(-high)
        done, many = 0, FAN
        while done < len(order) and high[order[done]] >= best[0] - SLACK:
            part = order[done : done + many]
            judge(under(0, nodes[part[high[part] >= best[0] - SLACK]]))
            done, many = done + many, min(4 * many, 1024)
        return best


def best_in_cell(sites: pa.Table, register: pa.Table):
    """(site number, score, register row) of each site's best row among these, the earliest of equal ones."""
    rows = _Register(register)
    names, addresses = _Tokens(sites.column("lnt")), _Tokens(sites.column("lat"))
    whole = sites.column("la").to_pylist()
    for i in sorted(range(len(whole)), key=whole.__getitem__):
        score, j = rows.best((_Side(rows.name, names, i), _Side(rows.address, addresses, i)), whole[i])
        yield i, score, {c: rows.table.column(c)[j].as_py() for c in ("ord", "rid", "rname")}


def _block_numbers(rows: DataFrame, name: str, blocks: int, other: str, others: int, *key: str) -> DataFrame:
    """Each row with the number of its block, once for every block of the other side."""
    return rows.withColumn(name, F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))


def best_rows(sites: DataFrame, register: DataFrame) -> DataFrame:
    """Per site: its key and ``_b`` (score, id and name of its best register row)."""
    sites, register = staged(sites, "sites"), staged(register, "register")
    cores = sites.sparkSession.sparkContext.defaultParallelism
    n = sites.count()
    site_blocks = max(math.ceil(n / SITE_BLOCK), min(6 * cores, math.ceil(n / 64)), 1)
    register_blocks = max(math.ceil(register.count() / REGISTER_BLOCK), 1)
    left = _block_numbers(sites, "sb", site_blocks, "rb", register_blocks, *MATCH_KEY)
    right = _block_numbers(register, "rb", register_blocks, "sb", site_blocks, "rid", "rname", "ord")
    schema = pa.schema([*((k, pa.string()) for k in MATCH_KEY), ("score", pa.float64()), ("ord", pa.int64()), ("rid", pa.string()), ("rname", pa.string())])

    def cell(some: pa.Table, others: pa.Table) -> pa.Table:
        keys = some.select(MATCH_KEY).to_pylist()
        found = [keys[i] | {"score": score} | row for i, score, row in best_in_cell(some, others)] if keys and others.num_rows else []
        return pa.Table.from_pylist(found, schema=schema)

    # explicit counts: adaptive execution would put all small cells into one task; four a cell, so that few meet in one
    tasks = max(2 * cores, 4 * site_blocks * register_blocks)
    cells = left.repartition(tasks, "sb", "rb").groupBy("sb", "rb").cogroup(right.repartition(tasks, "sb", "rb").groupBy("sb", "rb"))
    best = cells.applyInArrow(cell, ", ".join(f"{k} string" for k in MATCH_KEY) + ", score double, ord long, rid string, rname string")
    first = F.min(F.struct((-F.col("score")).alias("less"), F.coalesce("ord", F.lit(2**63 - 1)), F.col("rid"), F.col("rname")))
    return best.groupBy(*MATCH_KEY).agg(first.alias("b")).select(*MATCH_KEY, F.struct((-F.col("b.less")).alias("_score"), F.col("b.rid").alias("_rid"), F.col("b.rname").alias("_rname")).alias("_b"))


def fuzzy_match(live: DataFrame, register: DataFrame, order_col: str = "register_order") -> DataFrame:
    """C5 + E3: best register row for every distinct live (name, address); one output row per live key.

    ``live`` needs facility_name_raw, address_raw, scraped_at (the newest one
    is the match time); ``register`` needs facility_id_normalized,
    facility_name, full_address, city and ``order_col`` (earlier wins ties).
    """
    sites = live.groupBy(*MATCH_KEY).agg(F.max("scraped_at").alias("matched_at"))
    site_side = sites.select(
        *MATCH_KEY,
        tokens(normalize_main(F.col("facility_name_raw"))).alias("lnt"),
        normalize_main(F.col("address_raw")).alias("la"),
    ).withColumn("lat", tokens(F.col("la")))
    rows = register.select(
        F.col("facility_id_normalized").alias("rid"), F.col("facility_name").alias("rname"), F.col(order_col).cast("long").alias("ord"),
        tokens(normalize_main(F.col("facility_name"))).alias("rnt"), tokens(normalize_main(F.col("full_address"))).alias("rat"),
        F.when(F.coalesce(F.col("city"), F.lit("")) != "", normalize_main(F.col("city"))).alias("rc"),
    )
    top = best_rows(site_side, rows)
    # a site with no register row at all keeps the reference's "no_match" row; NULL keys are keys like others
    same = F.lit(True)
    for k in MATCH_KEY:
        same = same & sites[k].eqNullSafe(top[k])
    j = sites.join(top, same, "left").select(*[sites[k] for k in MATCH_KEY], "matched_at", "_b")
    sc = F.col("_b._score")
    hit = F.col("_b").isNotNull()
    return j.select(
        *MATCH_KEY,
        F.col("_b._rid").alias("matched_facility_id"),
        F.col("_b._rname").alias("matched_facility_name"),
        F.when(hit, F.bround(sc / 100.0, 4)).otherwise(F.lit(0.0)).alias("match_confidence"),
        F.when(~hit, F.lit("no_match")).when(sc >= L.MATCH_EXACTISH_THRESHOLD, F.lit("exactish")).otherwise(F.lit("fuzzy")).alias("match_method"),
        F.lit(False).alias("manually_validated"),
        "matched_at",
    )


def latest_overrides(overrides: DataFrame) -> DataFrame:
    """One override per key: the most recently updated (then highest target id) wins."""
    w = Window.partitionBy(*MATCH_KEY).orderBy(F.col("updated_at").desc_nulls_last(), F.col("matched_facility_id").desc_nulls_last())
    return overrides.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(
        *MATCH_KEY, F.col("matched_facility_id").alias("_oid"), F.col("matched_facility_name").alias("_oname"))


def apply_overrides(matches: DataFrame, overrides: DataFrame) -> DataFrame:
    """A manual override replaces id and name, sets confidence 1.0, method manual_override, validated."""
    o = latest_overrides(overrides).withColumn("_hit", F.lit(True))
    j = matches.join(broadcast_if_small(o), MATCH_KEY, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    return j.select(
        *MATCH_KEY,
        F.when(hit, F.col("_oid")).otherwise(F.col("matched_facility_id")).alias("matched_facility_id"),
        F.when(hit, F.col("_oname")).otherwise(F.col("matched_facility_name")).alias("matched_facility_name"),
        F.when(hit, F.lit(1.0)).otherwise(F.col("match_confidence")).alias("match_confidence"),
        F.when(hit, F.lit("manual_override")).otherwise(F.col("match_method")).alias("match_method"),
        F.when(hit, F.lit(True)).otherwise(F.col("manually_validated")).alias("manually_validated"),
        "matched_at",
    )


def upsert(target: DataFrame, source: DataFrame, keys: list[str] = MATCH_KEY) -> DataFrame:
    """MERGE as a plan: source rows replace target rows with equal keys, other source rows are inserted.

    One full outer join, so target and source are each computed once. Key equality is ``=``, so NULL keys never
    match (such target rows stay, such source rows are inserted). A key present twice in the source makes the job
    fail, like a MERGE with several source matches; the count runs over the join's own partitioning and sees source
    rows alone, which are unique when it passes."""
    has_keys = F.lit(True)
    for k in keys:
        has_keys = has_keys & F.col(k).isNotNull()
    twice = (F.count(F.lit(1)).over(Window.partitionBy(*keys)) > 1) & has_keys
    new = source.select(*[F.col(c).alias(f"_s_{c}") for c in target.columns], F.when(twice, F.raise_error(F.lit("upsert: duplicate source key")).cast("boolean")).otherwise(F.lit(True)).alias("_s"))
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(k) == F.col(f"_s_{k}"))
    j = target.join(new, same, "full_outer")
    return j.select(*[F.when(F.col("_s"), F.col(f"_s_{c}")).otherwise(F.col(c)).alias(c) for c in target.columns])
