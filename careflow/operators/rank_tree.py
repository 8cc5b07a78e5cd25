"""Which candidates can matter to a request: branch and bound over a packed ball tree.

Requests and candidates meet in a grid of cells of bounded size (an equi-join of block numbers); all rows of a
facility lie in one block. A cell sorts its facilities along a space-filling curve and packs neighbours into leaves; a
leaf has a centre, a radius, and the least static score (all parts but the distance) of its facilities. Great-circle
distance obeys the triangle inequality, so centre and radius bound every distance of the leaf from both sides.

* ``extremes``: per request and cell, the coordinates of a nearest and a farthest row, which the distance domain needs;
  leaves are looked into in order of their bound until it passes the best.
* ``contenders``: per request and cell, the rows of all facilities that can be among the first k; leaves are looked
  into in order of their bound until it passes the k-th best row found so far.

Distances and scores here only decide which rows go on, with a margin for their rounding; the exact values are computed
from the rows that do, by the JVM's expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow.functions import lexicon as L

#: Requests and candidate rows of a cell's two sides, and facilities of a leaf.
KEY_BLOCK, CANDIDATE_BLOCK, LEAF = 65_536, 32_768, 32
#: What rounding may change: distances are rounded to 0.01 km, scores to 0.0001.
KM_MARGIN, SCORE_MARGIN = 0.011, 0.0002
#: Request levels that are alike to penalty and acuity filter, by a level that stands for them.
LEVEL_CLASSES = (2, 3, 4, 6, None)
#: Classes whose requests see no row that carries the acuity marker.
FILTERED = (0, 1, 4)


def level_class(level: int | None) -> int:
    return 4 if level is None else 0 if level <= 2 else 1 if level == 3 else 2 if level in (4, 5) else 3


def haversine(lat: float, lon: float, lats: np.ndarray, lons: np.ndarray) -> np.ndarray:
    """Great-circle distances in km; 0 where a coordinate is missing (NaN)."""
    phi, phis = math.radians(lat), np.radians(lats)
    a = np.sin((phis - phi) / 2) ** 2 + math.cos(phi) * np.cos(phis) * np.sin(np.radians(lons - lon) / 2) ** 2
    return np.nan_to_num(L.EARTH_RADIUS_KM * 2 * np.arctan2(np.sqrt(a), np.sqrt(np.maximum(1 - a, 0))))


def curve(lat: np.ndarray, lon: np.ndarray) -> np.ndarray:
    """Place along a Z-order curve: 16 bits of either coordinate, interleaved."""
    out = np.zeros(len(lat), np.uint64)
    for v, span, shift in ((np.nan_to_num(lat) + 90, 180, 1), (np.nan_to_num(lon) + 180, 360, 0)):
        cell = (np.clip(v / span, 0, 1) * 65_535).astype(np.uint64)
        for bit in range(16):
            out |= ((cell >> np.uint64(bit)) & np.uint64(1)) << np.uint64(2 * bit + shift)
    return out


class Tree:
    """Candidate rows of a cell, sorted by facility along the curve, and their leaves."""

    def __init__(self, rows: pa.Table):
        column = lambda c: rows.column(c).to_numpy().astype(float)
        lat, lon = column("latitude"), column("longitude")
        missing = np.isnan(lat) | np.isnan(lon)
        lat[missing] = lon[missing] = np.nan
        unit = np.unique(rows.column("unit").to_numpy(), return_inverse=True)[1]
        first = np.full(unit.max() + 1, np.iinfo(np.uint64).max, np.uint64)
        np.minimum.at(first, unit, curve(lat, lon))
        order = np.lexsort((unit, first[unit]))
        self.lat, self.lon, unit = lat[order], lon[order], unit[order]
        self.ids = rows.column("cid").to_numpy()[order]
        static = np.array([rows.column(f"static{c}").to_numpy() for c in range(len(LEVEL_CLASSES))])[:, order]
        penalty = np.array([rows.column(f"pen{c}").to_numpy() for c in range(len(LEVEL_CLASSES))])[:, order]
        marked = rows.column("marked").to_numpy(zero_copy_only=False).astype(bool)[order]
        self.units = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))  # first row of each facility
        self.of = np.cumsum(np.concatenate([[True], unit[1:] != unit[:-1]])) - 1
        # only rows with the largest penalty can be a facility's worst; the others never give it its score
        worst = np.maximum.reduceat(penalty, self.units, axis=1)
        self.static = np.where(penalty == worst[:, self.of], static, -np.inf)
        self.passing = [np.add.reduceat(~marked if c in FILTERED else np.ones(len(marked), bool), self.units, dtype=int) for c in range(len(LEVEL_CLASSES))]
        least = np.maximum.reduceat(self.static, self.units, axis=1)  # a facility scores at least this
        leaf = np.arange(0, len(self.units), LEAF)
        self.leaf_units = [slice(a, min(a + LEAF, len(self.units))) for a in leaf]
        starts = [*self.units, len(self.ids)]
        self.leaf_rows = [slice(starts[u.start], starts[u.stop]) for u in self.leaf_units]
        self.static_bound = np.array([[min(np.where(self.passing[c][u] > 0, least[c, u], np.inf)) for u in self.leaf_units] for c in range(len(LEVEL_CLASSES))])
        here = [np.flatnonzero(~np.isnan(self.lat[r])) + r.start for r in self.leaf_rows]
        self.center = np.array([(self.lat[h].mean(), self.lon[h].mean()) if len(h) else (0.0, 0.0) for h in here])
        self.radius = np.array([haversine(*c, self.lat[h], self.lon[h]).max(initial=0.0) for c, h in zip(self.center, here)])
        self.located = np.array([len(h) > 0 for h in here])
        self.unlocated = np.array([len(h) < r.stop - r.start for h, r in zip(here, self.leaf_rows)])

    def bounds(self, lat: float, lon: float) -> tuple[np.ndarray, np.ndarray]:
        """Lowest and highest distance of any row of each leaf; rows without coordinates are at distance 0."""
        to = haversine(lat, lon, self.center[:, 0], self.center[:, 1])
        low = np.where(self.located & ~self.unlocated, np.maximum(to - self.radius - KM_MARGIN, 0), 0)
        return low, np.where(self.located, to + self.radius + KM_MARGIN, 0)

    def extremes(self, lat: float, lon: float) -> tuple[int, int]:
        """Row numbers of a nearest and a farthest row."""
        found = []
        low, high = self.bounds(lat, lon)
        for bound, sign in ((low, 1), (-high, -1)):
            best, at = np.inf, 0
            for leaf in np.argsort(bound, kind="stable"):
                if bound[leaf] >= best:
                    break
                rows = self.leaf_rows[leaf]
                to = sign * haversine(lat, lon, self.lat[rows], self.lon[rows])
                if to.min() < best:
                    best, at = to.min(), rows.start + int(to.argmin())
            found.append(at)
        return found[0], found[1]

    def contenders(self, level: int, lat: float, lon: float, lo: float, hi: float, k: int) -> Iterator[np.ndarray]:
        """Ids of the rows of all facilities that can hold one of the first k rows."""
        c = level_class(level)
        part = lambda km: L.RANK_WEIGHTS[1] * ((km - lo) / (hi - lo) if hi > lo else 0 * km)
        margin = SCORE_MARGIN + (part(lo + KM_MARGIN) if hi > lo else 0)
        known = not (math.isnan(lat) or math.isnan(lon))
        low = self.bounds(lat, lon)[0] if known else np.zeros(len(self.leaf_rows))
        bound = self.static_bound[c] + part(np.maximum(low, lo))
        scores, counts, places, limit = np.zeros(0), np.zeros(0, int), np.zeros(0, int), np.inf
        for leaf in np.argsort(bound, kind="stable"):
            if bound[leaf] > limit + margin or np.isinf(bound[leaf]):
                break
            rows, units = self.leaf_rows[leaf], self.leaf_units[leaf]
            to = haversine(lat, lon, self.lat[rows], self.lon[rows]) if known else np.zeros(rows.stop - rows.start)
            mine = np.maximum.reduceat(self.static[c, rows] + part(to), self.units[units] - rows.start)
            some = self.passing[c][units] > 0
            scores, counts = np.concatenate([scores, mine[some]]), np.concatenate([counts, self.passing[c][units][some]])
            places = np.concatenate([places, np.flatnonzero(some) + units.start])
            order = np.argsort(scores, kind="stable")
            enough = np.searchsorted(np.cumsum(counts[order]), k)
            limit = scores[order[enough]] if enough < len(order) else np.inf
        starts = [*self.units, len(self.ids)]
        for u in places[scores <= limit + margin]:
            yield self.ids[starts[u] : starts[u + 1]]


def _cells(keys: DataFrame, candidates: DataFrame, cell: Callable, schema: pa.Schema, ddl: str) -> DataFrame:
    """Both sides (staged) dealt over the grid; ``cell`` gets a tree and a list of requests."""
    cores = keys.sparkSession.sparkContext.defaultParallelism
    n = keys.count()
    key_blocks = max(math.ceil(n / KEY_BLOCK), min(3 * cores, math.ceil(n / 256)), 1)
    blocks = max(math.ceil(candidates.count() / CANDIDATE_BLOCK), 1)
    every = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    left = keys.withColumn("kb", F.pmod(F.xxhash64("_key"), F.lit(key_blocks)).cast("int")).withColumn("cb", every(blocks))
    right = candidates.withColumn("cb", F.pmod(F.col("unit"), F.lit(blocks)).cast("int")).withColumn("kb", every(key_blocks))

    def run(some: pa.Table, rows: pa.Table) -> pa.Table:
        out = list(cell(Tree(rows), some.to_pylist())) if some.num_rows and rows.num_rows else []
        return pa.Table.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)

    tasks = max(2 * cores, key_blocks * blocks)  # an explicit number is not coalesced
    return left.repartition(tasks, "kb", "cb").groupBy("kb", "cb").cogroup(right.repartition(tasks, "kb", "cb").groupBy("kb", "cb")).applyInArrow(run, ddl)


def extremes(keys: DataFrame, candidates: DataFrame) -> DataFrame:
    """(_key, lat, lon): per request and cell the coordinates of a nearest and a farthest candidate row."""
    schema = pa.schema([("_key", pa.string()), ("lat", pa.float64()), ("lon", pa.float64())])

    def cell(tree: Tree, requests: list[dict]):
        for r in requests:
            if r["user_latitude"] is None or r["user_longitude"] is None:
                yield r["_key"], None, None
                continue
            for row in tree.extremes(r["user_latitude"], r["user_longitude"]):
                lat, lon = float(tree.lat[row]), float(tree.lon[row])
                yield r["_key"], None if math.isnan(lat) else lat, None if math.isnan(lon) else lon

    return _cells(keys, candidates, cell, schema, "_key string, lat double, lon double")


def contenders(keys: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """(_key, _cid): per request and cell the rows of the facilities that can be among the first k. ``keys`` have the
    distance domain (_dist_lo, _dist_hi)."""
    schema = pa.schema([("_key", pa.string()), ("_cid", pa.int64())])

    def cell(tree: Tree, requests: list[dict]):
        for r in requests:
            lat, lon = (math.nan if r[c] is None else r[c] for c in ("user_latitude", "user_longitude"))
            for ids in tree.contenders(r["provisional_ctas_level"], lat, lon, r["_dist_lo"], r["_dist_hi"], k):
                yield from ((r["_key"], i) for i in ids.tolist())

    return _cells(keys, candidates, cell, schema, "_key string, _cid long")
