"""Word-window hashes in numpy, and a fixed-size count sketch over all rows that tells hot keys from cold ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from careflow.llm.common import give_back

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Bytes of text that are hashed at once (about 40 bytes of memory each).
BLOCK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads every input bit over the 64 output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * BASE)
_FOLDED = _BYTES.copy()
_FOLDED[65:91] = _BYTES[97:123]


class _Powers:
    """Powers of BASE and of its inverse, grown as needed."""

    up = down = np.ones(1, np.uint64)

    @classmethod
    def to(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, 2 * len(cls.up))
            cls.up, cls.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (BASE, BASE_INVERSE))
        return cls.up, cls.down


def _hash_block(data: np.ndarray, cuts: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of several texts that lie behind each other in ``data`` (UTF-8), text i from cuts[i] to
    cuts[i + 1]; and for each cut, the number of words before it."""
    word = ~_BLANK[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inside = cuts[(cuts > 0) & (cuts < len(data))]
    first[inside], last[inside - 1] = word[inside], word[inside - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _Powers.to(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTES)[data] * up[: len(data)], out=sums[1:])
    hashes = mix(((sums[ends] - sums[starts]) * down[starts]) ^ (ends - starts).astype(np.uint64))
    return hashes, np.searchsorted(starts, cuts)


def word_hashes(text: str | bytes | np.ndarray | None, fold: bool = False) -> np.ndarray:
    """Hashes of the words of one text (runs of anything but blank and 0x09-0x0D; ``fold``: A-Z as a-z)."""
    if not isinstance(text, np.ndarray):
        text = np.frombuffer(text.encode() if isinstance(text, str) else text or b"", np.uint8)
    out, at = [], 0
    while len(text) - at > BLOCK_BYTES:  # long texts in blocks that end behind a blank
        blank = np.flatnonzero(_BLANK[text[at : at + BLOCK_BYTES]])
        if len(blank):
            end = at + int(blank[-1]) + 1
        else:
            later = np.flatnonzero(_BLANK[text[at + BLOCK_BYTES :]])
            end = at + BLOCK_BYTES + int(later[0]) + 1 if len(later) else len(text)
        out.append(_hash_block(text[at:end], np.array([0, end - at]), fold)[0])
        at = end
    out.append(_hash_block(text[at:], np.array([0, len(text) - at]), fold)[0])
    return np.concatenate(out)


def hashed_rows(batches: Iterator[pa.RecordBatch], *names: str, fold: bool = False) -> Iterator[tuple]:
    """(named columns, word hashes of column text) of every row, straight from the Arrow buffers."""
    for batch in batches:
        col = batch.column("text").cast(pa.large_string())
        if col.null_count:
            col = col.fill_null("")
        _, offsets, values = col.buffers()
        at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
        data = np.frombuffer(values, np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
        row = 0
        while row < len(col):
            end = max(row + 1, min(int(np.searchsorted(at, at[row] + BLOCK_BYTES, "right")) - 1, row + 4096))
            keys = zip(*(batch.column(n).slice(row, end - row).to_pylist() for n in names))
            if at[end] - at[row] > BLOCK_BYTES:
                yield *next(keys), word_hashes(data[at[row] : at[end]], fold)
            else:
                hashes, cuts = _hash_block(data[at[row] : at[end]], at[row : end + 1] - at[row], fold)
                for k, a, b in zip(keys, cuts.tolist(), cuts[1:].tolist()):
                    yield *k, hashes[a:b]
            row = end
    give_back()


def rolling(w: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words."""
    m = len(w) - k + 1
    h = np.zeros(max(m, 0), np.uint64)
    for j in range(k if m > 0 else 0):
        h = h * BASE + w[j : j + m]
    return mix(h)


def sequence_hash(h: np.ndarray) -> np.uint64:
    """One hash of an ordered run of hashes and its length."""
    up, _ = _Powers.to(len(h))
    return mix((h * up[: len(h)]).sum(dtype=np.uint64, keepdims=True) ^ np.uint64(len(h)))[0]


class Spans:
    """Hashes of arbitrary word spans of one text by prefix sums; equal word sequences hash alike at any place."""

    def __init__(self, w: np.ndarray):
        up, self.down = _Powers.to(len(w) + 1)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(w * up[: len(w)], dtype=np.uint64)])

    def hash(self, start: np.ndarray, length) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start])


SKETCH_BITS = 20
_SHARDS = 64
_LEVEL = 256
#: Keys that a task holds before it counts them.
HELD_KEYS = 1 << 16


def count_sketch(docs: DataFrame, keys: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]) -> np.ndarray:
    """Counts of all keys of all rows in 2^SKETCH_BITS counters by the keys' top bits.

    A counter is at least the number of rows of each of its keys, so a key with a small counter is proven cold; the
    sketch's size is fixed. Each task adds up its own rows, tasks are summed in two levels of at most 256 each."""
    schema = pa.schema([("shard", pa.int32()), ("task", pa.int32()), ("counts", pa.binary())])
    ddl = "shard int, task int, counts binary"

    def count(batches):
        total, some, held = np.zeros(1 << SKETCH_BITS, np.int64), [], 0
        for more in chain(keys(batches), [None]):
            if more is not None:
                some.append(more)
                held += len(more)
            if some and (more is None or held > HELD_KEYS):
                np.add.at(total, counter_of(np.concatenate(some)), 1)  # in place: no second array of counters
                some, held = [], 0
        if total.any():
            parts = total.reshape(_SHARDS, -1)
            task = TaskContext.get().partitionId()
            for shard, p in enumerate(parts):  # one at a time: no copy of all counters
                yield pa.record_batch([pa.array([shard], pa.int32()), pa.array([task // _LEVEL], pa.int32()), pa.array([p.tobytes()], pa.binary())], schema=schema)

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in t.column("counts"))
        return pa.table([[t["shard"][0].as_py()], [t["task"][0].as_py() // _LEVEL], [total.tobytes()]], schema=schema)

    out = docs.mapInArrow(count, ddl)
    for _ in range(2):
        out = out.groupBy("shard", "task").applyInArrow(add, ddl)
    sketch = np.zeros((_SHARDS, (1 << SKETCH_BITS) // _SHARDS), np.int64)
    for r in out.collect():  # a fixed 8 MB in 64 rows (times the third level, for over 65,536 tasks)
        sketch[r["shard"]] += np.frombuffer(r["counts"], np.int64)
    return sketch.ravel()


def hot_counters(sketch: np.ndarray) -> np.ndarray:
    """Counters whose keys may be hot. Any other key has at most 256 rows plus 1/131072 of all rows."""
    return sketch > 256 + 8 * sketch.sum() / len(sketch)


def counter_of(keys: np.ndarray) -> np.ndarray:
    return (keys >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


#: Bits of a mask: for few keys and at most (128 MB), and bits a key in between.
MASK_BITS, BITS_A_KEY = (20, 30), 16


def key_mask(keys: DataFrame) -> np.ndarray:
    """Bits of all keys (a long column ``k``) in a mask whose size follows their number, up to a fixed bound: a key
    without its bit is none of them. A full mask keeps everything, so it saves work and decides nothing."""
    size = min(max(MASK_BITS[0], (BITS_A_KEY * keys.count()).bit_length()), MASK_BITS[1])
    bit = F.pmod("k", F.lit(1 << size)) + 1
    rows = keys.groupBy(F.bitmap_bucket_number(bit).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("m")).toLocalIterator()
    mask = np.zeros(1 << (size - 3), np.uint8)
    for r in rows:  # 2^size / 32768 rows of 4 KB at most
        mask[(r["b"] - 1) * 4096 : r["b"] * 4096] = np.frombuffer(r["m"], np.uint8)
    return mask


def in_mask(mask: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys.view(np.int64) & (8 * len(mask) - 1)
    return (mask[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0


def by_mask(batches: Iterator[pa.RecordBatch], mask: np.ndarray, wanted: bool, key: str = "_k") -> Iterator[pa.RecordBatch]:
    """The rows whose key (a long column) may be one of the mask's, or those whose key is none of them."""
    for batch in batches:
        yield batch.filter(pa.array(in_mask(mask, batch.column(key).to_numpy(zero_copy_only=False)) == wanted))


class Columns:
    """Collects numpy columns of many small results into Arrow batches of some tens of thousands of rows."""

    def __init__(self, schema: pa.Schema, size: int = 32_768):
        self.schema, self.size, self.parts, self.rows = schema, size, [], 0

    def add(self, *cols: np.ndarray) -> bool:
        self.parts.append(cols)
        self.rows += len(cols[0])
        return self.rows >= self.size

    def take(self) -> pa.RecordBatch:
        cols = [np.concatenate(c) for c in zip(*self.parts)]
        self.parts, self.rows = [], 0
        return pa.record_batch([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c).cast(f.type) for c, f in zip(cols, self.schema)], schema=self.schema)
