"""Word-shingle sets, min-hash signatures and connected components, for near-duplicate work.

A word is a maximal run of ASCII letters, digits and non-ASCII characters of the
lower-cased text. A text of one to four words has one shingle, of all its words;
a text without a word has none. Sets hold 64-bit hashes of the shingles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Stored, slices

WIDTH = 5
SLOTS = 128
SLICE = 1 << 20
_WORD = np.array([chr(i).isalnum() if i < 128 else True for i in range(256)])
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


@lru_cache(1)
def _byte_values() -> np.ndarray:
    return np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _ODD), np.full(n, np.uint64(pow(int(_ODD), -1, 1 << 64)))
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each word of all texts: its text's index, its hash, and the byte range in the joined lower-case texts."""
    raw = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(b) + 1 for b in raw])
    data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none.astype(np.uint64), none, none
    word = np.concatenate([[False], _WORD[data], [False]])
    edge = np.flatnonzero(word[1:] != word[:-1])
    first, last = edge[::2], edge[1::2]
    up, down = _powers(1 << max(21, int(len(data)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_byte_values()[data] * up[: len(data)])])
    h = mix((sums[last] - sums[first]) * down[first])
    return np.searchsorted(ends, first, "right"), h, first, last


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    texts = [t or "" for t in texts]
    for a, b in slices([len(t) for t in texts], SLICE):
        owner, h, _, _ = word_hashes(texts[a:b])
        bounds = np.searchsorted(owner, np.arange(b - a + 1))
        n = max(0, len(h) - WIDTH + 1)
        run = np.zeros(n, np.uint64)
        for j in range(WIDTH):
            run = run * _ODD + h[j : j + n]
        run = mix(run)
        for i in range(b - a):
            x, y = bounds[i], bounds[i + 1]
            if y - x >= WIDTH:
                yield np.unique(run[x : y - WIDTH + 1])
            elif y > x:
                few = np.zeros(1, np.uint64)
                for v in h[x:y]:
                    few = few * _ODD + v
                yield mix(few + np.uint64(y - x))
            else:
                yield run[:0]


@lru_cache(1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(12)
    return rng.integers(0, 1 << 32, SLOTS, dtype=np.uint32), rng.integers(0, 1 << 31, SLOTS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


@lru_cache(1)
def _inverse() -> np.ndarray:
    return np.array([pow(int(f), -1, 1 << 32) for f in _permutations()[1]], np.uint32)


def minwise(shingles: np.ndarray) -> np.ndarray:
    """The min-wise sampled shingle of each slot, out of a sorted set that isn't empty."""
    flip, factor = _permutations()
    short, low = (shingles >> np.uint64(32)).astype(np.uint32), np.full(SLOTS, np.uint32(0xFFFFFFFF))
    for a in range(0, len(short), 512):
        low = np.minimum(low, ((short[a : a + 512, None] ^ flip) * factor).min(axis=0))
    return shingles[np.searchsorted(short, (low * _inverse()) ^ flip)]  # a permutation is undone to find whose value was least


def signature(tokens: np.ndarray) -> np.ndarray:
    """16 bits of each sampled shingle."""
    return (mix(tokens) & np.uint64(0xFFFF)).astype(np.uint16)


def set_key(shingles: np.ndarray) -> bytes:
    """128 bits that tell a shingle set from others."""
    a = shingles.sum(dtype=np.uint64)
    b = mix(shingles + np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups out of batches that are sorted by the keys; many small groups share a table.

    A table ends where a group ends, and is cut as soon as that is possible.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        changed = np.zeros(batch.num_rows - 1, bool)
        for k in keys:
            x = batch.column(k).to_numpy(zero_copy_only=False)
            changed |= x[1:] != x[:-1]
        cut = np.flatnonzero(changed)
        if held and any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        if len(cut):
            yield pa.Table.from_batches([*held, batch.slice(0, int(cut[-1]) + 1)])
            held = [batch.slice(int(cut[-1]) + 1)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, per_file: int = 200_000) -> DataFrame:
    """(a, b) to (node, root): the smallest node of each node's connected component, for all nodes on an edge.

    Alternates large-star and small-star steps (each a min per node, pre-aggregated,
    and a join), storing the result of each round in files of about ``per_file``
    rows, until a round changes nothing. The mins are stored too, so that both sides of
    the join are read and dealt anew, and a hub's rows can be split among tasks.
    """

    def settled(rows: DataFrame, most: int) -> tuple[Stored, int, tuple]:
        kept = Stored(rows.coalesce(max(1, math.ceil(most / per_file))))
        mark = kept.df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        return kept, mark[0], tuple(mark)

    first = Stored(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    kept, n, mark = settled(first.df.distinct(), first.df.count())
    first.remove()
    while True:
        state = kept.df
        if not n:
            return state.select(F.col("a").alias("node"), F.col("b").alias("root"))
        both = state.union(state.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = Stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("_u"), F.least("a", "m").alias("m")))
        large = both.join(low.df, F.col("a") == F.col("_u")).where("b > a AND b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least.withColumnRenamed("a", "_u"), F.col("a") == F.col("_u")).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        after, n, now = settled(hung.select("e.*").where("a != b").distinct(), 2 * n)
        low.remove()
        if now == mark:
            after.remove()
            return state.select(F.col("a").alias("node"), F.col("b").alias("root")).union(state.select("b", "b").distinct())
        kept.remove()
        kept, mark = after, now


def repeated(array: pa.Array, n: np.ndarray) -> pa.Array:
    return pc.take(array, pa.array(np.repeat(np.arange(len(n)), n)))
