"""Near duplicates by fast similarity sketches, banding, and exact verification.

A sketch has 128 coordinates. In a round each element of a set falls, by a hash of
the element and the round, into one coordinate with one value; a coordinate keeps the
smallest value of the earliest round that reaches it. Rounds go on until every
coordinate is filled: after 128 rounds of hashed places, round 128 + i offers all
elements to coordinate i, so none stays empty. Two sets agree in a coordinate with the
probability of their similarity, and the share of agreeing coordinates is concentrated
as if these were drawn independently. A set of n elements takes about n + 128 log 128
steps in place of 128 n.

Sets that agree in all coordinates of one of 32 bands of six (``band_places``) share
its bucket: with a similarity of 0.85 a pair misses all of them once in four million.
Buckets of at most 64 sets compare their sketches; a larger one is banded again, each
of its bands joined with two more coordinates, in four ways; those still larger are
taken as wholly suspect. Suspects make groups, within which whole sets are compared
exactly, in blocks (``jaccard``): a group's first block with all, then those not yet
in the group's largest class with all. So links decide on full sets, and hot groups
take time in proportion to their size.

A word is ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z in lower case. A set holds the
distinct runs of three words, or of all words if there are fewer.

Edge cases: null texts and texts without a word have an empty set, are linked with
nothing, and are their own component. Repeated rows and equal sets are linked. Null
ids are kept as rows, never a component's id if another row has one; ``kept`` is false
for them then. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm import jaccard
from quire.llm.common import Stored, slices, stored
from quire.llm.shingles import SLOTS, components, mix, set_key, signature

WIDTH, SIMILARITY = 3, 0.85
BANDS, ROWS = 32, 6
AGAIN, MORE = 4, 2  # of a bucket that is too large: bandings, and further coordinates of each
SMALL = 64
SLICE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_GAP = np.array([i == 32 or 9 <= i <= 13 for i in range(256)])
_LOW = np.array([i + 32 if 65 <= i <= 90 else i for i in range(256)], np.uint8)
_ROUNDS = np.arange(1, 2 * SLOTS + 1, dtype=np.uint64) * _ODD
_VALUES = np.random.default_rng(31).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_places() -> np.ndarray:
    """The coordinates of each band; one coordinate is in one or two bands."""
    rng = np.random.default_rng(32)
    order = np.concatenate([rng.permutation(SLOTS) for _ in range(-(-BANDS * ROWS // SLOTS))])
    return order[: BANDS * ROWS].reshape(BANDS, ROWS)


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Each word's text and hash."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([len(b) + 1 for b in raw])
    data = _LOW[np.frombuffer(b" ".join([*raw, b""]), np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], _GAP[data], [True]])))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    # A polynomial over the bytes of each word, by Horner's rule over the words that still have a byte.
    h, at, n = np.zeros(len(first), np.uint64), np.argsort(first - last, kind="stable"), last - first
    lengths = n[at]
    for k in range(int(lengths[0])):
        at = at[: np.searchsorted(-lengths, -k, "left")]
        h[at] = h[at] * _ODD + _VALUES[data[first[at] + k]]
        if len(at) < 64:  # few words are longer than this: one by one
            for i in at.tolist():
                h[i] = _long(h[i], data[first[i] + k + 1 : last[i]])
            break
    return np.searchsorted(ends, first, "right"), mix(h + n.astype(np.uint64))


def _long(h: np.uint64, data: np.ndarray) -> np.uint64:
    """The polynomial carried on over the rest of a long word, in blocks."""
    for a in range(0, len(data), 1 << 12):
        part = _VALUES[data[a : a + (1 << 12)]]
        power = np.cumprod(np.full(len(part), _ODD))
        with np.errstate(over="ignore"):
            h = h * power[-1] + (part * np.concatenate([power[:-1][::-1], np.ones(1, np.uint64)])).sum(dtype=np.uint64)
    return h


def shingle_sets(texts: list[str | None]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    texts = [t or "" for t in texts]
    for a, b in slices([len(t) for t in texts], SLICE):
        owner, h = _words(texts[a:b])
        bounds = np.searchsorted(owner, np.arange(b - a + 1)).tolist()
        run = np.zeros(max(0, len(h) - WIDTH + 1), np.uint64)
        for j in range(WIDTH):
            run = mix(run * _ODD + h[j : j + len(run)])
        for x, y in zip(bounds, bounds[1:]):  # noqa: B905
            if y - x >= WIDTH:
                yield np.unique(run[x : y - WIDTH + 1])
            else:
                few = np.zeros(min(1, y - x), np.uint64)
                for v in h[x:y]:
                    few = mix(few * _ODD + v + np.uint64(y - x))
                yield few


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """The sketch of each set, none of them empty: 64 bits a coordinate, of the round and the value."""
    n = np.array([len(s) for s in sets])
    out = np.full((len(sets), SLOTS), np.iinfo(np.uint64).max)
    if not len(sets):
        return out
    owner, items, flat = np.repeat(np.arange(len(sets)), n), np.concatenate(sets), out.reshape(-1)
    for i in range(2 * SLOTS):
        h = mix(mix(items + _ROUNDS[i]))
        place = (h & np.uint64(SLOTS - 1)).astype(np.int64) if i < SLOTS else i - SLOTS
        np.minimum.at(flat, owner * SLOTS + place, np.uint64(i << 56) | (h >> np.uint64(8)))
        empty = (out == np.iinfo(np.uint64).max).any(axis=1)
        if not empty.any():
            return out
        more = empty[owner]
        owner, items = owner[more], items[more]
    return out


def _bands(sketch: np.ndarray) -> np.ndarray:
    """The bucket of each band, of each sketch."""
    out = np.empty((len(sketch), BANDS), np.uint64)
    for k, places in enumerate(band_places()):
        h = np.full(len(sketch), np.uint64(k + 1))
        for p in places:
            h = mix(h * _ODD + sketch[:, p])
        out[:, k] = h
    return out


def _embedded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, node, n, sig, paths): a hash of the text, the set's key and size, 16 bits of each coordinate, and the buckets."""

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, sigs, paths = [], [], [], []
            held: list[np.ndarray] = []

            def flush():
                some = [s for s in held if len(s)]
                sketch = sketches(some)
                sig, path = iter(signature(sketch)), iter(_bands(sketch).view(np.int64))
                for s in held:
                    sizes.append(len(s))
                    keys.append(set_key(s) if len(s) else None)
                    sigs.append(next(sig).tobytes() if len(s) else None)
                    paths.append(next(path) if len(s) else None)
                held.clear()

            total = 0
            for s in shingle_sets(batch.column("text").to_pylist()):
                held.append(s)
                total += len(s) + SLOTS
                if total > SLICE:
                    flush()
                    total = 0
            flush()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(paths, pa.list_(pa.int64()))], ["id", "th", "node", "n", "sig", "paths"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text")).mapInArrow(embed, f"id {kind}, th long, node binary, n long, sig binary, paths array<long>")


def _banded_again(rows: DataFrame) -> DataFrame:
    """(node, sig, path) of large buckets to (node, path) of smaller ones."""
    places = np.random.default_rng(33).permutation(SLOTS)[: AGAIN * MORE].reshape(AGAIN, MORE)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint16).reshape(-1, SLOTS)
            path = batch.column("path").to_numpy(zero_copy_only=False).view(np.uint64)
            for k, some in enumerate(places):
                h = path + np.uint64(k)
                for j in range(MORE):
                    # Which coordinates follow depends on the bucket, so that no pair meets the same ones in each.
                    at = (int(some[j]) + (path >> np.uint64(7)).astype(np.int64)) % SLOTS
                    h = mix(h * _ODD + sig[np.arange(len(path)), at])
                yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(h.view(np.int64))], ["node", "path"])

    return rows.mapInArrow(split, "node binary, path long")


def suspects(sets: DataFrame, similarity: float = SIMILARITY, small: int = SMALL) -> DataFrame:
    """(node, root): groups of sets that may be similar."""
    least = int(SLOTS * similarity - 4.5 * (SLOTS * similarity * (1 - similarity)) ** 0.5)
    sig, tables = sets.select(F.col("node").alias("_n"), "sig"), []

    def keep(df: DataFrame) -> DataFrame:
        tables.append(Stored(df))
        return tables[-1].df

    def with_sig(rows: DataFrame) -> DataFrame:
        return rows.select("node", "path").join(sig, F.col("node") == F.col("_n")).select("node", "path", "sig")

    def sized(rows: DataFrame) -> DataFrame:
        sizes = rows.groupBy(F.col("path").alias("_p")).agg(F.count("*").alias("size"), F.min("node").alias("pivot")).where("size > 1")
        return keep(rows.join(sizes, F.col("path") == F.col("_p")).drop("_p"))

    first = sized(sets.select("node", F.explode("paths").alias("path")))
    edges = keep(jaccard._compare(with_sig(first.where(F.col("size") <= small)), least))
    large = first.where(F.col("size") > small)
    if not large.isEmpty():
        second = sized(keep(_banded_again(with_sig(large))))
        edges = edges.unionAll(keep(jaccard._compare(with_sig(second.where(F.col("size") <= small)), least)))
        edges = edges.unionAll(keep(second.where((F.col("size") > small) & (F.col("pivot") != F.col("node"))).select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()))
    groups = components(edges)
    for table in tables:
        table.remove()
    return groups


def components_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, small: int = SMALL) -> DataFrame:
    """One row per input row: the id, n_shingles, component_id (smallest id that links reach), kept (the id is that one)."""
    every = stored(_embedded(docs, id_col, text_col))
    first = lambda c: F.first(c).alias(c)
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("rep")
    sets = stored(every.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("m"), F.min("id").alias("id"), rep, first("n"), first("sig"), first("paths")))
    placed = jaccard._placed(docs, id_col, text_col, sets, suspects(sets, similarity, small), shingle_sets)
    classes = stored(jaccard._classes(placed, similarity).select(F.col("node").alias("_n"), "root"))
    of = sets.select("node", "id").join(classes, F.col("node") == F.col("_n"), "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = of.groupBy("root").agg(F.min("id").alias("component_id")).withColumnRenamed("root", "_r")
    told = of.join(least, F.col("root") == F.col("_r")).select(F.col("node").alias("_node"), "component_id")
    rows = every.select("id", "n", "node").join(told, F.col("node") == F.col("_node"), "left")
    component = F.coalesce("component_id", "id")
    return rows.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
