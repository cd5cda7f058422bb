"""Approximate nearest neighbours: inverted file, product-quantised residuals, exact reranking.

Centroids and codebooks are fitted on a bounded sample; every row is then assigned
to its coarse list and its residual is coded. Lists are packed into blocks of a
bounded number of rows (a list larger than that has several blocks); a query goes
to the blocks of the lists it probes, where tables of its inner products with all
codewords give approximate cosines. The error of each is at most the distance of the
row to its codewords, so a block compares the original vectors of all rows that can be
among its nearest, in double precision, and passes on its exact nearest for each query.
The number of probed lists is calibrated on the sample for the target recall; nothing
else is approximate.

Rows with an equal vector tie exactly, and ties go to the smaller id; so beyond
the first ``k + 1`` ids of an equal vector none can be in a result, and a block
passes over those without loss.

Edge cases: vectors that are null, zero or hold null or non-finite components take
no part, nor do those of another dimension than the most frequent (of equally
frequent ones, the smallest); null ids neither. Rows that repeat an id and vector
count once. A query's own id is no candidate of it. Empty tables give an empty
result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK = 8192
LEAST_ROWS = 200  # that a query compares, on average; so it probes all lists of a small table


@dataclass
class Index:
    centroids: np.ndarray  # lists x d
    books: np.ndarray  # subspaces x codewords x width
    probes: int
    first: np.ndarray | None = None  # first block of each list
    blocks: np.ndarray | None = None  # number of blocks of each list


def _even(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, times a power of two each, so that no square overflows; cosines stay the same, bit by bit."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _unit(x: np.ndarray) -> np.ndarray:
    x = _even(x)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def _rounding(d: int) -> float:
    """Error of a cosine in single precision, at most."""
    return (d + 40) * 2.0**-22


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's algorithm; an empty cluster takes the place of a random point."""
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, x[:, j], k) for j in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], x[rng.integers(0, len(x), k)]).astype(np.float32)
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    return np.concatenate([(x[a : a + 4096] @ c.T - half).argmax(axis=1) for a in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def valid(vectors: DataFrame, id_col: str, vec_col: str, d: int | None = None) -> tuple[DataFrame, int]:
    """Rows (id, vec, vh) that take part, and their dimension, which is the most frequent unless given; vh is a hash of the vector."""
    ok = F.col(vec_col).isNotNull() & F.forall(vec_col, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vec_col, lambda v: v != 0)
    single = vectors.schema[vec_col].dataType.simpleString() == "array<float>"
    vec = F.col(vec_col).cast("array<float>" if single else "array<double>")
    rows = vectors.where(ok & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), vec.alias("vec"), F.xxhash64(vec).alias("vh"))
    if d is not None:
        return rows.where(F.size("vec") == d), d
    top = rows.groupBy(F.size("vec").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    d = top["d"] if top else 0
    return rows.where(F.size("vec") == d), d


def fit(rows: DataFrame, d: int, sample: int = 20_000, recall: float = 0.98, k: int = 5) -> Index | None:
    """Fit on the ``sample`` rows with the smallest hash of their vectors, collected to the driver."""
    total = rows.count()
    drawn = rows.dropDuplicates(["vh"]).orderBy("vh").limit(sample).select("vec").toArrow()
    if not drawn.num_rows:
        return None
    x = _unit(_matrix(drawn.column("vec").combine_chunks(), d))
    rng = np.random.default_rng(19)
    lists = int(np.clip(np.sqrt(total), 1, min(4096, len(x))))
    centroids = kmeans(x, lists, 8, rng)
    residual = x - centroids[nearest(x, centroids)]
    parts = max(p for p in range(1, d + 1) if d % p == 0 and (p <= 32 or p == 1))
    books = np.stack([kmeans(np.ascontiguousarray(r), min(256, len(x)), 6, rng) for r in np.split(residual, parts, axis=1)])
    # How many lists a query must probe: the ranks of the lists of its true neighbours in the sample.
    q = rng.choice(len(x), min(256, len(x)), replace=False)
    cosine = x[q] @ x.T
    cosine[np.arange(len(q)), q] = -9
    true = np.argsort(-cosine, axis=1)[:, : min(k, len(x) - 1)]
    order = np.argsort(np.argsort(-(x[q] @ centroids.T), axis=1), axis=1)
    ranks = np.take_along_axis(order, nearest(x, centroids)[true], axis=1) if true.size else np.zeros(1)
    probes = max(int(np.quantile(ranks, recall)) + 1, -(-lists * LEAST_ROWS // total))
    return Index(centroids, books, min(lists, probes))


def _encode(rows: DataFrame, index: Index, d: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((index.centroids, index.books))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, books = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _unit(_matrix(batch.column("vec"), d))
            at = nearest(x, centroids)
            codes = np.stack([nearest(np.ascontiguousarray(r), b) for r, b in zip(np.split(x - centroids[at], len(books), axis=1), books, strict=True)], axis=1).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("vh"), pa.array(at.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column("vec")], ["id", "vh", "list", "codes", "vec"])

    return rows.mapInArrow(encode, f"id {rows.schema['id'].dataType.simpleString()}, vh long, list int, codes binary, vec {rows.schema['vec'].dataType.simpleString()}")


def _dealt(queries: DataFrame, index: Index, d: int) -> DataFrame:
    """A row for each query and block that it probes, with the probed lists of that block."""
    shared = queries.sparkSession.sparkContext.broadcast(index)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = shared.value
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                q = _unit(_matrix(part.column("vec"), d))
                near = np.argsort(-(q @ ix.centroids.T), axis=1, kind="stable")[:, : ix.probes]
                row, block, lists = [], [], []
                for i, probed in enumerate(near):
                    of: dict[int, list[int]] = {}
                    for c in probed.tolist():
                        for b in range(int(ix.first[c]), int(ix.first[c] + ix.blocks[c])):
                            of.setdefault(b, []).append(c)
                    row += [i] * len(of)
                    block += of.keys()
                    lists += of.values()
                part = part.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(block, pa.int32()), part.column("id"), part.column("vh"), part.column("vec"), pa.array(lists, pa.list_(pa.int32()))], ["block", "id", "vh", "vec", "probed"])

    return queries.mapInArrow(deal, f"block int, id {queries.schema['id'].dataType.simpleString()}, vh long, vec {queries.schema['vec'].dataType.simpleString()}, probed array<int>")


def _scan(index: Index, d: int, k: int, spark):
    shared = spark.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix, block, held, rows = shared.value, None, [], None
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            kinds = batch.column("kind").to_numpy()
            edges = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1 if len(blocks) else []
            for a, b in zip([0, *edges], [*edges, len(blocks)], strict=True):
                if a == b:
                    continue
                if blocks[a] != block:
                    block, held, rows = blocks[a], [], None
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    held.append(part)
                    continue
                if rows is None:
                    rows = _block_rows(ix, pa.Table.from_batches(held), d, k) if held else ()
                for i in range(0, part.num_rows if rows else 0, 128):
                    yield from _best(ix, rows, part.slice(i, 128), d, k)

    return scan


def _block_rows(ix: Index, table: pa.Table, d: int, k: int) -> tuple:
    """Ids, lists, codes, vectors, unit vectors and errors of a block, ordered by id, with at most k + 1 ids of an equal vector."""
    table = table.select(["id", "vh", "list", "codes", "vec"]).sort_by("id")
    vh, ids = table.column("vh").to_numpy(), table.column("id").to_numpy()
    order = np.argsort(vh, kind="stable")
    s, of = vh[order], ids[order]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    order = order[first | np.concatenate([[True], of[1:] != of[:-1]])]  # repeated rows count once
    s = vh[order]
    begin = np.maximum.accumulate(np.where(np.concatenate([[True], s[1:] != s[:-1]]), np.arange(len(s)), 0))
    table = table.take(np.sort(order[np.arange(len(s)) - begin <= k]))
    codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(table.num_rows, -1).astype(np.int64)
    lists, x = table.column("list").to_numpy(), _matrix(table.column("vec").combine_chunks(), d)
    unit = _unit(x)
    decoded = ix.centroids[lists] + np.concatenate([b[codes[:, p]] for p, b in enumerate(ix.books)], axis=1)
    return table.column("id").combine_chunks(), lists, codes, x, unit, np.linalg.norm(unit - decoded, axis=1) + _rounding(d)


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, added in the order of the components, so that equal vectors tie exactly."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j].astype(np.float64) * y[:, j].astype(np.float64)
    return out


def _best(ix: Index, rows: tuple, queries: pa.RecordBatch, d: int, k: int) -> Iterator[pa.RecordBatch]:
    """The exact k nearest of a block's rows in the probed lists, for each query."""
    ids, lists, codes, x, unit, error = rows
    raw = _matrix(queries.column("vec"), d)
    q = _unit(raw)
    tables = np.einsum("qpw,pkw->qpk", q.reshape(len(q), len(ix.books), -1), ix.books)
    score = (q @ ix.centroids.T)[:, lists]
    for p in range(codes.shape[1]):
        score += tables[:, p, codes[:, p]]
    for i, probed in enumerate(queries.column("probed").to_pylist()):
        on = np.flatnonzero(np.isin(lists, probed) & pc.not_equal(ids, queries.column("id")[i]).to_numpy(zero_copy_only=False))
        if len(on) > k:  # at least k rows reach the k-th of the lower bounds
            s, e = score[i, on], error[on]
            on = on[s + e >= np.partition(s - e, len(s) - k)[len(s) - k]]
        if len(on) > k:
            s = unit[on] @ q[i]
            on = on[s >= np.partition(s, len(s) - k)[len(s) - k] - 2 * _rounding(d)]
        whole, asked = _even(x[on]), np.broadcast_to(_even(raw[i : i + 1]), (len(on), d))
        s = _dots(whole, asked) / np.sqrt(_dots(whole, whole)) / np.sqrt(_dots(asked, asked))
        top = np.argsort(-s, kind="stable")[:k]
        of = [queries.column(c).slice(i, 1).take(pa.array(np.zeros(len(top), np.int64))) for c in ("id", "vh")]
        yield pa.RecordBatch.from_arrays([*of, ids.take(pa.array(on[top])), pa.array(s[top])], ["query_id", "query_vh", "id", "score"])


def search(vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, recall: float = 0.98, sample: int = 20_000) -> DataFrame:
    """(query_id, rank, id_col, score): the k nearest found of each row for which ``is_query`` holds.

    Rows of one id with different vectors are queries of their own, each with its ranks;
    rows of a query's id are no candidates of it. score is the cosine of the original vectors.
    """
    spark = vectors.sparkSession
    rows, d = valid(vectors, id_col, vec_col)
    kind = vectors.schema[id_col].dataType.simpleString()
    index = fit(rows, d, sample, recall, k) if d else None
    if index is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, {id_col} {kind}, score double")
    queries = valid(vectors.where(is_query), id_col, vec_col, d)[0].dropDuplicates(["id", "vh"])
    coded = _encode(rows, index, d)
    sizes = dict(coded.groupBy("list").agg(F.count("*").alias("n")).toPandas().itertuples(index=False))
    index.first, index.blocks = np.zeros(len(index.centroids), np.int32), np.ones(len(index.centroids), np.int32)
    block, room = 0, BLOCK
    for c in range(len(index.centroids)):
        n = int(sizes.get(c, 0))
        if n > room:
            block, room = block + 1, BLOCK
        index.first[c] = block
        if n > BLOCK:
            index.blocks[c] = -(-n // BLOCK)
            block, room = block + int(index.blocks[c]), BLOCK
        else:
            room -= n
    lists = spark.createDataFrame([(c, int(index.first[c]), int(index.blocks[c])) for c in range(len(index.centroids))], "_list int, first int, blocks int")
    placed = coded.join(F.broadcast(lists), F.col("list") == F.col("_list")).select(
        (F.col("first") + F.pmod(F.xxhash64("id", "vh"), F.col("blocks"))).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "vh", "list", "codes", "vec", F.lit(None).cast("array<int>").alias("probed")
    )
    asked = _dealt(queries, index, d).select("block", F.lit(1).alias("kind"), "id", "vh", F.lit(None).cast("int").alias("list"), F.lit(None).cast("binary").alias("codes"), "vec", "probed")
    # As many partitions as blocks, so that small ones aren't put together.
    scored = placed.unionAll(asked).repartition(max(1, min(block + 1, 20_000)), "block").sortWithinPartitions("block", "kind").mapInArrow(_scan(index, d, k, spark), f"query_id {kind}, query_vh long, id {kind}, score double")
    order = W.partitionBy("query_id", "query_vh").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
