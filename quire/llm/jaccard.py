"""Jaccard self-join of word-shingle sets by the chosen-path method.

Documents with equal sets form one class first. The classes' sets are embedded as
128 min-wise sampled shingles, and each run splits them recursively: a node of the
recursion samples one or two of the coordinates (5/4 on average, as the threshold
of 0.8 asks for, so that a similar pair stays together in one child on average),
and sets that share the sampled shingle go on together. Buckets of at most
``small`` sets are compared by brute force; buckets that the deepest level leaves
larger are taken as wholly suspect. The number of runs follows from the target
recall and the survival probability of the branching process.

Suspect pairs only serve to find groups: within each connected group of suspects
pairs are compared exactly, on the whole sets, in blocks of bounded size, of which a
large group has many. So links are exact and complete within a group, and what
leaves a block is a count for each set and a spanning forest, never pairs. Counting
links compares all pairs of a group. Finding classes alone (``keep_one``) compares a
group's sets with its first block, and then only the few that aren't yet in the
group's largest class with all others: so a hot group takes time in proportion to
its size, and the classes are the same.

Edge cases: null texts and texts without a word are alone, with no link. Repeated
rows and equal sets link to each other. Null ids are kept as rows; a class's id is
its smallest non-null id. An empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Stored, stored
from quire.llm.shingles import SLOTS, components, minwise, mix, runs, set_key, shingle_sets, signature

LEVELS, STRIDE = 5, 2
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1_000_000
MOST_BROADCAST = 500_000  # rows of a table that documents are looked up in without a shuffle of texts; beyond, by one


def survival(similarity: float, level: int) -> float:
    """Probability that a pair shares a bucket at the level of one run."""
    s = 1.0
    for _ in range(level):
        x = similarity * s
        s = 0.75 * x + 0.25 * (1 - (1 - x) ** 2)
    return s


def runs_for(recall: float, similarity: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - survival(similarity, LEVELS))))


def _embedded(docs: DataFrame, id_col: str, text_col: str, seeds: int) -> DataFrame:
    """(id, th, node, n, sig, paths): a hash of the text, the set's key and size, its signature, and its buckets at the first level of each run.

    The first level splits by the whole hash of a sampled shingle, as all sets meet
    there; within a bucket, 16 bits of each are enough.
    """
    root = mix(np.arange(1, seeds + 1, dtype=np.uint64))
    first, more, second = _sample(root)
    slot, start = np.concatenate([first, second[more]]), np.concatenate([root, root[more]])

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sigs, sizes, paths = [], [], [], []
            for s in shingle_sets(batch.column("text").to_pylist()):
                sizes.append(len(s))
                if not len(s):
                    keys.append(None), sigs.append(None), paths.append(None)
                    continue
                tokens = minwise(s)
                keys.append(set_key(s))
                sigs.append(signature(tokens).tobytes())
                paths.append(_child(start, slot, tokens[slot]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(sigs, pa.binary()), pa.array(paths, pa.list_(pa.int64()))], ["id", "th", "node", "n", "sig", "paths"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text")).mapInArrow(embed, f"id {kind}, th long, node binary, n long, sig binary, paths array<long>")


def _sample(path: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The coordinates that each path's node samples: the first, whether there is a second, and that."""
    h = mix(path * np.uint64(0x2545F4914F6CDD1D) + np.uint64(99))
    first = (h & np.uint64(SLOTS - 1)).astype(np.int64)
    second = (first + 1 + ((h >> np.uint64(20)) % np.uint64(SLOTS - 1)).astype(np.int64)) % SLOTS
    return first, (h >> np.uint64(50)) % np.uint64(4) == 0, second


def _child(path: np.ndarray, slot: np.ndarray, token: np.ndarray) -> np.ndarray:
    return mix(mix(path + slot.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) + token.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SLOTS)


def _split(rows: DataFrame, levels: int) -> DataFrame:
    """(node, sig, path) to (node, path) of the descendants that many levels down, with no shuffle between these levels."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig, path = _signatures(batch.column("sig")), batch.column("path").to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.arange(len(path))
            for _ in range(levels):
                first, more, second = _sample(path)
                row, slot = np.concatenate([np.arange(len(path)), np.flatnonzero(more)]), np.concatenate([first, second[more]])
                at, path = at[row], _child(path[row], slot, sig[at[row], slot])
            yield pa.RecordBatch.from_arrays([pc.take(batch.column("node"), pa.array(at)), pa.array(path.view(np.int64))], ["node", "path"])

    return rows.mapInArrow(split, "node binary, path long")


def _compare(leaves: DataFrame, least: int) -> DataFrame:
    """Suspect edges of small buckets: a spanning forest of each bucket's pairs that agree in ``least`` coordinates."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in runs(batches, ["path"]):
            for a in range(0, group.num_rows, 1 << 16):  # the overlap holds any bucket that is cut here
                part = group.slice(a, (1 << 16) + 64)
                path, sig = part.column("path").to_numpy(), _signatures(part.column("sig"))
                left, right, d = [], [], 1
                while d < len(path):
                    i = np.flatnonzero(path[d:] == path[:-d])
                    if not len(i):
                        break
                    for x in range(0, len(i), 1 << 14):
                        j = i[x : x + (1 << 14)]
                        j = j[(sig[j] == sig[j + d]).sum(axis=1) >= least]
                        left.append(j)
                        right.append(j + d)
                    d += 1
                if left:
                    x, y = _forest(np.concatenate(left), np.concatenate(right))
                    node = part.column("node").combine_chunks()
                    yield pa.RecordBatch.from_arrays([pc.take(node, pa.array(x, pa.int64())), pc.take(node, pa.array(y, pa.int64()))], ["a", "b"])

    return leaves.repartition("path").sortWithinPartitions("path").mapInArrow(compare, "a binary, b binary")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = parent.get(p, p)
            x = p
        return x

    left, right = [], []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            parent[max(p, q)] = min(p, q)
            left.append(x)
            right.append(y)
    return left, right


def suspects(sets: DataFrame, similarity: float, small: int) -> DataFrame:
    """(node, root): groups of sets that may be similar, from all runs at once, one level of the recursion after the other."""
    least = math.floor(SLOTS * similarity - 4.2 * math.sqrt(SLOTS * similarity * (1 - similarity)))
    sig, found, kept = sets.select(F.col("node").alias("_n"), "sig"), [], []
    rows = sets.select("node", F.explode("paths").alias("path"))
    for level in range(1, LEVELS + 1, STRIDE):
        last = level + STRIDE > LEVELS
        pivot = [F.min("node").alias("pivot")] if last else []
        sizes = rows.groupBy("path").agg(F.count("*").alias("size"), *pivot).where("size > 1").withColumnRenamed("path", "_p")
        shared = Stored(rows.join(sizes, F.col("path") == F.col("_p")).drop("_p"))
        kept.append(shared)
        with_sig = lambda part: part.select("node", "path").join(sig, F.col("node") == F.col("_n")).select("node", "path", "sig")
        found.append(Stored(_compare(with_sig(shared.df.where(F.col("size") <= small)), least)))
        large = shared.df.where(F.col("size") > small)
        if last:
            found.append(Stored(large.select(F.col("pivot").alias("a"), F.col("node").alias("b"))))
        elif large.isEmpty():
            break
        else:
            kept.append(Stored(_split(with_sig(large), STRIDE)))
            rows = kept[-1].df
    groups = components(reduce(DataFrame.unionAll, [f.df for f in found]))
    for table in kept + found:
        table.remove()
    return groups


def _block_links(similarity: float):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs(batches, ["root", "i", "j"]):
            keys = [table.column(k).to_numpy() for k in ("root", "i", "j")]
            cut = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1 if table.num_rows > 1 else []
            for a, b in zip([0, *cut], [*cut, table.num_rows], strict=True):
                part = table.slice(a, b - a)
                links, root = _links(part, int(keys[1][a]), int(keys[2][a]), similarity)
                node = part.column("node").combine_chunks()
                of = [part.column(c).combine_chunks() for c in ("root", "blocks")]
                yield pa.RecordBatch.from_arrays([*of, node, pa.array(links), pc.take(node, pa.array(root))], ["root", "blocks", "node", "links", "head"])

    return compare


def _links(part: pa.Table, i: int, j: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of a block, or a pair of blocks: weighted links of each set, and the first member of its linked group."""
    lists = part.column("shingles").combine_chunks()
    n = np.diff(lists.offsets.to_numpy())
    block, weight = part.column("block").to_numpy(), part.column("m").to_numpy()
    shared = _intersections(np.repeat(np.arange(len(n)), n), lists.flatten().to_numpy(zero_copy_only=False), len(n))
    linked = shared >= similarity * (n[:, None] + n[None, :] - shared) - 1e-6
    np.fill_diagonal(linked, False)
    if i != j:
        linked &= block[:, None] != block[None, :]
    links = linked @ weight
    label = np.arange(len(n))
    while True:
        low = np.where(linked, label[None, :], len(n)).min(axis=1, initial=len(n))
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return links.astype(np.int64), label
        label = new


def _intersections(owner: np.ndarray, shingles: np.ndarray, n: int) -> np.ndarray:
    """Sizes of the intersections of n sets; shingles that are in the same sets are counted once, with a weight."""
    order = np.argsort(shingles, kind="stable")
    s, o = shingles[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    many = np.diff(np.append(start, len(s)))
    out = np.zeros((n, n), np.float64)
    out[np.arange(n), np.arange(n)] = np.bincount(owner, minlength=n)
    keep = many > 1
    if not keep.any():
        return out
    mark = np.random.default_rng(13).integers(0, 1 << 63, (n, 2), dtype=np.uint64)
    sums = np.add.reduceat(mark[o], start, axis=0)[keep]
    _, first, weight = np.unique(sums, axis=0, return_index=True, return_counts=True)
    start, many = start[keep][first], many[keep][first]
    out[:] = 0
    for a in range(0, len(start), 4096):
        x, k, w = start[a : a + 4096], many[a : a + 4096], weight[a : a + 4096]
        column = np.repeat(np.arange(len(x)), k)
        at = np.repeat(x - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
        m = np.zeros((n, len(x)), np.float32)
        m[o[at], column] = 1
        out += (m * w.astype(np.float32)) @ m.T
    return out


def _forests(pairs: DataFrame, similarity: float) -> DataFrame:
    """Placed sets with their block pairs (i, j) to (root, blocks, node, links, head), compared exactly."""
    return pairs.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(_block_links(similarity), "root binary, blocks int, node binary, links long, head binary")


def _paired(placed: DataFrame, others: Column) -> DataFrame:
    """A row of each set for each block that it is compared with."""
    rows = placed.withColumn("other", F.explode(others))
    return rows.select("root", "blocks", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "m", "shingles")


def _looked_up(table: DataFrame) -> DataFrame:
    """A table that others are joined with: it goes to all tasks if it has few rows."""
    return F.broadcast(table) if table.count() <= MOST_BROADCAST else table


def _placed(docs: DataFrame, id_col: str, text_col: str, sets: DataFrame, groups: DataFrame, sets_of=shingle_sets) -> DataFrame:
    """(root, blocks, block, node, m, shingles) of the sets in groups, whose texts are looked up by one row of each set; ``sets_of`` makes sets of texts."""
    members = groups.join(sets.select(F.col("node").alias("_n"), "m", "n", "rep"), F.col("node") == F.col("_n")).drop("_n")
    blocks = members.groupBy(F.col("root").alias("_r")).agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    reps = stored(members.join(blocks, F.col("root") == F.col("_r")).select(F.col("rep.id").alias("_id"), F.col("rep.th").alias("_th"), "root", "blocks", "node", "m"))

    def sets_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(sets_of(batch.column("_text").to_pylist()))
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
            flat = pa.array(np.concatenate(found).view(np.int64) if found else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("root", "blocks", "node", "m")), pa.ListArray.from_arrays(pa.array(offsets), flat)], ["root", "blocks", "node", "m", "shingles"])

    texts = docs.select(F.col(id_col).alias("_i"), F.xxhash64(F.col(text_col)).alias("_t"), F.col(text_col).alias("_text"))
    texts = texts.join(_looked_up(reps), F.col("_i").eqNullSafe(F.col("_id")) & (F.col("_t") == F.col("_th"))).select("_text", "root", "blocks", "node", "m")
    whole = texts.mapInArrow(sets_again, "root binary, blocks int, node binary, m long, shingles array<long>").dropDuplicates(["node"])
    return stored(whole.select("root", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("block"), "node", "m", "shingles"))


def _joined(edges: DataFrame) -> DataFrame:
    """(node, root) of exact links: a group of one block has its classes already, as all its pairs were compared at once."""
    one = edges.where("blocks = 1").select("node", F.col("head").alias("root"))
    if edges.where("blocks > 1").isEmpty():
        return one
    return one.unionAll(components(edges.where("blocks > 1").select(F.col("node").alias("a"), F.col("head").alias("b"))))


def _counted(placed: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(node, root) of the classes, and (node, links), from all pairs of each group."""
    exact = stored(_forests(_paired(placed, F.sequence(F.lit(0), F.col("blocks") - 1)), similarity))
    return _joined(exact), exact.groupBy("node").agg(F.sum("links").alias("links"))


def _classes(placed: DataFrame, similarity: float) -> DataFrame:
    """(node, root) of the classes, with no count of links."""
    with_first = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(F.lit(0)))
    edges = stored(_forests(_paired(placed, with_first), similarity).drop("links"))
    if edges.where("blocks > 1").isEmpty():
        return _joined(edges)
    # Of groups of several blocks: the sets that are not in the largest class so far.
    so_far = components(edges.where("blocks > 1").select(F.col("node").alias("a"), F.col("head").alias("b"))).select("node", F.col("root").alias("class"))
    large = placed.where("blocks > 1").select(F.col("node").alias("_n"), F.col("root").alias("_r")).join(so_far, F.col("_n") == F.col("node"), "left").select("_n", "_r", F.coalesce("class", "_n").alias("class"))
    sizes = large.groupBy("_r", "class").agg(F.count("*").alias("size")).groupBy("_r").agg(F.max_by("class", F.struct("size", "class")).alias("main"))
    rest = Stored(large.join(sizes.withColumnRenamed("_r", "_g"), F.col("_r") == F.col("_g")).where("class != main").select("_n", "_r"))
    if not rest.df.isEmpty():
        counts = stored(rest.df.groupBy(F.col("_r").alias("_g")).agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("parts")))
        # A pair of parts: some sets that remain, numbered behind the blocks, against a block of the whole group.
        of = placed.where("blocks > 1").join(counts, F.col("root") == F.col("_g")).withColumn("part", F.col("blocks") + F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
        remain = of.join(rest.df, F.col("node") == F.col("_n"), "left_semi")
        all_sets = of.select("root", "blocks", F.col("block").alias("i"), F.explode(F.sequence(F.col("blocks"), F.col("blocks") + F.col("parts") - 1)).alias("j"), "block", "node", "m", "shingles")
        remain = remain.select("root", "blocks", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("i"), F.col("part").alias("j"), F.col("part").alias("block"), "node", "m", "shingles")
        edges = edges.unionAll(stored(_forests(all_sets.unionAll(remain), similarity).drop("links")))
    rest.remove()
    return _joined(edges)


def _sets(docs: DataFrame, id_col: str, text_col: str, similarity: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """Every row, embedded, and a row for each different set: (node, m, id, rep, n, sig, paths); rep is its row with the smallest id."""
    every = stored(_embedded(docs, id_col, text_col, runs_for(recall, similarity)))
    first = lambda c: F.first(c).alias(c)
    rep = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "th")).alias("rep")
    return every, stored(every.where("node IS NOT NULL").groupBy("node").agg(F.count("*").alias("m"), F.min("id").alias("id"), rep, first("n"), first("sig"), first("paths")))


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, recall: float = 0.9999, small: int = 64) -> DataFrame:
    """One row per input row: the id, class_id, n_links (documents of similarity or more), n_copies.

    class_id is the smallest id in the connected group of links; a document
    without words has its own id.
    """
    every, sets = _sets(docs, id_col, text_col, similarity, recall)
    classes, links = _counted(_placed(docs, id_col, text_col, sets, suspects(sets, similarity, small)), similarity)
    joined = stored(classes.join(links.withColumnRenamed("node", "_l"), F.col("node") == F.col("_l")).select(F.col("node").alias("_n"), "root", "links"))
    of = sets.select("node", "m", "id").join(joined, F.col("node") == F.col("_n"), "left").select("node", "m", "id", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    least = of.groupBy("root").agg(F.min("id").alias("class_id")).withColumnRenamed("root", "_r")
    told = of.join(least, F.col("root") == F.col("_r")).select(F.col("node").alias("_node"), "class_id", (F.col("links") + F.col("m") - 1).alias("links"), "m")
    rows = every.select(F.col("id").alias("_id"), "node").join(told, F.col("node") == F.col("_node"), "left")
    return rows.select(
        F.col("_id").alias(id_col), F.coalesce("class_id", "_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"), F.coalesce("m", F.lit(1)).alias("n_copies")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = 0.8, recall: float = 0.9999, small: int = 64) -> DataFrame:
    """One row of each class: the one with the smallest id (null last), of equal ids the one whose text has the smallest hash.

    Of rows that repeat both id and text any one stays; rows without a word all stay.
    Rows are judged by id and text, so different texts under one id don't take each
    other along. Only rows that go, or repeat, are looked up; the others pass as they are.
    """
    every, sets = _sets(docs, id_col, text_col, similarity, recall)
    placed = _placed(docs, id_col, text_col, sets, suspects(sets, similarity, small))
    classes = stored(_classes(placed, similarity).select(F.col("node").alias("_n"), "root"))
    several = sets.select("node", "m", "rep").join(classes, F.col("node") == F.col("_n"), "left").where("m > 1 OR root IS NOT NULL").select("node", "rep", F.coalesce("root", "node").alias("root"))
    stays = several.groupBy("root").agg(F.min("rep").alias("stays")).withColumnRenamed("root", "_r")
    judged = several.join(stays, F.col("root") == F.col("_r")).select(F.col("node").alias("_n"), "stays")
    rows = every.select("id", "th", "node").join(judged, F.col("node") == F.col("_n"))
    is_it = F.col("id").eqNullSafe(F.col("stays.id")) & (F.col("th") == F.col("stays.th"))
    marks = stored(rows.groupBy("id", "th").agg(F.max(is_it).alias("stays"), F.count("*").alias("rows")).where("NOT stays OR rows > 1").select(F.col("id").alias("_gone_id"), F.col("th").alias("_gone_th"), "stays"))
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(id_col).alias("_id"), F.xxhash64(F.col(text_col)).alias("_th"))
    same = F.col("_id").eqNullSafe(F.col("_gone_id")) & (F.col("_th") == F.col("_gone_th"))
    out = row.join(_looked_up(marks), same, "left_anti").select("_row.*")
    repeated = marks.where("stays")
    if repeated.isEmpty():
        return out
    return out.unionAll(row.join(_looked_up(repeated), same, "left_semi").groupBy("_id", "_th").agg(F.first("_row").alias("_row")).select("_row.*"))
