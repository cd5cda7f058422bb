"""Alignment of two tokenizers over a corpus: which token of B stands where a token of A ends.

A is a byte-level BPE (``.json``) of a space and the text, B a sentencepiece model
(``.model``) of the text, to which it adds the space. Places where tokens of both
end cut a text into groups; tokens that end together are linked, and a pair's count
is the number of its links in all documents.

Counting spills: a task keeps the pair-document records of a bounded batch of
documents (a run), sorts them by side B, then A, then document, and writes them as
zstd columns, parted by a radix of the B id: the heads (a pair and its sum in the
run), and the body (each head's documents). A merge of one radix takes the heads of
all runs through a heap, by B id; when a B id has passed, its pairs' counts and
highest count are known and stream back to the runs, as a column beside their heads.
So only heads are gathered by pair, at most one for each run however often a pair
occurs, and a document's records leave its run nowhere. The number of radices follows
the number of input partitions.

Both tokenizers begin anew at a space behind a character that isn't white space: A's
pre-tokens do, and no piece of B has a space behind another character (which is
verified in its vocabulary; otherwise texts are encoded whole). So texts are encoded
in units between such places, and a worker keeps the units that it has met.

Edge cases: null and empty texts, and those whose tokens don't join to the text again
(B's normaliser has changed them), have no tokens: zeros and ''. Repeated rows are
rows of their own. Null ids are kept. Other columns are ignored. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import stored
from quire.llm.tokens import vocabulary

FILE_A, FILE_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
RUN = 1 << 20  # words of a run; a longer document is a run of its own
FLUSH = 1 << 15  # heads that a merge handles at once
STORE, STORE_CHARS = 400_000, 1 << 25  # units that a worker keeps
_RESTART = re.compile(r"(?<=\S)(?= )")
_WHITE = re.compile(r"\s ")
_CODEC = pa.Codec("zstd")


def byte_table() -> dict[str, int]:
    """Fixed by the byte-level format: printable bytes stand for themselves, the others follow from 256 on, in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Units:
    """Both encodings of units of text: links by unit, the text of its groups, and its numbers of tokens."""

    def __init__(self, file_a: str, file_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(file_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=file_b)
        table = byte_table()
        self.bytes_a = {i: bytes(table[c] for c in t) if all(c in table for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = max(self.bytes_a) + 1, len(pieces)
        self.parted = not any("▁" in p.lstrip("▁") for p in pieces)
        self.clear()

    def clear(self) -> None:
        self.ids: dict[str, int] = {}
        self.chars, self.groups, self.odd = 0, [], set()
        self.n_a, self.n_b, self.n_links, self.links = [], [], [], []  # the links of all units, one behind the other

    def parts(self, text: str) -> list[str]:
        """The units of a space and the text, without the space that begins each."""
        if not self.parted:
            return [text]
        if _WHITE.search(f" {text}"):
            return [u[1:] for u in _RESTART.split(f" {text}")]
        return text.split(" ")

    def learn(self, units: set[str]) -> None:
        new = units - self.ids.keys()
        plain = sorted(u for u in new if u and not u[-1].isspace())
        for x in range(0, len(plain), 4096):
            self._learn(plain[x : x + 4096])
        for u in sorted(new - set(plain)):
            self._learn([u])

    def _learn(self, units: list[str]) -> None:
        """Units that all end in no white space are encoded as one text, and parted again; if that isn't the text, its halves are."""
        text = " " + " ".join(units)
        whole = text.encode("utf-8", "surrogatepass")
        a, b = self.a.encode(text, add_special_tokens=False).ids, self.b.encode(text[1:], num_threads=1)
        same = b"".join(map(self.bytes_a.__getitem__, a)) == whole and b"".join(map(self.bytes_b.__getitem__, b)) == whole
        if not same and len(units) > 1:
            self._learn(units[: len(units) // 2])
            self._learn(units[len(units) // 2 :])
            return
        for u in units:
            self.ids[u] = len(self.ids)
            self.chars += len(u)
        if not same:
            self.odd.add(len(self.groups))
            self.groups.append("")
            for x in (self.n_a, self.n_b, self.n_links):
                x.append(0)
            return
        ends_a, ends_b = (np.cumsum([len(of[i]) for i in x]) for of, x in ((self.bytes_a, a), (self.bytes_b, b)))
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)
        in_a, in_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        link = (np.asarray(b, np.int64)[in_b] * self.size_a + np.asarray(a, np.int64)[in_a]).tolist()
        in_a, in_b = (in_a + 1).tolist(), (in_b + 1).tolist()
        said_a, said_b = list(map(str, a)), list(map(str, b))
        said = [f"{','.join(said_a[i:x])}|{','.join(said_b[j:y])}" for i, x, j, y in zip([0, *in_a], in_a, [0, *in_b], in_b)]  # noqa: B905
        ends = np.cumsum([1 + (len(u) if u.isascii() else len(u.encode("utf-8", "surrogatepass"))) for u in units])
        at = np.append(0, np.searchsorted(cuts, ends) + 1)
        self.n_a += np.diff(np.append(0, in_a)[at]).tolist()
        self.n_b += np.diff(np.append(0, in_b)[at]).tolist()
        self.n_links += np.diff(at).tolist()
        self.links += link
        at = at.tolist()
        self.groups += [";".join(said[x:y]) for x, y in zip(at, at[1:])]  # noqa: B905

    def encoded(self, texts: list[str | None]) -> list[list[int]]:
        """The units of each text, as numbers; none for a text that has no tokens. Numbers hold until the next call."""
        if len(self.ids) > STORE or self.chars > STORE_CHARS:
            self.clear()
        parts = [self.parts(t) if t else [] for t in texts]
        self.learn(set().union(*parts))
        out = [list(map(self.ids.__getitem__, p)) for p in parts]
        for i, units in enumerate(out):
            if not self.odd.isdisjoint(units):  # judged by the whole text
                self.learn({texts[i]})
                whole = self.ids[texts[i]]
                out[i] = [] if whole in self.odd else [whole]
        return out

    def said(self, units: list[int]) -> str:
        return ";".join([self.groups[u] for u in units])


@lru_cache(2)
def units(file_a: str, file_b: str) -> Units:
    return Units(*(f if os.path.isabs(f) else vocabulary(f) for f in (file_a, file_b)))


def _packed(x: np.ndarray) -> bytes:
    """Whole numbers as zstd bytes, after their number and width."""
    kind = np.min_scalar_type(int(x.max(initial=0)))
    return len(x).to_bytes(8, "little") + kind.str.encode() + _CODEC.compress(x.astype(kind).tobytes(), asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n, kind = int.from_bytes(data[:8], "little"), np.dtype(data[8:11].decode())
    return np.frombuffer(_CODEC.decompress(data[11:], n * kind.itemsize, asbytes=True), kind).astype(np.int64)


def _steps(x: np.ndarray) -> np.ndarray:
    """A sorted column as differences."""
    return np.diff(x, prepend=0)


def _radix(b: np.ndarray, radices: int) -> np.ndarray:
    return (b * 2654435761 % (1 << 32) * radices) >> 32


def _records(u: Units, rows: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, document, links) of a run, sorted by pair, then document."""
    none = np.zeros(0, np.int64)
    lengths = [len(x) for x in rows]
    flat = np.fromiter(chain.from_iterable(rows), np.int64, sum(lengths))
    met, times = np.unique(np.repeat(np.arange(len(rows)), lengths) * len(u.groups) + flat, return_counts=True)
    doc, unit = np.divmod(met, max(1, len(u.groups)))
    n, pairs = np.array(u.n_links, np.int64), np.array(u.links, np.int64)
    if not len(unit):
        return none, none, none
    start, many = np.cumsum(n) - n, n[unit]
    inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    key = pairs[np.repeat(start[unit], many) + inside] * len(rows) + np.repeat(doc, many)
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.add.reduceat(np.repeat(times, many)[order], first)
    pair, doc = np.divmod(key[first], len(rows))
    return pair, doc, times


def _spill(kind: pa.DataType, file_a: str, file_b: str, radices: int):
    """Documents to runs: a row for each document, and one for each radix with its heads and body."""

    def run(u: Units, number: int, ids: list, texts: list[str | None]) -> pa.RecordBatch:
        rows = u.encoded(texts)
        edge = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        numbers = np.array([u.n_a, u.n_b, u.n_links], np.int64).T[np.fromiter(chain.from_iterable(rows), np.int64, edge[-1])]
        sums = np.concatenate([np.zeros((1, 3), np.int64), np.cumsum(numbers, axis=0)])
        n_a, n_b, n_groups = (sums[edge[1:]] - sums[edge[:-1]]).T
        sha = [hashlib.sha256(u.said(x).encode()).hexdigest() if x else "" for x in rows]
        pair, doc, times = _records(u, rows)
        radix = _radix(pair // u.size_a, radices)
        parts = []
        for r in np.unique(radix).tolist():
            at = radix == r
            p, d, t = pair[at], doc[at], times[at]
            first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
            lens = np.diff(np.append(first, len(p)))
            step = _steps(d)
            step[first] = d[first]
            parts.append((r, _packed(_steps(p[first])), _packed(np.add.reduceat(t, first)), _packed(lens), _packed(step), _packed(t)))
        docs, n = len(texts), len(texts) + len(parts)
        column = lambda values, t: pa.array([*values, *[None] * (n - docs)], t)
        blobs = [pa.array([*[None] * docs, *(p[k] for p in parts)], pa.binary()) for k in range(1, 6)]
        numbers = [column(x.tolist(), pa.int64()) for x in (n_a, n_b, n_groups)]
        where = [pa.array([number] * n, pa.int64()), pa.array([*[-1] * docs, *(p[0] for p in parts)], pa.int32()), column(range(docs), pa.int32())]
        return pa.RecordBatch.from_arrays([*where, column(ids, kind), *numbers, column(sha, pa.string()), *blobs], names)

    names = ["run", "radix", "pos", "id", "n_a", "n_b", "n_groups", "sha", "heads", "sums", "lens", "docs", "times"]

    def spill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        u, number = units(file_a, file_b), TaskContext.get().partitionId() << 32
        ids, texts, words = [], [], 0
        for batch in batches:
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                n = 1 + (text.count(" ") if text else 0)
                if texts and words + n > RUN:
                    yield run(u, number, ids, texts)
                    number, ids, texts, words = number + 1, [], [], 0
                ids.append(i), texts.append(text)
                words += n
        if texts:
            yield run(u, number, ids, texts)

    return spill


def spilled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file_a: str = FILE_A, file_b: str = FILE_B) -> DataFrame:
    """The runs of all documents, stored: documents' rows have radix -1, the others hold a radix of a run."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    from pyspark.sql.pandas.types import to_arrow_type

    radices = min(1 << 13, max(16, rows.rdd.getNumPartitions()))
    schema = f"run long, radix int, pos int, id {kind.simpleString()}, n_a long, n_b long, n_groups long, sha string, heads binary, sums binary, lens binary, docs binary, times binary"
    return stored(rows.mapInArrow(_spill(to_arrow_type(kind), file_a, file_b, radices), schema))


def merged(heads: list[np.ndarray], sums: list[np.ndarray], size_a: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, int, int]], np.ndarray]]:
    """A k-way merge of sorted heads by side: (pairs, counts, is highest of its side, slices of runs, where each head of these is).

    The heap holds the next side of each run; heads of whole sides are summed together.
    """
    sides = [h // size_a for h in heads]
    starts = [np.append(np.flatnonzero(np.diff(s, prepend=-1)), len(s)).tolist() for s in sides]
    heap = [(int(s[0]), r, 0) for r, s in enumerate(sides) if len(s)]
    heapq.heapify(heap)
    taken: dict[int, list[int]] = {}
    held = 0

    def flush():
        slices = [(r, a, b) for r, (a, b) in taken.items()]
        pairs, at = np.unique(np.concatenate([heads[r][a:b] for r, a, b in slices]), return_inverse=True)
        counts = np.zeros(len(pairs), np.int64)
        np.add.at(counts, at, np.concatenate([sums[r][a:b] for r, a, b in slices]))
        side = pairs // size_a
        first = np.flatnonzero(np.diff(side, prepend=-1))
        top = np.repeat(np.maximum.reduceat(counts, first), np.diff(np.append(first, len(side))))
        return pairs, counts, counts == top, slices, at

    last = -1
    while heap:
        side, r, k = heap[0]
        if side != last and held >= FLUSH:
            yield flush()
            taken, held = {}, 0
        last, a, b = side, starts[r][k], starts[r][k + 1]
        taken.setdefault(r, [a, b])[1] = b
        held += b - a
        if k + 2 < len(starts[r]):
            heapq.heapreplace(heap, (int(sides[r][b]), r, k + 1))
        else:
            heapq.heappop(heap)
    if held:
        yield flush()


def _by_radix(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[int], list[np.ndarray], list[np.ndarray]]]:
    """Rows sorted by radix to (radix, runs, heads, sums) of one radix at a time."""
    radix, runs, heads, sums = None, [], [], []
    for batch in batches:
        for row in batch.to_pylist():
            if runs and row["radix"] != radix:
                yield radix, runs, heads, sums
                runs, heads, sums = [], [], []
            radix = row["radix"]
            runs.append(row["run"]), heads.append(np.cumsum(_unpacked(row["heads"]))), sums.append(_unpacked(row["sums"]))
    if runs:
        yield radix, runs, heads, sums


def _heads(runs: DataFrame) -> DataFrame:
    return runs.where("radix >= 0").select("run", "radix", "heads", "sums").repartition("radix").sortWithinPartitions("radix")


def answers(runs: DataFrame, file_a: str = FILE_A, file_b: str = FILE_B) -> DataFrame:
    """(run, radix, counts, best): for each head of a run its pair's count, and whether no pair of its B id has a higher one."""

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_a = units(file_a, file_b).size_a
        for radix, run, heads, sums in _by_radix(batches):
            counts, best = [[] for _ in run], [[] for _ in run]
            for _, n, top, slices, at in merged(heads, sums, size_a):
                from_ = 0
                for r, a, b in slices:
                    mine = at[from_ : from_ + b - a]
                    counts[r].append(n[mine]), best[r].append(top[mine])
                    from_ += b - a
            blobs = [pa.array([_packed(np.concatenate(x)) for x in c], pa.binary()) for c in (counts, best)]
            yield pa.RecordBatch.from_arrays([pa.array(run, pa.int64()), pa.array([radix] * len(run), pa.int32()), *blobs], ["run", "radix", "counts", "best"])

    return _heads(runs).mapInArrow(answer, "run long, radix int, counts binary, best binary")


def pairs(docs: DataFrame, file_a: str = FILE_A, file_b: str = FILE_B, **columns: str) -> DataFrame:
    """(b, a, count, best): every linked pair of token ids, its count in all documents, and whether it is the B id's highest."""

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size_a = units(file_a, file_b).size_a
        for _, _, heads, sums in _by_radix(batches):
            for p, n, top, _, _ in merged(heads, sums, size_a):
                yield pa.RecordBatch.from_arrays([pa.array(p // size_a), pa.array(p % size_a), pa.array(n), pa.array(top)], ["b", "a", "count", "best"])

    return _heads(spilled(docs, file_a=file_a, file_b=file_b, **columns)).mapInArrow(pair, "b long, a long, count long, best boolean")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file_a: str = FILE_A, file_b: str = FILE_B) -> DataFrame:
    """(the id, groups): ids of A and B in each group of a document, as ``a1,a2|b1;a3|b2,b3``."""

    @F.pandas_udf("string")
    def said(texts):
        u = units(file_a, file_b)
        return texts.map(lambda t: u.said(u.encoded([t])[0]) if t else "")

    return docs.select(F.col(id_col), said(F.coalesce(F.col(text_col), F.lit(""))).alias("groups"))


def _told(names: list[str], left: pa.Table, right: pa.Table) -> pa.Table:
    """A run and what the merges say of its heads, to its documents with their sums."""
    radix = left.column("radix").to_numpy()
    docs = left.filter(pa.array(radix < 0)).sort_by("pos")
    n_best, total = np.zeros(docs.num_rows, np.int64), np.zeros(docs.num_rows, np.int64)
    said = {r["radix"]: r for r in right.to_pylist()}
    for row in left.filter(pa.array(radix >= 0)).select(["radix", "lens", "docs", "times"]).to_pylist():
        lens, step, times = (_unpacked(row[k]) for k in ("lens", "docs", "times"))
        # Steps run on over the body; each head's documents begin at zero again.
        run = np.cumsum(step)
        first = np.cumsum(lens) - lens
        doc = run - np.repeat(run[first] - step[first], lens)
        counts, best = (np.repeat(_unpacked(said[row["radix"]][k]), lens) for k in ("counts", "best"))
        np.add.at(n_best, doc, times * best)
        np.add.at(total, doc, times * counts)
    columns = [*(docs.column(k) for k in ("id", "n_a", "n_b", "n_groups")), docs.column("n_groups"), pa.array(n_best), pa.array(total), docs.column("sha")]
    return pa.Table.from_arrays(columns, names)


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", file_a: str = FILE_A, file_b: str = FILE_B) -> DataFrame:
    """One row per input row: the id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    No token is empty, so one token of each side ends where a group ends: links are as many as groups.
    """
    runs = spilled(docs, id_col, text_col, file_a, file_b)
    kind = runs.schema["id"].dataType.simpleString()
    bodies = runs.select("run", "radix", "pos", "id", "n_a", "n_b", "n_groups", "sha", "lens", "docs", "times")
    names = ["_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    schema = f"_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    told = bodies.groupBy("run").cogroup(answers(runs, file_a, file_b).groupBy("run")).applyInArrow(partial(_told, names), schema)
    return told.withColumnRenamed("_id", id_col)
