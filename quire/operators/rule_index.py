"""Blocks against a table of literal rules, however many there are (F-1).

Each task gets the different literals once, as a trie whose edges are words of eight
bytes, and looks up many places of its texts together. Keys of the literals leave the
task with the blocks that hold them, and Spark joins the rules of each key, so that what
a text takes grows with its length; only the rows of the result grow with rules times
texts. These are not shuffled, and texts are dealt so that a task makes no more of them for more rules.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quire.functions import text as T
from quire.sources.lineage import stored

KINDS = ("textContains", "startsWith", "textEquals")
MOST_RULES, MOST_CHARS = 1 << 20, 1 << 25  # rules, and characters of them, that one scan of the blocks takes along
PAIRS = 1 << 35  # rules times blocks that one task takes on
MOST_BYTES, MOST_KEYS = 1 << 22, 1 << 20  # bytes of the texts that are looked up together, and keys that leave together; a text with more is alone
MOST_ROWS = 1 << 15  # rows of the result that come of one row of a task and one of the rules
PLACES = 1 << 17  # places that are looked up together
_MASK = np.array([0xFFFFFFFFFFFFFFFF, *((1 << 8 * t) - 1 for t in range(1, 9))], "<u8")
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each string begins and the last one ends, and the bytes of all, with a word of zeros behind them."""
    strings = strings.cast(pa.large_binary())
    at = np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]
    data = np.zeros(at[-1] - at[0] + 8, np.uint8)
    if len(data) > 8:
        data[:-8] = np.frombuffer(strings.buffers()[2], np.uint8)[at[0] : at[-1]]
    return at - at[0], data


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))


class Table:
    """Values by words, and by the nodes from which they lead, if there are several."""

    def __init__(self, word: np.ndarray, node: np.ndarray | None, value: np.ndarray):
        bits = max(8, (4 * len(word)).bit_length())
        self.shift = np.uint64(64 - bits)
        slot = self.slot(word, node)
        order = np.argsort(slot, kind="stable")
        self.word, self.node, self.value = word[order], None if node is None else node[order], value[order].astype(np.int32)
        n = np.bincount(slot.astype(np.int64), minlength=1 << bits)
        self.start, self.some = np.concatenate([[0], np.cumsum(n)]).astype(np.int32), n > 0

    def slot(self, word: np.ndarray, node: np.ndarray | None) -> np.ndarray:
        return ((word if node is None else word ^ (node.view("<u8") * _MIX[1])) * _MIX[0]) >> self.shift

    def find(self, word: np.ndarray, node: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words have a value, and the values."""
        slot = self.slot(word, node)
        live = np.flatnonzero(self.some[slot])
        slot, which, value = slot[live], [], []
        at, end = self.start[slot], self.start[slot + np.uint64(1)]
        while len(live):
            same = self.word[at] == word[live]
            if node is not None:
                same &= self.node[at] == node[live]
            which.append(live[same])
            value.append(self.value[at[same]])
            at += 1
            on = ~same & (at < end)
            live, at, end = live[on], at[on], end[on]
        return (np.concatenate(which), np.concatenate(value)) if which else (np.zeros(0, np.int64), np.zeros(0, np.int32))


class Trie:
    """Literals, none empty, by the words that they are made of: at each level, tables of the t bytes that remain of one, and of the eight that lead on."""

    def __init__(self, of: np.ndarray, at: np.ndarray, words: np.ndarray, length: np.ndarray):
        """of: their numbers; at and length: where each of all literals begins in words, and how long it is."""
        self.levels, node, self.shortest = [], None, int(min(8, length[of].min())) if len(of) else 0
        self.first = Table(first := np.unique(words[at[of]] & _MASK[self.shortest]), None, first) if len(of) else None
        while len(of):
            left, word = length[of] - 8 * len(self.levels), words[at[of] + 8 * len(self.levels)]
            tails, pick = [], lambda x, rows: None if x is None else x[rows]
            for t in np.unique(left[left <= 8]).tolist():
                rows = left == t
                tails.append((t, Table(word[rows] & _MASK[t], pick(node, rows), of[rows])))
            on = left > 8
            both = word[on][None] if node is None else np.stack([word[on], node[on].view("<u8")])
            edges, to = np.unique(both, axis=1, return_inverse=True)
            more = Table(edges[0], None if node is None else edges[1].view(np.int64), np.arange(edges.shape[1])) if on.any() else None
            self.levels.append((tails, more))
            of, node = of[on], to.reshape(-1).astype(np.int64)

    def walk(self, words: np.ndarray, place: np.ndarray, node: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places, literals) that begin at one of the places, if the bytes on hand go on so far."""
        for level, (tails, more) in enumerate(self.levels):
            word = words[np.minimum(place + 8 * level, len(words) - 1)]
            for t, table in tails:
                which, literal = table.find(word & _MASK[t], node)
                yield place[which], literal
            if more is not None:
                which, to = more.find(word, node)
                place, node = place[which], to.astype(np.int64)


class Index:
    """Literals by their kinds."""

    def __init__(self, kinds: np.ndarray, literals: pa.Array):
        """kinds: places in KINDS. Literals of a kind must differ."""
        at, data = _bytes(literals)
        words, self.lengths = _words(data), np.diff(at)
        self.empty = [np.flatnonzero((self.lengths == 0) & (kinds == k)) for k in range(len(KINDS))]
        self.tries = [Trie(np.flatnonzero((self.lengths > 0) & (kinds == k)), at, words, self.lengths) for k in range(len(KINDS))]

    def hits(self, at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, literals) that take them, in any order and as often as they are found."""
        words, n, size = _words(data), len(at) - 1, np.diff(at)
        text = np.repeat(np.arange(n, dtype=np.int32), size)
        rows, found = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
        anywhere, begins, whole = self.tries

        def add(place: np.ndarray, literal: np.ndarray, all_of_it: bool = False) -> None:
            of = text[place]
            end, last = place + self.lengths[literal], at[of + 1]
            fits = end == last if all_of_it else end <= last
            rows.append(of[fits])
            found.append(literal[fits])

        for a in range(0, len(text) if anywhere.levels else 0, PLACES):
            word = words[a : min(a + PLACES, len(text))] & _MASK[anywhere.shortest]
            for x in anywhere.walk(words, a + np.flatnonzero(anywhere.first.some[anywhere.first.slot(word, None)])):
                add(*x)
        for x in begins.walk(words, at[:-1][size > 0]):
            add(*x)
        for x in whole.walk(words, at[:-1][size > 0]):
            add(*x, all_of_it=True)
        for k, of in enumerate(self.empty):
            taken = np.flatnonzero(size == 0) if KINDS[k] == "textEquals" else np.arange(n)
            rows.append(np.repeat(taken, len(of)))
            found.append(np.tile(of, len(taken)))
        return np.concatenate(rows), np.concatenate(found)


class Keys:
    """Literals, and the keys that they stand for: one for the rules that have no other literal, and one for each rule that has."""

    def __init__(self, rules: pa.Table):
        """rules: rule, kind, literal; rows must differ."""
        name, rule = rules["rule"].combine_chunks(), rules["rule"].combine_chunks().dictionary_encode().indices.to_numpy()
        said = pc.binary_join_element_wise(rules["kind"], rules["literal"], " ").combine_chunks().dictionary_encode()
        parts, literal, self.n = pc.split_pattern(said.dictionary, " ", max_splits=1), said.indices.to_numpy().astype(np.int64), len(said.dictionary)
        self.index = Index(pc.index_in(parts.values[::2], pa.array(KINDS)).to_numpy(), parts.values[1::2])
        key = np.where(np.bincount(rule)[rule] > 1, self.n + rule, literal) if len(rule) else literal
        pairs = np.unique(literal << 32 | key)
        self.key, self.first = (pairs & 0xFFFFFFFF).astype(np.int32), np.searchsorted(pairs, np.arange(self.n + 1) << 32)
        _, once = np.unique(key << 32 | rule, return_index=True)
        key = key[once]
        self.rules_of = np.bincount(key)
        at = _cuts(key, MOST_ROWS)
        self.rules = pa.table({"key": pa.array(key[at].astype(np.int32)), "rules": _lists(at, name.take(pa.array(once)))})

    def of(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(keys, where their texts begin, texts by key): each text once for a key, and no more texts for one than make MOST_ROWS with its rules."""
        row, literal = self.index.hits(*_bytes(texts))
        pairs = np.sort(row.astype(np.int64) << 32 | literal)
        pairs = pairs[np.diff(pairs, prepend=-1) > 0]
        literal, at = pairs & 0xFFFFFFFF, np.searchsorted(pairs, np.arange(len(texts) + 1) << 32)
        n = self.first[literal + 1] - self.first[literal]
        ends = np.concatenate([[0], np.cumsum(n)])
        for a, b in _slices(ends[at], MOST_KEYS):
            some, m = slice(at[a], at[b]), n[at[a] : at[b]]
            which = np.repeat(self.first[literal[some]] - ends[some], m) + np.arange(ends[at[a]], ends[at[b]])
            keys = np.sort(self.key[which].astype(np.int64) << 32 | np.repeat(pairs[some] >> 32, m))
            keys = keys[np.diff(keys, prepend=-1) > 0]  # a rule may be found by several of its literals
            key = keys >> 32
            begin = _cuts(key, np.maximum(1, MOST_ROWS // self.rules_of[key]))
            yield key[begin], begin, keys & 0xFFFFFFFF


def _cuts(key: np.ndarray, most: int | np.ndarray) -> np.ndarray:
    """Where sorted keys change, and where one goes on for so many."""
    begin = np.flatnonzero(np.diff(key, prepend=-1))
    place = np.arange(len(key)) - np.repeat(begin, np.diff(begin, append=len(key)))
    return np.flatnonzero(place % most == 0)


def _lists(begin: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.append(begin, len(values)).astype(np.int32), values)


def _slices(ends: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Stretches of rows that hold no more than so much, or are one row. ends: where each row begins and the last one ends."""
    a = 0
    while a < len(ends) - 1:
        b = max(a + 1, int(np.searchsorted(ends, ends[a] + most, "right")) - 1)
        yield a, b
        a = b


def match_rule_table(blocks: DataFrame, rules: DataFrame, text_col: str = "text", rule_col: str = "rule", most_rules: int = MOST_RULES, most_chars: int = MOST_CHARS) -> DataFrame:
    """(doc_id, idx, rule): a row for each rule that takes a block, by its text with white space collapsed.

    rules: rule_col, kind (textContains, textEquals or startsWith), literal; other kinds
    and null literals take nothing. More rules than the bounds are taken along in several scans.
    """
    own = stored(rules.where(F.col("kind").isin(*KINDS) & F.col("literal").isNotNull() & F.col(rule_col).isNotNull()).select(F.col(rule_col).alias("rule"), "kind", "literal").distinct())
    n, chars = own.agg(F.count("*"), F.coalesce(F.sum(F.length("literal")), F.lit(0))).first()
    parts = max(1, math.ceil(n / most_rules), math.ceil(chars / most_chars))
    types = dict(blocks.dtypes)
    schema = f"key int, docs array<{types['doc_id']}>, idxs array<{types['idx']}>"
    spark, out = blocks.sparkSession, None
    cores = spark.sparkContext.defaultParallelism
    tasks = cores * max(1, math.ceil(blocks.count() * n / parts / PAIRS / cores))
    rows = blocks.select("doc_id", "idx", T.collapsed(F.coalesce(F.col(text_col), F.lit(""))).alias("text")).repartition(tasks, "doc_id", "idx")
    for k in range(parts):
        keys = Keys(own.where(F.pmod(F.xxhash64("rule"), F.lit(parts)) == k).toArrow())
        of_key = spark.createDataFrame(keys.rules, S.StructType([S.StructField("key", S.IntegerType()), S.StructField("rules", S.ArrayType(own.schema["rule"].dataType))]))
        del keys.rules
        shared = spark.sparkContext.broadcast(keys)

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sizes = pc.binary_length(batch.column("text")).to_numpy()
                for a, b in _slices(np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]), MOST_BYTES):
                    for key, begin, of in shared.value.of(batch.column("text").slice(a, b - a)):
                        at = pa.array(a + of)
                        yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), *(_lists(begin, batch.column(x).take(at)) for x in ("doc_id", "idx"))], ["key", "docs", "idxs"])

        found = rows.mapInArrow(match, schema).join(F.broadcast(of_key), "key").select("docs", "idxs", F.explode("rules").alias("rule"))
        more = found.select("idxs", "rule", F.posexplode("docs").alias("at", "doc_id")).select("doc_id", F.get("idxs", "at").alias("idx"), "rule")
        out = more if out is None else out.unionAll(more)
    return out  # all literals of a rule are in one part, so no hit comes twice, and hits, which may be many, are not shuffled
