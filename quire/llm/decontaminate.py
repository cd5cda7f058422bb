"""Benchmark decontamination by CGK embedding and bit-sampling LSH over windows of the items.

Texts and items are compared as lower-case words joined by one space. The CGK walk
reads a string with a pointer: at step j it outputs a value of the character under the
pointer and moves on by a random bit that depends on j and the character. Two strings
at a small edit distance fall into step again after each edit, so their outputs are at
a small Hamming distance. Every word of a text, and every word of an item, begins a
window, so that windows lie along the whole item. Each walk is sampled twice at
``SAMPLED`` steps; a window of the text and one of an item with an equal sample are a
candidate. As many samples are taken as the target recall asks for at the largest edit
rate. A candidate whose ``LOCAL`` characters around the window are near enough (bit
vectors, for all candidates at once) goes on to the exact edit distance between the
whole item and the best passage around it.

In scripts that don't part words by spaces (Chinese, Japanese, Thai and others) every
character begins a window, in texts and in items.

A match is a passage whose edit distance to the item is at most ``max_edits`` of the
item's length. Items of fewer than ``SHORT`` bytes, too short for a window, match
runs of whole words (in scripts without spaces, any run): one with k edits at most is cut into k + 1 pieces, of which a
match holds one unchanged (pigeonholes); pieces are looked up at every byte, and what
is around them is compared exactly.

Edge cases: null and empty texts match nothing, null items and items without a word
are in nothing. Repeated documents and items are each reported, repeated (id, item id)
pairs once a row. Empty tables give an empty result. Ids keep their type. Other columns
are ignored.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quire.llm.common import fresh, slices
from quire.llm.shingles import mix, word_hashes

#: (least characters of an item, steps of a walk, steps in a sample); walks advance by half a step on average.
CLASSES = ((52, 48, 10), (36, 32, 9), (20, 20, 7))
SHORT = CLASSES[-1][0]
HIT = 0.32  # chance that one sample finds an item of eight words with a fifth of its characters edited, as measured
ANCHORS, PART = 1 << 16, 1 << 20
LOCAL, SLACK, NEAR = 48, 14, 0.36  # bytes that the first comparison takes, shifts that it allows, and edits, as a share


def walks_for(recall: float) -> int:
    """Walks, of two samples each, that reach the target recall for short items at the largest edit rate."""
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - HIT) / 2))


def distance(pattern: str, text: str, most: int) -> int:
    """Edit distance of the pattern to the nearest passage of the text, or most + 1 (Myers's bit vectors)."""
    m = len(pattern)
    if pattern in text:
        return 0
    mask, top = defaultdict(int), 1 << (m - 1)
    for i, c in enumerate(pattern):
        mask[c] |= 1 << i
    full = (1 << m) - 1
    pv, mv, score, best = full, 0, m, m
    for c in text:
        eq = mask.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += bool(ph & top) - bool(mh & top)
        best = min(best, score)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
    return min(best, most + 1)


def nearest_passages(patterns: np.ndarray, lengths: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Row by row, the edit distance of the pattern (its first ``length`` bytes, 64 at most) to the nearest passage of the text (Myers's bit vectors, a column at a time)."""
    n, one = len(patterns), np.uint64(1)
    masks = np.zeros((n, 256), np.uint64)
    rows = np.arange(n)
    for i in range(patterns.shape[1]):
        masks[rows, patterns[:, i]] |= np.where(i < lengths, one << np.uint64(i), np.uint64(0))
    top = (lengths - 1).astype(np.uint64)
    pv, mv = np.full(n, ~np.uint64(0)), np.zeros(n, np.uint64)
    score = lengths.astype(np.int64)
    best = score.copy()
    for j in range(texts.shape[1]):
        eq = masks[rows, texts[:, j]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        score += ((ph >> top) & one).astype(np.int64) - ((mh >> top) & one).astype(np.int64)
        np.minimum(best, score, out=best)
        ph, mh = ph << one, mh << one
        pv, mv = mh | ~(xv | ph), ph & xv
    return best


@dataclass
class Items:
    """Items of one block, ready for look-up: ids, texts, their bytes and windows, and the keys of each walk and sample."""

    ids: list
    texts: list[str]
    data: np.ndarray  # bytes of all items, with room between them
    base: np.ndarray  # by item, where it begins in data
    size: np.ndarray  # by item, its bytes
    owner: np.ndarray  # by window, its item
    offset: np.ndarray  # by window, the bytes of the item before it
    walks: list[tuple[int, np.ndarray, list[np.ndarray]]]  # (class, values by step and byte, sampled steps)
    keys: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]]  # by walk and sample: (filter, sorted keys, windows)
    exact: dict[int, tuple[np.ndarray, np.ndarray]]  # by number of words: (sorted hashes, items) of short items
    pieces: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]  # by length: (sorted pieces of short items, items, bytes before)


def _normal(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts as lower-case words with one space behind each; by word: text, hash and first byte."""
    owner, h, first, last = word_hashes(texts)
    data = np.frombuffer(b" ".join([*(t.lower().encode("utf-8", "surrogatepass") for t in texts), b""]), np.uint8)
    long = last - first + 1
    start = np.cumsum(long) - long
    out = np.full(int(long.sum()), 32, np.uint8)
    mark = np.zeros(len(data) + 1, np.int8)
    mark[first] += 1
    mark[last] -= 1
    inside = np.cumsum(mark[:-1], dtype=np.int8) > 0
    there = np.ones(len(out), bool)
    there[start + long - 1] = False
    out[there] = data[inside]
    return out, owner, h, start


def _characters(data: np.ndarray) -> np.ndarray:
    """Where characters begin that stand without spaces between words: Thai and Lao, Burmese, Khmer, kana and ideographs (by their UTF-8)."""
    after = np.append(data[1:], 0)
    south = ((data == 0xE0) & (after >= 0xB8) & (after <= 0xBB)) | ((data == 0xE1) & (((after >= 0x80) & (after <= 0x82)) | (after == 0x9E) | (after == 0x9F)))
    return np.flatnonzero(south | ((data >= 0xE3) & (data <= 0xE9)) | ((data == 0xF0) & (after >= 0xA0) & (after <= 0xB3)))


def _cuts(size: int, most: int) -> list[tuple[int, int]]:
    """A short item's pieces, as (start, end), one more than its edits."""
    edges = [size * i // (most + 1) for i in range(most + 2)]
    return list(zip(edges, edges[1:]))  # noqa: B905


def _number(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes (8 at most) from each place, as one number."""
    out = np.zeros(max(0, len(data) - n + 1), np.uint64)
    for j in range(n):
        out = out << np.uint64(8) | data[j : j + len(out)].astype(np.uint64)
    return out


def _run_distance(item: str, words: list[str], most: int) -> tuple[int, int]:
    """The least edit distance of an item to a run of whole words, or most + 1, and the run's first word."""
    best = (most + 1, 0)
    for first in range(len(words)):
        row = list(range(len(item) + 1))
        for c in " ".join(words[first:]) + " ":
            if c == " " and row[-1] < best[0]:
                best = (row[-1], first)
            before, row = row, [row[0] + 1]
            for i, x in enumerate(item):
                row.append(min(before[i] + (x != c), before[i + 1] + 1, row[i] + 1))
            if min(row) > most:
                break
    return best


def _sampled(data: np.ndarray, starts: np.ndarray, values: np.ndarray, samples: list[np.ndarray]) -> list[np.ndarray]:
    """The key of each sample of one walk, for the windows that begin at ``starts``; data are bytes as indices."""
    wanted = [[k for k, steps in enumerate(samples) if j in steps] for j in range(len(values))]
    keys = [np.zeros(len(starts), np.uint32) for _ in samples]
    at, c = starts.astype(np.int64), np.empty(len(starts), np.int64)
    g, step = np.empty(len(starts), np.uint32), np.empty(len(starts), np.int64)
    moves = (values & np.uint32(1)).astype(np.int64)
    for j in range(max(int(x.max()) for x in samples) + 1):
        np.take(data, at, out=c, mode="clip")
        if wanted[j]:
            np.take(values[j], c, out=g, mode="clip")
            for k in wanted[j]:
                np.add(keys[k], g, out=keys[k])
        np.take(moves[j], c, out=step, mode="clip")
        np.add(at, step, out=at)
    for key in keys:
        key ^= key >> np.uint32(15)
        key *= np.uint32(0x85EBCA6B)
    return keys


def _padded(data: np.ndarray) -> np.ndarray:
    return np.concatenate([data, np.full(max(steps for _, steps, _ in CLASSES) + LOCAL + 2 * SLACK, 32, np.uint8)])


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the runs of n words that begin at each word."""
    out = np.zeros(max(0, len(h) - n + 1), np.uint64)
    for j in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + len(out)])
    return out


def prepare(rows: list[tuple], walks: int, max_edits: float = 0.2) -> Items | None:
    """Items from (id, text) rows; None if none has a word."""
    rows = [(i, t) for i, t in rows if t]
    data, owner, h, start = _normal([t for _, t in rows]) if rows else (None, np.zeros(0, np.int64), None, None)
    if not len(owner):
        return None
    begin = np.searchsorted(owner, np.arange(len(rows) + 1))
    edge = np.append(start, len(data))
    keep = [k for k in range(len(rows)) if begin[k + 1] > begin[k]]
    raw = [data[edge[begin[k]] : edge[begin[k + 1]] - 1] for k in keep]
    texts = [x.tobytes().decode("utf-8", "replace") for x in raw]
    kind = [next((c for c, (least, _, _) in enumerate(CLASSES) if len(x) >= least), len(CLASSES)) for x in raw]
    between = np.full(max(steps for _, steps, _ in CLASSES), 32, np.uint8)
    base = np.cumsum([0, *(len(x) + len(between) for x in raw)])[:-1]
    joined = _padded(np.concatenate([y for x in raw for y in (x, between)]))
    windows: list[tuple[int, int]] = []
    exact: dict[int, list[tuple[int, int]]] = defaultdict(list)
    pieces: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    for k, i in enumerate(keep):
        words = start[begin[i] : begin[i + 1]] - start[begin[i]]
        if kind[k] == len(CLASSES):
            exact[len(words)].append((int(_runs(h[begin[i] : begin[i + 1]], len(words))[0]), k))
            most = int(max_edits * len(texts[k]))
            if most or len(_characters(raw[k])):
                for a, b in _cuts(len(raw[k]), most):
                    for n in range(a, b, 8):
                        e = min(b, n + 8)
                        if n == a:  # of a longer piece its first eight bytes are enough
                            pieces[e - n].append((int(_number(raw[k][n:e], e - n)[0]), k, n))
        else:
            room = len(raw[k]) - CLASSES[kind[k]][1] * 0.5
            windows += [(k, int(x)) for x in np.union1d(words, _characters(raw[k])) if x <= max(0, room)]
    of, offset = np.array(windows, np.int64).reshape(-1, 2).T
    index, kinds = joined.astype(np.int64), np.array(kind)[of]
    plan, keys = [], []
    for c in sorted(set(kinds.tolist())):
        mine = np.flatnonzero(kinds == c)
        for w in range(walks):
            draw = np.random.default_rng([17, c, w])
            _, steps, size = CLASSES[c]
            values = draw.integers(0, 1 << 32, (steps, 256), dtype=np.uint64).astype(np.uint32)
            samples = [np.sort(draw.choice(steps, size, replace=False)) for _ in range(2)]
            plan.append((c, values, samples))
            tables = []
            for key in _sampled(index, base[of[mine]] + offset[mine], values, samples):
                order, bits = np.argsort(key, kind="stable"), min(24, max(16, (16 * len(mine)).bit_length()))
                seen = np.zeros(1 << bits, bool)
                seen[key >> np.uint32(32 - bits)] = True
                tables.append((seen, key[order], mine[order]))
            keys.append(tables)
    short = {n: tuple(np.array(x, kind) for x, kind in zip(zip(*sorted(v)), (np.uint64, np.int64), strict=True)) for n, v in exact.items()}
    cut = {n: tuple(np.array(x, kind) for x, kind in zip(zip(*sorted(v)), (np.uint64, np.int64, np.int64), strict=True)) for n, v in pieces.items()}
    return Items([rows[i][0] for i in keep], texts, joined, base, np.array([len(x) for x in raw]), of, offset, plan, keys, short, cut)


def _short_matches(items: Items, data: np.ndarray, owner: np.ndarray, start: np.ndarray, max_edits: float) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, edit distance, word) of edited short items, from each place where a piece of one stands."""
    padded = _padded(data)
    loose = {i for i in np.unique(np.concatenate([np.zeros(0, np.int64), *(of for _, of, _ in items.pieces.values())])).tolist() if len(_characters(items.data[items.base[i] : items.base[i] + items.size[i]]))}
    for n, (known, item, before) in items.pieces.items():
        number = _number(data, n)
        first = np.unique(known)
        seen = np.zeros(1 << 16, bool)
        mark = lambda x: (x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
        seen[mark(first)] = True
        hit = np.flatnonzero(seen[mark(number)])
        row, at = _joined(number[hit], known, np.arange(len(known)))
        p, k, o = hit[row], item[at], before[at]
        near = np.zeros(len(p), bool)
        most = np.array([int(max_edits * len(t)) for t in items.texts], np.int64)[k] if len(k) else k
        for a in range(0, len(p), 1 << 14):
            x, i = p[a : a + (1 << 14)] - o[a : a + (1 << 14)], k[a : a + (1 << 14)]
            pattern = items.data[items.base[i][:, None] + np.arange(SHORT)]
            place = x[:, None] + np.arange(-8, SHORT + 8)
            text = np.where(place >= 0, padded[np.clip(place, 0, len(padded) - 1)], 0)
            # Bytes differ more than characters, which have four at most.
            near[a : a + (1 << 14)] = nearest_passages(pattern, items.size[i], text) <= 4 * most[a : a + (1 << 14)]
        for q, i, m in np.unique(np.stack([p - o, k, most], axis=1)[near], axis=0).tolist():
            low = max(0, int(np.searchsorted(start, q - 4 * m, "left")) - 1)
            high = int(np.searchsorted(start, q + int(items.size[i]) + 4 * m, "right"))
            mid = min(max(int(np.searchsorted(start, q, "right")) - 1, 0), len(start) - 1)
            for doc in {int(owner[mid]), int(owner[min(mid + 1, len(start) - 1)])}:  # an item may lie at the border of two texts
                own = [w for w in range(low, high) if owner[w] == doc]
                if not own:
                    continue
                if i in loose:
                    begin, end = int(start[own[0]]), int(start[own[-1] + 1]) if own[-1] + 1 < len(start) else len(data)
                    d = distance(items.texts[i], data[max(begin, q - 4 * m) : min(end, q + int(items.size[i]) + 4 * m)].tobytes().decode("utf-8", "ignore"), m)
                    if d <= m:
                        yield doc, i, d, max(own[0], int(np.searchsorted(start, q, "right")) - 1)
                    continue
                stop = int(start[own[-1] + 1]) if own[-1] + 1 < len(start) else len(data)
                words = data[start[own[0]] : stop - 1].tobytes().decode("utf-8", "replace").split(" ")
                d, w = _run_distance(items.texts[i], words, m) if len(data[start[own[0]] : stop]) < 8 * SHORT + 64 else _run_distance(items.texts[i], [x for x in words if len(x) < 2 * SHORT], m)
                if d <= m:
                    yield doc, i, d, own[0] + w


def _joined(keys: np.ndarray, known: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, of) pairs of the keys that are known, with all places where they are."""
    low, high = np.searchsorted(known, keys, "left"), np.searchsorted(known, keys, "right")
    n = high - low
    row = np.repeat(np.arange(len(keys)), n)
    return row, of[low[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)]


def _candidates(items: Items, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (first byte, window of an item) pairs of windows with an equal sample, whose surroundings are near."""
    data, found = _padded(data), [np.zeros(0, np.int64)]
    index = data.astype(np.int64)
    for a in range(0, len(starts), ANCHORS):
        at = starts[a : a + ANCHORS]
        for (_, values, samples), tables in zip(items.walks, items.keys, strict=True):
            for key, (seen, known, of) in zip(_sampled(index, at, values, samples), tables, strict=True):
                hit = np.flatnonzero(np.take(seen, key >> np.uint32(33 - len(seen).bit_length()), mode="clip"))
                row, window = _joined(key[hit], known, of)
                found.append((at[hit[row]] << 32) | window)
    pairs = np.unique(np.concatenate(found))
    p, window = pairs >> 32, pairs & 0xFFFFFFFF
    near = np.zeros(len(p), bool)
    for a in range(0, len(p), 1 << 12):
        x, w = p[a : a + (1 << 12)], window[a : a + (1 << 12)]
        item, offset = items.owner[w], items.offset[w]
        length = np.minimum(LOCAL, items.size[item])
        begin = np.minimum(offset, items.size[item] - length)  # the compared part stays within the item
        pattern = items.data[(items.base[item] + begin)[:, None] + np.arange(LOCAL)]
        text = (x - offset + begin)[:, None] + np.arange(-SLACK, LOCAL + SLACK)
        text = np.where(text >= 0, data[np.minimum(text, len(data) - 1)], 0)
        near[a : a + (1 << 12)] = nearest_passages(pattern, length, text) <= NEAR * length
    return p[near], window[near]


def matches(items: Items, texts: list[str | None], max_edits: float) -> Iterator[tuple[int, int, int, int]]:
    """(text, item, first word, edit distance): the best match of each text and item; of edited ones, the word where the item would begin by its window."""
    texts = [t or "" for t in texts]
    for a, b in slices([len(t) for t in texts], PART):
        data, owner, h, start = _normal(texts[a:b])
        if not len(owner):
            continue
        bounds = np.searchsorted(owner, np.arange(b - a + 1))
        edge = np.append(start, len(data))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for n, (known, of) in items.exact.items():
            at, item = _joined(_runs(h, n), known, of)
            for w, k in zip(at.tolist(), item.tolist(), strict=True):
                if owner[w] == owner[w + n - 1]:
                    best.setdefault((int(owner[w]), k), (0, int(w - bounds[owner[w]])))
        for doc, item, d, w in _short_matches(items, data, owner, start, max_edits):
            if d < best.get((doc, item), (d + 1,))[0]:
                best[doc, item] = (d, int(w - bounds[doc]))
        checked: dict[tuple[int, int], int] = {}
        begin = np.union1d(start, _characters(data))
        p, window = _candidates(items, data, begin) if items.walks else (start[:0], start[:0])
        docs = owner[np.searchsorted(start, p, "right") - 1]
        begins = p - items.offset[window]  # where the item begins if nothing before the window is edited
        for k in np.argsort(begins, kind="stable").tolist():
            doc, item, q = int(docs[k]), int(items.owner[window[k]]), int(begins[k])
            most, size = int(max_edits * len(items.texts[item])), int(items.size[item])
            reach = int(max_edits * size)
            # What is compared reaches twice the edits beyond, so it holds all that begins up to ``reach`` later.
            if best.get((doc, item), (1,))[0] == 0 or ((doc, item) in checked and q - checked[doc, item] <= reach):
                continue
            checked[doc, item] = q
            low = max(int(edge[bounds[doc]]), int(begin[max(0, int(np.searchsorted(begin, q - 2 * reach, "right")) - 1)]))
            after = int(np.searchsorted(begin, q + size + 2 * reach, "right"))
            high = min(int(edge[bounds[doc + 1]]), int(begin[after]) if after < len(begin) else len(data))
            passage = data[low:high].tobytes().decode("utf-8", "replace").rstrip(" ")
            d = distance(items.texts[item], passage, most)
            if d <= most and d < best.get((doc, item), (most + 1,))[0]:
                word = int(np.searchsorted(start, q, "right")) - 1
                if not d:
                    word = int(np.searchsorted(start, low, "right")) - 1 + passage.count(" ", 0, passage.index(items.texts[item]))
                best[doc, item] = (d, max(0, word - int(bounds[doc])))
        for (doc, item), (d, w) in best.items():
            yield a + doc, item, w, d


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, walks: int, max_edits: float, most_items: int, most_chars: int) -> Iterator[Items]:
    """The items in blocks of a bounded size, each of which one scan takes along; their ids are (id, rows that repeat it)."""
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t IS NOT NULL").groupBy("i", "t").agg(F.count("*").alias("copies"))
    n, chars = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("t")), F.lit(0))).first()
    blocks = max(1, math.ceil(n / most_items), math.ceil(chars / most_chars))
    for k in range(blocks):
        items = prepare([((r.i, r.copies), r.t) for r in rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == k).orderBy("i", "t").collect()], walks, max_edits)
        if items:
            yield items


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_edits: float = 0.2, recall: float = 0.96, most_items: int = 20_000, most_chars: int = 1 << 22
) -> DataFrame:
    """A row for each document row and item that it holds: the id, item_id, first_word, n_edits.

    ``most_items`` and ``most_chars`` bound the items that one scan of the documents
    takes along; larger benchmarks are searched in several scans.
    """
    kind = to_arrow_type(benchmark.schema[item_col].dataType)
    kinds = [docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()]
    schema = f"id {kinds[0]}, item {kinds[1]}, first_word long, n_edits long"
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = docs.sparkSession.createDataFrame([], schema)
    for items in _blocks(benchmark, item_col, item_text_col, walks_for(recall), max_edits, most_items, most_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                found = [m for m in matches(known, batch.column("text").to_pylist(), max_edits) for _ in range(known.ids[m[1]][1])]
                ids = batch.column("id").take(pa.array([t for t, *_ in found], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([known.ids[i][0] for _, i, _, _ in found], kind), pa.array([p for *_, p, _ in found], pa.int64()), pa.array([d for *_, d in found], pa.int64())], ["id", "item", "first_word", "n_edits"])

        out = out.unionAll(rows.mapInArrow(search, schema))
    return out.select(F.col("id").alias(id_col), F.col("item").alias(item_col if item_col != id_col else f"benchmark_{item_col}"), "first_word", "n_edits")


def _holds(shared, max_edits: float):
    @F.pandas_udf("boolean")
    def holds(texts: pd.Series) -> pd.Series:
        hit = np.zeros(len(texts), bool)
        for t, *_ in matches(shared.value, [x if isinstance(x, str) else None for x in texts], max_edits):
            hit[t] = True
        return pd.Series(hit)

    return holds


def keep_clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", max_edits: float = 0.2, recall: float = 0.96, most_items: int = 20_000, most_chars: int = 1 << 22) -> DataFrame:
    """The documents without those that hold an item, judged row by row, with no join."""
    out, name = docs, fresh(docs, "_contaminated")
    for items in _blocks(benchmark, item_col, "text", walks_for(recall), max_edits, most_items, most_chars):
        shared = docs.sparkSession.sparkContext.broadcast(items)
        out = out.withColumn(name, _holds(shared, max_edits)(F.col(text_col))).where(~F.col(name)).select(*docs.columns)
    return out
