"""Collocations of two to four words, counted on a weighted de Bruijn graph of the corpus.

Every word of a piece (a stretch without ``.,;:!?`` or line breaks) begins one gram:
the four words from there, or what is left of the piece. Grams of four words are edges
between overlapping nodes of three words, weighted by their number; shorter ones are
the corrections at the ends of pieces. Chains of frequent edges of one weight through
nodes with one way in and one way out are compacted into paths. All shorter counts
follow from the graph: a phrase occurs as often as edges flow out of its node, and as
pieces end with it; so from four words down to one each level is summed from the one
above, with no further pass over texts.

A pass before bounds what is shuffled: each task counts all grams of one to four words
in 2 ** ``bits`` hashed places (one byte each), whose sums tell, for every gram, that it can't
reach ``least`` occurrences, or that it might. A gram is cut before the word that makes
it rare, as if the piece ended there: it can't be part of a candidate, and all counts of
``least`` or more stay exact. A second pass counts what is left in places of another hash, where rare grams no longer
add to others, and words only where they stand in such a pair: other words are in no candidate, and are counted
together. A full filter (some 10 ** 9 different grams) cuts less, and
the graph gets an edge for each different gram, but results are the same.

A task sends its grams in blocks, one for each language and part of the grams' hashes; a part's blocks are
summed together. A task tells a gram once (and again after each million different ones), so that blocks hold
tasks times grams at most, and never more than one gram a word.

Edge cases: null texts are empty, null languages ``und``, repeated rows count each.
Texts of any length are cut at ends of pieces while they are read. An empty table has
no phrases. Other columns are ignored. Numbers may pass 64 bits in products only, which
are decimals.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.common import Stored, slices, stored
from quire.llm.shingles import mix

LONGEST, LEAST, TOP = 4, 30, 2000
BITS, PART = 27, 1 << 16  # places of the filter; places of one of its rows
CHUNK = 1 << 21
HELD = 1_000_000  # different grams that a task sums before it sends them
PARTS = 1024  # of a language's grams; those of one are summed in memory
PIECE = 1000  # edges of a stored stretch of a path
_ENDS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(bytes(range(65, 91)) + _ENDS + b"\t", bytes(range(97, 123)) + b"." * len(_ENDS) + b" ")
_END = re.compile("[.,;:!?\n-\r]")
_ODD = np.uint64(0x9E3779B97F4A7C15)
_CODEC = pa.Codec("zstd")
_BLOCK = pa.schema({"lang": pa.string(), "part": pa.int32(), "size": pa.int32(), "grams": pa.binary(), "n": pa.binary()})


def _size(bits: np.ndarray) -> int:
    return (8 * len(bits)).bit_length() - 1


def _places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of hashes in the first filter and in the second."""
    return (h >> np.uint64(64 - bits)).astype(np.uint32), (h & np.uint64((1 << bits) - 1)).astype(np.uint32)


def _hits(h: np.ndarray, filters: list[np.ndarray]) -> np.ndarray:
    hit = np.ones(len(h), bool)
    for bits, place in zip(filters, _places(h, _size(filters[0])) if filters else (), strict=False):
        hit &= (bits[place >> 3] >> (7 - (place & 7))) & 1 == 1
    return hit


class Chunk:
    """Words of one language, with the ends of pieces between them: ids of words (0 is an end), and how far each is from the next end."""

    def __init__(self, lang: str, texts: list[str]):
        import xxhash

        self.words = b".".join([*(t.encode("utf-8", "surrogatepass") for t in texts), b""]).translate(_TABLE).replace(b".", b" . ").split()
        known: dict[bytes, int] = {b".": 0}
        for w in self.words:
            if w not in known:
                known[w] = len(known)
        self.lang, self.known = lang, len(known)
        self.ids = np.fromiter(map(known.__getitem__, self.words), np.int64, len(self.words))
        ends = np.flatnonzero(self.ids == 0)
        self.left = ends[np.searchsorted(ends, np.arange(len(self.ids)))] - np.arange(len(self.ids))
        self.hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in known), np.uint64, len(known))
        self.start = np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))

    def begun(self, filters: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each length from one up: the words that begin so long a gram without a part that filters call rare, and its hash."""
        at, shorter = np.flatnonzero(self.left), np.ones(len(self.ids), bool)
        h = np.full(len(at), self.start)
        for k in range(LONGEST):
            more = self.left[at] > k
            more[more] = shorter[at[more] + (k > 0)]
            at, h = at[more], h[more]
            h = mix(h * _ODD + self.hashes[self.ids[at + k]])
            if filters:
                hit = _hits(h, filters)
                at, h = at[hit], h[hit]
                shorter = np.zeros(len(self.ids), bool)
                shorter[at] = True
            yield at, h

    def places(self, bits: int, filters: list[np.ndarray]) -> Iterator[np.ndarray]:
        """The places of all grams in the first filter; after it, in the second: of those that it leaves, and of words within its pairs."""
        if not filters:
            for _, h in self.begun([]):
                yield _places(h, bits)[0]
            return
        (words, of), (pairs, h), *longer = self.begun(filters)
        within = np.zeros(len(self.ids), bool)
        within[pairs] = within[pairs + 1] = True
        for x in (of[within[words]], h, *(x for _, x in longer)):
            yield _places(x, bits)[1]

    def grams(self, filters: list[np.ndarray]) -> Iterator[tuple[bytes, int]]:
        """The longest gram from each word that holds no rare one, and its number; '' for words in no frequent pair."""
        length = np.zeros(len(self.ids), np.int64)
        for k, (at, _) in enumerate(self.begun(filters)):
            length[at] = k + 1
        at = np.flatnonzero(self.left)
        if rare := int((length[at] == 0).sum()):
            yield b"", rare
        at = at[length[at] > 0]
        padded = np.append(self.ids, np.zeros(LONGEST, np.int64))
        columns = [np.where(length[at] > k, padded[at + k], 0) for k in range(LONGEST)]
        if self.known < 1 << 21 and len(at) < 1 << 22:
            _, pair = np.unique(columns[0] << 21 | columns[1], return_inverse=True)
            _, first, times = np.unique(pair << 42 | columns[2] << 21 | columns[3], return_index=True, return_counts=True)
        else:
            _, first, times = np.unique(np.stack(columns, axis=1), axis=0, return_index=True, return_counts=True)
        for p, k, n in zip(at[first].tolist(), length[at[first]].tolist(), times.tolist(), strict=True):
            yield b" ".join(self.words[p : p + k]), n


def _stretches(text: str) -> Iterator[str]:
    """A long text, cut at ends of pieces."""
    a = 0
    while len(text) - a > CHUNK and (end := _END.search(text, a + CHUNK)):
        yield text[a : end.end()]
        a = end.end()
    yield text[a:]


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Chunk]:
    for batch in batches:
        by_lang: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if text:
                by_lang.setdefault(lang, []).extend(_stretches(text))
        for lang, texts in by_lang.items():
            for a, b in slices([len(t) for t in texts], CHUNK):
                yield Chunk(lang, texts[a:b])


def _zipped(sums: np.ndarray) -> bytes:
    return _CODEC.compress(sums.tobytes(), asbytes=True)


def _unzipped(data: bytes, n: int, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(_CODEC.decompress(data, n * kind.itemsize, asbytes=True), kind)


def _tallied(least: int, bits: int, before):
    """Sums of a task in a filter's places, up to ``least``; before: broadcast filters that what is counted has passed."""
    kind, size = np.min_scalar_type(least), min(PART, 1 << bits)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for chunk in _chunks(batches):
            sums = np.zeros(1 << bits, kind) if sums is None else sums
            for place in chunk.places(bits, [x.value for x in before]):
                place, times = np.unique(place, return_counts=True)
                sums[place] = np.minimum(sums[place] + times, least)
        if sums is None:
            return
        for part in range(len(sums) // size):
            own = sums[part * size : (part + 1) * size]
            if own.any():
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([_zipped(own)], pa.binary())], ["part", "sums"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sums = None, None

        def told():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(sums >= least).tobytes()], pa.binary())], ["part", "bits"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    if sums is not None:
                        yield told()
                    part, sums = row["part"], np.zeros(size, np.int64)
                sums += _unzipped(row["sums"], size, kind)
        if sums is not None:
            yield told()

    return tally, total


def maybe_frequent(rows: DataFrame, least: int = LEAST, bits: int = BITS, before=()) -> np.ndarray:
    """A filter's bits (16 MiB, whatever the corpus): whether a place has ``least`` occurrences of grams that pass those before."""
    tally, total = _tallied(least, bits, before)
    parts = rows.mapInArrow(tally, "part int, sums binary").repartition("part").sortWithinPartitions("part").mapInArrow(total, "part int, bits binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in parts.collect():
        own = np.frombuffer(row.bits, np.uint8)
        out[row.part * len(own) : (row.part + 1) * len(own)] = own
    return out


def _blocks(lang: str, grams: Counter) -> Iterator[dict]:
    """A task's grams of a language by part, sorted and packed; words hold no line breaks."""
    import xxhash

    parts: dict[int, list[bytes]] = {}
    for g in grams:
        parts.setdefault(xxhash.xxh3_64_intdigest(g) % PARTS, []).append(g)
    for part, own in parts.items():
        own.sort()
        text = b"\n".join(own)
        yield {"lang": lang, "part": part, "size": len(text), "grams": _CODEC.compress(text, asbytes=True), "n": _zipped(np.array([grams[g] for g in own], np.int64))}


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of blocks that come by language and part."""
    key, sums = None, Counter()

    def told():
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * len(sums), pa.string()), pa.array([g.decode("utf-8", "surrogatepass") for g in sums], pa.string()), pa.array(list(sums.values()), pa.int64())], ["lang", "gram", "n"])

    for batch in batches:
        for block in map(lambda i: {c: batch.column(c)[i].as_py() for c in _BLOCK.names}, range(batch.num_rows)):
            if (block["lang"], block["part"]) != key:
                if key:
                    yield told()
                key, sums = (block["lang"], block["part"]), Counter()
            own = _CODEC.decompress(block["grams"], block["size"], asbytes=True).split(b"\n")
            for g, n in zip(own, _unzipped(block["n"], len(own), np.dtype(np.int64)).tolist(), strict=True):
                sums[g] += n
    if key:
        yield told()


def graph(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, bits: int = BITS) -> DataFrame:
    """(lang, gram, n), stored: edges of four words and, shorter, the corrections at ends; '' counts the words that are in no frequent pair."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    context = rows.sparkSession.sparkContext
    filters = [context.broadcast(maybe_frequent(rows, least, bits))]
    filters.append(context.broadcast(maybe_frequent(rows, least, bits, tuple(filters))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}

        def told():
            for lang, grams in held.items():
                yield pa.RecordBatch.from_pylist(list(_blocks(lang, grams)), _BLOCK)
            held.clear()

        for chunk in _chunks(batches):
            of = held.setdefault(chunk.lang, Counter())
            for gram, n in chunk.grams([x.value for x in filters]):
                of[gram] += n
            if sum(map(len, held.values())) > HELD:
                yield from told()
        yield from told()

    blocks = rows.mapInArrow(count, "lang string, part int, size int, grams binary, n binary").repartition("lang", "part").sortWithinPartitions("lang", "part")
    return stored(blocks.mapInArrow(_summed, "lang string, gram string, n long"))


def _words(c: str) -> Column:
    return F.when(F.col(c) == "", F.array().cast("array<string>")).otherwise(F.split(c, " ", -1))


def _said(words: Column, start: Column | int, n: Column | int) -> Column:
    return F.array_join(F.slice(words, start, n), " ")


def paths(edges: DataFrame) -> DataFrame:
    """(lang, gram, n) edges of four words, stored, to (lang, words, n): compacted unary paths, which hold each edge once.

    An edge leads on to another if the node between has these two alone, of one weight.
    Heads of chains are found by doubling pointers to edges before; edges on a ring stay
    single. A chain of more than 1000 edges is told in stretches of that many.
    """
    words = edges.select("lang", "gram", "n", _said(_words("gram"), 1, 3).alias("source"), _said(_words("gram"), 2, 3).alias("target"))
    into = words.groupBy("lang", F.col("target").alias("node")).agg(F.count("*").alias("ins"), F.min("gram").alias("before"), F.min("n").alias("n"))
    out = words.groupBy(F.col("lang").alias("_l"), F.col("source").alias("_n")).agg(F.count("*").alias("outs"), F.min("gram").alias("gram"), F.min("n").alias("m"))
    links = into.join(out, (F.col("lang") == F.col("_l")) & (F.col("node") == F.col("_n"))).where("ins = 1 AND outs = 1 AND n = m AND before != gram")
    first = Stored(links.select("lang", "gram", F.col("before").alias("head"), F.lit(1).cast("long").alias("at")))
    state, left = first, first.df.count()
    for _ in range(math.ceil(math.log2(left + 1)) + 1 if left else 0):
        far = state.df.select(F.col("lang").alias("_l"), F.col("gram").alias("_g"), F.col("head").alias("_h"), F.col("at").alias("_a"))
        after = Stored(state.df.join(far, (F.col("lang") == F.col("_l")) & (F.col("head") == F.col("_g")), "left").select("lang", "gram", F.coalesce("_h", "head").alias("head"), (F.col("at") + F.coalesce("_a", F.lit(0))).alias("at")))
        moving = after.df.join(first.df.select("lang", F.col("gram").alias("head")), ["lang", "head"], "left_semi").isEmpty()
        if state is not first:
            state.remove()
        state = after
        if moving:
            break
    heads = first.df.select(F.col("lang").alias("_l"), F.col("gram").alias("_g"))
    hung = state.df.join(heads, (F.col("lang") == F.col("_l")) & (F.col("head") == F.col("_g")), "left_anti").select(F.col("lang").alias("_l"), F.col("gram").alias("_g"), "head", "at")
    told = edges.join(hung, (F.col("lang") == F.col("_l")) & (F.col("gram") == F.col("_g")), "left").select("lang", "gram", "n", F.coalesce("head", "gram").alias("head"), F.coalesce("at", F.lit(0)).alias("at"))
    chain = told.groupBy("lang", "head", F.floor(F.col("at") / PIECE).alias("stretch")).agg(F.array_sort(F.collect_list(F.struct("at", "gram"))).alias("edges"), F.min("n").alias("n"))
    begin = F.split(F.col("edges")[0]["gram"], " ", -1)
    return stored(chain.select("lang", F.concat(begin, F.transform(F.slice("edges", 2, PIECE), lambda e: F.element_at(F.split(e["gram"], " ", -1), -1))).alias("words"), "n"))


def counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, bits: int = BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f) of all phrases of two to four words that occur ``least`` times, and of their words; and (lang, n) of all words."""
    grams = graph(docs, lang_col, text_col, least, bits).withColumn("k", F.size(_words("gram")))
    frequent = (F.col("k") == LONGEST) & (F.col("n") >= least)
    ways, rest = paths(grams.where(frequent).select("lang", "gram", "n")), grams.where(~frequent)
    windows = F.transform(F.sequence(F.lit(1), F.size("words") - LONGEST + 1), lambda i: _said(F.col("words"), i, LONGEST))
    level = stored(ways.select("lang", F.explode(windows).alias("phrase"), F.col("n").alias("f")))
    found = [level.withColumn("k", F.lit(LONGEST))]
    for k in range(LONGEST - 1, 0, -1):
        short = lambda c: F.substring_index(c, " ", k)  # noqa: B023, E731
        flow = level.select("lang", short("phrase").alias("phrase"), "f")
        ends = rest.where(F.col("k") >= k if k == LONGEST - 1 else F.col("k") == k).select("lang", short("gram").alias("phrase"), F.col("n").alias("f"))
        level = stored(flow.unionAll(ends).groupBy("lang", "phrase").agg(F.sum("f").alias("f")))
        found.append(level.where(F.col("f") >= least).withColumn("k", F.lit(k)))
    total = level.unionAll(rest.where("k = 0").select("lang", F.col("gram").alias("phrase"), F.col("n").alias("f"))).groupBy("lang").agg(F.sum("f").alias("n"))
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    return stored(every), total


def _exact(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def scored(counted: DataFrame) -> DataFrame:
    """(lang, phrase, k, a, l, r, score): phrases of two words and more with their lowest cut; of cuts that tie, the first."""
    of = counted.where("k > 1").select("lang", "phrase", "k", F.col("f").alias("a"))
    cuts = of.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).withColumn("_w", F.split("phrase", " ", -1))
    cuts = cuts.select("lang", "phrase", "k", "a", "cut", _said(F.col("_w"), 1, F.col("cut")).alias("_first"), _said(F.col("_w"), F.col("cut") + 1, F.col("k")).alias("_rest"))
    for part, name in (("_first", "l"), ("_rest", "r")):
        side = counted.select(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase"), F.col("f").alias(name))
        cuts = cuts.join(side, (F.col("lang") == F.col("_lang")) & (F.col(part) == F.col("_phrase"))).drop("_lang", "_phrase")
    cuts = cuts.withColumns({"_times": _exact(F.lit(2_000_000)) * _exact("a"), "_sides": _exact("l") + _exact("r")}).withColumn("score", F.expr("CAST(_times div _sides AS BIGINT)"))
    least = cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("x"))
    return least.select("lang", "phrase", "k", "a", "x.l", "x.r", "x.score")


def independent(candidates: DataFrame, share: int = 80) -> DataFrame:
    """Candidates that no longer one holds which occurs at ``share`` percent as often."""
    longer = candidates.where("k > 2").withColumn("_w", F.split("phrase", " ", -1)).withColumn("_n", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    inside = F.transform(F.sequence(F.lit(1), F.col("k") - F.col("_n") + 1), lambda i: _said(F.col("_w"), i, F.col("_n")))
    most = longer.select(F.col("lang").alias("_lang"), F.explode(inside).alias("_phrase"), "a").groupBy("_lang", "_phrase").agg(F.max("a").alias("_most"))
    held = (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase"))
    return candidates.join(most, held, "left").where(F.col("_most").isNull() | (F.lit(100) * _exact("_most") < F.lit(share) * _exact("a"))).drop("_lang", "_phrase", "_most")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP, share: int = 80, bits: int = BITS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``top`` phrases, ranked in salted parts first."""
    counted, total = counts(docs, lang_col, text_col, least, bits)
    kept = independent(stored(scored(counted)), share)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    best = kept.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("int"))
    n = total.select(F.col("lang").alias("_lang"), "n")
    return best.where(F.col("rank") <= top).join(n, F.col("lang") == F.col("_lang")).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = """
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
q AS (SELECT row_number() OVER () AS nr, lang, piece FROM p),
u AS (SELECT nr, lang, unnest(list_filter(string_split(replace(piece, chr(9), ' '), ' '), lambda x: x <> '')) AS w FROM q),
v AS (SELECT *, row_number() OVER () AS i FROM u),
g AS (SELECT lang, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c, lead(w, 3) OVER o AS d FROM v WINDOW o AS (PARTITION BY nr ORDER BY i)),
f AS (SELECT lang, 1 AS k, a AS phrase, count(*) AS f FROM g GROUP BY ALL
  UNION ALL SELECT lang, 2, a || ' ' || b, count(*) FROM g WHERE b IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 3, a || ' ' || b || ' ' || c, count(*) FROM g WHERE c IS NOT NULL GROUP BY ALL
  UNION ALL SELECT lang, 4, a || ' ' || b || ' ' || c || ' ' || d, count(*) FROM g WHERE d IS NOT NULL GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND f >= 30),
x AS (SELECT lang, k, phrase, a, unnest(generate_series(1, k - 1)) AS cut, ws FROM c),
s AS (SELECT x.lang, x.k, x.phrase, a, l.f AS l, r.f AS r, CAST(2000000 * a::HUGEINT // (l.f::HUGEINT + r.f) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY x.lang, x.phrase ORDER BY 2000000 * a::HUGEINT // (l.f::HUGEINT + r.f), cut) AS nth
  FROM x JOIN f AS l ON l.lang = x.lang AND l.phrase = array_to_string(ws[1 : cut], ' ') JOIN f AS r ON r.lang = x.lang AND r.phrase = array_to_string(ws[cut + 1 : x.k], ' ')),
h AS (SELECT lang, array_to_string(ws[i : i + m - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT lang, ws, a, m, unnest(generate_series(1, k - m + 1)) AS i FROM (SELECT *, unnest(generate_series(2, k - 1)) AS m FROM c WHERE k > 2)) GROUP BY ALL),
z AS (SELECT s.lang, s.phrase, a, l, r, score, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
  FROM s LEFT JOIN h ON h.lang = s.lang AND h.phrase = s.phrase WHERE nth = 1 AND (most IS NULL OR 100 * most::HUGEINT < 80 * a::HUGEINT))
SELECT z.lang, rank, phrase, a, l, r, n, score FROM z JOIN n ON n.lang = z.lang WHERE rank <= 2000
"""
