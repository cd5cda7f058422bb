"""Language identification by bit-sliced Bloom filters over character n-grams.

One table of slots holds the filters of all languages at once: bit l of a slot is
the slot's bit in language l's filter, so that one lookup and one AND give every
language that contains an n-gram. Per-language popcounts over a text, corrected
for each filter's false-positive rate, decide.

Edge cases: null texts and texts without a letter are ``und`` with score 0; a
text in which no filter knows an n-gram gets the language with the most training
documents, with score 0; with no training rows every text is ``und``. Ties go to
the language with more training documents, then to the smaller name. Repeated
rows are judged each on its own; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fold, fresh, slices, stored

ORDERS = (3, 4)
PAD = "  "
PIECE = 1 << 19
_MUL, _MIX, _SECOND = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))


@dataclass
class Model:
    """Languages, their training documents, filter slots (one array per 64 languages) and fill rates."""

    langs: list[str]
    docs: list[int]
    bits: int
    slots: list[np.ndarray] = field(default_factory=list)
    fill: np.ndarray | None = None


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _grams(pieces: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """For padded pieces: whether each has a letter, and for each order (piece index, hash) of its n-grams.

    N-grams over two neighbouring non-letters don't count, which keeps them within a piece.
    """
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    code = np.frombuffer("".join(pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[code]
    code = np.where(letter, code, 0).astype(np.uint64)
    piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
    has = np.zeros(len(pieces), bool)
    has[piece[letter]] = True
    n = len(code) - 3
    if n <= 0:
        return has, [(piece[:0], code[:0]) for _ in ORDERS]
    gap = ~letter
    pair = gap[:-1] & gap[1:]
    same = piece[:n] == piece[3:]
    bad = pair[:n] | pair[1 : n + 1] | ~same
    h = (code[:n] * _MUL + code[1 : n + 1]) * _MUL + code[2 : n + 2]
    out = []
    for order in ORDERS:
        if order == 4:
            h = h * _MUL + code[3:] + np.uint64(1)
            bad |= pair[2 : n + 2]
        at = np.flatnonzero(~bad)
        x = h[at]
        x ^= x >> np.uint64(32)
        x *= _MIX
        x ^= x >> np.uint64(29)
        out.append((piece[at], x))
    return has, out


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    down = np.uint64(64 - bits)
    return (h * _MUL) >> down, (h * _SECOND) >> down


def _pieces(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Padded lower-case texts, long ones cut so that each n-gram starts in one piece, and whose they are."""
    pieces, owner = [], []
    for i, text in enumerate(texts):
        padded = f" {(text or '').lower()}{PAD}"
        for at in range(0, max(1, len(padded) - 3), PIECE):
            pieces.append(padded[at : at + PIECE + 3])
            owner.append(i)
    return pieces, np.array(owner, np.int64)


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_docs: int = 1500, min_rate: float = 0.005, share: float = 0.2, bits: int = 20) -> Model:
    """Fit on about ``max_docs`` documents of each language, drawn by a hash of the text.

    An n-gram goes into a language's filter if it is in ``min_rate`` of that
    language's drawn documents, and in at least ``share`` of the rate it has in
    the language where it is most frequent; so passages quoted in another
    language don't leak. A filter has 2**bits slots, which bounds the model.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes, key=lambda x: (-sizes[x], x))
    model = Model(langs, [sizes[x] for x in langs], bits)
    if not langs:
        return model
    index = {x: i for i, x in enumerate(langs)}
    rate = F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, max_docs / sizes[lang])))])
    drawn = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.element_at(rate, F.col("lang")) * F.lit(1 << 30))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, names = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
            for a, b in slices([len(x) for x in texts], PIECE):
                pieces, owner = _pieces(texts[a:b])
                lang = np.array([index[x] for x in names[a:b]], np.int64)
                docs_of = np.bincount(lang, minlength=len(langs))
                for piece, h in _grams(pieces)[1]:
                    order = np.argsort(h, kind="stable")  # documents stay in order within an n-gram
                    h, doc = h[order], owner[piece][order]
                    new = np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
                    h, of = h[new], lang[doc[new]]
                    order = np.lexsort((of, h))
                    h, of = h[order], of[order]
                    at = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), (h[1:] != h[:-1]) | (of[1:] != of[:-1])]))
                    n = np.diff(np.append(at, len(h)))
                    yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(of[at]), pa.array(n.astype(np.int64)), pa.array(np.zeros(len(n), bool))], ["h", "l", "n", "total"])
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(langs), np.int64)), pa.array(np.arange(len(langs))), pa.array(docs_of.astype(np.int64)), pa.array(np.ones(len(langs), bool))], ["h", "l", "n", "total"])

    counts = stored(drawn.mapInArrow(count, "h long, l long, n long, total boolean").groupBy("h", "l", "total").agg(F.sum("n").alias("n")))
    totals = counts.where("total").select("l", F.col("n").alias("docs"))
    rates = counts.where("NOT total").join(F.broadcast(totals), "l").where("n >= least(2, docs)").select("h", "l", (F.col("n") / F.col("docs")).alias("rate"))
    kept = (
        rates.groupBy("h")
        .agg(F.collect_list(F.struct("l", "rate")).alias("of"), F.max("rate").alias("top"))
        .select("h", F.expr(f"transform(filter(of, x -> x.rate >= {min_rate} AND x.rate >= {share} * top), x -> x.l)").alias("langs"))
        .where("size(langs) > 0")
    )

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("h").to_numpy(zero_copy_only=False).view(np.uint64)
            lists = batch.column("langs")
            n = np.diff(lists.offsets.to_numpy())
            lang = lists.flatten().to_numpy(zero_copy_only=False)
            first, second = _slots(np.repeat(h, n), bits)
            slot = np.concatenate([first, second]).astype(np.int64)
            lang = np.concatenate([lang, lang])
            yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(lang // 64), pa.array((np.uint64(1) << (lang % 64).astype(np.uint64)).view(np.int64))], ["slot", "word", "mask"])

    placed = kept.mapInArrow(place, "slot long, word long, mask long").groupBy("slot", "word").agg(F.bit_or("mask").alias("mask")).toPandas()
    kind = np.uint8 if len(langs) <= 8 else np.uint64
    for word in range((len(langs) + 63) // 64):
        part = placed[placed["word"] == word]
        slots = np.zeros(1 << bits, kind)
        slots[part["slot"].to_numpy()] = part["mask"].to_numpy(np.int64).view(np.uint64).astype(kind)
        model.slots.append(slots)
    model.fill = np.array([((model.slots[i // 64] >> kind(i % 64)) & kind(1)).mean() for i in range(len(langs))])
    return model


def _hits(model: Model, owner: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Hits of each language's filter in each of n texts."""
    first, second = _slots(h, model.bits)
    out = np.zeros((n, len(model.langs)))
    for word, slots in enumerate(model.slots):
        mask = slots[first] & slots[second]
        if mask.dtype == np.uint8:
            table = np.bincount(owner * 256 + mask, minlength=n * 256).reshape(n, 256)
            sets = (np.arange(256)[:, None] >> np.arange(len(model.langs))) & 1
            return table @ sets.astype(float)
        for i in range(word * 64, min(len(model.langs), word * 64 + 64)):
            out[:, i] = np.bincount(owner[(mask >> np.uint64(i % 64)) & np.uint64(1) == 1], minlength=n)
    return out


def judge(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and coverage (the winner's corrected share of n-grams) of each text."""
    n = len(texts)
    lang, score, cover = ["und"] * n, np.zeros(n), np.zeros(n)
    if not model.langs:
        return lang, score, cover
    false = model.fill**2
    for a, b in slices([len(x or "") for x in texts], PIECE):
        pieces, owner = _pieces(texts[a:b])
        letters, grams = _grams(pieces)
        hits, seen, has = np.zeros((b - a, len(model.langs))), np.zeros(b - a), np.zeros(b - a, bool)
        np.logical_or.at(has, owner, letters)
        for piece, h in grams:
            mine = owner[piece]
            hits += _hits(model, mine, h, b - a)
            seen += np.bincount(mine, minlength=b - a)
        share = np.clip((hits / np.maximum(seen, 1)[:, None] - false) / np.maximum(1 - false, 1e-9), 0, 1)
        best = share.argmax(axis=1)
        power = share**4
        top = power[np.arange(b - a), best]
        score[a:b] = np.where(has, top / np.maximum(power.sum(axis=1), 1e-300), 0)
        cover[a:b] = share[np.arange(b - a), best] * has
        for i in np.flatnonzero(has):
            lang[a + i] = model.langs[best[i]]
    return lang, score, cover


def predict(docs: DataFrame, model: Model, text: Column) -> Column:
    """A column struct<lang, score, coverage> for the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double, coverage double")
    def of(texts: pd.Series) -> pd.DataFrame:
        lang, score, cover = judge(shared.value, [x if isinstance(x, str) else None for x in texts])
        return pd.DataFrame({"lang": lang, "score": score, "coverage": cover})

    return of(text)


def predicted(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, lang_pred, score and coverage."""
    rows = docs.select(F.col(id_col), predict(docs, model, F.col(text_col)).alias("_p"))
    return rows.select(id_col, F.col("_p.lang").alias("lang_pred"), F.col("_p.score").alias("score"), F.col("_p.coverage").alias("coverage"))


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", min_coverage: float = 0.25) -> DataFrame:
    """Documents in a language of the model: not ``und``, and the filter knows ``min_coverage`` of their n-grams."""
    name = fresh(docs, "_language")
    judged = docs.withColumn(name, predict(docs, model, F.col(text_col)))
    return judged.where((F.col(f"{name}.lang") != "und") & (F.col(f"{name}.coverage") >= min_coverage)).select(*docs.columns)


def train_rows(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows whose language may be learned: fold 2 of 4 by crc32 of the id is held out; rows without id too."""
    return docs.where(fold(F.col(id_col), 4) != 2)
