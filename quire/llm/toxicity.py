"""Toxic passages as maximum-scoring segments over token log-odds.

Training counts words in toxic and clean documents and gives each word a log-odds
of its document frequencies with a Dirichlet prior; words whose log-odds is large
and significant form the lexicon, and all others share one slightly negative score. The scan finds every
maximal-scoring segment of a text in linear time (Ruzzo and Tompa). With scores
that are log-odds, the extreme-value scale is 1, and K is fitted on the clean
documents; sum statistics over a document's segments give one p-value, which a
logistic curve fitted on the training documents turns into the score.

Edge cases: null and empty texts have no segment and get the curve's lowest
score; without training rows of both classes every score is 0. Repeated rows are
scored each on its own; labels that are null don't count; of contradicting labels
of one document, each counts. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import fold, fresh, stored

WORD = re.compile(r"\w+")


@dataclass
class Model:
    """Word scores, the score of other words, the extreme-value K and the logistic curve."""

    lexicon: dict[str, float] = field(default_factory=dict)
    other: float = 0.0
    k: float = 0.0
    curve: tuple[float, float] | None = None


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of a sequence, left to right, in linear time."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    kept: list[tuple[int, int, float, float]] = []
    before: list[int] = []  # for each kept segment, the nearest earlier one whose left sum is smaller
    for at in np.flatnonzero(scores > 0):
        start, end, left, right = int(at), int(at) + 1, sums[at], sums[at + 1]
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= left:
                j = before[j]
            if j < 0 or kept[j][3] >= right:
                kept.append((start, end, left, right))
                before.append(j)
                break
            start, left = kept[j][0], kept[j][2]
            del kept[j:], before[j:]
    return [(a, b, r - x) for a, b, x, r in kept]


def word_scores(model: Model, words: list[str]) -> np.ndarray:
    return np.fromiter((model.lexicon.get(w, model.other) for w in words), float, len(words))


def p_value(found: list[float], n: int, k: float) -> float:
    """Of the segment scores of a text of n words: the smallest sum-statistic p-value over the best r segments."""
    best, total = 1.0, 0.0
    for r, s in enumerate(sorted(found, reverse=True), 1):
        x = s - math.log(max(k * n, 1e-12))
        if x <= 0:
            break
        total += x
        log_p = -total + (r - 1) * math.log(max(total, 1e-9)) - math.lgamma(r + 1) - math.lgamma(r)
        best = min(best, math.exp(max(-700.0, log_p)))
    return best


def scan(model: Model, text: str | None) -> tuple[list[str], list[tuple[int, int, float]]]:
    words = WORD.findall((text or "").lower())
    if not model.lexicon or model.lexicon.keys().isdisjoint(words):
        return words, []
    return words, segments(word_scores(model, words))


def evidence(model: Model, text: str | None) -> float:
    """-ln p of a text; 0 without a segment."""
    words, found = scan(model, text)
    return -math.log(p_value([s for _, _, s in found], len(words), model.k)) if found else 0.0


def posterior(model: Model, x: float) -> float:
    if model.curve is None:
        return 0.0
    return 1 / (1 + math.exp(min(700.0, -(model.curve[0] + model.curve[1] * x))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_docs: int = 20_000, min_z: float = 2.6, min_odds: float = 2.0) -> Model:
    """Fit on about ``max_docs`` labelled documents of each class, drawn by a hash of the id.

    The drawn labels are bounded by that and so are broadcast: no text is shuffled.
    The lexicon keeps all their words with a log-odds of ``min_odds`` (nats) and
    ``min_z`` standard deviations or more.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1)").distinct()
    sizes = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model()
    rate = F.when(F.col("y") == 1, min(1.0, max_docs / sizes[1])).otherwise(min(1.0, max_docs / sizes[0]))
    some = known.where(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) < rate * F.lit(1 << 30))
    texts = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    drawn = texts.join(F.broadcast(some), F.col("_doc") == F.col("_id")).select("text", "y")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (Counter(), Counter())
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                found[y].update(set(WORD.findall(text.lower())))
            words = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([c[w] for w in words], pa.int64()) for c in found)], ["w", "c", "t"])

    counts = stored(drawn.mapInArrow(count, "w string, c long, t long").groupBy("w").agg(F.sum("c").alias("c"), F.sum("t").alias("t")))
    clean, toxic, kinds = counts.agg(F.sum("c"), F.sum("t"), F.count("*")).first()
    if not clean or not toxic:
        return Model()
    odds = lambda y, n: F.log((y + 0.5) / (n + 0.5 * kinds - y - 0.5))  # noqa: E731  Dirichlet prior of 0.5 a word
    scored = counts.select("w", "c", "t", (odds(F.col("t"), toxic) - odds(F.col("c"), clean)).alias("d"), (1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5)).alias("v"))
    top = scored.where(f"t >= 3 AND d >= {min_odds} AND d / sqrt(v) >= {min_z}").orderBy("w").toPandas()
    if top.empty:
        return Model()
    p_toxic, p_clean = (top["t"] + 0.5).to_numpy() / toxic, (top["c"] + 0.5).to_numpy() / clean
    model = Model(dict(zip(top["w"], np.log(p_toxic / p_clean), strict=True)), math.log((1 - min(p_toxic.sum(), 0.999)) / (1 - min(p_clean.sum(), 0.998))))
    model.lexicon = {w: s for w, s in model.lexicon.items() if s > 0}
    if not model.lexicon:
        return Model()
    model.other = min(model.other, -1e-3)
    least = min(model.lexicon.values())
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("n long, above long")
    def tally(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            words, found = scan(shared.value, text)
            out.append((len(words), sum(s >= least for _, _, s in found)))
        return pd.DataFrame(out, columns=["n", "above"])

    words, above = drawn.where("y = 0").select(tally("text").alias("s")).agg(F.sum("s.n"), F.sum("s.above")).first()
    model.k = ((above or 0) + 0.5) / (max(1, words or 0) * math.exp(-least))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def level(texts: pd.Series) -> pd.Series:
        return pd.Series([min(60.0, round(evidence(shared.value, x) * 4) / 4) for x in texts], dtype=float)

    bins = drawn.select(level("text").alias("x"), "y").groupBy("x", "y").agg(F.count("*").alias("n")).toPandas()
    model.curve = _logistic(bins["x"].to_numpy(float), bins["y"].to_numpy(float), bins["n"].to_numpy(float) * np.where(bins["y"] == 1, max(1.0, sizes[1] / max_docs), max(1.0, sizes[0] / max_docs)))
    return model


def _logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Weighted logistic fit of y on x by Newton's method, with a weak ridge on the slope; the slope isn't negative."""
    a, b = 0.0, 0.1
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = n * p * (1 - p) + 1e-9
        g = np.array([(n * (y - p)).sum() - 0.01 * a, (n * (y - p) * x).sum() - b])
        h = np.array([[w.sum() + 0.01, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1.0]])
        step = np.linalg.solve(h, g)
        a, b = a + float(np.clip(step[0], -2, 2)), b + float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-8:
            break
    return a, max(0.0, b)


def score(docs: DataFrame, model: Model, text: Column) -> Column:
    """A column struct<score, passages>; passages are significant segments with word offsets, score and E-value."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, passages array<struct<first_word:int,last_word:int,score:double,e_value:double>>")
    def of(texts: pd.Series) -> pd.DataFrame:
        m, out = shared.value, []
        for text in texts:
            words, found = scan(m, text if isinstance(text, str) else None)
            x = -math.log(p_value([s for _, _, s in found], len(words), m.k)) if found else 0.0
            spans = [{"first_word": a, "last_word": b - 1, "score": s, "e_value": e} for a, b, s in found if (e := m.k * len(words) * math.exp(-s)) <= 0.05]
            out.append((posterior(m, x), spans))
        return pd.DataFrame(out, columns=["score", "passages"])

    return of(text)


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per input row: the id, score, predicted and the significant passages."""
    rows = docs.select(F.col(id_col), score(docs, model, F.col(text_col)).alias("_s"))
    return rows.select(id_col, F.col("_s.score").alias("score"), (F.col("_s.score") >= threshold).cast("int").alias("predicted"), F.col("_s.passages").alias("passages"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    name = fresh(docs, "_toxicity")
    return docs.withColumn(name, score(docs, model, F.col(text_col))).where(F.col(f"{name}.score") < threshold).select(*docs.columns)


def train_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The labels that may be learned: fold 1 of 3 by crc32 of the id is held out."""
    return labels.where(fold(F.col(id_col), 3) != 1)
