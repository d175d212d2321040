"""Toxicity scores by a linear classifier of character n-grams whose features
are scaled by naive Bayes log-count ratios.

A text's features are the hashed 3- to 5-grams of its lower-cased characters,
each at up to three levels: that the text has it, and that it has it often, by
LEVELS. On a bounded sample of labelled rows (SAMPLE_TOXIC and
SAMPLE_CLEAN, smallest id hashes first; equal rows once) each gram gets the log ratio of its
smoothed rates in toxic and clean texts; a logistic regression is then fitted on
the features so scaled. Grams seen in fewer than MIN_TEXTS texts, or about as
often in either class, have no weight. The intercept is set to the rate of toxic
rows among all labelled ones. Scoring reads every whole text once. LEVELS and L2
were set by cross-validation on rows that may be learned from, at sf0.1.

Results in special cases: a null or empty text has no gram and scores as the
intercept alone; without labelled rows of both classes every score is the rate
of toxic ones (0 if there are none); a document labelled more than once is toxic
if any label says so; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, arrow_map, held_out
from .words import chunks

SAMPLE_TOXIC, SAMPLE_CLEAN = 1500, 2500
SHORTEST, LONGEST, HASH_BITS = 3, 5, 20
MIN_TEXTS, MIN_RATIO, KEPT_GRAMS = 3, 0.4, 50_000
#: The penalty, and when the fit stops: steps at most, and the gradient against the first one.
L2, STEPS, TOLERANCE = 1.0, 200, 1e-4
THRESHOLD = 0.7
#: A gram is at a level if the text has it so many times, and once in so many characters.
LEVELS = ((1, None), (2, 1000), (3, 500))
_GRAMS = 1 << HASH_BITS


def _grams(texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Text bounds in characters, gram hashes by start for every length, and the
    end of the text that each character is of."""
    low = [(t or "").lower() for t in texts]
    bounds = np.zeros(len(low) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in low], out=bounds[1:])
    code = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.repeat(bounds[1:], np.diff(bounds))
    out, h = [], code.copy()
    for n in range(2, LONGEST + 1):
        h = h[: max(0, len(code) - n + 1)] * np.uint32(0x01000193) + code[n - 1 :]
        if n >= SHORTEST:
            x = (h ^ np.uint32(n * 0x1C6EF35F)) * np.uint32(0x9E3779B1)
            out.append((x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA77) >> np.uint32(32 - HASH_BITS))
    return bounds, out, ends


def text_features(texts: list[str | None], used: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) pairs, each once, by text; only grams where used, if given.

    A feature is level * _GRAMS + gram.
    """
    bounds, by_length, ends = _grams(texts)
    found = []
    for n, h in enumerate(by_length, start=SHORTEST):
        at = np.arange(len(h)) if used is None else np.flatnonzero(used[h])
        at = at[at + n <= ends[at]]
        found.append(((np.searchsorted(bounds, at, side="right") - 1) << HASH_BITS) | h[at])
    pairs, times = np.unique(np.concatenate(found), return_counts=True)
    doc, gram = pairs >> HASH_BITS, pairs & (_GRAMS - 1)
    size = np.diff(bounds)[doc]
    hit = [(times >= least) & (times * (per or 0) >= (size if per else 0)) for least, per in LEVELS]
    docs = np.concatenate([doc[x] for x in hit])
    order = np.argsort(docs, kind="stable")
    return docs[order], np.concatenate([gram[x] + k * _GRAMS for k, x in enumerate(hit)])[order]


@dataclass
class ToxicityModel:
    grams: np.ndarray
    weights: np.ndarray
    intercept: float

    def table(self) -> np.ndarray:
        out = np.zeros(len(LEVELS) * _GRAMS, dtype=np.float32)
        out[self.grams] = self.weights
        return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def fit_linear(texts: list[np.ndarray], toxic: np.ndarray, rate: float) -> ToxicityModel:
    """The classifier from each text's features (each once) and label, and the rate of toxic rows."""
    prior = float(np.log(max(rate, 1e-6) / max(1 - rate, 1e-6)))
    n_toxic, n_clean = int(toxic.sum()), int((1 - toxic).sum())
    none = np.zeros(0, dtype=np.int64)
    if not n_toxic or not n_clean:
        return ToxicityModel(none, none.astype(np.float32), prior if n_toxic or n_clean else -50.0)
    seen = np.zeros((2, len(LEVELS) * _GRAMS), dtype=np.float32)
    for grams, label in zip(texts, toxic, strict=True):
        seen[label, grams] += 1
    ratio = np.log((seen[1] + 1) / (n_toxic + 2)) - np.log((seen[0] + 1) / (n_clean + 2))
    strength = np.where(seen.sum(axis=0) >= MIN_TEXTS, np.abs(ratio), 0)
    kept = np.sort(np.argsort(-strength, kind="stable")[:KEPT_GRAMS])
    kept = kept[strength[kept] >= MIN_RATIO]
    if not len(kept):
        return ToxicityModel(kept, none.astype(np.float32), prior)
    name = np.full(len(LEVELS) * _GRAMS, -1, dtype=np.int32)
    name[kept] = np.arange(len(kept))
    columns = [(c := name[grams])[c >= 0] for grams in texts]
    doc = np.repeat(np.arange(len(texts)), [len(c) for c in columns])
    column = np.concatenate(columns)
    value = ratio[kept][column]
    n = len(toxic)
    balance = np.where(toxic == 1, 0.5 / n_toxic, 0.5 / n_clean)

    def loss(w: np.ndarray) -> tuple[float, np.ndarray]:
        """The balanced log loss with its penalty, and the gradient; the last weight is the bias."""
        logits = np.bincount(doc, weights=w[:-1][column] * value, minlength=n) + w[-1]
        error = (_sigmoid(logits) - toxic) * balance
        gradient = np.append(np.bincount(column, weights=error[doc] * value, minlength=len(kept)) + L2 / n * w[:-1], error.sum())
        return float((balance * (np.logaddexp(0, logits) - toxic * logits)).sum() + L2 / n / 2 * (w[:-1] @ w[:-1])), gradient

    w = minimise(loss, np.zeros(len(kept) + 1))
    return ToxicityModel(kept, (w[:-1] * ratio[kept]).astype(np.float32), float(w[-1]) + prior)


def minimise(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray) -> np.ndarray:
    """The minimum of a smooth convex function by L-BFGS, to a gradient TOLERANCE of its first."""
    value, g = loss(w)
    least = TOLERANCE * np.linalg.norm(g)
    steps: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=10)
    for _ in range(STEPS):
        if np.linalg.norm(g) <= least:
            break
        d, told = -g, []
        for s, y, r in reversed(steps):
            told.append(r * (s @ d))
            d = d - told[-1] * y
        if steps:
            s, y, r = steps[-1]
            d = d / (r * (y @ y))
        else:
            d = d / max(1e-12, np.linalg.norm(g))
        for (s, y, r), a in zip(steps, reversed(told), strict=True):
            d = d + s * (a - r * (y @ d))
        slope, t = g @ d, 1.0
        new_value, new_g = loss(w + d)
        while new_value > value + 1e-4 * t * slope and t > 1e-8:
            t /= 2
            new_value, new_g = loss(w + t * d)
        if new_value >= value:
            break
        s, y = t * d, new_g - g
        if s @ y > 1e-12 * np.linalg.norm(s) * np.linalg.norm(y):
            steps.append((s, y, 1 / (s @ y)))
        w, value, g = w + s, new_value, new_g
    return w


def learn(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fits on labelled rows that are not held out."""
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic")).filter(F.col("toxic").isin(0, 1)).filter(~held_out(F.col("doc_id")))
    by_hash = F.xxhash64("doc_id")
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    sample = known.filter("toxic = 1").orderBy(by_hash).limit(SAMPLE_TOXIC).union(known.filter("toxic = 0").orderBy(by_hash).limit(SAMPLE_CLEAN))

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, toxic = batch.column("text").to_pylist(), batch.column("toxic")
        for a, b in chunks(texts):
            doc, gram = text_features(texts[a:b])
            cuts = np.searchsorted(doc, np.arange(b - a + 1))
            packed = [gram[i:j].astype(np.int32).tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), toxic.slice(a, b - a), pa.array(packed, pa.binary())], names=["doc_id", "toxic", "grams"])

    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").withColumn("h", F.xxhash64("doc_id", "text"))
    # a repeated id brings many rows: equal ones count once, and of others no more than the sample's size
    different = hashed.groupBy("toxic", "doc_id", "h").agg(F.count("*").alias("n")).select("toxic", "doc_id", "h")
    kept = different.filter("toxic = 1").orderBy("h", "doc_id").limit(SAMPLE_TOXIC).union(different.filter("toxic = 0").orderBy("h", "doc_id").limit(SAMPLE_CLEAN))
    texts = hashed.join(F.broadcast(kept), ["toxic", "doc_id", "h"]).dropDuplicates(["toxic", "doc_id", "h"]).select("doc_id", "toxic", "text")
    found = sorted(arrow_map(texts, rows, "doc_id long, toxic int, grams binary").collect(), key=lambda r: (r["doc_id"], len(r["grams"]), bytes(r["grams"])))
    grams = [np.frombuffer(r["grams"], dtype=np.int32) for r in found]
    toxic = np.array([r["toxic"] for r in found], dtype=np.int64)
    rate = counts.get(1, 0) / max(1, sum(counts.values()))
    return fit_linear(grams, toxic, rate)


def toxicity_scores(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs(doc_id, text)."""

    def score(batches: Batches) -> Batches:
        table = model.table()
        used = (table.reshape(len(LEVELS), _GRAMS) != 0).any(axis=0)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts):
                doc, gram = text_features(texts[a:b], used)
                found = _sigmoid(np.bincount(doc, weights=table[gram], minlength=b - a) + model.intercept)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in ("doc_id", "held_out")), pa.array(found, pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id long, held_out boolean, score double").withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
