"""Language identification by nearest centroid.

Texts become normalised TF-IDF vectors of hashed character 1- to 3-grams
(letters lower-cased, everything else a space). A bounded sample of labelled
rows (PER_LANGUAGE of every language at most, by a hash of id and text, repeated
rows once) gives the inverse document frequencies and, by spherical k-means,
CENTROIDS centroids a language. Languages are fitted each by itself, distributed;
the driver and the workers hold the centroids of BLOCK_LANGUAGES at once, and more
languages take more passes, of which the best cosine counts. A text gets the language of the centroid of
highest cosine, its score. It is rejected if that cosine is below REJECT_SHARE
of a low quantile of the sample's own cosines, for the same language and length;
cut copies of the sample stand for short texts.

Results in special cases: a null text, or one without a letter, is `und` with
score 0 and rejected; with nothing to learn from every text is so; rows of null
language are not learned from; equal cosines go to the language first in code
points; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, arrow_map, held_out, settle
from .words import chunks

PER_LANGUAGE, BLOCK_LANGUAGES, CENTROIDS, ROUNDS = 300, 200, 4, 10
DIMENSIONS = 1 << 13
#: Lengths in characters at which the sample is cut for short texts.
CUTS = (12, 40, 120, 400)
REJECT_QUANTILE, REJECT_SHARE = 0.01, 0.5
_BUCKETS = 12
#: Texts whose dense vectors a worker holds at once.
_DENSE_TEXTS = 128
UNKNOWN = "und"
#: Columns of a judgement while it is made.
_JUDGED = ("__lf_lang", "__lf_score", "__lf_rejected")

_LOWER_LETTER = np.array([ord(c.lower()) if (c := chr(i)).isalpha() and len(c.lower()) == 1 else ord(c) if c.isalpha() else 0 for i in range(0x3000)], dtype=np.uint32)


def _letters(code: np.ndarray) -> np.ndarray:
    """Lower-case letters of code points, other characters 0."""
    low = _LOWER_LETTER[np.minimum(code, 0x2FFF)]
    far = np.flatnonzero(code >= 0x3000)
    if len(far):
        low[far] = [c if chr(c).isalpha() else 0 for c in code[far].tolist()]
    return low


def term_counts(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Gram counts (texts x DIMENSIONS) and the number of letters of every text."""
    parts = [t or "" for t in texts]
    sizes = np.array([len(t) for t in parts])
    code = np.frombuffer("".join(t + "  " for t in parts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letters = _letters(code)
    doc = np.repeat(np.arange(len(parts)), sizes + 2)
    n_letters = np.bincount(doc[letters > 0], minlength=len(parts))
    starts = np.zeros(len(parts), dtype=np.int64)
    np.cumsum(sizes[:-1] + 2, out=starts[1:])
    inside = np.arange(len(code)) - starts[doc] < sizes[doc]
    inside[:-2] &= (letters[:-2] > 0) | (letters[1:-1] > 0) | (letters[2:] > 0)
    at = np.flatnonzero(inside)
    counts = np.zeros(len(parts) * DIMENSIONS, dtype=np.int64)
    base = doc[at] * DIMENSIONS
    h = np.zeros(len(at), dtype=np.uint32)
    for n in range(3):
        h = h * np.uint32(0x01000193) + letters[at + n]
        x = (h + np.uint32(n + 1)) * np.uint32(0x9E3779B1)
        slot = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)
        counts += np.bincount(base + slot, minlength=len(counts))
    return counts.reshape(len(parts), DIMENSIONS), n_letters


def _bucket(n_letters: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(np.maximum(n_letters, 1)).astype(int), _BUCKETS - 1)


def _vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts, dtype=np.float32)
    x *= idf
    x /= np.maximum(np.sqrt(np.einsum("ij,ij->i", x, x))[:, None], 1e-9)
    return x


@dataclass
class LanguageModel:
    """A block of languages."""

    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    of: np.ndarray
    least: np.ndarray

    def judge(self, counts: np.ndarray, n_letters: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is rejected, for every text."""
        if not self.languages:
            return [UNKNOWN] * len(counts), np.zeros(len(counts)), np.ones(len(counts), dtype=bool)
        cosine = _vectors(counts, self.idf) @ self.centroids.T
        best = cosine.argmax(axis=1)
        bare = n_letters == 0
        score = np.where(bare, 0, np.clip(cosine[np.arange(len(best)), best], 0, 1)).astype(float)
        language = self.of[best]
        rejected = bare | (score < self.least[language, _bucket(n_letters)])
        return [UNKNOWN if b else self.languages[k] for b, k in zip(bare, language, strict=True)], score, rejected


def _k_means(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means; starts are the texts farthest from those chosen."""
    chosen = [0]
    near = x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    centroids = x[chosen]
    for _ in range(ROUNDS):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.stack([x[own == j].sum(axis=0) if (own == j).any() else centroids[j] for j in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return centroids


def _dense(packed: list[bytes]) -> np.ndarray:
    """Gram counts of texts from their (slots, counts) bytes."""
    out = np.zeros((len(packed), DIMENSIONS), dtype=np.float32)
    for row, p in zip(out, packed, strict=True):
        slots, counts = np.frombuffer(p, dtype=np.int32).reshape(2, -1)
        row[slots] = counts
    return out


@dataclass
class Learned:
    """All languages in order, and their centroids as a table."""

    languages: list[str]
    idf: np.ndarray
    fitted: DataFrame | None

    def blocks(self) -> Iterator[LanguageModel]:
        """Models of BLOCK_LANGUAGES languages at most, one at least."""
        for a in range(0, max(1, len(self.languages)), BLOCK_LANGUAGES):
            names = self.languages[a : a + BLOCK_LANGUAGES]
            found = {} if not names else {r["lang"]: r for r in self.fitted.filter(F.col("lang").between(names[0], names[-1])).collect()}
            parts = [np.frombuffer(found[n]["centroids"], dtype=np.float32).reshape(-1, DIMENSIONS) for n in names]
            centroids = np.concatenate(parts) if parts else np.zeros((0, DIMENSIONS), dtype=np.float32)
            least = np.array([found[n]["least"] for n in names]).reshape(-1, _BUCKETS)
            yield LanguageModel(names, self.idf, centroids, np.repeat(np.arange(len(names)), [len(p) for p in parts]), least)


def fit_language(packed: list[bytes], n_letters: np.ndarray, whole: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of one language, and its least cosines by length, from packed
    gram counts of texts; those not whole only set rejection."""
    centroids = _k_means(_vectors(_dense([p for p, w in zip(packed, whole, strict=True) if w]), idf), CENTROIDS)
    bucket = _bucket(n_letters)
    cosine = np.concatenate([(_vectors(_dense(packed[a : a + 200]), idf) @ centroids.T).max(axis=1) for a in range(0, len(packed), 200)])
    found = np.full(_BUCKETS, np.nan)
    for b in range(_BUCKETS):
        if (of_length := cosine[bucket == b]).size:
            found[b] = np.quantile(of_length, REJECT_QUANTILE) * REJECT_SHARE
    have = np.flatnonzero(~np.isnan(found))
    # lengths that the sample lacks go by the next shorter one, or are not rejected
    return centroids, np.array([found[have[have <= b][-1]] if (have <= b).any() else 0.0 for b in range(_BUCKETS)])


def sample(known: DataFrame) -> DataFrame:
    """PER_LANGUAGE different rows (doc_id, text) of every lang at most, each once.

    Hashes are ranked without the texts, by partition first; then the texts follow.
    """
    hashed = known.withColumn("h", F.xxhash64("doc_id", "text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = hashed.groupBy("lang", "h").agg(F.count("*").alias("n")).withColumn("place", place).filter(F.col("place") <= PER_LANGUAGE).select("lang", "h")
    return hashed.join(chosen, ["lang", "h"]).dropDuplicates(["lang", "h"])


def learn(docs: DataFrame) -> Learned:
    """Fits on documents with a language and a letter that are not held out."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    known = rows.filter(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    def sampled(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, langs, texts = (batch.column(c).to_pylist() for c in ("h", "lang", "text"))
        for i, text in enumerate(texts):
            for cut in (None, *CUTS):
                if text and (cut is None or len(text) > cut):
                    found, n = term_counts([text[:cut]])
                    slots = np.flatnonzero(found[0])
                    packed = np.concatenate([slots, found[0][slots]]).astype(np.int32).tobytes()
                    columns = (([ids[i]], pa.int64()), ([langs[i]], pa.string()), ([cut is None], pa.bool_()), ([int(n[0])], pa.int64()), ([packed], pa.binary()))
                    yield pa.RecordBatch.from_arrays([pa.array(*c) for c in columns], names=["h", "lang", "whole", "letters", "counts"])

    grams = settle(arrow_map(sample(known).select("h", "lang", "text"), sampled, "h long, lang string, whole boolean, letters long, counts binary").filter("letters > 0"))
    languages = [r["lang"] for r in grams.filter("whole").select("lang").distinct().orderBy("lang").collect()]

    def slots(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(DIMENSIONS, dtype=np.int64)
        for p in batch.column("counts").to_pylist():
            seen[np.frombuffer(p, dtype=np.int32).reshape(2, -1)[0]] += 1
        yield pa.RecordBatch.from_arrays([pa.array(range(DIMENSIONS), pa.int32()), pa.array(seen)], names=["slot", "n"])

    wholes = grams.filter("whole")
    seen = np.zeros(DIMENSIONS)
    for r in arrow_map(wholes.select("counts"), slots, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect():
        seen[r["slot"]] = r["n"]
    idf = np.log((wholes.count() + 1) / (seen + 1)).astype(np.float32) + 1

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["h", "whole", "letters", "counts"], ascending=[True, False, True, True])
        whole = rows["whole"].to_numpy(dtype=bool)
        if not whole.any():
            return pd.DataFrame({"lang": [], "centroids": [], "least": []})
        centroids, least = fit_language([bytes(p) for p in rows["counts"]], rows["letters"].to_numpy(), whole, idf)
        return pd.DataFrame({"lang": [rows["lang"].iloc[0]], "centroids": [centroids.astype(np.float32).tobytes()], "least": [least.tolist()]})

    fitted = settle(grams.groupBy("lang").applyInPandas(fit, "lang string, centroids binary, least array<double>")) if languages else None
    return Learned(languages, idf, fitted)


def _judge(model: LanguageModel, columns: list[str], again: bool):
    def run(batches: Batches) -> Batches:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            for a, b in chunks(texts, most=_DENSE_TEXTS):
                language, score, rejected = model.judge(*term_counts(texts[a:b]))
                if again:
                    old = [batch.column(c).slice(a, b - a).to_pylist() for c in _JUDGED]
                    best = [new if new[1] > was[1] else was for new, was in zip(zip(language, score.tolist(), rejected.tolist(), strict=True), zip(*old, strict=True), strict=True)]
                    language, score, rejected = zip(*best, strict=True)
                arrays = [batch.column(c).slice(a, b - a) for c in columns]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(language, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*columns, *_JUDGED])

    return run


def _judged(docs: DataFrame, model: Learned, kept: list[str]) -> DataFrame:
    """The kept columns of docs with _JUDGED, by one pass for every block of languages."""
    last = max(1, -(-len(model.languages) // BLOCK_LANGUAGES)) - 1
    for k, block in enumerate(model.blocks()):
        columns = kept if k == last else list(dict.fromkeys([*kept, "text"]))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in map(docs.schema.__getitem__, columns))
        docs = docs.mapInArrow(_judge(block, columns, k > 0), f"{schema}, {_JUDGED[0]} string, {_JUDGED[1]} double, {_JUDGED[2]} boolean")
        if k < last:
            docs = settle(docs)
    return docs


def predict(docs: DataFrame, model: Learned) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected of every row of docs(doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return _judged(rows, model, ["doc_id", "held_out"]).withColumnsRenamed(dict(zip(_JUDGED, ("lang_pred", "score", "rejected"), strict=True)))


def drop_rejected(docs: DataFrame, model: Learned) -> DataFrame:
    """docs without the rows whose language is rejected."""
    return _judged(docs, model, docs.columns).filter(~F.col(_JUDGED[2])).drop(*_JUDGED)
