"""Quality rules whose cutoffs are risk-controlled on labelled holdouts.

Base signals of every whole text are counted first. Each rule is a share from 0
to 1, higher being worse, cut into LEVELS levels. For each stratum (language) the
rows that labels call good form the holdout. A rule's cutoffs are tested from
the loosest to tighter ones; a cutoff is accepted while the exact binomial
(Clopper-Pearson) upper bound of the share of good rows that it rejects is at
most RISK / number of rules; of those accepted, the most useful one is taken.
Such a fixed sequence needs no correction within a rule; across rules and strata each test runs at DELTA / (rules x strata). So
with probability 1 - DELTA, no stratum loses more than RISK of its good rows to
the rules. A stratum whose holdout is too small gets no cutoff.

Results in special cases: null and empty texts have no words and fail the base
rule; a null language is a stratum; documents labelled more than once count as
good if all their labels say so, else as bad; rows of a repeated doc_id each count; labels
without a document are ignored; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, settle
from .words import chunks, mix, span_hash, split_words, window_hash

RISK, DELTA, LEVELS = 0.05, 0.05, 64
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
#: Fixed values of the query contract: the symbols that are counted.
SYMBOLS = "#*$%&|<>"

_SIGNALS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals", "n_marks"]
_DOC_STEP = np.uint64(0xD1342543DE82EF95)


def rules() -> dict[str, Column]:
    """Rule name to its share."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return {
        "symbols": F.col("n_symbols") / words,
        "duplicate_lines": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeated_words": F.col("n_repeat_words") / words,
        "capitals": F.col("n_capitals") / chars,
        "marks": F.col("n_marks") / words,
    }


def _byte_set(characters: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(characters.encode())] = True
    return out


_IS_SYMBOL, _IS_MARK = _byte_set(SYMBOLS), _byte_set("!?")
_IS_CAPITAL = _byte_set("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_STARTS_CHARACTER = (np.arange(256) & 0xC0) != 0x80


def signals(texts: list[str | None]) -> dict[str, np.ndarray]:
    """The base counts of every text."""
    w = split_words(texts)
    n_docs = len(texts)

    def per_doc(flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[w.text])

    inside = np.zeros(len(w.bytes_) + 1, dtype=np.int8)
    inside[w.first] = 1
    inside[w.last] -= 1
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    out = {
        "n_words": np.diff(w.bounds),
        "word_chars": per_doc(inside & _STARTS_CHARACTER[w.bytes_]),
        "n_symbols": per_doc(_IS_SYMBOL[w.bytes_]),
        "n_capitals": per_doc(_IS_CAPITAL[w.bytes_]),
        "n_marks": per_doc(_IS_MARK[w.bytes_]),
    }
    sums = w.sums()
    # lines: each text ends at a line feed, its own or the one that joins texts
    end = np.flatnonzero(w.bytes_ == 0x0A)
    start = np.append(0, end[:-1] + 1)
    worded = np.searchsorted(w.first, end) > np.searchsorted(w.first, start)
    start, end = start[worded], end[worded]
    of = np.searchsorted(w.text, start, side="right") - 1
    keys = mix(span_hash(sums, start, end) + of.astype(np.uint64) * _DOC_STEP)
    _, first = np.unique(keys, return_index=True)
    out["n_lines"] = np.bincount(of, minlength=n_docs)
    out["n_dup_lines"] = out["n_lines"] - np.bincount(of[first], minlength=n_docs)
    # words within windows that stand twice or more in their text
    doc = w.doc_of_word()
    windows = window_hash(span_hash(sums, w.first, w.last), REPEAT_WINDOW)
    at = np.flatnonzero(doc[REPEAT_WINDOW - 1 :] == doc[: len(windows)]) if len(windows) else np.zeros(0, dtype=np.int64)
    keys = mix(windows[at] + doc[at].astype(np.uint64) * _DOC_STEP)
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(keys) + 1, dtype=bool)
    twice[1:-1] |= same
    twice[:-2] |= same
    hit = at[order[twice[:-1]]]
    cover = np.zeros(len(doc) + 1, dtype=np.int64)
    cover[hit] = 1  # every window is hit once at most
    cover[hit + REPEAT_WINDOW] -= 1
    out["n_repeat_words"] = np.bincount(doc[np.cumsum(cover[:-1]) > 0], minlength=n_docs)
    return out


def _signal_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = batch.column("text").to_pylist()
    for a, b in chunks(texts):
        found = signals(texts[a:b])
        columns = [batch.column(c).slice(a, b - a) for c in ("doc_id", "lang")]
        yield pa.RecordBatch.from_arrays([*columns, *(pa.array(found[n], pa.int64()) for n in _SIGNALS)], names=["doc_id", "lang", *_SIGNALS])


def risk_bound(rejected: int, n: int, delta: float) -> float:
    """The exact binomial upper bound of a rate, at confidence 1 - delta."""
    if rejected >= n:
        return 1.0
    terms = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) for k in range(rejected + 1)]
    low, high = rejected / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        total = math.fsum(math.exp(t + k * math.log(p) + (n - k) * math.log1p(-p)) for k, t in enumerate(terms)) if p < 1 else 0.0
        low, high = (p, high) if total > delta else (low, p)
    return high


def choose_cutoff(good: np.ndarray, bad: np.ndarray, risk: float, delta: float) -> int:
    """The cutoff of a rule: rows of a higher level are rejected.

    good, bad: labelled rows at each level from 0 to LEVELS. Cutoffs are tested
    from the loosest on; of those accepted, the one with the most rejected bad
    less rejected good (as shares) is taken, the loosest if equal, as a looser
    one bears no more risk. LEVELS rejects nothing.
    """
    n, n_bad = int(good.sum()), max(1, int(bad.sum()))
    cutoff, best, lost, caught = LEVELS, 0.0, 0, 0
    for level in range(LEVELS, 0, -1):
        lost, caught = lost + int(good[level]), caught + int(bad[level])
        # more than this share of rejections cannot pass; so terms stay few
        if n == 0 or lost > risk * n or risk_bound(lost, n, delta) > risk:
            break
        if caught / n_bad - lost / n > best:
            cutoff, best = level - 1, caught / n_bad - lost / n
    return cutoff


def quality_signals(docs: DataFrame) -> DataFrame:
    """doc_id, lang and base signals of every row, with base_failed and a level per rule."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), "text")
    counted = arrow_map(rows, _signal_rows, "doc_id long, lang string, " + ", ".join(f"{n} long" for n in _SIGNALS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    levels = {f"level_{n}": F.ceil(F.least(share, F.lit(1.0)) * LEVELS).cast("int") for n, share in rules().items()}
    return counted.withColumn("base_failed", failed).withColumns(levels)


def cutoffs(scored: DataFrame, labels: DataFrame) -> DataFrame:
    """stratum and, for each rule, cut_<rule>; from labelled rows that pass the base."""
    names = list(rules())
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality")).filter(F.col("quality").isin(0, 1))
    held = scored.filter(~F.col("base_failed")).join(marks, "doc_id").withColumn("stratum", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")))
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("rule"), F.col(f"level_{n}").alias("level")) for n in names)))
    counts = held.select("stratum", "quality", pairs.alias("p")).groupBy("stratum", "quality", "p.rule", "p.level").agg(F.count("*").alias("n"))
    strata = counts.agg(F.count_distinct("stratum")).first()[0]
    delta = DELTA / (len(names) * max(1, strata))

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        out = {"stratum": [part["stratum"].iloc[0]]}
        for name in names:
            own = part[part["rule"] == name]
            found = np.zeros((2, LEVELS + 1), dtype=np.int64)
            np.add.at(found, (own["quality"].to_numpy(), own["level"].to_numpy()), own["n"].to_numpy())
            out[f"cut_{name}"] = [choose_cutoff(found[1], found[0], RISK / len(names), delta)]
        return pd.DataFrame(out)

    return counts.groupBy("stratum").applyInPandas(choose, "stratum string, " + ", ".join(f"cut_{n} int" for n in names))


def quality_verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, lang, text): the base signals,
    base_failed, kept, and each rule's level."""
    scored = settle(quality_signals(docs)).withColumn("stratum", F.coalesce(F.concat(F.lit("="), "lang"), F.lit("")))
    names = list(rules())
    over = [F.col(f"level_{n}") > F.coalesce(F.col(f"cut_{n}"), F.lit(LEVELS)) for n in names]
    rejected = over[0]
    for rule in over[1:]:
        rejected = rejected | rule
    return scored.join(settle(cutoffs(scored, labels)), "stratum", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~rejected).alias("kept"), *(f"level_{n}" for n in names)
    )
