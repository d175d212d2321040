"""Substring deduplication by relative Lempel-Ziv parsing.

The corpus is its own reference. It is cut into reference blocks: maximal runs of
20-word windows that share one minimiser (the smallest hash of a 5-word gram within
the window), so equal text is cut equally wherever it stands. The index holds every
block's earliest place, by minimiser and content; a shuffle on the minimiser looks
all blocks of all documents up in all of it.

A document is then parsed greedily from left to right: a factor is copied from the
place of its block in the reference (the earliest one, or within a task one that is
early enough) and grows as long as what follows in the document is what follows there. Where a minimiser stands in the index with other
contents too, a match can end inside the block: these are the factor boundaries,
whose windows are looked up one by one, in a second index of windows, and parsed on
in the same way. A factor is at least one window, 20 words, long: a duplicate span.

Both look-ups are exact up to 64-bit hash collisions (of contents with one
minimiser, and of windows at factor boundaries); at 10^13 windows some 10^-7 of
them could be taken for another.

Hot groups: a task settles what it has met earlier itself (HELD keys at most, across
its batches), so a content or window that many documents share reaches its group
about once a task. Where a task meets a minimiser with several contents, it sends
word of that once, and the blocks go by minimiser and content instead.

Results in special cases: a null or short text has no window and nothing
removed; a null doc_id sorts first; rows of one doc_id with different texts are
ordered by a hash of the text; rows repeated whole are one document listed more
than once, and each gets that document's result; extra columns are kept.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, arrow_map, settle
from .words import chunks, mix, prefix_sums, signed, span_hash, split_words, window_hash

#: Words of a window, and of the grams whose smallest hash names a factor.
WINDOW, GRAM = 20, 5
#: Keys whose earliest places a task keeps in mind, at most.
HELD = 100_000
#: A place in a document and a number of windows in one long; no text that Spark can
#: hold has more words than 31 bits count.
_N_BITS = 12
_MAX_RUN = (1 << _N_BITS) - 1
_KEY = ["__lf_doc", "__lf_th"]
#: States of a block: looked up; settled within the task; holding a window twice; of
#: a minimiser known to have other contents; no block, but word of such a minimiser.
_PLAIN, _KNOWN, _REPEATS_ITSELF, _MIXED, _MARK = range(5)


def _sliding_min(x: np.ndarray, n: int) -> np.ndarray:
    step = 1
    while 2 * step <= n:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = n - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def _windows(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every window: its hash, its minimiser, its document, its place there."""
    w = split_words(texts)
    hashes = w.hashes()
    windows = window_hash(hashes, WINDOW)
    doc = w.doc_of_word()
    inside = np.flatnonzero(doc[WINDOW - 1 :] == doc[: len(windows)]) if len(windows) else np.zeros(0, dtype=np.int64)
    least = _sliding_min(window_hash(hashes, GRAM), WINDOW - GRAM + 1) if len(windows) else windows
    of = doc[inside]
    return windows[inside], least[inside], of, inside - w.bounds[of]


def _factors(texts: list[str | None]) -> tuple[np.ndarray, ...]:
    """Of every factor: minimiser, content hash, document, first window, windows, state."""
    windows, least, doc, at = _windows(texts)
    n = len(windows)
    if not n:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64, np.int8))
    new = np.ones(n, dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, n))
    if size.max() > _MAX_RUN:  # cut very long runs into pieces
        new[np.concatenate([np.arange(s, s + k, _MAX_RUN) for s, k in zip(start[size > _MAX_RUN], size[size > _MAX_RUN], strict=True)])] = True
        start = np.flatnonzero(new)
        size = np.diff(np.append(start, n))
    content = span_hash(prefix_sums(windows), start, start + size)
    state = np.where(size > WINDOW - GRAM + 1, _REPEATS_ITSELF, _PLAIN).astype(np.int8)
    run = np.cumsum(new) - 1
    for d in range(1, min(WINDOW - GRAM + 1, n)):
        same = np.flatnonzero(windows[:-d] == windows[d:])
        state[run[same[run[same] == run[same + d]]]] = _REPEATS_ITSELF
    return least[start], content, doc[start], at[start], size, state


def _ranks(doc: np.ndarray, th: np.ndarray) -> np.ndarray:
    """Ranks of rows by (doc, th); equal rows get equal ranks."""
    order = np.lexsort((th, doc))
    step = np.ones(len(doc), dtype=np.int64)
    step[1:] = (doc[order][1:] != doc[order][:-1]) | (th[order][1:] != th[order][:-1])
    out = np.empty(len(doc), dtype=np.int64)
    out[order] = np.cumsum(step)
    return out


def _firsts(keys: tuple[np.ndarray, ...], place: np.ndarray) -> np.ndarray:
    """Of every row, the row of the smallest place among those with the same keys."""
    order = np.lexsort((place, *keys))
    new = np.ones(len(place), dtype=bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in keys])
    out = np.empty(len(place), dtype=np.int64)
    out[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(place)), 0))]
    return out


class Earliest:
    """Earliest places of keys that a task meets again and again."""

    def __init__(self) -> None:
        self.keys = np.zeros(0, dtype=np.uint64)
        self.places = np.zeros((3, 0), dtype=np.int64)  # doc, th, at

    def settle(self, keys: np.ndarray, doc: np.ndarray, th: np.ndarray, at: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every row, whether its key stands earlier in this task, and where."""
        places = np.stack([doc, th, at])
        place = (rank << 32) | at
        first = _firsts((keys,), place)
        known, ref = place > place[first], places[:, first]
        hit = np.zeros(len(keys), dtype=np.int64)
        held = np.zeros(len(keys), dtype=bool)
        if len(self.keys):
            hit = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            held = self.keys[hit] == keys
        old = self.places[:, hit[held]]
        earlier = _before(old, ref[:, held])
        where = np.flatnonzero(held)[earlier]
        ref[:, where] = old[:, earlier]
        known[where] |= _before(ref[:, where], places[:, where])
        # what came up again is kept in mind, at its earliest place
        again = np.unique(np.concatenate([np.flatnonzero(held), first[known]]))
        names, which = np.unique(keys[again], return_index=True)
        kept = ~np.isin(self.keys, names)
        if kept.sum() + len(names) > HELD:
            kept[:] = False
            names, which = names[:HELD], which[:HELD]
        merged = np.concatenate([self.keys[kept], names])
        order = np.argsort(merged)
        self.keys, self.places = merged[order], np.concatenate([self.places[:, kept], ref[:, again[which]]], axis=1)[:, order]
        return known, ref[0], ref[2]


def _before(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[0] < b[0]) | ((a[0] == b[0]) & ((a[1] < b[1]) | ((a[1] == b[1]) & (a[2] < b[2]))))


def _several(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which rows have a key that comes with more than one value."""
    order = np.lexsort((values, keys))
    k, x = keys[order], values[order]
    split = np.flatnonzero((k[1:] == k[:-1]) & (x[1:] != x[:-1]))
    return np.isin(keys, k[split])


def _spread(doc: np.ndarray, th: np.ndarray, pack: np.ndarray) -> np.ndarray:
    """Keys that deal rows out evenly, for what is settled and meets no group."""
    return mix((doc ^ (th << 7) ^ pack).view(np.uint64))


def _block_rows(batches: Batches) -> Batches:
    earliest, marked = Earliest(), np.zeros(0, dtype=np.uint64)
    for batch in batches:
        if not batch.num_rows:
            continue
        docs, ths = np.asarray(batch.column("__lf_doc")), np.asarray(batch.column("__lf_th"))
        texts, found = batch.column("text").to_pylist(), []
        for a, b in chunks(texts):
            least, content, doc, at, size, state = _factors(texts[a:b])
            found.append((least, content, doc + a, at, size, state))
        least, content, of, at, size, state = (np.concatenate(x) for x in zip(*found, strict=True))
        doc, th, pack = docs[of], ths[of], (at << _N_BITS) | size
        known, ref_doc, ref_at = earliest.settle(mix(least + content * np.uint64(3)), doc, th, at, _ranks(docs, ths)[of])
        mixed = (_several(least, content) | np.isin(least, marked)) & ~known
        new = np.setdiff1d(least[mixed], marked)
        marked = np.union1d(marked, new)[-HELD:]
        state[mixed], state[known] = _MIXED, _KNOWN
        key = np.where(known, _spread(doc, th, pack), np.where(mixed, mix(least ^ mix(content)), least))
        content = np.where(known, ref_doc.view(np.uint64), content)
        more = np.zeros(len(new), dtype=np.int64)
        columns = ((key, new), (content, more.view(np.uint64)), (doc, more), (th, more), (pack, more), (np.where(known, ref_at, 0), more), (state, np.full(len(new), _MARK, dtype=np.int8)))
        yield pa.RecordBatch.from_arrays([pa.array(signed(x) if x.dtype == np.uint64 else x) for x in map(np.concatenate, columns)], names=["m", "c", "doc", "th", "pack", "ref_at", "state"])


def _boundary_rows(batches: Batches) -> Batches:
    """The windows of boundary blocks, one row each."""
    earliest = Earliest()
    for batch in batches:
        if not batch.num_rows:
            continue
        docs, ths = np.asarray(batch.column("__lf_doc")), np.asarray(batch.column("__lf_th"))
        texts, runs = batch.column("text").to_pylist(), batch.column("__lf_open").to_pylist()
        hashes, of, places = [], [], []
        for a, b in chunks(texts):
            windows, _, doc, _ = _windows(texts[a:b])
            base = np.searchsorted(doc, np.arange(b - a))
            for i in range(a, b):
                pack = np.array(sorted(set(runs[i])), dtype=np.int64)
                n = pack & _MAX_RUN
                at = np.repeat((pack >> _N_BITS) - np.cumsum(n) + n, n) + np.arange(n.sum())
                hashes.append(windows[base[i - a] + at])
                of.append(np.full(len(at), i))
                places.append(at)
        h, of_, at = np.concatenate(hashes), np.concatenate(of), np.concatenate(places)
        doc, th, pack = docs[of_], ths[of_], (at << _N_BITS) | 1
        known, ref_doc, ref_at = earliest.settle(h, doc, th, at, _ranks(docs, ths)[of_])
        key = np.where(known, _spread(doc, th, pack), h)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (signed(key), doc, th, pack, known, np.where(known, ref_doc, 0), np.where(known, ref_at, 0))], names=["h", "doc", "th", "pack", "known", "ref_doc", "ref_at"])


def mark_repeats(docs: DataFrame) -> DataFrame:
    """docs with the places of repeated windows, for the parse.

    Adds __lf_doc, __lf_th, __lf_runs and __lf_single; the last two hold places of
    blocks and windows that also start earlier, with the earlier place of each.
    """
    # null ids come first, each text by itself, so that they share no key
    null_id = F.lit(-(2**63)) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    keyed = docs.withColumns({"__lf_doc": F.coalesce(F.col("doc_id").cast("long"), null_id), "__lf_th": F.xxhash64("text")})
    where, known = F.struct("doc", "th", "pack"), F.col("state") == _KNOWN
    by_content, by_least = Window.partitionBy("m", "c"), Window.partitionBy("m")
    repeated = known | (where > F.col("first"))
    entry = F.struct("pack", F.when(known, F.col("c")).otherwise(F.col("first.doc")).alias("ref_doc"), F.when(known, F.col("ref_at")).otherwise(F.shiftright("first.pack", _N_BITS)).alias("ref_at"))
    several = (F.min("c").over(by_least) != F.max("c").over(by_least)) | F.max(F.col("state") == _MARK).over(by_least)
    blocks = (
        keyed.select(*_KEY, "text")
        .mapInArrow(_block_rows, "m long, c long, doc long, th long, pack long, ref_at long, state byte")
        # by minimiser first: what is dealt by it serves the look-up by content too
        .withColumn("open", several | F.col("state").isin(_MIXED, _REPEATS_ITSELF))
        .withColumn("first", F.min(F.when(F.col("state") != _MARK, where)).over(by_content))
        .filter(F.col("state") != _MARK)
        .select("doc", "th", "pack", F.when(repeated, entry).alias("repeated"), "open")
        .filter("repeated is not null or open")
    )
    found = settle(
        blocks.groupBy(F.col("doc").alias("__lf_doc"), F.col("th").alias("__lf_th")).agg(
            F.collect_list("repeated").alias("__lf_runs"),
            F.collect_list(F.when(F.col("repeated").isNull(), F.col("pack"))).alias("__lf_open"),
        )
    )
    dealt = keyed.repartition(*_KEY)  # used twice below; Spark shuffles it once
    settled = F.col("known")
    single = F.struct("pack", F.when(settled, F.col("ref_doc")).otherwise(F.col("first.doc")).alias("ref_doc"), F.when(settled, F.col("ref_at")).otherwise(F.shiftright("first.pack", _N_BITS)).alias("ref_at"))
    windows = (
        # all columns of dealt, so that both uses read one and the same shuffle
        dealt.join(found.filter(F.size("__lf_open") > 0).select(*_KEY, "__lf_open"), _KEY)
        .mapInArrow(_boundary_rows, "h long, doc long, th long, pack long, known boolean, ref_doc long, ref_at long")
        .withColumn("first", F.min(where).over(Window.partitionBy("h")))
        .filter(settled | (where > F.col("first")))
        .groupBy(F.col("doc").alias("__lf_doc"), F.col("th").alias("__lf_th"))
        .agg(F.collect_list(single).alias("__lf_single"))
    )
    return dealt.join(found.drop("__lf_open"), _KEY, "left").join(windows, _KEY, "left")


@dataclass
class Factors:
    """The factors of a document: first word, windows, and their place in the reference."""

    at: np.ndarray
    n: np.ndarray
    ref_doc: np.ndarray
    ref_at: np.ndarray


def parse(runs: list | None, single: list | None) -> Factors:
    """The greedy parse: what follows both in the document and in the reference
    document goes to one factor."""
    found = sorted({(e["pack"], e["ref_doc"], e["ref_at"]) for e in (*(runs or ()), *(single or ()))})
    pack, ref_doc, ref_at = np.array(found, dtype=np.int64).reshape(-1, 3).T
    at, n = pack >> _N_BITS, pack & _MAX_RUN
    new = np.ones(len(at), dtype=bool)
    new[1:] = (at[1:] != at[:-1] + n[:-1]) | (ref_doc[1:] != ref_doc[:-1]) | (ref_at[1:] != ref_at[:-1] + n[:-1])
    start = np.flatnonzero(new)
    return Factors(at[start], np.add.reduceat(n, start) if len(start) else n, ref_doc[start], ref_at[start])


def parse_documents(docs: DataFrame) -> DataFrame:
    """The factors of every row of docs(doc_id, text): doc_id, start and n_words of
    the span, ref_doc (null for a document of null id) and ref_start of its source."""

    def rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, out = batch.column("doc_id").to_pylist(), []
        for i, runs, single in zip(ids, batch.column("__lf_runs").to_pylist(), batch.column("__lf_single").to_pylist(), strict=True):
            f = parse(runs, single)
            out += zip([i] * len(f.at), f.at.tolist(), (f.n + WINDOW - 1).tolist(), [x if x >= -(2**62) else None for x in f.ref_doc.tolist()], f.ref_at.tolist(), strict=True)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)], names=["doc_id", "start", "n_words", "ref_doc", "ref_start"])

    marked = mark_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return arrow_map(marked.select("doc_id", "__lf_runs", "__lf_single"), rows, "doc_id long, start long, n_words long, ref_doc long, ref_start long")


def _kept(n_words: int, runs: list | None, single: list | None) -> np.ndarray | None:
    """Which words no factor covers; None where that is all."""
    if not runs and not single:
        return None
    factors = parse(runs, single)
    cover = np.zeros(n_words + 1, dtype=np.int64)
    np.add.at(cover, factors.at, 1)
    np.add.at(cover, factors.at + factors.n + WINDOW - 1, -1)
    return np.cumsum(cover[:-1]) == 0


def _digests(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    out = []
    for text, runs, single in zip(batch.column("text").to_pylist(), batch.column("__lf_runs").to_pylist(), batch.column("__lf_single").to_pylist(), strict=True):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        kept = _kept(len(words), runs, single)
        left = words if kept is None else list(compress(words, kept))
        out.append((len(words), len(words) - len(left), hashlib.sha256(b" ".join(left)).hexdigest()))
    n, gone, sha = zip(*out, strict=True)
    yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def repeat_digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of docs(doc_id, text)."""
    marked = mark_repeats(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return arrow_map(marked.select("doc_id", "text", "__lf_runs", "__lf_single"), _digests, "doc_id long, n_words long, n_removed long, kept_sha256 string")


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _cut(text: str, runs: list | None, single: list | None) -> str:
    raw = text.encode("utf-8", "surrogatepass")
    spans = [m.span() for m in _WORD.finditer(raw)]
    kept = _kept(len(spans), runs, single)
    if kept is None:
        return text
    parts, at = [], 0
    for i, (a, b) in enumerate(spans):
        if not kept[i]:  # the word goes with the space before it
            at = b
        else:
            parts.append(raw[at:b])
            at = b
    return (b"".join(parts) + raw[at:]).decode("utf-8", "surrogatepass")


def cut_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated words cut from text and n_chars (if there) set anew."""
    marked = mark_repeats(docs)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    names = docs.columns

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        runs, single = batch.column("__lf_runs").to_pylist(), batch.column("__lf_single").to_pylist()
        texts = batch.column("text").to_pylist()
        texts = [t if t is None or not (r or s) else _cut(t, r, s) for t, r, s in zip(texts, runs, single, strict=True)]
        columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    out = arrow_map(marked.select(*docs.columns, "__lf_runs", "__lf_single"), cut, schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
