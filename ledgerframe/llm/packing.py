"""Packing token pieces into windows by best-fit decreasing.

Documents are tokenised whole and ended by END_ID. Those longer than a window
are first cut into full windows; what remains is placed by falling length into
the open window with the tightest room, found by a segment tree over remaining
capacities. Pieces are dealt at random (by hash) over groups of about
GROUP_PIECES, each packed by one task: the number of groups follows the data,
and with thousands of windows to choose from a group loses next to nothing.

All token ids come from the tokenizers library as it loads the vocabulary. For
speed texts are cut into segments where the vocabulary's pattern always ends a
token and no added token can lie: after a letter before an ASCII character that is
none, and before a single space. Each different segment is encoded by the library
once while a bounded memo of the worker has it; a text's ids are those of its
segments in order (tested against whole texts by an untouched tokenizer).

Results in special cases: a null or empty text is END_ID alone; rows of a
repeated doc_id are packed each; a document of exactly a window is one full
piece; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Batches, settle
from .words import chunks, prefix_sums, span_hash

WINDOW, END_ID, GROUP_PIECES = 2048, 1, 20_000


@lru_cache(maxsize=2)
def _tokenizer(path: str | None):
    import public_tokenizers
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has its own core, no more

    return Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))


#: Segments that each half of a worker's memo holds at most, about (some 200 bytes
#: each), and the longest it takes, in bytes.
MEMO_SEGMENTS, MEMO_BYTES = 150_000, 64
#: Characters of texts that are encoded together, about, and segments that the library
#: encodes at once. Both bound what a worker holds, some 40 bytes a character and 1000
#: bytes a segment.
CHUNK_CHARS, LIBRARY_SEGMENTS = 700_000, 10_000

_BYTES = np.arange(256)
_IS_LETTER = np.isin(_BYTES, list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))
_IS_SPACE = np.isin(_BYTES, list(b" \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f"))
#: First bytes of two-byte characters that are no white space; of those of the first
#: of them, two are no letters.
_LEADS = (_BYTES >= 0xC3) & (_BYTES <= 0xDF)
_LATIN_LEAD, _LATIN_SIGNS = 0xC3, (0x97, 0xB7)


def may_cut(data: np.ndarray) -> np.ndarray:
    """Of every UTF-8 byte but the first, whether a text may be cut before it.

    Added tokens hold '|' after letters, and no space, so they are never cut.
    """
    before, at = data[:-1], data[1:]
    lead = np.zeros(len(before), dtype=np.uint8)
    lead[1:] = before[:-1]
    two_bytes = (before >= 0x80) & _LEADS[lead]
    letter = _IS_LETTER[before] | (two_bytes & (lead == _LATIN_LEAD) & ~np.isin(before, _LATIN_SIGNS))
    after_letter = letter & (at < 0x80) & ~_IS_LETTER[at] & (at != ord("|"))
    follows = np.zeros(len(at), dtype=np.uint8)
    follows[:-1] = at[1:]
    starts_word = (follows > 0) & ((follows < 0x80) & ~_IS_SPACE[follows] | _LEADS[follows])
    single_space = (at == 0x20) & starts_word & ((before < 0x80) & ~_IS_SPACE[before] | two_bytes)
    return after_letter | single_space


def _places(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every run, one run after the other."""
    kind = np.int32 if int(size.sum()) + int(start.max(initial=0)) < 2**31 else np.int64
    out = np.repeat((start - np.cumsum(size) + size).astype(kind), size)
    out += np.arange(len(out), dtype=kind)
    return out


class Encoder:
    """Token ids of whole texts, with a memo of segments. When the memo is full, its
    older half goes; what was looked up since is in the other."""

    def __init__(self, path: str | None = None) -> None:
        self.library = _tokenizer(path)
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _ids(self, segments: list[bytes]) -> list[bytes]:
        """Of every segment its ids, as bytes."""
        if len(self.memo) > MEMO_SEGMENTS:
            self.older, self.memo = self.memo, {}
        unseen = [x for x in segments if x not in self.memo]
        self.memo.update((x, self.older[x]) for x in unseen if x in self.older)
        new = [x for x in unseen if x not in self.memo]
        found: dict[bytes, bytes] = {}
        for a in range(0, len(new), LIBRARY_SEGMENTS):
            some = new[a : a + LIBRARY_SEGMENTS]
            found.update(zip(some, (array("I", e.ids).tobytes() for e in self.library.encode_batch_fast([x.decode() for x in some], add_special_tokens=False)), strict=True))
        self.memo.update((x, ids) for x, ids in found.items() if len(x) <= MEMO_BYTES)
        return [found[x] if x in found else self.memo[x] for x in segments]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of every text; null and empty ones have none."""
        parts = [(t or "").encode() for t in texts]
        raw = b"\n".join(parts) + b"\n"
        data = np.frombuffer(raw, dtype=np.uint8)
        text = np.zeros(len(parts) + 1, dtype=np.int64)  # each ends by the line feed that joins it to the next
        np.cumsum([len(p) + 1 for p in parts], out=text[1:])
        cuts = np.append(True, may_cut(data))
        cuts[text[:-1]] = True
        start = np.flatnonzero(cuts)
        of = np.searchsorted(text, start, side="right") - 1
        end = np.minimum(np.append(start[1:], len(raw)), text[of + 1] - 1)
        start, end = np.minimum(start, end), end
        keys = span_hash(prefix_sums(np.add(data, 1, dtype=np.uint64)), start, end)
        _, first, which = np.unique(keys, return_index=True, return_inverse=True)
        size = end - start
        if (size[first][which] != size).any() or (data[_places(start[first][which], size)] != data[_places(start, size)]).any():  # two segments of one hash
            first, which = np.arange(len(start)), np.arange(len(start))
        ids = self._ids([raw[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)])
        flat, n = np.frombuffer(b"".join(ids), dtype="<u4"), np.array([len(x) // 4 for x in ids], dtype=np.int64)
        place, n = (np.cumsum(n) - n)[which], n[which]
        out = flat[_places(place, n)]
        return np.split(out, np.cumsum(np.bincount(of, weights=n, minlength=len(parts)).astype(np.int64))[:-1])


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    """One encoder for each worker process; tasks that follow share its memo."""
    return Encoder(path)


def encode(text: str | None, tokenizer: str | None = None) -> list[int]:
    """Token ids of one whole text."""
    return encoder(tokenizer).encode([text])[0].tolist()


def piece_rows(batches: Batches, tokenizer: str | None = None) -> Batches:
    """Rows of token_pieces, from batches of doc_id and text."""
    own = encoder(tokenizer)
    for batch in batches:
        out: list[tuple[int, int, int, int, int]] = []
        texts = batch.column("text").to_pylist()
        for a, b in chunks(texts, CHUNK_CHARS):
            for i, found in enumerate(own.encode(texts[a:b]), start=a):
                ids = np.append(found, np.array([END_ID], dtype="<u4"))
                out += [(i, k, len(part := ids[k : k + WINDOW]), zlib.crc32(part.tobytes()), len(ids)) for k in range(0, len(ids), WINDOW)]
        of, *columns = zip(*out, strict=True) if out else [()] * 6
        arrays = [batch.column("doc_id").take(pa.array(of, pa.int64())), *(pa.array(c, pa.int64()) for c in columns), pa.array(range(len(out)), pa.int64())]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "n"])


def token_pieces(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32 and doc_tokens of every piece of docs(doc_id, text)."""

    def rows(batches: Batches) -> Batches:
        return piece_rows(batches, tokenizer)

    rows_in = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows_in.mapInArrow(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, n long")


class RoomTree:
    """Open windows by remaining capacity; a segment tree of counts finds the
    least capacity that holds a piece."""

    def __init__(self, window: int = WINDOW) -> None:
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, capacity: int, by: int) -> None:
        i = capacity + self.leaves
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, window: int, capacity: int) -> None:
        self.open[capacity].append(window)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """A window with the least capacity of need or more, and that capacity."""
        i, count = need + self.leaves, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):  # climb to a right sibling that has some
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._add(capacity, -1)
        return self.open[capacity].pop(), capacity


def best_fit(lengths: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(window, offset) of every piece; lengths must fall."""
    tree, out, n = RoomTree(window), [], 0
    for length in lengths:
        found = tree.take(length)
        if found is None:
            found = n, window
            n += 1
        at, room = found
        out.append((at, window - room))
        if room > length:
            tree.put(at, room - length)
    return out


def pack(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id and offset."""
    pieces = settle(token_pieces(docs, tokenizer))
    groups = max(1, -(-pieces.count() // GROUP_PIECES))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True])
        at = np.array(best_fit(group["length"].tolist()), dtype=np.int64).reshape(-1, 2)
        return group[names].assign(sequence_id=at[:, 0] * groups + group["g"].to_numpy(), offset=at[:, 1])

    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", "n"), F.lit(groups)))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return dealt.groupBy("g").applyInPandas(place, schema)
