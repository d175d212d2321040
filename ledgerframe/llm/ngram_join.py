"""N-gram Jaccard self-join by a MinHash LSH forest and exact verification.

Two texts are linked if the sets of their five-word shingles have a Jaccard
similarity of 4/5 or more. Each distinct text gets a label of MAX_DEPTH MinHash
values per tree. The labels of all trees are sorted, so that a trie's node is a run
of leaves with one prefix. One pass over the runs counts the pairs under the nodes
of every tree and depth. Matched prefixes start at MAX_DEPTH and are then shortened,
each time in the tree where that adds the fewest pairs for what it adds to recall,
until a pair just at the threshold is found with TARGET_RECALL or more. (Depths go
by a tree's totals: if they went by a text's own matches, the choice would depend on
the pairs sought, and the bound would not hold.) Texts under a node of their tree's
depth are candidates.

Edges to the first text of every run, of which there are no more than leaves, join
candidates into components. Verification on the whole shingle sets goes by component
where that takes no more pairs than its nodes have together, and else by node, so
chains of copies cost what their nodes do; a pair under several nodes counts in one.
Units of either kind share tasks while small and are dealt out in pairs of bounded
blocks where large. A task returns link counts and a spanning forest, one row per
text and unit. Copies are one text until the end; a text's identity is its md5.

Results in special cases: texts of one to four words have one shingle, all
their words; texts without a word (null ones too) have no link and are their own
class; a null doc_id takes part; repeated rows count as copies; other columns of
docs are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .common import Batches, arrow_map, settle
from .components import components, with_group
from .words import chunks, mix, signed, span_hash, prefix_sums, split_words, window_hash

SHINGLE = 5
#: The least similarity, as a fraction.
NUMERATOR, DENOMINATOR = 4, 5
TREES, MIN_DEPTH, MAX_DEPTH, TARGET_RECALL = 16, 3, 8, 0.998
#: Leaves of the sorted tries that one task holds, about.
TASK_LEAVES = 1_000_000
#: Shingles and texts that one block of a component holds at most, about.
BLOCK_SHINGLES, BLOCK_TEXTS = 400_000, 1000
_COLUMNS = 2048
_NULL_ID = -(2**63)


def choose_depths(pairs: np.ndarray, target: float = TARGET_RECALL) -> np.ndarray:
    """The depth of every tree from its pairs (trees x depths from MIN_DEPTH on):
    prefixes are shortened until a pair at the threshold is found with the target."""
    found = (NUMERATOR / DENOMINATOR) ** np.arange(MIN_DEPTH, MAX_DEPTH + 1)
    missed = np.log1p(-found)  # of a tree that stands at each depth
    at = np.full(len(pairs), len(found) - 1)
    while missed[at].sum() > math.log(1 - target) and at.any():
        trees = np.flatnonzero(at)
        added = pairs[trees, at[trees] - 1] - pairs[trees, at[trees]] + 1.0
        gained = missed[at[trees]] - missed[at[trees] - 1]
        at[trees[(added / gained).argmin()]] -= 1
    return at + MIN_DEPTH


def _shingles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles in order, and their bounds by document."""
    w = split_words(texts)
    hashes = w.hashes()
    n_words = np.diff(w.bounds)
    n = np.where(n_words >= SHINGLE, n_words - SHINGLE + 1, np.minimum(n_words, 1))
    bounds = np.zeros(len(n) + 1, dtype=np.int64)
    np.cumsum(n, out=bounds[1:])
    out = np.zeros(bounds[-1], dtype=np.uint64)
    long = np.repeat(n_words >= SHINGLE, n)
    if long.any():
        at = np.arange(bounds[-1]) - np.repeat(bounds[:-1], n) + np.repeat(w.bounds[:-1], n)
        out[long] = window_hash(hashes, SHINGLE)[at[long]]
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):
        out[bounds[short]] = span_hash(prefix_sums(hashes), w.bounds[short], w.bounds[short + 1])
    return out, bounds


def _labels(shingles: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Every document's label, MAX_DEPTH values of two bytes for each tree; for
    documents with a shingle."""
    random = np.random.Generator(np.random.PCG64(7))
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(starts), TREES * MAX_DEPTH), dtype=">u2")
    for i in range(out.shape[1] if len(starts) else 0):
        flip, factor = random.integers(0, 2**63, 2, dtype=np.uint64)
        out[:, i] = mix(np.minimum.reduceat((shingles ^ flip) * (factor | np.uint64(1)), starts)) >> np.uint64(48)
    return out


def _signature_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    texts = batch.column("text").to_pylist()
    for a, b in chunks(texts):
        shingles, bounds = _shingles(texts[a:b])
        n = np.diff(bounds)
        labels = iter(_labels(shingles, bounds))
        column = pa.array([next(labels).tobytes() if x else None for x in n], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("v").slice(a, b - a), batch.column("doc").slice(a, b - a), pa.array(n, pa.int64()), column], names=["v", "doc", "k", "label"])


_LEAF_BYTES = 1 + 2 * MAX_DEPTH


class Leaves:
    """A task's part of the sorted tries: leaves (tree, label) and their texts."""

    def __init__(self, batches: Batches) -> None:
        held = [(b.column("leaf"), b.column("v")) for b in batches if b.num_rows]
        self.v = pa.concat_arrays([x for _, x in held]) if held else pa.array([], pa.binary())
        self.names = self.v.to_pylist()
        raw = b"".join(x for leaf, _ in held for x in leaf.to_pylist())
        self.leaf = np.frombuffer(raw, dtype=np.uint8).reshape(-1, _LEAF_BYTES)
        differ = self.leaf[1:] != self.leaf[:-1]
        same = np.where(differ.any(axis=1), differ.argmax(axis=1), _LEAF_BYTES)
        #: depth of the prefix shared with the leaf before; -1 for another tree
        self.shared = np.append(-1, (same - 1) >> 1) if len(self.leaf) else same
        self.tree = self.leaf[:, 0].astype(np.int64)
        values = np.ascontiguousarray(self.leaf[:, 1:]).view(">u2").astype(np.uint64)
        key = mix(self.tree.astype(np.uint64) + np.uint64(1))
        self.nodes = {}
        for d in range(1, MAX_DEPTH + 1):
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, d - 1])
            self.nodes[d] = key

    def runs(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """First leaf and length of every node's run at a depth."""
        start = np.flatnonzero(self.shared < depth)
        return start, np.diff(np.append(start, len(self.leaf)))

    def heads(self, start: np.ndarray, size: np.ndarray) -> list[bytes]:
        return [min(self.names[a : a + n]) for a, n in zip(start.tolist(), size.tolist(), strict=True)]


def _count_pairs(batches: Batches) -> Batches:
    """Pairs under the task's nodes by tree and depth; nodes at its ends one by one,
    as other tasks can have leaves of them too."""
    leaves, out = Leaves(batches), []
    for d in range(MIN_DEPTH, MAX_DEPTH + 1) if len(leaves.leaf) else ():
        start, size = leaves.runs(d)
        ends = sorted({0, len(start) - 1})
        heads = leaves.heads(start[ends], size[ends])
        out += [(int(leaves.tree[start[i]]), d, int(signed(leaves.nodes[d][start[i : i + 1]])[0]), int(size[i]), head) for i, head in zip(ends, heads, strict=True)]
        inner = np.ones(len(start), dtype=bool)
        inner[ends] = False
        pairs = np.bincount(leaves.tree[start[inner]], weights=size[inner].astype(float) * (size[inner] - 1) / 2, minlength=TREES)
        out += [(t, d, None, int(n), None) for t, n in enumerate(pairs) if n]
    if out:
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["tree", "depth", "node", "n", "head"])


def _member_rows(depths: np.ndarray, spread: dict[int, tuple[int, bytes]]):
    """(v, node, size, head) of every leaf that is not alone under its node; spread has
    size and head of the nodes whose leaves are in several tasks."""

    def rows(batches: Batches) -> Batches:
        leaves = Leaves(batches)
        for tree in range(TREES):
            mine = leaves.tree == tree
            if not mine.any():
                continue
            start, size = leaves.runs(int(depths[tree]))
            own = mine[start]
            start, size = start[own], size[own]
            node = signed(leaves.nodes[int(depths[tree])][start])
            known = [spread.get(x) for x in node.tolist()] if spread else [None] * len(node)
            several = (size > 1) | np.array([x is not None for x in known])
            start, size, node, known = start[several], size[several], node[several], [x for x, s in zip(known, several, strict=True) if s]
            if not len(start):
                continue
            heads = [h if x is None else x[1] for h, x in zip(leaves.heads(start, size), known, strict=True)]
            total = np.array([n if x is None else x[0] for n, x in zip(size.tolist(), known, strict=True)], dtype=np.int64)
            at = np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())
            which = np.repeat(np.arange(len(start)), size)
            yield pa.RecordBatch.from_arrays([leaves.v.take(pa.array(at)), pa.array(node[which]), pa.array(total[which]), pa.array(heads, pa.binary()).take(pa.array(which))], names=["v", "node", "size", "head"])

    return rows


def candidate_rows(reps: DataFrame) -> DataFrame:
    """(v, node, size, head): the nodes of the forest that each text of
    reps(v, label) is a candidate under, with the node's leaves and first text."""
    spark = reps.sparkSession
    n = reps.filter("label is not null").count()
    leaf = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.concat(F.substring(F.unhex(F.hex(t)), -1, 1), F.substr(F.col("label"), t * (2 * MAX_DEPTH) + 1, F.lit(2 * MAX_DEPTH))))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * TREES // TASK_LEAVES))
    order = ["leaf", "v"]  # no two rows are equal, so ranges are even whatever the labels
    tries = cut(reps.filter("label is not null").select(F.explode(leaf).alias("leaf"), "v").repartitionByRange(tasks, *order).sortWithinPartitions(*order))
    counted = settle(tries.mapInArrow(_count_pairs, "tree int, depth int, node long, n long, head binary"))
    ends = counted.filter("node is not null").groupBy("tree", "depth", "node").agg(F.sum("n").alias("n"), F.min("head").alias("head"), F.count("*").alias("tasks"))
    pairs = np.zeros((TREES, MAX_DEPTH - MIN_DEPTH + 1))
    whole = counted.filter("node is null").select("tree", "depth", F.col("n").cast("double").alias("pairs"))
    for r in whole.union(ends.select("tree", "depth", F.col("n").cast("double") * (F.col("n") - 1) / 2)).groupBy("tree", "depth").agg(F.sum("pairs").alias("pairs")).collect():
        pairs[r["tree"], r["depth"] - MIN_DEPTH] = r["pairs"]
    depths = choose_depths(pairs)
    # at most a node for every depth and end of a task
    known = {r["node"]: (r["n"], bytes(r["head"])) for r in ends.filter("tasks > 1").collect() if depths[r["tree"]] == r["depth"]}
    return tries.mapInArrow(_member_rows(depths, known), "v binary, node long, size long, head binary")


def _set_rows(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Every text's set of shingles, sorted, as bytes."""
    texts = batch.column("text").to_pylist()
    for a, b in chunks(texts):
        shingles, bounds = _shingles(texts[a:b])
        sets = [np.unique(shingles[bounds[i] : bounds[i + 1]]).tobytes() for i in range(b - a)]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(a, b - a) for c in names), pa.array(sets, pa.binary())], names=[*names, "sets"])


def _linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Which of the texts left (rows) and right (columns) are similar."""
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.full((len(left), len(right)), np.count_nonzero(count == len(sets)), dtype=np.float32)
    some = (count > 1) & (count < len(sets))
    name = np.cumsum(some) - 1
    held = some[column]
    row, column = row[held], name[column[held]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    cuts = np.searchsorted(column, np.arange(0, some.sum() + _COLUMNS, _COLUMNS))
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        if a < b:
            part = np.zeros((len(sets), _COLUMNS), dtype=np.float32)
            part[row[a:b], column[a:b] - k * _COLUMNS] = 1
            common += part[left] @ part[right].T
    both = sizes[left][:, None] + sizes[right][None, :]
    return (NUMERATOR + DENOMINATOR) * common.astype(np.int64) >= NUMERATOR * both


def _roots(linked: np.ndarray) -> np.ndarray:
    """For a symmetric relation, the first member of everyone's component."""
    n = len(linked)
    label = np.arange(n)
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], n).min(axis=1, initial=n))
        least = least[least]
        if (least == label).all():
            return label
        label = least


def _elsewhere(unit: int, nodes: list) -> np.ndarray | None:
    """Which texts share a node that comes before the unit, a node itself: those
    pairs count there. None if the unit is a component."""
    if nodes[0] is None:
        return None
    listed = [set(int(x) for x in n if x < unit) for n in nodes]
    names = {x: i for i, x in enumerate(sorted(set().union(*listed)))}
    held = np.zeros((len(nodes), len(names)), dtype=np.float32)
    for i, own in enumerate(listed):
        held[i, [names[x] for x in own]] = 1
    return held @ held.T > 0


def _verify(v: np.ndarray, w: np.ndarray, sets: list[np.ndarray], block: np.ndarray | None, elsewhere: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Link counts and roots of one unit, or of one pair of its blocks."""
    n = len(v)
    if n == 2 and block is None:
        common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        if (NUMERATOR + DENOMINATOR) * common >= NUMERATOR * (len(sets[0]) + len(sets[1])):
            return w[::-1] * (elsewhere is None or not elsewhere[0, 1]), np.array([v.min()] * 2, dtype=object)
        return np.zeros(2, dtype=np.int64), v
    if block is None:
        linked = _linked(sets, np.arange(n), np.arange(n))
        np.fill_diagonal(linked, False)
    else:
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block != block.min())
        linked = np.zeros((n, n), dtype=bool)
        linked[np.ix_(left, right)] = _linked(sets, left, right)
        linked |= linked.T
    counted = linked if elsewhere is None else linked & ~elsewhere
    return counted @ w, v[_roots(linked)]


def _verified(group: pd.DataFrame) -> pd.DataFrame:
    """All units of a bin, or one pair of blocks; texts in order of v."""
    group = group.drop_duplicates(["unit", "v"]).sort_values(["unit", "v"])
    v, w, unit, nodes = (group[c].to_numpy() for c in ("v", "w", "unit", "nodes"))
    sets = [np.frombuffer(s, dtype=np.uint64) for s in group["sets"]]
    pair = group["i"].iloc[0] != group["j"].iloc[0]
    links, roots = np.zeros(len(v), dtype=np.int64), v.copy()
    starts = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
    for a, b in zip(starts, np.append(starts[1:], len(v)), strict=True):
        block = group["b"].to_numpy() if pair else None
        if b - a > 1 and not (pair and (block == block[0]).all()):
            links[a:b], roots[a:b] = _verify(v[a:b], w[a:b], sets[a:b], block, _elsewhere(int(unit[a]), list(nodes[a:b])))
    return pd.DataFrame({"v": v, "links": links, "root": roots})


def _identity(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(_identity(F.col("text")).alias("v"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID)).alias("doc"), "text")


def verification_units(members: DataFrame) -> DataFrame:
    """members(v, comp, nodes, pairs, ...) once for every unit in which its pairs are
    verified: its component, with nodes null, if all pairs of that are no more than
    pairs (of its nodes, summed up), else each of its nodes."""
    sized = with_group(members, "comp", "v", {"n": F.count("*"), "under": F.sum("pairs")})
    dense = F.col("n") * F.col("n") <= F.col("under")
    units = F.when(dense, F.array(F.xxhash64("comp"))).otherwise(F.col("nodes"))
    return sized.withColumns({"unit": F.explode(units), "nodes": F.when(~dense, F.col("nodes"))}).drop("n", "under")


def text_classes(docs: DataFrame) -> DataFrame:
    """One row per distinct text: v (its md5), doc (its first doc_id), w (rows
    with it), k (shingles, repeats counted), links (rows of other texts that it
    is linked to) and root (one v for all that links connect)."""
    reps = settle(
        arrow_map(_texts(docs), _signature_rows, "v binary, doc long, k long, label binary")
        .groupBy("v")
        .agg(F.coalesce(F.min(F.when(F.col("doc") != _NULL_ID, F.col("doc"))), F.lit(_NULL_ID)).alias("doc"), F.count("*").alias("w"), F.first("k").alias("k"), F.first("label").alias("label"))
    )
    under = settle(candidate_rows(reps))
    star = components(under.select(F.col("v").alias("a"), F.col("head").alias("b")))
    member_of = star.select(F.col("a").alias("v"), F.col("b").alias("comp")).union(star.select(F.col("b").alias("v"), F.col("b").alias("comp")).distinct())
    per_text = under.groupBy("v").agg(F.collect_list("node").alias("nodes"), F.sum("size").alias("pairs"))
    units = settle(verification_units(member_of.join(per_text, "v").join(reps.drop("label"), "v")))
    blocks = F.greatest(F.ceil(F.sum("k") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_TEXTS)).cast("int")
    total = units.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    bins = max(1, -(-total // BLOCK_SHINGLES))
    sets = arrow_map(
        with_group(units, "unit", "v", {"nb": blocks}).select("v", "doc", "w", "unit", "nodes", "nb").join(_texts(docs), ["v", "doc"]).select("v", "w", "unit", "nodes", "nb", "text"),
        _set_rows,
        "v binary, w long, unit long, nodes array<long>, nb int, sets binary",
    )
    own = F.pmod(F.xxhash64("v", F.lit(1)), F.col("nb")).cast("int")
    dealt = (
        sets.withColumn("b", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("v", "w", "unit", "nodes", "sets", "b", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), F.when(F.col("nb") > 1, F.col("unit")).otherwise(F.pmod(F.xxhash64("unit"), F.lit(bins))).alias("bin"), (F.col("nb") > 1).alias("large"))
    )
    verified = settle(dealt.groupBy("large", "bin", "i", "j").applyInPandas(_verified, "v binary, links long, root binary"))
    roots = components(verified.select(F.col("v").alias("a"), F.col("root").alias("b"))).select(F.col("a").alias("v"), F.col("b").alias("root"))
    counts = verified.groupBy("v").agg(F.sum("links").alias("links"))
    return (
        reps.drop("label")
        .join(counts, "v", "left")
        .join(roots, "v", "left")
        .select("v", "doc", "w", "k", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "v").alias("root"))
    )


def ngram_join(docs: DataFrame) -> DataFrame:
    """One row per row of docs(doc_id, text): doc_id, class_id (the smallest
    doc_id that links connect it to), n_links (other rows that it is linked to,
    copies included) and text_id (the smallest doc_id with this very text)."""
    per_text = settle(text_classes(docs))
    known = per_text.withColumn("known", F.when(F.col("doc") != _NULL_ID, F.col("doc")))
    classed = with_group(known, "root", "v", {"class_id": F.min("known")})
    joined = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _identity(F.col("text")).alias("v")).join(classed, "v")
    worded = F.col("k") > 0
    return joined.select(
        "doc_id",
        F.when(worded, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(worded, F.col("links") + F.col("w") - 1).otherwise(F.lit(0).cast("long")).alias("n_links"),
        F.when(worded, F.col("known")).otherwise(F.col("doc_id")).alias("text_id"),
    )


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of every class (the one of the smallest doc_id), and
    every row without a word."""
    per_text = settle(text_classes(docs))
    first = per_text.filter("k > 0").groupBy("root").agg(F.min(F.struct("doc", "v")).alias("first")).select(F.col("first.doc").alias("__lf_doc"), F.col("first.v").alias("__lf_v"))
    keyed = docs.withColumns({"__lf_v": _identity(F.col("text")), "__lf_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL_ID))})
    row = F.row_number().over(Window.partitionBy("__lf_v", "__lf_doc").orderBy("__lf_v"))
    worded = keyed.join(first, ["__lf_v", "__lf_doc"]).withColumn("__lf_row", row).filter("__lf_row = 1").select(docs.columns)
    return worded.union(keyed.filter(~F.coalesce(F.col("text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select(docs.columns))
