"""Exact top-k inner products by a Voronoi join.

Vectors get one more component, sqrt(M^2 - |x|^2) with M the largest norm (queries
0), after which a higher inner product is a smaller distance:

    |q' - x'|^2 = |q|^2 + M^2 - 2 <q, x>.

Pivots are about sqrt(n) rows of smallest id hash. Every vector belongs to the cell
of its nearest pivot in that space. A cell's summary (least and largest distance to
the pivot, the k + 1 smallest ones; the same without the added component) bounds
every inner product of a query with its vectors, by distances d from q':

- the triangle inequality: d(q', p) - largest <= d and least - d(q', p) <= d;
- the hyperplane between p and the query's own pivot o:
  (d(q', p)^2 - d(q', o)^2) / (2 d(p, o)) <= d;
- without the added component: <q, x> <= <q, p> + |q| largest.

The k + 1 nearest of all cells bound it from the other side, which gives a query its
floor; it needs only the cells whose bound reaches that.

Cells near each other are put together to slices of bounded size (a larger cell is
dealt over several), and the queries of near cells to groups of bounded size. A
query goes to the slices of the cells it needs, a slice to the groups with such a
query, and every (group, slice) pair is solved by itself; the best k of a query are
then merged by rank.

What reaches the driver is pivots and summaries, MAX_PIVOTS of them at most, and
the counts of rows by cell, whatever the data. Where bounds exclude nothing, as for
vectors of no structure in many dimensions, every query meets every vector once.

Results in special cases: vectors null, empty, or with a null or non-finite
component take no part; shorter vectors count as ended by zeros; equal scores
go to smaller ids; repeated rows are candidates each, except that no row with
the query's own id is; rows with a null id take no part; no vectors, no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Batches, arrow_map, settle

#: Pivots at most; queries of a group, and components of a slice, about.
MAX_PIVOTS, QUERY_GROUP, SLICE_COMPONENTS = 2048, 512, 1_000_000
#: What bounds allow for rounding, as a share of the largest norms.
SLACK = 1e-6
_SAFE = 2.0**52
_SCORES = "query_id long, vec_id long, score long"


def quantise(embedding: Column) -> Column:
    """floor(1024 x) of every component; null for vectors that take no part."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    whole = F.transform(embedding, lambda x: F.floor(x.cast("double") * 1024).cast("long"))
    return F.when(fine & (F.size(embedding) > 0), whole)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, ended by zeros."""
    lengths = np.diff(np.asarray(column.offsets))
    flat = np.asarray(column.flatten())
    out = np.zeros((len(column), width), dtype=np.int64)
    row = np.repeat(np.arange(len(column)), lengths)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; floats where they cannot round."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if most < _SAFE else a @ b.T


def _top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """The k best of a row of candidates: highest score, then smallest id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        among = np.flatnonzero(scores >= edge)
    else:
        among = np.arange(len(scores))
    return among[np.lexsort((ids[among], -scores[among]))[:k]]


@dataclass
class Space:
    """The pivots, with one more component, and the largest norm."""

    pivots: np.ndarray
    norm: float

    def lift(self, x: np.ndarray, query: bool) -> np.ndarray:
        x = x.astype(np.float64)
        rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(self.norm**2 - (x * x).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """To every pivot, within SLACK of the scale of norms."""
        squares = (x * x).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1)[None, :] - 2 * x @ self.pivots.T
        return np.sqrt(np.maximum(squares, 0))


@dataclass
class Cells:
    """Summaries of the cells that have rows, in the order of their pivots. The flat
    ones are of distances without the added component."""

    space: Space
    near: list[np.ndarray]
    least: np.ndarray
    most: np.ndarray
    near_flat: list[np.ndarray]
    most_flat: np.ndarray

    @cached_property
    def between(self) -> np.ndarray:
        """Distances between pivots."""
        return self.space.distances(self.space.pivots)

    def needed(self, q: np.ndarray, k: int) -> np.ndarray:
        """Which cells (columns) every lifted query (rows) needs."""
        far, norm = self.space.distances(q), np.sqrt((q * q).sum(axis=1))[:, None]
        scale = self.space.norm + norm + 1
        slack = SLACK * scale
        own = far.argmin(axis=1)
        between = self.between[own]
        apart = between > SLACK * self.space.norm
        plane = np.where(apart, (far**2 - far[np.arange(len(q)), own][:, None] ** 2) / (2 * np.where(apart, between, 1)), 0)
        least = np.maximum(np.maximum(far - self.most, self.least - far), plane) - slack
        inner = q @ self.space.pivots.T

        def product(distance: np.ndarray) -> np.ndarray:
            return (norm**2 + self.space.norm**2 - distance**2) / 2

        highest = np.minimum(product(np.maximum(least, 0)), inner + norm * self.most_flat)
        # of all cells' nearest vectors one more than k, as the query's own row may be among them
        reach = np.concatenate([product(far[:, [i]] + slack + near) for i, near in enumerate(self.near)], axis=1)
        flat = np.concatenate([inner[:, [i]] - norm * near for i, near in enumerate(self.near_flat)], axis=1)
        n = reach.shape[1]
        floor = np.maximum(np.partition(reach, n - k - 1, axis=1)[:, n - k - 1], np.partition(flat, n - k - 1, axis=1)[:, n - k - 1]) if n > k else np.full(len(q), -np.inf)
        return highest + slack * scale >= floor[:, None]


def _near_order(pivots: np.ndarray) -> np.ndarray:
    """Pivots in an order in which neighbours are near: always on to the nearest one left."""
    left, order = np.ones(len(pivots), dtype=bool), [0]
    left[0] = False
    for _ in range(len(pivots) - 1):
        far = ((pivots - pivots[order[-1]]) ** 2).sum(axis=1)
        order.append(int(np.where(left, far, np.inf).argmin()))
        left[order[-1]] = False
    return np.array(order)


def _bins(counts: np.ndarray, order: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """First bin and number of bins of every cell: cells in order share a bin up to
    the limit, a larger one is dealt over as many as it needs."""
    first, parts = np.zeros(len(counts), dtype=np.int64), np.ones(len(counts), dtype=np.int64)
    bin_, held = 0, 0
    for c in order:
        if held and held + counts[c] > limit:
            bin_, held = bin_ + 1, 0
        first[c], parts[c] = bin_, max(1, -(-int(counts[c]) // limit))
        held += int(counts[c])
        if parts[c] > 1:
            bin_, held = bin_ + int(parts[c]), 0
    return first, parts


@dataclass
class Dealt:
    """Queries and data as they are sent to (group g, slice s), with the schema
    vec_id long, v array<long>, g long, s long, and the width of vectors."""

    queries: DataFrame
    data: DataFrame
    width: int


def deal(vectors: DataFrame, is_query: Column, k: int) -> Dealt | None:
    """Deals queries and data out; None if there are none of either."""
    rows = settle(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "v", F.coalesce(is_query, F.lit(False)).alias("asks")).filter("vec_id is not null and v is not null"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max(F.size("v")).alias("width"), F.max(squares).alias("squares")).first()
    if not counts["n"] or not counts["q"]:
        return None
    width, norm = counts["width"], math.sqrt(counts["squares"]) * (1 + 1e-12)
    n_pivots = min(MAX_PIVOTS, math.isqrt(counts["n"] - 1) + 1)
    picked = rows.select("vec_id", "v").orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("v")).limit(n_pivots).collect()
    whole = np.zeros((len(picked), width), dtype=np.int64)
    for i, r in enumerate(picked):
        whole[i, : len(r["v"])] = r["v"]
    space = Space(np.zeros((0, width + 1)), norm)
    space.pivots = np.unique(space.lift(whole, False), axis=0)

    def assign(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = space.lift(_matrix(batch.column("v"), width), False)
        cell = space.distances(x).argmin(axis=1)
        squares = (x - space.pivots[cell]) ** 2
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(np.sqrt(squares.sum(axis=1))), pa.array(np.sqrt(squares[:, :-1].sum(axis=1)))], names=[*batch.schema.names, "cell", "distance", "flat"])

    celled = settle(arrow_map(rows, assign, "vec_id long, v array<long>, asks boolean, cell int, distance double, flat double"))

    def summarise(batches: Batches) -> Batches:
        kept: dict[int, list] = {}
        for batch in batches:
            cell, distance, flat = (np.asarray(batch.column(c)) for c in ("cell", "distance", "flat"))
            for c in np.unique(cell).tolist():
                n, most, most_flat, near, near_flat = kept.get(c, (0, 0.0, 0.0, distance[:0], flat[:0]))
                x, y = distance[cell == c], flat[cell == c]
                kept[c] = [n + len(x), max(most, float(x.max())), max(most_flat, float(y.max())), np.sort(np.append(near, x))[: k + 1], np.sort(np.append(near_flat, y))[: k + 1]]
        if kept:
            n, most, most_flat, near, near_flat = zip(*kept.values(), strict=True)
            lists = [pa.array([x.tolist() for x in xs], pa.list_(pa.float64())) for xs in (near, near_flat)]
            yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int32()), pa.array(n, pa.int64()), pa.array(most), pa.array(most_flat), *lists], names=["cell", "n", "most", "most_flat", "near", "near_flat"])

    parts = celled.select("cell", "distance", "flat").mapInArrow(summarise, "cell int, n long, most double, most_flat double, near array<double>, near_flat array<double>")
    smallest = (F.slice(F.sort_array(F.flatten(F.collect_list(c))), 1, k + 1).alias(c) for c in ("near", "near_flat"))
    found = parts.groupBy("cell").agg(F.sum("n").alias("n"), F.max("most").alias("most"), F.max("most_flat").alias("most_flat"), *smallest).orderBy("cell").collect()
    used = np.array([c["cell"] for c in found])
    cells = Cells(Space(space.pivots[used], norm), [np.array(c["near"]) for c in found], np.array([c["near"][0] for c in found]), np.array([c["most"] for c in found]), [np.array(c["near_flat"]) for c in found], np.array([c["most_flat"] for c in found]))
    order = _near_order(cells.space.pivots)
    first, pieces = _bins(np.array([c["n"] for c in found]), order, max(1, SLICE_COMPONENTS // width))

    # a query's own cell, by its own nearest pivot, sets its group
    def home(q: np.ndarray) -> np.ndarray:
        return cells.space.distances(q).argmin(axis=1)

    def homes(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cell, n = np.unique(home(space.lift(_matrix(batch.column("v"), width), True)), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(n, pa.int64())], names=["home", "n"])

    asking = celled.filter("asks").select("vec_id", "v")
    asked = np.zeros(len(used), dtype=np.int64)
    for r in arrow_map(asking.select("v"), homes, "home long, n long").groupBy("home").agg(F.sum("n").alias("n")).collect():
        asked[r["home"]] = r["n"]
    group, shares = _bins(asked, order, QUERY_GROUP)
    n_slices = int((first + pieces).max())

    def send(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for a in range(0, batch.num_rows, 64):
            part = batch.slice(a, 64)
            q = space.lift(_matrix(part.column("v"), width), True)
            at, mix = home(q), np.asarray(part.column("h"))
            g = group[at] + np.mod(mix, shares[at])
            wanted = np.zeros((len(q), n_slices), dtype=bool)
            row, cell = np.nonzero(cells.needed(q, k))
            several = pieces[cell]
            bins = np.repeat(first[cell] - np.cumsum(several) + several, several) + np.arange(several.sum())
            wanted[np.repeat(row, several), bins] = True
            row, s = np.nonzero(wanted)
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(row)) for c in ("vec_id", "v")), pa.array(g[row], pa.int64()), pa.array(s, pa.int64())], names=["vec_id", "v", "g", "s"])

    hashed = F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(1 << 40))
    queries = settle(arrow_map(asking.withColumn("h", hashed), send, "vec_id long, v array<long>, g long, s long"))
    spark = rows.sparkSession
    places = F.broadcast(spark.createDataFrame([(int(c), int(a), int(b)) for c, a, b in zip(used, first, pieces, strict=True)], "cell int, first long, pieces long"))
    sliced = celled.select("vec_id", "v", "cell").join(places, "cell").select("vec_id", "v", (F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("pieces"))).alias("s"))
    pairs = queries.select(F.col("g").alias("to"), F.col("s").alias("of")).distinct()
    data = sliced.join(pairs, F.col("s") == F.col("of")).select("vec_id", "v", F.col("to").alias("g"), "s")
    return Dealt(queries, data, width)


def knn_join(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of every query's k highest inner products.

    vectors(vec_id, v): v as quantise gives it. is_query: a condition on vec_id.
    """
    dealt = deal(vectors, is_query, k)
    if dealt is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width = dealt.width

    def solve(q: pa.Table, x: pa.Table) -> pa.Table:
        out: list[tuple[int, int, int]] = []
        if q.num_rows and x.num_rows:
            of, ids = q.column("vec_id").to_numpy(), x.column("vec_id").to_numpy()
            a, b = (_matrix(t.column("v").combine_chunks(), width) for t in (q, x))
            for i in range(0, len(of), 256):
                for query, scores in zip(of[i : i + 256], _products(a[i : i + 256], b), strict=True):
                    other = ids != query
                    best = _top(ids[other], scores[other], k)
                    out += zip([query] * len(best), ids[other][best].tolist(), scores[other][best].tolist(), strict=True)
        return pa.table([pa.array([r[j] for r in out], pa.int64()) for j in range(3)], names=["query_id", "vec_id", "score"])

    found = dealt.queries.groupBy("g", "s").cogroup(dealt.data.groupBy("g", "s")).applyInArrow(solve, _SCORES)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
