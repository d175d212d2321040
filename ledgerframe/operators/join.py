"""Two-dataset joins, each side filtered by its own criteria first."""

from __future__ import annotations

from functools import reduce
from math import ceil, sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..dataset import Dataset
from ..errors import TableError
from ..functions.criteria import equal_columns, join_condition
from ..lineage import cut
from .read import get

#: Join words of the command language to Spark's join types.
MODES = {"ON": "inner", "LEFTON": "left", "RIGHTON": "right", "OUTON": "full"}

#: Pairs of rows in a block of equal keys, at most, about; rows of a side in a block, at
#: least, where both sides have more.
BLOCK_PAIRS, BLOCK_ROWS = 4_000_000, 2_000
#: Pairs of a group from which an inner join copies none of its rows for blocks, but packs
#: them into arrays; rows of an array, about.
HUGE_PAIRS, PACK_ROWS = 64_000_000, 256
#: Rows, with their copies for blocks, that a task of a dealt join makes or takes in, about,
#: and tasks at most; beyond that many, a task has more blocks.
TASK_ROWS, MAX_TASKS = 1_000_000, 20_000
#: Keys with several blocks that are broadcast.
MAX_BROADCAST = 100_000


def join(
    left: Dataset,
    right: Dataset,
    on: str | None = None,
    mode: str = "ON",
    left_criteria: str | None = None,
    right_criteria: str | None = None,
    left_select: list[str] | None = None,
    right_select: list[str] | None = None,
    prefixes: tuple[str, str] = ("l_", "r_"),
) -> DataFrame:
    """Joins what the criteria leave of both sides; columns carry the prefixes.

    Equality is null-safe and stays a hash or merge join; criteria for a side
    are never applied after an outer join. No join criteria: a cross join.

    Where the columns to be equal hold neither side's key, rows are counted by them
    first (a job). If a group or the whole makes many pairs, the join is dealt over
    tasks by its pairs. A group is split into blocks on both sides; in an outer join
    only on the side that is kept, in a full one on none. Copies of rows for blocks grow
    with the pairs, so an inner join shuffles those of huge groups uncopied, in arrays.
    """
    if mode.upper() not in MODES:
        raise TableError(217, mode)
    condition = join_condition(left, right, on, prefixes)
    sides = []
    for data, criteria, prefix in ((left, left_criteria, prefixes[0]), (right, right_criteria, prefixes[1])):
        rows = get(data, criteria)
        sides.append(rows.select(*(F.col(f"`{c}`").alias(prefix + c) for c in rows.columns)))
    names = [p + d.column(c) for d, s, p in ((left, left_select, prefixes[0]), (right, right_select, prefixes[1])) for c in (d.data.columns if s is None else s)]
    chosen = [F.col(f"`{n}`") for n in names]
    packed = None
    if condition is None:
        joined = sides[0].join(sides[1], F.lit(True), MODES[mode.upper()])
    else:
        equal = equal_columns(left, right, on)
        if equal and not {*left.keys} <= {a for a, _ in equal} and not {*right.keys} <= {b for _, b in equal}:
            dealt = _dealt(sides, [(prefixes[0] + a, prefixes[1] + b) for a, b in equal], MODES[mode.upper()])
            if dealt is not None:
                (sides, packed), rest = dealt, join_condition(left, right, on, prefixes, equal)
                condition = (F.col("__block_0") == F.col("__block_1")) & rest
        joined = sides[0].join(sides[1], condition, MODES[mode.upper()])
    rows = joined.select(*chosen)
    return rows if packed is None else rows.union(packed.filter(rest).select(*chosen))


def _same(names: list[str], others: list[str]) -> Column:
    return reduce(lambda a, b: a & b, (F.col(f"`{x}`").eqNullSafe(F.col(f"`{y}`")) for x, y in zip(names, others, strict=True)))


def _group_sizes(sides: list[DataFrame], equal: list[tuple[str, str]]) -> DataFrame:
    """Each group of equal keys with its rows on both sides, 1 for none; doubles, as
    their products can be beyond a long."""
    counted = [rows.groupBy(*(F.col(f"`{pair[i]}`").alias(f"__{i}_{k}") for k, pair in enumerate(equal))).agg(F.count("*").cast("double").alias(f"__rows_{i}")) for i, rows in enumerate(sides)]
    at = range(len(equal))
    both = counted[0].join(counted[1], _same([f"__0_{k}" for k in at], [f"__1_{k}" for k in at]), "full")
    return both.select(*(F.coalesce(f"__0_{k}", f"__1_{k}").alias(f"__key_{k}") for k in at), *(F.coalesce(f"__rows_{i}", F.lit(1.0)).alias(f"__rows_{i}") for i in (0, 1)))


def _parts(mode: str) -> list[Column]:
    """Into how many parts each side's rows of a group are split."""
    left, right = F.col("__rows_0"), F.col("__rows_1")
    one = F.lit(1).cast("long")
    if mode == "full":
        return [one, one]
    if mode == "right":
        return [one, F.ceil(right / F.greatest(F.lit(float(BLOCK_ROWS)), BLOCK_PAIRS / left))]
    in_part = F.least(left, F.greatest(F.lit(float(BLOCK_ROWS)), BLOCK_PAIRS / right))
    return [F.ceil(left / in_part), one if mode == "left" else F.ceil(right * in_part / BLOCK_PAIRS)]


def _dealt(sides: list[DataFrame], equal: list[tuple[str, str]], mode: str) -> tuple[list[DataFrame], DataFrame | None] | None:
    """Both sides dealt over tasks by blocks of their groups, in __block_0 and __block_1,
    and the pairs of huge groups, if there are any; None where Spark's own join has it easy.

    A row is in one part of its side, by a hash of the whole row, and goes to one block
    with each part of the other side; so each pair meets in one block. A block holds the
    keys, and in structs nulls are equal, so it is all there is to join by: with
    further keys Spark would deal anew, over its default number of tasks.
    """
    sizes = _group_sizes(sides, equal)
    pairs = F.col("__rows_0") * F.col("__rows_1")
    is_huge = (pairs > HUGE_PAIRS) if mode == "inner" else F.lit(False)
    is_split = (pairs > BLOCK_PAIRS) | is_huge
    parts = [F.when(is_huge, F.ceil(F.col(f"__rows_{i}") / PACK_ROWS)).otherwise(p) for i, p in enumerate(_parts(mode))]
    copied = [F.sum(F.when(~is_huge, F.col(f"__rows_{i}") * F.when(is_split, parts[1 - i]).otherwise(1))) for i in (0, 1)]
    packs = [F.sum(F.when(is_huge, p)) for p in parts]
    found = sizes.agg(F.sum(pairs), F.max(pairs), F.sum(F.when(is_huge, pairs)), F.count_if(is_split), F.sum("__rows_0"), F.sum("__rows_1"), *copied, *packs).first()
    total, most, in_huge, n_split, *n_rows, n_left, n_right, packs_left, packs_right = (x or 0 for x in found)
    if most <= min(BLOCK_PAIRS, HUGE_PAIRS) and total <= max(BLOCK_PAIRS, sum(n_rows)):
        return None
    n_tasks = min(MAX_TASKS, 2 * ceil((total - in_huge) / BLOCK_PAIRS) + ceil((n_left + n_right) / TASK_ROWS))
    keys = [f"__key_{k}" for k in range(len(equal))]
    split = cut(sizes.filter(is_split).select(*keys, is_huge.alias("__huge"), *(p.cast("long").alias(f"__parts_{i}") for i, p in enumerate(parts))))
    made, packed = [], []
    for i, rows in enumerate(sides):
        own = [pair[i] for pair in equal]
        columns = [F.col(f"`{c}`") for c in rows.columns]
        whole = F.xxhash64(*columns)
        n_copied = (n_left, n_right)[i]
        if n_copied > max(TASK_ROWS, 4 * n_rows[i]):  # a few tasks would make all the copies
            rows = rows.repartition(min(MAX_TASKS, ceil(n_copied / TASK_ROWS)), whole)
        found = rows.join(F.broadcast(split) if n_split <= MAX_BROADCAST else split, _same(own, keys), "left")
        mine, other = (F.coalesce(f"__parts_{j}", F.lit(1).cast("long")) for j in (i, 1 - i))
        part = F.pmod(whole, mine)
        if in_huge:
            packed.append(found.filter("__huge").groupBy(*(F.col(k).alias(f"{k}_{i}") for k in keys), part.alias(f"__part_{i}")).agg(F.collect_list(F.struct(*columns)).alias(f"__pack_{i}")))
            found = found.filter("__huge IS NOT TRUE")
        spread = found.select(*columns, part.alias("__part"), mine.alias("__mine"), other.alias("__other"), F.explode(F.sequence(F.lit(0).cast("long"), other - 1)).alias("__at"))
        block = F.col("__part") * F.col("__other") + F.col("__at") if i == 0 else F.col("__at") * F.col("__mine") + F.col("__part")
        key = F.struct(*(F.col(f"`{c}`").alias(f"key_{k}") for k, c in enumerate(own)), block.alias("block"))
        made.append(spread.select(*columns, key.alias(f"__block_{i}")).repartition(max(1, n_tasks), f"__block_{i}"))
    return made, _unpacked(packed, keys, in_huge, (packs_left, packs_right)) if in_huge else None


def _unpacked(packed: list[DataFrame], keys: list[str], pairs: float, n_packs: tuple[int, int]) -> DataFrame:
    """The pairs of rows of packs with equal keys. Each task reads some packs of each side
    from where they were shuffled to, without copies; it compares packs, not rows.

    Packs are dealt by key and part, not in turns, as a task run again can give the rows of
    a pack in another order.
    """
    tasks = min(MAX_TASKS, ceil(pairs / BLOCK_PAIRS))
    n_left = max(1, min(n_packs[0], tasks, round(sqrt(tasks * n_packs[0] / n_packs[1]))))
    n_right = max(1, min(n_packs[1], ceil(tasks / n_left)))
    names = [[f"{k}_{i}" for k in keys] for i in (0, 1)]
    dealt = [p.repartition(n, *names[i], f"__part_{i}") for i, (p, n) in enumerate(zip(packed, (n_left, n_right), strict=True))]
    met = dealt[0].join(dealt[1].hint("shuffle_replicate_nl"), _same(*names))
    names = [f"`{f.name}`" for f in packed[0].schema["__pack_0"].dataType.elementType]
    return met.select("__pack_1", F.inline("__pack_0")).select(*names, F.inline("__pack_1"))
