"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks.  The ideal mixture takes of every source that is not used up
a share of each slot in proportion to its target weight: exact arithmetic on whole-number weights tells at
what time it begins and ends a source's j-th block.  The slot in which it begins is the block's release
time, the slot by whose end it is complete its deadline; while no source is used up these are
``floor((j - 1) / w)`` and ``ceil(j / w)`` for a share ``w``.  Each slot takes, of the released blocks, the one with the
earliest deadline (ties: source order).  Whatever the weights and sizes, each source then has at every slot what the ideal
mixture gives it, to within less than one block.  Every document is placed exactly once.

The result depends on the rows alone: blocks are of ``block_docs`` documents and every source is scheduled by itself, however large
the table and however many its sources.  Documents are numbered within their source by hash order; that is done in buckets
(ranges of the hash), so that a large source is no large task, and their number changes nothing.

The schedule is worked out on the driver, slot by slot; what it holds are the sources and one block of each, and it hands
on ``PLAN_BLOCKS`` blocks at a time.  A caller who wants a coarser one may set ``MAX_BLOCKS`` (larger blocks where there would be
more) and ``SOURCES`` (where there are more, those that do not fill one block are scheduled together, each document in hash order).

Defined cases: null sources are one source; without given weights a source weighs its number
of documents to the power ``temperature``; sources without a given weight (or with none) come after
all others, by the same rule; null ids and repeated rows are placed like others; an empty table
gives no rows; extra columns stay as they are (a name with the prefix ``__mix`` is refused).
"""

from __future__ import annotations

import heapq
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from fractions import Fraction
from functools import reduce
from itertools import accumulate
from math import lcm

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.llm.folds import bounded
from lodestone.plans.staging import stage

BLOCK_DOCS, TEMPERATURE = 16, 0.5
#: Bounds that a caller may set for a coarser schedule: its blocks (one more for each source), and sources of less than a block that are scheduled one by one.
MAX_BLOCKS: int | None = None
SOURCES: int | None = None
#: Blocks of a source in a row of the plan, blocks that the driver hands on at a time, and blocks that may be broadcast (8 bytes each).
RUN, PLAN_BLOCKS, BROADCAST_BLOCKS = 1024, 1 << 20, 1 << 22
#: Documents in a partition of the mixed order, at most on average.
PARTITION_DOCS = 20_000
#: Documents in a numbering bucket, on average, and buckets at most (one more for each source).
BUCKET_DOCS, MAX_BUCKETS = 4096, 1 << 16


def clock(blocks: Sequence[int], weights: Sequence[float]) -> Callable[[int, int], tuple[int, int]]:
    """Slots that have passed when the ideal mixture has taken ``j`` blocks of source ``i``: whole ones, and whether a part of one more."""
    kinds: dict[tuple[int, float], int] = {}  # sources of one size and weight share their times
    of = array("q", (kinds.setdefault(x, len(kinds)) for x in zip(blocks, weights, strict=True)))
    many = Counter(of)
    exact = [Fraction(w) for _, w in kinds]
    scale = lcm(*[w.denominator for w in exact])
    a, sizes = [int(w * scale) for w in exact], [n for n, _ in kinds]
    order = sorted(range(len(a)), key=lambda c: Fraction(sizes[c], a[c]))  # in the order in which they are used up
    near = [sizes[c] / a[c] for c in order]
    gone = [0, *accumulate(sizes[c] * many[c] for c in order)]
    weight = [0, *accumulate(a[c] * many[c] for c in order)]

    def slot(j: int, i: int) -> tuple[int, int]:
        w = a[of[i]]
        at = bisect_left(near, j / w)  # by floating point, then put right
        while at and sizes[order[at - 1]] * w >= j * a[order[at - 1]]:
            at -= 1
        while at < len(order) and sizes[order[at]] * w < j * a[order[at]]:
            at += 1
        whole, part = divmod((weight[-1] - weight[at]) * j, w)
        return gone[at] + whole, int(part > 0)

    return slot


def windows(blocks: list[int], weights: list[float]) -> list[list[tuple[int, int]]]:
    """Release time and deadline of all blocks of each source, exactly."""
    slot = clock(blocks, weights)
    out = []
    for i, n in enumerate(blocks):
        at = [slot(j, i) for j in range(n + 1)]
        out.append([(at[j][0], sum(at[j + 1])) for j in range(n)])
    return out


def turns(blocks: Sequence[int], weights: Sequence[float]) -> Iterator[int]:
    """The source of each slot: of the released blocks, the one with the earliest deadline."""
    slot = clock(blocks, weights)
    deadlines = np.fromiter((sum(slot(1, i)) for i in range(len(blocks))), np.int64, len(blocks))
    fresh = [i for i in np.argsort(deadlines, kind="stable").tolist() if blocks[i]]  # all first blocks are released at once
    fresh.reverse()
    waiting: list[tuple[int, int, int, int, int]] = []  # release, deadline, source, block, whole slots by its end: the next one's release
    ready: list[tuple[int, int, int, int]] = []  # the same without the release
    for t in range(sum(blocks)):
        while waiting and waiting[0][0] <= t:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        if fresh and (not ready or (int(deadlines[fresh[-1]]), fresh[-1]) < ready[0][:2]):
            i, j = fresh.pop(), 0
            whole = slot(1, i)[0]
        else:
            _, i, j, whole = heapq.heappop(ready)
        yield i
        if j + 1 < blocks[i]:
            then, part = slot(j + 2, i)
            heapq.heappush(waiting, (whole, then + part, i, j + 1, then))


def all_turns(blocks: Sequence[int], first: Sequence[float], second: Sequence[float]) -> Iterator[int]:
    """The source of each slot: those of positive ``first`` weight, and after them the others by ``second``."""
    for weights, some in ((first, [i for i, w in enumerate(first) if w > 0]), (second, [i for i, w in enumerate(first) if not w > 0])):
        if some:
            yield from (some[i] for i in turns([blocks[i] for i in some], [weights[i] for i in some]))


def slots_of(order: Iterator[int], n: int) -> list[list[int]]:
    out: list[list[int]] = [[] for _ in range(n)]
    for t, i in enumerate(order):
        out[i].append(t)
    return out


def schedule(blocks: list[int], weights: list[float]) -> list[list[int]]:
    """The slots of all blocks of each source."""
    return slots_of(turns(blocks, weights), len(blocks))


def plan(blocks: list[int], first: list[float], second: list[float]) -> list[list[int]]:
    """The slots of all blocks of each source: those of positive ``first`` weight, and after them the others by ``second``."""
    return slots_of(all_turns(blocks, first, second), len(blocks))


def plan_runs(order: Iterator[int]) -> Iterator[pa.Table]:
    """Rows (source, number of a run of its blocks, the run's slots), some at a time."""
    open_runs: dict[int, array] = {}
    begun: Counter[int] = Counter()

    def table(rows: list[tuple[int, int, array]]) -> pa.Table:
        ends = np.cumsum([0, *[len(x) for _, _, x in rows]]).astype(np.int32)
        slots = np.concatenate([np.frombuffer(x, np.int64) for _, _, x in rows])
        return pa.table({"__mix_src2": pa.array([i for i, _, _ in rows], pa.int32()), "__mix_run2": pa.array([r for _, r, _ in rows], pa.int64()), "__mix_slots": pa.ListArray.from_arrays(ends, slots)})

    def close(i: int) -> tuple[int, int, array]:
        begun[i] += 1
        return i, begun[i] - 1, open_runs.pop(i)

    full: list[tuple[int, int, array]] = []
    for t, i in enumerate(order):
        run = open_runs.setdefault(i, array("q"))
        run.append(t)
        if len(run) == RUN:
            full.append(close(i))
            if len(full) * RUN >= PLAN_BLOCKS:
                yield table(full)
                full = []
    for i in list(open_runs):
        full.append(close(i))
        if len(full) * RUN >= PLAN_BLOCKS:
            yield table(full)
            full = []
    if full:
        yield table(full)


def planned(spark: SparkSession, order: Iterator[int], blocks: int) -> DataFrame:
    """The plan as a table: broadcast if it is short, else written piece by piece."""
    pieces = plan_runs(order)
    if blocks <= PLAN_BLOCKS:
        tables = list(pieces)
        whole = spark.createDataFrame(pa.concat_tables(tables))
    else:
        parts = [stage(spark.createDataFrame(piece), "mix-plan") for piece in pieces]
        whole = reduce(DataFrame.union, parts)
    return bounded(whole) if blocks <= BROADCAST_BLOCKS else whole


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None,
    temperature: float = TEMPERATURE, block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """``docs`` with ``__mix_block`` (of its source), ``__mix_slot`` and ``__mix_position`` (the order of all documents)."""
    spark = docs.sparkSession
    if taken := [c for c in docs.columns if c.startswith("__mix")]:
        raise ValueError(f"columns {taken}: names with the prefix __mix are reserved")
    counts = docs.groupBy(F.col(source_col).cast("string").alias("s")).count()
    total, sources = counts.agg(F.coalesce(F.sum("count"), F.lit(0)), F.count(F.lit(1))).first()
    if not total:
        return docs.select("*", *[F.lit(0).cast("long").alias(c) for c in ("__mix_block", "__mix_slot", "__mix_position")])
    if MAX_BLOCKS is not None:
        block_docs = max(block_docs, -(-total // MAX_BLOCKS))
    bucket_docs = max(BUCKET_DOCS, -(-total // MAX_BUCKETS))
    if SOURCES is not None and sources > SOURCES:
        counts = counts.where(F.col("count") >= block_docs)  # as many as there are blocks, at most
    sizes = counts.orderBy(F.col("s").asc_nulls_first()).toArrow()
    names, counted = sizes["s"].to_pylist(), sizes["count"].to_pylist()
    usual = [n**temperature for n in counted]
    given = usual if weights is None else [max(0.0, float(weights.get(s, 0))) for s in names]
    rest = total - sum(counted)
    together = len(names) if rest else None
    known = spark.createDataFrame(pa.table({"__mix_s": pa.array(names, pa.string()), "__mix_src": pa.array(range(len(names)), pa.int32()), "__mix_n": pa.array([-(-n // bucket_docs) for n in counted], pa.int64())}))
    if rest:  # the small sources, together
        counted, usual = [*counted, rest], [*usual, rest**temperature]
        given = [*given, usual[-1] if weights is None else max(0.0, sum(map(float, weights.values())) - sum(given))]
    blocks = [-(-n // block_docs) for n in counted]
    plan_df = planned(spark, all_turns(blocks, given, usual), sum(blocks))

    d = docs.withColumn("__mix_h", F.xxhash64(F.col(id_col), F.lit("mix")))
    d = d.join(bounded(known), d[source_col].cast("string").eqNullSafe(F.col("__mix_s")), "left" if rest else "inner").drop("__mix_s")
    if rest:
        d = d.withColumns({"__mix_src": F.coalesce("__mix_src", F.lit(together)), "__mix_n": F.coalesce("__mix_n", F.lit(-(-rest // bucket_docs)))})
    # equal ranges of the hash: however many there are, documents of later ones come later in hash order
    d = d.withColumn("__mix_bucket", F.shiftright((F.shiftright("__mix_h", 32) + (1 << 31)) * F.col("__mix_n"), 32)).drop("__mix_n")
    tally = d.groupBy("__mix_src", "__mix_bucket").agg(F.count(F.lit(1)).alias("__mix_c"))
    # MAX_BUCKETS rows, and one for each source, at most
    before = Window.partitionBy("__mix_src").orderBy("__mix_bucket").rowsBetween(Window.unboundedPreceding, -1)
    tally = tally.select(F.col("__mix_src").alias("__mix_s2"), F.col("__mix_bucket").alias("__mix_b2"), F.coalesce(F.sum("__mix_c").over(before), F.lit(0)).alias("__mix_off"))
    inside = Window.partitionBy("__mix_src", "__mix_bucket").orderBy("__mix_h", id_col)
    d = d.withColumn("__mix_rn", F.row_number().over(inside) - 1)
    d = d.join(bounded(tally), (F.col("__mix_src") == F.col("__mix_s2")) & (F.col("__mix_bucket") == F.col("__mix_b2")))
    d = d.withColumn("__mix_i", F.col("__mix_off") + F.col("__mix_rn")).withColumn("__mix_block", F.floor(F.col("__mix_i") / block_docs))
    d = d.join(plan_df, (F.col("__mix_src") == F.col("__mix_src2")) & (F.floor(F.col("__mix_block") / RUN) == F.col("__mix_run2")))
    d = d.withColumn("__mix_slot", F.col("__mix_slots")[(F.col("__mix_block") % RUN).cast("int")])
    d = d.withColumn("__mix_position", F.col("__mix_slot") * block_docs + F.col("__mix_i") % block_docs)
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], "__mix_block", "__mix_slot", "__mix_position")


def in_mixed_order(docs: DataFrame, *, partition_docs: int = PARTITION_DOCS, **options) -> DataFrame:
    """The rows and columns of ``docs``; its partitions, and the files written of them, follow the mixed order."""
    mixed = mix(docs, **options)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-docs.count() // partition_docs))
    return mixed.repartitionByRange(parts, "__mix_position").sortWithinPartitions("__mix_position").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source")
    return mix(docs).select("doc_id", "source", F.col("__mix_block").alias("block"), F.col("__mix_slot").alias("slot"), F.col("__mix_position").alias("position"))
