"""Blocking: candidate pairs from equal keys, bounds on their number before any pair exists, and their even distribution.

A block of ``n`` rows makes ``n (n - 1) / 2`` pairs, so a join dealt by key is as slow as its largest block.  Counts of blocks, taken first,
tell the number of pairs.  Where one block holds more than a work unit's pairs, its rows are dealt into parts by a hash of their id, and
its pairs into tiles ``(part, part)`` of about one unit each; a row travels to the tiles of its part.  Keys and tiles together deal the join, so that no
task holds more than its share of pairs, and the number of tasks follows the number of pairs (not of bytes, of which pairs have none before the join).
The right rows of a block or tile are joined as one array and opened by each left row.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.columns import col, present, quote
from lodestone.functions.strings import Similarities
from lodestone.plans.staging import stage

ID_L, ID_R = "__id_l__", "__id_r__"
#: Pairs that are worth a task of their own; tasks for each core, beyond which a task makes more, and how many then.
PAIRS_OF_A_TASK, TASKS_PER_CORE, PAIRS_PER_TASK = 5_000_000, 16, 40_000_000
#: Units into which a task's share is cut, at least, and units for each core: rows travel once for each part they meet, so that larger units send
#: fewer; bounds of a unit.
UNITS_PER_TASK, UNITS_PER_CORE, LEAST_UNIT, LARGEST_UNIT = 8, 128, 2_000, 36_000_000
#: Below so many pairs tasks are left to the engine.
FEW_PAIRS = 500_000
#: Rows of keys and counts of large blocks that may be broadcast.
BROADCAST_BLOCKS = 100_000


def blocks(df: DataFrame, rule: Sequence[str]) -> DataFrame:
    """Rows ``(k0, k1, ..., n)``: the number of rows in each block; rows with a missing key are in none."""
    valid = F.lit(True)
    for c in rule:
        valid = valid & present(df, c)
    return df.where(valid).groupBy(*[col(c).alias(f"k{i}") for i, c in enumerate(rule)]).agg(F.count(F.lit(1)).alias("n"))


@dataclass(frozen=True)
class Work:
    """What a rule's blocks make: bounds on all pairs and on those of the largest block."""

    pairs: int
    largest: int

    def tasks(self, parallelism: int) -> int:
        most = max(parallelism * TASKS_PER_CORE, math.ceil(self.pairs / PAIRS_PER_TASK))
        return max(parallelism, min(math.ceil(self.pairs / PAIRS_OF_A_TASK), most))

    def unit(self, parallelism: int) -> int:
        """Pairs of a work unit."""
        return max(LEAST_UNIT, min(LARGEST_UNIT, max(self.pairs // (self.tasks(parallelism) * UNITS_PER_TASK), self.pairs // (parallelism * UNITS_PER_CORE))))


def _sizes(df: DataFrame, rule: Sequence[str], right: DataFrame | None) -> DataFrame:
    """Rows ``(k0, ..., n, m, p)`` of blocks: rows on both sides and pairs."""
    left = blocks(df, rule)
    if right is None:
        return left.withColumn("m", F.col("n")).withColumn("p", (F.col("n") * (F.col("n") - 1) / 2).cast("long"))
    other = blocks(right, rule).select(*[F.col(f"k{j}").alias(f"r{j}") for j in range(len(rule))], F.col("n").alias("m"))
    same = F.lit(True)
    for j in range(len(rule)):
        same = same & (F.col(f"k{j}") == F.col(f"r{j}"))
    both = left.join(other, same) if rule else left.join(F.broadcast(other), F.lit(True))  # one row a side
    return both.withColumn("p", F.col("n") * F.col("m"))


def _work(df: DataFrame, rules: Sequence[Sequence[str]], right: DataFrame | None) -> DataFrame:
    out = None
    for i, rule in enumerate(rules or [()]):
        total = [F.coalesce(f("p"), F.lit(0)).cast("long").alias(n) for f, n in ((F.sum, "pairs"), (F.max, "largest"))]
        part = _sizes(df, rule, right).agg(*total).select(F.lit(i).alias("rule"), "pairs", "largest")
        out = part if out is None else out.unionByName(part)
    return out


def pair_bounds(df: DataFrame, rules: Sequence[Sequence[str]], right: DataFrame | None = None) -> DataFrame:
    """Rows ``(rule, pairs)``: an upper bound for each rule (their sum bounds the union); without rules all pairs."""
    return _work(df, rules, right).select("rule", "pairs")


def pair_work(df: DataFrame, rules: Sequence[Sequence[str]], right: DataFrame | None = None) -> list[Work]:
    """The work of each rule (without rules: of all pairs), in one job."""
    return [Work(r.pairs, r.largest) for r in sorted(_work(df, rules, right).collect())]


def _side(df: DataFrame, id_column: str, columns: Sequence[str], rules: Sequence[Sequence[str]], tag: str) -> DataFrame:
    names = dict.fromkeys([*columns, *(c for r in rules for c in r)])
    wide = [col(c).alias(f"{c}_{tag}") for c in columns]
    keys = {c: F.when(present(df, c), col(c)).alias(f"__k_{c}_{tag}") for c in names if any(c in r for r in rules)}
    return df.select(col(id_column).alias(ID_L if tag == "l" else ID_R), *wide, *keys.values())


def candidates(
    df: DataFrame, id_column: str, rules: Sequence[Sequence[str]], columns: Sequence[str] = (), right: DataFrame | None = None,
    *, work: Sequence[Work] | None = None, max_pairs: int | None = None, unit_pairs: int | None = None, similar: Sequence[str] = (),
) -> DataFrame:
    """Rows ``(__id_l__, __id_r__, c_l, c_r, ...)``: each pair once.

    One equi-join for each rule (a disjunction would become a nested loop).  A pair belongs to the first
    rule it satisfies, so that the union needs no shuffle to drop repeats.  The compared ``columns``
    travel through the join.  Within one table pairs are ordered by id; rows without id make none.

    ``work`` is what ``pair_work`` found, if the caller knows it.  Without rules every pair is a candidate,
    and a bound ``max_pairs`` must be given; beyond it (with or without rules) a MemoryError tells so before any pair is made.
    ``unit_pairs`` fixes the pairs of a work unit.  Of ``similar`` columns, text, each pair has ``__sim_<c>``, its Jaro-Winkler similarity, in place
    of both values: tiles are compared whole where they are, so that texts travel by row, not by pair."""
    if not rules and max_pairs is None:
        raise ValueError("all pairs are asked for: give max_pairs")
    work = list(work) if work is not None else pair_work(df, rules, right)
    if max_pairs is not None and sum(w.pairs for w in work) > max_pairs:
        raise MemoryError(f"up to {sum(w.pairs for w in work)} pairs exceed {max_pairs}")
    left = _side(df, id_column, columns, rules, "l")
    other = _side(df if right is None else right, id_column, columns, rules, "r")
    keep = [ID_L, ID_R, *[f"{c}_{t}" for c in columns if c not in similar for t in "lr"], *[f"__sim_{c}" for c in similar]]

    def satisfies(rule: Sequence[str]) -> Column:
        out = F.lit(True)
        for c in rule:
            out = out & (F.col(quote(f"__k_{c}_l")) == F.col(quote(f"__k_{c}_r")))
        return out

    out = None
    parallelism = df.sparkSession.sparkContext.defaultParallelism
    for i, (rule, w) in enumerate(zip(rules or [()], work, strict=True)):
        first = F.lit(True)
        for earlier in rules[:i]:
            first = first & ~F.coalesce(satisfies(earlier), F.lit(False))
        unit = unit_pairs or w.unit(parallelism)
        tasks = w.tasks(parallelism) if unit_pairs or w.pairs >= FEW_PAIRS else None
        a, b = (x.where(_filled(rule, t)) for x, t in ((left, "l"), (other, "r")))
        if right is None:
            a, b = a.where(F.col(ID_L).isNotNull()), b.where(F.col(ID_R).isNotNull())
        if rule and w.largest <= 2 * unit:
            once = F.col(ID_L) < F.col(ID_R) if right is None else F.lit(True)
            part = _open(a, b, rule, (), tasks, similar, right is None).where(once & first).select(*[F.col(quote(c)) for c in keep])
        else:
            a, b = _tiles(a, b, rule, _parts(df, rule, right, unit), right is None)
            once = (F.col("__i_l") < F.col("__j_l")) | (F.col(ID_L) < F.col(ID_R)) if right is None else F.lit(True)
            # tiles are made of keys and two numbers; few ones are dealt to as many tasks as the pairs ask for
            part = _open(a, b, rule, ("__i", "__j"), tasks or parallelism, similar, right is None).where(once & first).select(*_in_order(keep, right is None))
        out = part if out is None else out.unionByName(part)
    return out


def candidates_of(ids: DataFrame, df: DataFrame, id_column: str, rules: Sequence[Sequence[str]], columns: Sequence[str] = (), right: DataFrame | None = None) -> DataFrame:
    """Those of the given pairs ``(__id_l__, __id_r__)`` that are ``candidates``, with the same columns: two joins by id, whatever the number of
    candidates."""
    left = _side(df, id_column, columns, rules, "l")
    other = _side(df if right is None else right, id_column, columns, rules, "r")
    found = ids.select(ID_L, ID_R).distinct().join(left, ID_L).join(other, ID_R)
    if right is None:
        found = found.where(F.col(ID_L) < F.col(ID_R))
    some = F.lit(not rules)
    for rule in rules:
        same = F.lit(True)
        for x, y in zip(_keys(rule, "l"), _keys(rule, "r"), strict=True):
            same = same & F.coalesce(x == y, F.lit(False))
        some = some | same
    return found.where(some).select(*[F.col(quote(c)) for c in [ID_L, ID_R, *[f"{c}_{t}" for c in columns for t in "lr"]]])


def _keys(rule: Sequence[str], tag: str) -> list[Column]:
    return [F.col(quote(f"__k_{c}_{tag}")) for c in rule]


def _filled(rule: Sequence[str], tag: str) -> Column:
    out = F.lit(True)
    for key in _keys(rule, tag):
        out = out & key.isNotNull()
    return out


def _open(a: DataFrame, b: DataFrame, rule: Sequence[str], tile: Sequence[str], tasks: int | None, similar: Sequence[str], within: bool) -> DataFrame:
    """Both sides' columns of all pairs with equal keys and tile.  The right rows of a tile (at most about the root of two units) are
    one array a column, which each left row meets once and opens: a pair costs a step of a loop, not a row of a join, and no object."""
    keys = {t: [*_keys(rule, t), *[F.col(f"{n}_{t}") for n in tile]] for t in "lr"}
    if similar:
        return _compared(a, b, [[*[f"__k_{c}_{t}" for c in rule], *[f"{n}_{t}" for n in tile]] for t in "lr"], tasks, similar, within)
    if tasks:
        a, b = a.repartition(tasks, *keys["l"]), b.repartition(tasks, *keys["r"])
    inner = [f"__k_{c}_r" for c in rule] + [f"{n}_r" for n in tile]
    own = [c for c in b.columns if c not in inner]
    lists = b.groupBy(*keys["r"]).agg(F.collect_list(F.struct(*[F.col(quote(c)).alias(f"c{i}") for i, c in enumerate(own)])).alias("__rows"))
    lists = lists.select("*", *[F.col("__rows")[f"c{i}"].alias(f"__rows{i}") for i in range(len(own))]).drop("__rows")
    same = F.lit(True)
    for x, y in zip(keys["l"], keys["r"], strict=True):
        same = same & (x == y)
    met = a.join(lists.hint("merge"), same)
    known = [F.col(quote(c)) for c in [*a.columns, *inner]]
    if len(own) == 1:
        return met.select(*known, F.explode("__rows0").alias(own[0]))
    opened = met.select(*known, *[f"__rows{i}" for i in range(1, len(own))], F.posexplode("__rows0").alias("__at", own[0]))
    return opened.select(*known, F.col(quote(own[0])), *[F.get(F.col(f"__rows{i}"), F.col("__at")).alias(own[i]) for i in range(1, len(own))])


#: Pairs that are compared at once.
AT_ONCE = 1 << 13


def _compared(a: DataFrame, b: DataFrame, keys: Sequence[Sequence[str]], tasks: int | None, similar: Sequence[str], within: bool) -> DataFrame:
    """As ``_open``, with similarities in place of the ``similar`` columns.  The rows of both sides are sorted by tile, side and id, and a
    task holds one tile's rows at a time."""
    names = [[ID_L if t == "l" else ID_R, *[c for c in x.columns if c not in k and c not in (ID_L, ID_R)]] for x, t, k in zip((a, b), "lr", keys, strict=True)]
    k, n = len(keys[0]), len(names[0])

    def side(x: DataFrame, at: int) -> DataFrame:
        cols = [*[F.col(quote(c)).alias(f"k{i}") for i, c in enumerate(keys[at])], F.lit(at).alias("side")]
        return x.select(*cols, *[F.col(quote(c)).alias(f"c{i}") for i, c in enumerate(names[at])])

    both = side(a, 0).unionByName(side(b, 1))
    by = [f"k{i}" for i in range(k)]
    both = (both.repartition(tasks, *by) if tasks else both.repartition(*by)).sortWithinPartitions(*by, "side", "c0")
    texts = [names[0].index(f"{c}_l") for c in similar]
    out = [(names[at][i], both.schema[f"c{i}"].dataType, at, i) for at in (0, 1) for i in range(n) if i not in texts]
    tiles = [(keys[at][i], both.schema[f"k{i}"].dataType, i) for at in (0, 1) for i in range(k)]
    schema = T.StructType([T.StructField(c, t) for c, t, *_ in [*out, *tiles]] + [T.StructField(f"__sim_{c}", T.DoubleType()) for c in similar])
    dealt = keys[0][-1] == "__j_l"

    def pairs(tile: pa.Table) -> Iterator[pa.RecordBatch]:
        m = pc.sum(pc.equal(tile["side"], 0)).as_py()
        rows = [tile.slice(0, m), tile.slice(m)]
        if not m or m == len(tile):
            return
        rows = [[c.combine_chunks() for c in r.columns] for r in rows]
        inner = within and not (dealt and rows[0][k - 2][0].as_py() != rows[0][k - 1][0].as_py())  # both sides hold the same rows
        ids = [r[k + 1].to_pylist() for r in rows]
        for one, two in [(0, 1)] if inner or not within else [(0, 1), (1, 0)]:  # within one table the smaller id is the first
            sims = [Similarities(rows[one][k + 1 + t].to_pylist(), rows[two][k + 1 + t].to_pylist()) for t in texts]
            begin = np.array([bisect_right(ids[two], i) for i in ids[one]] if within else [0] * len(ids[one]))
            low = 0
            while low < len(begin):
                start = int(begin[low])
                wide = len(ids[two]) - start
                if not wide:
                    break
                high = min(len(begin), low + max(1, AT_ONCE // wide))
                x, y = np.nonzero(np.arange(start, start + wide) >= begin[low:high, None])
                take = (pa.array(x + low), pa.array(y + start))
                columns = [rows[(one, two)[at]][k + 1 + i].take(take[at]) for _, _, at, i in out]
                columns += [pa.repeat(rows[0][i][0], len(x)) for _, _, i in tiles]
                for s in sims:
                    value = s.grid(low, high, start)[x, y]
                    columns.append(pa.array(value, mask=np.isnan(value)))
                yield pa.RecordBatch.from_arrays(columns, [f.name for f in schema])
                low = high

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table]).combine_chunks()
            new = np.zeros(max(0, len(table) - 1), bool)
            for i in range(k):
                new |= pc.not_equal(table[f"k{i}"].slice(1), table[f"k{i}"].slice(0, len(table) - 1)).to_numpy()
            starts = [0, *(np.flatnonzero(new) + 1).tolist()]
            for low, high in zip(starts, starts[1:], strict=False):
                yield from pairs(table.slice(low, high - low))
            held = table.slice(starts[-1])
        if held is not None and len(held):
            yield from pairs(held)

    return both.mapInArrow(run, schema)


def _in_order(keep: Sequence[str], within: bool) -> list[Column]:
    """The pair's columns, the smaller id on the left."""
    if not within:
        return [F.col(quote(c)) for c in keep]
    turned = F.col(ID_L) > F.col(ID_R)
    sims = [c for c in keep if c.startswith("__sim_")]
    other = {ID_L: ID_R, ID_R: ID_L} | {c: c if c in sims else c[:-1] + ("r" if c[-1] == "l" else "l") for c in keep if c not in (ID_L, ID_R)}
    return [F.when(turned, F.col(quote(other[c]))).otherwise(F.col(quote(c))).alias(c) for c in keep]


def _parts(df: DataFrame, rule: Sequence[str], right: DataFrame | None, unit: int) -> DataFrame:
    """Rows ``(k0, ..., sl, sr)`` of blocks that make more than a unit's pairs: into how many parts either side is dealt."""
    side = max(1, math.isqrt(unit))
    large = _sizes(df, rule, right).where(F.col("p") > unit)
    large = large.select(*[f"k{j}" for j in range(len(rule))], *[F.ceil(F.col(n) / side).cast("int").alias(s) for n, s in (("n", "sl"), ("m", "sr"))])
    large = stage(large, "blocks")
    return F.broadcast(large) if large.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS else large


def _tiles(left: DataFrame, other: DataFrame, rule: Sequence[str], parts: DataFrame, within: bool) -> tuple[DataFrame, DataFrame]:
    """Both sides with the tiles ``(__i, __j)`` that each row belongs to.  A left row of part ``i`` meets right rows of part ``j``; within one table only
    tiles with ``i <= j`` exist, which hold each pair of parts once."""
    def dealt(side: DataFrame, tag: str, own: str, across: str) -> DataFrame:
        names = [c for c in side.columns]
        p = parts.select(*[F.col(f"k{j}").alias(f"__b{j}") for j in range(len(rule))], F.col("sl").alias("__sl"), F.col("sr").alias("__sr"))
        same = F.lit(True)
        for j, key in enumerate(_keys(rule, tag)):
            same = same & (key == F.col(f"__b{j}"))
        known = side.join(p, same, "left") if rule else side.join(F.broadcast(p), F.lit(True), "left")  # without keys: one row
        mine = F.pmod(F.xxhash64(F.col(ID_L if tag == "l" else ID_R)), F.coalesce(F.col(own), F.lit(1))).cast("int")
        known = known.withColumn("__own", mine)
        last = F.coalesce(F.col(across), F.lit(1)) - 1
        low, high = (F.lit(0), last) if not within else (F.col("__own"), last) if tag == "l" else (F.lit(0), F.col("__own"))
        known = known.withColumn("__across", F.explode(F.sequence(low, high)))
        i, j = ("__own", "__across") if tag == "l" else ("__across", "__own")
        return known.select(*[F.col(quote(c)) for c in names], F.col(i).alias(f"__i_{tag}"), F.col(j).alias(f"__j_{tag}"))

    return dealt(left, "l", "__sl", "__sr"), dealt(other, "r", "__sr", "__sl")
