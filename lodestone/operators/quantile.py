"""Exact quantiles by rank selection.

A quantile is interpolated between the values of two ranks.  For all columns together, one aggregate counts the present values and
sketches each column; the sketch's values a little below and above a wanted rank are splitters.  A second aggregate counts
exactly what lies below, at and between the splitters, so that a rank is either that of a splitter (heavy ties end here) or in the open range
between two.  Ranges that hold more than ``BOUND`` rows are sketched and counted again; each turn leaves a few ten-thousandths of
them.  At last the values of all small ranges are grouped and counted by one job.

What a task or the driver holds is splitters, sketches and ranges of bounded size, however many distinct values a column has.  The sketch only proposes:
where its splitters miss a rank, the exact counts say on which side it lies.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.functions.columns import key

#: Rows of a range that are grouped by value and ordered in one task.
BOUND = 100_000
#: Accuracy of the sketches: splitters are asked for two of its steps below and above a wanted rank.
ACCURACY = 4_000


@dataclass
class Range:
    """An open range of a column's values, how many rows lie below it and in it, and the ranks wanted of it."""

    column: int
    low: float | None
    high: float | None
    below: int
    inside: int
    ranks: list[int] = field(default_factory=list)

    def holds(self, x: Column) -> Column:
        out = F.lit(True)
        if self.low is not None:
            out = out & (x > F.lit(self.low))
        if self.high is not None:
            out = out & (x < F.lit(self.high))
        return out


def positions(n: int, qs: Sequence[float]) -> list[tuple[int, int, float]]:
    """The lower and upper rank of each quantile, and its place between them."""
    return [(math.floor(p), math.ceil(p), p) for p in ((n - 1) * q for q in qs)]


def _sketch(x: Column, fractions: Sequence[float], accuracy: int) -> Column:
    return F.percentile_approx(x, F.array(*[F.lit(min(1.0, max(0.0, f))) for f in fractions]), F.lit(accuracy))


def _split(df: DataFrame, values: Sequence[Column], cuts: list[tuple[Range, int, float, float]]) -> tuple[dict, list[Range]]:
    """Count at the splitters; values of ranks that are splitters, and the ranges that hold the others."""
    asked = list(dict.fromkeys((r.column, s) for r, _, low, high in cuts for s in (low, high)))
    counted = df.agg(*[f(F.when(g(values[c], F.lit(s)), 1)).alias(f"{t}{i}") for i, (c, s) in enumerate(asked) for t, f, g in (("b", F.count, Column.__lt__), ("e", F.count, Column.__eq__))]).first()
    below = {k: counted[f"b{i}"] for i, k in enumerate(asked)}
    at = {k: counted[f"e{i}"] for i, k in enumerate(asked)}
    found, ranges = {}, {}

    def put(r: Range, rank: int) -> None:
        ranges.setdefault((r.column, r.low, r.high), r).ranks.append(rank)

    for r, rank, low, high in cuts:
        a, b = (r.column, low), (r.column, high)
        if below[a] <= rank < below[a] + at[a]:
            found[r.column, rank] = low
        elif below[b] <= rank < below[b] + at[b]:
            found[r.column, rank] = high
        elif rank < below[a]:
            put(Range(r.column, r.low, low, r.below, below[a] - r.below), rank)
        elif rank < below[b]:
            first = below[a] + at[a]
            put(Range(r.column, low, high, first, below[b] - first), rank)
        else:
            first = below[b] + at[b]
            put(Range(r.column, high, r.high, first, r.below + r.inside - first), rank)
    return found, list(ranges.values())


def _apart(ranges: list[Range]) -> list[Range]:
    """Ranges of a column that overlap, as one."""
    out: list[Range] = []
    least = lambda r: -math.inf if r.low is None else r.low
    for r in sorted(ranges, key=lambda r: (r.column, r.low is not None, least(r))):
        last = out[-1] if out and out[-1].column == r.column else None
        if last and (last.high is None or r.low is None or r.low < last.high):
            last.high = None if last.high is None or r.high is None else max(last.high, r.high)
            last.ranks += r.ranks
        else:
            out.append(Range(r.column, r.low, r.high, r.below, r.inside, list(r.ranks)))
    return out


def _pick(df: DataFrame, values: Sequence[Column], ranges: list[Range]) -> dict[tuple[int, int], float]:
    """Values of the wanted ranks of small ranges: grouped by value, numbered within each range."""
    ranges = _apart(ranges)
    numbers: dict[int, Column] = {}  # the range of each column that a row's value is in
    for i, r in enumerate(ranges):
        inside = r.holds(values[r.column])
        numbers[r.column] = numbers[r.column].when(inside, i) if r.column in numbers else F.when(values[r.column].isNotNull() & inside, i)
    slim = df.select(*[values[c].alias(f"x{c}") for c in numbers], *[n.alias(f"r{c}") for c, n in numbers.items()])
    slim = slim.where(F.coalesce(*[F.col(f"r{c}") for c in numbers]).isNotNull())
    each = F.explode(F.array(*[F.struct(F.col(f"r{c}").alias("r"), F.col(f"x{c}").alias("x")) for c in numbers]))
    rows = slim.select(each.alias("h")).where("h.r IS NOT NULL").groupBy(F.col("h.r").alias("r"), F.col("h.x").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("r").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))  # a few times BOUND rows a range, at most
    rows = rows.withColumn("last", upto)
    wanted = F.lit(False)
    for i, r in enumerate(ranges):
        for k in dict.fromkeys(r.ranks):
            wanted = wanted | ((F.col("r") == i) & (F.col("last") > k - r.below) & (F.col("last") - F.col("n") <= k - r.below))
    found = {}
    for row in rows.where(wanted).collect():  # one row a rank, at most
        r = ranges[row.r]
        for k in r.ranks:
            if row.last - row.n <= k - r.below < row.last:
                found[r.column, k] = row.x
    return found


def exact_quantiles(df: DataFrame, columns: Sequence[str], qs: Sequence[float], *, bound: int = BOUND, accuracy: int = ACCURACY) -> dict[str, list[float | None]]:
    """For each column the quantiles ``qs`` of its present values, interpolated linearly; None for a column without any."""
    if any(not 0 <= q <= 1 for q in qs):
        raise ValueError("quantiles lie between 0 and 1")
    if not columns or not qs:
        return {c: [None] * len(qs) for c in columns}
    margin = 2 / accuracy
    values = [key(df, c).cast("double") for c in columns]
    asked = [f for q in qs for f in (q - margin, q + margin)]
    first = df.agg(*[F.count(x).alias(f"n{i}") for i, x in enumerate(values)], *[_sketch(x, asked, accuracy).alias(f"s{i}") for i, x in enumerate(values)]).first()
    at, found = [], {}
    cuts: list[tuple[Range, int, float, float]] = []
    open_ranges: list[Range] = []
    for i in range(len(columns)):
        n = first[f"n{i}"]
        at.append(positions(n, qs) if n else [])
        whole = Range(i, None, None, 0, n)
        for j, (low, high, _) in enumerate(at[i]):
            for rank in dict.fromkeys((low, high)):
                if n <= bound:
                    whole.ranks.append(rank)
                else:
                    cuts.append((whole, rank, first[f"s{i}"][2 * j], first[f"s{i}"][2 * j + 1]))
        if whole.ranks:
            open_ranges.append(whole)
    while cuts:
        known, ranges = _split(df, values, cuts)
        found |= known
        open_ranges += [r for r in ranges if r.inside <= bound]
        large = [r for r in ranges if r.inside > bound]
        cuts = []
        if large:
            ask = [[f for k in r.ranks for f in ((k - r.below) / r.inside - margin, (k - r.below) / r.inside + margin)] for r in large]
            again = df.agg(*[_sketch(F.when(r.holds(values[r.column]), values[r.column]), fs, accuracy).alias(f"s{i}") for i, (r, fs) in enumerate(zip(large, ask, strict=True))]).first()
            cuts = [(r, k, again[i][2 * j], again[i][2 * j + 1]) for i, r in enumerate(large) for j, k in enumerate(r.ranks)]
    if open_ranges:
        found |= _pick(df, values, open_ranges)
    out: dict[str, list[float | None]] = {}
    for i, c in enumerate(columns):
        # between unequal values as a weighted sum, so that infinities of one sign stay
        out[c] = [found[i, a] if found[i, a] == found[i, b] else (b - p) * found[i, a] + (p - a) * found[i, b] for a, b, p in at[i]] or [None] * len(qs)
    return out
