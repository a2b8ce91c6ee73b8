"""Exact top-k neighbours of binary codes by incremental multi-index hashing.

A vector's code has one bit for each component, set if it is positive.  The code is cut
into ``m`` segments and filed under each segment's value.  A code within distance
``m * (r + 1) - 1`` of a query agrees with it on some segment up to ``r`` bits, so the
search grows the segment radius ``r`` from zero, verifies the codes it meets, and drops
a query once its k-th verified distance is covered by the radius reached.

The files are cut into chunks by the high bits of a segment's value (crowded ones further, by id).  Codes and queries
meet in a chunk's task, which makes the probes of the low bits itself and passes on no more than ``k + 1`` codes
of a query that are not beyond its k-th distance so far: neither probes nor their hits are shuffled or broadcast.

Equal codes are one entry that carries its ``k + 1`` smallest ids: a neighbour list needs
no more of them, so a crowd of copies costs no more than one code.  Equal queries
are searched once.

Defined cases: neighbours are ordered by (distance, id) and a row is not its own neighbour;
null vectors and null ids are neither queries nor neighbours; null or NaN components and
those missing from shorter vectors are zero bits; repeated ids are listed once (their first
code by bit pattern); fewer than k other ids give all of them; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lodestone.plans.staging import stage

K, QUERY_STEP = 10, 50
#: Distinct codes of a chunk, up to twice as many: what a task holds.  At most 2 ** MAX_HIGH values of a segment's high bits tell chunks apart.
CHUNK_CODES, MAX_HIGH = 1 << 18, 10
#: Probes made at a time, and codes met at a time (a chunk more at most).
PROBES, MEETINGS = 1 << 17, 1 << 20


def segments(bits: int, n: int) -> list[tuple[int, int, int]]:
    """Segments (word, shift, width): each about log2(n) bits or longer, so that a file holds about one code."""
    out = []
    for w in range(-(-bits // 64)):
        size = min(64, bits - 64 * w)
        m = max(1, -(-size // 22), int(size / max(4.0, math.log2(max(n, 2)))))
        edges = [size * i // m for i in range(m + 1)]
        out += [(w, a, b - a) for a, b in itertools.pairwise(edges)]
    return out


def codes(df: DataFrame, id_col: str, vector_col: str, bits: int) -> DataFrame:
    """Rows ``(id, code)``: the code as an array of 64-bit words."""
    words = -(-bits // 64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            size = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            on = np.zeros((batch.num_rows, 64 * words), bool)
            row = np.repeat(np.arange(batch.num_rows), size)
            on[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat > 0
            code = np.packbits(on, axis=1, bitorder="little").view(np.int64)
            out = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * words, pa.int32()), pa.array(code.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), out], ["id", "code"])

    d = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).dropna()
    return d.mapInArrow(run, "id long, code array<long>")


def layout(entries: DataFrame, words: list[str], segs: list[tuple[int, int, int]], chunk: int) -> tuple[list[int], np.ndarray]:
    """How the files are cut into chunks: each segment's low bits, and rows ``(seg, prefix, salts, first)`` of its values' high bits.

    Codes whose segments share their high bits are one chunk, or as many as hold ``chunk`` codes each: they are numbered from ``first``.
    """
    n = entries.count()
    high = [min(width, MAX_HIGH, max(0, math.ceil(math.log2(max(1, n) / chunk)))) for _, _, width in segs]
    low = [width - h for (_, _, width), h in zip(segs, high, strict=True)]
    prefix = [F.shiftrightunsigned(F.col(words[w]), shift + lw).bitwiseAND(F.lit((1 << h) - 1)) for (w, shift, _), lw, h in zip(segs, low, high, strict=True)]
    pairs = F.explode(F.array(*[F.struct(F.lit(j).alias("seg"), x.cast("long").alias("prefix")) for j, x in enumerate(prefix)])).alias("s")
    counts = entries.select(pairs).groupBy("s.seg", "s.prefix").count().collect()  # 2 ** MAX_HIGH for each segment, at most
    rows, first = [], 0
    for j, p, c in sorted(tuple(r) for r in counts):
        salts = -(-c // chunk) if c > 2 * chunk else 1
        rows.append((j, p, salts, first))
        first += salts
    return low, np.array(rows, np.int64).reshape(-1, 4)


def numbers(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).to_numpy(zero_copy_only=False)


def deal(rows: DataFrame, words: list[str], segs: list[tuple[int, int, int]], low: list[int], parts: np.ndarray, r: int | None) -> DataFrame:
    """``rows`` with the chunks ``g`` they are filed in or, with ``r``, of those that may hold values within exactly ``r`` bits of theirs."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                for j, (w, shift, width) in enumerate(segs):
                    own = parts[parts[:, 0] == j]
                    code = numbers(batch, words[w]).view(np.uint64)
                    mine = ((code >> np.uint64(shift + low[j])) & np.uint64((1 << (width - low[j])) - 1)).astype(np.int64)
                    if r is None:
                        at, to = np.arange(batch.num_rows), np.searchsorted(own[:, 1], mine)
                        salt = (numbers(batch, "id").view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)
                        g = own[to, 3] + salt % own[to, 2]
                    else:
                        off = np.bitwise_count(mine[:, None] ^ own[None, :, 1]).astype(np.int64)
                        at, to = np.nonzero((off <= r) & (r - off <= low[j]))
                        n = own[to, 2]
                        at, g = np.repeat(at, n), np.repeat(own[to, 3] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                    if len(at):
                        columns = [c.take(pa.array(at)) for c in batch.columns]
                        yield pa.RecordBatch.from_arrays([*columns, pa.array(g.astype(np.int32))], [*names, "g"])

    return rows.mapInArrow(run, ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", g int")


class Chunk:
    """Distinct codes of one chunk, filed by the low bits of their segment."""

    def __init__(self, seg: int, prefix: int, words: np.ndarray, ids: np.ndarray, copies: np.ndarray, segs: list[tuple[int, int, int]], low: int) -> None:
        self.seg, self.prefix, self.segs, self.low = seg, prefix, segs, low
        key = self.lows(words)
        order = np.argsort(key, kind="stable")
        self.key, self.words, self.ids, self.copies = key[order], np.ascontiguousarray(words[:, order]), ids[order], copies[order]
        self.starts = np.zeros((1 << low) + 1, np.int64)
        np.cumsum(np.bincount(key, minlength=1 << low), out=self.starts[1:])

    def lows(self, words: np.ndarray) -> np.ndarray:
        w, shift, _ = self.segs[self.seg]
        return ((words[w] >> np.uint64(shift)) & np.uint64((1 << self.low) - 1)).astype(np.int64)

    def meet(self, asked: np.ndarray, rest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, place) whose low bits differ in exactly ``rest``; a bounded number at a time."""
        mine = self.lows(asked)
        flips = np.arange(1 << self.low)
        flips = flips[np.bitwise_count(flips) == rest]
        if len(flips) > len(self.key):  # fewer values are filed here than could be probed
            step = max(1, PROBES // max(1, len(self.key)))
            for i in range(0, len(mine), step):
                q, place = np.nonzero(np.bitwise_count(mine[i : i + step, None] ^ self.key[None, :]) == rest)
                yield q + i, place
            return
        step = max(1, PROBES // max(1, len(flips)))
        for i in range(0, len(mine), step):
            keys = (mine[i : i + step, None] ^ flips[None, :]).ravel()
            begin = self.starts[keys]
            size = self.starts[keys + 1] - begin
            some = np.nonzero(size)[0]
            begin, size, query = begin[some], size[some], some // len(flips) + i
            ends = np.cumsum(size)
            cuts = np.searchsorted(ends, np.arange(MEETINGS, ends[-1] if len(ends) else 0, MEETINGS)) + 1
            for a, b in itertools.pairwise([0, *np.unique(cuts).tolist(), len(some)]):
                if a < b:
                    n = size[a:b]
                    e = np.cumsum(n)
                    yield np.repeat(query[a:b], n), np.repeat(begin[a:b] - (e - n), n) + np.arange(e[-1])

    def search(self, asked: np.ndarray, bound: np.ndarray, r: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(query, place, distance): the ``k + 1`` nearest of each query that are met here in round ``r``, none beyond its bound."""
        w, shift, width = self.segs[self.seg]
        high = ((asked[w] >> np.uint64(shift + self.low)) & np.uint64((1 << (width - self.low)) - 1)).astype(np.int64)
        rest = r - np.bitwise_count(high ^ self.prefix).astype(np.int64)
        kept = []
        for some in (np.nonzero(rest == x)[0] for x in range(r + 1)):
            if not len(some):
                continue
            for q, place in self.meet(asked[:, some], int(rest[some[0]])):
                q = some[q]
                distance = np.zeros(len(q), np.int32)
                for own, other in zip(self.words, asked, strict=True):
                    distance += np.bitwise_count(own[place] ^ other[q])
                near = np.nonzero(distance <= bound[q])[0]
                q, place, distance = q[near], place[near], distance[near]
                # a pair counts in the round of its nearest segment, and there at the first such segment: it is met once
                first = np.ones(len(q), bool)
                for j, (wj, sj, width_j) in enumerate(self.segs):
                    mask = np.uint64(((1 << width_j) - 1) << sj)
                    apart = np.bitwise_count((self.words[wj][place] ^ asked[wj][q]) & mask)
                    first &= apart > r if j < self.seg else apart >= r
                kept.append((q[first], place[first], distance[first]))
                if sum(len(x[0]) for x in kept) > MEETINGS:
                    kept = [self.best(kept, k)]
        if kept:
            yield self.best(kept, k)

    def best(self, kept: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
        q, place, distance = (np.concatenate(x) for x in zip(*kept, strict=True))
        order = np.lexsort((self.ids[place], distance, q))
        q, place, distance = q[order], place[order], distance[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        return q[rank <= k], place[rank <= k], distance[rank <= k]


def searched(rows: DataFrame, words: list[str], segs: list[tuple[int, int, int]], low: list[int], parts: np.ndarray, r: int, k: int) -> DataFrame:
    """Rows ``(q, e, n, distance)`` that round ``r`` meets: ``rows`` hold each chunk's codes and, after them, its queries."""
    place_of = np.repeat(np.arange(len(parts)), parts[:, 2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, chunk = -1, [], None
        for batch in batches:
            g, kind, ids, x = (numbers(batch, c) for c in ("g", "kind", "id", "x"))
            code = np.stack([numbers(batch, w).view(np.uint64) for w in words])
            edges = [0, *(np.nonzero((np.diff(g) != 0) | (np.diff(kind) != 0))[0] + 1).tolist(), batch.num_rows]
            for a, b in itertools.pairwise(edges):
                if a == b:
                    continue
                if g[a] != now:
                    now, held, chunk = g[a], [], None
                if not kind[a]:
                    held.append((code[:, a:b], ids[a:b], x[a:b]))
                    continue
                if chunk is None:
                    if not held:
                        continue
                    seg, prefix = parts[place_of[now], :2].tolist()
                    own, names, copies = (np.concatenate(c, axis=-1) for c in zip(*held, strict=True))
                    chunk, held = Chunk(seg, prefix, own, names, copies, segs, low[seg]), []
                for q, place, distance in chunk.search(code[:, a:b], x[a:b], r, k):
                    columns = [ids[a:b][q], chunk.ids[place], chunk.copies[place].astype(np.int32), distance.astype(np.int32)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["q", "e", "n", "distance"])

    return rows.mapInArrow(run, "q long, e long, n int, distance int")


def top_k(
    df: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K, query_step: int = QUERY_STEP, broadcast_rows: int | None = None, chunk_codes: int = CHUNK_CODES,
) -> DataFrame:
    """Rows ``(query_id, rank, neighbor_id, distance)``: the ``k`` nearest of each row whose id is divisible by ``query_step``.

    ``broadcast_rows`` has no effect any more: neither codes nor probes are broadcast.
    """
    spark = df.sparkSession
    size, bits = df.select(F.count(id_col), F.max(F.size(vector_col))).first()
    bits = max(1, bits or 1)
    segs = segments(bits, size)
    m = len(segs)
    ws = [f"w{i}" for i in range(-(-bits // 64))]
    rows = codes(df, id_col, vector_col, bits).groupBy("id").agg(F.min("code").alias("code"))
    rows = stage(rows.select("id", *[F.col("code")[i].alias(w) for i, w in enumerate(ws)]), "codes")

    # k + 1 smallest ids of each code, by a limited window: no code gathers all its copies.  The first names the code.
    rank = F.row_number().over(Window.partitionBy(*ws).orderBy("id"))
    few = rows.withColumn("rn", rank).where(F.col("rn") <= k + 1)
    entries = few.groupBy(*ws).agg(F.sort_array(F.collect_list("id")).alias("ids"))
    entries = stage(entries.select(*ws, "ids", F.col("ids")[0].alias("e"), F.size("ids").alias("n")), "entries")
    queries = rows.where(F.col("id") % query_step == 0)
    asked = queries.select(*ws).distinct().join(entries.select("e", *ws), ws).select(F.col("e").alias("q"), F.lit(64 * len(ws)).alias("bound"), *ws)

    # chunks of some size, and enough of them for all cores; the pairs they meet are the same
    chunk = max(1, min(chunk_codes, max(4096, size * m // (4 * spark.sparkContext.defaultParallelism))))
    low, parts = layout(entries, ws, segs, chunk)
    n_chunks = int(parts[:, 2].sum())
    filed = deal(entries.select(F.lit(0).alias("kind"), F.col("e").alias("id"), F.col("n").alias("x"), *ws), ws, segs, low, parts, None)

    left = stage(asked, "left")
    best = Window.partitionBy("q").orderBy("distance", "e")
    ids_so_far = F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    met: DataFrame | None = None
    done: list[DataFrame] = []
    for r in range(max(width for _, _, width in segs) + 1):
        if left.isEmpty():
            break
        probes = deal(left.select(F.lit(1).alias("kind"), F.col("q").alias("id"), F.col("bound").alias("x"), *ws), ws, segs, low, parts, r)
        # a chunk's codes come before its queries, which pass by: nothing but one chunk is ever held
        together = filed.unionByName(probes).repartition(n_chunks, "g").sortWithinPartitions("g", "kind")
        new = searched(together, ws, segs, low, parts, r, k)
        if met is not None:
            new = met.join(left.select("q"), "q", "left_semi").select("q", "e", "n", "distance").unionByName(new)
        # k + 1 codes hold k + 1 ids at least
        ranked = new.withColumn("rn", F.row_number().over(best)).where(F.col("rn") <= k + 1).drop("rn")
        met = stage(ranked.withColumn("so_far", ids_so_far), "met")
        covered = m * (r + 1) - 1
        # k + 1 ids (the query among them) lie within the bound; a query rests once the bound is covered
        bounds = met.where(F.col("so_far") > k).groupBy("q").agg(F.min("distance").alias("bound"))
        left = left.withColumnRenamed("bound", "before").join(bounds, "q", "left").withColumn("bound", F.coalesce("bound", "before")).drop("before")
        left = stage(left, "left")
        done.append(stage(met.join(left.where(F.col("bound") <= covered).select("q"), "q", "left_semi").select("q", "e", "n", "distance"), "done"))
        left = left.where(F.col("bound") > covered)
    if met is not None:
        done.append(met.join(left.select("q"), "q", "left_semi").select("q", "e", "n", "distance"))  # every segment value was tried
    found = spark.createDataFrame([], "q long, e long, n int, distance int")
    for part in done:
        found = found.unionByName(part)
    one = found.join(entries.select("e", "ids"), "e").select("q", "distance", F.explode("ids").alias("neighbor_id"))
    named = queries.join(entries.select("e", *ws), ws).select(F.col("id").alias("query_id"), F.col("e").alias("q"))
    pairs = named.join(one, "q").where("query_id <> neighbor_id")
    order = Window.partitionBy("query_id").orderBy("distance", "neighbor_id")
    out = pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "neighbor_id", "distance")


SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 AND NOT isnan(x) THEN 1 ELSE 0 END) AS b FROM embeddings),
p AS (SELECT q.vec_id AS query_id, n.vec_id AS neighbor_id,
        list_sum(list_transform(list_zip(q.b, n.b), lambda z: abs(z[1] - z[2])))::INTEGER AS distance
      FROM c q JOIN c n ON q.vec_id <> n.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, neighbor_id, distance FROM r WHERE rank <= 10
"""


def query(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
