"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints: A-Z lower-cased, words split at ASCII white space, ``k``-word
shingles hashed by XXH64 (seed 42); a bit is set if over half the hashes set it.  Wide fingerprints add
words of 64 bits, made of the same hashes mixed with the word's number.  Equal fingerprints are one node.

Narrow fingerprints (64 bits) link exactly: two within ``radius`` bits agree on ``m - radius`` of ``m``
segments, so each node is filed under every choice of ``m - radius`` segments.

Similarity links by the Jaccard similarity of the sets of shingle hashes: equal sets are one node, which has a wide
fingerprint of its set.  Candidates are found by the same bit-sliced comparison, at a radius that covers all but
one in a thousand pairs of this similarity, whatever the sets' sizes; nodes are filed under fixed choices of bits, so many that a pair
at the threshold shares a file with a chance of ``RECALL``.  What hangs together so is a crowd.  Inside a crowd links are exact: all sets
are compared with one hub's; those that are not linked to it are then compared with all, in tiles.

Only nodes filed together are compared.  There, the bits are stored as vertical planes over blocks of 64
fingerprints; planes of differences are summed by carry-save adders into counters that are bit planes too, 64
distances at once, and a block is abandoned once all its distances exceed the radius.  Crowded files are cut into
tiles whose pairs are separate work.  Each task sends a forest of links, not pairs.

Defined cases: null text is empty; no word gives fingerprint zero, which links like
any other; ``component_id`` is the smallest non-null id reachable (null if none); rows that share an id are rows of their own;
repeated rows give repeated rows; extra columns are ignored; empty tables give none.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.folds import fresh
from lodestone.operators.components import connected_components
from lodestone.plans.staging import stage

WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints in a tile of a crowded file, and the mean file size from which finer files are used.
TILE, MEAN_FILE = 2048, 256
#: Word operations on so many (fingerprint, block) pairs at once; it bounds a task's memory.
PAIRS = 1 << 15
#: Similarity: the chance that a pair at the threshold shares a file, the mean size of a file, and by how many standard
#: deviations of its distance a pair at the threshold may be further apart than expected.
RECALL, WIDE_FILE, SLACK = 0.999, 512, 3.0
#: Rows (about 40 bytes each) that may be broadcast.
BROADCAST_ROWS = 200_000
#: Sets in a tile of a crowd whose pairs are compared in a task.
CROWD_TILE = 512


def shingle_hashes(text: str | None, k: int = WORDS) -> np.ndarray:
    """The hashes of all ``k``-word shingles of one text, repeated ones too; a shorter text is one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    whole, h64 = b" ".join(words), xxhash.xxh64_intdigest
    starts = [0, *ends]
    n = max(1, len(words) - k + 1)
    return np.fromiter((h64(whole[a : b - 1], SEED) for a, b in zip(starts[:n], starts[min(k, len(words)) :], strict=False)), np.uint64, n)


def fingerprint(text: str | None, k: int = WORDS, wide: int = 1) -> list[int]:
    """The fingerprint of one text: ``wide`` words of 64 bits."""
    return _fingerprint(shingle_hashes(text, k), wide)


def _fingerprint(h: np.ndarray, wide: int) -> list[int]:
    n, out = len(h), []
    if not n:
        return [0] * wide
    for w in range(wide):
        g = h if w == 0 else (h ^ (h >> np.uint64(31)) ^ np.uint64(w)) * np.uint64(0x9E3779B97F4A7C15 + 2 * w)
        g = g if w == 0 else (g ^ (g >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        counts = np.zeros(64, np.int64)
        for i in range(0, n, 65536):
            counts += np.unpackbits(g[i : i + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0]))
    return out


def _fp(wide: int) -> list[str]:
    return [f"fp{i}" for i in range(wide)]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, wide: int = 1) -> DataFrame:
    """Rows ``(doc_id, fp0, ...)``; each column holds 64 bits as a signed long."""
    names = _fp(wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), k, wide) for t in batch.column(1)], np.uint64).reshape(-1, wide)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(fps[:, i]).view(np.int64)) for i in range(wide)]], ["doc_id", *names])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t"))
    return d.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def segment_masks(n: int, radius: int = RADIUS, mean: int = MEAN_FILE) -> list[int]:
    """Masks, one for each choice of ``m - radius`` of ``m`` segments, ``m`` by the number of fingerprints."""
    for m in range(radius + 1, 13):
        edges = [64 * i // m for i in range(m + 1)]
        segments = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
        if n <= mean << (64 * (m - radius) // m) or m == 12:
            break
    return [sum(c) for c in itertools.combinations(segments, m - radius)]


def agreement(similarity: float) -> float:
    """The chance that a bit agrees between two large sets of this Jaccard similarity, as it is for equal sizes (the least)."""
    return 1 - math.acos(2 * similarity / (1 + similarity)) / math.pi


def radius_of(similarity: Fraction, wide: int) -> int:
    """A distance of wide fingerprints that pairs of this similarity exceed but rarely.  The chance that a bit differs is the
    greatest of those of large sets and, counted exactly, of all pairs of small sets."""
    worst = 1 - agreement(float(similarity))
    for c in range(1, 41):
        common = [math.comb(c, i) / 2**c for i in range(c + 1)]
        most = int(c / similarity) - c  # elements that only one has
        for x in range(most + 1):
            y = most - x
            upper = [[sum(math.comb(z, j) for j in range(z + 1) if 2 * (i + j) > c + z) / 2**z for i in range(c + 1)] for z in (x, y)]
            worst = max(worst, sum(p * (u * (1 - v) + v * (1 - u)) for p, u, v in zip(common, *upper, strict=True)))
    n = 64 * wide
    return math.ceil(n * worst + SLACK * math.sqrt(n * worst * (1 - worst)))


def choice_masks(n: int, wide: int, similarity: float, mean: int | None = None) -> list[list[int]]:
    """For wide fingerprints: masks (one for each word) of fixed choices of bits, more bits for more fingerprints."""
    bits = max(0, math.ceil(math.log2(max(1, n) / (mean or WIDE_FILE))))
    share = agreement(similarity) ** bits
    times = math.ceil(math.log(1 - RECALL) / math.log(1 - share)) if bits else 1
    rng = np.random.default_rng(SEED)
    out = []
    for _ in range(times):
        chosen = rng.choice(64 * wide, bits, replace=False).tolist()
        out.append([sum(1 << (b % 64) for b in chosen if b // 64 == w) for w in range(wide)])
    return out


def _planes(fps: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints (rows, words): row ``b`` holds bit ``b`` of all, 64 of them in a word."""
    padded = np.zeros((-(-len(fps) // 64) * 64, fps.shape[1]), np.uint64)
    padded[: len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 64, 8 * fps.shape[1]), axis=2, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.transpose(2, 0, 1), axis=2, bitorder="little")).view(np.uint64)[:, :, 0]


def _adder(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry planes of three planes."""
    x = a ^ b
    return x ^ c, (a & b) | (x & c)


def _over(count: list[np.ndarray], radius: int) -> np.ndarray:
    """The lanes whose counter exceeds ``radius``."""
    above, equal = np.zeros_like(count[0]), ~np.zeros_like(count[0])
    for j in range(len(count) - 1, -1, -1):
        if radius >> j & 1:
            equal = equal & count[j]
        else:
            above |= equal & count[j]
            equal = equal & ~count[j]
    return above


def sliced_matches(query: np.ndarray, planes: np.ndarray, q: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pairs (query index, block index): those blocks with a lane within the radius, and the lanes' mask."""
    bits = len(planes)
    width = max(bits.bit_length(), (radius + 1).bit_length())
    count = [np.zeros(len(q), np.uint64) for _ in range(width)]
    over = np.zeros(len(q), np.uint64)
    ones = ~np.uint64(0)

    def differ(b: int) -> np.ndarray:
        if b >= bits:
            return np.zeros(len(q), np.uint64)
        sign = -((query[q, b // 64] >> np.uint64(b % 64)) & np.uint64(1)).astype(np.int64)
        return planes[b][block] ^ sign.view(np.uint64)

    for b in range(0, bits, 7):  # seven planes to a number of three bits, which is added to the counters
        d = [differ(b + i) for i in range(7)]
        s1, c1 = _adder(d[0], d[1], d[2])
        s2, c2 = _adder(d[3], d[4], d[5])
        s3, c3 = _adder(s1, s2, d[6])
        t, f = _adder(c1, c2, c3)
        carry = np.zeros(len(q), np.uint64)
        for j in range(width):
            add = (s3, t, f)[j] if j < 3 else None
            if add is None:
                count[j], carry = count[j] ^ carry, count[j] & carry
            else:
                count[j], carry = _adder(count[j], add, carry)
        if b + 7 > radius:
            over = _over(count, radius)
            keep = over != ones
            if not keep.all():
                q, block, over, count = q[keep], block[keep], over[keep], [c[keep] for c in count]
            if not len(q):
                break
    return q, block, ~over


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the label trees of the pairs (a, b) in place; every label ends at its tree's smallest index."""
    rest = label[a] != label[b]
    a, b = a[rest], b[rest]
    while len(a):
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label[:] = up
        rest = label[a] != label[b]
        a, b = a[rest], b[rest]


def links(fps: np.ndarray, files: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest of links inside each run of equal ``files``.  ``side`` 0: compare with all; a file with
    sides 1 and 2 only compares across them."""
    n = len(fps)
    label = np.arange(n)
    if n < 2:
        return label[:0], label[:0]
    first = np.flatnonzero(np.r_[True, files[1:] != files[:-1]])
    size = np.diff(np.r_[first, n])
    owner = np.repeat(np.arange(len(first)), size)
    blocks = -(-size // 64)
    base = np.r_[0, np.cumsum(blocks)]
    slot = np.arange(n) - first[owner] + base[owner] * 64  # each file starts a new block
    lanes = np.zeros((base[-1] * 64, fps.shape[1]), np.uint64)
    lanes[slot] = fps
    at = np.full(len(lanes), -1)
    at[slot] = np.arange(n)
    own = at >= 0
    planes = _planes(lanes)
    # a fingerprint meets only the blocks from its own on
    todo = base[owner + 1] - slot // 64
    todo[size[owner] < 2] = 0
    ends = np.cumsum(todo)
    start = 0
    while start < n:
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS)))
        q = np.repeat(np.arange(start, stop), todo[start:stop])
        block = slot[q] // 64 + np.arange(len(q)) - np.repeat(ends[start:stop] - todo[start:stop], todo[start:stop]) + (ends[start - 1] if start else 0)
        # a block whose lanes all hang together with the fingerprint has nothing to tell
        of = np.where(own, label[at], n)
        low = of.reshape(-1, 64).min(1)
        high = np.where(own, of, -1).reshape(-1, 64).max(1)
        open_ = (low[block] != label[q]) | (high[block] != label[q])
        q, block = q[open_], block[open_]
        q, block, mask = sliced_matches(fps, planes, q, block, radius)
        if len(q):
            hit = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            row, lane = np.nonzero(hit)
            a, b = q[row], at[block[row] * 64 + lane]
            ok = (b > a) & ((side[a] == 0) | (side[a] != side[b]))
            _merge(label, a[ok], b[ok])
        start = stop
    child = np.flatnonzero(label != np.arange(n))
    return child, label[child]


def near_links(nodes: DataFrame, radius: int = RADIUS, tile: int = TILE, n: int | None = None, similarity: float | None = None) -> DataFrame:
    """Rows ``(a, b)`` of nodes whose components are those of all pairs within ``radius`` bits (with ``similarity``: of those
    that share a file).  ``nodes``: distinct fingerprints ``fp0, ...`` and their names ``node``."""
    names = [c for c in nodes.columns if c.startswith("fp")]
    kind = dict(nodes.dtypes)["node"]
    n = nodes.count() if n is None else n
    masks = [[m] for m in segment_masks(n, radius)] if similarity is None else choice_masks(n, len(names), similarity)
    signed = [[m - (1 << 64) if m >> 63 else m for m in ms] for ms in masks]
    keys = F.array(*[F.xxhash64(F.lit(i), *[F.col(c).bitwiseAND(F.lit(m)) for c, m in zip(names, ms, strict=True)]) for i, ms in enumerate(signed)])
    filed = nodes.select("node", *names, F.explode(keys).alias("file"))
    crowded = filed.groupBy("file").count().where(F.col("count") > tile)
    crowded = crowded.select(F.col("file").alias("f"), F.ceil(F.col("count") / tile).cast("int").alias("g"))
    filed = filed.join(crowded, F.col("file") == F.col("f"), "left")
    t = F.pmod(F.xxhash64("node"), F.col("g")).cast("int")
    # tile t meets every tile u once: in the work unit (smaller, larger); side 0 compares within
    alone = filed.where("g is null").select("node", *names, "file", F.lit(0).alias("x"), F.lit(0).alias("y"), F.lit(0).alias("side"))
    cut = filed.where("g is not null").select("node", *names, "file", t.alias("t"), F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("u"))
    cut = cut.select("node", *names, "file", F.least("t", "u").alias("x"), F.greatest("t", "u").alias("y"), F.when(F.col("t") == F.col("u"), 0).when(F.col("t") < F.col("u"), 1).otherwise(2).alias("side"))
    work = alone.unionByName(cut).select("node", F.xxhash64("file", "x", "y").alias("unit"), "side", *names)
    work = work.repartition("unit").sortWithinPartitions("unit", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        units: list[np.ndarray] = []

        def flush(rows: pa.Table) -> pa.RecordBatch:
            unit, side, *fp = (rows.column(i).to_numpy() for i in range(1, 3 + len(names)))
            a, b = links(np.ascontiguousarray(np.stack(fp, 1)).view(np.uint64), unit, side, radius)
            node = rows.column(0).combine_chunks()
            return pa.RecordBatch.from_arrays([node.take(pa.array(a)), node.take(pa.array(b))], ["a", "b"])

        for batch in batches:
            held.append(batch)
            units.append(batch.column(1).to_numpy(zero_copy_only=False))
            if sum(map(len, units)) < 50_000:
                continue
            unit = np.concatenate(units)
            last = int(np.searchsorted(unit, unit[-1]))  # the last unit may go on
            rows = pa.Table.from_batches(held)
            if last:
                yield flush(rows[:last])
            held, units = rows[last:].to_batches(), [unit[last:]]
        if held:
            yield flush(pa.Table.from_batches(held))

    return work.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def set_name(h: np.ndarray) -> bytes:
    """The name of a set of hashes (sorted and distinct): 128 bits."""
    return xxhash.xxh3_128_digest(h.tobytes(), SEED)


def _sets(docs: DataFrame, id_col: str, text_col: str, k: int, wide: int) -> DataFrame:
    """Rows ``(doc_id, th, node, fp0, ...)``: a hash of the text, the name and the wide fingerprint of its set of shingles."""
    names = _fp(wide)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), k)) for t in batch.column(2)]
            fps = np.array([_fingerprint(h, wide) for h in sets], np.uint64).reshape(-1, wide)
            words = [pa.array(np.ascontiguousarray(fps[:, i]).view(np.int64)) for i in range(wide)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(set_name, sets), pa.binary()), *words], ["doc_id", "th", "node", *names])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("t"))
    return d.mapInArrow(run, "doc_id long, th long, node binary" + "".join(f", {c} long" for c in names))


def _few(df: DataFrame) -> DataFrame:
    """Broadcast only what was counted and is within the limit."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def _matches(docs: DataFrame, rows: DataFrame, id_col: str, text_col: str, how: str) -> DataFrame:
    """``docs`` whose id and hash of the text are (``left_semi``) or are not (``left_anti``) among ``rows``: ``(doc_id, th)``."""
    i, th = fresh("__row_id", docs), fresh("__row_th", docs)
    named = rows.select(F.col("doc_id").alias(i), F.col("th").alias(th))
    return docs.join(_few(named), docs[id_col].cast("long").eqNullSafe(F.col(i)) & (F.xxhash64(docs[text_col]) == F.col(th)), how)


def similar_links(docs: DataFrame, nodes: DataFrame, similarity: Fraction, *, wide: int, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, tile: int = TILE, crowd_tile: int | None = None) -> DataFrame:
    """Rows ``(a, b)`` of nodes whose components are those of the pairs of this similarity inside the crowds.
    ``nodes``: ``node``, ``best`` (a row that has it: ``no_id, doc_id, th``), ``fp0, ...``."""
    crowds = connected_components(near_links(nodes.select("node", *_fp(wide)), radius_of(similarity, wide), tile, similarity=float(similarity)))
    crowds = stage(crowds.join(nodes.select("node", "best.doc_id", "best.th"), "node"), "crowds")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                sets = [np.unique(shingle_hashes(t.as_py(), k)) for t in batch.column(0)[at : at + 256]]
                yield pa.RecordBatch.from_arrays([pa.array(map(set_name, sets), pa.binary()), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], ["node", "s"])

    # the sets are made anew, from one text each
    texts = _matches(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__t")), crowds.select("doc_id", "th"), "__id", "__t", "left_semi")
    made = texts.select("__t").mapInArrow(run, "node binary, s array<long>").dropDuplicates(["node"])
    sets = stage(made.join(crowds.select("node", "root", "doc_id"), "node"), "sets")
    hubs = sets.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("m")).select(F.col("root").alias("c"), F.col("m.node").alias("hub"))
    hubs = sets.select(F.col("node").alias("hub"), F.col("s").alias("hs")).join(hubs, "hub")
    both = F.size(F.array_intersect("s", "hs")).cast("long")
    near = both * similarity.denominator >= (F.size("s") + F.size("hs") - both) * similarity.numerator
    met = stage(sets.join(hubs, F.col("root") == F.col("c")).select("node", "root", "hub", near.alias("near")), "met")
    found = met.where("near and node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b"))
    units = _units(met, CROWD_TILE if crowd_tile is None else crowd_tile)

    def compare(rows: pa.Table) -> pa.Table:
        node = rows.column("node").combine_chunks()
        a, b = set_links([x.values.to_numpy() for x in rows.column("s")], rows.column("side").to_numpy(), similarity)
        return pa.table({"a": node.take(pa.array(a)), "b": node.take(pa.array(b))})

    more = units.join(sets.select("node", "s"), "node").groupBy("unit").applyInArrow(compare, "a binary, b binary")
    return found.unionByName(more).distinct()


def _units(met: DataFrame, tile: int) -> DataFrame:
    """Rows ``(node, unit, side)``: in each unit a tile of a crowd's nodes that are not near its hub meets itself, another such tile
    or a tile of those that are near (which hang together)."""
    sizes = met.groupBy(F.col("root").alias("c")).agg(F.count_if(~F.col("near")).alias("far"), F.count_if("near").alias("close"))
    sizes = sizes.where("far > 0").select("c", F.ceil(F.col("far") / tile).cast("int").alias("gf"), F.ceil(F.col("close") / tile).cast("int").alias("gc"))
    t = F.when(F.col("near"), F.col("gf") + F.pmod(F.xxhash64("node"), F.col("gc"))).otherwise(F.pmod(F.xxhash64("node"), F.col("gf"))).cast("int")
    last = F.when(F.col("near"), F.col("gf") - 1).otherwise(F.col("gf") + F.col("gc") - 1)
    # one row a crowd: counted, then broadcast, so that a crowd's nodes are not dealt by its root
    rows = met.join(_few(sizes), F.col("root") == F.col("c")).select("node", "root", t.alias("t"), F.explode(F.sequence(F.lit(0), last)).alias("u"))
    side = F.when(F.col("t") == F.col("u"), 0).when(F.col("t") < F.col("u"), 1).otherwise(2)
    return rows.select("node", F.struct("root", F.least("t", "u").alias("x"), F.greatest("t", "u").alias("y")).alias("unit"), side.alias("side"))


def set_links(sets: list[np.ndarray], side: np.ndarray, similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """A forest of links between sets of this similarity; ``side`` as in ``links``."""
    n = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), n)
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    whole = np.zeros((len(sets), len(sets)), np.int64)
    few = np.flatnonzero((count[column] > 1) & (count[column] <= 32))
    for d in range(1, 32):  # hashes of few sets: their pairs
        few = few[few + d < len(column)]
        few = few[column[few] == column[few + d]]
        if not len(few):
            break
        x, y = owner[few], owner[few + d]
        whole += np.bincount(np.minimum(x, y) * len(sets) + np.maximum(x, y), minlength=len(sets) ** 2).reshape(whole.shape)
    many = count[column] > 32
    owner, column = owner[many], (np.cumsum(count > 32) - 1)[column[many]]
    both, step = np.zeros(whole.shape, np.float32), 1024
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, step):  # of many: a product of bit matrices
        x, y = np.searchsorted(column, [start, start + step])
        has = np.zeros((len(sets), step), np.float32)
        has[owner[x:y], column[x:y] - start] = 1
        both += has @ has.T
    whole += both.astype(np.int64)
    hit = whole * similarity.denominator >= (n[:, None] + n[None, :] - whole) * similarity.numerator
    a, b = np.nonzero(np.triu(hit & ((side[:, None] == 0) | (side[:, None] != side[None, :])), 1))
    label = np.arange(len(sets))
    _merge(label, a, b)
    child = np.flatnonzero(label != np.arange(len(sets)))
    return child, label[child]


def _classes(docs: DataFrame, id_col: str, text_col: str, k: int, radius: int | None, tile: int, wide: int, similarity: float | None) -> DataFrame:
    """Rows ``(doc_id, th, fp0, ..., best)`` for each row of ``docs``; ``best`` names the first row of its component: ``no_id, doc_id, th``."""
    if (similarity is None) != (wide == 1):
        raise ValueError("wide fingerprints link by similarity, narrow ones by radius")
    names = _fp(wide)
    if similarity is None:
        fps = fingerprints(docs, id_col, text_col, k, wide).withColumn("node", F.col("fp0")).withColumn("th", F.lit(0).cast("long"))
    else:
        fps = _sets(docs, id_col, text_col, k, wide)
    fps = stage(fps, "fingerprints")
    row = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")
    nodes = stage(fps.groupBy("node").agg(F.min(row).alias("best"), *[F.first(c).alias(c) for c in names]), "nodes")
    if similarity is None:
        found = near_links(nodes.select("node", *names), RADIUS if radius is None else radius, tile)
    else:
        found = similar_links(docs, nodes, Fraction(str(similarity)), wide=wide, id_col=id_col, text_col=text_col, k=k, tile=tile)
    found = connected_components(found).select(F.col("node").alias("v"), "root")
    root = nodes.join(found, F.col("node") == F.col("v"), "left").select("node", "best", F.coalesce("root", "node").alias("root"))
    least = root.groupBy(F.col("root").alias("r")).agg(F.min("best").alias("least"))
    named = root.join(least, F.col("root") == F.col("r")).select(F.col("node").alias("f"), F.col("least").alias("best"))
    return fps.join(named, F.col("node") == F.col("f")).select("doc_id", "th", *names, "best")


def near_duplicates(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, radius: int | None = None, tile: int = TILE,
    wide: int = 1, similarity: float | None = None,
) -> DataFrame:
    """Rows ``(doc_id, fingerprint, component_id)``, one for each row of ``docs``.  Links: within ``radius`` bits (four), or
    at ``similarity`` or more of the sets of shingles; the fingerprint, of ``wide`` words, then is that of the set."""
    out = _classes(docs, id_col, text_col, k, radius, tile, wide, similarity)
    digits = F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in _fp(wide)])
    return out.select("doc_id", digits.alias("fingerprint"), F.col("best.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, wide: int = 4, similarity: float = 0.8, tile: int = TILE) -> DataFrame:
    """``docs`` with one row of each component: that with the smallest id, then the smallest hash of its text.  Rows are told apart by id and text: of rows that share an id, each component keeps its own; of a row that
    repeats, one stays.  A row without id has no name to be dropped by and stays."""
    rows = _classes(docs, id_col, text_col, k, None, tile, wide, similarity)
    first = F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("th") == F.col("best.th"))
    rows = stage(rows.groupBy("doc_id", "th").agg(F.min(first).alias("first"), F.count(F.lit(1)).alias("n")), "rows")
    left = _matches(docs, rows.where("doc_id is not null and not first"), id_col, text_col, "left_anti")
    again = rows.where("doc_id is not null and first and n > 1")
    if again.isEmpty():
        return left
    once = _matches(left, again, id_col, text_col, "left_anti")
    key = [fresh("__key_id", docs), fresh("__key_th", docs)]
    twice = _matches(left, again, id_col, text_col, "left_semi").withColumns({key[0]: F.col(id_col), key[1]: F.xxhash64(text_col)})
    return once.unionByName(twice.dropDuplicates(key).drop(*key))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
