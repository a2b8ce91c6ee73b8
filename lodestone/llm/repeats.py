"""Removal of repeated byte windows by depth-limited radix sort.

A byte goes if a ``window``-byte string that covers it also starts earlier in the
corpus.  The suffixes to order are cut to ``window`` bytes: most-significant-digit
passes (eight bytes a digit) refine groups of suffixes until the depth is reached,
and the groups that are left are exactly the repeated windows.

So that not every suffix travels, neighbouring windows travel together.  Each window
has an anchor, its ``gram``-byte string with the smallest hash; a run of windows with
one anchor is a segment.  Equal windows have equal anchors at equal offsets, so a
segment whose anchor occurs once in the corpus cannot repeat and is never sent.

1. Documents are dealt into chunks of about ``chunk_bytes`` by a hash of their id.
   Whole-text copies of a smaller id need no search; a chunk sends one row for each distinct text.
2. Each chunk sends the distinct anchor hashes it holds, with their counts; the sums tell which repeat.
3. Each chunk sends its segments with repeated anchors, equal ones once (the later ones are already
   known to go).  They are dealt by anchor.  Segments of a hot anchor are dealt by their own bytes first, so
   that equal ones of all chunks become one, and only then by anchor; those of a very hot anchor travel as single windows,
   dealt by their bytes, so that no task gathers them.
4. Each task radix-sorts the windows of its segments and sends back the spans that go.

The text is shuffled once and read three times from the same exchange.

Defined cases: null text is empty; texts under ``window`` bytes lose nothing; a null id
precedes all others; rows that share an id follow each other in text order, a repeated row
after its first; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.plans.staging import stage

WINDOW, GRAM = 100, 32
CHUNK_BYTES = 4 << 20
#: Occurrences of an anchor above which equal segments are joined first, and above which its windows travel one by one.
HOT, VERY_HOT = 4096, 1 << 19
#: Bytes hashed, and windows sorted, at once: they bound a task's memory.
SLICE, SORT_ROWS = 1 << 19, 1 << 17
FIRST = -(1 << 63)

_B = 0x9E3779B97F4A7C15
_BINV = pow(_B, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B**i and B**-i modulo 2**64 for i < n."""
    if _powers.get("n", 0) < n:  # type: ignore[call-overload]
        one = np.ones(n, np.uint64)
        up, down = one.copy(), one.copy()
        up[1:], down[1:] = np.uint64(_B), np.uint64(_BINV)
        _powers.update(n=n, t=(np.cumprod(up), np.cumprod(down)))  # type: ignore[call-overload]
    return _powers["t"]  # type: ignore[index]


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


class Runs:
    """Segments of a buffer: ``start`` (first window), ``n`` (windows), ``anchor`` (its position), ``key`` (its hash)."""

    def __init__(self, start, n, anchor, key):
        self.start, self.n, self.anchor, self.key = start, n, anchor, key


def anchor_runs(buf: np.ndarray, lengths: np.ndarray, window: int, gram: int) -> Runs:
    """The segments of all documents in ``buf``, which lie one after the other."""
    total = len(buf)
    valid = np.ones(max(0, total), bool)
    ends = np.cumsum(lengths)
    for e, n in zip(ends.tolist(), lengths.tolist(), strict=True):
        valid[max(e - n, e - window + 1) : e] = False
    parts: list[tuple] = []
    span = window - gram + 1
    for lo in range(0, total, SLICE):
        piece = buf[lo : lo + SLICE + window - 1]
        if len(piece) < window:
            break
        up, down = _power_tables(SLICE + window)
        s = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * down[: len(piece)], out=s[1:])
        h = _mixed((s[gram:] - s[:-gram]) * up[: len(piece) - gram + 1])
        v = (h & ~np.uint64(0xFFFFF)) | np.arange(len(h), dtype=np.uint64)  # ties: the leftmost
        width = 1
        while width < span:
            step = min(width, span - width)
            v = np.minimum(v[: len(v) - step], v[step:])
            width += step
        ok = valid[lo : lo + len(v)]
        p = np.flatnonzero(ok)
        if not len(p):
            continue
        at = (v[p] & np.uint64(0xFFFFF)).astype(np.int64)
        # no run may pass from one document to the next: the windows between are not valid
        cut = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (p[1:] != p[:-1] + 1)])
        parts.append((p[cut] + lo, np.diff(np.r_[cut, len(p)]), at[cut] + lo, h[at[cut]]))
    if not parts:
        z = np.zeros(0, np.int64)
        return Runs(z, z, z, np.zeros(0, np.uint64))
    return Runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def radix_order(*keys: np.ndarray) -> np.ndarray:
    """The stable order of rows by ``keys``, the least significant first, by counting sorts of 16-bit pieces."""
    order = np.arange(len(keys[0]))
    for key in keys:
        key = key.astype(np.uint64)
        spread = int(np.bitwise_or.reduce(key ^ key[0])) if len(key) else 0
        for shift in range(0, 64, 16):
            if spread >> shift & 0xFFFF:  # numpy sorts 16-bit integers stably by radix
                order = order[np.argsort((key >> np.uint64(shift)).astype(np.uint16)[order], kind="stable")]
    return order


def refine(group: np.ndarray, digits) -> tuple[np.ndarray, np.ndarray]:
    """Most-significant-digit radix passes: rows that share ``group`` and all of ``digits`` (functions of row numbers,
    by depth) stay together.  Returns the rows in groups of two or more, and their group."""
    rows, gid = np.arange(len(group)), np.asarray(group)
    for digit in [None, *digits]:
        d = None if digit is None else digit(rows)
        order = radix_order(gid) if d is None else radix_order(d, gid)
        gid, rows = gid[order], rows[order]
        new = np.r_[True, gid[1:] != gid[:-1]]
        if d is not None:
            d = d[order]
            new[1:] |= d[1:] != d[:-1]
        if not len(rows):
            break
        gid = np.cumsum(new) - 1
        size = np.bincount(gid)
        many = size[gid] > 1
        rows, gid = rows[many], gid[many]
    return rows, gid


def _firsts(rows: np.ndarray, gid: np.ndarray, order: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within each group: the row that comes first by (order, place), and all others."""
    by = np.lexsort((place[rows], order[rows], gid))
    rows, gid = rows[by], gid[by]
    head = np.r_[True, gid[1:] != gid[:-1]] if len(rows) else np.zeros(0, bool)
    return rows[head], rows[~head]


def _flat(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... of all pieces, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Chunk:
    """The documents of one chunk in their order: (id order, text).  ``first``: the smallest id order of a repeated text."""

    def __init__(self, table: pa.Table, first: dict[bytes, int]):
        columns = [table[c].to_pylist() for c in ("o", "body", "sha", "doc_id")]
        rows = sorted(zip(*columns, strict=True), key=lambda r: r[:2])
        self.ids, self.bodies = [r[3] for r in rows], [r[1] for r in rows]
        self.order = np.array([r[0] for r in rows], np.int64)
        self.copy = np.array([first.get(r[2], r[0]) < r[0] for r in rows], bool)

    def search(self, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Runs]:
        """The buffer of all texts that need a search, their row numbers and starts, and the segments."""
        row = np.array([i for i, b in enumerate(self.bodies) if len(b) >= window and not self.copy[i]], np.int64)
        length = np.array([len(self.bodies[i]) for i in row], np.int64)
        buf = np.frombuffer(b"".join(self.bodies[i] for i in row), np.uint8)
        return buf, row, np.cumsum(length) - length, anchor_runs(buf, length, window, gram)


#: What travels: segments by anchor, segments by their bytes, single windows, and spans that go (their end is ``place + n``).
BY_ANCHOR, BY_BYTES, ALONE, SPAN = range(4)
_ROW = pa.schema([
    ("route", pa.int64()), ("kind", pa.int32()), ("key", pa.int64()), ("o", pa.int64()), ("place", pa.int64()), ("chunk", pa.int64()),
    ("n", pa.int64()), ("lead", pa.int32()), ("body", pa.binary()),
])
_ROW_SQL = "route long, kind int, key long, o long, place long, chunk long, n long, lead int, body binary"
_ANCHOR_SQL = "key long, n long, chunk long"
_SPAN_SQL = "chunk long, a long, b long"


def _bodies(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> pa.Array:
    """Pieces of ``buf`` as binaries, without a loop."""
    ends = np.r_[0, np.cumsum(length)].astype(np.int32)
    data = np.ascontiguousarray(buf[_flat(start, length)])
    return pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(data)])


def _rows(kind: int, route, key, o, place, chunk, n, lead, body: pa.Array | None = None) -> pa.RecordBatch:
    k = len(place)
    arrays = [route.astype(np.uint64).view(np.int64), np.full(k, kind, np.int32), key.astype(np.uint64).view(np.int64), o, place, chunk, n.astype(np.int64), lead.astype(np.int32)]
    return pa.RecordBatch.from_arrays([*map(pa.array, arrays), pa.nulls(k, pa.binary()) if body is None else body], schema=_ROW)


def _spans(chunk: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    z = np.zeros(len(a), np.int64)
    return _rows(SPAN, _mixed(chunk.astype(np.uint64) + np.uint64(1)), z, z, a, chunk, b - a, z)


def _hashed(buf: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A hash of each piece of ``buf``."""
    digest = length.astype(np.uint64)
    up, _ = _power_tables(SLICE)
    live = np.arange(len(start))
    for j in range(int(length.max(initial=0))):
        live = live[length[live] > j]
        digest[live] += (buf[start[live] + j].astype(np.uint64) + np.uint64(1)) * up[j + 1]
    return _mixed(digest)


def _firsts_of_equal(buf, start, length, label, order, place) -> np.ndarray:
    """For each piece of ``buf`` the index of the first piece (by order, place) of its ``label`` and bytes."""
    first = np.arange(len(start))
    rows, gid = refine(_hashed(buf, start, length), [lambda r: label[r]])
    if not len(rows):
        return first
    heads, later = _firsts(rows, gid, order, place)
    head = np.zeros(len(start), np.int64)
    head[rows] = gid
    of = np.zeros(int(gid.max()) + 1, np.int64)
    of[head[heads]] = heads
    twin = of[head[later]]
    fits = length[later] == length[twin]
    later, twin = later[fits], twin[fits]
    for i in range(0, len(later), SORT_ROWS):  # equal hashes are compared
        x, y = later[i : i + SORT_ROWS], twin[i : i + SORT_ROWS]
        same = buf[_flat(start[x], length[x])] == buf[_flat(start[y], length[x])]
        equal = np.add.reduceat(~same, np.cumsum(length[x]) - length[x]) == 0
        first[x[equal]] = y[equal]
    return first


def send_anchors(chunk: int, docs: Chunk, window: int, gram: int) -> pa.Table:
    key, n = np.unique(docs.search(window, gram)[3].key, return_counts=True)
    return pa.table({"key": key.view(np.int64), "n": n.astype(np.int64), "chunk": np.full(len(key), chunk, np.int64)})


def send_segments(chunk: int, docs: Chunk, known: np.ndarray, total: np.ndarray, window: int, gram: int, hot: int, very_hot: int) -> pa.Table:
    """Segments whose anchor is among ``known`` (hashes, with their numbers of occurrences)."""
    if not len(known):
        return _ROW.empty_table()
    buf, row, base, runs = docs.search(window, gram)
    by = radix_order(known)
    known, total = known[by], total[by]
    at = np.minimum(np.searchsorted(known, runs.key), len(known) - 1)
    again = known[at] == runs.key
    start, n, anchor, key, count = runs.start[again], runs.n[again], runs.anchor[again], runs.key[again], total[at[again]]
    length, lead = n + window - 1, anchor - start
    owner = np.searchsorted(base, start, side="right") - 1
    place, order = (row[owner] << 40) | (start - base[owner]), docs.order[row[owner]]
    gone = _firsts_of_equal(buf, start, length, lead, order, place) != np.arange(len(start))
    chunks = np.full(len(start), chunk, np.int64)
    out = [_spans(chunks[gone], place[gone], place[gone] + length[gone])]
    for kind, part in ((BY_ANCHOR, count <= hot), (BY_BYTES, (count > hot) & (count <= very_hot)), (ALONE, count > very_hot)):
        s = np.flatnonzero(part & ~gone)
        if not len(s):
            continue
        if kind == ALONE:
            at, owner = _flat(start[s], n[s]), np.repeat(s, n[s])
            size = np.full(len(at), window)
            route = _hashed(buf, at, size)
            one, zero = np.ones(len(at), np.int64), np.zeros(len(at), np.int64)
            out.append(_rows(kind, route, route, order[owner], place[owner] + at - start[owner], chunks[owner], one, zero, _bodies(buf, at, size)))
        else:
            route = key[s] if kind == BY_ANCHOR else _hashed(buf, start[s], length[s])
            out.append(_rows(kind, route, key[s], order[s], place[s], chunks[s], n[s], lead[s], _bodies(buf, start[s], length[s])))
    return pa.Table.from_batches(out, _ROW)


class Segments:
    """Columns of travelling rows, as arrays."""

    def __init__(self, table: pa.Table):
        self.table = table.combine_chunks()
        self.route, self.kind, self.key, self.order, self.place, self.chunk, self.n, self.lead = (self.table[c].to_numpy().astype(np.int64) for c in _ROW.names[:8])
        body = self.table["body"].combine_chunks() if isinstance(self.table["body"], pa.ChunkedArray) else self.table["body"]
        ends = np.frombuffer(body.buffers()[1], np.int32, len(body) + 1, body.offset * 4).astype(np.int64) if len(body) else np.zeros(1, np.int64)
        self.begin, self.length = ends[:-1], np.diff(ends)
        self.buf = np.frombuffer(body.buffers()[2] or b"", np.uint8) if len(body) else np.zeros(0, np.uint8)


def repeated_spans(rows: Segments, s: np.ndarray, window: int, gram: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of the segments ``s``, with all of their anchors there, the spans ``(chunk, begin, end)`` that go."""
    wide = window - gram
    size = -(-(wide + window) // 8) * 8 + 8
    _, key = np.unique(rows.key[s], return_inverse=True)
    by_key = radix_order(key)
    s, key = s[by_key], key[by_key]
    ends = np.flatnonzero(np.r_[key[1:] != key[:-1], True]) + 1 if len(key) else np.zeros(0, np.int64)
    weight = np.cumsum(rows.n[s])
    lo = 0
    while lo < len(s):  # whole keys at a time
        limit = (weight[lo - 1] if lo else 0) + SORT_ROWS
        fits = ends[(ends > lo) & (weight[ends - 1] <= limit)]
        hi = int(fits[-1]) if len(fits) else int(ends[np.searchsorted(ends, lo, side="right")])
        yield from _spans_of_keys(rows, s[lo:hi], key[lo:hi] - key[lo], window, wide, size)
        lo = hi


def _spans_of_keys(rows: Segments, s: np.ndarray, key: np.ndarray, window: int, wide: int, size: int):
    n, lead, length, order, place, chunk = rows.n[s], rows.lead[s], rows.length[s], rows.order[s], rows.place[s], rows.chunk[s]
    frame = np.zeros((len(s), size), np.uint8)  # anchors in one column
    frame[np.repeat(np.arange(len(s)), length), _flat(wide - lead, length)] = rows.buf[_flat(rows.begin[s], length)]
    digits = frame.view(">u8")
    found, gid = refine(key, [lambda r: (n * (2 * window) + lead)[r], *[lambda r, c=c: digits[r, c].astype(np.uint64) for c in range(digits.shape[1])]])
    _, later = _firsts(found, gid, order, place)
    yield chunk[later], place[later], place[later] + length[later]
    left = np.ones(len(s), bool)
    left[later] = False
    heads = np.flatnonzero(left)
    several = np.bincount(key[heads], minlength=int(key.max(initial=0)) + 1)[key[heads]] > 1
    heads = heads[several]  # distinct segments of one anchor: sort their windows
    low = wide - lead
    if n[heads].sum() <= 4 * SORT_ROWS:
        columns = [(0, wide + 1)]
    else:  # windows at different columns differ: some columns at a time
        step = max(1, SORT_ROWS // len(heads))
        columns = [(c, min(wide + 1, c + step)) for c in range(0, wide + 1, step)]
    for first, last in columns:
        a, b = np.maximum(low[heads], first), np.minimum(low[heads] + n[heads], last)
        some = b > a
        w = np.repeat(heads[some], (b - a)[some])
        column = _flat(a[some], (b - a)[some])

        def digit(c, w=w, column=column):
            def of(r):
                at = column[r] + c
                d = np.zeros(len(r), np.uint64)
                for j in range(min(8, window - c)):
                    d = (d << np.uint64(8)) | frame[w[r], at + j]
                return d

            return of

        found, gid = refine(key[w] * (2 * window) + column, [digit(c) for c in range(0, window, 8)])
        at = place[w] + column - low[w]
        _, later = _firsts(found, gid, order[w], at)
        yield chunk[w[later]], at[later], at[later] + window


def resolve(tables: Iterator[pa.RecordBatch], window: int, gram: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (route, o, place) to spans that go; the first of equal ``BY_BYTES`` rows go on, dealt by anchor."""

    def flush(held: list[pa.RecordBatch], end: bool) -> Iterator[pa.RecordBatch]:
        rows = Segments(pa.Table.from_batches(held, _ROW))
        if not len(rows.route):
            return
        last = rows.route == rows.route[-1]
        keep = np.zeros(len(last), bool)
        spans = []
        for kind in (BY_ANCHOR, BY_BYTES, ALONE):
            s = np.flatnonzero(rows.kind == kind)
            if kind == BY_ANCHOR:
                if not end:
                    keep[s] = last[s]
                    s = s[~last[s]]
                spans += repeated_spans(rows, s, window, gram)
                continue
            if not len(s):
                continue
            first = s[_firsts_of_equal(rows.buf, rows.begin[s], rows.length[s], rows.lead[s], rows.order[s], rows.place[s])]
            later = first != s
            spans.append((rows.chunk[s[later]], rows.place[s[later]], rows.place[s[later]] + rows.length[s[later]]))
            s = s[~later]
            if not end:
                keep[s] = last[s]
                s = s[~last[s]]
            if kind == BY_BYTES:
                for i in range(0, len(s), SORT_ROWS):
                    part = s[i : i + SORT_ROWS]
                    moved = _rows(BY_ANCHOR, *(x[part] for x in (rows.key, rows.key, rows.order, rows.place, rows.chunk, rows.n, rows.lead)), _bodies(rows.buf, rows.begin[part], rows.length[part]))
                    yield moved
        passed = np.flatnonzero(rows.kind == SPAN)
        spans.append((rows.chunk[passed], rows.place[passed], rows.place[passed] + rows.n[passed]))
        chunk, a, b = (np.concatenate(x) for x in zip(*spans, strict=True))
        by = radix_order(a, chunk)  # spans that touch become one
        yield _spans(*merged(chunk[by], a[by], b[by]))
        rest[:] = rows.table.filter(pa.array(keep)).to_batches()

    rest: list[pa.RecordBatch] = []
    size = 0
    for batch in tables:
        for i in range(0, batch.num_rows, SORT_ROWS):
            part = batch.slice(i, SORT_ROWS)
            rest.append(part)
            size += part.num_rows
            if size >= SORT_ROWS:
                yield from flush(list(rest), False)
                size = sum(x.num_rows for x in rest) // 2  # what is left of one route may fill a batch
    if rest:
        yield from flush(list(rest), True)


def merged(chunk: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of the spans [a, b) of each chunk, sorted by (chunk, a), as spans that do not touch."""
    cut = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1], True]) if len(a) else np.zeros(0, np.int64)
    parts = []
    for lo, hi in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
        x, reach = a[lo:hi], np.maximum.accumulate(b[lo:hi])
        new = np.flatnonzero(np.r_[True, x[1:] > reach[:-1]])
        parts.append((chunk[lo + new], x[new], reach[np.r_[new[1:] - 1, hi - lo - 1]]))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (chunk, a, b)


def results(docs: Chunk, a: np.ndarray, b: np.ndarray, window: int, with_text: bool) -> pa.Table:
    spans: list[list[tuple[int, int]]] = [[] for _ in docs.bodies]
    by = radix_order(a)
    _, a, b = merged(np.zeros(len(a), np.int64), a[by], b[by])
    base = (a >> 40) << 40
    for row, x, y in zip((a >> 40).tolist(), (a - base).tolist(), (b - base).tolist(), strict=True):
        spans[row].append((x, y))
    out: dict[str, list] = {k: [] for k in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept")}
    for i, body in enumerate(docs.bodies):
        mine = [(0, len(body))] if docs.copy[i] and len(body) >= window else spans[i]
        kept, at = [], 0
        for x, y in mine:
            kept.append(body[at:x])
            at = y
        kept.append(body[at:])
        whole = b"".join(kept)
        out["doc_id"].append(docs.ids[i])
        out["n_bytes"].append(len(body))
        out["n_removed"].append(len(body) - len(whole))
        out["n_spans"].append(len(mine))
        out["kept_sha256"].append(hashlib.sha256(whole).hexdigest())
        out["spans"].append([{"begin": x, "end": y} for x, y in mine] if with_text else None)
        out["kept"].append(whole if with_text else None)
    return pa.Table.from_pydict(out, schema=_RESULT)


_RESULT = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
    ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary()),
])
_RESULT_SQL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<begin:long,end:long>>, kept binary"


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM,
    chunk_bytes: int = CHUNK_BYTES, hot: int = HOT, very_hot: int = VERY_HOT, with_text: bool = True,
) -> DataFrame:
    """One row for each row of ``docs``: ``doc_id``, counts, the spans that go and the bytes that stay
    (``spans`` and ``kept`` are null unless ``with_text``)."""
    if not 8 <= gram <= window <= 4096:
        raise ValueError("8 <= gram <= window <= 4096 is needed")
    body = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(id_col).cast("long"), F.lit(FIRST)).alias("o"), body.alias("body"))
    total = d.agg(F.sum(F.length("body"))).first()[0] or 0
    chunks = max(1, -(-total // chunk_bytes))
    d = d.withColumn("chunk", F.pmod(F.xxhash64("o"), F.lit(chunks))).withColumn("sha", F.unhex(F.sha2("body", 256)))

    # a row for each chunk and distinct text, with the text's smallest id where it is smaller elsewhere or repeated here
    same = d.where(F.length("body") >= window).groupBy("chunk", "sha").agg(F.min("o").alias("o"), F.count(F.lit(1)).alias("n"))
    first = same.groupBy(F.col("sha").alias("s")).agg(F.min("o").alias("first"), F.sum("n").alias("all")).where("all > 1")
    copies = stage(same.join(first, F.col("sha") == F.col("s")).select("chunk", "sha", "first"), "copies")

    def chunked(run, side: DataFrame, schema: str):
        def of(key, left, right):
            told = right.filter(pc.is_valid(right["sha"]))
            return run(key[0].as_py(), Chunk(left, dict(zip(told["sha"].to_pylist(), told["first"].to_pylist(), strict=True))), right.filter(pc.is_null(right["sha"])))

        side = copies.unionByName(side, allowMissingColumns=True)
        # new names for both sides, which come from one table; the text's exchange is still the same each time
        text = d.select(F.col("chunk").alias("t_chunk"), *[F.col(c).alias(c) for c in ("doc_id", "o", "body", "sha")])
        side = side.select(F.col("chunk").alias("s_chunk"), *[F.col(c).alias(c) for c in side.columns if c != "chunk"])
        return text.groupBy("t_chunk").cogroup(side.groupBy("s_chunk")).applyInArrow(of, schema)

    def dealt(rows: DataFrame) -> DataFrame:
        rows = rows.repartition("route").sortWithinPartitions("route", "o", "place")
        return rows.mapInArrow(lambda batches: resolve(batches, window, gram), _ROW_SQL)

    def columns(rows: pa.Table, *names: str) -> list[np.ndarray]:
        return [rows[c].to_numpy() for c in names]

    anchors = chunked(lambda c, x, _: send_anchors(c, x, window, gram), d.select("chunk").limit(0), _ANCHOR_SQL).repartition("key")
    # both sides use all columns, so that one exchange serves both
    repeated = anchors.groupBy(F.col("key").alias("k")).agg(F.sum("n").alias("total"), F.max("chunk").alias("last")).where("total > 1 and last >= 0")
    repeated = anchors.select(*[F.col(c).alias(c) for c in ("key", "n", "chunk")]).join(repeated, F.col("key") == F.col("k")).select("chunk", "key", F.greatest("total", "n").alias("total"))

    def segments(c, x, told):
        known, count = columns(told, "key", "total")
        return send_segments(c, x, known.astype(np.int64).view(np.uint64), count, window, gram, hot, very_hot)

    spans = dealt(dealt(chunked(segments, repeated, _ROW_SQL))).select("chunk", F.col("place").alias("a"), (F.col("place") + F.col("n")).alias("b"))
    return chunked(lambda _, x, told: results(x, *(v.astype(np.int64) for v in columns(told, "a", "b")), window, with_text), spans, _RESULT_SQL)


def query(spark, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)
    return found.drop("spans", "kept")
