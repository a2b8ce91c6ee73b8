"""String normalisation and similarity."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNICODE_FORMS = ("NFC", "NFKC", "NFD", "NFKD")


@dataclass(frozen=True)
class StringNormalization:
    """Order: Unicode form, replacements, trim, white space runs, lower case, null tokens."""

    unicode_form: str | None = "NFKC"
    trim: bool = True
    collapse_whitespace: bool = True
    lowercase: bool = True
    null_tokens: tuple[str, ...] = ("",)
    regex_replacements: tuple[tuple[str, str], ...] = ()

    def __post_init__(self):
        if self.unicode_form is not None and self.unicode_form not in UNICODE_FORMS:
            raise ValueError(f"unknown Unicode form {self.unicode_form!r}")
        if len(set(self.null_tokens)) != len(self.null_tokens):
            raise ValueError("null tokens must be unique")
        if any(not pattern for pattern, _ in self.regex_replacements):
            raise ValueError("replacement patterns must not be empty")


def _unicode(form: str):
    @F.pandas_udf(T.StringType())
    def apply(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize(form, x))

    return apply


def normalize(c: Column, options: StringNormalization, ascii_only: bool = False) -> Column:
    """The normalised string.  With ``ascii_only`` the caller vouches that no Unicode form can change
    the text, and the expression stays in the JVM."""

    def steps(x: Column) -> Column:
        for pattern, replacement in options.regex_replacements:
            x = F.regexp_replace(x, pattern, replacement)
        if options.trim:
            x = F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
        if options.collapse_whitespace:
            x = F.regexp_replace(x, r"(?U)\s+", " ")
        return F.lower(x) if options.lowercase else x

    text = c.cast("string")
    if options.unicode_form and not ascii_only:
        text = _unicode(options.unicode_form)(text)
    text = steps(text)
    tokens = [steps(F.lit(unicodedata.normalize(options.unicode_form, t) if options.unicode_form else t)) for t in options.null_tokens]
    missing = F.lit(False)
    for token in tokens:
        missing = missing | (text == token)
    return F.when(~missing, text)


#: Characters from which pairs are compared one by one, with sets of positions as whole numbers.
LONG = 128


def long_jaro_winkler(a: str, b: str) -> float:
    """Similarity of one pair; the open positions of a character are the bits of a number, so that a step costs a few
    machine words for each 64 characters within reach."""
    if not a or not b:
        return float(a == b)
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    codes, open_ = np.frombuffer(b.encode("utf-32-le", "surrogatepass"), np.uint32), {}
    for c in set(a) & set(b):
        open_[c] = int.from_bytes(np.packbits(codes == ord(c), bitorder="little").tobytes(), "little")
    taken: list[int] = []
    kept: list[str] = []
    for i, c in enumerate(a):
        mask = open_.get(c, 0)
        if not mask:
            continue
        lo = max(0, i - reach)
        near = mask >> lo & (1 << (i + reach + 1 - lo)) - 1
        if near:
            j = lo + (near & -near).bit_length() - 1
            open_[c] = mask ^ 1 << j
            taken.append(j)
            kept.append(c)
    m = len(kept)
    if not m:
        return 0.0
    moved = sum(x != b[j] for x, j in zip(kept, sorted(taken), strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


def jaro_winkler(a: list[str], b: list[str]) -> np.ndarray:
    """Similarities of pairs of strings by code points, all pairs at once; two empty strings are alike."""
    n = len(a)
    la, lb = np.array([len(x) for x in a], int), np.array([len(x) for x in b], int)
    wide_a, wide_b = int(la.max(initial=0)), int(lb.max(initial=0))

    def codes(texts: list[str], sizes: np.ndarray, wide: int, pad: int) -> np.ndarray:
        out = np.full((n, wide), pad, np.int64)
        flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        out[np.repeat(np.arange(n), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        return out

    ca, cb = codes(a, la, wide_a, -1), codes(b, lb, wide_b, -2)
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    used_a, used_b = np.zeros((n, wide_a), bool), np.zeros((n, wide_b), bool)
    most = int(reach.max(initial=0))
    for i in range(wide_a):  # each character takes the first open one that is equal and within reach
        lo, hi = max(0, i - most), min(wide_b, i + most + 1)
        if hi <= lo:
            continue
        fits = (cb[:, lo:hi] == ca[:, i, None]) & ~used_b[:, lo:hi] & (abs(np.arange(lo, hi) - i) <= reach[:, None])
        first = fits.argmax(1)
        hit = np.flatnonzero(fits[np.arange(n), first] & (i < la))
        used_b[hit, lo + first[hit]] = True
        used_a[hit, i] = True
    m = used_a.sum(1)
    # k-th match of one side against the k-th of the other
    row_a, at_a = np.nonzero(used_a)
    row_b, at_b = np.nonzero(used_b)
    moved = np.bincount(row_a, ca[row_a, at_a] != cb[row_b, at_b], n) // 2
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / la + m / lb + (m - moved) / m) / 3, 0.0)
    k = min(4, wide_a, wide_b)
    prefix = np.cumprod(ca[:, :k] == cb[:, :k], axis=1).sum(1) if k else np.zeros(n)
    out = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
    return np.where((la == 0) & (lb == 0), 1.0, out)


#: Characters up to which a string's positions are the bits of one machine word, and most entries of a table of such words.
WORD, MOST_WORDS = 64, 1 << 21


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all strings in a row, and the strings' sizes."""
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64), np.array([len(x) for x in texts], np.int64)


def _distinct(codes: np.ndarray) -> np.ndarray:
    there = np.zeros(int(codes.max(initial=0)) + 1, bool)
    there[codes] = True
    return np.flatnonzero(there)


def _rows(codes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """The place of each code point among the letters, their number if it is none."""
    place = np.full(max(int(codes.max(initial=0)), int(letters.max(initial=0))) + 1, len(letters), np.int64)
    place[letters] = np.arange(len(letters))
    return place[codes]


def _columns(codes: np.ndarray, sizes: np.ndarray, letters: np.ndarray) -> np.ndarray:
    """A row for each position, an entry for each string: the place of its code point there, the number of letters past its end."""
    wide = int(sizes.max(initial=0))
    if len(codes) == wide * len(sizes):  # all of one size
        return np.ascontiguousarray(_rows(codes, letters).reshape(len(sizes), wide).T)
    out = np.full((len(sizes), wide), len(letters), np.int64)
    out[np.arange(wide) < sizes[:, None]] = _rows(codes, letters)
    return np.ascontiguousarray(out.T)


def _words(a: list[str], b: list[str]) -> tuple | None:
    """What ``word_jaro_winkler`` needs of two lists of strings of at most 64 code points; nothing if it were too large.

    A table tells for each code point and each string of ``b`` at which positions it stands, as bits."""
    (fa, la), (fb, lb) = _codes(a), _codes(b)
    k = len(letters := _distinct(fb))
    if (k + 1) * len(b) > max(MOST_WORDS, 2 * WORD):
        return None
    kind = np.uint32 if max(la.max(initial=0), lb.max(initial=0)) <= 32 else np.uint64
    table = np.zeros((k + 1, len(b)), kind)  # the last row is of letters that no string of b has
    for i, row in enumerate(_columns(fb, lb, letters)):
        table[row, np.arange(len(b))] |= kind(1 << i)
    table[k] = 0
    return la, lb, table, _columns(fa, la, letters)


def word_jaro_winkler(words: tuple, x: np.ndarray, y: np.ndarray | slice) -> np.ndarray:
    """Similarities of the pairs ``(a[x], b[y])``, all pairs at once, or of ``a[x]`` with each of a slice of ``b``; a step is a few operations
    on machine words, whatever the length of ``b``."""
    la, lb, table, rows = words
    kind, wide = table.dtype.type, len(rows)
    na, nb = (la[x][:, None], lb[y][None, :]) if isinstance(y, slice) else (la[x], lb[y])
    reach = np.maximum(np.maximum(na, nb) // 2 - 1, 0)
    near = _distinct(reach)
    which = _rows(reach, near)
    one, full = kind(1), (1 << table.itemsize * 8) - 1
    used, hits, same = np.zeros(reach.shape, kind), [], []
    for i in range(wide):  # each character takes the first open one that is equal and within reach
        bits = table[rows[i][x], y]
        window = np.array([full & (1 << i + int(r) + 1) - 1 & ~((1 << max(0, i - int(r))) - 1) for r in near], kind)
        fit = bits & ~used
        fit &= window[0] if len(near) == 1 else window[which]
        fit &= ~fit + one  # the lowest bit
        used |= fit
        hits.append(fit != 0)
        same.append(bits)
    m, moved = np.bitwise_count(used), np.zeros(reach.shape, np.uint8)
    for hit, bits in zip(hits, same, strict=True):  # k-th match of one side against the k-th of the other
        first = used & (~used + one)
        first *= hit
        moved += (first & ~bits) != 0
        used ^= first
    moved >>= 1
    m = m.astype(np.int64)
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m > 0, (m / na + m / nb + (m - moved) / m) / 3, 0.0)
    prefix, going = np.zeros(reach.shape, np.uint8), np.ones(reach.shape, bool)
    for i in range(min(4, wide)):
        going &= (same[i] >> kind(i) & one) != 0
        prefix += going
    out = np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro)
    return np.where((na == 0) & (nb == 0), 1.0, out)


class Similarities:
    """Similarities of pairs of two lists of strings, which are prepared once; NaN where either is null.  Pairs with a string that is
    longer than a machine word are compared in groups of like length, the longest ones one by one."""

    def __init__(self, a: list[str | None], b: list[str | None]):
        self.a, self.b = a, b
        self.plain = [np.array([t is not None and len(t) <= WORD for t in texts], bool) for texts in (a, b)]
        self.null = [np.array([t is None for t in texts], bool) for texts in (a, b)]
        self.all = [bool(p.all()) for p in self.plain]
        self.words = _words(*[[t if ok else "" for t, ok in zip(texts, p, strict=True)] for texts, p in zip((a, b), self.plain, strict=True)])

    def of(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if all(self.all):
            return self._short(x, y)
        out = np.full(len(x), np.nan)
        short = self.plain[0][x] & self.plain[1][y]
        out[short] = self._short(x[short], y[short])
        rest = np.flatnonzero(~short & ~self.null[0][x] & ~self.null[1][y])
        if len(rest):
            pairs, which = np.unique(np.stack([x[rest], y[rest]]), axis=1, return_inverse=True)
            out[rest] = _similarities([self.a[i] for i in pairs[0]], [self.b[i] for i in pairs[1]])[which.ravel()]
        return out

    def grid(self, low: int, high: int, start: int) -> np.ndarray:
        """Those of ``a[low:high]`` with each of ``b[start:]``, a row for each of the former."""
        if all(self.all) and self.words is not None:
            return word_jaro_winkler(self.words, np.arange(low, high), slice(start, None))
        n = len(self.b) - start
        return self.of(np.repeat(np.arange(low, high), n), np.tile(np.arange(start, len(self.b)), high - low)).reshape(high - low, n)

    def _short(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        if self.words is not None or not len(x):
            return word_jaro_winkler(self.words, x, y) if len(x) else np.zeros(0)
        if len(x) == 1:
            return jaro_winkler([self.a[x[0]]], [self.b[y[0]]])
        out = np.empty(len(x))
        for part in np.array_split(np.argsort(y, kind="stable"), 2):  # fewer pairs have fewer letters and strings
            (u, p), (v, q) = np.unique(x[part], return_inverse=True), np.unique(y[part], return_inverse=True)
            out[part] = Similarities([self.a[i] for i in u], [self.b[i] for i in v]).of(p, q)
        return out


@F.arrow_udf(T.DoubleType())
def jaro_winkler_udf(a: pa.Array, b: pa.Array) -> pa.Array:
    """Similarity of two columns, null if either is.  Each distinct string of a batch is prepared once."""
    ok = pc.and_(a.is_valid(), b.is_valid())
    out, keep = np.full(len(a), np.nan), ok.to_numpy(zero_copy_only=False)
    a, b = a.filter(ok).dictionary_encode(), b.filter(ok).dictionary_encode()
    x, y = (c.indices.to_numpy(zero_copy_only=False).astype(np.int64) for c in (a, b))
    out[keep] = Similarities(a.dictionary.to_pylist(), b.dictionary.to_pylist()).of(x, y)
    return pa.array(out, mask=~keep)


def _similarities(x: list[str], y: list[str]) -> np.ndarray:
    by = sorted(range(len(x)), key=lambda i: len(x[i]) + len(y[i]))
    found = np.zeros(len(x))
    short = sum(max(len(x[i]), len(y[i])) < LONG for i in by)
    by.sort(key=lambda i: max(len(x[i]), len(y[i])) >= LONG)  # stable: the short ones stay in order
    for i in by[short:]:
        found[i] = long_jaro_winkler(x[i], y[i])
    for i in range(0, short, 2048):
        part = by[i : min(short, i + 2048)]
        found[part] = jaro_winkler([x[j] for j in part], [y[j] for j in part])
    return found


class SimilarityLevels:
    """Levels of the similarities of two lists of strings, whole rows at once: 0 if either is null, else one more than the number of
    thresholds reached.  ``codes`` of a grid tell what the level follows from (matches, transpositions, prefix, sizes), ``levels`` gives the level of
    each code.

    A prefix that all strings share always matches itself, place by place, so that only what follows it is compared; its positions are
    the bits of the smallest word that holds them."""

    def __init__(self, a: list[str | None], b: list[str | None], thresholds: Sequence[float]):
        self.thresholds, self.n = np.array(sorted(thresholds)), len(b)
        self.null = [np.array([t is None for t in texts], bool) for texts in (a, b)]
        some = [t for texts in (a, b) for t in texts if t is not None]
        longest = max(map(len, some), default=0)
        self.slow = Similarities(a, b) if longest > WORD else None
        if self.slow is None:
            low, high = min(some, default=""), max(some, default="")
            self.common = next((i for i, (x, y) in enumerate(zip(low, high, strict=False)) if x != y), min(len(low), len(high)))
            self._prepare(*[[low if t is None else t for t in texts] for texts in (a, b)], longest)
        if self.slow is not None:
            self.levels = np.arange(len(self.thresholds) + 2)

    def _prepare(self, a: list[str], b: list[str], longest: int) -> None:
        wide = longest - self.common
        self.kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if wide <= np.dtype(k).itemsize * 8)
        (fa, la), (fb, lb) = _codes([t[self.common :] for t in a]), _codes([t[self.common :] for t in b])
        letters = _distinct(fb)
        if (len(letters) + 1) * len(b) > max(MOST_WORDS, 2 * WORD):
            self.slow = Similarities(*[[None if z else t for t, z in zip(texts, null, strict=True)] for texts, null in zip((a, b), self.null, strict=True)])
            return
        self.table = np.zeros((len(letters) + 1, len(b)), self.kind)  # the last row is of letters that no string of b has
        for i, row in enumerate(_columns(fb, lb, letters)):
            self.table[row, np.arange(len(b))] |= self.kind(1 << i)
        self.table[-1] = 0
        self.rows = _columns(fa, la, letters)
        (ua, self.ia), (ub, self.ib) = np.unique(la + self.common, return_inverse=True), np.unique(lb + self.common, return_inverse=True)
        self.sizes = len(ub)
        na, nb = ua[:, None], ub[None, :]
        self.reach = np.maximum(np.maximum(na, nb) // 2 - 1, 0)
        self.shape = (self.reach.size, len(self.rows) + 1, len(self.rows) // 2 + 1, 1 if self.common >= 4 else 5)
        m = (np.arange(self.shape[1]) + self.common)[None, :, None, None]
        moved, prefix = np.arange(self.shape[2])[:, None], np.full(1, 4.0) if self.common >= 4 else np.arange(5.0)
        la, lb = (np.broadcast_to(x, self.reach.shape).reshape(-1, 1, 1, 1) for x in (na, nb))
        with np.errstate(divide="ignore", invalid="ignore"):
            jaro = np.where(m > 0, np.nan_to_num((m / la + m / lb + (m - moved) / m) / 3), 0.0)
        sims = np.where((la == 0) & (lb == 0), 1.0, np.where(jaro > 0.7, jaro + prefix * 0.1 * (1 - jaro), jaro))
        self.levels = np.append((sims[..., None] >= self.thresholds).sum(-1).ravel() + 1, 0)  # the last code is of null

    def codes(self, low: int, high: int, start: int) -> np.ndarray:
        """Codes of ``a[low:high]`` with each of ``b[start:]``, a row for each of the former."""
        if self.slow is not None:
            sims = self.slow.grid(low, high, start)
            return np.where(np.isnan(sims), 0, (sims[..., None] >= self.thresholds).sum(-1) + 1)
        kind, wide = self.kind, len(self.rows)
        shape = (high - low, self.n - start)
        which = None
        if self.reach.size > 1:
            which = self.ia[low:high, None] * self.sizes + self.ib[None, start:]
        open_ = np.full(shape, np.iinfo(kind).max, kind)
        same, hits, first, mask = [], [], np.empty(shape, kind), np.empty(shape, bool)
        for i in range(wide):  # each character takes the first open one that is equal and within reach
            bits = self.table[self.rows[i, low:high], start:]
            np.bitwise_and(bits, open_, out=first)
            if int(self.reach.min()) < wide - 1:
                full = np.iinfo(kind).max
                window = np.array([full & ((1 << i + int(r) + 1) - 1) & ~((1 << max(0, i - int(r))) - 1) for r in self.reach.ravel()], kind)
                first &= window[0] if which is None else window[which]
            lowest = np.negative(first)
            lowest &= first
            open_ ^= lowest
            hits.append(lowest)
            same.append(bits)
        rest = ~open_
        m, agree = np.bitwise_count(rest), np.zeros(shape, np.uint8)
        for hit, bits in zip(hits, same, strict=True):  # k-th match of one side against the k-th of the other
            np.negative(rest, out=first)
            first &= rest
            np.not_equal(hit, 0, out=mask)
            if kind is np.uint8:
                first &= np.negative(mask.view(np.uint8))
            else:
                first &= np.negative(mask.astype(kind))
            rest ^= first
            first &= bits
            np.not_equal(first, 0, out=mask)
            agree += mask.view(np.uint8)
        moved = (m - agree) >> 1
        size = len(self.levels)
        code = m.astype(np.uint8 if size < 256 else np.uint16 if size < 1 << 16 else np.int64)
        code *= code.dtype.type(self.shape[2])
        code += moved
        if self.shape[3] > 1:
            prefix, going = np.full(shape, min(self.common, 4), np.uint8), np.ones(shape, bool)
            for i in range(max(0, min(4 - self.common, wide))):
                going &= (same[i] >> kind(i) & kind(1)) != 0
                prefix += going
            code *= code.dtype.type(self.shape[3])
            code += prefix
        if which is not None:
            code += (which * (self.shape[1] * self.shape[2] * self.shape[3])).astype(code.dtype)
        if self.null[0][low:high].any():
            code[self.null[0][low:high]] = size - 1
        if self.null[1][start:].any():
            code[:, self.null[1][start:]] = size - 1
        return code
