"""Language identification by a bidirectional gated recurrent network over bytes.

The bytes of a text are cut into windows of ``WINDOW``; a gated recurrent unit reads each window
forwards and another backwards, each from a zero state ``CONTEXT`` bytes outside the window (so that no position of the text is read
cold, and no character cut), and their states label every byte position with a distribution over the languages.  A document's
distribution is the mean over all its positions.  Weights are trained on the driver in numpy by backpropagation through
time (Adam), from at most ``PER_LANGUAGE`` documents of a language (fewer if there are many: ``SAMPLE`` in all, and four of
each) and ``PIECES`` pieces of each.  Every language is learned.

Defined cases: a null text and one without any letter are ``und`` with score 0, as is everything if
there is nothing to learn from; ties go to the language first in alphabetical order; a row without
id is predicted, is not held out and is never learned from; extra columns are ignored; repeated
rows are scored alike; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.folds import bounded, held_out, learnable, place, share

WINDOW, CONTEXT, HIDDEN = 64, 8, 8
#: Bounds of what is learned from: documents of a language, of all, pieces of a document, characters of a piece.
PER_LANGUAGE, SAMPLE, PIECES, PIECE_CHARS = 800, 16_000, 4, 200
BATCH, STEPS, RATE, SEED = 256, 300, 0.02, 11
#: Windows run at once with up to ``FEW`` languages, and fewer with more; it bounds a task's memory.
LANES, FEW = 2048, 16
_alphanumeric = re.compile(r"[^\W\d_]").finditer


def _letter(text: str) -> bool:
    """Whether a character is of a category of letters (numbers such as one half are not)."""
    return any(unicodedata.category(m[0])[0] == "L" for m in _alphanumeric(text))


def _forward(x: np.ndarray, table: np.ndarray, u: np.ndarray, inside: np.ndarray | None = None, keep: bool = False):
    """States (time, lanes, H) of one direction for byte columns ``x`` (time, lanes), zero where a lane has no byte
    (not ``inside``); with ``keep`` also what the backward pass needs.  Gates use the piecewise linear sigmoid 0.25 x + 0.5, which
    is folded into their weights; the update gate, the reset gate and the candidate are separate arrays."""
    n = u.shape[0]
    scale, shift = (0.25, 0.25, 1.0), (0.5, 0.5, 0.0)
    tables = [np.ascontiguousarray(table[:, i * n : (i + 1) * n] * np.float32(scale[i]) + np.float32(shift[i])) for i in range(3)]
    us = [np.ascontiguousarray(u[:, i * n : (i + 1) * n] * np.float32(scale[i])) for i in range(3)]
    x = x.astype(np.intp)
    h = np.zeros((x.shape[1], n), np.float32)
    a = [np.empty_like(h) for _ in range(3)]
    g = [np.empty_like(h) for _ in range(3)]
    states, saved = np.empty((len(x), *h.shape), np.float32), []
    for t in range(len(x)):
        for i in range(3):
            np.take(tables[i], x[t], axis=0, out=a[i], mode="clip")
            np.matmul(h, us[i], out=g[i])
        for i in range(2):
            a[i] += g[i]
            np.clip(a[i], 0, 1, out=a[i])
        z, r, c = a
        if keep:
            saved.append((h, z.copy(), r.copy(), None, g[2].copy()))
        g[2] *= r
        c += g[2]
        np.tanh(c, out=c)
        new = states[t]
        np.subtract(h, c, out=new)
        new *= z
        new += c
        if inside is not None:
            new *= inside[t][:, None]
        if keep:
            saved[-1] = (*saved[-1][:3], c.copy(), saved[-1][4])
        h = new
    return states, saved


def _backward(x: np.ndarray, u: np.ndarray, saved: list, d_states: np.ndarray, inside: np.ndarray):
    """Gradients of the input table and of ``u``, through time."""
    n = u.shape[0]
    pre = np.empty((*d_states.shape[:2], 3 * n), np.float32)
    d_u = np.zeros_like(u)
    dh = np.zeros_like(d_states[0])
    for t in range(len(x) - 1, -1, -1):
        h, z, r, c, g = saved[t]
        dh += d_states[t]
        dh *= inside[t][:, None]
        dc = dh * (1 - z) * (1 - c * c)
        pre[t, :, :n] = dh * (h - c) * (0.25 * ((z > 0) & (z < 1)))
        pre[t, :, n : 2 * n] = dc * g * (0.25 * ((r > 0) & (r < 1)))
        pre[t, :, 2 * n :] = dc
        dg = pre[t].copy()
        dg[:, 2 * n :] *= r
        d_u += h.T @ dg
        dh = dh * z + dg @ u.T
    d_table = np.zeros((256, 3 * n), np.float32)
    by = np.argsort(x.ravel(), kind="stable")
    sorted_x = x.ravel()[by]
    first = np.flatnonzero(np.r_[True, sorted_x[1:] != sorted_x[:-1]])
    d_table[sorted_x[first]] = np.add.reduceat(pre.reshape(-1, 3 * n)[by], first)
    return d_table, d_u


class Network:
    """Weights: input tables (256, 3H) and recurrent matrices (H, 3H) of both directions, output (2H, L) and bias."""

    def __init__(self, languages: list[str], hidden: int = HIDDEN, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.languages = languages
        scale = lambda *s: (rng.standard_normal(s) * 0.4).astype(np.float32)
        self.w = [scale(256, 3 * hidden), scale(hidden, 3 * hidden), scale(256, 3 * hidden), scale(hidden, 3 * hidden), scale(2 * hidden, len(languages)), np.zeros(len(languages), np.float32)]

    def _positions(self, x: np.ndarray, inside: np.ndarray | None = None, keep: bool = False):
        """Distributions (languages, time, lanes) of every position, and what led to them."""
        f, sf = _forward(x, self.w[0], self.w[1], inside, keep)
        b, sb = _forward(x[::-1], self.w[2], self.w[3], None if inside is None else inside[::-1], keep)
        b, n = b[::-1], f.shape[2]
        y = self.w[4][:n].T @ f.reshape(-1, n).T
        y += self.w[4][n:].T @ b.reshape(-1, n).T
        y += self.w[5][:, None]
        y -= y.max(0)
        np.exp(y, out=y)
        y /= y.sum(0)
        return y.reshape(-1, *x.shape), f, b, sf, sb

    def gradients(self, x: np.ndarray, label: np.ndarray, mask: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross entropy of the labelled positions, and its gradients."""
        p, f, b, sf, sb = self._positions(x, mask, True)
        n = f.shape[2]
        weight = mask.astype(np.float32) / np.float32(max(1, mask.sum()))
        lanes = np.arange(x.shape[1])
        true = p[label, :, lanes].T
        loss = float(-(np.log(true + 1e-9) * weight).sum())
        p[label, :, lanes] -= 1
        p *= weight
        d = p.reshape(len(p), -1)
        d_out = np.concatenate([d @ f.reshape(-1, n), d @ b.reshape(-1, n)], axis=1).T
        df = (self.w[4][:n] @ d).T.reshape(f.shape)
        db = (self.w[4][n:] @ d).T.reshape(b.shape)
        tf, uf = _backward(x, self.w[1], sf, df, mask)
        tb, ub = _backward(x[::-1], self.w[3], sb, db[::-1], mask[::-1])
        return loss, [tf, uf, tb, ub, d_out, d.sum(1)]

    def train(self, windows: np.ndarray, lengths: np.ndarray, label: np.ndarray, steps: int = STEPS, seed: int = SEED) -> float:
        """Adam over random batches with equal chances of all languages; returns the last mean loss."""
        rng = np.random.default_rng(seed)
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        of = [np.flatnonzero(label == i) for i in range(len(self.languages))]
        losses = []
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(o, -(-BATCH // len(of))) for o in of if len(o)])
            x = windows[pick].T
            mask = np.arange(len(x))[:, None] < lengths[pick][None, :]
            loss, grads = self.gradients(x, label[pick], mask)
            losses.append(loss)
            rate = RATE * min(1, 2 * (1 - step / (steps + 1)))
            for w, g, a, b in zip(self.w, grads, m, v, strict=True):
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * g * g
                w -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return float(np.mean(losses[-10:]))

    def predict(self, texts: list[bytes]) -> np.ndarray:
        """Distributions of documents: means over all positions of their whole texts."""
        size = np.array([len(t) for t in texts], np.int64)
        windows = -(-size // WINDOW)
        owner = np.repeat(np.arange(len(texts)), windows)
        begin = CONTEXT + np.cumsum(size) - size
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = begin[owner] + nth * WINDOW
        left = np.minimum(WINDOW, size[owner] - nth * WINDOW)
        before = np.where(nth > 0, CONTEXT, 0)
        after = np.minimum(CONTEXT, size[owner] - nth * WINDOW - left)
        buf = np.frombuffer(b"".join([bytes(CONTEXT), *texts, bytes(WINDOW + CONTEXT)]), np.uint8)
        total = np.zeros((len(texts), len(self.languages)))
        by = np.lexsort((-before, -after, -left))
        lanes = max(16, LANES * FEW // max(FEW, len(self.languages)))
        for i in range(0, len(by), lanes):
            w = by[i : i + lanes]
            steps = np.arange(CONTEXT + int((left[w] + after[w]).max()))[:, None] - CONTEXT
            inside = (steps >= -before[w]) & (steps < (left + after)[w])
            x = np.where(inside, buf[at[w][None, :] + steps], 0).astype(np.uint8)
            p = self._positions(x, None if inside.all() else inside)[0]
            p *= (steps >= 0) & (steps < left[w])  # what lies around a window is only read
            for j, sums in enumerate(p.sum(1)):
                total[:, j] += np.bincount(owner[w], sums, len(texts))
        return total / np.maximum(size, 1)[:, None]


def _windows(pieces: list[tuple[str, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rows, lengths, labels = [], [], []
    for piece, label in pieces:
        data = piece.encode("utf-8", "surrogatepass")
        for a in range(0, len(data), WINDOW):
            part = data[a : a + WINDOW]
            rows.append(part.ljust(WINDOW, b"\0"))
            lengths.append(len(part))
            labels.append(label)
    return np.frombuffer(b"".join(rows), np.uint8).reshape(-1, WINDOW), np.array(lengths), np.array(labels)


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network trained on the bounded sample, or None if no language can be learned."""
    size = F.greatest(F.length(text_col) - PIECE_CHARS + 1, F.lit(1))
    pieces = [F.substring(F.col(text_col), (F.pmod(F.xxhash64(F.col(id_col), F.lit(i)), size) + 1).cast("int"), F.lit(PIECE_CHARS)) for i in range(PIECES)]
    d = docs.where(learnable(id_col) & F.col(text_col).rlike(r"\p{L}") & F.col(lang_col).isNotNull())
    d = d.select(F.col(lang_col).cast("string").alias("lang"), place(id_col, text_col).alias("p"), F.array(*pieces).alias("pieces"))
    # the first of a language by place (of id and text, so that rows of one id have places of their own): a share of it by
    # its count, repeated rows once, cut to the bound here
    counts = dict(tuple(r) for r in d.groupBy("lang").count().collect())  # one row a language; of learnable rows alone
    if not counts:
        return None
    most = max(4, min(PER_LANGUAGE, SAMPLE // len(counts)))
    reach = docs.sparkSession.createDataFrame([(g, share(most, n)) for g, n in counts.items()], "lang string, reach double")
    found = d.join(bounded(reach), "lang").where("p < reach").select("lang", "p", "pieces").distinct().collect()
    found.sort(key=lambda r: (r.lang, r.p, r.pieces))
    rows = [r for _, g in itertools.groupby(found, key=lambda r: r.lang) for r in itertools.islice(g, most)]
    languages = sorted({r.lang for r in rows})
    if not languages:
        return None
    net = Network(languages)
    known = {x: i for i, x in enumerate(languages)}
    net.train(*_windows([(p, known[r.lang]) for r in rows for p in r.pieces]))
    return net


def identify(docs: DataFrame, net: Network | None, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, held_out, lang_pred, score)`` for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 1024):
                batch = whole.slice(i, 1024)
                texts = [t if t is not None and _letter(t) else "" for t in batch.column(2).to_pylist()]
                p = net.predict([t.encode("utf-8", "surrogatepass") for t in texts]) if net else np.zeros((len(texts), 1))
                best = p.argmax(1)
                names = [net.languages[b] if net and t else "und" for b, t in zip(best.tolist(), texts, strict=True)]
                score = [float(min(1.0, s)) if n != "und" else 0.0 for s, n in zip(p.max(1).tolist(), names, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("t"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn(docs))
