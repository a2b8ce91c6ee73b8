"""Quality classification by co-training of two views.

The text view is a logistic regression on what the text looks like (hashed byte pairs, symbols, repetition,
word shapes); the metadata view one on source and language alone, so that the views share no evidence.  Both start from the
labelled sample.  In each round, each view labels the pool documents of which it is most confident and
hands them to the other, and both are fitted anew.  Each view is then calibrated
(Platt) on labelled documents kept back from the training, and the calibrated log odds are
added, with the prior taken out once.  Everything is fitted on the driver from at most ``LABELLED``
labelled and ``POOL`` other documents; the scores cover every whole text.

Defined cases: null text is empty, null metadata is a value of its own; without labels of both classes
every score is the share of good labels (1 if there are none, so nothing is rejected); several labels of a
document: it is good only if all say so; rows without id are scored but never learned from; documents of the
held-out fold are not learned from; repeated rows score alike; empty tables give no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.folds import held_out, learnable, place, share

#: Bounds of what is learned from, in documents, and characters of a document to be chosen.
LABELLED, POOL, TRAIN_CHARS = 4000, 3000, 20_000
ROUNDS, HANDED, CONFIDENT, HOLD_BACK = 4, 100, 0.97, 4
PAIR_BUCKETS, META_BUCKETS, KEEP_FROM = 256, 64, 0.5

_pair_bucket = ((np.arange(65536, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % PAIR_BUCKETS
_symbol = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:!?'\"()-" for b in range(256)])
_digit = np.array([48 <= b < 58 for b in range(256)])
_stop = np.array([chr(b) in ".,;:!?" for b in range(256)])
_upper = np.array([65 <= b < 91 for b in range(256)])


def text_view(text: str) -> np.ndarray:
    """Features of the text alone."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    pairs = np.zeros(PAIR_BUCKETS)
    counts = np.bincount(data, minlength=256)
    for i in range(0, len(data), 1 << 20):
        part = data[i : i + (1 << 20) + 1].astype(np.int64)
        both = np.bincount(part[:-1] * 256 + part[1:], minlength=65536)
        pairs += np.bincount(_pair_bucket, both, PAIR_BUCKETS)
    n = max(1, len(data))
    words = text.split()
    k = max(1, len(words))
    distinct = len(set(words))
    again = sum(map(str.__eq__, words, words[1:])) if words else 0
    shape = [
        counts[_symbol].sum() / n, counts[_digit].sum() / n, counts[_stop].sum() / k, counts[_upper].sum() / k, distinct / k, again / k,
        np.log1p(k) * (1 - distinct / k), n / k / 10, counts[10] / k, float(not words),
        min(1.0, 10 * counts[_symbol].sum() / n), min(1.0, 4 * again / k),
    ]
    return np.concatenate([np.sqrt(pairs / n), shape])


def meta_view(source: str | None, lang: str | None) -> np.ndarray:
    """Features of the page's metadata: source, language, and both together."""
    out = np.zeros(3 * META_BUCKETS)
    for i, name in enumerate((f"source {source}", f"lang {lang}", f"both {source} {lang}")):
        out[i * META_BUCKETS + zlib.crc32(name.encode("utf-8", "surrogatepass")) % META_BUCKETS] = 1
    return out


class Logistic:
    """Logistic regression on standardised features, with an L2 penalty, by Newton's method."""

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 3.0, steps: int = 12) -> Logistic:
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        a = np.concatenate([(x - self.mean) / self.scale, np.ones((len(x), 1))], axis=1)
        w = np.zeros(a.shape[1])
        ridge = np.full(a.shape[1], penalty)
        ridge[-1] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            grad = a.T @ (weight * (p - y)) + ridge * w
            hess = (a * (weight * np.maximum(p * (1 - p), 1e-5))[:, None]).T @ a + np.diag(ridge)
            w -= np.linalg.solve(hess, grad)
        self.w = w
        return self

    def odds(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w[:-1] + self.w[-1]


class CoTrained:
    """Both views and their calibrations; ``score`` gives the probability of good quality."""

    def __init__(self, share: float = 1.0):
        self.share, self.views = share, []

    def fit(self, texts: np.ndarray, metas: np.ndarray, y: np.ndarray, pool_texts: np.ndarray, pool_metas: np.ndarray) -> CoTrained:
        back = np.arange(len(y)) % HOLD_BACK == 0
        if min(y[back].sum(), (~back).sum() - y[~back].sum(), (1 - y[back]).sum(), y[~back].sum()) < 1:
            back = np.zeros(len(y), bool)
        own = [texts[~back], metas[~back]]
        pool = [pool_texts, pool_metas]
        given: list[dict[int, int]] = [{}, {}]  # what each view was handed: pool row -> label
        views = [Logistic(), Logistic()]
        for r in range(ROUNDS + 1):
            for v in (0, 1):
                rows = np.array(list(given[v]), np.int64)
                x = np.concatenate([own[v], pool[v][rows]]) if len(rows) else own[v]
                labels = np.concatenate([y[~back], [given[v][i] for i in rows.tolist()]])
                views[v].fit(x, labels, np.concatenate([np.ones(len(own[v])), np.full(len(rows), 0.5)]))
            if r == ROUNDS or not len(pool[0]):
                break
            for v in (0, 1):
                p = 1 / (1 + np.exp(-np.clip(views[v].odds(pool[v]), -30, 30)))
                for label, sure in ((1, p), (0, 1 - p)):
                    top = np.argsort(-sure, kind="stable")[:HANDED]
                    given[1 - v].update({int(i): label for i in top if sure[i] >= CONFIDENT and int(i) not in given[1 - v]})
        base = y.mean()
        self.prior, self.views = float(np.log(base / (1 - base))), []
        some = back if back.any() else ~back
        for v, x in enumerate((texts[some], metas[some])):
            odds = views[v].odds(x)[:, None]
            platt = Logistic().fit(odds, y[some], np.ones(some.sum()), penalty=1.0)
            self.views.append((views[v], platt))
        return self

    def score(self, texts: np.ndarray, metas: np.ndarray) -> np.ndarray:
        if not self.views:
            return np.full(len(texts), self.share)
        total = np.full(len(texts), -self.prior)
        for (view, platt), x in zip(self.views, (texts, metas), strict=True):
            total += platt.odds(view.odds(x)[:, None])
        return 1 / (1 + np.exp(-np.clip(total, -700, 700)))


def _features(texts: list, sources: list, langs: list) -> tuple[np.ndarray, np.ndarray]:
    texts = [t or "" for t in texts]
    return np.array([text_view(t) for t in texts]), np.array([meta_view(s, g) for s, g in zip(sources, langs, strict=True)])


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", label_col: str = "quality") -> CoTrained:
    """A model trained on the bounded sample."""
    y = labels.where(F.col(label_col).isin(0, 1) & learnable(id_col)).groupBy(F.col(id_col).alias("l_id")).agg(F.min(F.col(label_col).cast("int")).alias("y"))
    there, all_docs = labels.count(), docs.count()
    # both samples are the first by place; their ids, never more than the bounds, go to the documents
    chosen = y.where(place("l_id") < share(LABELLED, there)).orderBy(place("l_id"), "l_id").limit(LABELLED)
    d = docs.where(learnable(id_col) & F.col(text_col).isNotNull() & (F.length(text_col) <= TRAIN_CHARS))
    d = d.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"), F.col(source_col).cast("string").alias("s"), F.col(lang_col).cast("string").alias("g"))
    known = d.join(F.broadcast(chosen), F.col("i") == F.col("l_id")).select("i", "t", "s", "g", "y").orderBy("i", "t", "s", "g").limit(2 * LABELLED).collect()
    reach = share(POOL, all_docs)
    taken = y.where(place("l_id") < reach).select("l_id")
    pool = d.where(place("i") < reach).join(taken, F.col("i") == F.col("l_id"), "left_anti").orderBy("i", "t", "s", "g").limit(2 * POOL).collect()
    order = lambda r: (r.i, r.t)
    known, pool = sorted(known, key=order), sorted(pool, key=order)[:POOL]
    target = np.array([r.y for r in known], float)
    model = CoTrained(float(target.mean()) if len(known) else 1.0)
    if not 0 < target.sum() < len(target):
        return model
    texts, metas = _features([r.t for r in known], [r.s for r in known], [r.g for r in known])
    if pool:
        more = _features([r.t for r in pool], [r.s for r in pool], [r.g for r in pool])
    else:
        more = texts[:0], metas[:0]
    return model.fit(texts, metas, target, *more)


def score(docs: DataFrame, model: CoTrained, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """Rows ``(doc_id, held_out, score, keep)`` for every row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                s = model.score(*_features(*(b.column(c).to_pylist() for c in (2, 3, 4))))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s), pa.array(s >= KEEP_FROM)], ["doc_id", "held_out", "score", "keep"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("t"), F.col(source_col).cast("string").alias("s"), F.col(lang_col).cast("string").alias("g"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, keep boolean")


def keep_good(docs: DataFrame, model: CoTrained, *, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """The rows of ``docs``, columns unchanged, that score ``KEEP_FROM`` or more."""
    at = [docs.columns.index(c) for c in (text_col, source_col, lang_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 512):
                b = whole.slice(i, 512)
                text, source, lang = (b.column(c).to_pylist() for c in at)
                s = model.score(*_features(text, [None if x is None else str(x) for x in source], lang))
                yield b.filter(pa.array(s >= KEEP_FROM))

    return docs.mapInArrow(run, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
