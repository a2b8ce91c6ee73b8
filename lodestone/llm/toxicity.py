"""Toxicity by subword-bag embeddings averaged into a linear softmax.

A word is the bag of its character n-grams (with marks at both ends) and itself, each
hashed to one of ``BUCKETS`` vectors.  The vectors of a passage of ``PASSAGE`` words are averaged
and a linear softmax gives the odds of both classes; a document's score is that of
its most toxic passage, so that a long text does not dilute an insult.  Vectors and softmax are
trained jointly in numpy on the driver (Adam), from at most ``PER_CLASS`` labelled documents of a class;
a document's loss weighs its passages by a soft maximum.  Misspellings that were never
seen share n-gram vectors with the words they distort.

Scoring is exact for the whole text: both layers are linear in the bag, so each distinct word
has one number, kept per worker, and a passage's logit is a mean of numbers.

Defined cases: null text is empty; a text without words has the score of an empty passage;
without labels of both classes every score is the share of toxic labels (0 if there are none); a row
without id is scored, not held out and never learned from; repeated rows score alike; several labels
of a document: it is toxic if any says so; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.folds import held_out, learnable, place, share

PASSAGE, GRAMS, BUCKETS, DIM = 4, (3, 4, 5), 1 << 17, 8
#: Bounds of what is learned from: documents of a class, and characters of a document to be chosen.
PER_CLASS, TRAIN_CHARS = 3000, 20_000
STEPS, BATCH_DOCS, RATE, SHARPNESS, SEED = 200, 1500, 0.05, 3.0, 5
#: Distinct words whose numbers a worker keeps.
REMEMBERED = 400_000
_words = re.compile(r"[^\W_]+").findall


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' features, word by word, and how many each word has."""
    marked = [f"<{w}>" for w in words]
    size = np.array([len(m) for m in marked], np.int64)
    cp = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    begin = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    left = np.repeat(begin + size, size) - np.arange(len(cp))  # characters from here to the end
    mult = np.uint64(0x9E3779B97F4A7C15)
    h = np.zeros(len(cp), np.uint64)
    keys, owners = [], []
    for j in range(max(GRAMS)):
        h[: len(cp) - j] = (h[: len(cp) - j] + cp[j:] + np.uint64(1)) * mult
        h ^= h >> np.uint64(29)
        if j + 1 in GRAMS:
            ok = (left > j) & (left != size[owner]) | (left == size[owner]) & (size[owner] > j)
            keys.append(h[ok] + np.uint64(j))
            owners.append(owner[ok])
    # the word itself: a sum of mixed characters by place
    place = (np.arange(len(cp)) - begin[owner]).astype(np.uint64)
    mixed = (cp * mult) ^ ((place + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F))
    mixed = (mixed ^ (mixed >> np.uint64(31))) * mult
    whole = np.add.reduceat(mixed, begin) if len(words) else mixed
    keys.append(whole)
    owners.append(np.arange(len(words)))
    key, own = np.concatenate(keys), np.concatenate(owners)
    key = (key ^ (key >> np.uint64(33))) * mult
    by = np.argsort(own, kind="stable")
    return (key[by] >> np.uint64(40)).astype(np.int64) % BUCKETS, np.bincount(own, minlength=len(words))


def _passages(sizes: np.ndarray) -> np.ndarray:
    """First words of all passages of documents with ``sizes`` words; a document without words has none."""
    n = -(-sizes // PASSAGE)
    doc = np.repeat(np.arange(len(sizes)), n)
    return (np.cumsum(sizes) - sizes)[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * PASSAGE


class Model:
    """``vectors`` (BUCKETS, DIM) and the softmax's difference of class weights ``out`` and ``bias``."""

    def __init__(self, share: float = 0.0, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.vectors = (rng.standard_normal((BUCKETS, DIM)) * 0.05).astype(np.float32)
        self.out = (rng.standard_normal(DIM) * 0.5).astype(np.float32)
        self.bias, self.share, self.trained = 0.0, share, False
        self.known: dict[str, int] = {}
        self.total = np.zeros(0)
        self.count = np.zeros(0)

    def train(self, texts: list[str], label: np.ndarray, steps: int = STEPS) -> None:
        """Adam on batches of documents with equal chances of both classes."""
        ids: dict[str, int] = {}
        words = [np.array([ids.setdefault(w, len(ids)) for w in _words(t.lower())], np.int32) for t in texts]
        names = list(ids)
        parts = [features(names[i : i + 20_000]) for i in range(0, len(names), 20_000)]
        feats, n_feats = np.concatenate([f.astype(np.int32) for f, _ in parts]), np.concatenate([n for _, n in parts])
        del names, parts
        first = np.cumsum(n_feats) - n_feats
        rng = np.random.default_rng(SEED)
        of = [np.array([i for i in np.flatnonzero(label == c) if len(words[i])], np.int64) for c in (0, 1)]
        m, v = np.zeros_like(self.vectors), np.zeros_like(self.vectors)
        mo, vo, mb, vb = np.zeros(DIM), np.zeros(DIM), 0.0, 0.0
        for step in range(1, steps + 1):
            pick = np.concatenate([rng.choice(o, min(len(o), BATCH_DOCS // 2), replace=False) for o in of if len(o)])
            flat = np.concatenate([words[i] for i in pick])
            sizes = np.array([len(words[i]) for i in pick])
            start = _passages(sizes)
            n_pass = -(-sizes // PASSAGE)
            at = np.cumsum(n_pass) - n_pass
            of_pass = np.repeat(np.arange(len(pick)), n_pass)
            length = np.diff(np.r_[start, len(flat)])
            scalar = self.vectors @ self.out
            w_sum = np.add.reduceat(scalar[feats], first)
            count = np.add.reduceat(n_feats[flat], start)
            z = np.add.reduceat(w_sum[flat], start) / count + self.bias
            top = np.maximum.reduceat(z, at)
            soft = np.exp(SHARPNESS * (z - top[of_pass]))
            soft /= np.add.reduceat(soft, at)[of_pass]
            zd = np.add.reduceat(soft * z, at)
            y = label[pick]
            g = (1 / (1 + np.exp(-zd)) - y) / len(pick)
            gp = g[of_pass] * soft
            # each feature's share of the gradient is a number times ``out``
            per_word = np.bincount(flat, np.repeat(gp / count, length), len(ids))
            per_feature = np.bincount(feats, np.repeat(per_word, n_feats), BUCKETS)
            used = np.flatnonzero(per_feature)
            grad = (per_feature[used, None] * self.out[None, :]).astype(np.float32)
            g_out = per_feature[used] @ self.vectors[used]
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            m[used] = 0.9 * m[used] + 0.1 * grad
            v[used] = 0.99 * v[used] + 0.01 * grad * grad
            fix_m, fix_v = 1 - 0.9**step, 1 - 0.99**step
            self.vectors[used] -= rate * (m[used] / fix_m) / (np.sqrt(v[used] / fix_v) + 1e-7)
            mo, vo = 0.9 * mo + 0.1 * g_out, 0.99 * vo + 0.01 * g_out**2
            self.out -= (rate * (mo / fix_m) / (np.sqrt(vo / fix_v) + 1e-7)).astype(np.float32)
            gb = float(gp.sum())
            mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
            self.bias -= rate * (mb / fix_m) / (vb**0.5 / fix_v**0.5 + 1e-7)
        self.trained = True

    def shrink(self) -> Model:
        """For the executors: vectors and softmax folded into one number a bucket."""
        self.scalar = (self.vectors @ self.out).astype(np.float32)
        self.vectors = None
        return self

    def _ids(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self.known))
        if new:
            if len(self.known) + len(new) > REMEMBERED:
                self.known, self.total, self.count = {}, np.zeros(0), np.zeros(0)
                new = list(set(words))
            feats, n = features(new)
            self.known.update(zip(new, range(len(self.total), len(self.total) + len(new)), strict=True))
            self.total = np.concatenate([self.total, np.add.reduceat(self.scalar[feats], np.cumsum(n) - n, dtype=np.float64)])
            self.count = np.concatenate([self.count, n])
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def score(self, texts: list[str]) -> np.ndarray:
        """Scores of whole texts."""
        if not self.trained:
            return np.full(len(texts), self.share)
        docs = [_words(t.lower()) for t in texts]
        sizes = np.array([len(d) for d in docs], np.int64)
        flat = self._ids([w for d in docs for w in d])
        z = np.full(len(texts), self.bias)
        if len(flat):
            start = _passages(sizes)
            logit = np.add.reduceat(self.total[flat], start) / np.add.reduceat(self.count[flat], start) + self.bias
            some = np.flatnonzero(sizes)
            n = -(-sizes[some] // PASSAGE)
            z[some] = np.maximum.reduceat(logit, np.cumsum(n) - n)
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))


def learn(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model trained on the bounded sample."""
    y = labels.where(F.col(label_col).isin(0, 1) & learnable(id_col)).groupBy(F.col(id_col).alias("l_id")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    d = docs.where(learnable(id_col) & F.col(text_col).isNotNull() & (F.length(text_col) <= TRAIN_CHARS)).select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    rows = []
    for c, there in sorted(tuple(r) for r in y.groupBy("y").count().collect()):
        # the first of a class by place; their ids, never more than the bound, go to the documents
        chosen = y.where((F.col("y") == c) & (place("l_id") < share(PER_CLASS, there))).orderBy(place("l_id"), "l_id").limit(PER_CLASS)
        rows += d.join(F.broadcast(chosen), F.col("i") == F.col("l_id")).select("i", "t", "y").orderBy("i", "t").limit(2 * PER_CLASS).collect()
    rows.sort(key=lambda r: (r.y, r.i, r.t))
    label = np.array([r.y for r in rows], np.int64)
    model = Model(float(label.mean()) if len(label) else 0.0)
    if 0 < label.sum() < len(label):
        model.train([r.t for r in rows], label)
    return model.shrink()


_models: dict[str, Model] = {}


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, held_out, score, predicted)`` for every row of ``docs``."""
    import uuid

    name, sent = uuid.uuid4().hex, docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _models:  # a worker's next tasks find the words' numbers
            _models.clear()
            _models[name] = sent.value
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                batch = whole.slice(i, 256)
                s = _models[name].score([t or "" for t in batch.column(2).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("t"))
    return d.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
