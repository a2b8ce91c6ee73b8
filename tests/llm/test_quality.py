import random

import numpy as np

from lodestone.llm import quality as qu


def corpus(n=600):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 150))]
        good = i % 5 != 0
        if not good:
            words = [w + rng.choice(["$$$", "%%%", "&&&"]) for w in words] if i % 2 else [words[0]] * len(words)
        docs.append((i, " ".join(words), rng.choice(["en", "de"]), f"src{i % 7}", 1))
        if i % 3:
            labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy_and_cases(spark):
    docs, labels = corpus()
    extra = [(5000, None, None, None, None), (5001, "", "en", "src1", 0), (None, docs[1][1], "en", None, 3), (5002, "word salad of many " * 30000, "en", "x", 1)]
    d = spark.createDataFrame([(*r, 0.1) for r in docs + extra], "doc_id long, text string, lang string, source string, n_chars long, score double")
    lab = spark.createDataFrame(labels + [(None, 0, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    model = qu.learn(d, lab)
    got = qu.score(d, model).collect()
    assert len(got) == len(docs) + len(extra)
    test = [r for r in got if r.held_out and r.doc_id < 5000]
    assert np.mean([r.keep == (r.doc_id % 5 != 0) for r in test]) > 0.95
    assert all(0 <= r.score <= 1 and r.keep == (r.score >= qu.KEEP_FROM) for r in got)
    kept = qu.keep_good(d, model)
    assert kept.schema == d.schema
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.keep)
    nothing = qu.learn(d, lab.limit(0))
    assert qu.keep_good(d, nothing).count() == d.count()
    assert qu.score(d.limit(0), model).count() == 0


def test_views_hand_labels_to_each_other():
    rng = np.random.default_rng(0)
    y = (np.arange(60) % 2).astype(float)
    texts = y[:, None] + rng.normal(0, 0.3, (60, 3))
    metas = y[:, None] + rng.normal(0, 0.3, (60, 2))
    hidden = (np.arange(400) % 2).astype(float)
    pool = hidden[:, None] + rng.normal(0, 0.3, (400, 3)), hidden[:, None] + rng.normal(0, 0.3, (400, 2))
    model = qu.CoTrained().fit(texts, metas, y, *pool)
    assert ((model.score(*pool) >= 0.5) == hidden).mean() > 0.97


def test_the_exchange_beats_the_single_views():
    """Forty labels; each view of the others is noisy, in its own way."""
    rng = np.random.default_rng(1)
    y = (np.arange(40) % 2).astype(float)
    side = lambda t, k: np.concatenate([t[:, None] + rng.normal(0, 0.6, (len(t), 2)), rng.normal(0, 1, (len(t), k))], axis=1)
    hidden, test = (np.arange(600) % 2).astype(float), (np.arange(1000) % 2).astype(float)
    own, pool, held = [(side(t, 30), side(t, 30)) for t in (y, hidden, test)]
    with_pool = qu.CoTrained().fit(*own, y, *pool)
    without = qu.CoTrained().fit(*own, y, own[0][:0], own[1][:0])
    right = lambda odds: ((odds >= 0) == test).mean()
    for v in (0, 1):
        alone = qu.Logistic().fit(own[v], y, np.ones(40))
        assert right(with_pool.views[v][0].odds(held[v])) > right(alone.odds(held[v]))
    score = lambda m: ((m.score(*held) >= 0.5) == test).mean()
    assert score(with_pool) > score(without) and score(with_pool) > 0.9


def test_text_view_is_a_plain_count():
    text = "Ab ab, a1$ a1$ é.\nzz!"
    data = text.encode()
    pairs = np.zeros(qu.PAIR_BUCKETS)
    for a, b in zip(data, data[1:]):
        pairs[((a * 256 + b) * 0x9E3779B97F4A7C15 % 2**64 >> 40) % qu.PAIR_BUCKETS] += 1
    words = text.split()
    got = qu.text_view(text)
    assert np.allclose(got[: qu.PAIR_BUCKETS], np.sqrt(pairs / len(data)))
    assert np.allclose(got[qu.PAIR_BUCKETS :][:6], [2 / len(data), 2 / len(data), 3 / 6, 1 / 6, 5 / 6, 1 / 6])
    assert len(words) == 6


def test_repeats_contradictions_and_ties(spark):
    docs, labels = corpus(300)
    more = [(i, 1 - q, 0) for i, q, _ in labels[:40]] + labels[:60]  # some documents have both labels
    d = spark.createDataFrame(docs + docs[:50], "doc_id long, text string, lang string, source string, n_chars long")
    lab = spark.createDataFrame(labels + more, "doc_id long, quality int, toxic int")
    first, second = qu.learn(d, lab), qu.learn(d.repartition(7), lab.repartition(5))
    for a, b in zip(first.views, second.views, strict=True):
        assert np.allclose(a[0].w, b[0].w)
    rows = {}
    for r in qu.score(d, first).collect():
        rows.setdefault(r.doc_id, set()).add(round(r.score, 9))
    assert all(len(s) == 1 for s in rows.values())
    same = np.ones((20, 2))  # all equally sure: the first ones are handed over
    model = qu.CoTrained().fit(np.eye(2)[np.arange(20) % 2], same, (np.arange(20) % 2).astype(float), np.eye(2)[np.arange(300) % 2], np.ones((300, 2)))
    assert np.isfinite(model.score(np.eye(2), np.ones((2, 2)))).all()
