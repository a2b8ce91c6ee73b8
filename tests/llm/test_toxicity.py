import random

import numpy as np

from lodestone.llm import toxicity as tx


def corpus(n=700):
    rng = random.Random(9)
    clean = ["house", "tree", "water", "stone", "river", "cloud", "field", "bird", "light", "train", "class", "stump"]
    rude = ["blockhead", "dunderpate", "nincompoop"]
    docs, labels = [], []
    for i in range(n):
        words = [rng.choice(clean) + rng.choice(["", "s", "ly", "er"]) for _ in range(rng.randint(5, 200))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randint(0, len(words)), rng.choice(rude))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_and_misspelled(spark, monkeypatch):
    monkeypatch.setattr(tx, "STEPS", 80)
    docs, labels = corpus()
    extra = [(5000, "house tree blockheads water"), (5001, "the nincompoo river cloud"), (5002, None), (5003, ""), (None, "tree water"), (5004, "water " * 50000 + "blokhead blockhead")]
    d = spark.createDataFrame([(*r, 0.1) for r in docs + extra], "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels + [(3, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = tx.learn(d, lab)
    got = tx.score(d, model).collect()
    assert len(got) == len(docs) + len(extra)
    truth = {i: t for i, _, t in labels}
    test = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in test]) > 0.95
    by = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id >= 5000}
    assert by[5000].predicted == 1 and by[5001].predicted == 1 and by[5004].predicted == 1
    assert by[5002].predicted == by[5003].predicted == by[None].predicted == 0
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert {r.score for r in tx.score(d, tx.learn(d, lab.limit(0))).collect()} == {0.0}
    assert tx.score(d.limit(0), model).count() == 0


def test_scoring_by_words_is_the_model():
    rng = np.random.default_rng(0)
    m = tx.Model()
    m.trained = True
    vectors, out = m.vectors.copy(), m.out.copy()
    m.shrink()
    text = "One two, three-four FIVE six seven eight nine ten"
    words = tx._words(text.lower())
    z = []
    for i in range(0, len(words), tx.PASSAGE):
        f, _ = tx.features(words[i : i + tx.PASSAGE])
        z.append(float(vectors[f].mean(0) @ out))
    assert np.allclose(m.score([text])[0], 1 / (1 + np.exp(-max(z))), atol=1e-5)
    assert np.allclose(m.score([text, "", text])[[0, 2]], m.score([text])[0])
    del rng


def test_distortions_share_features():
    a, b, c = (set(tx.features([w])[0].tolist()) for w in ("blockhead", "blockheadz", "river"))
    assert len(a & b) > len(a) / 2 and len(a & c) < len(a) / 4
    f, n = tx.features(["ab", "abcdef", "é"])
    assert len(f) == n.sum() and n[1] == 1 + 6 + 5 + 4


def test_repeated_rows_and_contradicting_labels(spark, monkeypatch):
    monkeypatch.setattr(tx, "STEPS", 30)
    docs = [(i, f"plain words number {i} here" + (" idiotface" if i % 4 == 0 else "")) for i in range(200)]
    d = spark.createDataFrame(docs + docs[:40] + [(8, "another text of this id")], "doc_id long, text string")
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200)]
    lab = spark.createDataFrame(labels + [(i, 1, 0) for i in range(0, 40, 4)] + labels[:20], "doc_id long, quality int, toxic int")
    model, again = tx.learn(d, lab), tx.learn(d.repartition(6), lab.repartition(4))
    assert np.allclose(model.scalar, again.scalar)
    rows = {}
    for r in tx.score(d, model).collect():
        rows.setdefault(r.doc_id, []).append(r.score)
    assert all(len(set(rows[i])) == 1 and len(rows[i]) == 1 + (i < 40) for i in range(200) if i != 8)
    found = [r for r in tx.score(d, model).collect() if r.held_out]
    assert np.mean([r.predicted == int(r.doc_id % 4 == 0) for r in found]) > 0.9  # any label says so
