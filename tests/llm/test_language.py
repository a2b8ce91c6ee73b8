import random

import numpy as np

from lodestone.llm import language as la
from lodestone.llm.folds import held_out


def rows(n=240):
    rng = random.Random(3)
    parts = {"en": ["the", "ing", "and", "th", "er"], "fr": ["é", "eau", "que", "ou", "è"], "de": ["ich", "ü", "sch", "ung", "ö"]}
    out = []
    for i in range(n):
        lang = ["en", "fr", "de"][i % 3]
        out.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 120))), lang))
    return out


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    net = la.Network(["a", "b", "c"], hidden=3)
    net.w = [w.astype(np.float64) * 0.5 for w in net.w]
    x = rng.integers(97, 101, (6, 5)).astype(np.uint8)
    label, mask = rng.integers(0, 3, 5), np.arange(6)[:, None] < np.array([6, 6, 4, 3, 6])[None, :]
    _, grads = net.gradients(x, label, mask)
    for w, g in zip(net.w, grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        old, h = w[at], 1e-2
        w[at] = old + h
        up, _ = net.gradients(x, label, mask)
        w[at] = old - h
        down, _ = net.gradients(x, label, mask)
        w[at] = old
        assert abs((up - down) / (2 * h) - g[at]) < 0.02 * abs(g[at]) + 1e-4


def test_held_out_accuracy_and_cases(spark, monkeypatch):
    monkeypatch.setattr(la, "STEPS", 120)
    data = rows()
    extra = [(1000, None, "en"), (1001, "", "fr"), (1002, "123 !?", "de"), (None, "the and ing the and ing", "en"), (1003, "que eau " * 20000, None), (7, data[7][1], "de")]
    docs = spark.createDataFrame([(*r, 0.5) for r in data + extra], "doc_id long, text string, lang string, score double")
    net = la.learn(docs)
    got = la.identify(docs, net).collect()
    assert len(got) == len(data) + len(extra)
    truth = {r[0]: r[2] for r in data}
    test = [r for r in got if r.held_out and r.doc_id in truth]
    assert len(test) > 20 and np.mean([r.lang_pred == truth[r.doc_id] for r in test]) > 0.95
    by = {r.doc_id: r for r in got if r.doc_id is None or r.doc_id >= 1000}
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1000].score == 0
    assert by[1003].lang_pred == "fr" and by[None].lang_pred == "en" and not by[None].held_out
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.lang_pred for r in la.identify(docs, la.learn(docs.limit(0))).collect()} == {"und"}
    assert la.identify(docs.limit(0), net).count() == 0


def brute_distribution(net, text):
    """Every position from its own definition: one byte after the other, in plain arithmetic."""
    table, u, back_table, back_u, out, bias = (w.astype(float) for w in net.w)
    n = u.shape[0]

    def run(data, table, u):
        h, states = np.zeros(n), []
        for b in data:
            x, r_in = table[b], h @ u
            z = np.clip(0.25 * (x[:n] + r_in[:n]) + 0.5, 0, 1)
            r = np.clip(0.25 * (x[n : 2 * n] + r_in[n : 2 * n]) + 0.5, 0, 1)
            c = np.tanh(x[2 * n :] + r * r_in[2 * n :])
            h = z * h + (1 - z) * c
            states.append(h)
        return states

    total = np.zeros(len(net.languages))
    for at in range(0, len(text), la.WINDOW):
        first, last = max(0, at - la.CONTEXT), min(len(text), at + la.WINDOW + la.CONTEXT)
        part = text[first:last]
        forward, backward = run(part, table, u), run(part[::-1], back_table, back_u)[::-1]
        for i in range(at, min(len(text), at + la.WINDOW)):
            y = np.concatenate([forward[i - first], backward[i - first]]) @ out + bias
            y = np.exp(y - y.max())
            total += y / y.sum()
    return total / max(1, len(text))


def test_prediction_is_that_of_a_plain_recurrence():
    net = la.Network(["a", "b", "c"])
    rng = random.Random(1)
    texts = [bytes(rng.choices(range(256), k=n)) for n in (1000, 0, 1, 63, 64, 65, 71, 72, 73, 128, 200)]
    got = net.predict(texts)
    for t, p in zip(texts, got, strict=True):
        assert np.allclose(p, brute_distribution(net, t), atol=1e-4)


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(la, "STEPS", 1)
    docs = spark.createDataFrame([(i, f"text of {i}", f"l{i % 300:03d}") for i in range(1500)] + [(3, f"row {i}", "l003") for i in range(900)], "doc_id long, text string, lang string")
    seen = []
    monkeypatch.setattr(la.Network, "train", lambda self, w, n, label: seen.append(np.bincount(label)))
    net = la.learn(docs)
    assert net.languages == [f"l{i:03d}" for i in range(300)] and seen[0].min() > 0
    assert seen[0].max() <= 53 * la.PIECES * 4  # rows of one id do not come together


def test_fold(spark):
    import zlib

    got = spark.range(50).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in got)


def test_numbers_are_no_letters():
    assert not any(la._letter(t) for t in ("", "\u00bd \u2461", "\u2167 12", "\u00b2_", "!? \u0301"))
    assert all(la._letter(t) for t in ("\u00bd a", "\u00aa", "\u02b0", "\u6f22", "1\u00e9"))


def test_labels_of_held_out_rows_change_nothing(spark):
    import random
    import zlib

    rng = random.Random(8)
    words = {"aa": ["thou", "wither", "nought"], "bb": ["jag", "och", "inte"]}
    rows = [(i, " ".join(rng.choice(words[g]) for _ in range(12)), g) for i in range(120) for g in [rng.choice(["aa", "bb"])]]
    out = lambda i: zlib.crc32(str(i).encode()) % 5 == 0
    turned = [(i, t, f"x{i}" if out(i) else g) for i, t, g in rows]
    found = []
    for table in (rows, turned):
        df = spark.createDataFrame(table, "doc_id long, text string, lang string").coalesce(1)
        found.append(sorted(tuple(r) for r in la.identify(df, la.learn(df)).collect()))
    assert found[0] == found[1] and {r[2] for r in found[0]} == {"aa", "bb"}


def test_windows_at_once_follow_the_number_of_languages():
    net = la.Network([f"l{i}" for i in range(300)])
    sizes = []
    inner = net._positions
    net._positions = lambda x, inside=None: sizes.append(x.shape[1]) or inner(x, inside)
    p = net.predict([b"some words of a text " * 400])
    assert p.shape == (1, 300) and abs(p.sum() - 1) < 1e-3 and max(sizes) <= la.LANES * la.FEW // 300
