import hashlib
import random

import numpy as np
import pytest

from lodestone.llm import repeats


def brute(rows, w=100):
    rows = sorted(((i, (t or "").encode()) for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    seen, out = set(), []
    for i, b in rows:
        gone = bytearray(len(b))
        for p in range(len(b) - w + 1):
            x = b[p : p + w]
            if x in seen:
                gone[p : p + w] = b"\1" * w
            seen.add(x)
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for p, g in enumerate(gone) if g and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def cases():
    rng = random.Random(5)

    def words(n):
        return " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(n))

    shared = [words(60) for _ in range(3)]
    rows = []
    for i in range(80):
        parts = [words(rng.randint(0, 80))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(shared)
            a = rng.randint(0, len(p) // 2)
            parts += [p[a : a + rng.randint(60, 200)], words(rng.randint(1, 20))]
        rows.append((i * 7 % 80, "".join(parts)))
    rows += [(100 + i, rows[3][1]) for i in range(5)]
    rows += [(200, "ab " * 200), (201, "ab " * 90 + "x" + "ab " * 50), (202, None), (203, ""), (None, rows[8][1]), (204, "é" * 49), (204, "é" * 300), (204, "é" * 300)]
    rows.append((300, words(30000)))
    rows.append((301, rows[-1][1][5000:9000] + words(50) + rows[-1][1][100000:]))
    return rows


def check(spark, rows, **options):
    docs = spark.createDataFrame([(*r, b"x") for r in rows], "doc_id long, text string, body binary")
    found = repeats.remove_repeats(docs, **options)
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found.collect()]
    assert sorted(got, key=str) == brute(rows)


def test_matches_brute_force(spark):
    check(spark, cases())


def test_small_chunks_and_hot_anchors(spark):
    check(spark, cases(), chunk_bytes=5000, hot=3)


def test_very_hot_anchors_travel_as_windows(spark):
    check(spark, cases(), chunk_bytes=5000, hot=3, very_hot=8)


def test_windows_of_other_sizes(spark):
    docs = spark.createDataFrame(cases(), "doc_id long, text string")
    for window, gram in ((600, 32), (40, 16)):
        got = repeats.remove_repeats(docs, window=window, gram=gram, chunk_bytes=20_000)
        assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()], key=str) == brute(cases(), window)
    with pytest.raises(ValueError, match="window"):
        repeats.remove_repeats(docs, window=5000)


def test_one_text_in_many_chunks(spark, monkeypatch):
    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abcdef") for _ in range(5)) for _ in range(150))
    rows = [(i, text) for i in range(300)]  # exact copies
    for i in range(300):  # near copies: equal segments meet across chunks
        words = text.split()
        words[rng.randrange(150)] = "other"
        rows.append((1000 + i, " ".join(words)))
    monkeypatch.setattr(repeats, "SORT_ROWS", 50)  # routes and keys that fill more than a batch
    check(spark, rows, chunk_bytes=4000, hot=20)
    check(spark, rows, chunk_bytes=4000, hot=20, very_hot=100)


def test_radix_order_is_stable():
    rng = np.random.default_rng(3)
    low, high = rng.integers(0, 1 << 62, 500), rng.integers(0, 3, 500) << 40
    assert repeats.radix_order(low, high).tolist() == np.lexsort((low, high)).tolist()
    assert repeats.radix_order(high).tolist() == np.argsort(high, kind="stable").tolist()


def test_empty_table(spark):
    assert repeats.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_refine_is_depth_limited():
    rows = [b"aaaaaaaabb", b"aaaaaaaacc", b"aaaaaaaabb", b"baaaaaaabb"]
    m = np.frombuffer(b"".join(rows), np.uint8).reshape(4, 10)
    digits = [lambda r, j=j: m[r, j] for j in range(8)]
    found, gid = repeats.refine(np.zeros(4, int), digits)
    assert sorted(found.tolist()) == [0, 1, 2] and len(set(gid.tolist())) == 1
    found, _ = repeats.refine(np.zeros(4, int), [*digits, lambda r: m[r, 8], lambda r: m[r, 9]])
    assert sorted(found.tolist()) == [0, 2]


def test_runs_cover_each_window_once(monkeypatch):
    rng = np.random.default_rng(2)
    buf = rng.integers(97, 100, 5000).astype(np.uint8)
    lengths = np.array([1200, 99, 100, 3601])
    whole = repeats.anchor_runs(buf, lengths, 100, 32)
    assert whole.n.sum() == 1101 + 1 + 3502
    monkeypatch.setattr(repeats, "SLICE", 700)
    cut = repeats.anchor_runs(buf, lengths, 100, 32)
    key = lambda x: sorted((int(s) + i, int(a)) for s, n, a in zip(x.start, x.n, x.anchor, strict=True) for i in range(n))
    assert key(whole) == key(cut)
