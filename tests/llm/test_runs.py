import hashlib
import random
import zlib

from lodestone.llm import runs


def slow(w, min_length, min_exponent):
    """Every run by definition."""
    n, seen = len(w), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j - i >= q:
                seen.setdefault((i, j + q), q)
            i = max(j, i) + 1
    return sorted((s, e - s, q) for (s, e), q in seen.items() if e - s >= max(min_length, min_exponent * q))


def fib(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def test_all_runs_of_small_words():
    rng = random.Random(1)
    for trial in range(1500):
        n, sigma = rng.randint(0, 60), rng.choice([1, 2, 2, 3, 4])
        w = [rng.randrange(sigma) for _ in range(n)]
        if trial % 3 == 0 and n:
            p = w[: rng.randint(1, 9)]
            at = rng.randrange(n)
            w[at:at] = p * rng.randint(2, 6)
        if trial % 5 == 0:
            w = w + w[: len(w) // 2] + w
        for m, e in ((2, 2), (6, 3), (9, 2)):
            assert runs.find(w, m, e) == slow(w, m, e), (w, m, e)
    for w in (fib(300), [0] * 100, fib(90) * 3, [0, 1] * 80 + [1, 0] * 80):
        for m, e in ((2, 2), (24, 3)):
            assert runs.find(w, m, e) == slow(w, m, e)


def test_factors_are_longest_earlier_strings():
    rng = random.Random(2)
    for _ in range(200):
        w = [rng.randrange(3) for _ in range(rng.randint(0, 40))]
        at = 0
        earlier = lambda i, k: any(w[j : j + k] == w[i : i + k] for j in range(i))
        for b, size, source in runs.factors(w):
            assert b == at
            if source < 0:
                assert size == 1 and w[b] not in w[:b]
            else:
                assert source < b and w[source : source + size] == w[b : b + size] and (b + size == len(w) or not earlier(b, size + 1))
            at += size
        assert at == len(w)


def test_cut_texts_have_the_same_runs():
    rng = random.Random(3)
    for m, e in ((24, 3), (12, 3), (10, 2), (20, 4)):
        for _ in range(60):
            w = [b"w%d" % rng.randrange(rng.choice([3, 400])) for _ in range(rng.randint(0, 300))]
            for _ in range(rng.randint(0, 3)):
                p = [b"w%d" % rng.randrange(9) for _ in range(rng.randint(1, 20))]
                at = rng.randint(0, len(w))
                w[at:at] = (p * 6)[: rng.randint(1, 6 * len(p))]
            assert runs.runs_of(w, m, e) == slow(w, m, e)


def expected(doc_id, text):
    w = [x for x in __import__("re").findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())]
    n = len(w)
    if doc_id is not None and n and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = slow(w, 24, 3)
    found.sort(key=lambda r: (r[0], r[2]))
    keep = [x for i, x in enumerate(w) if not any(s + q <= i < s + k for s, k, q in found)]
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    digest = lambda b: hashlib.sha256(b).hexdigest()
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, digest("".join(f"{s},{k},{q}\n" for s, k, q in found).encode()), digest(b" ".join(keep)))


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(4)
    docs = [(None, None), (1, ""), (2, None), (3, " \x0b\x0c\t\n"), (4, "a " * 24), (4, "a " * 24), (5, "a " * 23), (None, "x y z " * 9), (6, "é é " * 30 + "　 q"), (7, "a\tb\nc\x0bd " * 12 + "tail " * 40)]
    for i in range(8, 130):
        w = [rng.choice(["foo", "bar", "é", "q"]) if rng.random() < 0.3 else f"w{rng.randrange(9999)}" for _ in range(rng.randint(0, 250))]
        if i % 3 == 0:
            w[5:5] = (w[:7] * 9)[: rng.randint(20, 60)]
        docs.append((i, " ".join(w)))
    spark.createDataFrame([(i, t, "n", 1) for i, t in docs], "doc_id long, text string, runs string, collapsed int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = runs.query(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in out.collect()), key=key)
    assert got == sorted((expected(i, t) for i, t in docs), key=key)
    assert sum(r[1] for r in got) > 30


def test_long_text_and_empty_table(spark):
    rng = random.Random(5)
    part = [f"p{rng.randrange(50)}" for _ in range(3000)]
    text = " ".join([f"u{i}" for i in range(60000)] + part * 5 + ["same"] * 40000)
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = runs.periodic_runs(d).first()
    assert row.n_words == 115000 and (60000, 15000, 3000) in {(r.start, r.length, r.period) for r in row.runs} and (75000, 40000, 1) in {(r.start, r.length, r.period) for r in row.runs}
    assert row.collapsed == " ".join([f"u{i}" for i in range(60000)] + part + ["same"])
    assert runs.periodic_runs(d.limit(0)).count() == 0
