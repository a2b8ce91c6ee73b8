import itertools
import random

from lodestone.llm import hamming_topk


def brute(rows, k, step):
    code = {}
    bits = max((len(v) for i, v in rows if v is not None), default=1)
    for i, v in rows:
        if i is None or v is None:
            continue
        b = [int(x is not None and x > 0) for x in v] + [0] * (bits - len(v))
        code.setdefault(i, b)
    out = []
    for q in code:
        if q % step == 0:
            near = sorted((sum(a != b for a, b in zip(code[q], code[n], strict=True)), n) for n in code if n != q)[:k]
            out += [(q, r, n, d) for r, (d, n) in enumerate(near, 1)]
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, code int")
    return sorted(tuple(r) for r in hamming_topk.top_k(df, **options).collect())


def test_matches_brute_force(spark):
    rng = random.Random(6)
    base = [[rng.gauss(0, 1) for _ in range(24)] for _ in range(12)]
    rows = [(i, [x if rng.random() > 0.1 else -x for x in rng.choice(base)]) for i in range(300)]
    rows += [(1000 + i, base[0]) for i in range(60)]
    rows += [(None, base[0]), (2000, None), (2001, [1.0, None, float("nan")]), (2050, [-1.0] * 24), (2050, [-1.0] * 24), (2100, [])]
    assert run(spark, rows, k=5, query_step=50) == brute(rows, 5, 50)


def test_few_rows_and_none(spark):
    rows = [(0, [1.0, -1.0]), (1, [1.0, 1.0]), (50, [-1.0, 1.0])]
    assert run(spark, rows) == brute(rows, 10, 50)
    assert run(spark, [(3, [1.0])]) == [] and run(spark, []) == []


def test_more_than_a_word_and_no_broadcast(spark):
    rng = random.Random(7)
    base = [[rng.gauss(0, 1) for _ in range(100)] for _ in range(6)]
    rows = [(i, [x if rng.random() > 0.05 else -x for x in rng.choice(base)]) for i in range(150)]
    assert run(spark, rows, k=3, query_step=50, broadcast_rows=0) == brute(rows, 3, 50)
    assert hamming_topk.segments(64, 51282) == [(0, 0, 16), (0, 16, 16), (0, 32, 16), (0, 48, 16)]
    assert sum(w for _, _, w in hamming_topk.segments(100, 10)) == 100


def test_probes_are_never_broadcast(spark, monkeypatch):
    """Their number is unknown to the planner: it took them for as few as the queries, and the driver ran out of memory."""
    plans, stage = [], hamming_topk.stage
    monkeypatch.setattr(hamming_topk, "stage", lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or stage(df, name))
    rng = random.Random(8)
    rows = [(i, [rng.gauss(0, 1) for _ in range(20)]) for i in range(200)]
    assert run(spark, rows, k=3, query_step=50, broadcast_rows=0) == brute(rows, 3, 50)
    for plan in plans:
        lines = [(len(x) - len(x.lstrip(" :+-*()0123456789")), x) for x in plan.splitlines()]
        for i, (depth, x) in enumerate(lines):
            below = itertools.takewhile(lambda y, d=depth: y[0] > d, lines[i + 1 :])
            assert "BroadcastExchange" not in x or not any("MapInArrow" in y for _, y in below)


def test_chunks_of_any_size_meet_the_same_pairs(spark, monkeypatch):
    """Many chunks, crowded ones that are cut by id, and few pairs at a time."""
    rng = random.Random(9)
    base = [[rng.gauss(0, 1) for _ in range(70)] for _ in range(3)]
    rows = [(i, base[0][:40] + [x if rng.random() > 0.3 else -x for x in rng.choice(base)[40:]]) for i in range(120)]  # all alike in their first bits
    rows += [(200 + i, [x if rng.random() > 0.2 else -x for x in rng.choice(base)]) for i in range(120)] + [(500 + i, base[1]) for i in range(9)]
    monkeypatch.setattr(hamming_topk, "PROBES", 40)
    monkeypatch.setattr(hamming_topk, "MEETINGS", 25)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = hamming_topk.top_k(df, k=4, query_step=20, chunk_codes=5)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, 4, 20)
