import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from lodestone.llm import personal as P

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def card(rng, n=16):
    d = "4" + "".join(rng.choice("0123456789") for _ in range(n - 2))
    return next(d + c for c in "0123456789" if luhn(d + c))


def base(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def corpus(rng):
    word = lambda: rng.choice(["the", "été", "of", "日本", "a1", "x", "erha", "🙂"])
    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(0, 9999):04d}"
    ip = lambda: ".".join(str(rng.randint(1, 254)) for _ in range(4))
    email = lambda: f"{rng.choice(['ab', 'q.w', 'n_x'])}.{rng.randint(10, 99)}@mail{rng.randint(0, 9)}.example.com"
    rows = []
    for i in range(300):
        parts = [word() for _ in range(rng.randint(0, 40))]
        if i % 2:
            for make in rng.sample([phone, ip, email, lambda: card(rng)], rng.randint(1, 4)):
                parts.insert(rng.randint(0, len(parts)), make())
        if i % 7 == 0:
            parts.append('token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"')
        rows.append((i, " ".join(parts)))
    return rows


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(1)
    c, d = card(rng), card(rng)
    rows = corpus(rng) + [
        (1000, None), (1000, None), (None, ""), (1001, f"{c} {d}"), (1002, f"call +1 (269) 555-3296 {c} or"), (1003, f"+1 (608) 555-2280 37.92.178.161 in {c} 53.121.55.90"),
        (1004, "a@b.com.%x@y.z..c@d.e-f.g @x.y q@w"), (1005, "300.1.2.3 1.2.3.4.5.6.7.8 0000.1.02.255 1..2.3.4.5"), (1006, f"{c[:4]}-{c[4:8]}-{c[8:12]}-{c[12:]} +49 (0) 30.1234567 +1+2345678901"),
        (1007, "5 5-5 " * 9), (1008, "v 1.2.3.4\n" + "+44 20 7946 0958 " + d), (1009, f"{c}\n{d}"), (1010, "🙂🙂 x@y.zz " + c), (None, "z@z.zz"),
    ]
    df = spark.createDataFrame([(i, t, "t", 3) for i, t in rows], "doc_id long, text string, found string, left int")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    out = P.query(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    plan = out._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    got = out.collect()
    assert len(got) == len(rows)
    by_base = lambda text: [f"{k}:{a}:{b}" for k, a, b in base(text)]
    want = sorted(((str(i), *[sum(k == kind for k, _, _ in base(t)) for kind in PATTERNS], hashlib.sha256(",".join(by_base(t)).encode()).hexdigest()) for i, t in rows))
    assert sorted((str(r.doc_id), *r[1:6]) for r in got) == want
    spans = {r.doc_id: r.spans.split(",") if r.spans else [] for r in got if r.doc_id is not None}
    texts = {i: t or "" for i, t in rows if i is not None}
    added = {}
    for i, found in spans.items():
        assert set(by_base(texts[i])) <= set(found) and len(set(found)) == len(found)
        order = [(list(PATTERNS).index(s.split(":")[0]), int(s.split(":")[1])) for s in found]
        assert order == sorted(order)
        for s in set(found) - set(by_base(texts[i])):
            kind, a, b = s.split(":")
            added.setdefault(i, set()).add((kind, texts[i][int(a) : int(b)]))
    assert added[1001] == {("card", c), ("card", d)} or {("card", c), ("card", d)} >= added[1001]
    assert added[1002] == {("phone", "+1 (269) 555-3296"), ("card", c)}
    assert added[1003] == {("phone", "+1 (608) 555-2280"), ("card", c)}
    assert ("card", d) in added[1008]
    # numbers in hexadecimal tokens are not taken, and no span holds another's signs of its kind
    assert not any("token" in texts[i] and len(s) < 15 for i, found in added.items() for _, s in found)
    for i, found in spans.items():
        for kind in PATTERNS:
            own = sorted((int(a), int(b)) for k, a, b in (s.split(":") for s in found) if k == kind)
            assert all(x[1] <= y[0] for x, y in zip(own, own[1:], strict=False))


def test_expectation_maximisation_by_hand(spark):
    rng = random.Random(2)
    rows = [(k, *[rng.choice([-1, 0, 1, 1]) for _ in range(P.LABELERS)], rng.randint(1, 50)) for k in (0, 2, 3) for _ in range(25)]
    names = [f"v{j}" for j in range(P.LABELERS)]
    df = spark.createDataFrame(rows, ", ".join(["kind int", *[f"{n} int" for n in names], "n long"]))
    model = P.reliabilities(df, rounds=5)
    for k in (0, 2, 3):
        own = [r for r in rows if r[0] == k]
        theta = [[list(P.BELIEF), list(reversed(P.BELIEF))] for _ in range(P.LABELERS)]
        odds, totals = 0.0, (sum(P.BELIEF),) * 2
        for step in range(6):
            logs = lambda j, v: math.log(theta[j][0][v + 1] / totals[0] / (theta[j][1][v + 1] / totals[1]))  # noqa: B023, E731
            if step == 5:
                break
            p = [1 / (1 + math.exp(-odds - sum(logs(j, r[1 + j]) for j in range(P.LABELERS)))) for r in own]
            yes = sum(r[-1] * x for r, x in zip(own, p, strict=True))
            no = sum(r[-1] for r in own) - yes
            theta = [[[P.BELIEF[v] + sum(r[-1] * x for r, x in zip(own, p, strict=True) if r[1 + j] == v - 1) for v in range(3)], [P.BELIEF[2 - v] + sum(r[-1] * (1 - x) for r, x in zip(own, p, strict=True) if r[1 + j] == v - 1) for v in range(3)]] for j in range(P.LABELERS)]
            odds, totals = math.log((yes + 1) / (no + 1)), (yes + sum(P.BELIEF), no + sum(P.BELIEF))
        assert abs(model.prior[k] - odds) < 1e-9
        for j in range(P.LABELERS):
            for v in (-1, 0, 1):
                assert abs(model.weight[(k * P.LABELERS + j) * 3 + v + 1] - logs(j, v)) < 1e-9


def test_long_texts_and_empty_table(spark):
    rng = random.Random(3)
    texts = ["1" * 200_000, "a" * 300_000 + "@", "a@" + "b." * 50_000 + "c", ("+1 (222) 555-0000 " + card(rng) + "\n") * 3000, "1." * 100_000, "+1" + "-1" * 50_000, "9" * 16 + " 9" * 50_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = P.candidates(df)
    got = {r.doc_id: [(P.KINDS[x.kind], x.start, x.end) for x in r.found if x.base] for r in found.collect()}
    # the plain patterns would take time with the square of these texts
    assert got[0] == got[1] == got[5] == got[6] == []
    assert got[2] == [("email", 0, len(texts[2]))]
    assert got[4] == [("ip", 8 * i, 8 * i + 7) for i in range(25_000)]
    assert sorted(got[3]) == sorted(base(texts[3]))
    model = P.Classifier(5.0, [0.0] * sum(P.BUCKETS))
    spans = {r.doc_id: r.spans for r in P.personal_spans(df, classifier=model).collect()}
    assert len(spans[3]) == 6000 and {x.kind for x in spans[3]} == {"phone", "card"}
    assert P.personal_spans(df.limit(0)).count() == 0


def test_checks(spark):
    rng = random.Random(4)
    numbers = [card(rng, n) for n in range(15, 20)] + ["".join(rng.choice("0123456789") for _ in range(rng.randint(15, 19))) for _ in range(200)]
    df = spark.createDataFrame([(x,) for x in numbers], "s string")
    assert [r[0] for r in df.select(P.luhn(F.col("s"))).collect()] == [luhn(x) for x in numbers]
