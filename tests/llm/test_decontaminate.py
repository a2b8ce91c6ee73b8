import random
import re

from lodestone.llm import decontaminate


def grams(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_matches_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    items = [(i, " ".join(word() for _ in range(rng.randint(1, 40)))) for i in range(60)] + [(None, "null id item of seven words here"), (99, None)]
    docs = []
    for i in range(150):
        parts = [word() for _ in range(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 2)):
            w = items[rng.randrange(60)][1].upper().split()
            w = w[: rng.randint(max(1, len(w) * 6 // 10), len(w))]
            at = rng.randint(0, len(parts))
            parts[at:at] = w
        docs.append((i, (", " if i % 2 else "\n").join(parts)))
    docs += [(500, None), (501, ""), (502, "a b c d"), (None, "x Null-id item of seven words here!"), (5, docs[9][1]), (5, docs[9][1])]
    docs.append((600, " ".join([word() for _ in range(40000)]) + " " + items[3][1] + " " + items[4][1]))
    d = spark.createDataFrame([(*r, 1, "q") for r in docs], "doc_id long, text string, n int, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = set()
    by_id = {}
    for i, t in docs:
        by_id.setdefault(i, set()).update(grams(t))
    for i, g in by_id.items():
        for j, t in items:
            n = grams(t)
            if n and len(n & g) * 10 >= len(n) * 8:
                want.add((i, j, len(n & g), len(n)))
    found = decontaminate.contamination(d, b)
    assert {tuple(r)[:4] for r in found.collect()} == want and found.count() == len(want) > 20
    shuffled = decontaminate.contamination(d, b, broadcast_rows=0)
    assert {tuple(r)[:4] for r in shuffled.collect()} == want
    clean = decontaminate.decontaminate(d, b)
    bad = {i for i, *_ in want}
    assert clean.columns == d.columns
    assert sorted((r.doc_id for r in clean.collect())) == sorted(i for i, _ in docs if i not in bad)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    assert decontaminate.contamination(none, items).count() == 0
    assert decontaminate.contamination(docs, items.limit(0)).count() == 0
    assert decontaminate.contamination(docs, items).count() == 1


def test_main_path_is_native(spark):
    docs = spark.createDataFrame([(1, "one two three four five six")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    plan = decontaminate.contamination(docs, items)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "one two three four five six", 7, "x"), (2, "none of it", 8, "y")], "doc_id long, text string, __contaminated_id int, __Contaminated_ID_ string")
    items = spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string")
    clean = decontaminate.decontaminate(docs, items)
    assert clean.columns == docs.columns and [tuple(r) for r in clean.collect()] == [(2, "none of it", 8, "y")]
    assert decontaminate.decontaminate(docs, items, broadcast_rows=0).count() == 1
