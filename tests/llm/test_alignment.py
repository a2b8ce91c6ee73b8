import collections
import hashlib
import random

import pytest

from lodestone.llm import alignment as al

WORDS = ["the", "Haus", "été", "it's", "x1y22", "don't,", "naïve.", "…", "日本語", "ﬁ", "<|endoftext|>", "<s>", "<0x41>", "12345", "token=be8a8e7152a5c5", "AAAAAAAAAA", "Ünï", "a" * 40, "🙂", "é", "-" * 9]
ODD = ["", " ", "\n", "  \n ", "\t", "a\tb c", "tail ", "tail\n\n", " lead", "\n lead", "a b c", "a  b  c　d", "x\x00y", "a▁b", "▁", "\x1c q \x1c", "\x85 \x85z", "line\r\nline\r\n", "é é"]


@pytest.fixture(scope="module")
def tokenizers():
    return al.Tokenizers(al.tokenizer_path(al.A_NAME), al.tokenizer_path(al.B_NAME))


def plain(t, text):
    """Tokens and groups of a whole text, by the definition."""
    if not text:
        return [], [], []
    a = t.a.encode(" " + text, add_special_tokens=False).ids
    b = t.b.encode(text)
    raw = (" " + text).encode()
    if b"".join(t.a_bytes[i] for i in a) != raw or b"".join(t.b_bytes[i] for i in b) != raw:
        return [], [], []
    ends = []
    for ids, table in ((a, t.a_bytes), (b, t.b_bytes)):
        at, out = 0, []
        for i in ids:
            at += len(table[i])
            out.append(at)
        ends.append(out)
    both = sorted(set(ends[0]) & set(ends[1]))
    groups, low = [], 0
    for e in both:
        groups.append(([i for i, x in zip(a, ends[0]) if low < x <= e], [i for i, x in zip(b, ends[1]) if low < x <= e]))
        low = e
    return a, b, groups


def texts(rng, n):
    out = list(ODD)
    for _ in range(n):
        out.append("".join(rng.choice([" ", " ", " ", " ", "\n", "  ", " \n", "\t"] if rng.random() < 0.1 else [" "]) + rng.choice(WORDS) for _ in range(rng.randint(0, 60))).lstrip(rng.choice(["", " "])))
    return out


def test_parts_give_the_tokens_of_whole_texts(tokenizers):
    assert tokenizers.parted
    rng = random.Random(1)
    store = al.Parts(tokenizers)
    for text in texts(rng, 300):
        a, b, groups = plain(tokenizers, text)
        d, _ = al.chunk_rows(store, [text])
        assert (d["n_a"][0], d["n_b"][0], d["n_groups"][0]) == (len(a), len(b), len(groups)), text
        assert d["groups"][0] == ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
    sample = texts(rng, 30)
    by_parts = al.chunk_rows(store, sample)[0]
    tokenizers.parted = False
    whole = al.chunk_rows(al.Parts(tokenizers), sample)[0]
    tokenizers.parted = True
    assert whole["groups"] == by_parts["groups"] and whole["n_links"] == by_parts["n_links"]


def test_packed_sequences_round_trip():
    import numpy as np

    for top in (0, 1, 127, 128, 255, 40000, 1 << 31, 1 << 40):
        v, w = np.array([0, top, 3]), np.array([top, 1, 1])
        x, y = al.unpacked(al.packed(v, w), 2)
        assert (x == v).all() and (y == w).all()
    assert [len(x) for x in al.unpacked(al.packed(np.zeros(0, int), np.zeros(0, int)), 2)] == [0, 0]


def expected(t, rows):
    per, held = [], collections.Counter()
    for i, text in rows:
        a, b, groups = plain(t, text)
        links = collections.Counter((x, y) for left, right in groups for x in left for y in right)
        held.update(links.keys())
        per.append((i, a, b, groups, links))
    top = collections.defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    out = []
    for i, a, b, groups, links in per:
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        best = sum(k for (x, y), k in links.items() if held[x, y] == top[x])
        out.append((i, len(a), len(b), len(groups), sum(links.values()), best, sum(k * held[p] for p, k in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str), held


def test_query_against_brute_force(spark, tmp_path, tokenizers, monkeypatch):
    rng = random.Random(2)
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts(rng, 150))] + [(3, None), (3, None), (5, "the the the"), (5, "the the the"), (1 << 60, "z" * 3000), (9, "ก" * 400)]
    spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, chunk string, pairs int").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    want, held = expected(tokenizers, rows)
    out = al.query(spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == want
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    small = al.aligned(d, a_path=al.tokenizer_path(al.A_NAME), b_path=al.tokenizer_path(al.B_NAME), chunk=500, remembered=20).drop("groups")
    counts = al.pair_counts(small)
    assert {(r.a, r.b): r.n_docs for r in counts.collect()} == dict(held)
    again = al.with_counts(small, counts).collect()
    assert sorted((r.n_links, r.n_best, r.count_sum) for r in again) == sorted(w[4:7] for w in want)


def test_empty_table(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    rows = al.aligned(d, a_path=al.tokenizer_path(al.A_NAME), b_path=al.tokenizer_path(al.B_NAME))
    assert rows.count() == 0 and al.with_counts(rows.drop("groups"), al.pair_counts(rows)).count() == 0
