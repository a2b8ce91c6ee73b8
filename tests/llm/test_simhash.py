import random
from fractions import Fraction

import numpy as np
import xxhash

from lodestone.llm import simhash


def brute_fingerprint(text):
    words = []
    for c in (text or "").encode().lower().replace(b"\x0b", b" ").replace(b"\x0c", b" ").split():
        words.append(c)
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))  # the first of the words


def brute_components(rows, radius=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, f"{fps[i]:016x}", min(ids, default=None)))
    return sorted(out, key=str)


def cases():
    rng = random.Random(7)
    words = ["Alpha", "beta", "gämma", "delta", "eps", "zeta", "eta", "iota", "x|y"]
    rows = []
    for i in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 60))]
        rows.append((i * 3, " ".join(base)))
        for _ in range(rng.randint(0, 3)):
            near = list(base)
            near[rng.randrange(len(near))] = rng.choice(words)
            rows.append((rng.randint(0, 500), "\n\t".join(near)))
    rows += [(900, None), (901, ""), (902, " \n"), (None, "alone here"), (5, rows[0][1]), (5, rows[0][1]), (903, "a b\x0bc\x0cd e f")]
    rows.append((904, "many words of one long text " * 30000))
    return rows


def test_matches_brute_force(spark):
    rows = cases()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, fp int")
    found = [tuple(r) for r in simhash.near_duplicates(docs).collect()]
    assert sorted(found, key=str) == brute_components(rows)


def test_crowded_files_are_cut_into_tiles(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(10)]
    fps = set()
    for _ in range(600):
        x = rng.choice(base)
        for _ in range(rng.randint(0, 3)):
            x ^= 1 << rng.randrange(64)
        fps.add(x - (1 << 64) if x >> 63 else x)
    from lodestone.operators.components import connected_components

    nodes = spark.createDataFrame([(f, f) for f in fps], "node long, fp0 long")
    whole = {tuple(r) for r in connected_components(simhash.near_links(nodes)).collect()}
    cut = {tuple(r) for r in connected_components(simhash.near_links(nodes, tile=16)).collect()}
    assert whole == cut and len({b for _, b in cut}) == 10


def test_sliced_matches_are_the_hamming_ball():
    rng = np.random.default_rng(1)
    fps = rng.integers(0, 1 << 63, 64, dtype=np.uint64)
    query = np.concatenate([fps[:8] ^ np.uint64(0b1111), fps[:8] ^ np.uint64(0b11111), fps[:2]])
    q, _, mask = simhash.sliced_matches(query[:, None], simhash._planes(fps[:, None]), np.arange(18), np.zeros(18, int), 4)
    got = {(int(a), lane) for a, m in zip(q, mask, strict=True) for lane in range(64) if int(m) >> lane & 1}
    assert got == {(i, j) for i in range(18) for j in range(64) if int(query[i] ^ fps[j]).bit_count() <= 4}


def test_more_segments_for_more_fingerprints():
    assert [len(simhash.segment_masks(n)) for n in (10, 10**6, 10**8, 10**10)] == [5, 5, 15, 35]
    assert all((m & ~((1 << 64) - 1)) == 0 for m in simhash.segment_masks(10**12))


def test_empty_and_keep_one(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(2, "a b c d e"), (1, "a b c d e"), (3, "other words are here now"), (1, "a b c d e")], "doc_id long, text string")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_wide_fingerprints_find_similar_texts(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    rows, near = [], {}
    for i in range(120):
        base = [word() for _ in range(rng.randint(80, 400))]
        rows.append((i, " ".join(base)))
        if i % 2:
            copy = list(base)
            for _ in range(len(base) // 75):  # some words changed: similarity of five-word shingles about 0.87
                copy[rng.randrange(len(copy))] = word()
            rows.append((1000 + i, " ".join(copy)))
            near[1000 + i] = i
    rows += [(2000, rows[0][1]), (None, rows[1][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, k=5, wide=4, similarity=0.8).collect()}
    assert np.mean([got[c] == i for c, i in near.items()]) > 0.9
    assert all(got[i] == i for i in range(120)) and got[2000] == 0
    kept = [r.doc_id for r in simhash.keep_one(docs, k=5, wide=4, similarity=0.8).collect()]
    assert set(range(120)) | {None} <= set(kept) and len(kept) == len(set(kept))


def test_dense_groups_hang_together():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, (1, 4), dtype=np.uint64)
    fps = np.repeat(base, 500, 0)
    for i in range(500):
        for b in rng.choice(256, 8, replace=False):
            fps[i, b // 64] ^= np.uint64(1 << int(b % 64))
    fps[250:] = ~fps[250:]
    a, b = simhash.links(fps, np.zeros(500, int), np.zeros(500, int), 40)
    assert len(a) == 498 and set(b.tolist()) == {0, 250}


def brute_similar(rows, k, similarity):
    """Components of the graph of pairs whose sets of shingles have this Jaccard similarity."""
    sets = []
    for _, text in rows:
        words = (text or "").lower().split()
        sets.append({tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) * 10 >= round(similarity * 10) * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, min(ids, default=None)))
    return sorted(out, key=str)


def test_similarity_is_that_of_the_sets(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    rows = []
    for i in range(60):  # changes that lead to similarities around 0.8, some of them along chains
        base = [word() for _ in range(rng.randint(6, 150))]
        for c in range(4):
            rows.append((10 * i + c, " ".join(base)))
            for _ in range(rng.randint(1, max(1, len(base) // 40))):
                base[rng.randrange(len(base))] = word()
    shared = [word() for _ in range(60)]
    for i in range(60):  # a common passage, and a crowd of near copies
        rows.append((1000 + i, " ".join(shared + [word() for _ in range(rng.choice([8, 12, 14, 30]))])))
    rows += [(2000, None), (2001, " "), (None, rows[3][1]), (5, rows[0][1]), (5, rows[0][1])]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for tile in (8, 512):
        monkeypatch.setattr(simhash, "CROWD_TILE", tile)
        got = simhash.near_duplicates(docs, k=5, wide=4, similarity=0.8).collect()
        assert sorted([(r.doc_id, r.component_id) for r in got], key=str) == brute_similar(rows, 5, 0.8)


def test_repeated_shingles_count_once(spark):
    w = lambda name, n: [f"{name}{i}" for i in range(n)]
    line = w("line", 8)
    rows = [w("a", 100), w("a", 100) + w("a", 20) * 10]  # the same set
    rows += [w("b", 60) + line * 20, w("c", 60) + line * 20]  # unrelated, with a repeated line
    rows += [w("d", 8) + ["x"], w("d", 8) + ["y"] * 30]  # 8 of 10
    rows += [w("e", 79) + w("f", 11), (w("e", 79) + w("g", 10)) * 3]  # 79 of 100
    docs = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs, k=1, wide=4, similarity=0.8).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7}


def test_candidates_cover_pairs_at_the_threshold():
    rng = np.random.default_rng(6)
    for n in (4, 8, 20, 300):  # the smaller set is the larger without its last elements; similarity 0.8
        met, masks = 0, simhash.choice_masks(200_000, 4, 0.8)
        for _ in range(200):
            h = rng.integers(0, 1 << 63, n + n // 4, dtype=np.uint64)
            a, b = (np.array(simhash._fingerprint(np.unique(x), 4), np.uint64) for x in (h, h[:n]))
            apart = a ^ b
            near = sum(int(x).bit_count() for x in apart) <= simhash.radius_of(Fraction("0.8"), 4)
            met += near and any(not any(int(x) & m for x, m in zip(apart, ms, strict=True)) for ms in masks)
        assert met >= 190


def test_keep_one_decides_by_row(spark):
    words = lambda name, n: " ".join(f"{name}{i}" for i in range(n))
    a, b, c = words("a", 30), words("b", 30), words("c", 30)
    rows = [(1, a), (2, a), (2, b), (2, c), (2, c), (3, c), (4, None), (5, ""), (6, b + " more")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, th string")
    kept = sorted(tuple(r) for r in simhash.keep_one(docs, k=5).collect())
    assert kept == [(1, a, "x"), (2, b, "x"), (2, c, "x"), (4, None, "x")]


def test_units_hold_every_pair_that_is_not_known(spark):
    rows = [(bytes([i]), b"c", b"h", i % 3 == 0) for i in range(40)]
    met = spark.createDataFrame(rows, "node binary, root binary, hub binary, near boolean")
    units = {}
    for r in simhash._units(met, 4).collect():
        units.setdefault(tuple(r.unit), []).append((bytes(r.node)[0], r.side))
    pairs = set()
    for members in units.values():
        assert len(members) <= 40
        pairs |= {frozenset((x, y)) for x, s in members for y, t in members if x < y and (s == 0 or s != t)}
    assert pairs >= {frozenset((x, y)) for x in range(40) for y in range(x) if x % 3 or y % 3}


def test_keep_one_with_clashing_names(spark):
    from lodestone.llm import simhash

    text = "a b c d e f g h i j k l m n o p"
    rows = [(1, text, 5, "u", "v", 2), (2, text, 6, "u", "v", 2), (1, text, 5, "u", "v", 2), (3, "other words in this one than there", 7, "u", "v", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __row_id int, __row_th string, __key_id string, __key_th int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
