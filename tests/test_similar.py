import random

import numpy as np
import pytest

from lodestone.functions import strings
from lodestone.operators import blocking, linkage
from lodestone.operators.fellegi_sunter import Fit
from lodestone.operators.levels import ExactMatch, FuzzyString, with_levels


def words(rng, n, letters, most):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(n)]


@pytest.mark.parametrize(("letters", "most"), [("ab", 12), ("abcñ😀", 64), ("0123456789", 18), ("abc", 90), ("a", 0)])
def test_words_of_bits_give_the_same_similarities(letters, most, monkeypatch):
    rng = random.Random(5)
    a, b = words(rng, 60, letters, most), words(rng, 40, letters, most)
    x, y = np.array([rng.randrange(60) for _ in range(900)]), np.array([rng.randrange(40) for _ in range(900)])
    want = strings.jaro_winkler([a[i] for i in x], [b[i] for i in y])
    assert (strings.Similarities(a, b).of(x, y) == want).all()
    assert (strings.Similarities(a, b).grid(3, 9, 7) == strings.jaro_winkler([t for t in a[3:9] for _ in b[7:]], b[7:] * 6).reshape(6, 33)).all()
    monkeypatch.setattr(strings, "MOST_WORDS", 150)
    assert (strings.Similarities(a, b).of(x, y) == want).all()


@pytest.mark.parametrize("unit", [None, 40])
def test_tiles_compared_whole_lose_no_pair_and_no_level(spark, unit):
    rng = random.Random(6)
    data = [(f"i{i}", rng.choice(["hot", "hot", "a", None, "b"]), rng.choice(["martha", "marhta", None, "", "x" * 70, "aab" * 5, "aba" * 5]), i % 3) for i in range(90)]
    df, spec = spark.createDataFrame(data, "id string, k string, s string, v int"), [FuzzyString("s", (0.8, 0.95))]
    cols = ["__id_l__", "__id_r__", "v_l", "v_r", "level__s"]
    for rules, right in (([("k",)], None), ([("v",), ("k",)], None), ([("k",)], df.where("v = 1"))):
        plain = with_levels(blocking.candidates(df, "id", rules, ["v", "s"], right), spec).select(*cols)
        whole = with_levels(blocking.candidates(df, "id", rules, ["v", "s"], right, unit_pairs=unit, similar=["s"]), spec).select(*cols)
        assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, plain.collect()))


def test_matches_compare_texts_only_where_other_levels_leave_it_open(spark):
    rng = random.Random(7)
    data = [(i, rng.choice("ab"), rng.choice("xy"), rng.choice(["martha", "marhta", "dixon"])) for i in range(60)]
    df = spark.createDataFrame(data, "id long, k string, e string, s string")
    config = linkage.LinkConfig("id", (ExactMatch("e"), FuzzyString("s", (0.9, 0.97))), (("k",),))
    f = Fit([np.array([0, 0.1, 0.9]), np.array([0, 0.1, 0.2, 0.7])], [np.array([0, 0.9, 0.1]), np.array([0, 0.8, 0.1, 0.1])], 0.1)
    grid = np.array([(a, b) for a in (0, 1, 2) for b in (0, 1, 2, 3)])
    pairs = blocking.candidates(df, "id", config.blocking_rules, ["e", "s"])
    scored = linkage.score_pairs(with_levels(pairs, config.comparisons), config, f, grid)
    for t in (0.0, 0.3, 0.6, 1.0):
        assert sorted(map(tuple, linkage.score_matches(pairs, config, f, grid, t).collect())) == sorted(map(tuple, linkage.matches(scored, t).collect()))


def test_labelled_pairs_are_found_among_candidates_by_id(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, rng.choice(["a", "b", None]), rng.choice([1, 2, None])) for i in range(40)], "id long, k string, g int")
    ids = spark.createDataFrame([(rng.randrange(45), rng.randrange(45)) for _ in range(400)], "__id_l__ long, __id_r__ long")
    for rules in ([("k",)], [("k", "g")], [("k",), ("g",)]):
        some = {(r[0], r[1]) for r in ids.collect()}
        want = sorted(tuple(r) for r in blocking.candidates(df, "id", rules, ["g"]).collect() if (r[0], r[1]) in some)
        assert sorted(map(tuple, blocking.candidates_of(ids, df, "id", rules, ["g"]).collect())) == want


def test_the_fit_holds_no_pairs_and_needs_no_cap_on_them(spark):
    df = spark.createDataFrame([(i, "k", i % 7, f"name{i % 11}") for i in range(60)], "id long, k string, v long, s string")
    few = linkage.LinkConfig("id", (ExactMatch("v"), FuzzyString("s", (0.9, 0.97))), (("k",),), max_pairs_warning=10, max_pairs_hard_cap=10)
    with pytest.raises(MemoryError):
        linkage.link(df, few)
    got, want = linkage.fit_pairs(df, few), linkage.link(df, linkage.LinkConfig("id", few.comparisons, few.blocking_rules))
    assert sorted(map(tuple, got.pairs.collect())) == sorted(map(tuple, want.pairs.collect())) and got.fit.match_share == want.fit.match_share
