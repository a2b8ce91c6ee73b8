import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions import strings
from lodestone.operators import blocking, grids, linkage
from lodestone.operators.fellegi_sunter import Fit
from lodestone.operators.levels import ExactMatch, FuzzyString, NumericDiff, patterns, with_levels

SPECS = [ExactMatch("e"), NumericDiff("v", (0.5, 3.0)), NumericDiff("w", (2.0, 1e18)), FuzzyString("s", (0.8, 0.93, 0.97))]


def rows(spark, seed, n, texts):
    rng = random.Random(seed)
    values = [1.5, 2.0, 4.0, -3.0, None, float("nan"), float("inf")]
    data = [(f"i{i}" if i else None, rng.choice(["hot", "hot", "a", None, "b"]), rng.choice(["x", "y", None]), rng.choice(values), rng.choice([2**63 - 1, -(2**63), 0, 1, None]), texts(rng)) for i in range(n)]
    return spark.createDataFrame(data, "id string, k string, e string, v double, w long, s string").repartition(3)


TEXTS = {
    "short": lambda r: r.choice(["martha", "marhta", None, "", "dixon", "aab" * 5, "aba" * 5]),
    "numbered": lambda r: f"Customer#{r.randrange(3000):09d}",
    "long": lambda r: r.choice(["x" * 70, "x" * 69 + "y", "martha", None]),
    "wide": lambda r: "".join(r.choice("abc") for _ in range(r.randint(0, 40))),
    "null": lambda r: None,
}


@pytest.mark.parametrize("kind", TEXTS)
@pytest.mark.parametrize("unit", [None, 40])
@pytest.mark.parametrize("two", [False, True])
def test_grids_give_the_levels_of_the_pairs_one_by_one(spark, kind, unit, two, monkeypatch):
    df = rows(spark, 1, 90, TEXTS[kind])
    right = rows(spark, 2, 30, TEXTS[kind]) if two else None
    assert grids.able(df, [("k",)], SPECS, right)
    names = ["__id_l__", "__id_r__", *[f"level__{s.column}" for s in SPECS]]
    plain = with_levels(blocking.candidates(df, "id", [("k",)], [s.column for s in SPECS], right), SPECS).select(*names)
    want = sorted(map(tuple, plain.collect()), key=repr)
    got = grids.level_pairs(df, "id", ("k",), SPECS, right, unit_pairs=unit)
    assert got.dtypes == plain.dtypes and sorted(map(tuple, got.collect()), key=repr) == want
    counts = grids.level_counts(df, "id", ("k",), SPECS, right, unit_pairs=unit)
    assert counts.dtypes == patterns(plain, SPECS).dtypes and sorted(map(tuple, counts.collect())) == sorted(map(tuple, patterns(plain, SPECS).collect()))


def test_counts_of_patterns_make_no_row_for_a_pair(spark):
    df = spark.createDataFrame([(i, i % 3, i % 7, f"name{i % 11}") for i in range(200)], "id long, k long, v long, s string")
    plan = linkage.counted_patterns(df, "id", [("k",)], [ExactMatch("v"), FuzzyString("s")])._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan


def test_what_grids_cannot_compare_is_left_to_pairs(spark):
    df = spark.createDataFrame([(i, i % 3, i % 7, i / 2, f"name{i % 11}") for i in range(60)], "id long, k long, g long, x double, s string").withColumn("d", F.col("x").cast("decimal(9,2)"))
    for rules, specs in (([("k",), ("g",)], [FuzzyString("s")]), ([("k",)], [ExactMatch("x"), FuzzyString("s")]), ([("k",)], [NumericDiff("d")])):
        assert not grids.able(df, rules, specs)
        want = patterns(with_levels(blocking.candidates(df, "id", rules, [s.column for s in specs]), specs), specs)
        assert sorted(map(tuple, linkage.counted_patterns(df, "id", rules, specs).collect())) == sorted(map(tuple, want.collect()))


def test_a_prefix_of_all_strings_is_not_compared():
    texts = [f"Customer#{i:09d}" for i in range(300)]
    grid = strings.SimilarityLevels(texts, texts, (0.93, 0.97))
    assert grid.common == 15 and len(grid.rows) == 3 and grid.kind().itemsize == 1
    want = [[1 + (s >= 0.93) + (s >= 0.97) for s in strings.jaro_winkler([t] * 300, texts)] for t in texts[:20]]
    assert grid.levels[grid.codes(0, 20, 0)].tolist() == want


def test_scores_are_rounded_a_pattern_at_a_time(spark, monkeypatch):
    config = linkage.LinkConfig("id", (ExactMatch("a"), ExactMatch("b")), (("k",),))
    f = Fit([np.array([0, 0.1, 0.9])] * 2, [np.array([0, 0.7, 0.3])] * 2, 0.1)
    levelled = spark.createDataFrame([(i, i + 1, i % 3, i % 2 + 1) for i in range(12)], "__id_l__ long, __id_r__ long, level__a int, level__b int")
    grid = np.array([(a, b) for a in (1, 2) for b in (1, 2)])  # no pattern with a missing value
    plan = linkage.score_pairs(levelled, config, f, grid, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan and "Join" not in plan
    got = sorted(map(tuple, linkage.score_pairs(levelled, config, f, grid, 3).collect()))
    exact = sorted(map(tuple, linkage.score_pairs(levelled, config, f, grid).collect()))
    assert len(got) == 8 and [r[2] for r in got] == [round(r[2], 3) for r in exact] and [r[2] for r in got] != [r[2] for r in exact]
    monkeypatch.setattr(linkage, "ARRAY_PATTERNS", 0)
    assert sorted(map(tuple, linkage.score_pairs(levelled, config, f, grid, 3).collect())) == got


def test_pairs_leave_their_tiles_with_scores(spark):
    df = rows(spark, 3, 60, TEXTS["short"]).select("id", "k", "e", "s")
    config = linkage.LinkConfig("id", (ExactMatch("e"), FuzzyString("s", (0.9, 0.97))), (("k",),))
    f = Fit([np.array([0, 0.1, 0.9]), np.array([0, 0.1, 0.2, 0.7])], [np.array([0, 0.9, 0.1]), np.array([0, 0.8, 0.1, 0.1])], 0.1)
    grid = np.array([(a, b) for a in (1, 2) for b in (0, 1, 2, 3)])  # no score where e is missing
    want = linkage.score_pairs(with_levels(blocking.candidates(df, "id", config.blocking_rules, ["e", "s"]), config.comparisons), config, f, grid, 4)
    got = linkage.scored_pairs(df, config, f, grid, digits=4)
    assert got.dtypes == want.dtypes and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "Generate" not in got._jdf.queryExecution().executedPlan().toString()
    assert linkage.scored_pairs(df, config, f, grid, keep_levels=False).columns == ["__id_l__", "__id_r__", "match_probability"]
