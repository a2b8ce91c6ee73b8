import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.strings import StringNormalization, jaro_winkler, normalize
from lodestone.operators import merge
from lodestone.operators.components import connected_components
from lodestone.operators.fellegi_sunter import fit
from lodestone.operators.levels import ExactMatch, FuzzyString, NumericDiff, with_levels
from lodestone.operators.linkage import LinkConfig, evaluate, label_clusters, link


def planted(spark, n=1000, copies=50):
    rng = random.Random(42)
    rows = [(i, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(12)), f"P{rng.randrange(50)}", rng.randrange(20000)) for i in range(n)]
    for k in range(copies):
        i, name, post, dob = rows[k]
        at = rng.randrange(12)
        rows.append((n + k, name[:at] + rng.choice("abc") + name[at + 1 :], post, dob))
    return spark.createDataFrame(rows, "id long, name string, postcode string, dob long")


SPECS = (FuzzyString("name", (0.88, 0.95)), NumericDiff("dob", (0.0, 365.0)), ExactMatch("postcode"))


def test_planted_duplicates_are_found(spark):
    df = planted(spark)
    result = link(df, LinkConfig("id", SPECS[:2], (("postcode",),)))
    found = {(r["__id_l__"], r["__id_r__"]) for r in result.match_pairs(0.9).collect()}
    true = {(k, 1000 + k) for k in range(50)}
    assert len(found & true) >= 40 and len(found & true) >= 0.8 * len(found)
    summary = result.summary()
    assert summary["fit_status"] in ("ok", "warning") and summary["clusters"] <= 1050
    clusters = {r.id: r.cluster_id for r in result.clusters.collect()}
    assert len(clusters) == 1050 and sorted(set(clusters.values())) == list(range(len(set(clusters.values()))))
    labels = spark.createDataFrame([(*p, True) for p in true] + [(0, 999, False)], "__id_l__ long, __id_r__ long, is_match boolean")
    m = evaluate(result.pairs, labels, 0.9).first()
    assert m.tp == len(found & true) and m.fn == 50 - m.tp and m.tn + m.fp == 1


def test_levels(spark):
    pairs = spark.createDataFrame([(20.0, 21.0), (30.0, 40.0), (None, 30.0), (float("nan"), 1.0)], "age_l double, age_r double")
    assert [r.level__age for r in with_levels(pairs, [NumericDiff("age", (0.5, 5.0))]).collect()] == [2, 1, 0, 0]
    wide = spark.createDataFrame([(2**53, 2**53 + 1), (-(2**63), 2**63 - 1)], "x_l long, x_r long")
    assert [r.level__x for r in with_levels(wide, [NumericDiff("x", (0.0,))]).collect()] == [1, 1]
    text = spark.createDataFrame([("", ""), ("martha", "marhta"), (None, "a"), ("abc", "xyz")], "s_l string, s_r string")
    assert [r.level__s for r in with_levels(text, [FuzzyString("s", (0.9, 0.97))]).collect()] == [3, 2, 0, 1]


def test_jaro_winkler():
    a = ["martha", "dixon", "dwayne", "", "", "a", "ñandú", "abcd"]
    b = ["marhta", "dicksonx", "duane", "", "x", "a", "ñandu", "dcba"]
    assert np.allclose(jaro_winkler(a, b)[:6], [0.961111, 0.813333, 0.84, 1, 0, 1], atol=1e-5)


def test_em_smooths_and_diagnoses():
    levels = np.array([(2, 3), (1, 1), (1, 2), (2, 1), (0, 3)])
    f = fit(levels, np.array([40, 9000, 300, 600, 5]), [2, 3])
    assert f.status in ("ok", "warning") and all(abs(t[1:].sum() - 1) < 1e-9 for t in f.m + f.u) and 0 < f.match_share < 0.5
    assert fit(np.array([(1,), (1,)]), np.array([5, 5]), [2]).status == "rejected"


def test_config_is_strict():
    for bad in (dict(comparisons=()), dict(comparisons=(ExactMatch("a"), ExactMatch("a"))), dict(blocking_rules=(("b",), ("b", "c"))), dict(blocking_rules=(("id",),)), dict(match_threshold_probability=0.4)):
        with pytest.raises(ValueError):
            LinkConfig("id", **{"comparisons": (ExactMatch("a"),), **bad})


def test_guards_and_inputs(spark):
    df = planted(spark, 60, 0)
    with pytest.raises(MemoryError):
        link(df, LinkConfig("id", SPECS[:1], (), max_pairs_warning=10))
    with pytest.raises(ValueError):
        link(df.unionByName(df.limit(1)), LinkConfig("id", SPECS[:1], (("postcode",),)))
    with pytest.raises(TypeError):
        link(df, LinkConfig("id", (NumericDiff("name", (1.0,)),), (("postcode",),)))


def test_normalisation_order(spark):
    df = spark.createDataFrame([("  Ａ\t b\u00a0C ",), ("n/a",), (" N/A ",), (None,)], "s string")
    got = [r[0] for r in df.select(normalize(F.col("s"), StringNormalization(null_tokens=("n/a", "")))).collect()]
    assert got == ["a b c", None, None, None]


def test_components_and_labels(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    assert got == {x: find(x) for x in root if x in got} and set(got) >= {x for e in edges for x in e if None not in e and e[0] != e[1]}
    members = spark.createDataFrame([(10, 1), (2, 2), (3, 1), (1, 3)], "id long, root long")
    assert {r.id: r.cluster_id for r in label_clusters(members).collect()} == {1: 0, 10: 1, 3: 1, 2: 2}


def test_consolidation(spark):
    rows = [(10, 1, "a@x", None, 3), (20, 2, "b@x", "1", 2), (30, 2, " ", "2", 9), (40, 5, "c@x", "3", 1)]
    df = spark.createDataFrame(rows, "id long, priority long, email string, phone string, seen long")
    clusters = spark.createDataFrame([(10, 7), (20, 7), (30, 7), (40, 9)], "id long, cluster_id long")
    rules = {"email": merge.MergeRule("latest", "seen"), "phone": merge.MergeRule("first_non_null")}
    out = merge.consolidate(df, "id", clusters, merge.ConsolidationConfig((merge.SurvivorSortKey("priority"),), (), rules))
    assert [tuple(r) for r in out.frame.collect()] == [(10, 1, "a@x", "1", 3), (40, 5, "c@x", "3", 1)]
    assert out.frame.schema.simpleString() == df.schema.simpleString()
    assert {r.source_id: r.survivor_id for r in out.lineage.collect()} == {10: 10, 20: 10, 30: 10, 40: 40}
    audit = {r["column"]: r for r in out.audit.collect()}
    assert (audit["phone"].action, audit["phone"].donor_id, audit["phone"].conflicting_source_ids) == ("filled", 20, [20, 30])
    assert (audit["email"].action, audit["email"].distinct_value_count) == ("retained", 2)
    assert out.summary()["removed_records"] == 2
    with pytest.raises(ValueError):
        merge.consolidate(df, "id", clusters.limit(2), merge.ConsolidationConfig())
    with pytest.raises(ValueError):
        merge.consolidate(df.withColumn("seen", F.lit(None).cast("long")), "id", clusters, merge.ConsolidationConfig(merge_rules=rules))


def test_deduplicate_and_most_frequent(spark):
    df = planted(spark, 400, 30)
    out = merge.deduplicate(df, LinkConfig("id", SPECS[:2], (("postcode",),), allow_warning_fit=True), merge.default_merge(df, "id"))
    assert out.consolidation.frame.count() == out.linkage.summary()["clusters"] < 430
    rows = [(1, "x"), (2, "y"), (3, "y"), (4, "z"), (5, "z"), (6, None)]
    f = spark.createDataFrame(rows, "id long, v string")
    c = f.select("id", F.lit(0).cast("long").alias("cluster_id"))
    got = merge.consolidate(f, "id", c, merge.ConsolidationConfig(merge_rules={"v": merge.MergeRule("most_frequent")}))
    assert [tuple(r) for r in got.frame.collect()] == [(1, "y")]
