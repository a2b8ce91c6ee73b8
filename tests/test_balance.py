import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import blocking


def rows(spark, rng, n, hot):
    data = [(f"i{i:05d}" if i % 9 else f"j{i}", "hot" if rng.random() < hot else rng.choice(["a", "b", None, *map(str, range(60))]), rng.choice([0, 1, 2, None]), i % 5) for i in range(n)]
    return spark.createDataFrame(data, "id string, k string, g int, v int").repartition(3), data


def expected(data, rules, right=None):
    out = []
    at = {"k": 1, "g": 2}
    for x in data:
        for y in right if right is not None else data:
            if right is None and not x[0] < y[0]:
                continue
            if any(all(x[at[c]] is not None and x[at[c]] == y[at[c]] for c in r) for r in rules) or not rules:
                out.append((x[0], y[0], x[3], y[3]))
    return sorted(out)


@pytest.mark.parametrize("rules", [[("k",)], [("k", "g")], [("k",), ("g",)], [("g",), ("k", "g")], []])
@pytest.mark.parametrize("unit", [None, 40, 1500])
def test_tiles_lose_and_repeat_no_pair(spark, rules, unit):
    df, data = rows(spark, random.Random(1), 180, 0.5)
    got = blocking.candidates(df, "id", rules, ["v"], unit_pairs=unit, max_pairs=10**6)
    assert got.columns == ["__id_l__", "__id_r__", "v_l", "v_r"]
    assert sorted(map(tuple, got.collect())) == expected(data, rules)


@pytest.mark.parametrize("rules", [[("k",)], [("k",), ("g",)], []])
@pytest.mark.parametrize("unit", [None, 40])
def test_two_tables(spark, rules, unit):
    a, left = rows(spark, random.Random(2), 90, 0.5)
    b, right = rows(spark, random.Random(3), 40, 0.3)
    got = blocking.candidates(a, "id", rules, ["v"], b, unit_pairs=unit, max_pairs=10**6)
    assert sorted(map(tuple, got.collect())) == expected(left, rules, right)


def test_a_hot_block_is_spread_evenly(spark):
    df = spark.range(6000).select("id", F.when(F.col("id") % 2 == 0, -1).otherwise(F.col("id") % 400).alias("k"), F.lit("t").alias("__x"))
    work = blocking.pair_work(df, [("k",)])
    assert work[0].largest == 3000 * 2999 // 2 and work[0].pairs > work[0].largest
    pairs = blocking.candidates(df, "id", [("k",)], work=work)
    per = sorted(r["count"] for r in pairs.groupBy(F.spark_partition_id().alias("p")).count().collect())
    assert sum(per) == work[0].pairs and per[-1] <= 3 * per[len(per) // 2] and len(per) >= 4
    assert "BroadcastNestedLoopJoin" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_all_pairs_need_a_bound(spark):
    df = spark.range(50)
    with pytest.raises(ValueError, match="max_pairs"):
        blocking.candidates(df, "id", [])
    with pytest.raises(MemoryError):
        blocking.candidates(df, "id", [], max_pairs=1224)
    assert blocking.candidates(df, "id", [], max_pairs=1225).count() == 1225
    assert blocking.candidates(df.limit(0), "id", [], max_pairs=0).count() == 0
    nulls = df.select(F.when(F.col("id") > 3, F.col("id")).alias("id"), F.lit(1).alias("k"))
    assert blocking.candidates(nulls, "id", [("k",)], unit_pairs=10).count() == 46 * 45 // 2


def test_pairs_open_plain_arrays(spark):
    """A pair makes no object: each column of a tile's right rows is an array of its own, missing values in place."""
    df, data = rows(spark, random.Random(4), 150, 0.4)
    pairs = blocking.candidates(df, "id", [("k",)], ["v", "g"], unit_pairs=40)
    assert "inline(" not in pairs._jdf.queryExecution().executedPlan().toString()
    got = sorted((r["__id_l__"], r["__id_r__"], r.v_l, r.v_r) for r in pairs.collect())
    assert got == expected(data, [("k",)])
