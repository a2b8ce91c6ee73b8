import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import contracts

NAN = float("nan")


@pytest.mark.parametrize("nulls_pass", [True, False])
def test_counts_of_keys_are_weighed(spark, nulls_pass):
    rng = random.Random(3)
    rows = [(rng.choice([7, 7, 7, 7, 1, 2, 3, None]), rng.choice([0.5, 0.5, NAN, None, 2.0]), i) for i in range(500)]
    ref = [(7, 0.5), (7, 0.5), (1, NAN), (None, 2.0), (3, 2.0)]
    df = spark.createDataFrame(rows, "`a.b` int, x double, n int").repartition(5)
    r = spark.createDataFrame(ref, "`c` int, `k0` double")
    there = {(7, 0.5), (3, 2.0)}
    whole = lambda a, x: a is not None and x is not None and x == x
    want = sum((a, x) not in there if whole(a, x) else not nulls_pass for a, x, _ in rows)
    assert contracts.foreign_key_count(df, ["a.b", "x"], r, ["c", "k0"], nulls_pass).first()[0] == want > 0
    assert contracts.foreign_key_violations(df, ["a.b", "x"], r, ["c", "k0"], nulls_pass).count() == want
    assert contracts.foreign_key_count(df.limit(0), ["a.b"], r, ["c"], nulls_pass).first()[0] == 0


def test_a_hot_key_is_one_row_of_the_join(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 10 > 0, 5).otherwise(F.col("id")).alias("k"))
    # (a small reference is broadcast, and the join is pushed below the count)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        plan = contracts.foreign_key_count(df, ["k"], spark.range(10).toDF("k"), ["k"])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.index("Join") < plan.index("partial_count(1)")  # the count lies below the join
