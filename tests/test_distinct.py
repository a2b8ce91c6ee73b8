import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import profile
from lodestone.plans.checker import DataQualityChecker
from lodestone.plans.config import CheckConfig, Config

NAN = float("nan")


def table(spark, n=300):
    rng = random.Random(7)
    rows = [(rng.choice([None, NAN, 0.0, -0.0, rng.random()]), rng.choice([None, "", "a", str(rng.random())]), rng.choice([None, 1, 2]), rng.choice([None, [1], [2, None]]), None, i) for i in range(n)]
    return spark.createDataFrame(rows, "`x.y` double, s string, k int, l array<int>, none string, id int").repartition(3), rows


def expected(rows):
    return [len({tuple(v) if isinstance(v, list) else v for v in col if v is not None and v == v}) for col in zip(*rows, strict=True)]


@pytest.mark.parametrize("collide", [False, True])
def test_against_sets(spark, monkeypatch, collide):
    df, rows = table(spark)
    if collide:  # all values of a column share one digest
        monkeypatch.setattr(profile, "value_digest", lambda v: [F.when(v.isNotNull(), F.lit(1).cast("long")), F.lit(1).cast("long")])
    got = profile.distinct_counts(df)
    assert [(r["column"], r.distinct_count) for r in got.collect()] == list(zip(df.columns, expected(rows), strict=True))
    assert [r.distinct_count for r in profile.distinct_counts(df, ["s"]).collect()] == [expected(rows)[1]]
    assert {r.distinct_count for r in profile.distinct_counts(df.limit(0)).collect()} == {0}


def test_one_scan_without_expand(spark, monkeypatch):
    seen = []
    inner = type(spark.range(1)).collect
    df = spark.range(500).select(*[(F.col("id") % (i + 1)).alias(f"c{i}") for i in range(60)])
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append(self._jdf.queryExecution().executedPlan().toString()) or inner(self))
    got = profile.distinct_counts(df)
    monkeypatch.undo()
    assert [r.distinct_count for r in got.collect()] == list(range(1, 61))
    assert len(seen) == 1 and "Expand" not in seen[0] and seen[0].count("Range (") == 1


def test_approximate_check(spark):
    df = spark.range(2000).select("id", (F.col("id") % 10).alias("k"))
    report = DataQualityChecker(df, Config(checks=CheckConfig(approximate_cardinality=True))).run()
    found = next(r for r in report.results if r.name == "cardinality").payload
    assert found["distinct_provenance"]["method"] == "approximate"
    assert abs(found["per_column"][0]["distinct_count"] - 2000) < 300 and found["per_column"][1]["distinct_count"] == 10


def test_wide_expressions_are_compiled(spark, monkeypatch):
    """Sixty hashed columns make a generated method that the JVM never compiles; it must not be run fused."""
    name, seen = "spark.sql.codegen.hugeMethodLimit", []
    inner, before = type(spark.range(1)).collect, spark.conf.get("spark.sql.codegen.hugeMethodLimit")
    df = spark.range(100).select(*[((F.col("id") * (i + 1)) % (7 + i)).alias(f"c{i}") for i in range(60)])
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append(int(spark.conf.get(name))) or inner(self))
    profile.distinct_counts(df)
    assert seen == [8000] and spark.conf.get(name) == before


@pytest.mark.parametrize("held", [0, 3, 1 << 13])
def test_few_or_no_hashes_held_back(spark, monkeypatch, held):
    monkeypatch.setattr(profile, "HELD_HASHES", held)
    df, rows = table(spark)
    assert [r.distinct_count for r in profile.distinct_counts(df).collect()] == expected(rows)
