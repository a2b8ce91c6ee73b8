import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import profile, quantile

NAN = float("nan")


def frame(spark, columns):
    n = max(map(len, columns.values()))
    rows = list(zip(*[c + [None] * (n - len(c)) for c in columns.values()], strict=True))
    return spark.createDataFrame(rows, ", ".join(f"`{c}` double" for c in columns)).repartition(3)


@pytest.mark.parametrize("bound", [1, 7, 100_000])
def test_all_columns_together(spark, bound):
    rng = random.Random(1)
    columns = {
        "spread.x": [rng.gauss(0, 1e6) for _ in range(900)],
        "ties": [rng.choice([5.0, 7.0, 7.0, 7.0, rng.random() * 9]) for _ in range(1000)],
        "two": [5.0] * 500 + [7.0] * 500,
        "one": [3.5],
        "same": [-0.0] * 700,
        "gaps": [NAN, None, 1.0, 2.0, NAN, 1e300, -1e300] * 60,
        "skew": [10.0 ** rng.randint(-200, 200) for _ in range(800)],
        "inf": [float("inf")] * 300 + [1.0] * 300 + [-float("inf")] * 2,
        "none": [NAN, None],
    }
    qs = [0.0, 0.001, 0.25, 0.3333, 0.5, 0.75, 0.9, 1.0]
    got = quantile.exact_quantiles(frame(spark, columns), list(columns), qs, bound=bound, accuracy=20)
    for c, xs in columns.items():
        xs = sorted(x for x in xs if x is not None and x == x)
        if not xs:
            assert got[c] == [None] * len(qs)
            continue
        for q, v in zip(qs, got[c], strict=True):
            p = (len(xs) - 1) * q
            a, b = int(np.floor(p)), int(np.ceil(p))
            want = xs[a] if xs[a] == xs[b] else (b - p) * xs[a] + (p - a) * xs[b]
            assert v == want, (c, q)


def test_as_the_aggregate_over_many_values(spark):
    df = spark.range(300_000).select(F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double").alias("x"), F.when(F.col("id") % 3 == 0, 4.0).otherwise(F.rand(5)).alias("y"), (F.col("id") % 10).alias("z"))
    df.persist()
    qs = [0.05, 0.25, 0.5, 0.75, 0.999]
    got = quantile.exact_quantiles(df, ["x", "y", "z"], qs, bound=1000, accuracy=1000)
    want = df.agg(*[F.percentile(F.col(c).cast("double"), F.array(*map(F.lit, qs))) for c in ("x", "y", "z")]).first()
    assert [got[c] for c in ("x", "y", "z")] == [list(w) for w in want]
    df.unpersist()


def test_misleading_sketch_is_put_right(spark, monkeypatch):
    df = spark.range(5000).select(F.col("id").cast("double").alias("x"))
    monkeypatch.setattr(quantile, "_sketch", lambda x, fractions, accuracy: F.array(*[F.percentile_approx(x, F.lit(0.9), F.lit(1000)) for _ in fractions]))
    assert quantile.exact_quantiles(df, ["x"], [0.25, 0.95], bound=2000) == {"x": [0.25 * 4999, 0.95 * 4999]}


def test_tables_of_quantiles(spark):
    df = frame(spark, {"a": [1.0, 2.0, 4.0], "b": []})
    assert [tuple(r) for r in profile.quantiles(df, ["a"], [0.5]).collect()] == [("a", 0.5, 2.0)]
    assert [r.value != r.value for r in profile.quantiles(df, ["b"], [0.5]).collect()] == [True]
    assert [tuple(r) for r in profile.fences(df, ["a", "b"], 1.0).collect()] == [("a", 0.0, 4.5), ("b", None, None)]
    assert quantile.exact_quantiles(df, [], [0.5]) == {} and quantile.exact_quantiles(df.limit(0), ["a"], [0.5]) == {"a": [None]}
