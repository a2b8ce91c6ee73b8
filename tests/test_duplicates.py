import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lodestone.operators import profile

NAN = float("nan")


def table(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice([None, NAN, 0.0, -0.0, 1.5]), rng.choice([None, "", "a", "b", "a" * 50]), rng.choice([None, 1, 2]), rng.choice([None, [1, None], [1], []]), i) for i in range(n)]
    return spark.createDataFrame(rows, "`x.y` double, s string, k int, l array<int>, id int").repartition(3), rows


def keys(r, at):
    out = []
    for i in at:
        v = r[i]
        out.append(None if v is None or v != v else 0.0 if v == 0 and i == 0 else tuple(v) if isinstance(v, list) else v)
    return tuple(out)


@pytest.mark.parametrize("limit", [1_000_000, 0])
@pytest.mark.parametrize("names", [["x.y", "s", "k"], ["s"], ["k", "s"], ["l", "s", "x.y", "k"], ["k"], ["id", "s", "k"]])
@pytest.mark.parametrize("collide", [False, True])
def test_against_counting(spark, monkeypatch, names, limit, collide):
    df, rows = table(spark, 40 if collide else 120)
    if collide:  # every digest is one of two
        monkeypatch.setattr(profile, "digest", lambda ks: [F.coalesce(F.length(ks[0].cast("string")), F.lit(0)) % 2, F.lit(0)])
    monkeypatch.setattr(profile, "BROADCAST_DIGESTS", limit)
    at = [df.columns.index(c) for c in names]
    n = Counter(keys(r, at) for r in rows)
    assert profile.duplicate_count(df, names).first()[0] == sum(v for v in n.values() if v > 1)
    found = profile.duplicate_rows(df, names)
    assert found.columns == df.columns
    assert sorted(r.id for r in found.collect()) == sorted(r[4] for r in rows if n[keys(r, at)] > 1)


def test_only_digests_travel_without_duplicates(spark):
    df = spark.range(1000).select("id", F.repeat(F.lit("x"), 1000).alias("wide"))
    assert profile._suspects(df, df.columns) is None
    assert profile.duplicate_count(df).first()[0] == 0 and profile.duplicate_rows(df).count() == 0
    assert profile.duplicate_count(df.limit(0)).first()[0] == 0
    one_key = df.withColumn("id", F.lit(1))
    assert profile.duplicate_count(one_key).first()[0] == 1000 and len(profile.duplicate_rows(one_key, n=7).collect()) == 7
