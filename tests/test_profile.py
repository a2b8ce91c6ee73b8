import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import columns as C
from lodestone.operators import contracts, profile

NAN = float("nan")


def one(df):
    return tuple(df.first())


def test_missing_values_count_nowhere_else(spark):
    """Depth soundings: two casts without a reading, one with a broken one."""
    casts = [("north", 31.5, 4), ("north", None, 9), ("south", NAN, None), (None, 250.0, 9), ("east", -2.0, 9), ("east", 31.5, 4)]
    df = spark.createDataFrame(casts, "station string, depth double, crew long")
    assert {r["column"]: (r.null_count, r.row_count) for r in profile.null_counts(df).collect()} == {"station": (1, 6), "depth": (2, 6), "crew": (1, 6)}
    assert {r["column"]: r.distinct_count for r in profile.distinct_counts(df).collect()} == {"station": 3, "depth": 3, "crew": 2}
    assert {r["column"]: r.violation_count for r in profile.counts_outside(df, {"depth": (0, 200), "crew": (5, 9)}).collect()} == {"depth": 2, "crew": 2}


def test_wide_distinct_is_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(0.0, b"a", dt.date(2020, 1, 1)), (-0.0, b"b", None), (NAN, b"a", None)], "x double, y binary, z date")
    want = sorted(map(tuple, profile.distinct_counts(df).collect()))
    for step in (1, 2):
        monkeypatch.setattr(profile, "MULTI_DISTINCT", step)
        assert sorted(map(tuple, profile.distinct_counts(df).collect())) == want == [("x", 1), ("y", 2), ("z", 1)]


def test_instants_of_a_repeated_hour_differ(spark, monkeypatch):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        df = spark.range(2).select(F.timestamp_seconds(F.lit(1_604_208_600) + F.col("id") * 3600).alias("t"), *[F.lit(i).alias(f"c{i}") for i in range(9)])
        for step in (8, 20):
            monkeypatch.setattr(profile, "MULTI_DISTINCT", step)
            assert profile.distinct_counts(df).where("column = 't'").first().distinct_count == 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_bounds_that_are_no_numbers_find_no_outliers(spark):
    inf = float("inf")
    df = spark.createDataFrame([(inf, 1.0), (inf, 2.0), (-inf, 2.0), (-inf, 3.0), (1.0, 900.0)], "x double, y double")
    assert [(r["column"], r.outlier_count) for r in profile.outliers(df, ["x", "y"]).collect()] == [("y", 1)]


def test_duplicates_hold_all_members_and_one_missing_key(spark):
    df = spark.createDataFrame([(None, 1), (NAN, 1), (2.0, 1), (2.0, 2)], "value double, other long")
    assert one(profile.duplicate_count(df)) == (2,)
    assert one(profile.duplicate_count(df, ["value"])) == (4,)
    assert profile.duplicate_rows(df, ["value"]).count() == 4
    assert one(profile.duplicate_count(df.limit(0))) == (0,)


def test_quantiles_interpolate(spark):
    df = spark.createDataFrame([(float(i), None) for i in (1, 2, 3, 4)] + [(NAN, None)], "x double, y double")
    got = {(r["column"], r.quantile): r.value for r in profile.quantiles(df, ["x", "y"], [0.25, 0.75]).collect()}
    assert (got[("x", 0.25)], got[("x", 0.75)]) == (1.75, 3.25) and got[("y", 0.25)] != got[("y", 0.25)]


def test_offsets_and_bad_instants(spark):
    """The latest of three departures is told by their offsets, not by their clocks."""
    times = ["2021-03-01T22:00:00+09:30", "2021-03-01T10:15:00-0345", " 2021-03-01T13:59:59 ", "at noon", None, "later"]
    micros, bad = one(profile.max_instant(spark.createDataFrame([(t,) for t in times], "departs string"), "departs"))
    assert micros == int(dt.datetime(2021, 3, 1, 14, 0, tzinfo=dt.UTC).timestamp()) * 10**6 and bad == 2


def test_names_with_dots_and_quotes(spark):
    df = spark.createDataFrame([(1, 2), (1, None)], ["a.b", "c`d"])
    assert {r["column"]: r.null_count for r in profile.null_counts(df).collect()} == {"a.b": 0, "c`d": 1}
    for bad in (["a", "A"], [" a"], [""], ["x\0"]):
        with pytest.raises(ValueError):
            C.validate_names(bad)


def test_nested(spark):
    df = spark.createDataFrame([(1, {"a": None}, [1])], "id long, m map<string,int>, v array<int>")
    with pytest.raises(TypeError):
        C.normalize_nested(df)
    flat, names = C.normalize_nested(df, True)
    assert names == ["m", "v"] and tuple(flat.first()) == (1, '{"a":null}', "[1]")


def test_operators_agree_with_python(spark):
    import operator

    pairs = [(a, b) for a in (-3, 0, 7) for b in (-3, 1, 7, 8)]
    df = spark.createDataFrame(pairs, "asked long, sold long")
    for name in ("eq", "ne", "gt", "ge", "lt", "le"):
        broken = sum(not getattr(operator, name)(a, b) for a, b in pairs)
        assert one(contracts.comparison_count(df, left="asked", operator=name, right_column="sold")) == (broken,), name


def test_missing_values_in_rules(spark):
    """Stock and orders of a shop: a missing side passes or fails a rule, as it says."""
    rows = [(5.0, 5.0), (4.0, 9.0), (None, 2.0), (NAN, 1.0), (8.0, None), (6.0, 2.0), (None, NAN)]
    df = spark.createDataFrame(rows, "stock double, ordered double")
    rule = {"left": "stock", "operator": "ge", "right_column": "ordered"}
    assert one(contracts.comparison_count(df, **rule)) == (1,)
    assert one(contracts.comparison_count(df, **rule, nulls_pass=False)) == (5,)
    shelf = spark.createDataFrame([(2.0,), (9.0,), (NAN,), (None,)], "code double")
    assert one(contracts.foreign_key_count(df, ["ordered"], shelf, ["code"])) == (2,)
    assert one(contracts.foreign_key_count(df, ["ordered"], shelf, ["code"], nulls_pass=False)) == (4,)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.one_of(st.none(), st.just(NAN), st.floats(-9, 9)), st.one_of(st.none(), st.sampled_from("ab"))), min_size=1, max_size=20), st.integers(1, 4))
def test_partitions_do_not_matter(spark, rows, n):
    df = spark.createDataFrame(rows, "x double, s string")
    for f in (profile.null_counts, profile.distinct_counts, profile.duplicate_count):
        assert sorted(map(str, f(df).collect())) == sorted(map(str, f(df.repartition(n)).collect()))
    assert one(profile.null_counts(df).where(F.col("column") == "x").select("null_count")) == (sum(r[0] is None or r[0] != r[0] for r in rows),)
