import datetime as dt
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lodestone.functions import strings
from lodestone.plans import checks
from lodestone.plans.config import IcebergTableConfig
from lodestone.sources import snapshots, text_validation
from lodestone.sources.load import load


def test_ancestry_has_no_bound(spark):
    """A chain of 400 snapshots, a branch beside it, and a loop."""
    rows = [(i, i - 1 if i else None) for i in range(400)] + [(1000, 50), (2000, 2001), (2001, 2000)]
    table = spark.createDataFrame(rows, "snapshot_id long, parent_id long")
    got = sorted(map(tuple, snapshots.ancestry(table, 399).collect()), key=lambda r: r[1])
    assert got == [(399 - d, d) for d in range(400)]
    assert snapshots.is_ancestor(table, 399, 0) and snapshots.is_ancestor(table, 1000, 50) and not snapshots.is_ancestor(table, 1000, 51)
    assert snapshots.ancestry(table, 2000).count() == 2 and snapshots.ancestry(table, 5555).count() == 0


class Stub(snapshots.Snapshot):
    """A captured snapshot whose live metadata are given."""

    def current_id(self):
        return 7

    def current_spec_id(self):
        return 3


def table_check(spark, **limits):
    now = dt.datetime(2024, 5, 1, 12, tzinfo=dt.UTC)
    made = spark.createDataFrame([(6, None, 1_714_471_200), (7, 6, 1_714_557_600)], "snapshot_id long, parent_id long, s long").withColumn("committed_at", F.timestamp_seconds("s"))
    files = spark.createDataFrame([(0, 0, "a", 1), (0, 3, "b", 1), (1, 3, "c", 1)], "content int, spec_id int, file_path string, file_size_in_bytes long")
    frame = spark.createDataFrame([(1, "x")], "id long, name string")
    stub = Stub("t", 7, frame, files, files.limit(2), made, made, spark, captured_schema_id=2)
    ctx = SimpleNamespace(iceberg=IcebergTableConfig(identifier="db.t", **limits), snapshot=stub, now=now, df=frame, dtypes=dict(frame.dtypes))
    return checks.IcebergTable().judge(ctx, {})


def test_table_check_reads_schema_spec_and_age(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    for name in ("UTC", "Asia/Tokyo"):  # ages do not depend on the session's clock
        spark.conf.set("spark.sql.session.timeZone", name)
        try:
            severity, out = table_check(spark, expected_schema_id=2, expected_current_spec_id=3, max_snapshot_age_hours=2.1, expected_ancestor_snapshot_id=6)
        finally:
            spark.conf.set("spark.sql.session.timeZone", zone)
        assert severity == "ok" and out["violations"] == 0, out
        assert (out["captured_schema_id"], out["current_spec_id"], out["snapshot_age_hours"], out["active_spec_ids"]) == (2, 3, 2.0, [0, 3])
    assert table_check(spark, expected_schema_id=1, expected_current_spec_id=0, max_snapshot_age_hours=1.9, max_data_files=1, expected_ancestor_snapshot_id=5)[1]["violations"] == 5


def test_json_lines_with_many_facts(spark, tmp_path):
    (tmp_path / "wide.jsonl").write_text("\n".join("{" + ", ".join(f'"k{i}": {n + i}' for i in range(300)) + "}" for n in range(20)))
    schema = text_validation.jsonl_schema(spark, f"file://{tmp_path}/wide.jsonl")
    assert schema.names == [f"k{i}" for i in range(300)]
    (tmp_path / "bad.jsonl").write_text('{"a": 1}\n{"b": 1}\n')
    with pytest.raises(ValueError, match="different keys"):
        text_validation.jsonl_schema(spark, f"file://{tmp_path}/bad.jsonl")
    (tmp_path / "worse.jsonl").write_text('{"a": 1}\n{"a": NaN}\n[1]\n')
    with pytest.raises(ValueError, match="invalid JSON lines"):
        text_validation.jsonl_schema(spark, f"file://{tmp_path}/worse.jsonl")


def test_long_strings_compare_like_short_ones():
    import random
    import time

    rng = random.Random(3)
    a = ["".join(rng.choice("abcdé") for _ in range(rng.randint(0, 30))) for _ in range(400)]
    b = [x[::-1] if i % 3 else x[2:] + "q" for i, x in enumerate(a)]
    assert strings.jaro_winkler(a, b).tolist() == [strings.long_jaro_winkler(x, y) for x, y in zip(a, b, strict=True)]
    long = ["".join(rng.choice("abcdefghijkl mnop") for _ in range(10_000)) for _ in range(2)]
    began = time.perf_counter()
    assert 0.6 < strings.long_jaro_winkler(*long) < 0.9
    assert time.perf_counter() - began < 1


def test_csv_quotes_and_line_ends(spark, tmp_path):
    plain, long = tmp_path / "plain.csv", tmp_path / "long.csv"
    plain.write_text('id,said\n1,"a ""quoted"" word, and more"\n2,\n3,back\\slash\n')
    long.write_text('id,said\n1,"first\nsecond"\n2,"x ""y"""\n')
    assert [tuple(r) for r in load(str(plain), spark).frame.orderBy("id").collect()] == [(1, 'a "quoted" word, and more'), (2, None), (3, "back\\slash")]
    assert [tuple(r) for r in load(str(long), spark).frame.orderBy("id").collect()] == [(1, "first\nsecond"), (2, 'x "y"')]
