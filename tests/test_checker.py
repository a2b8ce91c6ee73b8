import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.operators import entities
from lodestone.plans import checks, narrative, render
from lodestone.plans.checker import DataQualityChecker, report_format
from lodestone.plans.config import CheckConfig, ColumnRange, ComparisonRule, Config, ForeignKeyRule, QualityContract, SchemaPolicy, build, fingerprint, from_environment
from lodestone.plans.results import CheckResult, QualityReport
from lodestone.sources import intake
from lodestone.sources.load import guard_url, load, redact
from lodestone.sources.text_validation import check_csv, check_line, merge_families
from lodestone.streaming.monitor import monitor

NOW = dt.datetime(2026, 1, 2, tzinfo=dt.UTC)


def dirty(spark):
    rows = [(i, float(i), "a") for i in range(8)] + [(8, None, "b"), (9, 10000.0, "b"), (9, 10000.0, "b")]
    return spark.createDataFrame(rows, "id long, amount double, category string").withColumn("ts", F.lit(dt.datetime(2026, 1, 1, 12)).cast("timestamp_ntz"))


def by_name(report):
    return {r.name: r for r in report.results}


def test_default_checks(spark):
    cfg = CheckConfig(sample_size=2, include_top_values=True, freshness=True, column_ranges={"amount": ColumnRange(0, 100), "category": ColumnRange(0, 1)}, expected_dtypes={"id": "integer", "gone": "string"})
    r = by_name(DataQualityChecker(dirty(spark), Config(checks=cfg), now=NOW).run())
    assert list(r) == ["dataset_contract", "missing_values", "duplicates", "data_types", "outliers", "ranges", "cardinality", "freshness"]
    assert r["dataset_contract"].severity == "error" and r["dataset_contract"].payload["missing_required_columns"] == ["gone"]
    assert r["missing_values"].severity == "warn" and r["missing_values"].payload["total_null_count"] == 1
    assert r["duplicates"].payload["total_duplicate_rows"] == 2 and len(r["duplicates"].payload["sample"]) == 2
    out = {c["column"]: c for c in r["outliers"].payload["per_column"]}
    assert out["amount"]["outlier_count"] == 2 and r["outliers"].severity == "warn"
    ranges = {c["column"]: c for c in r["ranges"].payload["per_column"]}
    assert ranges["amount"]["violation_count"] == 2 and "note" in ranges["category"] and r["ranges"].severity == "error"
    assert r["cardinality"].severity == "warn"
    fresh = r["freshness"].payload["per_column"][0]
    assert r["freshness"].severity == "ok" and fresh["age_hours"] == 12 and not fresh["is_stale"]


def test_one_pass_for_shared_facts(spark):
    df = dirty(spark)
    tracker = spark.sparkContext.statusTracker()
    group = "shared-facts-test"
    spark.sparkContext.setJobGroup(group, "")
    cfg = CheckConfig(duplicates=False, outliers=False, cardinality=False, freshness=True, column_ranges={"amount": ColumnRange(0, 1)}, rule_packs=[QualityContract("p", [ComparisonRule("r", "amount", "ge", right_value=0)])])
    DataQualityChecker(df, Config(checks=cfg), now=NOW).run()
    jobs = tracker.getJobIdsForGroup(group)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2  # one aggregate (adaptive execution may show its stage as a job)


def test_failures_are_isolated(spark):
    packs = [QualityContract("p", [ComparisonRule("bad", "category", "gt", right_value=1)])]
    r = by_name(DataQualityChecker(dirty(spark), Config(checks=CheckConfig(rule_packs=packs, severity_overrides={"missing_values": "ok"})), now=NOW).run())
    assert r["quality_contract"].status == "failed" and r["quality_contract"].error
    assert r["missing_values"].status == "completed" and r["missing_values"].severity == "ok"


def test_contracts(spark):
    ref = spark.createDataFrame([("a",)], "name string")
    pack = QualityContract(
        "p", [ComparisonRule("pos", "amount", "ge", right_value=1), ComparisonRule("lost", "nope", "eq", right_value=1)],
        [ForeignKeyRule("fk", ["category"], "cats", ["name"]), ForeignKeyRule("nofk", ["category"], "none", ["name"])], SchemaPolicy({"id": "bigint", "amount": "string"}, allow_additions=True),
    )
    r = by_name(DataQualityChecker(dirty(spark), Config(checks=CheckConfig(rule_packs=[pack])), references={"cats": ref}, now=NOW).run())["quality_contract"]
    assert {f["rule"]: f["violation_count"] for f in r.payload["findings"]} == {"schema": 1, "pos": 1, "lost": 1, "fk": 3, "nofk": 1}
    assert r.severity == "error" and r.payload["violation_count"] == 7


def test_registered_checks(spark):
    checks.register_check("rows_even", lambda ctx: ("warn", {"rows": ctx.row_count}))
    try:
        with pytest.raises(ValueError):
            checks.register_check("ranges", lambda ctx: ("ok", {}))
        r = by_name(DataQualityChecker(dirty(spark), Config(checks=CheckConfig(registered_checks=["rows_even", "unknown"])), now=NOW).run())
        assert r["rows_even"].payload == {"rows": 11} and r["unknown"].status == "failed"
    finally:
        checks.unregister_check("rows_even")


def report(spark):
    return DataQualityChecker(dirty(spark), Config(checks=CheckConfig(sample_size=3)), now=NOW).run()


def test_reports(spark, tmp_path):
    r = report(spark)
    back = QualityReport.from_json(json.dumps(json.loads(r.to_json()) | {"new": 1}))
    assert back.to_json() == r.to_json()
    r.results.append(CheckResult("x<script>|", "error", "failed", 0.0, {"a": float("nan")}, "E: <b>"))
    for text in (render.markdown(r), render.html(r)):
        assert "<script>" not in text and "<b>" not in text
    assert r.exit_code() == 2 and back.exit_code() == 0 and back.exit_code("warn") == 1
    assert 'lodestone_check_severity{check="duplicates",status="completed"} 1.0' in back.prometheus_text()
    assert report_format("a.html", "json") == "html" and report_format("a.txt", "markdown") == "markdown"
    narrative.register_provider("echo", lambda p, c: p)
    narrative.enrich(r, build({"narrative": {"provider": "echo"}}).narrative)
    assert r.llm_status == "completed" and "sample" not in r.llm_report
    assert narrative.summarise([{"count": i % 2} for i in range(60)])["omitted_count"] == 10


def test_config(tmp_path, monkeypatch):
    f = tmp_path / "c.yaml"
    f.write_text("checks:\n  min_rows: 5\n  column_ranges: {a: {min: 0, max: 1}}\n")
    monkeypatch.setenv("LODESTONE__CHECKS__SAMPLE_SIZE", "7")
    c = Config.from_file(f, checks={"min_rows": 9})
    assert (c.checks.min_rows, c.checks.sample_size, c.checks.column_ranges["a"].max) == (9, 7, 1.0)
    assert from_environment({"LODESTONE__OUTPUT_PATH": "x"}) == {"output_path": "x"}
    assert fingerprint(c) != fingerprint(Config()) and fingerprint(Config(output_path="a")) == fingerprint(Config())
    for bad in ("checks: {min_rows: 1}\nchecks: {}\n", "checks: {nope: 1}\n", "checks: {min_rows: '1'}\n", "checks: {column_ranges: {a: {min: .nan, max: 1}}}\n"):
        f.write_text(bad)
        with pytest.raises((ValueError, TypeError)):
            Config.from_file(f)


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,NA\n2,\n")
    rows = load(str(tmp_path / "a.csv"), spark).frame.collect()
    assert [tuple(r) for r in rows] == [(1, "NA"), (2, None)]
    (tmp_path / "b.jsonl").write_text('{"id": 1, "x": 1, "n": {"a": [1]}}\n{"id": 2, "x": 1.5, "n": {"a": [2]}}\n')
    with pytest.raises(TypeError):
        load(str(tmp_path / "b.jsonl"), spark)
    got = load(str(tmp_path / "b.jsonl"), spark, allow_nested=True)
    assert [r.x for r in got.frame.collect()] == [1.0, 1.5] and got.nested == ["n"]
    for bad in (b"a,a\n1,2\n", b"a,b\n1\n", b"a,b\n\n1,2\n", b'a,b\n"1,2\n', b"a\0,b\n", b"", b" a,b\n1,2\n"):
        assert check_csv(bad)[1]
    assert check_csv(b'a,b\n"x\ny",2\n') == (["a", "b"], [])
    for bad in ('{"a": 1, "a": 2}', '{"a": NaN}', '{"a": 9223372036854775808}', '{"a": "\\ud800"}', "[1]", "{"):
        with pytest.raises(ValueError):
            check_line(bad)
    assert merge_families({"integer", "number", "null"}) == "number"
    with pytest.raises(ValueError):
        merge_families({"integer", "string"})
    assert redact("s3://u:p@b/k?t=1#f") == "s3://b/k"
    with pytest.raises(ValueError):
        guard_url("https://u@h/x")


def test_intake():
    event = {"Records": [{"eventName": "ObjectCreated:Put", "s3": {"bucket": {"name": "b"}, "object": {"key": "a+b.csv", "versionId": "v"}}}, {"eventName": "ObjectCreated:Put", "s3": {"bucket": {"name": "b"}, "object": {"key": "x.txt"}}}]}
    kept, skipped = intake.items(event)
    assert kept == [intake.Item("s3a://b/a b.csv", "v")] and skipped == 1
    with pytest.raises(ExceptionGroup):
        intake.items({"Records": [{"eventName": "ObjectRemoved:x"}]})
    assert intake.gate(["ok", "warn"], "warn")["passed"] is False and intake.gate(["ok", "warn"], "error")["passed"] is True


def test_cli(spark, tmp_path, capsys):
    (tmp_path / "a.csv").write_text("id,v\n1,5\n2,7\n3,500\n")
    out = tmp_path / "r.json"
    assert cli.main(["check", str(tmp_path / "a.csv"), "--range", "v=0,10", "--output", str(out)], spark) == 1
    assert json.loads(out.read_text())["dataset"]["row_count"] == 3
    assert cli.main(["check", str(tmp_path / "none.csv")], spark) == 2
    assert cli.main(["version"]) == 0
    person = lambda i: f"name{i:03d}xyz,mail{i * 7}@x,c{i % 4}"
    rows = ["id,name,mail,city"] + [f"{i},{person(i)}" for i in range(40)] + [f"{100 + i},{person(i)}" for i in range(8)]
    (tmp_path / "p.csv").write_text("\n".join(rows) + "\n")
    audit = tmp_path / "audit.json"
    code = cli.main(["link", str(tmp_path / "p.csv"), "--id", "id", "--compare", "name:exact", "--compare", "mail:exact", "--block", "city", "--audit", str(audit), "--allow-warning-fit", "--dedupe-output", str(tmp_path / "out")], spark)
    assert code == 0 and len(json.loads(audit.read_text())["matched_pairs"]) == 8
    assert spark.read.parquet(str(tmp_path / "out")).count() == 40
    manifest = json.loads((tmp_path / "audit.json.dedupe" / "manifest.json").read_text())
    assert manifest["summary"]["removed_records"] == 8 and len(manifest["data_sha256"]) == 64
    capsys.readouterr()


def test_entities(spark):
    df = spark.createDataFrame([(1, "Ann met Bob"), (2, None), (3, "")], "id long, text string")
    rec = entities.PatternRecognizer({"NAME": r"\b[A-Z][a-z]+"})
    got = [tuple(r) for r in entities.extract(df, rec, id_col="id").collect()]
    assert got == [(1, "Ann", "NAME", 0, 3, None), (1, "Bob", "NAME", 8, 11, None)]
    assert entities.audit(df, rec, id_col="id") == {"rows": 3, "skipped_null_texts": 1, "entities": 2, "labels": {"NAME": 2}}


def test_monitor(spark, tmp_path):
    spark.range(100).select("id", (F.col("id") % 7).alias("v")).repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, v long").parquet(str(tmp_path / "in"))
    seen = {}
    q = monitor(stream, Config(checks=CheckConfig(column_ranges={"v": ColumnRange(0, 5)})), lambda r, n: seen.update({n: r}), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sum(r.dataset.row_count for r in seen.values()) == 100
    assert sum(c["violation_count"] for r in seen.values() for x in r.results if x.name == "ranges" for c in x.payload["per_column"]) == 14
