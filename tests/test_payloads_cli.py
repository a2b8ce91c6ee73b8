import hashlib
import json
import sys
from dataclasses import replace
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from lodestone import cli
from lodestone.operators import entities
from lodestone.plans import payloads
from lodestone.plans.checker import DataQualityChecker
from lodestone.plans.config import CheckConfig, ColumnRange, Config, NarrativeConfig
from lodestone.plans.results import CheckResult
from lodestone.sources import intake


def test_payloads_are_typed(spark):
    df = spark.range(60).select("id", F.when(F.col("id") > 3, F.col("id") * 1.5).alias("v"), F.timestamp_seconds("id").alias("at"))
    checks = CheckConfig(column_ranges={"v": ColumnRange(0, 50), "gone": ColumnRange(0, 1)}, freshness=True, freshness_columns=["at", "lost"], required_columns=["v"], include_top_values=True)
    report = DataQualityChecker(df, Config(checks=checks)).run()
    seen = {r.name: r.typed_payload() for r in report.results}
    assert {type(v) for v in seen.values()} == {payloads.VIEWS[n] for n in seen} and not any(v.extra for v in seen.values())
    assert seen["missing_values"].total_null_count == 4 and seen["ranges"].per_column[1].note == "column not found"
    assert isinstance(seen["freshness"].per_column[0], payloads.FreshColumn) and isinstance(seen["freshness"].per_column[1], payloads.UndatedColumn)


def test_views_refuse_and_keep():
    made = lambda name, payload, **k: CheckResult(name, "ok", payload=payload, **k)
    more = made("duplicates", {"total_duplicate_rows": 2, "later": [1]}).typed_payload()
    assert (more.total_duplicate_rows, more.subset, more.extra) == (2, None, {"later": [1]})
    assert made("own", {"a": 1}).typed_payload() == payloads.Generic(extra={"a": 1})
    assert made("linkage", {"skipped": True}).typed_payload() == payloads.LinkageSkipped(skipped=True)
    assert CheckResult("ranges", "error", "failed", error="x").typed_payload() == payloads.Failed()
    assert made("x", {"total_duplicate_rows": 1}).payload_as(payloads.Duplicates).total_duplicate_rows == 1
    infinite = {"per_column": [{"column": "a", "min_allowed": float("-inf"), "max_allowed": 3, "violation_count": 0, "sample": []}]}
    assert made("ranges", infinite).typed_payload().per_column[0].min_allowed == float("-inf")
    for payload in ({}, {"total_duplicate_rows": "2"}, {"total_duplicate_rows": True}):
        with pytest.raises((TypeError, ValueError)):
            made("duplicates", payload).typed_payload()
    with pytest.raises(ValueError, match="negative"):
        made("missing_values", {"total_null_count": -1, "worst_column_pct": 0.0, "per_column": []}).typed_payload()


def test_limits_bind_what_is_read(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(20_000).withColumn("same", F.lit("x" * 50)).coalesce(1).write.parquet(path)
    stored, expanded = intake.state(spark, path).size, intake.expanded_bytes(spark, path)
    assert 0 < stored and expanded > 0
    assert intake.check_limits(spark, path, max_expanded=expanded) == stored
    with pytest.raises(ValueError, match="expand"):
        intake.check_limits(spark, path, max_expanded=expanded - 1)
    with pytest.raises(ValueError, match="exceeds"):
        intake.check_limits(spark, path, max_bytes=stored - 1)
    with pytest.raises(RuntimeError, match="changed"), intake.bound(spark, path):
        spark.range(3).withColumn("same", F.lit("y")).write.mode("append").parquet(path)


def test_reports_are_stored_once(spark, tmp_path):
    source, folder = str(tmp_path / "a.parquet"), str(tmp_path / "reports")
    spark.range(5).write.parquet(source)
    item, config = intake.Item(source), Config(checks=CheckConfig(min_rows=9))
    first = intake.process(spark, item, config, folder)
    again = intake.process(spark, item, config, folder)
    assert (first["cached"], again["cached"]) == (False, True) and first["summary"]["dataset_contract"] == "error"
    assert {k: v for k, v in first.items() if k != "cached"} == {k: v for k, v in again.items() if k != "cached"}
    assert intake.process(spark, item, replace(config, checks=CheckConfig()), folder)["path"] != first["path"]
    spark.range(6).write.mode("append").parquet(source)  # another state is another report
    assert not intake.process(spark, item, config, folder)["cached"]
    assert intake.write_once(spark, folder, "once", "1") == intake.write_once(spark, folder, "once", "2")[:1] + (True,)
    assert (tmp_path / "reports" / "once.json").read_text() == "1" and not list((tmp_path / "reports").glob(".once*.json.*[!c]"))
    broken = DataQualityChecker(spark.range(2), Config()).run()
    broken.results.append(CheckResult("own", "error", "failed", error="lost"))
    kept = [intake.store(spark, folder, "abc", broken)["path"] for _ in range(2)]
    assert kept[0] != kept[1] and all("/failures/abc." in k for k in kept) and intake.stored(spark, folder, "abc") is None
    (tmp_path / "reports" / "other.json").write_text(json.dumps({"identity": "mine", "outcome": {}}))
    with pytest.raises(ValueError, match="another input"):
        intake.stored(spark, folder, "other")


def test_model_is_pinned(monkeypatch, tmp_path):
    (tmp_path / "m" / "__pycache__").mkdir(parents=True)
    (tmp_path / "m" / "meta.json").write_bytes(b"{}")
    (tmp_path / "m" / "__pycache__" / "x.pyc").write_bytes(b"1")
    size = lambda b: len(b).to_bytes(8, "big")
    digest = hashlib.sha256(size(b"meta.json") + b"meta.json" + size(b"{}") + b"{}").hexdigest()
    assert entities.directory_sha256(tmp_path / "m") == digest

    class Pipeline:
        meta, pipe_labels, max_length = {"version": "3.1"}, {"ner": ["PERSON", "ORG"]}, 10

        def pipe(self, texts, batch_size, n_process):
            for t in texts:
                yield SimpleNamespace(ents=[SimpleNamespace(text=t, label_=x, start_char=0, end_char=len(t), kb_id_="") for x in ("PERSON", "ORG")])

    monkeypatch.setitem(sys.modules, "spacy", SimpleNamespace(load=lambda m: Pipeline()))
    make = lambda **k: entities.ModelRecognizer(str(tmp_path / "m"), **k)
    good = make(labels=["ORG"], expected_version="3.1", expected_sha256=digest.upper())
    assert list(good.extract_many(["ab"])) == [(entities.NamedEntity("ab", "ORG", 0, 2),)]
    assert good.describe() == {"model": str(tmp_path / "m"), "version": "3.1", "sha256": digest, "labels": ["ORG"]}
    for wrong, said in (({"labels": ["CITY"]}, "CITY"), ({"expected_version": "3"}, "version"), ({"expected_sha256": "0" * 64}, "digest")):
        with pytest.raises(ValueError, match=said):
            list(make(**wrong).extract_many(["ab"]))
    with pytest.raises(ValueError, match="11 characters"):
        list(make().extract_many(["x" * 11]))
    for wrong in ({"expected_sha256": "ab"}, {"labels": [" "]}, {"batch_size": 0}):
        with pytest.raises(ValueError):
            make(**wrong)


def test_rows_are_numbered(spark):
    df = spark.range(1000, numPartitions=7).where("id % 3 <> 1")
    got = [tuple(r) for r in entities.numbered(df).orderBy("row_index").collect()]
    assert got == [(i, n) for n, i in enumerate(i for i in range(1000) if i % 3 != 1)]


def test_ner_command(spark, tmp_path, capsys):
    (tmp_path / "t.csv").write_text("id,text\n5,Ann met Bob\n6,\n7,and Cy\n")
    out = tmp_path / "o.json"
    base = ["ner", str(tmp_path / "t.csv"), "--text", "text", "--pattern", r"NAME=\b[A-Z][a-z]+", "--pattern", "AND=and"]
    assert cli.main([*base, "--id", "id", "--label", "NAME", "-o", str(out)], spark) == 0
    got = json.loads(out.read_text())
    assert got["summary"] == {"rows": 3, "processed_rows": 2, "null_rows": 1, "entities": 3, "labels": {"NAME": 3}} and len(got["source_state"]) == 64
    assert [(e["row_index"], e["record_id"], e["text"]) for e in got["entities"]] == [(0, 5, "Ann"), (0, 5, "Bob"), (2, 7, "Cy")]
    assert cli.main(base, spark) == 0 and cli.main(["ner", str(tmp_path / "t.csv"), "--text", "id", "--pattern", "A=b"], spark) == 2
    (tmp_path / "twice.csv").write_text("id,text\n1,a\n1,b\n")
    assert cli.main(["ner", str(tmp_path / "twice.csv"), "--text", "text", "--id", "id", "--pattern", "A=b"], spark) == 2
    assert cli.main([*base, "-o", "o.txt"], spark) == 2 and cli.main([*base, "--label", " "], spark) == 2
    capsys.readouterr()


def test_link_command_normalises(spark, tmp_path, capsys):
    row = lambda i: f"Name{i:03d}  xyz,mail{i * 7}@x,c{i % 4}"
    rows = ["id,name,mail,city"] + [f"{i},{row(i)}" for i in range(40)] + [f"{100 + i},{row(i).upper()}" for i in range(8)]
    (tmp_path / "p.csv").write_text("\n".join(rows) + "\n")
    base = ["link", str(tmp_path / "p.csv"), "--id", "id", "--compare", "name:exact", "--compare", "mail:exact", "--block", "city", "--allow-warning-fit"]
    out = str(tmp_path / "out.csv")
    assert cli.main([*base, "-o", str(tmp_path / "a.json"), "--deduplicated-output", out, "--completeness", "mail", "--survivor-sort", "id:desc"], spark) == 0
    kept = spark.read.option("header", True).csv(out)
    assert kept.count() == 40 and {r.name for r in kept.collect()} == {f"name{i:03d} xyz" for i in range(40)}
    assert cli.main([*base, "--raw-strings"], spark) in (0, 2)
    assert '"matched_pairs": 8' not in capsys.readouterr().out.splitlines()[-1]
    assert cli.main([*base, "--deduplicated-output", out], spark) == 2
    assert cli.main([*base, "-o", str(tmp_path / "b.json"), "--deduplicated-output", str(tmp_path / "n"), "--completeness", "mail", "--no-completeness"], spark) == 2
    capsys.readouterr()


def test_flags_of_the_narrative():
    current = NarrativeConfig("one", "large", connection_name="c", base_url="https://h/x")
    flags = lambda *a: cli.narrative_flags(cli.parser().parse_args(["check", "p", *a]), current)
    assert flags() == current
    assert flags("--llm", "one") == replace(current, connection_name=None)
    assert flags("--llm", "two") == replace(current, provider="two", model="", connection_name=None)
    assert flags("--llm", "two", "--model", "m").model == "m"
    with pytest.raises(ValueError, match="https"):
        flags("--base-url", "http://far/x")
    assert flags("--base-url", "http://far/x", "--allow-insecure-http").base_url == "http://far/x"
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["--quiet", "--verbose", "version"])
