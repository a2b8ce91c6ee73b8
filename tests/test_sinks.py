import json
import os

import pytest
from pyspark.sql import functions as F

from lodestone.operators import merge
from lodestone.sources import sinks


@pytest.fixture
def merged(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c"), (4, "d")], "id long, name string")
    clusters = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 1)], "id long, cluster_id long")
    return merge.consolidate(df, "id", clusters, merge.default_merge(df, "id"))


def tree(path):
    return {os.path.relpath(os.path.join(d, f), path): open(os.path.join(d, f), "rb").read() for d, _, files in os.walk(path) for f in files if not f.startswith(".")}


def left_over(folder):
    return [n for n in os.listdir(folder) if "staging-" in n or "before-" in n]


def test_a_second_publication_leaves_the_first_alone(merged, tmp_path):
    a, b, audit = (str(tmp_path / n) for n in ("a", "b", "audit"))
    first = sinks.publish(merged, a, audit)
    before = tree(tmp_path)
    assert json.load(open(f"{audit}/manifest.json")) == first and first["audit_sha256"].keys() == {"audit", "lineage"}
    with pytest.raises(FileExistsError):
        sinks.publish(merged, b, audit)
    with pytest.raises(FileExistsError):
        sinks.publish(merged, a, str(tmp_path / "other"))
    with pytest.raises(ValueError, match="places"):
        sinks.publish(merged, str(tmp_path / "x"), str(tmp_path / "x"))
    assert tree(tmp_path) == before and not left_over(tmp_path)
    sinks.publish(merged, b, audit, "jsonl", replace=True)
    assert json.load(open(f"{audit}/manifest.json"))["data"] == b and not left_over(tmp_path)


@pytest.mark.parametrize("step", range(6))
@pytest.mark.parametrize("there", [False, True])
def test_a_failure_at_any_step_puts_all_back(merged, tmp_path, monkeypatch, step, there):
    data, audit = str(tmp_path / "data"), str(tmp_path / "audit")
    if there:
        sinks.publish(merged, data, audit)
    before, calls = tree(tmp_path), [0]

    def count(f):
        def run(*args, **kw):
            calls[0] += 1
            if calls[0] == step + 1 and not failed:
                failed.append(1)
                raise OSError("lost")
            return f(*args, **kw)

        return run

    failed = []
    monkeypatch.setattr(sinks, "write_frame", count(sinks.write_frame))
    monkeypatch.setattr(sinks, "_put", count(sinks._put))
    monkeypatch.setattr(sinks._Swap, "_rename", count(sinks._Swap._rename))
    steps = 2 + (4 if there else 2)
    if step < steps:
        with pytest.raises(OSError, match="lost"):
            sinks.publish(merged, data, audit, replace=there)
        assert tree(tmp_path) == before
    else:
        sinks.publish(merged, data, audit, replace=there)
    assert not left_over(tmp_path)


def test_tree_of_digests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "PART_ROWS", 100)
    path = str(tmp_path / "audit")
    rows = spark.range(1000).select("id", F.when(F.col("id") % 2 == 0, "x").alias("note")).repartition(3)
    made = sinks.write_audit_tree(spark, path, {"config": {"t": 0.5}}, {"pairs": rows, "clusters": rows.limit(0)})
    assert sinks.verify_audit_tree(spark, path) == [] and set(made["tables"]) == {"pairs", "clusters"}
    parts = sorted(n for n in os.listdir(f"{path}/pairs") if n.startswith("part-"))
    assert len(parts) >= 10
    assert spark.read.json(f"{path}/pairs").count() == 1000
    with pytest.raises(FileExistsError):
        sinks.write_audit_tree(spark, path, {}, {"pairs": rows})
    part = f"{path}/pairs/{parts[4]}"
    raw = open(part, "rb").read()
    os.remove(f"{path}/pairs/.{parts[4]}.crc")
    open(part, "wb").write(raw.replace(b"x", b"y", 1))
    assert sinks.verify_audit_tree(spark, path) == ["pairs"]
    open(part, "wb").write(raw)
    assert sinks.verify_audit_tree(spark, path) == []
    os.remove(part)
    assert sinks.verify_audit_tree(spark, path) == ["pairs"]
    open(part, "wb").write(raw)
    text = open(f"{path}/manifest.json").read().replace("0.5", "0.6")
    os.remove(f"{path}/.manifest.json.crc")
    open(f"{path}/manifest.json", "w").write(text)
    assert sinks.verify_audit_tree(spark, path) == ["manifest"]
