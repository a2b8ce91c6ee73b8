"""Outputs: atomic reports, and deduplicated data that is published before its audit."""

from __future__ import annotations

import hashlib
import json
import os
import tempfile
import uuid
from collections.abc import Iterable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.merge import ConsolidationResult


def write_text_atomic(path: str | Path, text: str) -> Path:
    """Write a file so that readers see the old or the new content only."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, temp = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temp, path)
    except BaseException:
        Path(temp).unlink(missing_ok=True)
        raise
    return path


def _fs(df: DataFrame, path: str):
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p, spark._jvm.org.apache.hadoop.fs.Path


def write_frame(df: DataFrame, path: str, kind: str) -> None:
    writer = df.write
    if kind == "parquet":
        writer.parquet(path)
    elif kind == "csv":
        writer.option("header", True).csv(path)
    elif kind in ("jsonl", "ndjson"):
        writer.option("ignoreNullFields", "false").json(path)
    else:
        raise ValueError(f"unknown format {kind!r}")


def part_digests(spark: SparkSession, path: str) -> DataFrame:
    """Rows ``(name, sha256)`` of a folder's part files, computed by the tasks that read them."""
    files = spark.read.format("binaryFile").load(path + "/part-*")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"))


def folder_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 over the digests and names of a folder's parts, in order of names; only these lines pass the driver."""
    total = hashlib.sha256()
    for r in part_digests(spark, path).orderBy("name").toLocalIterator():
        total.update(f"{r.sha256}  {r.name}\n".encode())
    return total.hexdigest()


def _put(fs, path, text: str) -> None:
    out = fs.create(path, False)
    out.write(bytearray(text.encode()))
    out.close()


class _Swap:
    """Folders that are renamed into place together: what was there is kept aside until all are, and put back if one fails."""

    def __init__(self, fs, path_of, replace: bool):
        self.fs, self.path_of, self.replace, self.tag = fs, path_of, replace, uuid.uuid4().hex
        self.staged: list[str] = []
        self.aside: list[tuple[str, str]] = []
        self.placed: list[str] = []

    def stage(self, target: str) -> str:
        """A new folder beside ``target`` to write to."""
        target = target.rstrip("/")
        if not self.replace and self.fs.exists(self.path_of(target)):
            raise FileExistsError(target)
        self.staged.append(target)
        return f"{target}.staging-{self.tag}"

    def _rename(self, a: str, b: str) -> None:
        if not self.fs.rename(self.path_of(a), self.path_of(b)):
            raise OSError(f"cannot rename {a} to {b}")

    def commit(self) -> None:
        for target in self.staged:
            if self.fs.exists(self.path_of(target)):
                if not self.replace:
                    raise FileExistsError(target)
                self._rename(target, f"{target}.before-{self.tag}")
                self.aside.append((f"{target}.before-{self.tag}", target))
            self._rename(f"{target}.staging-{self.tag}", target)
            self.placed.append(target)

    def undo(self) -> None:
        """Delete what this swap wrote, nothing else, and put back what it set aside."""
        for target in self.staged:
            self.fs.delete(self.path_of(f"{target}.staging-{self.tag}"), True)
        for target in self.placed:
            self.fs.delete(self.path_of(target), True)
        for kept, target in self.aside:
            self._rename(kept, target)

    def finish(self) -> None:
        for kept, _ in self.aside:
            self.fs.delete(self.path_of(kept), True)


def publish(result: ConsolidationResult, data_path: str, audit_path: str, kind: str = "parquet", extra: dict | None = None, replace: bool = False) -> dict:
    """Data, audit and lineage are written beside their places, with digests of their parts; then the data and last the audit, whose
    manifest commits both, are renamed into place.  Existing targets are refused, or with ``replace`` set aside until both new ones are in
    place; on an error they are put back, and only what this call wrote is deleted."""
    df = result.frame
    spark = df.sparkSession
    fs, _, path_of = _fs(df, data_path)
    if path_of(data_path).equals(path_of(audit_path)):
        raise ValueError("data and audit need places of their own")
    swap = _Swap(fs, path_of, replace)
    try:
        data, audit = swap.stage(data_path), swap.stage(audit_path)
        write_frame(df, data, kind)
        result.audit.write.json(f"{audit}/audit")
        result.lineage.write.json(f"{audit}/lineage")
        manifest = {
            "schema_version": "1.0", "data": data_path, "format": kind, "data_sha256": folder_digest(spark, data),
            "audit_sha256": {n: folder_digest(spark, f"{audit}/{n}") for n in ("audit", "lineage")}, "summary": result.summary(), **(extra or {}),
        }
        _put(fs, path_of(f"{audit}/manifest.json"), json.dumps(manifest, sort_keys=True))
        swap.commit()
    except BaseException:
        swap.undo()
        raise
    swap.finish()
    return manifest


#: Rows of a part of an audit, so that each can be read and digested by one task.
PART_ROWS = 1_000_000


def write_audit_tree(spark: SparkSession, path: str, head: dict, tables: dict[str, DataFrame], replace: bool = False) -> dict:
    """An audit of any size: a folder of JSON parts for each table, written by its tasks, and ``manifest.json`` with ``head``, the digest of each
    table over its parts' digests, and the root over those.  The manifest commits the audit; rows never pass the driver."""
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    swap = _Swap(fs, p, replace)
    try:
        staging = swap.stage(path)
        digests = {}
        for name, df in tables.items():
            df.write.option("maxRecordsPerFile", PART_ROWS).option("ignoreNullFields", "false").json(f"{staging}/{name}")
            digests[name] = folder_digest(spark, f"{staging}/{name}")
        manifest = head | {"tables": digests, "root_sha256": _root(head, digests)}
        _put(fs, p(f"{staging}/manifest.json"), json.dumps(manifest, sort_keys=True, default=str))
        swap.commit()
    except BaseException:
        swap.undo()
        raise
    swap.finish()
    return manifest


def _root(head: dict, digests: dict[str, str]) -> str:
    lines = [json.dumps(head, sort_keys=True, default=str), *(f"{digests[n]}  {n}" for n in sorted(digests))]
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def verify_audit_tree(spark: SparkSession, path: str) -> list[str]:
    """What of an audit does not match its manifest: names of tables, and ``manifest``; an empty list if all is as written."""
    text = "\n".join(r.value for r in spark.read.text(f"{path}/manifest.json").collect())
    manifest = json.loads(text)
    digests, root = manifest.pop("tables"), manifest.pop("root_sha256")
    wrong = [n for n, d in sorted(digests.items()) if folder_digest(spark, f"{path}/{n}") != d]
    return wrong + ["manifest"] * (_root(manifest, digests) != root)


def stream_json(path: str | Path, head: dict, lists: dict[str, Iterable[dict]]) -> Path:
    """A JSON document with long lists, written row by row and renamed into place."""
    path = Path(path)
    handle, temp = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(json.dumps(head, default=str)[:-1] if head else "{")
            first = not head
            for name, rows in lists.items():
                f.write(("" if first else ", ") + json.dumps(name) + ": [")
                first = False
                for i, row in enumerate(rows):
                    f.write((",\n" if i else "\n") + json.dumps(row, default=str))
                f.write("]")
            f.write("}\n")
        os.replace(temp, path)
    except BaseException:
        Path(temp).unlink(missing_ok=True)
        raise
    return path


def _linkage_head(result, config_text: str) -> dict:
    return {
        "config": json.loads(config_text), "config_sha256": hashlib.sha256(config_text.encode()).hexdigest(), "summary": result.summary(),
        "parameters": {} if result.fit is None else {"lambda": result.fit.match_share, "m": [list(map(float, x)) for x in result.fit.m], "u": [list(map(float, x)) for x in result.fit.u]},
    }


def linkage_audit(path: str | Path, result, config_text: str) -> Path:
    """Configuration, its digest, summary, parameters, matched pairs and clusters as one document; rows stream through the driver.  Larger
    results: ``linkage_audit_tree``."""
    rows = lambda d: (r.asDict() for r in d.toLocalIterator(prefetchPartitions=True))
    pairs = result.match_pairs(result.config.match_threshold_probability)
    return stream_json(path, _linkage_head(result, config_text), {"matched_pairs": rows(pairs), "clusters": rows(result.clusters) if result.clusters is not None else []})


def linkage_audit_tree(path: str, result, config_text: str, replace: bool = False) -> dict:
    """The same as a folder with a tree of digests."""
    tables = {"matched_pairs": result.match_pairs(result.config.match_threshold_probability)}
    if result.clusters is not None:
        tables["clusters"] = result.clusters
    return write_audit_tree(result.pairs.sparkSession, path, _linkage_head(result, config_text), tables, replace)
