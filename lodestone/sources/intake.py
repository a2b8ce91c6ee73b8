"""Work arriving as object-store events: which inputs to check, their limits, and reports written once."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from urllib.parse import unquote_plus

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from lodestone.functions.columns import is_nested
from lodestone.plans.results import QualityReport

SUFFIXES = (".parquet", ".pq", ".csv", ".jsonl", ".ndjson")
#: Limits of one input: bytes stored, columns, bytes expanded and how far text expands.
MAX_BYTES, MAX_COLUMNS, MAX_EXPANDED, TEXT_FACTOR = 256 << 20, 10_000, 1 << 30, 8


@dataclass(frozen=True)
class Item:
    path: str
    version: str | None = None


def items(event: dict) -> tuple[list[Item], int]:
    """The inputs of an event (one address, or records of created objects) and how many were skipped for their suffix."""
    if "s3_uri" in event:
        found = [Item(str(event["s3_uri"]))]
    elif isinstance(event.get("Records"), list):
        found, problems = [], []
        for r in event["Records"]:
            try:
                if not str(r["eventName"]).removeprefix("s3:").startswith("ObjectCreated:"):
                    raise ValueError(f"unexpected event {r['eventName']!r}")
                o = r["s3"]["object"]
                found.append(Item(f"s3a://{r['s3']['bucket']['name']}/{unquote_plus(o['key'])}", o.get("versionId")))
            except (KeyError, TypeError, ValueError) as e:
                problems.append(ValueError(f"bad record: {e}"))
        if problems:
            raise ExceptionGroup("bad records", problems)
    else:
        raise ValueError("an event has one address or records")
    kept = [i for i in found if i.path.lower().endswith(SUFFIXES)]
    return kept, len(found) - len(kept)


@dataclass(frozen=True)
class State:
    """What an input was when it was looked at: its bytes, and a digest over its files' names, lengths, times and (where the
    file system keeps them) checksums."""

    size: int
    version: str


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def state(spark: SparkSession, path: str, *, max_bytes: int = MAX_BYTES) -> State:
    """The input's state; ValueError if it has more than ``max_bytes``.  Only metadata are read."""
    fs, p = _fs(spark, path)
    size = fs.getContentSummary(p).getLength()
    if size > max_bytes:
        raise ValueError(f"input of {size} bytes exceeds {max_bytes}")
    told, files = [], fs.listFiles(p, True)
    while files.hasNext():
        f = files.next()
        checksum = fs.getFileChecksum(f.getPath())
        told.append((f.getPath().toString(), f.getLen(), f.getModificationTime(), None if checksum is None else checksum.toString()))
    return State(size, hashlib.sha256(json.dumps(sorted(told)).encode()).hexdigest())


@contextmanager
def bound(spark: SparkSession, path: str, *, max_bytes: int = MAX_BYTES) -> Iterator[State]:
    """Binds what is read inside to one state of the input: RuntimeError if that has changed when the block ends."""
    before = state(spark, path, max_bytes=max_bytes)
    yield before
    if state(spark, path, max_bytes=max_bytes) != before:
        raise RuntimeError(f"{path} changed while it was read")


def expanded_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of an input when expanded: for Parquet what the footers tell, for text ``TEXT_FACTOR`` times its size.  The size cap
    bounds the number of footers."""
    fs, p = _fs(spark, path)
    if not path.lower().endswith((".parquet", ".pq")):
        return fs.getContentSummary(p).getLength() * TEXT_FACTOR
    jvm, conf, total = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    files = fs.listFiles(p, True)
    while files.hasNext():
        f = files.next().getPath()
        if f.getName().startswith(("_", ".")):
            continue
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(f, conf))
        try:
            total += sum(block.getTotalByteSize() for block in reader.getFooter().getBlocks())
        finally:
            reader.close()
    return total


def check_limits(spark: SparkSession, path: str, frame: DataFrame | None = None, *, max_bytes: int = MAX_BYTES, max_expanded: int = MAX_EXPANDED) -> int:
    """The input's bytes; ValueError beyond the limits."""
    size = state(spark, path, max_bytes=max_bytes).size
    if (n := expanded_bytes(spark, path)) > max_expanded:
        raise ValueError(f"input may expand to {n} bytes, beyond {max_expanded}")
    if frame is not None:
        if len(frame.columns) > MAX_COLUMNS:
            raise ValueError(f"more than {MAX_COLUMNS} columns")
        if any(is_nested(f.dataType) for f in frame.schema):
            raise ValueError("nested columns")
    return size


def run_id(item: Item, config_hash: str, build: str) -> str:
    """The identity of a report: the same input under the same configuration and build."""
    return hashlib.sha256(json.dumps([item.path, item.version, config_hash, build]).encode()).hexdigest()


def write_once(spark: SparkSession, folder: str, name: str, text: str) -> tuple[str, bool]:
    """Write a report unless it is there; returns its path and whether it was written.

    The text goes to a file of its own that is renamed without overwriting, so that of several writers one wins and
    no reader finds half a report."""
    jvm = spark._jvm
    fs, target = _fs(spark, f"{folder.rstrip('/')}/{name}.json")
    if fs.exists(target):
        return target.toString(), False
    temp = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{target.getName()}.{uuid.uuid4().hex}")
    out = fs.create(temp, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        never = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(temp, target, never)
    except Py4JJavaError as e:
        fs.delete(temp, False)
        if "FileAlreadyExistsException" not in e.java_exception.getClass().getName():
            raise
        return target.toString(), False
    return target.toString(), True


def stored(spark: SparkSession, folder: str, identity: str) -> dict | None:
    """The outcome of the report of that identity, if it is there."""
    fs, path = _fs(spark, f"{folder.rstrip('/')}/{identity}.json")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        data = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    if data.get("identity") != identity:
        raise ValueError(f"{path.toString()} belongs to another input")
    return {**data["outcome"], "path": path.toString(), "cached": True}


def store(spark: SparkSession, folder: str, identity: str, report: QualityReport) -> dict:
    """Store a report once.  One whose checks or narrative could not run may be tried again, so it goes to a key of its own
    under ``failures``; where another writer was first, the outcome is that of the report found."""
    failures = sum(r.status == "failed" for r in report.results)
    outcome = {"summary": {r.name: r.severity for r in report.results if r.status == "completed"}, "narrative": report.llm_status, "execution_failures": failures}
    text = json.dumps({"identity": identity, "outcome": outcome, "report": json.loads(report.to_json())}, ensure_ascii=False)
    name = f"failures/{identity}.{uuid.uuid4().hex}" if failures or report.llm_status == "failed" else identity
    path, written = write_once(spark, folder, name, text)
    return {**outcome, "path": path, "cached": False} if written else stored(spark, folder, identity)


def process(spark: SparkSession, item: Item, config, folder: str, *, max_bytes: int = MAX_BYTES, max_expanded: int = MAX_EXPANDED, build: str | None = None) -> dict:
    """Check one input within its limits, bound to one state of it, and store the report; a report that is there already is
    used again.  An input that changes while it is checked leaves no report."""
    from lodestone import __version__
    from lodestone.plans.checker import DataQualityChecker
    from lodestone.plans.config import fingerprint

    with bound(spark, item.path, max_bytes=max_bytes) as now:
        identity = run_id(Item(item.path, item.version or now.version), fingerprint(config), build or __version__)
        if (found := stored(spark, folder, identity)) is not None:
            return found
        check_limits(spark, item.path, max_bytes=max_bytes, max_expanded=max_expanded)
        checker = DataQualityChecker(item.path, config, spark=spark)
        check_limits(spark, item.path, checker.df, max_bytes=max_bytes, max_expanded=max_expanded)
        report = checker.run()
        report.dataset.source_version = item.version or now.version
    return store(spark, folder, identity, report)


def gate(severities: list[str], threshold: str) -> dict:
    """The outcome of a run: counts by severity, and whether the gate at ``threshold`` (none, warn or error) passes."""
    if threshold not in ("none", "warn", "error"):
        raise ValueError("a gate is none, warn or error")
    counts = {s: severities.count(s) for s in ("ok", "warn", "error")}
    failed = threshold != "none" and (counts["error"] > 0 or threshold == "warn" and counts["warn"] > 0)
    return {"passed": not failed, **counts}


def embedded_metrics(outcome: dict, namespace: str = "Lodestone", now_ms: int = 0) -> str:
    """Three counters as an embedded-metric JSON line."""
    names = {"ChecksOk": outcome["ok"], "ChecksWarn": outcome["warn"], "ChecksError": outcome["error"]}
    meta = {"Timestamp": now_ms, "CloudWatchMetrics": [{"Namespace": namespace, "Dimensions": [[]], "Metrics": [{"Name": n, "Unit": "Count"} for n in names]}]}
    return json.dumps({"_aws": meta, **names})
