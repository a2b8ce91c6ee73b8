"""Command line: check, link, ner, version."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Sequence
from dataclasses import replace
from datetime import UTC, datetime

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import __version__
from lodestone.functions.columns import col, family, type_of
from lodestone.functions.strings import StringNormalization
from lodestone.operators import entities, merge
from lodestone.operators.linkage import LinkConfig, link, normalize_records
from lodestone.plans.checker import DataQualityChecker, report_format
from lodestone.plans.config import Config, NarrativeConfig, comparison_spec, plain
from lodestone.plans.staging import drop_staged, stage
from lodestone.sources import intake
from lodestone.sources.load import load
from lodestone.sources.sinks import linkage_audit, linkage_audit_tree, publish, stream_json

log = logging.getLogger("lodestone")

LOG_FIELDS = ("check", "duration_seconds", "engine", "output_path", "format", "severity", "status")


class JsonFormatter(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        out = {"level": record.levelname.lower(), "message": record.getMessage()}
        return json.dumps(out | {k: getattr(record, k) for k in LOG_FIELDS if hasattr(record, k)}, default=str)


def set_up_logging(level: str = "warning", as_json: bool = False) -> None:
    handler = logging.StreamHandler(sys.stderr)
    handler.setFormatter(JsonFormatter() if as_json else logging.Formatter("%(levelname)s %(message)s"))
    log.handlers[:] = [handler]
    log.setLevel(level.upper())


def parse_range(text: str) -> tuple[str, dict]:
    """col=min,max"""
    name, eq, bounds = text.rpartition("=")
    low, comma, high = bounds.partition(",")
    if not eq or not comma or not name:
        raise argparse.ArgumentTypeError(f"expected col=min,max: {text!r}")
    return name, {"min": float(low), "max": float(high)}


def parse_comparison(text: str):
    """col:kind[:t1,t2]"""
    parts = text.split(":")
    if len(parts) not in (2, 3) or parts[1] not in ("exact", "numeric", "fuzzy"):
        raise argparse.ArgumentTypeError(f"expected col:kind[:t1,t2]: {text!r}")
    spec: dict = {"column": parts[0], "kind": parts[1]}
    if len(parts) == 3:
        spec["thresholds"] = [float(t) for t in parts[2].split(",")]
    return comparison_spec(spec)


def parse_merge(text: str) -> tuple[str, merge.MergeRule]:
    """col:strategy[:order]"""
    parts = text.split(":")
    if len(parts) not in (2, 3):
        raise argparse.ArgumentTypeError(f"expected col:strategy[:order]: {text!r}")
    return parts[0], merge.MergeRule(parts[1], parts[2] if len(parts) == 3 else None)


def parse_sort(text: str) -> merge.SurvivorSortKey:
    """col:asc|desc"""
    name, _, way = text.rpartition(":")
    if way not in ("asc", "desc") or not name:
        raise argparse.ArgumentTypeError(f"expected col:asc or col:desc: {text!r}")
    return merge.SurvivorSortKey(name, way == "desc")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--log-level", default=os.environ.get("LODESTONE_LOG_LEVEL", "warning"), type=str.lower, choices=["debug", "info", "warning", "error", "critical"])
    p.add_argument("--json-logs", "--log-json", dest="log_json", action="store_true")
    p.add_argument("--rich-logs", dest="log_json", action="store_false")
    loud = p.add_mutually_exclusive_group()
    loud.add_argument("--quiet", "-q", action="store_true")
    loud.add_argument("--verbose", "-v", action="store_true")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("version")
    c = sub.add_parser("check", help="check a table against a contract")
    c.add_argument("path")
    c.add_argument("--config", "-c")
    c.add_argument("--engine", "-e", choices=["spark"], default="spark", help="Spark is the only engine")
    c.add_argument("--output", "-o")
    c.add_argument("--format", "-f", choices=["json", "html", "markdown"])
    c.add_argument("--llm", help="registered provider of the narrative, or none")
    c.add_argument("--model")
    c.add_argument("--region", default=os.environ.get("AWS_REGION"))
    c.add_argument("--profile", default=os.environ.get("AWS_PROFILE"))
    c.add_argument("--base-url")
    c.add_argument("--allow-insecure-http", action="store_true", default=None)
    c.add_argument("--require-https", dest="allow_insecure_http", action="store_false")
    c.add_argument("--fail-on", choices=["warn", "error", "never"], default="error")
    c.add_argument("--range", dest="ranges", type=parse_range, action="append", default=[])
    c.add_argument("--required", action="append", default=[])
    c.add_argument("--duplicate-subset", action="append", default=[])
    c.add_argument("--freshness", action="append", default=[])
    c.add_argument("--max-age-hours", type=float)
    c.add_argument("--min-rows", type=int)
    c.add_argument("--sample-size", type=int)
    c.add_argument("--allow-nested", action="store_true")
    c.add_argument("--reference", action="append", default=[], help="name=path")
    k = sub.add_parser("link", help="find records of the same entity, and optionally merge them")
    k.add_argument("path")
    k.add_argument("--right")
    k.add_argument("--id", required=True)
    k.add_argument("--compare", type=parse_comparison, action="append", default=[])
    k.add_argument("--block", action="append", default=[], help="col[,col]")
    k.add_argument("--threshold", type=float, default=0.9)
    k.add_argument("--normalize-strings", action="store_true", default=True)
    k.add_argument("--raw-strings", dest="normalize_strings", action="store_false")
    k.add_argument("--output", "--audit", "-o", dest="audit", help="JSON of parameters, matched pairs and clusters")
    k.add_argument("--audit-tree", help="folder of the same, written by all tasks, with a tree of digests")
    k.add_argument("--deduplicated-output", "--dedupe-output", dest="dedupe_output")
    k.add_argument("--dedupe-format", choices=["parquet", "csv", "jsonl", "ndjson"], help="default: the output's suffix, else parquet")
    k.add_argument("--survivor-sort", type=parse_sort, action="append", default=[])
    k.add_argument("--completeness", action="append", help="column counted when survivors are ranked (default: all but the id)")
    k.add_argument("--rank-by-completeness", dest="rank_by_completeness", action="store_true", default=True)
    k.add_argument("--no-completeness", dest="rank_by_completeness", action="store_false")
    k.add_argument("--merge", type=parse_merge, action="append", default=[])
    k.add_argument("--allow-warning-fit", action="store_true")
    n = sub.add_parser("ner", help="find named entities and audit them")
    n.add_argument("path")
    n.add_argument("--text", required=True)
    n.add_argument("--id")
    n.add_argument("--pattern", action="append", default=[], help="LABEL=regular expression")
    n.add_argument("--model")
    n.add_argument("--expected-model-version")
    n.add_argument("--expected-model-sha256")
    n.add_argument("--label", action="append")
    n.add_argument("--batch-size", type=int, default=256)
    n.add_argument("--processes", type=int, default=1)
    n.add_argument("--output", "-o")
    return p


def narrative_flags(a: argparse.Namespace, current: NarrativeConfig) -> NarrativeConfig:
    """The narrative with what was given.  A named provider clears the connection, and another one the model."""
    given = {"provider": a.llm, "model": a.model, "region": a.region, "aws_profile": a.profile, "base_url": a.base_url, "allow_insecure_http": a.allow_insecure_http}
    changes = {k: v for k, v in given.items() if v is not None}
    if a.llm is not None:
        changes["connection_name"] = None
        if a.llm != current.provider:
            changes.setdefault("model", "")
    return replace(current, **changes)


def check_overrides(a: argparse.Namespace) -> dict:
    """Flags as configuration; what was not given stays out."""
    checks: dict = {}
    if a.ranges:
        checks["column_ranges"] = dict(a.ranges)
    for flag, name in ((a.required, "required_columns"), (a.duplicate_subset, "duplicate_subset"), (a.freshness, "freshness_columns")):
        if flag:
            checks[name] = flag
    if a.freshness:
        checks["freshness"] = True
    for value, name in ((a.max_age_hours, "freshness_max_age_hours"), (a.min_rows, "min_rows"), (a.sample_size, "sample_size")):
        if value is not None:
            checks[name] = value
    if a.allow_nested:
        checks["allow_nested"] = True
    out: dict = {"checks": checks} if checks else {}
    if a.output:
        out["output_path"] = a.output
    if a.format:
        out["report_format"] = a.format
    return out


def run_check(a: argparse.Namespace, spark: SparkSession) -> int:
    over = check_overrides(a)
    config = Config.from_file(a.config, **over) if a.config else Config.load(**over)
    config = replace(config, narrative=narrative_flags(a, config.narrative))
    refs = dict(r.split("=", 1) for r in a.reference)
    report = DataQualityChecker(a.path, config, references=refs, spark=spark).run()
    if not a.quiet:
        for r in report.results:
            print(f"{r.name:20} {r.severity:6} {r.status:10} {r.duration_seconds:.2f}s" + (f"  {r.error}" if r.error else ""))
    if config.output_path:
        log.info("report written", extra={"output_path": config.output_path, "format": report_format(config.output_path, config.report_format)})
    return report.exit_code(a.fail_on)


def consolidation(a: argparse.Namespace, df: DataFrame) -> merge.ConsolidationConfig:
    """Rules from the flags over the first present value of each column."""
    columns = [c for c, _ in a.merge]
    if len(set(columns)) != len(columns):
        raise ValueError("--merge names a column twice")
    if a.completeness is not None and not a.rank_by_completeness:
        raise ValueError("--completeness and --no-completeness exclude each other")
    base = merge.default_merge(df, a.id)
    counted = () if not a.rank_by_completeness else base.completeness_columns if a.completeness is None else tuple(a.completeness)
    return merge.ConsolidationConfig(tuple(a.survivor_sort), counted, {**base.merge_rules, **dict(a.merge)})


def run_link(a: argparse.Namespace, spark: SparkSession) -> int:
    if a.dedupe_output and not a.audit:
        raise ValueError("--deduplicated-output needs --output for its audit")
    if a.dedupe_output and a.right:
        raise ValueError("deduplication works on one table")
    df = load(a.path, spark).frame
    right = load(a.right, spark).frame if a.right else None
    text = [c for c in df.columns if c != a.id and family(type_of(df, c)) == "string" and (right is None or c in right.columns and family(type_of(right, c)) == "string")]
    rules = tuple(tuple(c.strip() for c in b.split(",") if c.strip()) for b in a.block)
    config = LinkConfig(
        a.id, tuple(a.compare), rules, {c: StringNormalization() for c in text} if a.normalize_strings else {}, "link" if a.right else "dedupe",
        match_threshold_probability=a.threshold, allow_warning_fit=a.allow_warning_fit,
    )
    if a.dedupe_output:
        suffix = a.dedupe_output.rstrip("/").rpartition(".")[2].lower()
        kind = a.dedupe_format or (suffix if suffix in ("csv", "jsonl", "ndjson") else "parquet")
        found = merge.deduplicate(normalize_records(df, config), config, consolidation(a, df))  # normal forms stay as they are when normalised again
        result = found.linkage
        publish(found.consolidation, a.dedupe_output, a.audit + ".dedupe", kind, replace=True)
    else:
        result = link(df, config, right)
    if a.audit:
        linkage_audit(a.audit, result, json.dumps(plain(config), sort_keys=True))
        log.info("linkage written", extra={"output_path": a.audit, "format": "json"})
    if a.audit_tree:
        linkage_audit_tree(a.audit_tree, result, json.dumps(plain(config), sort_keys=True), replace=True)
    if not a.quiet:
        print(json.dumps(result.summary(), default=str))
    return 2 if result.status == "rejected" else 0


def run_ner(a: argparse.Namespace, spark: SparkSession) -> int:
    """Entities of a table with their rows; the input is bound to one state, and its digest told."""
    if bool(a.model) == bool(a.pattern):
        raise ValueError("give --model or --pattern")
    if a.output and (not a.output.lower().endswith(".json") or a.output == a.path):
        raise ValueError("--output is a .json file that is not the input")
    if any(not label.strip() for label in a.label or ()):
        raise ValueError("labels must not be blank")
    if a.model:
        rec = entities.ModelRecognizer(
            a.model, labels=a.label, expected_version=a.expected_model_version, expected_sha256=a.expected_model_sha256, batch_size=a.batch_size, processes=a.processes
        )
        about = rec.describe()
    else:
        patterns = dict(p.split("=", 1) for p in a.pattern)
        rec, about = entities.PatternRecognizer(patterns), {"patterns": patterns}
    with intake.bound(spark, a.path, max_bytes=sys.maxsize) as now:
        df = load(a.path, spark).frame
        entities.check_request(df, text_col=a.text, id_col=a.id)
        found = stage(entities.found_rows(df, rec, text_col=a.text, id_col=a.id, labels=a.label), "entities")
        rows, skipped = df.agg(F.count(F.lit(1)), F.count_if(col(a.text).isNull())).first()
    labels = {r.label: r.entities for r in entities.label_counts(found).orderBy("label").collect()}
    head = {
        "schema_version": "1.0", "generated_at": datetime.now(UTC).isoformat(), "package_version": __version__, "source": a.path, "source_state": now.version, "text_column": a.text, "id_column": a.id,
        "label_filter": sorted(a.label) if a.label else None, "model": about,
        "summary": {"rows": rows, "processed_rows": rows - skipped, "null_rows": skipped, "entities": sum(labels.values()), "labels": labels},
    }
    if a.output:
        listed = found.orderBy("row_index", "start_char", "end_char", "label").toLocalIterator(prefetchPartitions=True)
        stream_json(a.output, head, {"entities": (r.asDict() for r in listed)})
        log.info("entities written", extra={"output_path": a.output, "format": "json"})
    if not a.quiet:
        print(json.dumps(head, indent=2))
    drop_staged(found)
    return 0


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    set_up_logging("error" if a.quiet else "info" if a.verbose else a.log_level, a.log_json)
    if a.command == "version":
        print(__version__)
        return 0
    spark = spark or SparkSession.builder.appName("lodestone").getOrCreate()
    try:
        return {"check": run_check, "link": run_link, "ner": run_ner}[a.command](a, spark)
    except (ValueError, TypeError, OSError, RuntimeError, MemoryError, PySparkException) as e:
        print(f"error: {e}", file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
