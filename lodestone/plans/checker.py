"""The orchestrator: bind inputs, gather facts in one pass, judge, report."""

from __future__ import annotations

import logging
from collections.abc import Callable, Mapping
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import columns as C
from lodestone.plans import narrative, render
from lodestone.plans.checks import Check, CheckContext, enabled
from lodestone.plans.config import Config, fingerprint
from lodestone.plans.results import DatasetStats, QualityReport
from lodestone.sources.load import load
from lodestone.sources.sinks import write_text_atomic
from lodestone.sources.snapshots import load_snapshot

log = logging.getLogger("lodestone")


def shared_facts(ctx: CheckContext, checks: list[Check]) -> tuple[int, dict[str, Callable[[], dict]]]:
    """The row count and each check's facts, from one aggregate over the data.  If that fails (a rule that
    compares what cannot be compared), each check's own aggregate runs apart, so that only its owner fails."""
    wanted: dict[str, dict] = {}
    broken: dict[str, Exception] = {}
    for c in checks:
        try:
            wanted[c.name] = c.aggregates(ctx)
        except Exception as e:
            broken[c.name], wanted[c.name] = e, {}

    def run(names: list[str]) -> tuple[int, dict[str, dict]]:
        flat = [(n, k, col) for n in names for k, col in wanted[n].items()]
        row = ctx.df.agg(F.count(F.lit(1)), *[col.alias(f"f{i}") for i, (_, _, col) in enumerate(flat)]).first()
        out: dict[str, dict] = {n: {} for n in names}
        for (n, k, _), v in zip(flat, row[1:], strict=True):
            out[n][k] = v
        return row[0], out

    def fail(e: Exception) -> Callable[[], dict]:
        def raise_it() -> dict:
            raise e

        return raise_it

    names = [c.name for c in checks]
    facts: dict[str, Callable[[], dict]] = {}
    try:
        rows, found = run(names)
        facts = {n: (lambda v=found[n]: v) for n in names}
    except Exception:
        rows = ctx.df.count()
        facts = {n: (lambda n=n: run([n])[1][n]) for n in names}
    return rows, facts | {n: fail(e) for n, e in broken.items()}


class DataQualityChecker:
    """Checks one dataset; the caller's session is used and never stopped."""

    def __init__(self, data, config: Config | None = None, *, references: Mapping[str, object] | None = None, spark: SparkSession | None = None, now: datetime | None = None):
        self.config = config or Config()
        self.now = now
        if self.config.iceberg is not None and not hasattr(self, "_snapshot"):
            raise ValueError("table checks start from from_iceberg()")
        if self.config.output_path and isinstance(data, str) and data == self.config.output_path:
            raise ValueError("the report would overwrite the input")
        source = load(data, spark, allow_nested=self.config.checks.allow_nested)
        self.df, self._source, self._nested = source.frame, source.name, source.nested
        self.references: dict[str, DataFrame] = {}
        for name, ref in (references or {}).items():
            self.references[name] = load(ref, self.df.sparkSession, allow_nested=True).frame

    @classmethod
    def from_iceberg(cls, identifier: str, spark: SparkSession, config: Config, snapshot_id: int | None = None, **options) -> DataQualityChecker:
        """Rows and metadata of a table, bound to one snapshot."""
        snapshot = load_snapshot(spark, identifier, snapshot_id)
        self = cls.__new__(cls)
        self._snapshot = snapshot
        self.__init__(snapshot.frame, config, spark=spark, **options)
        self._source, self._version = identifier, str(snapshot.snapshot_id)
        return self

    def run(self, *, include_narrative: bool = True) -> QualityReport:
        cfg, sc = self.config, self.df.sparkSession.sparkContext
        ctx = CheckContext(self.df, cfg.checks, self.references, 0, self.now or datetime.now(UTC), cfg.iceberg, getattr(self, "_snapshot", None))
        checks = enabled(cfg.checks, cfg.iceberg)
        sc.setJobDescription("lodestone: shared facts")
        ctx.row_count, facts = shared_facts(ctx, checks)
        results = []
        for check in checks:
            sc.setJobDescription(f"lodestone: {check.name}")
            r = check.run(ctx, facts[check.name])
            log.info("check finished", extra={"check": r.name, "duration_seconds": r.duration_seconds, "severity": r.severity, "status": r.status, "engine": "spark"})
            results.append(r)
        sc.setJobDescription(None)
        stats = DatasetStats(ctx.row_count, len(self.df.columns), list(self.df.columns), C.dtypes(self.df), "spark", self._source, getattr(self, "_version", None), self._nested)
        report = QualityReport(stats, results, config_hash=fingerprint(cfg))
        if include_narrative:
            narrative.enrich(report, cfg.narrative)
        if cfg.output_path:
            save(report, cfg.output_path, cfg.report_format)
        return report

    def close(self) -> None:
        """Nothing is held: frames and session are the caller's."""

    def __enter__(self) -> DataQualityChecker:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()


def report_format(path: str, configured: str = "json") -> str:
    """A known suffix wins over the configured format."""
    for suffix, kind in ((".json", "json"), (".html", "html"), (".htm", "html"), (".md", "markdown"), (".markdown", "markdown")):
        if str(path).lower().endswith(suffix):
            return kind
    return configured


def save(report: QualityReport, path: str, configured: str = "json"):
    kind = report_format(path, configured)
    text = {"json": report.to_json, "html": lambda: render.html(report), "markdown": lambda: render.markdown(report)}[kind]()
    return write_text_atomic(path, text)
