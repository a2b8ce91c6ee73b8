"""Checks.  Each declares the aggregates it needs; the planner gathers those of all checks into one pass over the
data, and each check then judges its numbers.  What no single aggregate can answer (quantiles before
counts, groups, joins) is the check's own job."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import columns as C
from lodestone.operators import contracts, profile
from lodestone.operators.linkage import cluster_sizes, link
from lodestone.plans.config import BUILT_IN, CheckConfig, IcebergTableConfig
from lodestone.plans.results import CheckResult
from lodestone.sources import snapshots


@dataclass
class CheckContext:
    df: DataFrame
    config: CheckConfig
    references: dict[str, DataFrame] = field(default_factory=dict)
    row_count: int = 0
    now: datetime = field(default_factory=lambda: datetime.now(UTC))
    iceberg: IcebergTableConfig | None = None
    snapshot: Any = None

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def dtypes(self) -> dict[str, str]:
        return C.dtypes(self.df)


class Check:
    name = ""

    def aggregates(self, ctx: CheckContext) -> dict[str, Column]:
        """Columns for the shared aggregate, by names of this check's choice."""
        return {}

    def judge(self, ctx: CheckContext, facts: dict[str, Any]) -> tuple[str, dict]:
        raise NotImplementedError

    def run(self, ctx: CheckContext, facts: Callable[[], dict[str, Any]]) -> CheckResult:
        """Failures are results; overrides change the severity of findings, never success or failure."""
        began = time.perf_counter()
        spent = lambda: time.perf_counter() - began
        try:
            severity, payload = self.judge(ctx, facts())
            if severity != "ok":
                severity = ctx.config.severity_overrides.get(self.name, severity)
            return CheckResult(self.name, severity, "completed", spent(), payload)
        except Exception as e:  # a check that cannot run must not end the others
            return CheckResult(self.name, "error", "failed", spent(), {}, f"{type(e).__name__}: {str(e)[:2000]}")


def sample(df: DataFrame, ctx: CheckContext) -> list[dict]:
    return [r.asDict(recursive=True) for r in df.limit(ctx.config.sample_size).collect()]


class DatasetContract(Check):
    name = "dataset_contract"

    def judge(self, ctx, facts):
        cfg = ctx.config
        need = [*dict.fromkeys([*cfg.required_columns, *cfg.expected_dtypes])]
        lost = [c for c in need if c not in ctx.columns]
        types = {f.name: f.dataType for f in ctx.df.schema}
        wrong = [{"column": c, "expected": e, "actual": types[c].simpleString()} for c, e in cfg.expected_dtypes.items() if c in types and not C.matches_family(types[c], e)]
        bad = lost or wrong or ctx.row_count < cfg.min_rows
        return ("error" if bad else "ok"), {"row_count": ctx.row_count, "min_rows": cfg.min_rows, "missing_required_columns": lost, "dtype_mismatches": wrong}


class MissingValues(Check):
    name = "missing_values"

    def aggregates(self, ctx):
        return {c: profile.missing_count(ctx.df, c) for c in ctx.columns}

    def judge(self, ctx, facts):
        rows = ctx.row_count or 1
        per = [{"column": c, "null_count": facts[c], "null_percentage": round(100 * facts[c] / rows, 4)} for c in ctx.columns]
        worst = max((p["null_percentage"] for p in per), default=0.0)
        total = sum(p["null_count"] for p in per)
        return ("error" if worst > 50 else "warn" if total else "ok"), {"total_null_count": total, "worst_column_pct": worst, "per_column": per}


class Duplicates(Check):
    name = "duplicates"

    def judge(self, ctx, facts):
        subset = ctx.config.duplicate_subset
        n = profile.duplicate_count(ctx.df, subset).first()[0]
        rows = sample(profile.duplicate_rows(ctx.df, subset), ctx) if n and ctx.config.sample_size else []
        return ("warn" if n else "ok"), {"total_duplicate_rows": n, "subset": subset, "sample": rows}


class DataTypes(Check):
    name = "data_types"

    def judge(self, ctx, facts):
        roll: dict[str, int] = {}
        for t in ctx.dtypes.values():
            roll[t] = roll.get(t, 0) + 1
        return "ok", {"per_column": ctx.dtypes, "rollup": roll}


class Outliers(Check):
    name = "outliers"

    def judge(self, ctx, facts):
        cfg, names = ctx.config, C.numeric_columns(ctx.df)
        per: list[dict] = []
        found = profile.fences(ctx.df, names, cfg.outlier_iqr_multiplier, cfg.approximate_quantiles).collect() if names else []
        good = []
        for r in found:
            if r.lower_bound is None:
                continue
            if abs(r.lower_bound) == float("inf") or abs(r.upper_bound) == float("inf") or r.lower_bound != r.lower_bound or r.upper_bound != r.upper_bound:
                per.append({"column": r["column"], "skipped": "bounds are not finite"})
            else:
                good.append(r)
        counts = ctx.df.agg(*[F.count_if(profile.outside(ctx.df, r["column"], r.lower_bound, r.upper_bound)) for r in good]).first() if good else []
        for r, n in zip(good, counts, strict=True):
            rows = sample(profile.rows_outside(ctx.df, r["column"], r.lower_bound, r.upper_bound), ctx) if n and cfg.sample_size else []
            per.append({"column": r["column"], "lower_bound": r.lower_bound, "upper_bound": r.upper_bound, "outlier_count": n, "sample": rows})
        return ("warn" if any(p.get("outlier_count") for p in per) else "ok"), {"per_column": per, "quantile_provenance": profile.quantile_provenance(cfg.approximate_quantiles)}


class Ranges(Check):
    name = "ranges"

    def _usable(self, ctx) -> list[str]:
        numeric = set(C.numeric_columns(ctx.df))
        return [c for c in ctx.config.column_ranges if c in numeric]

    def aggregates(self, ctx):
        r = ctx.config.column_ranges
        return {c: F.count_if(profile.outside(ctx.df, c, r[c].min, r[c].max)) for c in self._usable(ctx)}

    def judge(self, ctx, facts):
        per, bad = [], False
        for c, r in ctx.config.column_ranges.items():
            row = {"column": c, "min_allowed": r.min, "max_allowed": r.max, "violation_count": 0, "sample": []}
            if c not in facts:
                row["note"] = "column not found" if c not in ctx.columns else "column is not numeric"
                bad = True
            else:
                row["violation_count"] = facts[c]
                if facts[c] and ctx.config.sample_size:
                    row["sample"] = sample(profile.rows_outside(ctx.df, c, r.min, r.max), ctx)
                bad |= facts[c] > 0
            per.append(row)
        return ("error" if bad else "ok"), {"per_column": per}


class Cardinality(Check):
    name = "cardinality"

    def judge(self, ctx, facts):
        counts = {r["column"]: r.distinct_count for r in profile.distinct_counts(ctx.df, approximate=ctx.config.approximate_cardinality).collect()}
        per = []
        for c in ctx.columns:
            top = [(r.value, r["count"]) for r in profile.top_values(ctx.df, c).collect()] if ctx.config.include_top_values else []
            per.append({"column": c, "distinct_count": counts[c], "unique_ratio": round(counts[c] / (ctx.row_count or 1), 6), "top_values": top})
        constant = ctx.row_count > 1 and any(p["distinct_count"] <= 1 for p in per)
        payload = {"per_column": per} | ({"distinct_provenance": {"method": "approximate", "relative_error": 0.05}} if ctx.config.approximate_cardinality else {})
        return ("warn" if constant else "ok"), payload


class Freshness(Check):
    name = "freshness"

    def _columns(self, ctx) -> list[str]:
        return ctx.config.freshness_columns or C.datetime_columns(ctx.df)

    def _usable(self, ctx) -> list[str]:
        return [c for c in self._columns(ctx) if c in ctx.columns and C.family(C.type_of(ctx.df, c)) in ("datetime", "date", "string")]

    def aggregates(self, ctx):
        out = {}
        for c in self._usable(ctx):
            micros, invalid = profile.instant_micros(ctx.df, c, ctx.config.freshness_timezone)
            out[f"max {c}"], out[f"bad {c}"] = F.max(micros), F.count_if(invalid)
        return out

    def judge(self, ctx, facts):
        cfg, names = ctx.config, self._columns(ctx)
        if not names:
            return "error", {"per_column": [], "note": "no temporal column"}
        per, bad = [], False
        for c in names:
            if f"max {c}" not in facts:
                per.append({"column": c, "max_timestamp": None, "is_stale": True, "note": "column not found" if c not in ctx.columns else "column has no instants"})
                bad = True
                continue
            if facts[f"bad {c}"]:
                raise ValueError(f"{facts[f'bad {c}']} values of {c!r} are no timestamps")
            micros = facts[f"max {c}"]
            if micros is None:
                per.append({"column": c, "max_timestamp": None, "is_stale": True, "note": "no values"})
                bad = True
                continue
            at = datetime.fromtimestamp(micros / 1e6, UTC)
            age = (ctx.now - at).total_seconds() / 3600
            stale, future = age > cfg.freshness_max_age_hours, age < -cfg.freshness_future_tolerance_hours
            per.append({"column": c, "max_timestamp": at.isoformat(), "age_hours": round(age, 3), "is_stale": stale, "is_future": future})
            bad |= stale or future
        return ("error" if bad else "ok"), {"per_column": per}


class Linkage(Check):
    name = "linkage"

    def judge(self, ctx, facts):
        result = link(ctx.df, ctx.config.linkage)
        summary = result.summary()
        sizes = cluster_sizes(result.clusters).first()
        summary |= {"duplicate_clusters": sizes.duplicate_clusters, "records_in_duplicate_groups": sizes.records_in_duplicate_groups}
        bad = "error" if result.status == "rejected" else "warn" if result.status == "warning" or sizes.duplicate_clusters else "ok"
        return bad, summary


class QualityContracts(Check):
    name = "quality_contract"

    def _rules(self, ctx):
        return [(p, r) for p in ctx.config.rule_packs for r in p.comparisons]

    def _lost(self, ctx, r) -> list[str]:
        return [c for c in dict.fromkeys([r.left_column, r.right_column]) if c is not None and c not in ctx.columns]

    def aggregates(self, ctx):
        return {
            f"{p.name}/{r.name}": F.count_if(contracts.comparison_violation(ctx.df, r.left_column, r.operator, r.right_column, r.right_value, r.nulls_pass))
            for p, r in self._rules(ctx) if not self._lost(ctx, r)
        }

    def judge(self, ctx, facts):
        findings = []
        for p in ctx.config.rule_packs:
            if p.schema_policy is not None:
                s = p.schema_policy
                found = contracts.schema_differences(ctx.dtypes, s.columns, allow_additions=s.allow_additions, allow_removals=s.allow_removals, allow_type_changes=s.allow_type_changes)
                findings.append({"pack": p.name, "rule": "schema", "kind": "schema", **found})
            for r in p.comparisons:
                lost = self._lost(ctx, r)
                findings.append({"pack": p.name, "rule": r.name, "kind": "comparison", "violation_count": 1 if lost else facts[f"{p.name}/{r.name}"], "missing_columns": lost, "nulls_pass": r.nulls_pass})
            for r in p.foreign_keys:
                ref = ctx.references.get(r.reference)
                n = 1 if ref is None else contracts.foreign_key_count(ctx.df, r.columns, ref, r.reference_columns, r.nulls_pass).first()[0]
                findings.append({"pack": p.name, "rule": r.name, "kind": "foreign_key", "violation_count": n, "reference": r.reference, "missing_reference": ref is None, "nulls_pass": r.nulls_pass})
        total = sum(f["violation_count"] for f in findings)
        return ("error" if total else "ok"), {"schema_version": "1.0", "rule_packs": [p.name for p in ctx.config.rule_packs], "findings": findings, "violation_count": total}


class IcebergTable(Check):
    name = "iceberg_table"

    def judge(self, ctx, facts):
        cfg, s = ctx.iceberg, ctx.snapshot
        if s is None:
            raise ValueError("the table check needs a captured snapshot")
        counts = snapshots.file_aggregates(s.files).first()
        specs = sorted(r.spec_id for r in s.files.select("spec_id").distinct().collect())
        manifests = s.manifests.count()
        row = s.snapshots.where(F.col("snapshot_id") == s.snapshot_id).select(F.unix_micros("committed_at").alias("at")).first()
        age = (ctx.now.timestamp() - row.at / 1e6) / 3600 if row else None
        current = s.current_id()
        out = {
            "identifier": cfg.identifier, "metadata_complete": row is not None, "captured_snapshot_id": s.snapshot_id, "current_snapshot_id": current, "history_count": s.history.count(),
            "snapshot_count": s.snapshots.count(), "snapshot_age_hours": age, "data_files": counts.data_files, "delete_files": counts.delete_files, "total_files": counts.total_files,
            "active_partition_spec_count": len(specs), "active_spec_ids": specs, "manifest_count": manifests, "schema": ctx.dtypes,
        }
        limits = ((cfg.max_data_files, counts.data_files), (cfg.max_delete_files, counts.delete_files), (cfg.max_active_partition_specs, len(specs)), (cfg.max_manifest_count, manifests), (cfg.max_snapshot_age_hours, age))
        bad = sum(limit is not None and (value is None or value > limit) for limit, value in limits)
        bad += cfg.expected_snapshot_id is not None and cfg.expected_snapshot_id != s.snapshot_id
        bad += cfg.require_current_snapshot and current != s.snapshot_id
        bad += bool(cfg.allowed_spec_ids) and not set(specs) <= set(cfg.allowed_spec_ids)
        if cfg.expected_ancestor_snapshot_id is not None:
            out["ancestor_ok"] = snapshots.is_ancestor(s.snapshots, s.snapshot_id, cfg.expected_ancestor_snapshot_id)
            bad += not out["ancestor_ok"]
        for name, value, expected in (("captured_schema_id", s.captured_schema_id, cfg.expected_schema_id), ("current_spec_id", s.current_spec_id(), cfg.expected_current_spec_id)):
            out[name] = value
            bad += expected is not None and expected != value
        types = {f.name: f.dataType for f in ctx.df.schema}
        wrong = [{"column": c, "expected": e, "actual": types[c].simpleString() if c in types else None} for c, e in cfg.expected_dtypes.items() if c not in types or not C.matches_family(types[c], e)]
        out["dtype_mismatches"] = wrong
        bad += len(wrong)
        if cfg.schema_policy is not None:
            p = cfg.schema_policy
            out["schema_policy"] = contracts.schema_differences(ctx.dtypes, p.columns, allow_additions=p.allow_additions, allow_removals=p.allow_removals, allow_type_changes=p.allow_type_changes)
            bad += out["schema_policy"]["violation_count"]
        probe = snapshots.probe_files(s.files, cfg.file_probe_max_files)
        out["file_probe"] = vars(probe)
        bad += probe.missing + probe.size_mismatches + (cfg.file_probe_require_complete and not probe.complete)
        incomplete = probe.performed and (probe.errors > 0 or not probe.complete)
        out["violations"] = int(bad)
        return ("error" if bad else "warn" if incomplete else "ok"), out


RegisteredCheck = Callable[[CheckContext], tuple[str, dict]]
_registered: dict[str, RegisteredCheck] = {}


def register_check(name: str, check: RegisteredCheck) -> None:
    """Add a check of the caller's; names are unique and not those of built-in checks."""
    if not name.strip() or name in BUILT_IN or name in _registered:
        raise ValueError(f"the name {name!r} is taken or blank")
    _registered[name] = check


def unregister_check(name: str) -> None:
    _registered.pop(name, None)


class Registered(Check):
    def __init__(self, name: str):
        self.name = name

    def judge(self, ctx, facts):
        if self.name not in _registered:
            raise LookupError(f"no check is registered as {self.name!r}")
        return _registered[self.name](ctx)


def enabled(config: CheckConfig, iceberg: IcebergTableConfig | None = None) -> list[Check]:
    """The checks in their order."""
    switched = ((config.missing_values, MissingValues), (config.duplicates, Duplicates), (config.data_types, DataTypes), (config.outliers, Outliers), (config.ranges, Ranges), (config.cardinality, Cardinality), (config.freshness, Freshness))
    out: list[Check] = [DatasetContract(), *[kind() for on, kind in switched if on]]
    if config.linkage is not None:
        out.append(Linkage())
    if config.quality_contract and config.rule_packs:
        out.append(QualityContracts())
    if iceberg is not None:
        out.append(IcebergTable())
    return out + [Registered(n) for n in config.registered_checks]
