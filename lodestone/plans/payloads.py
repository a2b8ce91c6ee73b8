"""Typed views of the payloads of checks.

A view is frozen, holds what the check of that name reports and keeps keys that a newer version or a caller
added under ``extra``.  ``view`` reads any of these classes (or a caller's, of the same kind) from JSON values
and refuses values of other types, missing keys and negative counts.
"""

from __future__ import annotations

import types
import typing
from dataclasses import MISSING, dataclass, field, fields, is_dataclass
from typing import Any


@dataclass(frozen=True, kw_only=True)
class Payload:
    extra: dict[str, Any] = field(default_factory=dict)


@dataclass(frozen=True, kw_only=True)
class TypeDifference(Payload):
    column: str
    expected: str
    actual: str | None


@dataclass(frozen=True, kw_only=True)
class DatasetContract(Payload):
    row_count: int
    min_rows: int
    missing_required_columns: list[str]
    dtype_mismatches: list[TypeDifference]


@dataclass(frozen=True, kw_only=True)
class MissingColumn(Payload):
    column: str
    null_count: int
    null_percentage: float


@dataclass(frozen=True, kw_only=True)
class MissingValues(Payload):
    total_null_count: int
    worst_column_pct: float
    per_column: list[MissingColumn]


@dataclass(frozen=True, kw_only=True)
class Duplicates(Payload):
    total_duplicate_rows: int
    subset: list[str] | None = None
    sample: list[dict[str, Any]] = field(default_factory=list)


@dataclass(frozen=True, kw_only=True)
class DataTypes(Payload):
    per_column: dict[str, str]
    rollup: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True, kw_only=True)
class OutlierColumn(Payload):
    column: str
    lower_bound: float
    upper_bound: float
    outlier_count: int
    sample: list[dict[str, Any]]


@dataclass(frozen=True, kw_only=True)
class SkippedColumn(Payload):
    column: str
    skipped: str


@dataclass(frozen=True, kw_only=True)
class Provenance(Payload):
    method: str
    relative_error: float | None = None


@dataclass(frozen=True, kw_only=True)
class Outliers(Payload):
    per_column: list[OutlierColumn | SkippedColumn]
    quantile_provenance: Provenance


@dataclass(frozen=True, kw_only=True)
class RangeColumn(Payload):
    column: str
    min_allowed: float | None
    max_allowed: float | None
    violation_count: int
    sample: list[dict[str, Any]]
    note: str | None = None


@dataclass(frozen=True, kw_only=True)
class Ranges(Payload):
    per_column: list[RangeColumn]


@dataclass(frozen=True, kw_only=True)
class CardinalityColumn(Payload):
    column: str
    distinct_count: int
    unique_ratio: float
    top_values: list[list[Any]] = field(default_factory=list)


@dataclass(frozen=True, kw_only=True)
class Cardinality(Payload):
    per_column: list[CardinalityColumn]


@dataclass(frozen=True, kw_only=True)
class FreshColumn(Payload):
    column: str
    max_timestamp: str
    age_hours: float
    is_stale: bool
    is_future: bool


@dataclass(frozen=True, kw_only=True)
class UndatedColumn(Payload):
    column: str
    note: str
    is_stale: bool
    max_timestamp: None = None


@dataclass(frozen=True, kw_only=True)
class Freshness(Payload):
    per_column: list[FreshColumn | UndatedColumn]
    note: str | None = None


@dataclass(frozen=True, kw_only=True)
class LinkageSkipped(Payload):
    skipped: bool


@dataclass(frozen=True, kw_only=True)
class Linkage(Payload):
    candidate_pairs: int
    matched_pairs: int
    match_threshold_probability: float
    clusters: int
    timings_ms: dict[str, float]
    lambda_: float
    fit_status: str
    fit_reason: str | None
    fit_warnings: list[str]
    duplicate_clusters: int
    records_in_duplicate_groups: int


@dataclass(frozen=True, kw_only=True)
class SchemaPolicy(Payload):
    violation_count: int
    additions: list[str]
    removals: list[str]
    type_changes: list[TypeDifference]


@dataclass(frozen=True, kw_only=True)
class SchemaFinding(SchemaPolicy):
    pack: str
    rule: str
    kind: typing.Literal["schema"]


@dataclass(frozen=True, kw_only=True)
class ComparisonFinding(Payload):
    pack: str
    rule: str
    kind: typing.Literal["comparison"]
    violation_count: int
    missing_columns: list[str]
    nulls_pass: bool


@dataclass(frozen=True, kw_only=True)
class ForeignKeyFinding(Payload):
    pack: str
    rule: str
    kind: typing.Literal["foreign_key"]
    violation_count: int
    reference: str
    missing_reference: bool
    nulls_pass: bool


@dataclass(frozen=True, kw_only=True)
class QualityContract(Payload):
    schema_version: str
    rule_packs: list[str]
    findings: list[SchemaFinding | ComparisonFinding | ForeignKeyFinding]
    violation_count: int


@dataclass(frozen=True, kw_only=True)
class Probe(Payload):
    performed: bool
    checked: int
    missing: int
    size_mismatches: int
    errors: int
    complete: bool


@dataclass(frozen=True, kw_only=True)
class TableSnapshot(Payload):
    identifier: str
    metadata_complete: bool
    captured_snapshot_id: int | None = None
    current_snapshot_id: int | None = None
    history_count: int | None = None
    snapshot_count: int | None = None
    snapshot_age_hours: float | None = None
    data_files: int | None = None
    delete_files: int | None = None
    total_files: int | None = None
    active_partition_spec_count: int | None = None
    active_spec_ids: list[int] = field(default_factory=list)
    manifest_count: int | None = None
    captured_schema_id: int | None = None
    current_spec_id: int | None = None
    schema_: dict[str, str] = field(default_factory=dict)
    dtype_mismatches: list[TypeDifference] = field(default_factory=list)
    schema_policy: SchemaPolicy | None = None
    ancestor_ok: bool | None = None
    file_probe: Probe | None = None


@dataclass(frozen=True, kw_only=True)
class Generic(Payload):
    """What a check of the caller's reports: all of it under ``extra``."""


@dataclass(frozen=True, kw_only=True)
class Failed(Payload):
    """A check that could not run reports nothing."""


VIEWS: dict[str, type[Payload]] = {
    "dataset_contract": DatasetContract, "missing_values": MissingValues, "duplicates": Duplicates, "data_types": DataTypes, "outliers": Outliers, "ranges": Ranges,
    "cardinality": Cardinality, "freshness": Freshness, "linkage": Linkage, "quality_contract": QualityContract, "iceberg_table": TableSnapshot,
}


def view(kind: type, data: dict, where: str = "payload"):
    """``data`` as a ``kind``.  A field's key is its name without a trailing underscore; numbers that are not finite come as
    text and are read back."""
    if not isinstance(data, dict):
        raise TypeError(f"{where}: expected an object")
    hints = typing.get_type_hints(kind)
    told = {f.name.rstrip("_"): f for f in fields(kind) if f.name != "extra"}
    out: dict = {}
    for key, f in told.items():
        if key in data:
            out[f.name] = _value(hints[f.name], data[key], f"{where}.{key}")
            if key.endswith("_count") and isinstance(out[f.name], int) and out[f.name] < 0:
                raise ValueError(f"{where}.{key}: counts are not negative")
        elif f.default is MISSING and f.default_factory is MISSING:
            raise ValueError(f"{where}: {key!r} is missing")
    if "extra" in hints:
        out["extra"] = {k: v for k, v in data.items() if k not in told}
    return kind(**out)


def _value(kind, value, where: str):
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if kind is Any:
        return value
    if origin in (typing.Union, types.UnionType):
        problems = []
        for a in args:
            try:
                return _value(a, value, where)
            except (TypeError, ValueError) as e:
                problems.append(str(e))
        raise TypeError("; ".join(problems))
    if origin is typing.Literal:
        if value not in args:
            raise ValueError(f"{where}: expected {args[0]!r}")
        return value
    if is_dataclass(kind):
        return view(kind, value, where)
    if origin is list:
        if not isinstance(value, list):
            raise TypeError(f"{where}: expected a list")
        return [_value(args[0], v, f"{where}[{i}]") for i, v in enumerate(value)]
    if origin is dict:
        if not isinstance(value, dict):
            raise TypeError(f"{where}: expected an object")
        return {k: _value(args[1], v, f"{where}.{k}") for k, v in value.items()}
    if kind is float and (isinstance(value, int) and not isinstance(value, bool) or value in ("inf", "-inf", "nan")):
        return float(value)
    if not isinstance(value, kind) or isinstance(value, bool) and kind is not bool:
        raise TypeError(f"{where}: expected {kind.__name__}, not {type(value).__name__}")
    return value
