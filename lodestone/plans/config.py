"""Configuration: strict dataclasses from defaults, file, environment and keywords, in that order."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import math
import os
import types
import typing
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import urlsplit
from zoneinfo import ZoneInfo

from lodestone.functions.columns import validate_names
from lodestone.functions.strings import StringNormalization
from lodestone.operators.contracts import OPERATORS
from lodestone.operators.levels import ExactMatch, FuzzyString, NumericDiff
from lodestone.operators.linkage import LinkConfig

ENV_PREFIX = "LODESTONE__"
SEVERITIES = ("ok", "warn", "error")
BUILT_IN = ("dataset_contract", "missing_values", "duplicates", "data_types", "outliers", "ranges", "cardinality", "freshness", "linkage", "quality_contract", "iceberg_table")


@dataclass(frozen=True)
class ComparisonRule:
    name: str
    left_column: str
    operator: str
    right_column: str | None = None
    right_value: str | int | float | bool | None = None
    nulls_pass: bool = True

    def __post_init__(self):
        _named(self.name, self.left_column)
        if self.operator not in OPERATORS:
            raise ValueError(f"unknown operator {self.operator!r}")
        if (self.right_column is None) == (self.right_value is None):
            raise ValueError("a comparison has one right operand")
        if isinstance(self.right_value, float) and not math.isfinite(self.right_value):
            raise ValueError("values must be finite")


@dataclass(frozen=True)
class ForeignKeyRule:
    name: str
    columns: list[str]
    reference: str
    reference_columns: list[str]
    nulls_pass: bool = True

    def __post_init__(self):
        _named(self.name, self.reference, *self.columns, *self.reference_columns)
        if not self.columns or len(self.columns) != len(self.reference_columns):
            raise ValueError("key and reference need equally many columns")
        if len(set(self.columns)) != len(self.columns) or len(set(self.reference_columns)) != len(self.reference_columns):
            raise ValueError("key columns must be unique")


@dataclass(frozen=True)
class SchemaPolicy:
    columns: dict[str, str] = field(default_factory=dict)
    allow_additions: bool = False
    allow_removals: bool = False
    allow_type_changes: bool = False


@dataclass(frozen=True)
class QualityContract:
    name: str
    comparisons: list[ComparisonRule] = field(default_factory=list)
    foreign_keys: list[ForeignKeyRule] = field(default_factory=list)
    schema_policy: SchemaPolicy | None = None

    def __post_init__(self):
        _named(self.name)
        names = [r.name for r in [*self.comparisons, *self.foreign_keys]]
        if len(set(names)) != len(names):
            raise ValueError("rule names must be unique")


@dataclass(frozen=True)
class ColumnRange:
    min: float
    max: float

    def __post_init__(self):
        if not (math.isfinite(self.min) and math.isfinite(self.max) and self.min <= self.max):
            raise ValueError("a range has finite bounds, min first")


@dataclass(frozen=True)
class IcebergTableConfig:
    identifier: str
    max_snapshot_age_hours: float | None = None
    max_data_files: int | None = None
    max_delete_files: int | None = None
    max_active_partition_specs: int | None = None
    max_manifest_count: int | None = None
    expected_snapshot_id: int | None = None
    expected_ancestor_snapshot_id: int | None = None
    require_current_snapshot: bool = False
    expected_schema_id: int | None = None
    expected_current_spec_id: int | None = None
    allowed_spec_ids: list[int] = field(default_factory=list)
    schema_policy: SchemaPolicy | None = None
    file_probe_max_files: int = 0
    file_probe_require_complete: bool = False
    expected_dtypes: dict[str, str] = field(default_factory=dict)

    def __post_init__(self):
        if not 0 <= self.file_probe_max_files <= 10_000:
            raise ValueError("at most 10000 files are probed")
        if self.file_probe_require_complete and not self.file_probe_max_files:
            raise ValueError("a complete probe needs a number of files")
        if len(set(self.allowed_spec_ids)) != len(self.allowed_spec_ids):
            raise ValueError("allowed specs must be unique")


@dataclass(frozen=True)
class CheckConfig:
    missing_values: bool = True
    duplicates: bool = True
    data_types: bool = True
    outliers: bool = True
    ranges: bool = True
    cardinality: bool = True
    freshness: bool = False
    quality_contract: bool = True
    allow_nested: bool = False
    rule_packs: list[QualityContract] = field(default_factory=list)
    registered_checks: list[str] = field(default_factory=list)
    severity_overrides: dict[str, str] = field(default_factory=dict)
    min_rows: int = 1
    required_columns: list[str] = field(default_factory=list)
    expected_dtypes: dict[str, str] = field(default_factory=dict)
    outlier_iqr_multiplier: float = 1.5
    approximate_quantiles: bool = False
    approximate_cardinality: bool = False
    duplicate_subset: list[str] | None = None
    column_ranges: dict[str, ColumnRange] = field(default_factory=dict)
    freshness_columns: list[str] = field(default_factory=list)
    freshness_max_age_hours: float = 24.0
    freshness_timezone: str = "UTC"
    freshness_future_tolerance_hours: float = 0.0
    sample_size: int = 0
    include_top_values: bool = False
    linkage: LinkConfig | None = None

    def __post_init__(self):
        for name, severity in self.severity_overrides.items():
            if name not in BUILT_IN or severity not in SEVERITIES:
                raise ValueError(f"bad severity override {name}: {severity}")
        if self.min_rows < 0 or not 0 <= self.sample_size <= 1000:
            raise ValueError("min_rows and sample_size are out of range")
        if not (math.isfinite(self.outlier_iqr_multiplier) and self.outlier_iqr_multiplier > 0 and math.isfinite(self.freshness_max_age_hours) and self.freshness_max_age_hours > 0):
            raise ValueError("multipliers and ages must be positive")
        if not self.freshness_future_tolerance_hours >= 0:
            raise ValueError("the tolerance must not be negative")
        ZoneInfo(self.freshness_timezone)
        for names in (self.required_columns, list(self.expected_dtypes), list(self.column_ranges), self.freshness_columns, self.duplicate_subset or []):
            validate_names(names)
        packs = [p.name for p in self.rule_packs]
        if len(set(packs)) != len(packs):
            raise ValueError("rule packs must have different names")
        if self.linkage is not None and self.linkage.mode != "dedupe":
            raise ValueError("the linkage check works on one table")


@dataclass(frozen=True)
class NarrativeConfig:
    """The optional narrative; only the null provider is built in, others are registered by the caller and find here
    where to connect.  An address without TLS is for this machine, unless it is allowed."""

    provider: str = "none"
    model: str = ""
    region: str | None = None
    aws_profile: str | None = None
    base_url: str | None = None
    allow_insecure_http: bool = False
    connection_name: str | None = None

    def __post_init__(self):
        if self.base_url is None:
            return
        address = urlsplit(self.base_url)
        if address.scheme not in ("http", "https") or not address.hostname or address.username or address.password:
            raise ValueError("base_url is an http(s) address without credentials")
        if address.scheme == "http" and address.hostname not in ("localhost", "127.0.0.1", "::1") and not self.allow_insecure_http:
            raise ValueError("base_url needs https, or allow_insecure_http")


@dataclass(frozen=True)
class Config:
    checks: CheckConfig = field(default_factory=CheckConfig)
    iceberg: IcebergTableConfig | None = None
    narrative: NarrativeConfig = field(default_factory=NarrativeConfig)
    output_path: str | None = None
    report_format: str = "json"

    def __post_init__(self):
        if self.report_format not in ("json", "html", "markdown"):
            raise ValueError("a report is json, html or markdown")

    @classmethod
    def from_file(cls, path: str | Path, **overrides) -> Config:
        """File, then environment, then keywords (nested dictionaries merge)."""
        return build(_merge(_merge(read_mapping(path), from_environment()), overrides))

    @classmethod
    def load(cls, **overrides) -> Config:
        return build(_merge(from_environment(), overrides))


def _named(*names: str) -> None:
    if any(not isinstance(n, str) or not n.strip() for n in names):
        raise ValueError("names must not be blank")


def read_mapping(path: str | Path) -> dict:
    """A YAML or JSON mapping without duplicate keys or numbers that are not finite."""
    text = Path(path).read_text(encoding="utf-8")
    if str(path).endswith(".json"):

        def pairs(found):
            if len({k for k, _ in found}) != len(found):
                raise ValueError("duplicate key in configuration")
            return dict(found)

        def constant(name):
            raise ValueError(f"{name} is not allowed")

        data = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    else:
        import yaml

        class Loader(yaml.SafeLoader):
            pass

        def mapping(loader, node, deep=False):
            keys = [loader.construct_object(k, deep=True) for k, _ in node.value]
            if len({str(k) for k in keys}) != len(keys):
                raise ValueError("duplicate key in configuration")
            return {k: loader.construct_object(v, deep=True) for k, (_, v) in zip(keys, node.value, strict=True)}

        Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
        data = yaml.load(text, Loader)  # noqa: S506 - a SafeLoader
    if data is None:
        return {}
    if not isinstance(data, dict):
        raise ValueError("a configuration is a mapping")
    return data


def from_environment(env: Mapping[str, str] | None = None) -> dict:
    """Values of variables such as LODESTONE__CHECKS__MIN_ROWS; JSON where it parses, else text."""
    out: dict = {}
    for name, value in sorted((os.environ if env is None else env).items()):
        if not name.upper().startswith(ENV_PREFIX):
            continue
        at = out
        *path, last = name[len(ENV_PREFIX) :].lower().split("__")
        for p in path:
            at = at.setdefault(p, {})
        try:
            at[last] = json.loads(value)
        except ValueError:
            at[last] = value
    return out


def _merge(base: dict, more: dict) -> dict:
    out = dict(base)
    for k, v in more.items():
        out[k] = _merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def build(data: dict) -> Config:
    return convert(data, Config, "configuration")


def comparison_spec(data):
    if not isinstance(data, dict):
        return data
    data = dict(data)
    kind = data.pop("kind", "exact")
    if "thresholds" in data:
        data["thresholds"] = tuple(data["thresholds"])
    return {"exact": ExactMatch, "numeric": NumericDiff, "fuzzy": FuzzyString}[kind](**data)


def convert(value, kind, where: str):
    """``value`` as ``kind``; unknown keys, wrong types and numbers that are not finite are refused."""
    origin, args = typing.get_origin(kind), typing.get_args(kind)
    if origin in (typing.Union, types.UnionType):
        if value is None and type(None) in args:
            return None
        errors = []
        for a in args:
            if a is type(None):
                continue
            if a is bool and not isinstance(value, bool) or a in (int, float) and isinstance(value, bool) or a is float and isinstance(value, int) and int in args:
                continue
            try:
                return convert(value, a, where)
            except (TypeError, ValueError) as e:
                errors.append(e)
        raise errors[0] if errors else TypeError(f"{where}: bad value")
    if kind is LinkConfig and isinstance(value, dict):
        value = dict(value)
        value["comparisons"] = tuple(comparison_spec(c) for c in value.get("comparisons", ()))
        value["blocking_rules"] = tuple(tuple(r) for r in value.get("blocking_rules", ()))
        norm = {k: StringNormalization(**{a: tuple(map(tuple, b)) if a == "regex_replacements" else tuple(b) if a == "null_tokens" else b for a, b in v.items()}) if isinstance(v, dict) else v for k, v in value.get("normalization", {}).items()}
        known = {f.name for f in dataclasses.fields(LinkConfig)}
        if extra := sorted(set(value) - known):
            raise ValueError(f"{where}: unknown keys {extra}")
        return LinkConfig(**{**value, "normalization": norm})
    if dataclasses.is_dataclass(kind):
        if isinstance(value, kind):
            return value
        if not isinstance(value, dict):
            raise TypeError(f"{where}: expected a mapping")
        hints = typing.get_type_hints(kind)
        known = {f.name for f in dataclasses.fields(kind)}
        if extra := sorted(map(str, set(value) - known)):
            raise ValueError(f"{where}: unknown keys {extra}")
        return kind(**{k: convert(v, hints[k], f"{where}.{k}") for k, v in value.items()})
    if origin is list:
        if not isinstance(value, (list, tuple)):
            raise TypeError(f"{where}: expected a list")
        return [convert(v, args[0], f"{where}[{i}]") for i, v in enumerate(value)]
    if origin is dict:
        if not isinstance(value, dict):
            raise TypeError(f"{where}: expected a mapping")
        return {convert(k, args[0], where): convert(v, args[1], f"{where}.{k}") for k, v in value.items()}
    if kind is float and isinstance(value, int) and not isinstance(value, bool):
        value = float(value)
    if kind is float and isinstance(value, float) and not math.isfinite(value):
        raise ValueError(f"{where}: numbers must be finite")
    if not isinstance(value, kind) or kind is int and isinstance(value, bool):
        raise TypeError(f"{where}: expected {kind.__name__}, not {type(value).__name__}")
    return value


def plain(value):
    """Dataclasses as JSON values."""
    if dataclasses.is_dataclass(value):
        out = {f.name: plain(getattr(value, f.name)) for f in dataclasses.fields(value)}
        return out | ({"kind": value.kind} if hasattr(value, "kind") else {})
    if isinstance(value, Mapping):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


def fingerprint(config: Config) -> str:
    """SHA-256 of the canonical JSON, without the output path."""
    data = plain(config)
    data.pop("output_path")
    return hashlib.sha256(json.dumps(data, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
