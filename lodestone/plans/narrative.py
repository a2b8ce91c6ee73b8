"""Bounded summaries of a report, for a narrative by a provider that the caller registers."""

from __future__ import annotations

import json
from collections.abc import Callable

from lodestone.plans.config import NarrativeConfig
from lodestone.plans.results import QualityReport

MAX_ITEMS, MAX_DTYPES, DROPPED = 50, 100, ("sample", "top_values")
_providers: dict[str, Callable[[str, NarrativeConfig], str]] = {}


def register_provider(name: str, provider: Callable[[str, NarrativeConfig], str]) -> None:
    if name == "none" or name in _providers:
        raise ValueError(f"the provider {name!r} is taken")
    _providers[name] = provider


def _actionable(value) -> bool:
    if not isinstance(value, dict):
        return False
    counts = any(isinstance(v, (int, float)) and not isinstance(v, bool) and v > 0 and ("count" in k or "violation" in k) and k != "distinct_count" for k, v in value.items())
    return counts or bool(value.get("is_stale") or value.get("is_future") or value.get("note"))


def summarise(value):
    """Without samples and values; lists hold what asks for action first, at most ``MAX_ITEMS``."""
    if isinstance(value, dict):
        return {k: summarise(v) for k, v in value.items() if k not in DROPPED}
    if isinstance(value, list):
        items = sorted(value, key=lambda v: not _actionable(v))
        short = [summarise(v) for v in items[:MAX_ITEMS]]
        if len(items) <= MAX_ITEMS:
            return short
        return {"items": short, "total_count": len(items), "omitted_count": len(items) - MAX_ITEMS}
    return value


def prompt(report: QualityReport) -> str:
    d = report.dataset
    head = {"rows": d.row_count, "columns": d.column_count, "dtypes": dict(list(d.dtypes.items())[:MAX_DTYPES])}
    checks = [{"check": r.name, "severity": r.severity, "status": r.status, "payload": summarise(r.payload)} for r in report.results]
    return json.dumps({"dataset": head, "checks": checks}, ensure_ascii=False)


def enrich(report: QualityReport, config: NarrativeConfig) -> None:
    """Add the narrative; a provider's failure is noted, not raised."""
    if config.provider == "none":
        return
    report.llm_provider, report.llm_model = config.provider, config.model
    try:
        report.llm_report = _providers[config.provider](prompt(report), config)
        report.llm_status = "completed"
    except Exception as e:  # a lost provider must not lose the report
        report.llm_status, report.llm_error = "failed", f"{type(e).__name__}: {e}"
