"""Reports as Markdown and HTML: the worst first, a few sample cells, the raw payload at the end."""

from __future__ import annotations

import html as _html
import json

from lodestone.plans.results import CheckResult, QualityReport

WORST, SAMPLE_ROWS, SAMPLE_COLUMNS = 10, 5, 5
TITLES = {
    "dataset_contract": "Dataset contract", "missing_values": "Missing values", "duplicates": "Duplicates", "data_types": "Data types", "outliers": "Outliers",
    "ranges": "Ranges", "cardinality": "Cardinality", "freshness": "Freshness", "linkage": "Linkage",
}


def _rows(result: CheckResult) -> tuple[list[str], list[list]]:
    """The table of a built-in check."""
    p = result.payload
    per = p.get("per_column") or []
    if result.name == "missing_values":
        worst = sorted((c for c in per if c["null_count"]), key=lambda c: -c["null_count"])[:WORST]
        return ["column", "missing", "%"], [[c["column"], c["null_count"], c["null_percentage"]] for c in worst]
    if result.name == "outliers":
        worst = sorted((c for c in per if c.get("outlier_count")), key=lambda c: -c["outlier_count"])[:WORST]
        return ["column", "lower", "upper", "outliers"], [[c["column"], c["lower_bound"], c["upper_bound"], c["outlier_count"]] for c in worst]
    if result.name == "ranges":
        return ["column", "min", "max", "violations", "note"], [[c["column"], c["min_allowed"], c["max_allowed"], c["violation_count"], c.get("note", "")] for c in per]
    if result.name == "cardinality":
        return ["constant column"], [[c["column"]] for c in per if c["distinct_count"] <= 1]
    if result.name == "freshness":
        return ["column", "latest", "age"], [[c["column"], c["max_timestamp"], _age(c)] for c in per]
    if result.name == "data_types":
        return ["type", "columns"], [[k, v] for k, v in sorted(p.get("rollup", {}).items())]
    flat = [[k, v] for k, v in p.items() if not isinstance(v, (list, dict))]
    return ["fact", "value"], flat


def _age(c: dict) -> str:
    if c.get("max_timestamp") is None:
        return c.get("note", "")
    h = c["age_hours"]
    return f"{abs(h)} hours " + ("in the future" if h < 0 else "ago")


def _samples(result: CheckResult) -> list[dict]:
    p = result.payload
    found = list(p.get("sample") or [])
    for c in p.get("per_column") or []:
        if isinstance(c, dict):
            found += c.get("sample") or []
    return [dict(list(r.items())[:SAMPLE_COLUMNS]) for r in found[:SAMPLE_ROWS]]


def _cell(v) -> str:
    text = _html.escape(str(v), quote=False).replace("\\", "\\\\")
    for ch in "|`*_[]#~":
        text = text.replace(ch, "\\" + ch)
    return text.replace("\r", " ").replace("\n", " ")


def _md_table(head: list[str], rows: list[list]) -> list[str]:
    return ["| " + " | ".join(map(_cell, head)) + " |", "|" + " --- |" * len(head), *["| " + " | ".join(map(_cell, r)) + " |" for r in rows]]


def _fence(text: str) -> list[str]:
    mark = "```"
    while mark in text:
        mark += "`"
    return [mark + "json", text, mark]


def markdown(report: QualityReport) -> str:
    d = report.dataset
    out = ["# Data quality report", "", f"{d.row_count} rows, {d.column_count} columns, source {_cell(d.source or '-')}, {report.generated_at}", ""]
    out += _md_table(["check", "severity", "status", "seconds"], [[r.name, r.severity, r.status, round(r.duration_seconds, 3)] for r in report.results]) + [""]
    for r in report.results:
        out += [f"## {_cell(TITLES.get(r.name, r.name))}", ""]
        if r.error:
            out += [_cell(r.error), ""]
        if r.name in TITLES:
            head, rows = _rows(r)
            if rows:
                out += _md_table(head, rows) + [""]
            if samples := _samples(r):
                names = list(dict.fromkeys(k for s in samples for k in s))
                out += _md_table(names, [[s.get(n, "") for n in names] for s in samples]) + [""]
        out += _fence(json.dumps(r.payload, indent=1, ensure_ascii=False)) + [""]
    if report.llm_report:
        out += ["## Narrative", "", _html.escape(report.llm_report, quote=False), ""]
    return "\n".join(out)


def _html_table(head: list[str], rows: list[list]) -> str:
    e = lambda v: _html.escape(str(v))
    return "<table><tr>" + "".join(f"<th>{e(h)}</th>" for h in head) + "</tr>" + "".join("<tr>" + "".join(f"<td>{e(v)}</td>" for v in r) + "</tr>" for r in rows) + "</table>"


def html(report: QualityReport) -> str:
    d, e = report.dataset, lambda v: _html.escape(str(v))
    body = [f"<h1>Data quality report</h1><p>{d.row_count} rows, {d.column_count} columns, source {e(d.source or '-')}, {e(report.generated_at)}</p>"]
    body.append(_html_table(["check", "severity", "status", "seconds"], [[r.name, r.severity, r.status, round(r.duration_seconds, 3)] for r in report.results]))
    for r in report.results:
        body.append(f"<h2 class='{r.severity}'>{e(TITLES.get(r.name, r.name))}</h2>" + (f"<p>{e(r.error)}</p>" if r.error else ""))
        if r.name in TITLES:
            head, rows = _rows(r)
            if rows:
                body.append(_html_table(head, rows))
            if samples := _samples(r):
                names = list(dict.fromkeys(k for s in samples for k in s))
                body.append(_html_table(names, [[s.get(n, "") for n in names] for s in samples]))
        body.append(f"<details><summary>payload</summary><pre>{e(json.dumps(r.payload, indent=1, ensure_ascii=False))}</pre></details>")
    if report.llm_report:
        body.append(f"<h2>Narrative</h2><p>{e(report.llm_report)}</p>")
    style = "body{font-family:sans-serif}td,th{border:1px solid #ccc;padding:2px 6px}.error{color:#a00}.warn{color:#a60}"
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Data quality report</title><style>{style}</style></head><body>{''.join(body)}</body></html>"
