"""Queries over checks, guards, sources and consolidation as a caller meets them, and the SQL that gives the same rows.

What a check reports is small (a row a column or rule), so it comes back as rows made on the driver."""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.columns import family
from lodestone.operators import entities, merge
from lodestone.operators.fellegi_sunter import PSEUDOCOUNT
from lodestone.operators.levels import ExactMatch, NumericDiff
from lodestone.operators.linkage import LinkConfig, fit_pairs, guard, validate
from lodestone.plans.checker import DataQualityChecker
from lodestone.plans.checks import register_check, unregister_check
from lodestone.plans.config import CheckConfig, ColumnRange, ComparisonRule, Config, ForeignKeyRule, QualityContract, SchemaPolicy
from lodestone.plans.results import CheckResult, QualityReport
from lodestone.plans.staging import new_path
from lodestone.queries import _GROUPS, _L_NUM, _LI, _PAIRS, _RANKED, _merge_config, _outlier_sql, DIRTY, KEYED, dirty_events, dirty_lineitem, groups, query, table
from lodestone.sources.load import load, read_jsonl
from lodestone.sources.text_validation import csv_problems, jsonl_facts

_SWITCHES = ("missing_values", "duplicates", "data_types", "outliers", "ranges", "cardinality", "freshness", "quality_contract")


def run_check(df: DataFrame, name: str, references: dict | None = None, now: datetime | None = None, **options) -> CheckResult:
    """The result of one check, run by the checker with the other switches off."""
    on = {s: s == name for s in _SWITCHES}
    report = DataQualityChecker(df, Config(checks=CheckConfig(**{**on, **options})), references=references, now=now).run()
    found = next(r for r in report.results if r.name == name)
    if found.status == "failed":
        raise RuntimeError(found.error)
    return found


# --- checks ---------------------------------------------------------------------------------------------


@query(
    """SELECT 'error' AS severity, count(*) AS row_count, 'no_such_column' AS lost,
CASE WHEN any_value(typeof(o_orderstatus)) IN ('BIGINT', 'INTEGER', 'DOUBLE') THEN '' ELSE 'o_orderstatus' END AS wrong FROM orders"""
)
def check_dataset_contract(spark, sf):
    r = run_check(table(spark, sf, "orders"), "dataset_contract", min_rows=1, required_columns=["o_orderkey", "no_such_column"], expected_dtypes={"o_orderkey": "integer", "o_totalprice": "double", "o_orderstatus": "numeric"})
    p = r.payload
    row = (r.severity, p["row_count"], ",".join(p["missing_required_columns"]), ",".join(m["column"] for m in p["dtype_mismatches"]))
    return spark.createDataFrame([row], "severity string, row_count long, lost string, wrong string")


_MISSING = " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER ({c} IS NULL) AS null_count, count(*) AS n FROM {KEYED}""" for c in ("event_id", "value", "user_id", "event_type"))


@query(f"""SELECT CASE WHEN max(null_count * 100.0 / n) OVER () > 50 THEN 'error' WHEN sum(null_count) OVER () > 0 THEN 'warn' ELSE 'ok' END AS severity, "column", null_count, round(100 * null_count::DOUBLE / n, 4) AS null_percentage FROM ({_MISSING})""")
def check_missing_values(spark, sf):
    r = run_check(dirty_events(spark, sf), "missing_values")
    rows = [(r.severity, p["column"], p["null_count"], p["null_percentage"]) for p in r.payload["per_column"]]
    return spark.createDataFrame(rows, "severity string, column string, null_count long, null_percentage double")


@query("SELECT CASE WHEN n > 0 THEN 'warn' ELSE 'ok' END AS severity, n AS total_duplicate_rows FROM (SELECT coalesce(sum(k), 0)::BIGINT AS n FROM (SELECT count(*) AS k FROM documents GROUP BY text, lang HAVING count(*) > 1))")
def check_duplicates(spark, sf):
    r = run_check(table(spark, sf, "documents"), "duplicates", duplicate_subset=["text", "lang"])
    return spark.createDataFrame([(r.severity, r.payload["total_duplicate_rows"])], "severity string, total_duplicate_rows long")


def _typed_sql(cols: list[str], source: str, name: str, names: dict[str, str]) -> str:
    case = "CASE any_value(typeof({c})) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", {case.format(c=c)} AS {name} FROM {source}""" for c in cols)


@query(_typed_sql(_LI, "lineitem", "dtype", {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "TIMESTAMP": "timestamp_ntz"}))
def check_data_types(spark, sf):
    r = run_check(table(spark, sf, "lineitem").select(*_LI), "data_types")
    return spark.createDataFrame(list(r.payload["per_column"].items()), "column string, dtype string")


@query(_typed_sql(_LI, "lineitem", "family", {"BIGINT": "integer", "INTEGER": "integer", "DOUBLE": "float", "VARCHAR": "string", "DATE": "date", "TIMESTAMP": "datetime"}))
def column_families(spark, sf):
    schema = table(spark, sf, "lineitem").select(*_LI).schema
    return spark.createDataFrame([(f.name, family(f.dataType)) for f in schema], "column string, family string")


@query(f"SELECT CASE WHEN sum(outlier_count) OVER () > 0 THEN 'warn' ELSE 'ok' END AS severity, * FROM ({_outlier_sql(['value', 'user_id'], KEYED, 0.5)})")
def check_outliers(spark, sf):
    r = run_check(dirty_events(spark, sf).select("value", "user_id"), "outliers", outlier_iqr_multiplier=0.5)
    rows = [(r.severity, p["column"], float(p["lower_bound"]), float(p["upper_bound"]), p["outlier_count"]) for p in r.payload["per_column"]]
    return spark.createDataFrame(rows, "severity string, column string, lower_bound double, upper_bound double, outlier_count long")


@query(
    """SELECT 'error' AS severity, 'l_quantity' AS "column", count(*) FILTER (nullif(l_quantity, 1) < 5 OR nullif(l_quantity, 1) > 45) AS violation_count, NULL::VARCHAR AS note FROM lineitem
UNION ALL SELECT 'error', 'l_linestatus', 0, 'column is not numeric' UNION ALL SELECT 'error', 'no_such_column', 0, 'column not found'"""
)
def check_ranges(spark, sf):
    wanted = {"l_quantity": ColumnRange(5, 45), "l_linestatus": ColumnRange(0, 1), "no_such_column": ColumnRange(0, 1)}
    r = run_check(dirty_lineitem(spark, sf), "ranges", column_ranges=wanted)
    rows = [(r.severity, p["column"], p["violation_count"], p.get("note")) for p in r.payload["per_column"]]
    return spark.createDataFrame(rows, "severity string, column string, violation_count long, note string")


_DISTINCT = " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_count, count(*) AS n FROM {KEYED}""" for c in ("event_id", "value", "user_id", "event_type"))


@query(f"""SELECT "column", distinct_count, round(distinct_count::DOUBLE / n, 6) AS unique_ratio FROM ({_DISTINCT})""")
def check_cardinality(spark, sf):
    r = run_check(dirty_events(spark, sf), "cardinality")
    return spark.createDataFrame([(p["column"], p["distinct_count"], p["unique_ratio"]) for p in r.payload["per_column"]], "column string, distinct_count long, unique_ratio double")


@query(
    """SELECT CASE WHEN age > 48 THEN 'error' ELSE 'ok' END AS severity, 'ts' AS "column", round(age, 3) AS age_hours, age > 48 AS is_stale, age < 0 AS is_future
FROM (SELECT (epoch_us(TIMESTAMP '2030-01-01 00:00:00') - epoch_us(max(ts))) / 3600000000.0::DOUBLE AS age FROM events)"""
)
def check_freshness(spark, sf):
    r = run_check(table(spark, sf, "events"), "freshness", now=datetime(2030, 1, 1, tzinfo=UTC), freshness_columns=["ts"], freshness_max_age_hours=48, freshness_timezone="UTC")
    rows = [(r.severity, p["column"], p["age_hours"], p["is_stale"], p["is_future"]) for p in r.payload["per_column"]]
    return spark.createDataFrame(rows, "severity string, column string, age_hours double, is_stale boolean, is_future boolean")


@query(
    f"""SELECT 'schema' AS rule, 'schema' AS kind, 1::BIGINT AS violation_count
UNION ALL SELECT 'below', 'comparison', count(*) FROM {KEYED} WHERE value IS NOT NULL AND NOT (value <= 50)
UNION ALL SELECT 'ordered', 'comparison', count(*) FROM {KEYED} WHERE NOT coalesce(value >= user_id, false)
UNION ALL SELECT 'known', 'foreign_key', count(*) FROM {KEYED} WHERE user_id IS NOT NULL AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 0)
UNION ALL SELECT 'unbound', 'foreign_key', 1"""
)
def check_quality_contract(spark, sf):
    pack = QualityContract(
        "events",
        [ComparisonRule("below", "value", "le", right_value=50), ComparisonRule("ordered", "value", "ge", right_column="user_id", nulls_pass=False)],
        [ForeignKeyRule("known", ["user_id"], "customers", ["c_custkey"]), ForeignKeyRule("unbound", ["user_id"], "nothing", ["id"])],
        SchemaPolicy({"event_id": "bigint", "value": "double", "user_id": "bigint"}),
    )
    r = run_check(dirty_events(spark, sf), "quality_contract", {"customers": table(spark, sf, "customer").where("c_custkey % 7 <> 0")}, rule_packs=[pack])
    return spark.createDataFrame([(f["rule"], f["kind"], f["violation_count"]) for f in r.payload["findings"]], "rule string, kind string, violation_count long")


@query("SELECT CASE WHEN n > 100 THEN 'warn' ELSE 'ok' END AS severity, n AS large_orders FROM (SELECT count(*) FILTER (o_totalprice > 300000) AS n FROM orders)")
def check_registered(spark, sf):
    def large_orders(ctx):
        n = ctx.df.where("o_totalprice > 300000").count()
        return ("warn" if n > 100 else "ok"), {"large_orders": n}

    register_check("large_orders", large_orders)
    try:
        r = run_check(table(spark, sf, "orders"), "large_orders", registered_checks=["large_orders"])
    finally:
        unregister_check("large_orders")
    return spark.createDataFrame([(r.severity, r.payload["large_orders"])], "severity string, large_orders long")


@query(
    f"""WITH s AS (SELECT 'dataset_contract' AS "check", 'ok' AS severity UNION ALL
SELECT 'missing_values', CASE WHEN greatest(count(*) FILTER (value IS NULL), count(*) FILTER (user_id IS NULL), count(*) FILTER (event_type IS NULL)) * 2 > count(*) THEN 'error' WHEN count(value) < count(*) OR count(user_id) < count(*) OR count(event_type) < count(*) THEN 'warn' ELSE 'ok' END FROM {KEYED} UNION ALL
SELECT 'duplicates', CASE WHEN count(*) > count(DISTINCT event_id) THEN 'warn' ELSE 'ok' END FROM {KEYED} UNION ALL
SELECT 'ranges', CASE WHEN count(*) FILTER (value < 0 OR value > 90) > 0 THEN 'error' ELSE 'ok' END FROM {KEYED})
SELECT "check", severity, (SELECT CASE WHEN bool_or(severity = 'error') THEN 1 ELSE 0 END FROM s)::INTEGER AS exit_code FROM s"""
)
def report_round_trip(spark, sf):
    on = {s: s in ("missing_values", "duplicates", "ranges") for s in _SWITCHES}
    checks = CheckConfig(**on, duplicate_subset=["event_id"], column_ranges={"value": ColumnRange(0, 90)})
    report = DataQualityChecker(dirty_events(spark, sf), Config(checks=checks)).run()
    again = QualityReport.from_json(report.to_json())
    return spark.createDataFrame([(r.name, r.severity, again.exit_code()) for r in again.results], "check string, severity string, exit_code int")


# --- linkage: guards, fit, summaries ------------------------------------------------------------------------

_BLOCKS = (("c_nationkey", "c_mktsegment"),)
_STEPS = 3


def _link_config(**more) -> LinkConfig:
    return LinkConfig("c_custkey", (ExactMatch("digit"), NumericDiff("c_acctbal", (50.5, 500.5))), _BLOCKS, **more)


def _digits(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").withColumn("digit", F.col("c_custkey") % 10)


def _em_sql(steps: int) -> str:
    """Expectation maximisation unrolled: patterns p, then for each step posteriors r, share s and tables t."""
    c0 = "CASE WHEN a.c_custkey % 10 = b.c_custkey % 10 THEN 2 ELSE 1 END"
    parts = [
        f"p AS (SELECT {c0} AS x, {_L_NUM} AS y, count(*)::DOUBLE AS w FROM {_PAIRS} GROUP BY ALL)",
        "l(c, v, start) AS (VALUES (0, 1, 0.25::DOUBLE), (0, 2, 0.7), (1, 1, 0.125), (1, 2, 0.125), (1, 3, 0.7))",
        "s0 AS (SELECT 0.001::DOUBLE AS share)",
        f"""t0 AS (SELECT c, v, start / sum(start) OVER (PARTITION BY c) AS m, n / sum(n) OVER (PARTITION BY c) AS u
FROM (SELECT c, v, start, {PSEUDOCOUNT} + coalesce((SELECT sum(w) FROM p WHERE CASE c WHEN 0 THEN x ELSE y END = v), 0) AS n FROM l))""",
    ]
    for k in range(1, steps + 1):
        parts += [
            f"""r{k} AS (SELECT x, y, w, w / (1 + exp(-(ln(share) - ln(1 - share) + ln(a.m) - ln(a.u) + ln(b.m) - ln(b.u)))) AS r
FROM p, s{k - 1}, t{k - 1} a, t{k - 1} b WHERE a.c = 0 AND a.v = x AND b.c = 1 AND b.v = y)""",
            f"s{k} AS (SELECT (sum(r) + 0.5) / (sum(w) + 1) AS share FROM r{k})",
            f"""t{k} AS (SELECT c, v, m / sum(m) OVER (PARTITION BY c) AS m, u / sum(u) OVER (PARTITION BY c) AS u FROM (SELECT c, v,
{PSEUDOCOUNT} + coalesce((SELECT sum(r) FROM r{k} WHERE CASE c WHEN 0 THEN x ELSE y END = v), 0) AS m,
{PSEUDOCOUNT} + coalesce((SELECT sum(w - r) FROM r{k} WHERE CASE c WHEN 0 THEN x ELSE y END = v), 0) AS u FROM l))""",
        ]
    return "WITH " + ", ".join(parts)


@query(f"""{_em_sql(_STEPS)} SELECT CASE c WHEN 0 THEN 'digit' ELSE 'c_acctbal' END AS "column", v::INTEGER AS level, round(m, 9) AS m, round(u, 9) AS u, round(share, 9) AS share FROM t{_STEPS}, s{_STEPS}""")
def em_steps(spark, sf):
    f = fit_pairs(_digits(spark, sf), _link_config(em_max_iter=_STEPS, em_tolerance=1e-300)).fit
    rows = [(c, v, round(float(f.m[i][v]), 9), round(float(f.u[i][v]), 9), round(f.match_share, 9)) for i, c in enumerate(("digit", "c_acctbal")) for v in range(1, len(f.m[i]))]
    return spark.createDataFrame(rows, "column string, level int, m double, u double, share double")


_BOUND = "(SELECT (sum(n * (n - 1)) // 2)::BIGINT AS pairs FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment))"


@query(f"SELECT cap, pairs > cap AS refused, CASE WHEN pairs > cap THEN NULL ELSE pairs END AS pairs FROM {_BOUND}, (VALUES (10::BIGINT), (50000000)) v(cap)")
def link_guard(spark, sf):
    rows = []
    for cap in (10, 50_000_000):
        try:
            rows.append((cap, False, sum(w.pairs for w in guard(_digits(spark, sf), _link_config(max_pairs_warning=min(cap, 5_000_000), max_pairs_hard_cap=cap), None))))
        except MemoryError:
            rows.append((cap, True, None))
    return spark.createDataFrame(rows, "cap long, refused boolean, pairs long")


@query(
    f"""SELECT 'event_id' AS id, 'valid' AS outcome UNION ALL SELECT 'user_id', 'left input has ' || count(*) FILTER (user_id IS NULL) || ' missing, blank or infinite ids' FROM {DIRTY}
UNION ALL SELECT 'day', 'left ids are not unique' UNION ALL SELECT 'nothing', 'left input lacks columns [''nothing'']'"""
)
def link_validation(spark, sf):
    e = dirty_events(spark, sf).withColumn("day", F.col("event_id") % 7)
    rows = []
    for name in ("event_id", "user_id", "day", "nothing"):
        try:
            validate(e, LinkConfig(name, (NumericDiff("value", (1.0,)),)))
            rows.append((name, "valid"))
        except ValueError as error:
            rows.append((name, str(error)))
    return spark.createDataFrame(rows, "id string, outcome string")


def _summary(result) -> tuple:
    s = result.summary()
    return s["candidate_pairs"], s["matched_pairs"], s["clusters"], s["fit_status"]


@query(
    f"""SELECT 'no information' AS input, pairs AS candidate_pairs, 0::BIGINT AS matched_pairs, 'rejected' AS fit_status FROM {_BOUND}
UNION ALL SELECT 'no candidates', 0, 0, 'not_fitted'"""
)
def link_without_fit(spark, sf):
    c = table(spark, sf, "customer").withColumn("one", F.lit("x"))
    same = fit_pairs(c, LinkConfig("c_custkey", (ExactMatch("one"),), _BLOCKS))
    lone = fit_pairs(c, LinkConfig("c_custkey", (ExactMatch("one"),), (("c_name",),)))
    rows = [(n, a, b, s) for n, (a, b, _, s) in (("no information", _summary(same)), ("no candidates", _summary(lone)))]
    return spark.createDataFrame(rows, "input string, candidate_pairs long, matched_pairs long, fit_status string")


# --- consolidation -------------------------------------------------------------------------------------------

_COLUMNS = ("c_custkey", "c_name", "seg", "c_acctbal", "prio")


@query(f"SELECT {', '.join(_COLUMNS)} FROM {_RANKED} WHERE rk = 1")
def merge_survivor(spark, sf):
    df, c = groups(spark, sf)
    return merge.consolidate(df, "c_custkey", c, _merge_config()).frame.select(*_COLUMNS)


@query(
    f"""SELECT arg_min(c_custkey, rk) AS c_custkey, arg_min(c_name, rk) FILTER (c_name IS NOT NULL) AS c_name, arg_min(seg, rk) FILTER (trim(seg) <> '') AS seg, arg_min(c_acctbal, rk) FILTER (c_acctbal IS NOT NULL) AS c_acctbal, arg_min(prio, rk) AS prio
FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY (c_name IS NOT NULL)::INT + coalesce(trim(seg) <> '', false)::INT + (c_acctbal IS NOT NULL)::INT DESC, c_custkey) AS rk FROM {_GROUPS}) GROUP BY cluster_id"""
)
def merge_defaults(spark, sf):
    df, c = groups(spark, sf)
    return merge.consolidate(df, "c_custkey", c, merge.default_merge(df, "c_custkey")).frame.select(*_COLUMNS)


@query(
    f"""SELECT sum(n)::BIGINT AS input_records, count(*) AS output_records, (sum(n) - count(*))::BIGINT AS removed_records, count(*) AS clusters, count(*) FILTER (n > 1 AND k > 1) AS conflicts, count(*) FILTER (n > 1 AND changed) AS changes
FROM (SELECT count(*) AS n, count(DISTINCT seg) FILTER (trim(seg) <> '') AS k, coalesce(arg_min(c_custkey, rk) FILTER (trim(seg) <> '') <> arg_min(c_custkey, rk), false) AS changed FROM {_RANKED} GROUP BY cluster_id)"""
)
def merge_summary(spark, sf):
    df, c = groups(spark, sf)
    s = merge.consolidate(df, "c_custkey", c, _merge_config(seg=merge.MergeRule("first_non_null"))).summary()
    return spark.createDataFrame([tuple(s.values())], ", ".join(f"{k} long" for k in s))


# --- sources and entities --------------------------------------------------------------------------------------


@query("SELECT o_orderstatus, count(*) AS orders, min(o_orderkey) AS first_key FROM orders GROUP BY o_orderstatus")
def load_parquet(spark, sf):
    return load(f"{sf}/orders.parquet", spark).frame.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("orders"), F.min("o_orderkey").alias("first_key"))


_TEXTS = ("SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment || '\"; ' END AS seg FROM customer")


def _texts(spark, sf) -> DataFrame:
    seg = F.when(F.col("c_custkey") % 5 != 0, F.concat("c_mktsegment", F.lit('"; ')))
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", seg.alias("seg"))


@query(_TEXTS)
def load_csv(spark, sf):
    path = new_path(spark, "csv")
    _texts(spark, sf).write.options(header=True, escape='"', ignoreTrailingWhiteSpace=False).csv(path)
    return load(path, spark).frame.withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query(_TEXTS)
def load_jsonl(spark, sf):
    path = new_path(spark, "jsonl")
    _texts(spark, sf).write.option("ignoreNullFields", False).json(path)
    return read_jsonl(spark, path)


@query("SELECT DISTINCT CASE c_custkey % 4 WHEN 0 THEN 'duplicate key' WHEN 1 THEN 'NaN is no JSON number' WHEN 2 THEN 'not an object' END AS problem FROM customer WHERE c_custkey % 4 < 3")
def jsonl_problems(spark, sf):
    k = F.col("c_custkey") % 4
    line = F.when(k == 0, '{"a": 1, "a": 2}').when(k == 1, '{"a": NaN}').when(k == 2, "[1]").otherwise('{"a": 1}')
    path = new_path(spark, "jsonl")
    table(spark, sf, "customer").select(line.alias("value")).write.text(path)
    return jsonl_facts(spark, path).where("problem is not null").select("problem").distinct()


@query("SELECT '[\"a\", \"b\"]' AS header, CASE WHEN count(*) FILTER (c_custkey % 50 = 0) > 0 THEN 'ragged row' END AS problem FROM customer")
def csv_ragged(spark, sf):
    path = new_path(spark, "csv")
    rows = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 50 == 0, "1,2,3").otherwise("1,2").alias("value"))
    head = spark.createDataFrame([(-1, "a,b")], "k long, value string")
    head.union(rows).coalesce(1).sortWithinPartitions("k").select("value").write.text(path)
    return csv_problems(spark, path).select("header", "problem")


@query("SELECT count(*) AS rows, count(*) FILTER (doc_id % 9 = 0) AS skipped_null_texts, coalesce(sum(len(regexp_extract_all(text, '[A-Z][a-z]{11,}'))) FILTER (doc_id % 9 <> 0), 0)::BIGINT AS entities FROM documents")
def entities_audit(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 9 != 0, F.col("text")).alias("text"))
    a = entities.audit(d, entities.PatternRecognizer({"WORD": "[A-Z][a-z]{11,}"}), id_col="doc_id")
    return spark.createDataFrame([(a["rows"], a["skipped_null_texts"], a["entities"])], "rows long, skipped_null_texts long, entities long")
