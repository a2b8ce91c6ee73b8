"""One query for each operator over the driver's tables, and the SQL that gives the same rows.

The tables are clean, so NULLs, NaNs and broken references are derived by rule, alike in both."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.columns import matches_family, normalize_nested
from lodestone.functions.strings import StringNormalization, normalize
from lodestone.operators import contracts, entities, merge, profile
from lodestone.operators.blocking import candidates, candidates_of, pair_bounds
from lodestone.operators.fellegi_sunter import Fit
from lodestone.operators.levels import ExactMatch, FuzzyString, NumericDiff, with_levels
from lodestone.operators.linkage import LinkConfig, cluster, cluster_sizes, counted_patterns, evaluate, fit_pairs, label_clusters, levelled_pairs, score_matches, score_pairs, scored_pairs

QUERIES, ORACLE_SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- derived tables ---------------------------------------------------------------------------


def dirty_events(spark, sf) -> DataFrame:
    """event_id, value with NULL for event_id % 101 = 0 and NaN for % 97 = 0, user_id NULL for % 13 = 0, type NULL for 'view'."""
    e = table(spark, sf, "events")
    value = F.when(F.col("event_id") % 101 == 0, None).when(F.col("event_id") % 97 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return e.select("event_id", value.alias("value"), F.when(F.col("event_id") % 13 != 0, F.col("user_id")).alias("user_id"), F.when(F.col("event_type") != "view", F.col("event_type")).alias("event_type"))


DIRTY = """(SELECT event_id, CASE WHEN event_id % 101 = 0 THEN NULL WHEN event_id % 97 = 0 THEN 'nan'::DOUBLE ELSE value END AS value,
  CASE WHEN event_id % 13 <> 0 THEN user_id END AS user_id, CASE WHEN event_type <> 'view' THEN event_type END AS event_type FROM events)"""
KEYED = f"(SELECT event_id, CASE WHEN isnan(value) THEN NULL ELSE value END AS value, user_id, event_type FROM {DIRTY})"


def dirty_lineitem(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.nullif("l_quantity", F.lit(1.0)).alias("l_quantity"), "l_extendedprice", "l_discount", "l_tax", F.nullif("l_returnflag", F.lit("R")).alias("l_returnflag"), "l_linestatus", "l_shipdate")


# --- structure and counts -----------------------------------------------------------------------


@query("SELECT count(*)::BIGINT AS row_count FROM lineitem")
def row_count(spark, sf):
    return profile.row_count(table(spark, sf, "lineitem"))


@query(
    """SELECT t AS dtype, count(*) AS columns FROM (SELECT CASE data_type WHEN 'INTEGER' THEN 'int' WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE lower(data_type) END AS t
FROM information_schema.columns WHERE table_name = 'lineitem') GROUP BY t"""
)
def dtype_inventory(spark, sf):
    return profile.dtype_inventory(table(spark, sf, "lineitem"))


@query(
    f"""SELECT 'event_id' AS "column", count(*) FILTER (event_id IS NULL) AS null_count, count(*) AS row_count FROM {KEYED}
UNION ALL SELECT 'value', count(*) FILTER (value IS NULL), count(*) FROM {KEYED}
UNION ALL SELECT 'user_id', count(*) FILTER (user_id IS NULL), count(*) FROM {KEYED}
UNION ALL SELECT 'event_type', count(*) FILTER (event_type IS NULL), count(*) FROM {KEYED}"""
)
def missing_values(spark, sf):
    return profile.null_counts(dirty_events(spark, sf))


@query(
    f"""SELECT 'event_id' AS "column", count(DISTINCT event_id) AS distinct_count FROM {KEYED} UNION ALL SELECT 'value', count(DISTINCT value) FROM {KEYED}
UNION ALL SELECT 'user_id', count(DISTINCT user_id) FROM {KEYED} UNION ALL SELECT 'event_type', count(DISTINCT event_type) FROM {KEYED}"""
)
def cardinality(spark, sf):
    return profile.distinct_counts(dirty_events(spark, sf))


_LI = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(DISTINCT {c}) AS distinct_count FROM lineitem""" for c in _LI))
def cardinality_wide(spark, sf):
    return profile.distinct_counts(table(spark, sf, "lineitem"), _LI)


_SIXTY = [f"(l_orderkey * {i + 1} + l_partkey) % {1000 + i}" for i in range(60)]


@query(f"""SELECT "column", distinct_count FROM (UNPIVOT (SELECT {', '.join(f'count(DISTINCT {e}) AS c{i}' for i, e in enumerate(_SIXTY))} FROM lineitem) ON COLUMNS(*) INTO NAME "column" VALUE distinct_count)""")
def cardinality_60_columns(spark, sf):
    return profile.distinct_counts(table(spark, sf, "lineitem").select(*[F.expr(e).alias(f"c{i}") for i, e in enumerate(_SIXTY)]))


@query("SELECT props AS value, count(*) AS count FROM events GROUP BY props ORDER BY count DESC, value LIMIT 10")
def top_values(spark, sf):
    return profile.top_values(table(spark, sf, "events"), "props")


@query("SELECT l_shipdate::VARCHAR AS value, count(*) AS count FROM lineitem GROUP BY l_shipdate ORDER BY count DESC, value LIMIT 10")
def top_values_dates(spark, sf):
    return profile.top_values(table(spark, sf, "lineitem"), "l_shipdate")


def _quantile_sql(cols: list[str], qs: list[float], source: str) -> str:
    return " UNION ALL ".join(f"""SELECT '{c}' AS "column", {q}::DOUBLE AS quantile, quantile_cont({c}::DOUBLE, {q}) AS value FROM {source}""" for c in cols for q in qs)


@query(_quantile_sql(["l_quantity", "l_extendedprice", "l_discount"], [0.05, 0.25, 0.5, 0.75, 0.95], "(SELECT nullif(l_quantity, 1) AS l_quantity, l_extendedprice, l_discount FROM lineitem)"))
def quantiles(spark, sf):
    return profile.quantiles(dirty_lineitem(spark, sf), ["l_quantity", "l_extendedprice", "l_discount"], [0.05, 0.25, 0.5, 0.75, 0.95])


@query()
def quantiles_approximate(spark, sf):
    return profile.quantiles(dirty_lineitem(spark, sf), ["l_quantity", "l_extendedprice"], [0.25, 0.75], approximate=True)


def _outlier_sql(cols: list[str], source: str, k: float) -> str:
    one = """SELECT '{c}' AS "column", lo AS lower_bound, hi AS upper_bound, (SELECT count(*) FROM {s} WHERE {c} < lo OR {c} > hi) AS outlier_count
FROM (SELECT q1 - {k} * (q3 - q1) AS lo, q3 + {k} * (q3 - q1) AS hi FROM (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {s}))"""
    return " UNION ALL ".join(one.format(c=c, s=source, k=k) for c in cols)


@query(_outlier_sql(["value", "user_id"], KEYED, 0.5))
def outliers_iqr(spark, sf):
    return profile.outliers(dirty_events(spark, sf), ["value", "user_id"], 0.5)


@query("SELECT o_orderkey, o_totalprice FROM orders, (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3 FROM orders) WHERE o_totalprice < q1 - 0.3 * (q3 - q1) OR o_totalprice > q3 + 0.3 * (q3 - q1)")
def outlier_rows(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    f = profile.fences(o, ["o_totalprice"], 0.3)
    return o.join(F.broadcast(f), (F.col("o_totalprice") < F.col("lower_bound")) | (F.col("o_totalprice") > F.col("upper_bound"))).select("o_orderkey", "o_totalprice")  # one row


@query("SELECT coalesce(sum(n), 0)::BIGINT AS duplicate_count FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)")
def duplicates_subset(spark, sf):
    return profile.duplicate_count(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT coalesce(sum(n), 0)::BIGINT AS duplicate_count FROM (SELECT count(*) AS n FROM documents GROUP BY text, lang HAVING count(*) > 1)")
def duplicates_all(spark, sf):
    return profile.duplicate_count(table(spark, sf, "documents").select("text", "lang"))


@query(f"SELECT coalesce(sum(n), 0)::BIGINT AS duplicate_count FROM (SELECT count(*) AS n FROM (SELECT CASE WHEN event_id % 3 = 0 THEN value END AS v, event_type FROM {KEYED}) GROUP BY v, event_type HAVING count(*) > 1)")
def duplicate_null_nan_key(spark, sf):
    d = dirty_events(spark, sf)
    v = F.when(F.col("event_id") % 3 == 0, F.col("value")).when(F.col("event_id") % 3 == 1, F.lit(float("nan")))
    return profile.duplicate_count(d.select(v.alias("v"), "event_type"))


_DEALT = ["l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@query(f"SELECT coalesce(sum(n), 0)::BIGINT AS duplicate_count FROM (SELECT count(*) AS n FROM lineitem GROUP BY {', '.join(_DEALT)} HAVING count(*) > 1)")
def duplicates_wide_keys(spark, sf):
    return profile.duplicate_count(table(spark, sf, "lineitem"), _DEALT)


@query("SELECT coalesce(sum(n), 0)::BIGINT AS duplicate_count FROM (SELECT *, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1)")
def duplicates_whole_rows(spark, sf):
    return profile.duplicate_count(table(spark, sf, "lineitem"))


@query("SELECT doc_id, text, lang FROM documents QUALIFY count(*) OVER (PARTITION BY text, lang) > 1")
def duplicate_documents(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "documents").select("doc_id", "text", "lang"), ["text", "lang"])


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) > 1")
def duplicate_rows(spark, sf):
    return profile.duplicate_rows(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), ["l_orderkey", "l_linenumber"])


_BOUNDS = {"l_quantity": (5, 45), "l_extendedprice": (1000.0, 50000.0), "l_discount": (0.0, 0.05)}


@query(" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER (nullif({c}, 1) < {a} OR nullif({c}, 1) > {b}) AS violation_count FROM lineitem""" for c, (a, b) in _BOUNDS.items()))
def ranges(spark, sf):
    return profile.counts_outside(dirty_lineitem(spark, sf), _BOUNDS)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 20000 OR o_totalprice > 400000")
def range_rows(spark, sf):
    return profile.rows_outside(table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 20000.0, 400000.0)


@query(f"""SELECT 'value' AS "column", count(*) FILTER (value < 10 OR value > 60) AS violation_count FROM {KEYED}""")
def ranges_nan(spark, sf):
    return profile.counts_outside(dirty_events(spark, sf), {"value": (10, 60)})


@query("SELECT max(ts) AS max_datetime FROM events")
def freshness_max(spark, sf):
    return profile.max_datetime(table(spark, sf, "events"), "ts")


@query("SELECT epoch_us(max(ts) AT TIME ZONE 'America/New_York')::BIGINT AS max_instant_micros, 0::BIGINT AS invalid_count FROM events")
def freshness_zoned(spark, sf):
    return profile.max_instant(table(spark, sf, "events"), "ts", "America/New_York")


_OFFSETS = {0: "+14:00", 1: "-12:00", 2: "Z", 3: "+0530"}


@query(
    """SELECT max(epoch_us(t))::BIGINT AS max_instant_micros, count(*) FILTER (event_id % 50 = 7) AS invalid_count FROM (SELECT event_id, CASE WHEN event_id % 50 = 7 THEN NULL
ELSE (strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE event_id % 4 WHEN 0 THEN '+14:00' WHEN 1 THEN '-12:00' WHEN 2 THEN '+00:00' ELSE '+05:30' END)::TIMESTAMPTZ END AS t FROM events)"""
)
def freshness_string_offsets(spark, sf):
    e = table(spark, sf, "events")
    off = F.element_at(F.create_map(*[F.lit(x) for kv in _OFFSETS.items() for x in kv]), (F.col("event_id") % 4).cast("int"))
    text = F.when(F.col("event_id") % 50 == 7, F.lit("not a time")).otherwise(F.concat(F.lit(" "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), off, F.lit("\t")))
    return profile.max_instant(e.select(text.alias("t")), "t", "UTC")


@query("SELECT count(*) AS row_count, (count(*) < 1)::BIGINT AS too_few, 1::BIGINT AS missing_required, 1::BIGINT AS dtype_mismatches FROM orders")
def dataset_contract(spark, sf):
    o = table(spark, sf, "orders")
    need, expected = ["o_orderkey", "no_such_column"], {"o_orderkey": "integer", "o_totalprice": "double", "o_orderstatus": "numeric", "o_orderdate": "datetime"}
    types = {f.name: f.dataType for f in o.schema}
    wrong = sum(not matches_family(types[c], e) for c, e in expected.items())
    lost = sum(c not in types for c in need)
    return o.agg(F.count(F.lit(1)).alias("row_count")).select("row_count", (F.col("row_count") < 1).cast("long").alias("too_few"), F.lit(lost).cast("long").alias("missing_required"), F.lit(wrong).cast("long").alias("dtype_mismatches"))


# --- contracts --------------------------------------------------------------------------------------

_SIGNS = {"eq": "=", "ne": "<>", "gt": ">", "ge": ">=", "lt": "<", "le": "<="}


def _compare(op: str):
    def run(spark, sf):
        return contracts.comparison_count(dirty_lineitem(spark, sf), left="l_quantity", operator=op, right_column="l_linenumber")

    run.__name__ = f"contract_compare_{op}"
    query(f"SELECT count(*) AS violation_count FROM (SELECT nullif(l_quantity, 1) AS q, l_linenumber AS n FROM lineitem) WHERE q IS NOT NULL AND NOT coalesce(q {_SIGNS[op]} n, false)")(run)


for _op in _SIGNS:
    _compare(_op)


@query(f"SELECT count(*) AS violation_count FROM {KEYED} WHERE NOT coalesce(value >= user_id, false)")
def contract_nulls_fail(spark, sf):
    return contracts.comparison_count(dirty_events(spark, sf), left="value", operator="ge", right_column="user_id", nulls_pass=False)


@query(f"SELECT count(*) AS violation_count FROM {KEYED} WHERE value IS NOT NULL AND NOT (value <= 50)")
def contract_literal(spark, sf):
    return contracts.comparison_count(dirty_events(spark, sf), left="value", operator="le", right_value=50)


@query("SELECT count(*) AS violation_count FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 7 <> 0)")
def contract_fk(spark, sf):
    return contracts.foreign_key_count(table(spark, sf, "orders"), ["o_custkey"], table(spark, sf, "customer").where("c_custkey % 7 <> 0"), ["c_custkey"])


_FK = "(SELECT l_orderkey AS a, CASE WHEN l_linenumber % 5 <> 0 THEN l_suppkey END AS b FROM lineitem)"
_FKR = "(SELECT l_orderkey AS x, CASE WHEN l_orderkey % 11 <> 0 THEN l_suppkey END AS y FROM lineitem WHERE l_orderkey % 3 <> 0)"


def _fk_frames(spark, sf):
    li = table(spark, sf, "lineitem")
    src = li.select(F.col("l_orderkey").alias("a.b"), F.when(F.col("l_linenumber") % 5 != 0, F.col("l_suppkey")).alias("b"))
    ref = li.where("l_orderkey % 3 <> 0").select(F.col("l_orderkey").alias("x"), F.when(F.col("l_orderkey") % 11 != 0, F.col("l_suppkey")).alias("y`"))
    return src, ref


@query(f"SELECT count(*) AS violation_count FROM {_FK} WHERE b IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {_FKR} WHERE x = a AND y = b)")
def contract_fk_composite(spark, sf):
    src, ref = _fk_frames(spark, sf)
    return contracts.foreign_key_count(src, ["a.b", "b"], ref, ["x", "y`"])


@query(f"SELECT count(*) AS violation_count FROM {_FK} WHERE NOT EXISTS (SELECT 1 FROM {_FKR} WHERE x = a AND y = b)")
def contract_fk_nulls(spark, sf):
    src, ref = _fk_frames(spark, sf)
    return contracts.foreign_key_count(src, ["a.b", "b"], ref, ["x", "y`"], nulls_pass=False)


@query("SELECT doc_id, text FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def contract_fk_rows(spark, sf):
    return contracts.foreign_key_violations(table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], table(spark, sf, "labels"), ["doc_id"])


@query("SELECT 'addition' AS kind, 'p_type' AS \"column\", NULL::VARCHAR AS expected, NULL::VARCHAR AS actual UNION ALL SELECT 'removal', 'p_comment', NULL, NULL UNION ALL SELECT 'type_change', 'p_size', 'bigint', 'int'")
def schema_policy(spark, sf):
    expected = {"p_partkey": "BIGINT", "p_name": "string", "p_brand": "string", "p_size": "bigint", "p_retailprice": "double", "p_comment": "string"}
    return contracts.schema_policy(table(spark, sf, "part"), expected)


@query("SELECT vec_id, label, (length(array_to_string(embedding, ',')) > 0) AS has_text, len(embedding)::INTEGER AS n FROM embeddings")
def nested_json(spark, sf):
    flat, _ = normalize_nested(table(spark, sf, "embeddings"), allow=True)
    return flat.select("vec_id", "label", (F.length("embedding") > 2).alias("has_text"), F.json_array_length("embedding").alias("n"))


# --- linkage -------------------------------------------------------------------------------------


@query("SELECT p_partkey, nullif(trim(regexp_replace(regexp_replace(lower(p_name || '  ' || p_brand), '[^a-z0-9 ]', '#', 'g'), '\\s+', ' ', 'g')), 'part#1 brand#11') AS name FROM part")
def normalize_strings(spark, sf):
    p = table(spark, sf, "part")
    opts = StringNormalization(null_tokens=("part#1 brand#11",), regex_replacements=(("[^A-Za-z0-9 ]", "#"),))
    return p.select("p_partkey", normalize(F.concat(F.col("p_name"), F.lit("  "), F.col("p_brand")), opts).alias("name"))


_CUST = "(SELECT c_custkey, c_name, c_nationkey, c_mktsegment, (c_acctbal / 100)::BIGINT AS bal FROM customer)"


def customers(spark, sf) -> DataFrame:
    return table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment", F.round(F.col("c_acctbal") / 100).cast("long").alias("bal"), "c_acctbal")


@query("""SELECT 0::INTEGER AS rule, (sum(n * (n - 1)) // 2)::BIGINT AS pairs FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey, c_mktsegment)
UNION ALL SELECT 1, coalesce(sum(n * (n - 1)) // 2, 0)::BIGINT FROM (SELECT count(*) AS n FROM customer GROUP BY c_name)""")
def blocking_bound(spark, sf):
    return pair_bounds(table(spark, sf, "customer"), [("c_nationkey", "c_mktsegment"), ("c_name",)])


@query("SELECT sum(a.n * b.n)::BIGINT AS pairs, 0::INTEGER AS rule FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY 1) a JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier GROUP BY 1) b USING (k)")
def blocking_bound_link(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return pair_bounds(c.select(F.col("c_nationkey").alias("k")), [("k",)], s.select(F.col("s_nationkey").alias("k")))


@query('SELECT a.c_custkey AS "__id_l__", b.c_custkey AS "__id_r__" FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey')
def blocking_pairs(spark, sf):
    return candidates(table(spark, sf, "customer"), "c_custkey", [("c_nationkey", "c_mktsegment")])


@query(f'SELECT a.c_custkey AS "__id_l__", b.c_custkey AS "__id_r__" FROM {_CUST} a JOIN {_CUST} b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey UNION SELECT a.c_custkey, b.c_custkey FROM (SELECT c_custkey, c_acctbal FROM customer) a JOIN (SELECT c_custkey, c_acctbal FROM customer) b ON floor(a.c_acctbal / 50) = floor(b.c_acctbal / 50) AND a.c_custkey < b.c_custkey')
def blocking_union(spark, sf):
    c = table(spark, sf, "customer").withColumn("band", F.floor(F.col("c_acctbal") / 50))
    return candidates(c, "c_custkey", [("c_nationkey", "c_mktsegment"), ("band",)])


@query('SELECT c_custkey AS "__id_l__", s_suppkey AS "__id_r__" FROM customer JOIN supplier ON c_nationkey = s_nationkey')
def blocking_link(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return candidates(c.select("c_custkey", F.col("c_nationkey").alias("k")), "c_custkey", [("k",)], right=s.select(F.col("s_suppkey").alias("c_custkey"), F.col("s_nationkey").alias("k")))


@query('SELECT a.s_suppkey AS "__id_l__", b.s_suppkey AS "__id_r__" FROM supplier a JOIN supplier b ON a.s_suppkey < b.s_suppkey')
def blocking_none(spark, sf):
    return candidates(table(spark, sf, "supplier"), "s_suppkey", [], max_pairs=10**12)


_HALF = "(SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN -1 ELSE c_nationkey END AS k FROM customer)"


@query(f'SELECT a.c_custkey AS "__id_l__", b.c_custkey AS "__id_r__", a.k AS k_l, b.k AS k_r FROM {_HALF} a JOIN {_HALF} b ON a.k = b.k AND a.c_custkey < b.c_custkey')
def blocking_hot_block(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, -1).otherwise(F.col("c_nationkey")).alias("k"))
    return candidates(c, "c_custkey", [("k",)], ["k"])


_PAIRS = "customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_mktsegment = b.c_mktsegment AND a.c_custkey < b.c_custkey"
_L_NUM = "CASE WHEN abs(a.c_acctbal - b.c_acctbal) <= 50.5 THEN 3 WHEN abs(a.c_acctbal - b.c_acctbal) <= 500.5 THEN 2 ELSE 1 END"
_L_FUZZY = "CASE WHEN jaro_winkler_similarity(a.c_name, b.c_name) >= 0.97 THEN 3 WHEN jaro_winkler_similarity(a.c_name, b.c_name) >= 0.93 THEN 2 ELSE 1 END"
_L_EXACT = "CASE WHEN a.c_custkey % 10 = b.c_custkey % 10 THEN 2 ELSE 1 END"
_SPECS = (ExactMatch("digit"), NumericDiff("c_acctbal", (50.5, 500.5)), FuzzyString("c_name", (0.93, 0.97)))


def levelled(spark, sf, specs=_SPECS) -> DataFrame:
    c = table(spark, sf, "customer").withColumn("digit", F.col("c_custkey") % 10)
    return levelled_pairs(c, "c_custkey", [("c_nationkey", "c_mktsegment")], specs)


@query(f'SELECT a.c_custkey AS "__id_l__", b.c_custkey AS "__id_r__", {_L_EXACT} AS level__digit FROM {_PAIRS}')
def levels_exact(spark, sf):
    return levelled(spark, sf, _SPECS[0:1]).select("__id_l__", "__id_r__", "level__digit")


@query(f'SELECT a.c_custkey AS "__id_l__", b.c_custkey AS "__id_r__", {_L_NUM} AS level__c_acctbal FROM {_PAIRS}')
def levels_numeric(spark, sf):
    return levelled(spark, sf, _SPECS[1:2]).select("__id_l__", "__id_r__", "level__c_acctbal")


@query(f'SELECT a.c_custkey AS "__id_l__", b.c_custkey AS "__id_r__", {_L_FUZZY} AS level__c_name FROM {_PAIRS}')
def levels_fuzzy(spark, sf):
    return levelled(spark, sf, _SPECS[2:3]).select("__id_l__", "__id_r__", "level__c_name")


@query(f"SELECT {_L_EXACT} AS level__digit, {_L_NUM} AS level__c_acctbal, {_L_FUZZY} AS level__c_name, count(*) AS n FROM {_PAIRS} GROUP BY ALL")
def level_patterns(spark, sf):
    c = table(spark, sf, "customer").withColumn("digit", F.col("c_custkey") % 10)
    return counted_patterns(c, "c_custkey", [("c_nationkey", "c_mktsegment")], _SPECS)


_M = {"digit": [0, 0.1, 0.9], "c_acctbal": [0, 0.1, 0.2, 0.7], "c_name": [0, 0.2, 0.3, 0.5]}
_U = {"digit": [0, 0.9, 0.1], "c_acctbal": [0, 0.85, 0.1, 0.05], "c_name": [0, 0.5, 0.3, 0.2]}


def _weight(level: str, name: str) -> str:
    return "CASE " + level + " " + " ".join(f"WHEN {i} THEN ln({_M[name][i]}::DOUBLE) - ln({_U[name][i]}::DOUBLE)" for i in range(1, len(_M[name]))) + " END"


_SCORES = f"""(SELECT "__id_l__", "__id_r__", 1 / (1 + exp(-(ln(0.01::DOUBLE) - ln(0.99::DOUBLE) + {_weight('d', 'digit')} + {_weight('n', 'c_acctbal')} + {_weight('f', 'c_name')}))) AS p
FROM (SELECT a.c_custkey AS "__id_l__", b.c_custkey AS "__id_r__", {_L_EXACT} AS d, {_L_NUM} AS n, {_L_FUZZY} AS f FROM {_PAIRS}))"""


_FIXED = LinkConfig("c_custkey", _SPECS, (("c_nationkey", "c_mktsegment"),))
_GRID = [(a, b, c) for a in (1, 2) for b in (1, 2, 3) for c in (1, 2, 3)]


def fixed_fit() -> Fit:
    return Fit([np.array(_M[c.column], float) for c in _SPECS], [np.array(_U[c.column], float) for c in _SPECS], 0.01)


def fixed_matches(spark, sf, threshold: float) -> DataFrame:
    c = table(spark, sf, "customer").withColumn("digit", F.col("c_custkey") % 10)
    pairs = candidates(c, "c_custkey", _FIXED.blocking_rules, [s.column for s in _SPECS])
    return score_matches(pairs, _FIXED, fixed_fit(), np.array(_GRID), threshold)


@query(f'SELECT "__id_l__", "__id_r__", round(p, 9) AS match_probability FROM {_SCORES}')
def pair_scores_fixed(spark, sf):
    c = table(spark, sf, "customer").withColumn("digit", F.col("c_custkey") % 10)
    return scored_pairs(c, _FIXED, fixed_fit(), np.array(_GRID), digits=9, keep_levels=False)


@query(f'SELECT "__id_l__", "__id_r__" FROM {_SCORES} WHERE p >= 0.3')
def match_filter(spark, sf):
    return fixed_matches(spark, sf, 0.3).select("__id_l__", "__id_r__")


@query()
def em_fit(spark, sf):
    c = table(spark, sf, "customer").withColumn("digit", F.col("c_custkey") % 10)
    return fit_pairs(c, LinkConfig("c_custkey", _SPECS, (("c_nationkey", "c_mktsegment"),))).pairs


@query(
    f"""WITH RECURSIVE m AS (SELECT "__id_l__" AS a, "__id_r__" AS b FROM {_SCORES} WHERE p >= 0.5), e AS (SELECT a, b FROM m UNION ALL SELECT b, a FROM m),
r AS (SELECT c_custkey AS id, c_custkey AS x FROM customer UNION SELECT r.id, e.b FROM r JOIN e ON r.x = e.a),
g AS (SELECT id, min(x) AS root FROM r GROUP BY id), n AS (SELECT root, row_number() OVER (ORDER BY min(id::VARCHAR)) - 1 AS cluster_id FROM g GROUP BY root)
SELECT id, cluster_id FROM g JOIN n USING (root)"""
)
def linkage_clusters(spark, sf):
    return cluster(table(spark, sf, "customer"), "c_custkey", fixed_matches(spark, sf, 0.5))


@query("SELECT count(*) AS duplicate_clusters, sum(n)::BIGINT AS records_in_duplicate_groups FROM (SELECT count(*) AS n FROM customer GROUP BY c_nationkey HAVING count(*) > 1)")
def linkage_sizes(spark, sf):
    return cluster_sizes(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("cluster_id")))


@query("SELECT doc_id AS id, dense_rank() OVER (ORDER BY first) - 1 AS cluster_id FROM (SELECT doc_id, min(doc_id::VARCHAR) OVER (PARTITION BY text) AS first FROM documents)")
def cluster_labels(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("root"))
    return label_clusters(d)


@query(
    f"""SELECT tp, fp, tn, fn, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall, CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1
FROM (SELECT count(*) FILTER (s AND t) AS tp, count(*) FILTER (s AND NOT t) AS fp, count(*) FILTER (NOT s AND NOT t) AS tn, count(*) FILTER (NOT s AND t) AS fn FROM
(SELECT coalesce(p, 0) >= 0.3 AS s, l.t FROM (SELECT a.c_custkey AS x, b.c_custkey AS y, (a.c_custkey + b.c_custkey) % 3 = 0 AS t FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey AND b.c_custkey - a.c_custkey < 60) l
LEFT JOIN {_SCORES} q ON q."__id_l__" = l.x AND q."__id_r__" = l.y))"""
)
def labeled_metrics(spark, sf):
    c = table(spark, sf, "customer").withColumn("digit", F.col("c_custkey") % 10)
    # ids less than 60 apart are in the same or in neighbouring bands of 60
    k, n, band = F.col("c_custkey"), F.col("c_nationkey"), F.floor(F.col("c_custkey") / 60)
    a = c.select(k.alias("__id_l__"), n.alias("n"), F.explode(F.array(band, band + 1)).alias("band"))
    b = c.select(k.alias("__id_r__"), n.alias("n"), band.alias("band"))
    labels = a.join(b, ["n", "band"]).where("__id_l__ < __id_r__ and __id_r__ - __id_l__ < 60").select("__id_l__", "__id_r__")
    pairs = candidates_of(labels, c, "c_custkey", _FIXED.blocking_rules, [s.column for s in _SPECS])
    scores = score_pairs(with_levels(pairs, _SPECS), _FIXED, fixed_fit(), np.array(_GRID))
    return evaluate(scores, labels.withColumn("is_match", (F.col("__id_l__") + F.col("__id_r__")) % 3 == 0), 0.3)


# --- consolidation -----------------------------------------------------------------------------------

_GROUPS = """(SELECT c_custkey, c_nationkey * 10 + ascii(c_mktsegment) % 10 AS cluster_id, CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS c_name, CASE WHEN c_custkey % 4 = 1 THEN ' ' WHEN c_custkey % 5 <> 0 THEN c_mktsegment || (c_custkey % 3)::VARCHAR END AS seg,
CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS c_acctbal, c_custkey % 6 AS prio FROM customer)"""
_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY prio DESC NULLS LAST, (c_name IS NOT NULL)::INT + (c_acctbal IS NOT NULL)::INT DESC, c_custkey) AS rk FROM {_GROUPS})"


def groups(spark, sf) -> tuple[DataFrame, DataFrame]:
    c, k = table(spark, sf, "customer"), F.col("c_custkey")
    seg = F.when(k % 4 == 1, F.lit(" ")).when(k % 5 != 0, F.concat("c_mktsegment", (k % 3).cast("string")))
    rows = c.select("c_custkey", F.when(k % 3 != 0, F.col("c_name")).alias("c_name"), seg.alias("seg"), F.when(k % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"), (k % 6).alias("prio"))
    return rows, c.select(k.alias("id"), (F.col("c_nationkey") * 10 + F.ascii("c_mktsegment") % 10).cast("long").alias("cluster_id"))


def _merge_config(**rules) -> merge.ConsolidationConfig:
    return merge.ConsolidationConfig((merge.SurvivorSortKey("prio", True),), ("c_name", "c_acctbal"), rules)


@query(f"SELECT cluster_id::BIGINT AS cluster_id, c_custkey AS survivor_id FROM {_RANKED} WHERE rk = 1")
def survivors(spark, sf):
    df, c = groups(spark, sf)
    return merge.survivors(df, "c_custkey", c, _merge_config())


@query(f"SELECT g.c_custkey AS source_id, s.c_custkey AS survivor_id FROM {_GROUPS} g JOIN {_RANKED} s ON s.cluster_id = g.cluster_id AND rk = 1")
def lineage(spark, sf):
    df, c = groups(spark, sf)
    return merge.lineage(df, "c_custkey", c, _merge_config())


@query(f"SELECT arg_min(c_custkey, rk) AS c_custkey, arg_min(c_name, rk) FILTER (c_name IS NOT NULL) AS c_name, arg_min(seg, rk) FILTER (trim(seg) <> '') AS seg FROM {_RANKED} GROUP BY cluster_id")
def merge_first_non_null(spark, sf):
    df, c = groups(spark, sf)
    r = merge.MergeRule("first_non_null")
    return merge.consolidate(df, "c_custkey", c, _merge_config(c_name=r, seg=r)).frame.select("c_custkey", "c_name", "seg")


@query(f"SELECT s.c_custkey, f.seg FROM {_RANKED} s LEFT JOIN (SELECT cluster_id, seg FROM (SELECT cluster_id, seg, count(*) AS n, min(rk) AS k FROM {_RANKED} WHERE trim(seg) <> '' GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, k) = 1) f USING (cluster_id) WHERE rk = 1")
def merge_most_frequent(spark, sf):
    df, c = groups(spark, sf)
    return merge.consolidate(df, "c_custkey", c, _merge_config(seg=merge.MergeRule("most_frequent"))).frame.select("c_custkey", "seg")


@query(f"SELECT s.c_custkey, l.c_name FROM {_RANKED} s LEFT JOIN (SELECT cluster_id, c_name FROM {_RANKED} WHERE c_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY prio DESC, rk) = 1) l USING (cluster_id) WHERE rk = 1")
def merge_latest(spark, sf):
    df, c = groups(spark, sf)
    return merge.consolidate(df, "c_custkey", c, _merge_config(c_name=merge.MergeRule("latest", "prio"))).frame.select("c_custkey", "c_name")


@query(
    f"""SELECT cluster_id::BIGINT AS cluster_id, sid AS survivor_id, 'seg' AS "column", 'first_non_null' AS strategy, CASE WHEN NOT changed THEN 'retained' ELSE 'filled' END AS action, donor AS donor_id, k AS distinct_value_count,
array_to_string(CASE WHEN k > 1 THEN ids ELSE [] END, ',') AS conflicting
FROM (SELECT cluster_id, count(*) AS n, arg_min(c_custkey, rk) AS sid, arg_min(c_custkey, rk) FILTER (trim(seg) <> '') AS donor, count(DISTINCT seg) FILTER (trim(seg) <> '') AS k,
list(c_custkey ORDER BY rk) FILTER (trim(seg) <> '') AS ids, coalesce(arg_min(c_custkey, rk) FILTER (trim(seg) <> '') <> arg_min(c_custkey, rk), false) AS changed FROM {_RANKED} GROUP BY cluster_id) WHERE n > 1 AND (changed OR k > 1)"""
)
def merge_audit(spark, sf):
    df, c = groups(spark, sf)
    a = merge.consolidate(df, "c_custkey", c, _merge_config(seg=merge.MergeRule("first_non_null"))).audit
    return a.select("cluster_id", "survivor_id", "column", "strategy", "action", "donor_id", "distinct_value_count", F.array_join("conflicting_source_ids", ",").alias("conflicting"))


# --- snapshots, entities, checks ------------------------------------------------------------------------


@query("SELECT count(*) AS total_files, count(*) FILTER (content = 0) AS data_files, count(*) FILTER (content <> 0) AS delete_files, count(DISTINCT spec_id) AS active_partition_spec_count FROM (SELECT o_orderkey % 4 AS content, o_custkey % 3 AS spec_id FROM orders)")
def snapshot_file_aggregates(spark, sf):
    from lodestone.sources.snapshots import file_aggregates

    return file_aggregates(table(spark, sf, "orders").select((F.col("o_orderkey") % 4).alias("content"), (F.col("o_custkey") % 3).alias("spec_id")))


@query("WITH RECURSIVE a AS (SELECT 40::BIGINT AS snapshot_id, 0 AS depth UNION ALL SELECT (snapshot_id // 2)::BIGINT, depth + 1 FROM a WHERE snapshot_id > 1) SELECT snapshot_id, depth::INTEGER AS depth FROM a")
def snapshot_ancestry(spark, sf):
    from lodestone.sources.snapshots import ancestry

    s = table(spark, sf, "customer").select(F.col("c_custkey").alias("snapshot_id"), F.when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 2)).alias("parent_id"))
    return ancestry(s, 40)


@query("SELECT doc_id, 'WORD' AS label, m AS text FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Z][a-z]{11,}')) AS m FROM documents)")
def entities_regex(spark, sf):
    rec = entities.PatternRecognizer({"WORD": "[A-Z][a-z]{11,}"})
    found = entities.extract(table(spark, sf, "documents"), rec, id_col="doc_id", text_col="text")
    return found.select(F.col("row_id").alias("doc_id"), "label", "text")


@query("SELECT 'WORD' AS label, count(*) AS entities FROM (SELECT unnest(regexp_extract_all(text, '[A-Z][a-z]{11,}')) AS m FROM documents)")
def entity_label_counts(spark, sf):
    rec = entities.PatternRecognizer({"WORD": "[A-Z][a-z]{11,}"})
    return entities.label_counts(entities.extract(table(spark, sf, "documents"), rec, id_col="doc_id", text_col="text"))


@query()
def full_check(spark, sf):
    from lodestone.plans.checker import DataQualityChecker
    from lodestone.plans.config import CheckConfig, ColumnRange, Config

    checks = CheckConfig(column_ranges={"o_totalprice": ColumnRange(0, 300000)}, freshness=True, freshness_columns=["o_orderdate"])
    return DataQualityChecker(table(spark, sf, "orders"), Config(checks=checks)).run().to_dataframe(spark)
