"""Consolidation: one row for each cluster, with lineage and an audit that never shows a value."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.functions.columns import col, filled, is_float, strip, type_of
from lodestone.operators.linkage import LinkageResult, LinkConfig, link

STRATEGIES = ("survivor", "first_non_null", "most_frequent", "latest")


@dataclass(frozen=True)
class SurvivorSortKey:
    column: str
    descending: bool = False


@dataclass(frozen=True)
class MergeRule:
    strategy: str = "survivor"
    order_by: str | None = None

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy!r}")
        if (self.strategy == "latest") != (self.order_by is not None):
            raise ValueError("order_by belongs to the latest strategy")


@dataclass(frozen=True)
class ConsolidationConfig:
    sort_keys: tuple[SurvivorSortKey, ...] = ()
    completeness_columns: tuple[str, ...] = ()
    merge_rules: Mapping[str, MergeRule] = field(default_factory=dict)

    def __post_init__(self):
        names = [k.column for k in self.sort_keys]
        if len(set(names)) != len(names) or len(set(self.completeness_columns)) != len(self.completeness_columns):
            raise ValueError("sort keys and completeness columns must be unique")


@dataclass
class ConsolidationResult:
    frame: DataFrame
    lineage: DataFrame
    audit: DataFrame

    def summary(self) -> dict[str, int]:
        n, k = self.lineage.agg(F.count(F.lit(1)), F.count_distinct("survivor_id")).first()
        conflicts, changes = self.audit.agg(F.count_if(F.col("distinct_value_count") > 1), F.count_if(F.col("action") != "retained")).first()
        return {"input_records": n, "output_records": k, "removed_records": n - k, "clusters": k, "conflicts": conflicts, "changes": changes}


def ranked(df: DataFrame, id_column: str, clusters: DataFrame, config: ConsolidationConfig) -> DataFrame:
    """``df`` with ``__cluster`` and ``__rank``: sort keys (missing last), completeness descending, then id.

    Clusters are sets of records of one entity; a cluster large enough to burden a task is a fault of the matching,
    which the pair caps bound beforehand."""
    c = clusters.select(F.col("id").alias("__cid"), F.col("cluster_id").alias("__cluster"))
    order = []
    for k in config.sort_keys:
        v = F.when(filled(df, k.column), col(k.column))
        order.append(v.desc_nulls_last() if k.descending else v.asc_nulls_last())
    complete = sum((filled(df, x).cast("int") for x in config.completeness_columns), F.lit(0))
    rank = F.row_number().over(Window.partitionBy("__cluster").orderBy(*order, complete.desc(), col(id_column)))
    return df.join(c, col(id_column) == F.col("__cid")).withColumn("__rank", rank).drop("__cid")


def survivors(df: DataFrame, id_column: str, clusters: DataFrame, config: ConsolidationConfig) -> DataFrame:
    """Rows ``(cluster_id, survivor_id)``."""
    r = ranked(df, id_column, clusters, config).where("__rank = 1")
    return r.select(F.col("__cluster").alias("cluster_id"), col(id_column).alias("survivor_id"))


def lineage(df: DataFrame, id_column: str, clusters: DataFrame, config: ConsolidationConfig) -> DataFrame:
    """Rows ``(source_id, survivor_id)``."""
    s = survivors(df, id_column, clusters, config)
    return clusters.join(s, "cluster_id").select(F.col("id").alias("source_id"), "survivor_id")


def validate(df: DataFrame, id_column: str, clusters: DataFrame, config: ConsolidationConfig) -> None:
    """Columns exist, the id is not merged, clusters cover each id once with a number from zero, and
    every present value of a latest rule has an order."""
    need = {id_column, *(k.column for k in config.sort_keys), *config.completeness_columns, *config.merge_rules, *(r.order_by for r in config.merge_rules.values() if r.order_by)}
    if lost := sorted(need - set(df.columns)):
        raise ValueError(f"input lacks columns {lost}")
    if id_column in config.merge_rules:
        raise ValueError("the id cannot be merged")
    i = col(id_column)
    no_order = [(c, filled(df, c) & ~filled(df, r.order_by)) for c, r in config.merge_rules.items() if r.strategy == "latest"]
    checks = df.agg(F.count_if(i.isNull()), F.count(F.lit(1)), *[F.count_if(x) for _, x in no_order]).first()
    if checks[0]:
        raise ValueError("ids must be present")
    for (c, _), n in zip(no_order, checks[2:], strict=True):
        if n:
            raise ValueError(f"{n} values of {c!r} have no order")
    if df.groupBy(i).count().where("count > 1").limit(1).count() or clusters.groupBy("id").count().where("count > 1").limit(1).count():
        raise ValueError("ids must be unique")
    if clusters.where("cluster_id is null or cluster_id < 0").limit(1).count():
        raise ValueError("cluster numbers start at zero")
    ids = df.select(i.alias("id"))
    if ids.join(clusters, "id", "left_anti").limit(1).count() or clusters.join(ids, "id", "left_anti").limit(1).count():
        raise ValueError("clusters must name each id of the input")


def _clean(df: DataFrame, name: str) -> Column:
    return F.when(filled(df, name), col(name))


def _pick(r: DataFrame, id_column: str, name: str, rule: MergeRule) -> Column:
    """The chosen (donor, value) of a column in a cluster, null if there is none."""
    pair = F.struct(col(id_column).alias("donor"), _clean(r, name).alias("value"))
    ok = filled(r, name)
    if rule.strategy == "survivor":
        return F.min_by(pair, F.col("__rank"))
    if rule.strategy == "first_non_null":
        return F.min_by(pair, F.when(ok, F.col("__rank")))
    order = F.struct(_clean(r, rule.order_by).alias("o"), (-F.col("__rank")).alias("k"))
    return F.max_by(pair, F.when(ok, order))


def _text(df: DataFrame, name: str) -> Column:
    """Equal for equal present values, and only for them: -0.0 is 0.0; an instant is a number, for its text depends on the clock."""
    c = col(name)
    if isinstance(type_of(df, name), T.TimestampType):
        return F.unix_micros(c).cast("string")
    return (c + F.lit(0.0)).cast("string") if is_float(type_of(df, name)) else F.hex(c) if isinstance(type_of(df, name), T.BinaryType) else c.cast("string")


def most_frequent(r: DataFrame, id_column: str, names: Sequence[str]) -> DataFrame:
    """Rows ``(__cluster, c0, c1, ...)`` with the (donor) of the largest group of equal values; ties go to the
    group that comes first by rank.  Values are counted in one pass over (cluster, column, value)."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.when(filled(r, c), _text(r, c)).alias("v")) for i, c in enumerate(names)]))
    long = r.select("__cluster", "__rank", col(id_column).alias("d"), cells.alias("x")).where("x.v is not null")
    g = long.groupBy("__cluster", "x.i", "x.v").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("__rank", "d")).alias("first"))
    best = g.groupBy("__cluster", "i").agg(F.min_by("first.d", F.struct(-F.col("n"), F.col("first.__rank"))).alias("donor"))
    return best.groupBy("__cluster").agg(*[F.max(F.when(F.col("i") == i, F.col("donor"))).alias(f"f{i}") for i in range(len(names))])


def merged(df: DataFrame, id_column: str, clusters: DataFrame, config: ConsolidationConfig) -> tuple[DataFrame, DataFrame]:
    """(rows with ``__cluster``, survivor and each column's struct ``m<i>``: donor and value), and the ranked input."""
    r = ranked(df, id_column, clusters, config)
    names = [c for c in df.columns if c != id_column]
    rules = {c: config.merge_rules.get(c, MergeRule()) for c in names}
    often = [c for c in names if rules[c].strategy == "most_frequent"]
    picks = [_pick(r, id_column, c, rules[c]).alias(f"m{i}") for i, c in enumerate(names) if c not in often]
    first = [F.min_by(col(id_column), F.col("__rank")).alias("__survivor"), F.count(F.lit(1)).alias("__n")]
    raw = [F.min_by(col(c), F.col("__rank")).alias(f"s{i}") for i, c in enumerate(names)]
    out = r.groupBy("__cluster").agg(*first, *raw, *picks)
    if often:
        donors = most_frequent(r, id_column, often)
        out = out.join(donors, "__cluster", "left")
        values = r.select(F.col("__cluster").alias("vc"), col(id_column).alias("vd"), *[col(c).alias(f"v{names.index(c)}") for c in often])
        for j, c in enumerate(often):
            i = names.index(c)
            v = values.select("vc", "vd", F.struct(F.col("vd").alias("donor"), F.col(f"v{i}").alias("value")).alias(f"m{i}"))
            out = out.join(v, (F.col("__cluster") == F.col("vc")) & (F.col(f"f{j}") == F.col("vd")), "left").drop("vc", "vd", f"f{j}")
    return out, r


def consolidate(df: DataFrame, id_column: str, clusters: DataFrame, config: ConsolidationConfig, check: bool = True) -> ConsolidationResult:
    """One row for each cluster in cluster order, with the input's schema; lineage; audit."""
    if check:
        validate(df, id_column, clusters, config)
    names = [c for c in df.columns if c != id_column]
    types = {f.name: f.dataType for f in df.schema}
    out, r = merged(df, id_column, clusters, config)
    chosen = []
    for i, c in enumerate(names):
        survivor_only = config.merge_rules.get(c, MergeRule()).strategy == "survivor"
        value = F.col(f"s{i}") if survivor_only else F.col(f"m{i}.value")
        chosen.append(value.cast(types[c]).alias(c))
    by = dict(zip(names, chosen, strict=True))
    frame = out.orderBy("__cluster").select(*[F.col("__survivor").alias(c) if c == id_column else by[c] for c in df.columns])
    return ConsolidationResult(frame, lineage(df, id_column, clusters, config), audit(out, r, id_column, config))


def audit(out: DataFrame, r: DataFrame, id_column: str, config: ConsolidationConfig) -> DataFrame:
    """Rows about merged columns of clusters of two or more, where the value changed or several were present."""
    names = [c for c in r.columns if c not in (id_column, "__cluster", "__rank")]
    told = [(names.index(c), c, rule) for c, rule in config.merge_rules.items()]
    schema = f"cluster_id long, survivor_id {type_of(r, id_column).simpleString()}, column string, strategy string, action string, donor_id {type_of(r, id_column).simpleString()}, distinct_value_count long, conflicting_source_ids array<{type_of(r, id_column).simpleString()}>"
    if not told:
        return r.sparkSession.createDataFrame([], schema)
    rows = []
    for i, c, rule in told:
        before = F.when(F.col(f"s{i}").isNotNull() & (strip(F.col(f"s{i}").cast("string")) != "") & (F.col(f"s{i}").cast("string") != "NaN"), F.col(f"s{i}"))
        after = F.col(f"m{i}.value")
        changed = after.isNotNull() & ~before.eqNullSafe(after)
        action = F.when(~changed, "retained").when(before.isNull(), "filled").otherwise("replaced")
        donor = F.when(after.isNotNull(), F.col(f"m{i}.donor"))
        rows.append(F.struct(F.lit(c).alias("column"), F.lit(rule.strategy).alias("strategy"), action.alias("action"), donor.alias("donor_id"), changed.alias("changed")))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.when(filled(r, c), _text(r, c)).alias("v")) for _, c, _ in told]))
    long = r.select("__cluster", "__rank", col(id_column).alias("d"), cells.alias("x")).where("x.v is not null")
    seen = long.groupBy(F.col("__cluster").alias("sc"), F.col("x.column").alias("scol")).agg(
        F.count_distinct("x.v").alias("k"), F.transform(F.sort_array(F.collect_list(F.struct("__rank", "d"))), lambda x: x["d"]).alias("ids")
    )
    each = out.where("__n > 1").select("__cluster", "__survivor", F.explode(F.array(*rows)).alias("a"))
    joined = each.join(seen, (F.col("__cluster") == F.col("sc")) & (F.col("a.column") == F.col("scol")), "left")
    k = F.coalesce("k", F.lit(0))
    empty = F.array().cast(f"array<{type_of(r, id_column).simpleString()}>")
    return joined.where(F.col("a.changed") | (k > 1)).select(
        F.col("__cluster").cast("long").alias("cluster_id"), F.col("__survivor").alias("survivor_id"), F.col("a.column").alias("column"), F.col("a.strategy").alias("strategy"), F.col("a.action").alias("action"),
        F.col("a.donor_id").alias("donor_id"), k.alias("distinct_value_count"), F.when(k > 1, F.col("ids")).otherwise(empty).alias("conflicting_source_ids"),
    )


@dataclass
class DeduplicationResult:
    linkage: LinkageResult
    consolidation: ConsolidationResult


def deduplicate(df: DataFrame, config: LinkConfig, merge: ConsolidationConfig) -> DeduplicationResult:
    """Link and consolidate; refused if the fit is rejected, or has warnings that are not allowed."""
    if config.mode != "dedupe":
        raise ValueError("deduplication works on one table")
    found = link(df, config)
    if found.status == "rejected" or found.status == "warning" and not config.allow_warning_fit:
        raise RuntimeError(f"the fit is {found.status}: {found.fit.reason or ', '.join(found.fit.warnings)}")
    return DeduplicationResult(found, consolidate(df, config.unique_id_column, found.clusters, merge))


def default_merge(df: DataFrame, id_column: str) -> ConsolidationConfig:
    """Every column but the id takes the first present value; completeness counts all of them."""
    names = tuple(c for c in df.columns if c != id_column)
    return ConsolidationConfig((), names, {c: MergeRule("first_non_null") for c in names})
