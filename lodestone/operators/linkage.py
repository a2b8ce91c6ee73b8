"""Probabilistic record linkage: normalise, block, compare, fit, score, cluster, evaluate."""

from __future__ import annotations

import math
import time
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from lodestone.functions.columns import col, family, is_float, is_nested, quote, strip, type_of
from lodestone.functions.strings import StringNormalization, normalize
from lodestone.operators.blocking import ID_L, ID_R, Work, candidates, pair_work
from lodestone.operators.components import connected_components
from lodestone.operators.fellegi_sunter import Fit, fit, score
from lodestone.operators.grids import able, level_counts, level_pairs
from lodestone.operators.levels import patterns, with_levels
from lodestone.plans.staging import stage

#: Pattern rows collected for the fit; beyond it the comparisons have too many levels.
#: Patterns of levels (a few numbers each) that are broadcast; more are joined.  Up to so many are looked up in one array.
BROADCAST_PATTERNS, ARRAY_PATTERNS = 100_000, 10_000


@dataclass(frozen=True)
class LinkConfig:
    unique_id_column: str
    comparisons: tuple = ()
    blocking_rules: tuple[tuple[str, ...], ...] = ()
    normalization: Mapping[str, StringNormalization] = field(default_factory=dict)
    mode: str = "dedupe"
    prior_match_probability: float = 0.001
    match_threshold_probability: float = 0.9
    em_max_iter: int = 100
    em_tolerance: float = 1e-3
    allow_warning_fit: bool = False
    max_pairs_warning: int = 5_000_000
    max_pairs_hard_cap: int = 50_000_000

    def __post_init__(self):
        put = lambda k, v: object.__setattr__(self, k, v)
        put("unique_id_column", self.unique_id_column.strip())
        put("comparisons", tuple(self.comparisons))
        if not self.unique_id_column:
            raise ValueError("unique_id_column must not be blank")
        if not self.comparisons:
            raise ValueError("at least one comparison is needed")
        names = [c.column for c in self.comparisons]
        if len(set(names)) != len(names):
            raise ValueError("each column may be compared once")
        if self.mode not in ("dedupe", "link"):
            raise ValueError("mode is dedupe or link")
        rules = [tuple(sorted(r)) for r in self.blocking_rules]
        if any(not r or len(set(r)) != len(r) for r in rules):
            raise ValueError("a blocking rule needs distinct columns")
        if len(set(rules)) != len(rules):
            raise ValueError("blocking rules must be unique")
        for a in rules:
            if any(set(b) < set(a) for b in rules):
                raise ValueError(f"blocking rule {list(a)} is covered by a shorter one")
        put("blocking_rules", tuple(sorted(rules)))
        used = set(names) | {c for r in rules for c in r} | set(self.normalization)
        if self.unique_id_column in used:
            raise ValueError("the id cannot be compared, blocked on or normalised")
        if not 0 < self.prior_match_probability < 1 or not 0.5 <= self.match_threshold_probability < 1:
            raise ValueError("probabilities are out of range")
        if not 1 <= self.em_max_iter <= 200 or not (math.isfinite(self.em_tolerance) and self.em_tolerance > 0):
            raise ValueError("fit settings are out of range")
        if not 0 < self.max_pairs_warning <= self.max_pairs_hard_cap:
            raise ValueError("the pair warning must not exceed the hard cap")


@dataclass
class LinkageResult:
    pairs: DataFrame
    clusters: DataFrame | None
    fit: Fit | None
    config: LinkConfig
    timings_ms: dict[str, float] = field(default_factory=dict)

    @property
    def status(self) -> str:
        return self.fit.status if self.fit else "not_fitted"

    def match_pairs(self, threshold: float) -> DataFrame:
        return matches(self.pairs, threshold)

    def evaluate_labeled_pairs(self, labels: DataFrame, threshold: float | None = None) -> dict:
        t = self.config.match_threshold_probability if threshold is None else threshold
        return evaluate(self.pairs, labels, t).first().asDict()

    def summary(self) -> dict:
        t = self.config.match_threshold_probability
        n, k = self.pairs.agg(F.count(F.lit(1)), F.count_if(F.col("match_probability") >= t)).first()
        clusters = self.clusters.agg(F.count_distinct("cluster_id")).first()[0] if self.clusters is not None else 0
        return {
            "candidate_pairs": n, "matched_pairs": k, "match_threshold_probability": t, "clusters": clusters, "timings_ms": self.timings_ms,
            "lambda": self.fit.match_share if self.fit else self.config.prior_match_probability, "fit_status": self.status, "fit_reason": self.fit.reason if self.fit else None,
            "fit_warnings": list(self.fit.warnings) if self.fit else [],
        }


def _threshold(t: float) -> float:
    if isinstance(t, bool) or not math.isfinite(t) or not 0 <= t <= 1:
        raise ValueError("a threshold is a finite number from 0 to 1")
    return float(t)


def matches(pairs: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose probability reaches the threshold."""
    return pairs.where(F.col("match_probability") >= _threshold(threshold))


def validate(df: DataFrame, config: LinkConfig, label: str = "left") -> None:
    """Ids present, finite, not blank and unique; columns of fitting types without infinities: one aggregate."""
    names = {f.name: f.dataType for f in df.schema}
    need = {config.unique_id_column, *(c.column for c in config.comparisons), *(c for r in config.blocking_rules for c in r), *config.normalization}
    if lost := sorted(need - set(names)):
        raise ValueError(f"{label} input lacks columns {lost}")
    if taken := sorted(n for n in names if n in (ID_L, ID_R) or n.startswith("level__")):
        raise ValueError(f"{label} input uses reserved names {taken}")
    for c in need:
        if is_nested(names[c]):
            raise TypeError(f"column {c!r} is nested")
    for spec in config.comparisons:
        kind = family(names[spec.column])
        if spec.kind == "numeric" and kind not in ("integer", "float", "decimal"):
            raise TypeError(f"column {spec.column!r} is not numeric")
        if spec.kind == "fuzzy" and kind != "string":
            raise TypeError(f"column {spec.column!r} is not text")
    for c in config.normalization:
        if family(names[c]) != "string":
            raise TypeError(f"column {c!r} is not text and cannot be normalised")
    i, dtype = col(config.unique_id_column), names[config.unique_id_column]
    bad = i.isNull()
    if is_float(dtype):
        bad = bad | F.isnan(i) | (F.abs(i) == float("inf"))
    if isinstance(dtype, T.StringType):
        bad = bad | (strip(i) == "")
    infinite = F.lit(False)
    for spec in config.comparisons:
        if spec.kind == "numeric" and is_float(names[spec.column]):
            infinite = infinite | (F.abs(col(spec.column)) == float("inf"))
    bad_ids, infinities = df.agg(F.count_if(F.coalesce(bad, F.lit(False))), F.count_if(F.coalesce(infinite, F.lit(False)))).first()
    if bad_ids:
        raise ValueError(f"{label} input has {bad_ids} missing, blank or infinite ids")
    if infinities:
        raise ValueError(f"{label} input has {infinities} infinite values to compare")
    twice = df.groupBy(i).count().where("count > 1").limit(1).count()
    if twice:
        raise ValueError(f"{label} ids are not unique")


def normalize_records(df: DataFrame, config: LinkConfig) -> DataFrame:
    """``df`` with its configured text columns normalised.  One aggregate finds out which are pure ASCII and need no
    Unicode form, and so no Python."""
    todo = config.normalization
    if not todo:
        return df
    flags = df.agg(*[F.count_if(~col(c).rlike(r"^[\x00-\x7F]*$")).alias(f"a{i}") for i, c in enumerate(todo)]).first()
    plain = {c: flags[i] == 0 for i, c in enumerate(todo)}
    return df.select(*[normalize(col(c), todo[c], plain[c]).alias(c) if c in todo else col(c) for c in df.columns])


def guard(df: DataFrame, config: LinkConfig, right: DataFrame | None) -> list[Work]:
    """The bounds on pairs of each rule; MemoryError beyond the caps."""
    work = pair_work(df, config.blocking_rules, right)
    bound = sum(w.pairs for w in work)
    if bound > config.max_pairs_hard_cap:
        raise MemoryError(f"up to {bound} pairs exceed the cap of {config.max_pairs_hard_cap}")
    if not config.blocking_rules and bound > config.max_pairs_warning:
        raise MemoryError(f"{bound} pairs without blocking exceed {config.max_pairs_warning}")
    return work


def levelled_pairs(df: DataFrame, id_column: str, rules: Sequence[Sequence[str]], specs: Sequence, right: DataFrame | None = None) -> DataFrame:
    """Rows ``(__id_l__, __id_r__, level__...)`` of the candidates of ``rules``.  Where texts are compared, tiles are compared whole if they can be."""
    similar = [s.column for s in specs if s.kind == "fuzzy"]
    if similar and able(df, rules, specs, right):
        return level_pairs(df, id_column, rules[0], specs, right)
    pairs = candidates(df, id_column, rules, [s.column for s in specs], right, similar=similar)
    return with_levels(pairs, specs).select(ID_L, ID_R, *[F.col(quote(f"level__{s.column}")) for s in specs])


def counted_patterns(df: DataFrame, id_column: str, rules: Sequence[Sequence[str]], specs: Sequence, right: DataFrame | None = None) -> DataFrame:
    """``patterns`` of ``levelled_pairs``; where tiles can be compared whole, no pair becomes a row."""
    if able(df, rules, specs, right):
        return level_counts(df, id_column, rules[0], specs, right)
    return patterns(levelled_pairs(df, id_column, rules, specs, right), specs)


def _score_array(config: LinkConfig, rows: Sequence[tuple]) -> np.ndarray | None:
    """The scores ``(level, ..., score)`` of patterns with an axis of levels for each comparison, NaN where there is none; nothing if too many."""
    sizes = [c.top + 1 for c in config.comparisons]
    if math.prod(sizes) > ARRAY_PATTERNS or len({r[:-1] for r in rows}) < len(rows):
        return None
    out = np.full(sizes, np.nan)
    for *row, x in rows:
        out[tuple(row)] = x
    return out


def scored_pairs(df: DataFrame, config: LinkConfig, fitted: Fit, levels: np.ndarray, right: DataFrame | None = None, digits: int | None = None, keep_levels: bool = True) -> DataFrame:
    """``score_pairs`` of the candidates of a table; where tiles are compared whole, pairs leave them with their scores."""
    rules, specs = config.blocking_rules, config.comparisons
    if any(s.kind == "fuzzy" for s in specs) and able(df, rules, specs, right):
        p = score(levels, fitted) if fitted.status != "rejected" else np.zeros(len(levels))
        if digits is not None:  # by the engine's rule
            p = np.array(df.sparkSession.range(1).select(F.array(*[F.round(F.lit(float(x)), digits) for x in p])).first()[0])
        known = _score_array(config, [(*map(int, row), float(x)) for row, x in zip(levels, p, strict=True)])
        if known is not None:
            return level_pairs(df, config.unique_id_column, rules[0], specs, right, scores=known, keep_levels=keep_levels)
    out = score_pairs(levelled_pairs(df, config.unique_id_column, rules, specs, right), config, fitted, levels, digits)
    return out if keep_levels else out.select(ID_L, ID_R, "match_probability")


def score_pairs(levelled: DataFrame, config: LinkConfig, fitted: Fit, levels: np.ndarray, digits: int | None = None) -> DataFrame:
    """``match_probability`` by looking up each pair's pattern in the scored patterns; rounded to ``digits``, if given, a pattern at a time."""
    names = [f"level__{c.column}" for c in config.comparisons]
    p = score(levels, fitted) if fitted.status != "rejected" else np.zeros(len(levels))
    rows = [(*map(int, row), float(x)) for row, x in zip(levels, p, strict=True)]
    known = _score_array(config, rows)
    if known is not None:
        at = F.lit(0)
        for n, size in zip(names, known.shape, strict=True):
            at = at * size + F.col(quote(n))
        scores = [F.lit(None).cast("double") if math.isnan(x) else F.lit(x) if digits is None else F.round(F.lit(x), digits) for x in known.ravel().tolist()]
        found = levelled.withColumn("match_probability", F.get(F.array(*scores), at))
        return found.where(F.col("match_probability").isNotNull()).select(ID_L, ID_R, "match_probability", *[F.col(quote(n)) for n in names])
    table = levelled.sparkSession.createDataFrame(rows, ", ".join(f"p{i} int" for i in range(len(names))) + ", match_probability double")
    if digits is not None:
        table = table.withColumn("match_probability", F.round("match_probability", digits))
    same = F.lit(True)
    for i, n in enumerate(names):
        same = same & (F.col(quote(n)) == F.col(f"p{i}"))
    return levelled.join(F.broadcast(table) if len(rows) <= BROADCAST_PATTERNS else table, same).select(ID_L, ID_R, "match_probability", *[F.col(quote(n)) for n in names])


def score_matches(pairs: DataFrame, config: LinkConfig, fitted: Fit, levels: np.ndarray, threshold: float) -> DataFrame:
    """``matches`` of ``score_pairs`` of candidate pairs without levels.  Texts are compared only where the other levels leave the
    outcome open: the patterns that reach the threshold name the levels which such a pair must have."""
    at = [i for i, c in enumerate(config.comparisons) if c.kind != "fuzzy"]
    out = with_levels(pairs, [config.comparisons[i] for i in at])
    p = score(levels, fitted) if fitted.status != "rejected" else np.zeros(len(levels))
    able = sorted({tuple(int(row[i]) for i in at) for row in levels[p >= _threshold(threshold)]})
    if at and len(at) < len(config.comparisons) and len(able) <= BROADCAST_PATTERNS:
        table = pairs.sparkSession.createDataFrame(able, ", ".join(f"p{i} int" for i in range(len(at))))
        same = F.lit(True)
        for j, i in enumerate(at):
            same = same & (F.col(quote(f"level__{config.comparisons[i].column}")) == F.col(f"p{j}"))
        out = out.join(F.broadcast(table), same, "left_semi")
    out = with_levels(out, [c for c in config.comparisons if c.kind == "fuzzy"])
    return matches(score_pairs(out, config, fitted, levels), threshold)


def label_clusters(members: DataFrame, id_column: str = "id", root: str = "root") -> DataFrame:
    """Rows ``(id, cluster_id)``: clusters numbered from zero by the smallest text form of a member id.

    The order is made by range partitions, numbered within and shifted by the counts before them, so that no
    task holds all clusters."""
    i = F.col(id_column)
    text = F.concat(F.lit("'"), i, F.lit("'")) if isinstance(type_of(members, id_column), T.StringType) else i.cast("string")
    least = members.groupBy(F.col(root).alias("r")).agg(F.min(text).alias("name"))
    dealt = stage(least.repartitionByRange("name").withColumn("part", F.spark_partition_id()), "clusters")
    counts = dealt.groupBy("part").count()  # one row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select(F.col("part").alias("p"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy("name"))
    numbered = dealt.withColumn("rn", inside).join(shift, F.col("part") == F.col("p")).select("r", (F.col("rn") - 1 + F.col("shift")).alias("cluster_id"))
    return members.join(numbered, F.col(root) == F.col("r")).select(i.alias("id"), "cluster_id")


def cluster(df: DataFrame, id_column: str, pairs: DataFrame) -> DataFrame:
    """Rows ``(id, cluster_id)``: connected components of matched pairs; ids without a pair are alone."""
    found = connected_components(pairs, ID_L, ID_R)
    ids = df.select(col(id_column).alias("id"))
    members = ids.join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("root", "id").alias("root"))
    return label_clusters(members)


def evaluate(pairs: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """One row of counts and measures; labelled pairs that are no candidates have probability zero."""
    p = pairs.select(F.col(ID_L).alias("a"), F.col(ID_R).alias("b"), "match_probability")
    joined = labels.join(p, (F.col(ID_L) == F.col("a")) & (F.col(ID_R) == F.col("b")), "left")
    said, true = F.coalesce("match_probability", F.lit(0.0)) >= _threshold(threshold), F.col("is_match")
    c = joined.agg(F.count_if(said & true).alias("tp"), F.count_if(said & ~true).alias("fp"), F.count_if(~said & ~true).alias("tn"), F.count_if(~said & true).alias("fn"))

    def ratio(a, b):
        return F.when(b == 0, 0.0).otherwise(a / b)

    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("tp", "fp", "tn", "fn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def _checked(df: DataFrame, config: LinkConfig, right: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Both tables, found valid and normalised."""
    if (right is not None) != (config.mode == "link"):
        raise ValueError("link mode takes two tables and dedupe mode one")
    validate(df, config)
    if right is not None:
        validate(right, config, "right")
        for spec in config.comparisons:
            a, b = family(type_of(df, spec.column)), family(type_of(right, spec.column))
            if (a == "decimal") != (b == "decimal") and spec.kind == "numeric" or spec.kind == "exact" and a != b and not {a, b} <= {"integer", "float"}:
                raise TypeError(f"column {spec.column!r} has types {a} and {b}")
    return normalize_records(df, config), None if right is None else normalize_records(right, config)


def _fit(counted: DataFrame, config: LinkConfig, most: int | None) -> tuple[Fit | None, np.ndarray]:
    """The fit of counted patterns, if there are any, and the patterns."""
    rows = counted.orderBy(*[F.col(quote(f"level__{c.column}")) for c in config.comparisons]).collect()  # the product of the numbers of levels, at most
    levels = np.array([list(r)[:-1] for r in rows], int)
    if not rows:
        return None, levels
    counts = np.array([r.n for r in rows], float)
    if most is not None and counts.sum() > most:
        raise MemoryError("pairs exceed the hard cap")
    return fit(levels, counts, [c.top for c in config.comparisons], config.prior_match_probability, config.em_max_iter, config.em_tolerance), levels


def _unscored(levelled: DataFrame) -> DataFrame:
    return levelled.select(ID_L, ID_R, F.lit(0.0).alias("match_probability"), *[F.col(quote(c)) for c in levelled.columns if c.startswith("level__")])


def fit_pairs(df: DataFrame, config: LinkConfig, right: DataFrame | None = None) -> LinkageResult:
    """The fit and the scored pairs of ``link``, without clusters and without a table of pairs.  Patterns are counted while pairs are made, and
    pairs are made again when the result is read, so that memory and disk hold none of them and the caps on held pairs do not
    apply.  Blocking rules are needed."""
    left, other = _checked(df, config, right)
    if not config.blocking_rules:
        raise ValueError("without blocking rules use link, which bounds all pairs")
    what = (left, config.unique_id_column, config.blocking_rules, config.comparisons, other)
    fitted, levels = _fit(counted_patterns(*what), config, None)
    scored = scored_pairs(left, config, fitted, levels, other) if fitted else _unscored(levelled_pairs(*what))
    return LinkageResult(scored, None, fitted, config)


def link(df: DataFrame, config: LinkConfig, right: DataFrame | None = None) -> LinkageResult:
    """The whole linkage.  Levels are staged once; the fit and the scores read them."""
    timings: dict[str, float] = {}
    began = time.perf_counter()

    def lap(name: str) -> None:
        nonlocal began
        timings[name], began = (time.perf_counter() - began) * 1000, time.perf_counter()

    left, other = _checked(df, config, right)
    lap("normalize")
    work = guard(left, config, other)
    lap("estimate")
    pairs = candidates(left, config.unique_id_column, config.blocking_rules, [c.column for c in config.comparisons], other, work=work, max_pairs=config.max_pairs_hard_cap)
    levelled = with_levels(pairs, config.comparisons).select(ID_L, ID_R, *[F.col(quote(f"level__{c.column}")) for c in config.comparisons])
    levelled = stage(levelled, "levels")
    lap("compare")
    fitted, levels = _fit(patterns(levelled, config.comparisons), config, config.max_pairs_hard_cap)
    scored = score_pairs(levelled, config, fitted, levels) if fitted else _unscored(levelled)
    lap("fit")
    clusters = None
    if config.mode == "dedupe":
        t = config.match_threshold_probability if fitted and fitted.status != "rejected" else 1.0
        clusters = cluster(df, config.unique_id_column, matches(scored, t))
        lap("cluster")
    return LinkageResult(scored, clusters, fitted, config, timings)


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """One row ``(duplicate_clusters, records_in_duplicate_groups)``."""
    n = clusters.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return n.agg(F.count(F.lit(1)).alias("duplicate_clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("records_in_duplicate_groups"))
