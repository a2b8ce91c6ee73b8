"""Personal data in texts: weak labelers vote on spans, expectation-maximisation tells how far each may be trusted, and a
classifier learnt from their joint opinion decides on spans that no base pattern accepts.

Kinds are ``email``, ``ip``, ``card`` and ``phone``.  *Base* spans are the leftmost, non-overlapping matches of a kind's pattern that pass its check (parts
of at most 255, the Luhn sum, 8 to 15 digits).  They always stay.  What they leave of a text is searched by wider patterns: numbers that
a base match swallowed together with a neighbour, other spellings, numbers that fail a check.  These and the base spans are the *candidates*.

1. Labelers vote 1, 0 or -1 on each candidate: the base pattern, the check, gazetteers (top-level domains, issuers, calling codes, special
   networks), the shape, the signs at the borders, and the words before.
2. Votes are counted by pattern (kind and six votes: at most 2,916 rows).  Expectation-maximisation over that table estimates, for
   each kind, how often each labeler votes what on personal data and on other candidates, starting from (and smoothed by) the belief that labelers err seldom.
3. Each candidate's posterior is its label.  A naive Bayes classifier over hashed features (number of digits, shape, border signs, word before,
   checks) is trained on all candidates by these soft labels.
4. A candidate that passes its kind's check and has a score of at least 0.5 is added.

DataFrame functions only, and no shuffle of texts: candidates are arrays of structs within the row, counts are aggregates of bounded size, the models are
literals.  Patterns are written so that they need neither backtracking over long runs nor recursion (possessive loops), and
positions are summed in blocks, so that a text takes time in proportion to its length.

Defined cases: a null text is empty; rows are independent of each other, so repeated rows, null and shared ids need no rule; extra columns are ignored; an empty table
gives no rows.  Positions count code points from 0, ends are exclusive.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.plans.staging import stage

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# Base patterns (fixed by the task), written without backtracking: a match begins where its first run of signs begins or the last match ended.
BASE = (
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
_AT, _DOT = r"(?:\x20?[\[({]\x20?(?:at|AT)\x20?[\])}]\x20?|\x20at\x20)", r"(?:\x20?[\[({]\x20?(?:dot|DOT)\x20?[\])}]\x20?|\x20dot\x20|\.)"
_IP_DOT = r"(?:\.|[\[(]\.[\])])"
_END = r"(?![0-9]|\.[0-9])"
#: Wider patterns, for what base spans leave.
WIDE = (
    rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++",
    rf"(?<![0-9.])[0-9]{{1,3}}(?:{_IP_DOT}[0-9]{{1,3}}){{3}}(?![0-9])",
    r"(?<![0-9])(?:[0-9]{4}([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{1,3})?|[0-9]{4}([\x20-])[0-9]{6}\2[0-9]{5}|[0-9]{13,19})(?![0-9])",
    rf"\+1[\x20.-]?\(?[0-9]{{3}}\)?[\x20.-]?[0-9]{{3}}[\x20.-]?[0-9]{{4}}{_END}|\+[0-9]{{1,3}}(?:[\x20.-]?\(?[0-9]{{1,4}}\)?){{2,5}}{_END}"
    rf"|(?<![0-9A-Za-z+.-])\(?[0-9]{{3}}\)?[\x20.-][0-9]{{3}}[\x20.-][0-9]{{4}}{_END}",
)
# Gazetteers: fixed values.
DOMAINS = "com|org|net|edu|gov|mil|int|info|biz|name|io|co|ai|app|dev|me|tv|eu|de|at|ch|fr|be|nl|es|pt|it|uk|ie|us|ca|mx|br|ar|cl|au|nz|in|cn|jp|kr|ru|pl|cz|se|no|dk|fi|gr|tr|za|example"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|30[0-5]|3[689]|35|6011|64[4-9]|65|62|50|5[6-8]|67)"
CALLING = r"^\+(?:1|7|20|27|3[0123469]|4[013456789]|5[1-8]|6[0-6]|8[1246]|9[0123458]|21[12368]|2[2-6][0-9]|29[0179]|3[578][0-9]|42[013]|5[09][0-9]|6[789][0-9]|80[08]|85[02356]|88[06]|9[679][0-9])"
HINTS = (
    r"\b(?:e-?mail|mail|contact|write|kontakt|schreib|courriel|correo|contacto)\b",
    r"\b(?:ip|host|server|address|addr|adresse|client|from|dirección|direccion)\b",
    r"\b(?:card|visa|mastercard|amex|credit|debit|pay|karte|carte|tarjeta)\b",
    r"\b(?:call|phone|tel|telephone|fax|mobile|cell|telefon|anruf|appel|teléfono|telefono|llame)\b",
)
OTHER_WORDS = r"\b(?:token|password|passwd|secret|key|sha|md5|hash|version|isbn|issn|doi|order|invoice|serial|build)\b\W*$|[=\"']$"

LABELERS, ROUNDS = 6, 8
#: Beliefs about a labeler on personal data, in votes: so many of -1, 0 and 1 (on other candidates: the reverse).
BELIEF = (1.0, 4.0, 8.0)
#: Hashed features: buckets of each.
BUCKETS = (64, 128, 64, 256, 64)
BLOCK_BITS = 7
BLOCK = 1 << BLOCK_BITS
_SPAN = "array<struct<start:bigint,end:bigint,s:string,before:string,after:string>>"


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a Luhn sum divisible by ten."""
    n = F.length(digits)

    def add(acc: Column, i: Column) -> Column:
        x = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def passes(kind: int | Column, s: Column) -> Column:
    """A kind's own check of a matched string."""
    d = _digits(s)
    small = F.forall(F.split(F.regexp_replace(s, r"[^0-9]+", "."), r"\."), lambda x: (F.length(F.ltrim(x, F.lit("0"))) <= 3) & (F.lpad(F.ltrim(x, F.lit("0")), 3, "0") <= "255"))
    checks = [
        F.lower(s).rlike(r"[a-z][a-z0-9-]*$"),
        small,
        F.length(d).between(15, 19) & luhn(d),
        F.length(d).between(8, 15),
    ]
    if isinstance(kind, int):
        return checks[kind]
    out = F.when(kind == 0, checks[0])
    for i in (1, 2, 3):
        out = out.when(kind == i, checks[i])
    return F.coalesce(out, F.lit(False))


def base_check(kind: int, s: Column) -> Column:
    """What a base match must pass (all emails do)."""
    if kind == EMAIL:
        return F.lit(True)
    if kind == CARD:
        return F.length(_digits(s)).between(16, 19) & passes(CARD, s)
    return passes(kind, s)


def located(df: DataFrame, name: str, text: str, pattern: str, flag: Column) -> DataFrame:
    """Adds array ``name`` of structs ``(start, end, s, before, after)``, the leftmost non-overlapping matches with up to 40 signs before and 20 after each, and
    ``name_parts``, the text between matches (null without matches).  Starts are sums of lengths, in two levels of ``BLOCK`` matches."""
    none = F.array().cast("array<string>")
    df = df.withColumn("__f", F.when(flag, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(f"{name}_parts", F.when(F.size("__f") > 0, F.split(text, pattern, -1)))
    parts, found, n = F.col(f"{name}_parts"), F.col("__f"), F.size("__f")

    def item(i: Column) -> Column:
        part, s = F.get(parts, i), F.get(found, i)
        return F.struct(F.length(part).cast("long").alias("b"), F.length(s).cast("long").alias("m"), s.alias("s"), F.right(part, F.lit(40)).alias("before"), F.left(F.get(parts, i + 1), F.lit(20)).alias("after"))

    df = df.withColumn("__i", F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), item)))
    items = F.col("__i")
    block = lambda k: F.slice(items, k * BLOCK + 1, BLOCK)
    sums = F.transform(F.sequence(F.lit(0), F.shiftright(n - 1, BLOCK_BITS)), lambda k: F.aggregate(block(k), F.lit(0).cast("long"), lambda acc, x: acc + x["b"] + x["m"]))
    df = df.withColumn("__o", F.when(n > 0, F.aggregate(sums, F.array(F.lit(0).cast("long")), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))))
    empty = F.array().cast(_SPAN)

    def spans(k: Column) -> Column:
        def step(acc: Column, x: Column) -> Column:
            start = acc["at"] + x["b"]
            one = F.struct(start.alias("start"), (start + x["m"]).alias("end"), x["s"].alias("s"), x["before"].alias("before"), x["after"].alias("after"))
            return F.struct((start + x["m"]).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(block(k), F.struct(F.get(F.col("__o"), k).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])

    whole = F.flatten(F.transform(F.sequence(F.lit(0), F.size("__o") - 2), spans))
    return df.withColumn(name, F.when(n > 0, whole).otherwise(empty)).drop("__f", "__i", "__o")


def candidates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``(doc_id, found)``: for each text the array of candidates ``(kind, start, end, s, before, after, base)``."""
    df = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    df = df.withColumn("digit", F.col("t").rlike("[0-9]")).withColumn("at", F.instr("t", "@") > 0)
    spelled = (F.instr("t", " dot ") > 0) | F.col("t").rlike(r"[\[({]\x20?(?:at|AT)\x20?[\])}]")
    flags = (F.col("at"), F.col("digit"), F.col("digit"), F.col("digit") & (F.instr("t", "+") > 0))
    wide_flags = (spelled, *[F.col("digit")] * 3)
    for k in range(len(KINDS)):
        df = _with_candidates(df, k, flags[k], wide_flags[k])
    # an array of one element, exploded, keeps the optimizer from copying all of the above into filters on the result
    return df.select("doc_id", F.explode(F.array(F.concat(*[f"{name}_all" for name in KINDS]))).alias("found"))


def _with_candidates(df: DataFrame, kind: int, flag: Column, wide_flag: Column) -> DataFrame:
    """Adds one kind's candidates: base spans, and what the wider pattern finds in the text without them."""
    name = KINDS[kind]
    spans, parts, ok = F.col(name), F.col(f"{name}_parts"), F.col(f"{name}_ok")
    df = located(df, name, "t", BASE[kind], flag)
    df = df.withColumn(f"{name}_ok", F.transform(spans, lambda x: base_check(kind, x["s"])))

    def blanked(i: Column) -> Column:
        s = F.get(spans, i)["s"]
        return F.concat(F.get(parts, i), F.when(F.get(ok, i), F.repeat(F.lit("\x01"), F.length(s))).otherwise(s))

    left = F.concat(F.array_join(F.transform(F.sequence(F.lit(0), F.size(spans) - 1), blanked), ""), F.element_at(parts, -1))
    df = df.withColumn("left", F.when(F.size(spans) > 0, left).otherwise(F.col("t")))
    df = located(df, f"{name}_wide", "left", WIDE[kind], wide_flag)

    def tagged(x: Column, base: bool) -> Column:
        return F.struct(F.lit(kind).alias("kind"), *[x[c].alias(c) for c in ("start", "end", "s", "before", "after")], F.lit(base).alias("base"))

    sure = F.filter(F.arrays_zip(spans.alias("x"), ok.alias("ok")), lambda z: z["ok"])
    df = df.withColumn(f"{name}_all", F.concat(F.transform(sure, lambda z: tagged(z["x"], True)), F.transform(f"{name}_wide", lambda x: tagged(x, False))))
    return df.drop(f"{name}_parts", f"{name}_wide_parts", f"{name}_ok", f"{name}_wide", name, "left")


def _by_kind(kind: Column, *choices: Column) -> Column:
    out = F.when(kind == 0, choices[0])
    for i, c in enumerate(choices[1:], 1):
        out = out.when(kind == i, c)
    return out.otherwise(F.lit(0))


def _vote(yes: Column, no: Column | None = None) -> Column:
    out = F.when(yes, 1)
    return (out if no is None else out.when(no, -1)).otherwise(0)


def _sides(x: Column) -> tuple[Column, Column]:
    return F.right(x["before"], F.lit(1)), F.left(x["after"], F.lit(1))


def votes(x: Column) -> list[Column]:
    """The labelers' votes on a candidate."""
    kind, s = x["kind"], x["s"]
    d, low = _digits(s), F.lower(s)
    ok = passes(kind, s)
    whole = [s.rlike(f"^(?:{p})$") for p in BASE]
    left, right = _sides(x)
    grown = left.rlike(r"[\p{L}\p{N}_=\"'/]") | right.rlike(r"[\p{L}\p{N}_\"'/]")
    text = F.lower(x["before"])
    return [
        _by_kind(kind, *[_vote(w & ok) for w in whole]),
        _vote(ok, ~ok),
        _by_kind(
            kind, _vote(low.rlike(rf"(?:{DOMAINS})$")), _vote(~d.rlike("^0") & ~s.rlike(r"^(?:0|127|22[4-9]|2[34][0-9]|25[0-5])[^0-9]"), s.rlike(r"^0[^0-9]")),
            _vote(d.rlike(ISSUERS), ~d.rlike(ISSUERS)), _vote(s.rlike(CALLING), s.rlike(r"^\+")),
        ),
        _by_kind(
            kind, _vote(F.instr(s, "@") > 0), _vote(~s.rlike(r"(?:^|[^0-9])0[0-9]"), s.rlike(r"(?:^|[^0-9])0[0-9]")),
            _vote(s.rlike(r"^[0-9]{15,16}$|^[0-9]{4}[\x20-]"), s.rlike(r"^(?:[0-9]{13,14}|[0-9]{17,})$")), _vote(s.rlike(r"[()]|[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}$")),
        ),
        _vote(~grown, grown),
        F.when(text.rlike(OTHER_WORDS), -1).otherwise(_by_kind(kind, *[_vote(text.rlike(h)) for h in HINTS])),
    ]


def features(x: Column, given: list[Column]) -> list[Column]:
    """Numbers of a candidate's hashed features."""
    kind, s = x["kind"], x["s"]
    left, right = _sides(x)
    sort = lambda c: F.when(c == "", "").when(c.rlike(r"\p{L}"), "a").when(c.rlike(r"\p{N}"), "9").when(c.rlike(r"\s"), " ").otherwise(c)
    shape = F.regexp_replace(F.regexp_replace(s, "[0-9]+", "9"), "[A-Za-z]+", "a")
    said = [F.length(_digits(s)).cast("string"), shape, F.concat(sort(left), F.lit("|"), sort(right)), F.regexp_extract(F.lower(x["before"]), r"([\p{L}]+)\W*$", 1), F.concat_ws("|", *[v.cast("string") for v in given[1:4]])]
    out, first = [], 0
    for c, size in zip(said, BUCKETS, strict=True):
        out.append((F.pmod(F.xxhash64(kind, c), F.lit(size)) + first).cast("int"))
        first += size
    return out


def _numbers(values: list[float]) -> Column:
    """Many numbers as one literal."""
    return F.split(F.lit(" ".join(map(repr, values))), " ").cast("array<double>")


def _sum_of(table: Column, at: list[Column]) -> Column:
    out = F.lit(0.0)
    for i in at:
        out = out + F.get(table, i)
    return out


def _chance(log_odds: Column) -> Column:
    return 1 / (1 + F.exp(-log_odds))


@dataclass
class Reliability:
    """Log odds of each kind, and of each labeler's votes: of kind, labeler and vote."""

    prior: list[float]
    weight: list[float]

    def posterior(self, kind: Column, given: list[Column]) -> Column:
        at = [(kind * LABELERS + j) * 3 + v + 1 for j, v in enumerate(given)]
        return _chance(F.get(_numbers(self.prior), kind) + _sum_of(_numbers(self.weight), at))


def _believed(rows: list[dict] | None = None) -> Reliability:
    """Reliabilities from sums of votes by posterior (none: the beliefs alone)."""
    sums = {r["kind"]: r for r in rows or ()}
    prior, weight = [], []
    for k in range(len(KINDS)):
        r = sums.get(k)
        yes, no = (r["yes"], r["no"]) if r else (0.0, 0.0)
        prior.append(math.log((yes + 1) / (no + 1)))
        for j in range(LABELERS):
            for v in range(3):
                a, b = (r[f"y{j}_{v}"], r[f"n{j}_{v}"]) if r else (0.0, 0.0)
                weight.append(math.log((a + BELIEF[v]) / (yes + sum(BELIEF)) / ((b + BELIEF[2 - v]) / (no + sum(BELIEF)))))
    return Reliability(prior, weight)


def reliabilities(patterns: DataFrame, rounds: int = ROUNDS) -> Reliability:
    """Expectation-maximisation over rows ``(kind, v0, ..., n)``; each round is one aggregate of that table."""
    given = [F.col(f"v{j}") for j in range(LABELERS)]
    model = _believed()
    for _ in range(rounds):
        p = model.posterior(F.col("kind"), given)
        rows = patterns.withColumn("yes", F.col("n") * p).withColumn("no", F.col("n") - F.col("yes"))
        parts = [F.sum(F.when(v == w - 1, F.col(c)).otherwise(0.0)).alias(f"{c[0]}{j}_{w}") for j, v in enumerate(given) for w in range(3) for c in ("yes", "no")]
        model = _believed([r.asDict() for r in rows.groupBy("kind").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"), *parts).collect()])
    return model


@dataclass
class Classifier:
    """Naive Bayes over hashed features: log odds without features, and of each feature."""

    prior: float
    weight: list[float]

    def score(self, x: Column) -> Column:
        return _chance(F.lit(self.prior) + _sum_of(_numbers(self.weight), features(x, votes(x))))


def fit(found: DataFrame) -> Classifier:
    """Learn from all candidates: reliabilities of the labelers, then the classifier by their posteriors."""
    c = found.select(F.explode("found").alias("x"))
    seen = votes(F.col("x"))
    seen = c.select(F.col("x.kind").alias("kind"), *[v.alias(f"v{j}") for j, v in enumerate(seen)], *[f.alias(f"f{j}") for j, f in enumerate(features(F.col("x"), seen))])
    # the corpus' candidates, by votes and features; of bounded width, written once
    seen = stage(seen.groupBy(*seen.columns).agg(F.count(F.lit(1)).alias("n")), "candidates")
    given = [f"v{j}" for j in range(LABELERS)]
    patterns = stage(seen.groupBy("kind", *given).agg(F.sum("n").alias("n")), "votes")
    p = reliabilities(patterns).posterior(F.col("kind"), [F.col(v) for v in given])
    soft = seen.select(F.col("n").cast("double").alias("n"), (F.col("n") * p).alias("yes"), F.array(*[F.col(f"f{j}") for j in range(len(BUCKETS))]).alias("f"))
    sums = soft.select("n", "yes", F.explode("f").alias("f")).groupBy("f").agg(F.sum("yes").alias("yes"), (F.sum("n") - F.sum("yes")).alias("no")).collect()
    yes, no = [0.0] * sum(BUCKETS), [0.0] * sum(BUCKETS)
    for r in sums:
        yes[r.f], no[r.f] = r.yes, r.no
    weight, first = [], 0
    for size in BUCKETS:
        all_yes, all_no = sum(yes[first : first + size]), sum(no[first : first + size])
        weight += [math.log((yes[i] + 1) / (all_yes + size) / ((no[i] + 1) / (all_no + size))) for i in range(first, first + size)]
        first += size
    return Classifier(math.log((sum(yes[: BUCKETS[0]]) + 1) / (sum(no[: BUCKETS[0]]) + 1)), weight)


def personal_spans(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", classifier: Classifier | None = None) -> DataFrame:
    """Rows ``(doc_id, spans)``: the array of ``(kind, start, end, base)`` by kind as in ``KINDS``, then start."""
    found = candidates(docs, id_col=id_col, text_col=text_col)
    model = classifier or fit(found)
    kept = F.filter("found", lambda x: x["base"] | (passes(x["kind"], x["s"]) & (model.score(x) >= 0.5)))
    name = lambda k: F.get(F.array(*map(F.lit, KINDS)), k)
    ordered = F.array_sort(F.transform(kept, lambda x: F.struct(x["kind"].alias("k"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"))))
    return found.select("doc_id", F.transform(ordered, lambda x: F.struct(name(x["k"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base"))).alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    spans = personal_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    out = spans.withColumn("b", F.filter("spans", lambda x: x["base"]))
    number = lambda kind: F.size(F.filter("b", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return out.select("doc_id", *map(number, KINDS), F.sha2(listed(F.col("b")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
