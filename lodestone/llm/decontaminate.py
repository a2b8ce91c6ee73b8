"""Benchmark decontamination: short test items found inside long documents.

Method (DataFrame functions only).  Text becomes lower-case words of letters and
digits and five-word shingles.  Items fall into size partitions (powers of two of
their distinct shingle count); each partition fixes how many of an item's smallest
shingle hashes form its sketch.  An item of ``n`` shingles of which at least
``need = ceil(threshold * n)`` occur in a document misses at most ``n - need`` of
them, so of its ``u - ceil(threshold * u) + 1`` smallest hashes (``u``: the
partition's upper bound, hence at least ``n - need + 1`` of them) one at least
is in the document: the MinHash search loses nothing, however long the document.  Only items have sketches: a long document's own
smallest hashes say nothing about a short item, so all hashes of the document are looked up, and instead of an estimate the bound
above decides which pairs are candidates.  These are then verified by exact containment of the shingles as strings.

Defined cases: a null or shorter text has no shingles and matches nothing, nor does
an item of under five words; null ids are ids like any other; rows that share an id
are one document (or item); extra columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.folds import fresh
from lodestone.plans.staging import stage

WORDS = 5
THRESHOLD = 0.8
#: Rows that may be broadcast, and bytes of their texts; beyond it the joins shuffle.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits, in order."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def shingles(df: DataFrame, key: str, text: str, k: int = WORDS) -> DataFrame:
    """Rows ``(key, n, s)``: one for each window of ``k`` words, ``s`` a struct of them, ``n`` windows."""
    w = df.select(F.col(key), words(F.col(text)).alias("w")).where(F.size("w") >= k)
    n = F.size("w") - (k - 1)
    w = w.select(key, n.alias("n"), *[F.slice("w", i + 1, n).alias(f"w{i}") for i in range(k)])
    return w.select(key, "n", F.explode(F.arrays_zip(*[f"w{i}" for i in range(k)])).alias("s"))


def _hash(k: int) -> Column:
    return F.xxhash64(*[F.col(f"s.w{i}") for i in range(k)])


def _text(k: int) -> Column:
    return F.concat_ws(" ", *[F.col(f"s.w{i}") for i in range(k)])


def _sized(small: DataFrame, limit: int) -> DataFrame:
    """Broadcast only what was counted and is within the limits of rows and bytes."""
    texts = [F.octet_length(c) for c, t in small.dtypes if t == "string"]
    size = sum(texts, F.lit(0).cast("long"))
    n, held = small.limit(limit + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(small) if n <= limit and held <= BROADCAST_BYTES else small


def item_shingles(items: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """Rows ``(item_id, h, shingle)``, distinct."""
    s = shingles(items.select(F.col(key).alias("item_id"), F.col(text).alias("t")), "item_id", "t", k)
    return s.select("item_id", _hash(k).alias("h"), _text(k).alias("shingle")).distinct()


def sketches(shingled: DataFrame, threshold: float) -> DataFrame:
    """Rows ``(h, item_id)``: the smallest hashes of each item, as many as its size partition asks for."""
    per = shingled.groupBy("item_id").agg(F.sort_array(F.collect_set("h")).alias("hs"))
    n = F.size("hs")
    upper = F.pow(F.lit(2.0), F.ceil(F.log2(n.cast("double")))).cast("long")  # sizes (upper/2, upper]
    per = per.withColumn("m", upper - F.ceil(upper * F.lit(threshold)) + 1)
    return per.select("item_id", F.explode(F.slice("hs", F.lit(1), F.least(F.col("m").cast("int"), n))).alias("h"))


def contamination(
    docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id",
    item_text_col: str = "text", k: int = WORDS, threshold: float = THRESHOLD, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Rows ``(doc_id, item_id, n_shared, n_item_shingles, containment)`` for each document
    that holds at least ``threshold`` of an item's distinct ``k``-word shingles."""
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    known = item_shingles(items, item_id_col, item_text_col, k)
    sketch = _sized(sketches(known, threshold), broadcast_rows)
    hits = shingles(d, "doc_id", "t", k).select("doc_id", _hash(k).alias("h")).join(sketch, "h")
    few = stage(hits.select(F.col("doc_id").alias("c")).distinct(), "candidates")
    near = d.join(_sized(few, broadcast_rows), F.col("doc_id").eqNullSafe(F.col("c")), "left_semi")
    whole = shingles(near, "doc_id", "t", k).select("doc_id", _text(k).alias("shingle"))
    shared = whole.join(_sized(known.select("item_id", "shingle"), broadcast_rows), "shingle")
    shared = shared.groupBy("doc_id", "item_id").agg(F.count_distinct("shingle").alias("n_shared"))
    total = known.groupBy(F.col("item_id").alias("i")).agg(F.count_distinct("shingle").alias("n_item_shingles"))
    found = shared.join(_sized(total, broadcast_rows), F.col("item_id").eqNullSafe(F.col("i")))
    found = found.where(F.col("n_shared") >= F.ceil(F.col("n_item_shingles") * F.lit(threshold)))
    return found.select("doc_id", "item_id", "n_shared", "n_item_shingles", (F.col("n_shared") / F.col("n_item_shingles")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, columns unchanged, that hold no item; ties and repeats stay or go together."""
    id_col = options.get("id_col", "doc_id")
    name = fresh("__contaminated_id", docs)
    # ids only: counted, so that few of them are broadcast and no text moves
    bad = stage(contamination(docs, items, **options).select(F.col("doc_id").alias(name)).distinct(), "contaminated")
    return docs.join(_sized(bad, options.get("broadcast_rows", BROADCAST_ROWS)), docs[id_col].eqNullSafe(F.col(name)), "left_anti")


SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM dw WHERE len(w) >= 5)),
bs AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS s FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - 4)) AS i FROM bw WHERE len(w) >= 5)),
bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT doc_id, item_id, count(*)::BIGINT AS n_shared, any_value(n)::BIGINT AS n_item_shingles, count(*)::DOUBLE / any_value(n) AS containment
FROM ds JOIN bs USING (s) JOIN bn USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= ceil(any_value(n) * 0.8)
"""


def query(spark, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
