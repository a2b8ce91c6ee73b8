"""From documents to token files: quality, near-duplicates, benchmark leaks, mixing, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next one's documents.  All but the last return the columns of documents.  The mixing
stage's decision is an order; it returns the rows in that order over its partitions, so that the
files it is written to hold it, and the last stage packs the tokens in the order of files and rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, mixing, quality, simhash, token_output
from lodestone.plans.staging import new_path, stage

#: Near-duplicates in the pipeline: five-word shingles, a similarity of 0.8 or more of their sets, fingerprints of 256 bits.
SHINGLE_WORDS, SIMILARITY, WIDE = 5, 0.8, 4


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality.keep_good(docs, quality.learn(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return simhash.keep_one(docs, k=SHINGLE_WORDS, similarity=SIMILARITY, wide=WIDE)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, in the order of the Pfair schedule of their sources."""
    return mixing.in_mixed_order(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the order of ``docs``' files and rows; their digests, read back."""
    path = new_path(spark, "pipeline-tokens")
    if docs.inputFiles():
        part = F.regexp_extract("_metadata.file_path", r"part-(\d+)[^/]*$", 1).cast("long")  # a number: part-100000 follows part-99999
        docs = docs.select("doc_id", "text", part.alias("__part"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
        token_output.write_tokens(docs, path, token_output.tokenizer_path(), order=[F.col("__part"), F.col("__file"), F.col("__row")])
    else:  # rows that are in no file have no order but their ids'
        token_output.write_tokens(docs, path, token_output.tokenizer_path())
    return token_output.read_digests(spark, path)


STAGES = [
    ("quality classifier", keep_good),
    ("SimHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_sources),
    ("token-ID / binary output", write_tokens),
]

#: Trained classifiers and tokenizers are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), "-".join(name.split()[:1]))
    return STAGES[-1][1](spark, docs, sf_dir)
