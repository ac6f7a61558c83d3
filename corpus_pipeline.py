"""Documents made ready for training: five stages, each written as Parquet and read again by the next.

A stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; all but the last return
the columns of documents. A stage deletes the scratch tables of the stage before it, which is why a stage's result must be
stored before the next one starts; nobody else's scratch is touched.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessitura.llm import bpe, common, exact_dedup, language, mixing, simhash

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
OWNER = "pipeline"  # of the stages' scratch
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told go."""
    with common.owned(spark, OWNER):
        return language.keep_known(docs).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest doc_id stays."""
    with common.owned(spark, OWNER):
        return exact_dedup.keep_first(docs).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the smallest doc_id stays."""
    with common.owned(spark, OWNER):
        return simhash.keep_one(docs).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    with common.owned(spark, OWNER):
        return mixing.mixed(docs).select(*COLUMNS)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the text that the ids decode to, a row for each copy taken."""
    with common.owned(spark, OWNER):
        return bpe.encode(docs, decoded=True).select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("text", 256).alias("decoded_sha256"))


STAGES: list[tuple[str, Stage]] = [
    ("language ID", identify_language),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode_tokens),
]

# SQL has neither the fingerprints of the third stage nor the tokens of the fifth; the tests hold run() against a
# brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = common.scratch_path(spark, name.replace(" ", "-"))  # nobody's, so that the next stage can read it
        stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            common.delete(spark, last)
        docs, last = spark.read.parquet(path), path
    return docs
