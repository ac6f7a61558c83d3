"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, language, line_dedup, minhash, mixing, sharding, simhash, substring_dedup, warc

Query = Callable[[SparkSession, str], DataFrame]


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: operator(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def queries() -> dict[str, Query]:
    return {
        "op1_line_dedup": _over("documents", line_dedup.op1_line_dedup),
        "op2_mixing": _over("documents", mixing.op2_mixing),
        "op3_language_id": language.op3_language_id,
        "op4_warc": _over("pages", warc.op4_warc),
        "op5_exact_dedup": _over("documents", exact_dedup.op5_exact_dedup),
        "op6_substring_dedup": _over("documents", substring_dedup.op6_substring_dedup),
        "op7_minhash": _over("documents", minhash.op7_minhash),
        "op8_bpe": _over("documents", bpe.op8_bpe),
        "op9_simhash": _over("documents", simhash.op9_simhash),
        "op10_sharding": _over("documents", sharding.op10_sharding),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_line_dedup": line_dedup.ORACLE,
        "op2_mixing": mixing.ORACLE,
        "op4_warc": warc.ORACLE,
        "op5_exact_dedup": exact_dedup.ORACLE,
        "op6_substring_dedup": substring_dedup.ORACLE,
    }
