"""The queries of the corpus operators: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import contamination, language, licenses, packing, repair, sharding, simhash, suffixes, syncmers, wordvectors


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _tokenizer(name: str) -> str:
    """The vocabulary file's place; files stay where the box has them."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": lambda s, d: sharding.op1_sharding(_docs(s, d)),
        "op2_quality": lambda s, d: wordvectors.op2_quality(_docs(s, d), s.read.parquet(f"{d}/labels.parquet")),
        "op3_packing": lambda s, d: packing.op3_packing(_docs(s, d), _tokenizer("word_bpe_49k.json")),
        "op4_language": lambda s, d: language.op4_language(_docs(s, d)),
        "op5_simhash": lambda s, d: simhash.op5_simhash(_docs(s, d)),
        "op6_license_scan": lambda s, d: licenses.op6_license_scan(_docs(s, d)),
        "op7_token_ids": lambda s, d: repair.op7_token_ids(_docs(s, d), _tokenizer("byte_bpe_50k.json")),
        "op8_decontamination": lambda s, d: contamination.op8_decontamination(_docs(s, d), s.read.parquet(f"{d}/benchmark.parquet")),
        "op9_syncmers": lambda s, d: syncmers.op9_syncmers(_docs(s, d)),
        "op10_suffix_dedup": lambda s, d: suffixes.op10_suffix_dedup(_docs(s, d)),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_license_scan": licenses.oracle(),
        "op8_decontamination": contamination.ORACLE,
    }
