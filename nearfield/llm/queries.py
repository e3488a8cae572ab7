"""The registered queries of this subpackage and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import (
    alignment, chat, compression, decontaminate, exact, licenses, lines, mixing, neighbours, pii, quality,
    simhash, tokens,
)

Query = Callable[[SparkSession, str], DataFrame]

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op1_quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.op2_perspectives(table(spark, sf_dir, "conversations"))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.op3_benchmark_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.op4_block_nearest(table(spark, sf_dir, "embeddings"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.op5_token_lists(table(spark, sf_dir, "documents"), tokenizer_path())


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.op6_simhash_classes(table(spark, sf_dir, "documents"))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.op7_fuzzy_lines(table(spark, sf_dir, "documents"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.op9_personal_data(table(spark, sf_dir, "documents"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op10_water_filled_mix(table(spark, sf_dir, "documents"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.op11_resident_lloyd(table(spark, sf_dir, "embeddings"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.op12_token_alignment(
        table(spark, sf_dir, "documents"), tokenizer_path(), tokenizer_path(PIECES))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.op13_exact_classes(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "op1_quality_scores": op1,
    "op2_perspectives": op2,
    "op3_benchmark_leaks": op3,
    "op4_block_nearest": op4,
    "op5_token_lists": op5,
    "op6_simhash_classes": op6,
    "op7_fuzzy_lines": op7,
    "op8_license_spans": op8,
    "op9_personal_data": op9,
    "op10_water_filled_mix": op10,
    "op11_resident_lloyd": op11,
    "op12_token_alignment": op12,
    "op13_exact_classes": op13,
}

# The others have no SQL: trained models, SimHash with components, alignment, the tokenizer.
ORACLES: dict[str, str] = {
    "op2_perspectives": chat.SQL,
    "op4_block_nearest": neighbours.SQL,
    "op8_license_spans": licenses.sql(),
    "op10_water_filled_mix": mixing.sql(),
    "op11_resident_lloyd": compression.sql(),
    "op13_exact_classes": exact.SQL,
}
