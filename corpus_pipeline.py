"""A training corpus from raw documents: score, deduplicate, decontaminate, mix, tokenise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from nearfield.llm import decontaminate, mixing, quality, simhash, tokens
from nearfield.llm.queries import table, tokenizer_path
from nearfield.session import scratch_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels it may see, does not reject."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every SimHash component."""
    return simhash.keep_first(docs)


def unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item, not even an edited one, is found."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources; a document that is taken twice has two rows."""
    return mixing.repeat(mixing.mix(docs))


def tokenised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place, length and checksum of every document's token ids, read back from their files."""
    return tokens.op5_token_lists(docs, tokenizer_path())


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good),
    ("SimHash near-dedup", distinct),
    ("benchmark decontamination", unseen),
    ("mixing sources to target weights", mixed),
    ("token-ID / binary output", tokenised),
]

# Trees, SimHash, alignment and the tokenizer cannot be said in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each one's rows are written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-").replace("/", ""))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
