"""Shared helpers of the text operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.session import materialize, ship_package

__all__ = ["by_batch", "id_and_text", "materialize"]


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` only, whatever else the table holds; a null text is empty."""
    return docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"),
    )


def by_batch(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]],
             schema: str) -> DataFrame:
    """Run a function of Arrow batches in every task; it may give several batches for one."""
    ship_package(df.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from fn(batch)

    return df.mapInArrow(each, schema)
