"""Row numbers and running totals over a whole table in a total order.

A window without partitions would pull the table into one task. Here the table is range-sorted
and written once; the parquet reader then supplies each row's position inside its file, and the
only thing gathered on the driver is one count per file.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.hashing import shuffle_key
from nearfield.session import scratch_path

_FILE = "__file"
_POS = "__pos"


def _sorted_files(df: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """Write ``df`` in key order and read it back with file number and position in the file.

    The keys must end in something unique, so that a frequent key value is spread over several
    range partitions instead of landing in one.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "ordered")
    df.sort(*keys).write.option("maxRecordsPerFile", 0).parquet(path)
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^part-(\d+)", 1).cast("int")
    return (
        spark.read.schema(df.schema)
        .parquet(path)
        .select(*df.columns, number.alias(_FILE), F.col("_metadata.row_index").alias(_POS))
    )


def _with_offsets(stored: DataFrame, amount: Column) -> tuple[DataFrame, int]:
    """Join each file's total of ``amount`` over all earlier files (one row per file)."""
    per_file = stored.groupBy(_FILE).agg(amount.alias("n")).orderBy(_FILE).collect()
    offsets, total = [], 0
    for row in per_file:
        offsets.append((row[_FILE], total))
        total += row["n"]
    spark = stored.sparkSession
    table = spark.createDataFrame(offsets, f"{_FILE} int, __offset long")
    return stored.join(F.broadcast(table), _FILE), total


def number_rows_total(
    df: DataFrame, keys: Sequence[Column | str], column: str = "idx"
) -> tuple[DataFrame, int]:
    """:func:`number_rows` together with the number of rows."""
    stored = _sorted_files(df, keys)
    with_offset, total = _with_offsets(stored, F.max(_POS) + 1)
    idx = (F.col("__offset") + F.col(_POS)).alias(column)
    return with_offset.select(*df.columns, idx), total


def number_rows(df: DataFrame, keys: Sequence[Column | str], column: str = "idx") -> DataFrame:
    """Contiguous ids 0..N-1 in the order of ``keys`` (end them with a unique column)."""
    return number_rows_total(df, keys, column)[0]


def running_total(
    df: DataFrame, keys: Sequence[Column | str], amount: str, column: str = "total"
) -> DataFrame:
    """Inclusive running sum of ``amount`` over the whole table in the order of ``keys``."""
    stored = _sorted_files(df, keys)
    with_offset, _ = _with_offsets(stored, F.sum(amount))
    in_file = Window.partitionBy(_FILE).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    value = F.col("__offset") + F.sum(amount).over(in_file)
    return with_offset.select(*df.columns, value.alias(column))


def reorder(
    df: DataFrame, keys: Sequence[Column | str], id_col: str = "id", old: str = "original_id"
) -> DataFrame:
    """New contiguous ids in key order; the former id is kept in ``old``."""
    rest = [c for c in df.columns if c != id_col]
    numbered = number_rows(df, [*keys, id_col], "__new")
    return numbered.select(
        F.col("__new").alias(id_col), F.col(id_col).alias(old), *rest
    )


def reorder_randomly(
    df: DataFrame, seed: int, id_col: str = "id", old: str = "original_id"
) -> DataFrame:
    return reorder(df, [shuffle_key(seed, F.col(id_col))], id_col, old)


def id_mapping(
    df: DataFrame, keys: Sequence[Column | str], id_col: str = "id"
) -> DataFrame:
    """``(old_id, new_id)`` of a reordering. Only the key columns are moved, never the vectors."""
    named = [k if isinstance(k, Column) else F.col(k) for k in keys]
    narrow = df.select(
        F.col(id_col).alias("old_id"), *[k.alias(f"__k{i}") for i, k in enumerate(named)]
    )
    order = [f"__k{i}" for i in range(len(named))] + ["old_id"]
    return number_rows(narrow, order, "new_id").select("old_id", "new_id")


def block_of(idx: Column, rows_per_block: int) -> Column:
    return F.floor(idx / F.lit(rows_per_block)).cast("long")


def every_nth(numbered: DataFrame, total: int, target: int, idx: str = "idx") -> DataFrame:
    """Thin to about ``target`` rows by keeping every n-th row."""
    return numbered.where(F.col(idx) % max(1, total // target) == 0)
