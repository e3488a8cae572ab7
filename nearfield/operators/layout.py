"""File layout: how many rows go in which file, and writing them so."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.operators.sampling import ROW_GROUP

GIB = 1024**3


@dataclass(frozen=True)
class Layout:
    rows_per_file: int
    files: int
    full_files: int
    remainder: int


def plan_layout(
    total_bytes: int, total_rows: int, limit_bytes: float, margin: float = 1.0,
    group_rows: int = ROW_GROUP,
) -> Layout:
    """Rows per file: the most whole row groups under ``limit * margin``, at least one."""
    fitting = int(limit_bytes * margin / (total_bytes / total_rows))
    rows = max(1, fitting // group_rows) * group_rows
    full, remainder = divmod(total_rows, rows)
    return Layout(rows, full + (1 if remainder else 0), full, remainder)


def layout_columns(
    total_bytes: Column, total_rows: Column, limit_bytes: float, margin: float = 1.0,
    group_rows: int = ROW_GROUP,
) -> Column:
    """:func:`plan_layout` for a table of tables, as a struct column."""
    per_row = total_bytes / total_rows.cast("double")
    fitting = F.floor(F.lit(limit_bytes * margin) / per_row)
    rows = (F.greatest(F.lit(1), F.floor(fitting / F.lit(group_rows))) * group_rows).cast("long")
    return F.struct(
        rows.alias("rows_per_file"),
        F.ceil(total_rows / rows).cast("long").alias("files"),
        F.floor(total_rows / rows).cast("long").alias("full_files"),
        (total_rows % rows).alias("remainder"),
    )


def stored_size(df: DataFrame) -> DataFrame:
    """One row: files, bytes and rows of a table read from files."""
    files = df.select("_metadata.file_path", "_metadata.file_size")
    per_file = files.groupBy("file_path").agg(
        F.max("file_size").alias("size"), F.count("*").alias("rows")
    )
    return per_file.agg(
        F.count("*").alias("files"), F.sum("size").alias("bytes"), F.sum("rows").alias("rows")
    )


def subset_rows(
    total_bytes: int, total_rows: int, target_gb: float, group_rows: int = ROW_GROUP
) -> int:
    """How many leading rows fill ``target_gb`` GiB, in whole row groups, capped at the table."""
    wanted = int(target_gb * GIB / (total_bytes / total_rows))
    return min(wanted, total_rows) // group_rows * group_rows


def file_index(numbered: DataFrame, rows_per_file: int, idx: str = "idx") -> DataFrame:
    """Adds ``file_idx`` so that every file but the last is full."""
    return numbered.withColumn(
        "file_idx", F.floor(F.col(idx) / F.lit(rows_per_file)).cast("int")
    )


def split_index(numbered: DataFrame, sizes: Sequence[int], idx: str = "idx") -> DataFrame:
    """Adds ``file_idx`` from given row counts per file (a list of file sizes, not of rows).

    Fails where rows, numbered from 0, are not as many as the sizes say.
    """
    spark = numbered.sparkSession
    starts, at = [], 0
    for number, size in enumerate(sizes):
        if size:
            starts.append((at, at + size, number))
        at += size
    last = numbered.agg(F.max(idx).alias("last")).first()["last"]
    if (-1 if last is None else last) != at - 1:
        raise ValueError(f"files of {at} rows in all do not fit {0 if last is None else last + 1} rows")
    if len(starts) <= 1000:
        place = F.lit(None).cast("int")
        for low, _, number in starts:
            place = F.when(F.col(idx) >= low, number).otherwise(place)
        return numbered.withColumn("file_idx", place)
    table = spark.createDataFrame(starts, "low long, high long, file_idx int")
    # An equality on coarse steps turns the range lookup into a hash join.
    step = max(1, math.ceil(at / len(starts)))
    table = table.withColumn(
        "__step", F.explode(F.sequence(F.floor(F.col("low") / step), F.floor((F.col("high") - 1) / step)))
    )
    keyed = numbered.withColumn("__step", F.floor(F.col(idx) / step))
    inside = (F.col(idx) >= F.col("low")) & (F.col(idx) < F.col("high"))
    joined = keyed.join(F.broadcast(table), "__step").where(inside)
    return joined.select(*numbered.columns, "file_idx")


def shard_name(prefix: str, number: Column, files: Column | int) -> Column:
    """``prefix-00-of-10.parquet``, padded to the width of the file count and at least two."""
    count = F.lit(files) if isinstance(files, int) else files
    width = F.greatest(F.lit(2), F.length(count.cast("string")))
    padded = F.lpad(number.cast("string"), width, F.lit("0"))
    return F.concat(F.lit(f"{prefix}-"), padded, F.lit("-of-"), count.cast("string"), F.lit(".parquet"))


def file_report(indexed: DataFrame, idx: str = "idx") -> DataFrame:
    """Rows and first and last row number per file."""
    return indexed.groupBy("file_idx").agg(
        F.count("*").alias("rows"), F.min(idx).alias("first"), F.max(idx).alias("last")
    )
