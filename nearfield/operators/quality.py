"""Checks of tables, one small result each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from nearfield.functions.vectors import is_valid_vector
from nearfield.operators.ranges import range_counts

def equal_counts(left: DataFrame, right: DataFrame) -> DataFrame:
    sides = left.select(F.lit(1).alias("a"), F.lit(0).alias("b")).unionAll(
        right.select(F.lit(0).alias("a"), F.lit(1).alias("b"))
    )
    totals = sides.agg(
        F.coalesce(F.sum("a"), F.lit(0)).cast("long").alias("left_rows"),
        F.coalesce(F.sum("b"), F.lit(0)).cast("long").alias("right_rows"),
    )
    return totals.withColumn("ok", F.col("left_rows") == F.col("right_rows"))


def bijection(mapping: DataFrame) -> DataFrame:
    """Whether a mapping covers 0..N-1 once on the new side and has no id twice on the old."""
    sides = F.explode(F.array(
        F.struct(F.lit(False).alias("new"), F.col("old_id").alias("id")),
        F.struct(F.lit(True).alias("new"), F.col("new_id").alias("id")),
    ))
    ids = mapping.select(sides.alias("s")).groupBy("s.new", "s.id").agg(F.count("*").alias("n"))
    new = F.col("new")
    totals = ids.agg(
        F.coalesce(F.sum(F.when(new, F.col("n"))), F.lit(0)).alias("pairs"),
        F.count_if(~new).alias("distinct_old_id"),
        F.count_if(new).alias("distinct_new_id"),
        F.min(F.when(new, F.col("id"))).alias("low"),
        F.max(F.when(new, F.col("id"))).alias("high"),
    )
    n = F.col("pairs")
    fine = (
        (F.col("distinct_old_id") == n) & (F.col("distinct_new_id") == n)
        & (F.col("low") == 0) & (F.col("high") == n - 1)
    )
    return totals.select("pairs", "distinct_old_id", "distinct_new_id", fine.alias("ok"))


def unsorted_places(
    numbered: DataFrame, key: str, idx: str = "idx", rows_per_block: int = 122_880
) -> DataFrame:
    """One row: how many rows have a smaller key than the row before them.

    Neighbours inside a block are compared in a window over that block; the first row of a block
    is compared with the last row of the block before it.
    """
    block = F.floor(F.col(idx) / rows_per_block)
    rows = numbered.select(F.col(idx).alias("i"), F.col(key).alias("k"), block.alias("block"))
    within = Window.partitionBy("block").orderBy("i")
    marked = rows.withColumn("down", F.col("k") < F.lag("k").over(within))
    inside = marked.groupBy("block").agg(
        F.count_if("down").alias("falls"), F.min_by("k", "i").alias("head"),
        F.max_by("k", "i").alias("tail"), F.count("*").alias("n"),
    )
    before = inside.select((F.col("block") + 1).alias("block"), F.col("tail").alias("previous"))
    falls = F.col("falls") + F.coalesce((F.col("head") < F.col("previous")).cast("long"), F.lit(0))
    return inside.join(before, "block", "left").agg(
        F.sum("n").alias("rows"), F.sum(falls).alias("falls")
    ).withColumn("ok", F.col("falls") == 0)


def vector_report(df: DataFrame, emb: str, dim: int) -> DataFrame:
    """Vectors in all, and how many are null, of another dimension or not finite."""
    vec = F.col(emb)
    wrong = vec.isNotNull() & (F.size(vec) != dim)
    valid = is_valid_vector(vec, dim)
    return df.agg(
        F.count("*").alias("vectors"),
        F.count_if(vec.isNull()).alias("nulls"),
        F.count_if(wrong).alias("wrong_dimension"),
        F.count_if(vec.isNotNull() & ~wrong & ~valid).alias("not_finite"),
    )


def inexact_filters(values: DataFrame, attr: str, filters: DataFrame) -> DataFrame:
    """Range filters whose match count differs from their target."""
    counts = range_counts(values, attr, filters)
    return filters.join(counts, "qid").where(F.col("count") != F.col("target_count"))


def differing_values(
    left: DataFrame, right: DataFrame, keys: Sequence[str], value: str
) -> DataFrame:
    """One row: keys in all, keys on one side only and keys whose values differ."""
    a = left.select(*keys, F.col(value).alias("__a"), F.lit(True).alias("__la"))
    b = right.select(*keys, F.col(value).alias("__b"), F.lit(True).alias("__lb"))
    both = a.join(b, list(keys), "full_outer")
    one_sided = F.col("__la").isNull() | F.col("__lb").isNull()
    return both.agg(
        F.count("*").alias("keys"),
        F.count_if(one_sided).alias("one_sided"),
        F.count_if(~one_sided & ~F.col("__a").eqNullSafe(F.col("__b"))).alias("different"),
    )


def array_length_is(df: DataFrame, column: str, expected: int, strict: bool = False) -> DataFrame:
    """Drop rows whose array has another length (or is missing); fail on them in strict mode."""
    length = F.coalesce(F.array_size(column), F.lit(-1))
    if not strict:
        return df.where(length == expected)
    message = F.format_string(f"expected {expected} values but got %d", length)
    checked = F.when(length == expected, F.col(column)).otherwise(
        F.raise_error(message).cast(df.schema[column].dataType)
    )
    return df.withColumn(column, checked)
