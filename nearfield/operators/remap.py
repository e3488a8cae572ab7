"""Following renumbered ids through tables and neighbour lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.operators.numbering import number_rows


def remap_rows(df: DataFrame, mapping: DataFrame, id_col: str = "id", strict: bool = True) -> DataFrame:
    """Replace row ids by their new ids. An id without a new one is an error in strict mode and
    null otherwise."""
    joined = df.join(
        mapping.select(F.col("old_id").alias(id_col), F.col("new_id")), id_col, "left"
    )
    rest = [c for c in df.columns if c != id_col]
    return joined.select(_known(F.col("new_id"), F.col(id_col), strict).alias(id_col), *rest)


def _known(new_id: Column, old_id: Column, strict: bool) -> Column:
    if not strict:
        return new_id
    message = F.concat(F.lit("id without a new id: "), old_id.cast("string"))
    return F.when(new_id.isNull(), F.raise_error(message).cast("long")).otherwise(new_id)


def remap_lists(
    lists: DataFrame, mapping: DataFrame, column: str = "neighbors_id", id_col: str = "id",
    strict: bool = True,
) -> DataFrame:
    """Replace the ids inside lists, keeping their order; the row's own id is not touched."""
    items = lists.select(id_col, F.posexplode(column).alias("pos", "old_id"))
    joined = items.join(mapping.select("old_id", "new_id"), "old_id", "left")
    new = _known(F.col("new_id"), F.col("old_id"), strict)
    rebuilt = joined.groupBy(id_col).agg(
        F.array_sort(F.collect_list(F.struct(F.col("pos"), new.alias("new")))).alias("__items")
    )
    ids = F.transform("__items", lambda x: x["new"])
    none = F.array().cast("array<bigint>")
    return (
        lists.drop(column)
        .join(rebuilt, id_col, "left")
        .withColumn(column, F.coalesce(ids, none))
        .drop("__items")
    )


def inverse(mapping: DataFrame) -> DataFrame:
    return mapping.select(F.col("new_id").alias("old_id"), F.col("old_id").alias("new_id"))


def zip_by_position(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, column: str = "qid"
) -> DataFrame:
    """Pair the i-th rows of two tables in their own orders; both must be equally long."""
    a, b = number_rows(left, [left_key], column), number_rows(right, [right_key], column)
    n, m = left.count(), right.count()
    if n != m:
        raise ValueError(f"tables differ in length: {n} and {m}")
    return a.join(b, column)
