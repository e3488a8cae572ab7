"""Counts, selectivity and block skipping of range predicates.

A count per range is a difference of two running totals, so values and range ends are sorted
together once. The cost is one sort of N + 2Q rows, never Q x N comparisons.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.numbering import block_of, running_total


def _upto(values: DataFrame, attr: str, points: DataFrame) -> DataFrame:
    """``points`` (``qid``, ``point`` and ``side``) with the number of values before each point.

    Points of side 0 sort before equal values, those of side 2 after them. Values and points keep
    their own types; the union gives both the wider one, so nothing is truncated.
    """
    kind = points.schema["qid"].dataType
    counted = (
        values.where(F.col(attr).isNotNull())
        .groupBy(F.col(attr).alias("point"))
        .agg(F.count("*").alias("n"))
        .select("point", F.lit(1).alias("side"), F.lit(None).cast(kind).alias("qid"), "n")
    )
    asked = points.select("point", "side", "qid", F.lit(0).cast("long").alias("n"))
    totals = running_total(counted.unionByName(asked), ["point", "side", "qid"], "n")
    return totals.where(F.col("side") != 1)


def range_counts(
    values: DataFrame, attr: str, ranges: DataFrame, *, qid: str = "qid",
    low: str = "range_start", high: str = "range_end",
) -> DataFrame:
    """``(qid, count)``: rows whose ``attr`` lies in the closed range. Empty ranges count 0."""
    def end(column: str, side: int) -> DataFrame:
        return ranges.select(
            F.col(qid).alias("qid"), F.col(column).alias("point"), F.lit(side).alias("side")
        )

    totals = _upto(values, attr, end(low, 0).unionByName(end(high, 2)))
    below = F.max(F.when(F.col("side") == 0, F.col("total")))
    upto = F.max(F.when(F.col("side") == 2, F.col("total")))
    return totals.groupBy(F.col("qid").alias(qid)).agg(
        F.greatest(upto - below, F.lit(0)).alias("count")
    )


def matches_per_query(queries: DataFrame, values: DataFrame, key: str) -> DataFrame:
    """``(qid, n)``: rows of ``values`` with the query's key, counted once per key; 0 if none."""
    sizes = values.groupBy(key).agg(F.count("*").alias("n"))
    return queries.select("qid", key).join(sizes, key, "left").select(
        "qid", F.coalesce("n", F.lit(0)).cast("long").alias("n")
    )


def selectivities(values: DataFrame, attr: str, ranges: DataFrame, **names: str) -> DataFrame:
    """``(qid, range_start, range_end, count, selectivity)`` against the whole table."""
    total = values.count()
    qid = names.get("qid", "qid")
    counts = range_counts(values, attr, ranges, **names)
    return ranges.join(counts, qid).withColumn(
        "selectivity", F.col("count") / F.lit(float(total))
    )


def eligible(selectivity: DataFrame, low: float, high: float) -> DataFrame:
    """Queries whose selectivity lies in the closed window."""
    if low > high:
        raise ValueError(f"selectivity window is empty: {low} > {high}")
    return selectivity.where(F.col("selectivity").between(low, high))


def block_profile(numbered: DataFrame, attr: str, rows_per_block: int, idx: str = "idx") -> DataFrame:
    """Rows, minimum and maximum of ``attr`` per block of consecutive rows."""
    return numbered.groupBy(block_of(F.col(idx), rows_per_block).alias("block")).agg(
        F.count("*").alias("rows"), F.min(attr).alias("low"), F.max(attr).alias("high")
    )


def skippable_blocks(blocks: DataFrame, ranges: DataFrame) -> DataFrame:
    """Share of blocks every range can skip by their minimum and maximum.

    A block is skipped when it ends below the range or starts above it, never both, so the number
    is two one-sided range counts.
    """
    total = blocks.count()
    starts = ranges.select("qid", F.col("range_start").alias("point"), F.lit(0).alias("side"))
    ends = ranges.select("qid", F.col("range_end").alias("point"), F.lit(2).alias("side"))
    known = blocks.where(F.col("high").isNotNull()).count()
    reaching = _upto(blocks, "high", starts).select("qid", (F.lit(known) - F.col("total")).alias("not_below"))
    started = _upto(blocks, "low", ends).select("qid", F.col("total").alias("not_above"))
    # every block with values starts by the end of a range or ends before its start, or both
    overlap = F.col("not_below") + F.col("not_above") - F.lit(known)
    return reaching.join(started, "qid").select(
        "qid",
        (F.lit(total) - overlap).alias("skipped"),
        ((F.lit(total) - overlap) / F.lit(float(total))).alias("skip_share"),
    )
