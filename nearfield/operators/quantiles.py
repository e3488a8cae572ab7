"""Ranks and exact quantiles per group, safe for groups that hold most of the table.

Rows are numbered once over (group, value, id), so a group is a run of consecutive numbers and a
quantile is a lookup of two numbers. No task ever holds a whole group.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.operators.numbering import number_rows
from nearfield.session import materialize

# Rows of positions (some 40 bytes each) up to which they are broadcast.
_BROADCAST_POSITIONS = 500_000


def group_starts(numbered: DataFrame, groups: Sequence[str], idx: str = "idx") -> DataFrame:
    """First number and size of every group of a table numbered in group order."""
    return numbered.groupBy(*groups).agg(
        F.min(idx).alias("group_start"), F.count("*").alias("group_size")
    )


def rank_within(
    df: DataFrame, groups: Sequence[str], keys: Sequence[Column | str], column: str = "rank"
) -> DataFrame:
    """1-based position of every row inside its group (end ``keys`` with a unique column)."""
    numbered = number_rows(df, [*groups, *keys], "__idx")
    starts = group_starts(numbered, groups, "__idx").drop("group_size")
    return numbered.join(starts, list(groups)).select(
        *df.columns, (F.col("__idx") - F.col("group_start") + 1).alias(column)
    )


def ordered_values(df: DataFrame, groups: Sequence[str], value: str, id_col: str) -> DataFrame:
    """The (group, value) rows numbered in order of group, value and id."""
    narrow = df.select(*groups, F.col(value).cast("double").alias("value"), id_col)
    narrow = narrow.where(F.col("value").isNotNull())
    return number_rows(narrow, [*groups, "value", id_col]).drop(id_col)


def values_at(ordered: DataFrame, wanted: DataFrame, position: str) -> DataFrame:
    """``wanted`` with the value at the table-wide number in column ``position``. A few positions,
    which are counted first, are sent to the ordered table, which then stays where it is."""
    wanted = materialize(wanted, "positions")
    if wanted.count() <= _BROADCAST_POSITIONS:
        wanted = F.broadcast(wanted)
    lookup = ordered.select(F.col("idx").alias(position), F.col("value"))
    return wanted.join(lookup, position)


def quantiles_of(
    ordered: DataFrame, groups: Sequence[str], probabilities: Mapping[str, float]
) -> DataFrame:
    """Linearly interpolated quantiles per group, one column per name."""
    asked = F.array(
        *[F.struct(F.lit(n).alias("name"), F.lit(float(p)).alias("p")) for n, p in
          probabilities.items()]
    )
    exact = F.col("ask.p") * (F.col("group_size") - 1)
    low = F.floor(exact)
    ends = F.array(
        F.struct(low.alias("at"), (1 - (exact - low)).alias("weight")),
        F.struct(F.ceil(exact).alias("at"), (exact - low).alias("weight")),
    )
    targets = (
        group_starts(ordered, groups)
        .withColumn("ask", F.explode(asked))
        .withColumn("end", F.explode(ends))
        .select(
            *groups,
            F.col("ask.name").alias("name"),
            F.col("end.weight").alias("weight"),
            (F.col("group_start") + F.col("end.at")).alias("position"),
        )
        .where(F.col("weight") > 0)
    )
    found = values_at(ordered, targets, "position")
    return found.groupBy(*groups).agg(
        *[
            F.sum(F.when(F.col("name") == n, F.col("weight") * F.col("value"))).alias(n)
            for n in probabilities
        ]
    )


def group_quantiles(
    df: DataFrame, groups: Sequence[str], value: str, id_col: str,
    probabilities: Mapping[str, float],
) -> DataFrame:
    return quantiles_of(ordered_values(df, groups, value, id_col), groups, probabilities)
