"""Selectivity buckets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.operators.bootstrap import bootstrap_median

Bounds = Sequence[tuple[float, float]]


def assign_bucket(selectivity: Column, bounds: Bounds, close_last: bool = True) -> Column:
    """Bucket number of a selectivity by percent bounds, -1 when none fits.

    A bucket holds ``low <= s < high``. It is closed above when it is a single point or reaches
    100 percent, and, with ``close_last``, when it is the last one. Later buckets win on overlap.
    """
    bucket = F.lit(-1)
    for at, (low, high) in enumerate(bounds):
        closed = low == high or high == 100 or (close_last and at == len(bounds) - 1)
        top = F.lit(high / 100.0)
        inside = (selectivity >= F.lit(low / 100.0)) & (
            (selectivity <= top) if closed else (selectivity < top)
        )
        bucket = F.when(inside, at).otherwise(bucket)
    return bucket


def _all_buckets(df: DataFrame, runs: Sequence[str], bounds: Bounds) -> DataFrame:
    numbers = F.explode(F.sequence(F.lit(0), F.lit(len(bounds) - 1)))
    return df.select(*runs).distinct().withColumn("bucket", numbers)


def bucket_recalls(df: DataFrame, runs: Sequence[str], bounds: Bounds, recall: str = "recall") -> DataFrame:
    """Mean recall per run and bucket; an empty bucket has 0."""
    means = df.groupBy(*runs, "bucket").agg(F.avg(recall).alias("recall"), F.count("*").alias("queries"))
    return _all_buckets(df, runs, bounds).join(means, [*runs, "bucket"], "left").select(
        *runs, "bucket", F.coalesce("recall", F.lit(0.0)).alias("recall"),
        F.coalesce("queries", F.lit(0)).alias("queries"),
    )


def bucket_qps(
    df: DataFrame, runs: Sequence[str], bounds: Bounds, latency: str, id_col: str,
    replicates: int = 1000,
) -> DataFrame:
    """Throughput with its bootstrap interval per run and bucket; an empty bucket has zeros."""
    inside = df.where(F.col("bucket") >= 0)
    rates = bootstrap_median(
        inside, [*runs, "bucket"], latency, id_col, replicates=replicates, throughput=True
    )
    return _all_buckets(df, runs, bounds).join(rates, [*runs, "bucket"], "left").select(
        *runs, "bucket",
        *[F.coalesce(c, F.lit(0.0)).alias(n) for c, n in
          (("estimate", "qps"), ("lower_err", "lower_err"), ("upper_err", "upper_err"))],
    )
