"""Summaries and comparisons of benchmark runs."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.names import parse_dataset
from nearfield.operators.numbering import number_rows
from nearfield.operators.quantiles import ordered_values, quantiles_of, rank_within


def select_runs(
    df: DataFrame, *, kind: str | None = None, blob: bool | None = None,
    threads: int | None = None, without_datasets: Sequence[str] = (),
) -> DataFrame:
    """Runs of one index kind (``"EXTENSION"`` means any but FLAT), interface and thread count.

    Runs without a thread count always pass the thread filter.
    """
    if kind == "EXTENSION":
        df = df.where(F.col("index_kind") != "FLAT")
    elif kind:
        df = df.where(F.col("index_kind") == kind)
    if blob is not None:
        df = df.where(F.coalesce("use_blob", F.lit(False)) == blob)
    if threads is not None:
        df = df.where(F.col("threads").isNull() | (F.col("threads") == threads))
    if without_datasets:
        df = df.where(~F.col("dataset").isin(list(without_datasets)))
    return df


def point_ids(df: DataFrame, keys: Sequence[Column | str]) -> DataFrame:
    """Sequential ids over all runs in key order."""
    return number_rows(df, keys, "point_id")


def median_with_bars(
    df: DataFrame, groups: Sequence[str], value: str, id_col: str
) -> DataFrame:
    """Exact median per group and the distances to its minimum and maximum."""
    ends = df.groupBy(*groups).agg(
        F.min(value).alias("__min"), F.max(value).alias("__max"), F.count(value).alias("n")
    )
    ordered = ordered_values(df, groups, value, id_col)
    return ends.join(quantiles_of(ordered, groups, {"median": 0.5}), list(groups)).select(
        *groups, "n", "median",
        (F.col("median") - F.col("__min")).alias("lower_err"),
        (F.col("__max") - F.col("median")).alias("upper_err"),
    )


def incomplete_groups(df: DataFrame, groups: Sequence[str], expected: int = 3) -> DataFrame:
    """Groups that do not have exactly the expected number of measurements."""
    counts = df.groupBy(*groups).agg(F.count("*").alias("measurements"))
    return counts.where(F.col("measurements") != expected)


def _two_means(df: DataFrame, dataset: str, index: str, value: str, slow: str, fast: str) -> DataFrame:
    def mean(name: str) -> Column:
        return F.avg(F.when(F.col(index) == name, F.col(value)))

    both = df.where(F.col(index).isin(slow, fast)).groupBy(dataset).agg(
        mean(slow).alias("base_mean"), mean(fast).alias("other_mean")
    )
    return both.where(F.col("base_mean").isNotNull() & F.col("other_mean").isNotNull())


def speedups(
    df: DataFrame, base: str, other: str, *, dataset: str = "dataset", index: str = "index",
    value: str = "optimize_duration",
) -> DataFrame:
    """Per dataset: how many times faster ``other`` is than ``base`` by mean duration."""
    means = _two_means(df, dataset, index, value, base, other)
    return means.withColumn("speedup", F.col("base_mean") / F.col("other_mean"))


def reductions(
    df: DataFrame, base: str, other: str, *, dataset: str = "dataset", index: str = "index",
    value: str = "bytes",
) -> DataFrame:
    """Per dataset: by how many percent ``other`` is smaller than ``base``."""
    means = _two_means(df, dataset, index, value, base, other)
    return means.withColumn("reduction_pct", (1 - F.col("other_mean") / F.col("base_mean")) * 100)


def extremes(df: DataFrame, value: str, dataset: str = "dataset") -> DataFrame:
    """One row: smallest and largest value and the dataset of each (ties by name)."""
    ordered = F.struct(F.col(value).alias("v"), F.col(dataset).alias("d"))
    last = F.max(F.col(value))
    top = df.agg(F.min(ordered).alias("lo"), last.alias("max_value"))
    named = df.select(F.col(value).alias("max_value"), F.col(dataset).alias("d")).groupBy(
        "max_value"
    ).agg(F.min("d").alias("max_dataset"))
    return top.join(named, "max_value").select(
        F.col("lo.d").alias("min_dataset"), F.col("lo.v").alias("min_value"),
        "max_dataset", "max_value",
    )


# Bytes of one raw vector element.
ELEMENT_BYTES = {"f32": 4, "u8": 1}


def size_overhead(
    df: DataFrame, *, dataset: str = "dataset", size: str = "bytes", element: str = "element",
    exact_counts: Mapping[str, int] | None = None,
) -> DataFrame:
    """Raw bytes of the vectors, and what an index takes beyond them, absolute and as a share of
    the total. A missing size stays missing."""
    p = parse_dataset(F.col(dataset))
    n = p["n"]
    for name, count in (exact_counts or {}).items():
        n = F.when(F.col(dataset) == name, count).otherwise(n)
    width = F.when(F.col(element) == "u8", ELEMENT_BYTES["u8"]).otherwise(ELEMENT_BYTES["f32"])
    sized = df.withColumn("raw_bytes", n * p["d"] * width)
    over = F.col(size) - F.col("raw_bytes")
    return sized.withColumn("overhead", over).withColumn(
        "overhead_pct", F.when(F.col(size) != 0, over / F.col(size) * 100)
    )


def system_by_dataset(
    df: DataFrame, systems: str, datasets: str, value: str, columns: Sequence[str]
) -> DataFrame:
    """One row per system, one column per listed dataset."""
    return df.groupBy(systems).pivot(datasets, list(columns)).agg(F.first(value, ignorenulls=True))


def run_means(df: DataFrame, runs: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """Number of queries and the mean of every measure per run."""
    return df.groupBy(*runs).agg(
        F.count("*").alias("num_queries_run"),
        *[F.avg(m).alias(f"avg_{m}") for m in measures],
    )


def timing_breakdown(
    df: DataFrame, runs: Sequence[str], components: Sequence[str], latency: str
) -> DataFrame:
    """Mean milliseconds per run and component, leaving out components that are 0 in every run,
    with the sum of the parts and queries per second as 1 / mean latency."""
    means = df.groupBy(*runs).agg(
        *[F.avg(c).alias(c) for c in components], F.avg(latency).alias("__latency")
    )
    parts = means.unpivot([*runs, "__latency"], list(components), "component", "seconds")
    total = parts.groupBy(*runs).agg((F.sum("seconds") * 1000).alias("total_ms"))
    used = parts.groupBy("component").agg(F.max(F.abs("seconds")).alias("most")).where("most <> 0")
    rate = F.when(F.col("__latency") > 0, 1 / F.col("__latency"))
    return (
        parts.join(used.select("component"), "component", "left_semi")
        .join(total, list(runs))
        .select(*runs, "component", (F.col("seconds") * 1000).alias("ms"), "total_ms",
                rate.alias("qps"))
    )


def recall_curve(
    df: DataFrame, groups: Sequence[str], recall: str, rate: str, id_col: str
) -> DataFrame:
    """The points of every recall / throughput curve with their place along it."""
    points = df.select(*groups, recall, rate, id_col)
    return rank_within(points, groups, [recall, id_col, rate], "point")


def curve_lists(curve: DataFrame, groups: Sequence[str], recall: str, rate: str) -> DataFrame:
    """The curves as one row each, for curves of few points."""
    point = F.struct("point", F.col(recall).alias("recall"), F.col(rate).alias("qps"))
    return curve.groupBy(*groups).agg(F.array_sort(F.collect_list(point)).alias("points"))


def curve_blocks(
    curve: DataFrame, groups: Sequence[str], recall: str, rate: str, points: int = 1_000
) -> DataFrame:
    """The curves in rows of ``points`` points at most: ``(groups, block, points)``, blocks and points in
    order along the curve, so that no row grows with its curve."""
    block = curve.withColumn("block", F.floor((F.col("point") - 1) / points).cast("long"))
    return curve_lists(block, [*groups, "block"], recall, rate)


def rate_at_recall(
    df: DataFrame, groups: Sequence[str], index: str, base: str, other: str, *,
    recall: str, rate: str, id_col: str, target: float = 0.90,
) -> DataFrame:
    """Per group: the lowest-recall point at or above the target of two indexes and the percentage
    by which throughput falls from one to the other; ``missing`` names a side without a point."""
    good = df.where(F.col(index).isin(base, other) & (F.col(recall) >= target))
    first = good.groupBy(*groups, index).agg(
        F.min(F.struct(F.col(recall).alias("r"), F.col(id_col).alias("i"), F.col(rate).alias("q")))
        .alias("p")
    )

    def side(name: str, prefix: str) -> DataFrame:
        return first.where(F.col(index) == name).select(
            *groups, F.col("p.r").alias(f"{prefix}_recall"), F.col("p.q").alias(f"{prefix}_qps")
        )

    every = df.select(*groups).distinct()
    joined = every.join(side(base, "base"), list(groups), "left").join(
        side(other, "other"), list(groups), "left"
    )
    none = F.when(F.col("base_qps").isNull() & F.col("other_qps").isNull(), "both")
    missing = none.when(F.col("base_qps").isNull(), "base").when(F.col("other_qps").isNull(), "other")
    fall = (F.col("base_qps") - F.col("other_qps")) / F.col("base_qps") * 100
    return joined.withColumn("decrease_pct", fall).withColumn("missing", missing)
