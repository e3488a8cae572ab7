"""Bootstrap confidence intervals of a median, or of throughput as 1 / median.

A resample is a set of drawn ranks, so its median is the value at its middle rank. Every draw is
generated once, in numpy on Arrow batches. A group of at most a chunk of values is resampled by the
tasks that are sent its values, a part of the replicates each, and leaves one number a replicate. Of
larger groups only middle ranks are ever joined to values, and all that is kept of a part of a
resample is how many draws lie below a band around the middle, and the draws inside it. Such states add up over the parts. A band is some square roots of the resample wide,
so nothing ever holds a whole resample; replicates whose middle lies outside it, which the counts
show, are drawn again with a wider one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.hashing import drawn_ranks, replicate_key, replicate_keys
from nearfield.operators.quantiles import group_starts, ordered_values, quantiles_of, values_at
from nearfield.session import materialize, ship_package

# Half a band in square roots of the resample; the middle's standard deviation is half of one.
_BAND = 3.0
# Draws that are one row of work, that are in memory at once, and that make a task.
_CHUNK = 1 << 18
_RUN = 1 << 18
_DRAWS_PER_TASK = 20_000_000
_ONE = ["group_start", "replicate"]


def _tasks(starts: DataFrame, replicates: int) -> int:
    """Tasks that generate draws: by their number, as the rows they come from are few."""
    total = starts.agg(F.sum("group_size").alias("n")).first()["n"] or 0
    cores = starts.sparkSession.sparkContext.defaultParallelism
    return max(cores, min(100_000, total * replicates // _DRAWS_PER_TASK))


def _group_middles(values: np.ndarray, replicates: np.ndarray, seed: int, most: int) -> np.ndarray:
    """The median of every replicate of one group's ordered values, about ``most`` draws at once."""
    n, found = len(values), np.empty(len(replicates))
    middles, step = [(n - 1) // 2, n // 2], max(1, most // n)
    for at in range(0, len(replicates), step):
        keys = replicate_keys(seed, replicates[at : at + step])
        ranks = drawn_ranks(keys[:, None], np.arange(n)[None, :], np.array(n))
        ranks.partition(middles, axis=1)
        found[at : at + step] = (values[ranks[:, middles[0]]] + values[ranks[:, middles[1]]]) / 2
    return found


def _whole_groups(
    ordered: DataFrame, starts: DataFrame, groups: Sequence[str], replicates: int, seed: int, tasks: int,
) -> DataFrame:
    """``(group_start, replicate, stat)``, the median of every replicate of groups that fit a chunk.

    A part of a group's replicates comes with all its values, so parts are no smaller than a task's draws.
    """
    most = _RUN
    parts = F.ceil(F.col("group_size") * replicates / _DRAWS_PER_TASK).cast("long")
    last = F.least(parts, F.lit(replicates)) - 1
    sent = ordered.join(starts, list(groups)).select("group_start", "group_size", "idx", "value").withColumns({
        "parts": last + 1, "part": F.explode(F.sequence(F.lit(0).cast("long"), last))})
    sent = sent.repartition(tasks, "group_start", "part").sortWithinPartitions("group_start", "part", "idx")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, wanted = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < max(1, wanted):
                continue
            table = pa.Table.from_batches(held)
            start, size, parts, part, value = (
                table[c].to_numpy() for c in ("group_start", "group_size", "parts", "part", "value"))
            at, out = 0, []
            while at < rows and at + size[at] <= rows:
                own = np.arange(part[at] * replicates // parts[at], (part[at] + 1) * replicates // parts[at])
                out.append((start[at], own, _group_middles(value[at : at + size[at]], own, seed, most)))
                at += size[at]
            if out:
                numbers = [np.full(len(own), first) for first, own, _ in out]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(x)) for x in (numbers, [own for _, own, _ in out], [m for *_, m in out])],
                    names=["group_start", "replicate", "stat"])
            # The last group goes on in the next batch.
            wanted = size[at] if at < rows else 0
            held, rows = table.slice(at).to_batches(), rows - at

    return sent.mapInArrow(each, "group_start long, replicate long, stat double")


def _runs(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``most`` draws."""
    ends, first = np.cumsum(lengths), 0
    while first < len(lengths):
        done = ends[first] - lengths[first]
        last = max(first + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield first, last
        first = last


def _states(batch: pa.RecordBatch, size: int = _CHUNK, most: int = _RUN) -> Iterator[pa.RecordBatch]:
    """Draws below the band, and those inside it, of every row of work, a part of ``size`` draws."""
    start, replicate, n, chunk, key, low, high = (
        batch.column(c).to_numpy() for c in ("group_start", "replicate", "group_size", "chunk", "key", "low", "high"))
    lengths = np.minimum(n - chunk * size, size)
    for i, j in _runs(lengths, most):
        length = lengths[i:j]
        of = np.repeat(np.arange(i, j), length)
        position = np.arange(len(of)) - np.repeat(np.cumsum(length) - length - chunk[i:j] * size, length)
        rank = drawn_ranks(key[of], position, n[of])
        below = np.bincount(of[rank < low[of]] - i, minlength=j - i)
        inside = np.flatnonzero((rank >= low[of]) & (rank < high[of]))
        ends = np.searchsorted(of[inside], np.arange(i, j + 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(start[i:j]), pa.array(replicate[i:j]), pa.array(below.astype(np.int64)),
             pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(rank[inside], pa.int64()))],
            names=["group_start", "replicate", "below", "inside"])


def _middles(replicates: DataFrame, tasks: int) -> DataFrame:
    """Every replicate with both middle ranks (equal for odd sizes), null where the band misses one.

    ``replicates`` has ``group_start``, ``replicate``, ``group_size``, ``key`` and ``width``, half the band.
    """
    n, size, most = F.col("group_size"), _CHUNK, _RUN
    middle = F.floor(n / 2)
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((n - 1) / size)))
    work = replicates.select(
        *_ONE, "group_size", chunk.alias("chunk"), "key",
        F.greatest(middle - F.col("width"), F.lit(0)).cast("long").alias("low"),
        F.least(middle + F.col("width"), n).cast("long").alias("high"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _states(batch, size, most)

    states = work.repartition(tasks, *_ONE, "chunk").mapInArrow(
        each, "group_start long, replicate long, below long, inside array<long>")
    merged = states.groupBy(*_ONE).agg(
        F.sum("below").alias("below"), F.sort_array(F.flatten(F.collect_list("inside"))).alias("inside"))

    def rank(position: Column) -> Column:
        at = position - F.col("below")
        held = (at >= 0) & (at < F.size("inside"))
        return F.when(held, F.element_at("inside", (at + 1).cast("int")))

    # Spark takes replicates for as few as groups, and would broadcast them.
    return replicates.hint("merge").join(merged, _ONE).select(
        *replicates.columns, rank(F.floor((n - 1) / 2)).alias("low_rank"), rank(middle).alias("high_rank"))


def _middle_places(replicates: DataFrame, tasks: int) -> DataFrame:
    """Both middle places of every replicate in the numbered table."""
    found = []
    while True:
        told = materialize(_middles(replicates, tasks), "middles")
        hit = F.col("low_rank").isNotNull() & F.col("high_rank").isNotNull()
        places = F.array(*[F.col("group_start") + F.col(c) for c in ("low_rank", "high_rank")])
        found.append(told.where(hit).select(*_ONE, F.explode(places).alias("position")))
        missed = told.where(~hit)
        if missed.isEmpty():
            return reduce(DataFrame.unionByName, found)
        replicates = missed.select(*replicates.columns).withColumn("width", F.col("width") * 4 + 1)


def bootstrap_median(
    df: DataFrame, groups: Sequence[str], value: str, id_col: str, *,
    replicates: int = 1000, confidence: float = 0.95, seed: int = 42, throughput: bool = False,
) -> DataFrame:
    """Per group: ``estimate``, ``lower_err`` and ``upper_err`` (distances from the estimate),
    ``n``, and ``few`` for samples under 30. Groups of one value have zero errors.

    With ``throughput`` the statistic is 1 / median (0 when the median is 0).
    """
    names = list(groups)
    ordered = ordered_values(df, names, value, id_col)
    starts = materialize(group_starts(ordered, names), "groups")
    medians = quantiles_of(ordered, names, {"median": 0.5})

    ship_package(df.sparkSession)
    tasks = _tasks(starts, replicates)
    stat = _whole_groups(
        ordered, starts.where(F.col("group_size").between(2, _CHUNK)), names, replicates, seed, tasks)
    large = starts.where(F.col("group_size") > max(1, _CHUNK))
    if not large.isEmpty():
        each = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(replicates - 1).cast("long")))
        resampled = large.select("group_start", "group_size", each.alias("replicate")).withColumns({
            "key": replicate_key(seed, F.col("replicate")),
            "width": F.ceil(F.lit(_BAND) * F.sqrt(F.col("group_size").cast("double"))),
        })
        places = _middle_places(resampled, tasks)
        found = values_at(ordered, places, "position").groupBy(*_ONE).agg(F.avg("value").alias("stat"))
        stat = stat.unionByName(found)
    if throughput:
        rate = F.when(F.col("stat") > 0, 1 / F.col("stat")).otherwise(F.lit(float("inf")))
        stat = stat.withColumn("stat", rate)
        estimate = F.when(F.col("median") > 0, 1 / F.col("median")).otherwise(0.0)
    else:
        estimate = F.col("median")
    alpha = (1 - confidence) / 2
    interval = stat.groupBy("group_start").agg(
        F.percentile("stat", F.lit(alpha)).alias("low"),
        F.percentile("stat", F.lit(1 - alpha)).alias("high"),
    )
    return (
        medians.join(starts, names)
        .join(interval, "group_start", "left")
        .withColumn("estimate", estimate)
        .select(
            *names,
            "estimate",
            F.coalesce(F.col("estimate") - F.col("low"), F.lit(0.0)).alias("lower_err"),
            F.coalesce(F.col("high") - F.col("estimate"), F.lit(0.0)).alias("upper_err"),
            F.col("group_size").alias("n"),
            (F.col("group_size") < 30).alias("few"),
        )
    )
