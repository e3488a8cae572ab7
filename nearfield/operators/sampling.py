"""Samples, splits and generated query sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.hashing import hash_draw, shuffle_key
from nearfield.operators.numbering import number_rows, number_rows_total

# Fixed value: rows of a storage block of the measured engine.
ROW_GROUP = 122_880


def _likely_first(ids: DataFrame, n: int, seed: int, id_col: str) -> DataFrame:
    """Rows that hold the first n in shuffled order: those whose key starts low enough for a few more
    than n to be expected. They are counted; if they are too few, all rows are returned."""
    total = ids.count()
    share = (n + 8 * n**0.5 + 20) / total if total else 1.0
    if share >= 0.5:
        return ids
    whole = 16**15
    few = ids.where(hash_draw(seed, F.col(id_col), F.lit(whole)) < int(share * whole))
    return few if few.count() >= n else ids


def sample_ids(df: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """``(id, original_id)`` of a seeded sample without replacement, renumbered in id order."""
    ids = _likely_first(df.select(id_col), n, seed, id_col)
    drawn = number_rows(ids, [shuffle_key(seed, F.col(id_col)), id_col], "__draw").where(
        F.col("__draw") < n
    )
    return number_rows(drawn.select(F.col(id_col).alias("original_id")), ["original_id"], "id")


def sample(df: DataFrame, n: int, seed: int, id_col: str = "id") -> DataFrame:
    """Sampled rows with new ids 0..n-1; only ids are shuffled to choose them."""
    rest = [c for c in df.columns if c != id_col]
    picked = sample_ids(df, n, seed, id_col)
    source = df.withColumnRenamed(id_col, "original_id")
    return source.join(picked, "original_id").select(
        F.col("id").alias(id_col), "original_id", *rest
    )


def split_queries(
    df: DataFrame, n: int, seed: int, id_col: str = "id"
) -> tuple[DataFrame, DataFrame]:
    """A sample as queries, and the base without those rows."""
    queries = sample(df, n, seed, id_col)
    return queries, without_rows(df, queries, id_col)


def without_rows(base: DataFrame, queries: DataFrame, id_col: str = "id") -> DataFrame:
    """Drop base rows that became queries (by the query's ``original_id``)."""
    taken = queries.select(F.col("original_id").alias(id_col))
    return base.join(taken, id_col, "left_anti")


def take_rows(df: DataFrame, wanted: DataFrame, id_col: str = "id") -> DataFrame:
    """The rows whose id is in ``wanted``."""
    return df.join(wanted.select(id_col), id_col, "left_semi")


def take_repeated(
    requests: DataFrame, source: DataFrame, at: str, keys: Sequence[Column | str]
) -> DataFrame:
    """Give every request the source row at a position in key order; rows may repeat."""
    numbered = number_rows(source, keys, at)
    return requests.join(numbered, at)


def draw_positions(requests: DataFrame, n: int, seed: int, qid: str = "qid", at: str = "at") -> DataFrame:
    """A seeded draw with replacement from 0..n-1 for every request."""
    return requests.withColumn(at, hash_draw(seed, F.col(qid), F.lit(n)))


# Keys looked at to place the cuts of a selection, and how often it is narrowed at most.
_SAMPLED_KEYS = 4_000
_NARROWINGS = 8


def _cuts(keys: DataFrame, total: int, n: int) -> list[Column]:
    """A few keys that about n rows and increasingly more do not exceed, from a sample of bounded size."""
    drawn = keys.sample(min(1.0, _SAMPLED_KEYS / total), seed=0).sort("key").collect()
    if not drawn:
        return []
    place, fields = n / total * len(drawn), keys.schema["key"].dataType.fields
    steps = {int(place + width * (place + 1) ** 0.5) for width in (1, 2, 4, 8, 16)}
    return [
        F.struct(*[F.lit(drawn[at]["key"][f.name]).cast(f.dataType).alias(f.name) for f in fields])
        for at in sorted(steps) if at < len(drawn)
    ]


def lowest(df: DataFrame, keys: Sequence[Column | str], n: int) -> DataFrame:
    """Rows among which are the first n in ascending order of ``keys`` (nulls first), and few others.

    Nothing is sorted: keys that may cut off the rest come from a sample of keys, the rows up to each
    are counted in one pass over the key columns, and the lowest cut that leaves n rows is taken, again
    and again while it leaves many more. The result is right whatever the sample; it only decides how
    much is left. The end of the first key is a condition of its own, which files can be skipped by.
    """
    named = [k if isinstance(k, Column) else F.col(k) for k in keys]
    key = F.struct(*[k.alias(f"k{i}") for i, k in enumerate(named)])
    total = df.count()
    for _ in range(_NARROWINGS):
        if total <= 2 * n or total <= _SAMPLED_KEYS:
            break
        cuts = _cuts(df.select(key.alias("key")), total, n)
        if not cuts:
            break
        counts = df.agg(*[F.count_if(key <= cut).alias(f"n{i}") for i, cut in enumerate(cuts)]).first()
        enough = [(rows, cut) for rows, cut in zip(counts, cuts) if n <= rows < total]
        if not enough:
            break
        total, cut = enough[0]
        first = named[0].isNull() | (named[0] <= cut["k0"])
        df = df.where(first & (key <= cut))
    return df


def head(df: DataFrame, keys: Sequence[Column | str], n: int = 2 * ROW_GROUP, column: str = "id") -> DataFrame:
    """The first n rows in ascending key order with ids from 0; only they and few others are sorted."""
    return number_rows(lowest(df, keys, n), keys, column).where(F.col(column) < n)


# Pass rates of the generated range filters, and filters per rate.
PASS_RATES = [
    0.001, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5,
    0.6, 0.7, 0.8, 0.9, 0.95, 0.98, 0.99, 0.995, 0.998, 0.999,
]
FILTERS_PER_RATE = 500


def range_filters(
    df: DataFrame, attr: str, *, rates: Sequence[float] = PASS_RATES,
    per_rate: int = FILTERS_PER_RATE, seed: int = 42,
) -> DataFrame:
    """Range filters that each match an exact number of rows.

    Every filter is a window of ``round(rate * N)`` consecutive rows in attribute order, at a
    seeded start. The attribute must be unique; ``range_counts`` verifies the result.
    """
    spark = df.sparkSession
    ordered, total = number_rows_total(df.select(attr), [attr], "place")
    rows = [(i, float(rate), max(1, min(total, round(rate * total)))) for i, rate in enumerate(rates)]
    table = spark.createDataFrame(rows, "r long, selectivity double, target_count long")
    draws = (
        table.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(per_rate - 1))))
        .withColumn("qid", F.col("r") * per_rate + F.col("j"))
        .withColumn("first", hash_draw(seed, F.col("qid"), F.lit(total) - F.col("target_count") + 1))
        .withColumn("last", F.col("first") + F.col("target_count") - 1)
    )
    starts = ordered.select(F.col("place").alias("first"), F.col(attr).alias("range_start"))
    ends = ordered.select(F.col("place").alias("last"), F.col(attr).alias("range_end"))
    return draws.join(starts, "first").join(ends, "last").select(
        "qid", "range_start", "range_end", "target_count", "selectivity"
    )


def shuffle_queries(
    filters: DataFrame, vectors: DataFrame, n_vectors: int, *, seed: int = 42, id_col: str = "id"
) -> DataFrame:
    """Generated queries in random order with new ids, each with a drawn vector."""
    drawn = draw_positions(filters, n_vectors, seed + 1, "qid", "at")
    mixed = number_rows(drawn, [shuffle_key(seed, F.col("qid")), "qid"], "id")
    # only ids are numbered; vectors move for the drawn rows alone
    sources = number_rows(vectors.select(F.col(id_col).alias("source_id")), ["source_id"], "at")
    named = mixed.join(sources, "at").drop("at")
    return named.join(vectors.select(F.col(id_col).alias("source_id"), "emb"), "source_id").select(
        *mixed.drop("at").columns, "source_id", "emb"
    )
