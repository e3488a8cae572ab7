"""Scalar quantisation of vectors to one byte per element, and search over the codes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.functions.arrow import arrow_function
from nearfield.functions.vectors import vector_score
from nearfield.operators.kernels import EUCLIDEAN, as_list_column, as_matrix
from nearfield.operators.knn import nearest_partial, rank_nearest
from nearfield.session import materialize, ship_package

LEVELS = 255
# Candidate ids up to which they are broadcast (8 bytes each).
_BROADCAST_CANDIDATES = 2_000_000
# Words of 64 bits of the filter of more ids than that, 16 MB, and ids a word up to which it is of use.
_FILTER_WORDS = 1 << 21
_FILTER_LOAD = 16


@dataclass(frozen=True)
class Bounds:
    """Lowest and highest value of every dimension (d numbers each, whatever the table)."""

    low: np.ndarray
    high: np.ndarray

    def overall(self) -> Bounds:
        """One common range for all dimensions, so that code distances keep the metric."""
        d = len(self.low)
        return Bounds(np.full(d, self.low.min()), np.full(d, self.high.max()))

    @property
    def width(self) -> np.ndarray:
        return np.where(self.high > self.low, self.high - self.low, 1.0)


def dimension_bounds(df: DataFrame, emb: str = "emb") -> DataFrame:
    """``(dim, low, high)``. Every task reduces its rows to one pair of vectors first."""
    ship_package(df.sparkSession)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = None
        for batch in batches:
            if not batch.num_rows:
                continue
            block = as_matrix(batch.column(0))
            lo, hi = block.min(axis=0), block.max(axis=0)
            low = lo if low is None else np.minimum(low, lo)
            high = hi if high is None else np.maximum(high, hi)
        if low is not None:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(low), dtype=np.int32)), pa.array(low), pa.array(high)],
                names=["dim", "low", "high"],
            )

    vectors = df.select(emb).dropna()
    parts = vectors.mapInArrow(reduce, "dim int, low double, high double")
    return parts.groupBy("dim").agg(F.min("low").alias("low"), F.max("high").alias("high"))


def fit_bounds(df: DataFrame, emb: str = "emb", per_dimension: bool = False) -> Bounds:
    """Read the bounds back: one row per dimension, independent of the number of vectors."""
    rows = dimension_bounds(df, emb).orderBy("dim").collect()
    bounds = Bounds(np.array([r["low"] for r in rows]), np.array([r["high"] for r in rows]))
    return bounds if per_dimension else bounds.overall()


def quantise(emb: Column, bounds: Bounds) -> Column:
    """Codes 0..255 as a binary column; values outside the bounds are clamped."""
    low, width = bounds.low, bounds.width

    @arrow_function("binary")
    def codes(column: pa.Array) -> pa.Array:
        scaled = np.rint((as_matrix(column) - low) / width * LEVELS)
        packed = np.clip(scaled, 0, LEVELS).astype(np.uint8)
        n, dim = packed.shape
        ends = pa.py_buffer((np.arange(n + 1, dtype=np.int32) * np.int32(dim)).tobytes())
        return pa.Array.from_buffers(pa.binary(), n, [None, ends, pa.py_buffer(packed.tobytes())])

    return codes(emb)


def code_list(code: Column) -> Column:
    """The codes as a list of integers."""

    @arrow_function("array<int>")
    def unpacked(column: pa.Array) -> pa.Array:
        return as_list_column(as_matrix(column).astype(np.int32), pa.int32())

    return unpacked(code)


def dequantise(code: Column, bounds: Bounds) -> Column:
    low, width = bounds.low, bounds.width

    @arrow_function("array<float>")
    def values(column: pa.Array) -> pa.Array:
        decoded = as_matrix(column) / LEVELS * width + low
        return as_list_column(decoded.astype(np.float32), pa.float32())

    return values(code)


def with_codes(df: DataFrame, bounds: Bounds, emb: str = "emb") -> DataFrame:
    """The table with its vectors replaced by codes."""
    return df.withColumn(emb, quantise(F.col(emb), bounds))


def code_candidates(queries: DataFrame, coded: DataFrame, m: int, bounds: Bounds, **sizes: int) -> DataFrame:
    """The m nearest base rows by distance between codes, as ranked rows."""
    partial = nearest_partial(with_codes(queries, bounds), coded, m, EUCLIDEAN, **sizes)
    ranked = rank_nearest(partial, m, EUCLIDEAN)
    step = float(bounds.width[0]) / LEVELS
    return ranked.withColumn("score", F.col("score") * step)


def _bits(number: Column, words: int) -> tuple[Column, Column]:
    """The word of a number in a Bloom filter, and the bits in it that stand for the number."""
    draw = F.xxhash64(number)
    one = F.lit(1).cast("long")

    def bit(at: int) -> Column:  # shiftleft takes its step from a column in SQL only
        return F.call_function("shiftleft", one, F.shiftrightunsigned(draw, at).bitwiseAND(F.lit(63)).cast("int"))

    word = F.pmod(F.shiftrightunsigned(draw, 20), F.lit(words))
    return word, bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12))


def bloom_filter(ids: DataFrame, words: int = _FILTER_WORDS) -> DataFrame:
    """``(__word, __mask)`` of a Bloom filter of distinct ids: at most ``words`` rows, whatever the ids.
    An id has three bits of one word, so that a lookup is one step."""
    word, mask = _bits(F.col("id"), words)
    return ids.select(word.alias("__word"), mask.alias("__own")).groupBy("__word").agg(
        F.bit_or("__own").alias("__mask"))


def may_hold(base: DataFrame, bloom: DataFrame, words: int = _FILTER_WORDS) -> DataFrame:
    """The rows whose id may be in the filter: all that are, and few others. Rows stay where they are."""
    word, mask = _bits(F.col("id"), words)
    met = base.withColumn("__word", word).join(F.broadcast(bloom), "__word")
    return met.where(F.col("__mask").bitwiseAND(mask) == mask).select(*base.columns)


def rows_with(base: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the base with one of these distinct, written ids."""
    n = ids.count()
    if n <= _BROADCAST_CANDIDATES:
        return base.join(F.broadcast(ids), "id", "left_semi")
    if n <= _FILTER_LOAD * _FILTER_WORDS:
        base = may_hold(base, materialize(bloom_filter(ids), "bloom"))
    return base.join(ids, "id", "left_semi")


def rerank(
    candidates: DataFrame, queries: DataFrame, base: DataFrame, k: int, metric: str = EUCLIDEAN
) -> DataFrame:
    """Exact order of candidate rows: ``(qid, id, rank, score)``. Only candidates meet vectors: their
    ids, counted first, are sent to the base where they are few, and a Bloom filter of them where
    they are more, so that only their rows move."""
    found = materialize(candidates.select("qid", "id"), "candidates")
    ids = materialize(found.select("id").distinct(), "candidate-ids")
    fetched = rows_with(base.select("id", F.col("emb").alias("__b")), ids)
    pairs = (
        found.join(fetched, "id")
        .join(queries.select("qid", F.col("emb").alias("__q")), "qid")
    )
    score, ascending = vector_score(metric, F.col("__q"), F.col("__b"))
    scored = pairs.select("qid", "id", score.alias("__score"))
    keyed = scored.withColumn("__key", F.col("__score") if ascending else -F.col("__score"))
    return rank_nearest(keyed.drop("__score"), k, metric).select("qid", "id", "rank", "score")


@dataclass(frozen=True)
class CodeTable:
    """Written codes ``(id, emb)`` of a base and the bounds they were made with, for many searches."""

    codes: DataFrame
    bounds: Bounds


def write_codes(base: DataFrame, path: str) -> CodeTable:
    """Make the codes of a base once and store them with their bounds under ``path``."""
    bounds = fit_bounds(base)
    limits = list(zip(bounds.low.tolist(), bounds.high.tolist()))
    rows = base.sparkSession.createDataFrame([(i, *x) for i, x in enumerate(limits)], "dim int, low double, high double")
    rows.coalesce(1).write.parquet(f"{path}/bounds")
    with_codes(base.select("id", "emb"), bounds).write.parquet(f"{path}/codes")
    return read_codes(base.sparkSession, path)


def read_codes(spark: SparkSession, path: str) -> CodeTable:
    rows = spark.read.parquet(f"{path}/bounds").orderBy("dim").collect()
    bounds = Bounds(np.array([r["low"] for r in rows]), np.array([r["high"] for r in rows]))
    return CodeTable(spark.read.parquet(f"{path}/codes"), bounds)


def nearest_reranked(
    queries: DataFrame, base: DataFrame, k: int, fetch: int, metric: str = EUCLIDEAN, *,
    stored: CodeTable | None = None, **sizes: int,
) -> DataFrame:
    """Fetch by code distance, then rank the fetched rows exactly. With ``stored`` the search reads codes
    that were written before, else it makes them on the way."""
    if stored is None:
        bounds = fit_bounds(base)
        stored = CodeTable(with_codes(base, bounds), bounds)
    found = code_candidates(queries, stored.codes, max(k, fetch), stored.bounds, **sizes)
    return rerank(found, queries, base, k, metric)
