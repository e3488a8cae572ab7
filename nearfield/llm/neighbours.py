"""Nearest neighbours by largest inner product: int8 tiles with error bounds, then exact scores."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import by_batch, materialize

QUERY_TILE = 512  # vectors of a query tile
BASE_TILE = 4096  # vectors of a base tile
_PAIRS = 1 << 15  # pairs that are scored exactly at once
_SPREAD = 64
_CHUNK = 1024  # components whose int8 products a float32 sum holds exactly


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v)`` of the vectors that take part: id and vector not null, not empty, not all
    zero, every component a finite number. Rows that repeat an id are one, with the least of their
    vectors."""
    v = vectors[vector_col].cast("array<double>")
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    taken = vectors.select(vectors[id_col].cast("long").alias("vec_id"), v.alias("v")).filter(
        F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", fine) & F.exists("v", lambda x: x != 0))
    return taken.groupBy("vec_id").agg(F.min("v").alias("v"))


def tiles(vectors: DataFrame, size: int) -> DataFrame:
    """Rows of ``(dim, tile, ids, v)``: up to ``size`` vectors of one length as binary matrices.

    Every task cuts its own rows, so nothing is gathered; a tile is named by the hash of its ids.
    """

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(1)
        at = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False)
        ids, dims = batch.column(0).to_numpy(), np.diff(at)
        for dim in np.unique(dims):
            rows = np.flatnonzero(dims == dim)
            step = max(1, min(size, (32 << 20) // (8 * int(dim))))
            for i in range(0, len(rows), step):
                some = rows[i : i + step]
                some = some[np.argsort(ids[some])]
                matrix = np.stack([values[at[r] : at[r + 1]] for r in some])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(dim)], pa.int32()), pa.array([ids[some].astype("<i8").tobytes()], pa.binary()),
                     pa.array([matrix.astype("<f8").tobytes()], pa.binary())], names=["dim", "ids", "v"])

    made = by_batch(vectors.select("vec_id", "v"), each, "dim int, ids binary, v binary")
    return made.withColumn("tile", F.xxhash64("ids"))


class Quantised:
    """Rows as ``scale * int8`` with the length of what rounding leaves.

    Squares of very large or small rows leave the range of a double, so all is computed from
    ``unit``, the row without its ``power`` of two, which takes no rounding; lengths and scales are held
    for ``unit`` too.
    """

    def __init__(self, ids: bytes, vectors: bytes, dim: int):
        self.ids = np.frombuffer(ids, dtype="<i8")
        self.exact = np.frombuffer(vectors, dtype="<f8").reshape(-1, dim)
        _, self.power = np.frexp(np.abs(self.exact).max(axis=1))
        self.unit = np.ldexp(self.exact, -self.power[:, None])
        self.unit_scale = np.abs(self.unit).max(axis=1) / 127
        self.codes = np.rint(self.unit / self.unit_scale[:, None]).astype(np.int8)
        kept = self.codes * self.unit_scale[:, None]
        self.unit_kept = np.sqrt((kept**2).sum(axis=1))
        self.unit_lost = np.sqrt(((self.unit - kept) ** 2).sum(axis=1))
        with np.errstate(over="ignore", under="ignore"):
            self.scale, self.kept, self.lost = (
                np.ldexp(x, self.power) for x in (self.unit_scale, self.unit_kept, self.unit_lost))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact int8 products of all rows; float32 holds each part's sums exactly."""
    total = np.zeros((len(a), len(b)))
    for i in range(0, a.shape[1], _CHUNK):
        total += a[:, i : i + _CHUNK].astype(np.float32) @ b[:, i : i + _CHUNK].astype(np.float32).T
    return total


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, summed in the order of the components."""
    total = np.zeros(len(a))
    for i in range(a.shape[1]):
        total += a[:, i] * b[:, i]
    return total


def _copies_beyond(exact: np.ndarray, k: int) -> np.ndarray:
    """Mark rows equal to at least ``k`` earlier ones (of smaller id), which can't be among the k."""
    _, of = np.unique(np.ascontiguousarray(exact).view(f"V{exact.shape[1] * 8}").ravel(), return_inverse=True)
    order = np.argsort(of, kind="stable")
    sorted_of = of[order]
    first = np.concatenate(([0], np.flatnonzero(np.diff(sorted_of)) + 1))
    rank = np.arange(len(of)) - np.repeat(first, np.diff(np.append(first, len(of))))
    beyond = np.zeros(len(of), dtype=bool)
    beyond[order] = rank >= k
    return beyond


def tile_neighbours(q: Quantised, b: Quantised, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query rows, base ids and exact scores of the pairs of two tiles that can be among the best k.

    An approximate product misses the true one by at most what rounding left of either vector times
    the other. Pairs whose upper bound is below the k-th lower bound of their query are dropped;
    the others are computed from the original vectors. All is compared in units of the query's size
    and the largest base row's. Products too large for a double are equal there, as their scores
    are; a product too small for it may be anything near zero.
    """
    most = int(b.power.max(initial=0))
    smaller = np.ldexp(1.0, b.power - most)
    approximate = _products(q.codes, b.codes) * q.unit_scale[:, None] * (b.unit_scale * smaller)[None, :]
    bound = q.unit_lost[:, None] * ((b.unit_kept + b.unit_lost) * smaller)[None, :]
    bound += q.unit_kept[:, None] * (b.unit_lost * smaller)[None, :]
    power = q.power.astype(np.int64) + most
    with np.errstate(over="ignore"):
        vague = np.ldexp(float(b.exact.shape[1]), np.clip(-1074 - power, -1070, 2000))
        cap = np.ldexp(1.0, np.clip(1024 - power, -1070, 2000))
        bound += 1e-12 * (np.abs(approximate) + bound) + 1e-300 + vague[:, None]
    lower = np.minimum(approximate - bound, cap[:, None])
    upper = np.minimum(approximate + bound, cap[:, None])
    out = (q.ids[:, None] == b.ids[None, :]) | _copies_beyond(b.exact, k + 1)[None, :]
    lower[out] = -np.inf
    kth = np.partition(lower, -k, axis=1)[:, -k] if lower.shape[1] >= k else np.full(len(lower), -np.inf)
    left, right = np.nonzero((upper >= kth[:, None]) & ~out)
    score = np.empty(len(left))
    for i in range(0, len(left), _PAIRS):
        of, to = left[i : i + _PAIRS], right[i : i + _PAIRS]
        with np.errstate(over="ignore", under="ignore"):
            score[i : i + _PAIRS] = np.ldexp(_scores(q.unit[of], b.unit[to]), q.power[of] + b.power[to])
    order = np.lexsort((b.ids[right], -score, left))
    left, right, score = left[order], right[order], score[order]
    first = np.searchsorted(left, left)
    kept = np.arange(len(left)) - first < k
    return left[kept], b.ids[right[kept]], score[kept]


def nearest(vectors: DataFrame, is_query: Column, k: int, id_col: str = "vec_id",
            vector_col: str = "embedding") -> DataFrame:
    """``(query_id, rank, vec_id, score)``: the ``k`` rows with the largest inner product.

    Queries are the rows for which ``is_query`` (over ``vec_id``) holds, candidates all rows but the
    query's own; ties go to the smaller id. Only vectors of the query's length are its candidates.
    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows
    without an id; rows that repeat an id are one row (see :func:`usable`); other columns are not
    read. With fewer than ``k`` candidates all are returned.

    Blocks of queries meet blocks of the base: a base tile is moved once, and each query tile once
    per base tile, as in a blocked matrix product. A pair of tiles leaves at most ``k`` rows per
    query; these are merged in heaps of ``k`` by streaming rows sorted by query.
    """
    taken = materialize(usable(vectors, id_col, vector_col), "vectors")
    queries = materialize(tiles(taken.filter(is_query), QUERY_TILE), "query-tiles")
    base = materialize(tiles(taken, BASE_TILE), "base-tiles")
    # Which blocks meet, as names only: every block of queries every block of the base. Lengths are
    # few, so the pairing is spread by a part of the base tile's name.
    part = F.pmod(F.col("base_tile"), F.lit(_SPREAD)).cast("int")
    spots = base.select("dim", F.col("tile").alias("base_tile")).withColumn("part", part)
    asked = queries.select("dim", F.col("tile").alias("q_tile"), F.explode(
        F.sequence(F.lit(0), F.lit(_SPREAD - 1))).alias("part"))
    pairs = asked.join(spots, ["dim", "part"]).select("dim", "q_tile", "base_tile")
    q = queries.select(F.col("tile").alias("qt"), F.col("ids").alias("q_ids"), F.col("v").alias("q_v"))
    b = base.select(F.col("tile").alias("bt"), F.col("ids").alias("b_ids"), F.col("v").alias("b_v"))
    blocks = pairs.join(q, F.col("q_tile") == F.col("qt")).join(b, F.col("base_tile") == F.col("bt")).select(
        "dim", "q_ids", "q_v", "b_ids", "b_v")

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        held, base = None, None
        for i in range(len(batch)):
            dim, q_ids, q_v, b_ids, b_v = (c[i].as_py() for c in batch.columns)
            if b_ids != held:
                held, base = b_ids, Quantised(b_ids, b_v, dim)
            tile = Quantised(q_ids, q_v, dim)
            row, ids, score = tile_neighbours(tile, base, k)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tile.ids[row]), pa.array(ids), pa.array(score)], names=["query_id", "vec_id", "score"])

    partial = by_batch(blocks, each, "query_id long, vec_id long, score double")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, heap, done = None, [], []

        def close() -> None:
            done.extend((now, r + 1, -v, s) for r, (s, v) in enumerate(sorted(heap, reverse=True)))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [[]] * 4
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.float64()]
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                              names=["query_id", "rank", "vec_id", "score"])

        for batch in batches:
            for query, vec, score in zip(*(c.to_pylist() for c in batch.columns)):
                if query != now:
                    if now is not None:
                        close()
                    now, heap = query, []
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                else:
                    heapq.heappushpop(heap, (score, -vec))
            yield flush()
        if now is not None:
            close()
        yield flush()

    return partial.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(
        merge, "query_id long, rank int, vec_id long, score double")


def op4_block_nearest(embeddings: DataFrame) -> DataFrame:
    return nearest(embeddings, F.col("vec_id") % 20 == 0, 20)


SQL = """
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (
  SELECT q.vec_id AS query_id, b.vec_id, list_inner_product(q.v, b.v) AS score
  FROM e q JOIN e b ON q.vec_id <> b.vec_id AND len(q.v) = len(b.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20"""
