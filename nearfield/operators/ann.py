"""Approximate search over inverted lists and hash buckets."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from nearfield.functions.arrow import arrow_function
from nearfield.functions.hashing import shuffle_key
from nearfield.operators.kernels import (
    EUCLIDEAN,
    TopK,
    VectorBlock,
    as_list_column,
    as_matrix,
    finite_rows,
    nearest_row,
)
from nearfield.operators.knn import (
    _MOST_WORDS,
    BLOCK_VALUES,
    MOST_BUCKETS,
    _Queries,
    _Spec,
    compared,
    metric_for,
    nearest,
    nearest_partial,
    partial_schema,
    rank_nearest,
    stored_by_cell,
)
from nearfield.operators.metrics import recall_by_rank
from nearfield.operators.numbering import number_rows
from nearfield.session import BROADCAST_LIMIT_BYTES, materialize, ship_package

# Rows per list for tables up to a million rows, and for the finer variant.
ROWS_PER_LIST = 1_000
ROOT_FROM_ROWS = 1_000_000
ROWS_PER_FINE_LIST = 256
# Scan tasks per core in training: fewer and longer tasks leave fewer partial sums.
_TASKS_PER_CORE = 4


def list_count(rows: int) -> int:
    """Number of inverted lists for a table of this many rows."""
    if rows <= ROOT_FROM_ROWS:
        return max(1, math.ceil(rows / ROWS_PER_LIST))
    return math.ceil(math.sqrt(rows))


def fine_list_count(rows: int) -> int:
    return max(1, math.ceil(rows / ROWS_PER_FINE_LIST))


def list_count_column(rows: Column) -> Column:
    few = F.ceil(rows / F.lit(ROWS_PER_LIST))
    many = F.ceil(F.sqrt(rows.cast("double")))
    return F.greatest(F.lit(1), F.when(rows <= ROOT_FROM_ROWS, few).otherwise(many)).cast("long")


def train_lists(
    base: DataFrame, lists: int, *, seed: int = 0, iterations: int = 10,
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
) -> DataFrame:
    """Centroids ``(list_id, emb)`` by k-means over all rows from seeded starting rows.

    Rows with a null vector or a value that is not finite are left out. A few long tasks each add
    up their rows per list before anything is shuffled.
    """
    rows = _training_rows(base.select("id", "emb"))
    ids = number_rows(rows.select("id"), [shuffle_key(seed, F.col("id")), "id"], "n")
    start = rows.join(ids.where(F.col("n") < lists), "id")
    centroids = materialize(start.select(F.col("n").cast("int").alias("list_id"), "emb"), "centroids")
    return _rounds(rows, centroids, iterations, broadcast_limit)


# Upper centroids of the tree, at most.
_MOST_PIVOTS = 1024
# Values of a slice of lists that a cell's rows are compared with at once, and of sums a task holds.
_SLICE_VALUES = 2_000_000
_CELL = "__cell"


class _Tree:
    """Rows and lists in two levels, for lists that are too many to send to every task.

    The upper level is a bounded number of pivots. Every row is placed once with its nearest pivot, in a
    written table bucketed by cell; a pivot with many rows has many cells. A round then sends each
    list to the cells that it can be nearest in, and the rows stay where they are. Within ``reach`` of
    their pivot p no row is nearer to a list c than to p's own nearest list o if
    d(p, c) > d(p, o) + 2 reach, so nothing else is left out and the assignment is exact.

    A cell has at most ``block_values`` values of rows. Its lists, where the bound leaves out none, are all
    lists at 8 bytes a value; they are compared slice by slice.
    """

    def __init__(self, rows: DataFrame, centroids: DataFrame, block_values: int = BLOCK_VALUES):
        spark = rows.sparkSession
        ship_package(spark)
        self.kind = centroids.schema["list_id"].dataType
        number, dim = centroids.agg(F.count("*"), F.max(F.size("emb"))).first()
        most = max(1, min(_MOST_PIVOTS, math.isqrt(number), BROADCAST_LIMIT_BYTES // (8 * dim)))
        drawn = centroids.orderBy(F.xxhash64("list_id"), "list_id").limit(most)
        self.pivots = spark.sparkContext.broadcast(as_matrix(drawn.select("emb").toArrow()["emb"]))
        found = rows.select("emb").mapInArrow(self._spread(), "pivot int, n long, reach double")
        spans = found.groupBy("pivot").agg(F.sum("n").alias("n"), F.max("reach").alias("reach")).collect()
        size = max(1, block_values // dim)
        self.parts = {r["pivot"]: -(-r["n"] // size) for r in spans}
        self.reach = {r["pivot"]: r["reach"] for r in spans if r["pivot"] >= 0}
        self.columns = rows.schema
        place, options = self._place(), F.create_map(*[F.lit(x).cast("long") for x in sum(self.parts.items(), ())])
        placed = rows.mapInArrow(place, T.StructType([*rows.schema.fields, T.StructField("__pivot", T.LongType())]))
        part = F.pmod(F.xxhash64("id"), options[F.col("__pivot")]) if self.parts else F.lit(0).cast("long")
        placed = placed.withColumn(_CELL, F.col("__pivot") * F.lit(1 << 32) + part).drop("__pivot")
        cells = max(1, sum(self.parts.values()))
        self.rows = stored_by_cell(placed, max(spark.sparkContext.defaultParallelism, min(MOST_BUCKETS, cells)))

    def _spread(self):
        shared = self.pivots

        def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows per pivot, and how far they are from it at most; -1 for rows without a list."""
            n = np.zeros(len(shared.value) + 1, np.int64)
            reach = np.zeros(len(n))
            for batch in batches:
                owner, gap = _nearest_pivots(batch["emb"], shared.value)
                n += np.bincount(owner + 1, minlength=len(n))
                np.maximum.at(reach, owner + 1, gap)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array((some - 1).astype(np.int32)), pa.array(n[some]), pa.array(reach[some])],
                names=["pivot", "n", "reach"])

        return spread

    def _place(self):
        shared = self.pivots

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                owner, _ = _nearest_pivots(batch["emb"], shared.value)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(owner)], names=[*batch.schema.names, "__pivot"])

        return place

    def _routed(self, centroids: DataFrame) -> DataFrame:
        """``(list_id, emb, cell)``: every list with the cells that hold rows it can be nearest to."""
        shared, held = self.pivots, sorted(self.reach)
        reach = np.array([self.reach[p] for p in held])
        parts = [self.parts[p] for p in held]

        def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            gap = np.full(len(shared.value), np.inf)
            for batch in batches:
                if batch.num_rows:
                    np.minimum(gap, _gaps(as_matrix(batch["emb"]), shared.value).min(axis=0), out=gap)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(gap), dtype=np.int32)), pa.array(gap)], names=["pivot", "gap"])

        found = centroids.select("emb").mapInArrow(least, "pivot int, gap double").groupBy("pivot").agg(
            F.min("gap").alias("gap")).orderBy("pivot").collect()
        own = np.array([found[p]["gap"] for p in held])
        limit = (own + 2 * reach) * (1 + 1e-9) + 1e-300

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not held:
                    continue
                gaps = _gaps(as_matrix(batch["emb"]), shared.value[held])
                for at in range(0, batch.num_rows, 256):
                    near = gaps[at : at + 256] <= limit
                    cells = [[held[p] * (1 << 32) + part for p in np.flatnonzero(row) for part in range(parts[p])]
                             for row in near]
                    some = batch.slice(at, 256)
                    yield pa.RecordBatch.from_arrays(
                        [some["list_id"], some["emb"], pa.array(cells, pa.list_(pa.int64()))],
                        names=["list_id", "emb", "cells"])

        sent = centroids.select("list_id", "emb").mapInArrow(
            route, T.StructType([*centroids.select("list_id", "emb").schema.fields,
                                 T.StructField("cells", T.ArrayType(T.LongType()))]))
        return sent.select("list_id", "emb", F.explode("cells").alias(_CELL))

    def assigned(self, centroids: DataFrame) -> DataFrame:
        """The rows with ``list_id``."""
        kind = to_arrow_type(self.kind)
        schema = T.StructType([*self.columns.fields, T.StructField("list_id", self.kind)])

        def assign(lists: pa.Table, rows: pa.Table) -> pa.Table:
            number = _nearest_slices(rows["emb"], lists) if lists.num_rows else None
            column = pa.nulls(rows.num_rows, kind) if number is None else pa.array(number).cast(kind)
            return rows.drop_columns([_CELL]).append_column("list_id", column)

        return self._routed(centroids).groupBy(_CELL).cogroup(self.rows.groupBy(_CELL)).applyInArrow(assign, schema)

    def sums(self, centroids: DataFrame, schema: str) -> DataFrame:
        """Per list its rows' sum and number, in several rows."""
        kind = to_arrow_type(self.kind)

        def add(lists: pa.Table, rows: pa.Table) -> pa.Table:
            found = [] if not lists.num_rows or not rows.num_rows else list(_add_up(iter([
                pa.RecordBatch.from_arrays(
                    [pa.array(_nearest_slices(rows["emb"], lists)).cast(kind), rows["emb"].combine_chunks()],
                    names=["list_id", "emb"])])))
            empty = pa.schema([("list_id", kind), ("total", pa.list_(pa.float64())), ("n", pa.int64())])
            return pa.Table.from_batches(found) if found else empty.empty_table()

        cells = self._routed(centroids).groupBy(_CELL).cogroup(self.rows.groupBy(_CELL)).applyInArrow(add, schema)
        return cells.mapInArrow(_merge_totals, schema)


def _gaps(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of all pairs, from differences: a product's rounding could leave out a list."""
    out = np.empty((len(vectors), len(pivots)))
    for p, pivot in enumerate(pivots):
        gap = vectors - pivot
        out[:, p] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def _nearest_pivots(column: pa.Array, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest pivot of every row and its distance; -1 and 0 for a vector that is null or not finite."""
    owner, gap = np.full(len(column), -1, np.int64), np.zeros(len(column))
    rows = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
    if len(rows):
        matrix = as_matrix(column.take(pa.array(rows)))
        fine = finite_rows(matrix)
        rows, matrix = rows[fine], matrix[fine]
    if len(rows):
        owner[rows] = nearest_row(VectorBlock(matrix, EUCLIDEAN), VectorBlock(pivots, EUCLIDEAN))
        far = matrix - pivots[owner[rows]]
        gap[rows] = np.sqrt(np.einsum("ij,ij->i", far, far))
    return owner, gap


def _nearest_slices(column: pa.ChunkedArray, lists: pa.Table) -> np.ndarray:
    """The nearest list of every row, ties to the lower number, lists being taken in slices."""
    lists = lists.sort_by("list_id")
    numbers, rows = lists["list_id"].to_numpy(), as_matrix(column)
    step = max(1, _SLICE_VALUES // max(1, rows.shape[1]))
    block = VectorBlock(rows, EUCLIDEAN)
    best, gap = np.zeros(len(rows), numbers.dtype), np.full(len(rows), np.inf)
    for at in range(0, lists.num_rows, step):
        centres = VectorBlock(as_matrix(lists["emb"].slice(at, step)), EUCLIDEAN)
        own = nearest_row(block, centres)
        far = centres.matrix[own] - rows
        found = np.einsum("ij,ij->i", far, far)
        nearer = found < gap
        best[nearer], gap[nearer] = numbers[at + own[nearer]], found[nearer]
    return best


def _merge_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a list from the cells of one task put together, as far as a bounded table reaches."""
    held, values = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            values += len(batch["total"].flatten())
        if values > _SLICE_VALUES:
            held = [_merged(held)]
            values = len(held[0]["total"].flatten())
            if values > _SLICE_VALUES // 2:
                yield held.pop()
                values = 0
    if held:
        yield _merged(held)


def _merged(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches)
    lists, owner = np.unique(table["list_id"].to_numpy(), return_inverse=True)
    order = np.argsort(owner, kind="stable")
    edges = np.searchsorted(owner[order], np.arange(len(lists)))
    total = np.add.reduceat(as_matrix(table["total"])[order], edges, axis=0)
    n = np.add.reduceat(table["n"].to_numpy()[order], edges)
    return pa.RecordBatch.from_arrays(
        [pa.array(lists).cast(table["list_id"].type), as_list_column(total, pa.float64()), pa.array(n)],
        names=["list_id", "total", "n"])


def _training_rows(base: DataFrame) -> DataFrame:
    context = base.sparkSession.sparkContext
    fine = F.forall("emb", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf)))
    rows = base.withColumn("emb", F.col("emb").cast("array<double>")).dropna().where(fine)
    return rows.coalesce(_TASKS_PER_CORE * context.defaultParallelism)


def _rounds(rows: DataFrame, centroids: DataFrame, iterations: int, broadcast_limit: int,
            key: str | None = None) -> DataFrame:
    """Move the centroids to the mean of their rows, ``iterations`` times."""
    ship_package(rows.sparkSession)
    number = centroids.schema["list_id"].dataType.simpleString()
    schema = f"list_id {number}, total array<double>, n long"
    tree = None if key or not iterations or _fits(centroids, broadcast_limit) else _Tree(rows, centroids)
    for _ in range(iterations):
        if tree:
            sums = tree.sums(centroids, schema)
        else:
            sums = assign_lists(rows, centroids, broadcast_limit, key).mapInArrow(_add_up, schema)
        moved = sums.groupBy("list_id").applyInArrow(_average, f"list_id {number}, moved array<double>")
        centroids = _replace_moved(centroids, moved, broadcast_limit)
    return centroids


def _replace_moved(centroids: DataFrame, moved: DataFrame, broadcast_limit: int) -> DataFrame:
    """New centroids; a list without rows keeps its old one. Few enough to be broadcast, they
    are put together on the driver, else in a written table."""
    if not _fits(centroids, broadcast_limit):
        joined = centroids.join(moved, "list_id", "left")
        kept = joined.withColumn("emb", F.coalesce("moved", "emb")).select(*centroids.columns)
        return materialize(kept, "centroids")
    old, new = centroids.toArrow(), moved.toArrow()
    place = {number: at for at, number in enumerate(old["list_id"].to_pylist())}
    matrix = as_matrix(old["emb"]).copy()
    if new.num_rows:
        matrix[[place[n] for n in new["list_id"].to_pylist()]] = as_matrix(new["moved"])
    at = old.schema.get_field_index("emb")
    table = old.combine_chunks().set_column(at, "emb", as_list_column(matrix, pa.float64()))
    return centroids.sparkSession.createDataFrame(table)


def _fits(centroids: DataFrame, broadcast_limit: int) -> bool:
    size = centroids.agg(F.sum(F.size("emb").cast("long") * 8).alias("bytes")).first()["bytes"]
    return (size or 0) <= broadcast_limit


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per list seen in a task: the sum and number of its vectors."""
    totals: dict[int, list] = {}
    for batch in batches:
        if not batch.num_rows:
            continue
        kind = batch["list_id"].type
        lists, owner = np.unique(batch["list_id"].to_numpy(), return_inverse=True)
        vectors = as_matrix(batch["emb"])
        order = np.argsort(owner, kind="stable")
        edges = np.searchsorted(owner[order], np.arange(len(lists)))
        sums = np.add.reduceat(vectors[order], edges, axis=0)
        for number, total, n in zip(lists.tolist(), sums, np.bincount(owner)):
            held = totals.setdefault(number, [0.0, 0])
            held[0], held[1] = held[0] + total, held[1] + int(n)
    if totals:
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(totals), kind),
             as_list_column(np.array([t for t, _ in totals.values()]), pa.float64()),
             pa.array([n for _, n in totals.values()], pa.int64())],
            names=["list_id", "total", "n"],
        )


def _average(table: pa.Table) -> pa.Table:
    """The mean of one list from at most one row per task."""
    mean = as_matrix(table["total"]).sum(axis=0) / table["n"].to_numpy().sum()
    return pa.table({
        "list_id": table["list_id"].combine_chunks().slice(0, 1),
        "moved": as_list_column(mean[None, :], pa.float64()),
    })


def _by_value(column: pa.Array | None, rows: int) -> Iterator[tuple[object, np.ndarray]]:
    """Row numbers of every value of a column; of all rows without one."""
    if not rows:
        return
    if column is None:
        yield None, np.arange(rows)
        return
    coded = column.dictionary_encode()
    index = coded.indices.fill_null(len(coded.dictionary)).to_numpy()
    order = np.argsort(index, kind="stable")
    values = [*coded.dictionary.to_pylist(), None]
    edges = np.searchsorted(index[order], np.arange(len(values) + 1))
    for at, value in enumerate(values):
        if edges[at + 1] > edges[at]:
            yield value, order[edges[at] : edges[at + 1]]


def assign_lists(
    base: DataFrame, centroids: DataFrame, broadcast_limit: int = BROADCAST_LIMIT_BYTES,
    key: str | None = None,
) -> DataFrame:
    """Adds ``list_id``, the nearest centroid, null for a vector that is null or not finite. With
    ``key`` a row's lists are those with its value of that column. Rows stay where they are unless
    the centroids are too many to send to every task; then they are written once by cell."""
    spark = base.sparkSession
    ship_package(spark)
    number = centroids.schema["list_id"].dataType
    own = [key] if key else []
    if not _fits(centroids, broadcast_limit) and not key:
        return _Tree(base, centroids).assigned(centroids)
    if not _fits(centroids, broadcast_limit):
        rows = base.select(F.col("id").alias("qid"), "emb", *own)
        lists = centroids.select(F.col("list_id").cast("long").alias("id"), "emb", *own)
        found = nearest(rows, lists, 1, key=key, broadcast_limit=broadcast_limit)
        pairs = found.select(F.col("qid").alias("id"), F.col("id").cast(number).alias("list_id"))
        return base.join(pairs, "id", "left")
    table = centroids.toArrow().sort_by("list_id")
    heads = table[key].to_pylist() if key else [None] * table.num_rows
    groups: dict = {}
    for at, value in enumerate(heads):
        groups.setdefault(value, []).append(at)
    matrix, numbers = as_matrix(table["emb"]), table["list_id"].to_numpy()
    shared = spark.sparkContext.broadcast({
        value: (numbers[rows], VectorBlock(matrix[rows], EUCLIDEAN)) for value, rows in groups.items()
    })

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, np.int64)
            known = batch["emb"].is_valid().to_numpy(zero_copy_only=False)
            if known.any():
                matrix = as_matrix(batch["emb"].filter(pa.array(known)))
                fine = finite_rows(matrix)
                matrix = matrix[fine]
                known[known] = fine
            rows = np.flatnonzero(known)
            for value, part in _by_value(batch[key].take(pa.array(rows)) if key else None, len(rows)):
                if value not in shared.value:
                    known[rows[part]] = False
                    continue
                ids, centres = shared.value[value]
                found[rows[part]] = ids[nearest_row(VectorBlock(matrix[part], EUCLIDEAN), centres)]
            lists = pa.array(found, mask=~known).cast(kind)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, lists], names=[*batch.schema.names, "list_id"]
            )

    kind = to_arrow_type(number)
    schema = T.StructType([*base.schema.fields, T.StructField("list_id", number)])
    return base.mapInArrow(assign, schema)


def write_lists(assigned: DataFrame, path: str) -> DataFrame:
    """Store the table by list, so that a search reads only the probed lists. Rows are spread by
    list and id, so a list that holds much of the table is written by several tasks."""
    ordered = assigned.repartitionByRange("list_id", "id")
    ordered.write.partitionBy("list_id").parquet(path)
    return assigned.sparkSession.read.schema(assigned.schema).parquet(path)


def probes(queries: DataFrame, centroids: DataFrame, n_probe: int, **sizes: int) -> DataFrame:
    """The lists to search: ``(qid, list_id, probe_rank)``; 0 means every list."""
    lists = centroids.select(F.col("list_id").cast("long").alias("id"), "emb")
    wanted = n_probe or centroids.count()
    found = nearest(queries.select("qid", "emb"), lists, wanted, **sizes)
    return found.select(
        "qid", F.col("id").cast("int").alias("list_id"), F.col("rank").alias("probe_rank")
    )


def with_lists(queries: DataFrame, probed: DataFrame) -> DataFrame:
    """Queries with all their lists to search in one column, nearest first, beside one vector."""
    lists = probed.groupBy("qid").agg(
        F.sort_array(F.collect_list(F.struct("probe_rank", "list_id")))["list_id"].alias("list_id"))
    return queries.select("qid", "emb").join(lists, "qid")


def search_lists(
    queries: DataFrame, assigned: DataFrame, centroids: DataFrame, k: int, n_probe: int,
    metric: str = EUCLIDEAN, **sizes: int,
) -> DataFrame:
    """The k nearest rows among the probed lists; 0 probes search all lists, which is a plain scan."""
    if not n_probe:
        return nearest(queries, assigned.where(F.col("list_id").isNotNull()), k, metric, **sizes)
    asked = with_lists(queries, probes(queries, centroids, n_probe, **sizes))
    partial = nearest_partial(asked, assigned, k, metric, key="list_id", **sizes)
    return rank_nearest(partial, k, metric).select("qid", "id", "rank", "score")


# Lists of a block are numbered from this many times the block.
_LOCAL = 1 << 32


def local_lists(
    base: DataFrame, *, rows_per_list: int = ROWS_PER_FINE_LIST, seed: int = 0, iterations: int = 10,
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
) -> tuple[DataFrame, DataFrame]:
    """Lists of their own for every ``block`` of rows, trained for all blocks at once.

    Returns the rows with ``list_id`` (unique over all blocks as ``block:number``) and the
    centroids ``(block, list_id, emb)``. A block starts from its first rows in seeded order, one
    list per ``rows_per_list``.
    """
    rows = _training_rows(base.select("block", "id", "emb"))
    order = Window.partitionBy("block").orderBy(shuffle_key(seed, F.col("id")), "id")
    drawn = rows.select("block", "id").withColumns({
        "n": F.row_number().over(order) - 1, "rows": F.count("*").over(Window.partitionBy("block")),
    }).where(F.col("n") < F.ceil(F.col("rows") / rows_per_list))
    number = F.col("block") * F.lit(_LOCAL) + F.col("n")
    start = rows.join(drawn.select("id", number.alias("list_id")), "id").select("block", "list_id", "emb")
    centroids = _rounds(rows, materialize(start, "centroids"), iterations, broadcast_limit, "block")
    name = F.concat_ws(":", F.floor(F.col("list_id") / _LOCAL), F.col("list_id") % _LOCAL).alias("list_id")
    assigned = assign_lists(base, centroids, broadcast_limit, "block")
    rest = [c for c in assigned.columns if c != "list_id"]
    return assigned.select(*rest, F.when(F.col("list_id").isNotNull(), name).alias("list_id")), \
        centroids.select("block", name, "emb")


class _Probing(_Queries):
    """Queries that find out in a task which lists of a block they probe, so that no table holds their pairs.

    ``heads`` has the numbers and centroids of every block's lists.
    """

    def __init__(self, table: pa.Table, spec: _Spec, heads: dict, n_probe: int):
        super().__init__(table, spec)
        self.heads, self.n_probe = heads, n_probe
        self.plain = self.block if spec.metric == EUCLIDEAN else VectorBlock(self.block.matrix, EUCLIDEAN)

    def add_block(self, top: TopK, base: VectorBlock, batch) -> None:
        ids, numbers = batch["id"].to_numpy(), batch["number"].to_numpy()
        column = batch["block"]
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        every = np.arange(len(self.plain.matrix))
        for block, part in _by_value(column, batch.num_rows):
            if block not in self.heads or not len(every):
                continue
            lists, centres = self.heads[block]
            part = part[np.isin(numbers[part], lists)]
            near = TopK(self.plain, self.n_probe, EUCLIDEAN)
            near.add(every, centres, lists)
            who, found, _ = near.rows()
            probed, held = np.searchsorted(lists, found), np.searchsorted(lists, numbers[part])
            rows = base.take(part)
            if len(lists) <= 64 * _MOST_WORDS:
                marks = [np.zeros((n, -(-len(lists) // 64)), np.uint64) for n in (len(every), len(part))]
                np.bitwise_or.at(marks[0], (who, probed // 64), np.uint64(1) << (probed % 64).astype(np.uint64))
                marks[1][np.arange(len(part)), held // 64] = np.uint64(1) << (held % 64).astype(np.uint64)
                top.add(every, rows, ids[part], marks=marks)
                continue
            order = np.argsort(probed, kind="stable")
            edges = np.searchsorted(probed[order], np.arange(len(lists) + 1))
            for at in np.unique(held):
                own = np.flatnonzero(held == at)
                top.add(np.sort(who[order[edges[at] : edges[at + 1]]]), rows.take(own), ids[part[own]])


def _repeats(df: DataFrame, *columns: str) -> bool:
    return not df.groupBy(*columns).count().where(F.col("count") > 1).isEmpty()


def search_local_lists(
    queries: DataFrame, assigned: DataFrame, centroids: DataFrame, k: int, n_probe: int,
    metric: str = EUCLIDEAN, **sizes: int,
) -> DataFrame:
    """The k nearest rows among the ``n_probe`` nearest lists of every block; 0 searches all lists, which
    is a plain scan.

    A query probes lists in every block. Centroids that can be sent to every task are looked up where the
    block's rows are; only if they cannot, or ids repeat, are the probed lists a table.
    """
    if not n_probe:
        return nearest(queries, assigned.where(F.col("list_id").isNotNull()), k, metric, **sizes)
    numbered = centroids.withColumn("number", F.split("list_id", ":")[1].cast("long"))
    limit = sizes.get("broadcast_limit", BROADCAST_LIMIT_BYTES)
    if _fits(centroids, limit) and not _repeats(centroids, "list_id") and not _repeats(queries, "qid"):
        partial = _probed_in_tasks(queries, assigned, numbered, k, n_probe, metric, sizes)
        return rank_nearest(partial, k, metric).select("qid", "id", "rank", "score")
    last = numbered.agg(F.max("block").alias("last")).first()["last"]
    per_block = queries.select("qid", "emb").withColumn(
        "block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")))
    )
    heads = numbered.select(F.col("number").alias("id"), "emb", "block")
    found = rank_nearest(
        nearest_partial(per_block, heads, n_probe, key="block", tags=("block",), **sizes),
        n_probe, EUCLIDEAN, ("qid", "block"),
    )
    lists = found.select("qid", F.concat_ws(":", "block", "id").alias("list_id"))
    asked = queries.select("qid", "emb").join(lists, "qid")
    partial = nearest_partial(asked, assigned, k, metric, key="list_id", **sizes)
    return rank_nearest(partial, k, metric).select("qid", "id", "rank", "score")


def _probed_in_tasks(
    queries: DataFrame, assigned: DataFrame, numbered: DataFrame, k: int, n_probe: int, metric: str, sizes: dict,
) -> DataFrame:
    table = numbered.where(F.col("emb").isNotNull()).select("block", "number", "emb").toArrow().sort_by(
        [("block", "ascending"), ("number", "ascending")]).combine_chunks()
    heads = {}
    for block, part in _by_value(table["block"].combine_chunks(), table.num_rows):
        own = table.take(pa.array(part))
        matrix = as_matrix(own["emb"])
        fine = finite_rows(matrix)
        heads[block] = own["number"].to_numpy()[fine], VectorBlock(matrix[fine], EUCLIDEAN)
    heads = {block: found for block, found in heads.items() if len(found[0])}
    name = F.split("list_id", ":")
    rows = assigned.where(F.col("list_id").isNotNull()).select(
        "id", "emb", name[0].cast("long").alias("block"), name[1].cast("long").alias("number"))
    asked = queries.select("qid", "emb").where(F.col("qid").isNotNull())
    spec = _Spec(k, metric_for(metric), None, None, ())
    return compared(
        asked, rows, lambda few: _Probing(few, spec, heads, n_probe), partial_schema(asked, spec), k, order="block",
        **sizes)


def hash_directions(dim: int, tables: int, seed: int) -> np.ndarray:
    """Unit vectors (dim x tables) whose components come from md5, so that any engine can draw them."""
    def component(t: int, i: int) -> float:
        head = hashlib.md5(f"{seed}:{t}:{i}".encode()).hexdigest()[:8]
        return int(head, 16) / 2147483648.0 - 1.0

    drawn = np.array([[component(t, i) for t in range(tables)] for i in range(dim)])
    return drawn / np.sqrt((drawn**2).sum(axis=0))


def hash_buckets(emb: Column, directions: np.ndarray, bucket_length: float) -> Column:
    """One bucket per table: ``table * 2**32`` plus the floor of the projection over the length."""

    @arrow_function("array<bigint>")
    def buckets(column: pa.Array) -> pa.Array:
        matrix = as_matrix(column)
        matrix = np.where(finite_rows(matrix)[:, None], matrix, 0.0)
        place = np.floor(matrix @ directions / bucket_length)
        place = np.clip(place, -(2**31), 2**31 - 1).astype(np.int64) + 2**31
        return as_list_column(place + (np.arange(place.shape[1]) << 32), pa.int64())

    return buckets(emb)


def nearest_by_hash(
    queries: DataFrame, base: DataFrame, k: int, *, bucket_length: float, tables: int,
    seed: int = 0, **sizes: int,
) -> DataFrame:
    """The k nearest rows among those sharing a random-projection bucket with the query.

    Rows and queries list their buckets beside their vectors, which are held once. A pair is compared once,
    however many buckets it shares, where buckets hold much of the table.
    """
    first = base.select(F.size("emb").alias("d")).where("d >= 0").first()
    directions = hash_directions(first["d"] if first else 0, tables, seed)
    listed = base.select("id", "emb", hash_buckets(F.col("emb"), directions, bucket_length).alias("bucket"))
    asked = queries.select("qid", "emb", hash_buckets(F.col("emb"), directions, bucket_length).alias("bucket"))
    partial = nearest_partial(asked, listed, k, EUCLIDEAN, key="bucket", **sizes)
    once = partial.groupBy("qid", "id").agg(F.min("__key").alias("__key"))
    return rank_nearest(once, k, EUCLIDEAN).select("qid", "id", "rank", "score")


def parameter_grid(df: DataFrame, **values: Sequence) -> DataFrame:
    """Every row of ``df`` with every combination of the given parameter values."""
    for name, options in values.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(x) for x in options])))
    return df


def sweep(
    queries: DataFrame, bases: dict[str, tuple[DataFrame, DataFrame]], centroids: DataFrame,
    truth: DataFrame, n_probes: Sequence[int], ks: Sequence[int], **sizes: int,
) -> DataFrame:
    """Recall of every (quantisation, n_probe, k) from one scan per quantisation, and a plain one for
    all lists (0).

    ``bases`` maps a quantisation name to its (queries, assigned rows). Candidates carry the rank
    of the list they came from, so the result for ``n_probe`` is the candidates of rank up to it.
    """
    top = max(ks)
    truth = materialize(truth, "truth")  # it is read several times for every k
    some = sorted({n for n in n_probes if n})
    asked = materialize(probes(queries, centroids, some[-1], **sizes), "probes") if some else None
    per_setting = None
    for name, (own_queries, assigned) in bases.items():
        runs = []
        if some:
            near = nearest_partial(
                with_lists(own_queries, asked), assigned, top, key="list_id", place="probe_rank", **sizes)
            deep = F.filter(F.array(*map(F.lit, some)), lambda n: n >= F.col("probe_rank"))
            runs.append(near.withColumn("n_probe", F.explode(deep)))
        if 0 in n_probes:
            held = assigned.where(F.col("list_id").isNotNull())
            runs.append(nearest_partial(own_queries, held, top, **sizes).withColumn("n_probe", F.lit(0)))
        for run in runs:
            run = run.select(F.lit(name).alias("quantisation"), "n_probe", "qid", "id", "__key")
            per_setting = run if per_setting is None else per_setting.unionByName(run)
    ranked = materialize(
        rank_nearest(per_setting, top, EUCLIDEAN, ("quantisation", "n_probe", "qid")), "sweep"
    )
    results = None
    for k in ks:
        part = recall_by_rank(ranked, truth, ["quantisation", "n_probe"], k).withColumn("k", F.lit(k))
        results = part if results is None else results.unionByName(part)
    return results
