"""Exact nearest-neighbour joins.

One operator covers the plain join and its filtered forms: an equality key (labels, set members,
inverted lists, hash buckets) and a closed range. Two physical forms give the same rows:

* few queries: the query matrix, whose size is checked first, is broadcast and the base table is
  scanned once where it lies, every task keeping only the k best per query; a few times as many are
  cut into slices of that size, each with a scan of its own, so that the base is never moved;
* many queries: the base is written once, every row in one block, into a table bucketed by block;
  queries are routed to the blocks that they can match, in waves of bounded size. A wave moves its
  queries only: the blocks are read where they lie. Blocks follow the key or ranges of the
  attribute, and a frequent key or value gets as many blocks as its rows need. Blocks that are small
  share a task, to which a query goes once for all of them.

Either way one window on the query id, whose limit is applied before the shuffle too, merges the
partial lists. Several filters over one base share all of this: see :func:`all_ground_truths`.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from nearfield.operators.kernels import (
    COSINE,
    EUCLIDEAN,
    TopK,
    VectorBlock,
    add_in_range,
    as_matrix,
    finite_rows,
)
from nearfield.session import BROADCAST_LIMIT_BYTES, materialize, scratch_path, ship_package

# Values (rows x dimensions) of a base block, 32 MB of float32, up to which smaller blocks share a task. The
# queries of a wave take up to twice as many bytes, times this many, with the lists that are found.
BLOCK_VALUES = 8_000_000
_WAVE_BLOCKS = 4
# Queries that a task compares with its blocks at once, and words of 64 keys by which they may share one.
_ASKED = 16_384
# Query rows whose lists leave a task as one batch.
_FOUND = 4_096
_MOST_WORDS = 16
# Lists of keys and blocks up to this many rows are broadcast (about 32 bytes a row).
_BROADCAST_KEYS = 1_000_000
# Slices of queries that are broadcast one by one before the blocked form takes over, and scan tasks
# per core: fewer and longer tasks leave fewer partial lists to merge.
_MOST_SLICES = 8
_SCANS_PER_CORE = 4
# Waves that are one plan; more are written one after another.
_PLAN_WAVES = 8
# Bands of the attribute by which range queries are routed.
_MOST_BANDS = 64
# Buckets of a stored base, and the fewest rows worth a block of their own.
MOST_BUCKETS = 20_000
_LEAST_ROWS = 4_096
_CELL = "__cell"
_PLACE = "__places"
_FILTER = "filter_type"


def metric_for(name: str) -> str:
    """The metric a name stands for, be it a metric or a dataset named after one."""
    text = name.lower()
    if "euclidean" in text or text in ("l2", "l2sq"):
        return EUCLIDEAN
    if "angular" in text or "cosine" in text:
        return COSINE
    raise ValueError(f"no metric in {name!r}")


@dataclass(frozen=True)
class Range:
    """``base.attr`` between ``query.low`` and ``query.high``, both ends included."""

    attr: str
    low: str
    high: str


@dataclass(frozen=True)
class _Spec:
    k: int
    metric: str
    key: str | None
    within: Range | None
    tags: tuple[str, ...]
    place: str | None = None
    shared: bool = False  # both sides list their keys, and a pair counts once


def _dimension(df: DataFrame) -> int:
    coded = isinstance(df.schema["emb"].dataType, T.BinaryType)
    row = df.select((F.length("emb") if coded else F.size("emb")).alias("d")).first()
    return row["d"] if row else 0


def _query_columns(spec: _Spec) -> list[str]:
    cols = ["qid", *spec.tags, "emb"]
    if spec.key and spec.key not in cols:
        cols.append(spec.key)
    if spec.within:
        cols += [spec.within.low, spec.within.high]
    return cols


def _base_columns(spec: _Spec) -> list[str]:
    cols = ["id", "emb"]
    if spec.key:
        cols.append(spec.key)
    if spec.within:
        cols.append(spec.within.attr)
    return cols


def _numpy(column) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def _valid(table, columns: Sequence[str]) -> np.ndarray:
    """Rows without nulls in these columns."""
    fine = np.ones(table.num_rows, dtype=bool)
    for column in columns:
        if table[column].null_count:
            fine &= _numpy(table[column].is_valid())
    return fine


def _finite(table):
    """Rows whose vectors are finite, and the vectors."""
    matrix = as_matrix(table["emb"])
    fine = finite_rows(matrix)
    return (table, matrix) if fine.all() else (table.filter(pa.array(fine)), matrix[fine])


def _by_value(column: pa.Array) -> Iterator[tuple[object, np.ndarray]]:
    """Every value but null, and where it stands."""
    coded = column.dictionary_encode()
    index = _numpy(coded.indices.fill_null(len(coded.dictionary)))
    order = np.argsort(index, kind="stable")
    edges = np.searchsorted(index[order], np.arange(len(coded.dictionary) + 1))
    for at, value in enumerate(coded.dictionary.to_pylist()):
        yield value, order[edges[at] : edges[at + 1]]


class _Queries:
    """Query rows as a task sees them; rows with a null in what the filter needs match nothing.

    A query may list its keys. Its vector is held once; it has one list of neighbours, or one per key
    if the key's place is asked for.
    """

    def __init__(self, table: pa.Table, spec: _Spec, block: VectorBlock | None = None):
        self.spec, self.metric = spec, spec.metric
        if block is None:
            table, matrix = _finite(table)
            block = VectorBlock(matrix, spec.metric)
        self.block = block
        self.labels = {name: table[name].combine_chunks() for name in ("qid", *spec.tags)}
        fine = np.flatnonzero(_valid(table, _filters(spec)[0]))
        self.owner = np.arange(table.num_rows)
        self.rows = {None: fine}
        if spec.key:
            self._by_key(table.take(pa.array(fine)), fine)
        if spec.within:
            self.low, self.high = (
                _numpy(table[c].fill_null(0) if table[c].null_count else table[c])[self.owner]
                for c in (spec.within.low, spec.within.high))

    def _by_key(self, table: pa.Table, rows: np.ndarray) -> None:
        keys = table[self.spec.key].combine_chunks()
        if pa.types.is_list(keys.type):
            lengths = _numpy(keys.value_lengths()).astype(np.int64)
            rows = np.repeat(rows, lengths)
            if self.spec.place:
                if _PLACE in table.column_names:
                    place = _numpy(table[_PLACE].combine_chunks().flatten()).astype(np.int64)
                else:
                    place = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                self.labels = {name: labels.take(pa.array(rows)) for name, labels in self.labels.items()}
                self.labels[self.spec.place] = pa.array(place + 1, pa.int64())
                self.owner, rows = rows, np.arange(len(rows))
            keys = keys.flatten()
        self.rows = {value: rows[part] for value, part in _by_value(keys)}
        self.codes = {value: at for at, value in enumerate(v for v in self.rows if v is not None)}
        self.marks = None
        if self.spec.shared and len(self.codes) <= 64 * _MOST_WORDS:
            self.marks = self._marked(
                len(self.owner), ((code, self.rows[value]) for value, code in self.codes.items()))

    def _marked(self, rows: int, found: Iterable[tuple[int, np.ndarray]]) -> np.ndarray:
        """A bit per key of the queries, in words of 64."""
        marks = np.zeros((rows, max(1, -(-len(self.codes) // 64))), np.uint64)
        for code, some in found:
            marks[some, code // 64] |= np.uint64(1 << code % 64)
        return marks

    def collector(self) -> TopK:
        return TopK(self.block, self.spec.k, self.spec.metric, self.owner, self.spec.shared)

    def add(self, top: TopK, batch) -> None:
        if batch.num_rows:
            batch, matrix = _finite(batch)
            self.add_block(top, VectorBlock(matrix, self.spec.metric), batch)

    def add_block(self, top: TopK, base: VectorBlock, batch) -> None:
        spec = self.spec
        fine = _valid(batch, _filters(spec)[1])
        if not fine.all():
            base, batch = base.take(fine), batch.filter(pa.array(fine))
        if not batch.num_rows:
            return
        ids = _numpy(batch["id"])
        attr = _numpy(batch[spec.within.attr]) if spec.within else None
        if not spec.key:
            self._merge(top, self.rows[None], base, ids, attr)
            return
        codes = batch[spec.key]
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        owner = None
        if pa.types.is_list(codes.type):  # a row stands under each of its keys; its vector is held once
            owner = np.repeat(np.arange(len(codes)), codes.value_lengths().to_numpy())
            codes = codes.flatten()
        met = [(value, part if owner is None else owner[part]) for value, part in _by_value(codes)
               if value is not None and value in self.rows]
        if spec.shared and self.marks is not None:
            pairs = sum(len(self.rows[value]) * len(part) for value, part in met)
            if 2 * pairs > len(self.owner) * len(ids):  # cheaper to compare all pairs once
                marks = self._marked(len(ids), ((self.codes[value], part) for value, part in met))
                top.add(np.arange(len(self.owner)), base, ids, marks=(self.marks, marks))
                return
        for value, part in met:
            rows = self.rows.get(value)
            if rows is not None:
                self._merge(
                    top, rows, base.take(part), ids[part], None if attr is None else attr[part]
                )

    def _merge(self, top, rows, base, ids, attr):
        if attr is None:
            top.add(rows, base, ids)
        else:
            add_in_range(top, rows, self.low, self.high, base, ids, attr)

    def pieces(self, top: TopK) -> Iterator[pa.RecordBatch]:
        """What is found, in batches of bounded size."""
        for first in range(0, len(self.owner), _FOUND):
            yield self.found(top, first, first + _FOUND)

    def found(self, top: TopK, first: int = 0, last: int | None = None) -> pa.RecordBatch:
        qi, ids, keys = top.rows(first, last)
        picked = pa.array(qi)
        columns = [labels.take(picked) for labels in self.labels.values()]
        columns += [pa.array(ids, pa.int64()), pa.array(keys, pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=[*self.labels, "id", "__key"])


class _ManyFilters:
    """Query rows under several filters, which share the vectors of the queries and of each batch."""

    def __init__(self, table: pa.Table, specs: Mapping[str, _Spec]):
        table, matrix = _finite(table)
        self.metric = next(iter(specs.values())).metric
        block = VectorBlock(matrix, self.metric)
        self.parts = {name: _Queries(table, spec, block) for name, spec in specs.items()}

    def collector(self) -> dict[str, TopK]:
        return {name: part.collector() for name, part in self.parts.items()}

    def add(self, tops: dict[str, TopK], batch) -> None:
        if batch.num_rows:
            batch, matrix = _finite(batch)
            self.add_block(tops, VectorBlock(matrix, self.metric), batch)

    def add_block(self, tops: dict[str, TopK], base: VectorBlock, batch) -> None:
        for name, part in self.parts.items():
            part.add_block(tops[name], base, batch)

    def pieces(self, tops: dict[str, TopK]) -> Iterator[pa.RecordBatch]:
        for name, part in self.parts.items():
            for batch in part.pieces(tops[name]):
                yield batch.add_column(0, _FILTER, pa.array([name] * batch.num_rows, pa.string()))


def partial_schema(queries: DataFrame, spec: _Spec) -> T.StructType:
    fields = [T.StructField(c, queries.schema[c].dataType) for c in ("qid", *spec.tags)]
    if spec.place:
        fields.append(T.StructField(spec.place, T.LongType()))
    return T.StructType(
        [*fields, T.StructField("id", T.LongType()), T.StructField("__key", T.DoubleType())]
    )


def _scan_with(shared, base: DataFrame, schema: T.StructType) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        local = shared.value
        top = local.collector()
        for batch in batches:
            local.add(top, batch)
        yield from local.pieces(top)

    return base.mapInArrow(scan, schema)


def _scanned(local, base: DataFrame, schema: T.StructType) -> DataFrame:
    """One scan of the base by a few tasks per core, with the queries broadcast."""
    context = base.sparkSession.sparkContext
    base = base.coalesce(_SCANS_PER_CORE * context.defaultParallelism)
    return _scan_with(context.broadcast(local), base, schema)


def _broadcast_form(table: pa.Table, queries: DataFrame, base: DataFrame, spec: _Spec) -> DataFrame:
    local = _Queries(table, spec)
    if spec.key:
        keys = [key for key in local.rows if key is not None]
        kind = base.schema[spec.key].dataType
        if isinstance(kind, T.ArrayType):
            if 0 < len(keys) <= 1000:
                own = F.array(*[F.lit(key).cast(kind.elementType) for key in keys])
                base = base.where(F.arrays_overlap(F.col(spec.key), own))
        elif len(keys) <= 1000:
            base = base.where(F.col(spec.key).isin(keys))
        else:
            own = queries.schema[spec.key].dataType
            wanted = base.sparkSession.createDataFrame([(key,) for key in keys], T.StructType(
                [T.StructField(spec.key, own.elementType if isinstance(own, T.ArrayType) else own)]))
            base = base.join(F.broadcast(wanted), spec.key, "left_semi").select(*base.columns)
    if spec.within and len(local.low):
        reach = F.col(spec.within.attr).between(local.low.min().item(), local.high.max().item())
        base = base.where(reach)
    return _scanned(local, base, partial_schema(queries, spec))


def _blocks(rows: int, size: int, cores: int) -> int:
    """Blocks of ``size`` rows, as many as cores if there are rows enough."""
    return max(1, -(-rows // size), min(cores, -(-rows // _LEAST_ROWS)))


def _task_of(cell: Column, tasks: int | None) -> Column:
    """The block itself, or the task that it shares with other blocks."""
    if not tasks:
        return cell
    return F.pmod(F.shiftright(cell, 32).bitwiseXOR(cell), F.lit(tasks).cast("long"))


def _sent(queries: DataFrame, cells: Column, tasks: int | None) -> DataFrame:
    """Queries once for every task that has one of these blocks."""
    met = F.array_distinct(F.transform(cells, lambda x: _task_of(x, tasks))) if tasks else cells
    return queries.withColumn(_CELL, F.explode(met))


def _in_all_blocks(
    queries: DataFrame, base: DataFrame, n: int, tasks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    cell = _task_of(F.pmod(F.xxhash64("id"), F.lit(n)).cast("long"), tasks)
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(min(n, tasks or n) - 1).cast("long")))
    return queries.withColumn(_CELL, every), base.withColumn(_CELL, cell)


def _by_member(
    queries: DataFrame, base: DataFrame, key: str, n: int, tasks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows lie in one block whatever their members; queries go to blocks that hold their member."""
    placed = base.withColumn(_CELL, _task_of(F.pmod(F.xxhash64("id"), F.lit(n)).cast("long"), tasks))
    holds = materialize(placed.select(F.explode(key).alias(key), _CELL).distinct(), "members")
    if holds.count() <= _BROADCAST_KEYS:
        holds = F.broadcast(holds)
    return queries.join(holds, key), placed


def _by_key(
    queries: DataFrame, base: DataFrame, key: str, n: int, base_rows: int, tasks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows of a key lie in one block, which keys share, but for keys with more rows than a block.

    There are no more of those than blocks, so their list is small.
    """
    counted = base.groupBy(key).agg(F.count("*").alias("__n")).where(F.col("__n") > base_rows)
    hot = F.broadcast(materialize(
        counted.select(key, F.ceil(F.col("__n") / base_rows).cast("long").alias("__parts")), "hot-keys"))
    shared = F.pmod(F.xxhash64(key), F.lit(n)).cast("long")

    def cell(part: Column) -> Column:
        # Hashes of keys' parts may meet each other; keys are told apart inside a block anyway.
        return F.when(F.col("__parts").isNull(), shared).otherwise(F.xxhash64(F.col(key), part))

    part = F.pmod(F.xxhash64("id"), F.col("__parts"))
    placed = base.join(hot, key, "left").withColumn(_CELL, _task_of(cell(part), tasks)).drop("__parts")
    parts = F.sequence(F.lit(0).cast("long"), F.coalesce("__parts", F.lit(1)) - 1)
    routed = _sent(queries.join(hot, key, "left"), F.transform(parts, cell), tasks)
    return routed.drop("__parts"), placed


def _by_listed_keys(queries: DataFrame, base: DataFrame, key: str, route) -> tuple[DataFrame, DataFrame]:
    """Queries that list their keys go once to every block that one of them leads to, with the keys that
    do. Only ids and keys are routed; the vectors meet them at the end."""
    routed, placed = route(queries.select("qid", F.posexplode(key).alias(_PLACE, key)), base)
    met = routed.groupBy("qid", _CELL).agg(F.sort_array(F.collect_list(F.struct(_PLACE, key))).alias("__met"))
    lists = met.select("qid", _CELL, *[F.col("__met")[c].alias(c) for c in (key, _PLACE)])
    return queries.drop(key).join(lists, "qid"), placed


def _by_range(
    queries: DataFrame, base: DataFrame, within: Range, n: int, base_rows: int, tasks: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows lie in bands of the attribute, each of as many blocks as it needs; queries go to the bands
    that their range reaches. The bands are a few rows."""
    attr = F.col(within.attr)
    bands = min(_MOST_BANDS, n)
    cuts = [i / bands for i in range(1, bands)]
    found = base.agg(F.percentile_approx(attr, cuts, 10_000).alias("c")).first()["c"] if cuts else None
    edges = sorted(set(found or ()))
    band = F.size(F.filter(F.array(*map(F.lit, edges)), lambda x: x < attr)) if edges else F.lit(0)
    banded = base.withColumn("__band", band)
    spans = banded.groupBy("__band").agg(
        F.min(attr).alias("low"), F.max(attr).alias("high"), F.count("*").alias("n")).collect()
    if not spans:
        return _in_all_blocks(queries, base, 1, tasks)
    options = F.array(*[
        F.struct(F.lit(r["__band"]).alias("band"), F.lit(r["low"]).alias("low"), F.lit(r["high"]).alias("high"),
                 F.lit(-(-r["n"] // base_rows)).cast("long").alias("parts")) for r in spans])
    own = F.element_at(F.filter(options, lambda x: x["band"] == F.col("__band")), 1)["parts"]
    spread = F.lit(1 << 32).cast("long")
    cell = F.col("__band") * spread + F.pmod(F.xxhash64("id"), own)
    met = F.filter(options, lambda x: (x["low"] <= F.col(within.high)) & (x["high"] >= F.col(within.low)))
    cells = F.flatten(F.transform(met, lambda x: F.transform(
        F.sequence(F.lit(0).cast("long"), x["parts"] - 1), lambda p: x["band"] * spread + p)))
    return _sent(queries, cells, tasks), banded.withColumn(_CELL, _task_of(cell, tasks)).drop("__band")


def stored_by_cell(base: DataFrame, buckets: int) -> DataFrame:
    """The base written once, bucketed by block. The table's name is only needed to tell Spark of the
    buckets; its files lie in the shared folder."""
    spark = base.sparkSession
    name = f"blocks_{uuid.uuid4().hex}"
    writer = base.repartition(buckets, _CELL).write.format("parquet").option("path", scratch_path(spark, "blocks"))
    writer.bucketBy(buckets, _CELL).saveAsTable(name)
    stored = spark.table(name)
    stored.schema  # resolved, so the name may go
    spark.sql(f"DROP TABLE {name}")
    return stored


def _blocked_form(
    queries: DataFrame, base: DataFrame, place, local, schema: T.StructType, rows: int, k: int, per: Sequence[str],
    lists: float = 1.0, attr: str | None = None,
) -> DataFrame:
    """Candidate lists by waves of queries over a stored base.

    ``place`` routes queries and places base rows, given the number of blocks and, if blocks share tasks, of
    tasks; ``local`` makes what compares some queries with blocks. ``lists`` is how many lists of neighbours
    a query has, ``attr`` what queries have ranges of.
    """
    spark = base.sparkSession
    cores = spark.sparkContext.defaultParallelism
    dim = max(1, _dimension(base))
    number = base.count()
    n = _blocks(number, rows, cores)
    tasks = min(n, max(cores, -(-number * dim // BLOCK_VALUES)))
    routed, placed = place(queries, base, n, tasks if tasks < n else None)
    stored = stored_by_cell(placed, max(cores, min(MOST_BUCKETS, tasks)))
    state = 8 * dim + lists * (16 * k + 16)
    waves = math.ceil(queries.count() * state / (2 * max(rows * dim, BLOCK_VALUES) * _WAVE_BLOCKS)) or 1
    wave = F.pmod(F.xxhash64("qid", *[c for c in per if c in queries.columns and c != "qid"]), F.lit(waves))
    empty = to_arrow_schema(schema).empty_table()
    asked_at_once = max(1, int(_ASKED / max(1.0, lists)))

    def compare(few: pa.Table, many: pa.Table) -> pa.Table:
        if not few.num_rows or not many.num_rows:
            return empty
        if attr:
            many = many.sort_by(attr)
        many, matrix = _finite(many)
        block, found = None, []
        for at in range(0, few.num_rows, asked_at_once):
            asked = local(few.slice(at, asked_at_once))
            block = block or VectorBlock(matrix, asked.metric)
            top = asked.collector()
            if many.num_rows:
                asked.add_block(top, block, many)
            found += asked.pieces(top)
        return pa.Table.from_batches(found) if found else empty

    def found(number: int) -> DataFrame:
        asked = routed.where(wave == number).groupBy(_CELL)
        return asked.cogroup(stored.groupBy(_CELL)).applyInArrow(compare, schema)

    if waves <= _PLAN_WAVES:
        return reduce(DataFrame.unionByName, map(found, range(waves)))
    # A query is in one wave, so its list is whole at its end.
    path = scratch_path(spark, "waves")
    order = Window.partitionBy(*per).orderBy("__key", "id")
    for number in range(waves):
        best = found(number).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        best.drop("rank").write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def compared(
    queries: DataFrame, base: DataFrame, make: Callable[[pa.Table], object], schema: T.StructType, k: int, *,
    order: str, broadcast_limit: int = BROADCAST_LIMIT_BYTES, block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """Candidate lists of queries that every base row may match, by what ``make`` makes of some of them.

    Rows are scanned, or stand in their block, in the order of the column ``order``.
    """
    ship_package(base.sparkSession)
    queries, base = _present(queries, ()), _present(base, ())
    dim = max(1, _dimension(base))
    size = queries.count() * dim * 8
    slices = -(-size // broadcast_limit) if broadcast_limit else size
    if slices > _MOST_SLICES:
        return _blocked_form(
            queries, base, _in_all_blocks, make, schema, max(1, block_values // dim), k, ["qid"], attr=order)
    tasks = _SCANS_PER_CORE * base.sparkSession.sparkContext.defaultParallelism
    rows = materialize(base.repartitionByRange(tasks, order, "id").sortWithinPartitions(order, "id"), "scanned")
    stored = queries if slices <= 1 else materialize(queries, "queries")
    part = F.pmod(F.xxhash64("qid"), F.lit(max(1, slices)))
    return reduce(DataFrame.unionByName, [
        _scanned(make(stored.where(part == number).toArrow()), rows, schema) for number in range(max(1, slices))])


def nearest_partial(
    queries: DataFrame,
    base: DataFrame,
    k: int,
    metric: str = EUCLIDEAN,
    *,
    key: str | None = None,
    within: Range | None = None,
    tags: Sequence[str] = (),
    place: str | None = None,
    everywhere: bool = False,
    broadcast_limit: int = BROADCAST_LIMIT_BYTES,
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """Candidate lists ``(qid, tags, id, __key)`` holding at least the k nearest of every query
    row; rows with a null vector, key, attribute or range end never match, nor do vectors with a
    value that is not finite. The base's key column may be a list of distinct keys, under each of
    which the row stands.

    The key column of the queries may be such a list too, of queries with ids of their own; a vector is
    then sent once for all keys. ``place`` names a column for the place (from 1) of the key that
    led to a row, and asks for the k nearest per place. If both sides list their keys and no place is
    asked for, a row that shares several keys with a query counts once, and so do rows of one id and
    distance. ``everywhere`` says that all blocks hold all keys, so that queries need not be routed by them.
    """
    ship_package(base.sparkSession)
    listed = bool(key) and isinstance(queries.schema[key].dataType, T.ArrayType)
    shared = listed and not place and isinstance(base.schema[key].dataType, T.ArrayType)
    spec = _Spec(k, metric_for(metric), key, within, tuple(tags), place, shared)
    if place and not listed:
        raise ValueError("only queries that list their keys have places")
    asked, held = _filters(spec)
    queries = _present(queries.select(*_query_columns(spec)), asked)
    base = _present(base.select(*_base_columns(spec)), held)
    dim = max(1, _dimension(base))
    lists = 1.0
    if listed:
        # a place has k ids and distances of its own while a task scans
        counted = queries.agg(F.count("*").alias("n"), F.sum(F.size(key)).alias("keys")).first()
        size = counted["n"] * dim * 8 + (counted["keys"] or 0) * (16 * k + 16 if place else 16)
        lists = max(1.0, (counted["keys"] or 0) / max(1, counted["n"])) if place else 1.0
    else:
        size = queries.count() * dim * 8
    slices = -(-size // broadcast_limit) if broadcast_limit else size
    if slices <= 1:
        return _broadcast_form(queries.toArrow(), queries, base, spec)
    if slices <= _MOST_SLICES:
        stored = materialize(queries, "queries")
        part = F.pmod(F.xxhash64("qid", *spec.tags), F.lit(slices))
        found = None
        for number in range(slices):
            scan = _broadcast_form(stored.where(part == number).toArrow(), stored, base, spec)
            found = scan if found is None else found.unionByName(scan)
        return found
    rows = max(1, block_values // dim)

    def spread(queries: DataFrame, base: DataFrame, n: int, tasks: int | None) -> tuple[DataFrame, DataFrame]:
        if shared or everywhere:
            return _in_all_blocks(queries, base, n, tasks)
        if listed and key in queries.columns and isinstance(queries.schema[key].dataType, T.ArrayType):
            return _by_listed_keys(queries, base, key, lambda pairs, rows: spread(pairs, rows, n, tasks))
        if spec.key and isinstance(base.schema[spec.key].dataType, T.ArrayType):
            return _by_member(queries, base, spec.key, n, tasks)
        if spec.key:
            return _by_key(queries, base, spec.key, n, rows, tasks)
        if spec.within:
            return _by_range(queries, base, spec.within, n, rows, tasks)
        return _in_all_blocks(queries, base, n, tasks)

    return _blocked_form(
        queries, base, spread, lambda few: _Queries(few, spec), partial_schema(queries, spec), rows, k,
        ["qid", *spec.tags, *([place] if place else [])], lists, within.attr if within else None)


def _present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows without nulls in these columns, one filter each so that the scan can take them."""
    for column in ("emb", *columns):
        df = df.where(F.col(column).isNotNull())
    return df


def _filters(spec: _Spec) -> tuple[list[str], list[str]]:
    key = [spec.key] if spec.key else []
    if not spec.within:
        return key, key
    return [*key, spec.within.low, spec.within.high], [*key, spec.within.attr]


def rank_nearest(
    partial: DataFrame, k: int, metric: str, per: Sequence[str] = ("qid",)
) -> DataFrame:
    """Merge candidate lists: ``rank`` 1..k by distance (or similarity), then id."""
    order = Window.partitionBy(*per).orderBy("__key", "id")
    score = F.col("__key") if metric_for(metric) == EUCLIDEAN else -F.col("__key")
    return (
        partial.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("long"))
        .withColumn("score", score)
        .drop("__key")
    )


def nearest(
    queries: DataFrame,
    base: DataFrame,
    k: int = 10,
    metric: str = EUCLIDEAN,
    *,
    key: str | None = None,
    within: Range | None = None,
    **sizes: int,
) -> DataFrame:
    """The k nearest base rows of every query: ``(qid, id, rank, score)``.

    ``queries`` has ``qid`` and ``emb``, ``base`` has ``id`` and ``emb``. With ``key`` only rows
    with the query's value of that column count, with ``within`` only rows inside its range.
    Ties go to the lower id. ``score`` is the distance or the cosine similarity.
    """
    partial = nearest_partial(queries, base, k, metric, key=key, within=within, **sizes)
    return rank_nearest(partial, k, metric).select("qid", "id", "rank", "score")


def nearest_with_member(
    queries: DataFrame, base: DataFrame, k: int, member: str, of: str, metric: str = EUCLIDEAN,
    **sizes: int,
) -> DataFrame:
    """The k nearest rows whose list column ``of`` contains the query's ``member``."""
    listed = base.select("id", "emb", F.array_distinct(of).alias(member))
    return nearest(queries, listed, k, metric, key=member, **sizes)


def neighbour_lists(queries: DataFrame, ranked: DataFrame) -> DataFrame:
    """Ground truth ``(id, neighbors_id)``, nearest first; no match gives an empty list."""
    lists = ranked.groupBy("qid").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]
        ).alias("neighbors_id")
    )
    none = F.array().cast("array<bigint>")
    return (
        queries.select("qid")
        .join(lists, "qid", "left")
        .select(F.col("qid").alias("id"), F.coalesce("neighbors_id", none).alias("neighbors_id"))
    )


def nearest_by_filter_rate(
    queries: DataFrame, base: DataFrame, rates: Sequence[float], k: int,
    metric: str = EUCLIDEAN, **sizes: int,
) -> DataFrame:
    """The k nearest rows at every filter rate: ``(filter_rate, qid, id, rank, score)``.

    Rate r lets ``1 - r`` of the rows pass, those with the highest of the contiguous ids. All
    rates share one pass over the base: rows are cut into bands of ids where a rate begins, a pair is
    compared once, and a rate's list comes from the k nearest of each of its bands.
    """
    total = base.count()
    starts = [(float(r), math.floor(float(r) * total)) for r in rates]
    cuts = sorted({start for _, start in starts})
    passed = sum((F.col("id") >= cut).cast("int") for cut in cuts)
    rows = base.select("id", "emb", F.when((F.col("id") >= cuts[0]) & (F.col("id") <= total), passed).alias("__band"))
    asked = queries.select("qid", "emb", F.array(*[F.lit(at + 1) for at in range(len(cuts))]).alias("__band"))
    partial = nearest_partial(asked, rows, k, metric, key="__band", place="__place", everywhere=True, **sizes)
    options = F.array(*[
        F.struct(F.lit(rate).alias("rate"), F.lit(cuts.index(start) + 1).alias("first")) for rate, start in starts])
    met = F.filter(options, lambda x: x["first"] <= F.col("__place"))
    partial = partial.withColumn("filter_rate", F.explode(F.transform(met, lambda x: x["rate"]))).drop("__place")
    return rank_nearest(partial, k, metric, ("filter_rate", "qid")).select(
        "filter_rate", "qid", "id", "rank", "score"
    )


def all_ground_truths(
    queries: DataFrame, base: DataFrame, k: int, *, label: str, within: Range, member: str,
    members: str, metric: str = EUCLIDEAN, broadcast_limit: int = BROADCAST_LIMIT_BYTES,
    block_values: int = BLOCK_VALUES,
) -> DataFrame:
    """Unfiltered (``none``), equality (``em``), range (``r``) and set-membership (``emis``) ground truth:
    ``(filter_type, qid, id, rank, score)``.

    All four come from one scan of the base, whose vectors are read and prepared once for all; each
    task keeps the k best per filter and query. A row with a null in what a filter needs is left out
    of that filter only.
    """
    ship_package(base.sparkSession)
    kind = metric_for(metric)
    specs = {
        "none": _Spec(k, kind, None, None, ()), "em": _Spec(k, kind, label, None, ()),
        "r": _Spec(k, kind, None, within, ()), "emis": _Spec(k, kind, member, None, ()),
    }
    asked = _present(queries.select("qid", "emb", label, within.low, within.high, member), ())
    own = F.array_distinct(members).alias(member)
    rows = _present(base.select("id", "emb", label, within.attr, own), ())
    dim = max(1, _dimension(rows))
    plain = partial_schema(queries, specs["none"])
    schema = T.StructType([T.StructField(_FILTER, T.StringType()), *plain.fields])
    size = asked.count() * dim * 8
    slices = -(-size // broadcast_limit) if broadcast_limit else size
    if slices <= _MOST_SLICES:
        stored = asked if slices <= 1 else materialize(asked, "queries")
        part = F.pmod(F.xxhash64("qid"), F.lit(max(1, slices)))
        partial = reduce(DataFrame.unionByName, [
            _scanned(_ManyFilters(stored.where(part == number).toArrow(), specs), rows, schema)
            for number in range(max(1, slices))])
    else:
        partial = _blocked_form(
            asked, rows, _in_all_blocks, lambda few: _ManyFilters(few, specs), schema,
            max(1, block_values // dim), k, [_FILTER, "qid"], len(specs), within.attr)
    return rank_nearest(partial, k, metric, (_FILTER, "qid")).select(_FILTER, "qid", "id", "rank", "score")
