"""Compressed vectors: product codes whose codebooks are trained on members that stay where they are.

Every part of every vector is a row of its owner, which is (position, entry, salt). The rows of an
owner lie in one bucket of a written table, and all later steps work on the buckets: owners add up
their members for the new codebook, and each member is given the nearest entry. Members that stay
are written again from the bucket they are in, without a shuffle; only those that change their entry
go through one, to the bucket of their new owner.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.llm.common import by_batch, materialize
from nearfield.session import scratch_path, ship_package

ENTRIES = 256
POSITIONS = 4
ROUNDS = 4
SCALE = 1024
# Numbers that an owner holds before it gets another salt, and that a bucket is laid out for.
OWNER_VALUES = 1_000_000
BUCKET_VALUES = 4_000_000
_MOST_BUCKETS = 50_000
# Numbers whose distances to all entries are computed at once.
_TILE_VALUES = 64_000
# Whole numbers up to this are exact in a double.
_EXACT = 2**53
# Labels up to which their errors are broadcast.
_BROADCAST_LABELS = 500_000
_OWNER = ["position", "entry", "salt"]
_RESULT = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"


def usable(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int = SCALE) -> DataFrame:
    """``(place, vec_id, label, x)`` of the rows whose vector is neither null nor holds null or
    non-finite components, as whole numbers ``floor(scale * component)``; ``place`` is unique."""
    v = F.col("v")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(
        vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].alias("label"),
        vectors[vector_col].cast("array<double>").alias("v"))
    # What does not fit is cut to where the check of sizes refuses it.
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(9e18)), F.lit(-9e18))))
    return rows.where(v.isNotNull()).where(~odd).select(
        F.monotonically_increasing_id().alias("place"), "vec_id", "label", whole.alias("x"))


def distances(x: np.ndarray, codebook: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows and entries, both 64-bit whole numbers."""
    most = max(int(np.abs(x).max(initial=0)), int(np.abs(codebook).max(initial=0)))
    if x.shape[1] * most**2 < _EXACT:
        products = (x.astype(np.float64) @ codebook.T.astype(np.float64)).astype(np.int64)
    else:
        products = x @ codebook.T
    return (x * x).sum(axis=1)[:, None] - 2 * products + (codebook * codebook).sum(axis=1)[None, :]


def _assigned(position: np.ndarray, x: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of each row, the first among equals, and its squared distance."""
    entry, error = np.zeros(len(x), np.int32), np.zeros(len(x), np.int64)
    rows = max(1, _TILE_VALUES // max(1, x.shape[1]))
    for p in range(len(books)):
        mine = np.flatnonzero(position == p)
        for i in range(0, len(mine), rows):
            at = mine[i : i + rows]
            d = distances(x[at].astype(np.int64), books[p])
            entry[at] = d.argmin(axis=1)
            error[at] = d[np.arange(len(at)), entry[at]]
    return entry, error


@dataclass(frozen=True)
class Shape:
    """What is known of the vectors: rows, parts, numbers a part, and how a number is stored."""

    rows: int
    positions: int
    width: int
    kind: str

    def matrix(self, column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype=self.kind).reshape(-1, self.width)


def _shape(rows: DataFrame, positions: int) -> Shape:
    size = F.greatest(F.abs(F.array_max("x")), F.abs(F.array_min("x")))
    n, low, high, most = rows.agg(
        F.count("*"), F.min(F.size("x")), F.max(F.size("x")), F.max(size)).first()
    if not n:
        return Shape(0, positions, 0, "<i2")
    if low != high or not low or low % positions:
        raise ValueError(f"vectors need one length that {positions} divides, not {low} to {high}")
    if 4 * low * most**2 >= 2**63:
        raise ValueError("components are too large for squared distances in 64 bits")
    return Shape(n, positions, low // positions, "<i2" if most < 2**15 else "<i4")


def _parts(rows: DataFrame, books: np.ndarray, shape: Shape) -> DataFrame:
    """All parts of all vectors with the nearest entry of the first codebooks."""
    label = rows.schema["label"].dataType.simpleString()
    shared = rows.sparkSession.sparkContext.broadcast(books)
    count, width, step = shape.positions, shape.width, max(1, 16 * _TILE_VALUES // shape.width)

    def each(whole: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(whole), step):
            batch = whole.slice(at, step)
            n = len(batch)
            x = batch.column(3).flatten().to_numpy().reshape(n * count, width)
            position = np.tile(np.arange(count, dtype=np.int32), n)
            entry, _ = _assigned(position, x, shared.value)
            of = pa.array(np.repeat(np.arange(n), count))
            parts = pa.array([r.tobytes() for r in x.astype(shape.kind)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(position), pa.array(entry), *(batch.column(c).take(of) for c in range(3)), parts],
                names=["position", "entry", "place", "vec_id", "label", "part"])

    return by_batch(rows, each, f"position int, entry int, place long, vec_id long, label {label}, part binary")


class Members:
    """The written table of members: one partition a generation, bucketed by owner.

    Generation g holds the members as round g finds them; generation -g those that leave their owner
    for round g, still in its bucket.
    """

    def __init__(self, spark: SparkSession, shape: Shape):
        values = shape.rows * shape.positions * shape.width
        self.spark, self.shape = spark, shape
        self.buckets = min(_MOST_BUCKETS, max(spark.sparkContext.defaultParallelism, -(-values // BUCKET_VALUES)))
        self.path, self.name = scratch_path(spark, "members"), f"members_{uuid.uuid4().hex}"

    def _write(self, rows: DataFrame) -> None:
        columns = [*_OWNER, "to_entry", "place", "vec_id", "label", "part", "generation"]
        writer = rows.select(*columns).write.mode("append").format("parquet").option("path", self.path)
        writer.partitionBy("generation").bucketBy(self.buckets, *_OWNER).saveAsTable(self.name)

    def of(self, *generations: int) -> DataFrame:
        return self.spark.table(self.name).where(F.col("generation").isin(*generations))

    def settle(self, rows: DataFrame, counts: DataFrame, generation: int) -> None:
        """Deal rows to the buckets of their owners. ``counts`` says how many members each (position,
        entry) will have, and so how many salts; it is no larger than the codebooks."""
        salts = F.ceil(F.col("n") * self.shape.width / OWNER_VALUES).cast("int")
        met = rows.join(F.broadcast(counts.select("position", "entry", salts.alias("salts"))), ["position", "entry"])
        placed = met.withColumns({
            "salt": F.pmod(F.xxhash64("place"), "salts").cast("int"), "to_entry": F.col("entry"),
            "generation": F.lit(generation)})
        self._write(placed.repartition(self.buckets, *_OWNER))

    def totals(self, generation: int) -> DataFrame:
        """``(position, entry, n, sums)``: every owner adds up its resident members."""
        ship_package(self.spark)
        shape = self.shape

        def add(key: tuple, found: pa.Table) -> pa.Table:
            sums = np.zeros(shape.width, np.int64)
            for batch in found.to_batches():
                sums += shape.matrix(batch.column("part")).sum(axis=0, dtype=np.int64)
            return pa.table({
                "position": pa.array([key[0].as_py()], pa.int32()), "entry": pa.array([key[1].as_py()], pa.int32()),
                "n": pa.array([found.num_rows], pa.int64()), "sums": pa.array([sums.tolist()], pa.list_(pa.int64()))})

        return self.of(generation).select(*_OWNER, "part").groupBy(*_OWNER).applyInArrow(
            add, "position int, entry int, n long, sums array<long>")

    def assigned(self, generation: int, books: np.ndarray) -> DataFrame:
        """Members with their nearest entry as ``to_entry`` and its squared distance as ``error``."""
        shared = self.spark.sparkContext.broadcast(books)
        rows = self.of(generation).drop("generation", "to_entry")
        position, part = rows.columns.index("position"), rows.columns.index("part")
        shape, names = self.shape, [*rows.columns, "to_entry", "error"]

        def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            entry, error = _assigned(
                batch.column(position).to_numpy(), shape.matrix(batch.column(part)), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(entry), pa.array(error)], names=names)

        schema = T.StructType([*rows.schema.fields]).add("to_entry", T.IntegerType()).add("error", T.LongType())
        return by_batch(rows, each, schema)

    def advance(self, generation: int, books: np.ndarray) -> None:
        """Write the next generation: who stays, from the bucket it is in; who goes, by a shuffle."""
        after = generation + 1
        stays = F.col("to_entry") == F.col("entry")
        self._write(self.assigned(generation, books).withColumn(
            "generation", F.when(stays, after).otherwise(-after)))
        counts = self.of(after, -after).groupBy("position", F.col("to_entry").alias("entry")).agg(F.count("*").alias("n"))
        self.settle(self.of(-after).drop("salt").withColumn("entry", F.col("to_entry")), counts, after)

    def close(self) -> None:
        """Forget the name; the files belong to the shared folder."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def _updated(books: np.ndarray, totals: DataFrame) -> np.ndarray:
    """Entries replaced by the floor of their members' mean; those without members stay.

    The totals of all salts are added up before they reach the driver, which gets no more numbers
    than the codebooks have.
    """
    each = totals.select("position", "entry", "n", F.posexplode("sums").alias("i", "s"))
    found = each.groupBy("position", "entry", "i").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).toArrow()
    p, e, i, s, n = (found[c].to_numpy() for c in ("position", "entry", "i", "s", "n"))
    out = books.copy()
    out[p, e, i] = np.floor_divide(s, n)
    return out


def train(rows: DataFrame, shape: Shape, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame]:
    """The codebooks (position, entry, component) after ``rounds`` rounds, and the written parts with
    their nearest entry ``to_entry`` and ``error``.

    ``rows`` are written rows of :func:`usable`. The first codebooks are the parts of the rows with
    the smallest ids, null ids last, rows of one id by vector. The driver holds codebooks only.
    """
    spark = rows.sparkSession
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x", "place").limit(entries).select("x").collect()
    start = np.array([r["x"] for r in first], dtype=np.int64).reshape(-1, shape.positions, shape.width)
    books = np.ascontiguousarray(start.transpose(1, 0, 2))
    parts = materialize(_parts(rows, books, shape), "parts")
    members = Members(spark, shape)
    try:
        members.settle(parts, parts.groupBy("position", "entry").agg(F.count("*").alias("n")), 0)
        for generation in range(rounds):
            books = _updated(books, members.totals(generation))
            if generation < rounds - 1:
                members.advance(generation, books)
        told = members.assigned(rounds - 1, books) if rounds else members.assigned(0, books)
        return books, materialize(told.select("place", "vec_id", "label", "position", "to_entry", "error"), "assigned")
    finally:
        members.close()


def codebooks_sha256(books: np.ndarray) -> str:
    """Of all entries' components as decimals, by part, entry and position in the part, comma-joined."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, positions: int = POSITIONS, entries: int = ENTRIES, rounds: int = ROUNDS,
             id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(vec_id, code, error, label_error, codebooks_sha256)`` of every usable row.

    Vectors that are null or hold null or non-finite components are left out; those left must have
    one length that ``positions`` divides, and components whose squared distances fit 64 bits, or an
    error says so. Rows that repeat an id, or have none, are rows of their own. ``code`` is two hex
    digits a part. Labels that are null are one label. An empty table has no rows; other columns
    are not read.
    """
    if not 1 <= entries <= 256:
        raise ValueError("an entry has two hex digits")
    spark = vectors.sparkSession
    rows = materialize(usable(vectors, id_col, vector_col, label_col), "vectors")
    shape = _shape(rows, positions)
    if not shape.rows:
        return spark.createDataFrame([], _RESULT)
    books, parts = train(rows, shape, entries, rounds)
    digits = F.lower(F.lpad(F.hex("to_entry"), 2, "0"))
    code = F.concat(*[F.max(F.when(F.col("position") == p, digits)) for p in range(positions)])
    whole = materialize(parts.groupBy("place").agg(
        F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), code.alias("code"),
        F.sum("error").alias("error")), "codes")
    by_label = materialize(
        whole.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "label-errors")
    if by_label.count() <= _BROADCAST_LABELS:
        by_label = F.broadcast(by_label)
    return whole.join(by_label, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))


def op11_resident_lloyd(embeddings: DataFrame) -> DataFrame:
    return compress(embeddings)


def sql(table: str = "embeddings") -> str:
    """The same rounds over all pairs of parts and entries."""
    steps = [f"""
e AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: floor(x::DOUBLE * {SCALE})) AS x,
         row_number() OVER (ORDER BY vec_id, embedding) AS place, len(embedding) // {POSITIONS} AS w
  FROM {table} WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (
  SELECT place, pos, list_slice(x, pos * w + 1, pos * w + w)::DOUBLE[] AS v FROM e, range({POSITIONS}) t(pos)),
b0 AS MATERIALIZED (SELECT pos, place - 1 AS entry, v AS c FROM p WHERE place <= {ENTRIES})"""]
    for t in range(ROUNDS + 1):
        # The distance and the entry in one number, the entry in its last digits.
        steps.append(f"""
a{t} AS MATERIALIZED (
  SELECT p.place, p.pos, min(((list_inner_product(v, v) - 2 * list_inner_product(v, c)
         + list_inner_product(c, c))::BIGINT) * {ENTRIES} + entry) AS found
  FROM p JOIN b{t} b ON p.pos = b.pos GROUP BY p.place, p.pos)""")
        if t < ROUNDS:
            steps.append(f"""
m{t} AS (
  SELECT pos, entry, list(s ORDER BY i) AS c FROM (
    SELECT pos, found % {ENTRIES} AS entry, i, floor(sum(v[i]) / count(*)) AS s
    FROM a{t} JOIN p USING (place, pos), range(1, len(v) + 1) r(i) GROUP BY pos, entry, i)
  GROUP BY pos, entry),
b{t + 1} AS MATERIALIZED (
  SELECT b.pos, b.entry, coalesce(m.c, b.c) AS c FROM b{t} b LEFT JOIN m{t} m ON b.pos = m.pos AND b.entry = m.entry)""")
    last = ROUNDS
    return f"""
WITH {",".join(steps)},
r AS (SELECT e.vec_id, e.label, string_agg(lower(printf('%02x', found % {ENTRIES})), '' ORDER BY pos) AS code,
             sum(found // {ENTRIES})::BIGINT AS error
      FROM a{last} JOIN e USING (place) GROUP BY e.place, e.vec_id, e.label)
SELECT vec_id::BIGINT AS vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
       (SELECT sha256(string_agg(array_to_string(list_transform(c, lambda x: x::BIGINT), ','), ',' ORDER BY pos, entry))
        FROM b{last}) AS codebooks_sha256
FROM r"""
