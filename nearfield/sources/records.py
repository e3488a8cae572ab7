"""Binary records of fixed width, read by byte ranges of their files."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.kernels import as_list_column
from nearfield.session import materialize, ship_package

# Bytes of a file that one task reads, of one read, and of a gap that is read over instead of sought past.
_RANGE = 128 << 20
_PIECE = 4 << 20
_GAP = 64 << 10
# Records that one task seeks at most.
_SEEKS = 4096
_SCHEMA = "record long, emb array<float>"


@dataclass(frozen=True)
class RecordFiles:
    """Files of whole records in name order: one entry per file, as Spark lists them."""

    paths: list[str]
    first: np.ndarray  # number of each file's first record
    records: np.ndarray
    dims: int

    @property
    def width(self) -> int:
        return 4 * (self.dims + 1)

    @property
    def total(self) -> int:
        return int(self.records.sum())


def list_records(spark: SparkSession, path: str, dims: int, expected: int | None = None) -> RecordFiles:
    """The files of a path and their record numbers, from file lengths alone."""
    width = 4 * (dims + 1)
    listed = spark.read.format("binaryFile").load(path).select("path", "length").orderBy("path").toArrow()
    lengths = listed["length"].to_numpy()
    if (lengths % width).any():
        raise ValueError(f"{path}: file size is not a multiple of {width} bytes")
    records = lengths // width
    if expected is not None and records.sum() != expected:
        raise ValueError(f"{path}: {records.sum()} vectors instead of {expected}")
    return RecordFiles(listed["path"].to_pylist(), np.cumsum(records) - records, records, dims)


def _open(path: str) -> BinaryIO:
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(re.sub(r"^file:/+", "/", path))
    store, inside = fs.FileSystem.from_uri(quote(re.sub("^s3[an]:", "s3:", path), safe="/:@"))
    return store.open_input_file(inside)


def _vectors(raw: bytes, dims: int) -> np.ndarray:
    rows = np.frombuffer(raw, "<f4").reshape(-1, dims + 1)
    if not (np.ascontiguousarray(rows[:, 0]).view("<i4") == dims).all():
        raise ValueError(f"a record does not have {dims} dimensions")
    return rows[:, 1:]


def _batch(numbers: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    emb = as_list_column(np.ascontiguousarray(vectors, "f4"), pa.float32())
    return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), emb], names=["record", "emb"])


def read_all(spark: SparkSession, files: RecordFiles) -> DataFrame:
    """Every record: ``(record, emb)``. A task reads one range of a file, a few megabytes at a time."""
    ship_package(spark)
    dims, width = files.dims, files.width
    step, piece = max(1, _RANGE // width), max(1, _PIECE // width)
    rows = [(p, int(a), int(n)) for p, a, n in zip(files.paths, files.first, files.records) if n]
    table = spark.createDataFrame(rows, "path string, first long, records long")
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(step).cast("long")))
    ranges = table.withColumn("begin", begin)
    tasks = int((-(-files.records // step)).sum())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, first, records, begin in zip(*(c.to_pylist() for c in batch.columns)):
                with _open(path) as stream:
                    for at in range(begin, min(begin + step, records), piece):
                        n = min(piece, begin + step - at, records - at)
                        found = _vectors(stream.read_at(n * width, at * width), dims)
                        yield _batch(first + at + np.arange(n), found)

    return ranges.repartition(max(1, tasks)).mapInArrow(read, _SCHEMA)


def runs(
    numbers: np.ndarray, files: RecordFiles, gap: int, piece: int
) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """What to read for ascending record numbers: ``(file, first, last, wanted)``, all records counted
    from the start of the file. Neighbours less than ``gap`` bytes apart are read together, up to a
    piece."""
    own = np.searchsorted(files.first, numbers, side="right") - 1
    inside = numbers - files.first[own]
    gap, piece = max(1, gap // files.width), max(1, piece // files.width)
    cell = inside // piece
    new = (own[1:] != own[:-1]) | (cell[1:] != cell[:-1]) | (inside[1:] - inside[:-1] > gap)
    edges = np.concatenate(([0], np.flatnonzero(new) + 1, [len(numbers)]))
    for a, b in zip(edges.tolist(), edges[1:].tolist()):
        if a < b:
            yield int(own[a]), int(inside[a]), int(inside[b - 1]), inside[a:b]


def read_some(spark: SparkSession, files: RecordFiles, wanted: DataFrame) -> DataFrame:
    """The records whose numbers are in ``wanted.record``: ``(record, emb)``.

    The numbers, not the records, are sorted into ranges; a task seeks its own ones, at most a few
    thousand, and reads nothing else but gaps too small to be worth a seek. Null numbers and those
    beyond the files find nothing; a repeated number is read once.
    """
    ship_package(spark)
    inside = wanted.select(F.col("record").cast("long")).where(F.col("record").between(0, files.total - 1))
    asked = materialize(inside.distinct(), "wanted")
    total = asked.count()
    tasks = max(1, -(-total // _SEEKS), -(-total * files.width // _RANGE))
    gap, piece = _GAP, _PIECE
    sent = spark.sparkContext.broadcast(files)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        number, stream = None, None
        for batch in batches:
            for file, first, last, records in runs(batch.column(0).to_numpy(), own, gap, piece):
                if file != number:
                    if stream is not None:
                        stream.close()
                    number, stream = file, _open(own.paths[file])
                yield _batch(own.first[file] + records, _picked(stream, first, last, records, own))
        if stream is not None:
            stream.close()

    sorted_numbers = asked.repartitionByRange(tasks, "record").sortWithinPartitions("record")
    return sorted_numbers.mapInArrow(read, _SCHEMA)


def _picked(stream: BinaryIO, first: int, last: int, records: np.ndarray, files: RecordFiles) -> np.ndarray:
    """Some of the records of a run; what lies between them is not looked at."""
    raw = stream.read_at((last - first + 1) * files.width, first * files.width)
    rows = np.frombuffer(raw, np.uint8).reshape(-1, files.width)
    return _vectors(rows[records - first].tobytes(), files.dims)
