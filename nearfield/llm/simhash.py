"""Near-duplicate documents by SimHash and an inverted index of byte positions."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.llm.common import by_batch, id_and_text, materialize
from nearfield.llm.components import components

# Words of a shingle, seed of its hash, differing bits of a link.
SHINGLE = 3
SEED = 42
MAX_BITS = 2

# Two fingerprints that differ in at most two bits agree in at least six of their eight bytes. Of
# four pairs of byte positions they then agree in at least two, so they meet in a posting of one of
# the six choices of two pairs.
MIN_BYTES = 8 - MAX_BITS
_PAIRS = [0xFFFF << (16 * i) for i in range(4)]
_MASKS = [a | b for a, b in combinations(_PAIRS, 2)]
# Postings up to this size are joined with themselves; larger ones are linked through hubs.
SMALL_POSTING = 64
_PART = 1 << 16

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_PLACES = (np.arange(8, dtype=np.int64) * 256)[None, :]


def fingerprint(text: bytes) -> int:
    """The SimHash of one text, as an unsigned number."""
    words = text.lower().split()  # of bytes: lowers A-Z only, splits at ASCII white space
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.flatnonzero(np.frombuffer(line, dtype=np.uint8) == 32)
    starts = np.concatenate(([0], ends + 1))
    ends = np.concatenate((ends, [len(line)]))
    n = max(len(words) - SHINGLE + 1, 1)
    starts, ends = starts[:n], ends[-n:]
    digest, tally = xxhash.xxh64_intdigest, np.zeros(2048, dtype=np.int64)
    for at in range(0, n, _PART):
        pairs = zip(starts[at : at + _PART].tolist(), ends[at : at + _PART].tolist())
        part = np.array([digest(line[i:j], SEED) for i, j in pairs], dtype=np.uint64)
        tally += np.bincount((part.view(np.uint8).reshape(-1, 8) + _PLACES).ravel(), minlength=2048)
    ones = (tally.reshape(8, 256) @ _BITS).ravel() * 2 > n
    return int.from_bytes(np.packbits(ones, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` of every row; ``fp`` holds the 64 bits as a signed long."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [fingerprint(value.as_py()) for value in batch.column(1).cast(pa.large_binary())]
        bits = np.array(found, dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits)], names=["doc_id", "fp"])

    return by_batch(id_and_text(docs, id_col, text_col), each, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _shared_bytes(a: Column, b: Column) -> Column:
    """Tally of the byte positions at which two fingerprints agree."""
    differ = a.bitwiseXOR(b)
    return sum(
        (differ.bitwiseAND(F.lit(_signed(0xFF << (8 * i)))) == 0).cast("int") for i in range(8))


def links(distinct: DataFrame) -> DataFrame:
    """Links ``(a, b)`` whose components are those of all pairs within ``MAX_BITS``.

    ``distinct`` has one row per fingerprint ``fp``. Every fingerprint stands in six postings, one
    per choice of four byte positions. Within a small posting all pairs are tallied by the byte
    positions they share, kept at ``MIN_BYTES`` or more, and verified by their differing bits. A
    large posting is not paired: two fingerprints at most two bits apart have a common point at
    most one bit from both, so its members meet at the points around them (33 each, as only 32 of
    the bits are free) and are linked to the least fingerprint at each point. Both are exact.
    """
    fp = F.col("fp")
    slots = F.array(*[
        F.struct(F.lit(i).cast("tinyint").alias("choice"), fp.bitwiseAND(F.lit(_signed(m))).alias("value"))
        for i, m in enumerate(_MASKS)])
    post = distinct.select("fp", F.explode(slots).alias("p")).select("fp", "p.*")
    size = F.count(F.lit(1)).over(Window.partitionBy("choice", "value"))
    post = materialize(post.withColumn("members", size).filter("members > 1"), "postings")

    small = post.filter(F.col("members") <= SMALL_POSTING)
    left = small.select("choice", "value", F.col("fp").alias("a"))
    right = small.select("choice", "value", F.col("fp").alias("b"))
    a, b = F.col("a"), F.col("b")
    near = left.join(right, ["choice", "value"]).filter(a < b)
    near = near.filter(_shared_bytes(a, b) >= MIN_BYTES).filter(F.bit_count(a.bitwiseXOR(b)) <= MAX_BITS)

    free = F.element_at(F.array(*[
        F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << i)) for i in range(64) if not m >> i & 1])
        for m in _MASKS]), F.col("choice") + 1)
    hubs = post.filter(F.col("members") > SMALL_POSTING).select("choice", "fp", F.explode(free).alias("flip"))
    hubs = hubs.select("choice", "fp", fp.bitwiseXOR(F.col("flip")).alias("hub"))
    least = F.min("fp").over(Window.partitionBy("choice", "hub"))
    far = hubs.select(F.col("fp").alias("a"), least.alias("b")).filter(a != b)
    return near.select("a", "b").union(far).distinct()


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp, component_id)`` for every row of ``docs``.

    Documents are linked if their fingerprints differ in at most ``MAX_BITS`` bits;
    ``component_id`` is the least id that can be reached. A null text is empty, and texts without
    words have fingerprint zero. Rows without an id keep a fingerprint, form no links and have no
    component. Rows that repeat an id are separate rows. Other columns are not read. Equal
    fingerprints, whose number may be a large part of all rows, are one node of the graph; only
    the last join, on narrow rows, meets them again, and Spark splits its skewed partitions.
    """
    prints = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = prints.filter("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = materialize(nodes, "nodes")
    of = components(links(nodes.select("fp")))
    placed = nodes.join(of, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("component", "fp").alias("component"))
    least = placed.groupBy("component").agg(F.min("first").alias("component_id"))
    named = placed.join(least, "component").select(F.col("fp").alias("of"), "component_id")
    return prints.join(named, F.col("fp") == F.col("of"), "left").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: of every component the document with the least id.

    Rows without an id all stay. Of rows that repeat the id of a document that stays, one stays.
    """
    marks = classes(docs, id_col, text_col).filter("doc_id = component_id")
    ids = materialize(marks.groupBy(F.col("doc_id").alias("__kept")).agg(F.count(F.lit(1)).alias("__rows")), "kept")
    own = [F.col(f"`{c}`") for c in docs.columns]
    # as many ids as documents stay: never a side to broadcast, whatever the size
    met = docs.join(ids.hint("merge"), docs[id_col].cast("long") == F.col("__kept"), "left")
    if ids.filter("__rows > 1").isEmpty():
        return met.filter(F.col("__kept").isNotNull() | F.col(id_col).isNull()).select(*own)
    once = met.filter((F.col("__rows") == 1) | F.col(id_col).isNull()).select(*own)
    return once.unionByName(met.filter("__rows > 1").select(*own).dropDuplicates([id_col]))


def op6_simhash_classes(docs: DataFrame) -> DataFrame:
    return classes(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
