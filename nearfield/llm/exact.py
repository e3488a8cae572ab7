"""Exact duplicates by a tree of merges over sorted runs of digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import id_and_text, materialize

# Runs that are merged into one in a round.
FAN_IN = 8
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# What makes two rows equal: a short digest by which runs are ordered, then length and SHA-256, which
# verify it wherever two entries meet.
_SAME = ["digest", "n_bytes", "sha256"]


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z in lower case and everything else as it is."""
    plain = F.octet_length(text) == F.char_length(text)  # ASCII alone
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, place, run, digest, n_bytes, sha256)`` of every row, written as sorted runs.

    A run is what one task has read, ordered by digest; ``place`` is unique. Both are fixed by being
    written, and no text is read again.
    """
    lowered = id_and_text(docs, id_col, text_col).select(
        "doc_id", F.monotonically_increasing_id().alias("place"), lower_ascii(F.col("text")).alias("text"))
    rows = lowered.select(
        "doc_id", "place", F.shiftright("place", 33).alias("run"), F.xxhash64("text").alias("digest"),
        F.octet_length("text").alias("n_bytes"), F.unhex(F.sha2("text", 256)).alias("sha256"))
    return materialize(rows.sortWithinPartitions(*_SAME), "digest-runs")


def _merge(runs: DataFrame, run: Column) -> DataFrame:
    """Merge the entries of all runs that get the same number: equal digests whose length and SHA-256
    agree become one, with the best row so far and the rows counted; others stay apart."""
    return runs.groupBy(run.alias("run"), *_SAME).agg(
        F.max("best").alias("best"), F.sum("size").alias("size"))


def _tree(rows: DataFrame, largest: bool, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """The entries of the first level, and one entry ``(digest, n_bytes, sha256, best, size)`` per text.

    In each round ``fan_in`` neighbouring runs become one. A run is never in one task: its entries
    are dealt out by run and digest, so every task gets a slice of several runs, merges it in order
    and writes it back in order. After about ``log(runs) / log(fan_in)`` rounds one run is left, still
    in slices. A text in all documents is one entry a run at first and one in the end.
    """
    rank = F.col("doc_id") if largest else F.bitwise_not("doc_id")  # ~x falls as x grows
    best = F.struct(rank.alias("rank"), F.bitwise_not("place").alias("first"))
    entries = rows.select("run", *_SAME, best.alias("best"), F.lit(1).cast("long").alias("size"))
    last = rows.agg(F.max("run").alias("n")).first()["n"]
    runs = 0 if last is None else last + 1
    first = level = materialize(_merge(entries, F.col("run")).sortWithinPartitions("run", *_SAME), "runs")
    while runs > 1:
        merged = _merge(level, F.floor(F.col("run") / fan_in))
        level = materialize(merged.sortWithinPartitions("run", *_SAME), "runs")
        runs = -(-runs // fan_in)
    return first, level.drop("run")


def classes(docs: DataFrame, largest: bool = True, fan_in: int = FAN_IN, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` of every row.

    Texts are equal when they are identical after A-Z are lower-cased; a null text is empty. Of equal
    texts the row with the largest id (or the smallest) stays; a null id ranks below all others, and
    of rows that repeat the id that stays, exactly one is kept. An empty table has no rows; other
    columns are not read. Texts of any length are hashed whole.

    Going down again, the entries of the first level learn what became of them, one row for each run
    and text, and tell the rows of their run: no join meets more rows of a text than a run holds.
    """
    if fan_in < 2:
        raise ValueError("a round must merge at least two runs")
    rows = _digests(docs, id_col, text_col)
    first, groups = _tree(rows, largest, fan_in)
    rank = F.col("best.rank")
    told = first.select("run", *_SAME).join(groups, _SAME).select(
        "run", *_SAME, (rank if largest else F.bitwise_not(rank)).alias("keep_id"),
        F.bitwise_not(F.col("best.first")).alias("keep_place"), F.col("size").alias("group_size"))
    return rows.join(told, ["run", *_SAME]).select(
        "doc_id", "keep_id", "group_size", (F.col("place") == F.col("keep_place")).alias("kept"),
        F.lower(F.hex("sha256")).alias("text_sha256"))


def op13_exact_classes(docs: DataFrame) -> DataFrame:
    return classes(docs)


SQL = f"""
WITH d AS (SELECT doc_id::BIGINT AS doc_id,
                  translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(t) AS text_sha256
FROM d"""
