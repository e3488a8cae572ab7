"""Writing vector tables, mappings and reports."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.operators.layout import shard_name
from nearfield.operators.sampling import ROW_GROUP


def write_vectors(df: DataFrame, path: str, rows_per_group: int = ROW_GROUP) -> None:
    """Parquet whose row groups hold exactly this many rows (the last of a file may be smaller)."""
    df.write.option("parquet.block.row.count.limit", rows_per_group).option(
        "parquet.block.size", 1 << 34
    ).parquet(path)


def write_files(
    indexed: DataFrame, path: str, files: int, *, prefix: str = "train", idx: str = "idx",
    rows_per_group: int = ROW_GROUP,
) -> DataFrame:
    """Write one shard per ``file_idx`` in ``idx`` order; returns the name of each.

    A shard is a folder with its name (``train-00-of-10.parquet``) that holds one file, and is what
    ``read_shards`` reads. A file, whose size the layout bounds, is one task.
    """
    spark = indexed.sparkSession
    placed = indexed.repartitionById(max(1, files), F.col("file_idx")).sortWithinPartitions("file_idx", idx)
    placed.write.option("parquet.block.row.count.limit", rows_per_group).option(
        "parquet.block.size", 1 << 34
    ).partitionBy("file_idx").parquet(path)
    numbers = spark.range(files).select(F.col("id").cast("int").alias("file_idx"))
    names = numbers.select("file_idx", shard_name(prefix, F.col("file_idx"), files).alias("name"))
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for row in names.collect():
        written = jvm.org.apache.hadoop.fs.Path(at, f"file_idx={row['file_idx']}")
        if store.exists(written):  # a shard without rows has no folder
            store.rename(written, jvm.org.apache.hadoop.fs.Path(at, row["name"]))
    return names


def _write_document(body: DataFrame, head: str, tail: str, path: str) -> None:
    """Text files that make up one JSON document when concatenated in name order.

    Each body line starts with the comma that separates it from the line before, except the first,
    which is found by its row number 0.
    """
    spark = body.sparkSession
    first = spark.createDataFrame([(0, -1, head)], "part int, at long, value string")
    last = spark.createDataFrame([(2, -1, tail)], "part int, at long, value string")
    lines = body.select(
        F.lit(1).alias("part"), F.col("at").cast("long").alias("at"),
        F.concat(F.when(F.col("at") == 0, "").otherwise(","), F.col("value")).alias("value"),
    )
    first.unionByName(lines).unionByName(last).sort("part", "at").select("value").write.text(path)


def write_id_mapping(mapping: DataFrame, path: str) -> None:
    """``{"old_to_new": {old: new, ...}}`` in new-id order (new ids are 0..N-1)."""
    body = mapping.select(
        F.col("new_id").alias("at"),
        F.format_string('"%d": %d', F.col("old_id"), F.col("new_id")).alias("value"),
    )
    _write_document(body, '{"old_to_new": {', "}}", path)


def write_neighbour_map(lists: DataFrame, path: str) -> None:
    """``{"0": [ids], ...}`` in id order, for ids 0..N-1."""
    body = lists.select(
        F.col("id").alias("at"),
        F.concat(F.lit('"'), F.col("id").cast("string"), F.lit('": '), F.to_json("neighbors_id")).alias("value"),
    )
    _write_document(body, "{", "}", path)


def selectivity_lines(report: DataFrame) -> DataFrame:
    """The report's entries as JSON text, one row per query."""
    entry = F.to_json(F.struct("range_start", "range_end", "count", "selectivity"))
    return report.select(F.col("qid").alias("at"), entry.alias("value"))


def write_selectivity_report(report: DataFrame, total_rows: int, path: str) -> None:
    """One JSON document with the totals and an entry per query in qid order (0..Q-1)."""
    n = report.count()
    head = f'{{"total_rows": {total_rows}, "num_queries": {n}, "queries": ['
    _write_document(selectivity_lines(report), head, "]}", path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).csv(path)
