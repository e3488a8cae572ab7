"""Reading vector tables, shards, ordered text, binary records and benchmark results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nearfield.functions.vectors import normalised_vector
from nearfield.session import materialize
from nearfield.sources.records import list_records, read_all, read_some


def read_vectors(
    spark: SparkSession, path: str, id_col: str = "id", emb_col: str = "emb",
    keep: Sequence[str] = (),
) -> DataFrame:
    """``(id bigint, emb array<float>)`` out of a wider parquet table."""
    return spark.read.parquet(path).select(
        F.col(id_col).cast("long").alias("id"), normalised_vector(F.col(emb_col)).alias("emb"), *keep
    )


_SHARD = r"/(?:shuffle_)?train-(\d+)-of-\d+\.parquet"


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Numbered shards, each a file or a folder of files, with ``shard_no`` and ``position``.

    ``position`` numbers the rows over all shards in order: a row's place in its file plus the
    rows of the files before it (one count per file). Shuffled shards are preferred when a folder
    has both kinds.
    """
    for pattern in ("shuffle_train-*-of-*.parquet", "train-*-of-*.parquet"):
        try:
            found = spark.read.parquet(f"{folder}/{pattern}")
            break
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
    else:
        raise FileNotFoundError(f"no train shards in {folder}")
    path = F.col("_metadata.file_path")
    rows = found.select(
        "*",
        F.regexp_extract(path, _SHARD, 1).cast("int").alias("shard_no"),
        path.alias("__file"),
        F.col("_metadata.row_index").alias("__row"),
    )
    per_file = rows.groupBy("shard_no", "__file").agg((F.max("__row") + 1).alias("n"))
    offsets, at = [], 0
    for file in per_file.orderBy("shard_no", "__file").collect():
        offsets.append((file["__file"], at))
        at += file["n"]
    table = spark.createDataFrame(offsets, "__file string, __offset long")
    return rows.join(F.broadcast(table), "__file").select(
        *found.columns, "shard_no", (F.col("__offset") + F.col("__row")).alias("position")
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """``(line, value)``: text lines with their 0-based number over all files in name order.

    A task reads consecutive lines of each file split, so a line's number is its place in the
    split plus the lines of all splits before it; one count per split is gathered to add those up.
    Splits depend on the executors at hand, so the lines are written once with their places, and
    both the counts and the lines are read from there.
    """
    read = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_path").alias("__file"),
        F.col("_metadata.file_block_start").alias("__start"),
        F.monotonically_increasing_id().alias("__seq"),
    )
    lines = materialize(read, "lines")
    splits = lines.groupBy("__file", "__start").agg(
        F.count("*").alias("n"), F.min("__seq").alias("first")
    )
    offsets, at = [], 0
    for split in splits.orderBy("__file", "__start").collect():
        offsets.append((split["__file"], split["__start"], at - split["first"]))
        at += split["n"]
    table = spark.createDataFrame(offsets, "__file string, __start long, __shift long")
    return lines.join(F.broadcast(table), ["__file", "__start"]).select(
        (F.col("__seq") + F.col("__shift")).alias("line"), "value"
    )


def read_jsonl_ordered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with their line number as ``line``."""
    return read_lines(spark, path).select("line", F.from_json("value", schema).alias("r")).select(
        "line", "r.*"
    )


_ENTRY = r'"(-?\d+)"\s*:\s*'


def read_neighbour_map(spark: SparkSession, path: str) -> DataFrame:
    """``(id, neighbors_id)`` from JSON objects of the form ``{"0": [1, 2], ...}``.

    Even a single huge object is read by many tasks: records end at the bracket that closes a list.
    """
    records = spark.read.option("lineSep", "]").text(path)
    pattern = _ENTRY + r"\[([^\]]*)$"
    items = F.regexp_extract("value", pattern, 2)
    numbers = F.filter(F.split(F.regexp_replace(items, r"\s+", ""), ","), lambda x: x != "")
    return records.where(F.col("value").rlike(pattern)).select(
        F.regexp_extract("value", pattern, 1).cast("long").alias("id"),
        F.transform(numbers, lambda x: x.cast("long")).alias("neighbors_id"),
    )


def read_id_mapping(spark: SparkSession, path: str) -> DataFrame:
    """``(old_id, new_id)`` from a JSON document ``{"old_to_new": {"0": 5, ...}}``, in parallel."""
    records = spark.read.option("lineSep", ",").text(path)
    pattern = _ENTRY + r"(-?\d+)"
    return records.where(F.col("value").rlike(pattern)).select(
        F.regexp_extract("value", pattern, 1).cast("long").alias("old_id"),
        F.regexp_extract("value", pattern, 2).cast("long").alias("new_id"),
    )


def read_fvecs(spark: SparkSession, path: str, dims: int, expected: int | None = None) -> DataFrame:
    """``(record, emb)`` from binary records of an int32 dimension and that many float32.

    Fails when the files are not whole records, hold another number of records than expected, or
    a record states another dimension. ``record`` counts over all files in name order.
    """
    return read_all(spark, list_records(spark, path, dims, expected))


def read_fvecs_subset(
    spark: SparkSession, path: str, dims: int, wanted: DataFrame, expected: int | None = None
) -> DataFrame:
    """Only the records whose number is in ``wanted.record``; the others are not read."""
    return read_some(spark, list_records(spark, path, dims, expected), wanted)


RESULT_SCHEMA = """
    run_id string, task_label string, timestamp double,
    results array<struct<
        metrics: struct<
            insert_duration: double, optimize_duration: double, load_duration: double,
            recall: double, ndcg: double,
            serial_latency_avg: double, serial_latency_p95: double, serial_latency_p99: double,
            serial_latencies: array<double>, recalls: array<double>>,
        task_config: struct<
            db: string,
            db_config: struct<db_label: string, duckdb_threads: int>,
            db_case_config: struct<
                index: string, index_quantization_type: string, use_blob_interface: boolean,
                max_parallel_workers: int, runtime_n_probe: int, runtime_ef_search: int>,
            case_config: struct<
                case_id: long, k: int,
                custom_case: struct<
                    arxiv_dataset_order: string, sorted_by_update_date: boolean,
                    dataset_order: string, cohere_dataset_order: string,
                    filter_type: string, arxiv_filter_type: string,
                    cohere_filter_type: string, filter_rate: double>>>>>
"""


def read_results(spark: SparkSession, *folders: str) -> DataFrame:
    """One row per benchmark result, nested as recorded, with its ``source_file``.

    Pretty-printed and one-line files are read alike; muted files and missing folders are skipped.
    """
    schema = T.DataType.fromDDL(RESULT_SCHEMA)
    out = None
    for folder in folders:
        reader = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST")
        found = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json")
        try:
            part = found.json(folder)
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], schema).withColumn("source_file", F.lit("")).select(
            "run_id", "task_label", "timestamp", F.explode("results").alias("result"), "source_file"
        )
    name = F.col("_metadata.file_name")
    return out.where(~name.startswith("muted_")).select(
        "run_id", "task_label", "timestamp", F.explode("results").alias("result"),
        name.alias("source_file"),
    )


def flatten_results(results: DataFrame) -> DataFrame:
    """The fields the analyses use, one column each."""
    metrics, task = F.col("result.metrics"), F.col("result.task_config")
    db, case, custom = (
        task["db_config"], task["db_case_config"], task["case_config"]["custom_case"]
    )
    return results.select(
        "run_id", "task_label", "timestamp", "source_file",
        task["case_config"]["case_id"].alias("case_id"),
        task["case_config"]["k"].alias("k"),
        case["index"].alias("index_kind"),
        case["index_quantization_type"].alias("quantisation"),
        F.coalesce(case["use_blob_interface"], F.lit(False)).alias("use_blob"),
        F.coalesce(db["duckdb_threads"], case["max_parallel_workers"]).alias("threads"),
        case["runtime_n_probe"].alias("n_probe"),
        case["runtime_ef_search"].alias("ef_search"),
        db["db_label"].alias("db_label"),
        custom.alias("custom_case"),
        metrics["optimize_duration"].alias("optimize_duration"),
        metrics["recall"].alias("recall"),
        metrics["ndcg"].alias("ndcg"),
        metrics["serial_latencies"].alias("serial_latencies"),
        metrics["recalls"].alias("recalls"),
    )


def per_query(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per run and query: ``(keys, query, latency, recall)`` from the aligned arrays. Fails
    where a run has not as many recalls as latencies."""
    lengths = [F.coalesce(F.size(c), F.lit(-1)) for c in ("serial_latencies", "recalls")]
    said = F.concat(F.lit("latencies and recalls differ in number: "), lengths[0], F.lit(" and "), lengths[1])
    zipped = F.arrays_zip("serial_latencies", "recalls")
    fine = F.when(lengths[0] == lengths[1], zipped).otherwise(F.raise_error(said))
    pair = F.posexplode(fine).alias("query", "p")
    return runs.select(*keys, pair).select(
        *keys, "query", F.col("p.serial_latencies").alias("latency"), F.col("p.recalls").alias("recall")
    )


def read_summary_csv(spark: SparkSession, path: str, required: Sequence[str]) -> DataFrame:
    """A summary CSV with a header; fails when columns are missing or there is no row."""
    table = spark.read.option("header", True).option("inferSchema", False).csv(path)
    missing = [c for c in required if c not in table.columns]
    if missing:
        raise ValueError(f"{path} lacks columns: {', '.join(missing)}")
    if table.isEmpty():
        raise ValueError(f"{path} has no rows")
    return table


def numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns as doubles; what is not a number becomes null."""
    def number(name: str) -> Column:
        return F.col(name).try_cast("double")

    return df.withColumns({c: number(c) for c in columns})
