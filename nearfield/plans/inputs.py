"""Base, query and run tables derived from the test tables, in Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.operators.knn import Range

DIM = 64
RANGE = Range("attr", "range_start", "range_end")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def base(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding as a base row with a label, a range attribute and a set of members."""
    v = F.col("vec_id")
    return table(spark, sf, "embeddings").select(
        v.alias("id"), F.col("embedding").alias("emb"), "label", ((v * 37) % 1009).alias("attr"),
        F.array(F.concat(F.lit("c"), "label"), F.concat(F.lit("d"), v % 7)).alias("members"),
    )


def queries(spark: SparkSession, sf: str) -> DataFrame:
    """Every embedding as a query with its predicates."""
    v = F.col("vec_id")
    start = (v * 13) % 700
    return table(spark, sf, "embeddings").select(
        v.alias("qid"), F.col("embedding").alias("emb"), "label", start.alias("range_start"),
        (start + 50 + v % 200).alias("range_end"), F.concat(F.lit("d"), v % 7).alias("member"),
    )


BASE_SQL = """
SELECT vec_id AS id, embedding::DOUBLE[64] AS emb, label, (vec_id * 37) % 1009 AS attr,
       ['c' || label, 'd' || (vec_id % 7)] AS members
FROM embeddings
"""

QUERIES_SQL = """
SELECT vec_id AS qid, embedding::DOUBLE[64] AS emb, label, (vec_id * 13) % 700 AS range_start,
       (vec_id * 13) % 700 + 50 + vec_id % 200 AS range_end, 'd' || (vec_id % 7) AS member
FROM embeddings
"""


def knn_sql(k: int, where: str = "true", score: str = "array_distance(q.emb, b.emb)",
            direction: str = "ASC") -> str:
    """CTE body ranking every pair that meets ``where``."""
    return f"""
SELECT * FROM (
  SELECT q.qid, b.id, {score} AS score,
         row_number() OVER (PARTITION BY q.qid ORDER BY {score} {direction}, b.id) AS rank
  FROM q JOIN b ON {where}) WHERE rank <= {k}
"""


def knn_oracle(k: int, where: str = "true", **kind: str) -> str:
    return f"""
WITH q AS ({QUERIES_SQL}), b AS ({BASE_SQL}), r AS ({knn_sql(k, where, **kind)})
SELECT qid, id, rank, round(score, 6) AS score FROM r
"""


def days(column: str) -> Column:
    return F.datediff(F.to_date(column), F.lit("1970-01-01").cast("date")).cast("long")


def days_sql(column: str) -> str:
    return f"date_diff('day', DATE '1970-01-01', {column}::DATE)"


def orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a dated table: ``(id, day)``."""
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("id"), days("o_orderdate").alias("day")
    )


ORDERS_SQL = f"SELECT o_orderkey AS id, {days_sql('o_orderdate')} AS day FROM orders"


def day_ranges(spark: SparkSession, sf: str) -> DataFrame:
    """A range of days for every customer."""
    c = F.col("c_custkey")
    start = F.lit(8000) + (c * 13) % 2300
    return table(spark, sf, "customer").select(
        c.alias("qid"), start.alias("range_start"), (start + 1 + c % 400).alias("range_end")
    )


DAY_RANGES_SQL = """
SELECT c_custkey AS qid, 8000 + (c_custkey * 13) % 2300 AS range_start,
       8000 + (c_custkey * 13) % 2300 + 1 + c_custkey % 400 AS range_end
FROM customer
"""


def line_id() -> Column:
    return (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long")


LINE_ID_SQL = "l_orderkey * 10 + l_linenumber"


def latencies(spark: SparkSession, sf: str) -> DataFrame:
    """Events as the per-query latencies of runs: ``(event_id, kind, run, latency)``."""
    return table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("kind"), (F.col("user_id") % 3).alias("run"),
        (F.col("value") / 1000).alias("latency"),
    )


LATENCIES_SQL = """
SELECT event_id, event_type AS kind, user_id % 3 AS run, value / 1000 AS latency FROM events
"""


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
