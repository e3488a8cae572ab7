"""Recall, latency, confidence intervals, histograms and buckets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from nearfield.functions.codec import error_report, quantise_column
from nearfield.functions.hashing import replicate_draw_sql, replicate_key_sql
from nearfield.operators.bootstrap import bootstrap_median
from nearfield.operators.buckets import assign_bucket, bucket_qps, bucket_recalls
from nearfield.operators.knn import nearest, neighbour_lists
from nearfield.operators.metrics import (
    describe,
    histogram,
    latency_summary,
    ndcg_at,
    recall_by_rank,
    recalls,
)
from nearfield.operators.quantiles import rank_within
from nearfield.operators.ranges import selectivities
from nearfield.plans.inputs import (
    BASE_SQL,
    DAY_RANGES_SQL,
    LATENCIES_SQL,
    LINE_ID_SQL,
    ORDERS_SQL,
    QUERIES_SQL,
    RANGE,
    base,
    day_ranges,
    knn_sql,
    latencies,
    line_id,
    orders,
    queries,
    rounded,
    table,
)
from nearfield.plans.registry import query

K = 10

# The rows within a coarse rounding of the vectors stand for an approximate result.
_COARSE = "list_transform(embedding, lambda x: round_even(x::DOUBLE * 8, 0) / 8)::DOUBLE[64]"
_LISTS_SQL = f"""
WITH q AS ({QUERIES_SQL}), b AS ({BASE_SQL}), truth AS ({knn_sql(K)}),
cb AS (SELECT vec_id AS id, {_COARSE} AS emb FROM embeddings),
found AS (SELECT qid, id, rank FROM (
  SELECT q.qid, cb.id, row_number() OVER (
    PARTITION BY q.qid ORDER BY round(array_distance(q.emb, cb.emb), 9), cb.id) AS rank
  FROM q, cb) WHERE rank <= {K})
"""


def _truth_and_found(spark, sf):
    asked, rows = queries(spark, sf), base(spark, sf)
    coarse = rows.withColumn(
        "emb", F.transform("emb", lambda x: (F.rint(x.cast("double") * 8) / 8).cast("float"))
    )
    return asked, nearest(asked, rows, K), nearest(asked, coarse, K)


@query("AG1_recall", f"""
{_LISTS_SQL}
SELECT q.qid AS id, count(f.id) / {K}::DOUBLE AS recall, false AS short_truth
FROM q JOIN truth t USING (qid) LEFT JOIN found f ON f.qid = t.qid AND f.id = t.id GROUP BY q.qid
""")
def recall(spark, sf):
    asked, truth, found = _truth_and_found(spark, sf)
    return recalls(neighbour_lists(asked, found), neighbour_lists(asked, truth), K)


@query("AG1_recall_of_short_truth", f"""
WITH q AS ({QUERIES_SQL}), b AS ({BASE_SQL}),
r AS ({knn_sql(K, "b.label = q.label AND b.attr BETWEEN q.range_start AND q.range_end")}),
n AS (SELECT q.qid, count(r.id) AS n FROM q LEFT JOIN r USING (qid) GROUP BY 1)
SELECT qid AS id, CASE WHEN n >= {K} THEN 1.0::DOUBLE END AS recall, n < {K} AS short_truth FROM n
""")
def recall_short(spark, sf):
    """Queries with fewer than k true neighbours have no recall and are flagged."""
    asked, rows = queries(spark, sf), base(spark, sf)
    truth = neighbour_lists(asked, nearest(asked, rows, K, key="label", within=RANGE))
    return recalls(truth, truth, K)


@query("AG2_mean_recall", f"""
{_LISTS_SQL}
SELECT run, round(count(f.id) / count(*)::DOUBLE, 6) AS recall
FROM (SELECT unnest([0, 1])::INTEGER AS run) r JOIN truth t ON true
LEFT JOIN found f ON f.qid = t.qid AND f.id = t.id AND (run = 0 OR f.rank <= {K // 2}) GROUP BY run
""")
def mean_recall(spark, sf):
    """Two runs: the whole result, and only the first half of every list."""
    _, truth, found = _truth_and_found(spark, sf)
    halves = F.when(F.col("rank") <= K // 2, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    runs = found.withColumn("run", F.explode(halves))
    return rounded(recall_by_rank(runs, truth, ["run"], K), "recall")


@query("AG3_ndcg", f"""
{_LISTS_SQL},
ideal AS (SELECT sum(1 / log2(i + 1)) AS best FROM range(1, {K + 1}) t(i))
SELECT f.qid AS id, round(coalesce(sum(1 / log2(f.rank + 1)) FILTER (t.id IS NOT NULL), 0) / best, 6) AS ndcg
FROM found f LEFT JOIN truth t ON f.qid = t.qid AND f.id = t.id, ideal GROUP BY f.qid, best
""")
def ndcg(spark, sf):
    asked, truth, found = _truth_and_found(spark, sf)
    both = neighbour_lists(asked, truth).withColumnRenamed("neighbors_id", "truth").join(
        neighbour_lists(asked, found), "id"
    )
    score = ndcg_at(F.col("neighbors_id"), F.col("truth"), K)
    return both.select("id", F.round(score, 6).alias("ndcg"))


_SUMMARY_SQL = f"""
SELECT kind, run, count(*) AS queries, round(avg(latency), 8) AS mean,
       round(quantile_cont(latency, 0.5), 8) AS median, round(quantile_cont(latency, 0.95), 8) AS p95,
       round(quantile_cont(latency, 0.99), 8) AS p99,
       round(CASE WHEN median(latency) > 0 THEN 1 / median(latency) ELSE 0 END, 6) AS qps
FROM ({LATENCIES_SQL}) GROUP BY kind, run
"""


def _summary(spark, sf):
    runs = latency_summary(latencies(spark, sf), ["kind", "run"], "latency", "event_id")
    return rounded(rounded(runs, "mean", "median", "p95", "p99", digits=8), "qps")


@query("AG4_latency_summary", f"SELECT kind, run, queries, mean, p95, p99 FROM ({_SUMMARY_SQL})")
def latency(spark, sf):
    return _summary(spark, sf).select("kind", "run", "queries", "mean", "p95", "p99")


@query("AG5_qps", f"SELECT kind, run, qps FROM ({_SUMMARY_SQL})")
def rates(spark, sf):
    return _summary(spark, sf).select("kind", "run", "qps")


REPLICATES = 1000


def bootstrap_sql(source: str, groups: str, throughput: bool, replicates: int, digits: int = 6) -> str:
    """The same resamples drawn in SQL: ``source`` has the groups, ``latency`` and ``event_id``."""
    key, draw = replicate_key_sql(42, "b"), replicate_draw_sql("key", "i", "n")
    stat = "CASE WHEN m > 0 THEN 1 / m ELSE 'inf'::DOUBLE END" if throughput else "m"
    est = "CASE WHEN med > 0 THEN 1 / med ELSE 0 END" if throughput else "med"
    using = f"USING ({groups})"
    return f"""
WITH s AS ({source}),
r AS (SELECT {groups}, latency, row_number() OVER (PARTITION BY {groups} ORDER BY latency, event_id) - 1 AS rank FROM s),
g AS (SELECT {groups}, count(*) AS n, median(latency) AS med FROM s GROUP BY {groups}),
reps AS (SELECT b, {key} AS key FROM range({replicates}) t(b)),
d AS (SELECT {groups}, n, b, unnest(range(n)) AS i, key FROM g, reps WHERE n > 1),
dr AS (SELECT {groups}, b, {draw} AS rank FROM d),
m AS (SELECT {groups}, b, median(latency) AS m FROM dr JOIN r USING ({groups}, rank) GROUP BY {groups}, b),
c AS (SELECT {groups}, quantile_cont({stat}, 0.025) AS lo, quantile_cont({stat}, 0.975) AS hi FROM m GROUP BY {groups})
SELECT {groups}, round({est}, {digits}) AS estimate, round(coalesce({est} - lo, 0), {digits}) AS lower_err,
       round(coalesce(hi - {est}, 0), {digits}) AS upper_err, n, n < 30 AS few
FROM g LEFT JOIN c {using}
"""


@query("AG6_median_interval", bootstrap_sql(LATENCIES_SQL, "kind, run", False, REPLICATES, 10))
def median_interval(spark, sf):
    found = bootstrap_median(
        latencies(spark, sf), ["kind", "run"], "latency", "event_id", replicates=REPLICATES
    )
    return rounded(found, "estimate", "lower_err", "upper_err", digits=10)


@query("AG7_qps_interval", bootstrap_sql(LATENCIES_SQL, "kind, run", True, REPLICATES))
def qps_interval(spark, sf):
    found = bootstrap_median(
        latencies(spark, sf), ["kind", "run"], "latency", "event_id", replicates=REPLICATES,
        throughput=True,
    )
    return rounded(found, "estimate", "lower_err", "upper_err")


_PER_USER_SQL = "SELECT event_id, user_id, value / 1000 AS latency FROM events"


@query("AG7_qps_interval_full", bootstrap_sql(_PER_USER_SQL, "user_id", True, 1000))
def qps_interval_full(spark, sf):
    """A thousand resamples of every user's events."""
    events = table(spark, sf, "events").select(
        "event_id", "user_id", (F.col("value") / 1000).alias("latency")
    )
    found = bootstrap_median(events, ["user_id"], "latency", "event_id", throughput=True)
    return rounded(found, "estimate", "lower_err", "upper_err")


@query("AG14_descriptives", """
SELECT count(*) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean,
       round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std FROM events
""")
def descriptives(spark, sf):
    found = describe(table(spark, sf, "events"), "value", "event_id")
    return rounded(found, "mean", "median", "std")


def histogram_sql(source: str, value: str, bins: int) -> str:
    return f"""
WITH s AS ({source}), e AS (SELECT min({value})::DOUBLE AS lo, max({value})::DOUBLE AS hi FROM s),
c AS (SELECT least(floor(({value} - lo) / ((hi - lo) / {bins})), {bins - 1})::INTEGER AS bin, count(*) AS n
      FROM s, e GROUP BY 1)
SELECT i::INTEGER AS bin, round(lo + i * ((hi - lo) / {bins}), 6) AS low,
       round(lo + (i + 1) * ((hi - lo) / {bins}), 6) AS high, coalesce(n, 0) AS n
FROM range({bins}) t(i) CROSS JOIN e LEFT JOIN c ON c.bin = i
"""


@query("AG15_day_histogram", histogram_sql(ORDERS_SQL, "day", 100))
def day_histogram(spark, sf):
    return rounded(histogram(orders(spark, sf), "day", 100), "low", "high")


@query("AG15_value_histogram", histogram_sql("SELECT value FROM events", "value", 50))
def value_histogram(spark, sf):
    return rounded(histogram(table(spark, sf, "events"), "value", 50), "low", "high")


_SELECTIVITY_SQL = f"""
SELECT q.qid, count(o.id) AS count, count(o.id) / (SELECT count(*) FROM orders)::DOUBLE AS selectivity
FROM ({DAY_RANGES_SQL}) q LEFT JOIN ({ORDERS_SQL}) o ON o.day BETWEEN q.range_start AND q.range_end
GROUP BY q.qid
"""


@query("AG16_selectivity", f"SELECT qid, count, round(selectivity, 9) AS selectivity FROM ({_SELECTIVITY_SQL})")
def selectivity(spark, sf):
    report = selectivities(orders(spark, sf), "day", day_ranges(spark, sf))
    return report.select("qid", "count", F.round("selectivity", 9).alias("selectivity"))


# Bounds of the selectivity buckets, in percent.
ARXIV_BOUNDS = [(0, 5), (5, 25), (25, 75), (75, 100)]
POINT_BOUNDS = [(75, 100), (5.0, 5.0), (1, 6)]


def bucket_sql(value: str, bounds) -> str:
    cases = []
    for at, (low, high) in reversed(list(enumerate(bounds))):
        top = "<=" if low == high or high == 100 or at == len(bounds) - 1 else "<"
        cases.append(
            f"WHEN {value} >= {low / 100.0}::DOUBLE AND {value} {top} {high / 100.0}::DOUBLE THEN {at}"
        )
    return f"CASE {' '.join(cases)} ELSE -1 END"


@query("W8_selectivity_buckets", f"""
SELECT l_orderkey, l_linenumber, {bucket_sql("l_discount", ARXIV_BOUNDS)} AS bucket,
       {bucket_sql("l_discount", POINT_BOUNDS)} AS point_bucket FROM lineitem
""")
def buckets(spark, sf):
    share = F.col("l_discount")
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", assign_bucket(share, ARXIV_BOUNDS).alias("bucket"),
        assign_bucket(share, POINT_BOUNDS).alias("point_bucket"),
    )


# The last bucket lies above every discount and stays empty.
DISCOUNT_BOUNDS = [(0, 3), (3, 8), (50, 100)]
_SCORED_SQL = f"""
SELECT {LINE_ID_SQL} AS event_id, l_returnflag AS run, 1 - l_tax AS recall, l_quantity / 1000 AS latency,
       {bucket_sql("l_discount", DISCOUNT_BOUNDS)} AS bucket FROM lineitem
"""


def _scored(spark, sf):
    return table(spark, sf, "lineitem").select(
        line_id().alias("event_id"), F.col("l_returnflag").alias("run"),
        (1 - F.col("l_tax")).alias("recall"), (F.col("l_quantity") / 1000).alias("latency"),
        assign_bucket(F.col("l_discount"), DISCOUNT_BOUNDS).alias("bucket"),
    )


_ALL_BUCKETS = "(SELECT DISTINCT run FROM s) CROSS JOIN (SELECT unnest([0, 1, 2])::INTEGER AS bucket)"


@query("AG17_bucket_recall", f"""
WITH s AS ({_SCORED_SQL})
SELECT run, bucket, round(coalesce(avg(recall), 0), 6) AS recall, count(recall) AS queries
FROM {_ALL_BUCKETS} LEFT JOIN s USING (run, bucket) GROUP BY run, bucket
""")
def recall_per_bucket(spark, sf):
    return rounded(bucket_recalls(_scored(spark, sf), ["run"], DISCOUNT_BOUNDS), "recall")


@query("AG18_bucket_qps", f"""
WITH s AS ({_SCORED_SQL}), x AS ({bootstrap_sql("SELECT * FROM s WHERE bucket >= 0", "run, bucket", True, REPLICATES)
    .replace("WITH s AS", "WITH s_ AS").replace("FROM s)", "FROM s_)").replace("FROM s GROUP", "FROM s_ GROUP")})
SELECT run, bucket, coalesce(estimate, 0) AS qps, coalesce(lower_err, 0) AS lower_err,
       coalesce(upper_err, 0) AS upper_err FROM {_ALL_BUCKETS} LEFT JOIN x USING (run, bucket)
""")
def qps_per_bucket(spark, sf):
    found = bucket_qps(
        _scored(spark, sf), ["run"], DISCOUNT_BOUNDS, "latency", "event_id", replicates=REPLICATES
    )
    return rounded(found, "qps", "lower_err", "upper_err")


@query("W5_top_per_group", """
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rank
FROM events QUALIFY rank <= 5
""")
def top_per_group(spark, sf):
    """Top rows by a window, which Spark limits per group before the shuffle."""
    order = Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id")
    ranked = table(spark, sf, "events").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= 5).select(
        "user_id", "event_id", F.col("rank").cast("long").alias("rank")
    )


@query("W5_rank_within_group", """
SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS rank FROM events
""")
def ranks(spark, sf):
    """Full ranks in a few huge groups, numbered without holding a group in a task."""
    rows = table(spark, sf, "events").select("event_type", "event_id", "value")
    return rank_within(rows, ["event_type"], ["value", "event_id"]).select("event_type", "event_id", "rank")


_CODE_SQL = """
WITH e AS (SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) t(i)),
s AS (SELECT vec_id, i, x, CASE
  WHEN round_even(x * 100000, 0) BETWEEN -8192 AND 8191 THEN 0
  WHEN round_even(x * 10000, 0) BETWEEN -8192 AND 8191 THEN 1
  WHEN round_even(x * 1000, 0) BETWEEN -8192 AND 8191 THEN 2 ELSE 3 END AS scale FROM e),
m AS (SELECT *, ([100000.0, 10000.0, 1000.0, 100.0]::DOUBLE[])[scale + 1] AS f FROM s),
c AS (SELECT vec_id, i, x, f, greatest(-8192, least(8191, round_even(x * f, 0)))::BIGINT AS q, scale FROM m)
"""


@query("SF9_codes", f"{_CODE_SQL} SELECT vec_id, i - 1 AS pos, (q * 4 + scale)::SMALLINT AS code FROM c")
def codes(spark, sf):
    coded = quantise_column(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("emb")))
    return coded.select("vec_id", F.posexplode("code").alias("pos", "code")).withColumn(
        "pos", F.col("pos").cast("long")
    )


@query("SF9_error_report", f"""
{_CODE_SQL}
SELECT count(DISTINCT vec_id) AS vectors, count(*) AS elements,
       round(avg(abs(x - (q / f)::FLOAT::DOUBLE)), 9) AS mean_abs_error,
       round(max(abs(x - (q / f)::FLOAT::DOUBLE)), 9) AS max_abs_error FROM c
""")
def code_errors(spark, sf):
    coded = quantise_column(table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("emb")))
    return rounded(error_report(coded), "mean_abs_error", "max_abs_error", digits=9)
