"""Benchmark records: reading, naming, comparing and drawing curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearfield.functions.names import (
    CASE_NAMES,
    EXACT_COUNTS,
    case_dataset,
    dataset_label,
    dataset_order,
    dataset_order_shuffled,
    filter_type,
    format_bytes,
    index_name,
    index_position,
    label_field,
    parse_dataset,
    pg_index_name,
    short_dataset_labels,
    short_system_label,
    strip_quantisation,
    task_tags,
    variant_name,
)
from nearfield.operators.profiles import profile_rollup
from nearfield.operators.numbering import block_of, number_rows
from nearfield.operators.runs import (
    curve_blocks,
    curve_lists,
    extremes,
    incomplete_groups,
    median_with_bars,
    point_ids,
    rate_at_recall,
    recall_curve,
    reductions,
    run_means,
    select_runs,
    size_overhead,
    speedups,
    system_by_dataset,
    timing_breakdown,
)
from nearfield.operators.buckets import assign_bucket, bucket_qps, bucket_recalls
from nearfield.plans.evaluation import ARXIV_BOUNDS, REPLICATES, bootstrap_sql, bucket_sql
from nearfield.plans.inputs import LINE_ID_SQL, line_id, rounded, table
from nearfield.plans.registry import query
from nearfield.session import scratch_path
from nearfield.sources import readers, writers

# Events as index builds: the type is the index, the user the dataset.
_BUILDS_SQL = """
SELECT event_id, 'D' || (user_id % 5) AS dataset, event_type AS index,
       CASE WHEN event_id % 2 = 0 THEN 1 ELSE 14 END AS threads, value AS optimize_duration FROM events
"""


def _builds(spark, sf):
    threads = F.when(F.col("event_id") % 2 == 0, 1).otherwise(14)
    return table(spark, sf, "events").select(
        "event_id", F.concat(F.lit("D"), F.col("user_id") % 5).alias("dataset"),
        F.col("event_type").alias("index"), threads.alias("threads"),
        F.col("value").alias("optimize_duration"),
    )


@query("PF10_run_filters", """
SELECT event_id, kind AS index_kind, dataset FROM (
  SELECT event_id, event_type AS kind, 'D' || (user_id % 5) AS dataset, event_id % 3 = 0 AS use_blob,
         CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN 1 ELSE 14 END AS threads FROM events)
WHERE kind = 'click' AND use_blob AND (threads IS NULL OR threads = 14) AND dataset <> 'D1'
""")
def run_filters(spark, sf):
    e = F.col("event_id")
    runs = table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("index_kind"),
        F.concat(F.lit("D"), F.col("user_id") % 5).alias("dataset"), (e % 3 == 0).alias("use_blob"),
        F.when(e % 4 == 1, 1).when(e % 4 != 0, 14).alias("threads"),
    )
    kept = select_runs(runs, kind="click", blob=True, threads=14, without_datasets=["D1"])
    return kept.select("event_id", "index_kind", "dataset")


@query("PF10_extension_runs", """
SELECT event_id FROM events WHERE CASE WHEN event_type = 'view' THEN 'FLAT' ELSE event_type END <> 'FLAT'
""")
def extension_runs(spark, sf):
    kind = F.when(F.col("event_type") == "view", "FLAT").otherwise(F.col("event_type"))
    runs = table(spark, sf, "events").select("event_id", kind.alias("index_kind"))
    return select_runs(runs, kind="EXTENSION").select("event_id")


_CASES_SQL = ", ".join(f"({case}, '{name}')" for case, name in CASE_NAMES.items())


@query("JN10_case_names", f"""
SELECT p_partkey, coalesce(c.name, 'Unknown (case_id=' || (p_partkey % 620) || ')') AS dataset
FROM part LEFT JOIN (VALUES {_CASES_SQL}) c(id, name) ON c.id = p_partkey % 620
""")
def case_names(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 620).alias("case_id"))
    return case_dataset(parts).select("p_partkey", "dataset")


@query("AG8_median_with_bars", f"""
SELECT dataset, index, threads, count(*) AS n, round(median(optimize_duration), 6) AS median,
       round(median(optimize_duration) - min(optimize_duration), 6) AS lower_err,
       round(max(optimize_duration) - median(optimize_duration), 6) AS upper_err
FROM ({_BUILDS_SQL}) GROUP BY ALL
""")
def build_bars(spark, sf):
    found = median_with_bars(
        _builds(spark, sf), ["dataset", "index", "threads"], "optimize_duration", "event_id"
    )
    return rounded(found, "median", "lower_err", "upper_err")


@query("AG9_incomplete_groups", """
SELECT l_orderkey, l_returnflag, count(*) AS measurements FROM lineitem GROUP BY ALL HAVING count(*) <> 3
""")
def incomplete(spark, sf):
    return incomplete_groups(table(spark, sf, "lineitem"), ["l_orderkey", "l_returnflag"])


_SPEEDUP_SQL = f"""
SELECT * FROM (SELECT dataset, avg(optimize_duration) FILTER (index = 'view') AS base_mean,
  avg(optimize_duration) FILTER (index = 'click') AS other_mean,
  avg(optimize_duration) FILTER (index = 'view') / avg(optimize_duration) FILTER (index = 'click') AS speedup
FROM ({_BUILDS_SQL}) WHERE threads = 14 GROUP BY dataset) WHERE base_mean IS NOT NULL AND other_mean IS NOT NULL
"""


def _speedups(spark, sf):
    return speedups(_builds(spark, sf).where(F.col("threads") == 14), "view", "click")


@query("AG10_speedups", f"""
SELECT dataset, round(base_mean, 6) AS base_mean, round(other_mean, 6) AS other_mean, round(speedup, 6) AS speedup
FROM ({_SPEEDUP_SQL})
""")
def speedup(spark, sf):
    return rounded(_speedups(spark, sf), "base_mean", "other_mean", "speedup")


def _extremes_sql(source: str, value: str) -> str:
    return f"""
WITH s AS ({source})
SELECT (SELECT dataset FROM s ORDER BY {value}, dataset LIMIT 1) AS min_dataset, round(min({value}), 6) AS min_value,
       (SELECT dataset FROM s ORDER BY {value} DESC, dataset LIMIT 1) AS max_dataset, round(max({value}), 6) AS max_value
FROM s
"""


@query("AG10_speedup_range", _extremes_sql(_SPEEDUP_SQL, "speedup"))
def speedup_range(spark, sf):
    return rounded(extremes(_speedups(spark, sf), "speedup"), "min_value", "max_value")


# Documents as stored indexes: the language is the dataset, the source the system.
_SIZES_SQL = "SELECT lang AS dataset, source AS index, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY ALL"
_REDUCTION_SQL = f"""
SELECT a.dataset, a.bytes::DOUBLE AS base_mean, b.bytes::DOUBLE AS other_mean, (1 - b.bytes / a.bytes::DOUBLE) * 100 AS reduction_pct
FROM ({_SIZES_SQL}) a JOIN ({_SIZES_SQL}) b USING (dataset)
WHERE a.index = (SELECT min(source) FROM documents) AND b.index = (SELECT max(source) FROM documents)
"""


def _sizes(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.groupBy(F.col("lang").alias("dataset"), F.col("source").alias("index")).agg(
        F.sum("n_chars").alias("bytes")
    )


def _reductions(spark, sf):
    names = table(spark, sf, "documents").agg(F.min("source").alias("a"), F.max("source").alias("b")).first()
    return reductions(_sizes(spark, sf), names["a"], names["b"])


@query("AG11_reductions", f"""
SELECT dataset, base_mean, other_mean, round(reduction_pct, 6) AS reduction_pct FROM ({_REDUCTION_SQL})
""")
def reduction(spark, sf):
    return rounded(_reductions(spark, sf), "reduction_pct")


@query("AG11_reduction_range", _extremes_sql(_REDUCTION_SQL, "reduction_pct"))
def reduction_range(spark, sf):
    return rounded(extremes(_reductions(spark, sf), "reduction_pct"), "min_value", "max_value")


# Parts as indexes: the name of a listed dataset, and a size that is missing for some.
_NAMES_SQL = f"SELECT list(name ORDER BY id) AS names FROM (VALUES {_CASES_SQL}) c(id, name)"
_INDEXES_SQL = f"""
SELECT p_partkey, names[p_partkey % len(names) + 1] AS dataset,
       CASE WHEN p_partkey % 11 <> 0 THEN (p_retailprice * 10000000)::BIGINT END AS bytes,
       CASE WHEN p_size % 2 = 0 THEN 'u8' ELSE 'f32' END AS element FROM part, ({_NAMES_SQL})
"""


def _indexes(spark, sf):
    names = F.array(*[F.lit(name) for name in CASE_NAMES.values()])
    key = F.col("p_partkey")
    return table(spark, sf, "part").select(
        "p_partkey", F.element_at(names, (key % len(CASE_NAMES) + 1).cast("int")).alias("dataset"),
        F.when(key % 11 != 0, F.round(F.col("p_retailprice") * 10000000).cast("long")).alias("bytes"),
        F.when(F.col("p_size") % 2 == 0, "u8").otherwise("f32").alias("element"),
    )


_PARSED = r"regexp_extract(dataset, '\((\d+(?:\.\d+)?)\s*([KM]?)\s*×\s*(\d+)', {})"
_COUNT_SQL = (
    f"({_PARSED.format(1)}::DOUBLE * CASE {_PARSED.format(2)} WHEN 'K' THEN 1000 WHEN 'M' THEN 1000000 ELSE 1 END)::BIGINT"
)
_EXACT_SQL = " ".join(f"WHEN dataset = '{n}' THEN {c}" for n, c in EXACT_COUNTS.items())


@query("AG12_size_overhead", f"""
WITH p AS (SELECT *, CASE {_EXACT_SQL} ELSE {_COUNT_SQL} END * {_PARSED.format(3)}::BIGINT
                  * CASE WHEN element = 'u8' THEN 1 ELSE 4 END AS raw_bytes FROM ({_INDEXES_SQL}))
SELECT p_partkey, raw_bytes, bytes - raw_bytes AS overhead, round((bytes - raw_bytes) / bytes::DOUBLE * 100, 6) AS overhead_pct
FROM p
""")
def overheads(spark, sf):
    found = size_overhead(_indexes(spark, sf), exact_counts=EXACT_COUNTS)
    return rounded(found.select("p_partkey", "raw_bytes", "overhead", "overhead_pct"), "overhead_pct")


@query("AG13_system_by_dataset", """
SELECT event_type AS index, max(event_id) FILTER (user_id % 3 = 0) AS D0,
       max(event_id) FILTER (user_id % 3 = 1) AS D1, max(event_id) FILTER (user_id % 3 = 2) AS D2
FROM events GROUP BY event_type
""")
def pivoted(spark, sf):
    sizes = table(spark, sf, "events").groupBy(
        F.col("event_type").alias("index"), F.concat(F.lit("D"), F.col("user_id") % 3).alias("dataset")
    ).agg(F.max("event_id").alias("bytes"))
    return system_by_dataset(sizes, "index", "dataset", "bytes", ["D0", "D1", "D2"])


_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("AG19_run_means", f"""
SELECT l_returnflag, l_linestatus, count(*) AS num_queries_run,
       {", ".join(f"round(avg({m}), 4) AS avg_{m}" for m in _MEASURES)} FROM lineitem GROUP BY ALL
""")
def means(spark, sf):
    found = run_means(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], _MEASURES)
    return rounded(found, *[f"avg_{m}" for m in _MEASURES], digits=4)


@query("AG20_timing_breakdown", """
WITH m AS (SELECT l_linestatus AS run, avg(l_discount) AS planner, avg(l_tax) AS scan, avg(l_quantity) AS latency
           FROM lineitem GROUP BY 1),
p AS (SELECT run, 'planner' AS component, planner AS s, latency FROM m UNION ALL SELECT run, 'scan', scan, latency FROM m)
SELECT run, component, round(s * 1000, 6) AS ms, round(sum(s) OVER (PARTITION BY run) * 1000, 6) AS total_ms,
       round(1 / latency, 6) AS qps FROM p
""")
def breakdown(spark, sf):
    """The third component is 0 everywhere and drops out."""
    lines = table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("run"), F.col("l_discount").alias("planner"),
        F.col("l_tax").alias("scan"), F.lit(0.0).alias("unused"), F.col("l_quantity").alias("latency"),
    )
    found = timing_breakdown(lines, ["run"], ["planner", "scan", "unused"], "latency")
    return rounded(found, "ms", "total_ms", "qps")


_POINTS_SQL = f"""
SELECT {LINE_ID_SQL} AS id, l_returnflag AS dataset, l_linenumber AS threads,
       CASE WHEN l_suppkey % 3 = 0 THEN 'global' WHEN l_suppkey % 3 = 1 THEN 'local' ELSE 'flat' END AS index,
       1 - l_discount * 2 AS recall, l_extendedprice AS qps
FROM lineitem
"""


def _points(spark, sf):
    s = F.col("l_suppkey") % 3
    return table(spark, sf, "lineitem").select(
        line_id().alias("id"), F.col("l_returnflag").alias("dataset"), F.col("l_linenumber").alias("threads"),
        F.when(s == 0, "global").when(s == 1, "local").otherwise("flat").alias("index"),
        (1 - F.col("l_discount") * 2).alias("recall"),
        F.col("l_extendedprice").alias("qps"),
    )


_CURVE = ["dataset", "index", "threads"]


@query("AG21_recall_curves", f"""
SELECT dataset, index, threads, row_number() OVER (PARTITION BY dataset, index, threads ORDER BY recall, id, qps) AS point,
       round(recall, 6) AS recall, round(qps, 6) AS qps FROM ({_POINTS_SQL})
""")
def curves(spark, sf):
    found = recall_curve(_points(spark, sf), _CURVE, "recall", "qps", "id")
    return rounded(found.select(*_CURVE, "point", "recall", "qps"), "recall", "qps")


@query("AG21_curve_lists", """
SELECT user_id, string_agg(event_id::VARCHAR, ',' ORDER BY value, event_id) AS points FROM events GROUP BY user_id
""")
def nested_curves(spark, sf):
    points = table(spark, sf, "events").select("user_id", F.col("value").alias("recall"), "event_id")
    curve = recall_curve(points.withColumn("qps", F.col("event_id")), ["user_id"], "recall", "qps", "event_id")
    lists = curve_lists(curve, ["user_id"], "recall", "qps")
    ids = F.transform("points", lambda p: p["qps"].cast("string"))
    return lists.select("user_id", F.array_join(ids, ",").alias("points"))


@query("AG21_curve_blocks", f"""
WITH p AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY recall, id, qps) - 1 AS place FROM ({_POINTS_SQL}))
SELECT dataset, place // 100 AS block, string_agg(id::VARCHAR, ',' ORDER BY place) AS points FROM p GROUP BY ALL
""")
def blocked_curves(spark, sf):
    """Three curves of all lines, a hundred points a row."""
    points = _points(spark, sf).select("dataset", "recall", F.col("qps").alias("rate"), "id")
    curve = recall_curve(points, ["dataset"], "recall", "rate", "id").withColumn("qps", F.col("id"))
    blocks = curve_blocks(curve, ["dataset"], "recall", "qps", 100)
    ids = F.transform("points", lambda p: p["qps"].cast("string"))
    return blocks.select("dataset", "block", F.array_join(ids, ",").alias("points"))


@query("AG22_rate_at_recall", f"""
WITH s AS ({_POINTS_SQL}),
f AS (SELECT * FROM s WHERE recall >= 0.9
      QUALIFY row_number() OVER (PARTITION BY dataset, threads, index ORDER BY recall, id, qps) = 1),
g AS (SELECT DISTINCT dataset, threads FROM s)
SELECT g.dataset, g.threads, round(a.recall, 6) AS base_recall, round(a.qps, 6) AS base_qps,
       round(b.recall, 6) AS other_recall, round(b.qps, 6) AS other_qps,
       round((a.qps - b.qps) / a.qps * 100, 6) AS decrease_pct,
       CASE WHEN a.qps IS NULL AND b.qps IS NULL THEN 'both' WHEN a.qps IS NULL THEN 'base'
            WHEN b.qps IS NULL THEN 'other' END AS missing
FROM g LEFT JOIN f a ON a.dataset = g.dataset AND a.threads = g.threads AND a.index = 'global'
LEFT JOIN f b ON b.dataset = g.dataset AND b.threads = g.threads AND b.index = 'local'
""")
def at_recall(spark, sf):
    found = rate_at_recall(
        _points(spark, sf), ["dataset", "threads"], "index", "global", "local",
        recall="recall", rate="qps", id_col="id",
    )
    return rounded(found, "base_recall", "base_qps", "other_recall", "other_qps", "decrease_pct")


@query("W9_point_ids", """
SELECT event_id, row_number() OVER (ORDER BY event_type, ts, event_id) - 1 AS point_id FROM events
""")
def points(spark, sf):
    runs = table(spark, sf, "events").select("event_id", "event_type", "ts")
    return point_ids(runs, ["event_type", "ts", "event_id"]).select("event_id", "point_id")


@query("W10_dataset_order", f"""
WITH d AS (SELECT DISTINCT dataset FROM ({_INDEXES_SQL}) UNION ALL SELECT DISTINCT lang FROM documents),
p AS (SELECT dataset, CASE WHEN {_PARSED.format(3)} <> '' THEN {_PARSED.format(3)}::BIGINT END AS d,
             CASE WHEN {_PARSED.format(3)} <> '' THEN {_COUNT_SQL.replace("::DOUBLE", "")
             .replace(_PARSED.format(1), "TRY_CAST(" + _PARSED.format(1) + " AS DOUBLE)")} END AS n FROM d)
SELECT dataset, row_number() OVER (ORDER BY n * d * 4 NULLS LAST, d NULLS LAST, n NULLS LAST, dataset) - 1 AS place FROM p
""")
def datasets_ordered(spark, sf):
    """Datasets by size, with names that do not parse at the end."""
    names = _indexes(spark, sf).select("dataset").distinct().unionByName(
        table(spark, sf, "documents").select(F.col("lang").alias("dataset")).distinct()
    )
    p = parse_dataset(F.col("dataset"))
    keyed = names.select("dataset", p.alias("p"))
    keys = [F.col(f"p.{c}").asc_nulls_last() for c in ("bytes", "d", "n")]
    return number_rows(keyed, [*keys, "dataset"], "place").select("dataset", "place")


_ORDER = ["view", "click", "purchase"]


@query("W11_index_order", f"""
SELECT event_id, CASE event_type {" ".join(f"WHEN '{n}' THEN {i + 1}" for i, n in enumerate(_ORDER))} END::BIGINT AS place
FROM events
""")
def index_order(spark, sf):
    return table(spark, sf, "events").select("event_id", index_position(F.col("event_type"), _ORDER).alias("place"))


@query("SF1_index_names", """
SELECT event_id, CASE kind WHEN 'FLAT' THEN 'DuckDB' WHEN 'HNSW' THEN 'DuckDB VSS (HNSW)'
  WHEN 'IVF' THEN 'Lists (IVF, ' || CASE WHEN version IS NULL THEN 'Row Group' ELSE 'Global' END || ', ' ||
       upper(coalesce(quant, 'f32')) || ')' ELSE kind END AS name,
  CASE lower(kind) WHEN 'hnsw' THEN 'pgvector (HNSW)' WHEN 'ivfflat' THEN 'pgvector (IVFFlat)' ELSE kind END AS pg_name
FROM (SELECT event_id, ['FLAT', 'HNSW', 'IVF', 'IvfFlat', 'other'][event_id % 5 + 1] AS kind,
             CASE user_id % 3 WHEN 0 THEN 'u8' WHEN 1 THEN 'f32' END AS quant,
             CASE WHEN user_id % 2 = 0 THEN 'true' END AS version FROM events)
""")
def index_names(spark, sf):
    kinds = F.array(*[F.lit(k) for k in ("FLAT", "HNSW", "IVF", "IvfFlat", "other")])
    user = F.col("user_id")
    runs = table(spark, sf, "events").select(
        "event_id", F.element_at(kinds, (F.col("event_id") % 5 + 1).cast("int")).alias("kind"),
        F.when(user % 3 == 0, "u8").when(user % 3 == 1, "f32").alias("quant"),
        F.when(user % 2 == 0, "true").alias("version"),
    )
    shown = index_name(
        F.col("kind"), F.col("quant"), F.col("version"), ivf_kind="IVF", ivf_name="Lists"
    )
    return runs.select("event_id", shown.alias("name"), pg_index_name(F.col("kind")).alias("pg_name"))


@query("SF2_parsed_names", f"""
SELECT p_partkey, trim(split_part(dataset, '(', 1)) AS base, {_COUNT_SQL} AS n,
       {_PARSED.format(3)}::BIGINT AS d, {_COUNT_SQL} * {_PARSED.format(3)}::BIGINT * 4 AS bytes,
       trim(split_part(dataset, '(', 1)) || chr(10) || '(n=' || {_PARSED.format(1)} || {_PARSED.format(2)} || ', d=' ||
       {_PARSED.format(3)} || ', ' || format('{{:.2f}}', {_COUNT_SQL} * {_PARSED.format(3)}::BIGINT * 4 / 1073741824.0::DOUBLE) || ' GiB)' AS label
FROM ({_INDEXES_SQL})
""")
def parsed_names(spark, sf):
    p = parse_dataset(F.col("dataset"))
    return _indexes(spark, sf).select(
        "p_partkey", p["base"].alias("base"), p["n"].alias("n"), p["d"].alias("d"),
        p["bytes"].alias("bytes"), dataset_label(F.col("dataset")).alias("label"),
    )


def _format_sql(value: str, decimals: int) -> str:
    cases = [f"WHEN abs({value}) < 1024 THEN format('{{:.0f}} B', {value})"]
    for power, unit in enumerate(["KiB", "MiB", "GiB", "TiB"], start=1):
        scaled = f"({value} / pow(1024, {power}))"
        cases.append(f"WHEN abs({scaled}) < 1024 THEN format('{{:.{decimals}f}} {unit}', {scaled})")
    return f"CASE {' '.join(cases)} ELSE format('{{:.{decimals}f}} PiB', {value} / pow(1024, 5)) END"


@query("SF3_formatted_bytes", f"""
SELECT {LINE_ID_SQL} AS id, {_format_sql("b", 2)} AS shown, {_format_sql("b", 0)} AS short
FROM (SELECT *, (l_partkey * 1000003 * pow(17, l_linenumber) + l_suppkey)::BIGINT::DOUBLE AS b FROM lineitem)
""")
def formatted(spark, sf):
    """Sizes are doubles, all of them whole numbers: those of many parts are beyond 64 bits."""
    size = F.col("l_partkey") * 1000003 * F.pow(F.lit(17.0), "l_linenumber") + F.col("l_suppkey")
    return table(spark, sf, "lineitem").select(
        line_id().alias("id"), format_bytes(size).alias("shown"), format_bytes(size, 0).alias("short")
    )


@query("SF4_renamed_variants", """
SELECT event_id, CASE WHEN name LIKE '%, U8)' OR name LIKE '%, F32)'
    THEN regexp_replace(name, ', (U8|F32)\\)$', ')') ELSE name END AS plain,
  CASE WHEN build = 'b1' THEN replace(name, '(IVF, Global,', '(IVF, Global 256/cl,') ELSE name END AS variant
FROM (SELECT event_id, 'Lists (IVF, ' || CASE WHEN user_id % 2 = 0 THEN 'Global' ELSE 'Row Group' END || ', ' ||
        CASE WHEN event_id % 2 = 0 THEN 'U8' ELSE 'F32' END || ')' AS name, 'b' || (user_id % 3) AS build FROM events)
""")
def variants(spark, sf):
    user, event = F.col("user_id"), F.col("event_id")
    name = F.concat(
        F.lit("Lists (IVF, "), F.when(user % 2 == 0, "Global").otherwise("Row Group"), F.lit(", "),
        F.when(event % 2 == 0, "U8").otherwise("F32"), F.lit(")"),
    )
    runs = table(spark, sf, "events").select("event_id", name.alias("name"), F.concat(F.lit("b"), user % 3).alias("build"))
    return runs.select(
        "event_id", strip_quantisation(F.col("name")).alias("plain"),
        variant_name(F.col("name"), F.col("build"), "b1", "Global 256/cl").alias("variant"),
    )


@query("SF5_label_fields", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN json_extract_string(props, '$.k') END AS k,
       json_extract_string(props, '$.absent') AS absent FROM events
""")
def label_fields(spark, sf):
    text = F.when(F.col("event_id") % 2 == 0, F.col("props"))
    return table(spark, sf, "events").select(
        "event_id", label_field(text, "k").alias("k"), label_field(F.col("props"), "absent").alias("absent")
    )


@query("SF6_fallback_fields", """
SELECT event_id, CASE WHEN a IS NOT NULL THEN a WHEN b THEN 'sorted_by_update_date' ELSE 'original' END AS row_order,
       coalesce(a, c, 'randomly_shuffled') AS shuffled_order, coalesce(nullif(d, ''), c) AS filter_type
FROM (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS a, event_id % 2 = 0 AS b,
             CASE WHEN event_id % 5 = 0 THEN 'legacy' END AS c,
             CASE WHEN event_id % 7 = 0 THEN '' WHEN event_id % 7 < 4 THEN 'R' END AS d FROM events)
""")
def fallbacks(spark, sf):
    e = F.col("event_id")
    runs = table(spark, sf, "events").select(
        "event_id", F.when(e % 3 == 0, F.col("event_type")).alias("a"), (e % 2 == 0).alias("b"),
        F.when(e % 5 == 0, "legacy").alias("c"), F.when(e % 7 == 0, "").when(e % 7 < 4, "R").alias("d"),
    )
    return runs.select(
        "event_id", dataset_order(F.col("a"), F.col("b")).alias("row_order"),
        dataset_order_shuffled(F.col("a"), F.col("c")).alias("shuffled_order"),
        filter_type(F.col("d"), F.col("c")).alias("filter_type"),
    )


@query("SF7_short_labels", f"""
WITH d AS (SELECT DISTINCT dataset FROM ({_INDEXES_SQL})),
b AS (SELECT dataset, trim(split_part(dataset, '(', 1)) AS base, {_PARSED.format(1)} || {_PARSED.format(2)} AS tag FROM d),
s AS (SELECT dataset, CASE WHEN count(*) OVER (PARTITION BY base) > 1 THEN base || tag ELSE base END AS short FROM b)
SELECT i.p_partkey, s.short, replace(replace('DuckDB ' || element || ' (IVF, Global)', 'DuckDB ', ''), '(IVF, ', '(') AS system
FROM ({_INDEXES_SQL}) i JOIN s USING (dataset)
""")
def short_labels(spark, sf):
    shown = short_dataset_labels(_indexes(spark, sf))
    system = F.concat(F.lit("DuckDB "), "element", F.lit(" (IVF, Global)"))
    return shown.select("p_partkey", "short", short_system_label(system).alias("system"))


@query("SF8_task_tags", """
SELECT event_id, event_type AS tool, CASE WHEN event_id % 4 <> 0 THEN 'case_' || user_id END AS case_name,
       strftime(ts, '%H-%M-%S') AS time FROM events
""")
def tags(spark, sf):
    case = F.when(F.col("event_id") % 4 != 0, F.concat(F.lit("case_"), "user_id"))
    label = F.concat_ws("_", "event_type", case, F.date_format("ts", "HH-mm-ss"))
    found = table(spark, sf, "events").select("event_id", task_tags(label).alias("t"))
    return found.select("event_id", "t.tool", F.col("t.case").alias("case_name"), "t.time")


def _profiles(spark, sf):
    """A profile tree per event: projection over top-k over an index scan, or two scans."""
    def node(name, timing, *children):
        kids = F.array(*children) if children else F.array()
        return F.struct(F.lit(name).alias("operator_name"), timing.alias("operator_timing"), kids.alias("children"))

    v, few = F.col("value"), (F.col("event_id") % 10) / 100
    phases = [
        (v / 10).alias("latency"), (v / 100).alias("all_optimizers"), few.alias("planner"),
        (few / 2).alias("physical_planner"),
    ]
    nested = F.struct(
        *phases, F.lit(None).cast("string").alias("operator_name"), F.lit(0.0).alias("operator_timing"),
        F.array(node("PROJECTION", few, node("TOP_N", few / 4, node("INDEX_SCAN", v / 50)))).alias("children"),
    )
    flat = F.struct(
        *phases, F.lit("ROOT").alias("operator_name"), F.lit(0.5).alias("operator_timing"),
        F.array(node("SEQ_SCAN ", v / 200), node("INDEX_FILTER_SCAN", v / 70)).alias("children"),
    )
    text = F.when(F.col("event_id") % 2 == 0, F.to_json(flat)).otherwise(F.to_json(nested))
    events = table(spark, sf, "events").select("event_id", text.alias("profile"))
    # Stands for a folder of many profile files.
    return events.repartition(spark.sparkContext.defaultParallelism, "event_id")


@query("SF10_profile_rollup", """
WITH l AS (SELECT event_id, event_id % 2 = 0 AS flat, value AS v, (event_id % 10) / 100::DOUBLE AS few FROM events)
SELECT event_id, CASE WHEN flat THEN 3 ELSE 4 END::BIGINT AS nodes,
       round(CASE WHEN flat THEN v / 70 ELSE v / 50 END, 6) AS index_scan,
       round(CASE WHEN flat THEN v / 200 END, 6) AS sequential_scan,
       round(CASE WHEN flat THEN 0.5::DOUBLE ELSE few + few / 4 END, 6) AS other_operators,
       round(v / 100 + few + few / 2, 6) AS planning,
       round(greatest(0, v / 10 - (v / 100 + few + few / 2)
             - CASE WHEN flat THEN 0.5::DOUBLE + v / 200 ELSE few + few / 4 END), 6) AS index_scan_residual
FROM l
""")
def profiles(spark, sf):
    found = profile_rollup(
        _profiles(spark, sf), "profile", ["event_id"], index_scans=["INDEX_SCAN", "INDEX_FILTER_SCAN"]
    )
    return rounded(
        found, "index_scan", "sequential_scan", "other_operators", "planning", "index_scan_residual"
    )


def _write_results(spark, sf):
    """Events as result files: a result per type and user, up to twenty users in a file."""
    events = table(spark, sf, "events")
    per_user = events.groupBy("event_type", "user_id").agg(
        F.avg("value").alias("mean"), F.count("*").alias("n"), F.min("event_id").alias("first")
    )
    user = F.col("user_id")
    result = F.struct(
        F.struct(F.col("mean").alias("optimize_duration"), (1 / F.col("n")).alias("recall")).alias("metrics"),
        F.struct(
            F.lit("DuckDB").alias("db"),
            F.struct(
                F.concat(F.lit('{"global_version": "'), user % 2, F.lit('"}')).alias("db_label"),
                F.when(user % 2 == 0, 1).otherwise(14).alias("duckdb_threads"),
            ).alias("db_config"),
            F.struct(F.upper("event_type").alias("index"), F.lit("f32").alias("index_quantization_type"))
            .alias("db_case_config"),
            F.struct((user % 25).alias("case_id"), F.lit(100).alias("k")).alias("case_config"),
        ).alias("task_config"),
    )
    part = F.floor(user / 20).alias("part")
    files = per_user.select("event_type", part, result.alias("r"), "first").groupBy("event_type", "part").agg(
        F.sort_array(F.collect_list(F.struct("first", "r"))).alias("rs")
    )
    path = scratch_path(spark, "results")
    doc = files.select(
        F.concat_ws("-", "event_type", "part").alias("run"),
        F.concat_ws("-", "event_type", "part").alias("run_id"),
        F.concat("event_type", F.lit("_case_10-20-30")).alias("task_label"),
        F.transform("rs", lambda r: r["r"]).alias("results"), F.lit(1.5).alias("timestamp"),
    )
    doc.write.partitionBy("run").json(path)
    return path


@query("SC7_read_results", """
SELECT event_type || '-' || (user_id // 20) AS run_id, event_type || '_case_10-20-30' AS task_label, upper(event_type) AS index_kind, user_id % 25 AS case_id,
       CASE WHEN user_id % 2 = 0 THEN 1 ELSE 14 END AS threads, (user_id % 2)::VARCHAR AS global_version,
       round(avg(value), 6) AS optimize_duration, round(1 / count(*)::DOUBLE, 6) AS recall
FROM events GROUP BY event_type, user_id
""")
def results(spark, sf):
    path = _write_results(spark, sf)
    flat = readers.flatten_results(readers.read_results(spark, path, path + "-absent"))
    return rounded(
        flat.select(
            "run_id", "task_label", "index_kind", "case_id", "threads",
            label_field(F.col("db_label"), "global_version").alias("global_version"),
            "optimize_duration", "recall",
        ), "optimize_duration", "recall",
    )


# Queries a result holds, a multiple of the ten selectivities that they go through, and users a file.
_RESULT_QUERIES = 1000
_FILE_USERS = 200

_PER_QUERY_SQL = f"""
SELECT *, {bucket_sql("(query % 10) / 10.0::DOUBLE", ARXIV_BOUNDS)} AS bucket FROM (
  SELECT upper(event_type) AS run, event_id, value / 1000 AS latency, (event_id % 11) / 10::DOUBLE AS recall,
         row_number() OVER (PARTITION BY event_type, user_id ORDER BY event_id) - 1 AS query FROM events)
"""


@query("AG18_from_result_files", f"""
WITH p AS ({_PER_QUERY_SQL}), x AS ({bootstrap_sql("SELECT * FROM p WHERE bucket >= 0", "run, bucket", True, REPLICATES)}),
r AS (SELECT run, bucket, avg(recall) AS recall, count(*) AS queries FROM p GROUP BY run, bucket)
SELECT run, bucket, round(coalesce(recall, 0), 6) AS recall, coalesce(queries, 0) AS queries, coalesce(estimate, 0) AS qps,
       coalesce(lower_err, 0) AS lower_err, coalesce(upper_err, 0) AS upper_err
FROM (SELECT DISTINCT run FROM p) CROSS JOIN (SELECT unnest([0, 1, 2, 3])::INTEGER AS bucket)
LEFT JOIN r USING (run, bucket) LEFT JOIN x USING (run, bucket)
""")
def from_result_files(spark, sf):
    """From the arrays of result files to recall and throughput per run and selectivity bucket.

    A user's events are cut into results of ``_RESULT_QUERIES``, and a file has one such block of
    ``_FILE_USERS`` users, so that neither grows with the table or with a user.
    """
    events = table(spark, sf, "events").select("event_type", "user_id", "event_id", "value")
    numbered = number_rows(events, ["event_type", "user_id", "event_id"])
    first = numbered.groupBy("event_type", "user_id").agg(F.min("idx").alias("first"))
    blocks = numbered.join(first, ["event_type", "user_id"]).select(
        "event_type", "user_id", block_of(F.col("idx") - F.col("first"), _RESULT_QUERIES).alias("block"),
        F.struct("event_id", "value").alias("e"),
    )
    lists = blocks.groupBy("event_type", "user_id", "block").agg(F.array_sort(F.collect_list("e")).alias("es"))
    metrics = F.struct(
        F.transform("es", lambda e: e["value"] / 1000).alias("serial_latencies"),
        F.transform("es", lambda e: (e["event_id"] % 11) / 10).alias("recalls"),
    )
    task = F.struct(
        F.struct(F.upper("event_type").alias("index")).alias("db_case_config"),
        F.struct((F.col("block") * F.lit(1 << 32) + F.col("user_id")).alias("case_id")).alias("case_config"),
    )
    result = F.struct(metrics.alias("metrics"), task.alias("task_config"))
    name = F.concat_ws("-", "event_type", F.floor(F.col("user_id") / _FILE_USERS), "block")
    path = scratch_path(spark, "query-results")
    lists.select(name.alias("run_id"), result.alias("r")).groupBy("run_id").agg(
        F.collect_list("r").alias("results")
    ).withColumn("run", F.col("run_id")).write.partitionBy("run").json(path)
    flat = readers.flatten_results(readers.read_results(spark, path))
    rows = readers.per_query(flat, ["index_kind", "case_id"]).select(
        F.col("index_kind").alias("run"), "latency", "recall", F.concat_ws(":", "index_kind", "case_id", "query").alias("id"),
        assign_bucket((F.col("query") % 10) / 10, ARXIV_BOUNDS).alias("bucket"),
    )
    found = bucket_recalls(rows, ["run"], ARXIV_BOUNDS).join(
        bucket_qps(rows, ["run"], ARXIV_BOUNDS, "latency", "id", replicates=REPLICATES), ["run", "bucket"]
    )
    return rounded(found, "recall", "qps", "lower_err", "upper_err")


@query("SC8_read_summary", """
SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS avg_latency, round(avg(l_discount), 6) AS avg_recall
FROM lineitem GROUP BY ALL
""")
def summary(spark, sf):
    found = run_means(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], ["l_quantity", "l_discount"])
    named = found.withColumnsRenamed({"avg_l_quantity": "avg_latency", "avg_l_discount": "avg_recall"})
    path = scratch_path(spark, "summary")
    writers.write_csv(named, path)
    needed = ["avg_latency", "avg_recall"]
    read = readers.numbers(readers.read_summary_csv(spark, path, needed), needed)
    return rounded(read.drop("num_queries_run"), *needed)


@query("SK8_per_query_csv", f"SELECT {LINE_ID_SQL} AS query_idx, round(l_quantity, 6) AS latency, l_returnflag AS run FROM lineitem")
def per_query_csv(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        line_id().alias("query_idx"), F.col("l_quantity").alias("latency"), F.col("l_returnflag").alias("run")
    )
    path = scratch_path(spark, "queries")
    writers.write_csv(rows, path)
    read = readers.read_summary_csv(spark, path, ["query_idx", "latency"])
    return rounded(readers.numbers(read, ["latency"]).withColumn("query_idx", F.col("query_idx").cast("long")), "latency")
