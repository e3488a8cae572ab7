"""Ids, samples, joins, ranges, layout, sources and checks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from nearfield.functions.hashing import shuffle_key
from nearfield.operators.knn import nearest, neighbour_lists
from nearfield.operators.layout import (
    file_index,
    file_report,
    layout_columns,
    shard_name,
    split_index,
    stored_size,
    subset_rows,
)
from nearfield.operators.numbering import (
    block_of,
    every_nth,
    id_mapping,
    number_rows,
    number_rows_total,
    reorder,
    reorder_randomly,
)
from nearfield.operators.quality import (
    array_length_is,
    bijection,
    differing_values,
    equal_counts,
    inexact_filters,
    unsorted_places,
    vector_report,
)
from nearfield.operators.ranges import (
    block_profile,
    eligible,
    matches_per_query,
    range_counts,
    selectivities,
    skippable_blocks,
)
from nearfield.operators.reduce import stack, unstack
from nearfield.operators.remap import inverse, remap_lists, remap_rows, zip_by_position
from nearfield.operators.sampling import (
    FILTERS_PER_RATE,
    PASS_RATES,
    draw_positions,
    head,
    range_filters,
    sample,
    sample_ids,
    shuffle_queries,
    split_queries,
    take_repeated,
    take_rows,
    without_rows,
)
from nearfield.plans.inputs import (
    BASE_SQL,
    DAY_RANGES_SQL,
    DIM,
    LINE_ID_SQL,
    ORDERS_SQL,
    QUERIES_SQL,
    base,
    day_ranges,
    knn_sql,
    line_id,
    orders,
    queries,
    table,
)
from nearfield.plans.registry import query
from nearfield.session import scratch_path, ship_package
from nearfield.sources import readers, writers

BLOCK = 1024
TO_DUCK_INT = "('0x' || substr(md5('{seed}:' || {col}), 1, 15))::BIGINT"


def draw_sql(seed: int, column: str, n: str) -> str:
    return f"({TO_DUCK_INT.format(seed=seed, col=column)} % ({n}))"


# --- projections, filters, predicates -------------------------------------------------------

@query("PF1_label_tables", f"""
WITH b AS ({BASE_SQL})
SELECT 'em' AS kind, id, label::VARCHAR AS value FROM b
UNION ALL SELECT 'r', id, attr::VARCHAR FROM b
UNION ALL SELECT 'emis', id, array_to_string(members, '|') FROM b
""")
def label_tables(spark, sf):
    """The three label tables of a wide table; only label columns are read."""
    wide = base(spark, sf)
    em = wide.select("id", F.col("label").cast("string").alias("value"))
    r = wide.select("id", F.col("attr").cast("string").alias("value"))
    emis = wide.select("id", F.array_join("members", "|").alias("value"))
    named = [t.select(F.lit(n).alias("kind"), "*") for n, t in (("em", em), ("r", r), ("emis", emis))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("PF2_replace_cast", """
SELECT * REPLACE (l_quantity::BIGINT AS l_quantity, l_linenumber::BIGINT AS l_linenumber)
FROM (SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem)
""")
def replace_cast(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return lines.withColumns({
        "l_quantity": F.col("l_quantity").cast("long"),
        "l_linenumber": F.col("l_linenumber").cast("long"),
    })


@query("PF3_replace_id", f"""
SELECT row_number() OVER (ORDER BY vec_id DESC) - 1 AS id, round(list_sum(embedding::DOUBLE[]), 4) AS emb_sum
FROM embeddings
""")
def replace_id(spark, sf):
    rows = base(spark, sf).withColumn("helper", -F.col("id"))
    renumbered = reorder(rows, ["helper"]).drop("helper", "original_id").select("id", "emb")
    total = F.aggregate(F.col("emb").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return renumbered.select("id", F.round(total, 4).alias("emb_sum"))


@query("PF4_equality_predicate", f"""
WITH q AS ({QUERIES_SQL}), b AS ({BASE_SQL})
SELECT q.qid, count(b.id) AS n FROM q LEFT JOIN b ON b.label = q.label GROUP BY q.qid
""")
def equality_predicate(spark, sf):
    return matches_per_query(queries(spark, sf), base(spark, sf).select("label"), "label")


@query("PF4_unmatched_queries", f"""
WITH q AS ({QUERIES_SQL}), b AS ({BASE_SQL})
SELECT q.qid, count(b.id) AS n FROM q LEFT JOIN b ON b.label = q.label + 3 AND b.label < 8 GROUP BY q.qid
""")
def unmatched_queries(spark, sf):
    """Some queries ask for a label that no row has; they match 0 rows."""
    asked = queries(spark, sf).withColumn("label", F.col("label") + 3)
    return matches_per_query(asked, base(spark, sf).where("label < 8").select("label"), "label")


@query("PF5_range_predicate", f"""
WITH q AS ({QUERIES_SQL}), b AS ({BASE_SQL})
SELECT q.qid, count(b.id) AS n FROM q LEFT JOIN b ON b.attr BETWEEN q.range_start AND q.range_end
GROUP BY q.qid
""")
def range_predicate(spark, sf):
    counts = range_counts(base(spark, sf).select("attr"), "attr", queries(spark, sf))
    return counts.withColumnRenamed("count", "n")


@query("JN11_fractional_values", f"""
SELECT q.qid, count(p.v) AS count FROM ({DAY_RANGES_SQL}) q
LEFT JOIN (SELECT 8000 + o_totalprice / 100 AS v FROM orders) p ON p.v BETWEEN q.range_start AND q.range_end
GROUP BY q.qid
""")
def fractional_values(spark, sf):
    """Fractions against ranges with integer ends."""
    values = table(spark, sf, "orders").select((8000 + F.col("o_totalprice") / 100).alias("v"))
    return range_counts(values, "v", day_ranges(spark, sf))


@query("PF6_member_predicate", f"""
WITH q AS ({QUERIES_SQL}), b AS ({BASE_SQL})
SELECT q.qid, count(b.id) AS n FROM q LEFT JOIN b ON list_contains(b.members, q.member) GROUP BY q.qid
""")
def member_predicate(spark, sf):
    members = base(spark, sf).select(F.explode(F.array_distinct("members")).alias("member"))
    return matches_per_query(queries(spark, sf), members, "member")


@query("PF7_filter_rate", """
SELECT rate, count(*) AS passing
FROM (SELECT unnest([0.01, 0.1, 0.5, 0.9, 0.99]::DOUBLE[]) AS rate)
JOIN orders ON o_orderkey >= floor(rate * (SELECT count(*) FROM orders)) GROUP BY rate
""")
def filter_rate(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey")
    total = rows.count()
    rates = [0.01, 0.1, 0.5, 0.9, 0.99]
    passing = [
        F.count_if(F.col("o_orderkey") >= F.floor(F.lit(r) * total)).alias(f"r{i}")
        for i, r in enumerate(rates)
    ]
    counts = F.explode(F.array(*[
        F.struct(F.lit(r).alias("rate"), F.col(f"r{i}").alias("passing"))
        for i, r in enumerate(rates)
    ]))
    return rows.agg(*passing).select(counts.alias("c")).select("c.rate", "c.passing")


_SELECTIVITY_SQL = f"""
SELECT q.qid, q.range_start, q.range_end, count(o.id) AS count,
       count(o.id) / (SELECT count(*) FROM orders)::DOUBLE AS selectivity
FROM ({DAY_RANGES_SQL}) q LEFT JOIN ({ORDERS_SQL}) o ON o.day BETWEEN q.range_start AND q.range_end
GROUP BY ALL
"""


@query("PF8_selectivity_window", f"""
SELECT qid, round(selectivity, 6) AS selectivity FROM ({_SELECTIVITY_SQL})
WHERE selectivity BETWEEN 0.02 AND 0.1
""")
def selectivity_window(spark, sf):
    report = selectivities(orders(spark, sf), "day", day_ranges(spark, sf))
    return eligible(report, 0.02, 0.1).select("qid", F.round("selectivity", 6).alias("selectivity"))


@query("PF9_first_queries", "SELECT c_custkey AS qid FROM customer ORDER BY 1 LIMIT 1000")
def first_queries(spark, sf):
    """The cap is the feature: a run uses the first M queries in id order."""
    return day_ranges(spark, sf).select("qid").orderBy("qid").limit(1000)


@query("PF11_thinned_rows", f"""
WITH n AS (SELECT day, row_number() OVER (ORDER BY id) - 1 AS idx FROM ({ORDERS_SQL}))
SELECT idx, day FROM n
WHERE idx % greatest(1, ((SELECT count(*) FROM orders) // 2000)) = 0
""")
def thinned(spark, sf):
    numbered, total = number_rows_total(orders(spark, sf), ["id"])
    return every_nth(numbered, total, 2000).select("idx", "day")


# --- joins ----------------------------------------------------------------------------------

@query("JN1_labels_left", """
SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def labels_left(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    labels = table(spark, sf, "labels")
    joined = docs.join(labels, "doc_id", "left")
    # a label table that repeats an id would multiply rows
    if labels.groupBy("doc_id").count().where("count > 1").isEmpty():
        return joined
    raise ValueError("labels repeat an id: the join would change the number of rows")


@query("JN2_labels_inner", """
SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id)
""")
def labels_inner(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return docs.join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query("JN3_scalar_lookup", """
SELECT o_orderkey, (SELECT c_nationkey FROM customer WHERE c_custkey = o_custkey) AS nation FROM orders
""")
def scalar_lookup(spark, sf):
    found = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("nation")
    )
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(
        found, "o_custkey", "left"
    ).select("o_orderkey", "nation")


_SAMPLE_SQL = """
SELECT original_id, row_number() OVER (ORDER BY original_id) - 1 AS id FROM (
  SELECT o_orderkey AS original_id, row_number() OVER (ORDER BY md5('42:' || o_orderkey), o_orderkey) AS r
  FROM orders) WHERE r <= 500
"""


@query("JN4_drop_query_rows", f"""
SELECT id, day FROM ({ORDERS_SQL}) WHERE id NOT IN (SELECT original_id FROM ({_SAMPLE_SQL}))
""")
def drop_query_rows(spark, sf):
    rows = orders(spark, sf)
    return without_rows(rows, sample_ids(rows, 500, 42))


@query("JN5_take_rows", f"""
SELECT id, day FROM ({ORDERS_SQL}) WHERE id IN (SELECT original_id FROM ({_SAMPLE_SQL}))
""")
def take(spark, sf):
    rows = orders(spark, sf)
    return take_rows(rows, sample_ids(rows, 500, 42).select(F.col("original_id").alias("id")))


@query("JN6_take_repeated", f"""
WITH s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings),
r AS (SELECT o_orderkey AS qid, {draw_sql(7, "o_orderkey", "SELECT count(*) FROM embeddings")} AS place FROM orders)
SELECT qid, vec_id FROM r JOIN s USING (place)
""")
def repeated(spark, sf):
    source = table(spark, sf, "embeddings").select("vec_id")
    asked = draw_positions(orders(spark, sf).select(F.col("id").alias("qid")), source.count(), 7)
    return take_repeated(asked, source, "at", ["vec_id"]).select("qid", "vec_id")


@query("JN7_zip_by_position", """
WITH a AS (SELECT o_orderkey AS a, row_number() OVER (ORDER BY o_orderkey) - 1 AS i FROM orders),
b AS (SELECT o_custkey AS b, row_number() OVER (ORDER BY md5('3:' || o_orderkey), o_orderkey) - 1 AS i FROM orders)
SELECT i AS qid, a, b FROM a JOIN b USING (i)
""")
def zipped(spark, sf):
    rows = table(spark, sf, "orders")
    left = rows.select(F.col("o_orderkey").alias("a"))
    right = rows.select(
        F.struct(shuffle_key(3, F.col("o_orderkey")).alias("h"), "o_orderkey").alias("key"),
        F.col("o_custkey").alias("b"),
    )
    return zip_by_position(left, right, "a", "key").select("qid", "a", "b")


_BY_DAY_SQL = f"""
SELECT id AS old_id, row_number() OVER (ORDER BY day, id) - 1 AS new_id FROM ({ORDERS_SQL})
"""


def _mapping(spark, sf):
    return id_mapping(orders(spark, sf), ["day"])


@query("JN8_remap_rows", f"""
WITH m AS ({_BY_DAY_SQL}) SELECT m.new_id AS id, o.day FROM ({ORDERS_SQL}) o JOIN m ON m.old_id = o.id
""")
def remapped_rows(spark, sf):
    return remap_rows(orders(spark, sf), _mapping(spark, sf)).sort("id")


_VEC_MAP_SQL = """
SELECT vec_id AS old_id, row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) - 1 AS new_id FROM embeddings
"""


def _vec_map(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"))
    return id_mapping(rows, [shuffle_key(42, F.col("id"))])


@query("JN9_remap_lists", f"""
WITH q AS ({QUERIES_SQL}), b AS ({BASE_SQL}), r AS ({knn_sql(5)}), m AS ({_VEC_MAP_SQL})
SELECT r.qid AS id, r.rank - 1 AS pos, m.new_id AS neighbor FROM r JOIN m ON m.old_id = r.id
""")
def remapped_lists(spark, sf):
    asked = queries(spark, sf)
    lists = neighbour_lists(asked, nearest(asked, base(spark, sf), 5))
    moved = remap_lists(lists, _vec_map(spark, sf))
    return moved.select("id", F.posexplode("neighbors_id").alias("pos", "neighbor")).withColumn(
        "pos", F.col("pos").cast("long")
    )


@query("JN9_remap_and_back", f"""
WITH q AS ({QUERIES_SQL}), b AS ({BASE_SQL}), r AS ({knn_sql(5)})
SELECT qid AS id, string_agg(id::VARCHAR, ',' ORDER BY rank) AS neighbors FROM r GROUP BY qid
""")
def remapped_and_back(spark, sf):
    asked = queries(spark, sf)
    lists = neighbour_lists(asked, nearest(asked, base(spark, sf), 5))
    there = _vec_map(spark, sf)
    back = remap_lists(remap_lists(lists, there), inverse(there))
    return back.select(
        "id", F.array_join(F.col("neighbors_id").cast("array<string>"), ",").alias("neighbors")
    )


@query("JN11_range_counts", f"SELECT qid, count FROM ({_SELECTIVITY_SQL})")
def counted_ranges(spark, sf):
    return range_counts(orders(spark, sf), "day", day_ranges(spark, sf))


# --- numbering and order --------------------------------------------------------------------

@query("W1_contiguous_ids", f"""
SELECT {LINE_ID_SQL} AS line, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) - 1 AS idx
FROM lineitem
""")
def contiguous_ids(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        line_id().alias("line"), "l_shipdate", "l_orderkey", "l_linenumber"
    )
    return number_rows(lines, ["l_shipdate", "l_orderkey", "l_linenumber"]).select("line", "idx")


@query("W2_reorder_by_day", f"""
SELECT row_number() OVER (ORDER BY day, id) - 1 AS id, id AS original_id, day FROM ({ORDERS_SQL})
""")
def reordered(spark, sf):
    return reorder(orders(spark, sf), ["day"])


@query("W3_shuffled", f"""
SELECT row_number() OVER (ORDER BY md5('42:' || id), id) - 1 AS id, id AS original_id, day FROM ({ORDERS_SQL})
""")
def shuffled(spark, sf):
    return reorder_randomly(orders(spark, sf), 42)


@query("W4_inverse_permutation", _BY_DAY_SQL)
def inverse_permutation(spark, sf):
    return _mapping(spark, sf)


@query("W6_blocks", f"""
WITH n AS (SELECT row_number() OVER (ORDER BY id) - 1 AS idx FROM ({ORDERS_SQL}))
SELECT idx // {BLOCK} AS block, min(idx) AS first, max(idx) AS last FROM n GROUP BY 1
""")
def blocks(spark, sf):
    numbered = number_rows(orders(spark, sf), ["id"])
    return numbered.groupBy(block_of(F.col("idx"), BLOCK).alias("block")).agg(
        F.min("idx").alias("first"), F.max("idx").alias("last")
    )


_ORDERS_OF_ROWS = {
    "original": "id", "sorted": "day, id", "shuffled": "md5('42:' || id), id",
}


def _by_order(spark, sf, name):
    rows = orders(spark, sf)
    keys = {"original": [], "sorted": ["day"], "shuffled": [shuffle_key(42, F.col("id"))]}[name]
    return number_rows(rows, [*keys, "id"])


@query("W7_block_profile", f"""
WITH n AS ({" UNION ALL ".join(
    f"SELECT '{name}' AS row_order, day, row_number() OVER (ORDER BY {keys}) - 1 AS idx FROM ({ORDERS_SQL})"
    for name, keys in _ORDERS_OF_ROWS.items())})
SELECT row_order, idx // {BLOCK} AS block, count(*) AS rows, min(day) AS low, max(day) AS high
FROM n GROUP BY 1, 2
""")
def block_profiles(spark, sf):
    parts = [
        block_profile(_by_order(spark, sf, name), "day", BLOCK).withColumn("row_order", F.lit(name))
        for name in _ORDERS_OF_ROWS
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("W7_skippable_blocks", f"""
WITH n AS (SELECT day, row_number() OVER (ORDER BY day, id) - 1 AS idx FROM ({ORDERS_SQL})),
blk AS (SELECT idx // {BLOCK} AS block, min(day) AS low, max(day) AS high FROM n GROUP BY 1)
SELECT q.qid, count(*) FILTER (high < range_start OR low > range_end) AS skipped,
       round(count(*) FILTER (high < range_start OR low > range_end) / count(*)::DOUBLE, 6) AS skip_share
FROM ({DAY_RANGES_SQL}) q, blk GROUP BY q.qid
""")
def skippable(spark, sf):
    profile = block_profile(_by_order(spark, sf, "sorted"), "day", BLOCK)
    found = skippable_blocks(profile, day_ranges(spark, sf))
    return found.withColumn("skip_share", F.round("skip_share", 6))


# --- sampling and generation ----------------------------------------------------------------

@query("SG1_sample", f"SELECT s.id, s.original_id, o.day FROM ({_SAMPLE_SQL}) s JOIN ({ORDERS_SQL}) o ON o.id = s.original_id")
def sampled(spark, sf):
    return sample(orders(spark, sf), 500, 42)


@query("SG2_sample_with_replacement", f"""
SELECT o_orderkey AS qid, {draw_sql(42, "o_orderkey", "SELECT count(*) FROM customer")} AS at FROM orders
""")
def sampled_with_replacement(spark, sf):
    n = table(spark, sf, "customer").count()
    return draw_positions(orders(spark, sf).select(F.col("id").alias("qid")), n, 42)


@query("SG3_head", f"""
SELECT row_number() OVER (ORDER BY day, id) - 1 AS id, id AS order_id FROM ({ORDERS_SQL})
QUALIFY row_number() OVER (ORDER BY day, id) <= 2 * {BLOCK}
""")
def first_rows(spark, sf):
    rows = orders(spark, sf).withColumnRenamed("id", "order_id")
    return head(rows, ["day", "order_id"], 2 * BLOCK).select("id", "order_id")


def _filters_sql() -> str:
    return f"""
WITH t AS (SELECT count(*) AS n FROM orders),
rates AS (SELECT unnest({PASS_RATES}::DOUBLE[]) AS selectivity, unnest(range({len(PASS_RATES)})) AS r),
f AS (SELECT r * {FILTERS_PER_RATE} + j AS qid, selectivity,
        greatest(1, least(n, round_even(selectivity * n, 0)::BIGINT)) AS target_count, n
      FROM rates, t, range({FILTERS_PER_RATE}) g(j)),
d AS (SELECT *, {draw_sql(42, "qid", "n - target_count + 1")} AS first FROM f),
o AS (SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders)
SELECT d.qid, a.id AS range_start, b.id AS range_end, d.target_count, d.selectivity
FROM d JOIN o a ON a.place = d.first JOIN o b ON b.place = d.first + d.target_count - 1
"""


@query("SG4_range_filters", _filters_sql())
def generated_filters(spark, sf):
    return range_filters(orders(spark, sf), "id")


@query("SG5_shuffled_queries", f"""
WITH f AS ({_filters_sql()}),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS place FROM embeddings),
m AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || qid), qid) - 1 AS id,
             {draw_sql(43, "qid", "SELECT count(*) FROM embeddings")} AS place FROM f)
SELECT id, qid, range_start, range_end, vec_id AS source_id FROM m JOIN s USING (place)
""")
def shuffled_queries(spark, sf):
    vectors = base(spark, sf)
    filters = range_filters(orders(spark, sf), "id")
    mixed = shuffle_queries(filters, vectors, vectors.count())
    return mixed.select("id", "qid", "range_start", "range_end", "source_id")


@query("SG6_query_split", f"""
WITH s AS ({_SAMPLE_SQL})
SELECT 'query' AS side, id, original_id FROM s
UNION ALL SELECT 'base', id, id FROM ({ORDERS_SQL}) WHERE id NOT IN (SELECT original_id FROM s)
""")
def query_split(spark, sf):
    asked, rest = split_queries(orders(spark, sf), 500, 42)
    a = asked.select(F.lit("query").alias("side"), "id", "original_id")
    return a.unionByName(rest.select(F.lit("base").alias("side"), "id", F.col("id").alias("original_id")))


# --- set operations -------------------------------------------------------------------------

def _write_shards(spark, sf, prefix="train"):
    """Embeddings as four numbered shards in a fresh folder."""
    folder = scratch_path(spark, "shards")
    rows = base(spark, sf).select("id", "emb")
    numbered, total = number_rows_total(rows, ["id"])
    per = -(-total // 4)
    for shard in range(4):
        part = numbered.where(F.floor(F.col("idx") / per) == shard).drop("idx").sort("id")
        part.write.parquet(f"{folder}/{prefix}-{shard:02d}-of-4.parquet")
    return folder


@query("ST1_concatenated_shards", """
SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) - 1 AS position FROM embeddings
""")
def concatenated(spark, sf):
    return readers.read_shards(spark, _write_shards(spark, sf, "shuffle_train")).select("id", "position")


@query("ST2_stack_and_split", f"""
SELECT side, count(*) AS rows, sum(id)::BIGINT AS ids FROM (
  SELECT 'base' AS side, vec_id AS id FROM embeddings
  UNION ALL SELECT 'query', vec_id FROM embeddings) GROUP BY side
""")
def stacked(spark, sf):
    rows, asked = unstack(stack(base(spark, sf), queries(spark, sf)))
    parts = rows.select(F.lit("base").alias("side"), "id").unionByName(
        asked.select(F.lit("query").alias("side"), F.col("qid").alias("id"))
    )
    return parts.groupBy("side").agg(F.count("*").alias("rows"), F.sum("id").alias("ids"))


@query("ST3_array_intersection", f"""
WITH q AS ({QUERIES_SQL}), b AS ({BASE_SQL}), r AS ({knn_sql(10)}),
e AS ({knn_sql(10, "b.label = q.label")})
SELECT r.qid, count(e.id) AS common FROM r LEFT JOIN e ON e.qid = r.qid AND e.id = r.id GROUP BY r.qid
""")
def intersected(spark, sf):
    asked, rows = queries(spark, sf), base(spark, sf)
    a = neighbour_lists(asked, nearest(asked, rows, 10))
    b = neighbour_lists(asked, nearest(asked, rows, 10, key="label"))
    both = a.join(b.select("id", F.col("neighbors_id").alias("other")), "id")
    common = F.size(F.array_intersect("neighbors_id", "other")).cast("long")
    return both.select(F.col("id").alias("qid"), common.alias("common"))


@query("ST4_ordered_union", """
WITH items AS (
  SELECT l_orderkey, min(l_linenumber) AS first_seen, l_suppkey % 7 AS item
  FROM lineitem GROUP BY ALL),
lists AS (SELECT l_orderkey, string_agg(item::VARCHAR, ',' ORDER BY first_seen, item) AS items FROM items GROUP BY 1)
SELECT * FROM lists
""")
def ordered_union(spark, sf):
    """Suppliers of an order, first and second half of its lines, first occurrence wins."""
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_suppkey") % 7).alias("item")
    )

    def half(low: bool):
        chosen = (F.col("l_linenumber") <= 3) == F.lit(low)
        pairs = F.collect_list(F.when(chosen, F.struct("l_linenumber", "item")))
        return F.transform(F.array_sort(pairs), lambda p: p["item"])

    both = lines.groupBy("l_orderkey").agg(half(True).alias("a"), half(False).alias("b"))
    union = F.array_distinct(F.concat("a", "b"))
    return both.select("l_orderkey", F.array_join(union.cast("array<string>"), ",").alias("items"))


# --- sources --------------------------------------------------------------------------------

@query("SC1_read_vectors", """
SELECT vec_id AS id, len(embedding) AS dim, round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings
""")
def vectors_read(spark, sf):
    rows = readers.read_vectors(spark, f"{sf}/embeddings.parquet", "vec_id", "embedding")
    total = F.aggregate(F.col("emb").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return rows.select("id", F.size("emb").cast("long").alias("dim"), F.round(total, 4).alias("total"))


@query("SC2_read_shards", """
SELECT vec_id AS id, i // ((n + 3) // 4) AS shard_no, i AS position FROM (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings)
""")
def shards_read(spark, sf):
    rows = readers.read_shards(spark, _write_shards(spark, sf))
    return rows.select("id", F.col("shard_no").cast("long").alias("shard_no"), "position")


@query("SC3_ordered_json_lines", """
SELECT row_number() OVER (ORDER BY event_id) - 1 AS line, event_id, event_type, round(value, 6) AS value FROM events
""")
def json_lines(spark, sf):
    path = scratch_path(spark, "jsonl")
    events = table(spark, sf, "events").select("event_id", "event_type", "value").sort("event_id")
    events.select(F.to_json(F.struct("*"))).write.text(path)
    rows = readers.read_jsonl_ordered(spark, path, "event_id long, event_type string, value double")
    return rows.withColumn("value", F.round("value", 6))


@query("SC4_read_neighbour_map", f"""
WITH q AS ({QUERIES_SQL}), b AS ({BASE_SQL}), r AS ({knn_sql(5)})
SELECT qid AS id, rank - 1 AS pos, id AS neighbor FROM r
""")
def neighbour_map(spark, sf):
    asked = queries(spark, sf)
    lists = neighbour_lists(asked, nearest(asked, base(spark, sf), 5))
    path = scratch_path(spark, "neighbours")
    writers.write_neighbour_map(lists, path)
    rows = readers.read_neighbour_map(spark, path)
    return rows.select("id", F.posexplode("neighbors_id").alias("pos", "neighbor")).withColumn(
        "pos", F.col("pos").cast("long")
    )


def _write_fvecs(spark, sf):
    """The embeddings as little-endian records, one file per task, in id order."""
    from pyarrow.fs import FileSystem

    ship_package(spark)
    folder = scratch_path(spark, "fvecs")
    address = folder if "://" in folder else f"file://{folder}"
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    placed = rows.repartitionByRange("vec_id").sortWithinPartitions("vec_id")
    placed = placed.withColumn("part", F.spark_partition_id())

    def write(batches):
        stream, written = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if stream is None:
                store, root = FileSystem.from_uri(address)
                store.create_dir(root)
                stream = store.open_output_stream(f"{root}/part-{batch['part'][0].as_py():06d}.fvecs")
            values = batch["embedding"].flatten().to_numpy().reshape(batch.num_rows, -1)
            heads = np.full((len(values), 1), values.shape[1], "<i4").view("<f4")
            stream.write(np.hstack([heads, values.astype("<f4")]).tobytes())
            written += len(values)
        if stream is not None:
            stream.close()
        yield pa.RecordBatch.from_pydict({"n": pa.array([written], pa.int64())})

    total = placed.mapInArrow(write, "n long").agg(F.sum("n").alias("n")).first()["n"]
    return folder, total


_FVECS_SQL = """
SELECT row_number() OVER (ORDER BY vec_id) - 1 AS record, len(embedding) AS dim,
       round(list_sum(embedding::DOUBLE[]), 4) AS total FROM embeddings
"""


def _fvecs_report(rows):
    total = F.aggregate(F.col("emb").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return rows.select("record", F.size("emb").cast("long").alias("dim"), F.round(total, 4).alias("total"))


@query("SC5_read_fvecs", _FVECS_SQL)
def fvecs(spark, sf):
    folder, total = _write_fvecs(spark, sf)
    return _fvecs_report(readers.read_fvecs(spark, folder, DIM, total))


@query("SC6_read_fvecs_subset", f"""
SELECT * FROM ({_FVECS_SQL}) WHERE record IN (SELECT r FROM (
  SELECT vec_id AS r FROM embeddings ORDER BY md5('42:' || vec_id), vec_id LIMIT 100))
""")
def fvecs_subset(spark, sf):
    folder, total = _write_fvecs(spark, sf)
    wanted = sample_ids(table(spark, sf, "embeddings"), 100, 42, "vec_id").select(
        F.col("original_id").alias("record")
    )
    return _fvecs_report(readers.read_fvecs_subset(spark, folder, DIM, wanted, total))


@query("SC9_read_id_mapping", _BY_DAY_SQL)
def id_mapping_read(spark, sf):
    path = scratch_path(spark, "mapping")
    writers.write_id_mapping(_mapping(spark, sf), path)
    return readers.read_id_mapping(spark, path)


# --- sinks and layout -----------------------------------------------------------------------

GROUP = 4096


@query("SK1_row_groups", f"""
SELECT count(*) AS rows, least(count(*), {GROUP}) AS largest_group FROM lineitem
""")
def row_groups(spark, sf):
    """Row counts of the groups, read from the footers of the written files."""
    from pyarrow import parquet
    from pyarrow.fs import FileSystem

    path = scratch_path(spark, "groups")
    writers.write_vectors(
        table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), path, GROUP
    )
    files = spark.read.parquet(path).select(F.col("_metadata.file_path").alias("f")).distinct()

    def footers(batches):
        for batch in batches:
            sizes = []
            for name in batch["f"].to_pylist():
                store, place = FileSystem.from_uri(name)
                with store.open_input_file(place) as handle:
                    meta = parquet.ParquetFile(handle).metadata
                    sizes += [meta.row_group(i).num_rows for i in range(meta.num_row_groups)]
            yield pa.RecordBatch.from_pydict({"n": pa.array(sizes, pa.int64())})

    groups = files.mapInArrow(footers, "n long")
    return groups.agg(F.sum("n").alias("rows"), F.max("n").alias("largest_group"))


@query("SK2_layout", """
WITH t AS (SELECT p_partkey, 10000 * (p_partkey + 1) AS rows, floor(40 * p_retailprice)::BIGINT * 10000 * (p_partkey + 1) AS bytes FROM part),
f AS (SELECT *, greatest(1, floor(floor(5 * 1073741824::BIGINT * 0.9::DOUBLE / (bytes / rows::DOUBLE)) / 122880::DOUBLE)) AS g FROM t)
SELECT p_partkey, (g * 122880)::BIGINT AS rows_per_file, floor(rows / (g * 122880)::DOUBLE)::BIGINT AS full_files,
       (rows % (g * 122880)::BIGINT)::BIGINT AS remainder,
       ceil(rows / (g * 122880)::DOUBLE)::BIGINT AS files FROM f
""")
def layouts(spark, sf):
    key = F.col("p_partkey")
    parts = table(spark, sf, "part").select(
        "p_partkey", ((key + 1) * 10000).alias("rows"),
        (F.floor(F.col("p_retailprice") * 40) * 10000 * (key + 1)).alias("bytes"),
    )
    plan = layout_columns(F.col("bytes"), F.col("rows"), 5 * 1024**3, 0.9)
    return parts.withColumn("l", plan).select("p_partkey", "l.*")


@query("SK2_stored_size", "SELECT 1::BIGINT AS files, count(*) AS rows FROM lineitem")
def stored(spark, sf):
    return stored_size(table(spark, sf, "lineitem")).select("files", "rows")


@query("SK3_repack", f"""
SELECT (i // 5000)::INTEGER AS file_idx, count(*) AS rows, min(i) AS first, max(i) AS last FROM (
  SELECT row_number() OVER (ORDER BY l_orderkey, l_linenumber) - 1 AS i FROM lineitem) GROUP BY 1
""")
def repacked(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    numbered, total = number_rows_total(lines, ["l_orderkey", "l_linenumber"])
    path = scratch_path(spark, "repacked")
    writers.write_files(file_index(numbered, 5000), path, -(-total // 5000), rows_per_group=1000)
    shards = readers.read_shards(spark, path).withColumnRenamed("shard_no", "file_idx")
    return file_report(shards, "position")


@query("SK4_subset_to_bytes", f"""
SELECT o_orderkey FROM orders ORDER BY o_orderkey
LIMIT (SELECT least((0.001::DOUBLE * 1073741824 / 100.0)::BIGINT, count(*)) // {BLOCK} * {BLOCK} FROM orders)
""")
def subset(spark, sf):
    """As if a row took 100 bytes: the leading rows that fill a thousandth of a GiB."""
    rows = orders(spark, sf)
    total = rows.count()
    keep = subset_rows(100 * total, total, 0.001, BLOCK)
    numbered = head(rows, ["id"], keep, "idx")
    path = scratch_path(spark, "subset")
    writers.write_files(
        file_index(numbered, BLOCK), path, -(-keep // BLOCK), rows_per_group=BLOCK)
    return readers.read_shards(spark, path).select(F.col("id").alias("o_orderkey"))


@query("SK5_split_sizes", f"""
WITH n AS (SELECT count(*) AS n FROM orders),
i AS (SELECT row_number() OVER (ORDER BY day, id) - 1 AS idx FROM ({ORDERS_SQL}))
SELECT CASE WHEN idx < n // 2 THEN 0 WHEN idx < n // 2 + n // 3 THEN 1 ELSE 2 END AS file_idx,
       count(*) AS rows, min(idx) AS first, max(idx) AS last FROM i, n GROUP BY 1
""")
def split_sizes(spark, sf):
    numbered, n = number_rows_total(orders(spark, sf), ["day", "id"])
    sizes = [n // 2, n // 3, n - n // 2 - n // 3]
    path = scratch_path(spark, "split")
    writers.write_files(split_index(numbered, sizes), path, len(sizes), prefix="shuffle_train")
    shards = readers.read_shards(spark, path).withColumnRenamed("shard_no", "file_idx")
    return file_report(shards, "position")


@query("SK6_shard_names", """
SELECT o_orderkey, 'train-' || lpad((o_orderkey % files)::VARCHAR, greatest(2, length(files::VARCHAR))::INTEGER, '0')
       || '-of-' || files || '.parquet' AS name
FROM (SELECT o_orderkey, 1 + o_custkey % 1200 AS files FROM orders)
""")
def shard_names(spark, sf):
    rows = table(spark, sf, "orders").withColumn("files", 1 + F.col("o_custkey") % 1200)
    name = shard_name("train", F.col("o_orderkey") % F.col("files"), F.col("files"))
    return rows.select("o_orderkey", name.alias("name"))


@query("SK7_selectivity_report", f"""
SELECT range_start, range_end, count, round(selectivity, 9) AS selectivity,
       (SELECT count(*) FROM orders) AS total_rows, (SELECT count(*) FROM customer) AS num_queries
FROM ({_SELECTIVITY_SQL})
""")
def selectivity_report(spark, sf):
    """The written document, read back line by line."""
    rows = orders(spark, sf)
    report = selectivities(rows, "day", day_ranges(spark, sf))
    numbered = number_rows(report.drop("idx"), ["qid"], "at").drop("qid").withColumnRenamed("at", "qid")
    path = scratch_path(spark, "selectivity")
    writers.write_selectivity_report(numbered, rows.count(), path)
    lines = readers.read_lines(spark, path)
    entry = F.from_json(
        F.regexp_replace("value", "^,", ""),
        "range_start long, range_end long, count long, selectivity double",
    )
    head = F.regexp_extract("value", r'"total_rows": (\d+), "num_queries": (\d+)', 1)
    count = F.regexp_extract("value", r'"total_rows": (\d+), "num_queries": (\d+)', 2)
    start = lines.where(F.col("value").startswith('{"total_rows"')).select(
        head.cast("long").alias("total_rows"), count.cast("long").alias("num_queries")
    ).first()
    entries = lines.where(F.col("value").rlike('^,?\\{"range_start"')).select(entry.alias("e"))
    return entries.select(
        "e.range_start", "e.range_end", "e.count", F.round("e.selectivity", 9).alias("selectivity"),
        F.lit(start["total_rows"]).cast("long").alias("total_rows"),
        F.lit(start["num_queries"]).cast("long").alias("num_queries"),
    )


# --- checks ---------------------------------------------------------------------------------

@query("DQ1_equal_counts", """
SELECT (SELECT count(*) FROM documents) AS left_rows, (SELECT count(*) FROM labels) AS right_rows,
       (SELECT count(*) FROM documents) = (SELECT count(*) FROM labels) AS ok
""")
def counts_equal(spark, sf):
    return equal_counts(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("DQ2_bijection", f"""
SELECT count(*) AS pairs, count(DISTINCT old_id) AS distinct_old_id, count(DISTINCT new_id) AS distinct_new_id,
       count(DISTINCT old_id) = count(*) AND count(DISTINCT new_id) = count(*) AND min(new_id) = 0
       AND max(new_id) = count(*) - 1 AS ok FROM ({_BY_DAY_SQL})
""")
def is_bijection(spark, sf):
    return bijection(_mapping(spark, sf))


@query("DQ3_sorted", f"""
WITH n AS (SELECT day, row_number() OVER (ORDER BY id) - 1 AS idx FROM ({ORDERS_SQL})),
d AS (SELECT day < lag(day) OVER (ORDER BY idx) AS down FROM n)
SELECT count(*) AS rows, count(*) FILTER (down) AS falls, count(*) FILTER (down) = 0 AS ok FROM d
""")
def is_sorted(spark, sf):
    return unsorted_places(number_rows(orders(spark, sf), ["id"]), "day", rows_per_block=BLOCK)


@query("DQ4_vectors", f"""
SELECT count(*) AS vectors, count(*) FILTER (embedding IS NULL) AS nulls,
       count(*) FILTER (len(embedding) <> {DIM}) AS wrong_dimension,
       count(*) FILTER (len(embedding) = {DIM} AND NOT isfinite(list_sum(embedding))) AS not_finite FROM embeddings
""")
def vectors_valid(spark, sf):
    return vector_report(table(spark, sf, "embeddings"), "embedding", DIM)


@query("DQ5_inexact_filters", f"""
WITH f AS (SELECT c_custkey AS qid, 8000 + (c_custkey * 13) % 2300 AS range_start,
                  8000 + (c_custkey * 13) % 2300 + c_custkey % 400 AS range_end, 50::BIGINT AS target_count FROM customer)
SELECT f.qid, f.target_count, count(o.id) AS count FROM f
LEFT JOIN ({ORDERS_SQL}) o ON o.day BETWEEN f.range_start AND f.range_end GROUP BY ALL
HAVING count(o.id) <> f.target_count
""")
def filters_inexact(spark, sf):
    start = 8000 + (F.col("c_custkey") * 13) % 2300
    filters = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("qid"), start.alias("range_start"),
        (start + F.col("c_custkey") % 400).alias("range_end"),
        F.lit(50).cast("long").alias("target_count"),
    )
    return inexact_filters(orders(spark, sf), "day", filters).select("qid", "target_count", "count")


@query("DQ5_generated_filters_exact", "SELECT count(*) AS filters, 0::BIGINT AS inexact FROM range(10500)")
def filters_exact(spark, sf):
    rows = orders(spark, sf)
    filters = range_filters(rows, "id")
    counts = range_counts(rows, "id", filters)
    return filters.join(counts, "qid").agg(
        F.count("*").alias("filters"), F.count_if(F.col("count") != F.col("target_count")).alias("inexact")
    )


@query("DQ6_order_invariance", """
SELECT count(*) AS keys, 0::BIGINT AS one_sided, 0::BIGINT AS different FROM customer
""")
def order_invariant(spark, sf):
    """Selectivities before and after reordering the base."""
    ranges = day_ranges(spark, sf)
    before = selectivities(orders(spark, sf), "day", ranges)
    after = selectivities(reorder_randomly(orders(spark, sf), 42), "day", ranges)
    return differing_values(before, after, ["qid"], "selectivity")


@query("DQ7_array_length", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 4")
def lengths(spark, sf):
    """Orders whose list of lines has the expected length."""
    lists = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.collect_list("l_linenumber").alias("lines")
    )
    return array_length_is(lists, "lines", 4).select("l_orderkey")
