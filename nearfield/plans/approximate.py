"""Inverted lists, quantisation, hashing, sweeps and projections."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Correlation, Summarizer
from pyspark.sql import functions as F

from nearfield.operators.ann import (
    assign_lists,
    fine_list_count,
    list_count,
    list_count_column,
    local_lists,
    nearest_by_hash,
    parameter_grid,
    search_lists,
    search_local_lists,
    sweep,
    train_lists,
    write_lists,
)
from nearfield.operators.knn import nearest
from nearfield.operators.numbering import block_of, number_rows
from nearfield.operators.quantize import (
    code_list,
    dimension_bounds,
    fit_bounds,
    nearest_reranked,
    quantise,
    read_codes,
    with_codes,
    write_codes,
)
from nearfield.operators.reduce import fit_projection, reduce_jointly
from nearfield.plans.inputs import BASE_SQL, DIM, QUERIES_SQL, base, knn_oracle, queries, rounded, table
from nearfield.plans.registry import query
from nearfield.session import materialize, scratch_path

K = 10
ROUNDS = 10
# The small tables get enough lists for probing to matter; larger ones follow the rule.
LEAST_LISTS = 16
_LISTS_SQL = f"""greatest({LEAST_LISTS}, (SELECT CASE WHEN count(*) <= 1000000 THEN ceil(count(*) / 1000.0)
  ELSE ceil(sqrt(count(*))) END::BIGINT FROM embeddings))"""


def _trained(spark, sf):
    rows = base(spark, sf).select("id", "emb")
    lists = max(LEAST_LISTS, list_count(rows.count()))
    return rows, materialize(train_lists(rows, lists, seed=0, iterations=ROUNDS), "centroids")


def kmeans_sql(lists: str, name: str = "") -> str:
    """CTEs of k-means over all vectors: centroids ``{name}c`` and the rows' lists ``{name}a``."""
    def nearest_list(centres: str) -> str:
        return f"""
SELECT v.id, min_by(c.list_id, {{'d': array_distance(v.emb, c.emb), 'l': c.list_id}}) AS list_id
FROM v CROSS JOIN {centres} c GROUP BY v.id"""

    steps = [f"""
{name}c0 AS (SELECT list_id, emb FROM (
  SELECT row_number() OVER (ORDER BY md5('0:' || id), id) - 1 AS list_id, emb FROM v) WHERE list_id < {lists})"""]
    for i in range(ROUNDS):
        old, new, rows = f"{name}c{i}", f"{name}c{i + 1}", f"{name}a{i}"
        steps.append(f"""
{rows} AS MATERIALIZED ({nearest_list(old)}),
{name}m{i} AS (SELECT list_id, list(m ORDER BY i)::DOUBLE[{DIM}] AS emb FROM (
  SELECT list_id, i, avg(emb[i]) AS m FROM {rows} JOIN v USING (id), range(1, {DIM + 1}) t(i) GROUP BY list_id, i)
  GROUP BY list_id),
{new} AS MATERIALIZED (SELECT o.list_id, coalesce(n.emb, o.emb) AS emb FROM {old} o LEFT JOIN {name}m{i} n USING (list_id))""")
    steps.append(f"""
{name}c AS (SELECT * FROM {name}c{ROUNDS}),
{name}a AS MATERIALIZED ({nearest_list(f"{name}c")})""")
    return ",".join(steps)


_VECTORS_SQL = f"v AS (SELECT vec_id AS id, embedding::DOUBLE[{DIM}] AS emb FROM embeddings)"


@query("KN9_list_counts", """
SELECT n, CASE WHEN n <= 1000000 THEN greatest(1, ceil(n / 1000.0)) ELSE ceil(sqrt(n)) END::BIGINT AS lists
FROM (SELECT DISTINCT l_orderkey * l_partkey AS n FROM lineitem)
""")
def list_counts(spark, sf):
    sizes = table(spark, sf, "lineitem").select((F.col("l_orderkey") * F.col("l_partkey")).alias("n"))
    return sizes.distinct().withColumn("lists", list_count_column(F.col("n")))


@query("KN9_trained_lists", f"""
WITH {_VECTORS_SQL}, {kmeans_sql("(SELECT greatest(1, ceil(count(*) / 1000.0)) FROM v)", "t")},
{kmeans_sql("(SELECT greatest(1, ceil(count(*) / 256.0)) FROM v)", "f")},
u AS (SELECT 'thousand' AS rule, * FROM tc UNION ALL SELECT 'fine', * FROM fc)
SELECT rule, list_id::INTEGER AS list_id, i - 1 AS pos, round(emb[i], 6) AS value FROM u, range(1, {DIM + 1}) r(i)
""")
def trained(spark, sf):
    """Centroids for the recommended number of lists (up to a million rows) and for the finer rule."""
    rows = base(spark, sf).select("id", "emb")
    n = rows.count()
    out = None
    for rule, lists in (("thousand", list_count(n)), ("fine", fine_list_count(n))):
        centres = train_lists(rows, lists, seed=0, iterations=ROUNDS).select(
            F.lit(rule).alias("rule"), "list_id", F.posexplode("emb").alias("pos", "value")
        )
        out = centres if out is None else out.unionByName(centres)
    return rounded(out.withColumn("pos", F.col("pos").cast("long")), "value")


@query("KN10_assigned_lists", f"""
WITH {_VECTORS_SQL}, {kmeans_sql(_LISTS_SQL)} SELECT id, list_id::INTEGER AS list_id FROM a
""")
def assigned(spark, sf):
    """Every row lands in one list; the table is stored by list."""
    rows, centres = _trained(spark, sf)
    return write_lists(assign_lists(rows, centres), scratch_path(spark, "lists")).select("id", "list_id")


@query("KN10_assignment_forms_agree", "SELECT count(*) AS rows, count(*) AS same FROM embeddings")
def assignment_forms(spark, sf):
    rows, centres = _trained(spark, sf)
    a = assign_lists(rows, centres).select("id", "list_id")
    b = assign_lists(rows, centres, broadcast_limit=0).select("id", F.col("list_id").alias("other"))
    return a.join(b, "id").agg(
        F.count("*").alias("rows"), F.count_if(F.col("list_id") == F.col("other")).alias("same")
    )


@query("KN11_all_lists_is_exact", knn_oracle(K))
def all_lists(spark, sf):
    rows, centres = _trained(spark, sf)
    found = search_lists(queries(spark, sf), assign_lists(rows, centres), centres, K, 0)
    return rounded(found, "score")


def _probed_sql(n_probe: int) -> str:
    return f"""
p AS (SELECT qid, list_id, probe_rank FROM (
  SELECT q.id AS qid, c.list_id,
         row_number() OVER (PARTITION BY q.id ORDER BY array_distance(q.emb, c.emb), c.list_id) AS probe_rank
  FROM v q, c) WHERE probe_rank <= {n_probe})"""


@query("KN11_probed_lists", f"""
WITH {_VECTORS_SQL}, {kmeans_sql(_LISTS_SQL)}, {_probed_sql(4)},
r AS (SELECT p.qid, b.id, array_distance(q.emb, b.emb) AS d,
             row_number() OVER (PARTITION BY p.qid ORDER BY array_distance(q.emb, b.emb), b.id) AS rank
      FROM p JOIN a USING (list_id) JOIN v b ON b.id = a.id JOIN v q ON q.id = p.qid)
SELECT qid, id, rank, round(d, 6) AS score FROM r WHERE rank <= {K}
""")
def probed(spark, sf):
    rows, centres = _trained(spark, sf)
    stored = write_lists(assign_lists(rows, centres), scratch_path(spark, "lists"))
    return rounded(search_lists(queries(spark, sf), stored, centres, K, 4), "score")


def _blocks(spark, sf, rows_per_block=250):
    rows = base(spark, sf).select("id", "emb")
    numbered = number_rows(rows.select("id"), ["id"]).select(
        "id", block_of(F.col("idx"), rows_per_block).alias("block")
    )
    return rows.join(numbered, "id")


@query("KN12_all_local_lists_is_exact", knn_oracle(K))
def all_local(spark, sf):
    assigned_rows, centres = local_lists(_blocks(spark, sf), rows_per_list=32, iterations=ROUNDS)
    found = search_local_lists(queries(spark, sf), assigned_rows, centres, K, 0)
    return rounded(found, "score")


def _local_sql() -> str:
    """CTEs of k-means within blocks: centroids ``c`` and the rows' lists ``a``."""
    nearest_list = """
SELECT b.id, min_by(c.n, {{'d': array_distance(b.emb, c.emb), 'l': c.n}}) AS n
FROM b JOIN {0} c USING (block) GROUP BY b.id"""
    steps = ["""
b AS (SELECT *, count(*) OVER (PARTITION BY block) AS size,
             row_number() OVER (PARTITION BY block ORDER BY md5('0:' || id), id) - 1 AS place
      FROM (SELECT id, emb, (row_number() OVER (ORDER BY id) - 1) // 250 AS block FROM v)),
c0 AS (SELECT block, place AS n, emb FROM b WHERE place < ceil(size / 32.0))"""]
    for i in range(ROUNDS):
        steps.append(f"""
a{i} AS MATERIALIZED ({nearest_list.format(f"c{i}")}),
m{i} AS (SELECT block, n, list(m ORDER BY i)::DOUBLE[{DIM}] AS emb FROM (
  SELECT block, n, i, avg(emb[i]) AS m FROM a{i} JOIN b USING (id), range(1, {DIM + 1}) t(i) GROUP BY block, n, i)
  GROUP BY block, n),
c{i + 1} AS MATERIALIZED (SELECT o.block, o.n, coalesce(m.emb, o.emb) AS emb FROM c{i} o LEFT JOIN m{i} m USING (block, n))""")
    steps.append(f"""
c AS (SELECT * FROM c{ROUNDS}), a AS MATERIALIZED ({nearest_list.format(f"c{ROUNDS}")})""")
    return ",".join(steps)


@query("KN12_probed_local_lists", f"""
WITH {_VECTORS_SQL}, {_local_sql()},
p AS (SELECT qid, block, n FROM (
  SELECT q.id AS qid, c.block, c.n,
         row_number() OVER (PARTITION BY q.id, c.block ORDER BY array_distance(q.emb, c.emb), c.n) AS r
  FROM v q, c) WHERE r <= 2),
r AS (SELECT p.qid, b.id, array_distance(q.emb, b.emb) AS d,
             row_number() OVER (PARTITION BY p.qid ORDER BY array_distance(q.emb, b.emb), b.id) AS rank
      FROM p JOIN b ON b.block = p.block JOIN a ON a.id = b.id AND a.n = p.n JOIN v q ON q.id = p.qid)
SELECT qid, id, rank, round(d, 6) AS score FROM r WHERE rank <= {K}
""")
def probed_local(spark, sf):
    assigned_rows, centres = local_lists(_blocks(spark, sf), rows_per_list=32, iterations=ROUNDS)
    found = search_local_lists(queries(spark, sf), assigned_rows, centres, K, 2)
    return rounded(found, "score")


@query("KN13_dimension_bounds", f"""
SELECT (i - 1)::INTEGER AS dim, round(min(embedding[i]::DOUBLE), 6) AS low, round(max(embedding[i]::DOUBLE), 6) AS high
FROM embeddings, range(1, {DIM + 1}) t(i) GROUP BY i
""")
def bounds(spark, sf):
    return rounded(dimension_bounds(base(spark, sf)), "low", "high")


_X = "embedding[i]::DOUBLE"


@query("KN13_codes", f"""
WITH e AS (SELECT vec_id AS id, i - 1 AS pos, {_X} AS x FROM embeddings, range(1, {DIM + 1}) t(i)),
b AS (SELECT min(x) AS lo, max(x) AS hi FROM e)
SELECT id, pos, greatest(0, least(255, round_even((x - lo) / (hi - lo) * 255, 0)))::INTEGER AS code FROM e, b
""")
def codes(spark, sf):
    rows = base(spark, sf)
    coded = rows.select("id", code_list(quantise(F.col("emb"), fit_bounds(rows))).alias("code"))
    return coded.select("id", F.posexplode("code").alias("pos", "code")).withColumn(
        "pos", F.col("pos").cast("long")
    )


@query("KN13_codes_per_dimension", f"""
WITH e AS (SELECT vec_id AS id, i - 1 AS pos, {_X} AS x FROM embeddings, range(1, {DIM + 1}) t(i)),
b AS (SELECT pos, min(x) AS lo, max(x) AS hi FROM e GROUP BY pos)
SELECT id, pos, greatest(0, least(255, round_even((x - lo) / (hi - lo) * 255, 0)))::INTEGER AS code
FROM e JOIN b USING (pos)
""")
def codes_per_dimension(spark, sf):
    rows = base(spark, sf)
    limits = fit_bounds(rows, per_dimension=True)
    coded = rows.select("id", code_list(quantise(F.col("emb"), limits)).alias("code"))
    return coded.select("id", F.posexplode("code").alias("pos", "code")).withColumn(
        "pos", F.col("pos").cast("long")
    )


@query("KN13_code_distance", f"""
WITH e AS (SELECT vec_id AS id, i, {_X} AS x FROM embeddings, range(1, {DIM + 1}) t(i)),
b AS (SELECT min(x) AS lo, max(x) AS hi FROM e),
c AS (SELECT id, list(greatest(0, least(255, round_even((x - lo) / (hi - lo) * 255, 0))) ORDER BY i)::DOUBLE[{DIM}] AS code
      FROM e, b GROUP BY id),
r AS (SELECT q.id AS qid, c.id, array_distance(q.code, c.code) AS d,
             row_number() OVER (PARTITION BY q.id ORDER BY array_distance(q.code, c.code), c.id) AS rank FROM c q, c)
SELECT qid, id, rank, round(d, 6) AS score FROM r WHERE rank <= {K}
""")
def code_distance(spark, sf):
    rows = base(spark, sf).select("id", "emb")
    limits = fit_bounds(rows)
    asked = with_codes(queries(spark, sf).select("qid", "emb"), limits)
    return rounded(nearest(asked, with_codes(rows, limits), K), "score")


@query("KN14_reranked_all_is_exact", knn_oracle(K))
def reranked_all(spark, sf):
    """Fetching ten times k by code loses no true neighbour here; the order is exact."""
    rows = base(spark, sf).select("id", "emb")
    asked = queries(spark, sf).select("qid", "emb")
    return rounded(nearest_reranked(asked, rows, K, 10 * K), "score")


_RERANKED_SQL = f"""
WITH e AS (SELECT vec_id AS id, i, {_X} AS x FROM embeddings, range(1, {DIM + 1}) t(i)),
lim AS (SELECT min(x) AS lo, max(x) AS hi FROM e),
c AS (SELECT id, list(greatest(0, least(255, round_even((x - lo) / (hi - lo) * 255, 0))) ORDER BY i)::DOUBLE[{DIM}] AS code
      FROM e, lim GROUP BY id),
f AS (SELECT q.id AS qid, c.id,
             row_number() OVER (PARTITION BY q.id ORDER BY array_distance(q.code, c.code), c.id) AS place FROM c q, c),
x AS (SELECT f.qid, f.id, array_distance(q.emb, b.emb) AS d FROM f
      JOIN ({QUERIES_SQL}) q USING (qid) JOIN ({BASE_SQL}) b ON b.id = f.id WHERE f.place <= {2 * K}),
r AS (SELECT qid, id, d, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM x)
SELECT qid, id, rank, round(d, 6) AS score FROM r WHERE rank <= {K}
"""


@query("KN14_reranked", _RERANKED_SQL)
def reranked(spark, sf):
    rows = base(spark, sf).select("id", "emb")
    asked = queries(spark, sf).select("qid", "emb")
    return rounded(nearest_reranked(asked, rows, K, 2 * K), "score")


@query("KN14_stored_codes", _RERANKED_SQL)
def stored_codes(spark, sf):
    """The same search over codes that are written once and read back with their bounds."""
    rows = base(spark, sf).select("id", "emb")
    asked = queries(spark, sf).select("qid", "emb")
    path = scratch_path(spark, "codes")
    write_codes(rows, path)
    return rounded(nearest_reranked(asked, rows, K, 2 * K, stored=read_codes(spark, path)), "score")


@query("KN15_hash_search", f"""
WITH {_VECTORS_SQL},
d AS (SELECT t, i, ('0x' || substr(md5('1:' || t || ':' || (i - 1)), 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1 AS x
      FROM range(8) a(t), range(1, {DIM + 1}) b(i)),
n AS (SELECT t, sqrt(sum(x * x)) AS norm FROM d GROUP BY t),
h AS (SELECT id, t, floor(sum(emb[i] * x / norm) / 0.25) AS bucket FROM v, d JOIN n USING (t) GROUP BY id, t),
p AS (SELECT DISTINCT a.id AS qid, b.id FROM h a JOIN h b USING (t, bucket)),
r AS (SELECT p.qid, p.id, array_distance(q.emb, b.emb) AS d,
             row_number() OVER (PARTITION BY p.qid ORDER BY array_distance(q.emb, b.emb), p.id) AS rank
      FROM p JOIN v q ON q.id = p.qid JOIN v b ON b.id = p.id)
SELECT qid, id, rank, round(d, 6) AS score FROM r WHERE rank <= {K}
""")
def hashed(spark, sf):
    rows = base(spark, sf).select("id", "emb")
    asked = queries(spark, sf).select("qid", "emb")
    found = nearest_by_hash(asked, rows, K, bucket_length=0.25, tables=8, seed=1)
    return rounded(found, "score")


@query("KN15_wide_buckets_are_exact", knn_oracle(K))
def hashed_wide(spark, sf):
    """One bucket on either side of zero and many tables: every pair meets somewhere."""
    rows = base(spark, sf).select("id", "emb")
    asked = queries(spark, sf).select("qid", "emb")
    found = nearest_by_hash(asked, rows, K, bucket_length=100.0, tables=24, seed=1)
    return rounded(found, "score")


N_PROBES = [1, 2, 4, 8, 0]
KS = [1, 10]


@query("KN16_grid", f"""
SELECT n_name, n_probe, quantisation, k FROM (SELECT unnest({N_PROBES}) AS n_probe),
  (SELECT unnest(['f32', 'u8']) AS quantisation), (SELECT unnest({KS}) AS k), (SELECT n_name FROM nation)
""")
def grid(spark, sf):
    return parameter_grid(
        table(spark, sf, "nation").select("n_name"), n_probe=N_PROBES, quantisation=["f32", "u8"], k=KS
    )


def _sweep(spark, sf):
    rows, centres = _trained(spark, sf)
    asked = queries(spark, sf).select("qid", "emb")
    stored = materialize(assign_lists(rows, centres), "assigned")
    limits = fit_bounds(rows)
    coded = materialize(with_codes(stored, limits), "codes")
    truth = nearest(asked, rows, max(KS))
    bases = {"f32": (asked, stored), "u8": (with_codes(asked, limits), coded)}
    return sweep(asked, bases, centres, truth, N_PROBES, KS)


@query("KN16_recall_sweep", f"""
WITH {_VECTORS_SQL}, {kmeans_sql(_LISTS_SQL)},
e AS (SELECT id, i, emb[i] AS x FROM v, range(1, {DIM + 1}) t(i)),
lim AS (SELECT min(x) AS lo, max(x) AS hi FROM e),
u AS (SELECT id, list(greatest(0, least(255, round_even((x - lo) / (hi - lo) * 255, 0))) ORDER BY i)::DOUBLE[{DIM}] AS emb
      FROM e, lim GROUP BY id),
kinds AS (SELECT 'f32' AS quantisation, id, emb FROM v UNION ALL SELECT 'u8', id, emb FROM u),
near AS MATERIALIZED (SELECT q.id AS qid, c.list_id,
  row_number() OVER (PARTITION BY q.id ORDER BY array_distance(q.emb, c.emb), c.list_id) AS probe_rank FROM v q, c),
pairs AS MATERIALIZED (
  SELECT q.quantisation, q.id AS qid, b.id, n.probe_rank, array_distance(q.emb, b.emb) AS d
  FROM kinds q JOIN kinds b USING (quantisation) JOIN a ON a.id = b.id
  JOIN near n ON n.qid = q.id AND n.list_id = a.list_id),
truth AS (SELECT qid, id, rank FROM (
  SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY d, id) AS rank FROM pairs WHERE quantisation = 'f32')
  WHERE rank <= {max(KS)}),
found AS (SELECT quantisation, n_probe, qid, id, rank FROM (
  SELECT quantisation, n_probe, qid, id,
         row_number() OVER (PARTITION BY quantisation, n_probe, qid ORDER BY d, id) AS rank
  FROM pairs JOIN (SELECT unnest({N_PROBES}) AS n_probe) ON n_probe = 0 OR probe_rank <= n_probe) WHERE rank <= {max(KS)})
SELECT s.quantisation, s.n_probe, s.k, round(count(f.id) / (s.k * (SELECT count(*) FROM v)::DOUBLE), 6) AS recall
FROM (SELECT * FROM (SELECT unnest(['f32', 'u8']) AS quantisation), (SELECT unnest({N_PROBES}) AS n_probe),
      (SELECT unnest({KS}) AS k)) s
JOIN truth t ON t.rank <= s.k
LEFT JOIN found f ON f.quantisation = s.quantisation AND f.n_probe = s.n_probe AND f.qid = t.qid AND f.id = t.id
  AND f.rank <= s.k
GROUP BY s.quantisation, s.n_probe, s.k
""")
def recall_sweep(spark, sf):
    return rounded(_sweep(spark, sf), "recall")


@query("KN16_all_lists_recall_one", "SELECT unnest([1, 10])::INTEGER AS k, 1.0::DOUBLE AS recall")
def full_recall(spark, sf):
    full = _sweep(spark, sf).where((F.col("n_probe") == 0) & (F.col("quantisation") == "f32"))
    return full.select("k", "recall")


@query("DR1_projected_distances", f"""
SELECT count(*) AS vectors, {DIM}::INTEGER AS dim FROM embeddings
""")
def projected(spark, sf):
    """Base and queries reduced together; row counts and the target dimension."""
    rows, _, _ = reduce_jointly(base(spark, sf), queries(spark, sf), DIM)
    return rows.groupBy(F.size("emb").alias("dim")).agg(F.count("*").alias("vectors"))


@query("DR1_reduced_neighbours", f"SELECT qid, id, rank FROM ({knn_oracle(K)})")
def reduced_neighbours(spark, sf):
    """Keeping all components is a rotation, so the neighbours stay the same."""
    rows, asked, _ = reduce_jointly(base(spark, sf), queries(spark, sf), DIM)
    return nearest(asked, rows, K).select("qid", "id", "rank")


@query("DR2_total_variance", f"""
WITH e AS (SELECT i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, {DIM + 1}) t(i)),
v AS (SELECT i, var_samp(x) AS v FROM e GROUP BY i)
SELECT round(sum(v), 4) AS variance, 1.0::DOUBLE AS ratio FROM v
""")
def total_variance(spark, sf):
    """All components together explain all of the variance, which a rotation keeps."""
    rows = base(spark, sf)
    fitted = fit_projection(rows, DIM)
    turned = rows.select(F.posexplode(fitted.apply(F.col("emb"))).alias("i", "x"))
    per_dim = turned.groupBy("i").agg(F.var_samp(F.col("x").cast("double")).alias("v"))
    return per_dim.agg(F.round(F.sum("v"), 4).alias("variance")).withColumn(
        "ratio", F.round(F.lit(fitted.explained_ratio), 6)
    )


@query("DR2_explained_variance", """
SELECT (SELECT count(*) FROM embeddings) AS vectors, i::INTEGER AS component, 1.0::DOUBLE AS length,
       true AS orthogonal, true AS decorrelated, true AS share_is_variance, true AS descending FROM range(16) t(i)
""")
def explained(spark, sf):
    """What makes 16 components principal: unit vectors at right angles, whose projections are not
    correlated, with the stated share of the variance each, largest first."""
    rows = base(spark, sf)
    fitted = fit_projection(rows, 16)
    moments = rows.select(array_to_vector(F.transform(
        fitted.apply(F.col("emb")), lambda x: x.cast("double"))).alias("x"))
    corr = np.nan_to_num(Correlation.corr(moments, "x").first()[0].toArray()) - np.eye(16)
    spread = moments.select(Summarizer.variance(F.col("x")).alias("v")).first()["v"].toArray()
    whole = rows.select(array_to_vector(F.transform("emb", lambda x: x.cast("double"))).alias("x"))
    total = whole.select(Summarizer.variance(F.col("x")).alias("v")).first()["v"].toArray().sum()
    angles = fitted.components.T @ fitted.components - np.eye(16)
    falling = np.diff(fitted.explained, prepend=np.inf) <= 1e-12
    facts = [
        (rows.count(), i, round(float(np.sqrt(1 + angles[i, i])), 6), bool(np.abs(angles[i]).max() < 1e-6),
         bool(np.abs(corr[i]).max() < 1e-3), bool(abs(spread[i] / total - fitted.explained[i]) < 1e-5), bool(falling[i]))
        for i in range(16)
    ]
    return spark.createDataFrame(facts, "vectors long, component int, length double, orthogonal boolean, "
                                 "decorrelated boolean, share_is_variance boolean, descending boolean")
