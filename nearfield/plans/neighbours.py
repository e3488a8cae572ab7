"""Exact and filtered nearest neighbours, vector functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from nearfield.functions.vectors import (
    cosine_similarity,
    euclidean_distance,
    permute_dimensions,
    seeded_permutation,
    vector_score,
)
from nearfield.operators.knn import (
    all_ground_truths,
    nearest,
    nearest_by_filter_rate,
    nearest_with_member,
    neighbour_lists,
)
from nearfield.operators.metrics import recall_by_rank
from nearfield.operators.reduce import fit_projection
from nearfield.plans.inputs import (
    BASE_SQL,
    DIM,
    QUERIES_SQL,
    RANGE,
    base,
    knn_oracle,
    knn_sql,
    queries,
    rounded,
)
from nearfield.plans.registry import query
from nearfield.session import materialize

COSINE_SQL = {"score": "array_cosine_similarity(q.emb, b.emb)", "direction": "DESC"}
K = 10


@query("KN1_knn_euclidean", knn_oracle(K))
def knn_euclidean(spark, sf):
    return rounded(nearest(queries(spark, sf), base(spark, sf), K), "score")


@query("KN1_knn_euclidean_blocks", knn_oracle(K))
def knn_blocks(spark, sf):
    """The form for many queries: both sides cut into blocks."""
    found = nearest(
        queries(spark, sf), base(spark, sf), K, broadcast_limit=0, block_values=DIM * 256
    )
    return rounded(found, "score")


@query("KN2_knn_cosine", knn_oracle(K, **COSINE_SQL))
def knn_cosine(spark, sf):
    return rounded(nearest(queries(spark, sf), base(spark, sf), K, "cosine"), "score")


@query("KN3_knn_equality", knn_oracle(K, "b.label = q.label"))
def knn_equality(spark, sf):
    return rounded(nearest(queries(spark, sf), base(spark, sf), K, key="label"), "score")


@query("KN3_knn_equality_blocks", knn_oracle(K, "b.label = q.label"))
def knn_equality_blocks(spark, sf):
    found = nearest(
        queries(spark, sf), base(spark, sf), K, key="label", broadcast_limit=0,
        block_values=DIM * 32,
    )
    return rounded(found, "score")


@query("KN4_knn_range", knn_oracle(K, "b.attr BETWEEN q.range_start AND q.range_end"))
def knn_range(spark, sf):
    return rounded(nearest(queries(spark, sf), base(spark, sf), K, within=RANGE), "score")


@query(
    "KN4_knn_range_cosine_blocks",
    knn_oracle(K, "b.attr BETWEEN q.range_start AND q.range_end", **COSINE_SQL),
)
def knn_range_blocks(spark, sf):
    found = nearest(
        queries(spark, sf), base(spark, sf), K, "cosine", within=RANGE, broadcast_limit=0,
        block_values=DIM * 256,
    )
    return rounded(found, "score")


@query("KN5_knn_member", knn_oracle(K, "list_contains(b.members, q.member)"))
def knn_member(spark, sf):
    found = nearest_with_member(queries(spark, sf), base(spark, sf), K, "member", "members")
    return rounded(found, "score")


FILTER_RATES = [0.01, 0.1, 0.5, 0.9, 0.99]


@query("KN6_knn_filter_rate", f"""
WITH q AS ({QUERIES_SQL}), b AS ({BASE_SQL}), r AS (
  SELECT f.filter_rate, q.qid, b.id, array_distance(q.emb, b.emb) AS score,
         row_number() OVER (PARTITION BY f.filter_rate, q.qid
                            ORDER BY array_distance(q.emb, b.emb), b.id) AS rank
  FROM (SELECT unnest({FILTER_RATES}::DOUBLE[]) AS filter_rate) f
  JOIN b ON b.id >= floor(f.filter_rate * (SELECT count(*) FROM b)) JOIN q ON true)
SELECT filter_rate, qid, id, rank, round(score, 6) AS score FROM r WHERE rank <= {K}
""")
def knn_filter_rate(spark, sf):
    found = nearest_by_filter_rate(queries(spark, sf), base(spark, sf), FILTER_RATES, K)
    return rounded(found, "score")


@query("KN6_recall_per_filter_rate", f"""
WITH passing AS (SELECT r.filter_rate, count(*) AS n
  FROM (SELECT unnest({FILTER_RATES}::DOUBLE[]) AS filter_rate) r
  JOIN embeddings ON vec_id >= floor(r.filter_rate * (SELECT count(*) FROM embeddings))
  GROUP BY r.filter_rate)
SELECT filter_rate, 1.0::DOUBLE AS recall FROM passing WHERE n >= {K}
""")
def recall_per_filter_rate(spark, sf):
    """The blocked search scored against the scanned ground truth of the same rate."""
    asked, rows = queries(spark, sf), base(spark, sf)
    # Both are read several times below, so they are written: each is a search of its own.
    found = materialize(nearest_by_filter_rate(asked, rows, FILTER_RATES, K, broadcast_limit=0), "found")
    truth = materialize(nearest_by_filter_rate(asked, rows, FILTER_RATES, K), "truth")
    return recall_by_rank(found, truth, ["filter_rate"], K, shared=["filter_rate"])


@query("KN7_ground_truth_lists", f"""
WITH q AS ({QUERIES_SQL}), b AS ({BASE_SQL}),
r AS ({knn_sql(100, "b.label = q.label AND b.attr BETWEEN q.range_start AND q.range_end")}),
lists AS (SELECT qid, string_agg(id::VARCHAR, ',' ORDER BY rank) AS ids, count(*) AS n
          FROM r GROUP BY qid)
SELECT q.qid AS id, coalesce(n, 0) AS n, coalesce(ids, '') AS neighbors FROM q LEFT JOIN lists USING (qid)
""")
def ground_truth_lists(spark, sf):
    """Few rows pass both predicates, so lists fall short of k and may be empty."""
    asked = queries(spark, sf)
    found = nearest(asked, base(spark, sf), 100, key="label", within=RANGE)
    lists = neighbour_lists(asked, found)
    return lists.select(
        "id", F.size("neighbors_id").cast("long").alias("n"),
        F.array_join(F.col("neighbors_id").cast("array<string>"), ",").alias("neighbors"),
    )


_KINDS = {
    "none": "true", "em": "b.label = q.label",
    "r": "b.attr BETWEEN q.range_start AND q.range_end",
    "emis": "list_contains(b.members, q.member)",
}


@query("KN8_all_ground_truths", f"""
WITH q AS ({QUERIES_SQL}), b AS ({BASE_SQL}), r AS ({" UNION ALL ".join(
    f"SELECT '{name}' AS filter_type, * FROM ({knn_sql(K, where)})" for name, where in _KINDS.items()
)})
SELECT filter_type, qid, id, rank, round(score, 6) AS score FROM r
""")
def ground_truths(spark, sf):
    found = all_ground_truths(
        queries(spark, sf), base(spark, sf), K, label="label", within=RANGE, member="member",
        members="members",
    )
    return rounded(found, "score")


def _neighbour_pairs(spark, sf):
    """Every embedding next to the one with the following id (the last meets the first)."""
    rows = base(spark, sf)
    n = rows.count()
    following = rows.select(((F.col("id") + n - 1) % n).alias("id"), F.col("emb").alias("other"))
    return rows.join(following, "id")


_PAIRS_SQL = """
SELECT a.vec_id AS id, a.embedding::DOUBLE[64] AS emb, b.embedding::DOUBLE[64] AS other
FROM embeddings a JOIN embeddings b
  ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings)
"""


@query("VF1_euclidean_distance",
       f"SELECT id, round(array_distance(emb, other), 6) AS score FROM ({_PAIRS_SQL})")
def euclidean(spark, sf):
    pairs = _neighbour_pairs(spark, sf)
    return pairs.select("id", F.round(euclidean_distance(F.col("emb"), F.col("other")), 6).alias("score"))


@query("VF2_cosine_similarity",
       f"SELECT id, round(array_cosine_similarity(emb, other), 6) AS score FROM ({_PAIRS_SQL})")
def cosine(spark, sf):
    pairs = _neighbour_pairs(spark, sf)
    return pairs.select("id", F.round(cosine_similarity(F.col("emb"), F.col("other")), 6).alias("score"))


@query("VF3_metric_by_name", f"""
SELECT id, 'sift-128-euclidean' AS name, true AS ascending,
       round(array_distance(emb, other), 6) AS score FROM ({_PAIRS_SQL})
UNION ALL
SELECT id, 'glove-100-angular', false, round(array_cosine_similarity(emb, other), 6) FROM ({_PAIRS_SQL})
""")
def metric_by_name(spark, sf):
    pairs = _neighbour_pairs(spark, sf)
    out = None
    for name in ("sift-128-euclidean", "glove-100-angular"):
        score, ascending = vector_score(name, F.col("emb"), F.col("other"))
        part = pairs.select(
            "id", F.lit(name).alias("name"), F.lit(ascending).alias("ascending"),
            F.round(score, 6).alias("score"),
        )
        out = part if out is None else out.unionByName(part)
    return out


@query("VF4_permuted_dimensions", f"""
WITH p AS (SELECT row_number() OVER (ORDER BY md5('42:' || i)) - 1 AS pos, i
           FROM range({DIM}) t(i))
SELECT vec_id AS id, pos, round(embedding[i + 1]::DOUBLE, 6) AS value FROM embeddings, p
""")
def permuted(spark, sf):
    order = seeded_permutation(DIM, 42)
    moved = base(spark, sf).select("id", permute_dimensions(F.col("emb"), order).alias("emb"))
    return moved.select("id", F.posexplode("emb").alias("pos", "x")).select(
        "id", F.col("pos").cast("long").alias("pos"), F.round(F.col("x").cast("double"), 6).alias("value")
    )


@query("VF5_linear_projection", f"SELECT id, round(array_distance(emb, other), 4) AS score FROM ({_PAIRS_SQL})")
def projection(spark, sf):
    """A projection onto all components is a rotation: distances stay as they are."""
    pairs = _neighbour_pairs(spark, sf)
    fitted = fit_projection(base(spark, sf), DIM)
    turned = euclidean_distance(fitted.apply(F.col("emb")), fitted.apply(F.col("other")))
    return pairs.select("id", F.round(turned, 4).alias("score"))
