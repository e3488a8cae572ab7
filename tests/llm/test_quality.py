import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from nearfield.llm import quality, textscan

SF = "/root/testdata/sf0.1"


def stats(texts):
    data, offsets = textscan.texts(pa.array(texts, pa.string()))
    return quality.statistics(data, offsets)


def test_statistics_by_hand():
    x = dict(zip(quality.NAMES, stats(["ab cd ab\nab cd ab\nThe end."])[0]))
    assert np.isclose(x["log_words"], np.log1p(8)) and np.isclose(x["log_lines"], np.log1p(3))
    assert np.isclose(x["distinct_words"], 4 / 8) and np.isclose(x["top_word"], 4 / 8)
    assert np.isclose(x["distinct_lines"], 2 / 3) and np.isclose(x["doubled_words"], 1 / 8)
    assert np.isclose(x["share_1"], 1 / 26)


def test_statistics_do_not_depend_on_the_batch():
    texts = ["", "a", None, "one two\nthree", "é" * 50, " \n ", "x " * 9000, "| a | b"]
    together = stats(texts)
    assert np.isfinite(together).all() and not together[0].any() and not together[2].any()
    for i, t in enumerate(texts):
        assert np.allclose(together[i], stats([t])[0], rtol=1e-5, atol=1e-5)


def test_trees_against_plain_walk():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 4)).astype(np.float32)
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > -0.5)).astype(float)
    trees = quality.fit(x, y, trees=30)
    score = trees.score(x)
    assert ((score > 0.5) == y).mean() > 0.97

    def walk(row):
        total = trees.base
        for feature, bound, leaf in zip(trees.feature, trees.bound, trees.leaf):
            node = 0
            while node < len(bound):
                node = 2 * node + (2 if row[feature[node]] > bound[node] else 1)
            total += leaf[node - len(bound)]
        return 1 / (1 + np.exp(-total))

    assert np.allclose(score[:50], [walk(r) for r in x[:50]])


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = {r.doc_id: r for r in quality.op1_quality_scores(docs, labels).collect()}
    truth = duckdb.sql(f"SELECT doc_id, quality FROM '{SF}/labels.parquet'").fetchall()
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    held = [(rows[i].score, q) for i, q in truth if i in rows and rows[i].held_out]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert auc > 0.97, auc
    assert np.mean([(s >= 0.5) == q for s, q in held]) > 0.95


def test_held_out_labels_are_not_used(spark):
    docs, labels = (spark.read.parquet("/root/testdata/sf0.01/documents.parquet"),
                    spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))
    flipped = labels.selectExpr(
        "doc_id", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - quality ELSE quality END AS quality")
    one, two = (quality.train(docs, t) for t in (labels, flipped))
    assert np.array_equal(one.leaf, two.leaf) and np.array_equal(one.bound, two.bound)


@pytest.mark.parametrize("rows", [[], [(0, 1), (2, 1)], [(None, 1), (0, None), (0, 7)]])
def test_edges(spark, docs_of, rows):
    docs = docs_of(["a b c", None, "", "long " * 100_000, "a b c"], ids=[0, 1, None, 2, 2])
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    got = quality.op1_quality_scores(docs.withColumnRenamed("lang", "score"), labels).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    trees = quality.train(docs, labels)
    kept = quality.keep_good(docs, trees)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.op1_quality_scores(docs.limit(0), labels).collect() == []
