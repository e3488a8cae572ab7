import numpy as np
import pytest
from brute import collected, neighbours

from nearfield.operators import knn
from nearfield.operators.knn import (
    Range, all_ground_truths, metric_for, nearest, nearest_partial, nearest_with_member, neighbour_lists,
)

BASE = "id long, emb array<float>, label string, attr long, members array<string>"
QUERIES = "qid long, emb array<float>, label string, low long, high long, member string"
FORMS = [
    {}, {"broadcast_limit": 0}, {"broadcast_limit": 0, "block_values": 4 * 7},
    {"broadcast_limit": 300},  # queries in slices
]


def fixture(spark, seed=0, n=120, m=25, copies=40):
    """A third of the base are copies of one vector with one label and one attribute value."""
    rng = np.random.default_rng(seed)
    # Small integers make many ties.
    points = rng.integers(-2, 3, (n, 4)).astype(float)
    points[:copies] = [1, 1, 0, 2]
    base = [
        {"id": int(i), "emb": points[i].tolist(), "label": "hot" if i < copies else f"l{i % 3}",
         "attr": 50 if i < copies else int(rng.integers(0, 100)), "members": [f"m{i % 4}", "all", "all"]}
        for i in rng.permutation(n)
    ]
    queries = [
        {"qid": i, "emb": rng.integers(-2, 3, 4).astype(float).tolist(),
         "label": ["hot", "l0", "l1", "absent"][i % 4], "low": int(rng.integers(0, 90)),
         "high": int(rng.integers(5, 100)), "member": ["all", "m1", "none"][i % 3]}
        for i in range(m)
    ]
    tables = [
        spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(5)
        for rows, schema in ((base, BASE), (queries, QUERIES))
    ]
    return base, queries, *tables


def agree(found, expected):
    assert collected(found) == {q: ids for q, ids in expected.items() if ids}


@pytest.mark.parametrize("sizes", FORMS)
@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
def test_plain_with_ties_and_copies(spark, sizes, metric):
    base, queries, b, q = fixture(spark)
    agree(nearest(q, b, 7, metric, **sizes), neighbours(queries, base, 7, metric))


@pytest.mark.parametrize("sizes", FORMS)
def test_equality_with_a_hot_label(spark, sizes):
    base, queries, b, q = fixture(spark)
    found = nearest(q, b, 9, key="label", **sizes)
    agree(found, neighbours(queries, base, 9, passes=lambda x, y: x["label"] == y["label"]))


@pytest.mark.parametrize("sizes", FORMS)
def test_range_with_a_hot_value_and_empty_ranges(spark, sizes):
    base, queries, b, q = fixture(spark)
    found = nearest(q, b, 9, within=Range("attr", "low", "high"), **sizes)
    agree(found, neighbours(queries, base, 9, passes=lambda x, y: x["low"] <= y["attr"] <= x["high"]))


@pytest.mark.parametrize("sizes", FORMS)
def test_key_and_range_together(spark, sizes):
    base, queries, b, q = fixture(spark)
    found = nearest(q, b, 9, key="label", within=Range("attr", "low", "high"), **sizes)
    expected = neighbours(
        queries, base, 9,
        passes=lambda x, y: x["label"] == y["label"] and x["low"] <= y["attr"] <= x["high"],
    )
    agree(found, expected)


@pytest.mark.parametrize("sizes", FORMS)
def test_members_listed_twice_count_once(spark, sizes):
    base, queries, b, q = fixture(spark)
    found = nearest_with_member(q, b, 9, "member", "members", **sizes)
    agree(found, neighbours(queries, base, 9, passes=lambda x, y: x["member"] in y["members"]))


@pytest.mark.parametrize("sizes", FORMS)
def test_more_asked_than_there_is(spark, sizes):
    base, queries, b, q = fixture(spark, n=6, copies=2)
    agree(nearest(q, b, 50, **sizes), neighbours(queries, base, 50))


def test_single_row_and_exact_hit(spark):
    b = spark.createDataFrame([(5, [3.0, 4.0])], "id long, emb array<float>")
    q = spark.createDataFrame([(0, [3.0, 4.0]), (1, [0.0, 0.0])], "qid long, emb array<float>")
    rows = {r["qid"]: (r["id"], r["score"]) for r in nearest(q, b, 3).collect()}
    assert rows == {0: (5, 0.0), 1: (5, 5.0)}


@pytest.mark.parametrize("sizes", FORMS)
def test_null_vectors_never_match(spark, sizes):
    base, queries, _, _ = fixture(spark)
    base[3]["emb"], queries[2]["emb"] = None, None
    b = spark.createDataFrame([tuple(r.values()) for r in base], BASE)
    q = spark.createDataFrame([tuple(r.values()) for r in queries], QUERIES)
    agree(nearest(q, b, 200, **sizes), neighbours(queries, base, 200))


def test_ragged_vectors_are_an_error(spark):
    b = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0])], "id long, emb array<float>").coalesce(1)
    q = spark.createDataFrame([(0, [1.0, 2.0])], "qid long, emb array<float>")
    with pytest.raises(Exception, match="differ in dimension"):
        nearest(q, b, 1).collect()


def test_no_queries_and_no_base(spark):
    base, queries, b, q = fixture(spark)
    for sizes in FORMS:
        assert nearest(q.where("false"), b, 3, **sizes).count() == 0
        assert nearest(q, b.where("false"), 3, **sizes).count() == 0


@pytest.mark.parametrize("sizes", FORMS)
@pytest.mark.parametrize("bad", [float("nan"), float("inf")])
def test_vectors_that_are_not_finite_never_match(spark, sizes, bad):
    base, queries, _, _ = fixture(spark)
    base[3]["emb"], queries[2]["emb"] = [1.0, bad, 0.0, 0.0], [bad, 0.0, 0.0, 0.0]
    b = spark.createDataFrame([tuple(r.values()) for r in base], BASE)
    q = spark.createDataFrame([tuple(r.values()) for r in queries], QUERIES)
    del base[3], queries[2]
    agree(nearest(q, b, 7, **sizes), neighbours(queries, base, 7))
    found = nearest(q, b, 9, key="label", within=Range("attr", "low", "high"), **sizes)
    agree(found, neighbours(queries, base, 9, passes=lambda x, y: (
        x["label"] == y["label"] and x["low"] <= y["attr"] <= x["high"])))


@pytest.mark.parametrize("scale", [1e-30, 1e-6, 1e12, 1e20])
def test_single_precision_products_keep_exact_order(spark, scale):
    """Nearly equal distances, and values near the ends of single precision."""
    rng = np.random.default_rng(8)
    points = (1 + rng.normal(size=(200, 16)) * 1e-7) * scale
    base = [{"id": i, "emb": p.tolist()} for i, p in enumerate(points)]
    queries = [{"qid": i, "emb": (points[i] * 1.0000001).tolist()} for i in range(10)]
    b = spark.createDataFrame([tuple(r.values()) for r in base], "id long, emb array<double>")
    q = spark.createDataFrame([tuple(r.values()) for r in queries], "qid long, emb array<double>")
    agree(nearest(q, b, 5), neighbours(queries, base, 5))


def test_queries_without_a_match_get_empty_lists(spark):
    base, queries, b, q = fixture(spark)
    lists = neighbour_lists(q, nearest(q, b, 4, key="label"))
    by_id = {r["id"]: r["neighbors_id"] for r in lists.collect()}
    assert len(by_id) == len(queries)
    assert all(by_id[x["qid"]] == [] for x in queries if x["label"] == "absent")


def test_metric_names():
    assert metric_for("sift-128-euclidean") == "euclidean"
    assert metric_for("glove-25-angular") == metric_for("cosine") == "cosine"
    with pytest.raises(ValueError):
        metric_for("hamming")


def test_large_offset_keeps_exact_order(spark):
    """Vectors far from the origin: the matrix form alone would lose the differences."""
    rng = np.random.default_rng(3)
    points = 1e4 + rng.normal(size=(300, 8))
    base = [{"id": i, "emb": np.float32(p).astype(float).tolist()} for i, p in enumerate(points)]
    queries = [{"qid": i, "emb": base[i]["emb"]} for i in range(40)]
    b = spark.createDataFrame([tuple(r.values()) for r in base], "id long, emb array<float>")
    q = spark.createDataFrame([tuple(r.values()) for r in queries], "qid long, emb array<float>")
    for sizes in FORMS:
        agree(nearest(q, b, 10, **sizes), neighbours(queries, base, 10))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("case", ["plain", "key", "range", "member"])
def test_no_vector_of_a_stored_base_is_shuffled(spark, case):
    """Each wave shuffles its queries; the base is read by bucket, where it lies."""
    _, _, b, q = fixture(spark, n=300, m=60)
    kind = {
        "plain": {}, "key": {"key": "label"}, "range": {"within": Range("attr", "low", "high")}, "member": {"key": "members"},
    }[case]
    q = q.withColumn("members", q["member"])
    plan = _plan(nearest_partial(q, b, 5, broadcast_limit=0, block_values=4 * 16, **kind))
    waves = plan.count("FlatMapCoGroupsInArrow")
    assert waves == 1 and plan.count("Bucketed: true") == 1
    base_side = plan[plan.index("Bucketed: true") - 600 : plan.index("Bucketed: true")]
    assert "Exchange" not in base_side.split("FileScan")[0].splitlines()[-1]
    # The exchanges are the queries' and, for members, that of the list of blocks that hold them.
    assert plan.count("Exchange hashpartitioning(__cell") == 1


@pytest.mark.parametrize("kind", [{}, {"key": "label"}, {"within": Range("attr", "low", "high")}])
def test_many_waves(spark, monkeypatch, kind):
    """Waves beyond one plan are written one after another, and leave whole lists."""
    monkeypatch.setattr(knn, "_PLAN_WAVES", 1)
    monkeypatch.setattr(knn, "_WAVE_BLOCKS", 1)
    base, queries, b, q = fixture(spark)
    passes = {
        0: lambda x, y: True, "key": lambda x, y: x["label"] == y["label"],
        "within": lambda x, y: x["low"] <= y["attr"] <= x["high"],
    }[next(iter(kind), 0)]
    found = nearest(q, b, 7, broadcast_limit=0, block_values=4 * 9, **kind)
    agree(found, neighbours(queries, base, 7, passes=passes))


@pytest.mark.parametrize("sizes", FORMS)
def test_all_filters_in_one_scan(spark, sizes):
    base, queries, b, q = fixture(spark)
    base[3] |= {"label": None}
    base[5] |= {"attr": None, "members": None}
    base[7] |= {"emb": None}
    base[9] |= {"members": [None, "m1"]}
    queries[1] |= {"label": None}
    queries[2] |= {"low": None, "member": None}
    queries[4] |= {"emb": None}
    b = spark.createDataFrame([tuple(r[c] for c in ("id", "emb", "label", "attr", "members")) for r in base], BASE).repartition(4)
    q = spark.createDataFrame(
        [tuple(r[c] for c in ("qid", "emb", "label", "low", "high", "member")) for r in queries], QUERIES)
    found = all_ground_truths(
        q, b, 6, label="label", within=Range("attr", "low", "high"), member="member", members="members", **sizes)
    passes = {
        "none": lambda x, y: True, "em": lambda x, y: x["label"] is not None and x["label"] == y["label"],
        "r": lambda x, y: None not in (x["low"], x["high"], y["attr"]) and x["low"] <= y["attr"] <= x["high"],
        "emis": lambda x, y: x["member"] is not None and x["member"] in (y["members"] or ()),
    }
    for name, passing in passes.items():
        agree(found.where(f"filter_type = '{name}'"), neighbours(queries, base, 6, passes=passing))


def test_all_filters_read_the_base_once(spark, tmp_path):
    _, _, b, q = fixture(spark)
    b.write.parquet(str(tmp_path / "base"))
    found = all_ground_truths(
        q, spark.read.parquet(str(tmp_path / "base")), 6, label="label", within=Range("attr", "low", "high"),
        member="member", members="members")
    assert _plan(found).count("FileScan") == 1


def test_hot_keys_and_values_get_blocks_of_their_own(spark):
    """No block holds more than about a block's rows, though a third of them share label and value."""
    _, _, b, q = fixture(spark, n=600, copies=200)
    for place in (
        lambda: knn._by_key(q, b, "label", 10, 40)[1], lambda: knn._by_range(q, b, Range("attr", "low", "high"), 10, 40)[1],
        lambda: knn._by_member(q.withColumnRenamed("member", "members"), b, "members", 15)[1],
    ):
        sizes = [r["count"] for r in place().groupBy("__cell").count().collect()]
        assert sum(sizes) == 600 and max(sizes) < 250 and len(sizes) > 6
        hot = [r["count"] for r in place().where("label = 'hot'").groupBy("__cell").count().collect()]
        assert max(hot) < 80
