import numpy as np
import pytest
from brute import collected, neighbours
from pyspark.sql import functions as F

from nearfield.operators.ann import (
    assign_lists,
    fine_list_count,
    list_count,
    local_lists,
    nearest_by_hash,
    probes,
    search_lists,
    search_local_lists,
    sweep,
    train_lists,
    write_lists,
)
from nearfield.operators.knn import nearest, nearest_partial, rank_nearest
from nearfield.operators import ann, quantize
from nearfield.operators.quantize import (
    bloom_filter,
    fit_bounds,
    may_hold,
    nearest_reranked,
    quantise,
    read_codes,
    with_codes,
    write_codes,
)
from nearfield.operators.reduce import fit_projection, reduce_jointly

N, M, D = 240, 20, 8


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    points = np.float32(rng.normal(size=(N, D))).astype(float)
    points[: N // 3] = points[0]
    asked = np.float32(rng.normal(size=(M, D))).astype(float)
    base = [{"id": i, "emb": p.tolist()} for i, p in enumerate(points)]
    queries = [{"qid": i, "emb": p.tolist()} for i, p in enumerate(asked)]
    b = spark.createDataFrame([tuple(r.values()) for r in base], "id long, emb array<float>")
    q = spark.createDataFrame([tuple(r.values()) for r in queries], "qid long, emb array<float>")
    return base, queries, b.cache(), q.cache()


@pytest.fixture(scope="module")
def lists(spark, data):
    centres = train_lists(data[2], 6, iterations=5).cache()
    return assign_lists(data[2], centres).cache(), centres


def test_list_counts():
    assert [list_count(n) for n in (1, 1000, 1001, 1_000_000, 1_000_001, 4_999_000)] == [
        1, 1, 2, 1000, 1001, 2236]
    assert fine_list_count(257) == 2


def test_probed_lists_equal_brute_force_inside_them(data, lists):
    base, queries, b, q = data
    assigned, centres = lists
    owner = {r["id"]: r["list_id"] for r in assigned.select("id", "list_id").collect()}
    heads = {r["list_id"]: np.array(r["emb"]) for r in centres.collect()}
    for row in base:
        gaps = {i: np.linalg.norm(np.array(row["emb"]) - c) for i, c in heads.items()}
        assert gaps[owner[row["id"]]] == pytest.approx(min(gaps.values()))
    asked = {}
    for r in probes(q, centres, 2).collect():
        asked.setdefault(r["qid"], set()).add(r["list_id"])
    assert all(len(found) == 2 for found in asked.values())
    expected = neighbours(queries, base, 5, passes=lambda x, y: owner[y["id"]] in asked[x["qid"]])
    for sizes in ({}, {"broadcast_limit": 0, "block_values": D * 16}):
        assert collected(search_lists(q, assigned, centres, 5, 2, **sizes)) == expected


def test_all_lists_and_a_stored_table(data, lists, tmp_path):
    base, queries, b, q = data
    stored = write_lists(lists[0], str(tmp_path / "lists"))
    assert collected(search_lists(q, stored, lists[1], 5, 0)) == neighbours(queries, base, 5)


def test_both_forms_of_assignment_agree(data, lists):
    other = assign_lists(data[2], lists[1], broadcast_limit=0).select("id", F.col("list_id").alias("o"))
    both = lists[0].join(other, "id")
    assert both.count() == N and both.where("list_id <> o").count() == 0


def test_recall_grows_with_the_probes(data, lists):
    _, _, b, q = data
    assigned, centres = lists
    truth = nearest(q, b, 5)
    found = sweep(q, {"f32": (q, assigned)}, centres, truth, [1, 2, 4, 0], [1, 5]).collect()
    for k in (1, 5):
        by_probe = {r["n_probe"]: r["recall"] for r in found if r["k"] == k}
        line = [by_probe[n] for n in (1, 2, 4, 0)]
        assert line == sorted(line) and line[-1] == 1.0
        single = collected(search_lists(q, assigned, centres, k, 2))
        exact = collected(nearest(q, b, k))
        hits = sum(len(set(single[x]) & set(exact[x])) for x in exact)
        assert by_probe[2] == pytest.approx(hits / (k * M))


def test_rows_that_are_not_finite_have_no_list(spark, data):
    b = data[2].unionByName(spark.createDataFrame(
        [(N, [float("nan")] * D), (N + 1, None)], "id long, emb array<float>"))
    centres = train_lists(b, 6, iterations=5)
    assert np.allclose(sorted(r["emb"] for r in centres.collect()),
                       sorted(r["emb"] for r in train_lists(data[2], 6, iterations=5).collect()))
    for limit in (1 << 20, 0):
        rows = {r["id"]: r["list_id"] for r in assign_lists(b, centres, broadcast_limit=limit).collect()}
        assert len(rows) == N + 2 and rows[N] is rows[N + 1] is None and len(set(rows.values())) > 3


def test_local_lists(data):
    base, queries, b, q = data
    blocks = b.withColumn("block", F.floor(F.col("id") / 100))
    assigned, centres = local_lists(blocks, rows_per_list=20, iterations=4)
    assert assigned.count() == N
    assert collected(search_local_lists(q, assigned, centres, 5, 0)) == neighbours(queries, base, 5)
    owner = {r["id"]: r["list_id"] for r in assigned.collect()}
    heads = {}
    for r in centres.collect():
        heads.setdefault(r["block"], []).append((r["list_id"], np.array(r["emb"])))

    def probed(x, y):
        rows = heads[y["id"] // 100]
        order = sorted(rows, key=lambda h: (np.linalg.norm(np.array(x["emb"]) - h[1]), int(h[0].split(":")[1])))
        return owner[y["id"]] in [name for name, _ in order[:2]]

    expected = neighbours(queries, base, 5, passes=probed)
    assert collected(search_local_lists(q, assigned, centres, 5, 2)) == expected


def test_codes_and_rerank(data):
    base, queries, b, q = data
    limits = fit_bounds(b)
    codes = {r["id"]: np.frombuffer(r["c"], np.uint8).astype(float)
             for r in b.select("id", quantise(F.col("emb"), limits).alias("c")).collect()}
    lo, hi = limits.low[0], limits.high[0]
    for row in base[::17]:
        expected = np.rint((np.array(row["emb"]) - lo) / (hi - lo) * 255)
        assert (codes[row["id"]] == expected).all()
    coded_q = [{"qid": x["qid"], "emb": np.clip(np.rint((np.array(x["emb"]) - lo) / (hi - lo) * 255), 0, 255)}
               for x in queries]
    coded_b = [{"id": i, "emb": c} for i, c in codes.items()]
    fetched = neighbours(coded_q, coded_b, 12)
    expected = neighbours(queries, base, 5, passes=lambda x, y: y["id"] in fetched[x["qid"]])
    assert collected(nearest_reranked(q, b, 5, 12)) == expected
    assert collected(nearest(with_codes(q, limits), with_codes(b, limits), 12)) == fetched


def test_hash_buckets_with_a_bucket_of_copies(data):
    base, queries, b, q = data
    wide = nearest_by_hash(q, b, 5, bucket_length=1000.0, tables=16, seed=3)
    exact = neighbours(queries, base, 5)
    assert collected(wide) == exact
    narrow = nearest_by_hash(q, b, 5, bucket_length=1.0, tables=3, seed=3)
    blocked = nearest_by_hash(
        q, b, 5, bucket_length=1.0, tables=3, seed=3, broadcast_limit=0, block_values=D * 10
    )
    assert collected(narrow) == collected(blocked)
    hits = sum(len(set(ids) & set(exact[x])) for x, ids in collected(narrow).items())
    assert 0 < hits <= 5 * M


def test_projection(data):
    base, queries, b, q = data
    rows, asked, fitted = reduce_jointly(b, q, 3)
    points = np.array([r["emb"] for r in base] + [r["emb"] for r in queries])
    values, vectors = np.linalg.eigh(np.cov(points.T))
    assert fitted.explained_ratio == pytest.approx(values[::-1][:3].sum() / values.sum())
    kept = (points - points.mean(axis=0)) @ vectors[:, ::-1][:, :3]
    expected = neighbours(
        [{"qid": i, "emb": kept[N + i]} for i in range(M)], [{"id": i, "emb": kept[i]} for i in range(N // 3, N)], 3
    )
    assert collected(nearest(asked, rows.where(F.col("id") >= N // 3), 3)) == expected
    assert fit_projection(b, D).explained_ratio == pytest.approx(1.0)


def test_queries_that_list_their_keys(data):
    """One vector per query, however many keys; in every form, with and without places."""
    base, queries, b, q = data
    owner = {x["id"]: x["id"] % 7 for x in base}
    lists = {x["qid"]: [(x["qid"] * 3 + i * i) % 7 for i in range(3)] for x in queries}
    lists = {x: list(dict.fromkeys(found)) for x, found in lists.items()}
    keyed = b.withColumn("key", (F.col("id") % 7).cast("int"))
    asked = q.withColumn("key", F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (
        (F.col("qid") * 3 + i * i) % 7).cast("int"))))
    whole = neighbours(queries, base, 4, passes=lambda x, y: owner[y["id"]] in lists[x["qid"]])
    places = {
        (x["qid"], p + 1): neighbours([x], base, 4, passes=lambda _, y: owner[y["id"]] == key)[x["qid"]]
        for x in queries for p, key in enumerate(lists[x["qid"]])}
    for sizes in ({}, {"broadcast_limit": 2500}, {"broadcast_limit": 0, "block_values": D * 16}):
        found = rank_nearest(nearest_partial(asked, keyed, 4, key="key", **sizes), 4, "euclidean")
        assert collected(found) == whole
        partial = nearest_partial(asked, keyed, 4, key="key", place="place", **sizes)
        ranked = rank_nearest(partial, 4, "euclidean", ("qid", "place"))
        per = {}
        for r in sorted(ranked.collect(), key=lambda r: r["rank"]):
            per.setdefault((r["qid"], r["place"]), []).append(r["id"])
        assert per == places
    with pytest.raises(ValueError):
        nearest_partial(q.withColumn("key", F.lit(1)), keyed, 4, key="key", place="place")


def test_probe_tables_hold_no_vectors(data, lists):
    assert probes(data[3], lists[1], 3).columns == ["qid", "list_id", "probe_rank"]


def test_a_filter_of_many_ids_loses_none(spark):
    base = spark.range(200_000).withColumn("emb", F.lit("x"))
    ids = spark.range(0, 200_000, 40)
    found = may_hold(base, bloom_filter(ids, 1024), 1024)
    assert found.join(ids, "id").count() == 5_000
    assert found.count() < 12_000  # five ids a word, 15 bits at most: one of 75 others passes
    assert bloom_filter(ids, 1024).count() <= 1024 and found.columns == ["id", "emb"]
    assert may_hold(base, bloom_filter(ids.where("id < 0"))).isEmpty()


def test_candidates_beyond_the_broadcast_limit(data, monkeypatch, tmp_path, spark):
    """The same rows by ids, by filter and by a join; the base meets the filter before it is shuffled."""
    _, _, b, q = data
    expected = collected(nearest_reranked(q, b, 5, 12))
    written = write_codes(b, str(tmp_path / "codes"))
    assert collected(nearest_reranked(q, b, 5, 12, stored=read_codes(spark, str(tmp_path / "codes")))) == expected
    monkeypatch.setattr(quantize, "_BROADCAST_CANDIDATES", 0)
    found = nearest_reranked(q, b, 5, 12, stored=written)
    assert collected(found) == expected
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "__mask" in plan
    monkeypatch.setattr(quantize, "_FILTER_LOAD", 0)
    assert collected(nearest_reranked(q, b, 5, 12, stored=written)) == expected


def test_tree_of_lists(spark, data, monkeypatch):
    """Rows are placed once and only lists move; cells, slices and bounds change nothing."""
    base, _, b, _ = data
    monkeypatch.setattr(ann, "BLOCK_VALUES", D * 30)
    monkeypatch.setattr(ann, "_SLICE_VALUES", D * 3)
    rng = np.random.default_rng(5)
    far = np.float32(rng.normal(size=(4, D))).astype(float) + 100  # a cloud of its own
    rows = b.unionByName(spark.createDataFrame(
        [(N + i, p.tolist()) for i, p in enumerate(far)] + [(N + 4, None), (N + 5, [float("inf")] * D)],
        "id long, emb array<float>"))
    points = np.array([r["emb"] for r in base] + far.tolist())
    heads = np.vstack([points[: N // 3 + 12][-14:], points[-2:], points[:1]])  # repeated heads too
    centres = spark.createDataFrame([(i, h.tolist()) for i, h in enumerate(heads)], "list_id int, emb array<double>")
    gaps = ((points[:, None] - heads[None]) ** 2).sum(axis=2)
    tree = ann._Tree(rows, centres, D * 30)
    assert tree.parts[-1] == 1 and max(tree.parts.values()) > 1
    routed = tree._routed(centres)
    assert routed.select("list_id", "__cell").distinct().count() == routed.count()
    found = assign_lists(rows, centres, broadcast_limit=0)
    assert found.columns == ["id", "emb", "list_id"]
    owner = {r["id"]: r["list_id"] for r in found.collect()}
    assert owner == {**dict(enumerate(gaps.argmin(axis=1).tolist())), N + 4: None, N + 5: None}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    one, two = (
        {r["list_id"]: r["emb"] for r in train_lists(rows, 20, iterations=3, broadcast_limit=limit).collect()}
        for limit in (1 << 20, 0))
    assert one.keys() == two.keys() and all(np.allclose(one[i], two[i]) for i in one)
