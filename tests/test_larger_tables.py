"""Queries and operators on what only larger tables have."""

import numpy as np
import pyarrow as pa
import pytest
from brute import collected, neighbours
from pyspark.sql import functions as F

from nearfield.operators import ann, bootstrap, kernels, knn
from nearfield.operators.ann import local_lists, search_local_lists
from nearfield.operators.bootstrap import bootstrap_median
from nearfield.operators.knn import Range, nearest, nearest_partial, rank_nearest
from nearfield.plans.catalogue import QUERIES
from nearfield.session import materialize


def test_sizes_beyond_64_bits_are_shown(spark, tmp_path):
    lines = [(1, 20_000, 5, 7), (2, 120_000, 9, 7), (3, 1_200_000, 1, 7), (4, 1, 3, 1)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(
        str(tmp_path / "lineitem.parquet"))
    rows = QUERIES["SF3_formatted_bytes"](spark, str(tmp_path)).collect()
    assert {r["id"]: (r["shown"], r["short"]) for r in rows} == {
        17: ("7289.10 PiB", "7289 PiB"), 27: ("43734.61 PiB", "43735 PiB"), 37: ("437346.06 PiB", "437346 PiB"),
        41: ("16.21 MiB", "16 MiB")}


def test_resamples_of_many_groups_are_not_broadcast(spark, monkeypatch):
    """Replicates are many times the groups they come from, which Spark's estimate does not know."""
    rows = [(i, i % 300, float((i * 7919) % 1013)) for i in range(1500)] + [(1500 + i, 300, float(i)) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, g long, v double")
    joins = []
    plain = bootstrap.materialize

    def seen(table, label):
        joins.append(table._jdf.queryExecution().executedPlan().toString() if label == "middles" else "")
        return plain(table, label)

    whole = sorted(bootstrap_median(df, ["g"], "v", "id", replicates=60).collect())
    monkeypatch.setattr(bootstrap, "materialize", seen)
    for chunk in (1 << 18, 8):  # all groups where they lie, all but one
        monkeypatch.setattr(bootstrap, "_CHUNK", chunk)
        monkeypatch.setattr(bootstrap, "_DRAWS_PER_TASK", 1000)
        joins.clear()
        assert sorted(bootstrap_median(df, ["g"], "v", "id", replicates=60).collect()) == whole
        assert not any("BroadcastHashJoin" in x for x in joins)
        assert any(joins) == (chunk < 100)


def _vectors(spark, n, m, seed=0):
    rng = np.random.default_rng(seed)
    base = [{"id": i, "emb": rng.integers(-3, 4, 4).astype(float).tolist(), "label": "hot" if i % 2 else f"l{i % 5}",
             "attr": int(rng.integers(0, 90)), "keys": [int(x) for x in rng.choice(40, 3, replace=False)]} for i in range(n)]
    queries = [{"qid": i, "emb": rng.integers(-3, 4, 4).astype(float).tolist(), "label": ["hot", "l2"][i % 2],
                "low": i % 70, "high": i % 70 + i % 30, "keys": [int(x) for x in rng.choice(40, 3, replace=False)]}
               for i in range(m)]
    b = spark.createDataFrame([tuple(x.values()) for x in base], "id long, emb array<float>, label string, attr long, keys array<long>")
    q = spark.createDataFrame([tuple(x.values()) for x in queries],
                              "qid long, emb array<float>, label string, low long, high long, keys array<long>")
    return base, queries, b, q


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


KINDS = {
    "KN1": ({}, lambda x, y: True),
    "KN3": ({"key": "label"}, lambda x, y: x["label"] == y["label"]),
    "KN4": ({"within": Range("attr", "low", "high"), "metric": "cosine"}, lambda x, y: x["low"] <= y["attr"] <= x["high"]),
}


@pytest.mark.parametrize("case", KINDS)
def test_small_blocks_share_tasks_and_waves(spark, monkeypatch, case):
    """A query goes once to a task, not once to a block, and waves follow memory, not the blocks' size."""
    base, queries, b, q = _vectors(spark, 400, 150)
    kind, passes = KINDS[case]
    sizes = {"broadcast_limit": 0, "block_values": 4 * 16, **kind}
    assert _plan(nearest_partial(q, b, 7, **sizes)).count("FlatMapCoGroupsInArrow") == 1
    expected = {x: ids for x, ids in neighbours(queries, base, 7, kind.get("metric", "euclidean"), passes).items() if ids}
    assert collected(nearest(q, b, 7, **sizes)) == expected
    monkeypatch.setattr(knn, "BLOCK_VALUES", 4 * 100)  # four tasks at least, and some waves
    monkeypatch.setattr(knn, "_ASKED", 11)
    monkeypatch.setattr(kernels, "_PIECE", 24)
    assert collected(nearest(q, b, 7, **sizes)) == expected


def test_queries_go_to_a_task_once(spark):
    _, _, b, q = _vectors(spark, 400, 30)
    for place in (
        lambda: knn._in_all_blocks(q, b, 100, 8), lambda: knn._by_key(q, b, "label", 100, 4, 8),
        lambda: knn._by_range(q, b, Range("attr", "low", "high"), 100, 4, 8),
    ):
        sent, placed = place()
        assert sent.count() == sent.select("qid", "__cell").distinct().count() <= 30 * 8
        assert placed.select("__cell").distinct().count() == 8 and placed.count() == 400


def test_pieces_spans_and_marks_against_all_pairs(monkeypatch):
    """Rows in pieces, runs of places, marks in several words, and rows that come again or stand twice."""
    monkeypatch.setattr(kernels, "_PIECE", 16)
    rng = np.random.default_rng(1)
    q, b = rng.integers(-2, 3, (40, 5)).astype(float), rng.integers(-2, 3, (300, 5)).astype(float)
    b[200:] = b[100:200]
    ids = np.r_[np.arange(200), np.arange(100, 200)]
    low = rng.integers(0, 300, 40)
    high = np.minimum(low + rng.integers(0, 150, 40), 300)
    marks = [rng.integers(0, 2**62, (n, 3)).astype(np.uint64) & np.uint64(0x0010010001000010) for n in (40, 300)]
    gaps = np.sqrt(((q[:, None] - b[None]) ** 2).sum(axis=2))
    for span, bits, once in ((None, None, False), ((low, high), None, False), (None, marks, True), ((low, high), marks, True)):
        top = kernels.TopK(kernels.VectorBlock(q, "euclidean"), 6, "euclidean", once=once)
        for _ in range(1 + once):
            top.add(np.arange(40), kernels.VectorBlock(b, "euclidean"), ids, span, bits)
        for i in range(40):
            rows = [j for j in range(300) if (span is None or low[i] <= j < high[i])
                    and (bits is None or (marks[0][i] & marks[1][j]).any())]
            pairs = [(gaps[i, j], ids[j]) for j in rows]
            wanted = sorted(set(pairs) if once else pairs)[:6]
            held = np.isfinite(top.keys[i])
            assert top.ids[i][held].tolist() == [j for _, j in wanted]
            assert top.keys[i][held].tolist() == pytest.approx([gap for gap, _ in wanted])


@pytest.mark.parametrize("sizes", [{}, {"broadcast_limit": 3000}, {"broadcast_limit": 0, "block_values": 4 * 16}])
@pytest.mark.parametrize("words", [16, 0])
def test_rows_that_share_several_keys_count_once(spark, monkeypatch, sizes, words):
    """By marks, whether a key's rows or all pairs are compared, and key by key where keys are too many."""
    base, queries, b, q = _vectors(spark, 300, 60)
    for x in (*base[:200], *queries[:30]):
        x["keys"] = [x["keys"][0] % 2, 2]
    few = F.when(F.col("id") < 200, F.array(F.col("keys")[0] % 2, F.lit(2).cast("long"))).otherwise(F.col("keys"))
    b = b.withColumn("keys", few)
    q = q.withColumnRenamed("qid", "id").withColumn("keys", F.when(F.col("id") < 30, F.array(
        F.col("keys")[0] % 2, F.lit(2).cast("long"))).otherwise(F.col("keys"))).withColumnRenamed("id", "qid")
    monkeypatch.setattr(knn, "_MOST_WORDS", words)
    found = rank_nearest(nearest_partial(q, b.unionByName(b.limit(0)), 6, key="keys", **sizes), 6, "euclidean")
    expected = neighbours(queries, base, 6, passes=lambda x, y: bool({*x["keys"]} & {*y["keys"]}))
    assert collected(found) == {x: ids for x, ids in expected.items() if ids}


@pytest.mark.parametrize("words", [16, 0])
def test_local_lists_are_probed_where_their_rows_are(spark, monkeypatch, words):
    """No table of queries and blocks or lists; ids that repeat take the form with tables, as before."""
    _, _, b, q = _vectors(spark, 300, 40)
    blocks = b.select("id", "emb", F.floor(F.col("id") / 60).alias("block"))
    assigned, centres = local_lists(blocks, rows_per_list=10, iterations=2)
    assigned, centres = materialize(assigned, "assigned"), materialize(centres, "centres")
    asked = q.select("qid", "emb")
    by_tables = collected(search_local_lists(asked, assigned, centres, 5, 2, broadcast_limit=0))
    monkeypatch.setattr(ann, "nearest_partial", None)
    monkeypatch.setattr(ann, "_MOST_WORDS", words)
    assert collected(search_local_lists(asked, assigned, centres, 5, 2)) == by_tables
    assert collected(search_local_lists(asked, assigned, centres, 5, 2, broadcast_limit=2500)) == by_tables
    with pytest.raises(TypeError):
        search_local_lists(asked.unionByName(asked.limit(1)), assigned, centres, 5, 2)


@pytest.mark.parametrize("sizes", [{}, {"broadcast_limit": 0, "block_values": 4 * 16}])
def test_rates_compare_a_pair_once(spark, monkeypatch, sizes):
    base, queries, b, q = _vectors(spark, 300, 20)
    rates, asked, plain = [0.9, 0.0, 0.5, 0.99], [], knn.nearest_partial

    def seen(queries, *args, **kinds):
        asked.append(queries.count())
        return plain(queries, *args, **kinds)

    monkeypatch.setattr(knn, "nearest_partial", seen)
    found = knn.nearest_by_filter_rate(q, b, rates, 5, **sizes).collect()
    assert asked == [20]  # it was a row for every query and rate
    for rate in rates:
        expected = neighbours(queries, [x for x in base if x["id"] >= rate * 300], 5)
        rows = sorted((r for r in found if r["filter_rate"] == rate), key=lambda r: r["rank"])
        assert {x: [r["id"] for r in rows if r["qid"] == x] for x in expected} == expected


def test_waves_are_sized_by_all_lists_of_a_query(spark, monkeypatch):
    """A query with eight places has eight lists while a task compares it, so fewer make a wave."""
    _, _, b, q = _vectors(spark, 300, 60)
    keyed = b.withColumn("key", F.col("id") % 8)
    asked = q.withColumn("key", F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")))
    monkeypatch.setattr(knn, "BLOCK_VALUES", 4 * 100)
    monkeypatch.setattr(knn, "_PLAN_WAVES", 50)
    waves = [
        _plan(nearest_partial(asked, keyed, 5, key="key", broadcast_limit=0, block_values=4 * 16, **place)).count("FlatMapCoGroupsInArrow")
        for place in ({}, {"place": "place"})]
    assert waves == [3, 15]


def test_found_lists_leave_a_task_in_pieces(monkeypatch):
    """A task that has lists of many queries and places does not make one batch of them."""
    monkeypatch.setattr(knn, "_FOUND", 4)
    asked = knn._Queries(pa.table({"qid": list(range(30)), "emb": [[float(i), 1.0] for i in range(30)]}), knn._Spec(
        3, "euclidean", None, None, ()))
    top = asked.collector()
    asked.add(top, pa.record_batch({"id": [5, 6, 7, 8], "emb": [[1.0, 1.0], [9.0, 1.0], [2.0, 2.0], [20.0, 1.0]]}))
    batches = list(asked.pieces(top))
    assert [b.num_rows for b in batches] == [12] * 7 + [6]
    assert pa.Table.from_batches(batches).equals(pa.Table.from_batches([asked.found(top)]))
