from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nearfield.functions.hashing import drawn_ranks, hash_draw, replicate_draw, replicate_key
from nearfield.operators import bootstrap, sampling
from nearfield.functions.codec import decode_vector, encode_vector, quantise_column, error_report
from nearfield.functions.names import (
    format_bytes,
    index_name,
    order_datasets,
    parse_dataset,
    task_tags,
)
from nearfield.functions.vectors import euclidean_distance, permute_dimensions, seeded_permutation
from nearfield.operators.bootstrap import bootstrap_median
from nearfield.operators.buckets import assign_bucket
from nearfield.operators.layout import layout_columns, plan_layout, split_index, subset_rows
from nearfield.operators.metrics import histogram, latency_summary, recall_by_rank, recalls
from nearfield.operators.numbering import number_rows, number_rows_total, running_total
from nearfield.operators.profiles import profile_nodes, profile_rollup
from nearfield.operators.quality import (
    array_length_is,
    bijection,
    inexact_filters,
    unsorted_places,
    vector_report,
)
from nearfield.operators.quantiles import group_quantiles, rank_within
from nearfield.operators.ranges import matches_per_query, range_counts, skippable_blocks
from nearfield.operators.remap import remap_lists, remap_rows, zip_by_position
from nearfield.operators.runs import curve_blocks, rate_at_recall, recall_curve, timing_breakdown
from nearfield.operators.sampling import range_filters, sample, split_queries
from nearfield.session import scratch_root, scratch_scope


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows of which a third share one group and one value."""
    rng = np.random.default_rng(5)
    rows = [(i, "hot" if i < 1000 else f"g{i % 7}", 5.0 if i < 1000 else float(rng.integers(0, 50)) / 7)
            for i in range(3000)]
    return spark.createDataFrame(rows, "id long, grp string, v double").repartition(6).cache(), rows


def test_numbering_of_a_hot_key(spark, skewed):
    df, rows = skewed
    numbered, total = number_rows_total(df, ["v", "id"])
    expected = {i: at for at, (_, i) in enumerate(sorted((v, i) for i, _, v in rows))}
    assert total == 3000 and {r["id"]: r["idx"] for r in numbered.collect()} == expected


def test_numbering_of_nothing_and_one_row(spark):
    empty = spark.createDataFrame([], "id long")
    assert number_rows(empty, ["id"]).count() == 0
    assert number_rows(spark.createDataFrame([(7,)], "id long"), ["id"]).first()["idx"] == 0


def test_running_total(skewed):
    df, rows = skewed
    found = running_total(df.withColumn("n", F.col("id") % 5), ["v", "id"], "n")
    expected, total = {}, 0
    for _, i in sorted((v, i) for i, _, v in rows):
        total += i % 5
        expected[i] = total
    assert {r["id"]: r["total"] for r in found.collect()} == expected


def test_ranks_and_quantiles_of_a_hot_group(skewed):
    df, rows = skewed
    ranks = {r["id"]: r["rank"] for r in rank_within(df, ["grp"], ["v", "id"]).collect()}
    by_group = {}
    for i, g, v in rows:
        by_group.setdefault(g, []).append((v, i))
    assert all(ranks[i] == at for g in by_group.values() for at, (_, i) in enumerate(sorted(g), 1))
    found = group_quantiles(df, ["grp"], "v", "id", {"median": 0.5, "p95": 0.95, "top": 1.0})
    for r in found.collect():
        values = [v for v, _ in by_group[r["grp"]]]
        assert [r["median"], r["p95"], r["top"]] == pytest.approx(np.quantile(values, [0.5, 0.95, 1.0]))


def _mix(x):
    for _ in range(2):
        x = ((x >> 16) ^ x) * 0x45D9F3B % 2**32
    return (x >> 16) ^ x


def _draw(key, i, n):
    (a, b), (c, d) = ((625341585, 1664525), (1103515245, 22695477))
    low, high = i % 2**32, i >> 32
    first = _mix((key + low * a + high * b) % 2**32)
    second = _mix((key + 2654435769 + low * c + high * d) % 2**32)
    return (first * 2**31 + (second >> 1)) % n


def test_draws_reach_beyond_32_bits(spark):
    n = 30_000_000_000
    rows = spark.range(4000).select(
        hash_draw(1, F.col("id"), F.lit(n)).alias("a"),
        replicate_draw(replicate_key(1, F.lit(3)), F.col("id") * 7_500_001, F.lit(n)).alias("b"), "id").collect()
    for column in ("a", "b"):
        drawn = np.array([r[column] for r in rows]) / n
        assert drawn.min() >= 0 and drawn.max() < 1
        assert np.abs(np.histogram(drawn, 10, (0, 1))[0] - 400).max() < 100
    assert all(r["b"] == _draw(_mix(4), r["id"] * 7_500_001, n) for r in rows[:200])


@pytest.mark.parametrize("throughput", [False, True])
def test_bootstrap_against_numpy(spark, throughput):
    rng = np.random.default_rng(9)
    groups = {"a": rng.exponential(size=41), "b": rng.exponential(size=100), "one": [2.0], "two": [1.0, 4.0]}
    rows = [(f"{g}{i}", g, float(v)) for g, values in groups.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "id string, g string, v double")
    found = {r["g"]: r for r in bootstrap_median(
        df, ["g"], "v", "id", replicates=50, throughput=throughput).collect()}
    for g, values in groups.items():
        ordered = np.sort(values)
        n = len(ordered)
        turn = (lambda x: 1 / x) if throughput else (lambda x: x)
        estimate = turn(np.median(ordered))
        stats = [turn(np.median(ordered[[_draw(_mix(b + 42), i, n) for i in range(n)]])) for b in range(50)]
        low, high = np.quantile(stats, [0.025, 0.975]) if n > 1 else (estimate, estimate)
        r = found[g]
        assert (r["estimate"], r["lower_err"], r["upper_err"]) == pytest.approx(
            (estimate, estimate - low, high - estimate))
        assert r["n"] == n and r["few"] == (n < 30)


def test_draws_of_arrays_and_columns_agree(spark):
    rng = np.random.default_rng(4)
    n = np.array([1, 2, 7, 1000, 2**31 + 11, 2**40 + 3, 2**62 + 1])
    rows = [(int(rng.integers(2**32)), int(rng.integers(2**45)), int(n[i % 7])) for i in range(700)]
    table = spark.createDataFrame(rows, "key long, i long, n long")
    drawn = replicate_draw(F.col("key"), F.col("i"), F.col("n"))
    expected = [r["d"] for r in table.select(drawn.alias("d")).collect()]
    key, i, size = map(np.array, zip(*rows))
    assert drawn_ranks(key, i, size).tolist() == expected


@pytest.mark.parametrize("band, chunk, run", [(0.0, 1 << 18, 1 << 18), (0.5, 64, 100), (3.0, 7, 10)])
def test_bands_that_miss_are_widened(spark, monkeypatch, band, chunk, run):
    """Whatever the band, the parts of a resample and the rows worked on at once, the same interval."""
    rng = np.random.default_rng(6)
    rows = [(i, "a" if i < 700 else "b", float(v)) for i, v in enumerate(rng.exponential(size=1000))]
    df = spark.createDataFrame(rows, "id long, g string, v double")
    whole = sorted(bootstrap_median(df, ["g"], "v", "id", replicates=40).collect())
    for name, value in (("_BAND", band), ("_CHUNK", chunk), ("_RUN", run)):
        monkeypatch.setattr(bootstrap, name, value)
    assert sorted(bootstrap_median(df, ["g"], "v", "id", replicates=40).collect()) == whole


def test_states_hold_a_band_only():
    """Of a hundred thousand draws a state keeps a few thousand."""
    n = 100_000
    batch = pa.RecordBatch.from_pydict({
        "group_start": [0], "replicate": [3], "group_size": [n], "chunk": [0], "key": [77],
        "low": [n // 2 - 950], "high": [n // 2 + 950]})
    state = pa.Table.from_batches(bootstrap._states(batch)).to_pylist()[0]
    drawn = np.sort(drawn_ranks(np.full(n, 77), np.arange(n), np.full(n, n)))
    assert 1500 < len(state["inside"]) < 2300
    assert sorted(state["inside"])[n // 2 - state["below"]] == drawn[n // 2]


def test_latencies(spark, skewed):
    df, rows = skewed
    r = latency_summary(df.where("grp = 'g1'"), ["grp"], "v", "id").first()
    values = [v for _, g, v in rows if g == "g1"]
    assert (r["mean"], r["p99"], r["qps"]) == pytest.approx(
        (np.mean(values), np.quantile(values, 0.99), 1 / np.median(values)))


def test_range_counts_with_hot_values_and_inverted_ranges(spark, skewed):
    df, rows = skewed
    rng = np.random.default_rng(2)
    ranges = [(i, float(rng.uniform(-1, 8)), float(rng.uniform(-1, 8))) for i in range(200)]
    ranges += [(200, 5.0, 5.0), (201, 9.0, 10.0), (202, -5.0, -4.0)]
    q = spark.createDataFrame(ranges, "qid long, range_start double, range_end double")
    values = np.array([v for _, _, v in rows])
    expected = {i: int(((values >= lo) & (values <= hi)).sum()) for i, lo, hi in ranges}
    assert {r["qid"]: r["count"] for r in range_counts(df, "v", q).collect()} == expected


def test_fractions_against_integer_ranges(spark):
    values = spark.createDataFrame([(5.7,), (5.0,), (6.2,), (None,)], "v double")
    ranges = spark.createDataFrame([("a", 5, 5), ("b", 5, 6)], "qid string, range_start long, range_end long")
    assert {r["qid"]: r["count"] for r in range_counts(values, "v", ranges).collect()} == {"a": 1, "b": 2}
    days = spark.createDataFrame([(f"2020-01-0{i}",) for i in range(1, 6)], "d string").select(F.to_date("d").alias("d"))
    asked = spark.createDataFrame([(1, "2020-01-02", "2020-01-04")], "qid long, s string, e string").select(
        "qid", F.to_date("s").alias("range_start"), F.to_date("e").alias("range_end"))
    assert range_counts(days, "d", asked).first()["count"] == 3


def test_predicates_count_unmatched_queries(spark):
    queries = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "qid long, label string")
    values = spark.createDataFrame([("a",), ("a",), (None,)], "label string")
    assert {r["qid"]: r["n"] for r in matches_per_query(queries, values, "label").collect()} == {1: 2, 2: 0, 3: 0}


def test_blocks_beyond_62_bits(spark):
    big = 2**62 + 5
    blocks = spark.createDataFrame([(0, -big, -big + 2), (1, 0, 1), (2, big, big + 1)], "block long, low long, high long")
    q = spark.createDataFrame([(0, big, big), (1, -big, -big), (2, 5, 6)], "qid long, range_start long, range_end long")
    assert {r["qid"]: r["skipped"] for r in skippable_blocks(blocks, q).collect()} == {0: 2, 1: 2, 2: 3}


def test_skippable_blocks(spark):
    blocks = [(i, int(lo), int(lo) + i % 9) for i, lo in enumerate(np.random.default_rng(4).integers(0, 60, 40))]
    ranges = [(i, i, i + i % 13) for i in range(70)]
    b = spark.createDataFrame(blocks, "block long, low long, high long")
    q = spark.createDataFrame(ranges, "qid long, range_start long, range_end long")
    found = {r["qid"]: r["skipped"] for r in skippable_blocks(b, q).collect()}
    assert found == {i: sum(h < s or lo > e for _, lo, h in blocks) for i, s, e in ranges}


def test_filters_are_exact_and_ties_are_reported(spark):
    unique = spark.createDataFrame([(i * 3,) for i in range(997)], "a long")
    filters = range_filters(unique, "a", per_rate=20)
    assert filters.count() == 21 * 20 and inexact_filters(unique, "a", filters).count() == 0
    tied = spark.createDataFrame([(i // 2,) for i in range(997)], "a long")
    assert inexact_filters(tied, "a", range_filters(tied, "a", per_rate=20)).count() > 0


def test_sample_and_split(spark):
    df = spark.range(1000).select("id", (F.col("id") * 2).alias("x"))
    rows = sample(df, 100, 7).orderBy("id").collect()
    assert [r["id"] for r in rows] == list(range(100))
    assert [r["original_id"] for r in rows] == sorted({r["original_id"] for r in rows})
    assert all(r["x"] == 2 * r["original_id"] for r in rows)
    queries, rest = split_queries(df, 100, 7)
    taken = {r["original_id"] for r in queries.collect()}
    left = {r["id"] for r in rest.collect()}
    assert not taken & left and len(taken | left) == 1000


def test_unmapped_ids_fail_or_show(spark):
    mapping = spark.createDataFrame([(0, 10), (1, 11)], "old_id long, new_id long")
    lists = spark.createDataFrame([(0, [1, 0]), (1, [0, 5]), (2, [])], "id long, neighbors_id array<long>")
    with pytest.raises(Exception, match="id without a new id: 5"):
        remap_lists(lists, mapping).collect()
    loose = {r["id"]: r["neighbors_id"] for r in remap_lists(lists, mapping, strict=False).collect()}
    assert loose == {0: [11, 10], 1: [10, None], 2: []}
    with pytest.raises(Exception, match="id without a new id: 2"):
        remap_rows(lists, mapping).collect()


def test_zip_needs_equal_lengths(spark):
    a = spark.range(3).select(F.col("id").alias("a"))
    with pytest.raises(ValueError):
        zip_by_position(a, spark.range(4).select(F.col("id").alias("b")), "a", "b")


def test_recall_edges(spark):
    truth = spark.createDataFrame([(0, [1, 2, 3]), (1, [4]), (2, [5, 6, 7])], "id long, neighbors_id array<long>")
    found = spark.createDataFrame([(0, [3, 3, 9]), (1, [4])], "id long, neighbors_id array<long>")
    rows = {r["id"]: (r["recall"], r["short_truth"]) for r in recalls(found, truth, 2).collect()}
    assert rows == {0: (0.0, False), 1: (None, True), 2: (0.0, False)}
    with pytest.raises(Exception, match="fewer than 2"):
        recalls(found, truth, 2, strict=True).collect()


def test_recall_of_a_run_that_found_nothing(spark):
    truth = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 3, 1)], "qid long, id long, rank long")
    found = spark.createDataFrame([("a", 0, 1, 1), ("a", 0, 9, 2)], "run string, qid long, id long, rank long")
    every = spark.createDataFrame([("a",), ("b",)], "run string")
    rows = {r["run"]: r["recall"] for r in recall_by_rank(found, truth, ["run"], 2, every=every).collect()}
    assert rows == {"a": 0.5, "b": 0.0}  # the query with one true neighbour is left out


def test_buckets(spark):
    shares = [0.0, 0.001, 0.01, 0.0999, 0.1, 0.5, 0.75, 1.0]
    df = spark.createDataFrame([(s,) for s in shares], "s double")
    plain = assign_bucket(F.col("s"), [(0, 10), (75, 100)])
    assert [r[0] for r in df.select(plain).collect()] == [0, 0, 0, 0, -1, -1, 1, 1]
    points = assign_bucket(F.col("s"), [(75, 100), (1.0, 1.0), (0.1, 0.1)])
    assert [r[0] for r in df.select(points).collect()] == [-1, 2, 1, -1, -1, -1, 0, 0]
    open_last = assign_bucket(F.col("s"), [(0, 10)], close_last=False)
    assert [r[0] for r in df.select(open_last).collect()] == [0, 0, 0, 0, -1, -1, -1, -1]


def test_histogram_has_empty_bins_and_a_closed_end(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 9, 10, 10)], "x double")
    assert [r["n"] for r in histogram(df, "x", 5).orderBy("bin").collect()] == [2, 0, 0, 0, 3]


def test_layouts(spark):
    assert plan_layout(10 * 2**30, 1_000_000, 4 * 2**30).rows_per_file == 122_880 * 3
    tiny = plan_layout(100, 10, 4 * 2**30)
    assert (tiny.files, tiny.full_files, tiny.remainder) == (1, 0, 10)
    big = plan_layout(10**12, 1000, 10)
    assert big.rows_per_file == 122_880
    assert subset_rows(10**9, 1_000_000, 0.5) == 536_870 // 122_880 * 122_880
    assert subset_rows(100, 1_000_000, 5.0) == 8 * 122_880
    cases = spark.createDataFrame([(10 * 2**30, 1_000_000), (10**12, 1000)], "b long, r long")
    for row in cases.withColumn("l", layout_columns(F.col("b"), F.col("r"), 5 * 2**30, 0.9)).collect():
        plan = plan_layout(row["b"], row["r"], 5 * 2**30, 0.9)
        assert tuple(row["l"]) == (plan.rows_per_file, plan.files, plan.full_files, plan.remainder)


def test_many_split_sizes(spark):
    sizes = [3, 0, 1] * 500 + [7]
    rows = spark.range(sum(sizes)).select(F.col("id").alias("idx"))
    counts = {r["file_idx"]: r["count"] for r in split_index(rows, sizes).groupBy("file_idx").count().collect()}
    assert counts == {i: n for i, n in enumerate(sizes) if n}
    for wrong in ([*sizes, 1], sizes[:-1]):
        with pytest.raises(ValueError, match="do not fit"):
            split_index(rows, wrong)


def test_checks(spark):
    good = spark.createDataFrame([(5, 0), (9, 1)], "old_id long, new_id long")
    twice = spark.createDataFrame([(5, 0), (9, 0)], "old_id long, new_id long")
    assert bijection(good).first()["ok"] and not bijection(twice).first()["ok"]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate([1, 2, 2, 5, 4, 6, 0, 7])], "idx long, k long")
    for block in (1, 3, 4, 100):
        r = unsorted_places(rows, "k", rows_per_block=block).first()
        assert (r["rows"], r["falls"], r["ok"]) == (8, 2, False)
    vecs = spark.createDataFrame(
        [([1.0, 2.0],), ([1.0],), (None,), ([float("nan"), 1.0],), ([float("inf"), 1.0],), ([None, 1.0],)],
        "emb array<float>")
    assert tuple(vector_report(vecs, "emb", 2).first()) == (6, 1, 1, 3)
    arrays = spark.createDataFrame([(1, [1.0, 2.0]), (2, []), (3, None)], "id long, xs array<double>")
    assert [r["id"] for r in array_length_is(arrays, "xs", 2).collect()] == [1]
    with pytest.raises(Exception, match="expected 2 values but got"):
        array_length_is(arrays, "xs", 2, strict=True).collect()


def test_vector_functions_pass_nulls_on(spark):
    rows = [(0, [0.0, 0.0], [3.0, 4.0]), (1, None, [1.0, 1.0]), (2, [1.0, 1.0], [1.0, 2.0])]
    df = spark.createDataFrame(rows, "id int, a array<float>, b array<float>").coalesce(1)
    assert [r[0] for r in df.orderBy("id").select(euclidean_distance(F.col("a"), F.col("b"))).collect()] == [5.0, None, 1.0]
    order = seeded_permutation(2, 42)
    moved = df.where("id = 0").select(permute_dimensions(F.col("b"), order)).first()[0]
    assert moved == [[3.0, 4.0][i] for i in order]
    with pytest.raises(ValueError):
        permute_dimensions(F.col("b"), [0, 0])


def test_codec(spark):
    values = [0.0, 0.08191, -0.08192, 0.5, -0.81, 8.0, 81.91, 500.0, -500.0, 0.000005, 0.000015]
    df = spark.createDataFrame([(values,)], "emb array<double>")
    codes = df.select(encode_vector(F.col("emb"))).first()[0]
    expected = []
    for v in values:
        for x, scale in enumerate([100000.0, 10000.0, 1000.0, 100.0]):
            if -8192 <= round(v * scale) <= 8191:
                expected.append(round(v * scale) * 4 + x)
                break
        else:
            expected.append(max(-8192, min(8191, round(v * 100))) * 4 + 3)
    assert codes == expected
    decoded = df.select(decode_vector(encode_vector(F.col("emb")))).first()[0]
    assert decoded[:7] == pytest.approx([0.0, 0.08191, -0.08192, 0.5, -0.81, 8.0, 81.91])
    assert error_report(quantise_column(df)).first()["elements"] == len(values)


def test_names(spark):
    names = ["ArxivForFanns (1.2M × 1024)", "OpenAI (50K × 1536)", "Tiny (12 × 8)", "plain", "odd (x)"]
    df = spark.createDataFrame([(n,) for n in names], "dataset string")
    parsed = {r["dataset"]: r["p"] for r in df.select("dataset", parse_dataset(F.col("dataset")).alias("p")).collect()}
    assert tuple(parsed[names[0]]) == ("ArxivForFanns", "1.2M", 1_200_000, 1024, 1_200_000 * 4096)
    assert tuple(parsed["Tiny (12 × 8)"]) == ("Tiny", "12", 12, 8, 384)
    assert parsed["plain"]["base"] == "plain" and parsed["odd (x)"]["base"] == "odd" and parsed["plain"]["n"] is None
    assert [r[0] for r in order_datasets(df).collect()] == ["Tiny (12 × 8)", names[1], names[0], "odd (x)", "plain"]
    sizes = spark.createDataFrame([(x,) for x in (0, 1023, 1024, 1536, 4558821312, 2**50, 2**60)], "n long")
    assert [r[0] for r in sizes.select(format_bytes(F.col("n"))).collect()] == [
        "0 B", "1023 B", "1.00 KiB", "1.50 KiB", "4.25 GiB", "1.00 PiB", "1024.00 PiB"]
    runs = spark.createDataFrame(
        [("FLAT", None, None), ("HNSW", None, None), ("X", "u8", "true"), ("X", None, None), ("Y", "u8", None)],
        "kind string, q string, g string")
    shown = index_name(F.col("kind"), F.col("q"), F.col("g"), ivf_kind="X", ivf_name="Engine X")
    assert [r[0] for r in runs.select(shown).collect()] == [
        "DuckDB", "DuckDB VSS (HNSW)", "Engine X (IVF, Global, U8)", "Engine X (IVF, Row Group, F32)", "Y"]
    labels = spark.createDataFrame([("tool_Case1_23-01-02",), ("tool_23-01-02",)], "t string")
    assert [tuple(r[0]) for r in labels.select(task_tags(F.col("t"))).collect()] == [
        ("tool", "Case1", "23-01-02"), ("tool", None, "23-01-02")]


def test_profiles(spark):
    tree = """{"latency": 10.0, "all_optimizers": 1.0, "planner": 0.5, "children": [
      {"operator_name": "A", "operator_timing": 1.0, "children": [
        {"operator_name": " SEQ_SCAN", "operator_timing": 2.0, "children": []},
        {"operator_name": "IDX", "operator_timing": 7.0}]},
      {"operator_name": "IDX", "operator_timing": 3.0, "children": []}]}"""
    df = spark.createDataFrame([(1, tree)], "id int, p string")
    r = profile_rollup(df, "p", ["id"], index_scans=["IDX"]).first()
    assert (r["nodes"], r["index_scan"], r["sequential_scan"]) == (5, 7.0, 2.0)
    assert (r["other_operators"], r["planning"], r["index_scan_residual"]) == (1.0, 1.5, 5.5)
    deep = '{"operator_name": "IDX", "operator_timing": 4.0}'
    for _ in range(30):
        deep = f'{{"operator_name": "A", "operator_timing": 1.0, "children": [{deep}]}}'
    df = spark.createDataFrame([(1, deep), (2, None), (3, "no tree")], "id int, p string")
    rows = {r["id"]: r for r in profile_rollup(df, "p", ["id"], index_scans=["IDX"]).collect()}
    assert (rows[1]["nodes"], rows[1]["index_scan"], rows[1]["other_operators"]) == (31, 4.0, 30.0)
    assert rows[2]["nodes"] == rows[3]["nodes"] == 1 and rows[2]["index_scan"] is None
    paths = [r["path"] for r in profile_nodes(df, "p", ["id"]).where("id = 1").collect()]
    assert sorted(map(len, paths)) == list(range(31))


def test_rate_at_recall_reports_missing_sides(spark):
    rows = [(0, "d1", "g", 0.91, 100.0), (1, "d1", "g", 0.95, 90.0), (2, "d1", "l", 0.90, 75.0),
            (3, "d2", "g", 0.99, 10.0), (4, "d2", "l", 0.5, 99.0), (5, "d3", "g", 0.1, 1.0)]
    df = spark.createDataFrame(rows, "id long, dataset string, index string, recall double, qps double")
    found = {r["dataset"]: r for r in rate_at_recall(
        df, ["dataset"], "index", "g", "l", recall="recall", rate="qps", id_col="id").collect()}
    assert (found["d1"]["base_qps"], found["d1"]["decrease_pct"], found["d1"]["missing"]) == (100.0, 25.0, None)
    assert found["d2"]["missing"] == "other" and found["d3"]["missing"] == "both"


def test_breakdown_drops_components_that_are_always_zero(spark):
    df = spark.createDataFrame([("a", 0.001, 0.0, 0.0, 0.5), ("b", 0.003, 0.0, 0.002, 0.25)],
                               "run string, x double, y double, z double, latency double")
    rows = {(r["run"], r["component"]): r for r in timing_breakdown(df, ["run"], ["x", "y", "z"], "latency").collect()}
    assert set(rows) == {("a", "x"), ("a", "z"), ("b", "x"), ("b", "z")}
    assert rows["b", "x"]["total_ms"] == pytest.approx(5.0) and rows["b", "z"]["qps"] == 4.0


def test_lowest_rows_without_a_sort(spark):
    """Ties in the first key, nulls, NaN and text keys; few rows are left whatever the table's order."""
    odd = "CASE WHEN id % 997 = 0 THEN NULL WHEN id % 991 = 0 THEN double('NaN') ELSE (id * 7919) % 1000 END"
    df = spark.range(60_000).selectExpr("id", f"{odd} AS x", "md5(string(id)) AS s", "id % 3 AS z").repartition(6)
    for keys in (["x", "id"], ["s"], [F.col("z"), "id"], [F.col("x") + 1, "s"]):
        order = [F.col(k) if isinstance(k, str) else k for k in keys]
        for n in (0, 1, 700, 5_000, 40_000, 70_000):
            few = sampling.lowest(df, keys, n)
            left = few.count()
            assert left >= min(n, 60_000) and (n > 5_000 or left < 15_000)
            if n in (700, 40_000):
                truth = [r.id for r in df.sort(*order).limit(n).collect()]
                found = sampling.head(df, keys, n, "at").sort("at").collect()
                assert [r.id for r in found] == truth and [r["at"] for r in found] == list(range(n))
    assert sampling.lowest(df.limit(0), ["id"], 5).count() == 0


def test_a_cut_reaches_the_scan(spark, tmp_path, capsys):
    spark.range(60_000).write.parquet(str(tmp_path / "t"))
    few = sampling.lowest(spark.read.parquet(str(tmp_path / "t")), ["id"], 100)
    few.explain()
    plan = capsys.readouterr().out
    assert "LessThanOrEqual(id" in plan and "Sort" not in plan and "Exchange" not in plan


def test_scratch_scopes_leave_nothing_but_what_is_kept(spark):
    root = Path(scratch_root(spark).removeprefix("file:"))
    before = set(root.iterdir())
    with scratch_scope(spark) as outer:
        with scratch_scope(spark) as inner:
            numbered = number_rows(spark.range(50), [F.col("id").desc()], "n")
            passed = inner.keep(numbered)
        assert passed.count() == 50
        kept = outer.keep(passed.where("n < 5"))
    assert sorted((r.id, r.n) for r in kept.collect()) == [(49 - n, n) for n in reversed(range(5))]
    assert len(set(root.iterdir()) - before) == 1
    with pytest.raises(ZeroDivisionError), scratch_scope(spark):
        number_rows(spark.range(50), ["id"], "n")
        1 / 0  # noqa: B018
    assert len(set(root.iterdir()) - before) == 1


def test_curves_in_blocks(spark):
    df = spark.range(25).selectExpr("'a' AS g", "(id * 7) % 25 AS recall", "id AS qps", "id")
    rows = curve_blocks(recall_curve(df, ["g"], "recall", "qps", "id"), ["g"], "recall", "qps", 10).sort("block").collect()
    assert [(r.block, len(r.points)) for r in rows] == [(0, 10), (1, 10), (2, 5)]
    assert [p.recall for r in rows for p in r.points] == list(range(25))
