import json

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from nearfield.functions.names import label_field
from nearfield.operators.layout import file_index
from nearfield.sources import readers, records, writers


def _shard(path, ids):
    table = pa.table({"id": pa.array(ids, pa.int64()), "emb": pa.array([[float(i), 0.0] for i in ids])})
    pq.write_table(table, path)


def test_shards_in_name_order(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.read_shards(spark, str(tmp_path))
    for at, ids in enumerate([[5, 3], [9], [1, 2, 0]]):
        _shard(tmp_path / f"train-{at:02d}-of-3.parquet", ids)
    rows = readers.read_shards(spark, str(tmp_path)).orderBy("position").collect()
    assert [(r["id"], r["shard_no"], r["position"]) for r in rows] == [
        (5, 0, 0), (3, 0, 1), (9, 1, 2), (1, 2, 3), (2, 2, 4), (0, 2, 5)]
    _shard(tmp_path / "shuffle_train-00-of-1.parquet", [7])
    assert [r["id"] for r in readers.read_shards(spark, str(tmp_path)).collect()] == [7]


def test_double_vectors_become_float(spark, tmp_path):
    _shard(tmp_path / "v.parquet", [1, 2])
    df = readers.read_vectors(spark, str(tmp_path / "v.parquet"))
    assert dict(df.dtypes) == {"id": "bigint", "emb": "array<float>"}


def test_line_numbers_over_many_splits(spark, tmp_path):
    n = 0
    for name in ("b.jsonl", "a.jsonl", "c.jsonl"):
        lines = [json.dumps({"file": name, "i": i, "pad": "x" * (i % 50)}) for i in range(400)]
        (tmp_path / name).write_text("\n".join(lines) + "\n")
        n += 400
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = readers.read_jsonl_ordered(spark, str(tmp_path), "file string, i int").orderBy("line").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["line"] for r in rows] == list(range(n))
    assert [(r["file"], r["i"]) for r in rows] == [(f"{f}.jsonl", i) for f in "abc" for i in range(400)]


@pytest.mark.parametrize("indent", [None, 2])
def test_neighbour_map_as_any_json(spark, tmp_path, indent):
    expected = {0: [3, 1, 2], 10: [], 2: [7]}
    (tmp_path / "gt.json").write_text(json.dumps({str(k): v for k, v in expected.items()}, indent=indent))
    rows = readers.read_neighbour_map(spark, str(tmp_path / "gt.json")).collect()
    assert {r["id"]: r["neighbors_id"] for r in rows} == expected


@pytest.mark.parametrize("indent", [None, 2])
def test_id_mapping_as_any_json(spark, tmp_path, indent):
    expected = {i: (i * 7) % 100 for i in range(100)}
    (tmp_path / "m.json").write_text(json.dumps({"old_to_new": expected}, indent=indent))
    rows = readers.read_id_mapping(spark, str(tmp_path / "m.json")).collect()
    assert {r["old_id"]: r["new_id"] for r in rows} == expected


def _document(path):
    return json.loads("".join(p.read_text() for p in sorted(path.glob("part-*"))))


def test_written_documents_are_json(spark, tmp_path):
    mapping = spark.range(50).select(F.col("id").alias("old_id"), ((F.col("id") + 20) % 50).alias("new_id"))
    writers.write_id_mapping(mapping, str(tmp_path / "m"))
    assert _document(tmp_path / "m") == {"old_to_new": {str(i): (i + 20) % 50 for i in range(50)}}
    lists = spark.createDataFrame([(0, [4, 5]), (1, [])], "id long, neighbors_id array<long>")
    writers.write_neighbour_map(lists, str(tmp_path / "n"))
    assert _document(tmp_path / "n") == {"0": [4, 5], "1": []}
    report = spark.createDataFrame(
        [(1, 5, 9, 3, 0.3), (0, 1, 2, 1, 0.1)],
        "qid long, range_start long, range_end long, count long, selectivity double")
    writers.write_selectivity_report(report, 10, str(tmp_path / "s"))
    assert _document(tmp_path / "s") == {"total_rows": 10, "num_queries": 2, "queries": [
        {"range_start": 1, "range_end": 2, "count": 1, "selectivity": 0.1},
        {"range_start": 5, "range_end": 9, "count": 3, "selectivity": 0.3}]}


def test_fvecs(spark, tmp_path):
    values = np.random.default_rng(0).normal(size=(20, 3)).astype("<f4")

    def write(name, rows, dim=3):
        heads = np.full((len(rows), 1), dim, "<i4").view("<f4")
        (tmp_path / name).write_bytes(np.hstack([heads, rows]).tobytes())

    write("a.fvecs", values[:12])
    write("b.fvecs", values[12:])
    rows = readers.read_fvecs(spark, str(tmp_path / "*.fvecs"), 3, 20).orderBy("record").collect()
    assert [r["record"] for r in rows] == list(range(20))
    assert np.array([r["emb"] for r in rows], "f4").tolist() == values.tolist()
    wanted = spark.createDataFrame([(3,), (15,)], "record long")
    some = readers.read_fvecs_subset(spark, str(tmp_path / "*.fvecs"), 3, wanted).orderBy("record").collect()
    assert [r["emb"] for r in some] == [values[3].tolist(), values[15].tolist()]
    with pytest.raises(ValueError, match="20 vectors instead of 21"):
        readers.read_fvecs(spark, str(tmp_path / "*.fvecs"), 3, 21)
    with pytest.raises(ValueError, match="not a multiple"):
        readers.read_fvecs(spark, str(tmp_path / "a.fvecs"), 4)
    write("c.fvecs", values[:4], dim=9)
    with pytest.raises(Exception, match="does not have 3 dimensions"):
        readers.read_fvecs(spark, str(tmp_path / "c.fvecs"), 3).collect()


def test_fvecs_are_read_by_ranges(spark, tmp_path, monkeypatch):
    values = np.random.default_rng(1).normal(size=(500, 3)).astype("<f4")
    heads = np.full((500, 1), 3, "<i4")
    heads[[7, 300]] = 99  # broken records that nobody asks for
    raw = np.hstack([heads.view("<f4"), values])
    for name, a, b in (("x y.fvecs", 0, 210), ("y.fvecs", 210, 210), ("z.fvecs", 210, 500)):
        (tmp_path / name).write_bytes(raw[a:b].tobytes())
    asked = [0, 5, 6, 8, 209, 210, 211, 299, 301, 499]
    wanted = spark.createDataFrame([(n,) for n in [*asked, 5, 5, -1, 500, None]], "record long")
    for gap, piece, seeks in ((64, 4096, 4096), (0, 16, 2), (64, 64, 3)):
        monkeypatch.setattr(records, "_GAP", gap)
        monkeypatch.setattr(records, "_PIECE", piece)
        monkeypatch.setattr(records, "_SEEKS", seeks)
        rows = readers.read_fvecs_subset(spark, str(tmp_path), 3, wanted).collect()
        assert sorted(r["record"] for r in rows) == asked
        assert all(np.array(r["emb"], "f4").tolist() == values[r["record"]].tolist() for r in rows)
    monkeypatch.setattr(records, "_RANGE", 16 * 37)
    monkeypatch.setattr(records, "_PIECE", 16 * 5)
    raw[[7, 300], 0] = raw[0, 0]
    (tmp_path / "x y.fvecs").write_bytes(raw[:210].tobytes())
    (tmp_path / "z.fvecs").write_bytes(raw[210:].tobytes())
    every = readers.read_fvecs(spark, str(tmp_path), 3, 500)
    assert every.rdd.getNumPartitions() == 6 + 8
    rows = every.orderBy("record").collect()
    assert [r["record"] for r in rows] == list(range(500))
    assert np.array([r["emb"] for r in rows], "f4").tolist() == values.tolist()


def test_runs_read_little_beside_what_is_asked():
    sizes = np.array([100, 0, 1, 899])
    files = records.RecordFiles(["a", "b", "c", "d"], np.cumsum(sizes) - sizes, sizes, 3)
    rng = np.random.default_rng(4)
    for n in (0, 1, 20, 300, 1000):
        asked = np.sort(rng.choice(1000, n, replace=False))
        found, read = [], 0
        for file, first, last, inside in records.runs(asked, files, 3 * 16, 50 * 16):
            assert 0 <= first == inside[0] and last == inside[-1] < sizes[file] and last - first < 50
            assert (np.diff(inside) <= 3).all()
            found += (files.first[file] + inside).tolist()
            read += last - first + 1
        assert found == asked.tolist() and read <= 3 * n


def _result(case, latencies=None, label=None):
    metrics = {"optimize_duration": 2.5, "recall": 0.5, "ndcg": 0.6, "unknown": [1]}
    if latencies is not None:
        metrics |= {"serial_latencies": latencies, "recalls": [1.0] * len(latencies)}
    db = {"duckdb_threads": 14} | ({"db_label": json.dumps(label)} if label else {})
    return {"metrics": metrics, "task_config": {
        "db": "DuckDB", "db_config": db, "db_case_config": {"index": "HNSW"},
        "case_config": {"case_id": case, "k": 10, "custom_case": {"arxiv_filter_type": "R"}}}}


def test_results(spark, tmp_path):
    def put(name, results, indent):
        doc = {"run_id": name, "task_label": "t", "results": results, "timestamp": 1.5}
        (tmp_path / name).write_text(json.dumps(doc, indent=indent))

    put("a.json", [_result(5, [0.1, 0.2], {"global_version": "true"}), _result(6)], 4)
    put("b.json", [_result(7, [])], None)
    put("muted_c.json", [_result(8)], None)
    runs = readers.read_results(spark, str(tmp_path), str(tmp_path / "missing"))
    flat = readers.flatten_results(runs)
    rows = {r["case_id"]: r for r in flat.withColumn("g", label_field(F.col("db_label"), "global_version")).collect()}
    assert set(rows) == {5, 6, 7}
    assert (rows[5]["g"], rows[6]["g"]) == ("true", None) and rows[6]["serial_latencies"] is None
    assert rows[5]["custom_case"]["arxiv_filter_type"] == "R" and rows[7]["source_file"] == "b.json"
    queries = readers.per_query(flat, ["case_id"]).orderBy("query").collect()
    assert [(r["case_id"], r["query"], r["latency"], r["recall"]) for r in queries] == [(5, 0, 0.1, 1.0), (5, 1, 0.2, 1.0)]
    assert readers.read_results(spark, str(tmp_path / "missing")).count() == 0
    short = _result(9, [0.1, 0.2])
    short["metrics"]["recalls"] = [1.0]
    put("d.json", [short], None)
    again = readers.flatten_results(readers.read_results(spark, str(tmp_path)))
    with pytest.raises(Exception, match="differ in number: 2 and 1"):
        readers.per_query(again, ["case_id"]).collect()


def test_summary_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a,b\n1.5,x\n")
    (tmp_path / "e.csv").write_text("a,b\n")
    table = readers.numbers(readers.read_summary_csv(spark, str(tmp_path / "s.csv"), ["a"]), ["a", "b"])
    assert tuple(table.first()) == (1.5, None)
    with pytest.raises(ValueError, match="lacks columns: c"):
        readers.read_summary_csv(spark, str(tmp_path / "s.csv"), ["a", "c"])
    with pytest.raises(ValueError, match="no rows"):
        readers.read_summary_csv(spark, str(tmp_path / "e.csv"), ["a"])


def test_files_and_row_groups(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("idx"), "id").repartition(7)
    names = writers.write_files(file_index(df, 300), str(tmp_path / "out"), 4, rows_per_group=100)
    assert [r["name"] for r in names.orderBy("file_idx").collect()] == [f"train-0{i}-of-4.parquet" for i in range(4)]
    for at, rows in enumerate([300, 300, 300, 100]):
        (file,) = (tmp_path / "out" / f"train-0{at}-of-4.parquet").glob("*.parquet")
        meta = pq.ParquetFile(file).metadata
        assert [meta.row_group(i).num_rows for i in range(meta.num_row_groups)] == [100] * (rows // 100)
        assert pq.read_table(file)["idx"].to_pylist() == list(range(at * 300, at * 300 + rows))
    shards = readers.read_shards(spark, str(tmp_path / "out"))
    assert all(r["idx"] == r["position"] and r["shard_no"] == r["idx"] // 300 for r in shards.collect())


def test_lines_survive_a_change_of_parallelism(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
        lines = readers.read_lines(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "17000")
        rows = lines.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert {r["line"]: r["value"] for r in rows} == {i: f"line {i}" for i in range(20_000)}
