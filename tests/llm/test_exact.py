"""Exact dedup against grouping the texts themselves."""

import hashlib
from collections import defaultdict

import pytest

from nearfield.llm import exact

A_TO_Z = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute(rows, largest=True):
    groups = defaultdict(list)
    for at, (doc, text) in enumerate(rows):
        groups[(text or "").translate(A_TO_Z)].append((doc, at))
    out = []
    for text, members in groups.items():
        ids = [d for d, _ in members if d is not None]
        keep = (max if largest else min)(ids) if ids else None
        for doc, _ in members:
            out.append((doc, keep, len(members), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in df.collect()], key=repr)


ROWS = [
    (1, "Same Text"), (2, "same text"), (3, "SAME TEXT"), (4, "same  text"), (5, None), (6, ""), (7, "É"), (8, "é"),
    (9, "K"), (10, "k"), (11, "K"), (12, "İ"), (13, "x" * 300_000), (14, "X" * 300_000), (15, "x" * 300_001),
    (2**62, "far"), (-2**63, "FAR"), (None, "far"), (None, "alone"), (20, "straße"), (21, "STRAßE"), (22, "STRASSE"),
]


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("fan_in", [2, 3, 8])
def test_against_groups_of_texts(spark, docs_of, largest, fan_in):
    docs = docs_of([t for _, t in ROWS], ids=[i for i, _ in ROWS]).repartition(7)
    got = exact.classes(docs, largest, fan_in)
    assert found(got) == brute(ROWS, largest)
    kept = [r for r in got.collect() if r.kept]
    assert all(r.doc_id == r.keep_id for r in kept) and len(kept) == len({t for *_, t in brute(ROWS)})


def test_one_row_stays_of_repeated_ids(spark, docs_of):
    got = exact.classes(docs_of(["a", "A", "a", "b"], ids=[5, 5, 3, 5]).repartition(3)).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size) for r in got) == [(3, 5, 3), (5, 5, 1), (5, 5, 3), (5, 5, 3)]
    assert sum(r.kept for r in got) == 2


def test_a_text_in_most_rows_of_many_runs(spark):
    docs = spark.range(20_000, numPartitions=40).selectExpr(
        "id AS doc_id", "if(id % 3 < 2, 'Copy', concat('own ', id)) AS text")
    got = exact.classes(docs)
    assert got.where("kept").count() == 1 + 6666
    assert got.where("group_size > 1").select("keep_id", "group_size").distinct().collect() == [(19_999, 13_334)]


def test_equal_digests_stay_apart_where_the_check_differs(spark):
    """Entries are merged only when length and SHA-256 agree with the digest."""
    runs = spark.createDataFrame(
        [(0, 7, 3, bytearray(b"a"), (1, -1), 1), (1, 7, 3, bytearray(b"b"), (2, -2), 1), (2, 7, 3, bytearray(b"a"), (3, -3), 4),
         (3, 7, 4, bytearray(b"a"), (9, -9), 1)],
        "run long, digest long, n_bytes int, sha256 binary, best struct<rank:long,first:long>, size long")
    got = {(bytes(r.sha256), r.n_bytes): (r.best.rank, r["size"]) for r in exact._merge(runs, runs["run"] * 0).collect()}
    assert got == {(b"a", 3): (3, 5), (b"b", 3): (2, 1), (b"a", 4): (9, 1)}


def test_empty_table_and_clashing_columns(spark, docs_of):
    assert exact.classes(docs_of([])).collect() == []
    docs = docs_of(["a", "A"]).selectExpr("*", "1 AS run", "2 AS digest", "'x' AS keep_id", "3 AS place", "4 AS best")
    assert found(exact.classes(docs)) == brute([(0, "a"), (1, "A")])


def test_runs_no_python(spark, docs_of):
    plan = exact.classes(docs_of(["a"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan
