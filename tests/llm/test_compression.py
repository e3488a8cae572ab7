"""Product codes against plain rounds of Lloyd over whole numbers."""

import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from nearfield.llm import compression

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, positions=4, entries=256, rounds=4):
    """The contract in plain Python."""
    kept = [(v, [math.floor(1024 * x) for x in e], label) for v, e, label in rows
            if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0], kept[i][1]))
    width = len(kept[0][1]) // positions

    def part(i, p):
        return kept[i][1][p * width : (p + 1) * width]

    books = [[part(i, p) for i in order[:entries]] for p in range(positions)]

    def nearest(i, p):
        return min((sum((a - b) ** 2 for a, b in zip(part(i, p), c)), e) for e, c in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(positions):
            members = defaultdict(list)
            for i in range(len(kept)):
                members[nearest(i, p)[1]].append(part(i, p))
            for e, found in members.items():
                books[p][e] = [sum(c) // len(found) for c in zip(*found)]
    sign = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    codes = [[nearest(i, p) for p in range(positions)] for i in range(len(kept))]
    errors = [sum(d for d, _ in c) for c in codes]
    by_label = defaultdict(int)
    for (_, _, label), error in zip(kept, errors):
        by_label[label] += error
    return sorted([(kept[i][0], "".join(f"{e:02x}" for _, e in codes[i]), errors[i], by_label[kept[i][2]], sign)
                   for i in range(len(kept))], key=repr)


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def made(n, seed, dim=8):
    rng = np.random.default_rng(seed)
    rows = [(int(v), [float(np.float32(x)) for x in rng.normal(size=dim) * 0.2], int(rng.integers(3)))
            for v in rng.permutation(n) * 3]
    return rows


def test_against_plain_rounds(spark):
    rows = made(330, 1)
    rows += [(7, None, 1), (8, [0.1] * 7 + [None], 1), (10, [0.1] * 7 + [float("nan")], 1), (11, [float("inf")] * 8, 2),
             (12, [0.0] * 8, None), (12, [0.5] * 8, None), (None, [0.25] * 8, 1), (4, [-0.001] * 8, None)]
    rows += [(1000 + i, [0.125] * 8, 9) for i in range(150)]  # one group of copies
    got = compression.compress(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert found(got) == plain(rows)


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_few_rows_and_other_sizes(spark, rounds):
    rows = made(60, 2, dim=6)
    got = compression.compress(spark.createDataFrame(rows, SCHEMA), positions=2, entries=5, rounds=rounds)
    assert found(got) == plain(rows, 2, 5, rounds)


def test_salted_owners(spark, monkeypatch):
    """Owners cut into many salts give the same sums."""
    monkeypatch.setattr(compression, "OWNER_VALUES", 20)
    rows = made(80, 3) + [(1000 + i, [0.125] * 8, 9) for i in range(80)]
    got = compression.compress(spark.createDataFrame(rows, SCHEMA), entries=16)
    assert found(got) == plain(rows, entries=16)


def test_large_components(spark):
    rows = [(i, [float(x)] * 4, 0) for i, x in enumerate([30_000, -30_000, 20_000.5, 29_000, 1e-30, -1e-30])]
    assert found(compression.compress(spark.createDataFrame(rows, SCHEMA), entries=3)) == plain(rows, entries=3)
    far = spark.createDataFrame([(1, [1e30] * 4, 0), (2, [0.0] * 4, 0)], SCHEMA)
    with pytest.raises(ValueError, match="too large"):
        compression.compress(far)


def test_lengths_empty_tables_and_other_columns(spark):
    with pytest.raises(ValueError, match="one length"):
        compression.compress(spark.createDataFrame([(1, [0.1] * 4, 0), (2, [0.1] * 8, 0)], SCHEMA))
    empty = compression.compress(spark.createDataFrame([(1, None, 0)], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    rows = made(20, 4)
    clash = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS place", "2 AS entry", "3 AS salt", "4 AS x")
    assert found(compression.compress(clash)) == plain(rows)


def test_members_are_not_shuffled_to_be_added_up(spark):
    """The plan of the owners' sums reads the buckets as they lie."""
    rows = compression.materialize(
        compression.usable(spark.createDataFrame(made(50, 5), SCHEMA), "vec_id", "embedding", "label"), "v")
    shape = compression._shape(rows, 4)
    books = np.zeros((4, 3, 2), np.int64)
    members = compression.Members(spark, shape)
    parts = compression._parts(rows, books, shape)
    members.settle(parts, parts.groupBy("position", "entry").count().withColumnRenamed("count", "n"), 0)
    try:
        plan = members.totals(0)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "Bucketed: true" in plan
    finally:
        members.close()
