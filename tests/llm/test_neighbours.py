import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.llm import neighbours

NAN, INF = float("nan"), float("inf")


def by_hand(rows, is_query, k):
    fine = {i: np.array(v, float) for i, v in rows
            if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = set()
    for q in filter(is_query, fine):
        scored = sorted((-sum(a * b for a, b in zip(fine[q], v)), i) for i, v in fine.items()
                        if i != q and len(v) == len(fine[q]))
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])}
    return out


def found(spark, rows, k):
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = neighbours.nearest(table.repartition(3), F.col("vec_id") % 5 == 0, k).collect()
    return {tuple(r) for r in got}, len(got)


@pytest.mark.parametrize("dim", [1, 3, 17, 1500])
def test_against_brute_force(spark, monkeypatch, dim):
    monkeypatch.setattr(neighbours, "QUERY_TILE", 7)
    monkeypatch.setattr(neighbours, "BASE_TILE", 11)
    rng = np.random.default_rng(dim)
    vectors = rng.integers(-3, 4, (90, dim)) * rng.choice([1e-6, 1, 50], (90, 1)) if dim < 9 else rng.normal(size=(90, dim))
    rows = [(i, np.float32(v).tolist(), 0) for i, v in enumerate(vectors)]
    got, n = found(spark, rows, 6)
    expected = by_hand([r[:2] for r in rows], lambda i: i % 5 == 0, 6)
    assert n == len(got) and got == expected


def test_many_copies_tie_by_id(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "_PAIRS", 16)
    rows = [(i, [1.0, 2.0, 3.0], 0) for i in range(70)] + [(100 + i, [0.5, float(i), 1.0], 0) for i in range(20)]
    got, _ = found(spark, rows, 8)
    assert got == by_hand([r[:2] for r in rows], lambda i: i % 5 == 0, 8)


def test_what_takes_no_part(spark):
    rows = [(0, [1.0, 0.0], 0), (1, None, 0), (2, [0.0, 0.0], 0), (3, [NAN, 1.0], 0), (4, [INF, 1.0], 0), (5, [1.0, None], 0),
            (None, [1.0, 1.0], 0), (6, [], 0), (7, [1.0, 1.0, 1.0], 0), (8, [2.0, 1.0], 0), (8, [2.0, 1.0], 0), (10, [1.0, 5.0], 0)]
    got, n = found(spark, rows, 20)
    assert got == by_hand([r[:2] for r in rows[:10] + rows[11:]], lambda i: i % 5 == 0, 20) and n == len(got)
    assert found(spark, [], 3)[0] == set() and found(spark, [(0, [1.0], 0)], 3)[0] == set()


def test_bound_holds():
    rng = np.random.default_rng(0)
    a, b = (neighbours.Quantised(np.arange(50).tobytes(), (rng.normal(size=(50, 33)) ** 3).tobytes(), 33) for _ in range(2))
    near = neighbours._products(a.codes, b.codes) * a.scale[:, None] * b.scale[None, :]
    bound = a.lost[:, None] * (b.kept + b.lost)[None, :] + a.kept[:, None] * b.lost[None, :]
    assert (np.abs(a.exact @ b.exact.T - near) <= bound * (1 + 1e-9)).all()


@pytest.mark.parametrize("sizes", [[1e160], [1e-200], [1e-320, 5e-324], [1e308, 1.0, 1e-308], [1e154, 1e150, 1e-150], [1.0, 3e200]])
def test_vectors_of_any_finite_size(spark, sizes):
    """Nothing is lost where squares or products leave the range of a double; scores are infinite or
    zero there, and ties go to the smaller id."""
    rng = np.random.default_rng(8)
    rows = []
    for i in range(60):
        v = rng.normal(size=8)
        v = v / np.abs(v).max() * sizes[i % len(sizes)]
        rows.append((i, [float(x) for x in v]))
    rows = [(i, v) for i, v in rows if any(v)]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, 20).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))

    def product(a, b):
        exact = sum(Fraction(x) * Fraction(y) for x, y in zip(a, b))
        try:
            return float(exact)
        except OverflowError:
            return math.inf if exact > 0 else -math.inf

    for q, v in rows:
        if q % 20:
            continue
        expected = sorted(((-product(v, w), i) for i, w in rows if i != q))[:20]
        found = sorted(got[q])
        assert [r for r, _, _ in found] == list(range(1, len(expected) + 1))
        for (_, vec, score), (minus, i) in zip(found, expected):
            assert score == pytest.approx(-minus, rel=1e-12, abs=1e-322)
            assert vec == i or score == pytest.approx(-minus, rel=1e-14)
