import math

import pytest
from pyspark.sql import functions as F

from nearfield.llm import mixing


def filled(sizes, weights, share, cap):
    """Water-filling by the book: clamp whatever is above, share out the rest, repeat."""
    free, target, rest = set(sizes), {}, share * sum(sizes.values())
    while free:
        level = rest / sum(weights[s] for s in free)
        above = {s for s in free if weights[s] * level > cap * sizes[s]}
        if not above:
            return target | {s: weights[s] * level for s in free}
        target |= {s: cap * sizes[s] for s in above}
        rest -= sum(cap * sizes[s] for s in above)
        free -= above
    return target


@pytest.mark.parametrize("share", [0.5, 1.0, 1.5, 2.0, 3.0])
def test_water_filling(spark, share):
    sizes = {"a": 10, "b": 1000, "c": 37, "d": 500, "e": 3}
    weights = dict(zip("abcde", (3, 1, 2, 3, 1)))
    table = spark.createDataFrame([(s, n, float(weights[s])) for s, n in sizes.items()],
                                  "source string, words long, weight double")
    got = {r.source: r.target for r in mixing.water_fill(table, share, 2).collect()}
    expected = filled(sizes, weights, share, 2)
    assert got.keys() == expected.keys()
    assert all(math.isclose(got[s], expected[s]) for s in got)


def test_words_come_near_their_targets(docs_of):
    texts = [" ".join(["w"] * (1 + i * 7 % 50)) for i in range(600)]
    sources = [None if i % 3 == 0 else f"s{i % 7}" for i in range(600)]  # one source has a third
    rows = mixing.op10_water_filled_mix(docs_of(texts, sources)).collect()
    again = mixing.op10_water_filled_mix(docs_of(texts, sources)).collect()
    assert sorted(rows) == sorted(again) and len(rows) == 600
    size, taken = {}, {}
    for r in rows:
        s = sources[r.doc_id]
        assert r.size == len(texts[r.doc_id].split()) and r.taken <= 2 * r.size and r.taken % r.size == 0
        size[s] = size.get(s, 0) + r.size
        taken.setdefault(s, [0, r.target, r.source_size])[0] += r.taken
    order = sorted((s for s in size if s is not None)) + [None]
    expected = filled(size, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5, 2)
    for s, (words, target, whole) in taken.items():
        assert whole == size[s] and math.isclose(target, expected[s]) and abs(words - target) <= 25


def test_repeat_and_named_weights(spark, docs_of):
    docs = docs_of(["a b", "c d", "e", "f"], ["x", "x", "y", "z"]).withColumn("mix_size", F.lit("own"))
    mixed = mixing.mix(docs, weights={"x": 1.0, "y": 1.0}, share=1.0)
    rows = {r.doc_id: r for r in mixed.collect()}
    assert rows[3].mix_copies == 0 and rows[3].mix_target == 0 and rows[2].mix_copies == 2
    repeated = mixing.repeat(mixed)
    assert repeated.count() == sum(r.mix_copies for r in rows.values())


def test_edges(spark, docs_of):
    assert mixing.op10_water_filled_mix(docs_of([])).collect() == []
    rows = mixing.op10_water_filled_mix(docs_of([None, "", " \t\n"], [None, "", "x"])).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in rows] == [(0, 0, 0.0, 0)] * 3
    # a no-break space is no white space here; ids may be missing or repeat
    rows = mixing.op10_water_filled_mix(docs_of(["a b c", "x", "x"], ids=[None, 4, 4])).collect()
    assert sorted(r.size for r in rows) == [1, 1, 2]
    long = docs_of(["word " * 300_000, "a"])
    assert {r.size for r in mixing.op10_water_filled_mix(long).collect()} == {300_000, 1}
