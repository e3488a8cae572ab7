import random

import numpy as np

from nearfield.llm import decontaminate

RNG = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(4000)]


def prose(n):
    return [RNG.choice(VOCABULARY) for _ in range(n)]


ITEMS = [" ".join(prose(30)) for _ in range(12)]


def slow_align(a, b):
    best, table = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if x == y else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best


def test_alignment_score():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (rng.integers(0, 4, rng.integers(1, 12)).astype(np.int64) for _ in range(2))
        score, first, last = decontaminate.align(a, b)
        assert score == slow_align(a.tolist(), b.tolist())
        if score:
            assert score == slow_align(a.tolist(), b[first:last].tolist())


def test_long_passage_in_parts(monkeypatch):
    monkeypatch.setattr(decontaminate, "_ALIGN_CELLS", 40)
    item = np.arange(10)
    passage = np.concatenate((np.full(133, -1), item, np.full(61, -1)))
    assert decontaminate.align(item, passage) == (20, 133, 143)


def test_long_items_are_aligned_in_little_memory():
    import tracemalloc

    rng = np.random.default_rng(3)
    item = rng.integers(0, 10**6, 6_000)
    passage = np.concatenate((rng.integers(0, 10**6, 9_000), np.insert(item, 3_000, [-1] * 500), [-2] * 4_000))
    tracemalloc.start()
    assert decontaminate.align(item, passage) == (12_000 - 500, 9_000, 15_500)
    assert tracemalloc.get_traced_memory()[1] < 10_000_000
    tracemalloc.stop()


def edited(text, share):
    words = text.split()
    for i in RNG.sample(range(len(words)), int(len(words) * share)):
        words[i] = "changed"
    return " ".join(words)


def planted():
    docs, truth = [], set()
    for i in range(60):
        body = prose(RNG.randint(0, 300))
        if i % 3 == 0:
            k = RNG.randrange(len(ITEMS))
            copy = [ITEMS[k], ITEMS[k].upper().replace(" ", ", "), edited(ITEMS[k], 0.1)][i // 3 % 3]
            at = RNG.randint(0, len(body))
            body[at:at] = copy.split(" ")
            truth.add((i, k))
        docs.append(" ".join(body))
    return docs, truth


def benchmark(spark, items=ITEMS):
    return spark.createDataFrame(list(enumerate(items)), "item_id long, text string")


def test_planted_copies(spark, docs_of, monkeypatch):
    texts, truth = planted()
    docs = docs_of(texts).withColumnRenamed("lang", "item_id").repartition(7)
    rows = decontaminate.op3_benchmark_leaks(docs, benchmark(spark)).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == truth
    assert all(0.6 <= r.score <= 1 for r in rows)
    clean = decontaminate.keep_clean(docs, benchmark(spark))
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == set(range(60)) - {d for d, _ in truth}
    monkeypatch.setattr(decontaminate, "SEED_LIMIT", 40)  # the seeds in several parts
    assert sorted(rows) == sorted(decontaminate.op3_benchmark_leaks(docs, benchmark(spark)).collect())


def test_agrees_with_all_pairs(spark, docs_of):
    texts = [edited(ITEMS[i % 12], s) + " " + " ".join(prose(20)) for i in range(24) for s in (0.05, 0.2, 0.4)]
    rows = {(r.doc_id, r.item_id): r.score for r in decontaminate.contaminated(docs_of(texts), benchmark(spark)).collect()}
    for d, t in enumerate(texts):
        for k, item in enumerate(ITEMS):
            a, b = item.split(), t.split()
            score = slow_align(a, b) / (2 * len(a))
            seeded = {tuple(a[i : i + 4]) for i in range(27)} & {tuple(b[i : i + 4]) for i in range(len(b) - 3)}
            assert ((d, k) in rows) == (score >= 0.6 and bool(seeded))
            if (d, k) in rows:
                assert abs(rows[d, k] - score) < 1e-9


def test_words_put_in(spark, docs_of):
    """Copies with words put in, at one place or all over, are found at their score of all pairs,
    whatever other items there are."""
    item = prose(40)
    texts = []
    for extra in (1, 10, 20, 30, 31, 32, 40):
        for at in (5, 20, 35):
            texts.append(" ".join(prose(90) + item[:at] + [f"in{i}" for i in range(extra)] + item[at:] + prose(90)))
        spread = list(item)
        for i in range(extra):
            spread.insert(5 + 35 * i // extra + i, f"in{i}")
        texts.append(" ".join(prose(90) + spread + prose(90)))
    truth = {}
    for d, t in enumerate(texts):
        score = slow_align(item, t.split()) / 80
        words = t.split()
        seeded = any(words[i : i + 4] == item[j : j + 4] for j in range(37) for i in range(len(words) - 3))
        if score >= 0.6 and seeded:
            truth[d] = score
    assert 12 < len(truth) < len(texts)
    for others in ([], [" ".join(prose(300))], ["one two three four five"]):
        rows = decontaminate.contaminated(docs_of(texts), benchmark(spark, [" ".join(item), *others])).collect()
        assert {r.doc_id: r.score for r in rows if r.item_id == 0} == truth


def test_item_in_many_copies_is_still_found(spark, docs_of):
    texts = [ITEMS[0]] * 80 + [ITEMS[1]]
    rows = decontaminate.contaminated(docs_of(texts), benchmark(spark)).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(i, 0) for i in range(80)} | {(80, 1)}


def test_frequent_seeds_are_aligned(spark, docs_of):
    """Edited copies that share only grams found a thousand times as often as their item's other grams."""
    words = [f"v{i}" for i in range(25)]
    kept = [w if i % 5 else "changed" for i, w in enumerate(words)]
    texts = [" ".join(kept)] * 1200 + [" ".join(words)]
    rows = decontaminate.contaminated(docs_of(texts), benchmark(spark, [" ".join(words)])).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(i, 0) for i in range(1201)}
    assert decontaminate.keep_clean(docs_of(texts), benchmark(spark, [" ".join(words)])).count() == 0


def test_a_seed_of_many_items(spark, docs_of, monkeypatch):
    shared = prose(5)
    items = [" ".join(shared + prose(15)) for _ in range(40)]
    monkeypatch.setattr(decontaminate, "_PORTION", 7)
    rows = decontaminate.contaminated(docs_of(items + [" ".join(shared)]), benchmark(spark, items)).collect()
    assert {(r.doc_id, r.item_id, r.score) for r in rows} == {(i, i, 1.0) for i in range(40)}


def test_edges(spark, docs_of):
    leak = ITEMS[2]
    docs = docs_of([leak, None, "", "clean text that is nobody's", leak, "clean one", "clean two", ("a " * 50_000) + leak],
                   ids=[1, 2, 3, 4, None, None, 1, 8])
    few = benchmark(spark, [None, "", "too short", *ITEMS])
    found = decontaminate.contaminated(docs, few).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(1, 5), (None, 5), (8, 5)}
    assert next(r for r in found if r.doc_id == 8).first_word == 50_000
    kept = [r.text for r in decontaminate.keep_clean(docs, few).collect()]
    assert sorted(kept, key=str) == sorted([None, "", "clean text that is nobody's", "clean one", "clean two"], key=str)
    for b in (few.limit(0), benchmark(spark, ["short"])):
        assert decontaminate.contaminated(docs, b).collect() == []
        assert decontaminate.keep_clean(docs, b).count() == 8
    assert decontaminate.contaminated(docs.limit(0), few).collect() == []
