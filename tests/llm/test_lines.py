import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from nearfield.llm import lines, textscan

RNG = random.Random(4)


def normal(line):
    text = "".join(c.lower() if "A" <= c <= "Z" else "0" if "0" <= c <= "9" else c for c in line)
    return " ".join(re.findall(r"[a-z0\x80-\U0010FFFF]+", text))


def print_of(text):
    """Key and SimHash of one line as the operator has them."""
    data, offsets = textscan.texts(pa.array([text]))
    key, fp, _ = lines.prints(data, np.array([0]), np.array([len(data)]))
    return int(key.view(np.int64)[0]), int(fp[0])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def by_hand(texts, ids):
    """(doc, line) -> whether it is kept, by all pairs of lines."""
    place, node = [], {}
    for i, t in zip(ids, texts):
        for k, line in enumerate((t or "").split("\n")):
            n = normal(line)
            if n and i is not None:
                place.append((i, k, n))
                node.setdefault(n, (len(n.split()), print_of(line)[1]))
    parent = {n: n for n in node}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in node:
        for b in node:
            (wa, fa), (wb, fb) = node[a], node[b]
            if a < b and min(wa, wb) >= 5 and bin(fa ^ fb).count("1") <= 3:
                if distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
                    parent[root(b)] = root(a)
    first = {}
    for i, k, n in sorted(place):
        first.setdefault(root(n), (i, k))
    return {(i, k): first[root(n)] == (i, k) for i, k, n in place}


def sample():
    stock = [" ".join(RNG.choice(["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta"]) + str(RNG.randrange(9))
                      for _ in range(RNG.randint(1, 40))) for _ in range(25)]

    def changed(line):
        words = line.split(" ")
        words[RNG.randrange(len(words))] = RNG.choice(["alpha", "nu", "beta7"])
        return " ".join(words).capitalize() + RNG.choice(["", ".", " !"])

    return ["\n".join(changed(RNG.choice(stock)) if RNG.random() < 0.6 else RNG.choice(stock) for _ in range(6))
            for _ in range(20)]


@pytest.mark.parametrize("cell", [256, 2])
def test_against_all_pairs(docs_of, monkeypatch, cell):
    monkeypatch.setattr(lines, "_CELL", cell)
    texts = sample() + [None, "", "\n\n", "Page 1 of 9 pages here\nPage 22 of 94 pages here", "a\rb\na b"]
    docs = docs_of(texts).withColumnRenamed("lang", "line").repartition(4)
    rows = lines.groups(docs).collect()
    found = {(r.doc_id, r.line): r.keep for r in rows}
    assert len(found) == len(rows) and found == by_hand(texts, range(len(texts)))


def test_edits():
    rng = random.Random(9)
    for _ in range(500):
        a, b = ("".join(rng.choice("abé ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert lines.edits(a, b) == distance(a, b)
    long = "x" * 5000
    assert lines.edits(long + "a" + long, long + "bc" + long) == 2


def test_prints_shared_by_different_lines(docs_of, monkeypatch):
    """Word order does not change a print: groups must come from pairs other than the first lines'."""
    words = [f"word{i}" for i in range(12)]
    orders = [RNG.sample(words, 12) for _ in range(6)]
    texts = [" ".join(o) for o in orders] + [" ".join(o).replace("word3", "word3 x", 1) for o in orders]
    texts += [" ".join(o[:-1] + ["other"]) for o in orders]
    rows = {(r.doc_id, r.line): r.keep for r in lines.groups(docs_of(texts)).collect()}
    assert rows == by_hand(texts, range(len(texts)))


def test_links_exist():
    line = " ".join(f"word{i % 37}x{'abcdefgh'[i % 8]}" for i in range(80))
    (_, a), (_, b) = print_of(line), print_of(line.replace("word3xd", "word3xq", 1))
    assert bin(a ^ b).count("1") <= 6 and print_of("A  b, 12")[0] == print_of("a B 99")[0]


def test_edges(docs_of):
    long = " ".join(f"w{i}" for i in range(50_000))
    texts = [long, long, "one line of five words", "one line of five words", "x", "x"]
    ids = [1, 2, 3, 3, None, 4]
    rows = {(r.doc_id, r.line): r.keep for r in lines.groups(docs_of(texts, ids=ids)).collect()}
    assert rows == {(1, 0): True, (2, 0): False, (3, 0): True, (4, 0): True}
    assert lines.op7_fuzzy_lines(docs_of([])).collect() == [] and lines.groups(docs_of([None, ""])).collect() == []


@pytest.mark.parametrize("n_words, least", [(4, 0.2), (10, 0.85), (20, 0.97), (40, 0.97), (80, 0.97)])
def test_recall_of_one_changed_word(n_words, least):
    """Lines of which one word is replaced and whose edit similarity is 0.8: how many meet in a table."""
    rng = random.Random(n_words)
    met = tried = 0
    while tried < 300:
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(n_words)]
        other = list(words)
        other[rng.randrange(n_words)] = "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
        a, b = " ".join(words), " ".join(other)
        if a != b and lines.edits(a, b) <= 0.2 * max(len(a), len(b)):
            data, _ = textscan.texts(pa.array([f"{a}\n{b}"]))
            x, y = lines.slots(data, np.array([0, len(a) + 1]), np.array([len(a), len(data)]), lines.TABLES)
            met, tried = met + bool((x == y).any()), tried + 1
    assert met / tried >= least


def test_changed_words_are_grouped(docs_of):
    """Against all pairs by edit similarity alone, one word of every line replaced."""
    rng = random.Random(8)
    stock = [["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(25)] for _ in range(30)]
    texts = [" ".join(words) for words in stock] + [" ".join([*w[:k], "other", *w[k + 1 :]]) for k, w in enumerate(stock[:25])]
    rows = {r.doc_id: r.keep for r in lines.groups(docs_of(texts), tables=lines.TABLES).collect()}
    kept = [not any(distance(t, texts[j]) <= 0.2 * max(len(t), len(texts[j])) for j in range(i)) for i, t in enumerate(texts)]
    assert rows == dict(enumerate(kept))
    assert [r.n_kept for r in lines.op7_fuzzy_lines(docs_of(texts)).orderBy("doc_id").collect()] == [int(k) for k in kept]


def test_scratch_of_unlike_lines(docs_of, spark):
    """What is written grows by little for a line that nothing resembles: no slots, no row a block."""
    rng = random.Random(12)
    texts = ["\n".join(" ".join("".join(rng.choices("abcdefghijklmnop", k=15)) for _ in range(8)) for _ in range(400))
             for _ in range(20)]

    def written():
        return sum(f.stat().st_size for f in Path(spark.conf.get("spark.checkpoint.dir")).rglob("part-*.parquet"))

    before = written()
    assert lines.groups(docs_of(texts), tables=lines.TABLES).filter("keep").count() == 8000
    assert written() - before < 8000 * 150


@pytest.mark.parametrize("cell", [256, 2])
def test_shared_slots_by_hand(docs_of, monkeypatch, cell):
    monkeypatch.setattr(lines, "_CELL", cell)
    texts = [t for t in sample() if t] + ["alpha\nalpha1 beta\nALPHA", ""]
    held = {}
    for line in {normal(x) for t in texts for x in t.split("\n")} - {""}:
        data, _ = textscan.texts(pa.array([line]))
        values = lines.slots(data, np.array([0]), np.array([len(data)]), lines.TABLES)[0]
        for slot in enumerate(values.tolist()):
            held.setdefault(slot, set()).add(print_of(line)[0])
    wanted = sorted(sorted(keys) for keys in held.values() if len(keys) > 1)
    found = {}
    for r in lines.shared_slots(docs_of(texts).repartition(4), lines.TABLES, 100).collect():
        found.setdefault(r.slot, []).append(r.key)
    assert sorted(map(sorted, found.values())) == wanted


def test_edits_of_pairs(monkeypatch):
    rng = random.Random(10)

    def text(n):
        return "".join(rng.choice("abcdé ü日") for _ in range(n))

    left = [text(rng.choice([0, 1, 63, 64, 65, 128, rng.randint(1, 300)])) for _ in range(300)]
    right = ["".join(c for c in a if rng.random() > 0.1) + text(3) if rng.random() < 0.7 else text(90) for a in left]
    wanted = [lines.edits(a, b) for a, b in zip(left, right)]
    for few, table in ((24, 1 << 22), (1, 1 << 22), (1, 1 << 10)):
        monkeypatch.setattr(lines, "_FEW", few)
        monkeypatch.setattr(lines, "_TABLE", table)
        assert lines.edits_of_pairs(left, right).tolist() == wanted
    assert lines.edits_of_pairs([], []).tolist() == []


def test_pairs_of_unlike_length_are_not_verified(docs_of):
    """Equal prints of lines whose lengths rule the similarity out: no pair for every two of them."""
    words = ["ab", "cd", "ef", "gh", "ij"]
    rows = lines.lines(docs_of([" ".join(words * k) for k in range(1, 30)] + ["é ü日"]))
    assert [r.chars for r in rows.orderBy("doc_id").collect()] == [15 * k - 1 for k in range(1, 30)] + [4]
    one = [(lines._signed(0xFF), 100), (lines._signed(0xFE), 79), (lines._signed(0xFD), 80), (lines._signed(0xFB), 0)]
    found = lines.close_prints(docs_of([]).sparkSession.createDataFrame(one, "fp long, chars long"), 0.8).collect()
    assert sorted((r.a, r.b) for r in found) == [(0xFB, 0xFD), (0xFB, 0xFE), (0xFB, 0xFF), (0xFD, 0xFE), (0xFD, 0xFF)]
