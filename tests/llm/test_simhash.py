import random

import pytest
import xxhash

from nearfield.llm import simhash
from nearfield.llm.components import components


def by_hand(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", words)]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64))


def reach(prints):
    """Least id within reach, by brute force over all pairs."""
    ids, parent = sorted(prints), {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {i: root(i) for i in ids}


def test_fingerprint():
    for text in ["", " \t", "a", "A b", "a b c", "É x y z  w", "the cat " * 500]:
        assert simhash.fingerprint(text.encode()) == by_hand(text)


def test_long_text_in_parts(monkeypatch):
    text = " ".join(str(i * i) for i in range(1000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_PART", 7)
    assert simhash.fingerprint(text) == whole


@pytest.mark.parametrize("limit", [64, 3, 1])
def test_links_are_complete(spark, monkeypatch, limit):
    monkeypatch.setattr(simhash, "SMALL_POSTING", limit)
    rng = random.Random(5)
    prints = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(15):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    signed = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    found = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"))
    links = found.collect()
    assert all(bin((a ^ b) & (1 << 64) - 1).count("1") <= 2 for a, b in links)
    of = dict(components(found).collect())
    expected = reach(signed)
    assert {s: of.get(s, s) for s in signed} == expected


def test_classes(docs_of):
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(400))
    texts = [base, base.replace("w1", "v1", 1), base + " end", base.upper(), None, "", "\n", "other text here"]
    texts += [base] * 30 + [" ".join(f"x{rng.randrange(99)}" for _ in range(40)) for _ in range(20)]
    rows = simhash.op6_simhash_classes(docs_of(texts)).collect()
    prints = {i: by_hand(t) for i, t in enumerate(texts)}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {r.doc_id: r.component_id for r in rows} == reach(prints)


def test_keep_first(docs_of):
    texts = ["one two three four", "one two three four", "five six", "five six", None, "seven eight nine"]
    docs = docs_of(texts, ids=[3, 1, 7, 7, None, 2]).withColumnRenamed("lang", "fp")
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(
        [(1, texts[0]), (7, "five six"), (None, None), (2, texts[5])], key=str)
    assert simhash.keep_first(docs.limit(0)).collect() == []
    only = {(r.doc_id, r.component_id) for r in simhash.classes(docs).collect()}
    assert only == {(3, 1), (1, 1), (7, 7), (None, None), (2, 2)}


def test_components(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 300)]
    rng.shuffle(chain)
    links = spark.createDataFrame([*chain, *star, (5000, 5000), (7, 6), (-5, -9)], "a long, b long")
    of = dict(components(links).collect())
    assert all(of[i] == 0 for i in range(201)) and all(of[1000 + i] == 1000 for i in range(300))
    assert of[-5] == of[-9] == -9 and 5000 not in of
    assert components(links.limit(0)).collect() == []
