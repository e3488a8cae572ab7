import re

from nearfield.llm import licenses

PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}


def base(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    found = []
    for label, phrase in PHRASES.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i : i + len(p)] == p]
    return words, sorted(found)


TEXTS = [
    None, "", "CC BY", "cc-by 4.0 and CC BY-NC", "All rights reserved. ALL RIGHTS RESERVED",
    "the GNU General Public License, version 3", "general public", "cc  by cc by by cc", "ac cby", "cc éby",
    "K cc by İ", "general public general public license", "x" * 50_000 + " cc by " + "y " * 20_000,
    "Permission is hereby granted, free of charge, to any person getting a copy of this software",
    "This work is licensed under the GNU General Public License, version 3.",
    "permission granted to copy this", "all rights\nreserved all.rights.reserved",
]


def test_base_places(docs_of):
    docs = docs_of(TEXTS + ["cc by", "cc by"], ids=[*range(len(TEXTS)), 99, 99]).withColumnRenamed("lang", "label")
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "cc by" if r.doc_id == 99 else TEXTS[r.doc_id]
        words, found = base(text)
        assert r.n_words == len(words) and r.n_base == len(found), text
        assert (r.first_word, r.last_word) == ((found[0][0], found[-1][0]) if found else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in found}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1
    by = {r.doc_id: r for r in rows}
    assert "mit" in by[13].labels and by[13].score < 1  # one word changed
    assert by[14].labels == "gpl,gpl-notice" and by[15].labels == ""


def test_spans_and_empty_table(docs_of):
    found = licenses.spans(docs_of(["a b all rights reserved c"])).collect()
    assert [(r.label, r.first, r.last) for r in found] == [("reserved", 2, 4)]
    assert licenses.scan(docs_of([])).collect() == []
    assert licenses.scan(docs_of(["cc by"], ids=[None])).first().n_base == 1


MIT = licenses.TEMPLATES[5].words.split()


def test_words_put_in_and_left_out(docs_of):
    def put(at, n):
        return " ".join(["before"] * 30 + MIT[:at] + ["put"] * n + MIT[at:] + ["after"] * 30)

    texts = [put(at, n) for at in (3, 8, 13) for n in (1, 2, 3, 4, 5)]
    texts += [" ".join(w for i, w in enumerate(MIT) if i not in out) for out in ((4,), (4, 5, 6), (1, 9))]
    for r in licenses.scan(docs_of(texts)).collect():
        assert r.labels == "mit" and 0.7 <= r.score < 1, texts[r.doc_id]
    spans = licenses.spans(docs_of([put(8, 5)])).collect()
    assert [(r.first, r.last) for r in spans] == [(30, 30 + len(MIT) + 4)]


def test_few_grams_repeated_are_no_license(docs_of):
    texts = [" ".join(MIT[:4]) + " " + " ".join(MIT[:4] * 20), "to any person " * 500, "of this software " * 40,
             " ".join(reversed(MIT)), " ".join(f"{a} {b} so" for a, b in zip(MIT[::4], MIT[1::4]))]
    assert {(r.labels, r.score) for r in licenses.scan(docs_of(texts)).collect()} == {("", 0.0)}


def test_a_gram_held_twice_counts_once(spark, docs_of):
    own = (licenses.Template("x", "a b c a b d a b e f g h"), licenses.Template("y", "p q p q", exact=True))
    texts = ["a b c a b d a b e f g h", "a b c a b d a b", "p q p q", "p q p", "p q p q p q"]
    rows = licenses.scan(docs_of(texts), own).sort("doc_id").collect()
    assert [(r.labels, r.score, r.n_base) for r in rows] == [
        ("x", 1.0, 0), ("", 0.0, 0), ("y", 1.0, 1), ("", 0.0, 0), ("y", 1.0, 2)]
