"""Token alignment against the tokenizers themselves and all pairs of tokens."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from nearfield.llm import alignment

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "The quick brown fox, jumping over 12,345 lazy dogs!", "  two  spaces   and more    ", " ", "   ", "", None, "a",
    "line\nbreaks\r\n\ttabs\n\n\nmore", "naïve café ÀÉÎ straße", "日本語のテキスト、テスト。", "한국어 텍스트", "emoji 😀👩‍👩‍👧 end",
    "a literal ▁ mark", "▁", "<|endoftext|> and <s>hi</s> <0x41> <unk>", "can't won't I'll THEY'RE", "x" * 5000,
    "\x00nul and \x7f", "non breaking　space", "ｆｕｌｌ width ﬁ ½", "http://a.b/c?d=e&f=g#h", "The quick brown fox, jumping",
    "the the the the the the", "mixed​zero﻿width", "1234567890" * 30, "don't  \n stop ",
]


def byte_of():
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def brute(texts):
    """Every pair of tokens whose bytes overlap, from the tokenizers run on whole texts."""
    letters = byte_of()
    tok = Tokenizer.from_file(A_PATH)
    tok.encode_special_tokens = True
    sp = SentencePieceProcessor(model_file=B_PATH)
    rows, counts = [], Counter()
    for text in texts:
        whole = (" " + text).encode() if text else b""
        ids = (tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)) if text else ([], [])
        spelt = [[bytes(letters[c] for c in tok.id_to_token(i)) for i in ids[0]],
                 [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode()
                  for i in ids[1]]]
        if not text or any(b"".join(s) != whole for s in spelt):
            rows.append(None)
            continue
        ends = [np.cumsum([len(x) for x in s]).tolist() for s in spelt]
        starts = [[0, *e[:-1]] for e in ends]
        links = [(ids[0][i], ids[1][j]) for i in range(len(ids[0])) for j in range(len(ids[1]))
                 if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]]
        groups, at = [], [0, 0]
        for end in sorted(set(ends[0]) & set(ends[1])):
            to = [ends[s].index(end) + 1 for s in (0, 1)]
            groups.append("|".join(",".join(map(str, ids[s][at[s] : to[s]])) for s in (0, 1)))
            at = to
        counts.update(links)
        rows.append((len(ids[0]), len(ids[1]), len(groups), links, ";".join(groups)))
    top = Counter()
    for (_, b), n in counts.items():
        top[b] = max(top[b], n)
    out = []
    for row in rows:
        if row is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, n_groups, links, told = row
        best = sum(counts[p] == top[p[1]] for p in links)
        out.append((n_a, n_b, n_groups, len(links), best, sum(counts[p] for p in links),
                    hashlib.sha256(told.encode()).hexdigest()))
    return out


def found(df):
    return [tuple(r)[1:] for r in sorted(df.collect(), key=lambda r: r.doc_id)]


def test_against_all_pairs(spark, docs_of):
    got = alignment.op12_token_alignment(docs_of(TEXTS).repartition(5), A_PATH, B_PATH)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert found(got) == brute(TEXTS)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) < 3000")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    assert found(alignment.op12_token_alignment(docs, A_PATH, B_PATH)) == brute(texts)


@pytest.mark.parametrize("frequent", [0, 3, 40])
def test_rare_pairs_by_shuffle(spark, docs_of, frequent):
    aligned = alignment.align(docs_of(TEXTS), A_PATH, B_PATH)
    assert found(alignment.score(aligned, frequent)) == brute(TEXTS)


def test_groups_of_random_ends():
    rng = random.Random(5)
    for _ in range(300):
        end = rng.randint(1, 60)
        a = sorted({*rng.sample(range(1, end + 1), rng.randint(1, end)), end})
        b = sorted({*(a if rng.random() < 0.3 else rng.sample(range(1, end + 1), rng.randint(1, end))), end})
        found = alignment.aligned(np.array(a), np.array(b), rng.choice([1, 3, 1000]))
        common = sorted(set(a) & set(b))
        assert found.a_ends.tolist() == [a.index(e) + 1 for e in common]
        assert found.b_ends.tolist() == [b.index(e) + 1 for e in common]
        overlaps = [(i, j) for i in range(len(a)) for j in range(len(b))
                    if (a[i - 1] if i else 0) < b[j] and (b[j - 1] if j else 0) < a[i]]
        assert sorted(zip(found.a_links.tolist(), found.b_links.tolist())) == overlaps


def test_stretches_are_one_range_each():
    a = [*range(1, 1001), 1003, 1004, *range(1005, 1050)]
    b = [*range(1, 1001), 1001, 1002, 1004, *range(1005, 1050)]
    assert alignment.groups(a, b) == [(0, 1000, 0, 1000), (1000, 1002, 1000, 1003), (1002, 1047, 1003, 1048)]


def test_a_tokenizer_that_must_encode_whole_texts(spark, docs_of, tmp_path):
    with open(A_PATH, encoding="utf-8") as file:
        told = json.load(file)
    told["normalizer"] = {"type": "NFC"}  # no cuts; texts that it changes are not spelt by its tokens
    path = tmp_path / "a.json"
    path.write_text(json.dumps(told))
    got = found(alignment.op12_token_alignment(docs_of([*TEXTS[:12], "é"]), str(path), B_PATH))
    assert got[:12] == brute(TEXTS[:12]) and got[12] == (0, 0, 0, 0, 0, 0, "")


def test_repeated_ids_empty_table_and_clashing_columns(spark, docs_of):
    assert alignment.op12_token_alignment(docs_of([]), A_PATH, B_PATH).collect() == []
    docs = docs_of(["one two", "one two"], ids=[1, 1]).selectExpr("*", "1 AS place", "2 AS pairs", "3 AS n_a")
    assert found(alignment.op12_token_alignment(docs, A_PATH, B_PATH)) == brute(["one two", "one two"])
