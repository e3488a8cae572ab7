import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from nearfield.llm import textscan, tokens
from nearfield.llm.queries import tokenizer_path

TEXTS = [
    "Hello world, it's  me.\n\n And   you?", None, "", " ", "\n", "a" * 3000, "x y 　z   w", "tab\t here",
    "end <|endoftext|> in text", "<|endoftext|>", "don't 123 45.6 ---- çé ñandú 漢字 かな", " leading", "trailing ",
    "  two", "a  b   c    d", "a \n b \r\n c", "1 2 3 '", "word " * 5000, "\x1c \x85 \x1f a", "𝔘 𝔫 😀 😀", "the the the",
]


@pytest.fixture(scope="module")
def reference():
    return Tokenizer.from_file(tokenizer_path())


def by_hand(reference, text):
    return [*reference.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]


def test_pieces_give_the_same_ids(reference):
    coder = tokens.Encoder(open(tokenizer_path()).read())
    assert coder.cuts
    plain = [t for t in TEXTS if t and "<|endoftext|>" not in t]
    data, offsets = textscan.texts(pa.array(plain * 2))
    ids, counts = coder.encode(data, offsets)
    expected = [reference.encode(t, add_special_tokens=False).ids for t in plain * 2]
    assert counts.tolist() == [len(e) for e in expected]
    assert ids.tolist() == [i for e in expected for i in e]


def test_digest(spark, docs_of, reference):
    order = [(i * 8) % len(TEXTS) for i in range(len(TEXTS))]
    docs = docs_of([TEXTS[i] for i in order], ids=[i * 3 for i in order]).withColumnRenamed("lang", "ids")
    docs = docs.repartition(5)
    rows = {r.doc_id: r for r in tokens.op5_token_lists(docs, tokenizer_path()).collect()}
    start = 0
    for i, text in enumerate(TEXTS):
        ids = by_hand(reference, text)
        r = rows[i * 3]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), i
        start += len(ids)
    assert len(rows) == len(TEXTS)


def test_repeated_and_missing_ids(docs_of, reference):
    docs = docs_of(["a", "b b", "b b", "c"], ids=[5, 2, 2, None])
    rows = sorted(tokens.op5_token_lists(docs, tokenizer_path()).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [2, 2, 5, None]
    assert [r.start for r in rows] == [0, 3, 6, 8]
    assert tokens.op5_token_lists(docs_of([]), tokenizer_path()).collect() == []


@pytest.mark.parametrize("encoding", ["dictionary", "delta"])
def test_files(spark, docs_of, tmp_path, reference, encoding):
    path = str(tmp_path / "out")
    docs = docs_of([f"text number {i} " * (i % 40) for i in range(3000)])
    tokens.write(docs, path, tokenizer_path(), layout=tokens.Layout(encoding=encoding, page_rows=500))
    footer = pq.ParquetFile(sorted((tmp_path / "out").glob("*.parquet"))[0]).metadata
    ids = next(footer.row_group(0).column(i) for i in range(3) if "ids" in footer.row_group(0).column(i).path_in_schema)
    assert ids.has_dictionary_page == (encoding == "dictionary")
    assert ids.has_column_index and ids.has_offset_index
    if encoding == "delta":
        assert "DELTA_BINARY_PACKED" in ids.encodings
    some = tokens.read(spark, path, first=700, last=702)
    assert "GreaterThanOrEqual(doc_id,700)" in some._jdf.queryExecution().executedPlan().toString()
    assert [r.ids for r in some.orderBy("doc_id").collect()] == [
        by_hand(reference, f"text number {i} " * (i % 40)) for i in (700, 701, 702)]
    narrow = tokens.read(spark, path).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in narrow.split("ReadSchema")[1]
    with pytest.raises(ValueError):
        tokens.Layout(encoding="plain").options()


@given(st.text(alphabet=st.one_of(st.characters(max_codepoint=0x180, exclude_categories=["Cs"]), st.sampled_from(
    " \n\t'smtdrlve1Aaé., \u0085\x1c　漢"))))
@settings(max_examples=1500, deadline=None)
def test_any_text_gives_the_same_ids(text):
    coder = _CODER or _CODER.append(tokens.Encoder(open(tokenizer_path()).read())) or _CODER
    data, offsets = textscan.texts(pa.array([text, text]))
    ids, counts = coder[0].encode(data, offsets)
    assert ids.tolist() == coder[0].tokenizer.encode(text, add_special_tokens=False).ids * 2
    assert counts[0] == counts[1]


_CODER = []


def thue_morse(letters, n):
    return "".join(letters[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("length", [16, 1024])
def test_words_of_one_hash_are_compared(spark, docs_of, length):
    """Words that collide in every polynomial modulo a power of two have their own ids."""
    texts = [thue_morse("ab", length), thue_morse("ba", length), thue_morse("ab", length)]
    path = tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    got = {r.doc_id: r.ids for r in tokens.encode(docs_of(texts), path, None).collect()}
    assert [got[i] for i in range(3)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_distinct_spans_where_hashes_collide(monkeypatch):
    monkeypatch.setattr(textscan, "mix", lambda h: h * np.uint64(0))
    words = [b"one", b"two", b"one", b"a longer word", b"three", b"", b"two", b"x" * 70, b"x" * 70, b"x" * 71]
    data = np.frombuffer(b"".join(words), np.uint8)
    codes, held = textscan.distinct(data, np.concatenate(([0], np.cumsum([len(w) for w in words]))))
    assert [held[c] for c in codes] == words and len(held) == len(set(words))


def test_random_mixtures_of_bytes_and_breaks():
    path = tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        encoder = tokens.Encoder(file.read())
    rng = random.Random(3)
    parts = ["a", "bc", "Z", "9", "12", " ", "  ", "\n", "\n\n", "\t", ".", "'s", "'", " \n", "\n ", "é", "×", "ß", "\xa0",
             " ", "\u0085", "日本", "😀", ",", "\r\n", "<|endoftext|>", "\x00", "\x1c", "\x0b"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(4000)]
    for k in range(0, len(texts), 40):
        raw = [t.encode() for t in texts[k : k + 40]]
        ids, n = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in raw]))))
        at = np.concatenate(([0], np.cumsum(n)))
        for text, i, j in zip(raw, at, at[1:]):
            assert ids[i:j].tolist() == tokenizer.encode(text.decode(), add_special_tokens=False).ids
