import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from nearfield.llm import textscan


@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab Cé\n.9", max_size=30)), max_size=8))
@settings(max_examples=150, deadline=None)
def test_spans_are_the_words_of_each_text(rows):
    data, offsets = textscan.texts(pa.array(rows, pa.string()))
    starts, ends = textscan.spans(data, offsets, ~textscan.SPACE)
    raw = data.tobytes()
    expected = [w for t in rows for w in (t or "").encode().split()]
    assert [raw[i:j] for i, j in zip(starts, ends)] == expected


def test_hash_depends_on_the_bytes_only(monkeypatch):
    words = [b"alpha", b"beta", b"alpha", b"a" * 50, b"beta", b"\x00", b"\x00\x00"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = ends - [len(w) for w in words]
    for limit in (1 << 20, 64, 8):
        monkeypatch.setattr(textscan, "RUN_BYTES", limit)
        got = textscan.hashes(data, starts, ends)
        assert got[0] == got[2] and got[1] == got[4]
        assert len(set(got.tolist())) == 5
    assert got[3] == textscan.mix(np.array([xxhash.xxh64_intdigest(words[3], 7)], np.uint64))[0]


def test_sliced_columns_and_runs():
    column = pa.array(["abc", None, "", "de", "f" * 10])[1:]
    data, offsets = textscan.texts(column)
    assert data.tobytes() == b"de" + b"f" * 10 and offsets.tolist() == [0, 0, 0, 2, 12]
    assert list(textscan.runs(offsets, 4)) == [(0, 3), (3, 4)]
    assert list(textscan.runs(np.zeros(1, np.int64))) == []


def test_grams():
    word = np.arange(10, dtype=np.uint64)
    assert len(textscan.grams(word, 4)) == 7 and len(textscan.grams(word[:3], 4)) == 0
    again = textscan.grams(np.concatenate((word, word)), 4)
    assert again[0] == again[10]
