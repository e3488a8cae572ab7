"""Vectorised scanning of whole Arrow text columns with numpy.

Texts are UTF-8 bytes in one buffer. Work goes through the buffer in runs of whole texts of about
``RUN_BYTES``, so that temporary arrays stay small however large a batch is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

RUN_BYTES = 1 << 20
# Any odd number has an inverse modulo 2**64, so a word's polynomial can be moved to its start.
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SHORT = 64  # bytes of a span that is hashed eight bytes at a time
_powers: dict[str, np.ndarray] = {}


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    if len(at) == 0:
        return raw[:0], np.zeros(1, np.int64)
    return raw[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, limit: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes; a longer text is a run of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def byte_set(*parts: str | range) -> np.ndarray:
    """A table that is true for the given bytes."""
    table = np.zeros(256, dtype=bool)
    for part in parts:
        table[[ord(c) for c in part] if isinstance(part, str) else list(part)] = True
    return table


SPACE = byte_set(" ", range(9, 14))
# Letters, digits and every byte of a non-ASCII character.
WORD = byte_set(range(48, 58), range(65, 91), range(97, 123), range(128, 256))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def spans(data: np.ndarray, offsets: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of member bytes; none crosses the end of a text."""
    inside = member[data]
    if not inside.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def _codes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A code for each span by its bytes, and the place of a span of each code. Spans are short.

    Spans are hashed and compared eight bytes at a time: those of one hash must equal one of them,
    or all are told apart by a table of whole values.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eights = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    h, lanes = lengths.astype(np.uint64), []
    for at in range(0, int(lengths.max(initial=0)), 8):
        some = np.flatnonzero(lengths > at)
        left = np.minimum(lengths[some] - at, 8).astype(np.uint64)
        value = eights[starts[some] + at] & (np.uint64(2**64 - 1) >> (np.uint64(64) - left * np.uint64(8)))
        lanes.append((some, value))
        h[some] = mix(h[some] * np.uint64(_BASE) ^ value)
    codes = pa.array(h).dictionary_encode().indices.to_numpy()
    place = np.empty(int(codes.max(initial=-1)) + 1, np.int64)
    place[codes] = np.arange(len(codes))
    one = place[codes]
    same = bool((lengths == lengths[one]).all())
    whole = np.zeros(len(codes), np.uint64)
    for some, value in lanes if same else ():
        whole[some] = value
        same = same and bool((value == whole[one[some]]).all())
    if not same:
        raw = data.tobytes()
        spans_of = pa.array([raw[i : i + n] for i, n in zip(starts.tolist(), lengths.tolist())], pa.binary())
        codes = spans_of.dictionary_encode().indices.to_numpy()
        place = np.empty(int(codes.max()) + 1, np.int64)
        place[codes] = np.arange(len(codes))
    return codes, place


def distinct(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """The spans between neighbouring bounds by their bytes: a code for each, and the span of each code."""
    lengths = np.diff(bounds)
    raw, starts = data.tobytes(), bounds[:-1]
    long = np.flatnonzero(lengths > _SHORT)
    if not len(long):
        codes, place = _codes(data, starts, lengths)
        at, to = starts[place].tolist(), bounds[1:][place].tolist()
        return codes, [raw[i:j] for i, j in zip(at, to)]
    short = np.flatnonzero(lengths <= _SHORT)
    codes = np.empty(len(lengths), np.int64)
    codes[short], place = _codes(data, starts[short], lengths[short])
    place = short[place]
    words = [raw[i:j] for i, j in zip(starts[place].tolist(), bounds[1:][place].tolist())]
    known: dict[bytes, int] = {}
    for k in long.tolist():
        codes[k] = known.setdefault(raw[bounds[k] : bounds[k + 1]], len(words) + len(known))
    return codes, [*words, *known]


def spread(held: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lists of 32-bit numbers, given once each as bytes, one after another as the codes call them, and
    where each one starts (one more than codes)."""
    lengths = np.fromiter(map(len, held), np.int64, len(held)) // 4
    flat = np.frombuffer(b"".join(held), np.int32)
    first = np.cumsum(lengths) - lengths
    n = lengths[codes]
    done = np.concatenate(([0], np.cumsum(n)))
    return flat[np.repeat(first[codes] - done[:-1], n) + np.arange(done[-1])], done


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values over all their bits."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _power(base: str, factor: int, n: int) -> np.ndarray:
    held = _powers.get(base)
    if held is None or len(held) < n:
        steps = np.full(max(n, RUN_BYTES + 1), factor, dtype=np.uint64)
        steps[0] = 1
        held = _powers[base] = np.multiply.accumulate(steps)
    return held


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every span, the same wherever it stands. Spans are in order."""
    out = np.empty(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        low = int(starts[at])
        to = max(int(np.searchsorted(ends, low + RUN_BYTES, side="right")), at + 1)
        if int(ends[to - 1]) - low > RUN_BYTES:  # one very long word
            out[at] = xxhash.xxh64_intdigest(data[low : ends[at]].tobytes(), 7)
            at = to
            continue
        part = data[low : ends[to - 1]].astype(np.uint64)
        part += np.uint64(1)
        part *= _power("up", _BASE, len(part))[: len(part)]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part, out=sums[1:])
        a, b = starts[at:to] - low, ends[at:to] - low
        out[at:to] = (sums[b] - sums[a]) * _power("down", _INVERSE, len(part))[a]
        at = to
    return mix(out)


def grams(word: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every ``n`` consecutive words (fewer words: empty)."""
    count = len(word) - n + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(count, dtype=np.uint64)
    for k in range(n):
        out = out * np.uint64(_BASE) + word[k : k + count]
    return mix(out)
