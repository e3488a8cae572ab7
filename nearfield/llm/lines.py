"""Fuzzy line dedup: SimHash blocks and MinHash tables of normalised lines, edit similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm import textscan
from nearfield.llm.common import by_batch, id_and_text, materialize
from nearfield.llm.components import components
from nearfield.operators.quantize import rows_with
from nearfield.session import ship_package

MAX_BITS = 3
SIMILARITY = 0.8
LEAST_WORDS = 5  # shorter lines have no SimHash
# MinHash tables of pairs of neighbouring words: lines meet if in one table all least hashes agree.
TABLES = 16
_LEAST_HASHES = 4

# 64 bits in five blocks: of two prints that differ in at most three bits at least two blocks agree,
# so they meet under one of the ten choices of two blocks.
_EDGES = (0, 13, 26, 39, 52, 64)
_BLOCKS = [((1 << (b - a)) - 1) << a for a, b in zip(_EDGES, _EDGES[1:])]
_MASKS = [a | b for a, b in combinations(_BLOCKS, 2)]
# Members of a block that are paired in one go; a larger block is cut into cells of this many,
# and every two cells are one unit of work.
_CELL = 256

# Postings are dealt to parts by the first bits of their value, so that they need only its last 32
# bits: 14 bytes each, packed by part, instead of a row each. A task packs about _TAKE lines at a
# time, a part gets about _PART postings. ``chars`` is a line's length, 0 if it tells nothing.
_POST = np.dtype([("low", "<u4"), ("id", "<u8"), ("chars", "<u2")])
_TAKE, _PART = 1 << 18, 1 << 17

# Edit distances are found for up to _PAIRS pairs of like length at a time, in tables of up to _TABLE
# numbers; fewer than _FEW pairs for every 64 characters of their lines one by one.
_PAIRS, _FEW, _TABLE = 2048, 24, 1 << 22

_LINE = ~textscan.byte_set("\n")
_NORMAL = np.where(textscan.WORD, textscan.LOWER, 32).astype(np.uint8)
_NORMAL[48:58] = ord("0")  # numbers differ from page to page: all digits count as one


def _normalised(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
    """Lines in lower case, digits alike, with single spaces between words."""
    raw = _NORMAL[data].tobytes()
    return [b" ".join(raw[i:j].split()) for i, j in zip(starts.tolist(), ends.tolist())]


# Bit k of a byte as the k-th byte of a number: sums of up to 255 of these count eight bits at once.
_SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
_AT_ONCE = 255


def _words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the normalised words of all lines, and the first and the end of each line's."""
    normal = _NORMAL[data]
    offsets = np.concatenate(([0], np.unique(np.concatenate((starts, ends))), [len(data)]))
    word_starts, word_ends = textscan.spans(normal, np.unique(offsets), textscan.WORD)
    word = textscan.hashes(normal, word_starts, word_ends)
    return word, np.searchsorted(word_starts, starts), np.searchsorted(word_starts, ends)


def _keys(word: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    count = last - first
    powers = textscan._power("up", textscan._BASE, int(count.max(initial=0)) + 1)
    place = np.arange(len(word)) - np.repeat(first, count)
    sums = np.zeros(len(word) + 1, dtype=np.uint64)
    np.cumsum(word * powers[place], out=sums[1:])
    return textscan.mix(sums[last] - sums[first] + count.astype(np.uint64))


def prints(data: np.ndarray, starts: np.ndarray, ends: np.ndarray,
           n_bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per line: a hash of its normalised words, the first bits (a multiple of eight) of its SimHash over
    them, and how many words there are."""
    word, first, last = _words(data, starts, ends)
    whole, count = _keys(word, first, last), last - first
    bits = np.zeros(len(starts), dtype=np.uint64)
    some = np.flatnonzero(count > 0)
    if not len(some):
        return whole, bits, count
    pieces = -(-count[some] // _AT_ONCE)
    at = np.cumsum(pieces) - pieces
    piece = np.repeat(first[some] - _AT_ONCE * at, pieces) + _AT_ONCE * np.arange(int(pieces.sum()))
    octets = word.astype("<u8").view(np.uint8).reshape(-1, 8)
    for i in range(n_bits // 8):
        sums = np.add.reduceat(_SPREAD[octets[:, i]], piece).view(np.uint8).reshape(-1, 8)
        ones = np.add.reduceat(sums.astype(np.int64), at)
        byte = np.packbits(ones * 2 > count[some, None], axis=1, bitorder="little")[:, 0]
        bits[some] |= byte.astype(np.uint64) << np.uint64(8 * i)
    return whole, bits, count


def slots(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, tables: int) -> np.ndarray:
    """Per line that has a word: its value in every MinHash table."""
    return _slots(*_words(data, starts, ends), tables)


def _slots(word: np.ndarray, first: np.ndarray, last: np.ndarray, tables: int) -> np.ndarray:
    first, last = first[last > first], last[last > first]
    out = np.zeros((len(first), tables), dtype=np.uint64)
    if not len(first):
        return out
    feature = np.append(textscan.grams(word, 2), word[-1:])  # a line's last word has no pair
    alone = last - first == 1
    feature[first[alone]] = word[first[alone]]
    none = last[~alone] - 1
    feature ^= feature >> np.uint64(29)
    order = np.empty_like(feature)
    seed = textscan.mix(np.arange(1, tables * _LEAST_HASHES + 1, dtype=np.uint64))
    for t in range(tables):
        value = np.zeros(len(first), dtype=np.uint64)
        for k in range(_LEAST_HASHES):
            np.multiply(feature, seed[t * _LEAST_HASHES + k] | np.uint64(1), out=order)
            order[none] = np.uint64(0xFFFFFFFFFFFFFFFF)
            value = textscan.mix(value + np.minimum.reduceat(order, first))
        out[:, t] = value
    return out


def _chars(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, count: np.ndarray) -> np.ndarray:
    """How many characters the normalised lines have."""
    begins = textscan.WORD[data] & (data & 0xC0 != 0x80)
    sums = np.concatenate(([0], np.cumsum(begins)))
    return sums[ends] - sums[starts] + np.maximum(count - 1, 0)


def _tag(chars: np.ndarray) -> np.ndarray:
    return np.where(chars < 1 << 16, chars, 0).astype(np.uint16)


def _like_length(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    a, b = a.astype(np.int64), b.astype(np.int64)
    return (a == 0) | (b == 0) | (np.abs(a - b) <= (1 - similarity) * np.maximum(a, b) + 1e-9)


def _of_like_length(a: str, b: str, similarity: float) -> Column:
    a, b = F.col(a), F.col(b)
    return (a == 0) | (b == 0) | (F.abs(a - b) <= F.lit(1 - similarity) * F.greatest(a, b) + 1e-9)


def _scanned(column: pa.Array) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of whole texts: their bytes, where lines start and end, and each line's row and number."""
    data, offsets = textscan.texts(column)
    for i, j in textscan.runs(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends = textscan.spans(part, at, _LINE)
        if len(starts):
            row = np.searchsorted(at, starts, side="right") - 1
            breaks = np.concatenate(([0], np.cumsum(part == 10)))
            yield part, starts, ends, row + i, breaks[starts] - breaks[at[row]]


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, line, key, fp, words, chars)`` for every line that has a word; lines count from 0 within
    a document and include those without words."""

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part, starts, ends, row, line in _scanned(batch.column(1)):
            whole, bits, count = prints(part, starts, ends)
            some = count > 0
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row[some])), pa.array(line[some]), pa.array(whole[some].view(np.int64)),
                 pa.array(bits[some].view(np.int64)), pa.array(count[some].astype(np.int64)),
                 pa.array(_chars(part, starts, ends, count)[some])],
                names=["doc_id", "line", "key", "fp", "words", "chars"])

    schema = "doc_id long, line long, key long, fp long, words long, chars long"
    return by_batch(id_and_text(docs, id_col, text_col), each, schema)


def _posted(df: DataFrame, found: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, ...]]],
            n: int) -> DataFrame:
    """Packed postings ``(deal, part, posts)`` of what ``found`` gives of batches: ids, their lengths, and
    per id a value in every table; there are about ``n`` ids.

    A part is one table's values of the same first bits, and ``deal`` names what must come together.
    Of a value that many ids of a task have, only ``_CELL`` are dealt to the part; the others, known to
    share it, have a negative ``deal`` and go wherever they may.
    """
    ship_package(df.sparkSession)
    bits = max(4, (n // _PART).bit_length())

    def packed(ids: np.ndarray, chars: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        ids, one = np.unique(ids, return_index=True)
        for t in range(values.shape[1]):
            value = values[one, t]
            order = np.argsort(value)
            value = value[order]
            posts = np.empty(len(ids), _POST)
            posts["low"], posts["id"], posts["chars"] = value & np.uint64(0xFFFFFFFF), ids[order], chars[one][order]
            starts = np.flatnonzero(np.append(True, value[1:] != value[:-1]))
            few = np.arange(len(ids)) - np.repeat(starts, np.diff(np.append(starts, len(ids)))) < _CELL
            cuts = np.searchsorted(value >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64))
            deal, part, held = [], [], []
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                block, fine = posts[cuts[p] : cuts[p + 1]], few[cuts[p] : cuts[p + 1]]
                for some, name in ((fine, t << bits | p), (~fine, -1 - int(block["id"][0] >> np.uint64(2)))):
                    if some.any():
                        deal.append(name)
                        part.append(t << bits | p)
                        held.append(block[some].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(deal, pa.int64()), pa.array(part, pa.int64()), pa.array(held, pa.binary())],
                names=["deal", "part", "posts"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for ids, chars, values in found(batch):
                held, size = [*held, (ids, chars, values)], size + len(ids)
                if size >= _TAKE:
                    yield from packed(*map(np.concatenate, zip(*held)))
                    held, size = [], 0
        if size:
            yield from packed(*map(np.concatenate, zip(*held)))

    return df.mapInArrow(each, "deal long, part long, posts binary")


def _met(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one deal, the postings whose value another id has: value (with its table and part, so that equal
    ones meet), id and length in their order, and how many ids have the value."""
    part, known = table["part"][0].as_py(), table["deal"][0].as_py() < 0
    if known:
        blocks = [(p, np.frombuffer(x, _POST)) for p, x in zip(table["part"].to_pylist(), table["posts"].to_pylist())]
        value = np.concatenate([b["low"].astype(np.int64) | p << 32 for p, b in blocks])
        posts = np.concatenate([b for _, b in blocks])
        return value, posts["id"], posts["chars"], np.full(len(value), _CELL + 1)
    posts = np.concatenate([np.frombuffer(x, _POST) for x in table["posts"].to_pylist()])
    posts = posts[np.argsort(posts["low"])]
    same = posts["low"][1:] == posts["low"][:-1]
    posts = posts[np.append(False, same) | np.append(same, False)]
    posts = posts[np.lexsort((posts["id"], posts["low"]))]
    low, ids = posts["low"], posts["id"]
    other = (low[1:] != low[:-1]) | (ids[1:] != ids[:-1])  # several tasks may have met one line
    posts = posts[np.append(True, other)[: len(posts)]]
    low = posts["low"]
    starts = np.flatnonzero(np.append(True, low[1:] != low[:-1])[: len(low)])
    size = np.diff(np.append(starts, len(low)))
    size = np.repeat(size, size)
    posts, low, size = posts[size > 1], low[size > 1], size[size > 1]
    return low.astype(np.int64) | part << 32, posts["id"], posts["chars"], size


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _near(value: np.ndarray, fp: np.ndarray, chars: np.ndarray, choice: int,
          similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of prints in order of their block, pairs in one block that differ in at most ``MAX_BITS`` bits, are
    of like length and agree in no choice of blocks before this one, so that a pair comes once."""
    found, at = [], np.arange(len(fp) - 1)
    for step in range(1, len(fp)):
        at = at[at + step < len(fp)]
        at = at[value[at] == value[at + step]]
        if not len(at):
            break
        differ = fp[at] ^ fp[at + step]
        some = (np.bitwise_count(differ) <= MAX_BITS) & _like_length(chars[at], chars[at + step], similarity)
        near, differ = at[some], differ[some]
        first = np.argmax([differ & np.uint64(m) == 0 for m in _MASKS], axis=0)
        near = near[first == choice]
        found.append((fp[near], fp[near + step]))
    a, b = map(np.concatenate, zip(*found)) if found else (fp[:0], fp[:0])
    return a.view(np.int64), b.view(np.int64)


def close_prints(distinct: DataFrame, similarity: float = 0.0) -> DataFrame:
    """Pairs ``(a, b)``, a < b, of prints that differ in at most ``MAX_BITS`` bits, from one row ``(fp, chars)``
    per print. Prints of one line each (``chars`` is its length, else 0) whose lengths rule the
    similarity out are left out. Prints meet in blocks; a large block is cut into cells by print, and
    every two cells of it are joined on their own, so that no task holds a large block."""
    n = distinct.count()
    bits = max(4, (n // _PART).bit_length())

    def blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        fp, chars = (c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns)
        yield fp, _tag(chars), np.stack([textscan.mix(fp & np.uint64(m)) for m in _MASKS], axis=1)

    def pairs(table: pa.Table) -> pa.Table:
        value, fp, chars, size = _met(table)
        choice, small = value >> (32 + bits), size < _CELL
        a, b = _near(value[small], fp[small], chars[small], int(choice[0]), similarity) if small.any() else (fp[:0].view(np.int64),) * 2
        rest = pa.nulls(len(a), pa.int64())
        return pa.table({
            "choice": pa.chunked_array([rest, pa.array(choice[~small])]),
            "value": pa.chunked_array([rest, pa.array(value[~small])]),
            "a": np.concatenate((a, fp[~small].view(np.int64))),
            "b": pa.chunked_array([pa.array(b), pa.nulls(int((~small).sum()), pa.int64())])})

    met = _posted(distinct.select("fp", "chars"), blocks, n).groupBy("deal").applyInArrow(
        pairs, "choice long, value long, a long, b long")
    met = materialize(met, "line-blocks")
    post = met.filter("b IS NULL").select("choice", "value", F.col("a").alias("fp")).distinct()
    post = post.join(post.groupBy("value").agg(F.count(F.lit(1)).alias("members")), "value")
    cells = F.ceil(F.col("members") / _CELL).cast("int")
    cell = F.pmod(F.xxhash64("fp"), cells).cast("int")
    # a cell meets itself and every other once: the left side is sent to all cells from its own on
    left = post.select("choice", "value", F.col("fp").alias("a"), cell.alias("own"),
                       F.explode(F.sequence(cell, cells - 1)).alias("cell"))
    right = post.select("value", F.col("fp").alias("b"), cell.alias("cell"))
    both = left.join(right, ["value", "cell"]).filter((F.col("own") < F.col("cell")) | (F.col("a") < F.col("b")))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    agreed = F.lit(None).cast("int")
    for i, m in reversed(list(enumerate(_MASKS))):
        agreed = F.when(differ.bitwiseAND(F.lit(_signed(m))) == 0, i).otherwise(agreed)
    # a pair is taken from the first choice under which it agrees, so it comes once
    large = both.filter(F.bit_count(differ) <= MAX_BITS).filter(agreed == F.col("choice")).filter("a <> b")
    return met.filter("b IS NOT NULL").select("a", "b").union(large.select("a", "b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def shared_slots(text: DataFrame, tables: int, n: int) -> DataFrame:
    """``(slot, key, chars)`` of the lines of all texts that share a slot of a MinHash table with another
    line, of about ``n`` different ones."""

    def found(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for part, starts, ends, _, _ in _scanned(batch.column(0)):
            word, first, last = _words(part, starts, ends)
            some = last > first
            yield (_keys(word, first, last)[some], _tag(_chars(part, starts, ends, last - first)[some]),
                   _slots(word, first, last, tables))

    def members(table: pa.Table) -> pa.Table:
        slot, key, chars, _ = _met(table)
        return pa.table({"slot": slot, "key": key.view(np.int64), "chars": chars.astype(np.int64)})

    return _posted(text.select("text"), found, n).groupBy("deal").applyInArrow(
        members, "slot long, key long, chars long").distinct()


def _wanted_texts(docs: DataFrame, places: DataFrame) -> DataFrame:
    """``(key, normal)``: the normalised text of chosen lines ``(doc_id, line, key)``, one per key."""
    some = materialize(places.groupBy("doc_id").agg(F.collect_list(F.struct("line", "key")).alias("wanted")), "places")
    held = rows_with(docs.withColumnRenamed("doc_id", "id"), some.select(F.col("doc_id").alias("id")))
    read = held.join(some, held["id"] == some["doc_id"]).select("text", "wanted")

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = textscan.texts(batch.column(0))
        keys, found = [], []
        for k, wanted in enumerate(batch.column(1)):
            part = data[offsets[k] : offsets[k + 1]]
            starts, ends = textscan.spans(part, np.array([0, len(part)]), _LINE)
            breaks = np.concatenate(([0], np.cumsum(part == 10)))[starts]
            whole, _, _ = prints(part, starts, ends, n_bits=0)
            asked = {(w["line"].as_py(), w["key"].as_py()) for w in wanted.values}
            rows = [r for r, (line, key) in enumerate(zip(breaks.tolist(), whole.view(np.int64).tolist()))
                    if (line, key) in asked]
            keys += whole[rows].view(np.int64).tolist()
            found += _normalised(part, starts[rows], ends[rows])
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array([x.decode() for x in found], pa.string())], names=["key", "normal"])

    return by_batch(read, each, "key long, normal string").dropDuplicates(["key"])


def _unshared(a: str, b: str) -> tuple[str, str]:
    """Both texts without what their ends share, found by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        half = (low + high + 1) // 2
        low, high = (half, high) if a[low:half] == b[low:half] else (low, half - 1)
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        half = (low + high + 1) // 2
        same = a[len(a) - half : len(a) - low] == b[len(b) - half : len(b) - low]
        low, high = (half, high) if same else (low, half - 1)
    return a[: len(a) - low], b[: len(b) - low]


def edits(a: str, b: str) -> int:
    """Edit distance. What both ends share is left out; the rest takes one step of whole-column bit
    operations per character of ``b``, with a column as one integer."""
    a, b = _unshared(a, b)
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    whole, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = whole, 0, len(a)  # where a column's value rises and falls from row to row
    for c in b:
        same = places.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        rise = down | (whole & ~(diagonal | up))
        fall = up & diagonal
        score += bool(rise & top) - bool(fall & top)
        rise = rise << 1 | 1
        up = (fall << 1 | ~(diagonal | rise)) & whole
        down = rise & diagonal & whole
    return score


def _columns(left: list[str], right: list[str]) -> np.ndarray:
    """Edit distances of pairs, by falling length of ``right``: the steps of ``edits`` on all pairs at once,
    a column being numbers of 64 rows each."""
    m, n = (np.array([len(x) for x in side]) for side in (left, right))
    letter = np.frombuffer("".join(left + right).encode("utf-32-le"), "<u4")
    used = np.zeros(int(letter.max()) + 1, dtype=np.int64)
    used[letter] = 1
    k, pairs, words = int(used.sum()), len(left), int(-(-m.max() // 64))
    code = (np.cumsum(used) - 1)[letter]
    if k * pairs * words > _TABLE and pairs > 1:
        half = pairs // 2
        return np.concatenate((_columns(left[:half], right[:half]), _columns(left[half:], right[half:])))

    def by_place(length: np.ndarray, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((pairs, int(length.max())), dtype=np.int64)
        out[np.arange(out.shape[1]) < length[:, None]] = codes
        return np.ascontiguousarray((out + np.arange(pairs)[:, None] * k).T)

    one, top = np.uint64(1), np.uint64(63)
    places = np.zeros((words, pairs * k), dtype=np.uint64)
    for i, row in enumerate(by_place(m, code[: m.sum()])):
        places[i // 64, row[m > i]] |= one << np.uint64(i % 64)
    up = np.full((words, pairs), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    down = np.zeros((words, pairs), dtype=np.uint64)
    going = np.searchsorted(-n, -np.arange(int(n.max())), side="left")
    reach = [int(np.flatnonzero(m > 64 * w)[-1]) + 1 for w in range(words)]  # the pairs with rows in a number
    for row, going_on in zip(by_place(n, code[m.sum() :]), going.tolist()):
        above, below = one, np.uint64(0)  # what rises and falls from column to column above a number's rows
        for w in range(words):
            c = min(going_on, reach[w])
            above, below = above[:c] if w else above, below[:c] if w else below
            same, u, d = places[w].take(row[:c]), up[w, :c], down[w, :c]
            vertical = same | d
            same |= below
            diagonal = (((same & u) + u) ^ u) | same
            rise = d | ~(diagonal | u)
            fall = u & diagonal
            next_above, next_below = rise >> top, fall >> top
            rise = (rise << one) | above
            fall = (fall << one) | below
            up[w, :c] = fall | ~(vertical | rise)
            down[w, :c] = rise & vertical
            above, below = next_above, next_below
    inside = np.clip(m - 64 * np.arange(words)[:, None], 0, 64)
    mask = np.where(inside > 0, np.uint64(0xFFFFFFFFFFFFFFFF) >> (64 - np.maximum(inside, 1)).astype(np.uint64), np.uint64(0))
    return n + (np.bitwise_count(up & mask).astype(np.int64) - np.bitwise_count(down & mask)).sum(axis=0)


def edits_of_pairs(left: list[str], right: list[str]) -> np.ndarray:
    """The edit distance of every pair."""
    out = np.zeros(len(left), dtype=np.int64)
    cut = [_unshared(a, b) for a, b in zip(left, right)]
    left, right = [a for a, _ in cut], [b for _, b in cut]
    m, n = (np.array([len(x) for x in side], dtype=np.int64) for side in (left, right))
    rows = np.argsort(-n, kind="stable")
    at = 0
    while at < len(rows):
        to = min(int(np.searchsorted(-n[rows], -0.8 * n[rows[at]], side="right")), at + _PAIRS)
        some = rows[at:to]
        if min(m[some].min(), n[some].min()) and len(some) * 64 >= _FEW * m[some].max():
            out[some] = _columns([left[i] for i in some], [right[i] for i in some])
        else:
            out[some] = [edits(left[i], right[i]) for i in some]
        at = to
    return out


def _alike(pairs: DataFrame, normal: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``(a, b)`` of keys whose normalised texts are similar enough."""
    one, two = (normal.select(F.col("key").alias(k), F.col("normal").alias(t)) for k, t in (("a", "ta"), ("b", "tb")))

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        left, right = (batch.column(c).to_pylist() for c in (2, 3))
        size = np.array([[len(x) for x in side] for side in (left, right)])
        allowed = (1 - similarity) * size.max(axis=0) + 1e-9
        fine = np.abs(size[0] - size[1]) <= allowed
        some = np.flatnonzero(fine).tolist()
        fine[some] = edits_of_pairs([left[i] for i in some], [right[i] for i in some]) <= allowed[some]
        yield batch.select([0, 1]).filter(pa.array(fine, pa.bool_()))

    met = pairs.distinct().join(one, "a").join(two, "b").select("a", "b", "ta", "tb")
    return materialize(by_batch(met, each, "a long, b long"), "line-links")


def similar_lines(nodes: DataFrame, docs: DataFrame, similarity: float, least_words: int,
                  tables: int) -> DataFrame:
    """``(node, component)`` of the distinct lines ``(key, fp, words, first)`` that are linked.

    Links inside a component that is known already need not be looked at, so pairs are verified in
    three steps: every line with the first line of its print and of its slots, and every print's first
    line with that of the least near print; then first lines of near prints that are still apart; then
    single lines of near prints and of slots that are still apart, slots being cut into cells. What is
    left out joins nothing new, so the components are those of all pairs, while a group of many copies
    costs a few pairs per line.
    """
    long = nodes.filter(F.col("words") >= least_words)
    n = F.count(F.lit(1))
    prints = materialize(long.groupBy("fp").agg(
        F.min("key").alias("head"), n.alias("n"), F.when(n == 1, F.max("chars")).otherwise(0).alias("chars")), "prints")
    near = materialize(close_prints(prints, similarity), "near-prints")
    met = near.select(F.col("a").alias("fp")).union(near.select(F.col("b").alias("fp"))).distinct().withColumn("met", F.lit(True))
    used = materialize(prints.join(met.hint("shuffle_hash"), "fp", "left").filter("n > 1 OR met").select("fp", "head"), "used-prints")
    place = [F.col("first.doc_id").alias("doc_id"), F.col("first.line").alias("line")]
    lines = materialize(long.join(used.hint("shuffle_hash"), "fp").select("key", "fp", "head", "chars", *place), "near-lines")
    places = lines.select("key", "doc_id", "line")

    heads = lines.filter("key = head").select("fp", "head", "chars")
    least = near.groupBy("b").agg(F.min("a").alias("a"))
    alike = _of_like_length("ca", "cb", similarity)

    def of_heads(pairs: DataFrame) -> DataFrame:
        left, right = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"h{c}"), F.col("chars").alias(f"c{c}"))
                       for c in ("a", "b"))
        return pairs.join(left, "a").join(right, "b").filter(alike).select(
            F.least("ha", "hb").alias("a"), F.greatest("ha", "hb").alias("b"))

    first = lines.filter("key <> head").select(F.col("head").alias("a"), F.col("key").alias("b")).union(of_heads(least))
    if tables:
        shared = materialize(shared_slots(docs, tables, nodes.count()), "line-slots")
        slot_heads = shared.groupBy("slot").agg(F.min(F.struct("key", "chars")).alias("head"))
        first = first.union(shared.withColumnRenamed("chars", "cb").join(
            slot_heads.select("slot", F.col("head.key").alias("head"), F.col("head.chars").alias("ca")), "slot").filter(
            "key <> head").filter(alike).select("head", "key"))
        places = places.union(nodes.join(shared.select("key").distinct().hint("shuffle_hash"), "key").select("key", *place))
    normal = materialize(_wanted_texts(docs, places), "line-texts")
    tried = materialize(first.distinct(), "line-stars")
    links = _alike(tried, normal, similarity)
    of = materialize(components(links), "line-parts")

    def part_of(keys: DataFrame) -> DataFrame:
        return keys.join(of, F.col("key") == F.col("node"), "left").withColumn(
            "part", F.coalesce("component", "key")).drop("node", "component")

    pairs = of_heads(near)
    for c in ("a", "b"):
        pairs = part_of(pairs.withColumn("key", F.col(c))).withColumnRenamed("part", f"p{c}").drop("key")
    apart = pairs.filter("pa <> pb").select("a", "b").distinct().join(tried, ["a", "b"], "left_anti")
    apart = materialize(apart, "heads-apart")
    if not apart.isEmpty():
        tried = tried.union(apart)
        more = _alike(apart, normal, similarity)
        if not more.isEmpty():
            links = links.union(more)
            of = materialize(components(links), "line-parts")

    # prints whose lines are not all in one component, alone or together with a near print
    parts = materialize(part_of(lines.select("key", "fp", "chars")), "print-parts")
    span = parts.groupBy("fp").agg(F.min("part").alias("low"), F.max("part").alias("high"))
    every = near.select("a", "b").union(span.filter("low <> high").select(F.col("fp").alias("a"), F.col("fp").alias("b")))
    a, b = (span.select(F.col("fp").alias(c), F.col("low").alias(f"l{c}"), F.col("high").alias(f"h{c}")) for c in ("a", "b"))
    mixed = every.join(a, "a").join(b, "b").filter("least(la, lb) <> greatest(ha, hb)").select("a", "b")
    one, two = (parts.select(F.col("fp").alias(c), F.col("key").alias(f"k{c}"), F.col("part").alias(f"p{c}"),
                             F.col("chars").alias(f"c{c}")) for c in ("a", "b"))
    left = mixed.join(one, "a").join(two, "b").filter("pa <> pb").filter(alike).select("ka", "kb")
    if tables:
        left = left.union(_slots_apart(part_of(shared), similarity))
    left = left.select(F.least("ka", "kb").alias("a"), F.greatest("ka", "kb").alias("b")).distinct()
    left = materialize(left.join(tried, ["a", "b"], "left_anti"), "lines-apart")
    if not left.isEmpty():
        more = _alike(left, normal, similarity)
        if not more.isEmpty():
            of = components(links.union(more))
    return of


def _slots_apart(shared: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``(ka, kb)`` of lines ``(slot, key, chars, part)`` of like length in one slot and in different parts."""
    parts = materialize(shared, "slot-parts")
    mixed = parts.groupBy("slot").agg(
        F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("n")).filter("low <> high")
    post = parts.join(mixed.select("slot", "n"), "slot")
    cells = F.ceil(F.col("n") / _CELL).cast("int")
    cell = F.pmod(F.xxhash64("key"), cells).cast("int")
    left = post.select("slot", F.col("key").alias("ka"), F.col("part").alias("pa"), F.col("chars").alias("ca"), cell.alias("own"),
                       F.explode(F.sequence(cell, cells - 1)).alias("cell"))
    right = post.select("slot", F.col("key").alias("kb"), F.col("part").alias("pb"), F.col("chars").alias("cb"), cell.alias("cell"))
    met = left.join(right, ["slot", "cell"]).filter("pa <> pb AND (own < cell OR ka < kb)")
    return met.filter(_of_like_length("ca", "cb", similarity)).select("ka", "kb")


def groups(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text",
           least_words: int = LEAST_WORDS, tables: int = 0) -> DataFrame:
    """``(doc_id, line, words, group_id, keep)`` for every line that has a word.

    Lines that are equal when normalised (lower case, every digit alike, words only) are one node.
    Nodes of at least ``least_words`` words are linked if the SimHashes of their words differ in at
    most ``MAX_BITS`` bits and their texts have edit similarity (one less edits over the longer
    length) of ``similarity`` or more; with ``tables``, so are nodes of any length that share a slot of
    one of so many MinHash tables. ``group_id`` names a connected group; of each, the occurrence
    with the least document id and line is kept, wherever the others stand. A null text has no
    lines; rows without an id are left out, as their lines could not be told apart; rows that repeat
    an id count as one document, equal lines at one place of it as one line. Other columns are not
    read.

    Only distinct lines take part in the blocks, so a line that stands in a third of all documents
    is one node. Texts are scanned again for the slots, and read again for lines in near pairs only.
    """
    text = id_and_text(docs, id_col, text_col).filter("doc_id IS NOT NULL")
    every = lines(text)
    if not text.groupBy("doc_id").count().filter("count > 1").isEmpty():
        every = every.distinct()
    every = materialize(every, "lines")
    place = F.struct("doc_id", "line")
    nodes = materialize(every.groupBy("key").agg(
        F.min(place).alias("first"), F.first("fp").alias("fp"), F.first("words").alias("words"),
        F.first("chars").alias("chars")), "line-nodes")
    of = similar_lines(nodes, text, similarity, least_words, tables)
    linked = materialize(of.join(nodes.select(F.col("key").alias("node"), "first"), "node"), "linked-lines")
    kept = linked.groupBy("component").agg(F.min("first").alias("kept"))
    linked = linked.join(kept, "component").select(F.col("node").alias("key"), "component", "kept")
    named = nodes.join(linked.hint("shuffle_hash"), "key", "left").select(
        "key", F.coalesce("component", "key").alias("group_id"), F.coalesce("kept", "first").alias("kept"))
    return every.join(named, "key").select(
        "doc_id", "line", "words", "group_id", (place == F.col("kept")).alias("keep"))


def op7_fuzzy_lines(docs: DataFrame) -> DataFrame:
    """Per document: its lines, those that are kept, and the groups it shares with other lines."""
    found = groups(docs, tables=TABLES)
    return found.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if("keep").alias("n_kept"),
        F.sum("words").alias("n_words"), F.sum(F.when(F.col("keep"), F.col("words")).otherwise(0)).alias("kept_words"))
