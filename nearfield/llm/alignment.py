"""Alignment of the tokens of two tokenizers over the same text, by diagonal run skipping."""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.llm import textscan
from nearfield.llm.common import by_batch, id_and_text, materialize
from nearfield.llm.tokens import Encoder, Recent

RUN_BYTES = 2 << 20
# Words that make a generation of a worker's cache; two generations are kept.
CACHE_ENTRIES = 100_000
# Pairs of ids, by falling count, that are broadcast; the others are joined by a shuffle.
FREQUENT_PAIRS = 1_000_000
# A step of the counts by which frequent pairs are told: an eighth of a power of two.
_STEPS = 8
# Tokens that are aligned at once.
WINDOW = 200_000
_LOW = (1 << 32) - 1
_PROBE = "ﬁ A  Ａ½ b"


class Pieces:
    """A sentence-piece tokenizer over texts that begin with the space which it adds itself.

    No token spans two neighbouring bytes that stand together in no piece. If nothing is normalised,
    texts are cut between such bytes, and each distinct part of a batch is encoded once, behind a
    character that joins with nothing. Other models encode texts whole.
    """

    def __init__(self, model: bytes):
        from sentencepiece import SentencePieceProcessor

        self.processor = SentencePieceProcessor(model_proto=model)
        spelt = [self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size())]
        self.bytes = [
            bytes([int(piece[3:5], 16)]) if self.processor.is_byte(i) else piece.replace("▁", " ").encode()
            for i, piece in enumerate(spelt)]
        self.together = np.zeros((256, 256), dtype=bool)
        self.together[:, 0x80:0xC0] = True  # no cut inside a character
        for i, piece in enumerate(self.bytes):
            if not (self.processor.is_control(i) or self.processor.is_unknown(i)):
                self.together[list(piece[:-1]), list(piece[1:])] = True
        self.guard = "\n"
        ahead, at = self.processor.encode(self.guard), ord(self.guard)
        self.cuts = (
            self.processor.normalize(_PROBE) == "▁" + _PROBE.replace(" ", "▁")
            and not self.together[at, :0x80].any() and not self.together[at, 0xC0:].any()
            and not self.together[32, at])
        self.ahead = len(ahead)
        self.words = Recent(CACHE_ENTRIES)

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word; none where its pieces spell something else, as U+2581 becomes a space."""
        skip = self.ahead if self.cuts else 0
        ahead = self.guard if self.cuts else ""
        found = self.processor.encode([ahead + w[0 if skip else 1 :].decode() for w in words])
        spelt = (b"".join(map(self.bytes.__getitem__, ids[skip:])) for ids in found)
        return [array("i", ids[skip:]).tobytes() if s == w else b"" for ids, s, w in zip(found, spelt, words)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids one after another, how many each text has, and which texts they spell."""
        starts = offsets[:-1]
        if self.cuts:
            begins = np.ones(len(data), dtype=bool)
            begins[1:] = ~self.together[data[:-1], data[1:]]
            begins[starts] = True
            starts = np.flatnonzero(begins)
        codes, words = textscan.distinct(data, np.append(starts, len(data)))
        held = self.words.of(words, self._ids)
        ids, done = textscan.spread(held, codes)
        odd = np.concatenate(([0], np.cumsum(np.diff(done) == 0)))
        bounds = np.searchsorted(starts, offsets)
        return ids, np.diff(done[bounds]), np.diff(odd[bounds]) == 0


class ByteLevel:
    """A byte-level tokenizer in which strings of special tokens are plain text."""

    def __init__(self, definition: str):
        self.encoder = Encoder(definition, plain=True)
        self.bytes = self.encoder.token_bytes()

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids, counts = self.encoder.encode(data, offsets)
        if self.encoder.cuts:  # nothing is normalised, and every byte has a letter
            return ids, counts, np.ones(len(counts), bool)
        at, raw = np.concatenate(([0], np.cumsum(counts))), data.tobytes()
        spelt = [b"".join(map(self.bytes.__getitem__, ids[i:j].tolist())) for i, j in zip(at, at[1:])]
        return ids, counts, np.array([s == raw[i:j] for s, i, j in zip(spelt, offsets, offsets[1:])], bool)


Range = tuple[int, int, int, int]


def groups(a_ends: list[int], b_ends: list[int]) -> list[Range]:
    """The least groups of tokens that end together, as ``(a, a_end, b, b_end)`` index ranges. A stretch of
    groups of one token a side is one range; the sides of any other group begin with tokens of
    different ends.

    ``a_ends`` and ``b_ends`` rise strictly and share their last number. While tokens match one to one,
    the two arrays agree at a fixed shift of the index. Blocks of doubling length are compared at
    that shift; in the first that differs, halving finds the last agreement, so a stretch of n tokens
    takes about log n comparisons. The group behind it is walked token by token, and its surplus of
    tokens on one side moves the shift.
    """
    found: list[Range] = []
    i, shift, n = 0, 0, len(a_ends)
    while i < n:
        j = i + shift
        x, y = a_ends[i], b_ends[j]
        if x == y:
            k, step = 1, 1
            while True:
                block = a_ends[i + k : i + k + step]
                if not block or block != b_ends[j + k : j + k + step]:
                    break
                k += len(block)
                step += step
            while step > 1:
                step >>= 1
                block = a_ends[i + k : i + k + step]
                if block and block == b_ends[j + k : j + k + step]:
                    k += len(block)
            found.append((i, i + k, j, j + k))
            i += k
            continue
        a, b = i, j
        while x != y:
            if x < y:
                a += 1
                x = a_ends[a]
            else:
                b += 1
                y = b_ends[b]
        found.append((i, a + 1, j, b + 1))
        shift = b - a
        i = a + 1
    return found


def _cut(a_ends: np.ndarray, b_ends: np.ndarray, least: int) -> tuple[int, int]:
    """Numbers of tokens, the first one's at least ``least`` if there are as many, after which both end."""
    for at in range(least - 1, len(a_ends), 4096):
        ends = a_ends[at : at + 4096]
        met = np.flatnonzero(b_ends[np.searchsorted(b_ends, ends)] == ends)
        if len(met):
            end = ends[met[0]]
            return at + int(met[0]) + 1, int(np.searchsorted(b_ends, end)) + 1
    return len(a_ends), len(b_ends)


def _each(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first``, ``first + 1`` and so on, ``n`` numbers for every entry."""
    done = np.cumsum(n) - n
    return np.repeat(first - done, n) + np.arange(int(n.sum()))


@dataclass(frozen=True)
class Alignment:
    """Where groups end on either side, in tokens, and the tokens of every link in order."""

    a_ends: np.ndarray
    b_ends: np.ndarray
    a_links: np.ndarray
    b_links: np.ndarray


def aligned(a_ends: np.ndarray, b_ends: np.ndarray, window: int = WINDOW) -> Alignment:
    """The alignment of tokens that end at these bytes, in windows that end where both sides do."""
    ranges, i, j = [np.empty((0, 4), np.int64)], 0, 0
    while i < len(a_ends):
        x, y = _cut(a_ends, b_ends, i + window)
        found = groups(a_ends[i:x].tolist(), b_ends[j:y].tolist())
        ranges.append(np.array(found, np.int64) + np.array([i, i, j, j]))
        i, j = x, y
    i, x, j, y = np.concatenate(ranges).T
    one_to_one = a_ends[i] == b_ends[j]
    # A stretch has a group and a link for each of its tokens.
    times = np.where(one_to_one, x - i, 1)
    a_group = _each(np.where(one_to_one, i + 1, x), times)
    b_group = _each(np.where(one_to_one, j + 1, y), times)
    a_even, b_even = _each(i[one_to_one], (x - i)[one_to_one]), _each(j[one_to_one], (y - j)[one_to_one])
    # Inside other groups, each stretch of bytes between neighbouring ends is a link's.
    i, x, j, y = i[~one_to_one], x[~one_to_one], j[~one_to_one], y[~one_to_one]
    ends = np.unique(np.concatenate([a_ends[_each(i, x - i)], b_ends[_each(j, y - j)]]))
    a_links = np.concatenate([a_even, np.searchsorted(a_ends, ends)])
    b_links = np.concatenate([b_even, np.searchsorted(b_ends, ends)])
    return Alignment(a_group, b_group, a_links, b_links)


class Names:
    """The decimal names of ids as bytes, first all of one side, then all of the other."""

    def __init__(self, a: int, b: int):
        names = [str(i).encode() for side in (a, b) for i in range(side)]
        self.length = np.array([len(x) + 1 for x in names], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b",".join([*names, b""]), np.uint8)
        self.second = a

    def told(self, a: np.ndarray, b: np.ndarray, found: Alignment) -> tuple[bytes, np.ndarray]:
        """All groups as ``a1,a2|b1;``, and where each one ends."""
        a_n, b_n = (np.diff(ends, prepend=0) for ends in (found.a_ends, found.b_ends))
        a_at = _each(found.a_ends - a_n + found.b_ends - b_n, a_n)
        b_at = _each(found.a_ends + found.b_ends - b_n, b_n)
        name = np.empty(len(a) + len(b), np.int64)
        name[a_at], name[b_at] = a, b.astype(np.int64) + self.second
        n = self.length[name]
        out = self.bytes[_each(self.start[name], n)]
        ends = np.cumsum(n)
        out[ends[found.a_ends + found.b_ends - b_n - 1] - 1] = ord("|")
        last = ends[found.a_ends + found.b_ends - 1]
        out[last - 1] = ord(";")
        return out.tobytes(), last


class Aligner:
    """Aligns the texts of a batch; kept by a worker, with the words that its tokenizers remember."""

    def __init__(self, definition: str, model: bytes):
        self.a, self.b = ByteLevel(definition), Pieces(model)
        self.a_length = np.array([len(x) for x in self.a.bytes], np.int64)
        self.b_length = np.array([len(x) for x in self.b.bytes], np.int64)
        self.names = Names(len(self.a_length), len(self.b_length))
        self.a_bits, self.b_bits = (max(1, (len(x) - 1).bit_length()) for x in (self.a_length, self.b_length))

    def batch(self, doc_id: pa.Array, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        """``(doc_id, n_a, n_b, n_groups, n_links, groups_sha256, pairs)`` of the texts."""
        n = len(doc_id)
        rows = np.flatnonzero(np.diff(offsets))
        spaced = np.insert(data, offsets[rows], 32)
        at = np.append(offsets[rows], offsets[-1]) + np.arange(len(rows) + 1)
        a, a_n, a_fine = self.a.encode(spaced, at)
        b, b_n, b_fine = self.b.encode(spaced, at)
        fine = a_fine & b_fine
        a, b = a[np.repeat(fine, a_n)], b[np.repeat(fine, b_n)]
        rows, a_n, b_n = rows[fine], a_n[fine], b_n[fine]
        # Both sides spell the same bytes and end together with every text, so no group leaves its text.
        found = aligned(np.cumsum(self.a_length[a]), np.cumsum(self.b_length[b]))
        told, ends = self.names.told(a, b, found)
        text_ends = np.cumsum(a_n)
        group_ends = np.searchsorted(found.a_ends, text_ends) + 1
        told_ends = ends[group_ends - 1]
        sums = [""] * n
        for row, i, j in zip(rows.tolist(), [0, *told_ends.tolist()], told_ends.tolist()):
            sums[row] = hashlib.sha256(told[i : j - 1]).hexdigest()
        text = np.searchsorted(text_ends, found.a_links, side="right")
        numbers = np.zeros((4, n), np.int64)
        numbers[:, rows] = a_n, b_n, np.diff(group_ends, prepend=0), np.bincount(text, minlength=len(rows))
        key = (rows[text] << (self.a_bits + self.b_bits)) | (a[found.a_links].astype(np.int64) << self.b_bits) | b[found.b_links]
        key, times = np.unique(key, return_counts=True)
        pair = (key >> self.b_bits & ((1 << self.a_bits) - 1)) << 32 | (key & ((1 << self.b_bits) - 1))
        bounds = np.searchsorted(key >> (self.a_bits + self.b_bits), np.arange(n + 1))
        linked = pa.StructArray.from_arrays([pa.array(pair), pa.array(times, pa.int64())], names=["pair", "n"])
        return pa.RecordBatch.from_arrays(
            [doc_id, *map(pa.array, numbers), pa.array(sums),
             pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), linked)],
            names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])


_aligners: dict[tuple[int, int], Aligner] = {}


def _aligner(key: tuple[int, int], definition: str, model: bytes) -> Aligner:
    if key not in _aligners:
        _aligners.clear()
        _aligners[key] = Aligner(definition, model)
    return _aligners[key]


_SCHEMA = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
           "pairs array<struct<pair:bigint,n:bigint>>")


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's alignment: tokens, groups, links, a checksum of the groups, and ``pairs``: each linked
    pair of ids, the first one's in the upper 32 bits, with how often the row links it.

    ``a_path`` is a byte-level tokenizer's file, given a space and the text; ``b_path`` a sentence-piece
    model's, given the text, to which it adds a space. Both are read by the driver and sent with the
    tasks. Rows whose text is null or empty, or is not what the tokens of either side spell (the
    second tokenizer reads U+2581 as a space), have zeros, no pairs and an empty checksum.
    """
    context = docs.sparkSession.sparkContext
    with open(a_path, encoding="utf-8") as a_file, open(b_path, "rb") as b_file:
        definition, model = context.broadcast(a_file.read()), context.broadcast(b_file.read())
    key = zlib.crc32(definition.value.encode()), zlib.crc32(model.value)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(key, definition.value, model.value)
        data, offsets = textscan.texts(batch.column(1))
        for i, j in textscan.runs(offsets, RUN_BYTES):
            yield aligner.batch(
                batch.column(0).slice(i, j - i), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])

    return by_batch(id_and_text(docs, id_col, text_col), each, _SCHEMA)


def pair_counts(aligned: DataFrame) -> DataFrame:
    """``(pair, count, best)``: links of every pair over all rows, and whether no other pair of the same
    second id has more. The highest counts are one row per id of the second vocabulary."""
    counts = materialize(
        aligned.select(F.inline("pairs")).groupBy("pair").agg(F.sum("n").alias("count")), "pair-counts")
    second = F.col("pair").bitwiseAND(F.lit(_LOW))
    top = counts.groupBy(second.alias("second")).agg(F.max("count").alias("top"))
    met = counts.join(F.broadcast(top), second == F.col("second"))
    return materialize(met.select("pair", "count", (F.col("count") == F.col("top")).alias("best")), "pairs")


def _step(count: Column) -> Column:
    return F.floor(F.log2(count.cast("double")) * _STEPS).cast("int")


def score(aligned: DataFrame, frequent: int = FREQUENT_PAIRS) -> DataFrame:
    """Rows of a written :func:`align` with ``n_best`` (their links whose pair is best) and ``count_sum``.

    Most links are of few pairs. As many of the most frequent pairs as ``frequent`` allows are
    broadcast and met where the links are; only links of rarer pairs are shuffled to the counts, and
    of those no pair is frequent. What is broadcast never grows beyond ``frequent`` rows.
    """
    rows = materialize(aligned.withColumn("place", F.monotonically_increasing_id()), "aligned")
    pairs = pair_counts(rows)
    steps = pairs.groupBy(_step(F.col("count")).alias("step")).agg(F.count("*").alias("n")).collect()
    level, left = 1 << 30, frequent
    for row in sorted(steps, reverse=True):
        left -= row["n"]
        if left < 0:
            break
        level = row["step"]
    links = rows.select("place", F.inline("pairs"))
    often, seldom = pairs.where(_step(F.col("count")) >= level), pairs.where(_step(F.col("count")) < level)

    def sums(met: DataFrame) -> DataFrame:
        best = F.when(F.col("best"), F.col("n")).otherwise(0)
        return met.groupBy("place").agg(F.sum(best).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))

    found = sums(links.join(F.broadcast(often), "pair"))
    if left < 0:
        rare = links.join(F.broadcast(often.select("pair")), "pair", "left_anti").join(seldom, "pair")
        found = found.unionByName(sums(rare)).groupBy("place").agg(
            F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.drop("pairs").join(found, "place", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def op12_token_alignment(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """Alignment digest of every row; rows that repeat an id are rows of their own, an empty table has
    none, other columns are not read."""
    return score(align(docs, a_path, b_path))
