"""Token ids in Parquet list columns."""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nearfield.llm import textscan
from nearfield.llm.common import by_batch, id_and_text
from nearfield.session import scratch_path

END_ID = 2
RUN_BYTES = 4 << 20
# Words that make a generation of a worker's cache; two generations are kept.
CACHE_ENTRIES = 200_000

# First bytes of characters that are never white space.
_SOLID = textscan.byte_set(range(0x21, 0x7F), range(0xC3, 0xE0), range(0xE4, 0xEA))

# Kinds of bytes in plain pieces: ASCII letters and all bytes of U+00C0 to U+017F but the signs for
# times and division are letters; digits; other printable ASCII. Everything else, and the apostrophe,
# which may begin a word of its own, makes a piece odd, but for single line breaks between plain bytes.
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[33:127] = 3
_KIND[[*range(65, 91), *range(97, 123), *range(128, 192), 0xC3, 0xC4, 0xC5]] = 1
_KIND[48:58] = 2
_KIND[ord("'")] = 0


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: b for b in plain} | {b: 256 + i for i, b in enumerate(rest)}


_BYTE_LETTERS = _byte_letters()
_LETTERS_BUT_NUL = {byte: letter for byte, letter in _BYTE_LETTERS.items() if byte}


@dataclass(frozen=True)
class Layout:
    """How the ids are laid out in the files.

    Row groups and pages are kept small enough that, with the column and page indexes which the
    writer adds, a reader of a few documents fetches a few pages, and a reader of ``doc_id`` and
    ``n_tokens`` fetches no ids. Ids repeat, so they are dictionary-encoded by default; ascending
    document ids are delta-encoded.
    """

    encoding: str = "dictionary"  # of the ids: or "delta"
    row_group_bytes: int = 32 << 20
    page_bytes: int = 256 << 10
    page_rows: int = 2000
    compression: str = "zstd"

    def options(self) -> dict[str, str]:
        if self.encoding not in ("dictionary", "delta"):
            raise ValueError(f"no such encoding: {self.encoding}")
        return {
            "compression": self.compression, "parquet.writer.version": "v2",
            "parquet.block.size": str(self.row_group_bytes), "parquet.page.size": str(self.page_bytes),
            "parquet.page.row.count.limit": str(self.page_rows), "parquet.enable.dictionary": "false",
            "parquet.enable.dictionary#ids.list.element": str(self.encoding == "dictionary").lower(),
        }


class Recent:
    """Values of keys met lately: two generations, of which a full one replaces the older."""

    def __init__(self, entries: int):
        self.entries = entries
        self.new: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def of(self, keys: list[bytes], make: Callable[[list[bytes]], list[bytes]]) -> list[bytes]:
        """The values of distinct keys; ``make`` is asked for those that are not held."""
        if len(self.new) > self.entries:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        found = [new.get(k) or old.get(k) for k in keys]
        missing = [i for i, v in enumerate(found) if v is None]
        if missing:
            for i, v in zip(missing, make([keys[i] for i in missing])):
                found[i] = v
        new.update(zip(keys, found))
        return found


class Encoder:
    """Encodes whole batches of texts, each distinct word of a batch once.

    A byte-level tokenizer without normalizer never joins what stands before a space and a solid
    character with what follows. Texts are cut there into pieces, and plain pieces further where
    letters, digits and signs meet, which is where the pre-tokenizer cuts them. Equal parts are found
    by their bytes; only new ones go through the model, odd pieces through the pre-tokenizer first. Other
    tokenizers, and texts that hold an added token, are encoded whole; with ``plain`` the strings of added
    tokens are text like any other.
    """

    def __init__(self, definition: str, plain: bool = False):
        from tokenizers import Tokenizer

        told = json.loads(definition)
        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = plain
        self.added = [] if plain else [t["content"].encode() for t in told.get("added_tokens", [])]
        before = told.get("pre_tokenizer") or {}
        self.cuts = (
            before.get("type") == "ByteLevel" and before.get("use_regex", True)
            and not before.get("add_prefix_space") and told.get("normalizer") is None
            and told.get("post_processor") is None and told.get("model", {}).get("type") == "BPE"
            and told.get("truncation") is None and told.get("padding") is None
        )
        self.model, self.splitter = self.tokenizer.model, self.tokenizer.pre_tokenizer
        # ids as the bytes of 32-bit numbers, of words and of odd pieces
        self.words, self.pieces = Recent(CACHE_ENTRIES), Recent(CACHE_ENTRIES // 4)

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id."""
        letters = {chr(letter): byte for byte, letter in _BYTE_LETTERS.items()}
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        out = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            out[i] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()
        return out

    def _whole(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode(), add_special_tokens=False).ids

    def _words(self, words: list[bytes]) -> list[bytes]:
        spelt = b"\0".join(words).decode("latin-1").translate(_LETTERS_BUT_NUL).split("\0")
        tokenize = self.model.tokenize
        return [array("i", [t.id for t in tokenize(word)]).tobytes() for word in spelt]

    def _pieces(self, pieces: list[bytes]) -> list[bytes]:
        tokenize, split = self.model.tokenize, self.splitter.pre_tokenize_str
        return [array("i", [t.id for word, _ in split(p.decode()) for t in tokenize(word)]).tobytes() for p in pieces]

    @staticmethod
    def _cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of words and odd pieces, and which are odd."""
        begins = np.zeros(len(data) + 1, dtype=bool)
        begins[: len(data)][:-1] = (data[:-1] == 32) & _SOLID[data[1:]]
        begins[offsets[:-1]] = True
        begins = begins[: len(data)]
        starts = np.flatnonzero(begins)
        if not len(starts):
            return starts, starts.astype(bool)
        kind = _KIND[data]
        breaks = np.flatnonzero(data[1:-1] == 10) + 1
        breaks = breaks[(kind[breaks - 1] > 0) & _SOLID[data[breaks + 1]] & ~begins[breaks] & ~begins[breaks + 1]]
        kind[breaks] = 4  # a word of its own
        odd = kind == 0
        odd[1:] |= (data[:-1] == 0xC3) & ((data[1:] == 0x97) | (data[1:] == 0xB7))
        odd[starts[data[starts] == 32]] = False  # the space that a word begins with
        odd_piece = np.add.reduceat(odd, starts, dtype=np.int64) > 0
        lead = starts[:-1][data[starts[:-1]] == 32] if len(data) == starts[-1] + 1 else starts[data[starts] == 32]
        kind[lead] = kind[lead + 1]
        inside = np.repeat(~odd_piece, np.diff(np.append(starts, len(data))))
        begins[1:] |= (kind[1:] != kind[:-1]) & inside[1:]
        words = np.flatnonzero(begins)
        return words, odd_piece[np.searchsorted(starts, words, side="right") - 1]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and how many each text has."""
        raw = data.tobytes()
        if not self.cuts or any(t in raw for t in self.added):
            found = [self._whole(raw[i:j]) for i, j in zip(offsets[:-1], offsets[1:])]
            counts = np.array([len(x) for x in found], dtype=np.int64)
            return np.fromiter(chain.from_iterable(found), np.int32, int(counts.sum())), counts
        starts, odd = self._cut(data, offsets)
        codes, parts = textscan.distinct(data, np.append(starts, len(data)) if len(starts) else np.zeros(1, np.int64))
        is_odd = np.zeros(len(parts), dtype=bool)
        is_odd[codes] = odd  # equal parts are all odd or all plain
        plain, rest = np.flatnonzero(~is_odd).tolist(), np.flatnonzero(is_odd).tolist()
        held = [b""] * len(parts)
        for some, cache, make in ((plain, self.words, self._words), (rest, self.pieces, self._pieces)):
            for i, ids in zip(some, cache.of([parts[i] for i in some], make)):
                held[i] = ids
        ids, done = textscan.spread(held, codes)
        bounds = done[np.searchsorted(starts, offsets)]
        return ids, np.diff(bounds)


_encoders: dict[int, Encoder] = {}


def _encoder(key: int, definition: str) -> Encoder:
    """One encoder, with what it remembers, for all tasks of a worker."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(definition)
    return _encoders[key]


def encode(docs: DataFrame, tokenizer: str, end_id: int | None = END_ID, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids)`` of every row: the ids of the whole text, then ``end_id``.

    ``tokenizer`` is the path of a tokenizer file, read by the driver and sent with the tasks.
    A null text is empty and has the end id only; rows that repeat an id are separate rows.
    """
    with open(tokenizer, encoding="utf-8") as file:
        definition = docs.sparkSession.sparkContext.broadcast(file.read())
    key = zlib.crc32(definition.value.encode())
    tail = [] if end_id is None else [end_id]

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        coder = _encoder(key, definition.value)
        data, offsets = textscan.texts(batch.column(1))
        for i, j in textscan.runs(offsets, RUN_BYTES):
            at = offsets[i : j + 1] - offsets[i]
            ids, counts = coder.encode(data[offsets[i] : offsets[j]], at)
            if tail:
                ids = np.insert(ids, np.cumsum(counts), tail[0])
                counts = counts + 1
            ends = np.concatenate(([0], np.cumsum(counts)))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), pa.array(counts), lists], names=["doc_id", "n_tokens", "ids"])

    return by_batch(id_and_text(docs, id_col, text_col), each, "doc_id long, n_tokens long, ids array<int>")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = END_ID,
          layout: Layout = Layout(), id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode ``docs`` and write ``(doc_id, n_tokens, ids)`` in ascending order of the id.

    Texts are dealt into ranges of ids and sorted there, rows without an id last and rows of one
    id by the hash of their text, and encoded on the way to the files, so ids are never shuffled.
    File names follow the ranges. A single text's ids must fit in one list (2**31 - 1).
    """
    text = id_and_text(docs, id_col, text_col)
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    ranged = text.repartitionByRange(*order).sortWithinPartitions(*order)
    encode(ranged, tokenizer, end_id).write.options(**layout.options()).parquet(path)


def read(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """Documents of the written files; a range of ids is pushed to row groups and pages."""
    found = spark.read.schema("doc_id long, n_tokens long, ids array<int>").parquet(path)
    if first is not None:
        found = found.filter(F.col("doc_id") >= first)
    if last is not None:
        found = found.filter(F.col("doc_id") <= last)
    return found


def starts(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, file, row, start, n_tokens)``: place of every document in the stream of all ids.

    Reads no ids. Files are in the order of their names; a running sum within each file is moved by
    the total of the files before it (one row per file).
    """
    name, row = F.col("_metadata.file_name"), F.col("_metadata.row_index")
    rows = read(spark, path).select("doc_id", "n_tokens", name.alias("file"), row.alias("row"))
    totals = rows.groupBy("file").agg(F.sum("n_tokens").alias("total"))
    by_name = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    moved = totals.select("file", F.coalesce(F.sum("total").over(by_name), F.lit(0)).alias("moved"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))
    return rows.withColumn("before", before).join(moved, "file").select(
        "doc_id", "file", "row", (F.col("before") + F.col("moved")).alias("start"), "n_tokens")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``(file, row, ids_crc32)`` from the ids themselves, as little-endian unsigned 32-bit numbers."""
    rows = read(spark, path).select(
        F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), "ids")

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lists = batch.column(2)
        at = lists.offsets.to_numpy().tolist()
        raw = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")
        sums = [zlib.crc32(raw[i:j]) for i, j in zip(at, at[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(sums, pa.int64())], names=["file", "row", "ids_crc32"])

    return by_batch(rows, each, "file string, row long, ids_crc32 long")


def op5_token_lists(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the documents' ids, read them back, and give each document's place and checksum."""
    spark = docs.sparkSession
    path = scratch_path(spark, "tokens")
    write(docs, path, tokenizer)
    return starts(spark, path).join(checksums(spark, path), ["file", "row"]).select(
        "doc_id", "start", "n_tokens", "ids_crc32")
