"""Find benchmark items in training text: n-gram seeds, then Smith-Waterman alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm import textscan
from nearfield.llm.common import by_batch, id_and_text, materialize

GRAM = 4  # words of a seed: an edited copy that keeps one run of four words is still met
MATCH, MISMATCH, GAP = 2, -1, -1
LEAST = 0.6  # of the score of an unchanged copy of the whole item
# Grams of items that every task holds at once, and places of items looked at in one go.
SEED_LIMIT = 2_000_000
_PORTION = 1 << 20
_ALIGN_CELLS = 1 << 21
_PAIRS = "doc_id long, item_id long, score double, first_word long, last_word long"


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, and where each text's words begin."""
    starts, ends = textscan.spans(data, offsets, textscan.WORD)
    return textscan.hashes(textscan.LOWER[data], starts, ends), np.searchsorted(starts, offsets)


def items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", gram: int = GRAM) -> DataFrame:
    """``(item_id, words, grams)`` as hashes of every benchmark item of at least ``gram`` words.

    A shorter one cannot be told from ordinary prose and is left out.
    """

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = textscan.texts(batch.column(1))
        word, bounds = words(data, offsets)
        own = [word[i:j] for i, j in zip(bounds, bounds[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([w.view(np.int64) for w in own], pa.list_(pa.int64())),
             pa.array([textscan.grams(w, gram).view(np.int64) for w in own], pa.list_(pa.int64()))],
            names=["item_id", "words", "grams"])

    text = benchmark.select(benchmark[id_col].cast("long").alias("item_id"),
                            F.coalesce(benchmark[text_col], F.lit("")).alias("text"))
    return by_batch(text, each, "item_id long, words array<long>, grams array<long>").filter("size(grams) > 0")


def _ramps(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers from every ``first`` on, ``size`` of each."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + size, size)


class Seeds:
    """The grams of some items, sorted, each with the items that hold it, and a table that answers most
    lookups by a few bits of the hash."""

    def __init__(self, number: list[int | None], words: list[np.ndarray], grams: list[np.ndarray]):
        self.number, self.words = number, words
        self.sorted_words = [np.unique(w) for w in words]
        # An alignment of the least score has fewer than two item lengths of words after any of its seeds.
        self.reach = np.array([2 * len(w) for w in words], np.int64)
        gram, item = np.concatenate(grams), np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        order = np.lexsort((item, gram))
        gram, item = gram[order], item[order]
        new = np.append(True, (gram[1:] != gram[:-1]) | (item[1:] != item[:-1]))
        self.items = item[new]
        self.seeds, self.first, self.count = np.unique(gram[new], return_index=True, return_counts=True)
        bits = max(int(len(self.seeds) * 16).bit_length(), 10)
        self.mask = np.uint64((1 << bits) - 1)
        self.table = np.zeros(1 << bits, dtype=bool)
        self.table[self.seeds & self.mask] = True

    def places(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where ``gram`` has a seed, and which."""
        at = np.flatnonzero(self.table[gram & self.mask])
        found = np.minimum(np.searchsorted(self.seeds, gram[at]), len(self.seeds) - 1)
        same = self.seeds[found] == gram[at]
        return at[same], found[same]

    def met(self, at: np.ndarray, seed: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """``(item, place)`` of every item of every seed found, sorted, in portions of whole items, so
        that little is held at once however many items share a frequent seed."""
        order = np.argsort(seed, kind="stable")
        at = at[order]
        known, first, often = np.unique(seed[order], return_index=True, return_counts=True)
        which = np.repeat(np.arange(len(known)), self.count[known])
        item = self.items[_ramps(self.first[known], self.count[known])]
        order = np.argsort(item, kind="stable")
        item, which = item[order], which[order]
        ends = np.append(np.flatnonzero(item[1:] != item[:-1]) + 1, len(item))
        total = np.cumsum(often[which])[ends - 1]
        done = 0  # items
        while done < len(ends):
            before = total[done - 1] if done else 0
            last = max(int(np.searchsorted(total, before + _PORTION, side="right")), done + 1)
            part = slice(ends[done - 1] if done else 0, ends[last - 1])
            place = at[_ramps(first[which[part]], often[which[part]])]
            of = np.repeat(item[part], often[which[part]])
            order = np.lexsort((place, of))
            yield of[order], place[order]
            done = last


def align(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment of two word sequences: score, and its first and last place (exclusive)
    in the passage. A passage that is long for one go is cut into overlapping parts. Only one row of
    the table is held at a time; the begin is found by going back from the end of the best."""
    part = max(_ALIGN_CELLS // max(len(item), 1), 4 * len(item))
    best = (0, 0, 0)
    for at in range(0, len(passage), part):
        begin = max(at - 2 * len(item), 0)
        score, i, j = _peak(item, passage[begin : at + part], local=True)
        if score > best[0]:
            best = (score, i, begin + j)
    score, i, end = best
    if not score:
        return 0, 0, 0
    # what lies more than three item lengths before the end costs more than all words of the item give
    before = passage[max(end - 3 * len(item), 0) : end]
    return score, end - _peak(item[:i][::-1], before[::-1], local=False)[2], end


def _peak(item: np.ndarray, passage: np.ndarray, local: bool) -> tuple[int, int, int]:
    """The highest score of an alignment, and how many words of both it ends after (the fewest). It may
    begin anywhere if ``local``, else with the first words. One vector step per word of the item; gaps
    along the passage by a running maximum."""
    slope = np.arange(len(passage) + 1) * -GAP
    row = np.zeros(len(passage) + 1, np.int64) if local else -slope
    best = (0, 0, 0)
    for i, word in enumerate(item, 1):
        above, row = row, row + GAP
        row[1:] = np.maximum(row[1:], above[:-1] + np.where(passage == word, MATCH, MISMATCH))
        if local:
            np.maximum(row, 0, out=row)
        row = np.maximum.accumulate(row + slope) - slope
        j = int(row.argmax())
        if row[j] > best[0]:
            best = (int(row[j]), i, j)
    return best


def _may_align(known: np.ndarray, passage: np.ndarray, length: int, least: float) -> bool:
    """Whether a passage can hold an alignment of the least score with an item of ``length`` words, of
    which ``known`` are the distinct ones. Such an alignment matches ``least`` of the words and has at
    most ``2 * (1 - least)`` item lengths of gaps, so that many matches must stand in such a stretch."""
    found = np.minimum(np.searchsorted(known, passage), len(known) - 1)
    same = np.concatenate(([0], np.cumsum(known[found] == passage)))
    stretch = min(int(length * (1 + MATCH * (1 - least))) + 1, len(passage))
    return int((same[stretch:] - same[: len(same) - stretch]).max()) >= least * length - 1e-9


def _found(docs: DataFrame, seeds: Seeds, gram: int, least: float) -> DataFrame:
    """The alignments of the items of ``seeds`` with the documents, found in the tasks that read them.

    Every item that shares a gram with a document is aligned with the passages around these grams
    (two lengths of the item to both sides; what meets is one passage), however frequent the grams are.
    """
    sent = docs.sparkSession.sparkContext.broadcast(seeds)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        data, offsets = textscan.texts(batch.column(1))
        own = sent.value
        docs, rows = [], []
        for i, j in textscan.runs(offsets):
            word, bounds = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            every = textscan.grams(word, gram)
            at, seed = own.places(every) if len(every) else (np.empty(0, np.int64),) * 2
            inside = at + gram <= bounds[np.searchsorted(bounds, at, side="right")]
            at, seed = at[inside], seed[inside]
            for item, place in own.met(at, seed) if len(at) else ():
                doc = np.searchsorted(bounds, place, side="right") - 1
                new = (item[1:] != item[:-1]) | (doc[1:] != doc[:-1]) | (place[1:] - place[:-1] > 2 * own.reach[item[1:]])
                first = np.flatnonzero(np.append(True, new))
                last = np.append(first[1:], len(place)) - 1
                reach = own.reach[item[first]]
                begin = np.maximum(place[first] - reach, bounds[doc[first]])
                end = np.minimum(place[last] + gram + reach, bounds[doc[first] + 1])
                for k, d, a, b in zip(item[first].tolist(), doc[first].tolist(), begin.tolist(), end.tolist()):
                    whole, passage = own.words[k], word[a:b]
                    if not _may_align(own.sorted_words[k], passage, len(whole), least):
                        continue
                    score, start, stop = align(whole, passage)
                    if score >= least * MATCH * len(whole):
                        shift = a - int(bounds[d])
                        docs.append(d + i)
                        rows.append((own.number[k], score / (MATCH * len(whole)), shift + start, shift + stop))
        columns = list(zip(*rows)) if rows else [[]] * 4
        kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(docs, pa.int64())), *[pa.array(c, t) for c, t in zip(columns, kinds)]],
            names=["doc_id", "item_id", "score", "first_word", "last_word"])

    return by_batch(docs, each, _PAIRS)


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = LEAST, gram: int = GRAM,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, item_id, score, first_word, last_word)``: benchmark items found in documents.

    Every n-gram of words of every document is compared with those of the items. An item is aligned
    with the passages around all grams that it shares with a document, frequent ones too; only where
    too few of its words stand together for the least score is the alignment spared. ``score`` is the
    best local alignment over that of an unchanged copy, and pairs of at least ``least`` are returned,
    the best place of each, with word positions from 0 (the last exclusive). What is found of an item
    depends on that item and the document only. Null texts are empty and
    hold nothing; empty items and items without an id are left out; rows without an id are searched
    too and returned with a null id; rows that repeat an id count as one document; other columns are
    not read.

    Documents are read once and never shuffled. Items grow with the benchmark, not with the corpus:
    they are held whole by every task up to ``SEED_LIMIT`` grams; beyond it items are taken in parts of
    that size, each with a reading of the documents.
    """
    spark = docs.sparkSession
    item = materialize(items(benchmark, gram=gram).filter("item_id IS NOT NULL"), "items")
    total = item.agg(F.sum(F.size("grams"))).first()[0]
    if total is None:
        return spark.createDataFrame([], _PAIRS)
    parts = total // SEED_LIMIT + 1
    text = id_and_text(docs, id_col, text_col)
    found = []
    for part in range(parts):
        chosen = item.filter(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).toArrow()
        if not len(chosen):
            continue
        lists = [[x.values.to_numpy().view(np.uint64) for x in chosen[c]] for c in ("words", "grams")]
        seeds = Seeds(chosen["item_id"].to_pylist(), *lists)
        found.append(materialize(_found(text, seeds, gram, least), "alignments"))
    aligned = found[0]
    for more in found[1:]:
        aligned = aligned.unionByName(more)
    best = F.max_by(F.struct("score", "first_word", "last_word"),
                    F.struct("score", (-F.col("first_word")).alias("earlier"), "last_word"))
    return aligned.groupBy("doc_id", "item_id").agg(best.alias("best")).select("doc_id", "item_id", "best.*")


def keep_clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no benchmark item is found, with their own columns.

    Rows are told apart by id and text, so neither a missing nor a repeated id drops a clean row.
    """
    row = F.xxhash64(docs[id_col].cast("long"), F.coalesce(docs[text_col], F.lit("")))
    keyed = docs.select(row.alias("row"), docs[text_col].alias("text"))
    found = contaminated(keyed, benchmark, id_col="row", text_col="text")
    leaks = materialize(found.select(F.col("doc_id").alias("__leak")).distinct(), "leaks")
    return docs.join(leaks, row == F.col("__leak"), "left_anti")


def op3_benchmark_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contaminated(docs, benchmark)
