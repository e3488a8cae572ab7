"""Text quality: gradient-boosted trees over histograms of document statistics."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm import textscan
from nearfield.llm.common import by_batch, id_and_text, materialize
from nearfield.session import ship_package

# The fit uses at most this many labelled rows, the first by the md5 of their id.
MAX_TRAINING_ROWS = 20_000
HELD_OUT = 1  # remainder of crc32(id) by 3 whose labels are never learned from

_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r",
            ".", ",", "'\"-", ";:!?", "()[]{}<>", "|", "#$%&*@^~+=_/\\`")
_CLASS = np.full(256, 13, dtype=np.int64)  # everything else, control characters
_CLASS[128:] = 12
for _i, _members in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _members]] = _i
N_CLASSES = 14
NAMES = (
    *(f"share_{i}" for i in range(N_CLASSES)), "log_bytes", "log_words", "log_lines", "word_length",
    "word_spread", "long_words", "plain_words", "words_per_line", "distinct_words", "top_word",
    "distinct_pairs", "distinct_lines", "short_words", "doubled_words", "words_per_stop",
)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring bounds (0 where these are equal)."""
    return np.diff(np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))[bounds])


def _distinct(keys: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Per group, how many distinct keys there are and how often the commonest one occurs."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    both = textscan.mix(keys + group.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first, counts = np.unique(both, return_index=True, return_counts=True)
    top = np.zeros(n)
    np.maximum.at(top, group[first], counts)
    return np.bincount(group[first], minlength=n).astype(np.float64), top


_LINE = ~textscan.byte_set("\n\r")


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` per text, from the whole of it; an empty text has zeros."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    of = np.repeat(np.arange(n), np.diff(offsets))
    shares = np.bincount(of * N_CLASSES + _CLASS[data], minlength=n * N_CLASSES).reshape(n, N_CLASSES)
    one = np.maximum(size, 1)

    starts, ends = textscan.spans(data, offsets, ~textscan.SPACE)
    bounds = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(n), np.diff(bounds))
    words = np.diff(bounds).astype(np.float64)
    some = np.maximum(words, 1)
    length = (ends - starts).astype(np.float64)
    mean = _sums(length, bounds) / some
    letters = np.concatenate(([0], np.cumsum((_CLASS[data] < 2) | (data >= 128))))
    plain = letters[ends] - letters[starts] >= length - 1
    lowered = textscan.LOWER[data]
    word = textscan.hashes(lowered, starts, ends)
    distinct, top = _distinct(word, doc, n)
    same_text = np.concatenate((doc[1:] == doc[:-1], [False])) if len(doc) else np.empty(0, bool)
    following = np.concatenate((word[1:], word[:1]))
    pair = (word * np.uint64(3) + following)[same_text]
    pairs, _ = _distinct(pair, doc[same_text], n)
    doubled = np.bincount(doc[same_text & (word == following)], minlength=n)
    ends_sentence = np.isin(data[np.maximum(ends - 1, 0)], np.frombuffer(b".!?", np.uint8)) if len(ends) else ends

    line_starts, line_ends = textscan.spans(data, offsets, _LINE)
    line_bounds = np.searchsorted(line_starts, offsets)
    lines = np.diff(line_bounds).astype(np.float64)
    line_doc = np.repeat(np.arange(n), np.diff(line_bounds))
    own_lines, _ = _distinct(textscan.hashes(lowered, line_starts, line_ends), line_doc, n)

    rest = [
        np.log1p(size), np.log1p(words), np.log1p(lines), mean,
        np.sqrt(np.maximum(_sums(length**2, bounds) / some - mean**2, 0)),
        _sums(length > 20, bounds) / some, _sums(plain, bounds) / some, words / np.maximum(lines, 1),
        distinct / some, top / some, pairs / np.maximum(words - 1, 1), own_lines / np.maximum(lines, 1),
        _sums(length <= 3, bounds) / some, doubled / some,
        words / (1 + _sums(ends_sentence, bounds)),
    ]
    return np.column_stack((shares / one[:, None], *rest)).astype(np.float32)


def _batch_statistics(column: pa.Array) -> np.ndarray:
    data, offsets = textscan.texts(column)
    parts = [
        statistics(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for i, j in textscan.runs(offsets)
    ]
    return np.concatenate(parts) if parts else np.empty((0, len(NAMES)), np.float32)


@dataclass(frozen=True)
class Trees:
    """Full binary trees of one depth, flattened: children of node i are 2i+1 and 2i+2."""

    base: float
    feature: np.ndarray  # trees x inner nodes
    bound: np.ndarray
    leaf: np.ndarray  # trees x leaves

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for every row."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        depth = self.leaf.shape[1].bit_length() - 1
        for feature, bound, leaf in zip(self.feature, self.bound, self.leaf):
            node = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > bound[node])
            total += leaf[node - len(bound)]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.2,
        bins: int = 32, ridge: float = 1.0, least_rows: int = 10) -> Trees:
    """Boost logistic-loss trees, splitting on histograms of quantile bins."""
    inner, leaves = (1 << depth) - 1, 1 << depth
    mean = min(max(float(y.mean()), 1e-6), 1 - 1e-6) if len(y) else 0.5
    base = float(np.log(mean / (1 - mean)))
    if len(y) == 0 or y.min() == y.max():
        return Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner), np.float32), np.zeros((0, leaves)))
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    places = binned + np.arange(width) * bins
    score = np.full(n, base)
    features, bounds, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, curve = y - p, p * (1 - p)
        feature, cut = np.zeros(inner, np.int64), np.full(inner, bins, np.int64)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            at = ((node - first)[:, None] * (width * bins) + places).ravel()
            shape = (many, width, bins)
            total = many * width * bins
            g, h, c = (
                np.bincount(at, weights=w, minlength=total).reshape(shape).cumsum(axis=2)
                for w in (np.repeat(grad, width), np.repeat(curve, width), np.ones(n * width)))
            all_g, all_h, all_c = g[:, :, -1:], h[:, :, -1:], c[:, :, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain[(c < least_rows) | (all_c - c < least_rows)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            worth = gain.reshape(many, -1)[np.arange(many), best] > 1e-9
            feature[first : first + many] = np.where(worth, best // bins, 0)
            cut[first : first + many] = np.where(worth, best % bins, bins)
            node = 2 * node + 1 + (binned[np.arange(n), feature[node]] > cut[node])
        leaf_of = node - inner
        leaf = rate * np.bincount(leaf_of, weights=grad, minlength=leaves) / (
            np.bincount(leaf_of, weights=curve, minlength=leaves) + ridge)
        score += leaf[leaf_of]
        bound = np.array([edges[f][c] if c < len(edges[f]) else np.inf for f, c in zip(feature, cut)], np.float32)
        features.append(feature), bounds.append(bound), values.append(leaf)
    return Trees(base, np.stack(features), np.stack(bounds), np.stack(values))


def _held_out(id_value):
    return F.coalesce(F.pmod(F.crc32(id_value.cast("string").cast("binary")), F.lit(3)) == HELD_OUT, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality",
          max_rows: int = MAX_TRAINING_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Trees:
    """Fit on the labelled documents that are not held out, at most ``max_rows`` of them.

    Labels that are null or neither 0 nor 1 are left out; of an id that is labelled more than once
    the greatest label counts. The chosen ids (bounded, so they are broadcast) find their texts in
    place, statistics are taken on the executors, and only these reach the driver.
    """
    ids = labels[id_col].cast("long")
    known = labels.select(ids.alias("id"), labels[label_col].cast("int").alias("label")).filter(
        F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~_held_out(F.col("id")))
    chosen = known.groupBy("id").agg(F.max("label").alias("label")).orderBy(
        F.md5(F.col("id").cast("string")), "id").limit(max_rows)
    chosen = materialize(chosen, "training-ids")
    text = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    # documents may repeat an id; the bound holds for what reaches the driver, too
    place = F.md5(F.concat_ws(":", "doc_id", F.xxhash64("text")))
    text = text.select(place.alias("place"), "label", "text")

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = _batch_statistics(batch.column(2))
        values = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(NAMES)).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], names=["place", "label", "x"])

    rows = by_batch(text, each, "place string, label int, x array<float>")
    found = rows.orderBy("place").limit(max_rows).toArrow()
    x = np.array(found.column("x").to_pylist(), dtype=np.float32).reshape(-1, len(NAMES))
    return fit(x, found.column("label").to_numpy().astype(np.float64))


def classify(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, score)`` of every row, from the whole text and nothing else.

    A null text is empty; its score is that of a text whose statistics are all zero. Rows without
    an id, and rows that repeat one, are scored like any others.
    """
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    def each(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        score = sent.value.score(_batch_statistics(batch.column(1)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], names=["doc_id", "score"])

    return by_batch(id_and_text(docs, id_col, text_col), each, "doc_id long, score double")


def keep_good(docs: DataFrame, trees: Trees, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with their own columns, in one pass."""
    sent = docs.sparkSession.sparkContext.broadcast(trees)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(sent.value.score(_batch_statistics(text)))

    ship_package(docs.sparkSession)
    return docs.filter(score(F.coalesce(docs[text_col], F.lit(""))) >= least)


def op1_quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = classify(docs, train(docs, labels))
    return scored.select(
        "doc_id", _held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
