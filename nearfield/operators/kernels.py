"""Numpy helpers that run inside Spark tasks on one block of vectors at a time."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

EUCLIDEAN = "euclidean"
COSINE = "cosine"

# Matrix products are taken in single precision while squares stay well inside its range.
_SINGLE_RANGE = (1e-25, 1e30)
# Cells of a query x base distance matrix held at once, base rows of one, and pairs rescored at once.
_MATRIX_CELLS = 1_000_000
_PIECE = 2_048
_PAIR_VALUES = 4_000_000


def as_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column, or binary column of u8 codes, as an (n, d) float64 matrix.

    Refuses nulls and ragged rows. Rows with a value that is not finite are the caller's to drop
    (:func:`finite_rows`): they have no distance to anything.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros((0, 0))
    if column.null_count:
        raise ValueError("null vector")
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        _, offsets, data = column.cast(pa.large_binary()).buffers()
        at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
        if (np.diff(at) != at[1] - at[0]).any():
            raise ValueError("vectors differ in dimension")
        raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
        return raw.astype(np.float64).reshape(n, -1)
    values = column.flatten()
    dim, ragged = divmod(len(values), n)
    lengths = column.value_lengths()
    if ragged or not (lengths.to_numpy() == dim).all():
        raise ValueError("vectors differ in dimension")
    if values.null_count:
        raise ValueError("null inside a vector")
    return values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(n, dim)


def as_list_column(matrix: np.ndarray, value_type: pa.DataType) -> pa.Array:
    n, dim = matrix.shape
    offsets = pa.array(np.arange(0, (n + 1) * dim, dim, dtype=np.int32)[: n + 1])
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel(), type=value_type))


def finite_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows without NaN and infinity."""
    return np.isfinite(matrix).all(axis=1)


def pair_scores(left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    """Exact double-precision distance (Euclidean) or similarity (cosine) of aligned rows."""
    if metric == EUCLIDEAN:
        diff = left - right
        return np.sqrt(np.einsum("ij,ij->i", diff, diff))
    dot = np.einsum("ij,ij->i", left, right)
    norms = np.sqrt(
        np.einsum("ij,ij->i", left, left) * np.einsum("ij,ij->i", right, right)
    )
    return np.divide(dot, norms, out=np.zeros_like(dot), where=norms > 0)


def sort_keys(scores: np.ndarray, metric: str) -> np.ndarray:
    """Ascending sort key: nearest first for both metrics."""
    return scores if metric == EUCLIDEAN else -scores


class VectorBlock:
    """Vectors with what the matrix form of the distance needs, computed once.

    ``query_form @ base_form.T`` is larger for nearer pairs: the cosine similarity, or half of
    ``|q|^2 - distance^2``. A form is made when it is asked for first, as a block is mostly on one side.
    """

    def __init__(self, matrix: np.ndarray, metric: str):
        self.matrix, self.metric = matrix, metric
        self.squares = np.einsum("ij,ij->i", matrix, matrix)
        low, high = _SINGLE_RANGE
        single = metric == COSINE or low < self.squares.max(initial=1.0) < high
        self.kind = np.float32 if single else np.float64
        self._forms: dict[str, np.ndarray] = {}

    def _form(self, side: str) -> np.ndarray:
        if self.metric == COSINE:
            side = "both"
        if side not in self._forms:
            if self.metric == COSINE:
                norms = np.sqrt(self.squares)[:, None]
                made = np.divide(self.matrix, norms, out=np.zeros_like(self.matrix), where=norms > 0).astype(self.kind)
            else:
                n, dim = self.matrix.shape
                made = np.empty((n, dim + 1), self.kind)
                made[:, :dim] = self.matrix
                made[:, dim] = -0.5 if side == "query" else self.squares
            self._forms[side] = made
        return self._forms[side]

    @property
    def query_form(self) -> np.ndarray:
        return self._form("query")

    @property
    def base_form(self) -> np.ndarray:
        return self._form("base")

    def take(self, rows) -> VectorBlock:
        """Some rows with the forms made so far; a slice is a view."""
        part = object.__new__(VectorBlock)
        part.kind, part.metric = self.kind, self.metric
        part.matrix, part.squares = self.matrix[rows], self.squares[rows]
        part._forms = {side: form[rows] for side, form in self._forms.items()}
        return part


def _slack(queries: VectorBlock, base: VectorBlock, scale: np.ndarray) -> np.ndarray:
    """How far a rough value can be from the true one: the rounding of the forms and of the sums."""
    unit = max(float(np.finfo(b.kind).eps) for b in (queries, base))
    return 4.0 * (base.matrix.shape[1] + 8) * unit * scale


def _rescore(queries, base, qi, bi, metric):
    step = max(1, _PAIR_VALUES // max(1, base.matrix.shape[1]))
    out = np.empty(len(qi))
    for at in range(0, len(qi), step):
        rows = slice(at, at + step)
        out[rows] = pair_scores(queries.matrix[qi[rows]], base.matrix[bi[rows]], metric)
    return sort_keys(out, metric)


def _places(keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of every true value; where few are, eight values are passed over at once."""
    width = keep.shape[1]
    if width % 8:
        flat = np.flatnonzero(keep)
    else:
        words = np.flatnonzero(keep.reshape(-1).view(np.uint64))
        at, inside = np.nonzero(keep.reshape(-1, 8)[words])
        flat = words[at] * 8 + inside
    return flat // width, flat % width


def _passing(qi: np.ndarray, bi: np.ndarray, span, marks) -> np.ndarray:
    """Pairs inside their query's span of places, and with a mark in common."""
    fine = np.ones(len(qi), bool)
    if span is not None:
        fine &= (bi >= span[0][qi]) & (bi < span[1][qi])
    if marks is not None:
        common = np.zeros(len(qi), bool)
        for word in range(marks[0].shape[1]):
            common |= (marks[0][qi, word] & marks[1][bi, word]) != 0
        fine &= common
    return fine


def _shut(rough: np.ndarray, span, marks) -> None:
    """Put pairs that do not pass behind all others."""
    if span is not None:
        place = np.arange(rough.shape[1], dtype=np.int32)
        low, high = (x.astype(np.int32)[:, None] for x in span)
        np.copyto(rough, -np.inf, where=(place < low) | (place >= high))
    if marks is not None:
        common = np.zeros(rough.shape, bool)
        for word in range(marks[0].shape[1]):
            common |= (marks[0][:, word, None] & marks[1][None, :, word]) != 0
        np.copyto(rough, -np.inf, where=~common)


def _nearest_chunk(queries, base, ids, k, metric, worst, span, marks, once, distinct):
    """The k best pairs of every query among these base rows, dropping what is worse than the
    sort key ``worst``: query row, place, sort key and id, query by query."""
    rough = queries.query_form @ base.base_form.T
    if metric == EUCLIDEAN:
        least = (queries.squares - worst * worst) / 2
        scale = queries.squares + base.squares.max()
    else:
        least = -worst
        scale = np.ones(len(rough))
    # Every true neighbour lies within rounding error of the k-th rough value, however many
    # rows tie there, so the exact ranking below sees all of them.
    slack = _slack(queries, base, scale)
    lowest = np.finfo(rough.dtype).min
    floor = np.maximum(least - slack, lowest)
    keep = rough >= _below(floor, rough.dtype)[:, None]
    if rough.shape[1] > k and np.count_nonzero(keep) > 2 * k * len(rough):
        _shut(rough, span, marks)
        if distinct:  # else one id may be many of the k
            kth = np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k]
            floor = np.maximum(floor, kth - slack)
        keep = rough >= _below(floor, rough.dtype)[:, None]
    qi, bi = _places(keep)
    if span is not None or marks is not None:
        fine = _passing(qi, bi, span, marks)
        qi, bi = qi[fine], bi[fine]
    keys = _rescore(queries, base, qi, bi, metric)
    found = ids[bi]
    order = np.lexsort((found, keys, qi))
    qi, keys, found = qi[order], keys[order], found[order]
    if once and len(qi):
        new = np.r_[True, (qi[1:] != qi[:-1]) | (found[1:] != found[:-1]) | (keys[1:] != keys[:-1])]
        qi, keys, found = qi[new], keys[new], found[new]
    first = np.searchsorted(qi, np.arange(len(rough)))
    place = np.arange(len(qi)) - first[qi]
    top = place < k
    return qi[top], place[top], keys[top], found[top]


def _below(floor: np.ndarray, kind) -> np.ndarray:
    """The values in this precision, rounded down, so that a comparison does not widen a matrix."""
    rounded = floor.astype(kind)
    above = rounded > floor
    rounded[above] = np.nextafter(rounded[above], kind.type(-np.inf))
    return rounded


class TopK:
    """The k nearest ids so far of every query row; blocks of base rows are merged in. With ``owner``,
    the vector of every query row, rows share vectors. With ``once`` a pair that comes again, or a base
    row that stands twice, counts once."""

    def __init__(self, queries: VectorBlock, k: int, metric: str, owner: np.ndarray | None = None, once: bool = False):
        self.queries, self.k, self.metric, self.once = queries, k, metric, once
        self.owner = np.arange(len(queries.matrix)) if owner is None else owner
        n = len(self.owner)
        self.keys = np.full((n, k), np.inf)
        self.ids = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)

    def add(self, rows: np.ndarray, base: VectorBlock, ids: np.ndarray, span=None, marks=None) -> None:
        """Merge base rows into the query rows ``rows``.

        ``span``, two arrays beside ``rows``, has the first place a query may meet and the one after its
        last; ``marks`` has bits per row of ``rows`` and of the base, of which a pair needs one in common.
        """
        if not len(ids) or not len(rows):
            return
        if base.matrix.shape[1] != self.queries.matrix.shape[1]:
            raise ValueError("vectors differ in dimension")
        self.queries.query_form, base.base_form  # made once, for all their parts
        for first in range(0, len(ids), _PIECE):
            own = slice(first, min(first + _PIECE, len(ids)))
            width = own.stop - first
            some, limits, bits = rows, None, None
            if span is not None:
                met = np.flatnonzero((span[0] < own.stop) & (span[1] > first))
                some, limits = rows[met], [np.clip(x[met] - first, 0, width) for x in span]
            if marks is not None:
                bits = (marks[0] if span is None else marks[0][met], marks[1][own])
            piece, held = base.take(own), ids[own]
            distinct = not self.once or len(np.unique(held)) == width
            step = max(1, _MATRIX_CELLS // width)
            for at in range(0, len(some), step):
                part = some[at : at + step]
                near = slice(at, at + step)
                qi, place, keys, found = _nearest_chunk(
                    self.queries.take(self.owner[part]), piece, held, self.k, self.metric,
                    self.keys[part, self.k - 1], limits and [x[near] for x in limits],
                    bits and (bits[0][near], bits[1]), self.once, distinct,
                )
                if len(qi):
                    self._merge(part, qi, place, keys, found)

    def _merge(self, part, qi, place, keys, found):
        first = np.flatnonzero(np.r_[True, qi[1:] != qi[:-1]])
        row = np.cumsum(np.r_[False, qi[1:] != qi[:-1]])
        part = part[qi[first]]
        wide = self.k + int(place.max()) + 1
        all_keys = np.full((len(part), wide), np.inf)
        all_ids = np.full((len(part), wide), np.iinfo(np.int64).max, dtype=np.int64)
        all_keys[:, : self.k], all_ids[:, : self.k] = self.keys[part], self.ids[part]
        all_keys[row, self.k + place] = keys
        all_ids[row, self.k + place] = found
        order = np.lexsort((all_ids, all_keys), axis=1)
        if self.once:
            all_keys, all_ids = (np.take_along_axis(x, order, axis=1) for x in (all_keys, all_ids))
            again = np.zeros(all_keys.shape, bool)
            again[:, 1:] = (all_keys[:, 1:] == all_keys[:, :-1]) & (all_ids[:, 1:] == all_ids[:, :-1])
            all_keys[again], all_ids[again] = np.inf, np.iinfo(np.int64).max
            order = np.lexsort((all_ids, all_keys), axis=1)
        order = order[:, : self.k]
        self.keys[part] = np.take_along_axis(all_keys, order, axis=1)
        self.ids[part] = np.take_along_axis(all_ids, order, axis=1)

    def rows(self, first: int = 0, last: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query row, base id and sort key of everything found, or of what is found for some query rows."""
        qi, place = np.nonzero(np.isfinite(self.keys[first:last]))
        qi += first
        return qi, self.ids[qi, place], self.keys[qi, place]


def add_in_range(top: TopK, rows, low, high, base: VectorBlock, ids, attr) -> None:
    """Merge base rows whose ``attr`` lies in each query's closed range.

    Base rows are put in attribute order, if they do not stand in it, so that a query meets a run of
    them; only pieces that a range reaches are compared with its query.
    """
    if (attr[1:] < attr[:-1]).any():
        order = np.argsort(attr, kind="stable")
        base, ids, attr = base.take(order), ids[order], attr[order]
    first = np.searchsorted(attr, low[rows], side="left")
    last = np.searchsorted(attr, high[rows], side="right")
    hit = last > first
    top.add(rows[hit], base, ids, (first[hit], last[hit]))


def nearest_row(vectors: VectorBlock, centres: VectorBlock) -> np.ndarray:
    """Index of the nearest centre of every row (ties go to the lower index)."""
    n = len(vectors.matrix)
    out = np.empty(n, dtype=np.int64)
    step = max(1, _MATRIX_CELLS // max(1, len(centres.matrix)))
    scale = vectors.squares + centres.squares.max()
    slack = _slack(vectors, centres, scale)
    for at in range(0, n, step):
        rows = slice(at, at + step)
        rough = vectors.query_form[rows] @ centres.base_form.T
        best = rough.argmax(axis=1)
        floor = rough[np.arange(len(best)), best] - slack[rows]
        near = rough >= floor[:, None]
        # Only rows with several centres within rounding error are compared exactly.
        for row in np.flatnonzero(np.count_nonzero(near, axis=1) > 1):
            some = np.flatnonzero(near[row])
            gaps = centres.matrix[some] - vectors.matrix[at + row]
            best[row] = some[np.einsum("ij,ij->i", gaps, gaps).argmin()]
        out[rows] = best
    return out
