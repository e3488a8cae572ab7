"""Vector functions on array columns, evaluated on Arrow batches in double precision."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from nearfield.functions.arrow import arrow_function
from nearfield.operators.kernels import COSINE, EUCLIDEAN, as_list_column, as_matrix, pair_scores
from nearfield.operators.knn import metric_for


@arrow_function("double")
def euclidean_distance(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array(pair_scores(as_matrix(left), as_matrix(right), EUCLIDEAN))


@arrow_function("double")
def cosine_similarity(left: pa.Array, right: pa.Array) -> pa.Array:
    return pa.array(pair_scores(as_matrix(left), as_matrix(right), COSINE))


def vector_score(name: str, left: Column, right: Column) -> tuple[Column, bool]:
    """Score column of the metric a name stands for, and whether smaller is nearer."""
    if metric_for(name) == EUCLIDEAN:
        return euclidean_distance(left, right), True
    return cosine_similarity(left, right), False


def seeded_permutation(dim: int, seed: int) -> list[int]:
    """Order of the positions 0..dim-1 by the md5 of ``seed:position``."""
    return sorted(range(dim), key=lambda i: (hashlib.md5(f"{seed}:{i}".encode()).hexdigest(), i))


def permute_dimensions(emb: Column, permutation: Sequence[int]) -> Column:
    """The same reordering of dimensions for every vector."""
    order = np.array(permutation)
    if sorted(permutation) != list(range(len(order))):
        raise ValueError("not a permutation")

    @arrow_function("array<float>")
    def permuted(column: pa.Array) -> pa.Array:
        return as_list_column(as_matrix(column)[:, order].astype(np.float32), pa.float32())

    return permuted(emb)


def normalised_vector(emb: Column) -> Column:
    """Vectors as ``array<float>`` whatever numeric list the file holds."""
    return emb.cast("array<float>")


def is_valid_vector(emb: Column, dim: int) -> Column:
    """Right dimension, no null and nothing infinite or not a number."""
    finite = F.forall(emb, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(emb) == dim) & finite, F.lit(False))
