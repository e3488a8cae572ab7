"""Compact 16-bit codes for vector elements: a 14-bit signed mantissa and a 2-bit scale."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.functions.arrow import arrow_function
from nearfield.operators.kernels import as_list_column, as_matrix

# element = mantissa / scale, finest scale first; mantissas fill 14 bits.
SCALES = [100000.0, 10000.0, 1000.0, 100.0]
MANTISSA_MIN = -8192
MANTISSA_MAX = 8191


@arrow_function("array<smallint>")
def encode_vector(emb: pa.Array) -> pa.Array:
    values = as_matrix(emb)
    steps = np.rint(values[..., None] * np.array(SCALES))
    fits = (steps >= MANTISSA_MIN) & (steps <= MANTISSA_MAX)
    scale = np.where(fits.any(axis=-1), fits.argmax(axis=-1), len(SCALES) - 1)
    mantissa = np.take_along_axis(steps, scale[..., None], axis=-1)[..., 0]
    codes = np.clip(mantissa, MANTISSA_MIN, MANTISSA_MAX).astype(np.int64) * 4 + scale
    return as_list_column(codes.astype(np.int16), pa.int16())


@arrow_function("array<float>")
def decode_vector(codes: pa.Array) -> pa.Array:
    packed = as_matrix(codes).astype(np.int64)
    values = (packed >> 2) / np.array(SCALES)[packed & 3]
    return as_list_column(values.astype(np.float32), pa.float32())


@arrow_function("struct<worst:double,total:double,elements:bigint>")
def _row_error(emb: pa.Array, decoded: pa.Array) -> pa.Array:
    gap = np.abs(as_matrix(emb) - as_matrix(decoded))
    return pa.StructArray.from_arrays(
        [pa.array(gap.max(axis=1)), pa.array(gap.sum(axis=1)),
         pa.array(np.full(len(gap), gap.shape[1]))],
        names=["worst", "total", "elements"],
    )


def quantise_column(df: DataFrame, emb: str = "emb") -> DataFrame:
    """Adds ``code`` and ``decoded``; the embedding stays as it is."""
    coded = df.withColumn("code", encode_vector(F.col(emb)))
    return coded.withColumn("decoded", decode_vector(F.col("code")))


def error_report(coded: DataFrame, emb: str = "emb") -> DataFrame:
    """One row: number of vectors and elements, mean and largest absolute error."""
    errors = coded.select(_row_error(F.col(emb), F.col("decoded")).alias("e"))
    return errors.agg(
        F.count("*").alias("vectors"),
        F.sum("e.elements").alias("elements"),
        (F.sum("e.total") / F.sum("e.elements")).alias("mean_abs_error"),
        F.max("e.worst").alias("max_abs_error"),
    )


