"""Column functions that work on whole Arrow arrays."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from nearfield.session import ship_package


def arrow_function(return_type: str) -> Callable:
    """Turn a function of Arrow arrays without nulls into a function of columns.

    Rows with a null argument give null; the function sees only the others.
    """

    def wrap(fn: Callable) -> Callable:
        def column_function(*columns: Column) -> Column:
            ship_package(SparkSession.active())
            returned = to_arrow_type(DataType.fromDDL(return_type))

            def evaluate(*arrays: pa.Array) -> pa.Array:
                valid = np.ones(len(arrays[0]), dtype=bool)
                for array in arrays:
                    if array.null_count:
                        valid &= array.is_valid().to_numpy(zero_copy_only=False)
                if not valid.any():
                    return pa.nulls(len(valid), returned)
                if valid.all():
                    return fn(*arrays)
                kept = pa.array(valid)
                result = fn(*[array.filter(kept) for array in arrays])
                return result.take(pa.array(np.cumsum(valid) - 1, mask=~valid))

            return F.arrow_udf(evaluate, return_type)(*columns)

        column_function.__doc__ = fn.__doc__
        column_function.__name__ = fn.__name__
        return column_function

    return wrap
