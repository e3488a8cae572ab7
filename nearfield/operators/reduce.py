"""Principal components of a vector table."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.arrow import arrow_function
from nearfield.operators.kernels import as_list_column, as_matrix


@dataclass(frozen=True)
class Projection:
    """Mean and components; their size depends on the dimensions alone."""

    mean: np.ndarray
    components: np.ndarray
    explained: np.ndarray

    def apply(self, emb: Column) -> Column:
        """Centre and project a vector column."""
        mean, components = self.mean, self.components

        @arrow_function("array<float>")
        def projected(column: pa.Array) -> pa.Array:
            reduced = (as_matrix(column) - mean) @ components
            return as_list_column(reduced.astype(np.float32), pa.float32())

        return projected(emb)

    @property
    def explained_ratio(self) -> float:
        """Share of the variance kept; tiny negative eigenvalues count as 0."""
        return float(np.maximum(self.explained, 0.0).sum())


def fit_projection(df: DataFrame, d_out: int, emb: str = "emb") -> Projection:
    """Fit on all rows: the covariance is summed up in the executors."""
    vectors = df.select(array_to_vector(emb).alias("features")).dropna()
    model = PCA(k=d_out, inputCol="features", outputCol="reduced").fit(vectors)
    mean = vectors.select(Summarizer.mean(F.col("features")).alias("mean")).first()["mean"]
    return Projection(
        mean.toArray(), model.pc.toArray(), np.asarray(model.explainedVariance.toArray())
    )


def stack(base: DataFrame, queries: DataFrame) -> DataFrame:
    """Base and query vectors in one table, told apart by ``side``."""
    a = base.select(F.lit("base").alias("side"), "id", "emb")
    return a.unionByName(queries.select(F.lit("query").alias("side"), F.col("qid").alias("id"), "emb"))


def unstack(stacked: DataFrame) -> tuple[DataFrame, DataFrame]:
    base = stacked.where(F.col("side") == "base").drop("side")
    queries = stacked.where(F.col("side") == "query").drop("side")
    return base, queries.withColumnRenamed("id", "qid")


def reduce_jointly(
    base: DataFrame, queries: DataFrame, d_out: int
) -> tuple[DataFrame, DataFrame, Projection]:
    """One projection fitted on base and queries together and applied to both."""
    both = stack(base, queries)
    projection = fit_projection(both, d_out)
    reduced = both.withColumn("emb", projection.apply(F.col("emb")))
    return *unstack(reduced), projection
