"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# Sizes up to which a table may be sent whole to every executor.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def _checkpoint_dir(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )


def scratch_root(spark: SparkSession) -> str:
    """The folder shared by all executors in which intermediate tables are written.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, where the driver's
    disk is every executor's disk, gets a folder of its own.
    """
    configured = _checkpoint_dir(spark)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    made = tempfile.mkdtemp(prefix="nearfield-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made


# Folder of the innermost scratch scope of this thread or task.
_scope: ContextVar[str | None] = ContextVar("scratch_scope", default=None)


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{_scope.get() or scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


class Scope:
    """The tables written since the scope was entered; :meth:`keep` carries a result out of it."""

    def __init__(self, outer: str):
        self._outer = outer

    def keep(self, df: DataFrame, label: str = "kept") -> DataFrame:
        """``df`` written outside, where it outlives the scope and does not read its tables."""
        path = f"{self._outer}/{label}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[Scope]:
    """Removes the intermediate tables that are written inside, also after an error.

    A DataFrame made inside may read them later: write it, collect it or :meth:`Scope.keep` it before
    the end. Scopes nest; what an inner one keeps belongs to the outer one. Only the folder that the
    scope has made in the shared scratch folder is removed.
    """
    outer = _scope.get() or scratch_root(spark)
    folder = f"{outer}/scope-{uuid.uuid4().hex}"
    token = _scope.set(folder)
    try:
        yield Scope(outer)
    finally:
        _scope.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    This cuts the lineage and survives the loss of executors: whatever is computed from the
    result later reads the files instead of running the earlier stages again.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers (once per Spark context)."""
    context = spark.sparkContext
    if getattr(context, "_nearfield_shipped", False):
        return
    source = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="nearfield-code-")) / "nearfield.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for module in sorted(source.rglob("*.py")):
            out.write(module, Path(source.name) / module.relative_to(source))
    context.addPyFile(str(archive))
    context._nearfield_shipped = True
