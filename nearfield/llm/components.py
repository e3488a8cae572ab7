"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nearfield.llm.common import materialize

_MAX_ROUNDS = 64  # the rounds grow with the logarithm of the nodes; more mean a fault


def _stars(links: DataFrame, small: bool) -> DataFrame:
    """Link every (larger, or with ``small`` smaller) neighbour of a node to the least of its
    neighbours and itself. ``links`` has ``hi > lo``."""
    if small:
        side = links.select(F.col("hi").alias("node"), F.col("lo").alias("near"))
    else:
        side = links.select(F.col("hi").alias("node"), F.col("lo").alias("near")).union(
            links.select(F.col("lo").alias("node"), F.col("hi").alias("near")))
    least = side.groupBy("node").agg(F.min("near").alias("least")).select(
        F.col("node").alias("of"), F.least("node", "least").alias("root"))
    met = side.join(least, F.col("node") == F.col("of"))
    out = met.filter(F.col("near") > F.col("root") if small else F.col("near") > F.col("node")).select(
        F.col("near").alias("hi"), F.col("root").alias("lo"))
    if small:
        out = out.union(least.filter(F.col("of") > F.col("root")).select(F.col("of").alias("hi"), F.col("root").alias("lo")))
    return out.filter(F.col("hi") > F.col("lo")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every linked node; the component is its least node.

    ``links`` holds pairs ``(a, b)`` of longs in any direction, repeats and loops allowed. Stars
    around larger and smaller neighbours alternate until nothing changes, which takes about as
    many rounds as the logarithm of the longest chain. Each round is an aggregate and a join, is
    written to the shared folder, and only its row count and checksum reach the driver.
    """
    now = materialize(
        links.filter(F.col("a") != F.col("b")).select(
            F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "links")
    seen = None
    for _ in range(_MAX_ROUNDS):
        sign = tuple(now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
        if sign == seen or not sign[0]:
            return now.select(F.col("hi").alias("node"), F.col("lo").alias("component")).union(
                now.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
        seen = sign
        now = materialize(_stars(_stars(now, small=False), small=True), "stars")
    raise RuntimeError("the components did not settle")
