"""Query profile trees as a table of nodes."""

from __future__ import annotations

import json
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearfield.functions.arrow import arrow_function

_HEAD = "latency double, all_optimizers double, planner double, physical_planner double"
_NODE = "struct<path:array<int>,name:string,timing:double>"


def _walk(text: str) -> list[dict]:
    """The nodes of one tree in pre-order; text that is no tree has a bare root. A tree deeper than the
    parser can follow is an error, not a bare root."""
    try:
        tree = json.loads(text)
    except ValueError:
        tree = None
    out, left = [], [([], tree if isinstance(tree, dict) else {})]
    while left:
        path, node = left.pop()
        name, timing = node.get("operator_name"), node.get("operator_timing")
        out.append({
            "path": path, "name": None if name is None else str(name),
            "timing": None if timing is None else float(timing),
        })
        children = node.get("children") or []
        left += [([*path, i], children[i]) for i in reversed(range(len(children)))]
    return out


def _nodes(text: Column) -> Column:
    @arrow_function(f"array<{_NODE}>")
    def nodes(column: pa.Array) -> pa.Array:
        kind = pa.struct([("path", pa.list_(pa.int32())), ("name", pa.string()), ("timing", pa.float64())])
        return pa.array([_walk(x) for x in column.to_pylist()], pa.list_(kind))

    bare = F.array(F.struct(
        F.array().cast("array<int>").alias("path"), F.lit(None).cast("string").alias("name"),
        F.lit(None).cast("double").alias("timing"),
    ))
    return F.transform(F.coalesce(nodes(text), bare), lambda n: F.struct(
        n["path"].alias("path"), F.trim(n["name"]).alias("name"),
        F.coalesce(n["timing"], F.lit(0.0)).alias("timing"),
    ))


def profile_nodes(
    df: DataFrame, text: str, keys: Sequence[str], facts: Sequence[str] = ()
) -> DataFrame:
    """One row per tree node: keys, ``path`` (positions from the root), name and timing.

    Paths compare in pre-order. ``facts`` are root fields repeated on every node.
    """
    head = F.from_json(text, _HEAD)
    return df.select(
        *keys, *[head[f].alias(f) for f in facts], F.explode(_nodes(F.col(text))).alias("n")
    ).select(*keys, *facts, "n.*")


def profile_rollup(
    df: DataFrame, text: str, keys: Sequence[str], *, index_scans: Sequence[str],
    sequential_scans: Sequence[str] = ("SEQ_SCAN",),
) -> DataFrame:
    """Per profile: first index scan and sequential scan in pre-order, time outside them, planning
    time, and what is left of the latency for the index scan (never negative). A row's tree is
    summed up in the row."""
    phases = ["all_optimizers", "planner", "physical_planner"]
    rows = df.select(*keys, F.from_json(text, _HEAD).alias("__head"), _nodes(F.col(text)).alias("__nodes"))
    head, nodes = F.col("__head"), F.col("__nodes")

    def named(names: Sequence[str]):
        return lambda n: F.coalesce(n["name"].isin(list(names)), F.lit(False))

    def first(names: Sequence[str]) -> Column:
        return F.get(F.filter(nodes, named(names)), 0)["timing"]

    def outside(names: Sequence[str]) -> Column:
        rest = F.filter(nodes, lambda n: ~named(names)(n))
        return F.aggregate(rest, F.lit(0.0), lambda total, n: total + n["timing"])

    planning = sum((F.coalesce(head[p], F.lit(0.0)) for p in phases), F.lit(0.0))
    return rows.select(
        *keys,
        F.size(nodes).cast("long").alias("nodes"),
        first(index_scans).alias("index_scan"),
        first(sequential_scans).alias("sequential_scan"),
        outside([*index_scans, *sequential_scans]).alias("other_operators"),
        planning.alias("planning"),
        F.greatest(F.lit(0.0), head["latency"] - outside(index_scans) - planning).alias("index_scan_residual"),
    )
