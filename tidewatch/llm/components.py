"""Connected components of an edge list by alternating large-star and small-star steps.

Nothing is gathered on the driver but a count and a checksum of each round's edges. Each round is
written to the shared folder, so a lost executor costs no more than a round. A hub's edges meet its
smallest neighbour in a join with one row a key, which adaptive execution splits if it is skewed.
Before the rounds, tasks of EDGES edges each leave a star for whatever their edges join, so that a dense
group goes through the rounds with fewer edges than it has nodes, a time for each such task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import keep
from .common import map_batches

EDGES = 65_536  # that a task joins


def stars(edges: DataFrame, at_once: int = EDGES) -> DataFrame:
    """(u, v): edges that join what the edges (u, v) join, from tasks of about at_once edges; v is the smallest node of a task's group, u another."""

    def fn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def top(x: int) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y]
            return x

        for b in batches:
            for u, v in zip(b.column("u").to_pylist(), b.column("v").to_pylist(), strict=True):
                u, v = top(u), top(v)
                up[max(u, v)] = min(u, v)
        pairs = [(x, top(x)) for x in up]
        pairs = [p for p in pairs if p[0] != p[1]]
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["u", "v"])

    longs = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    return map_batches(longs.repartition(-(-edges.count() // at_once) or 1), fn, "u long, v long")


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, component) for every node of edges (a, b); component is its smallest reachable node.

    Loops, nulls and repeated edges do not matter; no edges give no rows."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, seen = keep(stars(keep(e, "edges")).distinct(), "edges"), None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x")).select("x.u", "x.v")
        e = keep(small.where("u <> v").distinct(), "edges")
        state = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    low = e.groupBy("u").agg(F.min("v").alias("component"))
    return low.select(F.col("u").alias("node"), "component").unionByName(low.select(F.col("component").alias("node"), "component").distinct())
