"""Connected components of an edge table by alternating star contractions.

Each round replaces edges by edges to the least neighbour (large star, then
small star); the number of rounds grows with the logarithm of the longest
chain. All steps are sums for each node before a shuffle and equi-joins; no
node's neighbours are ever collected. The edges of a node are dealt over ``SALTS``
keys, so the centre of a large star is no single task's. Every round is written to
the shared scratch folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import stored

#: Keys that the edges of a node are dealt over; a node of few edges has as few.
SALTS = 64


def _with_least(e: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the least v of their u."""
    e = e.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)))
    own = e.groupBy("u", "salt").agg(F.min("v").alias("m"))
    low = own.select("u", "salt").join(own.groupBy("u").agg(F.min("m").alias("m")), "u")
    return e.join(low, ["u", "salt"]).select("u", "v", "m")


def _state(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(r)


def components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 64) -> DataFrame:
    """node, component: every node of an edge with the least node that it reaches."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = stored(e, "edges")
    state = _state(e)
    for _ in range(most_rounds):
        if not state[0]:
            break
        both = e.union(e.select("v", "u"))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).where("u <> v").distinct()
        small = _with_least(large)
        e = stored(small.select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct(), "edges")
        before, state = state, _state(e)
        if state == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
    if state[0]:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
