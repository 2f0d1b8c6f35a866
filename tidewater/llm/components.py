"""Connected components by alternating large-star and small-star steps.

Every round is two aggregations and two joins over the edges, written to the shared
folder; what tells whether anything changed is observed while writing, and nothing else
reaches the driver.  From ``SPLIT`` edges on, where a node that a large part of all edges
meets would make a task long, aggregates are written too: then both sides of a join are
tables and Spark can split such a node's partition.  The number of rounds is logarithmic
in the number of nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.llm.common import materialize, materialize_seen

#: Edges from which intermediate steps are written; a matter of plans, not of results.
SPLIT = 2_000_000


def _seen() -> dict:
    """What tells one set of edges from another."""
    return {"n": F.count(F.lit(1)), "x": F.bit_xor(F.xxhash64("a", "b")), "s": F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))}


def _star(edges: DataFrame, large: bool, label: str, split: bool) -> DataFrame:
    """edges: (a, b).  Returns the rewired edges (a, b) with b < a."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else \
        edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    if split:
        low = materialize(low, f"{label}-low")
    joined = both.join(low, F.col("a") == F.col("u"))
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b")))
    out = out.where(F.col("a") != F.col("b")).distinct()
    return materialize(out, label) if split and large else out


def connected_components(edges: DataFrame, label: str, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node reachable."""
    current, seen = materialize_seen(
        edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label, **_seen())
    for _ in range(max_rounds):
        if not seen["n"]:
            break
        before, split = seen, seen["n"] >= SPLIT
        current, seen = materialize_seen(_star(_star(current, True, label, split), False, label, split), label, **_seen())
        if seen == before:
            break
    else:
        raise RuntimeError(f"no components after {max_rounds} rounds")
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
