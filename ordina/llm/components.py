"""Connected components by random contraction, DataFrame operations only.

Each round, every node points to the neighbour (itself included) of the least round-specific hash; edges are rewritten
to the nodes pointed at and shrink by a constant factor in expectation, chains included.  Groups are only ever reduced
by ``min``, so a hub costs a partial aggregation, not one large group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_tables, materialize


def connected_components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """``edges``: columns ``a`` and ``b`` of one orderable type.  Returns ``node``, ``root`` for every node of a proper edge.

    Null ends, self-loops, repeated and reversed edges are ignored.  An empty input gives an empty result.
    """
    def proper(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    edges = materialize(proper(edges), "edges")
    written = [edges]
    pointers: list[DataFrame] = []
    for turn in range(rounds):
        both = edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        best = F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), F.col("b").alias("to"))).alias("m")
        own = F.struct(F.xxhash64("a", F.lit(turn)).alias("h"), F.col("a").alias("to"))
        to = materialize(both.groupBy("a").agg(best).select(F.col("a").alias("node"), F.least("m", own).getField("to").alias("to")), "pointers")
        written.append(to)
        if to.isEmpty():
            break
        pointers.append(to)
        at_a, at_b = to.toDF("a", "ta"), to.toDF("b", "tb")
        edges = proper(edges.join(at_a, "a").join(at_b, "b").select(F.col("ta").alias("a"), F.col("tb").alias("b")))
        # Two rounds share a plan; then the edges left are written.
        if turn % 2:
            edges = materialize(edges, "edges")
            written.append(edges)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    if not pointers:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = pointers[-1].toDF("node", "root")
    for earlier in reversed(pointers[:-1]):
        later = found.toDF("to", "root")
        found = earlier.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    found = materialize(found, "components")
    drop_tables(*written)
    return found
