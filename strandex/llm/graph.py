"""Connected components over edges that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandex.runtime import drop

from .common import scratch, scratch_scope


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for each node of edges (a, b): component is the least id reachable.

    Alternating large-star and small-star rounds: each node hands its neighbours the least
    neighbour until every node points at its root. A hub's minimum is combined before the
    shuffle and its edges are read by a join that Spark can split, so no task holds a hub.
    """
    with scratch_scope() as keep:
        e = keep(scratch(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()))
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
            )
        before = now
        with scratch_scope() as keep:
            last, e = e, keep(_round(e))
        drop(last)


def _round(e: DataFrame) -> DataFrame:
    # written, so that the join below reads plain exchanges and a hub's edges can be split among tasks
    least = scratch(
        e.select(F.col("a").alias("u"), "b")
        .unionByName(e.select(F.col("b").alias("u"), "b"))
        .groupBy("u")
        .agg(F.min("b").alias("m"))
    )
    large = e.join(least.hint("merge"), e.b == least.u).select("a", F.col("m").alias("b")).distinct()
    small = large.groupBy("a").agg(F.min("b").alias("m"))
    return scratch(
        large.join(small, "a")
        .where("b <> m")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(small.select("a", F.col("m").alias("b")))
        .distinct()
    )
