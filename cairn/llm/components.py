"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of edges (u, v) whose component, the smallest node it can reach, is another one.

    Nodes on no edge, loops and the smallest nodes themselves get no row. Each round joins the edges with one minimum per
    node, which partial aggregation makes before the shuffle, so a hub's edges are split by the adaptive skew join and no
    task holds a component. Rounds end when the edges, each node to its component's minimum, no longer change.
    """
    now = scratch.save(
        edges.filter("u is not null and v is not null and u != v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    mark = _mark(now)
    while mark[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = scratch.save(small.union(low.select("u", F.col("m").alias("v"))).distinct())
        last, mark = mark, _mark(after)
        scratch.drop(now)
        now = after
        if mark == last:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _mark(edges: DataFrame) -> tuple:
    """Count and two order-free digests of the edges: equal for equal sets."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count("*"), F.bit_xor(h), F.sum(F.shiftright(h, 24))).first())
