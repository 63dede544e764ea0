"""Connected components of a graph given by its links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The nodes of `links` (a, b: long, in any order, repeated or not) with the smallest node that
    each reaches: node, component.

    Alternates two steps until nothing changes, about log(nodes) times: every node sends its larger
    neighbours to the smallest neighbour it has (itself included), then its smaller ones. What remains is a
    star around each component's smallest node. The smallest neighbour of a node is found by a partial
    aggregation and joined back, so that a node with very many links is split by adaptive
    execution; no step gathers a node's neighbours. Each round is a written table.
    """
    edges = links.filter("a != b").select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")
    )
    edges = scratch.keep(edges.distinct(), f"{name}-0")
    seen, step = _fingerprint(edges), 0
    while True:
        step += 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        smallest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))  # (u, v) with v > u
        moved = larger.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = scratch.keep(moved.filter("u != v").distinct(), f"{name}-{step}-large")
        lowest = edges.groupBy("u").agg(F.min("v").alias("m"))
        joined = edges.join(lowest, "u")
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            joined.select("u", F.col("m").alias("v"))
        )
        edges = scratch.keep(moved.filter("u != v").distinct(), f"{name}-{step}")
        now = _fingerprint(edges)
        if now == seen:
            break
        seen = now
    tops = edges.select(F.col("v").alias("node")).distinct()
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(tops.select("node", F.col("node").alias("component")))


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).first()
    return tuple(row)
