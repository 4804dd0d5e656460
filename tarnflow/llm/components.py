"""Connected components of a link table: partitions contract their links alone, then large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stash


def _contracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The links of one partition as stars: each node with the least that it reaches inside the partition."""
    parent: dict = {}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
            a, b = root(parent.setdefault(a, a)), root(parent.setdefault(b, b))
            parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if parent[x] != x]
    if nodes:
        yield pd.DataFrame({"a": nodes, "b": [root(x) for x in nodes]})


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a > b). Every node's neighbours (large: the larger ones; small: itself and the smaller ones) are linked to the
    least of its neighbourhood. Minima combine before the shuffle; they are written before the join, so that they are
    broadcast if few, and else adaptive execution can split the rows of a hub."""
    near = _both(edges) if large else edges
    least = stash(near.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m")))
    linked = near.join(small(least), near["a"] == least["node"])
    out = linked.where("b > a") if large else linked
    out = out.select(F.col("b").alias("a"), F.col("m").alias("b"))
    if not large:
        out = out.unionByName(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """links (a, b), two columns of one orderable type, to (node, component): the least node that each linked node reaches. Nodes
    without a link to another are left out, null ends are ignored, and an empty table gives an empty result.

    Partitions first replace their links by stars, which settles most chains. The steps then shrink what is left to stars
    in about log(n) rounds, each written to the shared folder; no link and no component reaches the driver, only the
    number and a checksum of the links.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges, seen = stash(edges.mapInPandas(_contracted, edges.schema)), None
    while True:
        sign = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if sign == seen or not sign["n"]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            )
        seen, edges = sign, stash(_star(_star(edges, True), False))
