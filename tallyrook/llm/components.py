"""Distributed connected components, by DataFrame operations only.

Each round hooks every component to the smallest of its neighbours if that is
smaller, flattens the chains this makes by pointer doubling, and contracts the
edges to those between different components.  A component without a smaller
neighbour is hooked to by one, so their number at least halves per round.
Hot nodes: edges are distinct pairs, minima are pre-aggregated before the
shuffle, and joins on hot nodes split (adaptive skew join).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyrook.llm import base


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) of every node of `edges`: the smallest node reachable.
    Nulls and loops in edges are ignored; no edges give no rows."""
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u != v")
    e = base.saved(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    labels = None
    while not e.isEmpty():
        made = []

        def kept(df: DataFrame) -> DataFrame:
            made.append(base.saved(df, "parents"))
            return made[-1]

        both = e.union(e.select("v", "u"))
        parent = kept(both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("parent")))
        while True:
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            flat = kept(parent.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")))
            parent = flat.select("node", "parent")
            if flat.where("moved").isEmpty():
                break
        old = (labels, e)
        if labels is None:
            labels = base.saved(parent.select("node", F.col("parent").alias("component")), "labels")
        else:
            step = parent.select(F.col("node").alias("component"), "parent")
            labels = base.saved(labels.join(step, "component", "left").select("node", F.coalesce("parent", "component").alias("component")), "labels")
        a = parent.select(F.col("node").alias("u"), F.col("parent").alias("a"))
        b = parent.select(F.col("node").alias("v"), F.col("parent").alias("b"))
        crossing = e.join(a, "u").join(b, "v").where("a != b")
        e = base.saved(crossing.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
        base.dropped(*made, *[x for x in old if x is not None])
    return labels
