"""Connected components of a distributed edge list, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import Shelf


def components(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b), the component being its smallest node; a stored table.

    Each round points every node at its smallest neighbour if that is smaller, follows the pointers a few
    steps, and rewrites the edges between what they lead to. Every component loses at least half of its
    inner nodes, so rounds grow with the logarithm of the largest component. All steps are joins and
    pre-aggregated minima over the edge list; nothing is gathered in one task.
    """
    live = shelf.keep(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels, n = None, live.count()
    while n:
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        first = up = shelf.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("up")), n)
        for _ in range(3):
            up = up.join(first.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up"))
        up = shelf.keep(up, n)
        shelf.drop(first)
        a, b = (up.select(F.col("node").alias(x), F.col("up").alias(f"to_{x}")) for x in "ab")
        last, live = live, shelf.keep(live.join(a, "a").join(b, "b").where("to_a != to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), n)
        shelf.drop(last)
        if labels is None:
            labels, most = up, n
        else:
            to = up.select(F.col("node").alias("up"), F.col("up").alias("to"))
            last, labels = labels, shelf.keep(labels.join(to, "up", "left").select("node", F.coalesce("to", "up").alias("up")), most)
            shelf.drop(last, up)
        n = live.count()
    if labels is None:
        labels = shelf.keep(live.select(F.col("a").alias("node"), F.col("b").alias("up")))
    shelf.drop(live)
    return shelf.like(labels.select("node", F.col("up").alias("component")), labels)


def merged(labels: DataFrame | None, edges: DataFrame, shelf: Shelf) -> DataFrame:
    """``labels`` after more ``edges`` (a, b): only edges between components are contracted. The old table goes."""
    if labels is None:
        return components(edges, shelf)
    a, b = (labels.select(F.col("node").alias(x), F.col("component").alias(f"of_{x}")) for x in "ab")
    named = edges.join(a, "a", "left").join(b, "b", "left").select("a", "b", F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b"))
    named = shelf.keep(named)
    joined = components(named.select(F.col("of_a").alias("a"), F.col("of_b").alias("b")), shelf)
    to = joined.select(F.col("node").alias("component"), F.col("component").alias("to"))
    new = named.select(F.col("a").alias("node"), F.col("of_a").alias("component")).unionByName(named.select("b", "of_b").toDF("node", "component"))
    every = shelf.keep(labels.unionByName(new).distinct())
    out = shelf.keep(every.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component")))
    shelf.drop(labels, named, joined, every)
    return out
