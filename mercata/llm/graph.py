"""Connected components of an edge table, in joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mercata.session import drop_table, write_table


def _flatten(parent: DataFrame) -> DataFrame:
    """Follow (v, root) pointers to their ends; each pass doubles the reach."""
    while True:
        up = parent.select(F.col("v").alias("root"), F.col("root").alias("above"))
        nxt = write_table(parent.join(up, "root", "left").select(
            "v", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved")), "cc-parent")
        drop_table(parent)
        if nxt.filter("moved").isEmpty():
            return nxt.select("v", "root")
        parent = nxt.select("v", "root")


def connected_components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of ``edges`` (a long, b long) that is not its component's smallest.

    Each round hooks every vertex to its smallest smaller neighbour, flattens
    the pointers and contracts the edges; at most half of the vertices survive
    a round, so rounds grow with the logarithm of the vertices. A hub is no hot
    key: minima pre-aggregate in each task, and the joins have plain shuffles
    on both sides, which adaptive execution splits. Nulls and loops are ignored.
    """
    edges = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges = write_table(edges.filter("a < b").distinct(), "cc-edges")
    labels = None
    while not edges.isEmpty():
        parent = _flatten(write_table(edges.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("root")), "cc-parent"))
        of = lambda c, n: parent.select(F.col("v").alias(c), F.col("root").alias(n))
        moved = edges.join(of("a", "ra"), "a", "left").join(of("b", "rb"), "b", "left").select(
            F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        rest = write_table(moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
                           .filter("a < b").distinct(), "cc-edges")
        drop_table(edges)
        edges = rest
        if labels is None:
            labels = parent
        else:
            new = write_table(labels.join(of("root", "up"), "root", "left").select("v", F.coalesce("up", "root").alias("root"))
                              .unionByName(parent), "cc-labels")
            drop_table(labels)
            drop_table(parent)
            labels = new
    if labels is None:
        labels = edges.select(F.col("b").alias("v"), F.col("a").alias("root"))
    return labels
