"""Connected components of an edge table, as a few Spark joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node reachable from each node that has an edge.

    Every round each node points at its smallest neighbour, the pointers are doubled until all reach
    a root, and the edges are rewritten between roots; a round at least halves what is left, and
    doubling takes as many steps as the logarithm of the longest chain. Each step is written to the
    shared folder, and deleted once the next is there, so that the plan stays short and both sides of each join are plain scans: a hub's
    rows are then split by adaptive skew joins. Self edges, repeats and null ends are ignored; an
    empty table gives an empty result.
    """
    edges = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where("u is not null and v is not null and u <> v")
    edges = materialise(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels = labels_in = None
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parents = both.groupBy(F.col("u").alias("node")).agg(F.least("u", F.min("v")).alias("parent"))
        parents = written = materialise(parents, "parents")
        while True:
            above = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            jumped = materialise(parents.join(above, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved")), "jump")
            if not jumped.where("moved").limit(1).count():
                discard(jumped)
                break
            discard(written)
            parents, written = jumped.drop("moved"), jumped
        if labels is None:
            labels, labels_in = parents.select("node", F.col("parent").alias("component")), written
        else:
            step = parents.select(F.col("node").alias("component"), F.col("parent").alias("root"))
            labels = materialise(labels.join(step, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
            discard(labels_in)
            labels_in = labels
        left = parents.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        right = parents.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        half = materialise(edges.join(left, "u").select("pu", "v"), "half")
        moved_edges = half.join(right, "v").where("pu <> pv")
        after = materialise(moved_edges.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges")
        discard(edges, half, *([written] if written is not labels_in else []))
        edges = after
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels
