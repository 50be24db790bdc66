"""Connected components by joins: smallest label of the neighbours, then of the label's own label."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import Scratch


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (smallest node of its component), for the nodes of edges (u, v).

    Each round halves the distance to the root at least; all steps are joins and
    minima with partial aggregation, so that a star of any size is split. Raises
    if `rounds` don't suffice.
    """
    scratch = Scratch(edges.sparkSession)
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).filter("u <> v").distinct()
    both = scratch.written(both, "edges")
    labels = scratch.written(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")), "labels")
    for _ in range(rounds):
        theirs = both.join(labels.select(F.col("node").alias("v"), "root"), "v").select(F.col("u").alias("node"), "root")
        near = scratch.written(labels.select("node", "root").union(theirs).groupBy("node").agg(F.min("root").alias("root")), "labels")
        # a root is always a node: the label of the label, looked up
        up = near.select(F.col("node").alias("root"), F.col("root").alias("top"))
        jumped = scratch.written(near.join(up, "root").select("node", F.least("root", "top").alias("root")), "labels")
        before, after = (x.agg(F.sum(F.xxhash64("node", "root").cast("decimal(38,0)"))).first()[0] for x in (labels, jumped))
        scratch.drop(labels, near)
        labels = jumped
        if before == after:
            scratch.drop(keep=labels)
            return labels
    raise RuntimeError("components did not settle")
