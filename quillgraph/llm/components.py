"""Connected components by minimum-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.runtime import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node id.

    Each round takes the smallest label among a node's neighbours and then the label of that label, so
    the rounds grow with the logarithm of a component's diameter for chains of stars. A hub is no group: its
    edges are join rows that adaptive execution can split, and minima are combined before the shuffle.
    Edges with a null end are left out; repeated edges and loops do no harm; no edges give no rows.
    """
    ends = edges.select("a", "b").where("a is not null and b is not null and a <> b")
    both = materialise(ends.union(ends.select("b", "a")).toDF("node", "other").distinct(), "component-edges")
    labels = materialise(both.groupBy("node").agg(F.min("other").alias("near")).select("node", F.least("node", "near").alias("component")), "component-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("other"), F.col("component").alias("near")), "other").groupBy("node").agg(F.min("near").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("component").alias("then"))
        step = materialise(lower.join(jump, "via").select("node", F.least("via", "then").alias("component"), "was"), "component-labels")
        labels = step.select("node", "component")
        if step.where("component <> was").isEmpty():
            return labels
