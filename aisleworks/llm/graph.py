"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aisleworks.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """Per node of the edges ``a, b`` (longs): ``node, component``, the smallest node it reaches.

    Each round takes the smallest label among a node and its neighbours and then the label of that label, so a
    label's reach about doubles; labels are written to the shared folder between rounds. Loops and repeated edges
    do no harm, rows with a null end are ignored. An empty table gives no row.
    """
    kept = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    both = kept.select("a", "b").union(kept.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    links = written(both, "links")
    labels = written(
        links.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("component")), "labels"
    )
    while True:
        lowest = (
            links.join(labels, links["b"] == labels["node"])
            .groupBy(F.col("a").alias("of"))
            .agg(F.min("component").alias("lowest"))
        )
        hooked = labels.join(lowest, labels["node"] == lowest["of"]).select(
            "node", F.col("component").alias("was"), F.least("component", "lowest").alias("now")
        )
        parents = labels.select(F.col("node").alias("parent"), F.col("component").alias("beyond"))
        jumped = hooked.join(parents, F.col("now") == F.col("parent")).select(
            "node", F.least("now", "beyond").alias("component"), (F.col("was") != F.least("now", "beyond")).alias("moved")
        )
        new = written(jumped, "labels")
        labels = new.select("node", "component")
        if new.where("moved").isEmpty():
            return labels
