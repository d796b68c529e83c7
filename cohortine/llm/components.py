"""Connected components of a table of links, by label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import saved


def components(links: DataFrame) -> DataFrame:
    """(node, component) for links (a, b): the component is its smallest node.

    Every round each node takes the smallest label of itself and its neighbours and then the label of that label,
    so the number of rounds grows with the logarithm of the longest path. Both steps are map-side minima and equi-joins;
    a node with very many links costs no more than its links. A node without links gets no row. Links with a null end
    are ignored.
    """
    links = links.select("a", "b").where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = saved(links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = saved(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("component")))
    while True:
        seen = edges.join(labels.select(F.col("node").alias("b"), F.col("component").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        hooked = labels.join(seen, "node", "left").select("node", F.col("component").alias("was"), F.least("component", "near").alias("label"))
        roots = hooked.groupBy(F.col("was").alias("root")).agg(F.min("label").alias("least"))
        stepped = saved(
            hooked.join(roots, hooked.label == roots.root, "left")
            .select("node", "was", F.least("label", "least").alias("component"))
        )
        labels = stepped.select("node", "component")
        if stepped.where("was <> component").isEmpty():
            return labels
