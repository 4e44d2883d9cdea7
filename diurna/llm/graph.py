"""Connected components of a link table, as joins and map-side combined minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diurna.session import written_table


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b); the smallest node names it.

    Each round a node takes the smallest label among its neighbours', then the
    label of that label, so a label travels twice as far every round. A node
    with very many links is one group of a minimum that is combined map-side.
    """
    both = written_table(
        links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(
            links.select(F.col("b").alias("node"), F.col("a").alias("other"))
        ).distinct(),
        "links",
    )
    labels = written_table(
        both.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), "labels"
    )
    while True:
        near = (
            both.join(labels.withColumnsRenamed({"node": "other", "component": "label"}), "other")
            .groupBy("node")
            .agg(F.min("label").alias("label"))
        )
        hooked = labels.join(near, "node").select(
            "node",
            F.col("component").alias("before"),
            F.least("component", "label").alias("component"),
        )
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        moved = written_table(
            hooked.join(jump, "component", "left").select(
                "node",
                "before",
                F.least("component", F.coalesce("further", "component")).alias("component"),
            ),
            "labels",
        )
        labels = moved.select("node", "component")
        if moved.where(F.col("component") != F.col("before")).isEmpty():
            return labels
