"""Connected components of edges that may be many, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corpuspipe.llm.common import discard, store


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) of every node of ``edges`` (``x, y``); a stored table.

    Every round gives a node the smallest label among its own and its neighbours', and then that label's label,
    so labels travel in leaps. A hub's neighbours are combined before the shuffle. The driver only learns how
    many labels changed.
    """
    both = store(
        edges.select("x", "y").union(edges.select(F.col("y").alias("x"), F.col("x").alias("y"))).where("x <> y").distinct(),
        "component-edges",
    )
    labels = store(
        both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("y")).select("node", F.least("node", "y").alias("component")),
        "component-labels",
    )
    while True:
        known = labels.select(F.col("node").alias("y"), F.col("component").alias("seen"))
        nearest = both.join(known, "y").groupBy(F.col("x").alias("node")).agg(F.min("seen").alias("seen"))
        stepped = labels.join(nearest, "node").select(
            "node", "component", F.least("component", "seen").alias("stepped")
        )
        leap = labels.select(F.col("node").alias("stepped"), F.col("component").alias("leap"))
        moved = store(
            stepped.join(leap, "stepped").select(
                "node", F.least("stepped", "leap").alias("component"), (F.least("stepped", "leap") < F.col("component")).alias("moved")
            ),
            "component-labels",
        )
        changed = moved.where("moved").limit(1).count()
        discard(labels)
        labels = moved.select("node", "component")
        labels._stored_path = moved._stored_path
        if not changed:
            discard(both)
            return labels
