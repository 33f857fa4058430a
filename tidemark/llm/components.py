"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.staging import Stage


def components(stage: Stage, links: DataFrame, name: str) -> DataFrame:
    """(node, label): the smallest node that can be reached, for every node with a link.

    Labels spread over the links and are then looked up once more (label of the label), so a
    path's labels travel in steps that double. Each round is written and read back. A node
    with very many links is only ever the large side of a join that Spark can split, or the
    key of a minimum that tasks combine before the shuffle.
    """
    ends = links.select("a", "b")
    both = stage.table(
        ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        f"{name}-links",
    )
    rows = both.count()
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
    labels = labels.select("node", F.least("node", "near").alias("label"))
    labels, step = stage.table(labels, f"{name}-0", rows), 0
    while True:
        step += 1
        known = labels.withColumnsRenamed({"node": "b", "label": "other"})
        near = both.join(known, "b").groupBy(F.col("a").alias("node")).agg(F.min("other").alias("near"))
        moved = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("next"))
        jump = labels.withColumnsRenamed({"node": "next", "label": "far"})
        moved = moved.join(jump, "next").select(
            "node", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("changed")
        )
        moved = stage.table(moved, f"{name}-{step}", rows)
        stage.drop(f"{name}-{step - 1}")
        labels = moved.select("node", "label")
        if moved.where("changed").isEmpty():
            stage.drop(f"{name}-links")
            return labels
