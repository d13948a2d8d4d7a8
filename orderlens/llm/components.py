"""Connected components of a link table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.common import write_table


def connected(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links (a, b)``: the least node
    it is linked with. Labels go to neighbours and then jump to their label's
    label, until none changes; a hub's neighbours meet in partial minima."""
    both = write_table(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = write_table(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("near"))
        seen = labels.join(near, F.col("node") == F.col("a")).select("node", F.col("component").alias("old"), F.least("component", "near").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("component").alias("far"))
        moved = write_table(seen.join(jump, "next", "left").select("node", "old", F.least("next", F.coalesce("far", "next")).alias("component")), "labels")
        labels = moved.select("node", "component")
        if not moved.where("old <> component").limit(1).count():
            return labels
