"""Connected components of a table of links, without ever holding them in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillframe.llm.common import release, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every end of (a, b): the smallest node that links reach.

    Each round a node takes the least label among its own and its neighbours', and then its label's label, so long chains shrink by half at
    least as fast as labels meet. A node with very many links only meets partial minima.
    """
    both = stored(links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct(), "links")
    labels = stored(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")), "labels")
    while True:
        known = labels.select(F.col("node").alias("other"), "label")
        near = both.join(known, "other").groupBy("node").agg(F.min("label").alias("near"))
        moved = stored(labels.select("node", "label").join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label")), "labels")
        jump = moved.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = stored(moved.join(jump, "label", "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        done = after.where(F.col("was") != F.col("label")).isEmpty()
        release(moved, labels)
        labels = after
        if done:
            release(both)
            return labels.select("node", F.col("label").alias("component"))
