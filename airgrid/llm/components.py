"""Connected components of a graph held in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """node, label (the smallest node that it is linked with, over any number of links) for all ends of ``links`` (a, b).

    Every round, each node takes the smallest label next to it and then the label of
    that label, so that the distance covered doubles; rounds end when no label changes.
    Links and labels stay in the shared folder; only a count comes to the driver.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).where("a <> b").distinct(), "links")
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("l")), "b").groupBy(F.col("a").alias("node")).agg(F.min("l").alias("l"))
        took = labels.join(near, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "l").alias("via"))
        jump = labels.select(F.col("node").alias("via"), F.col("label").alias("far"))
        new = stored(took.join(jump, "via", "left").select("node", F.least("via", "far").alias("label"), "old"), "labels")
        changed = new.where("label <> old").limit(1).count()
        labels = new.select("node", "label")
        if not changed:
            return labels
