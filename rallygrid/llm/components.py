"""Connected components of links by minima and pointer jumping, all in joins."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """Rows ``node, component`` (its smallest reachable node) for every node of ``links`` (``u, v``).

    Each round takes the smallest label among neighbours, then follows the label's own label, so chains
    shorten by half.  Rounds go through a written table; only a count of changes reaches the driver.
    """
    both = written(links.select("u", "v").union(links.select(F.col("v"), F.col("u"))).where("u <> v").distinct(), "links")
    labels = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("was"), F.least("component", "near").alias("component"))
        up = labels.select(F.col("node").alias("component"), F.col("component").alias("up"))
        nxt = written(lower.join(up, "component", "left").select("node", "was", F.least("component", F.coalesce("up", "component")).alias("component")), "labels")
        labels = nxt.drop("was")
        if nxt.where("was <> component").isEmpty():
            return labels
