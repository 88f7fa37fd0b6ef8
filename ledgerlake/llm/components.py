"""Connected components by repeated minimum labels; nothing is collected to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stage import drop, stage


def components(links: DataFrame) -> DataFrame:
    """(node, comp) for every node of the undirected links (a, b).

    ``comp`` is the smallest node of the component. A round takes the smallest
    label among a node and its neighbours, then follows that label once more
    (pointer jumping), so stars end after one round and long chains after a
    logarithmic number. Minima are combined before the shuffle, so a node with
    very many links costs its task no more rows than there are tasks.
    """
    both = stage(links.select("a", F.col("b").alias("far")).union(links.select(F.col("b"), F.col("a"))), "links")
    label = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("far"), F.first("a")).alias("comp")), "comp")
    while True:
        near = (both.join(label.select(F.col("node").alias("far"), "comp"), "far")
                .groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near")))
        step = label.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        up = label.select(F.col("node").alias("low"), F.col("comp").alias("up"))
        new = stage(step.join(up, "low").select("node", F.col("comp").alias("was"), F.least("low", "up").alias("comp")), "comp")
        moved = new.where(F.col("was") != F.col("comp")).limit(1).count()
        drop(label)
        label = new
        if not moved:
            drop(both)
            out = new.select("node", "comp")
            out.staged_path = new.staged_path
            return out
