"""Connected components of a link table, as Spark joins over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def components(links: DataFrame) -> DataFrame:
    """``(id, class_id)`` for every id in ``links`` (columns ``a``, ``b``): the
    smallest id that it is linked to, directly or by others.

    Every round each id takes the smallest label among its neighbours (a
    partial aggregate before the shuffle, so a hub costs no more than its
    links), then the label of its label; labels are written to the shared folder
    after each round, which ends the lineage.  It stops when no label changes."""
    both = materialise(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("label"), F.lit(True).alias("moved")), "labels")
    while True:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, labels.id == near.a, "left").select("id", "label", F.least("label", "near").alias("low"))
        jump = labels.select(F.col("id").alias("at"), F.col("label").alias("far"))
        new = lower.join(jump, lower.low == jump["at"], "left")
        new = new.select("id", F.least("low", "far").alias("label"), (F.least("low", "far") < F.col("label")).alias("moved"))
        labels = materialise(new, "labels")
        if labels.where("moved").isEmpty():
            return labels.select("id", F.col("label").alias("class_id"))
