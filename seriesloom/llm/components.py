"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.storage import written_table


def connected_components(links: DataFrame) -> DataFrame:
    """``id, component``: the smallest id reachable by ``links`` (a, b), for every id in them.

    Each round takes the smallest label among the neighbours and then follows labels of labels, so
    that the number of rounds grows with the logarithm of long chains. Labels are stored each round.
    """
    links = links.where("a <> b")
    both = written_table(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = written_table(both.groupBy(F.col("a").alias("id")).agg(
        F.least(F.min("b"), F.min("a")).alias("component")))
    while True:
        near = both.join(labels.select(F.col("id").alias("b"), "component"), "b")
        near = near.groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "id").select("id", "component", F.least("component", "near").alias("lower"))
        jump = lower.select(F.col("id").alias("lower"), F.col("lower").alias("target"))
        nearer = written_table(lower.join(jump, "lower").select(
            "id", F.col("target").alias("component"), (F.col("target") != F.col("component")).alias("changed")))
        labels = nearer.select("id", "component")
        if nearer.where("changed").isEmpty():
            return labels
