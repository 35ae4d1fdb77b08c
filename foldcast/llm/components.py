"""Connected components of an edge table, by rounds of least labels and label jumps; every round is a stored table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from foldcast.llm.shared import measured, stored


def components(edges: DataFrame) -> DataFrame:
    """(v, label) of every vertex in ``edges`` (a, b): the least vertex it can reach."""
    both = stored(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a != b").distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("v")).groupBy("a").agg(F.min("label").alias("near"))
        met = labels.join(near, F.col("v") == F.col("a")).select("v", "label", F.least("label", "near").alias("low"))
        target = labels.select(F.col("v").alias("t"), F.col("label").alias("jump"))
        moved = met.join(target, F.col("low") == F.col("t")).select("v", F.least("low", "jump").alias("label"), (F.least("low", "jump") != F.col("label")).alias("changed"))
        moved, seen = measured(moved, "labels", changed=F.count_if("changed"))
        labels = moved.select("v", "label")
        if not seen["changed"]:
            return labels
