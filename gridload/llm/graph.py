"""Connected components of links, as DataFrame jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(links: DataFrame) -> DataFrame:
    """``(v, c)``: each linked vertex of ``links`` (a, b: long) and the smallest
    vertex of its component.

    Each round gives a vertex the smallest label around it, then the label of
    that label (which halves long chains). Minima are combined map-side, so a
    hub is no hot group; hubs as join keys are split by adaptive execution.
    Every round is written, so a lost executor costs one round."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"),
                                                           F.col("a").alias("b")))
    edges = written(both.where("a != b").distinct(), "edges")
    labels = written(edges.groupBy(F.col("a").alias("v"))
                     .agg(F.least(F.min("b"), F.col("a")).alias("c")), "labels")
    while True:
        near = (edges.join(labels, edges["b"] == labels["v"])
                .groupBy("a").agg(F.min("c").alias("_near")))
        least = (labels.join(near, labels["v"] == near["a"])
                 .select("v", F.least("c", "_near").alias("n"), F.col("c").alias("old")))
        least = written(least, "labels-near")
        of = least.select(F.col("v").alias("_v"), F.col("n").alias("_n"))
        jumped = (least.join(of, least["n"] == of["_v"])
                  .select("v", F.least("n", "_n").alias("c"), "old"))
        jumped = written(jumped, "labels")
        changed = jumped.where("c != old").agg(F.count(F.lit(1)).alias("n")).collect()[0]["n"]
        labels = jumped.select("v", "c")
        if not changed:
            return labels
