"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weir.llm.common import saved, small


def components(links: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(node, comp) of every node of the links (a, b): the smallest node reachable.

    Each step takes the least label of a node and its neighbours and then the label of that label, so that long chains shrink
    by halves. `labels` are those of an earlier call over a part of the links. A step shuffles the links once; labels are sent
    to all tasks only if they were counted and are few. No component is gathered anywhere.
    """
    both = saved(links.select("a", "b").union(links.select("b", "a")), "links")
    if labels is None:
        now = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("comp"))
    else:
        new = both.select(F.col("a").alias("node")).distinct().join(small(labels), "node", "left_anti")
        now = labels.union(new.select("node", F.col("node").alias("comp")))
    now = saved(now, "labels")
    while True:
        known = small(now)
        near = both.join(known, F.col("b") == F.col("node")).select(F.col("a").alias("node"), "comp", F.lit(None).cast("long").alias("old"))
        least = near.union(now.select("node", "comp", F.col("comp").alias("old"))).groupBy("node").agg(
            F.min("comp").alias("least"), F.max("old").alias("old"))
        # labels are nodes: the old label of the new label is reachable too
        jump = known.select(F.col("node").alias("least"), F.col("comp").alias("root"))
        step = saved(least.join(jump, "least").select(
            "node", F.least("least", "root").alias("comp"), (F.least("least", "root") != F.col("old")).alias("moved")), "labels")
        now = step.select("node", "comp")
        if not step.filter("moved").limit(1).count():
            return now
