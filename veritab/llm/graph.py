"""Connected components of an edge table by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(v, root): the smallest node that each node of `edges` (a, b) reaches.

    Each round hooks a node and its parent under the smallest grandparent of its
    neighbours and shortens all paths.  Messages to a node are minima, combined
    before they are shuffled, so a node with very many links is no hot group.
    Rounds are written to the shared checkpoint folder; nothing reaches the driver
    but one count a round.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("low")).select("v", F.least("v", "low").alias("root")), "roots")
    while True:
        parent = labels.select(F.col("v").alias("root"), F.col("root").alias("top"))
        high = labels.join(parent, "root").select("v", "root", "top")
        heard = both.join(high.select(F.col("v").alias("b"), "top"), "b").groupBy(F.col("a").alias("v")).agg(F.min("top").alias("heard"))
        told = high.join(heard, "v").select(
            F.explode(F.array(F.struct("v", F.least("top", "heard").alias("to")), F.struct(F.col("root").alias("v"), F.col("heard").alias("to")))).alias("m")
        )
        fresh = told.groupBy("m.v").agg(F.min("m.to").alias("to"))
        step = stored(
            labels.join(fresh, "v").select("v", F.least("root", "to").alias("root"), (F.least("root", "to") != F.col("root")).alias("moved")),
            "roots",
        )
        labels = step.select("v", "root")
        if step.where("moved").limit(1).count() == 0:
            return labels
