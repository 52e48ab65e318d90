"""Connected components of a graph held as a table of edges."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tradewind.llm.common import store


def components(edges: DataFrame) -> DataFrame:
    """``v`` and ``root``, the least vertex of its component, for edges (u, v) of strings.

    Each round a vertex takes the least label among its neighbours', then its label's own
    label, so a label travels twice as far each round. Nothing of the graph reaches the
    driver but the number of labels that changed.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    both = store(both.where("u <> v").distinct(), "edges")
    labels = both.groupBy(F.col("u").alias("v")).agg(F.min("v").alias("near"))
    labels = store(labels.select("v", F.least("v", "near").alias("root")), "labels0")
    turn = 0
    while True:
        turn += 1
        near = (
            both.join(labels, "v").groupBy(F.col("u").alias("v")).agg(F.min("root").alias("near"))
        )
        stepped = labels.join(near, "v").select("v", "root", F.least("root", "near").alias("next"))
        parents = labels.select(F.col("v").alias("next"), F.col("root").alias("above"))
        jumped = stepped.join(parents, "next").select(
            "v", "root", F.least("next", "above").alias("next")
        )
        jumped = store(jumped, f"labels{turn}")
        changed = jumped.where("next <> root").limit(1).count()
        labels = jumped.select("v", F.col("next").alias("root"))
        if not changed:
            return labels
