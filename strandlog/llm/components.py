"""Connected components of a graph that is given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlog.llm.common import durable


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """id, label: the least id of the component, for every id in a link (bigint columns a and b).

    Each round gives every vertex the least label among its neighbours and then follows labels of labels, until no
    label changes. Labels and links stay distributed; each round is written to the checkpoint folder.
    """
    pairs = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = durable(pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = durable(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("near")).select("id", F.least("id", "near").alias("label")))
    while True:
        seen = both.join(labels.select(F.col("id").alias("v"), "label"), "v").groupBy(F.col("u").alias("id")).agg(F.min("label").alias("near"))
        stepped = labels.join(seen, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        stepped = durable(stepped)
        over = stepped.select(F.col("id").alias("label"), F.col("label").alias("next"))
        jumped = durable(stepped.join(over, "label", "left").select("id", "old", F.least("label", "next").alias("label")))
        labels = jumped.select("id", "label")
        if jumped.where("label <> old").isEmpty():
            return labels
