"""Connected components of a graph given as a table of links, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltbed.llm.common import scratch, written


def components(links: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) of all nodes that links (a, b) name.

    Each round every node, and the node its label names, takes the least label of its neighbours, and then its label's
    label, so that labels travel twice as far each round. Labels only fall; when their sum stands still, they are final.
    Null ends are no links; links may repeat or go from a node to itself.
    """
    with scratch(links.sparkSession):
        return written(_components(links), "components", outer=True)


def _components(links: DataFrame) -> DataFrame:
    links = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null")
    both = written(links.union(links.select("b", "a")).distinct(), "links")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("a"), F.min("b")).alias("label")), "labels")
    total = lambda df: df.agg(F.sum(F.col("label").cast("decimal(38,0)")).alias("s")).first().s
    before = total(labels)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("least"))
        told = near.join(labels, near["n"] == labels["node"]).select(F.explode(F.array(F.struct("node", F.col("least").alias("label")), F.struct(F.col("label").alias("node"), F.col("least").alias("label")))).alias("x")).select("x.*")
        now = told.unionByName(labels).groupBy("node").agg(F.min("label").alias("label"))
        now = written(now, "labels")
        up = now.select(F.col("node").alias("up"), F.col("label").alias("higher"))
        labels = written(now.join(up, now["label"] == up["up"], "left").select("node", F.least("label", "higher").alias("label")), "labels")
        after = total(labels)
        if after == before:
            return labels.select("node", F.col("label").alias("component"))
        before = after
