"""Connected components of a table of links, by the smallest label: joins and minima only, written out each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import look_up, settle


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node of the links; a component's name is its smallest node.

    Each link is turned so that it leads from a node to a smaller one, its centre. A node belongs where its least centre
    belongs, so only the centres go through rounds, with one edge between the least centre of a node and each other one:
    the edges are as many as pairs of centres that share a node, not as links. Repeated links and loops are harmless; no
    links give no rows."""
    x, y = F.col(a), F.col(b)
    links = settle(links.where(x != y).select(F.greatest(x, y).alias("node"), F.least(x, y).alias("centre")).distinct())
    least = links.groupBy("node").agg(F.min("centre").alias("least"))
    centres = links.select("centre").distinct()
    between = links.join(least, "node").where("centre <> least").select("centre", "least")
    within = least.join(centres.withColumnRenamed("centre", "node"), "node", "left_semi").select(F.col("node").alias("centre"), "least")
    labels = among_centres(settle(between.unionByName(within).distinct()))
    whole = centres.withColumnRenamed("centre", "node").join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    named = look_up(least, "least", "node", labels.withColumnRenamed("node", "least"))
    return whole.unionByName(named.select("node", F.coalesce("component", "least").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))


def among_centres(edges: DataFrame) -> DataFrame:
    """(node, component) of the ends of settled edges (centre, least).

    Each round a node takes the smallest label next to it, then the label of its label, so labels run along a path in a
    logarithmic number of rounds; edges within one label are settled and dropped."""
    both = edges.select(F.col("centre").alias("from"), F.col("least").alias("to"))
    both = both.unionByName(both.select(F.col("to").alias("from"), F.col("from").alias("to"))).distinct()
    labels = both.groupBy("from").agg(F.min("to").alias("next")).select(F.col("from").alias("node"), F.least("from", "next").alias("component"))
    if not edges.limit(1).count():
        return labels
    both, labels = settle(both), settle(labels)
    while True:
        own = labels.select(F.col("node").alias("from"), F.col("component").alias("own"))
        near = labels.select(F.col("node").alias("to"), F.col("component").alias("near"))
        open_ = settle(both.join(own, "from").join(near, "to").where("own <> near"))
        if not open_.limit(1).count():
            return labels
        lower = open_.groupBy(F.col("own").alias("component")).agg(F.min("near").alias("near"))
        lower = settle(lower.select("component", F.least("component", "near").alias("low")))
        jump = lower.select(F.col("component").alias("low"), F.col("low").alias("far"))
        after = lower.join(jump, "low", "left").select("component", F.coalesce("far", "low").alias("low"))
        labels = settle(look_up(labels, "component", "node", after).select("node", F.coalesce("low", "component").alias("component")))
        both = open_.select("from", "to")
