"""Connected components of a table of links, by least labels and pointer jumping over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the least node reachable. No node is collected.

    Each round a node takes the least label among itself, its neighbours and its label's own label, so long chains
    shrink by halves. Neighbour minima are summed per node before the shuffle, so a node with many links is no hot spot.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    label = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("component"))
    label = last = stored(label, "labels")
    while True:
        near = both.join(label.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("component").alias("m"))
        new = label.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("component").alias("old"), F.least("component", "m").alias("p"))
        up = label.select(F.col("node").alias("p"), F.col("component").alias("pp"))
        new = stored(new.join(up, "p", "left").select("node", "old", F.least("p", "pp").alias("component")), "labels")
        done = new.filter("component <> old").isEmpty()
        discard(last)
        label, last = new.select("node", "component"), new
        if done:
            discard(both)
            return label
