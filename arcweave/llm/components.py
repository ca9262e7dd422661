"""Connected components of undirected links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.llm.common import written


def _stars(links: DataFrame) -> bool:
    """Whether each node hangs on one, and no node that others hang on hangs itself."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("n")).unionByName(links.select("b").distinct().select(F.col("b").alias("node"), F.lit(1).alias("n")))
    return ends.groupBy("node").agg(F.sum("n").alias("n")).where("n > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each end of links (a, b); the component is its smallest node.

    Each round hangs every node's larger neighbours on its smallest one, then its
    smaller ones; the rounds needed grow with the logarithm of a component's size.
    Minima are aggregated before the shuffle, and a hub's neighbours are joined
    back by a join that can be split. A round's links are written and read again.
    """
    links = written(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    while not _stars(links):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least("a", F.min("b")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a")
        small = small.where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(low.select("a", F.col("low").alias("b"))).distinct()
        links = written(small.where("a <> b"), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
