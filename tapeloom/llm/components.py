"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.session import cut_lineage


def _stars(pairs: DataFrame, larger: bool) -> DataFrame:
    """Hang the neighbours of every node on its least neighbour (or itself): the larger ones, or the others and the node."""
    both = pairs if not larger else pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("_b")).select("u", F.least("u", "_b").alias("m"))
    hung = both.join(least, F.col("a") == F.col("u"))
    if larger:
        out = hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = hung.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a > b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node; the component is its least node.

    ``links`` has long columns a and b. The neighbours of a node are never gathered: its
    least one is a grouped minimum, joined back. Rounds grow with the logarithm of the size.
    """
    pairs = cut_lineage(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
    state = None
    while True:
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        state = now
        pairs = cut_lineage(_stars(_stars(pairs, True), False))
