"""Connected components of a graph given as pairs, by alternating star contractions on scratch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_scratch, few_files, scratch


def _with_least(pairs: DataFrame) -> DataFrame:
    """Pairs (u, v) and m, the least of u and all its v.

    Minima are combined before they are shuffled. The join holds one row a node; the pairs of a node that has very many
    stream past it, and AQE splits them once they exceed a partition's size."""
    return pairs.join(pairs.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m")), "u")


def components(pairs: DataFrame) -> DataFrame:
    """pairs: u, v long. Returns u, m: each node that has a link to another, and the least node of its component.

    Each round links every node's larger neighbours, then its smaller ones, to the least of them; the number of pairs
    does not grow, and rounds number the logarithm of the longest path or so; they end when the pairs are stars. Repeated pairs
    and pairs of a node with itself count once or not at all; without pairs there is no row.
    """
    links = pairs.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = scratch(few_files(links, pairs.count()), "links")
    while not _are_stars(links):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        # u > v in every pair: all neighbours are smaller ones
        small = _with_least(large).select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("p"))
        new = scratch(few_files(small.select("p.*").filter("u <> v").distinct(), links.count()), "links")
        drop_scratch(links)
        links = new
    return _stars(links)


def _are_stars(links: DataFrame) -> bool:
    """Whether every u is in one pair and is no other pair's v: as u > v, each v is the least node of its component then."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("ups")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("ups")))
    each = ends.groupBy("node").agg(F.sum("ups").alias("ups"), F.min("ups").alias("least"))
    return not each.filter("ups > 1 or ups = 1 and least = 0").agg(F.count(F.lit(1))).first()[0]


def _stars(links: DataFrame) -> DataFrame:
    """links: u to the least node of its component."""
    return links.select("u", F.col("v").alias("m")).unionByName(links.select(F.col("v").alias("u"), F.col("v").alias("m"))).distinct()
