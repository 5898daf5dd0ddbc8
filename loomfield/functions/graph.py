"""Connected components of a graph of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomfield.functions.common import Tables


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked with its smallest, itself included."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), "u").alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours are linked with the smallest of them."""
    least = links.groupBy("u").agg(F.min("v").alias("m"))
    others = links.join(least, "u").where(F.col("v") > F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(links: DataFrame, tables: Tables) -> DataFrame:
    """node, component (its smallest node) of every node of the links (a, b), by stars that contract (Kiveris et al., 2014).

    Nodes are of any type that has an order. No node's neighbours are gathered: each turn is a partial minimum and a join, which
    adaptive execution splits where a node has many neighbours. Turns grow with the logarithm of the nodes. A loop, a null
    end and a repeated link change nothing; a node without a link to another isn't returned.
    """
    links = links.select("a", F.col("b").cast(links.schema["a"].dataType).alias("b"))
    at = tables.write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links-0")
    turn, seen = 0, None
    while True:
        now = at.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return at.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        turn, seen = turn + 1, now
        at = tables.write(_small_star(_large_star(at)), f"links-{turn}")
        tables.drop(f"links-{turn - 1}")
