"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelode.llm.steps import written


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` for every node of ``links(a, b)``; the component is its smallest node.

    Large-star and small-star steps in turn, each a minimum per node and an equi-join, so that no node's neighbours
    ever meet in one task. Every step is written and read again, which keeps the plan short and survives lost
    executors. Null ends and loops are ignored; no links give no rows.
    """
    links = written(links.where("a <> b").selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct())
    before = None
    while True:
        both = links.union(links.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(least, "u").where("v > u").selectExpr("v AS u", "m AS v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        stars = small.where("v <> m").selectExpr("v AS u", "m AS v").union(least.selectExpr("u", "m AS v")).distinct()
        links = written(stars)
        now = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == before:
            break
        before = now
    return links.selectExpr("u AS node", "v AS component").union(
        links.selectExpr("v AS node", "v AS component").distinct())
