"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round is two aggregations and two joins on the edges, whose number never grows; nothing is gathered in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metrelle.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of its component for every node that has an edge (a, b) to another; a null end drops the edge."""
    now = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a <> b").distinct())
    state = _state(now)
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(both.groupBy("u").agg(F.least("u", F.min("v")).alias("m")))  # written, so that a hub's join can be split
        star = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        star = cut(star)
        least = cut(star.groupBy("u").agg(F.min("v").alias("m")))
        then = star.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.toDF("u", "v"))
        now, before = cut(then.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()), state
        state = _state(now)
        if state == before:
            return now.toDF("node", "root")
