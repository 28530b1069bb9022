"""Parts of a graph that no edge connects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from civiltext.operators.joins import spread_join
from civiltext.session import cut_lineage


def connected_parts(edges: DataFrame) -> tuple[DataFrame, int]:
    """`(node, part)` for the nodes of `edges (a, b)`, a part being named by its smallest node, and the rounds it took.

    In a round every node hands its larger neighbours on to the smallest node it knows, then its smaller ones and itself
    to the smallest of these. Neighbourhoods shrink to a star around the smallest node, in about as many rounds as the
    longest path has binary digits. Only minima are taken per node, and the edges of a node of very many are not
    brought together.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low"))
    links, state, rounds = cut_lineage(pairs.distinct()), None, 0
    while True:
        rounds += 1
        both = links.unionByName(links.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("node", "other")
        least = both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("least"), F.count("*").alias("n_rows"))
        above = spread_join(both, least, "node").filter("other > node").select(F.col("other").alias("high"), F.col("least").alias("low"))
        above = cut_lineage(above.filter("high <> low").distinct())
        least = above.groupBy("high").agg(F.min("low").alias("least"), F.count("*").alias("n_rows"))
        below = spread_join(above, least, "high").select(F.col("low").alias("high"), F.col("least").alias("low"))
        below = below.unionByName(least.select("high", F.col("least").alias("low"))).filter("high <> low")
        links = cut_lineage(below.distinct())
        seen = links.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    nodes = links.select(F.col("high").alias("node"), F.col("low").alias("part"))
    return nodes.unionByName(links.select(F.col("low").alias("node"), F.col("low").alias("part")).distinct()), rounds
