"""Groups of records linked directly or through others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.session import cut


def star_edges(members: DataFrame, node: str, key: str) -> DataFrame:
    """(u, v) with v < u: each node of a key tied to the key's smallest node, one edge per membership.

    A key shared by n nodes costs n - 1 edges, never n squared. The smallest node comes from a partial aggregation;
    the join back has one row per key on its right, so a hot key is split on the left by adaptive execution.
    """
    keyed = members.filter(F.col(key).isNotNull() & F.col(node).isNotNull()).select(F.col(node).alias("u"), F.col(key).alias("k"))
    least = keyed.groupBy("k").agg(F.min("u").alias("v"), F.max("u").alias("top")).filter("v < top").select("k", "v")
    return keyed.join(least, "k").filter("v < u").select("u", "v").distinct()


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, group): the smallest node of the component of every node that occurs in ``edges`` (u, v).

    Each round every node takes the smallest label in its closed neighbourhood, two pointer jumps follow the labels
    taken in the same round, and the edges are rewritten between the labels. A rewritten graph has at most half
    the nodes of each component that is not yet one node, so the rounds grow with the logarithm of the longest component and
    the shuffles shrink from round to round. Every round is checkpointed to shared storage; only counts reach the
    driver. Loops and repeated edges do no harm; null ends are left out; an empty table gives an empty result.
    """
    graph = cut(edges.filter("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    steps: list[DataFrame] = []
    for _ in range(max_rounds):
        if graph.isEmpty():
            break
        near = graph.unionByName(graph.select(F.col("v").alias("u"), F.col("u").alias("v")))
        label = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("to"))
        for _ in range(2):
            hop = label.select(F.col("node").alias("to"), F.col("to").alias("next"))
            label = label.join(hop, "to").select("node", F.col("next").alias("to"))
        label = cut(label)
        steps.append(label)
        left = label.select(F.col("node").alias("u"), F.col("to").alias("a"))
        right = label.select(F.col("node").alias("v"), F.col("to").alias("b"))
        graph = cut(
            graph.join(left, "u").join(right, "v").filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        )
    else:
        raise RuntimeError(f"labels still change after {max_rounds} rounds")
    if not steps:
        return graph.select(F.col("u").alias("node"), F.col("v").alias("group"))
    groups = steps[-1].select("node", F.col("to").alias("group"))
    for step in reversed(steps[:-1]):
        later = groups.select(F.col("node").alias("to"), "group")
        groups = step.join(later, "to", "left").select("node", F.coalesce("group", "to").alias("group"))
    return groups
