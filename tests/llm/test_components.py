from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandwork.llm.components import connected_components, star_edges


def brute(edges):
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up if any(x in e for e in edges if e[0] != e[1] and None not in e)}


def components(spark, edges):
    return {r["node"]: r["group"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    random.seed(seed)
    edges = [(random.randint(0, 150), random.randint(0, 150)) for _ in range(90)]
    assert components(spark, edges) == brute(edges)


def test_long_chain_star_and_oddities(spark):
    chain = list(range(400))
    random.seed(1)
    random.shuffle(chain)
    edges = [(a, b) for a, b in zip(chain, chain[1:])] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (None, 3), (1000, 1001)]
    got = components(spark, edges)
    assert all(got[i] == 0 for i in range(400)) and all(got[1000 + i] == 1000 for i in range(300)) and 5000 not in got


def test_empty(spark):
    assert components(spark, []) == {}


def test_star_edges_stay_linear(spark):
    members = spark.range(3000).select(F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 900).cast("string"))).alias("key"), F.lit(1).alias("u"))
    assert star_edges(members, "row", "key").count() < 3000
    none = members.withColumn("key", F.lit(None).cast("string"))
    assert star_edges(none, "row", "key").count() == 0
