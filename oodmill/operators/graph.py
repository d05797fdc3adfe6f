"""Connected components by alternating star contraction; no group or link list ever meets in one task."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oodmill.session import cut, merged


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Union-find over the links of one batch after another: each node linked to its root in the batch."""
    for batch in batches:
        root: dict = {}

        def find(x):
            top = x
            while (up := root.setdefault(top, top)) != top:
                top = up
            while root[x] != top:
                root[x], x = top, root[x]
            return top

        for a, b in zip(batch["u"].tolist(), batch["v"].tolist(), strict=True):
            ra, rb = find(a), find(b)
            if ra != rb:
                root[max(ra, rb)] = min(ra, rb)
        nodes = [x for x in root if find(x) != x]
        yield pd.DataFrame({"u": nodes, "v": [find(x) for x in nodes]}).astype(batch.dtypes[["u", "v"]])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.join(merged(least), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(merged(least), "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _settled(links: DataFrame) -> bool:
    """Whether every node has one parent and no parent has one: then the links are stars, and the stars the groups."""
    role = links.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(links.select("v", F.lit(0), F.lit(1)))
    nodes = role.groupBy("node").agg(F.sum("child").alias("c"), F.max("parent").alias("p"))
    return nodes.where("c > 1 or (c > 0 and p > 0)").isEmpty()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of the undirected links; component is the least node of the group.

    Nodes keep their type where both ends are whole numbers (cheapest), else they are texts. NULL ends and loops are
    ignored unless the loop is all a node has (it is then a group of one). An empty table gives an empty result.
    Rounds of large-star and small-star contraction run until all groups are stars; each round is checkpointed, minima
    are pre-aggregated before their shuffle and hot nodes are left to AQE's skew join.
    """
    kinds = {edges.schema[c].dataType.simpleString() for c in (u, v)}
    kind = "bigint" if kinds <= {"bigint", "int"} else "string"
    pairs = edges.select(F.col(u).cast(kind).alias("u"), F.col(v).cast(kind).alias("v")).where("u is not null and v is not null")
    alone = pairs.where("u = v").select("u").distinct()
    links = cut(pairs.where("u <> v").mapInPandas(_forest, f"u {kind}, v {kind}").distinct())
    for _ in range(max_rounds):
        if _settled(links):
            break
        links = cut(_small_star(_large_star(links)))
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("v").alias("node")).union(alone.select(F.col("u").alias("node"))).distinct()
    children = links.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return children.unionByName(roots.join(merged(children), "node", "left_anti").select("node", F.col("node").alias("component")))
