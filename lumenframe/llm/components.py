"""Connected components of an edge table by min-hooking and contraction, all on tables.

Each round every node hooks to its smallest neighbour, pointers are doubled, and the edges are
rewritten between the roots, so at least half of the nodes that still have edges go each round.
Group minima combine on the map side; joins on a hub are ordinary sort-merge joins that adaptive
execution can split. Nothing is collected but whether edges are left; tables of past rounds are deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm.common import discard, materialize


def connected(edges: DataFrame) -> DataFrame:
    """edges: u, v (one comparable type). Returns node, root (the smallest node reachable) for nodes with edges."""
    left = materialize(edges.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    labels, spent = None, None  # spent: the written labels of the round before
    while not left.isEmpty():
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p"))
        parent = hooked = materialize(parent, "parents")
        for _ in range(2):
            upper = parent.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            parent = parent.join(upper, "p", "left").select("u", F.coalesce("pp", "p").alias("p"))
        parent = materialize(parent, "parents")
        discard(hooked)
        old = [left]
        if labels is None:
            labels = parent.select(F.col("u").alias("node"), F.col("p").alias("root"))
        else:
            step = parent.select(F.col("u").alias("root"), F.col("p").alias("next"))
            labels = labels.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
            labels = materialize(labels, "labels")
            old.append(parent)
            old += [spent] if spent is not None else []
            spent = labels
        to_u = parent.select("u", F.col("p").alias("pu"))
        to_v = parent.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        left = materialize(
            left.join(to_u, "u").join(to_v, "v").where("pu <> pv").select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct(), "edges"
        )
        discard(*old)
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
    return labels
