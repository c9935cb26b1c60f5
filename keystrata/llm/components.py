"""Connected components by hooking and contraction, on DataFrames all the way."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(v, root) for every vertex of ``edges(a, b)``; root is the smallest vertex it reaches.

    In a round each vertex that has a smaller neighbour hooks to the smallest
    one, pointers are doubled until they reach the roots, and the edges are
    rewritten to the roots of their ends; those inside a tree vanish. The minimum
    is combined before the shuffle, so a vertex with very many edges doesn't
    burden one task. A tree of depth d takes log d doublings, and each round
    leaves half of the vertices at most. Only counts reach the driver.
    """
    live = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    label: DataFrame | None = None
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        hook = live.groupBy(F.col("b").alias("v")).agg(F.min("a").alias("p"))
        for _ in range(max_rounds):
            up = hook.select(F.col("v").alias("p"), F.col("p").alias("pp"))
            hook = durable(hook.join(up, "p", "left").select("v", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")))
            if hook.where("moved").isEmpty():
                break
        hook = hook.drop("moved")
        if label is None:
            label = hook.withColumnRenamed("p", "root")
        else:
            # Roots that hook now were vertices of live edges only; the rest keep their label.
            moved = label.join(hook.select(F.col("v").alias("root"), F.col("p").alias("p")), "root", "left").select("v", F.coalesce("p", "root").alias("root"))
            label = moved.unionByName(hook.withColumnRenamed("p", "root").join(label, "v", "left_anti"))
        a, b = hook.select(F.col("v").alias("a"), F.col("p").alias("pa")), hook.select(F.col("v").alias("b"), F.col("p").alias("pb"))
        ends = live.join(b, "b", "left").join(a, "a", "left").select(F.coalesce("pa", "a").alias("x"), F.coalesce("pb", "b").alias("y"))
        live = durable(ends.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct())
        label = durable(label)
    else:
        raise RuntimeError("components did not settle")
    if label is None:
        return live.select(F.col("b").alias("v"), F.col("a").alias("root"))
    return label
