"""Connected components of an edge table by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def components(edges: DataFrame) -> DataFrame:
    """(v, label): for each long vertex of ``edges`` (a, b) the smallest vertex it is connected with.

    Each round hooks every vertex to its smallest neighbour and contracts the graph, so rounds grow with
    the logarithm of the longest path, and hot vertices shrink in the map-side combine. Self-loops count
    as vertices; repeated edges do no harm; nulls are dropped.
    """
    edges = written(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).dropna().distinct(), "edges")
    maps = []
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = written(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")), "hooks")
        maps.append(hook)
        one = edges.join(hook.withColumnRenamed("m", "x"), "a").select("x", "b")
        two = one.join(hook.select(F.col("a").alias("b"), F.col("m").alias("y")), "b")
        edges = written(two.select(F.col("x").alias("a"), F.col("y").alias("b")).where("a <> b").distinct(), "edges")
        if edges.isEmpty():
            break
    out = maps[0].select(F.col("a").alias("v"), F.col("m").alias("label"))
    for hook in maps[1:]:
        hook = hook.select(F.col("a").alias("label"), "m")
        out = out.join(hook, "label", "left").select("v", F.coalesce("m", "label").alias("label"))
    return written(out, "components")
