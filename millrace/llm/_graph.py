"""Connected components of a table of links, by rounds of contraction in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._store import saved


def components(links: DataFrame) -> DataFrame:
    """links has columns a and b; the result has node and root, the smallest node that links reach, for each node of a link.

    A round hooks each node to its smallest neighbour, shortcuts that once and renames the links by it. The smallest node of
    a component never moves, and every other one does while it has a link, so each component shrinks to its smallest node.
    """
    edges, rounds = saved(links.where("a <> b").distinct(), "links"), []
    while edges.limit(1).count():
        both = edges.union(edges.select("b", "a"))
        hooked = saved(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("p")), "hooks")
        up = hooked.select(F.col("a").alias("p"), F.col("p").alias("pp"))
        parents = saved(hooked.join(up, "p", "left").select("a", F.coalesce("pp", "p").alias("p")), "parents")
        rounds.append(parents)
        pa, pb = parents.withColumnRenamed("p", "pa"), parents.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        edges = saved(edges.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "links")
    if not rounds:
        return links.select(F.col("a").alias("node"), F.col("a").alias("root")).where("false")
    out = rounds[0].select(F.col("a").alias("node"), F.col("p").alias("root"))
    for parents in rounds[1:]:
        out = out.join(parents.withColumnRenamed("a", "root"), "root", "left").select("node", F.coalesce("p", "root").alias("root"))
    return saved(out, "components")
