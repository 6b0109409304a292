"""Connected components by contraction, in joins and aggregates only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(links: DataFrame) -> DataFrame:
    """`node, root` for every node of links(a, b): root is the smallest node of its component.

    Each round every node hooks onto its smallest neighbour if that is smaller, hooks are followed
    to their ends by doubling, and the links are carried over to those ends.  The smallest node of
    a component never hooks, so it is what remains.  Rounds are few (components at least halve),
    each is checkpointed, and only counts reach the driver.  Self-links, repeated links and an
    empty table are fine; links with a null end are dropped.
    """
    edges = _tidy(links.select(F.col("a").alias("u"), F.col("b").alias("v")))
    rounds: list[DataFrame] = []
    while not (edges := cut(edges, forget=True)).isEmpty():
        hooks = cut(edges.groupBy("u").agg(F.min("v").alias("p")), forget=True)
        while True:
            up = hooks.select(F.col("u").alias("p"), F.col("p").alias("pp"))
            hooks = cut(hooks.join(up, "p", "left").select("u", F.coalesce("pp", "p").alias("p"), F.col("pp").isNotNull().alias("moved")), forget=True)
            if hooks.filter("moved").isEmpty():
                break
            hooks = hooks.select("u", "p")
        hooks = hooks.select("u", "p")
        rounds.append(hooks)
        at_u, at_v = hooks.withColumnRenamed("p", "pu"), hooks.select(F.col("u").alias("v"), F.col("p").alias("pv"))
        edges = _tidy(edges.join(at_u, "u", "left").join(at_v, "v", "left").select(F.coalesce("pu", "u").alias("u"), F.coalesce("pv", "v").alias("v")))
    if not rounds:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    found = rounds[-1]
    for hooks in reversed(rounds[:-1]):  # a node's end in an early round may have hooked later on
        later = found.select(F.col("u").alias("p"), F.col("p").alias("root"))
        found = cut(hooks.join(later, "p", "left").select("u", F.coalesce("root", "p").alias("p")).unionByName(found), forget=True)
    found = found.select(F.col("u").alias("node"), F.col("p").alias("root"))
    return found.unionByName(found.select(F.col("root").alias("node"), "root").distinct())


def _tidy(edges: DataFrame) -> DataFrame:
    """Each link once, from its larger to its smaller end."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
