"""Connected components of a link table by joins and aggregations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textprep.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; root is the smallest node reachable.

    Each round hooks every root to its smallest neighbouring root, follows the hooks to their ends,
    and contracts the links to links between the new roots.  Hooks lead to smaller nodes only, so
    they form no cycle, and every root that has a smaller neighbour goes away: the rounds are about
    logarithmic in the longest chain.  The links shrink each round; a node with very many links is
    only ever a key of aggregations that combine before the shuffle and of equi-joins whose hot
    partitions AQE splits.  Rounds are cut by tables in the shared folder."""
    links = stored(_canonical(edges), "links")
    nodes = links.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    forest = stored(nodes.select("node", F.col("node").alias("root")), "forest")
    while not links.isEmpty():
        hooks = (
            links.select("a", "b")
            .unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
            .groupBy(F.col("a").alias("at"))
            .agg(F.min("b").alias("low"))
            .select("at", F.least("at", "low").alias("to"))
        )
        hooks = _ends(stored(hooks, "hooks"))
        forest = stored(
            forest.join(hooks, forest["root"] == hooks["at"], "left").select("node", F.coalesce("to", "root").alias("root")),
            "forest",
        )
        first, second = hooks.toDF("a", "a_to"), hooks.toDF("b", "b_to")
        links = links.join(first, "a").join(second, "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        links = stored(_canonical(links), "links")
    return forest


def _canonical(edges: DataFrame) -> DataFrame:
    return edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _ends(hooks: DataFrame) -> DataFrame:
    """Replace each target by the end of its chain (the length of the chains halves each time)."""
    while True:
        nxt = hooks.toDF("mid", "end")
        longer = stored(
            hooks.join(nxt, hooks["to"] == nxt["mid"], "left").select(
                "at", F.coalesce("end", "to").alias("to"), (F.coalesce("end", "to") < F.col("to")).alias("moved")
            ),
            "hooks",
        )
        hooks = longer.select("at", "to")
        if longer.where("moved").isEmpty():
            return hooks
