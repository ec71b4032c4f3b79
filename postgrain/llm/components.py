"""Connected components of a link table, by hooking and pointer jumping over narrow tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postgrain.llm.shared import staged


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is its component's smallest node.

    Each round points every root to its smallest neighbour if that is smaller, follows the pointers
    to their ends and keeps the links between different ends. At least half of the roots that
    still have links disappear in a round. Rows with a null end are ignored.
    """
    ends = links.where("a != b").select("a", "b")
    edges = staged(ends.union(ends.select("b", "a")).distinct(), "links")
    labels = edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    while not edges.isEmpty():
        hooks = edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        ends = _ends(hooks.select("node", F.least("node", "low").alias("root")))
        labels = staged(_renamed(labels, "root", ends).distinct(), "labels")
        moved = _renamed(_renamed(edges, "a", ends), "b", ends).where("a != b").distinct()
        edges = staged(moved, "links")
    return labels


def _renamed(table: DataFrame, column: str, ends: DataFrame) -> DataFrame:
    """``table`` with the values of one column replaced by their ends."""
    map_ = ends.select(F.col("node").alias(column), F.col("root").alias("_end"))
    others = [F.coalesce("_end", column).alias(column) if c == column else F.col(c) for c in table.columns]
    return table.join(map_, column, "left").select(*others)


def _ends(pointers: DataFrame) -> DataFrame:
    """Follow (node, root) until no pointer moves; pointers never rise, so there is no cycle."""
    while True:
        pointers = staged(pointers, "pointers")
        nexts = pointers.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        jumped = pointers.join(nexts, "root", "left").select(
            "node", F.coalesce("_next", "root").alias("root"),
            (F.col("_next") < F.col("root")).alias("_moved"))
        jumped = staged(jumped, "jumped")
        pointers = jumped.select("node", "root")
        if jumped.where("_moved").isEmpty():
            return pointers
