"""Connected components of an edge table, by contraction in shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscan.llm.common import dealt_join
from folioscan.workspace import persist_table


def components(edges: DataFrame) -> DataFrame:
    """(a, b) to (node, root), the root being the least node of the component.

    Each round hangs every node below the least of its neighbours, goes one step
    further up, and replaces edges by edges between those parents; rounds are
    few, as long chains shrink by a factor each time. The nodes below one parent
    are dealt over several tasks where they meet it. Edges and parents are
    written after each round; nothing but a row comes to the driver.
    """
    edges = persist_table(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    while edges.take(1):
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        up = both.groupBy("node").agg(F.min("other").alias("up")).select("node", F.least("node", "up").alias("up"))
        up = persist_table(up, "parents")
        far = persist_table(dealt_join(up, up.select(F.col("node").alias("up"), F.col("up").alias("far")), ["up"], ["node"]).select("node", F.col("far").alias("root")), "grandparents")
        if found is None:
            found = far
        else:
            higher = far.select(F.col("node").alias("root"), F.col("root").alias("higher"))
            found = persist_table(dealt_join(found, higher, ["root"], ["node"], "left").select("node", F.coalesce("higher", "root").alias("root")), "roots")
        a = far.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = far.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = dealt_join(dealt_join(edges, a, ["a"], ["b"]), b, ["b"], ["a"]).where("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges = persist_table(moved, "edges")
    if found is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return found
