"""Connected components of an edge table, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has an edge to another one; root is a node of its component.

    Each round every node points to the smallest of itself and its neighbours, pointers are
    followed once more, and edges are renamed to what their ends point to; loops and doubles go. The
    edges shrink until none is left. A hub's edges are reduced before the shuffle and its
    partition in a join can be split. Nothing but the count of edges reaches the driver.
    Null ends are left out.
    """
    live = stage(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "cc-edges")
    whole, old_names = None, []
    while not live.isEmpty():
        ends = live.select(F.col("a").alias("node"), F.col("b").alias("next")).union(live.select("b", "a"))
        low = stage(ends.groupBy("node").agg(F.min("next").alias("next")).select("node", F.least("node", "next").alias("up")), "cc-low")
        up = low.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        near, low = low, stage(low.join(up, "up").select("node", F.col("upper").alias("up")), "cc-up")
        drop_staged(near)
        old_names.append(low)
        pa, pb = low.select(F.col("node").alias("a"), F.col("up").alias("pa")), low.select(F.col("node").alias("b"), F.col("up").alias("pb"))
        named = live.join(pa, "a").join(pb, "b").where("pa <> pb").select(F.least("pa", "pb").alias("a"), F.greatest("pa", "pb").alias("b"))
        old, live = live, stage(named.distinct(), "cc-edges")
        drop_staged(old)
        if whole is None:
            whole = low.select("node", F.col("up").alias("root"))
        else:
            step = low.select(F.col("node").alias("root"), F.col("up").alias("next"))
            whole = whole.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
    if whole is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = stage(whole, "cc-roots")
    drop_staged(live, *old_names)
    return out
