"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import cut


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``label`` (the smallest node that can be reached) for every node of a link.

    Each round every node takes the smallest label next to it and then that label's own label, so a path shortens by more
    than half. State and links are written tables: joins read both sides afresh, and hot nodes can be split or broadcast.
    """
    pairs = links.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y")
    both = cut(pairs.unionAll(pairs.select("y", "x")).distinct(), "links")
    labels = cut(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("node"), F.least("x", "m").alias("label")), "labels")
    while True:
        others = labels.select(F.col("node").alias("y"), F.col("label").alias("l"))
        near = both.join(others, "y").groupBy("x").agg(F.min("l").alias("m"))
        hooked = labels.join(near, labels.node == near.x, "left").select("node", "label", F.least("label", "m").alias("mid"))
        jump = labels.select(F.col("node").alias("mid"), F.col("label").alias("next"))
        moved = hooked.join(jump, "mid").select("node", F.least("mid", "next").alias("label"), (F.least("mid", "next") < F.col("label")).alias("changed"))
        state = cut(moved, "labels")
        labels = state.select("node", "label")
        if state.filter("changed").isEmpty():
            return labels
