"""Connected components over an edge table, by minimum labels with hooking and
pointer jumping. Rounds grow with the logarithm of the longest chain; every
round is written to the shared folder, and the driver sees one count of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a long, b long), materialised -> (node, root): for every node
    of an edge, the smallest node that it reaches. Loops and repeated edges do
    no harm; no edges give no rows."""
    both = edges.select("a", "b").union(edges.select("b", "a"))
    labels = materialise(
        both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")), "cc"
    )
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).select("a", F.col("root").alias("to"))
        own = labels.select(F.col("node").alias("a"), F.col("root").alias("was"))
        seen = near.join(own, "a").filter(F.col("to") < F.col("was"))
        offers = seen.select(F.col("a").alias("node"), "to").union(
            seen.select(F.col("was").alias("node"), "to")  # the root is hooked as well
        )
        best = offers.groupBy("node").agg(F.min("to").alias("to"))
        hooked = labels.join(best, "node", "left").select(
            "node", "root", F.least("root", F.coalesce("to", "root")).alias("new")
        )
        hooked = materialise(hooked, "cc-hook")
        up = hooked.select(F.col("node").alias("new"), F.col("new").alias("over"))
        jumped = materialise(
            hooked.join(up, "new", "left").select(
                "node", F.coalesce("over", "new").alias("root"), F.col("root").alias("was")
            ),
            "cc-jump",
        )
        moved = jumped.filter(F.col("root") != F.col("was")).count()
        labels = jumped.select("node", "root")
        if not moved:
            return labels
