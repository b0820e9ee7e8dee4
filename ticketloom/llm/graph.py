"""Connected components of a link table, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ticketloom.llm.common import materialize


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root`` for every node of a link; root is the component's smallest node.

    Each round hooks every node to the smallest parent that it or a neighbour
    has, then halves all paths twice (parent of parent).  The parents are one row per
    node, written in the shared folder each round, and only counts reach the driver.
    Hubs cost what they have links: minima are taken map-side before the shuffle.
    """
    both = materialize(
        links.select(F.col(a).alias("u"), F.col(b).alias("v")).union(links.select(F.col(b), F.col(a))).filter("u != v").distinct(),
        "links",
    )
    parents = materialize(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select(
        "node", F.least("node", "m").alias("root")), "parents")
    while True:
        # smallest parent among the neighbours, offered to the node and to its present parent
        near = both.join(parents.select(F.col("node").alias("v"), F.col("root").alias("vr")), "v").groupBy("u").agg(F.min("vr").alias("m"))
        seen = parents.join(near, F.col("node") == F.col("u"), "left").select(
            "node", "root", F.least("root", F.coalesce("m", "root")).alias("low")
        )
        seen = materialize(seen, "seen")
        offers = seen.select("node", "low").union(seen.select(F.col("root").alias("node"), "low"))
        hooked = offers.groupBy("node").agg(F.min("low").alias("root"))
        for _ in range(2):
            up = hooked.select(F.col("node").alias("p"), F.col("root").alias("pr"))
            hooked = materialize(
                hooked.join(up, F.col("root") == F.col("p"), "left").select(
                    "node", F.least("root", F.coalesce("pr", "root")).alias("root")
                ),
                "parents",
            )
        moved = hooked.join(parents.select("node", F.col("root").alias("old")), "node").filter("root != old").limit(1).count()
        parents = hooked
        if not moved:
            return parents
