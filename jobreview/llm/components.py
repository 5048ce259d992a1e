"""Connected components of an edge table, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobreview.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of ``edges``
    (a, b; any order, repeats allowed).

    Each round every node points to the smallest of its neighbours' and its own
    pointers and then to what that one points to; minima combine before the
    shuffle, so a node with many edges is no hot spot. Rounds are written to the
    shared folder and end when nothing changes: their number grows with the
    logarithm of the longest shortest path, not with the table.
    """
    both = written(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a != b")
        .select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e"))
        .select("e.a", "e.b")
        .distinct(),
        "edges",
    )
    roots = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        seen = both.join(roots, F.col("b") == F.col("node")).select("a", "root")
        least = seen.groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = roots.join(least, "node").select("node", "root", F.least("root", "near").alias("near"))
        # What a node pointed to takes the new pointer too: whole trees move at once.
        pulled = hooked.groupBy(F.col("root").alias("node")).agg(F.min("near").alias("pull"))
        merged = hooked.join(pulled, "node", "left").select(
            "node", "root", F.least("near", F.coalesce("pull", "near")).alias("near")
        )
        merged = written(merged, "hooked")
        jump = merged.select(F.col("node").alias("at"), F.col("near").alias("far"))
        jumped = written(
            merged.join(jump, F.col("near") == F.col("at"), "left").select(
                "node", F.least("near", F.coalesce("far", "near")).alias("root"), F.col("root").alias("before")
            ),
            "roots",
        )
        changed = jumped.filter("root != before").limit(1).count()
        roots = jumped.select("node", "root")
        if not changed:
            return roots
