"""Connected components of an edge table by repeated contraction.

Every round each vertex points to its smallest neighbour (or itself), edges are redrawn between
the vertices pointed to, and loops go.  Rounds end when no edge is left; their number grows with
the logarithm of the longest chain of falling ids, not with the component sizes.  A round is
aggregations with map-side minima and joins against unique keys, which Spark may split where a
vertex has many edges.  Every round's tables are written to the shared folder, which cuts the
lineage and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskweave.session import staged


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every vertex of ``edges``; a root stands for its whole component.

    Loops and repeated edges are harmless, rows with a null end are ignored, no edges give no rows.
    """
    x, y = F.col(a), F.col(b)
    known = edges.where(x.isNotNull() & y.isNotNull())
    both = staged(
        known.select(F.least(x, y).alias("u"), F.greatest(x, y).alias("v")).distinct(), "edges"
    )
    nodes = both.select(F.col("u").alias("node")).union(both.select("v")).distinct()
    found = nodes.select("node", F.col("node").alias("root"))
    live = both.where("u <> v")
    while not live.isEmpty():
        ends = live.select(F.col("u").alias("at"), F.col("v").alias("to")).union(
            live.select("v", "u")
        )
        step = staged(
            ends.groupBy("at").agg(F.least(F.col("at"), F.min("to")).alias("up")), "step"
        )
        left = step.select(F.col("at").alias("u"), F.col("up").alias("up_u"))
        right = step.select(F.col("at").alias("v"), F.col("up").alias("up_v"))
        moved = live.join(left, "u").join(right, "v")
        live = staged(
            moved.where("up_u <> up_v")
            .select(F.least("up_u", "up_v").alias("u"), F.greatest("up_u", "up_v").alias("v"))
            .distinct(),
            "edges",
        )
        up = step.select(F.col("at").alias("root"), "up")
        found = staged(
            found.join(up, "root", "left").select("node", F.coalesce("up", "root").alias("root")),
            "roots",
        )
    return found
