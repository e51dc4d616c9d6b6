"""Connected components by minimum labels and pointer jumping; each round reads a table in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import Kept


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for every node with an edge.

    A round takes the least label among the neighbours, then the label's own label, so chains halve; it ends when no label changes.  A hub with very
    many edges is aggregated before the shuffle.  No edges give an empty table; loops and repeated edges do no harm; edges with a null end are left out.
    """
    kept = Kept(edges.sparkSession, "components")
    pair = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x is not null and y is not null and x <> y")
    both, _ = kept.write(pair.unionByName(pair.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    label, path = kept.write(both.groupBy(F.col("x").alias("node")).agg(F.min("y").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(label.withColumnRenamed("node", "y"), "y").groupBy(F.col("x").alias("node")).agg(F.min("root").alias("m"))
        least = label.join(near, "node").select("node", F.least("root", "m").alias("r"), F.col("root").alias("old"))
        # the label's label, of the round before
        up = label.select(F.col("node").alias("r"), F.col("root").alias("up"))
        new = least.join(up, "r", "left").select("node", F.least("r", F.coalesce("up", "r")).alias("root"), "old")
        table, new_path = kept.write(new)
        changed = table.where("root <> old").limit(1).count()
        kept.drop(path)
        label, path = table.select("node", "root"), new_path
        if not changed:
            return label
