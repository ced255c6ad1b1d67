"""Connected components of an edge table, in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(edges: DataFrame) -> DataFrame:
    """(a, b) edges to (node, label): the least node that each node is connected with.

    Each round every node points to its least neighbour below it, pointers are followed to their ends, and the edges that are
    no pointers are drawn between ends, each once. So the graph shrinks by half at least, whatever its shape, a star is gone
    after one round, and rounds end when no edge is left; each is written to the checkpoint folder. Least
    neighbours are found map-side. Joins meet a table with one row a node, so the rows of a hub can be split over tasks, as
    adaptive execution does. No edges or labels reach the driver. Loops and repeated edges do no harm; edges
    with a null end are passed over.
    """

    def ordered(d: DataFrame) -> DataFrame:
        return d.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    whole = common.cut(ordered(edges.select("a", "b").where("a is not null and b is not null")))
    labels = whole.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("label", F.col("node"))
    live = whole.where("a <> b")
    while True:
        up = common.cut(live.groupBy("a").agg(F.min("b").alias("p")))
        if up.isEmpty():
            return common.cut(labels)
        rest = live.join(up, "a").where("b <> p").select("a", "b")
        up = up.withColumnRenamed("a", "node")
        while True:
            ahead = up.select(F.col("node").alias("p"), F.col("p").alias("q"))
            jumped = common.cut(up.join(ahead, "p", "left").select("node", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")))
            up = jumped.select("node", "p")
            if jumped.where("moved").isEmpty():
                break
        to = lambda c: up.select(F.col("node").alias(c), F.col("p").alias(f"{c}_"))  # noqa: B023, E731
        labels = common.cut(labels.join(to("label"), "label", "left").select("node", F.coalesce("label_", "label").alias("label")))
        drawn = rest.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_", "a").alias("a"), F.coalesce("b_", "b").alias("b"))
        live = common.cut(ordered(drawn.where("a <> b")))
