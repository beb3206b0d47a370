"""Connected components of an edge table, without a driver-side graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

FILE_EDGES = 500_000


def components(edges: DataFrame) -> DataFrame:
    """node, root for the nodes of edges(a, b): root is the least node of the component.

    Each round takes the least label of the neighbours and then the label of the
    label, so that the rounds grow with the logarithm of a component's diameter
    in practice. Rounds are cut by tables in the shared folder.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).where("a != b").distinct(), "edges")
    # Edges are far fewer than rows: as many files as they fill.
    files = both.count() // FILE_EDGES + 1
    both = both.coalesce(files)
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select("node", F.least("node", "least").alias("root")).coalesce(files), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("root").alias("near"))
        new = labels.join(near, labels["node"] == near["a"], "left").select("node", F.col("root").alias("was"), F.least("root", "near").alias("mid"))
        up = labels.select(F.col("node").alias("mid"), F.col("root").alias("above"))
        new = new.join(up, "mid", "left").select("node", "was", F.least("mid", "above").alias("root"))
        new = materialize(new.coalesce(files), "labels")
        discard(labels)
        if new.where("root != was").isEmpty():
            discard(both)
            return new.select("node", "root")
        labels = new.select("node", "root")
