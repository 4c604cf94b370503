"""Connected components by least labels with pointer jumping, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarack.scratch import Scratch


def components(tables: Scratch, edges: DataFrame, name: str = "labels", most_rounds: int = 100) -> DataFrame:
    """(node, label) for each node of ``edges`` (a, b: long); the label is the component's least node.

    First each node is drawn to its least neighbour and edges are kept between what nodes were drawn to,
    each once: of a dense group hardly any edge is left. A round on those takes the least label among the
    neighbours and then the label of that label, so rounds follow the logarithm of the diameter.
    Neighbours are reduced by partial aggregation, never listed. An edge of a node with itself makes it a
    component of its own. Raises if labels do not settle. No table is broadcast, as Spark sizes them by their
    compressed files.
    """
    both = tables.keep(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{name}-edges")
    drawn = tables.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("near")), f"{name}-drawn")
    end = lambda side: drawn.select(F.col("node").alias(side), F.col("near").alias(f"near_{side}"))
    # the edges come both ways, so each is carried over once only
    thin = both.where("a <= b").join(end("a").hint("merge"), "a").join(end("b").hint("merge"), "b").select(F.col("near_a").alias("a"), F.col("near_b").alias("b")).distinct()
    thin = tables.keep(thin, f"{name}-thin")
    tables.drop(f"{name}-edges")
    pairs = tables.keep(thin.union(thin.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-pairs")
    labels = tables.keep(pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("label")), f"{name}-0")
    for i in range(1, most_rounds):
        near = pairs.join(labels.select(F.col("node").alias("b"), "label").hint("merge"), "b").groupBy("a").agg(F.min("label").alias("near"))
        low = labels.join(near.withColumnRenamed("a", "node").hint("merge"), "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        far = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        now = tables.keep(low.join(far.hint("merge"), "label").select("node", "was", F.least("label", "further").alias("label")), f"{name}-{i}")
        tables.drop(f"{name}-{i - 1}")
        labels = now.select("node", "label")
        if now.where("label <> was").isEmpty():
            # a node is drawn to itself or to another node of ``thin``, as the edge between them is there
            return drawn.join(labels.withColumnRenamed("node", "near").hint("merge"), "near").select("node", "label")
    raise RuntimeError("components did not settle")
