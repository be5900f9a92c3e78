"""Helpers that the training-data operators share: words, whole-text columns, shared tables, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.lineage import saved

#: A word is a run of anything but these six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the folder that driver and executors share and read it back: its lineage ends in files that outlive any executor."""
    return saved(df, name)


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else touched."""
    return F.translate(text, UPPER, LOWER)


def components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of undirected edges (u, v): one row (node, component) per node that has an edge.

    The component is its smallest node. Each round takes the smallest label among a node's neighbours (a partial
    aggregate, so that a node with very many neighbours is no single task's work) and then follows labels one step
    (pointer jumping), which halves the distance to the root; it stops when nothing changes. Labels are written
    to the shared folder after each round.
    """
    both = cut(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), name)
    labels = cut(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("component")), name)
    while True:
        near = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("component").alias("near"))
        step = labels.join(near, labels.node == near.u).select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        root = step.select(F.col("node").alias("root"), F.col("component").alias("above"))
        new = cut(step.join(root, step.component == root.root).select("node", "old", F.least("component", "above").alias("component")), name)
        labels = new.select("node", "component")
        if new.where("old <> component").isEmpty():
            return labels
