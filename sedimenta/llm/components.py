"""Consolidation of pairwise links into groups: minimum labels along edges, pointer jumping, contraction.

A round takes the graph of the labels that are left. Every node takes the smallest of itself and its neighbours as its
parent (map-side combined, so a node with a third of all links costs one row per partition), pointer jumping doubles
the reach of the parents until each points at a root, and the edges are rewritten to roots, without loops and
repetitions. A node that still has an edge has a neighbour, so each round at least halves the nodes; jumping takes
logarithmically many steps of the longest chain. Each step's table is written to the checkpoint folder; the driver only
asks whether rows are left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.session import Scratch


def _jump(scratch: Scratch, parents: DataFrame) -> DataFrame:
    """Parents replaced by their parents until nothing changes. parents: node, parent; each parent is a node too."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        jumped = parents.join(up, "parent").select("node", F.col("grand").alias("parent"), (F.col("grand") != F.col("parent")).alias("moved"))
        before, parents = parents, scratch.write(jumped)
        scratch.discard(before)
        if parents.filter("moved").isEmpty():
            return parents


def connected_components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """(node, label): for each node with an edge to another node, the smallest node of its component.

    Strings compare by code point. Null ends and self links count for nothing, repeated and reversed edges once; without
    edges the result is empty. Other columns of `edges` are ignored, whatever their names.
    """
    a, b = F.col(left), F.col(right)
    scratch = Scratch(edges.sparkSession)
    # A null end fails the filter.
    edges = scratch.write(edges.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    labels = None
    while not edges.isEmpty():
        down, own = F.struct(F.col("b").alias("node"), F.col("a").alias("low")), F.struct(F.col("a").alias("node"), F.col("a").alias("low"))
        ends = edges.select(F.explode(F.array(down, own)).alias("end"))
        parents = _jump(scratch, scratch.write(ends.groupBy("end.node").agg(F.min("end.low").alias("parent"))))
        up = parents.select(F.col("node").alias("label"), "parent")
        before, labels = labels, scratch.write(
            parents.select("node", F.col("parent").alias("label"))
            if labels is None
            else labels.join(up, "label", "left").select("node", F.coalesce("parent", "label").alias("label"))
        )
        scratch.discard(before)
        first = parents.select(F.col("node").alias("a"), F.col("parent").alias("x"))
        second = parents.select(F.col("node").alias("b"), F.col("parent").alias("y"))
        rewritten = edges.join(first, "a").join(second, "b").filter("x != y")
        before, edges = edges, scratch.write(rewritten.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
        scratch.discard(before)
        scratch.discard(parents)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")) if labels is None else labels


def member_groups(links: DataFrame, postings: DataFrame) -> DataFrame:
    """(member, group_id) of each member in a group of two or more; group_id is the smallest member of the group.

    A link counts if its status is resolved and both ends, without surrounding spaces, are members of `postings`.
    Repeated and reversed links, self links, null ends and unknown ends are allowed and change nothing.
    """
    members = postings.select("member").filter("member IS NOT NULL").distinct()
    pairs = (
        links.filter("status = 'resolved'")
        .select(F.trim("from_node").alias("a"), F.trim("to_node").alias("b"))
        .filter("a != b")
        .distinct()
        .join(members.withColumnRenamed("member", "a"), "a", "left_semi")
        .join(members.withColumnRenamed("member", "b"), "b", "left_semi")
    )
    return connected_components(pairs).select(F.col("node").alias("member"), F.col("label").alias("group_id"))
