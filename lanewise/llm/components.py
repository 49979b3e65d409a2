"""Connected components of an edge table; nothing but single rows reaches the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.llm.shared import stored


def _roots(parents: DataFrame) -> DataFrame:
    """``node, parent`` with each parent replaced by the root of its tree. Parents are less than their nodes, so there are no cycles.

    Every round doubles the distance that a node looks up.
    """
    while True:
        up = parents.select(F.col("node").alias("via"), F.col("parent").alias("above"))
        jumped = parents.join(up, F.col("parent") == F.col("via"), "left")
        jumped = stored(jumped.select("node", F.coalesce("above", "parent").alias("parent"), F.col("above").isNotNull().alias("moved")))
        parents = jumped.select("node", "parent")
        if jumped.filter("moved").isEmpty():
            return parents


def _renamed(df: DataFrame, column: str, names: DataFrame, node: str, name: str) -> DataFrame:
    """``df`` with ``column`` looked up in ``names``, unchanged where there is none."""
    found = names.select(F.col(node).alias("_node"), F.col(name).alias("_name"))
    return df.join(found, F.col(column) == F.col("_node"), "left").withColumn(column, F.coalesce("_name", column)).drop("_node", "_name")


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for all nodes of ``edges`` (``a, b``): the least node reachable. No edges: no rows.

    A round hooks every node to its least neighbour if that is less than itself, follows the hooks to their roots, and goes on
    with the edges between different roots, until there are none.
    """
    names = None
    while True:
        edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct())
        if edges.isEmpty():
            break
        roots = _roots(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")))
        if names is None:
            names = roots.select("node", F.col("parent").alias("component"))
        else:
            names = stored(_renamed(names, "component", roots, "node", "parent").unionByName(roots.select("node", F.col("parent").alias("component"))))
        edges = _renamed(_renamed(edges, "a", roots, "node", "parent"), "b", roots, "node", "parent")
    if names is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return names.unionByName(names.select(F.col("component").alias("node"), "component").distinct())


def joined(found: DataFrame, links: DataFrame) -> DataFrame:
    """``found`` (``node, component``, every node) with the components that ``links`` (``a, b``) connect made one."""
    edges = _renamed(_renamed(links, "a", found, "node", "component"), "b", found, "node", "component").filter("a <> b")
    between = components(edges)
    return stored(_renamed(found, "component", between, "node", "component"))
