"""Queries over trees kept as (id, parent) rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quirelake.runtime import cut


def _jumps(nodes: DataFrame, node: str, parent: str) -> list[DataFrame]:
    """Tables ``(id, ancestor)``, the k-th with each node's ancestor at distance ``2**k``."""
    known = nodes.select(F.col(node).alias("id")).where(F.col("id").isNotNull()).distinct()
    edges = (
        nodes.where(F.col(parent).isNotNull() & (F.col(parent) != F.col(node)))
        .select(F.col(node).alias("id"), F.col(parent).alias("ancestor"))
        .join(known.withColumnRenamed("id", "ancestor"), "ancestor", "left_semi")
        .select("id", "ancestor")
        .distinct()
    )
    size = known.count()
    jumps, reach = [cut(edges)], 1
    while True:
        last = jumps[-1]
        further = last.select("id", F.col("ancestor").alias("mid")).join(last.select(F.col("id").alias("mid"), "ancestor"), "mid")
        further = cut(further.select("id", "ancestor").distinct())
        if further.isEmpty():
            return jumps
        reach *= 2
        if reach >= size:
            # no path is as long as there are nodes, so these walk in circles
            kept = jumps[0].join(further.select("id").distinct(), "id", "left_anti")
            return _jumps(known.join(kept, "id", "left").withColumnRenamed("ancestor", "parent"), "id", "parent")
        jumps.append(further)


def closure(nodes: DataFrame, node: str = "id", parent: str = "parent", asked: DataFrame | None = None) -> DataFrame:
    """``(id, ancestor, distance)``: every node with itself and all its ancestors, at any depth.

    With ``asked`` (a table with ``id``) only for its nodes, and no other paths are built.
    Paths double in each round by a table of jumps, so a tree of depth d takes log2(d) joins
    keyed by node. Parents that are no nodes end the walk; nodes on a cycle or under one have
    only themselves. Null ids are no nodes; of two parents both count.
    """
    jumps = _jumps(nodes, node, parent)
    known = nodes.select(F.col(node).alias("id")).where(F.col("id").isNotNull()).distinct()
    if asked is not None:
        known = known.join(asked.select("id").distinct(), "id", "left_semi")
    paths = known.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("distance"))
    for k, jump in enumerate(jumps):
        longer = paths.select("id", F.col("ancestor").alias("mid"), "distance").join(jump.withColumnRenamed("id", "mid"), "mid")
        longer = longer.select("id", "ancestor", (F.col("distance") + F.lit(2**k)).alias("distance"))
        paths = cut(paths.unionAll(longer))
    return paths.groupBy("id", "ancestor").agg(F.min("distance").alias("distance"))


def visible_counts(nodes: DataFrame) -> DataFrame:
    """``(id, n)``: a node and all its descendants."""
    return closure(nodes).groupBy(F.col("ancestor").alias("id")).agg(F.count(F.lit(1)).alias("n"))


def depths(nodes: DataFrame) -> DataFrame:
    return closure(nodes).groupBy("id").agg(F.max("distance").alias("depth"))


def top_selected(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """Selected nodes none of whose ancestors is selected."""
    above = closure(nodes, asked=selected).where("distance > 0")
    under = above.join(selected.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id").distinct()
    return selected.select("id").join(under, "id", "left_anti")


def delete_with_branches(nodes: DataFrame, selected: DataFrame) -> DataFrame:
    """Nodes left after the selected ones and everything under them are gone."""
    gone = closure(nodes).join(selected.select(F.col("id").alias("ancestor")), "ancestor", "left_semi").select("id").distinct()
    return nodes.join(gone, "id", "left_anti")


def preorder(nodes: DataFrame, order: str = "id") -> DataFrame:
    """``(id, depth, path)``; ordering by ``path`` lists the tree in preorder."""
    up = closure(nodes).join(nodes.select(F.col("id").alias("ancestor"), F.col(order).alias("o")), "ancestor")
    path = F.transform(F.sort_array(F.collect_list(F.struct("distance", "o")), asc=False), lambda x: x["o"])
    return up.groupBy("id").agg(F.max("distance").alias("depth"), path.alias("path"))


def move_branches(nodes: DataFrame, dragged: DataFrame, target: int, position: str) -> DataFrame:
    """``(id, parent, place)`` after the ``dragged`` nodes went before, after or into (as last
    children of) ``target``; places count 1, 2, ... among the children of a parent.

    ``nodes`` has ``(id, parent, ord)``. Of the dragged nodes those under another one go with it. The
    tree stays as it is when the target is dragged itself or lies under a dragged node, or is
    no node.
    """
    if position not in ("before", "after", "child"):
        raise ValueError(position)
    nodes = nodes.select("id", "parent", F.col("ord").cast("double").alias("ord"))
    roots = top_selected(nodes, dragged.join(nodes.select("id"), "id", "left_semi"))
    spark = nodes.sparkSession
    aim = spark.createDataFrame([(target,)], "id long")
    above = closure(nodes, asked=aim).select(F.col("ancestor").alias("id"))
    to = nodes.where(F.col("id") == target).select("parent", "ord").collect()
    by = Window.partitionBy("parent").orderBy("ord", "group", "id")
    plain = nodes.withColumn("group", F.lit(0))
    if to and roots.join(above, "id", "left_semi").isEmpty():
        row = to[0]
        goal = F.lit(target if position == "child" else row["parent"]).cast("long")
        place = F.lit(float("inf") if position == "child" else row["ord"])
        side = 1 if position != "before" else -1
        moved = nodes.join(roots, "id", "left_semi").select("id", goal.alias("parent"), place.alias("ord"), F.lit(side).alias("group"), F.col("ord").alias("own"))
        # among those moved the old order holds
        kept = plain.join(roots, "id", "left_anti").withColumn("own", F.lit(0.0))
        plain = kept.unionByName(moved)
        by = Window.partitionBy("parent").orderBy("ord", "group", "own", "id")
    return plain.select("id", "parent", F.row_number().over(by).alias("place"))
