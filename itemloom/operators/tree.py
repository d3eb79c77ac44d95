"""Concept trees stored as materialised paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from itemloom.functions.text import normalize, stable_id

SEPARATOR = " / "


def prefixes(path: Column, least: int = 1) -> Column:
    """The path's own prefixes from level ``least`` on; a shorter path keeps itself."""
    parts = F.split(path, SEPARATOR, -1)
    first = F.least(F.lit(least), F.size(parts))
    return F.transform(F.sequence(first, F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), SEPARATOR))


def in_subtree(path: Column, node: str) -> Column:
    return (path == node) | F.startswith(path, F.lit(node + SEPARATOR))


def any_in_subtree(points: Column, ids: list[str], paths: list[str]) -> Column:
    """Whether any point (struct of id and path) lies in one of the subtrees; none given means none."""
    if not ids and not paths:
        return F.lit(False)

    def hit(k: Column) -> Column:
        out = k["id"].isin(ids) if ids else F.lit(False)
        for p in paths:
            out = out | in_subtree(k["path"], p)
        return F.coalesce(out, F.lit(False))

    return F.exists(points, hit)


def resolve(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Points (item, id, path) with the node that they mean: by id, or else by path; others go.

    Column ``node_path`` is the node's own path, so that a stale path never counts.
    """
    by_id = nodes.select(F.col("node_id").alias("id"), F.col("path").alias("__by_id"))
    by_path = nodes.select(F.col("path"), F.col("path").alias("__by_path"))
    out = points.join(by_id, "id", "left").join(by_path, "path", "left")
    return out.withColumn("node_path", F.coalesce("__by_id", "__by_path")).where("node_path IS NOT NULL").drop("__by_id", "__by_path")


def rollup_counts(points: DataFrame, item: str | list[str], path: str, least: int = 1) -> DataFrame:
    """(node, items): each item once for every node that one of its points is in or under.

    Ancestors come from each path itself, so the join with descendants never becomes a prefix comparison of all
    pairs.  An item's paths meet first; its nodes are made distinct where they stand, and only counts by node move on.
    """
    keys = [item] if isinstance(item, str) else item
    own = points.where(F.col(path).isNotNull()).groupBy(*keys).agg(F.collect_set(path).alias("__paths"))  # bounded by the item
    nodes = F.array_distinct(F.flatten(F.transform("__paths", lambda p: prefixes(p, least))))
    return own.select(F.explode(nodes).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("items"))


def descendants(nodes: DataFrame, wanted: DataFrame, path: str = "path", node: str = "node") -> DataFrame:
    """Nodes in or under the wanted ones, as an equi-join on exploded prefixes."""
    up = nodes.withColumn("__up", F.explode(prefixes(F.col(path))))
    return up.join(wanted.select(F.col(node).alias("__up")), "__up", "left_semi").drop("__up").distinct()


def pick_tree(trees: DataFrame, group: list[str], builtin: Column, matches: Column, created: Column) -> DataFrame:
    """One tree a group: not built in before built in, then matching the textbook, then newest."""
    rank = F.struct(builtin.cast("int"), (~matches).cast("int"), -F.unix_timestamp(created), F.col("tree_id"))
    return trees.groupBy(*group).agg(F.min_by("tree_id", rank).alias("tree_id"))


def resolve_typed(points: DataFrame, nodes: DataFrame) -> DataFrame:
    """Points (item, id, name) as typed, with the node's id and path: by id, or else by a name that normalises alike, or else free.

    ``how`` says which; of nodes of one name the smallest id counts; a free one has a stable id of its name and no path.
    """
    by_id = nodes.select(F.col("node_id").alias("id"), F.struct(F.col("node_id").cast("string").alias("id"), "path").alias("__a"))
    named = nodes.withColumn("__n", normalize(F.col("name"))).groupBy("__n").agg(F.min(F.struct(F.col("node_id"), "path")).alias("m"))
    by_name = named.select("__n", F.struct(F.col("m.node_id").cast("string").alias("id"), F.col("m.path").alias("path")).alias("__b"))
    met = points.withColumn("__n", normalize(F.col("name"))).join(by_id, "id", "left").join(by_name, "__n", "left")
    free = F.struct(stable_id(F.trim("name")).alias("id"), F.lit(None).cast("string").alias("path"))
    node = F.coalesce("__a", "__b", free)
    how = F.when(F.col("__a").isNotNull(), "id").when(F.col("__b").isNotNull(), "name").otherwise("free")
    return met.select("item", node["id"].alias("node_id"), node["path"].alias("path"), how.alias("how"))
