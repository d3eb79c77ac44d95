"""Concept trees from nested JSON, path tables, outlines and textbook catalogs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from itemloom.operators.tree import SEPARATOR


# Words of a header's cells, the header of aliases, and what separates aliases in a cell.
HEADER, ALIASES, BETWEEN = "级|层|名称|知识点|章|节|别名", "别名", "[|、；;]"


def from_paths(rows: DataFrame, levels: list[str], aliases: str | None = None, between: str = "[;；,，]") -> DataFrame:
    """(path, parent, name, level, aliases, is_leaf) from rows whose columns are a path's levels.

    Empty levels end a path; rows of one node merge, their aliases (split at ``between``) as a sorted set.
    """
    parts = F.filter(F.array(*[F.trim(F.coalesce(F.col(c), F.lit(""))) for c in levels]), lambda x: x != "")
    marks = F.filter(F.transform(F.split(F.coalesce(F.col(aliases) if aliases else F.lit(""), F.lit("")), between), lambda x: F.trim(x)), lambda x: x != "")
    base = rows.select(parts.alias("p"), marks.alias("a")).where(F.size("p") > 0)
    each = base.select("p", "a", F.explode(F.sequence(F.lit(1), F.size("p"))).alias("level"))
    node = each.select("level", F.array_join(F.slice("p", F.lit(1), F.col("level")), SEPARATOR).alias("path"), F.element_at("p", F.col("level")).alias("name"), F.when(F.col("level") == F.size("p"), F.col("a")).otherwise(F.array().cast("array<string>")).alias("a"), (F.col("level") < F.size("p")).alias("inner"))
    merged = node.groupBy("path", "name", "level").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("a")))).alias("aliases"), (~F.bool_or("inner")).alias("is_leaf"))
    parent = F.when(F.col("level") > 1, F.array_join(F.slice(F.split("path", SEPARATOR), F.lit(1), F.col("level") - 1), SEPARATOR))
    return merged.select("path", parent.alias("parent"), "name", "level", "aliases", "is_leaf")


def read_csv(spark: SparkSession, path: str, depth: int = 16) -> DataFrame:
    """A tree from CSV files of a path a row, of at most ``depth`` columns.

    The first row that isn't empty is a header if all its filled cells read like one; it doesn't count then, in
    none of the files, and its column of aliases, if any, is none of the path's.  Without a header all columns are levels.
    Rows may be shorter than others; empty rows say nothing; an empty file gives an empty tree.
    """
    names = [f"c{i}" for i in range(depth)]
    raw = spark.read.csv(path, schema=", ".join(f"{n} string" for n in names))
    strip = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)^[\uFEFF\s]+|\s+$", "")
    rows = raw.select(*[strip(n).alias(n) for n in names]).where(F.concat(*names) != "")
    head, aliases = rows.first(), None  # one row, from the start of a file
    if head is not None and all(re.search(HEADER, c) for c in head if c):
        rows = rows.where(~F.array(*names).eqNullSafe(F.array(*[F.lit(c) for c in head])))
        aliases = next((n for n, c in zip(names, head) if ALIASES in c), None)
    return from_paths(rows, [n for n in names if n != aliases], aliases, BETWEEN)


def from_json(rows: DataFrame, text: str, keep: list[str] | None = None) -> DataFrame:
    """The same, with columns ``keep``, from nested JSON objects {name, aliases, children} of any depth, level by level until none is left."""
    node = "array<struct<name: string, aliases: array<string>, children: string>>"
    keep = keep or []
    level = rows.select(*keep, F.col(text).alias("raw"), F.lit(None).cast("string").alias("parent"))
    out, k = None, 0
    while out is None or not level.isEmpty():  # one small query a level of the tree
        k += 1
        each = level.select(*keep, F.explode(F.from_json("raw", node)).alias("n"), "parent").where(F.trim("n.name") != "")
        inner = F.coalesce(F.exists(F.from_json("n.children", node), lambda c: F.trim(c["name"]) != ""), F.lit(False))
        here = each.select(*keep, F.concat_ws(SEPARATOR, "parent", F.trim("n.name")).alias("path"), "parent", F.trim("n.name").alias("name"), F.lit(k).alias("level"), F.array_sort(F.array_distinct(F.coalesce("n.aliases", F.array().cast("array<string>")))).alias("aliases"), (~inner).alias("is_leaf"), F.col("n.children").alias("raw"))
        out = here.drop("raw") if out is None else out.unionByName(here.drop("raw"))
        level = here.where("NOT is_leaf").select(*keep, "raw", F.col("path").alias("parent"))
    return out


def from_outline(lines: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """(doc, path): list items of a Markdown outline under their headings of levels 2 to 4."""
    w = Window.partitionBy(doc).orderBy(order)
    rows = lines.withColumn("__depth", F.length(F.regexp_extract(text, r"^(#{2,4})\s", 1)))
    for k in (2, 3, 4):
        # A heading ends those below it: an upper one resets to the empty string.
        mark = F.when(F.col("__depth") == k, F.trim(F.regexp_replace(text, r"^#+\s*", ""))).when((F.col("__depth") > 0) & (F.col("__depth") < k), F.lit(""))
        rows = rows.withColumn(f"__h{k}", F.last(mark, ignorenulls=True).over(w))
    item = F.trim(F.regexp_extract(text, r"^\s*[-*]\s+(.*)$", 1))
    return rows.where(item != "").select(doc, F.concat_ws(SEPARATOR, *[F.nullif(f"__h{k}", F.lit("")) for k in (2, 3, 4)], item).alias("path"))


def sections(books: DataFrame) -> DataFrame:
    """(node_id, name, knowledge) of chapters and sections of nested catalogs (version, book, chapters).

    ``chapters`` is array<struct<name, knowledge, sections: array<struct<name, knowledge>>>>; a chapter's
    knowledge is its own and its sections'.
    """
    c = books.select("version", "book", F.posexplode("chapters").alias("i", "c"))
    names = F.flatten(F.transform("c.sections", lambda s: s["knowledge"]))
    chapter = c.select(F.substring(F.md5(F.concat_ws("/", "version", "book", "c.name")), 1, 12).alias("node_id"), F.col("c.name").alias("name"), F.array_distinct(F.concat(F.coalesce("c.knowledge", F.array().cast("array<string>")), F.coalesce(names, F.array().cast("array<string>")))).alias("knowledge"))
    s = c.select("version", "book", F.col("c.name").alias("chapter"), F.explode("c.sections").alias("s"))
    section = s.select(F.substring(F.md5(F.concat_ws("/", "version", "book", "chapter", "s.name")), 1, 12).alias("node_id"), F.col("s.name").alias("name"), F.col("s.knowledge").alias("knowledge"))
    return chapter.unionByName(section)


def chapter_counts(points: DataFrame, catalog: DataFrame, item: str, path: str) -> DataFrame:
    """(node_id, items): questions one of whose points, or a level of its path, is in a section's knowledge."""
    # Each level meets the sections where it is, so that only pairs that count are shuffled, once.
    named = points.select(item, F.explode(F.array_distinct(F.split(path, SEPARATOR))).alias("k"))
    bridge = catalog.select("node_id", F.explode("knowledge").alias("k")).distinct()
    return named.join(bridge, "k").groupBy("node_id").agg(F.count_distinct(item).alias("items"))


def lexical_map(books: DataFrame, names: DataFrame, least: float = 0.6) -> DataFrame:
    """(section, chapter, names): the three concepts that a section's title is nearest to, or else the one its chapter's is."""
    from itemloom.operators.similarity import node_matches

    mark = r"^(第.+?[章单元节课]|[\dA-Za-z.]+|课题\s*\d+|Unit\s*\d+)\s*"
    bare = lambda c, p: F.trim(F.regexp_replace(c, p, ""))
    rows = books.select("section", "chapter", F.coalesce(F.nullif(bare(F.col("section"), mark), F.lit("")), F.col("section")).alias("s"), bare(F.col("chapter"), r"^(第.+?[章单元]|[\d.]+)\s*").alias("c")).distinct()
    nodes = names.select(F.col("name").alias("node_id"), "name", F.array().cast("array<string>").alias("aliases"))
    asked = rows.select(F.col("s").alias("name")).union(rows.select("c")).distinct()
    near = node_matches(asked, nodes, 3, least)
    own = near.groupBy(F.col("name").alias("s")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node_id"))), lambda x: x["node_id"]).alias("own"))
    other = near.where("rank = 1").select(F.col("name").alias("c"), F.array("node_id").alias("other"))
    return rows.join(own, "s", "left").join(other, "c", "left").select("section", "chapter", F.coalesce("own", "other", F.array().cast("array<string>")).alias("names"))
