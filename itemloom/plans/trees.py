"""Concept trees: roll-ups, subtrees, catalogs."""

from pyspark.sql import functions as F

from itemloom.operators import tree
from itemloom.plans.papers import _points
from itemloom.plans.registry import query
from itemloom.sources import trees as sources
from itemloom.sources.tables import table

_PATHS = "SELECT s_suppkey, r_name AS a, r_name || ' / ' || n_name AS b, r_name || ' / ' || n_name || ' / ' || s_name AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _tagged(spark, d):
    """Questions (order lines) with the path of their concept, joined on distinct pairs only."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_suppkey").distinct()
    return lines.join(_points(spark, d), lines.l_suppkey == F.col("s_suppkey")).select("l_orderkey", "path")


@query(f"WITH p AS ({_PATHS}), e AS (SELECT DISTINCT l_orderkey, unnest([a, b, c]) AS node FROM lineitem JOIN p ON l_suppkey = s_suppkey) SELECT node, count(*) AS items FROM e GROUP BY node")
def tree_rollup_counts(spark, d):
    return tree.rollup_counts(_tagged(spark, d), "l_orderkey", "path")


@query(f"WITH p AS ({_PATHS}) SELECT s_suppkey, c AS path FROM p WHERE c = 'ASIA' OR starts_with(c, 'ASIA / ') OR starts_with(c, 'EUROPE / NATION_3 / ')")
def subtree_filter(spark, d):
    points = F.array(F.struct(F.col("s_suppkey").cast("string").alias("id"), "path"))
    return _points(spark, d).where(tree.any_in_subtree(points, [], ["ASIA", "EUROPE / NATION_3"])).select("s_suppkey", "path")


@query(f"WITH p AS ({_PATHS}) SELECT s_suppkey, c AS path FROM p WHERE false")
def unknown_node_is_empty(spark, d):
    points = F.array(F.struct(F.col("s_suppkey").cast("string").alias("id"), "path"))
    return _points(spark, d).where(tree.any_in_subtree(points, [], [])).select("s_suppkey", "path")


@query(f"WITH p AS ({_PATHS}) SELECT s_suppkey, c AS path FROM p WHERE s_suppkey % 3 = 0 OR a = 'AFRICA'")
def tree_descendants(spark, d):
    nodes = _points(spark, d)
    wanted = nodes.where("s_suppkey % 3 = 0").select(F.col("path").alias("node")).unionByName(spark.createDataFrame([("AFRICA",)], "node string"))
    return tree.descendants(nodes, wanted)


@query(f"WITH p AS ({_PATHS}), m AS (SELECT s_suppkey AS item, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey ELSE -1 END AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'stale' ELSE c END AS path FROM p) SELECT item, coalesce(i.c, j.c) AS node_path FROM m LEFT JOIN p i ON m.id = i.s_suppkey LEFT JOIN p j ON m.path = j.c WHERE coalesce(i.c, j.c) IS NOT NULL")
def resolved_points(spark, d):
    """Points with stale ids resolve by path, with stale paths by id; neither: ignored."""
    nodes = _points(spark, d).select(F.col("s_suppkey").alias("node_id"), "path")
    points = nodes.select(F.col("node_id").alias("item"), F.when(F.col("node_id") % 2 == 0, F.col("node_id")).otherwise(-1).alias("id"), F.when(F.col("node_id") % 3 == 0, "stale").otherwise(F.col("path")).alias("path"))
    return tree.resolve(points, nodes).select("item", "node_path")


_CSV = "SELECT r_name AS path, NULL AS parent, r_name AS name, 1 AS level, '' AS aliases, false AS is_leaf FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT r_name || ' / ' || n_name, r_name, n_name, 2, 'a' || n_nationkey || '|x', true FROM nation JOIN region ON n_regionkey = r_regionkey"


@query(_CSV)
def tree_from_paths(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select("r_name", "n_name", F.lit(None).cast("string").alias("extra"), F.concat(F.lit("x; a"), F.col("n_nationkey").cast("string"), F.lit("，x")).alias("marks"))
    return sources.from_paths(rows, ["r_name", "n_name", "extra"], "marks").select("path", "parent", "name", "level", F.array_join("aliases", "|").alias("aliases"), "is_leaf")


@query("SELECT md5(o_custkey::VARCHAR || ':' || o_orderpriority)[1:10] AS id, count(*) AS items FROM orders GROUP BY 1")
def stable_ids(spark, d):
    from itemloom.functions.text import stable_id

    orders = table(spark, d, "orders", "o_custkey", "o_orderpriority")
    return orders.groupBy(stable_id(F.col("o_custkey").cast("string"), F.col("o_orderpriority")).alias("id")).agg(F.count(F.lit(1)).alias("items"))


@query(f"WITH p AS ({_PATHS}), n AS (SELECT DISTINCT l_orderkey, unnest(string_split(c, ' / ')) AS k FROM lineitem JOIN p ON l_suppkey = s_suppkey), b AS (SELECT r_name AS node_id, unnest([r_name, 'NATION_1', 'NATION_2']) AS k FROM region) SELECT node_id, count(DISTINCT l_orderkey) AS items FROM n JOIN (SELECT DISTINCT * FROM b) USING (k) GROUP BY 1")
def chapter_counts(spark, d):
    catalog = table(spark, d, "region").select(F.col("r_name").alias("node_id"), F.array("r_name", F.lit("NATION_1"), F.lit("NATION_2")).alias("knowledge"))
    return sources.chapter_counts(_tagged(spark, d), catalog, "l_orderkey", "path")


@query("SELECT c_nationkey, c_custkey AS tree_id FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY (c_custkey % 4 = 0)::INT, (c_mktsegment <> 'BUILDING')::INT, c_custkey) = 1")
def picked_tree(spark, d):
    rows = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment").withColumnRenamed("c_custkey", "tree_id")
    return tree.pick_tree(rows, ["c_nationkey"], F.col("tree_id") % 4 == 0, F.col("c_mktsegment") == "BUILDING", F.lit("2024-01-01").cast("timestamp"))


_DEEP = " UNION ALL ".join(f"SELECT p_partkey, {' || '.join(f"'n{i} / '" for i in range(k))}{' || ' if k else ''}'n{k}' AS path, {k + 1} AS level, {str(k == 8).lower()} AS is_leaf, {"'b|p' || p_partkey" if k == 8 else "''"} AS aliases FROM part" for k in range(9))


@query(_DEEP.replace("SELECT p_partkey, ", "SELECT DISTINCT p_size, ").replace("'b|p' || p_partkey", "'b|p' || p_size"))
def tree_from_json(spark, d):
    """Nested JSON nine levels deep, one tree for each size."""
    node = F.concat(F.lit('{"name": "n8 ", "aliases": ["p'), F.col("p_size").cast("string"), F.lit('", "b", "b"]}'))
    for k in reversed(range(8)):
        node = F.concat(F.lit(f'{{"name": "n{k}", "children": ['), node, F.lit(', {"name": " "}]}'))
    rows = table(spark, d, "part", "p_size").distinct().select("p_size", F.concat(F.lit("["), node, F.lit("]")).alias("json"))
    out = sources.from_json(rows, "json", ["p_size"])
    return out.select("p_size", "path", "level", "is_leaf", F.array_join("aliases", "|").alias("aliases"))


@query("SELECT r_regionkey AS doc, r_name || ' / part' || ' / ' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_regionkey, r_name || ' / loose' FROM region")
def outline_paths(spark, d):
    """An outline of headings and list items; the second heading of the upper level resets the lower one."""
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    heads = r.select(F.col("r_regionkey").alias("doc"), F.explode(F.array(F.struct(F.lit(0).alias("seq"), F.concat(F.lit("## "), F.col("r_name")).alias("text")), F.struct(F.lit(1).alias("seq"), F.lit("### part").alias("text")), F.struct(F.lit(900).alias("seq"), F.concat(F.lit("## "), F.col("r_name")).alias("text")), F.struct(F.lit(901).alias("seq"), F.lit("- loose").alias("text")))).alias("x")).select("doc", "x.*")
    items = n.select(F.col("n_regionkey").alias("doc"), (F.col("n_nationkey") + 10).alias("seq"), F.concat(F.lit("* "), F.col("n_name")).alias("text"))
    return sources.from_outline(heads.unionByName(items), "doc", "seq", "text")


@query("SELECT s AS label, names FROM (VALUES ('第1节 small ring', 'small ring'), ('第2节 unlike anything', 'red bolt'), ('1.3 blue gear', 'blue gear')) v(s, names)")
def mapped_sections(spark, d):
    """Sections named like concepts, or else their chapters; concepts are the parts' names."""
    rows = spark.createDataFrame([("第1节 small ring", "第一章 x"), ("第2节 unlike anything", "第二章 red bolt"), ("1.3 blue gear", "第三章 y")], "section string, chapter string")
    names = table(spark, d, "part", "p_name").where("p_name IN ('small ring', 'red bolt', 'blue gear', 'old anvil')").select(F.col("p_name").alias("name")).distinct()
    out = sources.lexical_map(rows, names)
    return out.select(F.col("section").alias("label"), F.array_join("names", "|").alias("names"))


@query(f"WITH p AS ({_PATHS}) SELECT s_suppkey FROM p WHERE string_split(c, ' / ')[1] IN ('ASIA') OR string_split(c, ' / ')[2] IN ('NATION_3')")
def chapter_filter(spark, d):
    """Questions one of whose concepts, or a level above it, is in a chapter's knowledge."""
    known = F.array(F.lit("ASIA"), F.lit("NATION_3"))
    return _points(spark, d).where(F.arrays_overlap(F.split("path", tree.SEPARATOR), known)).select("s_suppkey")


@query(f"WITH p AS ({_PATHS}) SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 OR a = 'ASIA' THEN c ELSE NULL END AS path, (CASE WHEN s_suppkey % 2 = 0 THEN 'id' WHEN a = 'ASIA' THEN 'name' ELSE 'free' END) AS how FROM p")
def edited_points(spark, d):
    """Concepts that a person typed: by id, by a name that is exactly a node's, or else free of the tree."""
    nodes = _points(spark, d).select(F.col("s_suppkey").alias("node_id"), "path", F.element_at(F.split("path", tree.SEPARATOR), -1).alias("name"))
    typed = nodes.select(F.col("node_id").alias("item"), F.when(F.col("node_id") % 2 == 0, F.col("node_id")).otherwise(-1).alias("id"), F.when(F.startswith("path", F.lit("ASIA")), F.concat(F.lit(" "), F.upper("name"))).otherwise("no such concept").alias("name"))
    return tree.resolve_typed(typed, nodes).select(F.col("item").alias("s_suppkey"), "path", "how")
