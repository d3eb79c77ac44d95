"""Knowledge points of a model's answers, and questions split at their marks."""

from pyspark.sql import functions as F

from itemloom.operators import mutate, tagging
from itemloom.plans.registry import query
from itemloom.sources.tables import table


def _flat(tagged):
    """A row a point; one with nulls for a question without any."""
    return tagged.select("key", "difficulty", F.posexplode_outer("refs").alias("pos", "x")).select("key", "difficulty", "pos", "x.id", "x.name", "x.in_tree")


@query(
    """WITH o AS (SELECT o_orderkey AS key, o_orderkey % 30 AS a, o_custkey % 25 AS b, o_orderkey % 3 AS m, CASE WHEN o_custkey % 14 <= 10 THEN (o_custkey % 14) / 10.0::DOUBLE END AS difficulty FROM orders),
    r AS (SELECT key, 0 AS p, a AS node, NULL AS name FROM o WHERE a < 25 UNION ALL SELECT key, 1, b, NULL FROM o WHERE a <> b UNION ALL SELECT key, 2, b, NULL FROM o WHERE m = 0 UNION ALL SELECT key, 2, NULL, 'point ' || b FROM o WHERE m = 1),
    n AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY p) - 1 AS pos, node, name FROM r)
    SELECT o.key, difficulty, n.pos::INT AS pos, CASE WHEN node IS NOT NULL THEN node::VARCHAR WHEN name IS NOT NULL THEN 'kp_' || left(md5('geography:' || name), 10) END AS id, coalesce(n_name, name) AS name, CASE WHEN pos IS NOT NULL THEN node IS NOT NULL END AS in_tree
    FROM o LEFT JOIN n USING (key) LEFT JOIN nation ON n_nationkey = node"""
)
def points_from_list(spark, d):
    """Orders as questions, nations as the tree's leaves: numbers within and beyond the list, one twice, names of nations and of points outside the tree."""
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey").withColumn("b", F.col("o_custkey") % 25)
    nation = table(spark, d, "nation", "n_nationkey", "n_name")
    s = lambda c: c.cast("string")
    a, b, m = F.col("o_orderkey") % 30, F.col("b"), F.col("o_orderkey") % 3
    ids = F.array(F.concat(F.lit("k"), s(a)), F.concat(F.lit(" k"), s(b)), F.concat(F.lit("k"), s(a)), F.concat(F.lit("x"), s(b)))
    other = F.when(m == 0, F.array(F.lit(" 。"), F.concat(F.lit("1. "), F.lower("n_name"), F.lit("。")), F.lit("more"))).when(m == 1, F.array(F.concat(F.lit("一、point "), s(b))))
    answers = orders.join(nation, F.col("b") == F.col("n_nationkey")).select(F.col("o_orderkey").alias("key"), ids.alias("ids"), other.alias("other"), s(F.col("o_custkey") % 14 / 10).alias("difficulty"))
    nodes = nation.select(F.col("n_nationkey").alias("node_id"), F.col("n_name").alias("name"), F.array().cast("array<string>").alias("aliases"), F.lower("n_name").alias("path"), F.col("n_nationkey").alias("at"))
    return _flat(tagging.tag_listed(answers, nodes, F.lit("geography")))


@query(
    """WITH p AS (SELECT p_partkey, p_name, min(p_partkey) OVER (PARTITION BY p_name) AS node FROM part)
    SELECT p_partkey AS key, 0.25::DOUBLE AS difficulty, 0 AS pos, CASE WHEN p_partkey % 5 = 0 THEN 'kp_' || left(md5('parts:zz' || p_partkey), 10) ELSE node::VARCHAR END AS id, CASE WHEN p_partkey % 5 = 0 THEN 'zz' || p_partkey ELSE p_name END AS name, p_partkey % 5 > 0 AS in_tree FROM p"""
)
def points_retrieved(spark, d):
    """Parts as questions and as leaves: a choice among the candidates of a part's name, a choice that is none of them, and names that no leaf has."""
    parts = table(spark, d, "part", "p_partkey", "p_name")
    key = F.col("p_partkey")
    nodes = parts.groupBy("p_name").agg(F.min("p_partkey").alias("node_id")).select("node_id", F.col("p_name").alias("name"), F.array().cast("array<string>").alias("aliases"), F.concat(F.lit("parts/"), "p_name").alias("path"))
    names = F.when(key % 5 == 0, F.array(F.concat(F.lit("zz"), key.cast("string")))).otherwise(F.array(F.upper("p_name")))
    chosen = F.when(key % 2 == 0, F.array(key)).otherwise(F.array(F.lit(-1).cast("long"), key + 1_000_000_000))
    answers = parts.select(key.alias("key"), names.alias("names"), chosen.alias("chosen"), F.lit(" 0.25").alias("difficulty"))
    return _flat(tagging.tag_retrieved(answers, nodes, F.lit("parts")))


@query(
    """WITH l AS (SELECT l_orderkey AS paper, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
    q AS (SELECT *, p % 4 AS m, n < 6 AND p % 4 >= 2 AS cuts FROM l), w AS (SELECT *, CASE WHEN cuts THEN m ELSE 1 END AS rows, p % 9 + 4 AS score FROM q),
    v AS (SELECT *, coalesce(sum(rows - 1) OVER (PARTITION BY paper ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS moved FROM w),
    t AS (SELECT *, unnest(range(rows)) AS i FROM v)
    SELECT paper, (n + moved + i)::INT AS no, CASE WHEN cuts THEN i::INT END AS part,
    CASE WHEN cuts THEN 'Q' || p || ' （' || (i + 1) || '）ask' ELSE 'Q' || p || ' ' || array_to_string(list_transform(range(1, m + 1), lambda x: '（' || x || '）ask '), '') END AS stem,
    (CASE WHEN NOT cuts THEN score WHEN i = m - 1 THEN score - score // m * (m - 1) ELSE score // m END)::BIGINT AS score,
    CASE WHEN p % 3 > 0 THEN CASE WHEN NOT cuts OR i = 0 THEN 'one' END WHEN cuts THEN substr('⑴⑵⑶', (i + 1)::INT, 1) || p ELSE array_to_string(list_transform(range(1, m + 1), lambda x: substr('⑴⑵⑶', x::INT, 1) || p || ' '), '') END AS answer FROM t"""
)
def split_at_marks(spark, d):
    """Orders as papers: of their first five lines those with two or three marked parts are split, scores and answers dealt, later numbers moved."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    p = F.col("p").cast("string")
    upto = lambda f: F.array_join(F.slice(F.array(*[f(i) for i in (1, 2, 3)]), 1, (F.col("p") % 4).cast("int")), "")
    stem = F.concat(F.lit("Q"), p, F.lit(" "), upto(lambda i: F.lit(f"（{i}）ask ")))
    answer = F.when(F.col("p") % 3 == 0, upto(lambda i: F.concat(F.lit("⑴⑵⑶"[i - 1]), p, F.lit(" ")))).otherwise("one")
    rows = lines.select(F.col("l_orderkey").alias("paper"), F.col("l_linenumber").cast("int").alias("no"), stem.alias("stem"), (F.col("p") % 9 + 4).cast("long").alias("score"), answer.alias("answer"))
    return mutate.split_questions(rows, ["paper"], "no", F.col("no") < 6, "stem", "score", "answer", [])
