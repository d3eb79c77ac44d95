"""Lexical and vector similarity, duplicates of questions and papers."""

from pyspark.sql import functions as F

from itemloom.functions.maths import cosine, hamming, sign_bits, usable_vector
from itemloom.functions.text import estimate_tokens, normalize
from itemloom.operators import similarity as sim
from itemloom.operators import vectors
from itemloom.plans.registry import query
from itemloom.sources.tables import table

_NORM = "regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace({}, '_{{2,}}|＿+|—{{2,}}|（\\s*）|\\(\\s*\\)', '', 'g'), '\\\\[a-zA-Z]+', '', 'g'), '[\\s$\\\\{{}}]', '', 'g')), '\\p{{P}}', '', 'g')"
_GRAMS = """SELECT {key}, g, count(*) AS n FROM (SELECT {key}, unnest(list_concat(list_transform(range(1, length(t)), lambda i: substr(t, i, 2)), list_transform(range(1, length(t) - 1), lambda i: substr(t, i, 3)))) AS g FROM {table}) GROUP BY 1, 2"""


@query(f"SELECT item_id, {_NORM.format('text')} AS normal, length(text) AS n FROM benchmark")
def normalized_text(spark, d):
    return table(spark, d, "benchmark").select("item_id", normalize(F.col("text")).alias("normal"), F.length("text").cast("long").alias("n"))


_PAIRS = f"""WITH a AS (SELECT item_id AS ka, {_NORM.format('text')} AS t FROM benchmark), b AS (SELECT p_partkey AS kb, lower(p_name || ' ' || p_type) AS t0, {_NORM.format("p_name || ' ' || p_type")} AS t FROM part),
 ga AS ({_GRAMS.format(key='ka', table='a')}), gb AS ({_GRAMS.format(key='kb', table='b')}), na AS (SELECT ka, sqrt(sum(n * n)) AS l FROM ga GROUP BY 1), nb AS (SELECT kb, sqrt(sum(n * n)) AS l FROM gb GROUP BY 1),
 p AS (SELECT ka, kb, sum(ga.n * gb.n) / (any_value(na.l) * any_value(nb.l)) AS lexical FROM ga JOIN gb USING (g) JOIN na USING (ka) JOIN nb USING (kb) GROUP BY 1, 2)"""


@query(f"{_PAIRS} SELECT ka, kb, round(lexical, 4) AS lexical, (row_number() OVER (PARTITION BY ka ORDER BY round(lexical, 4) DESC, kb))::INT AS rank FROM p WHERE lexical >= 0.02 QUALIFY row_number() OVER (PARTITION BY ka ORDER BY round(lexical, 4) DESC, kb) <= 3")
def lexical_topk(spark, d):
    """The three parts whose text is nearest to each benchmark item."""
    parts = table(spark, d, "part", "p_partkey", "p_name", "p_type").select("p_partkey", F.concat_ws(" ", "p_name", "p_type").alias("text"))
    return sim.nearest_texts(table(spark, d, "benchmark"), parts, "item_id", "p_partkey", F.col("text"), 3, 0.02, apart=False)


_TEXT = "p_name || ' ' || p_type || ' ' || p_brand"
_SELF = f"""WITH b AS (SELECT p_partkey AS kb, {_NORM.format(_TEXT)} AS t FROM part), a AS (SELECT kb AS ka, t FROM b WHERE kb % 100 = 0),
 ga AS ({_GRAMS.format(key='ka', table='a')}), gb AS ({_GRAMS.format(key='kb', table='b')}), na AS (SELECT ka, sqrt(sum(n * n)) AS l FROM ga GROUP BY 1), nb AS (SELECT kb, sqrt(sum(n * n)) AS l FROM gb GROUP BY 1),
 p AS (SELECT ka, kb, sum(ga.n * gb.n) / (any_value(na.l) * any_value(nb.l)) AS lexical FROM ga JOIN gb USING (g) JOIN na USING (ka) JOIN nb USING (kb) WHERE ka <> kb GROUP BY 1, 2)"""


@query(f"{_SELF} SELECT ka, kb AS duplicate_of, round(lexical, 4) AS score FROM p WHERE lexical >= 0.85 QUALIFY row_number() OVER (PARTITION BY ka ORDER BY round(lexical, 4) DESC, kb) = 1")
def dedupe_top1(spark, d):
    """Every hundredth part against all others: the nearest text from 0.85 on."""
    parts = table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_brand")
    return sim.duplicate_of(sim.nearest_texts(parts.where("p_partkey % 100 = 0"), parts, "p_partkey", "p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand"), 1, sim.DUPLICATE))


_COS = "list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[])"


@query(f"SELECT q.vec_id AS kq, e.vec_id AS kr, round({_COS}, 4) AS cos, (row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 4) DESC, e.vec_id))::INT AS rank FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0 AND {_COS} >= 0.1 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY round({_COS}, 4) DESC, e.vec_id) <= 5")
def vector_topk(spark, d):
    """Queries are the vectors whose id is divisible by 100, against all of their label."""
    rows = table(spark, d, "embeddings")
    pairs = vectors.nearest(rows.where("vec_id % 100 = 0"), rows, "vec_id", "vec_id", "embedding", ["label"], 5)
    return sim.top_k(pairs, "kq", "cos", "kr", 5, 0.1)


@query(
    f"""{_SELF}, v AS (SELECT p_partkey AS k, p_partkey % 10 AS grade, CASE WHEN p_size % 4 = 0 THEN 'draft' ELSE 'bank' END AS kind, CASE WHEN p_size % 3 > 0 THEN embedding END AS embedding FROM part LEFT JOIN embeddings ON p_partkey = vec_id),
    s AS (SELECT q.k AS ka, e.k AS kb, e.kind, {_COS} AS cos FROM v q JOIN v e ON q.grade = e.grade AND q.k <> e.k WHERE q.k % 100 = 0), m AS (SELECT s.ka, s.kb, kind, coalesce(lexical, 0) AS lexical, cos FROM s LEFT JOIN p ON p.ka = s.ka AND p.kb = s.kb),
    c AS (SELECT *, CASE WHEN cos IS NULL THEN lexical ELSE 0.5 * lexical + 0.5 * greatest(0.0::DOUBLE, least(1.0::DOUBLE, (cos - 0.6) / 0.35)) END AS score FROM m)
    SELECT ka AS kq, kind, kb AS kr, round(score, 4) AS score, round(lexical, 4) AS lexical, round(cos, 4) AS cos, (row_number() OVER (PARTITION BY ka ORDER BY round(score, 4) DESC, kind, kb))::INT AS rank FROM c WHERE score >= 0.3 QUALIFY row_number() OVER (PARTITION BY ka ORDER BY round(score, 4) DESC, kind, kb) <= 5"""
)
def hybrid_search(spark, d):
    """All parts by their texts and, where they have one, vectors; every hundredth as a query within its grade; saved ones before drafts of one score."""
    parts = table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_brand", "p_size")
    found = table(spark, d, "embeddings", "vec_id", "embedding")
    rows = parts.join(found, parts.p_partkey == found.vec_id, "left").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"), F.when(F.col("p_size") % 3 > 0, F.col("embedding")).alias("vector"), F.when(F.col("p_size") % 4 == 0, "draft").otherwise("bank").alias("kind"), (F.col("p_partkey") % 10).alias("grade"))
    return sim.hybrid_search(rows.where("p_partkey % 100 = 0"), rows, "p_partkey", "text", "vector", "kind", ["grade"])


@query("SELECT a.vec_id AS kq, b.vec_id AS kr, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: ((z[1] > 0) <> (z[2] > 0))::INT))::INT AS bits, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS cos FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 100 = 0")
def quantised_hamming(spark, d):
    """Every hundredth vector's sign bits against those of all of its label."""
    rows = table(spark, d, "embeddings", "vec_id", "label", "embedding")
    asked = lambda df: df.where("vec_id % 100 = 0")
    near = vectors.compared(asked(rows), rows, "vec_id", "vec_id", "embedding", ["label"])
    # Pairs of another kind: a vector that can't be compared, or, in labels of several sizes, two sizes.
    fine = usable_vector(F.col("embedding"))
    mixed = rows.where(fine).groupBy("label").agg(F.count_distinct(F.size("embedding")).alias("n")).where("n > 1").select("label")
    sized = rows.where(fine).join(mixed, "label", "left_semi")
    odd = _side_by_side(asked(rows), rows.where(~fine)).unionByName(_side_by_side(asked(rows).where(~fine), rows.where(fine)))
    odd = odd.unionByName(_side_by_side(asked(sized), sized, F.size("va") != F.size("vb")))
    each = odd.select("kq", "kr", hamming(sign_bits(F.col("va")), sign_bits(F.col("vb"))).cast("int").alias("bits"), cosine(F.col("va"), F.col("vb")).alias("cos"))
    return near.unionByName(each).withColumn("cos", F.round("cos", 6))


def _side_by_side(asked, rows, on=None):
    a, b = asked.select(F.col("vec_id").alias("kq"), "label", F.col("embedding").alias("va")), rows.select(F.col("vec_id").alias("kr"), "label", F.col("embedding").alias("vb"))
    met = a.join(b, "label")
    return met if on is None else met.where(on)


@query(
    """WITH p AS (SELECT o_orderkey AS paper, (o_orderkey // 3)::VARCHAR AS h, o_orderkey % 5 = 0 AS keep, 'yearly paper ' || o_custkey AS title, o_orderpriority AS grade, 4 AS items FROM orders),
    f AS (SELECT a.paper, min(b.paper) AS other FROM p a JOIN p b ON a.h = b.h AND a.paper <> b.paper WHERE a.keep AND b.keep GROUP BY 1),
    t AS (SELECT a.paper, min(b.paper) AS other FROM p a JOIN p b ON a.title = b.title AND a.grade = b.grade AND a.paper <> b.paper GROUP BY 1),
    d AS (SELECT paper, min(paper + 1) AS other FROM p WHERE paper % 7 = 0 GROUP BY 1)
    SELECT paper, coalesce(f.other, t.other, d.other) AS other, CASE WHEN f.other IS NOT NULL THEN 'same_file' WHEN t.other IS NOT NULL THEN 'same_title' ELSE 'most_questions' END AS reason FROM p LEFT JOIN f USING (paper) LEFT JOIN t USING (paper) LEFT JOIN d USING (paper) WHERE coalesce(f.other, t.other, d.other) IS NOT NULL"""
)
def duplicate_paper_check(spark, d):
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderpriority")
    k = F.col("o_orderkey")
    papers = orders.select(k.alias("id"), F.when(k % 5 == 0, F.floor(k / 3).cast("string")).alias("h"), F.concat(F.lit("yearly paper "), F.col("o_custkey").cast("string")).alias("title"), F.col("o_orderpriority").alias("grade"), F.lit(4).alias("n"))
    found = orders.where("o_orderkey % 7 = 0").select(k.alias("paper"), (k + 1).alias("other"), F.lit(3).alias("duplicates"))
    return sim.duplicate_paper(papers, found, "id", "h", "title", ["grade"], "n")


@query(
    f"""WITH b AS (SELECT p_partkey AS k, p_partkey // 5 AS paper, p_type AS kind, {_NORM.format(_TEXT)} AS t FROM part), g AS ({_GRAMS.format(key='k', table='b')}), l AS (SELECT k, sqrt(sum(n * n)) AS l FROM g GROUP BY 1),
    k AS (SELECT g.k, gram_kind.kind, g.g, g.n FROM g JOIN b AS gram_kind ON g.k = gram_kind.k), p AS (SELECT x.k AS ka, y.k AS kb, sum(x.n * y.n) / (any_value(lx.l) * any_value(ly.l)) AS lexical FROM k x JOIN k y ON x.g = y.g AND x.kind = y.kind AND x.k // 5 <> y.k // 5 JOIN l lx ON lx.k = x.k JOIN l ly ON ly.k = y.k GROUP BY 1, 2),
    d AS (SELECT ka, kb FROM p WHERE lexical >= 0.85 QUALIFY row_number() OVER (PARTITION BY ka ORDER BY round(lexical, 4) DESC, kb) = 1), v AS (SELECT ka // 5 AS paper, kb // 5 AS other, count(*) AS n FROM d GROUP BY 1, 2),
    q AS (SELECT paper, count(*) AS items, 'exam of ' || min(p_name) AS title, paper % 3 AS grade, CASE WHEN paper % 7 = 0 THEN paper // 14 END AS h FROM part JOIN b ON k = p_partkey GROUP BY paper),
    f AS (SELECT x.paper, min(y.paper) AS other FROM q x JOIN q y ON x.h = y.h AND x.paper <> y.paper GROUP BY 1),
    s AS (SELECT x.paper, min(y.paper) AS other FROM q x JOIN q y ON x.title = y.title AND x.grade = y.grade AND x.paper <> y.paper WHERE x.paper % 2 = 1 AND y.paper % 2 = 1 GROUP BY 1),
    m AS (SELECT paper, other FROM v JOIN q USING (paper) WHERE n >= 3 AND n >= 0.5 * items QUALIFY row_number() OVER (PARTITION BY paper ORDER BY n DESC, other) = 1)
    SELECT q.paper, coalesce(f.other, s.other, m.other) AS other, CASE WHEN f.other IS NOT NULL THEN 'same_file' WHEN s.other IS NOT NULL THEN 'same_title' ELSE 'most_questions' END AS reason FROM q LEFT JOIN f USING (paper) LEFT JOIN s USING (paper) LEFT JOIN m USING (paper) WHERE coalesce(f.other, s.other, m.other) IS NOT NULL"""
)
def duplicate_papers_by_votes(spark, d):
    """Papers of five parts each: same files, same titles within a grade, and real counts of near-equal questions of one type in one other paper."""
    parts = table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_brand").withColumn("paper", F.floor(F.col("p_partkey") / 5))
    owners = parts.select(F.col("p_partkey").alias("question"), "paper")
    votes = sim.paper_votes(sim.duplicates_elsewhere(parts, "p_partkey", "paper", F.concat_ws(" ", "p_name", "p_type", "p_brand"), ["p_type"]), owners)
    title = F.when(F.col("paper") % 2 == 1, F.concat(F.lit("exam of "), F.min("p_name"))).alias("title")
    papers = parts.groupBy("paper").agg(F.count(F.lit(1)).alias("items"), title, F.when(F.col("paper") % 7 == 0, F.floor(F.col("paper") / 14)).alias("h")).withColumn("grade", F.col("paper") % 3)
    return sim.duplicate_paper(papers, votes, "paper", "h", "title", ["grade"], "items")


@query("SELECT item_id, (length(regexp_replace(text, '[^一-鿿]', '', 'g')) + ceil((length(text) - length(regexp_replace(text, '[^一-鿿]', '', 'g'))) / 4.0))::BIGINT AS tokens FROM benchmark")
def token_estimates(spark, d):
    return table(spark, d, "benchmark").select("item_id", estimate_tokens(F.col("text")).alias("tokens"))


@query()
def node_matches(spark, d):
    """Part types and names matched to concepts named after parts."""
    nodes = table(spark, d, "part", "p_partkey", "p_name").groupBy("p_name").agg(F.min("p_partkey").alias("node_id")).select("node_id", F.concat(F.lit("1.2 "), F.col("p_name")).alias("name"), F.array().cast("array<string>").alias("aliases"))
    names = table(spark, d, "part", "p_name").select(F.upper("p_name").alias("name")).distinct()
    return sim.node_matches(names, nodes, 3)
