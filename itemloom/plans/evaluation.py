"""Evaluation against a gold standard and difficulty calibration."""

from pyspark.sql import functions as F

from itemloom.functions.maths import difficulty, jaccard
from itemloom.functions.text import answer_letters, answers_equal, normalize
from itemloom.operators import evaluate, vectors
from itemloom.operators import similarity as sim
from itemloom.plans.registry import query
from itemloom.plans.similar import _GRAMS, _NORM, _TEXT
from itemloom.sources.tables import cut, table


@query(
    """WITH r AS (SELECT l_discount * 10 AS x, 0.8 * l_discount * 10 + 0.1 + (l_linenumber - 4) / 100.0::DOUBLE AS y FROM lineitem), f AS (SELECT count(*) AS n, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM r)
    SELECT n, round(a, 4) AS slope, round(b, 4) AS intercept, round((SELECT avg(abs(y - greatest(0.02, least(0.98, x)))) FROM r), 4) AS mae_before, round((SELECT avg(abs(y - greatest(0.02, least(0.98, a * x + b)))) FROM r), 4) AS mae_after FROM f"""
)
def difficulty_fit(spark, d):
    rows = table(spark, d, "lineitem", "l_discount", "l_linenumber").select((F.col("l_discount") * 10).alias("x"), (F.lit(0.8) * F.col("l_discount") * 10 + 0.1 + (F.col("l_linenumber") - 4) / F.lit(100.0)).alias("y"))
    return evaluate.fit_line(rows, "x", "y")


@query("SELECT lang, count(*) FILTER (quality IS NOT NULL) AS quality_n, count(*) FILTER (quality IS NOT NULL AND quality = 1) AS quality_ok, count(*) FILTER (n_chars > 1000) AS flag_n, count(*) FILTER (n_chars > 1000 AND toxic = 0) AS flag_ok, round(count(*) FILTER (quality = 1) / nullif(count(*) FILTER (quality IS NOT NULL), 0)::DOUBLE, 4) AS quality_ratio, round(count(*) FILTER (n_chars > 1000 AND toxic = 0) / nullif(count(*) FILTER (n_chars > 1000), 0)::DOUBLE, 4) AS flag_ratio FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1")
def eval_counters(spark, d):
    rows = table(spark, d, "documents", "doc_id", "lang", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    return evaluate.counters(rows, ["lang"], {"quality": (F.col("quality").isNotNull(), F.coalesce(F.col("quality") == 1, F.lit(False))), "flag": (F.col("n_chars") > 1000, F.coalesce(F.col("toxic") == 0, F.lit(False)))})


_SAMPLES = f"""WITH b AS (SELECT p_partkey AS k, p_partkey // 50 AS sample, {_NORM.format(_TEXT)} AS t FROM part), g AS ({_GRAMS.format(key='k', table='b')}), l AS (SELECT k, sqrt(sum(n * n)) AS l FROM g GROUP BY 1)
    SELECT x.k // 50 AS sample, x.k AS gold, y.k AS pred, round(sum(x.n * y.n) / (any_value(lx.l) * any_value(ly.l)), 6) AS lexical FROM g x JOIN g y ON x.g = y.g AND x.k // 50 = y.k // 50 AND x.k % 2 = 0 AND y.k % 2 = 1 JOIN l lx ON lx.k = x.k JOIN l ly ON ly.k = y.k GROUP BY 1, 2, 3 HAVING sum(x.n * y.n) / (any_value(lx.l) * any_value(ly.l)) >= 0.5"""


def _gold_and_found(spark, d):
    """Parts of even and odd ids within samples of fifty, by the likeness of their texts."""
    parts = table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_brand").withColumn("sample", F.floor(F.col("p_partkey") / 50))
    grams = cut(sim.gram_table(parts, "p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand"), ["sample"]))
    pairs = sim.near_texts(grams.where("p_partkey % 2 = 0"), grams.where("p_partkey % 2 = 1"), "p_partkey", "p_partkey", sim.MATCH, same=["sample"])
    return pairs.select(F.floor(F.col("ka") / 50).alias("sample"), F.col("ka").alias("gold"), F.col("kb").alias("pred"), "lexical")


@query(_SAMPLES)
def gold_candidates(spark, d):
    """All pairs of a gold and a found text of one sample that are half alike or more."""
    return _gold_and_found(spark, d).withColumn("lexical", F.round("lexical", 6))


@query()
def greedy_text_match(spark, d):
    """Gold and found texts paired one to one within samples, most similar first."""
    return evaluate.greedy_match(_gold_and_found(spark, d), "sample", "gold", "pred", "lexical")


@query()
def greedy_match(spark, d):
    """Vectors of even and odd ids paired one to one within samples of fifty ids, most similar first."""
    rows = table(spark, d, "embeddings", "vec_id", "embedding").withColumn("sample", F.floor(F.col("vec_id") / 50))
    pairs = vectors.nearest(rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1"), "vec_id", "vec_id", "embedding", ["sample"], 50)
    met = pairs.select(F.floor(F.col("kq") / 50).alias("sample"), "kq", "kr", "cos")
    return evaluate.greedy_match(met, "sample", "kq", "kr", "cos", 0.1)


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, round(greatest(0.02, least(0.98, CASE WHEN l_returnflag = 'A' THEN 0.7::DOUBLE * (l_tax * 10) + (1 - 0.7::DOUBLE) * (l_discount * 10) ELSE l_discount * 10 END)), 2) AS coef FROM lineitem")
def combined_difficulty(spark, d):
    """Seven parts of a model's estimate, where there is one, to three of the baseline."""
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_discount", "l_tax", "l_returnflag")
    ai = F.when(F.col("l_returnflag") == "A", F.col("l_tax") * 10)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", difficulty(ai, F.col("l_discount") * 10).alias("coef"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN true WHEN 1 THEN p_size % 2 = 0 WHEN 2 THEN p_size % 3 = 0 ELSE false END AS same FROM part")
def equal_answers(spark, d):
    """Letters in any dress, words that normalise alike, nearly alike by their grams, and no answer."""
    k, size = F.col("p_partkey") % 4, F.col("p_size")
    gold = F.when(k < 2, "A、C").otherwise(F.col("p_name"))
    pred = F.when(k == 0, " a,c.").when(k == 1, F.when(size % 2 == 0, "AC").otherwise("AD")).when(k == 2, F.when(size % 3 == 0, F.concat(F.upper("p_name"), F.lit("！"))).otherwise("nothing")).otherwise("")
    return table(spark, d, "part", "p_partkey", "p_size", "p_name").select("p_partkey", answers_equal(k < 2, gold, pred, F.lit(None).cast("double"), normalize(gold), normalize(pred)).alias("same"))


@query("WITH s AS (SELECT l_orderkey, list(DISTINCT l_suppkey) AS a FROM lineitem GROUP BY 1) SELECT x.l_orderkey, round(len(list_intersect(x.a, y.a)) / len(list_distinct(list_concat(x.a, y.a)))::DOUBLE, 4) AS overlap FROM s x JOIN s y ON x.l_orderkey + 1 = y.l_orderkey")
def group_overlap(spark, d):
    sets = table(spark, d, "lineitem", "l_orderkey", "l_suppkey").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("a"))
    nxt = sets.select((F.col("l_orderkey") - 1).alias("l_orderkey"), F.col("a").alias("b"))
    return sets.join(nxt, "l_orderkey").select("l_orderkey", F.round(jaccard(F.col("a"), F.col("b")), 4).alias("overlap"))


@query("SELECT item_id, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(text), '[A-H]'))), '') AS letters FROM benchmark")
def answer_letter_sets(spark, d):
    return table(spark, d, "benchmark").select("item_id", answer_letters(F.col("text")).alias("letters"))


_PAIRED = "WITH k AS (SELECT p_partkey AS g FROM part), e AS (SELECT g, g // 50 AS sample FROM k WHERE g % 2 = 0), p AS (SELECT e.* FROM e JOIN k ON k.g = e.g + 1)"


def _sheets(spark, d):
    """(gold, found, pairs): parts of even ids as gold questions, each next odd one as what was found of it."""
    parts = table(spark, d, "part", "p_partkey")
    k = F.col("p_partkey")
    g, s = F.when(k % 2 == 0, k).otherwise(k - 1), lambda c: c.cast("string")
    odd, choice = k % 2 == 1, g % 3 == 0
    name = F.concat(F.lit("Point "), s(g % 6))
    rows = parts.select(
        F.floor(k / 50).alias("sample"), k.alias("no"), F.when(choice & ~(odd & (g % 5 == 0)), "单选题").otherwise("填空题").alias("type"),
        F.array_repeat(F.lit("x"), (g % 4 + F.when(odd & (g % 7 == 0), 2).otherwise(1)).cast("int")).alias("options"),
        F.when(choice, F.when(~odd, "A、C").when(g % 4 == 0, "b").otherwise("a, c.")).otherwise(F.when(odd & (g % 4 == 0), "nothing").when(odd & (g % 16 == 2), F.concat(F.lit("it is a longer answer, whose number is "), s(g), F.lit(" ."))).when(odd, F.concat(F.lit("IT IS A longer answer whose number is "), s(g))).otherwise(F.concat(F.lit("It is a longer answer, whose number is "), s(g)))).alias("answer"),
        F.when(g % 10 == 0, "model").otherwise("paper").alias("answer_source"), F.when(g % 4 == 0, "manual").otherwise("model").alias("difficulty_source"),
        F.when(g % 12 != 0, F.array(F.struct(F.when(odd, "other").otherwise(s(g)).alias("id"), F.when(~odd, name).when(g % 8 == 0, "another").otherwise(F.concat(F.lit("1.2 "), F.upper(name))).alias("name")))).alias("points"),
        F.when(odd, g % 10 / 20 + 0.2).otherwise(g % 10 / 10).alias("coef"),
    )
    gold, found = rows.where("no % 2 = 0"), rows.where("no % 2 = 1").drop("answer_source", "difficulty_source")
    pairs = gold.select("sample", F.col("no").alias("gold")).join(found.select("sample", F.col("no").alias("pred"), (F.col("no") - 1).alias("gold")), ["sample", "gold"])
    return gold, found, pairs


@query(
    _PAIRED + """, c AS (SELECT sample, count(*) AS matched, count_if(NOT (g % 3 = 0 AND g % 5 = 0)) AS type_ok, count_if(g % 3 = 0) AS options_n, count_if(g % 3 = 0 AND g % 7 > 0) AS options_ok,
    count_if(g % 10 > 0) AS answer_n, count_if(g % 10 > 0 AND g % 4 > 0) AS answer_ok, count_if(g % 12 > 0) AS points_n, count_if(g % 12 > 0 AND g % 8 > 0) AS points_ok, round(avg(CASE WHEN g % 4 = 0 THEN abs((g % 10) / 10.0::DOUBLE - ((g % 10) / 20.0::DOUBLE + 0.2::DOUBLE)) END), 4) AS difficulty_mae FROM p GROUP BY 1),
    a AS (SELECT sample, count(*) AS n_gold FROM e GROUP BY 1), b AS (SELECT g // 50 AS sample, count(*) AS n_found FROM k WHERE g % 2 = 1 GROUP BY 1),
    r AS (SELECT sample, n_gold, coalesce(n_found, 0) AS n_found, coalesce(matched, 0) AS matched, coalesce(matched, 0) AS type_n, coalesce(type_ok, 0) AS type_ok, coalesce(options_n, 0) AS options_n, coalesce(options_ok, 0) AS options_ok, coalesce(answer_n, 0) AS answer_n, coalesce(answer_ok, 0) AS answer_ok, coalesce(points_n, 0) AS points_n, coalesce(points_ok, 0) AS points_ok, difficulty_mae FROM a LEFT JOIN b USING (sample) LEFT JOIN c USING (sample))
    SELECT *, points_n AS points_gold, points_ok AS points_found, round(type_ok / nullif(type_n, 0), 4) AS type_ratio, round(options_ok / nullif(options_n, 0), 4) AS options_ratio, round(answer_ok / nullif(answer_n, 0), 4) AS answer_ratio, round(points_ok / nullif(points_n, 0), 4) AS points_ratio, round(matched / nullif(n_found, 0), 4) AS precision, round(matched / nullif(n_gold, 0), 4) AS recall, round(points_ok / nullif(points_n, 0), 4) AS points_recall FROM r"""
)
def sample_comparison(spark, d):
    """Metrics of each sample of found questions: kinds, options, answers (letters, words, and nearly the same ones), points by name, difficulty."""
    gold, found, pairs = _sheets(spark, d)
    return evaluate.sample_metrics(evaluate.compare(gold, found, pairs), gold, found)


@query(_PAIRED + " SELECT count_if(g % 4 = 0) AS n, 1.0::DOUBLE AS slope, 0.0::DOUBLE AS intercept FROM p")
def raw_calibration(spark, d):
    """A new calibration from estimates that the old one (half, and two tenths) has been taken off again: these were right."""
    rows = evaluate.compare(*_sheets(spark, d), F.lit(0.5), F.lit(0.2)).where("rated")
    return evaluate.fit_line(rows, "raw", "coef").select("n", "slope", F.abs("intercept").alias("intercept"))
