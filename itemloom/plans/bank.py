"""Search, scope, paging and review."""

from pyspark.sql import functions as F

from itemloom.functions.text import first_filled, province, term, year_matches, years
from itemloom.operators import bank
from itemloom.operators.facets import always_shown, fixed_order, folded, meta_facets, self_excluding
from itemloom.operators.mutate import apply_embeddings, merge_points, needs_embedding, sync, upsert
from itemloom.plans.registry import query
from itemloom.sources.tables import table


def _doc_bank(spark, d):
    """Documents as questions: difficulty by length, reviewed by quality, flagged by toxicity."""
    docs = table(spark, d, "documents", "doc_id", "lang", "source", "n_chars")
    return docs.join(table(spark, d, "labels"), "doc_id", "left").withColumn("coef", F.least(F.col("n_chars") / 5000, F.lit(1.0)))


_DOC_BANK = "SELECT d.doc_id, lang, source, n_chars, quality, toxic, least(n_chars / 5000.0::DOUBLE, 1.0::DOUBLE) AS coef FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


@query(f"SELECT doc_id, source, round(coef, 4) AS coef FROM ({_DOC_BANK}) WHERE lang = 'en' AND coef > 0.3 AND coef <= 0.6 ORDER BY coef DESC, doc_id LIMIT 50 OFFSET 20")
def bank_search_page(spark, d):
    found = bank.search(_doc_bank(spark, d), bank.BankFilter(equal={"lang": "en", "source": None}, band="medium"))
    return bank.page(found, [F.desc_nulls_first("coef"), F.asc("doc_id")], 20, 50).select("doc_id", "source", F.round("coef", 4).alias("coef"))


@query("SELECT doc_id, lang, n_chars, length(text) AS text_length FROM documents ORDER BY n_chars DESC, doc_id LIMIT 25")
def late_materialised_page(spark, d):
    docs = table(spark, d, "documents")
    page = bank.late_page(docs, "doc_id", [F.desc("n_chars"), F.asc("doc_id")], ["n_chars"], 0, 25)
    return page.select("doc_id", "lang", "n_chars", F.length("text").cast("long").alias("text_length"))


_NORMAL = "regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace({}, '_{{2,}}|＿+|—{{2,}}|（\\s*）|\\(\\s*\\)', '', 'g'), '\\\\[a-zA-Z]+', '', 'g'), '[\\s$\\\\{{}}]', '', 'g')), '\\p{{P}}', '', 'g')"


@query(f"SELECT doc_id, source FROM documents WHERE contains({_NORMAL.format("concat_ws(' ', text, source)")}, 'license')")
def keyword_search(spark, d):
    docs = table(spark, d, "documents", "doc_id", "text", "source")
    return bank.search(docs, bank.BankFilter(keyword="LICENSE.", keyword_columns=("text", "source"))).select("doc_id", "source")


@query("SELECT p_partkey, p_name FROM part WHERE contains(concat_ws(' ', p_name, p_type), 'ring') OR contains(concat_ws(' ', p_name, p_type), 'ECONOMY')")
def any_word_search(spark, d):
    parts = table(spark, d, "part", "p_partkey", "p_name", "p_type")
    return bank.search(parts, bank.BankFilter(any_words=("ring", "ECONOMY"), any_columns=("p_name", "p_type"))).select("p_partkey", "p_name")


@query("SELECT lang, count(*) AS total, count(*) FILTER (n_chars < 500) AS short, count(*) FILTER (quality = 1) AS reviewed, count(*) FILTER (toxic = 1) AS flagged FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY lang")
def filtered_counts(spark, d):
    return _doc_bank(spark, d).groupBy("lang").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("n_chars") < 500).alias("short"), F.count_if(F.col("quality") == 1).alias("reviewed"), F.count_if(F.col("toxic") == 1).alias("flagged"))


@query("SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def unsaved_drafts(spark, d):
    return bank.not_yet_saved(table(spark, d, "documents", "doc_id", "lang"), table(spark, d, "labels", "doc_id"), "doc_id", "doc_id")


def _scope_rows(spark, d):
    orders = table(spark, d, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    who = table(spark, d, "customer", "c_custkey", "c_mktsegment")
    return orders.join(who, orders.o_custkey == who.c_custkey).withColumn("reviewed", F.col("o_orderstatus") == "F")


@query("SELECT p_partkey FROM part WHERE p_name LIKE '%gear' OR p_name LIKE '%ring'")
def keyword_full_width(spark, d):
    """Names in full-width letters with punctuation, found by plain words; a keyword of punctuation alone filters nothing."""
    wide = F.translate("p_name", "abcdefghijklmnopqrstuvwxyz ", "ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ，")
    parts = table(spark, d, "part", "p_partkey", "p_name").withColumn("wide", wide)
    find = lambda word: bank.search(parts, bank.BankFilter(keyword=word, keyword_columns=("wide",)))
    every = bank.search(find("Gear").unionByName(find("ＲＩＮＧ")), bank.BankFilter(keyword="（ ）", keyword_columns=("wide",)))
    return every.select("p_partkey")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_custkey IN (4, 58, 84) AND c_mktsegment = 'MACHINERY' AND o_orderstatus = 'F'")
def scoped_member_view(spark, d):
    rows = _scope_rows(spark, d)
    views = [bank.scoped(rows, "member", user, "MACHINERY", "o_custkey", "reviewed", "c_mktsegment") for user in (4, 58, 84)]
    return views[0].unionByName(views[1]).unionByName(views[2]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def scoped_leader_view(spark, d):
    return bank.scoped(_scope_rows(spark, d), "leader", None, "MACHINERY", subject_of="c_mktsegment").select("o_orderkey", "o_totalprice")


_PAPER_SCOPE = "SELECT o_orderkey AS paper, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS subject, CASE WHEN o_orderkey % 2 = 0 THEN '1-URGENT' ELSE '2-HIGH' END AS scope FROM orders"


@query(f"SELECT 'leader' AS role, paper FROM ({_PAPER_SCOPE}) WHERE coalesce(nullif(subject, ''), scope) = '1-URGENT' UNION ALL SELECT DISTINCT 'member', l_orderkey FROM lineitem WHERE l_suppkey = 3 AND l_returnflag = 'R' AND l_linestatus = 'F'")
def scoped_papers(spark, d):
    """What a leader sees of the papers by subject or else scope, and a member by their own reviewed questions."""
    k = F.col("o_orderkey")
    papers = table(spark, d, "orders", "o_orderkey", "o_orderpriority").select(k.alias("paper"), F.when(k % 3 == 0, "").otherwise(F.col("o_orderpriority")).alias("subject"), F.when(k % 2 == 0, "1-URGENT").otherwise("2-HIGH").alias("scope"))
    items = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus").select(F.col("l_orderkey").alias("paper"), F.col("l_suppkey").alias("owner"), (F.col("l_linestatus") == "F").alias("reviewed"), F.col("l_returnflag").alias("subject"))
    seen = lambda role, user, subjects: bank.scoped_papers(papers, items, role, user, subjects).select(F.lit(role).alias("role"), "paper")
    return seen("leader", None, ["1-URGENT"]).unionByName(seen("member", 3, ["R"]))


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 4 = 0)")
def unknown_ids(spark, d):
    allowed = table(spark, d, "orders").where("o_orderstatus = 'F' AND o_orderkey % 4 = 0").select(F.col("o_custkey").alias("c_custkey"))
    return bank.unknown_ids(table(spark, d, "customer", "c_custkey"), allowed, "c_custkey")


@query("SELECT o_orderkey FROM orders WHERE nullif(o_orderpriority, '5-LOW') IS DISTINCT FROM '1-URGENT'")
def distinct_from_filter(spark, d):
    orders = table(spark, d, "orders", "o_orderkey", "o_orderpriority")
    return orders.where(~F.nullif(F.col("o_orderpriority"), F.lit("5-LOW")).eqNullSafe("1-URGENT")).select("o_orderkey")


_FACET_FILTERS = {"lang": "lang = 'en'", "band": "coef <= 0.6", "reviewed": "quality = 1"}
_FACETS = " UNION ALL ".join(
    f"SELECT '{dim}' AS dim, {value} AS value, count(*) AS items FROM ({_DOC_BANK}) WHERE {' AND '.join(f for k, f in _FACET_FILTERS.items() if k != dim)} GROUP BY 2"
    for dim, value in (("lang", "coalesce(nullif(lang, ''), 'unclassified')"), ("band", "CASE WHEN coef <= 0.3 THEN 'easy' WHEN coef <= 0.6 THEN 'medium' ELSE 'hard' END"), ("reviewed", "coalesce(quality::VARCHAR, 'unclassified')"))
)


@query(_FACETS)
def facets_self_excluding(spark, d):
    band = F.when(F.col("coef") <= 0.3, "easy").when(F.col("coef") <= 0.6, "medium").otherwise("hard")
    return self_excluding(_doc_bank(spark, d), {"lang": F.col("lang") == "en", "band": F.col("coef") <= 0.6, "reviewed": F.col("quality") == 1}, {"lang": F.col("lang"), "band": band, "reviewed": F.col("quality")})


@query("SELECT o_orderpriority AS value, count(*) AS items, (CASE o_orderpriority WHEN '1-URGENT' THEN 1 WHEN '3-MEDIUM' THEN 2 ELSE 3 END)::INT AS position FROM orders GROUP BY 1")
def facet_fixed_order(spark, d):
    counts = table(spark, d, "orders", "o_orderpriority").groupBy(F.col("o_orderpriority").alias("value")).agg(F.count(F.lit(1)).alias("items"))
    return fixed_order(counts, "value", ["1-URGENT", "3-MEDIUM"])


@query("SELECT value, coalesce(items, 0) AS items FROM (VALUES ('BUILDING'), ('FURNITURE'), ('SCHOOL')) l(value) FULL JOIN (SELECT c_mktsegment AS value, count(*) AS items FROM customer GROUP BY 1) c USING (value)")
def facet_always_shown(spark, d):
    counts = table(spark, d, "customer", "c_mktsegment").groupBy(F.col("c_mktsegment").alias("value")).agg(F.count(F.lit(1)).alias("items"))
    return always_shown(spark, counts, "value", ["BUILDING", "FURNITURE", "SCHOOL"])


_META = "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE year(o_orderdate) || '-' || (year(o_orderdate) + 1) || ' 上' END AS school_year, o_orderpriority || ' ' || year(o_orderdate) || (CASE WHEN o_orderkey % 2 = 0 THEN '下学期' ELSE '' END) AS title, CASE WHEN o_orderkey % 4 = 0 THEN ' 浙江 · 杭州' WHEN o_orderkey % 4 = 1 THEN '北京/海淀' WHEN o_orderkey % 4 = 2 THEN '上海' ELSE '' END AS region FROM orders"


def _meta(spark, d):
    k, y = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    orders = table(spark, d, "orders", "o_orderkey", "o_orderdate", "o_orderpriority")
    year = F.when(k % 3 == 0, "").otherwise(F.concat(y, F.lit("-"), (F.year("o_orderdate") + 1).cast("string"), F.lit(" 上")))
    region = F.when(k % 4 == 0, " 浙江 · 杭州").when(k % 4 == 1, "北京/海淀").when(k % 4 == 2, "上海").otherwise("")
    return orders.select("o_orderkey", year.alias("school_year"), F.concat("o_orderpriority", F.lit(" "), y, F.when(k % 2 == 0, "下学期").otherwise("")).alias("title"), region.alias("region"))


@query(
    f"""WITH m AS ({_META}), e AS (SELECT o_orderkey, list_transform(regexp_extract_all(school_year || ' ' || title, '(^|[^0-9])((19|20)[0-9][0-9])', 2), lambda y: y::INT) AS ys,
    CASE WHEN school_year <> '' THEN '上' WHEN title LIKE '%下学期' THEN '下' ELSE '' END AS term, trim(regexp_extract(region, '^\\s*([^·•/]*)', 1)) AS province FROM m)
    SELECT o_orderkey, list_min(ys) AS first_year, list_contains(ys, 1997) AS in_1997, list_min(ys) < 1997 AS before_1997, term, province FROM e"""
)
def year_term_extract(spark, d):
    found = years(F.col("school_year"), F.col("title"))
    return _meta(spark, d).select("o_orderkey", F.array_min(found).alias("first_year"), year_matches(found, "1997").alias("in_1997"), year_matches(found, "<1997").alias("before_1997"), term(F.col("school_year"), F.col("title")).alias("term"), province(F.col("region")).alias("province"))


@query(
    """SELECT d.doc_id, coalesce(list_aggregate(list_sort(list_filter([CASE WHEN n_chars < 300 THEN 'short' END, CASE WHEN toxic = 1 THEN 'toxic' END, CASE WHEN quality IS NULL THEN 'unlabelled' END, CASE WHEN trim(text) = '' THEN 'empty' END], lambda x: x IS NOT NULL)), 'string_agg', ','), '') AS reasons
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
)
def review_reasons(spark, d):
    rows = table(spark, d, "documents", "doc_id", "text", "n_chars").join(table(spark, d, "labels"), "doc_id", "left")
    rules = {"short": F.col("n_chars") < 300, "toxic": F.col("toxic") == 1, "unlabelled": F.col("quality").isNull(), "empty": F.trim("text") == ""}
    return rows.select("doc_id", F.array_join(bank.review_reasons(rules), ",").alias("reasons"))


@query("SELECT c_custkey, concat_ws(' · ', c_name, nullif(c_mktsegment, 'BUILDING')) AS label FROM customer")
def display_label(spark, d):
    return table(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment").select("c_custkey", F.concat_ws(" · ", "c_name", F.nullif(F.col("c_mktsegment"), F.lit("BUILDING"))).alias("label"))


@query("SELECT doc_id, coalesce(l.toxic, 0)::INT AS toxic, (CASE WHEN n.doc_id IS NOT NULL THEN n.n ELSE l.quality END)::BIGINT AS quality FROM labels l FULL JOIN (SELECT doc_id, n_chars AS n FROM documents WHERE lang = 'fr') n USING (doc_id)")
def commit_upsert(spark, d):
    """French documents commit their length as quality and keep the flag that they had."""
    saved = table(spark, d, "labels").withColumn("quality", F.col("quality").cast("long"))
    new = table(spark, d, "documents", "doc_id", "lang", "n_chars").where("lang = 'fr'").select("doc_id", F.col("n_chars").alias("quality"), F.lit(0).alias("toxic"))
    return upsert(saved, new, "doc_id", keep=["toxic"]).select("doc_id", "toxic", "quality")


@query("SELECT key, CASE WHEN a.key IS NULL THEN 'insert' WHEN b.key IS NULL THEN 'delete' ELSE 'update' END AS action FROM (SELECT c_custkey AS key, c_mktsegment AS v FROM customer WHERE c_custkey % 3 > 0) a FULL JOIN (SELECT c_custkey AS key, CASE WHEN c_custkey % 5 = 0 THEN 'NEW' ELSE c_mktsegment END AS v FROM customer WHERE c_custkey % 4 > 0) b USING (key) WHERE a.v IS DISTINCT FROM b.v")
def sync_actions(spark, d):
    rows = table(spark, d, "customer", "c_custkey", "c_mktsegment").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("v"))
    new = rows.where("key % 4 > 0").withColumn("v", F.when(F.col("key") % 5 == 0, "NEW").otherwise(F.col("v")))
    return sync(rows.where("key % 3 > 0"), new, "key", ["v"])


@query("SELECT vec_id FROM embeddings WHERE label IS DISTINCT FROM 3")
def needs_new_vector(spark, d):
    rows = table(spark, d, "embeddings").withColumn("model", F.col("label").cast("string"))
    return needs_embedding(rows, "3", "embedding", "model").select("vec_id")


@query("SELECT c_custkey, coalesce(nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END, ''), nullif(n_name, ''), '') AS subject FROM customer JOIN nation ON c_nationkey = n_nationkey")
def attributed_subject(spark, d):
    who = table(spark, d, "customer", "c_custkey", "c_nationkey", "c_mktsegment")
    nation = table(spark, d, "nation", "n_nationkey", "n_name")
    own = F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment"))
    return who.join(F.broadcast(nation), who.c_nationkey == nation.n_nationkey).select("c_custkey", first_filled(own, F.col("n_name")).alias("subject"))  # nations: a fixed 25 rows


_DRAFTS = "SELECT l_orderkey AS paper, l_orderkey * 10 + l_linenumber AS draft, min(l_quantity) AS q, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2"
_ACTIONS = f"""SELECT paper, draft, CASE WHEN q < 10 OR p % 4 = 0 OR paper % 9 = 0 THEN 'review' WHEN paper % 5 = 0 THEN 'same paper' WHEN p % 7 = 0 THEN 'duplicate' ELSE 'save' END AS action,
    array_to_string(list_filter([CASE WHEN p % 4 = 0 THEN 'answer' END, CASE WHEN q < 10 THEN 'confidence' END, CASE WHEN paper % 9 = 0 THEN 'rules only' END], lambda x: x IS NOT NULL), ',') AS reasons FROM ({_DRAFTS})"""


def _committed(spark, d):
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_partkey")
    drafts = rows.groupBy(F.col("l_orderkey").alias("paper"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("draft")).agg(F.min("l_quantity").alias("q"), F.min("l_partkey").alias("p"))
    reasons = bank.review_reasons({"confidence": F.col("q") < 10, "answer": F.col("p") % 4 == 0})
    asked = drafts.select("paper", "draft", reasons.alias("reasons"), (F.col("paper") % 9 == 0).alias("rule_only"))
    return bank.auto_commit(asked, "paper", drafts.where("p % 7 = 0").select("draft"), drafts.where("paper % 5 = 0").select("paper").distinct())


@query(_ACTIONS)
def auto_commits(spark, d):
    """What becomes of each draft: review, the same paper, a duplicate, or saved."""
    return _committed(spark, d).withColumn("reasons", F.array_join("reasons", ","))


@query(f"WITH a AS ({_ACTIONS}) SELECT paper, reason, count(*) AS items FROM (SELECT paper, unnest(CASE WHEN action = 'review' THEN string_split(reasons, ',') WHEN action = 'duplicate' THEN ['duplicate'] END) AS reason FROM a) GROUP BY 1, 2")
def pending_reasons(spark, d):
    return bank.reason_counts(_committed(spark, d), "paper")


@query("WITH b AS (SELECT l_orderkey, l_returnflag, l_linenumber, least(200.0::DOUBLE, floor((l_quantity / 3) * 2 + 0.5) / 2) AS s FROM lineitem) SELECT l_orderkey, l_returnflag, count(*) AS items, sum(s) AS score, CASE WHEN min(s) = max(s) THEN min(s) END AS each, (row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber), l_returnflag))::INT AS section FROM b GROUP BY 1, 2")
def basket_sections(spark, d):
    rows = table(spark, d, "lineitem", "l_orderkey", "l_returnflag", "l_linenumber", "l_quantity").withColumn("score", F.col("l_quantity") / 3)
    return bank.basket(rows, "l_orderkey", "l_linenumber", "l_returnflag", "score")


@query(
    f"""WITH m AS ({_META}), v AS (SELECT trim(regexp_extract(region, '^\\s*([^·•/]*)', 1)) AS province, CASE o_orderkey % 5 WHEN 0 THEN '高一' WHEN 1 THEN '初三' WHEN 2 THEN '高三' WHEN 3 THEN '竞赛' ELSE '' END AS grade, list_min(list_transform(regexp_extract_all(school_year || ' ' || title, '(^|[^0-9])((19|20)[0-9][0-9])', 2), lambda y: y::INT)) AS y FROM m),
    c AS (SELECT 'region' AS facet, province AS value, count(*) AS items FROM v WHERE province <> '' GROUP BY 2 UNION ALL SELECT 'grade', grade, count(*) FROM v WHERE grade <> '' GROUP BY 2 UNION ALL SELECT 'year', y::VARCHAR, count(*) FROM v WHERE y IS NOT NULL GROUP BY 2)
    SELECT *, (row_number() OVER (PARTITION BY facet ORDER BY CASE facet WHEN 'region' THEN -items WHEN 'year' THEN -try_cast(value AS INT) ELSE CASE value WHEN '初三' THEN 1 WHEN '高一' THEN 2 WHEN '高三' THEN 3 ELSE 99 END END, value))::INT AS position FROM c"""
)
def question_facets(spark, d):
    """Regions by count, grades by their order, each question's least year downwards."""
    k = F.col("o_orderkey") % 5
    grade = F.when(k == 0, "高一").when(k == 1, "初三").when(k == 2, "高三").when(k == 3, "竞赛").otherwise("")
    return meta_facets(_meta(spark, d), province(F.col("region")), grade, years(F.col("school_year"), F.col("title")), ["初三", "高一", "高三"])


@query("WITH c AS (SELECT CASE WHEN coalesce(s, '') = '' THEN 'none' WHEN s IN ('BUILDING', 'SCHOOL') THEN s ELSE 'other' END AS value, count(*) AS items FROM (SELECT CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_mktsegment END AS s FROM customer) GROUP BY 1) SELECT value, items FROM c UNION ALL SELECT 'SCHOOL', 0")
def school_facet(spark, d):
    """Listed values even without rows, the rest folded into other, empty ones apart."""
    seg = F.when(F.col("c_custkey") % 10 == 0, "").otherwise(F.col("c_mktsegment"))
    counts = table(spark, d, "customer", "c_custkey", "c_mktsegment").groupBy(seg.alias("value")).agg(F.count(F.lit(1)).alias("items"))
    return folded(counts, "value", ["BUILDING", "SCHOOL"], "other", "none")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'new' ELSE 'old' END AS vector, CASE WHEN event_id % 3 = 0 THEN 'm2' ELSE 'm1' END AS model FROM events WHERE event_id % 2 = 0 UNION ALL SELECT event_id, 'old', 'm1' FROM events WHERE event_id % 2 = 1")
def applied_vectors(spark, d):
    """Vectors computed for every third row, of which those whose text has changed meanwhile (odd ones) are refused."""
    rows = table(spark, d, "events", "event_id", "event_type").select("event_id", F.col("event_type").alias("text"), F.lit("old").alias("vector"), F.lit("m1").alias("model"))
    made = rows.where("event_id % 3 = 0").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("text")).otherwise("before").alias("text"), F.lit("new").alias("vector"))
    return apply_embeddings(rows, made, "event_id", "text", "m2", "vector", "model").select("event_id", "vector", "model")


@query("SELECT c_custkey, '1:c' || c_custkey || ',2:b' AS points FROM customer")
def merged_points(spark, d):
    """Concepts given twice keep their first place and the last values."""
    p = lambda i, n: F.struct(F.lit(i).alias("id"), n.alias("name"))
    points = F.array(p(1, F.lit("a")), p(2, F.lit("b")), p(1, F.concat(F.lit("c"), F.col("c_custkey").cast("string"))))
    out = table(spark, d, "customer", "c_custkey").select("c_custkey", merge_points(points).alias("p"))
    return out.select("c_custkey", F.array_join(F.transform("p", lambda x: F.concat(x["id"].cast("string"), F.lit(":"), x["name"])), ",").alias("points"))


@query("SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40")
def paper_page(spark, d):
    """A page of papers, newest first, with how many there are; the total is one row beside a page of twenty."""
    found = bank.search(table(spark, d, "orders", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate"), bank.BankFilter(equal={"o_orderstatus": "F"}))
    one = found.agg(F.count(F.lit(1)).alias("total"))
    return bank.page(found, [F.desc("o_orderdate"), F.asc("o_orderkey")], 40, 20).join(F.broadcast(one)).select("o_orderkey", "o_totalprice", "total")  # a page and one row
