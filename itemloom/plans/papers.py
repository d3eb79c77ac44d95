"""Paper summaries, ranks, renumbering, scores and composition."""

from pyspark.sql import functions as F

from itemloom.operators import library
from itemloom.operators.apportion import apportion, assign_scores, even_split, scale
from itemloom.operators.compose import Blueprint, compose, topics
from itemloom.operators.layout import paginate
from itemloom.operators.mutate import merge_into_previous
from itemloom.plans.registry import query
from itemloom.sources.tables import table


def _lines(spark, d, *more):
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", *more).withColumn("coef", F.round(F.col("l_discount") * 10, 2))


_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_discount"]


@query(
    """SELECT l_orderkey AS paper, count(*) AS items, sum(l_quantity) AS total_score, max(o_orderdate) AS updated_at,
    round(CASE WHEN sum(l_quantity) <> 0 THEN sum(round(l_discount * 100)::BIGINT * l_quantity::BIGINT)::DOUBLE / 10 / sum(l_quantity) ELSE avg(l_discount * 10) END + 1e-9, 2) AS avg_coef
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1"""
)
def paper_summary(spark, d):
    """Summaries by line first, so that only one row a paper meets the orders."""
    lines = _lines(spark, d).withColumn("tenths", F.round(F.col("l_discount") * 100).cast("long"))
    each = lines.groupBy(F.col("l_orderkey").alias("paper")).agg(F.count(F.lit(1)).alias("items"), F.sum("l_quantity").alias("total_score"), F.sum(F.col("tenths") * F.col("l_quantity").cast("long")).alias("w"), F.avg("coef").alias("mean"))
    orders = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    coef = F.when(F.col("total_score") != 0, F.col("w").cast("double") / 10 / F.col("total_score")).otherwise(F.col("mean"))
    return each.join(orders, each.paper == orders.o_orderkey).select("paper", "items", "total_score", F.col("o_orderdate").cast("timestamp_ntz").alias("updated_at"), F.round(coef + 1e-9, 2).alias("avg_coef"))


@query("SELECT l_orderkey, string_agg(l_returnflag || ':' || n, ',' ORDER BY l_returnflag) AS kinds FROM (SELECT l_orderkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1")
def type_counts(spark, d):
    kinds = library.kind_counts(table(spark, d, "lineitem", "l_orderkey", "l_returnflag"), "l_orderkey", "l_returnflag")
    text = F.array_join(F.transform(F.array_sort(F.map_entries("kinds")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return kinds.select("l_orderkey", text.alias("kinds"))


@query("SELECT o_orderkey, greatest(coalesce(n, 0), o_orderkey % 7)::BIGINT AS source_items FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def source_items(spark, d):
    n = table(spark, d, "lineitem", "l_orderkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    orders = table(spark, d, "orders", "o_orderkey")
    return orders.join(n, orders.o_orderkey == n.l_orderkey, "left").select("o_orderkey", F.greatest(F.coalesce("n", F.lit(0)), F.col("o_orderkey") % 7).alias("source_items"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, d):
    orders = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate", "o_totalprice")
    return library.latest(orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


_LINES = "SELECT *, l_returnflag AS kind FROM lineitem"
_SORT = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_extendedprice"


@query(
    f"""SELECT l_orderkey, l_linenumber, l_partkey, round((CASE kind WHEN 'A' THEN 0.12 WHEN 'N' THEN 0.2 ELSE 0.25 END)::DOUBLE + ((CASE kind WHEN 'A' THEN 0.55 WHEN 'N' THEN 0.65 ELSE 0.75 END)::DOUBLE - (CASE kind WHEN 'A' THEN 0.12 WHEN 'N' THEN 0.2 ELSE 0.25 END)::DOUBLE) *
    CASE WHEN n > 1 THEN (r - 1)::DOUBLE / (n - 1) ELSE 0.3::DOUBLE END + 1e-9, 2) AS coef
    FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, kind) AS n, row_number() OVER (PARTITION BY l_orderkey, kind ORDER BY {_SORT}) AS r FROM ({_LINES}))"""
)
def baseline_difficulty(spark, d):
    kind = F.col("l_returnflag")
    low, high = F.when(kind == "A", 0.12).when(kind == "N", 0.2).otherwise(0.25), F.when(kind == "A", 0.55).when(kind == "N", 0.65).otherwise(0.75)
    coef = library.rank_within(["l_orderkey", "l_returnflag"], [*_ORDER, "l_extendedprice"], low, high)
    return _lines(spark, d, "l_extendedprice").withColumn("coef", coef).select("l_orderkey", "l_linenumber", "l_partkey", "coef")


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SORT}))::INT AS no FROM lineitem")
def renumbered_lines(spark, d):
    return library.renumber(_lines(spark, d, "l_extendedprice"), ["l_orderkey"], [*_ORDER, "l_extendedprice"]).select("l_orderkey", "l_partkey", "l_suppkey", "no")


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, (1 + coalesce(sum(CASE WHEN l_quantity > 40 THEN 3 ELSE 1 END) OVER (PARTITION BY l_orderkey ORDER BY {_SORT} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::INT AS no FROM lineitem")
def split_shift(spark, d):
    parts = F.when(F.col("l_quantity") > 40, 3).otherwise(1)
    return library.split_shift(_lines(spark, d, "l_extendedprice"), ["l_orderkey"], [*_ORDER, "l_extendedprice"], parts).select("l_orderkey", "l_partkey", "l_suppkey", "no")


@query("SELECT p_partkey, CASE WHEN r = 1 THEN p_name ELSE p_name || '#' || r END AS p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, p_name ORDER BY p_partkey) AS r FROM part)")
def duplicate_names(spark, d):
    return library.duplicate_suffix(table(spark, d, "part", "p_partkey", "p_brand", "p_name"), ["p_brand"], "p_name", ["p_partkey"]).select("p_partkey", "p_name")


@query(
    """WITH w AS (SELECT o_custkey, o_orderkey, o_totalprice::DOUBLE AS w, count(*) OVER c AS n, sum(o_totalprice::DECIMAL(18,2)) OVER c AS tw FROM orders WINDOW c AS (PARTITION BY o_custkey)),
    r AS (SELECT *, (100 - n) * w / tw::DOUBLE AS raw FROM w), f AS (SELECT *, floor(raw) AS fl FROM r),
    k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY round(fl - raw, 9), o_orderkey) AS rk, (100 - n) - sum(fl) OVER (PARTITION BY o_custkey) AS rest FROM f)
    SELECT o_custkey, o_orderkey, CASE WHEN n <= 100 THEN (fl + (rk <= rest)::INT + 1)::BIGINT END AS share FROM k"""
)
def apportion_scores(spark, d):
    orders = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    return apportion(orders, ["o_custkey"], ["o_orderkey"], F.col("o_totalprice"), F.lit(100)).select("o_custkey", "o_orderkey", "share")


@query(f"SELECT l_orderkey, l_partkey, l_suppkey, (100 // n + (r > n - 100 % n)::INT)::BIGINT AS share FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_SORT}) AS r FROM lineitem)")
def even_scores(spark, d):
    return even_split(_lines(spark, d, "l_extendedprice"), ["l_orderkey"], [*_ORDER, "l_extendedprice"], F.lit(100)).select("l_orderkey", "l_partkey", "l_suppkey", "share")


@query(
    f"""WITH b AS (SELECT *, CASE l_returnflag WHEN 'A' THEN 5 WHEN 'N' THEN 4 ELSE 12 END AS base FROM lineitem), w AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN base * (0.8::DOUBLE + 0.5::DOUBLE * round(l_discount * 10, 2)) ELSE base END::DOUBLE AS wt FROM b),
    o AS (SELECT *, sum(wt) OVER p AS tw, max(l_returnflag) OVER p AS top FROM w WINDOW p AS (PARTITION BY l_orderkey)), e AS (SELECT *, l_returnflag = top AS flex, greatest(1, round_even(base * 150 / tw, 0))::BIGINT AS each FROM o),
    f AS (SELECT *, sum(CASE WHEN flex THEN 0 ELSE each END) OVER p AS fixed, sum(flex::INT) OVER p AS m FROM e WINDOW p AS (PARTITION BY l_orderkey)), s AS (SELECT *, 150 - fixed >= m AS split FROM f), t AS (SELECT *, CASE WHEN split THEN flex ELSE true END AS part, CASE WHEN split THEN 150 - fixed ELSE 150 END AS amount FROM s),
    x AS (SELECT *, (amount - count(*) OVER q) * wt / sum(wt) OVER q AS raw, amount - count(*) OVER q AS extra FROM t WHERE part WINDOW q AS (PARTITION BY l_orderkey)), k AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(floor(raw) - raw, 9), {_SORT}) AS rk, extra - sum(floor(raw)) OVER (PARTITION BY l_orderkey) AS rest FROM x)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, (floor(raw) + (rk <= rest)::INT + 1)::BIGINT AS assigned FROM k UNION ALL SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, each FROM t WHERE NOT part"""
)
def assigned_scores(spark, d):
    """Papers of 150 points; kind R, or else the last kind (by name), shares what the other kinds leave, by difficulty."""
    base = F.when(F.col("l_returnflag") == "A", 5).when(F.col("l_returnflag") == "N", 4).otherwise(12)
    weight = F.when(F.col("l_returnflag") == "R", base * (0.8 + 0.5 * F.col("coef"))).otherwise(base)
    out = assign_scores(_lines(spark, d, "l_extendedprice"), ["l_orderkey"], [*_ORDER, "l_extendedprice"], F.col("l_returnflag"), "R", base, weight, F.lit(150))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "assigned")


def _points(spark, d):
    """Suppliers as concepts: region / nation / supplier."""
    s, n, r = table(spark, d, "supplier", "s_suppkey", "s_name", "s_nationkey"), table(spark, d, "nation"), table(spark, d, "region")
    small = F.broadcast(n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", "n_name", "r_name"))  # nations: a fixed 25 rows
    return s.join(small, s.s_nationkey == F.col("n_nationkey")).select(F.col("s_suppkey"), F.concat_ws(" / ", "r_name", "n_name", "s_name").alias("path"))


@query()
def compose_select(spark, d):
    """One paper for each market segment out of its orders' lines, favouring one nation's concepts."""
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_discount")
    seg = table(spark, d, "orders", "o_orderkey", "o_custkey").join(table(spark, d, "customer", "c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment")
    rows = lines.join(seg, lines.l_orderkey == seg.o_orderkey).join(_points(spark, d), lines.l_suppkey == F.col("s_suppkey"))
    part = table(spark, d, "part", "p_partkey", "p_name", "p_type", "p_brand")
    rows = rows.join(part, rows.l_partkey == part.p_partkey)
    rows = rows.groupBy("c_mktsegment", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("item")).agg(F.min(F.concat_ws(" ", "p_name", "p_type", "p_brand")).alias("stem"), F.min("l_returnflag").alias("kind"), F.min("path").alias("path"), F.round(F.min("l_discount") * 10, 2).alias("coef"))
    return compose(rows, ["c_mktsegment"], "item", "kind", "path", "coef", Blueprint({"A": 8, "N": 4, "R": 6}, 0.5, {"ASIA": 2}, ("AFRICA",)))


@query(
    """WITH p AS (SELECT s_suppkey, r_name || ' / ' || n_name AS b, r_name || ' / ' || n_name || ' / ' || s_name AS c FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
    SELECT topic, count(DISTINCT l_partkey) AS items FROM (SELECT l_partkey, b AS topic FROM lineitem JOIN p ON l_suppkey = s_suppkey UNION ALL SELECT l_partkey, c FROM lineitem JOIN p ON l_suppkey = s_suppkey) GROUP BY 1 ORDER BY items DESC, topic LIMIT 200"""
)
def topic_catalog(spark, d):
    lines = table(spark, d, "lineitem", "l_partkey", "l_suppkey")
    met = lines.join(_points(spark, d), lines.l_suppkey == F.col("s_suppkey")).select("l_partkey", "path")
    return topics(met, "l_partkey", "path")


@query(
    """WITH t AS (SELECT *, length(text)::DOUBLE AS s, CASE WHEN role = 'user' THEN 0.4 ELSE 0.6 END::DOUBLE AS c, row_number() OVER w AS r FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    n AS (SELECT *, sum((role <> 'assistant' OR r = 1)::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS no FROM t)
    SELECT conv_id, no::BIGINT AS no, string_agg(text, '；' ORDER BY turn) AS text, sum(s) AS score, round(CASE WHEN sum(s) > 0 THEN sum(c * s) / sum(s) ELSE avg(c) END, 2) AS coef FROM n GROUP BY 1, 2"""
)
def merged_questions(spark, d):
    """Turns of the assistant join the user's turn before them, as follow-ups of a question do."""
    turns = table(spark, d, "conversations").withColumn("score", F.length("text").cast("double")).withColumn("coef", F.when(F.col("role") == "user", 0.4).otherwise(0.6))
    return merge_into_previous(turns, ["conv_id"], "turn", F.col("role") == "assistant", "text", "score", "coef")


@query(
    """WITH RECURSIVE h AS (SELECT conv_id, turn, ceil(length(text) / 40)::DOUBLE AS h, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
    w AS (SELECT conv_id, i, turn, h AS used, 1 AS page FROM h WHERE i = 1 UNION ALL SELECT h.conv_id, h.i, h.turn, CASE WHEN w.used > 0 AND w.used + h.h > 60 THEN h.h ELSE w.used + h.h END, w.page + (w.used > 0 AND w.used + h.h > 60)::INT FROM w JOIN h ON h.conv_id = w.conv_id AND h.i = w.i + 1)
    SELECT conv_id, turn, page::INT AS page FROM w"""
)
def paginated_turns(spark, d):
    heights = table(spark, d, "conversations", "conv_id", "turn", "text").select("conv_id", "turn", (F.ceil(F.length("text") / 40) * 1.0).alias("height"))
    return paginate(heights, ["conv_id"], "turn", "height", 60.0)


@query("SELECT l_orderkey, l_linenumber, l_partkey, (dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey))::INT AS page FROM lineitem")
def dense_pages(spark, d):
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").withColumnRenamed("l_suppkey", "page")
    return library.dense_pages(rows, "l_orderkey", "page").select("l_orderkey", "l_linenumber", "l_partkey", "page")


@query(
    """WITH r AS (SELECT o_custkey, o_orderkey, 60 * o_totalprice / sum(o_totalprice::DECIMAL(18,2)) OVER (PARTITION BY o_custkey)::DOUBLE AS raw FROM orders), f AS (SELECT *, floor(raw) AS fl FROM r)
    SELECT o_custkey, o_orderkey, (fl + (row_number() OVER (PARTITION BY o_custkey ORDER BY round(fl - raw, 9), o_orderkey) <= 60 - sum(fl) OVER (PARTITION BY o_custkey))::INT)::BIGINT AS scaled FROM f"""
)
def scaled_scores(spark, d):
    orders = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_totalprice")
    return scale(orders, ["o_custkey"], ["o_orderkey"], F.col("o_totalprice"), F.lit(60)).select("o_custkey", "o_orderkey", "scaled")
